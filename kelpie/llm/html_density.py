"""Main text of HTML pages by composite text density.

The page becomes a tree of block elements; inline elements count as tags of the
block they stand in. Every block gets its link-adjusted density

    CTD = C/T * log_x(C/LC * T/LT),   x = ln(C/(C-LC) * LC + LCb/Cb * C + e)

from the characters C, tags T, link characters LC and link tags LT below it, and
the page's share of link characters LCb/Cb (zero denominators count as one; on a
page without links the density is C/T). The density sum of a block is the sum
over its child blocks. The block of the largest sum is the seed; the threshold
is the smallest density on the path from it to the body. A block beside that path
belongs to the text if it reaches the threshold; a heading does without. Close to
the seed (in the article or main element around it, else in its parent, or under
the body a section of the seed's kind with a heading of its own) short sections
are thin but are text, so there only blocks under the threshold that are links
for the most part go. Inside whatever is kept, such blocks of links go as well.

Before that, what is never article text is taken out: scripts, styles, forms,
menus, page headers and footers, sidebars, hidden parts, and elements whose
class, id or role names adverts, notices, navigation or reader comments.

Edge cases: a null or empty page, or one without text, has the empty text; tags
that are not closed, closed twice or cut off at the end are tolerated; a null
page_id or url is passed through; repeated rows are kept; nothing is cut from
long pages; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.bpe import slices

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_NAMES = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Fixed values of the HTML standard: elements without content, with raw content, and laid out as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul svg canvas audio video object map math iframe script style textarea title".split()
)
CLOSES_P = BLOCK - frozenset("body head html tr td th tbody thead tfoot caption option optgroup button legend script style template noscript".split())
SCOPE = frozenset("html table td th button template object caption".split())
#: What a start tag closes, and what it does not reach beyond.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "body": ({"head"}, set()),
}
NEVER_TEXT = frozenset("aside audio button canvas dialog form head iframe map math menu nav noscript object optgroup option script search select style svg template textarea title video".split())
NAMED_OUT = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe breadcrumb breadcrumbs "
    "comment comments commentlist disqus respond replies popup modal navbar nav navigation menu sidebar contentinfo complementary".split()
)
#: These are out unless the name also speaks of the content.
NAMED_DOUBTFUL = frozenset("banner notice notices alert footer header masthead toolbar related recommended recommendations share sharing social widget widgets pagination pager login signup search skip overlay aside topbar".split())
NAMED_CONTENT = frozenset("article content entry main post story text body page".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never taken for a list of links.
KEPT = HEADINGS | {"p"}


class Block:
    __slots__ = ("name", "parent", "out", "chars", "tags", "link_chars", "link_tags", "children", "density", "total")

    def __init__(self, name: str, parent: Block | None, out: bool):
        self.name, self.parent, self.out = name, parent, out
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.children: list[Block] = []
        self.density = self.total = 0.0
        if parent is not None:
            parent.children.append(self)


def _named_out(attributes: str) -> bool:
    """Whether an element's attributes take it out."""
    out = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "itemprop"):
            names = set(_NAMES.findall(_CAMEL.sub(" ", value).lower()))
            out |= bool(names & NAMED_OUT) or (bool(names & NAMED_DOUBTFUL) and not names & NAMED_CONTENT)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            out = True
    return out


def parse(page: str) -> tuple[list[Block], list[tuple[Block, list[str]]], float]:
    """The blocks in page order, the runs of text with the block they stand in, and the share of link characters of the whole page."""
    root = Block("html", None, False)
    blocks, runs = [root], []
    stack: list[tuple[str, Block, int, int]] = []  # open elements and the links open before them; inline ones stand with the block around them
    at_block, in_link, wide = root, 0, 0  # wide: of the open links those that are closed, and so hold the blocks inside them
    run: list[str] = []
    all_chars = all_links = 0
    inside = 0  # depth of article and main

    def text(raw: str) -> None:
        nonlocal all_chars, all_links
        if not raw:
            return
        if "&" in raw:
            raw = html.unescape(raw)
        run.append(raw)
        n = len(raw) if not raw.isspace() else 0
        all_chars += n
        all_links += n if in_link else 0
        if not at_block.out:
            at_block.chars += n
            if in_link:
                at_block.link_chars += n

    def cut() -> None:
        nonlocal run
        if run:
            if not at_block.out:
                runs.append((at_block, run))
            run = []

    def close(depth: int) -> None:
        nonlocal at_block, in_link, wide, inside
        while len(stack) > depth:
            name, block, links, wide_links = stack.pop()
            if block is not at_block or name in BLOCK:
                cut()
            if name in BLOCK:
                at_block = block.parent or root
                inside -= name in ("article", "main")
            if name in BLOCK or name == "a":
                in_link, wide = links, wide_links

    def find(names: set[str], limits) -> int | None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in limits:
                return None
        return None

    at = 0
    for_next = _TOKEN.search
    while m := for_next(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue  # a comment or a declaration
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            limits = SCOPE - {name} if name not in ("html", "body") else ()
            i = find({name}, limits if name in BLOCK else BLOCK)
            if i is not None:
                close(i)
            continue
        if name in CLOSES_P and (i := find({"p"}, SCOPE)) is not None:
            close(i)
        if name in CLOSED_BY and (i := find(*CLOSED_BY[name])) is not None:
            close(i)
        if name == "a" and (i := find({"a"}, BLOCK)) is not None:
            close(i)
        at_block.tags += not at_block.out
        if name in VOID:
            if name == "br":
                run.append(" ")
            elif name in BLOCK:
                cut()
            continue
        if name in BLOCK or name in RAW:
            cut()
            out = bool(attributes) and name not in ("html", "body", "article", "main") and _named_out(attributes)
            out |= name in NEVER_TEXT or name == "footer" or name == "header" and not inside
            block = Block(name, at_block, out or at_block.out)
            blocks.append(block)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            stack.append((name, block, in_link, wide))
            at_block, in_link = block, wide
            inside += name in ("article", "main")
        else:
            if not attributes.rstrip().endswith("/") or name == "a":
                stack.append((name, at_block, in_link, wide))
            if name == "a":
                ends = _ANCHOR.search(page, at)
                in_link += 1
                wide += ends is not None and ends[1] == "/"
                at_block.link_tags += not at_block.out
    rest = page[at:]
    if (i := rest.rfind("<")) >= 0 and re.match(r"</?[a-zA-Z][^<>]*$", rest[i:]):
        rest = rest[:i]  # a tag that the page's end cuts off
    text(rest)
    close(0)
    cut()
    return blocks, runs, all_links / max(1, all_chars)


def composite(chars: int, tags: int, link_chars: int, link_tags: int, links: float) -> float:
    if not chars:
        return 0.0
    tags = max(1, tags)
    if not links:
        return chars / tags
    x = math.log(chars / max(1, chars - link_chars) * link_chars + links * chars + math.e)
    y = chars / max(1, link_chars) * tags / max(1, link_tags)
    return chars / tags * max(0.0, math.log(max(y, 1)) / math.log(max(x, 1 + 1e-9))) if x > 1 + 1e-9 else chars / tags


def measure(blocks: list[Block], links: float) -> list[Block]:
    """Sums up counts from the children, sets densities and density sums; returns the blocks with text."""
    for b in reversed(blocks):  # children come after their parent
        if b.parent is not None and not b.out:
            p = b.parent
            p.chars += b.chars
            p.tags += b.tags
            p.link_chars += b.link_chars
            p.link_tags += b.link_tags
        b.density = composite(b.chars, b.tags, b.link_chars, b.link_tags, links) if not b.out else 0.0
    kept = [b for b in blocks if not b.out and b.chars]
    for b in kept:
        b.total = sum(c.density for c in b.children if not c.out)
    return kept


def select(blocks: list[Block], kept: list[Block]) -> set[Block]:
    """The blocks whose own runs of text belong to the text."""
    seed = max(kept, key=lambda b: b.total)  # of equals the first, the outermost
    path = [seed]
    while path[-1].parent is not None and path[-1].name != "body":
        path.append(path[-1].parent)
    threshold, top = min(b.density for b in path), path[-1]
    around = [b for b in path if b.name in ("article", "main")]
    parent = path[1] if len(path) > 2 else seed
    core = around[0] if around else parent
    headed: set[Block] = set()
    for b in kept:
        if b.name in HEADINGS:
            up = b.parent
            while up is not None and up not in headed:
                headed.add(up)
                up = up.parent
    on_path, chosen, inside = set(path), set(), set()
    for b in blocks:  # parents come first
        if b is top or b.out or b.parent not in chosen:
            taken = b is top
        elif b in on_path:
            taken = True
        elif b.density >= threshold:
            taken = True
        elif b.name not in KEPT and 2 * b.link_chars > b.chars:
            taken = False
        else:
            akin = b.parent is seed.parent and b.name == seed.name and b in headed
            taken = b.parent in inside or b.name in HEADINGS or akin
        if taken:
            chosen.add(b)
            if b is core or b.parent in inside or b not in on_path:
                inside.add(b)
    return chosen


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks, runs, links = parse(page)
    kept = measure(blocks, links)
    if not kept:
        return ""
    chosen = select(blocks, kept)
    lines = (" ".join("".join(run).split()) for block, run in runs if block in chosen)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every whole page, in one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column=2):
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
