"""Sharding, the language model, toxicity, HTML extraction and the pipeline against brute force and planted cases."""

import collections
import html.parser
import math
import random
import zlib

import numpy as np
import pytest

import public_tokenizers as P
from kelpie.llm import html_density, interpolation, sharding, toxicity
from tests.llm.conftest import SCHEMA, edge_rows, row, sentence
from tests.llm.test_near_copies import brute_kept


@pytest.mark.parametrize("ways", [2, 3, 7])
def test_differencing_places_every_group(ways):
    rng = random.Random(ways)
    for _ in range(60):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(25))]
        out = sharding.difference([[(x, j)] for j, x in enumerate(sizes)], ways)
        assert len(out) == ways and sorted(j for o in out for j in o) == list(range(len(sizes)))


def test_differencing_known_case():
    """The textbook case: 8, 7, 6, 5, 4 end two apart."""
    sizes = [8, 7, 6, 5, 4]
    sums = sorted(sum(sizes[j] for j in o) for o in sharding.difference([[(x, j)] for j, x in enumerate(sizes)], 2))
    assert sums == [14, 16]


def test_differencing_beats_greedy():
    rng = random.Random(8)
    sizes = [rng.randrange(10**6, 10**7) for _ in range(200)]
    sums = [sum(sizes[j] for j in o) for o in sharding.difference([[(x, j)] for j, x in enumerate(sizes)], 8)]
    greedy = [0] * 8
    for x in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += x
    assert max(sums) - min(sums) < max(greedy) - min(greedy)


def brute_difference(sizes, ways):
    """Plain Karmarkar-Karp: whole lists of sums, always the two of largest spread, the first made first."""
    heap = [(-x, k, [0] * (ways - 1) + [x]) for k, x in enumerate(sizes)]
    made = len(heap)
    while len(heap) > 1:
        heap.sort()
        (_, _, a), (_, _, b), *heap = heap
        sums = sorted(x + y for x, y in zip(a, reversed(b), strict=True))
        heap.append((sums[0] - sums[-1], made, sums))
        made += 1
    return heap[0][2]


@pytest.mark.parametrize("ways", [2, 5, 40])
def test_differencing_against_plain_lists(ways):
    rng = random.Random(ways)
    sizes = rng.sample(range(10**6, 10**9), 150)
    found = sharding.difference([[(x, j)] for j, x in enumerate(sizes)], ways)
    assert sorted(sum(sizes[j] for j in o) for o in found) == brute_difference(sizes, ways)


def test_shards_against_plain_differencing(spark):
    """The whole query on a small table: its shards are those of the plain algorithm over groups of equal texts."""
    rng = random.Random(4)
    texts = [f"{i} " + "x" * rng.randrange(100_000) for i in range(90)]
    rows = [row(i, t) for i, t in enumerate(texts)] + [row(500 + i, texts[i % 7]) for i in range(20)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 8).groupBy("shard").sum("size").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[1]] += len(r[1]) + 16
    groups = [sizes[t] for t in texts]
    assert len(set(groups)) == len(groups) and sorted(r[1] for r in got) == brute_difference(groups, 8)


@pytest.mark.parametrize("most,last_cells", [(50_000, 1000), (6, 2), (20, 3)])
def test_shards(docs, empty, most, last_cells):
    """In one task, and in several levels."""
    got = sharding.shard_by_bytes(docs, 4, most=most, last_cells=last_cells).collect()
    texts = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in edge_rows())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    shards, groups = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        shards[r.shard].append(r.slot)
        groups[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and all(len(s) == 1 for s in groups.values())
    assert sharding.shard_by_bytes(empty, 4).count() == 0


def test_shards_are_near_equal(spark):
    rows = [row(i, sentence(i, 20 + i % 50)) for i in range(400)] + [row(1000 + i, "copy " * 30) for i in range(100)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 4).groupBy("shard").sum("size").collect()
    sums = [r[1] for r in got]
    assert len(sums) == 4 and max(sums) - min(sums) <= 0.01 * max(sums)


@pytest.mark.parametrize("most,last_cells,apart", [(500, 1000, 0.002), (200, 10, 0.08)])
def test_heavy_groups_are_balanced_in_levels(spark, most, last_cells, apart):
    """A group of a fifth of all bytes, among 4 shards and several tasks, or levels down to 40 bundles, which are as coarse as a fiftieth."""
    rows = [row(i, f"text {i} " * (5 + i % 7)) for i in range(4000)] + [row(10_000 + i, "copy " * 40) for i in range(440)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 4, most=most, last_cells=last_cells).groupBy("shard").sum("size").collect()
    sums = [r[1] for r in got]
    assert len(sums) == 4 and max(sums) - min(sums) <= apart * max(sums)


def brute_weights(cells, uniform):
    """Plain expectation-maximisation over single tokens, by bucket."""
    out, last = {}, (0.0, 0.9, 0.1)
    for b in range(65):
        own = [p for bucket, *p in cells if bucket == b]
        if own:
            w = [1 / 3] * 3
            for _ in range(200):
                shares = [0.0] * 3
                for p in own:
                    mixed = [x * y for x, y in zip(w, (*p, uniform), strict=True)]
                    shares = [s + x / sum(mixed) for s, x in zip(shares, mixed, strict=True)]
                w = [x / len(own) for x in shares]
            w = [w[0], w[1], max(w[2], 1e-6)]
            last = tuple(x / sum(w) for x in w)
        out[b] = last
    return out


def brute_model(rows):
    tokens = [(r[0], [w for w in (r[1] or "").encode().lower().split()] + [b""]) for r in rows]
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5

    def counts(folds):
        one, two = collections.Counter(), collections.Counter()
        for d, w in tokens:
            if fold(d) in folds:
                one.update(w)
                two.update(zip([b"", *w], w, strict=False))
        return one, two

    one, two = counts({0, 2, 3, 4})
    kept, kept2 = counts({2, 3, 4})
    n, m = sum(one.values()), sum(kept.values())
    cells = []
    for d, w in tokens:
        if fold(d) == 0:
            for v, x in zip([b"", *w], w, strict=False):
                cells.append((kept[v].bit_length(), kept2[v, x] / kept[v] if kept[v] else 0.0, kept[x] / m if m else 0.0))
    weights = brute_weights(cells, 1 / (len(kept) + 1))
    out = []
    for d, w in tokens:
        base = sum(math.log10((one[x] + 0.5) / (n + 0.5 * (len(one) + 1))) for x in w)
        score = 0.0
        for v, x in zip([b"", *w], w, strict=False):
            a, b, c = weights[one[v].bit_length()]
            score += math.log10(a * (two[v, x] / one[v] if one[v] else 0) + b * (one[x] / n if n else 0) + c / (len(one) + 1))
        out.append((d if d is not None else -99, fold(d) == 1, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("bits,most", [(8, 8 << 20), (1, 2000)])
def test_interpolation(docs, empty, monkeypatch, bits, most):
    """Against plain counts and plain expectation-maximisation; also with sums over many levels of small groups."""
    monkeypatch.setattr(interpolation, "CHUNK_BYTES", most)
    got = sorted((r[0] if r[0] is not None else -99, *r[1:]) for r in interpolation.score(docs, bits=bits).collect())
    want = brute_model(edge_rows())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], rel=2e-3)
    assert interpolation.score(empty).count() == 0


def test_trigrams(spark):
    """A word that the two before it fix: trigrams know it, bigrams do not."""
    rng = random.Random(9)
    rows = [row(i, " ".join(f"{a} {b} {a}{b}" for a, b in ((rng.choice("xyz"), rng.choice("uvw")) for _ in range(30)))) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    two, three = (sum(r.score for r in interpolation.score(docs, order=k).collect() if r.held_out) for k in (2, 3))
    assert three > 0.8 * two


def test_interpolation_without_training(docs):
    held = docs.filter("doc_id is not null and pmod(crc32(cast(doc_id as string)), 5) = 1")
    rows = interpolation.score(held).collect()
    assert rows and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)


def test_held_out_gain(spark):
    rows = [row(i, sentence(i % 60, 80)) for i in range(600)]
    got = [r for r in interpolation.score(spark.createDataFrame(rows, SCHEMA)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_weights_maximise_likelihood():
    rng = np.random.default_rng(3)
    cells = [(4, float(n), a, b) for n, a, b in zip(rng.integers(1, 50, 40), rng.random(40) * (rng.random(40) > 0.4), rng.random(40) / 50, strict=True)]
    w = np.array(interpolation.maximise(cells, 0.001)[4])
    value = lambda w: sum(n * math.log(w[0] * a + w[1] * b + w[2] * 0.001) for _, n, a, b in cells)
    assert w.sum() == pytest.approx(1) and (w > 0).all()
    for _ in range(200):
        other = rng.dirichlet([1, 1, 1])
        assert value(other) <= value(w) + 1e-3


def test_grammar():
    lexicon = toxicity.Lexicon()
    score = lambda t: toxicity.features(t, lexicon)
    assert score("") == score(None) == score("a calm sentence about rivers.") == (0.0, 0.0, 0.0, 0.0)
    plain, aimed = score("an idiot walked by"), score("you are an idiot")
    negated, told, quoted = score("he is not an idiot"), score("she said the man is an idiot"), score('the "idiot" sign')
    assert aimed[0] > plain[0] > 0
    assert negated[0] == told[0] == quoted[0] == 0.0 and negated[2] > 0 and told[2] > 0 and quoted[2] > 0
    assert score("I will kill time.")[0] < score("you, I will kill")[0]
    assert score("not today. you idiot")[0] > 0  # the clause bound ends the negation


def test_each_transducer():
    """Alone, and composed: gains add up, weights multiply, and a damped part damps the whole."""
    run = lambda symbols, *parts: [row for row in walk(toxicity.Transducer.compose(*parts), symbols)]

    def walk(table, symbols):
        state = 0
        for s in symbols:
            state, gain, damped = table[state][s]
            yield round(gain, 6), damped

    assert run("9CO9", toxicity.insults()) == [(1.0, False), (0.0, False), (0.0, False), (1.3, False)]
    assert run("TOY", toxicity.threats()) == [(0.1, False), (0.0, False), (0.2, False)]
    assert run("WT", toxicity.threats())[-1] == (0.3, False) and run("TOOOY", toxicity.threats())[-1] == (0.0, False)
    assert run("YO9", toxicity.insults(), toxicity.targeted())[-1] == (1.5, False)
    assert run("YWT", toxicity.threats(), toxicity.targeted())[-1] == (1.2, False)
    assert run("NO9", toxicity.insults(), toxicity.negation())[-1] == (0.3, True)
    assert run("NTY", toxicity.threats(), toxicity.negation())[1:] == [(0.03, True), (0.06, True)]
    assert run("ROO9", toxicity.insults(), toxicity.reported())[-1] == (0.5, True)
    assert run("Q9Q9", toxicity.insults(), toxicity.reported()) == [(0.0, False), (0.5, True), (0.0, False), (1.0, False)]
    assert toxicity.clause_score("YC9") == (pytest.approx(1.95), 0.0) and toxicity.clause_score("9" * 50)[0] == pytest.approx(50.0)


def test_grammar_against_its_parts():
    """The composed automaton over random clauses, against its five transducers run side by side."""
    rng = random.Random(11)
    parts = [toxicity.insults(), toxicity.threats(), toxicity.targeted(), toxicity.negation(), toxicity.reported()]
    for _ in range(400):
        symbols = "".join(rng.choice(toxicity.SYMBOLS) for _ in range(rng.randrange(25)))
        states, plain, damped = [0] * 5, 0.0, 0.0
        for s in symbols:
            steps = [p.step(state, s) for p, state in zip(parts, states, strict=True)]
            states = [x[0] for x in steps]
            gain = sum(x[1] for x in steps) * math.prod(x[2] for x in steps)
            plain, damped = (plain, damped + gain) if any(x[3] for x in steps) else (plain + gain, damped)
        assert toxicity.clause_score(symbols) == (pytest.approx(plain), pytest.approx(damped))


def toxic_rows():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(240):
        words, bad = sentence(i, 60).split(), i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "grobnika", "zlurping", "idiot"]))
        rows.append(row(i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_is_learned(spark, empty):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows + [row(900, None), row(901, ""), row(None, "idiot you"), row(0, rows[0][1])], SCHEMA)
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 4
    truth = {i: t for i, _, t in labels}
    assert all(r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.doc_id: r.held_out for r in got}[1] == (zlib.crc32(b"1") % 4 == 2)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    # Labels of the unseen fold change nothing.
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = toxicity.fit(docs, flipped)
    assert again.learned == model.learned and again.weights == model.weights
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_without_labels(docs, spark):
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert model.learned == {} and toxicity.score(docs, model).count() == len(edge_rows())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><div id="topMenu"><a href=x>Home</a> <a href=y>About us</a></div>
<header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>{0}<aside>aside</aside><form><input>Search</form><script>if (a < b) {{ "</p>" }}</script><footer>(c)</footer></body>"""


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><h1>Head</h1><p><b>One.<br><p>Two &amp; <a href=z>three</a>&nbsp;four.</p></article>", "Head\nOne.\nTwo & three four."),
        ("<div class=wrap><div class=story><h2>Head</h2><p>A first paragraph, long enough to count.</p><p>A second one, which is long too.<ul><li>item one<li>item two</ul></div><div class='comments'><p>Nice post!</p></div></div>", "Head\nA first paragraph, long enough to count.\nA second one, which is long too.\nitem one\nitem two"),
        ("<main><p>Only   one\n line</p><div class=ad>Buy</div><nav>n</nav></main>", "Only one line"),
        ("<article><header><h1>Own head</h1></header><section><p>a b c</p></section><section><p>d e f</p></section></article>", "Own head\na b c\nd e f"),
        ("<article><p>x < y &lt; z &#x41;&am</p><!-- <p>no</p> --></article>", "x < y < z A&am"),
    ],
)
def test_main_text(body, want):
    assert html_density.main_text(PAGE.format(body)) == want


def test_unequal_sections_without_article():
    """All sections stay, whatever their density; a block of links beside them does not."""
    first = "".join(f"<p>{f'word{i} ' * 60}</p>" for i in range(20))
    second = "<section><h2>A short heading</h2><p>A short paragraph of the second section, kept.</p></section>"
    links = "<div>" + "".join(f"<a href=x{i}>other page {i}</a> " for i in range(9)) + "</div>"
    for block in ("", links):
        text = html_density.main_text(f"<html><body><div class=content><section>{first}</section>{second}{block}</div></body></html>")
        assert "A short heading\nA short paragraph of the second section, kept." in text and "other page" not in text and "word19" in text


def test_density_decides_without_known_names():
    """No article, main or telling class: the menu of links, the list of links inside the content and the thin box beside it go, by density alone."""
    prose = "".join(f"<p>{f'word{i} and more ' * 20}</p>" for i in range(6))
    menu = "<div class=x1>" + "".join(f"<a href=m{i}>menu entry {i}</a>" for i in range(8)) + "</div>"
    inner = "<ul>" + "".join(f"<li><a href=r{i}>read this too {i}</a></li>" for i in range(5)) + "</ul>"
    box = "<div class=x3><span>A</span> <span>thin</span> <span>box</span></div>"
    text = html_density.main_text(f"<html><body>{menu}<div class=x2><h2>Head</h2>{prose}{inner}<p>The end.</p></div>{box}</body></html>")
    assert text.startswith("Head\nword0 and more") and text.endswith("The end.")
    assert not any(x in text for x in ("menu entry", "read this too", "thin"))


def test_links_around_blocks_count():
    blocks, _, links = html_density.parse("<body><a href=x><div>twenty-four characters..</div></a><div>plain</div><p><a href=y>never closed<div>after</div></body>")
    html_density.measure(blocks, links)
    card, plain, after = (b for b in blocks if b.name == "div")
    assert (card.chars, card.link_chars, plain.link_chars, after.link_chars) == (24, 24, 0, 0)


class Tree(html.parser.HTMLParser):
    """A plain tree of a well-formed page, with its text and counts worked out by recursion."""

    def __init__(self, page):
        super().__init__()
        self.top = self.at = {"name": "html", "up": None, "parts": []}
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        new = {"name": tag, "up": self.at, "parts": []}
        self.at["parts"].append(new)
        self.at = new

    def handle_endtag(self, tag):
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["parts"].append(data)


def brute_density(page):
    def blocks(n):
        return [n, *(x for p in n["parts"] if isinstance(p, dict) for x in blocks(p))]

    def counts(n, linked=False):
        c = t = lc = lt = 0
        for p in n["parts"]:
            if isinstance(p, str):
                c, lc = c + len(p), lc + len(p) * linked
            else:
                a, b, d, e = counts(p, linked or p["name"] == "a")
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (p["name"] == "a")
        return c, t, lc, lt

    tree = Tree(page)
    every = [b for b in blocks(tree.top) if b["name"] != "a"]
    c, _, lc, _ = counts(tree.top)
    share = lc / c
    density = {id(b): html_density.composite(*counts(b), share) for b in every}
    children = lambda b: [p for p in b["parts"] if isinstance(p, dict) and p["name"] != "a"]
    seed = max(every, key=lambda b: sum(density[id(x)] for x in children(b)))
    path = [seed]
    while path[-1]["name"] != "body":
        path.append(path[-1]["up"])
    least = min(density[id(b)] for b in path)
    core = path[1] if len(path) > 2 else seed

    def lines(b, inside):
        out, run = [], ""
        for p in [*b["parts"], None]:
            if isinstance(p, dict) and p["name"] != "a" or p is None:
                out.append(run)
                run = ""
            if isinstance(p, str):
                run += p
            elif p is not None and p["name"] == "a":
                run += "".join(p["parts"])
            elif p is not None:
                n = counts(p)
                heading = p["name"] == "h2"
                linked = 2 * n[2] > n[0] and p["name"] not in ("h2", "p")
                akin = p["up"] is seed["up"] and p["name"] == seed["name"] and any(x["name"] == "h2" and counts(x)[0] for x in blocks(p))
                if any(p is x for x in path):
                    out += lines(p, inside or p is core)
                elif density[id(p)] >= least or not linked and (inside or heading or akin):
                    out += lines(p, True)
        return out

    body = path[-1]
    return "\n".join(x for x in (" ".join(r.split()) for r in lines(body, body is core)) if x)


def test_text_density_against_brute_force():
    rng = random.Random(12)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "de", "epsilon"]) for _ in range(n))

    def element(depth):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "div", "section"] if depth else ["p", "p", "h2", "ul"])
        if kind == "h2":
            return f"<h2>{words(rng.randrange(1, 6))}</h2>"
        if kind == "p":
            return f"<p>{words(rng.choice([3, 30, 90]))}" + f" <a>{words(2)}</a>" * rng.randrange(3) + "</p>"
        if kind == "ul":
            return "<ul>" + "".join(rng.choice([f"<li><a>{words(3)}</a></li>", f"<li>{words(5)}</li>"]) for _ in range(rng.randrange(1, 6))) + "</ul>"
        return f"<{kind}>" + rng.choice(["", words(4)]) + "".join(element(depth - 1) for _ in range(rng.randrange(1, 6))) + f"</{kind}>"

    dropped = 0
    for _ in range(300):
        page = "<html><body>" + "".join(element(3) for _ in range(rng.randrange(2, 7))) + "</body></html>"
        want = brute_density(page)
        assert html_density.main_text(page) == want, page
        dropped += len(want.split()) < len(Tree(page).top and html_density.re.sub(r"<[^>]*>", " ", page).split())
    assert dropped > 100


@pytest.mark.parametrize("page", ["", None, "<", "<div>", "<p", "<a href='x", "</p></b></div>", "<table><tr><td>", "<!-- never closed", "<script>x", "&", "<p><p><p>"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_density.main_text(page), str)


def test_plain_text_and_depth():
    assert html_density.main_text("just  text") == "just text"
    assert html_density.main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"
    long = "<article>" + "".join(f"<p>paragraph {i}</p>" for i in range(5000)) + "</article>"
    assert html_density.main_text(long).count("\n") == 4999


def test_density_formula():
    """By hand: 100 characters, 4 tags, 20 of them in 2 links, on a page with a tenth of its text in links."""
    x = math.log(100 / 80 * 20 + 0.1 * 100 + math.e)
    assert html_density.composite(100, 4, 20, 2, 0.1) == pytest.approx(25 * math.log(100 / 20 * 4 / 2) / math.log(x))
    assert html_density.composite(0, 4, 0, 0, 0.1) == 0.0 and html_density.composite(100, 4, 0, 0, 0.0) == 25.0


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>ünï</p></article>", "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", "<article><p>ünï</p></article>", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(repr, html_density.extract(pages).collect())) == sorted(["Row(page_id=1, url='u', text='ünï', n_chars=3)"] * 2 + ["Row(page_id=2, url=None, text='', n_chars=0)", "Row(page_id=None, url='v', text='', n_chars=0)"])
    assert html_density.extract(pages.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage against what it must take out and leave."""
    import corpus_pipeline

    rows, labels = toxic_rows()
    item = " ".join(f"term{chr(97 + i % 26)}{i}" for i in range(40))  # words that no other text has
    rows += [row(1000, rows[1][1]), row(1001, rows[2][1]), row(1002, sentence(600, 30) + " " + item), row(1003, ""), row(1004, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([r[:5] for r in rows], columns)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, left = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), columns)
        left.append({r.doc_id for r in now.collect()})
    bad = {i for i, _, t in labels if t}
    assert left[0] == {r[0] for r in rows} - bad
    groups = set(brute_kept([(i, t) for i, t, *_ in (r[:5] for r in rows) if i in left[0]]))  # near copies: five words, 0.8 alike
    assert left[1] == groups and 1003 in left[1] and 1004 not in left[1] and 1000 not in left[1]
    assert left[2] == left[1] - {1002}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == left[2]


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)}
    assert P.path("byte_bpe_50k.json")
