"""Token counts by a linear longest-match automaton.

A word, in the sense of white space of the byte pattern `[^\\x20\\x09-\\x0D]+`, is
matched from the left, always by the longest vocabulary token that fits: the
first token among those that begin with a space, as words do inside a text, the
others among all. The trie of the vocabulary gets failure links: where a node
cannot go on, its link leads to the node of what remains after the longest
tokens on its path are popped, and the number of tokens popped is stored with
the link. A byte is thus read once and no piece is built; only numbers are
added. The distinct new words of a batch run through the automaton together.

Every single byte is a token of byte-level vocabularies, so that each word has
pieces; with other vocabularies a word without a complete match counts as one
unknown token.

Edge cases: a null, empty or blank text has no words and no tokens; a null
doc_id is kept; repeated rows are counted each; long words and texts are counted
whole; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.bpe import slices

CACHE_WORDS = 250_000
#: The words that go through the automaton together.
BATCH_WORDS = 50_000


class LongestMatch:
    """The automaton of a set of tokens (bytes)."""

    def __init__(self, tokens: Iterable[bytes]):
        goto: list[dict[int, int]] = [{}]
        parent, byte, token = [0], [0], [False]
        for t in tokens:
            at = 0
            for b in t:
                child = goto[at].get(b)
                if child is None:
                    child = goto[at][b] = len(goto)
                    goto.append({})
                    parent.append(at)
                    byte.append(b)
                    token.append(False)
                at = child
            if t:
                token[at] = True
        # Breadth first, so that the links of shorter strings are there. -1: what remains has no match.
        link, popped = [-1] * len(goto), [0] * len(goto)
        layer = [0]
        while layer:
            following = [c for at in layer for c in goto[at].values()]
            for v in following:
                if token[v]:
                    link[v], popped[v] = 0, 1
                    continue
                z, n = link[parent[v]], popped[parent[v]]
                while z >= 0 and byte[v] not in goto[z]:
                    n += popped[z]
                    z = link[z]
                if z >= 0:
                    link[v], popped[v] = goto[z][byte[v]], n
            layer = following
        self.link, self.popped = np.array(link, dtype=np.int64), np.array(popped, dtype=np.int64)
        edges = sorted((at << 8 | b, c) for at, kids in enumerate(goto) for b, c in kids.items())
        self.edges = np.array([e for e, _ in edges], dtype=np.int64)
        self.ends = np.array([c for _, c in edges], dtype=np.int64)

    def _step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        keys = nodes << 8 | symbols
        at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
        return np.where(self.edges[at] == keys, self.ends[at], -1)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of longest-match tokens of each word; 1 for a word that cannot be matched to its end, 0 for an empty one."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        out, node = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        left = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # words longer than k
        for k, n in enumerate(left.tolist()):
            todo = order[:n]
            todo = todo[node[todo] >= 0]
            while len(todo):
                to = self._step(node[todo], text[starts[todo] + k])
                stuck = to < 0
                node[todo[~stuck]] = to[~stuck]
                todo = todo[stuck]
                out[todo] += self.popped[node[todo]]
                node[todo] = self.link[node[todo]]
                todo = todo[node[todo] >= 0]
        todo = np.flatnonzero(node > 0)
        while len(todo):
            out[todo] += self.popped[node[todo]]
            node[todo] = self.link[node[todo]]
            todo = todo[node[todo] > 0]
        return np.where(node < 0, 1, out)


def ranked_tokens(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class WordCounter:
    def __init__(self, path: str):
        self.automaton = LongestMatch(ranked_tokens(path))
        self.cache: dict[bytes, int] = {}

    def count_batch(self, texts: list[bytes | None]) -> list[tuple[int, int]]:
        """Words and tokens of each text."""
        split = [(t or b"").split() for t in texts]
        seen: set[bytes] = set()
        for words in split:
            seen.update(words)
        new = [w for w in seen if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS and self.cache:
            self.cache.clear()
            new = list(seen)
        for i in range(0, len(new), BATCH_WORDS):
            some = new[i : i + BATCH_WORDS]
            self.cache.update(zip(some, self.automaton.counts([b" " + w for w in some]).tolist(), strict=True))
        get = self.cache.__getitem__
        return [(len(words), sum(map(get, words))) for words in split]


@lru_cache(2)
def _counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every whole text, in one pass without a shuffle; vocabulary is the path of a rank file on driver and executors."""

    def run(batches):
        counter = _counter(vocabulary)
        for batch in batches:
            for part in slices(batch):
                found = counter.count_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
