"""Near copies against brute force over all pairs of shingle sets."""

import itertools
import random

import numpy as np
import pytest

from kelpie.llm import near_copies
from tests.llm.conftest import SCHEMA, edge_rows, row
from tests.llm.test_similarity import brute_simhash


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """(doc_id, text) of the row that stays of each component of near copies."""
    sets, parent = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
            parent[root(a)] = root(b)
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(root(k), []).append(row)
    return sorted(min((i for i, _ in g if i is not None), default=-99) for g in groups.values())


def copies(groups, each):
    """Groups of texts of 200 words, each a few changed words away from the group's first or, in a chain, from the one before."""
    rng, rows = random.Random(4), []
    for g in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for k in range(each):
            text = list(words)
            for at in rng.sample(range(200), 1 + k % 4):
                text[at] = f"x{rng.randrange(5000)}"
            rows.append((1000 * g + k, " ".join(text)))
            if g % 2:
                words = text
    return rows


def ids(frame):
    return sorted(r.doc_id if r.doc_id is not None else -99 for r in frame.collect())


def test_pipeline_removes_loose_copies(spark):
    import corpus_pipeline

    rows = copies(6, 8)
    assert len({brute_simhash(t) for _, t in rows}) == len(rows)
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame([row(*r) for r in rows], SCHEMA), "")
    assert ids(kept) == brute_kept(rows) and kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert len(brute_kept(rows)) < len(rows) / 3


@pytest.mark.parametrize("bin_size", [32, 3])
def test_against_brute_force(spark, monkeypatch, bin_size):
    """Stars, chains and the edge cases, also with bins too large to pair."""
    monkeypatch.setattr(near_copies, "BIN", bin_size)
    rows = copies(4, 30) + [(r[0] + 100_000 if r[0] is not None else None, r[1]) for r in edge_rows()]
    kept = near_copies.one_each(spark.createDataFrame([row(*r) for r in rows], SCHEMA).repartition(3))
    assert ids(kept) == brute_kept(rows)


def test_wide_fingerprints():
    """Bit by bit, and as far apart as sets of their likeness should be."""
    rng = np.random.default_rng(3)
    some = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    mixed = near_copies._mix(some[:, None] * near_copies._WIDE_FACTORS)
    bits = np.unpackbits(mixed.view(np.uint8).reshape(700, -1), axis=1)
    assert (near_copies.wide_fingerprint(some) == np.packbits(bits.sum(axis=0) * 2 > 700).view(np.int64)).all()
    other = np.concatenate((some[:600], rng.integers(0, 1 << 63, 50, dtype=np.uint64)))  # 600 / 750 = 0.8
    apart = sum((int(a) ^ int(b)).bit_count() if (int(a) ^ int(b)) >= 0 else ((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() for a, b in zip(near_copies.wide_fingerprint(some), near_copies.wide_fingerprint(other), strict=True))
    assert 250 < apart <= near_copies.WIDE_DISTANCE


def test_rows_are_known_by_id_and_text(spark):
    """Other texts under one id stay, copies under another's id go, and of repeated rows one stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    for rows, want in (([(3, a), (3, b), (4, c)], [(3, a), (3, b), (4, c)]), ([(2, a), (3, a), (3, b)], [(2, a), (3, b)]), ([(None, a), (None, b), (None, b), (5, a)], [(5, a), (None, b)]), ([(1, a), (1, a), (1, a), (2, None), (2, ""), (7, b)], [(1, a), (7, b)])):
        kept = [(r.doc_id, r.text) for r in near_copies.one_each(spark.createDataFrame([row(*r) for r in rows], SCHEMA)).collect()]
        assert sorted(map(repr, (r for r in kept if r[1]))) == sorted(map(repr, want))
        assert sum(not t for _, t in kept) == any(not t for _, t in rows)


def test_no_rows(empty):
    assert near_copies.one_each(empty).count() == 0
