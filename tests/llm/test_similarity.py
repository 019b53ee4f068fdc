"""Fingerprints, near-duplicates, decontamination and components against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kelpie.llm import decontamination, simhash, syncmers
from kelpie.llm.components import connected_components
from tests.llm.conftest import edge_rows, sentence


def brute_anchors(text, k, s):
    code = np.array([ord(c) for c in text], dtype=np.uint64)
    if len(text) < k:
        return []
    inner = syncmers._grams(code, s).tolist()
    return [i for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]


@pytest.mark.parametrize("k,s", [(16, 5), (8, 3), (5, 5)])
def test_syncmers(k, s):
    text = sentence(9, 120) + "ünï\U0001f600" * 9
    at, hashes = syncmers.anchors(np.array([ord(c) for c in text], dtype=np.uint64), k, s)
    assert at.tolist() == brute_anchors(text, k, s)
    assert max(np.diff(at), default=0) <= max(1, k - s + 1)
    inserted = "zzz " + text  # context-free: the same anchors, moved
    moved, again = syncmers.anchors(np.array([ord(c) for c in inserted], dtype=np.uint64), k, s)
    assert set(hashes.tolist()) <= set(again.tolist())


def brute_likeness(a, b):
    """The longest common chain of hashes, by the i-th occurrences, in quadratic time."""
    def numbered(text):
        found, seen = syncmers.all_anchors([text])[0], {}
        out = []
        for h in found.hashes.tolist():
            seen[h] = seen.get(h, 0) + 1
            out.append((h, seen[h]))
        return out

    x, y = numbered(a), numbered(b)
    if not x or not y:
        return float(len(x) == len(y))
    row = [0] * (len(y) + 1)
    for p in x:
        above, row = row, [0]
        for j, q in enumerate(y):
            row.append(above[j] + 1 if p == q else max(above[j + 1], row[j]))
    return row[-1] / (len(x) + len(y) - row[-1])


def test_likeness():
    rng = random.Random(3)
    parts = [" ".join(rng.choice(["river", "moon", "quiet", "wizard", "brew"]) + str(rng.randrange(50)) for _ in range(20)) for _ in range(6)]
    text, turned = " ".join(parts), " ".join(reversed(parts))
    texts = [text, turned, " ".join(parts[2:]), "before " + text, text + " after", " ".join([*parts[3:], *parts[:3]]), parts[0] * 4, "", "short"]
    found = syncmers.all_anchors(texts)
    for (t, x), (u, y) in itertools.product(zip(texts, found, strict=True), repeat=2):
        assert syncmers.likeness(x, y) == pytest.approx(brute_likeness(t, u))
    # The same passages in another order share their anchors, but are less alike; moved together they are all alike but for the edges.
    assert len(set(found[0].hashes) & set(found[1].hashes)) > 0.9 * len(found[0])
    assert syncmers.likeness(found[0], found[1]) < 0.3 < 0.5 <= syncmers.likeness(found[0], found[5]) + 0.2 and syncmers.likeness(found[0], found[3]) > 0.95


def test_fingerprint_shows_every_anchor():
    texts = ["", "short", sentence(3, 2000), "ünï\U0001f600" * 40, "a" * 100]
    for text, found in zip(texts, syncmers.all_anchors(texts), strict=True):
        again = syncmers.read(syncmers.show(found))
        assert again.at.tolist() == found.at.tolist() and again.hashes.tolist() == found.hashes.tolist()
        if len(text) >= 40:
            assert found.at.tolist() == brute_anchors(text, syncmers.K, syncmers.S)


def test_short_texts_have_anchors():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(n)) for n in range(1, 50) for _ in range(20)]
    found = syncmers.all_anchors(["", *texts])
    assert not len(found[0]) and all(map(len, found[1:]))
    for n in range(16, 36):
        same = [s for t, s in zip(texts, found[1:], strict=True) if len(t) == n]
        assert all(syncmers.likeness(a, b) < 1 for a, b in itertools.combinations(same, 2))


def test_edited_fingerprints(docs, empty, spark):
    rows = sorted(((r[0], r[1] or "") for r in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = syncmers.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    unique = [r for r in rows if [x[0] for x in rows].count(r[0]) == 1]
    by_id = {r.doc_id: r for r in got}
    plain = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(docs).filter("doc_id is not null and doc_id != 3").collect()}
    for i, (k, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)]
        if (k, text) not in unique or after not in unique:
            continue
        edited, r = syncmers.edit(text, after[1]), by_id[k]
        s = syncmers.all_anchors([text, edited, after[1]])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == plain[k] == syncmers.show(s[0]) and r.edited_fingerprint == syncmers.show(s[1])
        if len(text) < 5000:
            assert r.near_edited == pytest.approx(brute_likeness(text, edited)) and r.near_next == pytest.approx(brute_likeness(text, after[1]))
    assert by_id[106].fingerprint == by_id[107].fingerprint and by_id[106].near_next == 1.0
    assert syncmers.edited_fingerprints(empty).count() == 0
    one = syncmers.edited_fingerprints(docs.filter("doc_id = 5")).collect()
    assert one[0].near_next == 1.0


def test_one_id_for_all_rows(spark, monkeypatch):
    """A doc_id with all rows is dealt to several ranges by the text's hash, and each row is compared with the next one."""
    from kelpie.llm import ranges

    monkeypatch.setattr(ranges, "ROWS_EACH", 10)
    docs = spark.createDataFrame([(7, sentence(i, 30 + i)) for i in range(200)] + [(None, sentence(i, 31 + i)) for i in range(90)], "doc_id long, text string")
    keys = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("tie"))
    bounds = ranges.ranges_of(keys, 4)
    held = keys.groupBy(ranges.place_of(bounds)("key", "tie").alias("p")).count().collect()
    assert len(held) > 20 and max(r["count"] for r in held) < 60
    order = [r.text for r in docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    want = sorted(hashlib.sha256(syncmers.edit(t, order[(i + 1) % len(order)]).encode()).hexdigest() for i, t in enumerate(order))
    assert sorted(r.edited_sha256 for r in syncmers.edited_fingerprints(docs).collect()) == want


def brute_simhash(text, words=3):
    tokens = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: list of (id, fingerprint); the least id of each row's component."""
    found = {f: f for f in {f for _, f in fps}}

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    for a, b in itertools.combinations(found, 2):
        if (a ^ b).bit_count() <= 2:
            found[root(a)] = root(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return [least.get(root(f)) for _, f in fps]


def test_near_duplicates(docs, empty):
    rows = [(r[0], brute_simhash(r[1])) for r in edge_rows()]
    want = sorted(repr((i, f"{f:016x}", c)) for (i, f), c in zip(rows, brute_components(rows), strict=True))
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bin_size", [32, 8])
@pytest.mark.parametrize("distance,segments", [(2, 5), (1, 4), (3, 8)])
def test_links_find_all_components(spark, monkeypatch, bin_size, distance, segments):
    """Groups of near fingerprints, a chain, and bins both small and large."""
    monkeypatch.setattr(simhash, "BIN", bin_size)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:6]:
        for _ in range(25):
            f = base
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                f ^= 1 << b
            fps.add(f)
    chain = rng.getrandbits(64)
    for b in range(0, 40, 2):
        chain ^= 3 << b
        fps.add(chain)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance, segments)
    got = {r.node: r.root for r in connected_components(edges).collect()}
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert {f: got.get(f, f) for f in signed} == {f: root(f) for f in signed}


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.root for r in connected_components(edges.union(spark.createDataFrame([(900, 901), (5, 5)], "src long, dst long"))).collect()} == {0, 900}


def test_decontamination(spark, docs, empty):
    item = sentence(50, 30)
    words = item.split()
    changed = [w if i % 6 else "other" for i, w in enumerate(words)]
    cases = [
        (1, "some words before " + item + " and after", True),
        (2, item.upper() + "!", True),
        (3, " ".join(changed), True),
        (4, " ".join(w if i % 2 else "other" for i, w in enumerate(words)), False),
        (5, "before " + " ".join(words[:20]) + " after", True),
        (6, " ".join(words[:10]), False),
        (7, None, False),
        (8, "", False),
        (9, sentence(51, 5000), False),
        (10, " ".join(words[5:]), True),
    ]
    frame = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in cases], "doc_id long, text string, item_id string, similarity double")
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item), (None, sentence(77, 40))], "item_id long, text string")
    got = decontamination.overlaps(frame, items).collect()
    assert sorted({r.doc_id for r in got}) == [i for i, _, leak in cases if leak] and {r.item_id for r in got} == {7}
    assert {r.doc_id: r.similarity for r in got}[1] == 1.0
    kept = decontamination.clean(frame, items)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _, leak in cases if not leak]
    assert decontamination.overlaps(empty, items).count() == 0 and decontamination.overlaps(docs, items.limit(0)).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    from kelpie.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    frame = spark.createDataFrame([(1, "x " + sentence(50, 30)), (2, "y"), (1, "z"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, sentence(50, 30))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.overlaps(frame, items).collect()] == [(1, 7)]
    assert sorted(map(repr, decontamination.clean(frame, items).collect())) == sorted(map(repr, frame.filter("text is null or length(text) = 1").collect()))


def test_masks_find_every_pattern():
    """Any window of 5 to 20 tokens with at most a fifth substituted holds a mask whose compared places are all left."""
    for n in range(decontamination.SHORTEST, decontamination.WINDOW + 1):
        for gone in itertools.combinations(range(n), n - -(-n * 4 // 5)):
            assert any(all(0 <= p + j < n and p + j not in gone for j in m) for p in range(n) for m in decontamination.MASKS), (n, gone)


def brute_overlap(text, item):
    import regex

    d, b = (regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()) for t in (text, item))
    if len(b) < 5:
        return 0.0
    width, best = min(20, len(b)), 0
    for diagonal in range(-len(b), len(d)):
        same = [0 <= j + diagonal < len(d) and d[j + diagonal] == x for j, x in enumerate(b)]
        if sum(same) > best:
            best = max(best, *(sum(same[k : k + width]) for k in range(len(b) - width + 1)))
    return best / width


def test_decontamination_against_brute_force(spark, monkeypatch):
    """Items of 5 to 45 tokens with random substitutions, at the start, inside and at the end of documents, over the edges of blocks."""
    monkeypatch.setattr(decontamination, "BLOCK", 16)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([*range(4, 25), 33, 45])]
    texts = []
    for i in range(160):
        item = rng.choice(items)[1].split()
        item = [w if rng.random() > rng.choice([0, 0.1, 0.2]) else "other" for w in item]
        cut = item[rng.choice([0, 0, 1, 3]) : len(item) - rng.choice([0, 0, 1, 3])]
        texts.append((i, " ".join(rng.choices(words, k=rng.choice([0, 3, 40])) + cut + rng.choices(words, k=rng.choice([0, 2, 50])))))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.overlaps(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k): s for i, t in texts for k, b in items if (s := brute_overlap(t, b)) >= 0.8}
    assert got == pytest.approx(want) and len(want) > 60


def test_clean_judges_rows_by_their_text(spark):
    """A clean row under the id of a leaked one, or without an id, stays."""
    item = sentence(50, 30)
    rows = [(3, item), (3, "a clean text"), (None, "b " + item), (None, "another clean text"), (None, None)]
    kept = decontamination.clean(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(map(repr, (tuple(r) for r in kept.collect()))) == sorted(map(repr, [rows[1], rows[3], rows[4]]))
