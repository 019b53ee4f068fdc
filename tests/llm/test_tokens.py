"""BPE, longest-match counts and sorted tables against the libraries and brute force."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers as P
from kelpie.llm import bpe, sstable, wordpiece
from tests.llm.conftest import edge_rows

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def fuzz(n, seed):
    rng = random.Random(seed)
    pool = [chr(c) for c in range(1, 0x250)] + [" ", "\n", "\t", "'", "a", "A", "1", "　", "\x1c", "\x85", "'s", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "  ", "aaa", "é", "é", "İ", "ς", "Σ", "!!", "...", "ab", " the", "%%%", "ª", "²", "\U0001f600", "漢字"] * 30
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_bpe_matches_library():
    texts, own, lib = fuzz(1500, 1), bpe.PairIndexBpe(BYTE), library(BYTE)
    encoded = own.encode_batch(texts)
    for t, e in zip(texts, encoded, strict=True):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e, "<u4").tolist() == ids
        assert own.decode(e) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_decodes_broken_text_as_library():
    own, lib, rng = bpe.PairIndexBpe(BYTE), library(BYTE), random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(12)]
        assert own.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_small_caches(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(bpe, "MERGE_SYMBOLS", 20)
    monkeypatch.setattr(bpe, "FEW", 2)
    own, lib = bpe.PairIndexBpe(BYTE), library(BYTE)
    for t in ("aaaa aaaaaaa banana bananas", "the the the theatre", ""):
        assert np.frombuffer(own.encode_batch([t])[0], "<u4").tolist() == lib.encode(t).ids


def test_bpe_round_trip(docs, empty):
    got = sorted(map(repr, bpe.round_trip(docs, BYTE).collect()))
    lib, want = library(BYTE), []
    for r in edge_rows():
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((r[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(f"Row(doc_id={a!r}, n_tokens={b}, ids_sha256={c!r}, decoded_sha256={d!r})" for a, b, c, d in want)
    assert bpe.round_trip(empty, BYTE).count() == 0
    back = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[0] or 0, r[1] or "") for r in edge_rows())


def brute_count(word, vocabulary, longest):
    n = i = 0
    while i < len(word):
        j = min(len(word), i + longest)
        while j > i and word[i:j] not in vocabulary:
            j -= 1
        if j == i:
            return 1
        i, n = j, n + 1
    return n


@pytest.mark.parametrize("seed", range(40))
def test_longest_match(seed):
    rng = random.Random(seed)
    vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))} | ({b"a", b"b", b"c"} if seed % 2 else set())
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(14))) for _ in range(50)]
    assert wordpiece.LongestMatch(vocabulary).counts(words).tolist() == [brute_count(w, vocabulary, 5) for w in words]


def test_token_counts(docs, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = set(wordpiece.ranked_tokens(path))
    longest = max(map(len, vocabulary))
    want = []
    for r in edge_rows():
        words = (r[1] or "").encode().split()
        want.append((r[0] or 0, len(words), sum(brute_count(b" " + w, vocabulary, longest) for w in words)))
    assert sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in wordpiece.token_counts(docs, path).collect()) == sorted(want)
    assert wordpiece.token_counts(empty, path).count() == 0


def test_chunk_encoder_matches_library():
    texts, lib = fuzz(1500, 3), library(WORD)
    own = sstable.ChunkEncoder(WORD, "<|endoftext|>", 2)
    for t, e in zip(texts, own.encode_batch([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(e, "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_sorted_table_lookup(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    rng, sink = random.Random(4), io.BytesIO()
    ids = sorted([None, *rng.sample(range(-500, 5000), 300), *[777] * 40], key=lambda x: (x is not None, x))
    values = [bytes(rng.randrange(256) for _ in range(2 * rng.randrange(20))) for _ in ids]
    writer = sstable.Writer(sink, 2)
    for k, v in zip(ids, values, strict=True):
        writer.add(k, v)
    about = writer.close()
    table = sstable.Reader(Source(sink.getvalue()))
    assert list(table) == list(zip(ids, values, strict=True)) and about["rows"] == len(ids)
    for k in {*ids, 6000, -501}:
        table.blocks_read = 0
        assert table.get(k) == [v for i, v in zip(ids, values, strict=True) if i == k]
        assert k == 777 or table.blocks_read <= 2
    assert len(table.index) > 5
    broken = bytearray(sink.getvalue())
    broken[20] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(sstable.Reader(Source(bytes(broken))))
    with pytest.raises(ValueError, match="ascend"):
        writer.add(-10_000, b"")


def test_sstable_round_trip(docs, empty):
    lib, start, want = library(WORD), 0, []
    encoded = [(r[0], np.array(lib.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")) for r in edge_rows()]
    for k, ids in sorted(encoded, key=lambda x: (x[0] is not None, x[0], x[1].astype("<u2").tobytes())):
        want.append((k if k is not None else -1 << 62, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [(r[0] if r[0] is not None else -1 << 62, *r[1:]) for r in sstable.round_trip(docs, WORD).collect()]
    assert sorted(got) == sorted(want)
    assert sstable.round_trip(empty, WORD).count() == 0
