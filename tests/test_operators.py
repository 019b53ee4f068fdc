"""Operators on small fixtures: alignment failures, tails, odd counts, fits, streams."""

import json
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.operators import alignment, matrices, metrics, packets, packing, scales
from kelpie.sources import manifests


def test_misaligned_layers_fail(spark):
    good = spark.createDataFrame([(layer, t) for layer in range(2) for t in range(3)], "layer int, token int")
    assert alignment.require_synchronized(good, ["token"], "layer", 2).count() == 3
    for bad in (good.filter("not (layer = 1 and token = 2)"), good.union(good.limit(1))):
        with pytest.raises(Exception, match="not aligned"):
            alignment.require_synchronized(bad, ["token"], "layer", 2).collect()


def test_invalid_token_drops_its_segment(spark):
    rows = spark.createDataFrame([(layer, t, t != 5 or layer == 0) for layer in range(2) for t in range(10)], "layer int, token int, ok boolean")
    kept = alignment.whole_segments(rows, F.floor(F.col("token") / 4), 4, F.col("ok"))
    assert {r["token"] for r in kept.collect()} == {0, 1, 2, 3}  # the second segment is invalid, the third short


@pytest.mark.parametrize("n,count", [(10, 3), (10, 4), (5, 9), (7, 1), (6, 0), (2, 2)])
def test_evenly_spaced(spark, n, count):
    frame = spark.range(n).select(F.col("id").alias("slab"))
    want = list(range(n)) if count <= 0 or count >= n else [n // 2] if count == 1 else sorted({int(np.rint(k * (n - 1) / (count - 1))) for k in range(count)})
    assert sorted(r[0] for r in alignment.evenly_spaced(frame, "slab", count).collect()) == want


def test_rms_tail_is_not_padded(spark):
    rows = spark.createDataFrame([(0, 0, [3.0, 4.0]), (0, 0, [0.0, 5.0]), (0, 1, [2.0, 2.0])], "layer int, block int, row array<double>")
    got = {r["block"]: r["rms"] for r in scales.rms_scales(rows, ["layer", "block"]).collect()}
    assert got[0] == pytest.approx(np.sqrt(50 / 4)) and got[1] == pytest.approx(2.0)
    assert scales.scale_count("block-view", 4, 125, 4, 32) == 64


def test_zero_block(spark):
    rows = spark.createDataFrame([(0, 0, [0.0, 0.0])], "layer int, token int, row array<double>")
    assert scales.with_amax_scale(rows, "token-layer", 6.0).first()["scale"] == 1.0


def test_pack_odd_tail(spark):
    codes = spark.createDataFrame([(0, i, c) for i, c in enumerate([1, 15, 7])], "k int, place long, code int")
    got = sorted((r["byte"], r["packed"]) for r in packing.packed_bytes(codes, ["k"], "place", 4).collect())
    assert got == [(0, 0xF1), (1, 0x07)]
    assert packing.pack_array([1, 15, 7], 4) == bytes([0xF1, 0x07])
    assert packing.pack_array([1, 2, 3, 0, 3], 2) == bytes([0b00111001, 0b11])


def test_deflate_matches_one_stream(spark):
    rows = [(s, t, [(t * 7 + i) % 16 for i in range(8)]) for s in "ab" for t in range(50)]
    got = {r["s"]: (r["raw_bytes"], r["zip_bytes"]) for r in packing.deflate_sizes(spark.createDataFrame(rows, "s string, t int, codes array<int>").repartition(4), ["s"], ["t"], "codes", 4).collect()}
    raw = b"".join(packing.pack_array(c, 4) for s, _, c in rows if s == "a")
    z = zlib.compressobj(6)
    assert got["a"] == got["b"] == (len(raw), len(z.compress(raw) + z.flush()))


def test_entropy_bounds(spark):
    frame = spark.createDataFrame([(i % 4, i % 3) for i in range(120)], "code int, before int")
    assert metrics.code_entropy(frame, []).first()["entropy_bits"] == pytest.approx(2.0)
    assert metrics.conditional_entropy(frame).first()[0] == pytest.approx(2.0)
    assert metrics.code_entropy(frame.limit(0), []).count() in (0, 1)


def test_procrustes_recovers_rotations():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turns = [np.linalg.qr(rng.normal(size=(6, 6)))[0] for _ in range(3)]
    clouds = [x @ t for t in turns]
    c = np.array([[a.T @ b for b in clouds] for a in clouds])
    r, history = matrices.fit_procrustes(c)
    assert history[-1] == pytest.approx(1.0, abs=1e-6) and matrices.orthogonality_error(r) < 1e-9
    assert np.allclose(r[0], np.eye(6))


def test_butterfly_turns_planes():
    """Stage by stage, plane by plane."""
    rng = np.random.default_rng(2)
    x, angles = rng.normal(size=8), rng.normal(size=(3, 4))
    want = x.copy()
    for s in range(3):
        for place, i in enumerate([i for i in range(8) if not i & 1 << s]):
            a, j = angles[s, place], i + (1 << s)
            want[i], want[j] = np.cos(a) * want[i] + np.sin(a) * want[j], np.cos(a) * want[j] - np.sin(a) * want[i]
    assert np.allclose(x @ matrices.butterfly_factor(angles), want)
    with pytest.raises(ValueError):
        matrices.butterfly_factor(angles[:2])


def test_pair_weights_and_cosines():
    w = matrices.pair_weights(4, [(0, 2), (2, 3)])
    assert w.tolist() == [[1, 0, 1, 0], [0, 1, 0, 0], [1, 0, 1, 1], [0, 0, 1, 1]] and matrices.pair_weights(2, None).all() and not matrices.pair_weights(2, [], False).any()
    with pytest.raises(ValueError):
        matrices.pair_weights(2, [(0, 2)])
    rng = np.random.default_rng(5)
    c, r = rng.normal(size=(4, 4, 3, 3)), np.linalg.qr(rng.normal(size=(4, 3, 3)))[0]
    want = [np.trace(r[i].T @ c[i, j] @ r[j]) / 10 for i, j in ((0, 2), (2, 3))]
    assert np.allclose(matrices.selected_cosines(c, r, [(0, 2), (2, 3)], 10), want) and np.allclose(matrices.weighted_cosines(c, r, w, 10), want)
    assert not len(matrices.weighted_cosines(c, r, np.eye(4)))


def test_fit_from_first_rotations():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4))
    turns = np.linalg.qr(rng.normal(size=(3, 4, 4)))[0]
    clouds = [x @ t / np.linalg.norm(x) for t in turns]
    c = np.array([[a.T @ b for b in clouds] for a in clouds])
    _, cold = matrices.fit_procrustes(c)
    r, warm = matrices.fit_procrustes(c, init=np.swapaxes(turns, 1, 2))
    assert warm[0] == pytest.approx(cold[-1], abs=1e-6) and len(warm) < len(cold) and np.allclose(r[0], np.eye(4))


def test_cayley_and_hadamard_are_orthogonal():
    assert matrices.orthogonality_error(matrices.cayley(np.random.default_rng(3).normal(size=(2, 5, 5)))) < 1e-9
    h = np.array(matrices.hadamard(8))
    assert np.allclose(h @ h.T, np.eye(8))
    with pytest.raises(ValueError):
        matrices.hadamard(6)


def test_manifests(spark, tmp_path):
    shard = {"format": manifests.SHARD_FORMAT, "shards": [{"sequence_index": 3, "worker_files": ["a.bin"], "key_token_sha256": None, "prompt_token_sha256": "x"}]}
    (tmp_path / "s.json").write_text(json.dumps(shard))
    assert manifests.read_shards(spark, str(tmp_path / "s.json")).first()["file"] == "a.bin"
    shard["shards"][0]["worker_files"].append("b.bin")
    (tmp_path / "t.json").write_text(json.dumps(shard))
    with pytest.raises(Exception, match="one file"):
        manifests.read_shards(spark, str(tmp_path / "t.json")).collect()
    records = {"status": "complete", "groups": [], "records": [{"split": s, "domain": "d", "task": "t", "tokens": 1, "slots": 2, "groups": [{"path": "p", "sha256": "h", "kind": "key"}]} for s in "ab"]}
    (tmp_path / "r.json").write_text(json.dumps(records))
    assert manifests.read_records(spark, str(tmp_path / "r.json"), "b").count() == 1


def test_truncated_packet_fails(spark):
    head = json.dumps({"format": "kvcodec-token-hevc-v2", "views": 16})
    frame = spark.createDataFrame([(head,)], "h string").select(manifests.pack_header(F.col("h")).alias("packet"))
    with pytest.raises(Exception, match="truncated"):
        manifests.parse_packet(frame).collect()


def test_reports_and_hashes(spark, tmp_path):
    manifests.write_report(spark.range(3), str(tmp_path / "r"), "json")
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert manifests.file_hashes(spark, str(tmp_path / "f.bin")).first()["sha256"].startswith("ba7816bf")


def test_stream_counts_each_file_once(spark, tmp_path):
    from kelpie.streaming import accumulate as A

    source, parts, checkpoint = (str(tmp_path / n) for n in ("in", "parts", "checkpoint"))
    data = spark.range(40).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * F.col("id")).cast("float")).alias("embedding"), F.lit(0).alias("label"))
    data.filter("vec_id < 20").coalesce(1).write.parquet(source)
    A.accumulate(spark, source, parts, checkpoint)
    data.filter("vec_id >= 20").coalesce(1).write.mode("append").parquet(source)
    A.accumulate(spark, source, parts, checkpoint)
    A.accumulate(spark, source, parts, checkpoint)
    want = {(r["layer"], r["code"]): r["n"] for r in A.code_parts(data).collect()}
    assert {(r["layer"], r["code"]): r["n"] for r in A.merged(spark, parts).collect()} == want


def test_codec_settings():
    assert "bframes=0" in packing.x265_params(bframes=0) and "b-adapt=0" in packing.x265_params(bframes=0)
    assert "rc-lookahead=9" in packing.x265_params(bframes=8) and "rc-lookahead=4" in packing.x265_params(bframes=3)
    assert "b-adapt=1" in packing.x265_params(bframes=1) and "b-adapt=2" in packing.x265_params(bframes=1, b_adapt=2) and "b-adapt=2" in packing.x265_params(bframes=4, b_adapt=0)
    for wrong in ({"b_adapt": 3}, {"bframes": 17}):
        with pytest.raises(ValueError):
            packing.x265_params(**wrong)
    tokens = packing.token_parameters(18, 512)
    assert tokens.startswith("lossless=1:scenecut=0:bframes=3:b-adapt=2:open-gop=0:") and "keyint=18:min-keyint=18" in tokens and "ctu=64" in tokens and "ctu=16" in packing.token_parameters(1, 31) and "ctu=32" in packing.token_parameters(1, 32)
    assert [packing.pixel_format(n) for n in (16, 256, 257, 4096)] == ["gray", "gray", "gray10le", "gray12le"]
    with pytest.raises(ValueError):
        packing.pixel_format(5000)
    assert packing.video_codec_available() in (True, False)


def test_sample_range_and_mismatches(spark):
    a = spark.createDataFrame([(0, 16), (1, 235), (2, 100)], "i int, code int")
    assert packing.sample_range(a).first() == (16, 235, False) and packing.sample_range(a.union(a.selectExpr("9", "15"))).first()["full_range"]
    b = spark.createDataFrame([(0, 16), (1, 234), (3, 1)], "i int, code int")
    found = packing.mismatches(a, b, ["i"]).first()
    assert (found["cells"], found["different"], found["missing"]) == (4, 3, 2) and [x["i"] for x in found["first"]] == [1, 2, 3]
    assert packing.mismatches(a, a, ["i"]).first()["different"] == 0


@pytest.mark.parametrize("model,groups,width", [("qwen", [4] * 16, 32), ("glm", [4, 4, 3], 8), ("deepseek", [3] * 7, 8)])
@pytest.mark.parametrize("tokens", [1, 13, 16])
def test_frames_and_packets(spark, model, groups, width, tokens):
    """Layouts against plain loops, and both formats there and back, with tails."""
    views = sum(groups)
    codes = np.random.default_rng(tokens).integers(0, 256, (views, tokens, width)).astype(np.uint8)
    padded, folded = packing.GEOMETRIES[model]
    half, full = (views // 2, 2 * width) if folded else (views, width)
    want = np.full((-(-tokens // 8), 8 * padded, full), 128)
    for v in range(views):
        for t in range(tokens):
            want[t // 8, t % 8 * padded + v % half, v // half * width : (v // half + 1) * width] = codes[v, t]
    assert (packets.lay_out(codes, model) == want).all() and (packets.take_back(want.astype(np.uint8), model, views, tokens) == codes).all()
    x = np.random.default_rng(3).normal(size=(views, tokens, width))
    for split in (False, True):
        packet = packets.encode(x, groups, model, 0.0267, packets.Deflate(), split)
        head, scales, low, _ = packets.parse(packet)
        back, same = packets.decode(packet, packets.Deflate())
        q, exact, floors = packets.quantize(x, 0.0267)
        assert (back == q).all() and (same == exact).all() and head["groups"] == groups and head["range_floor_views"] == floors and len(low) == (q.size // 2 if split else 0)
        assert (np.abs((q - 128.0) * exact[:, None, None] - x) <= exact[:, None, None] / 2 + 1e-12).all()
        with pytest.raises(ValueError):
            packets.parse(packet[:20])
    if tokens == 13:
        rows = spark.createDataFrame([(v, t, codes[v, t].tolist()) for v in range(views) for t in range(tokens)], "view long, token long, codes array<int>")
        frames = packing.token_frames(rows, model, views, width)
        assert {r["frame"]: r["pixels"] for r in frames.collect()} == {i: f.reshape(-1).tolist() for i, f in enumerate(want)}
        again = packing.frame_rows(frames.withColumn("n", F.lit(tokens)), model, views, width, "n")
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.select("token", "view", "codes").collect()))


def test_e4m3_arrays_agree_with_columns(spark):
    from kelpie.functions.quantizers import fp8

    values = [0.0, -0.0, 1e-9, 2.0**-10, 3 * 2.0**-10, 2.0**-9, 0.0171, -0.0171, 1.0625, 1.1875, 15.5, 15.6, -31.0, 447.0, 464.0, 1e9, -1e9, *np.random.default_rng(1).normal(0, 20, 500)]
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(fp8(F.col("v"))[0]).collect()]
    assert packing.e4m3_codes(np.array(values)).tolist() == got


def test_lossless_rates(spark, tmp_path):
    stand_in = tmp_path / "ffmpeg"
    stand_in.write_text(f"#!{sys.executable}\nimport sys, zlib\ndata = sys.stdin.buffer.read()\nsys.stdout.buffer.write(zlib.compress(data) if 'libx265' in sys.argv else zlib.decompress(data))\n")
    stand_in.chmod(0o755)
    frames = spark.createDataFrame([(a, g, f, 2, 4, bytes([g + f] * 8)) for a in "xy" for g in range(2) for f in range(3)], "arm string, gop int, frame int, height int, width int, pixels binary")
    about = spark.createDataFrame([("x", 4, 48), ("y", 8, 48)], "arm string, metadata_bytes long, n_values long")
    got = {r["arm"]: r for r in packing.lossless_rates(frames, "arm", about, "a", "b", str(stand_in)).collect()}
    assert got["x"]["raw_bytes"] == 48 and got["y"]["total_bytes"] == got["x"]["total_bytes"] + 4 and got["x"]["inter_gain"] == 0.0


def test_files_are_resolved(spark, tmp_path):
    for name in ("a/x.bin", "a/b/y.bin", "a/c/z.bin", "a/d/z.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    top = f"{tmp_path}/a"
    for name, want in ((f"{tmp_path}/a/x.bin", "a/x.bin"), ("b/y.bin", "a/b/y.bin"), ("elsewhere/y.bin", "a/b/y.bin"), ("/gone/y.bin", "a/b/y.bin")):
        assert manifests.resolve_file(spark, name, top).endswith(want)
    for name in ("z.bin", "none.bin"):
        with pytest.raises(FileNotFoundError):
            manifests.resolve_file(spark, name, top)


def test_sources_must_agree(spark):
    rows = [(0, "p", 4, "h"), (1, "q", 4, "h")]
    good = spark.createDataFrame(rows, "layer int, source string, heads int, hash string")
    assert sorted(map(tuple, manifests.require_agreement(good, ["heads", "hash"]).collect())) == [(0, "p"), (1, "q")]
    for extra, said in (((2, "r", 5, "h"), "heads"), ((1, "r", 4, "h"), "several sources")):
        with pytest.raises(Exception, match=said):
            manifests.require_agreement(good.union(spark.createDataFrame([extra], good.schema)), ["heads", "hash"]).collect()


def test_records_are_checked(spark, tmp_path):
    (tmp_path / "p").write_bytes(b"abc")
    right = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    schema = "split string, task string, path string, sha256 string"
    good = spark.createDataFrame([("a", "t", f"{tmp_path}/p", right), ("b", "u", f"{tmp_path}/q", "0")], schema)
    assert manifests.check_records(good, 4).count() == 2 and manifests.verify_hashes(good.limit(1)).count() == 1
    with pytest.raises(ValueError, match="splits share"):
        manifests.check_records(good.union(spark.createDataFrame([("b", "t", "r", "1")], schema)), 4)
    with pytest.raises(ValueError, match="without one hash"):
        manifests.check_records(good.union(spark.createDataFrame([("b", "v", f"{tmp_path}/q", "1")], schema)), 4)
    with pytest.raises(Exception, match="hash mismatch"):
        manifests.verify_hashes(spark.createDataFrame([("a", "t", f"{tmp_path}/p", "0")], schema)).collect()
    with pytest.raises(ValueError, match="no records"):
        manifests.require_rows(good.limit(0), "records")


def test_rotations_and_means_are_loaded(spark, tmp_path):
    spark.createDataFrame([(0, h, [[1.0, 0.0], [0.0, 1.0]], [0.5, 0.5]) for h in range(2)], "layer int, head int, matrix array<array<double>>, mean array<double>").write.parquet(f"{tmp_path}/r")
    assert manifests.load_matrices(spark, f"{tmp_path}/r", 2).count() == 2 and manifests.load_means(spark, f"{tmp_path}/r", 2).count() == 2
    with pytest.raises(Exception, match="another dimension"):
        manifests.load_matrices(spark, f"{tmp_path}/r", 3).collect()
    spark.read.parquet(f"{tmp_path}/r").limit(1).write.mode("append").parquet(f"{tmp_path}/twice")
    spark.read.parquet(f"{tmp_path}/r").limit(1).write.mode("append").parquet(f"{tmp_path}/twice")
    with pytest.raises(ValueError, match="twice"):
        manifests.load_means(spark, f"{tmp_path}/twice", 2)


def test_blocks_are_exported_whole(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("token"), (F.col("id") * 2).alias("v"))
    out = manifests.export_blocks(rows, f"{tmp_path}/e", 10, 4, 16)
    assert {(r["test_block"], r["n"]) for r in out.groupBy("test_block").agg(F.count("*").alias("n")).collect()} == {(b, 16) for b in range(4)}
    assert spark.read.json(f"{tmp_path}/e/manifest").first()["first_token"] == 10
    with pytest.raises(ValueError, match="not whole"):
        manifests.export_blocks(rows, f"{tmp_path}/f", 50, 4, 16)


def test_reports_are_replaced_whole(spark, tmp_path):
    for n in (3, 5):
        manifests.write_report(spark.range(n), f"{tmp_path}/r")
        assert spark.read.json(f"{tmp_path}/r").count() == n
    with pytest.raises(Exception, match="broken"):
        manifests.write_report(spark.range(2).select(F.raise_error(F.lit("broken")).cast("string").alias("x")), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 5 and sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".new")) == ["r"]


def test_video_process(spark, tmp_path):
    """The process and its checks, with a stand-in that deflates, as the encoder is not installed everywhere."""
    stand_in = tmp_path / "ffmpeg"
    stand_in.write_text(f"#!{sys.executable}\nimport sys, zlib\ndata = sys.stdin.buffer.read()\nsys.stdout.buffer.write(zlib.compress(data) if 'libx265' in sys.argv else zlib.decompress(data))\n")
    stand_in.chmod(0o755)
    frames = spark.createDataFrame([(g, f, 2, 4, bytes([g + f] * 8)) for g in range(2) for f in range(3)], "gop int, frame int, height int, width int, pixels binary")
    got = sorted(packing.video_sizes(frames, ["gop"], packing.x265_params(), str(stand_in)).collect())
    assert [(r.gop, r.raw_bytes, r.exact) for r in got] == [(0, 24, True), (1, 24, True)]
    stand_in.write_text(f"#!{sys.executable}\nimport sys\nsys.exit('no encoder')\n")
    with pytest.raises(Exception, match="no encoder"):
        packing.video_sizes(frames, ["gop"], "", str(stand_in)).collect()
