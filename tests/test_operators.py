"""Hand-computed cases and properties of history, statistics, transforms, metrics, sequential models and codecs."""

from __future__ import annotations

import lzma
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import scalars as fn
from marlstone.operators import analysis, batched, blocks, codecs, color, contexts, history, image_codecs, metrics, predict, sequential, stats

RUN = "codec string, run_seq int, csize long, etime double, dtime double, emem long"


def runs(spark, rows):
    return spark.createDataFrame(rows, RUN)


# --- history


def test_best_run_keeps_the_later_of_equal_scores(spark):
    df = runs(spark, [("A", 1, 10, 1.0, 1.0, 0), ("a", 4, 10, 1.0, 1.0, 0), ("a", 2, 90, 9.0, 9.0, 0), ("b", 3, 5, 1.0, 1.0, 0)])
    assert {(r["name"], r["run_seq"]) for r in history.best_runs(df).collect()} == {("a", 4), ("b", 3)}


def test_scores(spark):
    row = spark.range(1).select(history.score(F.lit(2 * 2**20), F.lit(1.0), F.lit(0.5)).alias("v2"), history.score(F.lit(2 * 2**20), F.lit(1.0), F.lit(0.5), 1.0).alias("v1")).first()
    assert (row["v2"], row["v1"]) == (4.0, 2097154.0)


def best_of(spark, points):
    return history.best_runs(runs(spark, [(f"c{i}", i, s * 2**20, float(t), 0.0, 0) for i, (s, t) in enumerate(points)]))


def test_pareto_front(spark):
    front = history.pareto_front(best_of(spark, [(1, 9), (2, 7), (3, 8), (4, 2)]))
    assert sorted(r["name"] for r in front.collect()) == ["c0", "c1", "c3"]


def test_no_front_point_is_dominated(spark):
    rng = random.Random(1)
    points = [(rng.randint(1, 10**6), rng.randint(1, 10**6)) for _ in range(60)]
    front = [(r["csize"], r["etime"]) for r in history.pareto_front(best_of(spark, points)).collect()]
    every = [(s * 2**20, float(t)) for s, t in points]
    assert all(not any(s < fs and t < ft for s, t in every) for fs, ft in front) and (min(every)) in front


def test_tiers_and_medians(spark):
    files = spark.createDataFrame([(i, 100, i) for i in range(5)], "file_idx int, usize long, bpd0 int")
    assert [r["tier"] for r in history.tiers(files, "bpd0").orderBy("file_idx").collect()] == [0, 1, 2, 3, 4]
    ten = spark.createDataFrame([(i, 10 * i) for i in range(10)], "file_idx int, usize long")
    assert sorted(r["place"] for r in history.medians(ten, 3).collect()) == [0, 3, 4, 5, 9]


def test_insert_rank_and_axis(spark):
    best = best_of(spark, [(1, 9), (2, 7), (3, 8)])
    current = runs(spark, [("x", 9, 2 * 2**20, 6.0, 0.0, 0), ("y", 9, 2 * 2**20, 7.0, 0.0, 0)])
    assert {r["codec"]: r["place"] for r in history.insert_rank(best, current).collect()} == {"x": 2, "y": 3}
    steps = spark.createDataFrame([(1.4,), (2.0,), (40.0,), (60.0,), (0.08,), (0.0,)], "s double").select(history.axis_step(F.col("s")).alias("v")).collect()
    assert [None if r["v"] is None else round(r["v"], 6) for r in steps] == [1.0, 2.0, 25.0, 50.0, 0.1, None]


def test_adding_a_worse_run_changes_nothing(spark):
    rows = [("a", 1, 10, 1.0, 1.0, 0), ("b", 2, 20, 2.0, 2.0, 0)]
    first = sorted(map(tuple, history.best_runs(runs(spark, rows)).collect()))
    assert first == sorted(map(tuple, history.best_runs(runs(spark, [*rows, ("A", 3, 99, 9.0, 9.0, 0)])).collect()))


# --- statistics


def blobs(spark, *data):
    return spark.createDataFrame([(i, bytearray(d) if d is not None else None) for i, d in enumerate(data)], "blob_id long, data binary")


def test_byte_entropies(spark):
    df = blobs(spark, b"aabb", b"", None)
    zero = stats.entropy(stats.byte_histogram(df, "blob_id"), ["blob_id"]).collect()
    one = stats.entropy(stats.byte_histogram(df, "blob_id", 1), ["blob_id"], ["prev"]).collect()
    assert [(r["blob_id"], r["count"], round(r["bits"], 9)) for r in zero] == [(0, 4, 4.0)]
    assert [round(r["bits"], 9) for r in one] == [2.0]


def test_u16_drops_the_odd_byte(spark):
    assert {(r["sym"], r["freq"]) for r in stats.pair_histogram(blobs(spark, b"abab\x01"), "blob_id").collect()} == {(0x6261, 2)}


def test_entropy_is_bounded_by_the_alphabet(spark):
    rng = np.random.default_rng(0)
    got = stats.entropy(stats.byte_histogram(blobs(spark, rng.integers(0, 256, 4096, dtype=np.uint8).tobytes()), "blob_id"), ["blob_id"]).first()
    assert got["bits"] / got["count"] <= 8


def test_tokens(spark):
    tok, low = stats.token(F.col("v"))
    rows = spark.createDataFrame([(0,), (15,), (16,), (23,), (24,), (255,)], "v long").select(tok.alias("t"), low.alias("n")).collect()
    assert [(r["t"], r["n"]) for r in rows] == [(0, 0), (15, 0), (16, 3), (16, 3), (17, 3), (23, 6)]


# --- transforms


def test_color_by_hand(spark):
    df = spark.createDataFrame([(0, 0, 0, 10, 20, 30)], "image_id long, y int, x int, r long, g long, b long")
    get = lambda n: tuple(color.forward(df, n).first()[3:])
    assert get("t06_ycocg_r") == (20, -20, 0) and get("t03_jpeg2000") == (20, 10, -10)


@pytest.mark.parametrize("name", list(color.LIFTS))
def test_color_round_trip(spark, name):
    rng = random.Random(2)
    df = spark.createDataFrame([(0, i, 0, *(rng.randint(-128, 127) for _ in range(3))) for i in range(50)], "image_id long, y int, x int, r long, g long, b long")
    back = color.inverse(color.forward(df, name), name)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_gradient_by_hand():
    assert predict.gradient(predict.Arrays, {"N": 5, "W": 3, "NW": 4}) == 4
    assert predict.gradient(predict.Arrays, {"N": 5, "W": 3, "NW": 1}) == 5


def test_division_truncates():
    assert predict.Arrays.div(np.array([-7, 7, -6]), 3).tolist() == [-2, 2, -2]

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-128, 127), min_size=64, max_size=64), st.sampled_from(sorted(sequential.CODERS)))
def test_sequential_round_trip(plane, name):
    forward, inverse = sequential.CODERS[name]
    v = np.array([plane, plane[::-1], [7] * 64], dtype=np.int64).reshape(3, 8, 8)
    out = forward(v)
    assert (inverse(out) == v).all()
    assert (forward(v[:1]) == out[:1]).all()  # whatever shares the batch


def test_move_to_front_by_hand():
    plane = np.array([[97, 97, 98, 97, 0, 97, 0, 0]]).reshape(1, 1, 8) - 128
    assert sequential.move_to_front(plane).ravel().tolist() == [97, 0, 98, 1, 2, 1, 1, 0]


def test_halves_and_activity_by_hand():
    v = np.array([[[-128, -3, -1, 0, 1, 3, 127, 5]]])
    assert sequential.halve(v).tolist() == [[[-64, -1, 0, 0, 0, 1, 63, 2]]]
    assert sequential.halve(sequential.halve(v), True).tolist() == [[[-128, -2, 1, 1, 1, 3, 127, 5]]]
    assert sequential.activity(np.array([[[8, 0, 0, 0]]])).tolist() == [[[0, 2, 0, 0]]]  # (0 + 512) >> 2 = 128, then 128 >> 2 = 32


def adaptive_by_hand(plane, halve_at):
    """C-07 with one context, sample by sample."""
    size = int(contexts.tokens(np.array([512]))[0][0]) + 1
    counts, bits = [1] * size, 0.0
    for v in plane:
        z = -2 * v - 1 if v < 0 else 2 * v
        t, low = (z, 0) if z < 16 else (16 + (z.bit_length() - 5) * 2 + (z - (1 << z.bit_length() - 1) >> z.bit_length() - 2), z.bit_length() - 2)
        bits += low - math.log2(counts[t] / sum(counts))
        counts[t] += 1
        if counts[t] >= halve_at:
            counts = [c + 1 >> 1 for c in counts]
    return bits


def test_adaptive_counts_are_halved():
    v = np.random.default_rng(4).integers(-128, 128, (3, 16, 8))
    v[0] = np.where(v[0] > 0, 3, v[0])
    for halve_at in (4, 20, 3200):
        got = contexts.adaptive_bits(v, "zero", halve_at)
        assert np.allclose(got, [adaptive_by_hand(p.ravel().tolist(), halve_at) for p in v])
    assert contexts.adaptive_bits(np.full((1, 8, 8), 5), "qnw").tolist() == [8]


def test_running_contexts_by_hand():
    sym = np.array([[[4, 0, 1, 0], [0, 0, 0, 0]]])
    # 0, (0 + 32) >> 2, (16 + 0) >> 2, (8 + 8) >> 2; below, the larger of what stands two and three to the right
    assert contexts.running(sym).tolist() == [[[0, 8, 4, 4], [0, 1, 1, 0]]]
    assert contexts.floor_log2(np.array([1, 2, 3, 4, 65535, 65536, 2**40 - 1, 2**40])).tolist() == [0, 1, 1, 2, 15, 16, 39, 40]


def test_context_costs_of_one_level():
    hist = contexts.histogram(np.zeros((1, 8, 8), dtype=np.int64), np.zeros((1, 8, 8), dtype=np.int64), 2)
    assert contexts.model_bits(hist).tolist() == [[0.0, 0.0]]  # one level takes the whole range
    assert contexts.header_bits(hist).shape == (1, 2) and contexts.header_bits(hist)[0, 1] == 0


def test_best_predictor_of_a_ramp():
    ramp = np.add.outer(np.arange(8), 2 * np.arange(8))[None]
    size = analysis.channel_sizes([ramp, ramp, ramp])
    assert size.shape == (1, 18, 12) and (size[0, :3, 6] == 0).all() and (size[0, 3:6, 0] == 0).all() and size[0, 0, 0] > 0


def test_blocks_by_hand():
    assert blocks.run(np.array([[1, 2, 3, 4]]), "t103_wht4").tolist() == [[2, 1, 2, 0]]
    steps = blocks.wavelet(4, "haar")
    v = [5, 3, 8, 2]
    for t, mode, (k,), mul, shift in steps:
        v[t] += (1 if mode == "+" else -1) * (v[k] * mul >> shift)
    assert [v[1], v[3], v[0], v[2]] == [4, 5, 2, 6]


@pytest.mark.parametrize("name", list(blocks.PLANS))
def test_block_round_trip(name):
    x = np.random.default_rng(3).integers(-128, 128, (20, 8, 8))
    assert (blocks.inverse2d(blocks.forward2d(x, name), name) == x).all()


# --- metrics


def test_psnr_and_identity(spark):
    row = spark.range(1).select(F.round(metrics.psnr(F.lit(1.0), 255.0), 6).alias("a"), metrics.psnr(F.lit(0.0), 255.0).alias("b")).first()
    assert (row["a"], row["b"]) == (48.130804, None)


def test_verify_finds_missing_samples(spark):
    a = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 2), (0, 1, 0, 3)], "image_id long, y int, x int, v long")
    assert metrics.verify(a, a, ["image_id", "y", "x"], "image_id").count() == 0
    got = metrics.verify(a, a.where("x = 0"), ["image_id", "y", "x"], "image_id").first()
    assert (got["differing"], tuple(got["first"])) == (1, (0, 1))


def test_ssim_of_equal_planes_is_one(spark):
    df = spark.range(64).select(F.lit(0).cast("long").alias("image_id"), F.expr("cast(id div 8 as int)").alias("y"), (F.col("id") % 8).cast("int").alias("x"), (F.col("id") * 3 % 50).alias("v")).withColumn("w", F.col("v"))
    rows = metrics.ssim_map(df, 5).collect()
    assert len(rows) == 16 and all(abs(r["ssim"] - 1) < 1e-9 for r in rows)


# --- codecs


@pytest.mark.parametrize("name", list(codecs.CODECS))
@pytest.mark.parametrize("data", [b"", b"a", b"a" * 5000, bytes(range(256)) * 3, b"abcabcabcabdabcabc" * 50, np.random.default_rng(4).integers(0, 256, 3000, dtype=np.uint8).tobytes()], ids=["empty", "one", "run", "all", "text", "noise"])
def test_codec_round_trip(name, data):
    encode, decode = codecs.CODECS[name]
    assert decode(encode(data)) == data


def _blobs():
    rng = np.random.default_rng(6)
    words = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in rng.integers(2, 9, 60)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 60, n)) for n in rng.integers(0, 1500, 90)]
    deep = b"".join(bytes([i]) * 2**i for i in range(18))
    return [b"", b"a", b"a" * 5000, b"ab" * 4096, b"z" * 4096, b"", bytes(range(256)) * 40, b"\xff" * 130 + b"x" + b"\x80" * 20000, deep, deep[::-1], rng.integers(0, 256, 9000, dtype=np.uint8).tobytes(), *texts, b""]


@pytest.mark.parametrize("name", ["rle", "rice", "huffman", "rans0", "lz"])
def test_codecs_over_many_blobs_make_the_same_streams(name):
    blobs = _blobs()
    one, many = codecs.CODECS[name], batched.pair(codecs.CODECS[name])
    assert one in batched.PAIRS
    for part in (blobs, blobs[:12], [b""], []):
        streams = [one[0](b) for b in part]
        assert many[0](part) == streams
        assert many[1](streams) == part == [one[1](d) for d in streams]


def test_lzma_sizes_are_those_of_preset_6():
    blobs = [*_blobs(), bytes(3 << 20)]
    assert [len(codecs.lzma_encode(b)) for b in blobs] == [len(lzma.compress(b)) for b in blobs]


def test_sizes_need_no_decoding(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc" * 40)), (2, None)], "blob_id long, data binary")
    rows = codecs.measure(df, ("rle", "lzma"), restore=False).collect()
    assert {(r["blob_id"], r["codec"], r["csize"], r["lossless"]) for r in rows} == {(i, k, len(codecs.CODECS[k][0](b)), None) for i, b in ((1, b"abc" * 40), (2, b"")) for k in ("rle", "lzma")}


def test_rans_is_near_the_entropy():
    data = np.random.default_rng(5).choice([1, 2, 3, 4], 20000, p=[0.7, 0.2, 0.05, 0.05]).astype(np.uint8).tobytes()
    p = np.bincount(np.frombuffer(data, dtype=np.uint8)) / len(data)
    p = p[p > 0]
    assert len(codecs.rans_encode(data)) < 1.02 * len(data) * -(p * np.log2(p)).sum() / 8 + 40


# --- functions


def test_scalar_functions(spark):
    df = spark.createDataFrame([("C:\\a.b\\file.tar.PPM", "  42x", "12.50e3", 40, -3)], "p string, u string, f string, n long, z long")
    row = df.select(
        fn.last_index(F.col("p"), "\\").alias("i"), fn.clean_path(F.col("p")).alias("c"), fn.file_title(F.col("p")).alias("t"), fn.extension(F.col("p")).alias("e"), fn.parse_uint(F.col("u")).alias("u"), fn.parse_float(F.col("f")).alias("f"),
        fn.floor_log2(F.col("n")).alias("lo"), fn.ceil_log2(F.col("n")).alias("hi"), fn.lowest_bit(F.col("n")).alias("lsb"), fn.zigzag(F.col("z")).alias("zz"), fn.duration_text(F.lit(90061.5)).alias("d"), fn.parse_until(F.lit("ab  \tc"), "\t").alias("s"),
    ).first()
    assert tuple(row) == (6, "C:/a.b/file.tar.PPM/", "file.tar", "PPM", 42, 12.5, 5, 6, 3, 5, "1-01-01-01.500000", "ab")


def test_templates(spark):
    df = spark.createDataFrame([("c1 *.ppm *.c1", "c1 *.c1 *.ppm"), ("c1 *.ppm *.c1", "c1 *.c2 *.ppm"), ("c1 *.ppm", "x")], "e string, d string")
    assert [r[0] for r in df.select(fn.template_ok(F.col("e"), F.col("d"))).collect()] == [True, False, False]
    assert df.select(fn.fill_template(F.col("e"), F.lit("s"), F.lit("t"))).first()[0] == 'c1 "s" "t"'


# --- image codecs


def _pictures():
    rng = np.random.default_rng(1)
    smooth = np.cumsum(np.cumsum(rng.integers(-3, 4, (6, 1, 8, 8)), 2), 3)
    v = np.clip(smooth + rng.integers(-4, 5, (6, 3, 8, 8)), -128, 127)
    v[0], v[1], v[2], v[3] = 0, rng.integers(-128, 128, (3, 8, 8)), 127, -128
    return v


@pytest.mark.parametrize("name", image_codecs.NAMES)
def test_image_codec_round_trip(name):
    v = _pictures()
    data = image_codecs.encode(v, name)
    assert (image_codecs.decode(data, name, v.shape) == v).all()
    assert image_codecs.encode(v[4:5], name) == data[4:5]  # whatever shares the batch
    tall = np.concatenate([v, v[:, :, ::-1]], axis=2)  # 16 rows
    assert (image_codecs.decode(image_codecs.encode(tall, name), name, tall.shape) == tall).all()


def test_lz_streams_of_all_images_are_coded_together(monkeypatch):
    v, calls, binary = _pictures(), [], image_codecs.binary_encode
    monkeypatch.setattr(image_codecs, "binary_encode", lambda *a, **b: calls.append(1) or binary(*a, **b))
    data = image_codecs.encode(v, "c56_lz_ac")
    assert len(calls) == 1
    assert data == [image_codecs.encode(v[i : i + 1], "c56_lz_ac")[0] for i in range(len(v))]
    assert (image_codecs.decode(data, "c56_lz_ac", v.shape) == v).all()


def test_few_images_are_dealt_to_all_cores(spark):
    df = spark.createDataFrame([(i, *[p.ravel().tolist() for p in image]) for i, image in enumerate(_pictures())], "image_id long, r array<int>, g array<int>, b array<int>").coalesce(1)
    got = image_codecs.measure(df, ("c57_fast_rice",))
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert [(r["image_id"], r["wrong"]) for r in got.orderBy("image_id").collect()] == [(i, 0) for i in range(6)]


@pytest.mark.parametrize("name", list(image_codecs.LOSSY))
def test_lossy_image_codec_restores_its_coefficients(name):
    v = _pictures()
    back = image_codecs.lossy_decode(image_codecs.lossy_encode(v, name), name, v.shape)
    colour, transform, step, _ = image_codecs.LOSSY[name]
    planes = sequential.inside(blocks.inverse2d(image_codecs.quantised(v, name) * step, transform))
    assert (back == image_codecs.COLOURS[colour][1](planes, np.zeros(len(v), dtype=np.int64), True)).all()
    assert ((back - v)[4:] ** 2).mean() < 200


@pytest.mark.parametrize("name", ["t24_mixnc", "t29_l1crct", "t31_l1bcrct", "t37_cgcrct", "t61_pu"])
def test_models_over_channels_round_trip(spark, name):
    v = _pictures()
    df = spark.createDataFrame([(i, *[p.ravel().tolist() for p in image]) for i, image in enumerate(v)], "image_id long, r array<int>, g array<int>, b array<int>")
    rows = analysis.channel_roundtrip(df, name).collect()
    assert len(rows) == len(v) and all(r["mismatches"] == 0 for r in rows) and rows[0]["magnitude"] == 0
