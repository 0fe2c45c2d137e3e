"""Files in, files out: PNM, WAV, histories, templates, channel split and join, streams."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.sources import files
from marlstone.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    x = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    (tmp_path / "a.PPM").write_bytes(b"P6\n# note\n3 2\n# more\n255\n" + x.tobytes())
    (tmp_path / "b.pgm").write_bytes(files.encode_pnm(np.array([[[1], [300]]], dtype=np.uint16)))
    (tmp_path / "bad.ppm").write_bytes(b"P6\n9 9\n255\nxx")
    (tmp_path / "empty.ppm").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.ppm").write_bytes(files.encode_pnm(x))
    body = np.array([[1, -2], [3, -4]], dtype="<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, 2, 44100, 176400, 4, 16)
    chunks = b"fmt " + struct.pack("<I", 16) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(body)) + body
    (tmp_path / "t.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks)
    return tmp_path


def test_scan(spark, folder):
    got = files.scan(spark, str(folder), ("ppm",))
    assert got.columns == ["path", "length"] and got.count() == 2 and files.valid_outputs(got).count() == 2
    assert files.scan(spark, str(folder), ("ppm",), recursive=True).count() == 3


def test_images(spark, folder):
    raw = files.scan(spark, str(folder), ("ppm", "pgm"), content=True)
    planes = files.images(raw)
    rows = {(r["path"].rsplit("/", 1)[1], r["ch"]): r for r in planes.collect()}
    assert set(rows) == {("a.PPM", 0), ("a.PPM", 1), ("a.PPM", 2), ("b.pgm", 0), ("bad.ppm", None)}
    assert rows["bad.ppm", None]["error"] and rows["bad.ppm", None]["px"] is None and rows["b.pgm", 0]["error"] is None
    assert rows["a.PPM", 1]["px"] == [1, 4, 7, 10, 13, 16] and rows["b.pgm", 0]["px"] == [1, 300] and rows["b.pgm", 0]["maxval"] == 65535
    assert files.explode_planes(planes).where("ch = 2 and y = 1 and x = 2").first()["v"] == 17
    assert {r[0] for r in raw.select(files.header_kind("content")).collect()} == {"PPM", "PGM"}


def test_split_and_join(spark, folder):
    planes = files.images(files.scan(spark, str(folder), ("ppm",), content=True))
    joined = files.join_channels(planes.where("error is null")).first()["content"]
    assert {r["content"] is None for r in files.join_channels(planes).collect()} == {True, False}  # a file without channels
    assert files.decode_pnm(bytes(joined))[3].ravel().tolist() == list(range(18))
    assert files.split_channels(planes).count() == 3


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(6)
    for kind, channels in ((np.uint8, 1), (np.uint8, 3), (np.uint16, 1), (np.uint16, 3)):
        x = rng.integers(0, np.iinfo(kind).max, (5, 7, channels)).astype(kind)
        w, h, top, back = files.decode_png(files.encode_png(x))
        assert (w, h, top) == (7, 5, np.iinfo(kind).max) and (back == x).all()
    x = rng.integers(0, 256, (5, 6, 4)).astype(np.int64)
    flat, rows = x.reshape(5, 24), []
    for y, kind in enumerate((0, 1, 2, 3, 4)):  # every filter type, with alpha
        line = [kind]
        for i in range(24):
            a, b, c = flat[y, i - 4] if i >= 4 else 0, flat[y - 1, i] if y else 0, flat[y - 1, i - 4] if y and i >= 4 else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append(int(flat[y, i] - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        rows.append(bytes(line))
    head = (6).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes([8, 6, 0, 0, 0])
    data = files._SIGNATURE + files._chunk(b"IHDR", head) + files._chunk(b"tEXt", b"x") + files._chunk(b"IDAT", zlib.compress(b"".join(rows))) + files._chunk(b"IEND", b"")
    assert (files.decode_png(data)[3] == x[:, :, :3]).all()
    assert files.decode_png(data[:-20]) is None and files.decode_png(data.replace(b"tEXt", b"tEXx")) is None and files.decode_png(b"") is None


def test_tracks(spark, folder):
    got = {r["ch"]: (r["rate"], r["samples"]) for r in files.tracks(files.scan(spark, str(folder), ("wav", "ppm"), content=True)).where("error is null").collect()}
    assert files.tracks(files.scan(spark, str(folder), ("wav", "ppm"), content=True)).where("error is not null").count() == 2
    assert got == {0: (44100, [1, 3]), 1: (44100, [-2, -4])}


def test_history(spark, tmp_path):
    text = "C:/data/\tppm\nfiles:\n100\ta.ppm\n200\tb.ppm\ntests:\nc01\t20240102_030405\t30 1 2 3 4\t10 .5 1 2 3\t20 .5 1 3 4\n"
    (tmp_path / "h.txt").write_text(text)
    f, c = files.history(spark, str(tmp_path / "h.txt"))
    assert [(r["file_idx"], r["filename"], r["usize"]) for r in f.orderBy("file_idx").collect()] == [(0, "a.ppm", 100), (1, "b.ppm", 200)]
    rows = c.orderBy("file_idx").collect()
    assert [(r["file_idx"], r["csize"], r["etime"]) for r in rows] == [(-1, 30.0, 1.0), (0, 10.0, 0.5), (1, 20.0, 0.5)] and str(rows[0]["ts"]) == "2024-01-02 03:04:05"
    v2 = "x\tppm\nfiles:\n100\t777\ta.ppm\ntests:\nc\t20240102_030405\t30 1 2 3 4 .1 .2 .3\t30 1 2 3 4 .1 .2 .3\n"
    assert files.parse_history(v2, 8)[0] == [(0, "a.ppm", 100, 777)]
    files.append_runs(c, str(tmp_path / "runs"))
    files.append_runs(c, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 6


def test_templates_and_lines(spark, tmp_path):
    (tmp_path / "z.txt").write_text("c *.ppm *.c\r\nc *.c *.ppm")
    row = files.templates(spark, str(tmp_path / "z.txt")).first()
    assert (row["encode"], row["decode"]) == ("c *.ppm *.c", "c *.c *.ppm")
    (tmp_path / "list.txt").write_text("/a\n\n/b\n")
    assert files.folder_list(spark, str(tmp_path / "list.txt")) == ["/a", "/b"]
    files.write_lines(spark.createDataFrame([(1, "b"), (0, "a")], "block int, line string"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b"]


def test_frames(spark, folder):
    rows = files.frames(files.scan(spark, str(folder), ("ppm",), recursive=True)).collect()
    assert sorted(r["frame_no"] for r in rows) == [0, 0, 1]


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 5} 0{i % 5}:10:00", "a", 1.0) for i in range(10)]
    spark.createDataFrame(rows, "id int, t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    query = ingest.windowed_totals(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.sql("select sum(n) from totals").first()[0] == 10
    ingest.append_new_runs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
