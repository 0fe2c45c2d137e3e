"""Files as tables: directory scans, PNM and WAV decoding, run histories, command templates; and the sinks for them.

Every reader starts from Spark's binaryFile or text source, so listing, splitting and retries are Spark's; decoding is
one Arrow pass. Metadata-only scans never read the content column.
"""

from __future__ import annotations

import re
import struct
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import extension


def scan(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), recursive: bool = False, content: bool = False) -> DataFrame:
    """S-01 to S-04: (path, length[, content]) of files, by extension without regard to case. Spark leaves out empty files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    if extensions:
        df = df.where(F.lower(extension(F.col("path"))).isin([e.lower() for e in extensions]))
    return df.select("path", "length", *(["content"] if content else []))


def valid_outputs(files: DataFrame) -> DataFrame:
    """P-15: files that exist and are not empty."""
    return files.where("length > 0")


def header_kind(content) -> object:
    """S-07: PPM, PGM, C01 or invalid, from the first bytes."""
    tag = F.substring(F.col(content) if isinstance(content, str) else content, 1, 2).cast("string")
    return F.when(tag == "P6", "PPM").when(tag == "P5", "PGM").when(tag == "C0", "C01").otherwise("invalid")


_PNM = re.compile(rb"P([56])\s(?:\s*#[^\n]*\n)*\s*(\d+)\s+(\d+)\s(?:\s*#[^\n]*\n)*\s*(\d+)\s")


def decode_pnm(data: bytes) -> tuple[int, int, int, np.ndarray] | None:
    """(width, height, maxval, samples (h, w, channels)) of a binary PPM or PGM of 8 or 16 (big-endian) bits; None for
    other or cut off content."""
    m = _PNM.match(data)
    if not m:
        return None
    channels, w, h, top = (3 if m[1] == b"6" else 1), int(m[2]), int(m[3]), int(m[4])
    if top not in (255, 65535) or len(data) - m.end() < w * h * channels * (1 if top == 255 else 2):
        return None
    return w, h, top, np.frombuffer(data, dtype=np.uint8 if top == 255 else ">u2", count=w * h * channels, offset=m.end()).reshape(h, w, channels)


def encode_pnm(x: np.ndarray) -> bytes:
    """K-04: a binary PPM (three channels) or PGM (one)."""
    h, w, c = x.shape
    wide = x.dtype.itemsize > 1
    return b"P%d\n%d %d\n%d\n" % (6 if c == 3 else 5, w, h, 65535 if wide else 255) + x.astype(">u2" if wide else np.uint8).tobytes()


_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(tag: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + tag + body + zlib.crc32(tag + body).to_bytes(4, "big")


def encode_png(x: np.ndarray) -> bytes:
    """K-04: a PNG of 8 or 16 bits with one or three channels; rows as differences to the row above."""
    h, w, c = x.shape
    wide = x.dtype.itemsize > 1
    rows = np.ascontiguousarray(x.astype(">u2" if wide else np.uint8)).view(np.uint8).reshape(h, -1)
    above = np.vstack([np.zeros_like(rows[:1]), rows[:-1]])
    raw = np.hstack([np.full((h, 1), 2, dtype=np.uint8), rows - above])
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([16 if wide else 8, 2 if c == 3 else 0, 0, 0, 0])
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes from rows with a filter type in front; neighbours are `step` bytes apart."""
    out = np.zeros((len(raw), raw.shape[1] - 1), dtype=np.int64)
    above = np.zeros(out.shape[1], dtype=np.int64)
    for y, line in enumerate(raw.astype(np.int64)):
        kind, line = line[0], line[1:]
        if kind in (0, 2):
            out[y] = line + (above if kind == 2 else 0) & 255
        elif kind == 1:
            for k in range(step):
                out[y, k::step] = np.cumsum(line[k::step]) & 255
        else:
            row = out[y]
            for i in range(len(row)):
                west, north, corner = (row[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
                if kind == 3:
                    p = (west + north) // 2
                else:
                    guess = west + north - corner
                    p = min((abs(guess - west), 0, west), (abs(guess - north), 1, north), (abs(guess - corner), 2, corner))[2]
                row[i] = line[i] + p & 255
        above = out[y]
    return out.astype(np.uint8)


def decode_png(data: bytes) -> tuple[int, int, int, np.ndarray] | None:
    """(width, height, maxval, samples (h, w, channels)) of a PNG without interlacing, of 8 or 16 bits: grey, colour, either
    with alpha (which is left out), or 8-bit palette. None for other, broken or cut off content."""
    if data[:8] != _SIGNATURE:
        return None
    at, head, body, palette = 8, b"", [], b""
    while at + 12 <= len(data):
        size, tag = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if len(part) < size or zlib.crc32(tag + part) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            return None
        head, palette = part if tag == b"IHDR" else head, part if tag == b"PLTE" else palette
        body += [part] if tag == b"IDAT" else []
        at += 12 + size
    if len(head) != 13 or head[12] or head[8] not in (8, 16) or head[9] not in (0, 2, 3, 4, 6) or head[9] == 3 and head[8] == 16:
        return None
    w, h, depth, stored = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[9]]
    step = stored * depth // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    except zlib.error:
        return None
    if not w or not h or len(raw) != h * (1 + w * step):
        return None
    x = _unfilter(raw.reshape(h, -1), step).view(np.uint8 if depth == 8 else ">u2").reshape(h, w, stored)
    if head[9] == 3:
        colours = np.frombuffer(palette, dtype=np.uint8).reshape(-1, 3)
        return (w, h, 255, colours[x[:, :, 0]]) if x.max(initial=0) < len(colours) else None
    return w, h, 255 if depth == 8 else 65535, x[:, :, : {0: 1, 2: 3, 4: 1, 6: 3}[head[9]]]


def decode_image(data: bytes) -> tuple[int, int, int, np.ndarray] | None:
    return decode_pnm(data) or decode_png(data)


def images(files: DataFrame) -> DataFrame:
    """S-05, S-06, S-08, S-10: (path, w, h, maxval, ch, px, error) with one row per channel plane of PNM and PNG files; a
    file that can't be read has one row with an error and nothing else."""

    def run(batches):
        for b in batches:
            out = {"path": [], "w": [], "h": [], "maxval": [], "ch": [], "px": [], "error": []}
            for path, data in zip(b["path"].to_pylist(), b["content"], strict=True):
                got = decode_image(data.as_py() or b"")
                rows = [(path, got[0], got[1], got[2], ch, got[3][:, :, ch].ravel().astype(np.int32), None) for ch in range(got[3].shape[2])] if got else [(path, None, None, None, None, None, "not a readable PNM or PNG image")]
                for row in rows:
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("w", pa.int32()), ("h", pa.int32()), ("maxval", pa.int32()), ("ch", pa.int32()), ("px", pa.list_(pa.int32())), ("error", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "path string, w int, h int, maxval int, ch int, px array<int>, error string")


def explode_planes(planes: DataFrame) -> DataFrame:
    """D-01 exploded: (path, ch, y, x, v)."""
    return planes.select("path", "w", "ch", F.posexplode("px").alias("pos", "v")).select("path", "ch", F.expr("pos div w").cast("int").alias("y"), (F.col("pos") % F.col("w")).alias("x"), "v")


def split_channels(planes: DataFrame) -> DataFrame:
    """K-08: every channel plane as a PGM file (path, content); rows with an error have no plane."""

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            data = [encode_pnm(np.array(r["px"]).reshape(r["h"], r["w"], 1).astype(np.uint8 if r["maxval"] == 255 else np.uint16)) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([f"{r['path']}.{r['ch']}" for r in rows], pa.string()), pa.array(data, pa.binary())], ["path", "content"])

    return planes.where("px is not null").select("path", "w", "h", "maxval", "ch", "px").mapInArrow(run, "path string, content binary")


def join_channels(planes: DataFrame, form: str = "pnm") -> DataFrame:
    """K-08, K-04: (path, content) as PPM (or PNG, by `form`) from three planes per path; without all three the content is
    null."""
    wide = planes.groupBy("path", "w", "h", "maxval").agg(*[F.max(F.when(F.col("ch") == i, F.col("px"))).alias(f"p{i}") for i in range(3)])

    def run(batches):
        encode = {"pnm": encode_pnm, "png": encode_png}[form]
        for b in batches:
            data = []
            for r in b.to_pylist():
                parts = [r[f"p{i}"] for i in range(3)]
                whole = all(p is not None for p in parts)
                data.append(encode(np.stack([np.array(p).reshape(r["h"], r["w"]) for p in parts], axis=2).astype(np.uint8 if r["maxval"] == 255 else np.uint16)) if whole else None)
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(data, pa.binary())], ["path", "content"])

    return wide.mapInArrow(run, "path string, content binary")


def decode_wav(data: bytes) -> tuple[int, np.ndarray] | None:
    """S-09: (sample rate, samples (frames, channels)) of 16-bit PCM; chunks before `data` are skipped."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if tag == b"fmt " and size == 16 and int.from_bytes(body[:2], "little") == 1:
            form = int.from_bytes(body[2:4], "little"), int.from_bytes(body[4:8], "little"), int.from_bytes(body[14:16], "little")
        if tag == b"data" and form and form[2] == 16:
            frames = len(body) // (2 * form[0])
            return form[1], np.frombuffer(body, dtype="<i2", count=frames * form[0]).reshape(frames, form[0])
        at += 8 + size + size % 2
    return None


def encode_wav(x: np.ndarray, rate: int = 44100) -> bytes:
    """16-bit PCM of samples (frames, channels)."""
    channels, body = x.shape[1], np.ascontiguousarray(x.astype("<i2")).tobytes()
    form = struct.pack("<HHIIHH", 1, channels, rate, 2 * channels * rate, 2 * channels, 16)
    chunks = b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def tracks(files: DataFrame) -> DataFrame:
    """D-04: (path, rate, ch, samples, error), one row per channel; a file that can't be read has one row with an error."""

    def run(batches):
        for b in batches:
            out = {"path": [], "rate": [], "ch": [], "samples": [], "error": []}
            for path, data in zip(b["path"].to_pylist(), b["content"], strict=True):
                got = decode_wav(data.as_py() or b"")
                rows = [(path, got[0], ch, got[1][:, ch], None) for ch in range(got[1].shape[1])] if got else [(path, None, None, None, "not a readable WAVE file")]
                for row in rows:
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("rate", pa.int32()), ("ch", pa.int32()), ("samples", pa.list_(pa.int16())), ("error", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "path string, rate int, ch int, samples array<smallint>, error string")


CELL = {5: ("csize", "etime", "dtime", "emem", "dmem"), 8: ("csize", "etime", "dtime", "emem", "dmem", "rmse_y", "rmse_u", "rmse_v")}
_FILES = "dataset string, file_idx int, filename string, usize long, cscore long"
_CELLS = "dataset string, run_seq int, codec string, ts string, file_idx int, values array<double>"


def parse_history(text: str, fields: int) -> tuple[list[tuple], list[tuple]]:
    """S-12, S-13: files and cells of one history text of `fields`-value cells. A run's cells align with the file list by
    position; the first cell of a run is its total (file_idx -1)."""
    head, _, tail = text.partition("tests:")
    rows = [ln.split("\t") for ln in head.splitlines()[1:] if ln.strip() and ln.strip() != "files:"]
    files = [(i, r[-1].strip(), int(r[0]), int(r[1]) if len(r) > 2 else None) for i, r in enumerate(rows)]
    cells = []
    for run, line in enumerate(ln for ln in tail.splitlines() if ln.strip()):
        name, rest = line.strip().split("\t", 1)
        words = rest.split()
        values = [float(w) for w in words[1:]]
        for k in range(0, len(values) // fields):
            cells.append((run, name.strip(), words[0], k - 1, values[k * fields : (k + 1) * fields]))
    return files, cells


def history(spark: SparkSession, path: str, fields: int = 5) -> tuple[DataFrame, DataFrame]:
    """(files, cells) of history text files, normalised once; parquet is appended to from there on."""
    raw = spark.read.text(path, wholetext=True).withColumn("dataset", F.input_file_name())

    def run(part):
        def kernel(batches):
            for b in batches:
                out = []
                for ds, text in zip(b["dataset"].to_pylist(), b["value"].to_pylist(), strict=True):
                    files, cells = parse_history(text, fields)
                    out += [{"dataset": ds, "file_idx": i, "filename": n, "usize": u, "cscore": c} for i, n, u, c in files] if part == "files" else [{"dataset": ds, "run_seq": r, "codec": n, "ts": t, "file_idx": k, "values": v} for r, n, t, k, v in cells]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("dataset", pa.string()), ("file_idx", pa.int32()), ("filename", pa.string()), ("usize", pa.int64()), ("cscore", pa.int64())] if part == "files" else [("dataset", pa.string()), ("run_seq", pa.int32()), ("codec", pa.string()), ("ts", pa.string()), ("file_idx", pa.int32()), ("values", pa.list_(pa.float64()))]))

        return kernel

    files = raw.mapInArrow(run("files"), _FILES)
    cells = raw.mapInArrow(run("cells"), _CELLS).withColumn("ts", F.to_timestamp_ntz("ts", F.lit("yyyyMMdd_HHmmss")))
    return files, cells.select("dataset", "run_seq", "codec", "ts", "file_idx", *[F.get("values", F.lit(i)).alias(c) for i, c in enumerate(CELL[fields])])


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or a local one if the master is local."""
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if shared is None and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='marlstone-')).rstrip('/')}/files-{uuid.uuid4().hex}"


def append_runs(cells: DataFrame, path: str) -> None:
    """K-01: append run records; nothing already written is rewritten."""
    cells.write.mode("append").parquet(path)


def templates(spark: SparkSession, path: str) -> DataFrame:
    """S-14: (path, encode, decode) of two-line command templates; the last newline may be missing."""
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n", -1)
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.get(lines, F.lit(0)).alias("encode"), F.get(lines, F.lit(1)).alias("decode"))


def folder_list(spark: SparkSession, path: str) -> list[str]:
    """S-15: one folder per line of a small configuration file."""
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]


def write_lines(lines: DataFrame, path: str) -> None:
    """K-02, K-03: one text file in the order of (block, line); for reports, which are small."""
    lines.orderBy("block", "line").select("line").coalesce(1).write.mode("overwrite").text(path)


def frames(files: DataFrame) -> DataFrame:
    """S-17, D-18: frames of a folder numbered in order of their names."""
    from pyspark.sql import Window

    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return files.withColumn("folder", folder).withColumn("frame_no", F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1)
