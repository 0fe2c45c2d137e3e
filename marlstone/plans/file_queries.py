"""Registered queries over file formats: tables are turned into files' content, read back and compared in SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import codecs, stats
from ..sources import files
from ..sources import views as v
from .registry import register

_DIGEST = "aggregate(transform({c}, (p, i) -> cast(p as bigint) * (i + 1)), 0L, (a, p) -> a + p)"


def _channel_rows(s, d):
    """One row per channel plane, levels from 0; every seventh image lacks its last channel."""
    rgb = v.rgb_bytes(s, d)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("ch"), F.transform(c, lambda e: e + 128).alias("px")) for i, c in enumerate("rgb")])).alias("p")
    planes = rgb.select(F.col("image_id").cast("string").alias("path"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(255).alias("maxval"), rows).select("path", "w", "h", "maxval", "p.ch", "p.px")
    return planes.where("ch < 2 or cast(path as bigint) % 7 <> 3")


def _read_back(planes):
    return files.images(planes).select(F.col("path").cast("long").alias("image_id"), "ch", "w", "h", "maxval", F.expr(_DIGEST.format(c="px")).alias("digest"), F.col("error").isNotNull().alias("broken"))


_BACK = f"""WITH {v.RGB}, p AS (SELECT image_id, unnest(range(0, 3))::INT AS ch, unnest([r, g, b]) + 128 AS u, y * 8 + x + 1 AS k FROM rgb)
    SELECT image_id, ch, 8 AS w, 8 AS h, 255 AS maxval, CAST(sum(u * k) AS BIGINT) AS digest, false AS broken FROM p WHERE image_id % 7 <> 3 GROUP BY image_id, ch
    UNION ALL SELECT DISTINCT image_id, CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS BIGINT), true FROM p WHERE image_id % 7 = 3"""
for _form, _name in (("pnm", "s05_k04_pnm"), ("png", "s10_k04_png")):
    register(_name, lambda s, d, form=_form: _read_back(files.join_channels(_channel_rows(s, d), form)), _BACK)

register("k08_split_channels", lambda s, d: files.images(files.split_channels(_channel_rows(s, d))).select("path", "ch", F.expr(_DIGEST.format(c="px")).alias("digest")), f"""WITH {v.RGB}, p AS (SELECT image_id, unnest(range(0, 3))::INT AS c, unnest([r, g, b]) + 128 AS u, y * 8 + x + 1 AS k FROM rgb)
    SELECT image_id || '.' || c AS path, 0 AS ch, CAST(sum(u * k) AS BIGINT) AS digest FROM p WHERE c < 2 OR image_id % 7 <> 3 GROUP BY image_id, c""")  # fmt: skip
register("s07_header_kinds", lambda s, d: files.join_channels(_channel_rows(s, d)).select(files.header_kind("content").alias("kind")).unionByName(files.split_channels(_channel_rows(s, d)).select(files.header_kind("content").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n")), f"""WITH {v.RGB}, i AS (SELECT DISTINCT image_id FROM rgb)
    SELECT 'PPM' AS kind, count(*) FILTER (image_id % 7 <> 3) AS n FROM i UNION ALL SELECT 'invalid', count(*) FILTER (image_id % 7 = 3) FROM i UNION ALL SELECT 'PGM', CAST(sum(CASE WHEN image_id % 7 = 3 THEN 2 ELSE 3 END) AS BIGINT) FROM i""")  # fmt: skip


def _wave(s, d):
    """S-09: tracks as two-channel files (samples, and their halves), read back."""
    tracks = v.pcm(s, d).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sample"))).alias("p"))

    def run(batches):
        for b in batches:
            data = []
            for p in b["p"].to_pylist():
                x = np.array([e["sample"] for e in p]).clip(-32768, 32767)
                data.append(files.encode_wav(np.stack([x, x // 2], axis=1)))
            yield pa.RecordBatch.from_arrays([b["track_id"].cast(pa.string()), pa.array(data, pa.binary())], ["path", "content"])

    got = files.tracks(tracks.select("track_id", "p").mapInArrow(run, "path string, content binary"))
    return got.select(F.col("path").cast("long").alias("track_id"), "rate", "ch", F.size("samples").cast("long").alias("frames"), F.expr(_DIGEST.format(c="samples")).alias("digest"))


register("s09_wave", _wave, f"""WITH {v.PCM}, c AS (SELECT track_id, pos, unnest(range(0, 2))::INT AS ch, unnest([greatest(-32768, least(32767, sample)), CAST(floor(greatest(-32768, least(32767, sample)) / 2.0) AS BIGINT)]) AS e FROM pcm)
    SELECT CAST(track_id AS BIGINT) AS track_id, 44100 AS rate, ch, count(*) AS frames, CAST(sum(e * (pos + 1)) AS BIGINT) AS digest FROM c GROUP BY track_id, ch""")  # fmt: skip


def _tokens(s, d):
    """C-08: tokens and bypass bits of zigzag samples of tracks."""
    z = v.pcm(s, d).select(F.when(F.col("sample") < 0, -2 * F.col("sample") - 1).otherwise(2 * F.col("sample")).alias("z"))
    token, low = stats.token(F.col("z"))
    return z.select(token.cast("long").alias("token"), low.cast("int").alias("low")).groupBy("token", "low").agg(F.count("*").alias("n"))


register("c08_tokens", _tokens, f"""WITH {v.PCM}, z AS (SELECT CASE WHEN sample < 0 THEN -2 * sample - 1 ELSE 2 * sample END AS z FROM pcm), l AS (SELECT z, len(bin(greatest(z, 1))) - 1 AS lg FROM z)
    SELECT CAST(CASE WHEN z < 16 THEN z ELSE 16 + (lg - 4) * 2 + ((z - (1 << lg)) >> (lg - 1)) END AS BIGINT) AS token, CAST(CASE WHEN z < 16 THEN 0 ELSE lg - 1 END AS INT) AS low, count(*) AS n FROM l GROUP BY ALL""")  # fmt: skip


def _varints(s, d):
    """F-26: variable-length integers: their bytes, and what reading them back gives."""

    def run(batches):
        for b in batches:
            ids = b["n"].to_pylist()
            data = [codecs._varint(i) for i in ids]
            yield pa.RecordBatch.from_arrays([b["n"], pa.array([len(x) for x in data], pa.int64()), pa.array([codecs._unvarint(x, 0)[0] for x in data], pa.int64())], ["n", "bytes", "back"])

    return v.table(s, d, "orders").select((F.col("o_orderkey") * F.col("o_orderkey") * 31).cast("long").alias("n")).mapInArrow(run, "n long, bytes long, back long").groupBy("bytes").agg(F.count("*").alias("count"), F.sum((F.col("n") != F.col("back")).cast("long")).alias("wrong"))


register(
    "f26_varints",
    _varints,
    "WITH n AS (SELECT CAST(o_orderkey AS BIGINT) * o_orderkey * 31 AS n FROM orders) SELECT CAST((len(bin(greatest(n, 1))) + 6) // 7 AS BIGINT) AS bytes, count(*) AS count, CAST(0 AS BIGINT) AS wrong FROM n GROUP BY 1",
)


# --- files that are written to a shared folder and read again


def _appended(s, d):
    """K-01: cells are appended in two parts; what a reader then sees."""
    path, cells = files.scratch(s), v.cells(s, d)
    for part in range(2):
        files.append_runs(cells.where(f"file_idx % 2 = {part}"), path)
    return s.read.parquet(path).groupBy("codec").agg(F.count("*").alias("n"), F.sum("csize").alias("csize"))


register("k01_appended_runs", _appended, f"WITH {v.CELLS} SELECT codec, count(*) AS n, CAST(sum(csize) AS BIGINT) AS csize FROM cells GROUP BY codec")

#: One history a supplier: its first files, and a run a month with a total and a cell per file.
_FILES_A_HISTORY, _HISTORIES = 4, 5


def _history_texts(s, d):
    few = v.files(s, d).where(f"file_idx <= {_FILES_A_HISTORY}").select("file_idx", F.concat(F.col("usize").cast("string"), F.lit("\t"), F.col("filename"), F.lit(".ppm")).alias("line"))
    head = few.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "line"))), lambda x: x["line"]), "\n").alias("head"))
    month = F.array(*[F.struct(F.lit(m).alias("m"), F.array(*[F.lit(float(m * 10 + k)) for k in range(5 * (_FILES_A_HISTORY + 1))]).alias("x")) for m in range(1, 4)])
    runs = F.transform(month, lambda r: F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("\t20240"), r["m"].cast("string"), F.lit("05_101112\t"), F.array_join(F.transform(r["x"], lambda e: (e + F.col("id")).cast("string")), " ")))
    text = F.concat(F.lit("C:/data/\tppm\nfiles:\n"), F.col("head"), F.lit("\ntests:\n"), F.array_join(runs, "\n"))
    return s.range(1, _HISTORIES + 1).crossJoin(head).select("id", text.alias("value"))


def _history(s, d):
    """S-12, S-01, S-04: histories written as text files, found by a scan, parsed and aligned with their files."""
    path = files.scratch(s)
    texts = _history_texts(s, d)
    texts.repartition(_HISTORIES, "id").write.partitionBy("id").text(path)
    found = files.scan(s, path, ("txt",), recursive=True)
    listed, cells = files.history(s, path)
    at = F.regexp_extract("dataset", r"id=(\d+)", 1).cast("long")
    sizes = listed.select(at.alias("id"), "file_idx", "usize").groupBy("id").agg(F.count("*").alias("files"), F.sum("usize").alias("usize"))
    cells = cells.groupBy(at.alias("id"), F.col("run_seq"), "codec").agg(F.first("ts").cast("string").alias("ts"), F.sum(F.when(F.col("file_idx") < 0, F.col("csize"))).alias("total"), F.sum(F.when(F.col("file_idx") >= 0, F.col("csize") + F.col("dmem") * (F.col("file_idx") + 1))).alias("digest"))
    seen = found.select(F.regexp_extract("path", r"id=(\d+)", 1).cast("long").alias("id"), (F.col("length") > 0).alias("found"))
    return cells.join(sizes, "id").join(seen, "id").select("id", F.col("run_seq").cast("int").alias("run_seq"), "codec", "ts", "files", "usize", "total", "digest", "found")


register("s12_s01_histories", _history, f"""WITH {v.CELLS}, few AS (SELECT count(*) AS files, CAST(sum(usize) AS BIGINT) AS usize FROM files WHERE file_idx <= {_FILES_A_HISTORY}),
    r AS (SELECT unnest(range(1, {_HISTORIES + 1})) AS id, few.* FROM few), m AS (SELECT r.*, unnest(range(1, 4))::INT AS m FROM r), x AS (SELECT *, unnest(range(0, {_FILES_A_HISTORY}))::INT AS f FROM m)
    SELECT id, CAST(m - 1 AS INT) AS run_seq, 'c' || id AS codec, '2024-0' || m || '-05 10:11:12' AS ts, any_value(files) AS files, any_value(usize) AS usize, any_value(m * 10 + id)::DOUBLE AS total,
        sum(m * 10 + 5 * (f + 1) + id + (m * 10 + 5 * (f + 1) + 4 + id) * (f + 1))::DOUBLE AS digest, true AS found FROM x GROUP BY id, m""")  # fmt: skip


def _templates(s, d):
    """S-14, S-15, K-02: command templates and a folder list written as text, read and checked."""
    path = files.scratch(s)
    regions = v.table(s, d, "region").select(F.col("r_regionkey").cast("int").alias("id"), F.lower(F.trim(F.col("r_name").cast("string"))).alias("name"))
    lines = regions.select("id", F.concat(F.lit("enc_"), "name", F.lit(" *.ppm *."), "name", F.lit("\ndec_"), "name", F.lit(" *."), "name", F.lit(" *.ppm")).alias("value"))
    lines.repartition(1).write.partitionBy("id").text(path)
    files.write_lines(regions.select(F.lit(0).alias("block"), F.concat(F.lit("/data/"), "name").alias("line")), f"{path}-list")
    folders = files.folder_list(s, f"{path}-list")
    got = files.templates(s, path).select(F.regexp_extract("path", r"id=(\d+)", 1).cast("int").alias("id"), "encode", "decode")
    return got.select("id", "encode", "decode", scalars.template_ok(F.col("encode"), F.col("decode")).alias("ok"), F.lit(len(folders)).cast("long").alias("folders"))


register("s14_s15_templates", _templates, """WITH n AS (SELECT CAST(r_regionkey AS INT) AS id, lower(trim(r_name)) AS name FROM region)
    SELECT id, 'enc_' || name || ' *.ppm *.' || name AS encode, 'dec_' || name || ' *.' || name || ' *.ppm' AS decode, true AS ok, (SELECT count(*) FROM n) AS folders FROM n""")  # fmt: skip
