"""Deterministic views of the driver's tables as runs, bytes, planes, pixels and tracks, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(file_idx, filename, usize, ext)"""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("file_idx"), F.col("p_name").alias("filename"), F.round(F.col("p_retailprice") * 6400).cast("long").alias("usize"), F.col("p_type").alias("kind"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(codec, run_seq, file_idx, csize, etime, dtime_cs, emem): one file in one run; dtime_cs in hundredths."""
    li = table(spark, sf_dir, "lineitem")
    month = F.year("l_shipdate") * 100 + F.month("l_shipdate")
    code = F.concat(F.lit("c"), F.col("l_suppkey").cast("string"))
    return li.select(
        F.when(month % 2 == 0, F.upper(code)).otherwise(code).alias("codec"), month.cast("int").alias("run_seq"), F.col("l_partkey").alias("file_idx"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("csize"),
        F.round("l_quantity").cast("long").alias("etime"), F.round(F.col("l_tax") * 100).cast("long").alias("dtime_cs"), F.round(F.col("l_discount") * 100).cast("long").alias("emem"),
    )


CELLS = """
    files AS (SELECT p_partkey AS file_idx, p_name AS filename, CAST(round(p_retailprice * 6400) AS BIGINT) AS usize, p_type AS kind FROM part),
    cells AS (SELECT CASE WHEN run_seq % 2 = 0 THEN upper(code) ELSE code END AS codec, run_seq, file_idx, csize, etime, dtime_cs, emem FROM (
        SELECT 'c' || l_suppkey AS code, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS run_seq, l_partkey AS file_idx, CAST(round(l_extendedprice * 100) AS BIGINT) AS csize,
            CAST(round(l_quantity) AS BIGINT) AS etime, CAST(round(l_tax * 100) AS BIGINT) AS dtime_cs, CAST(round(l_discount * 100) AS BIGINT) AS emem FROM lineitem)),
    runs AS (SELECT codec, run_seq, CAST(sum(csize) AS BIGINT) AS csize, CAST(sum(etime) AS DOUBLE) AS etime, CAST(sum(dtime_cs) AS DOUBLE) / 100.0 AS dtime, CAST(max(emem) AS BIGINT) AS emem, count(*) AS n_files FROM cells GROUP BY codec, run_seq)"""


def plane_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """planes(image_id, label, px array<int>): 8 x 8 signed samples in raster order, unexploded."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), "label", F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(-128.0), F.least(F.lit(127.0), v.cast("double") * 256))).cast("int")).alias("px"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """planes(image_id, y, x, v)"""
    return plane_bytes(spark, sf_dir).select("image_id", F.posexplode("px").alias("pos", "v")).select("image_id", F.expr("pos div 8").cast("int").alias("y"), (F.col("pos") % 8).alias("x"), F.col("v").cast("long").alias("v"))


def rgb_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """images(image_id, r, g, b): three planes in a row are the channels of one image; incomplete images are left out."""
    p = plane_bytes(spark, sf_dir).select(F.expr("image_id div 3").alias("image_id"), (F.col("image_id") % 3).alias("ch"), "px")
    return p.groupBy("image_id").agg(*[F.max(F.when(F.col("ch") == i, F.col("px"))).alias(c) for i, c in enumerate("rgb")]).dropna()


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rgb(image_id, y, x, r, g, b): the pixels of rgb_bytes."""
    px = rgb_bytes(spark, sf_dir).select("image_id", F.posexplode(F.arrays_zip("r", "g", "b")).alias("pos", "p"))
    return px.select("image_id", F.expr("pos div 8").cast("int").alias("y"), (F.col("pos") % 8).alias("x"), *[F.col(f"p.{c}").cast("long").alias(c) for c in "rgb"])


PLANES = """
    planes AS (SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(floor(greatest(-128.0, least(127.0, CAST(embedding[i] AS DOUBLE) * 256))) AS BIGINT) AS v
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
RGB = PLANES + """,
    rgb AS (SELECT image_id // 3 AS image_id, y, x, max(CASE WHEN image_id % 3 = 0 THEN v END) AS r, max(CASE WHEN image_id % 3 = 1 THEN v END) AS g, max(CASE WHEN image_id % 3 = 2 THEN v END) AS b
        FROM planes GROUP BY image_id // 3, y, x HAVING count(*) = 3)"""


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pcm(track_id, pos, sample)"""
    from pyspark.sql import Window

    ev = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return ev.select(F.col("user_id").alias("track_id"), pos.cast("long").alias("pos"), (F.round(F.col("value") * 100).cast("long") - 24500).alias("sample"))


PCM = """
    pcm AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CAST(round(value * 100) AS BIGINT) - 24500 AS sample FROM events)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blobs(blob_id, source, data): documents as UTF-8 bytes."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), "source", F.encode("text", "UTF-8").alias("data"))


BYTES = """
    bytes AS (SELECT blob_id, source, CAST(i - 1 AS BIGINT) AS pos, CAST(('0x' || substr(hx, CAST(2 * i - 1 AS INT), 2)) AS BIGINT) AS sym
        FROM (SELECT doc_id AS blob_id, source, hex(encode(text)) AS hx, unnest(range(1, strlen(text) + 1)) AS i FROM documents))"""
