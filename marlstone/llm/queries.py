"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language, license_scan, line_dedup, mixing, near_dedup, quality, substring_dedup, topk, url_filter
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.n_hit(F.col("hits"))
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages").select("page_id", "url", "html"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_near_dedup": op3_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_topk": op9_topk,
    "op10_language": op10_language,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
        flagged AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_doc FROM win) WHERE first_doc < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM flagged),
        cut AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
        word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w WHERE doc_id IN (SELECT doc_id FROM cut)),
        kept AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.j) AS text FROM word k ANTI JOIN gone g ON k.doc_id = g.doc_id AND k.j = g.j GROUP BY k.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(c.js), 0) AS BIGINT) AS n_removed,
            sha256(CASE WHEN c.js IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(k.text, '') END) AS kept_sha256
        FROM w LEFT JOIN cut c USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
    "op5_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        bs AS (SELECT item, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0 AND item IS NOT NULL),
        bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS gram FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bs)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS gram FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
        m AS (SELECT dw.doc_id, dw.n, dw.i, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
        hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op2_url_filter": r"""
        WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        judged AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, CASE
            WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
            WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
            WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
            WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
            WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM parts)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/de/8', 'com/en/', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM judged""",
    "op4_mixing": r"""
        WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        turned AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM per),
        weighted AS (SELECT *, CAST([5, 2, 1][CAST(turn % 3 AS INT) + 1] AS BIGINT) AS w, source_size * 3 AS cap FROM turned),
        summed AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w,
            CAST(coalesce(sum(cap) OVER b, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS w_before
            FROM weighted WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        levels AS (SELECT *, max(CAST(total - cap_before AS DOUBLE) / CAST(all_w - w_before AS DOUBLE)) OVER () AS level FROM summed),
        targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), level * w) AS target FROM levels),
        rated AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
            CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
            FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
        tried AS (SELECT source, k, abs(sum(size * (floor(rate) + CASE WHEN u + k / 64.0::DOUBLE - floor(u + k / 64.0::DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END)) - any_value(target)) AS away FROM rated, range(0, 64) r(k) GROUP BY source, k),
        turns AS (SELECT source, arg_min(k, (away, k)) AS k FROM tried GROUP BY source)
        SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u + k / 64.0::DOUBLE - floor(u + k / 64.0::DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM rated r JOIN turns t ON r.source IS NOT DISTINCT FROM t.source""",
    "op7_line_dedup": r"""
        WITH cut AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
        trimmed AS (SELECT doc_id, line_no, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM cut),
        masked AS (SELECT doc_id, line_no, CASE WHEN len(string_split(line, ' ')) - len(regexp_extract_all(line, '[^ ]*[0-9][^ ]*')) >= len(string_split(line, ' ')) * 0.6
            THEN regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') ELSE line END AS line FROM trimmed),
        lines AS (SELECT doc_id, line_no, line, string_split(line, ' ') AS ts FROM masked WHERE line <> '' AND len(string_split(line, ' ')) >= 3),
        leafed AS (SELECT doc_id, line_no, line, ts, len(ts) || '/' || array_to_string(ts[1:3], ' ') AS leaf FROM lines),
        leaves AS (SELECT leaf, count(DISTINCT line) AS kinds FROM leafed GROUP BY leaf HAVING count(DISTINCT (line, doc_id)) >= 10),
        busy AS (SELECT f.*, v.kinds FROM leafed f JOIN leaves v USING (leaf)),
        kinds AS (SELECT DISTINCT leaf, line, ts FROM busy WHERE kinds > 1),
        counted AS (SELECT leaf, place, token, count(*) AS n FROM (SELECT leaf, unnest(range(1, len(ts) + 1)) AS place, unnest(ts) AS token FROM kinds) GROUP BY ALL),
        fixed AS (SELECT leaf, place, CASE WHEN max(n) >= sum(n) * 0.5 THEN arg_max(token, (n, token)) ELSE '<*>' END AS token FROM counted GROUP BY leaf, place),
        shapes AS (SELECT leaf, list(token ORDER BY place) AS shape FROM fixed GROUP BY leaf),
        cover AS (SELECT k.leaf, k.line, array_to_string(shape, ' ') AS shape FROM kinds k JOIN shapes s USING (leaf)
            WHERE len([x FOR x IN range(1, len(ts) + 1) IF ts[x] = shape[x] AND shape[x] <> '<*>']) >= len(ts) * 0.6 AND (list_contains(shape, '<*>') OR contains(array_to_string(shape, ' '), '<*>') OR k.line = array_to_string(shape, ' '))),
        marked AS (SELECT b.doc_id, b.line_no, b.leaf || CASE WHEN c.shape IS NULL THEN '=' || b.line ELSE '~' || c.shape END AS template FROM busy b LEFT JOIN cover c USING (leaf, line)),
        common AS (SELECT template, min(doc_id) AS first FROM marked GROUP BY template HAVING count(DISTINCT doc_id) >= 10),
        gone AS (SELECT m.doc_id, m.line_no FROM marked m JOIN common c USING (template) WHERE m.doc_id > c.first),
        kept AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM cut ANTI JOIN gone USING (doc_id, line_no) GROUP BY doc_id),
        n_gone AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN n_gone USING (doc_id)""",
    "op9_topk": r"""
        WITH ok AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN [[q.v[i], c.v[i]] FOR i IN range(1, len(q.v) + 1)]]) AS BIGINT) AS score
            FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
