"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, K = 256, 5
#: Bytes of queries that are broadcast at a time; more queries take more passes over the candidates.
QUERY_BYTES = 8 << 20
#: Rows of a candidate block, and rotated dimensions of the partial sums.
BLOCK, HEAD = 2048, 16
#: Longest vectors that are searched first, for scores that the k-th best reaches in any case.
LONGEST = 2048


def integers(rows: list) -> np.ndarray:
    """Rows of integer-valued components as a matrix of doubles; shorter rows are filled up with zeros."""
    if len({len(r) for r in rows}) <= 1:
        return np.array(rows, dtype=np.float64).reshape(len(rows), len(rows[0]) if rows else 0)
    out = np.zeros((len(rows), max(map(len, rows))))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def widened(x: np.ndarray, d: int) -> np.ndarray:
    return x if x.shape[1] >= d else np.hstack([x, np.zeros((len(x), d - x.shape[1]))])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as int64: by doubles where no sum can pass 2 ** 53, by whole numbers of any size where one could
    pass 2 ** 63; what then doesn't fit 64 bits is the nearest number that does."""
    d = max(q.shape[1], x.shape[1])
    q, x = widened(q, d), widened(x, d)
    largest = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * d
    if largest < 2**53:
        return (q @ x.T).astype(np.int64)
    if largest < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = [np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) for m in (q, x)]
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return np.array([[min(max(int(v), low), high) for v in row] for row in whole[0] @ whole[1].T], dtype=np.int64).reshape(len(q), len(x))


class Queries:
    def __init__(self, ids: list[int], rows: list, rotation: np.ndarray):
        self.ids, self.q, self.rotation = np.array(ids, dtype=np.int64), integers(rows), rotation

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading rotated components and the length of what they leave."""
        x = widened(x, self.rotation.shape[0])[:, : self.rotation.shape[0]]
        head = x @ self.rotation[:, :HEAD]
        return head, np.sqrt(np.maximum((x * x).sum(1) - (head * head).sum(1), 0))


def _search(sent, k: int, floors=None):
    """The k best of each query in a task's vectors, which come by descending length. `floors` are scores that the k-th best
    of each query reaches in any case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = sent.value
        n = len(queries.ids)
        best = np.full((n, k), np.iinfo(np.int64).min)  # scores, highest first; ties by smaller id
        who = np.full((n, k), np.iinfo(np.int64).max)
        filled = np.zeros((n, k), dtype=bool)
        known = np.full(n, -np.inf) if floors is None else floors.value
        q_head, q_rest = queries.halves(queries.q)
        q_norm = np.sqrt((queries.q**2).sum(1))
        over = False
        for x in batches:
            if over or not x.num_rows:
                continue  # what follows is shorter still
            ids, rows = x["vec_id"].to_numpy(zero_copy_only=False).astype(np.int64), integers(x["v"].to_pylist())
            norms = np.sqrt((rows * rows).sum(1))
            for at in range(0, len(rows), BLOCK):
                part = np.arange(at, min(at + BLOCK, len(rows)))
                least = np.maximum(np.where(filled[:, -1], best[:, -1], -np.inf).astype(np.float64), known)
                live = np.flatnonzero(q_norm * norms[part].max() * (1 + 1e-9) + 1e-3 >= least)
                if not len(live):
                    over = True
                    break
                head, rest = queries.halves(rows[part])
                bound = (q_head[live] @ head.T + np.outer(q_rest[live], rest)) + 1e-6 * np.outer(q_norm[live], norms[part]) + 1e-3
                able = bound >= least[live, None]
                able &= queries.ids[live, None] != ids[part][None, :]
                some, col = np.flatnonzero(able.any(1)), np.flatnonzero(able.any(0))
                if not len(some):
                    continue
                score = products(queries.q[live[some]], rows[part[col]])
                for i, row in enumerate(live[some].tolist()):
                    mine = np.flatnonzero(able[some[i], col] & (score[i] >= (best[row, -1] if filled[row, -1] else score[i])))
                    if not len(mine):
                        continue
                    s, v = np.concatenate([best[row][filled[row]], score[i, mine]]), np.concatenate([who[row][filled[row]], ids[part[col[mine]]]])
                    top = np.lexsort((v, -s))[:k]
                    best[row, : len(top)], who[row, : len(top)], filled[row, : len(top)] = s[top], v[top], True
        row, rank = np.nonzero(filled)
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[row]), pa.array(who[row, rank]), pa.array(best[row, rank])], ["query_id", "vec_id", "score"])

    return run


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((0, 0))
    for x in batches:
        if x.num_rows:
            rows = integers(x["v"].to_pylist())
            d = max(len(total), rows.shape[1])
            grown = np.zeros((d, d))
            grown[: len(total), : len(total)] = total
            rows = widened(rows, d)
            total = grown + rows.T @ rows
    i, j = np.nonzero(np.triu(total))
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], ["i", "j", "v"])


def rotation(vectors: DataFrame) -> np.ndarray:
    """Right singular vectors of all vectors, by the eigenvectors of their summed Gram matrix."""
    got = vectors.select("v").mapInArrow(_gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = 1 + max((r["j"] for r in got), default=0)
    gram = np.zeros((d, d))
    for r in got:
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["v"]
    return np.linalg.eigh(gram)[1][:, ::-1]


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x); without null ids, null vectors and null or non-finite components. A
    component beyond 64 bits is the nearest number within them."""
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return rows.select("vec_id", F.transform(as_double, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query with all other vectors.

    Both inputs are (vec_id, v) from `usable`. Vectors are dealt to tasks by descending length and come to each in that
    order. Queries are taken in blocks of `query_bytes` through the driver; a block meets the LONGEST vectors first, whose
    scores bound what it needs from the others, and a task ends for it when length alone rules the rest out. A task keeps k
    rows per query. Ties go to the smaller vec_id; rows that share the query's id
    are the query's own and left out; candidates that repeat count each; of repeated queries one is answered; vectors
    of unequal length are filled up with zeros; with no other vector a query has no rows.
    """
    spark, turn = vectors.sparkSession, rotation(vectors)
    per = max(1, query_bytes // (8 * max(64, len(turn))))
    asked = queries.groupBy("vec_id").agg(F.max("v").alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("length")
    sized = vectors.select("vec_id", "v", length)
    first = sized.orderBy(F.col("length").desc()).limit(LONGEST).select("vec_id", "v")
    ordered = sized.repartitionByRange(F.col("length").desc(), F.xxhash64("vec_id")).sortWithinPartitions(F.col("length").desc()).select("vec_id", "v")
    out, held = None, ([], [])

    def block():
        asking = Queries(*held, turn)
        sent = spark.sparkContext.broadcast(asking)
        floors = np.full(len(asking.ids), -np.inf)
        scores: dict[int, list[int]] = {}
        for r in first.mapInArrow(_search(sent, k), "query_id long, vec_id long, score long").select("query_id", "score").toLocalIterator():
            scores.setdefault(r["query_id"], []).append(r["score"])
        for i, q in enumerate(asking.ids.tolist()):
            if len(scores.get(q, ())) >= k:
                floors[i] = sorted(scores[q])[-k]
        got = ordered.mapInArrow(_search(sent, k, spark.sparkContext.broadcast(floors)), "query_id long, vec_id long, score long")
        return got if out is None else out.unionByName(got)

    for r in asked.toLocalIterator():
        held[0].append(r["vec_id"])
        held[1].append(r["v"])
        if len(held[0]) >= per:
            out, held = block(), ([], [])
    if held[0] or out is None:
        out = block()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
