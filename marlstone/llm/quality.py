"""Quality classifier: random Fourier features over document statistics, ridge regression from partition-summed normal
equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_batches

N_FOURIER, BANDWIDTH, RIDGE, SEED = 160, 4.0, 1e-3, 20240611
BINS = 512  # of raw scores, for the calibration
FOLDS = 4
_FEATURES = 18
_CLASSES = np.zeros((256, 8), dtype=np.float64)
for _name, _members in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:?", "!", "|", "#$%&*+<=>@[]^_`{}~\\/", "\n")):
    _CLASSES[[ord(c) for c in _members], _name] = 1


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text, in fixed order; an empty text has zeros."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * _FEATURES
    freq = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower, digit, stop, bang, bar, symbol, newline = (freq @ _CLASSES).tolist()
    p = freq[freq > 0] / size
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(n), size / n, upper / max(1.0, upper + lower), digit / size, stop / n, min(bang / n, 2.0), min(bar / n, 2.0), min(symbol / n, 4.0),
        int(freq[128:].sum()) / size, np.log1p(newline) / np.log1p(n), len(counts) / n ** 0.8, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(len(w) <= 3 for w in counts) / len(counts), float(-(p * np.log2(p)).sum()),
        sum(1 for w in counts if w[-1:] in b"#$%&*!|") / len(counts),
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        text = x["text"].cast(pa.binary())
        rows = [statistics(text[i].as_py() or b"") for i in range(x.num_rows)]
        yield pa.RecordBatch.from_arrays([x["doc_id"], pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "f"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, f) for every row; null texts count as empty."""
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_statistics, "doc_id long, f array<double>")


class Model:
    """Standardisation, Fourier projection, ridge weights and calibration knots."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n_fourier: int, bandwidth: float, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), n_fourier)) / bandwidth
        self.b = rng.uniform(0, 2 * np.pi, n_fourier)
        self.weights = np.zeros(n_fourier + len(mean) + 1)
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def project(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b), z, np.ones((len(f), 1))])

    def raw(self, f: np.ndarray) -> np.ndarray:
        return self.project(f) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(f), self.x, self.y), 0, 1)


def _summed(rows: DataFrame, part) -> np.ndarray:
    """Element sums over all partitions of the vectors that `part` makes of each partition's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in batches:
            if x.num_rows:
                v = part(_matrix(x["f"]), x["y"].to_numpy(zero_copy_only=False))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "v"])

    got = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r["i"]] = r["v"]
    return out


def fit(train: DataFrame, n_fourier: int = N_FOURIER, bandwidth: float = BANDWIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Fit on all rows (f, y, fold): the ridge on those outside the fold, the calibration on those inside (on all rows where
    one of the two is empty). What comes to the driver is of fixed size: sums of features, the normal equations and `BINS`
    calibration bins. Without rows every score is 0.5; with one class every score is that class."""
    folds = {r["fold"] for r in train.select("fold").distinct().collect()}
    inside, train = (train.where("fold"), train.where("not fold")) if len(folds) == 2 else (train, train)
    sums = _summed(train, lambda f, y: np.concatenate([[len(f)], f.sum(0), (f * f).sum(0)]))
    if not len(sums):
        return Model(np.zeros(_FEATURES), np.ones(_FEATURES), n_fourier, bandwidth, seed)
    n, d = sums[0], (len(sums) - 1) // 2
    mean = sums[1 : d + 1] / n
    spread = np.sqrt(np.maximum(sums[d + 1 :] / n - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), n_fourier, bandwidth, seed)
    k = len(model.weights)
    upper = np.triu_indices(k)

    def normal(f: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.project(f)
        return np.concatenate([(z.T @ z)[upper], z.T @ y])

    sums = _summed(train, normal)
    a = np.zeros((k, k))
    a[upper] = sums[:-k]
    a = a + np.triu(a, 1).T
    model.weights = np.linalg.solve(a + ridge * n * np.eye(k) + 1e-9 * np.eye(k), sums[-k:])

    def binned(f: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = model.raw(f)
        at = np.clip(((s + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, s, BINS), np.bincount(at, y, BINS)])

    count, s, y = _summed(inside, binned).reshape(3, BINS)
    model.x, model.y = isotonic(s[count > 0] / count[count > 0], y[count > 0] / count[count > 0], count[count > 0])
    return model


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean x, value) of the non-decreasing fit to (x, y) with weights w."""
    blocks: list[list[float]] = []  # sum of w * x, w * y, w
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def labelled(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (f, y, fold) to fit on: labelled documents outside the held-out third; a fold of one in FOLDS, by a hash of the
    id, calibrates what the others fit. Null labels and ids are left out; several labels of one document count by their
    mean."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("of_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    marks, feats = marks.where(~held_out(F.col("of_id"))), feats.where(~held_out(F.col("doc_id")))
    fold = F.crc32(F.concat(F.lit("fold "), F.col("of_id").cast("string"))) % FOLDS == 0
    return feats.join(marks, feats["doc_id"] == F.col("of_id")).select("f", "y", fold.alias("fold"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`. Null texts count as empty, and an empty text's
    statistics are zeros; ties of raw scores share a score; repeated rows are scored alike; other columns are ignored; an
    empty table gives no rows, and without labels every score is 0.5."""
    text_batches(docs.sparkSession)
    feats = materialize(features(docs))
    model = feats.sparkSession.sparkContext.broadcast(fit(materialize(labelled(feats, labels))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yield pa.RecordBatch.from_arrays([x["doc_id"], pa.array(model.value.score(_matrix(x["f"])), pa.float64())], ["doc_id", "score"])

    got = feats.mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score 0.5 or more, unchanged."""
    text_batches(docs.sparkSession)
    train = materialize(labelled(features(docs), labels))
    model, names = docs.sparkSession.sparkContext.broadcast(fit(train)), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            text = x["text"].cast(pa.binary())
            rows = [statistics(text[i].as_py() or b"") for i in range(x.num_rows)]
            if rows:
                kept = x.filter(pa.array(model.value.score(np.array(rows, dtype=np.float64)) >= 0.5))
                yield kept.select(names)

    return docs.mapInArrow(run, docs.schema)
