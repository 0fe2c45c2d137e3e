"""Substring dedup: windows of consecutive words that already occur in an earlier document are cut out.

Each task hashes the windows of some megabytes of text, keeps one entry per window (that of the smallest document, once
for each of its rows) and sends it to the bucket of its hash; a bucket answers which entries also start in a smaller
document. Answers go back by chunk, then by document, as bit fields over that document's windows in the bucket, spread to
equal windows of the row and merge into removal intervals. A window that a third of all documents share thus sends one
entry per task chunk, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import buckets, materialize, release, text_batches

WIDTH = 50
#: Bytes of text that a task hashes at a time, windows that a bucket is planned for, and windows that a task remembers.
CHUNK_BYTES, BUCKET_WINDOWS, HOT_WINDOWS = 3 << 20, 1_200_000, 1 << 18
_NO_ID = np.iinfo(np.int64).max


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _rank(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts `key` stably, and each element's rank among equal keys before it."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return order, rank


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for x in batches:
        text = x["text"].cast(pa.binary())
        keys = [x[n].to_pylist() for n in names]
        for i in range(x.num_rows):
            yield tuple(k[i] for k in keys), text[i].as_py()


#: Kinds of rows: entries of a bucket, answers found inside a chunk, and a chunk's table of documents.
ENTRIES, FOUND, TABLE = 0, 1, 2
SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("place", pa.binary()), ("doc", pa.binary()), ("step", pa.binary()), ("hash", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("sizes", pa.binary()), ("bits", pa.binary())])
GATHERED = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("answers", pa.list_(pa.struct([("bucket", pa.int32()), ("bits", pa.binary())])))])


def _add(out: dict[str, list], *values) -> None:
    for column, value in zip(out.values(), values, strict=True):
        column.append(value)


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest takes."""
    size = next(k for k in (1, 2, 4, 8) if k == 8 or int(x.max(initial=0)) < 1 << 8 * k)
    return bytes([size]) + x.astype(f"u{size}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"u{raw[0]}", offset=1).astype(np.int64)


def _bits(ranks: np.ndarray) -> bytes:
    field = np.zeros(int(ranks.max()) + 1, dtype=bool)
    field[ranks] = True
    return np.packbits(field, bitorder="little").tobytes()


class Hot:
    """Windows that recur within the chunks of one task, with the smallest document seen: what is common everywhere goes
    to its bucket about once a task and not once a chunk. Forgetting some costs repeated entries only."""

    def __init__(self):
        self.key, self.rest, self.id = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def least(self, key: np.ndarray, rest: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The smallest document of each of these different windows, in this chunk and before."""
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ids = np.where((self.key[at] == key) & (self.rest[at] == rest), np.minimum(ids, self.id[at]), ids)
        key, rest, old = np.concatenate([key, self.key]), np.concatenate([rest, self.rest]), np.concatenate([ids, self.id])
        self.key, first = np.unique(key[: len(ids) + HOT_WINDOWS], return_index=True)
        self.rest, self.id = rest[first], old[first]
        return ids


def _send(n: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, hot = rolling.Words(), Hot()
        for rows in rolling.chunks(_rows(batches, ("doc_id", "tag")), CHUNK_BYTES):
            rows.sort(key=lambda r: r[0])
            ids = np.array([r[0] for r in rows], dtype=np.int64).reshape(-1, 2)
            key, other, of = rolling.windows(vocabulary.codes([r[1].split() for r in rows]), width)
            if not len(key):
                continue
            at = bucket_of(key, n)
            _, rank = _rank(of * n + at)
            order, new = rolling.ordered(key, other)  # rows are in order of ids, so the first of equal windows is the smallest document's
            begin, group = np.flatnonzero(new), np.cumsum(new) - 1
            least, twice = ids[of[order[begin]], 0], np.flatnonzero(np.diff(np.append(begin, len(key))) > 1)
            least[twice] = hot.least(key[order[begin[twice]]], other[order[begin[twice]]], least[twice])
            beaten = np.zeros(len(key), dtype=bool)
            beaten[order] = least[group] < ids[of[order], 0]
            # one entry per window and row of its smallest document; _cut spreads the answer to the row's equal windows
            row = np.cumsum(np.concatenate(([False], (ids[1:] != ids[:-1]).any(1))))[of[order]]
            keep = np.zeros(len(key), dtype=bool)
            keep[order[(new | (np.diff(row, prepend=-1) != 0)) & ~beaten[order]]] = True
            del order, new, group, row
            out: dict[str, list] = {k: [] for k in SENT.names}
            # the chunk's name follows from its documents, so equal chunks share one
            chunk = int.from_bytes(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), "little", signed=True)
            _add(out, chunk % n, chunk, TABLE, ids.tobytes(), b"", b"", b"", b"")
            for d in np.unique(of[beaten]):  # answered here; on their way they pass through a bucket
                _add(out, chunk % n, chunk, FOUND, np.uint32(d).tobytes(), b"", b"", b"", _bits(np.flatnonzero(beaten[slice(*np.searchsorted(of, [d, d + 1]))])))
            sent = np.flatnonzero(keep)
            sent = sent[np.argsort(at[sent], kind="stable")]
            cuts = np.searchsorted(at[sent], np.arange(n + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                part = sent[cuts[b] : cuts[b + 1]]
                docs, local = np.unique(of[part], return_inverse=True)
                fresh = np.diff(local, prepend=-1)
                step = np.diff(rank[part], prepend=0)
                step[fresh > 0] = rank[part][fresh > 0]
                known = ids[docs, 0]
                _add(out, int(b), chunk, ENTRIES, known[:1].tobytes() + _packed(np.diff(known).view(np.uint64)), _packed(np.diff(docs, prepend=0)), _packed(fresh), _packed(step), key[part].tobytes() + other[part].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=SENT)

    return run


def _answer(group: pa.Table) -> pa.Table:
    """One bucket: of each chunk's entries, those whose window also starts in a smaller document."""
    chunks, docs, places, locals_, keys, others, ranks, out = [], [], [], [], [], [], [], {k: [] for k in ANSWER.names}
    for x in (r for batch in group.to_batches() for r in batch.to_pylist()):
        if x["kind"] != ENTRIES:
            _add(out, x["chunk"], -1, x["kind"], x["docs"], np.array([len(x["hash"])], dtype=np.uint32).tobytes(), x["hash"])
            continue
        n, fresh, step = len(x["hash"]) // 12, _unpacked(x["doc"]), _unpacked(x["step"])
        total, begin = np.cumsum(step), np.flatnonzero(fresh)
        total -= np.repeat(total[begin] - step[begin], np.diff(np.append(begin, n)))
        chunks.append((x["chunk"], n))
        docs.append(np.cumsum(np.concatenate([np.frombuffer(x["docs"], dtype=np.int64, count=1), _unpacked(x["docs"][8:])])))
        places.append(np.cumsum(_unpacked(x["place"])).astype(np.uint32))
        locals_.append((np.cumsum(fresh) - 1).astype(np.uint32))
        keys.append(np.frombuffer(x["hash"], dtype=np.uint64, count=n))
        others.append(np.frombuffer(x["hash"], dtype=np.uint32, offset=8 * n))
        ranks.append(total.astype(np.uint32))
    if keys:
        bucket = group["bucket"][0].as_py()
        del group
        key, other, who = np.concatenate(keys), np.concatenate(others), np.concatenate([d[i] for d, i in zip(docs, locals_, strict=True)])
        del keys, others
        order, new = rolling.ordered(key, other, who)
        del key, other
        who = who[order]
        beaten = np.zeros(len(who), dtype=bool)
        beaten[order] = who[np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))] < who
        del order, new, who
        at = 0
        for (chunk, n), place, local, rank in zip(chunks, places, locals_, ranks, strict=True):
            hit, at = np.flatnonzero(beaten[at : at + n]), at + n
            if len(hit):
                new = np.flatnonzero(np.diff(local[hit], prepend=-1))
                fields = [_bits(rank[hit[a:b]]) for a, b in zip(new, np.append(new[1:], len(hit)), strict=True)]
                _add(out, chunk, bucket, ENTRIES, place[local[hit[new]]].tobytes(), np.array([len(f) for f in fields], dtype=np.uint32).tobytes(), b"".join(fields))
    return pa.Table.from_pydict(out, schema=ANSWER)


def _gather(group: pa.Table) -> pa.Table:
    """The answers of all buckets to one chunk, by document."""
    found: dict[tuple[int, int], list[dict]] = {}
    rows = [r for batch in group.to_batches() for r in batch.to_pylist()]
    ids = list(map(tuple, np.frombuffer(next(r["docs"] for r in rows if r["kind"] == TABLE), dtype=np.int64).reshape(-1, 2).tolist()))
    for x in rows:
        if x["kind"] != TABLE:
            ends = np.cumsum(np.frombuffer(x["sizes"], dtype=np.uint32))
            for i, place in enumerate(np.frombuffer(x["docs"], dtype=np.uint32).tolist()):
                found.setdefault(ids[place], []).append({"bucket": x["bucket"], "bits": x["bits"][0 if not i else ends[i - 1] : ends[i]]})
    return pa.Table.from_pydict({"doc_id": [k[0] for k in found], "tag": [k[1] for k in found], "answers": list(found.values())}, schema=GATHERED)


def _cut(n: int, width: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = rolling.Words()

        def rows():
            for x in batches:
                text, given = x["text"].cast(pa.binary()), x["answers"]
                for i in range(x.num_rows):
                    yield (x["doc_id"][i].as_py(), given[i].as_py()), text[i].as_py()

        for held in rolling.chunks(rows(), CHUNK_BYTES // 3):
            words = [text.split() for _, text in held]
            marked = [i for i, r in enumerate(held) if r[0][1]]
            key, other, of = rolling.windows(vocabulary.codes([words[i] for i in marked]), width)
            at = bucket_of(key, n)
            order, _ = _rank(of * n + at)
            place = (of * n + at)[order]
            flagged = np.zeros(len(key), dtype=bool)
            starts = np.searchsorted(of, np.arange(len(marked) + 1))
            for d, i in enumerate(marked):
                for a in held[i][0][1]:
                    bits = np.flatnonzero(np.unpackbits(np.frombuffer(a["bits"], dtype=np.uint8), bitorder="little"))
                    if a["bucket"] < 0:
                        flagged[starts[d] + bits] = True
                    else:
                        flagged[order[np.searchsorted(place, d * n + a["bucket"]) + bits]] = True
            del at, order, place
            if len(key):  # an answer names the first of a row's equal windows
                order = np.lexsort((other, key, of))
                begin = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1]) | (of[order][1:] != of[order][:-1]))))
                flagged[order] = np.repeat(np.logical_or.reduceat(flagged[order], begin), np.diff(np.append(begin, len(key))))
            out, d = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}, 0
            for ((doc_id, answers), _), word in zip(held, words, strict=True):
                kept = word
                if answers:
                    mine = np.flatnonzero(flagged[starts[d] : starts[d + 1]])
                    edge = np.zeros(len(word) + 1, dtype=np.int32)
                    np.add.at(edge, mine, 1)
                    np.add.at(edge, mine + width, -1)
                    kept = list(compress(word, (np.cumsum(edge[:-1]) == 0).tolist()))
                    d += 1
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(word))
                out["n_removed"].append(len(word) - len(kept))
                text = b" ".join(kept)
                out["kept"].append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return run


def dedup(docs: DataFrame, width: int = WIDTH, digest: bool = False, n_buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): `kept` is the text without removed words (joined by one space), or with
    `digest` its SHA-256.

    A word goes if a window of `width` words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. A null text has no words; texts under `width` words have no window; a null doc_id is larger
    than any other; rows with one doc_id don't remove each other's words; repeated rows give repeated results; other
    columns are ignored, whatever their names; an empty table gives an empty result. Windows are told apart by 92 bits:
    their polynomials modulo 2 ** 61 - 1 and 2 ** 31 - 1 over keyed hashes of the words. Two given windows collide with a
    probability of 2 ** -92, so 1.5e13 windows (100 TB) hold about 0.02 colliding pairs by expectation.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if n_buckets is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_buckets = max(buckets(spark), size // 6 // BUCKET_WINDOWS)
    n = int(n_buckets)
    keyed = rows.select(F.coalesce("doc_id", F.lit(int(_NO_ID))).alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    sent = keyed.mapInArrow(_send(n, width), "bucket int, chunk long, kind int, docs binary, place binary, doc binary, step binary, hash binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, kind int, docs binary, sizes binary, bits binary")
    answers = answers.groupBy("chunk").applyInArrow(_gather, "doc_id long, tag long, answers array<struct<bucket:int,bits:binary>>")
    answers = answers.groupBy(F.col("doc_id").alias("of_id"), F.col("tag").alias("of_tag")).agg(F.flatten(F.collect_set("answers")).alias("answers"))
    # answers are small beside the windows, whose shuffle files go before the texts are shuffled
    answers = materialize(answers)
    del sent
    release(spark)
    joined = keyed.join(answers, (keyed["doc_id"] == F.col("of_id")) & (keyed["tag"] == F.col("of_tag")), "left").select("doc_id", "text", "answers")
    got = joined.mapInArrow(_cut(n, width, digest), "doc_id long, n_words long, n_removed long, kept string")
    return got.withColumn("doc_id", F.when(F.col("doc_id") != int(_NO_ID), F.col("doc_id")))
