"""Near-duplicate documents by Order MinHash over five-word shingles, verified by banded alignment.

A sketch takes the two smallest of a document's occurrence-labelled shingles under one hash and keeps them in text order,
so it is sensitive to edits and not to the set of shingles alone. Sketches are banded; equal texts are one node from the
start. Documents that share a band are candidates: a bucket's members, with their shingles, meet in blocks of bounded
size, where shared shingles are counted for all pairs of different classes at once and pairs that may be similar are
aligned. A block returns links that span what it found, never all pairs. Buckets of several blocks then compare, block by
block, what is still in different classes. Links merge by star contraction; nothing is collected at the driver.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import attach, bounded, compact, materialize, release, text_batches
from .decontamination import NORMAL

K, SIMILAR = 5, 0.8
#: Bands of sketches: at similarity 0.8 two texts share a band with probability 1 - (1 - 0.64 ** 3) ** 24 = 0.9993.
BANDS, ROWS = 24, 3
#: Members, and bytes of their shingles, that a block of a bucket is planned for.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
CHUNK_BYTES = 1 << 20
_rng = np.random.Generator(np.random.PCG64(5))
_SEED = _rng.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)

_VOCABULARY = rolling.Words()


def shingles(texts: list[bytes], k: int = K) -> list[np.ndarray]:
    """Occurrence-labelled shingle hashes of each text; a text of fewer than k words, but not none, is one shingle."""
    codes = first, _, counts = _VOCABULARY.codes([t.translate(NORMAL).split() for t in texts])
    sh, _, of = rolling.windows(codes, k)
    begin = np.cumsum(counts) - counts
    key = rolling.mixed(sh ^ rolling.mixed(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    lead = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    rank = np.empty(len(key), dtype=np.uint64)
    rank[order] = (np.arange(len(key)) - np.repeat(lead, np.diff(np.append(lead, len(key))))).astype(np.uint64)
    labelled = rolling.mixed(sh + rank * _A)
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    out = [labelled[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        out[i] = rolling.mixed(np.bitwise_xor.reduce(first[begin[i] : begin[i] + counts[i]] * _B ** np.arange(1, counts[i] + 1, dtype=np.uint64), keepdims=True))
    return out


def sketches(x: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS order sketches of one text's labelled shingles (at least one)."""
    at = np.arange(len(_SEED))
    base, first, second = (x >> np.uint64(20)).astype(np.uint32), [], []
    for i in range(0, len(_SEED), step := max(1, (1 << 22) // len(x))):
        v = (base ^ _SEED[i : i + step]) * _ODD[i : i + step]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(12)
        a = v.argmin(1)
        v[np.arange(len(v)), a] = 0xFFFFFFFF
        b = v.argmin(1)
        first.append(np.minimum(a, b))
        second.append(np.maximum(a, b))
    return rolling.mixed(x[np.concatenate(first)] * _A + x[np.concatenate(second)] * _B + at.astype(np.uint64))


def _texts(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for x in batches:
        text, keys = x["text"].cast(pa.binary()), [x[c].to_pylist() for c in names]
        for i in range(x.num_rows):
            yield tuple(k[i] for k in keys), text[i].as_py()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight = np.multiply.accumulate(np.full(ROWS, _A))
    for held in rolling.chunks(_texts(batches, ("doc_id", "h1", "h2")), CHUNK_BYTES):
        sizes, bands = [], []
        for x in shingles([r[1] for r in held]):
            sizes.append(len(x))
            bands.append(rolling.mixed((sketches(x).reshape(BANDS, ROWS) * weight).sum(1)).view(np.int64).tolist() if len(x) else [])
        columns = [pa.array([r[0][i] for r in held], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "n", "bands"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in rolling.chunks(_texts(batches, ("id",)), CHUNK_BYTES):
        yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in held], pa.int64()), pa.array([x.tobytes() for x in shingles([r[1] for r in held])], pa.binary())], ["id", "shingles"])


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles matched in order: longest common subsequence of two sequences without repeats, inside the band that a
    similarity of SIMILAR allows (an offset is at most the number of unmatched shingles)."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= (1 / SIMILAR - SIMILAR + 0.05) * min(len(a), len(b)) + 1
    order = np.argsort(i[near], kind="stable")
    to = j[near][order]
    if len(to) < 2 or (np.diff(to) > 0).all():
        return len(to)
    tails: list[int] = []
    for v in to.tolist():
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Ordered Jaccard: aligned shingles over all."""
    if not len(a) or not len(b) or min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return 0.0
    both = aligned(a, b)
    return both / (len(a) + len(b) - both)


def spanning(ids: np.ndarray, root: np.ndarray, block: np.ndarray, held: list[np.ndarray], similar: float) -> Iterator[tuple[int, int]]:
    """Links that span the classes of these members: every pair of different classes (and, if there are two blocks, of
    different blocks) is tried until its classes are one. Shared shingles of one member with all others are counted at
    once; as shingles are occurrence-labelled, sets without repeats, the set's Jaccard bounds the ordered one."""
    cls = np.unique(root, return_inverse=True)[1]
    if cls.max(initial=0) == 0:
        return
    n = np.array([len(x) for x in held])
    at = np.cumsum(n) - n
    dense = np.unique(np.concatenate(held), return_inverse=True)[1].astype(np.int32)
    present = np.zeros(int(dense.max()) + 1, dtype=np.int32)
    parted, place = block[0] != block[-1] or (block != block[0]).any(), np.arange(len(ids))
    for x in range(len(ids)):
        other = (place > x) & (cls != cls[x]) & (np.minimum(n, n[x]) >= similar * np.maximum(n, n[x]))
        if parted:
            other &= block != block[x]
        other = np.flatnonzero(other)
        if not len(other):
            continue
        mine = dense[at[x] : at[x] + n[x]]
        present[mine] = 1
        if 2 * len(other) < len(ids):
            theirs, starts = np.concatenate([dense[at[k] : at[k] + n[k]] for k in other]), np.cumsum(n[other]) - n[other]
            both = np.add.reduceat(present[theirs], starts)
        else:
            both = np.add.reduceat(present[dense], at)[other]
        present[mine] = 0
        near = both >= similar * (n[other] + n[x] - both)
        for k in other[near][np.argsort(-both[near], kind="stable")].tolist():
            if cls[k] != cls[x] and similarity(held[x], held[k]) >= similar:
                cls[cls == cls[k]] = cls[x]
                yield int(ids[x]), int(ids[k])


def _linked(similar: float):
    """Links found in each group (bucket, lower, upper) of rows that come sorted by group."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        if len(rows) > 1:
            ids, root, block = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1, 2))
            yield from spanning(ids, root, block, [np.frombuffer(r[3], dtype=np.uint64) for r in rows], similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, group = [], None
        for x in batches:
            found: list[tuple[int, int]] = []
            keys = zip(*[x[c].to_pylist() for c in ("bucket", "lower", "upper")], strict=True)
            own = [x[c].to_pylist() for c in ("id", "root", "block")]
            for i, key in enumerate(keys):
                if key != group:
                    found += links(rows)
                    rows, group = [], key
                rows.append((own[0][i], own[1][i], own[2][i], x["shingles"][i].as_py()))
            yield _pairs(found)
        yield _pairs(list(links(rows)))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])


def _met(dealt: DataFrame, known: DataFrame, similar: float) -> tuple[DataFrame, int]:
    """The links of groups (bucket, lower, upper) of members (id, root, block) with their shingles."""
    rows = dealt.join(known, "id").repartition("bucket", "lower", "upper").sortWithinPartitions("bucket", "lower", "upper", "id")
    got = rows.select("bucket", "lower", "upper", "id", "root", "block", "shingles").mapInArrow(_linked(similar), "a long, b long")
    return compact(got.distinct())


def links(members: DataFrame, known: DataFrame, similar: float) -> tuple[DataFrame, int]:
    """(a, b), a < b, and their number: links that connect the members (bucket, n_blocks, id) of each bucket as all their
    similar pairs would. `known` has the shingles of every id."""
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.col("n_blocks")).cast("int")
    members = members.withColumn("block", block)
    found, n = _met(members.select("bucket", F.col("block").alias("lower"), F.col("block").alias("upper"), "block", "id", F.col("id").alias("root")), known, similar)
    wide = members.where("n_blocks > 1")
    if wide.limit(1).count():
        if n:
            roots, n_roots = compact(components(found))
            wide = wide.join(bounded(roots, n_roots), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
        else:
            wide = wide.withColumn("root", F.col("id"))
        # pairs of blocks that hold more than one class
        ends = wide.groupBy("bucket", "n_blocks", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        ends = materialize(ends.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("bucket", "block", "low", "high", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper")).where("lower < upper"))
        still = ends.groupBy("bucket", "lower", "upper").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("bucket", "lower", "upper")
        dealt = ends.select("bucket", "block", "lower", "upper").join(still, ["bucket", "lower", "upper"], "left_semi").join(wide.select("bucket", "block", "id", "root"), ["bucket", "block"])
        more, n_more = _met(dealt.select("bucket", "lower", "upper", "block", "id", "root"), known, similar)
        found, n = found.unionByName(more), n + n_more
    return found, n


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): root is the smallest node of its component. Alternates large and
    small star contraction until all edges point at roots."""
    edges, n = compact(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges, n = compact(both.join(bounded(least, 2 * n), F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        joined = edges.join(bounded(least, n), F.col("u") == F.col("w"))
        moved = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges, n = compact(moved.where("u <> v").distinct())
        # done when every u has one v and no v is a u
        sources = edges.agg(F.count_distinct("u")).first()[0]
        if n == sources and not edges.join(bounded(edges.select(F.col("u").alias("x")), n), F.col("v") == F.col("x"), "left_semi").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select("v", "v").distinct().toDF("node", "root"))


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, text_id, class_id) for every row: `text_id` is the smallest doc_id with this very text, `class_id` the
    smallest doc_id of its class, i.e. of the texts that links of similarity `similar` or more connect.

    Words are as in decontamination: A-Z lower-cased, digits, letters and non-ASCII bytes. Null texts are classes of
    their own; texts without words are linked with equal texts only; texts of one to four words are one shingle; rows
    with a null doc_id take no part and have null ids; rows that share a doc_id are classed each by its own text, and
    repeated rows alike; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    return _classes(docs, similar).select("doc_id", "text_id", "class_id")


def _classes(docs: DataFrame, similar: float) -> DataFrame:
    """`classes` with a hash of each row's text, `h1`."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    whole = rows.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("twin"), "text").alias("h2"), "text")
    sketched = whole.mapInArrow(_sketch, "doc_id long, h1 long, h2 long, n long, bands array<long>")
    texts = materialize(sketched.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.min("doc_id").alias("text_id"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    same = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    # a node is a text, by 64 bits of its hash; of different texts that share them (about none) the first stands for both
    nodes = texts.where("n > 0").select(F.col("g1").alias("id"), "text_id", "n", "bands")
    keys = nodes.select("id", "n", F.posexplode("bands").alias("band", "key")).select("id", "n", F.xxhash64("band", "key").alias("bucket"))
    # buckets of several members; of those with the very same members, one
    n_blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("size") * 8 / BLOCK_BYTES)).cast("int")
    kept = keys.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("size"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(2))).alias("y")).where("members > 1")
    kept, n_kept = compact(kept.groupBy("members", "size", "x", "y").agg(F.min("bucket").alias("of_bucket")).select("of_bucket", n_blocks.alias("n_blocks")))
    members = materialize(keys.join(bounded(kept, n_kept), F.col("bucket") == F.col("of_bucket")).select("bucket", "n_blocks", "id"))
    roots = None
    if n_kept:
        member = members.select(F.col("id").alias("member")).distinct()
        asked, n_asked = compact(nodes.join(member, F.col("id") == F.col("member"), "left_semi").select("id", "text_id"))
        open_texts = whole.join(bounded(asked, n_asked), (F.col("h1") == F.col("id")) & (F.col("doc_id") == F.col("text_id"))).select("id", "text")
        known = materialize(open_texts.mapInArrow(_shingled, "id long, shingles binary").dropDuplicates(["id"]))
        release(docs.sparkSession)
        linked, n_linked = links(members, known, similar)
        if n_linked:
            roots, n_roots = compact(components(linked))
            named = texts.select("g1", "text_id").join(bounded(roots, n_roots), F.col("g1") == F.col("node")).select("node", "root", "text_id")
            first = named.groupBy(F.col("root").alias("of_root")).agg(F.min("text_id").alias("class_id"))
            roots = materialize(roots.join(first, F.col("root") == F.col("of_root")).select("node", "class_id"))
    named = attach(whole.select("doc_id", "h1", "h2"), texts.select("g1", "g2", "text_id"), same).select("doc_id", "h1", "text_id")
    if roots is not None:
        named = attach(named, roots, F.col("h1") == F.col("node"), "left").select("doc_id", "h1", "text_id", F.coalesce("class_id", "text_id").alias("class_id"))
    else:
        named = named.withColumn("class_id", F.col("text_id"))
    rest = rows.where("doc_id is null or text is null").select("doc_id", F.lit(None).cast("long").alias("h1"), F.col("doc_id").alias("text_id"), F.col("doc_id").alias("class_id"))
    return named.unionByName(rest)


def distinct_documents(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of `docs` whose doc_id is their class's (and those with a null text or doc_id): one document of each class.
    Columns pass, whatever their names."""
    gone = materialize(_classes(docs, similar).where("doc_id <> class_id").select(F.col("doc_id").alias("gone"), F.col("h1").alias("of_text")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), F.xxhash64("text").alias("h1"))
    return attach(rows, gone, (F.col("key") == F.col("gone")) & (F.col("h1") == F.col("of_text")), "left_anti").select("row.*")
