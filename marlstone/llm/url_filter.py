"""URL filters: a Bloom filter cascade over the keys of a corpus.

Keys of a url are its host suffixes joined to the prefixes of its path that have the length of some rule's path. Level 0
encodes the listed keys; each later level encodes those keys of the other kind (corpus keys that aren't listed, then
listed ones, and so on) which the levels before still confuse. A key's answer is the kind of the last level that holds
it, which is exact for every key that occurs in the corpus, so urls are judged without a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: Fixed rules: (host, path, action).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Cascades beyond so many bytes aren't broadcast; a join answers instead.
MAX_BYTES = 64 << 20
_SALT = 0x9E3779B97F4A7C15


def host_of(url: Column) -> Column:
    """From behind the first :// to /, ?, # or the end, A-Z in lower case; empty for null and for urls without ://."""
    at = F.instr(url, "://")
    return F.when(at > 0, ascii_lower(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def keys_of(host: Column, path: Column, lengths: Iterable[int], labels: Iterable[int]) -> Column:
    """Candidate keys: host suffixes of the given numbers of labels x path prefixes of the given lengths (as far as host and
    path go): no other key can be a rule's."""
    there = F.octet_length(host) - F.octet_length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.filter(F.array(*[F.when(there >= n, F.substring_index(host, ".", -n)) for n in sorted(set(labels))]), lambda s: s.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths))]), lambda p: p.isNotNull())
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def fingerprints(key: Column) -> list[Column]:
    """128 bits of a key, as two longs: keys that the corpus confuses with a listed one must differ here."""
    return [F.xxhash64(key), F.xxhash64(F.lit("cascade"), key)]


class Level:
    """One Bloom filter over pairs of 64-bit fingerprints."""

    def __init__(self, n: int, rate: float, number: int):
        bits = max(64, int(np.ceil(-max(n, 1) * np.log(rate) / np.log(2) ** 2)))
        self.bits, self.hashes, self.number = bits, max(1, round(-np.log2(rate))), number
        self.field = np.zeros((bits + 63) // 64, dtype=np.uint64)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            a = (a.view(np.uint64) ^ np.uint64(self.number * _SALT & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            a ^= a >> np.uint64(31)
            b = b.view(np.uint64) | np.uint64(1)
            for i in range(self.hashes):
                x = a + np.uint64(i) * b
                yield (x ^ (x >> np.uint64(29))) % np.uint64(self.bits)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for at in self._slots(a, b):
            np.bitwise_or.at(self.field, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), dtype=bool)
        for at in self._slots(a, b):
            out &= (self.field[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


class Cascade:
    def __init__(self) -> None:
        self.levels: list[Level] = []

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Membership: keys pass from level to level while each holds them; where they stop decides."""
        out, live = np.zeros(len(a), dtype=bool), np.arange(len(a))
        for depth, level in enumerate(self.levels):
            live = live[level.holds(a[live], b[live])]
            out[live] = depth % 2 == 0
            if not len(live):
                break
        return out

    def nbytes(self) -> int:
        return sum(x.field.nbytes for x in self.levels)


def _pairs(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct pairs at the driver, in order, as 16 bytes each; None if there are more than `most`."""
    got = rows.select("a", "b").limit(most + 1).toArrow()
    if got.num_rows > most:
        return None
    a, b = (got[c].to_numpy().astype(np.int64) for c in "ab")
    order = np.lexsort((b, a))
    return a[order], b[order]


def build(listed: DataFrame, universe: DataFrame, rate: float = 2**-12, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """A cascade that separates `listed` from the other keys of `universe`; both have columns a and b (fingerprints).

    Only the listed keys and level 0's false positives come to the driver, and only if both stay within `max_bytes`
    (else None; the caller joins instead). A null key is no key; repeated keys count once; an empty list gives a cascade
    without levels, which holds nothing.
    """
    spark, most = listed.sparkSession, max_bytes // 16
    yes, cascade = _pairs(listed.select("a", "b").where("a is not null").distinct(), most), Cascade()
    if yes is None:
        return None
    if not len(yes[0]):
        return cascade
    first = Level(len(yes[0]), rate, 0)
    first.add(*yes)
    cascade.levels.append(first)
    sent = spark.sparkContext.broadcast(first)

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            held = sent.value.holds(x["a"].to_numpy(zero_copy_only=False), x["b"].to_numpy(zero_copy_only=False))
            yield x.filter(pa.array(held))

    confused = universe.select("a", "b").where("a is not null").mapInArrow(positives, "a long, b long").distinct()
    inside, outside = _pairs(confused.join(listed.select("a", "b").distinct(), ["a", "b"], "left_anti"), most), yes
    if inside is None:
        return None
    # the keys of the next level, and what it must not hold
    while len(inside[0]):
        level = Level(len(inside[0]), 0.5, len(cascade.levels))
        level.add(*inside)
        cascade.levels.append(level)
        left = level.holds(*outside)
        inside, outside = (outside[0][left], outside[1][left]), inside
    return cascade if cascade.nbytes() <= max_bytes else None


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest rule whose host is the url's or a parent domain of it and whose
    path the url's starts with; the verdict is the rule's action, and where no rule fits, that of an unlisted key.

    One cascade holds the keys of all rules, another those that block, both exact over the corpus's keys; where they would
    take more than `max_bytes`, a join gives the same rows. Null urls and
    urls without :// have empty host and path and fit no rule; repeated rows are judged one by one; of two rules of one
    length the one with the longer host wins; an empty table gives an empty result.
    """
    rules = list(dict.fromkeys((ascii_host(h), p, v) for h, p, v in rules))
    spark = pages.sparkSession
    base = pages.select(F.col("page_id").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = base.withColumn("keys", keys_of(F.col("host"), F.col("path"), [len(p) for _, p, _ in rules] or [0], [h.count(".") + 1 for h, _, _ in rules] or [1]))
    given = spark.createDataFrame([(h + p, v) for h, p, v in rules], "key string, action string").select(*[f.alias(n) for f, n in zip(fingerprints(F.col("key")), "ab", strict=True)], "action")
    one = keyed.select(F.explode("keys").alias("key")).select(*[f.alias(n) for f, n in zip(fingerprints(F.col("key")), "ab", strict=True)])
    known = build(given, one, max_bytes=max_bytes)
    blocking = build(given.where("action = 'block'"), one, max_bytes=max_bytes)
    if known is None or blocking is None:
        return _judged_by_join(keyed, rules, default)
    sent = spark.sparkContext.broadcast((known, blocking))
    marks = keyed.select("page_id", "host", "path", "keys", F.transform("keys", lambda k: fingerprints(k)[0]).alias("a"), F.transform("keys", lambda k: fingerprints(k)[1]).alias("b"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keys, n = x["keys"], x.num_rows
            a, b = (x[c].flatten().to_numpy(zero_copy_only=False) for c in "ab")
            row = np.repeat(np.arange(n), keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            hit = np.flatnonzero(sent.value[0].holds(a, b))
            texts, blocks = keys.flatten().take(pa.array(hit)).to_pylist(), sent.value[1].holds(a[hit], b[hit])
            best: dict[int, tuple[int, int, str, bool]] = {}
            for i, key, stop in zip(row[hit].tolist(), texts, blocks.tolist(), strict=True):
                rank = (len(key), key.find("/") if "/" in key else len(key), key, stop)
                best[i] = max(best.get(i, rank), rank)
            rule = [best[i][2] if i in best else None for i in range(n)]
            verdict = [("block" if best[i][3] else "allow") if i in best else default for i in range(n)]
            yield pa.RecordBatch.from_arrays([x["page_id"], x["host"], x["path"], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return marks.mapInArrow(marked, "page_id long, host string, path string, rule string, verdict string")


def ascii_host(host: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in host)


def _judged_by_join(keyed: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """`judge` without cascades: the candidate keys of each row are joined to the rules, and the best that fits is kept."""
    rows = materialize(keyed.withColumn("row", F.monotonically_increasing_id()))
    given = keyed.sparkSession.createDataFrame([(h + p, len(h), v == "block") for h, p, v in rules], "rule string, at int, stop boolean")
    fit = rows.select(F.col("row").alias("of_row"), F.explode("keys").alias("key")).join(given, F.col("key") == F.col("rule"))
    best = fit.groupBy("of_row").agg(F.max(F.struct(F.length("rule").alias("size"), "at", "rule", "stop")).alias("best"))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.stop"), "block").otherwise("allow")
    return rows.join(best, F.col("row") == F.col("of_row"), "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
