"""Benchmark decontamination with a generalised suffix automaton of the normalised test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_batches

WINDOW = 10
#: Item words in one automaton (about 0.6 kB each while it is in use); larger benchmarks are dealt to several, which are
#: built, sent and applied one after another.
SHARD_WORDS = 250_000
#: A document loses its hit spans, or goes as a whole when more than this share of its words is hit.
MAX_COVERAGE = 0.5
#: A-Z to lower case; every ASCII byte that is neither digit nor letter to a space.
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_FILTER_BITS = 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """Suffix automaton over all items, with what each position of a text needs: the items that hold the last `window`
    words, and the short items (fewer words than the window) that end here."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in items]
        self.names = [name for name, _ in items]
        self.shortest = min([window, *(len(c) for c in coded if c)])
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = [self._insert(c) for c in coded]
        self.anchor = self._anchors()
        self.items: dict[int, list[int]] = self._holders(coded)
        self.short = self._short(coded, ends)
        self.pairs = np.zeros(1 << _FILTER_BITS, dtype=bool)
        for c in coded:
            a = np.array(c, dtype=np.int64)
            self.pairs[self.pair(a[:-1], a[1:])] = True

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA6B >> 7) & ((1 << _FILTER_BITS) - 1)

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _insert(self, item: list[int]) -> int:
        last = 0
        for c in item:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            p, last = last, self._state(self.length[last] + 1, 0, {})
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return last

    def _holders(self, coded: list[list[int]]) -> dict[int, list[int]]:
        """The items that hold the windows of each anchor."""
        found: dict[int, list[int]] = {}
        for i, item in enumerate(coded):
            v = 0
            for c in item:
                v = self.next[v][c]
                if self.anchor[v] >= 0:
                    held = found.setdefault(self.anchor[v], [])
                    if not held or held[-1] != i:
                        held.append(i)
        return found

    def _anchors(self) -> list[int]:
        """For states of `window` words or more, the ancestor whose strings include the last `window` words."""
        out = [-1] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[v] >= self.window:
                out[v] = v if self.length[self.link[v]] < self.window else out[self.link[v]]
        return out

    def _short(self, coded: list[list[int]], ends: list[int]) -> list[tuple[tuple[int, int], ...]]:
        own: dict[int, list[tuple[int, int]]] = {}
        for i, (item, end) in enumerate(zip(coded, ends, strict=True)):
            if 0 < len(item) < self.window:
                own.setdefault(end, []).append((len(item), i))
        out: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            out[v] = (*own.get(v, ()), *out[self.link[v]])
        return out

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Occurrences of windows in a text as (first word, behind the last), and the items they are from.

        The automaton only has to run where enough words in a row are known and each pair of neighbours occurs in some
        item; elsewhere no match can reach the shortest window.
        """
        n, least = len(words), self.shortest
        if n < least or not self.vocabulary:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=n)
        if least > 1:
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
            ok &= self.pairs[self.pair(ids[:-1], ids[1:])]
        else:
            ok = ids >= 0
        edge = np.diff(np.concatenate(([0], ok.view(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        need = max(1, least - 1)
        runs = [(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True) if b - a >= need] if len(begin) and (end - begin).max() >= need else []
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b in runs:
            v = l = 0
            for i, c in enumerate(ids[a : b + (least > 1)].tolist(), a):
                while v and c not in self.next[v]:
                    v = self.link[v]
                    l = self.length[v]
                if c in self.next[v]:
                    v, l = self.next[v][c], l + 1
                if l >= self.window:
                    hits.append((i - self.window + 1, i + 1))
                    items.update(self.items[self.anchor[v]])
                for size, item in self.short[v]:
                    if size <= l:
                        hits.append((i - size + 1, i + 1))
                        items.add(item)
        return hits, items


FOUND = "row_key long, n_words long, hits array<int>, items array<string>"


def _scan(sent, many: bool):
    """Rows (row_key, n_words, hits, items): hits are flat borders of merged hit spans, in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for x in batches:
            text = x["text"].cast(pa.binary())
            counts, hits, items = [], [], []
            for i in range(x.num_rows):
                words = words_of(text[i].as_py() or b"")
                spans, found = automaton.spans(words)
                counts.append(len(words))
                hits.append(merged(spans))
                items.append(sorted({automaton.names[k] for k in found}))
            rest = [x[c] for c in x.schema.names if c != "text"] if not many else [x["row_key"]]
            names = [c for c in x.schema.names if c != "text"] if not many else ["row_key"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], [*names, "n_words", "hits", "items"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def automata(benchmark: DataFrame, window: int, shard_words: int) -> Iterator[Automaton]:
    """One automaton for each `shard_words` of items; items come to the driver one shard at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("item is not null").toLocalIterator():
        words = words_of(bytes(row["text"] or b""))
        if held and size + len(words) > shard_words:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((row["item"], words))
        size += len(words)
    yield Automaton(held, window)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, hits, items) for every row of `docs`.

    Null and blank texts have no words and no hits; items with a null id or without words never occur, and an item id on
    several rows counts once; repeated documents are judged one by one; an empty benchmark hits nothing.
    """
    text_batches(docs.sparkSession)
    parts = automata(benchmark, window, shard_words)
    first, second = next(parts), next(parts, None)
    if second is None:
        return docs.select("doc_id", "text").mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(first), False), "doc_id long, n_words long, hits array<int>, items array<string>")
    keyed = materialize(docs.select("doc_id", "text").withColumn("row_key", F.monotonically_increasing_id()))
    per = _by_shard(keyed, chain((first, second), parts))
    return keyed.select("row_key", "doc_id").join(per, "row_key").select("doc_id", "n_words", "hits", "items")


def _by_shard(keyed: DataFrame, parts: Iterator[Automaton]) -> DataFrame:
    """(row_key, n_words, hits, items) of all shards together; one automaton at a time is at the driver and the workers."""
    found = None
    for p in parts:
        sent = keyed.sparkSession.sparkContext.broadcast(p)
        got = materialize(keyed.select("row_key", "text").mapInArrow(_scan(sent, True), FOUND).where("n_words = 0 or size(hits) > 0" if found is not None else "true"))
        sent.destroy()
        found = got if found is None else found.unionByName(got)
    per = found.groupBy("row_key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("flat"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size("flat") / 2 - 1).cast("int")), lambda i: F.struct(F.get("flat", i * 2).alias("a"), F.get("flat", i * 2 + 1).alias("b"))))
    joined = F.aggregate(pairs, F.array().cast("array<int>"), lambda acc, s: F.when((F.size(acc) > 0) & (s["a"] <= F.element_at(acc, -1)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), s["b"])))).otherwise(F.concat(acc, F.array(s["a"], s["b"]))))
    return per.withColumn("hits", F.when(F.size("flat") > 0, joined).otherwise(F.array().cast("array<int>")))


def n_hit(hits):
    """Words inside the spans of a `hits` column."""
    return F.aggregate(F.transform(hits, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _clean(sent, max_coverage: float, names: list[str]):
    """The rows without hit spans: these are in a column `hits`, or found by the automaton that was sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            given = x[0] if sent is None else x
            fields = {c: given.field(i) for i, c in enumerate(names)} if sent is None else {c: x[c] for c in names}
            raw, keep, texts = fields["text"].cast(pa.binary()), [], []
            for i in range(x.num_rows):
                text = raw[i].as_py()
                words = words_of(text or b"")
                cut = x[1][i].as_py() if sent is None else merged(sent.value.spans(words)[0])
                if not cut:
                    keep.append(i)
                    texts.append(None if text is None else text.decode())
                    continue
                if sum(cut[1::2]) - sum(cut[::2]) > max_coverage * len(words):
                    continue
                at = [m.span() for m in _WORD.finditer(text.translate(NORMAL))]
                out, last = [], 0
                for a, b in zip(cut[::2], cut[1::2], strict=True):
                    out.append(text[last : at[a][0]])
                    last = at[b - 1][1]
                keep.append(i)
                texts.append(b"".join([*out, text[last:]]).decode())
            rest = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else fields[c].take(rest) for c in names], names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`docs` without hit spans; a document goes when over `max_coverage` of its words is hit. Clean rows are unchanged.

    Nulls, repeated rows and empty tables are as in `scan`; other columns pass, whatever their names.
    """
    text_batches(docs.sparkSession)
    parts = automata(benchmark, window, shard_words)
    first, second = next(parts), next(parts, None)
    if second is None:
        return docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(first), max_coverage, docs.columns), docs.schema)
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("row_key"), "text", F.struct("*").alias("row")))
    per = _by_shard(keyed, chain((first, second), parts)).select(F.col("row_key").alias("of_key"), "hits")
    joined = keyed.join(per, F.col("row_key") == F.col("of_key"), "left").select("row", "hits")
    return joined.mapInArrow(_clean(None, max_coverage, docs.columns), docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
