"""Language ID by Bayesian evidence fusion: text likelihoods, the language that the markup declares, and host priors that
are smoothed by the address suffix and by the whole corpus."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize, text_batches
from .url_filter import host_of

#: Expected number of labelled documents that the text model is fitted on, chosen by a hash of their ids.
SAMPLE_DOCS = 20_000
BINS, TEMPER, MAX_LANGUAGES = 1 << 15, 0.1, 200
#: Pseudo-counts: of the corpus in a suffix's prior, of the suffix in a host's, of one declaration.
SUFFIX_WEIGHT, HOST_WEIGHT, DECLARED_WEIGHT = 20.0, 5.0, 1.0
_OPEN = re.compile(r"<(script|style)\b", re.I)
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style")}
_PLACES = re.compile(r"""<html\b[^>]*|(http-equiv\s*=\s*["']?content-language)[^>]*""", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([a-z]{2,3})""", re.I)
_CONTENT = re.compile(r"""content\s*=\s*["']?([a-z]{2,3})""", re.I)
#: What languages beyond `max_languages` are counted as, together.
REST = "und"


def bins(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text with white space runs as one space."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int64)
    return ((raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(17)).astype(np.int64)


def visible(page: str) -> str:
    """The text of a page: without comments, scripts, styles and tags, entities resolved. What is opened and never closed is
    looked for once, so the time is linear; it stays as text."""
    out, at, missing = [], 0, set()

    def behind(what: str, found: int) -> int:
        if found < 0:
            missing.add(what)
        return found

    while (i := page.find("<", at)) >= 0:
        end = -1
        if page.startswith("<!--", i) and "-->" not in missing:
            j = behind("-->", page.find("-->", i + 4))
            end = j + 3 if j >= 0 else -1
        if end < 0 and (opened := _OPEN.match(page, i)) and (name := opened[1].lower()) not in missing:
            closed = _CLOSE[name].search(page, opened.end())
            end = behind(name, closed.end() if closed else -1)
        if end < 0 and ">" not in missing:
            j = behind(">", page.find(">", i + 1))
            end = j + 1 if j >= 0 else -1
        if end < 0:
            out.append(page[at : i + 1])
            at = i + 1
        else:
            out += (page[at:i], " ")
            at = end
    return html.unescape("".join([*out, page[at:]]))


def declared_in(page: str) -> str | None:
    """The language that the markup declares first, in its html tag or as content-language."""
    for m in _PLACES.finditer(page):
        if found := _CONTENT.search(page, m.end(1), m.end()) if m[1] else _LANG.search(m[0]):
            return found[1].lower()
    return None


class TextModel:
    """Multinomial trigram log-likelihoods, smoothed by one count a bin."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        rows = np.array([counts[x] for x in self.languages], dtype=np.float64).reshape(len(self.languages), BINS) + 1
        self.log_p = np.log(rows / rows.sum(1, keepdims=True))

    def likelihood(self, text: str) -> np.ndarray:
        """Tempered log-likelihood of each language relative to the best; zeros for a text without trigrams."""
        at = bins(text)
        # of a long text the counts of bins, so that memory doesn't grow with it
        out = (self.log_p[:, at].sum(1) if len(at) <= 4096 else self.log_p @ np.bincount(at, minlength=BINS)) * TEMPER
        return out - out.max(initial=-np.inf) if len(out) else out


def fit(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, max_languages: int = MAX_LANGUAGES) -> TextModel:
    """Trigram counts of a sample of labelled documents of bounded expected size, the same at every run. If more than
    `max_languages` languages are labelled, those with the most documents (then first in code point order) keep their names
    and all others are one, REST."""
    rows = documents.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    known = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(max_languages + 1).collect()]
    if len(known) > max_languages:
        rows = rows.withColumn("lang", F.when(F.col("lang").isin(known[: max_languages - 1]), F.col("lang")).otherwise(REST))
    share = min(1.0, sample_docs / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for x in batches:
            for lang, text in zip(x["lang"].to_pylist(), x["text"], strict=True):
                if lang not in held:
                    held[lang] = np.zeros(BINS, dtype=np.int64)
                held[lang] += np.bincount(bins(text.as_py()), minlength=BINS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bin", "n"])

    got = rows.select("lang", "text").mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in got.toLocalIterator():
        if r["lang"] not in counts:
            counts[r["lang"]] = np.zeros(BINS)
        counts[r["lang"]][r["bin"]] = r["n"]
    return TextModel(counts)


def _evidence(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: TextModel = sent.value
        for x in batches:
            rows, declared = [], []
            for i in range(x.num_rows):
                page = x["html"][i].as_py() or ""
                rows.append(model.likelihood(visible(page)).tolist())
                declared.append(declared_in(page))
            yield pa.RecordBatch.from_arrays([x["page_id"], x["host"], pa.array(declared, pa.string()), pa.array(rows, pa.list_(pa.float64()))], ["page_id", "host", "declared", "text"])

    return run


def _counts(k: int) -> Column:
    """Pages of each language by text, as an array; pages whose text decides nothing count for none."""
    return F.array(*[F.sum(F.when(F.col("by_text") == i, 1.0).otherwise(0.0)) for i in range(k)])


def _smoothed(counts: Column, prior: Column, weight: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda n, p: (n + p * weight) / (total + weight))


def identify(pages: DataFrame, documents: DataFrame, **options) -> DataFrame:
    """(page_id, language, probability, text_language, declared) for every row of `pages`.

    posterior ~ tempered text likelihood x P(declared | language) x prior of the host without this page. A host's prior
    is smoothed by its suffix's (the last label of the host), and that by the corpus's. Null or empty html gives no text
    evidence and a null text_language; urls without host share an empty host; ties go to the first language in code
    point order; repeated rows count each; without labelled documents language is null; an empty table gives no rows.
    """
    text_batches(pages.sparkSession)
    model = fit(documents, **options)
    k = len(model.languages)
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").alias("page_id"), host_of(F.col("url")).alias("host"), F.col("html").alias("html"))
    sent = spark.sparkContext.broadcast(model)
    if not k:
        return rows.select("page_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_language"), F.lit(None).cast("string").alias("declared"))
    seen = rows.mapInArrow(_evidence(sent), "page_id long, host string, declared string, text array<double>")
    by_text = F.when(F.array_min("text") < 0, F.array_position(F.col("text"), F.lit(0.0)) - 1)
    seen = materialize(seen.select("*", F.element_at(F.split("host", r"\."), -1).alias("suffix"), by_text.alias("by_text")))
    names = F.array(*map(F.lit, model.languages))
    corpus = seen.agg(_counts(k).alias("n")).first()["n"]
    corpus = np.array([x or 0.0 for x in corpus]) + 1
    prior = F.array(*[F.lit(float(x)) for x in corpus / corpus.sum()])
    # P(declared | language): declarations of a language outside the model say nothing, so the table is k x k
    pairs = np.ones((k, k)) * DECLARED_WEIGHT
    said = F.array_position(names, F.col("declared"))
    for r in seen.where("by_text is not null").groupBy("by_text", said.alias("said")).agg(F.count("*").alias("n")).where("said > 0").collect():
        pairs[r["by_text"], r["said"] - 1] += r["n"]
    log_said = np.log(pairs / pairs.sum(1, keepdims=True)).T
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in log_said])
    suffixes = materialize(seen.groupBy("suffix").agg(_counts(k).alias("n")).select(F.col("suffix").alias("of_suffix"), _smoothed(F.col("n"), prior, SUFFIX_WEIGHT).alias("suffix_prior")))
    hosts = seen.groupBy("host", "suffix").agg(_counts(k).alias("host_n"))
    hosts = materialize(attach(hosts, suffixes, F.col("suffix") == F.col("of_suffix"), strings=("of_suffix",)).select(F.col("host").alias("of_host"), "host_n", "suffix_prior"))
    joined = attach(seen, hosts, F.col("host") == F.col("of_host"), strings=("of_host",))
    others = F.transform("host_n", lambda n, i: F.when(F.col("by_text") == i, n - 1).otherwise(n))
    joined = joined.withColumn("host_prior", _smoothed(others, F.col("suffix_prior"), HOST_WEIGHT))
    evidence = F.transform("text", lambda t, i: t + F.log(F.get(F.col("host_prior"), i)) + F.when(said > 0, F.get(F.get(table, (said - 1).cast("int")), i)).otherwise(0.0))
    joined = joined.withColumn("log_post", evidence)
    top = F.array_max("log_post")
    total = F.aggregate(F.transform("log_post", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return joined.select("page_id", F.get(names, (F.array_position(F.col("log_post"), top) - 1).cast("int")).alias("language"), (1 / total).alias("probability"), F.get(names, F.col("by_text").cast("int")).alias("text_language"), "declared")
