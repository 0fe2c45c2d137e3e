"""Line dedup with a log-template tree, with DataFrame functions only.

A line's path in the tree is its token count and its leading tokens, with tokens that hold digits as variable fields
(as long as most of its tokens stay constant). In
leaves that enough lines share, fields that vary between the leaf's distinct lines become variable too; lines that agree
with the leaf's constant fields form its general template, every other line is a template of its own. Templates that
recur across documents are dropped from all documents but the first.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize

LEAD, MIN_DOCS, MIN_TOKENS = 3, 10, 3
#: Share of a leaf's lines that hold a token at a place where it is constant; share of a line's tokens that must agree.
CONSTANT, SIMILAR = 0.5, 0.6
FIELD = "<*>"
_BLANK = " \t\r\v\f"
_NO_ID = 2**63 - 1
#: A token with a digit, in one step a character: matches begin at tokens only and never go back.
_DIGITS = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def trimmed(raw: Column) -> Column:
    """Without blanks at its ends. Most lines have none, which their first and last bytes tell; trimming walks the line."""
    edge = [f(raw, F.lit(c)) for c in _BLANK for f in (F.startswith, F.endswith)]
    return F.when(reduce(or_, edge), F.trim(raw, F.lit(_BLANK))).otherwise(raw)


def width(line: Column) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("int")


def masked(line: Column, n: Column, similar: float) -> Column:
    """The line with its fields generalised, if enough constant tokens are left to tell templates apart."""
    few = (n - F.regexp_count(line, F.lit(_DIGITS))) >= n * similar
    return F.when(line.rlike("[0-9]"), F.when(few, F.regexp_replace(line, _DIGITS, FIELD)).otherwise(line)).otherwise(line)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("text").alias("tag"), F.coalesce("text", F.lit("")).alias("text"))


def lines_of(rows: DataFrame, lead: int, min_tokens: int, similar: float) -> DataFrame:
    """(doc_id, tag, line_no, line, leaf): the masked lines of `min_tokens` or more tokens (separated by one space).
    Masking keeps the number of tokens, so short lines go before it."""
    cut = rows.select("doc_id", "tag", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    cut = cut.where(F.col("raw") != "").select("doc_id", "tag", "line_no", trimmed(F.col("raw")).alias("line"))
    cut = cut.where((width(F.col("line")) >= min_tokens) & (F.col("line") != ""))
    line, n = masked(F.col("line"), width(F.col("line")), similar), width(F.col("line"))
    return cut.select("doc_id", "tag", "line_no", line.alias("line"), F.xxhash64(n, F.substring_index(line, " ", lead)).alias("leaf"))


def general(candidates: DataFrame, constant: float, similar: float) -> DataFrame:
    """(leaf, line_hash, template): the distinct lines of each leaf that its general template covers."""
    distinct = materialize(candidates.groupBy("leaf", "line_hash").agg(F.min("line").alias("line")))
    tokens = distinct.select("leaf", F.posexplode(F.split("line", " ", -1)).alias("place", "token"))
    counted = tokens.groupBy("leaf", "place", "token").agg(F.count("*").alias("n"))
    places = counted.groupBy("leaf", "place").agg(F.max_by("token", F.struct("n", "token")).alias("token"), F.max("n").alias("top"), F.sum("n").alias("all"))
    fixed = F.when(F.col("top") >= F.col("all") * constant, F.col("token")).otherwise(FIELD)
    shapes = places.groupBy(F.col("leaf").alias("of_leaf")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", fixed.alias("token")))), lambda x: x["token"]).alias("shape"))
    joined = attach(distinct, materialize(shapes.withColumn("shape", F.array_join("shape", " "))), F.col("leaf") == F.col("of_leaf"), strings=("shape",))
    line, shape = F.split("line", " ", -1), F.split("shape", " ", -1)
    agreeing = F.size(F.filter(F.zip_with(line, shape, lambda a, b: (a == b) & (b != FIELD)), lambda x: x))
    return joined.where((agreeing >= F.size(line) * similar) & (F.col("shape").contains(FIELD) | (F.col("line") == F.col("shape")))).select("leaf", "line_hash", F.xxhash64("leaf", "shape").alias("template"))


def recurring(rows: DataFrame, lead: int = LEAD, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, constant: float = CONSTANT, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, tag, line_no) of the lines to drop. Counts of documents are exact, and pre-aggregated by line and
    document before they meet in one place, however common a line is."""
    lines = lines_of(rows, lead, min_tokens, similar).withColumn("line_hash", F.xxhash64("line"))
    found = materialize(lines.select("doc_id", "tag", "line_no", "leaf", "line_hash"))
    in_doc = found.select("leaf", "line_hash", "doc_id").distinct()
    leaves = in_doc.groupBy("leaf").agg(F.count("*").alias("n"), F.min("line_hash").alias("a"), F.max("line_hash").alias("b")).where(f"n >= {int(min_docs)}")
    leaves = materialize(leaves.select(F.col("leaf").alias("of_leaf"), (F.col("a") != F.col("b")).alias("branching")))
    busy = materialize(attach(found, leaves, F.col("leaf") == F.col("of_leaf")).drop("of_leaf"))
    branching = leaves.where("branching").select("of_leaf")
    texts = attach(lines.select("leaf", "line_hash", "line"), branching, F.col("leaf") == F.col("of_leaf"), "left_semi")
    cover = general(texts, constant, similar).select(F.col("leaf").alias("of_leaf"), F.col("line_hash").alias("of_line"), "template")
    marked = attach(busy, materialize(cover), (F.col("leaf") == F.col("of_leaf")) & (F.col("line_hash") == F.col("of_line")), "left")
    marked = marked.select("doc_id", "tag", "line_no", F.coalesce("template", F.xxhash64("leaf", "line_hash")).alias("template"))
    docs_of = marked.select("template", "doc_id").distinct().groupBy(F.col("template").alias("of_template")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    common = materialize(docs_of.where(f"n >= {int(min_docs)}").select("of_template", "first"))
    return attach(marked, common, F.col("template") == F.col("of_template")).where("doc_id > first").select("doc_id", "tag", "line_no")


def dropped(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, tag, gone): line numbers to drop, by id and hash of the text."""
    gone = recurring(keyed(docs), **options)
    return gone.groupBy(F.col("doc_id").alias("of_id"), F.col("tag").alias("of_tag")).agg(F.collect_set("line_no").alias("gone"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """(row, text, n_lines, n_dropped): `row` holds the columns of `docs`, `text` the lines that stay.

    A template recurs when its lines are in `min_docs` documents or more; its lines then stay in the document with the
    smallest id only. Lines are cut at newlines and keep their spelling; blank lines and lines under `min_tokens` tokens
    are never dropped; null and empty texts have no lines (a null text stays null); a null doc_id is larger than any
    other; rows with one doc_id count as one document; an empty table gives an empty result.
    """
    gone = dropped(docs, **options)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), F.xxhash64("text").alias("tag"), F.col("text").alias("text"))
    joined = rows.join(gone, (F.col("key") == F.col("of_id")) & (F.col("tag") == F.col("of_tag")), "left")
    lines = F.split("text", "\n", -1)
    # which lines go, in line order: sorted flags and not a search for every line
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    flags = F.sort_array(F.concat(F.transform("gone", lambda i: F.struct(i.alias("i"), F.lit(True).alias("gone"))), F.transform(F.array_except(numbers, "gone"), lambda i: F.struct(i.alias("i"), F.lit(False).alias("gone")))))
    left = F.filter(F.zip_with(lines, flags, lambda x, f: F.when(~f["gone"], x)), lambda x: x.isNotNull())
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(F.coalesce(F.octet_length("text"), F.lit(0)) == 0, 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined.select("row", text.alias("text"), n_lines.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))
