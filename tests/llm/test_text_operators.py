"""Small cases of the text operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontamination, license_scan, line_dedup, mixing, near_dedup, quality, rolling, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(3)
VOCAB = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(1, 400_000, 97)]


def prose(n: int, rng: random.Random = RNG) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- substring dedup


def cut_by_force(texts, width):
    first: dict[tuple, int] = {}
    words = [(i, (t or "").encode().split()) for i, t in texts]
    for i, ws in words:
        for k in range(len(ws) - width + 1):
            w = tuple(ws[k : k + width])
            first[w] = min(first.get(w, 2**63), 2**62 if i is None else i)
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - width + 1):
            if first[tuple(ws[k : k + width])] < (2**62 if i is None else i):
                gone.update(range(k, k + width))
        out.append((i, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    return sorted(out, key=str)


def test_substring_dedup_matches_brute_force(spark):
    shared, hot = prose(70), prose(60)
    texts = [(i, f"{prose(30)} {shared if i % 3 == 0 else ''} {prose(20)} {hot if i % 2 else ''}") for i in range(40)]
    texts += [(100, None), (101, ""), (102, " \n\t "), (103, "short text"), (104, shared), (104, shared), (105, shared + "\u00a0x"), (None, hot), (106, prose(9000) + " " + shared), (107, "a b " * 200), (108, "a b " * 150)]
    got = substring_dedup.dedup(docs_of(spark, texts), n_buckets=5).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == cut_by_force(texts, 50)


def test_substring_dedup_clashing_columns_and_common_windows_in_many_chunks(spark, monkeypatch):
    hot = prose(55)
    texts = [(i, f"{prose(6)} {hot}") for i in range(60)]
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 900)
    df = docs_of(spark, texts).withColumn("tag", F.lit(1)).withColumn("answers", F.lit("x")).withColumn("of_id", F.lit(2)).withColumn("bucket", F.lit(3))
    got = substring_dedup.dedup(df.repartition(6, "doc_id"), n_buckets=3).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == cut_by_force(texts, 50)


def test_tasks_remember_common_windows():
    hot = substring_dedup.Hot()
    key, rest = np.array([5, 9], dtype=np.uint64), np.array([1, 1], dtype=np.uint32)
    assert hot.least(key, rest, np.array([7, 8])).tolist() == [7, 8]
    assert hot.least(key, np.array([1, 2], dtype=np.uint32), np.array([9, 3])).tolist() == [7, 3]
    assert hot.least(np.array([5], dtype=np.uint64), np.array([1], dtype=np.uint32), np.array([2])).tolist() == [2]
    assert hot.least(key[:0], rest[:0], np.array([], dtype=np.int64)).tolist() == []


def test_substring_dedup_digest_and_empty(spark):
    got = by_id(substring_dedup.dedup(docs_of(spark, [(1, "a  b\nc")]), digest=True))
    assert got[1]["kept"] == hashlib.sha256(b"a b c").hexdigest()
    assert substring_dedup.dedup(docs_of(spark, []).where("false")).count() == 0


def test_substring_dedup_repeats_in_one_document(spark):
    passage = prose(60)
    early = [(1, f"{prose(20)} {passage}"), (2, "a b " * 60)]
    late = [(5, f"{passage} {prose(30)} {passage} {prose(10)} {passage}"), (6, "a b " * 200), (7, f"{prose(5)} {passage}"), (7, f"{passage} {prose(8)} {passage}"), (7, f"{prose(5)} {passage}")]
    late = [*late, *((7, f"{prose(3)} {passage}") for _ in range(3))]
    for held in (late, late[2:]):  # in the second, doc_id 7 is its chunk's smallest
        texts = early + held
        rows = spark.sparkContext.parallelize([[(i, t, "en", "s", len(t)) for i, t in x] for x in (early, held)], 2).flatMap(list)
        df = spark.createDataFrame(rows, DOCS)  # two chunks
        got = substring_dedup.dedup(df, n_buckets=5).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == cut_by_force(texts, 50)


# --- decontamination


def scan_by_force(texts, items, window=10):
    split = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    out = []
    for i, t in texts:
        ws, hit, found = split(t), set(), set()
        for name, item in items:
            iw = split(item)
            n = min(window, len(iw))
            for a in range(len(iw) - n + 1) if n else ():
                for k in range(len(ws) - n + 1):
                    if ws[k : k + n] == iw[a : a + n]:
                        hit.update(range(k, k + n))
                        found.add(str(name))
        out.append((i, len(ws), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [10_000, 30])
def test_decontamination_matches_brute_force(spark, shard):
    rng = random.Random(7)
    items = [(k, prose(rng.randint(10, 30), rng)) for k in range(8)] + [(8, "alpha beta gamma"), (9, None), (10, ""), (11, "alpha beta"), (12, "a " * 14), (13, prose(10, rng).upper())]
    texts = []
    for i in range(30):
        ws = prose(60, rng).split()
        item = (items[rng.randrange(8)][1] or "").split()
        ws[20:20] = item[rng.randrange(3) :][: rng.randint(5, 30)]
        texts.append((i, " ".join(ws)))
    texts += [(50, "Alpha, BETA-gamma! alpha beta"), (51, None), (52, ""), (53, "a " * 40), (54, items[13][1].lower() + "."), (55, items[0][1]), (55, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.scan(docs_of(spark, texts), bench, shard_words=shard).withColumn("n", decontamination.n_hit(F.col("hits"))).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n"], sorted(r["items"])) for r in got), key=str) == scan_by_force(texts, items)


@pytest.mark.parametrize("shard", [10_000, 12])
def test_decontamination_repeated_items_and_clashing_columns(spark, shard):
    item, other = prose(14), prose(11)
    bench = spark.createDataFrame([(1, item), (1, other), (1, item), (2, item)], "item_id long, text string")
    docs = docs_of(spark, [(1, f"{prose(30)} {item} {prose(30)} {other} x"), (2, "clean one"), (3, None)]).withColumn("hits", F.lit(3)).withColumn("items", F.lit("y")).withColumn("row_key", F.lit(1)).withColumn("row", F.lit(2))
    got = by_id(decontamination.scan(docs, bench, shard_words=shard))
    assert sorted(got[1]["items"]) == ["1", "2"] and got[2]["items"] == [] and got[3]["n_words"] == 0
    left = by_id(decontamination.clean(docs, bench, shard_words=shard))
    assert set(left) == {1, 2, 3} and left[1]["hits"] == 3 and item not in left[1]["text"] and left[1]["text"].endswith(" x") and left[2]["text"] == "clean one"
    assert decontamination.scan(docs.where("false"), bench, shard_words=shard).count() == 0


def test_decontamination_clean(spark):
    item = prose(12)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [(1, f"One, two. {item.upper()}! three four {prose(30)}"), (2, item), (3, "Clean text. "), (4, None)]
    got = by_id(decontamination.clean(docs_of(spark, texts), bench))
    assert set(got) == {1, 3, 4} and got[3]["text"] == "Clean text. " and got[4]["text"] is None
    assert got[1]["text"].startswith("One, two. ! three four")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert by_id(decontamination.clean(docs_of(spark, texts), empty)).keys() == {1, 2, 3, 4}


# --- line dedup


def test_line_dedup_templates(spark):
    rows = [(i, f"{prose(12)}\nUser u{i} logged in at {i}:00 today\n{prose(9)}") for i in range(12)]
    rows += [(20 + i, f"{prose(8)}\nThe cat named {VOCAB[i]} sat on the red mat") for i in range(11)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "ok\nok"), (None, "User u7 logged in at 9:00 today"), (54, prose(20000))]
    got = line_dedup.dedup(docs_of(spark, rows))
    found = {r["row"]["doc_id"]: r for r in got.collect()}
    assert len(found) == len(rows)
    assert found[0]["n_dropped"] == 0 and all(found[i]["n_dropped"] == 1 and found[i]["text"].count("\n") == 1 for i in range(1, 12))
    assert found[20]["n_dropped"] == 0 and all(found[i]["n_dropped"] == 1 for i in range(21, 31))
    assert found[None]["n_dropped"] == 1 and found[None]["text"] == ""
    assert found[50]["text"] is None and found[51]["n_lines"] == 0 and found[52]["text"] == "\n\n" and found[53]["text"] == "ok\nok"
    assert found[54]["text"] == rows[-1][1]
    assert line_dedup.dedup(docs_of(spark, []).where("false")).count() == 0


def test_line_dedup_long_tokens_and_many_lines(spark):
    rows = [(i, "x" * 400_000 + f" word {i} end of it\n" + "common line in all of them") for i in range(3)] + [(9, "\n".join(["same old line here"] * 30_000)), (10, "\n".join(["same old line here"] * 30_000))]
    rows += [(20 + i, "same old line here") for i in range(9)]
    got = {r["row"]["doc_id"]: r for r in line_dedup.dedup(docs_of(spark, rows)).collect()}
    assert got[9]["n_dropped"] == 0 and got[10]["n_dropped"] == 30_000 and got[10]["text"] == "" and got[0]["n_dropped"] == 0
    assert all(got[20 + i]["n_dropped"] == 1 for i in range(9))


def test_line_dedup_clashing_columns(spark):
    df = docs_of(spark, [(i, "same line in all\nown " + prose(5)) for i in range(12)]).withColumn("gone", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("tag", F.lit(2))
    got = line_dedup.dedup(df).collect()
    assert sum(r["n_dropped"] for r in got) == 11 and got[0]["row"]["leaf"] == "x"


# --- near duplicates


def edited(text: str, share: float, rng: random.Random) -> str:
    return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in text.split())


def test_near_dedup_classes(spark):
    rng = random.Random(5)
    base = [prose(rng.randint(60, 400), rng) for _ in range(12)]
    rows, truth = [], {}
    for b, text in enumerate(base):
        for c in range(4):
            i = len(rows)
            rows.append((i, text if c == 1 else edited(text, 0.01 if c else 0, rng)))
            truth[i] = b * 4
    chain = prose(300, rng)
    extra = [(100, None), (101, None), (102, ""), (103, ""), (104, "two words"), (105, "Two  words"), (106, "be " * 300), (107, "be " * 300 + "x"), (None, chain), (108, chain), (108, chain), (109, prose(30000, rng))]
    got = [(r["doc_id"], r["class_id"]) for r in near_dedup.classes(docs_of(spark, rows + extra)).collect()]
    assert len(got) == len(rows) + len(extra)
    found = dict(got)
    shingled = {i: set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for i, t in rows}
    for i, b in truth.items():
        if len(shingled[i] & shingled[b]) / len(shingled[i] | shingled[b]) >= 0.82:
            assert found[i] == b, (i, b)
    assert len({found[i] for i in truth}) >= 12 and all(truth[found[i]] == truth[i] for i in truth)
    assert found[100] == 100 and found[101] == 101 and found[102] == found[103] == 102 and found[104] == found[105] == 104
    assert found[106] == found[107] == 106 and found[108] == 108 and found[None] is None and found[109] == 109
    assert near_dedup.classes(docs_of(spark, []).where("false")).count() == 0


def test_near_dedup_links_inside_a_family_below_the_threshold(spark, monkeypatch):
    rng = random.Random(23)
    base, texts = prose(400, rng).split(), []
    for i in range(160):
        ws = list(base)
        for at in rng.sample(range(2, 78), 4 if i in (71, 120) else 6):
            ws[5 * at] = prose(1, rng)
        texts.append((i, " ".join(ws)))
    sh = near_dedup.shingles([t.encode() for _, t in texts])
    want = {i: i for i, _ in texts}
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if near_dedup.similarity(sh[a], sh[b]) >= near_dedup.SIMILAR:
                low, high = sorted((want[a], want[b]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert want[71] == want[120] and len(set(want.values())) > 100
    for block in (512, 32):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = by_id(near_dedup.classes(docs_of(spark, texts)))
        assert {i: r["class_id"] for i, r in got.items()} == want


def test_near_dedup_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text is not null")
    rng = random.Random(41)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for j, share in enumerate((0.002, 0.005, 0.01, 0.02, 0.05, 0.1)):
        texts += [(100_000 + 1000 * j + k, edited(texts[k][1], share, rng)) for k in range(0, 60, 2)]
    sh = near_dedup.shingles([t.encode() for _, t in texts])
    want, linked, caught = {i: i for i, _ in texts}, [], 0
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            n, m = len(sh[a]), len(sh[b])
            if texts[a][1] == texts[b][1] or (min(n, m) >= near_dedup.SIMILAR * max(n, m) and near_dedup.similarity(sh[a], sh[b]) >= near_dedup.SIMILAR):
                linked.append((texts[a][0], texts[b][0]))
                low, high = sorted((want[texts[a][0]], want[texts[b][0]]))
                want = {k: low if v == high else v for k, v in want.items()}
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("bucket", F.lit("b")).withColumn("h1", F.lit(0))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()}
    caught = sum(got[a] == got[b] for a, b in linked)
    assert len(linked) > 80 and caught >= 0.99 * len(linked)
    assert all(want[i] == want[c] for i, c in got.items())  # and nothing else is linked
    left = near_dedup.distinct_documents(df.withColumn("gone", F.lit(1)).withColumn("key", F.lit(2)).withColumn("row", F.lit(3)))
    assert {r["doc_id"] for r in left.collect()} == set(got.values()) and "gone" in left.columns


def test_near_dedup_rows_of_one_id_are_classed_by_their_texts(spark):
    rng = random.Random(51)
    a, b, c = prose(100, rng), prose(100, rng), prose(100, rng)
    rows = [(3, a), (7, a + " x"), (7, b), (9, b + " y"), (9, c), (9, c)]
    got = sorted((r["doc_id"], r["class_id"]) for r in near_dedup.classes(docs_of(spark, rows)).collect())
    assert got == [(3, 3), (7, 3), (7, 7), (9, 7), (9, 9), (9, 9)]
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.distinct_documents(docs_of(spark, rows)).collect()) == sorted([(3, a), (7, b), (9, c), (9, c)])


def test_near_dedup_shared_passage_is_no_link(spark):
    rng = random.Random(6)
    passage = prose(80, rng)
    rows = [(i, prose(60, rng) + " " + passage + " " + prose(60, rng)) for i in range(30)] + [(99, None)]
    assert all(r["doc_id"] == r["class_id"] for r in near_dedup.classes(docs_of(spark, rows)).collect())
    assert near_dedup.distinct_documents(docs_of(spark, rows)).count() == 31


def test_alignment_equals_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        a = np.array(rng.sample(range(500), 80), dtype=np.uint64)
        b = a.copy()
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(b))
            b = np.insert(b, k, 1000 + rng.randrange(10**6)) if rng.random() < 0.5 else np.delete(b, k)
        _, keep = np.unique(b, return_index=True)
        b = b[np.sort(keep)]
        t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert near_dedup.aligned(a, b) == t[-1, -1]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (20, 21), (3, 30), (30, 31), (31, 32), (32, 33)]
    got = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 30: 1, 31: 1, 32: 1, 33: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}


# --- mixing


def test_mixing_targets_and_rows(spark):
    rows = [(i, prose(10), "en", s, 0) for i, s in enumerate(["a"] * 40 + ["b"] * 400 + ["c"] * 2 + [None] * 5)] + [(900, None, "en", "a", 0), (901, "", "en", "z", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(7)).withColumn("target", F.lit("x"))
    per = {r["source"]: r for r in mixing.source_targets(df.select("source", F.lit(10).alias("size"))).collect()}
    assert abs(sum(r["target"] for r in per.values()) - 4490) < 1e-6 and all(r["target"] <= 3 * r["source_size"] + 1e-9 for r in per.values())
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and max(r["copies"] for r in got) <= 3 and {r["row"]["target"] for r in got} == {"x"}
    once = sorted(map(str, mixing.mixed(df).collect()))
    assert once == sorted(map(str, mixing.mixed(df).collect())) and len(once) == sum(r["copies"] for r in got)
    assert mixing.mix(df.where("false")).count() == 0


def test_mixing_copies_follow_the_rates_over_seeds(spark):
    rows = [(i, prose(10), "en", "ab"[i % 2], 0) for i in range(120)]
    df, copies = docs_of(spark, []).sparkSession.createDataFrame(rows, DOCS), {}
    for seed in range(12):
        for r in mixing.mix(df, seed=f"s{seed}").collect():
            copies.setdefault(r["row"]["source"], []).append((r["copies"], r["target"] / r["source_size"]))
    for taken in copies.values():
        rate = taken[0][1]
        assert abs(np.mean([c for c, _ in taken]) - rate) < 0.02 and {c for c, _ in taken} <= {int(rate), int(rate) + 1}


def test_mixing_long_texts(spark):
    df = docs_of(spark, [(1, "w " * 200_000), (2, "w " * 10), (3, "\u00a0" * 50_000)])
    got = {r["row"]["doc_id"]: r["size"] for r in mixing.mix(df).collect()}
    assert got == {1: 200_000, 2: 10, 3: 1}


# --- quality


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(2)
    rows = [(i, prose(80, rng) if i % 3 else " ".join(w.upper() + "!!" for w in prose(80, rng).split())) for i in range(600)] + [(9000, None), (9001, ""), (None, "x")]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(600)] + [(5, 1, 0), (None, 1, 0), (9001, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    import zlib

    assert {r["doc_id"] for r in held} == {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(r["predicted"] == (1 if r["doc_id"] % 3 else 0) for r in held if r["doc_id"] < 600)
    none = quality.score(docs_of(spark, rows[:5]), labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score(docs_of(spark, []).where("false"), labels).count() == 0


def scores_by_force(texts, marks, n_fourier=quality.N_FOURIER):
    """Plain normal equations over the same statistics, the same random features, and a plain isotonic fit by bins."""
    import zlib

    f = np.array([quality.statistics((t or "").encode()) for _, t in texts])
    held = np.array([i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in texts])
    rows = [k for k, (i, _) in enumerate(texts) if i in marks and not held[k]]
    fold = np.array([zlib.crc32(f"fold {texts[k][0]}".encode()) % quality.FOLDS == 0 for k in rows])
    x, y = f[rows], np.array([marks[texts[k][0]] for k in rows], dtype=float)
    a = x[~fold]
    mean, spread = a.mean(0), a.std(0)
    rng = np.random.Generator(np.random.PCG64(quality.SEED))
    w, b = rng.standard_normal((f.shape[1], n_fourier)) / quality.BANDWIDTH, rng.uniform(0, 2 * np.pi, n_fourier)

    def features(v):
        z = np.clip((v - mean) / np.where(spread > 1e-9, spread, 1), -6, 6)
        return np.hstack([np.sqrt(2 / n_fourier) * np.cos(z @ w + b), z, np.ones((len(v), 1))])

    p = features(a)
    weights = np.linalg.solve(p.T @ p + (quality.RIDGE * len(p) + 1e-9) * np.eye(p.shape[1]), p.T @ y[~fold])
    raw, truth = features(x[fold]) @ weights, y[fold]
    at = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    points = [(raw[at == k].mean(), truth[at == k].mean(), (at == k).sum()) for k in sorted(set(at.tolist()))]
    blocks = [[x, y, n] for x, y, n in points]
    while any(p[1] >= q[1] for p, q in zip(blocks, blocks[1:])):
        k = next(k for k in range(len(blocks) - 1) if blocks[k][1] >= blocks[k + 1][1])
        (x0, y0, n0), (x1, y1, n1) = blocks[k], blocks[k + 1]
        blocks[k : k + 2] = [[(x0 * n0 + x1 * n1) / (n0 + n1), (y0 * n0 + y1 * n1) / (n0 + n1), n0 + n1]]
    return np.interp(features(f) @ weights, [b[0] for b in blocks], [b[1] for b in blocks])


def test_quality_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    extra = [(90_000, None), (90_001, ""), (90_002, "long word " * 30_000), texts[0]]
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    both = docs_of(spark, texts + extra).withColumn("f", F.lit(1)).withColumn("y", F.lit("x")).withColumn("fold", F.lit(2))
    got = quality.score(both, spark.createDataFrame([(i, q, 0) for i, q in marks.items()], "doc_id long, quality int, toxic int")).collect()
    want: dict = {}
    for (i, _), v in zip(texts + extra, scores_by_force(texts + extra, marks)):
        want[i] = v
    assert len(got) == len(texts) + 4 and np.allclose([r["score"] for r in got], [want[r["doc_id"]] for r in got], atol=1e-6)


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.0, 1.0, 0.0, 1.0, 1.0]), np.ones(5))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1


# --- licence scan


def scored_by_force(line):
    families, names, w, b, heat = license_scan.model()
    if not re.search(license_scan.TERMS, "".join(c.lower() if c.isascii() else c for c in line)):
        return None
    at = [names.index(g) for g in license_scan.grams(license_scan.tokens(line)) if g in names]
    if not at:
        return None
    z = (w[at].sum(0) / np.sqrt(len(at)) + b) / heat
    return None if families[z.argmax()] == "unknown" else families[z.argmax()]


def test_license_scan_matches_brute_force(spark):
    lines = [t for f in license_scan.TEMPLATES.values() for t in f] + list(license_scan.PROSE) + ["Copyright 2024 A. Writer. All rights reserved.", "Licensed to nobody", prose(20)]
    texts = [(i, prose(5) + ".\n" + t) for i, t in enumerate(lines)] + [(950, None), (951, ""), (952, "\n"), (0, prose(5) + ".\n" + lines[0])]
    got = license_scan.scan(docs_of(spark, texts)).collect()
    want = sorted((i, scored_by_force(t.split("\n")[1])) for i, t in texts if t and t != "\n" and scored_by_force(t.split("\n")[1]))
    assert sorted((r["doc_id"], r["family"]) for r in got) == want
    right = {i: f for i, (f, _) in enumerate((f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts)}
    for r in got:
        if r["doc_id"] in right:
            assert r["family"] == right[r["doc_id"]] and r["confirmed"] and r["paragraph"] == 1
    assert not [r for r in got if len(right) <= r["doc_id"] < len(right) + len(license_scan.PROSE) and r["confirmed"]]
    assert license_scan.scan(docs_of(spark, []).where("false")).count() == 0


def test_license_scan_reads_wrapped_notices_and_leaves_others_alone(spark):
    long = license_scan.TEMPLATES["AGPL-3.0"][0].split()
    wrapped = "\n".join(" ".join(long[i : i + 9]) for i in range(0, len(long), 9))
    texts = [(1, f"{prose(20)}.\n\n{wrapped}\n\n{prose(30)}"), (2, "GNU Affero General Public License version 3"), (3, "Licensed under the ISC License"), (4, "SPDX-License-Identifier: MIT"), (5, "Released under the GPLv3 or later"), (6, "CC-BY-4.0"), (7, "the terms of the Mozilla Public License")]
    texts += [(20 + i, t) for i, t in enumerate(("Licensed under the Elastic License 2.0", "the terms of the contract", "You can use any version of the software", prose(40), "x " * 20000, " " * 30000 + "\n" + "\t" * 3000))]
    got = license_scan.scan(docs_of(spark, texts).withColumn("grams", F.lit(1)).withColumn("line", F.lit("x"))).collect()
    found = {r["doc_id"]: r["family"] for r in got if r["confirmed"] or r["doc_id"] > 1}
    assert {k: v for k, v in found.items() if k < 20} == {1: "AGPL-3.0", 2: "AGPL-3.0", 3: "ISC", 4: "MIT", 5: "GPL-3.0", 6: "CC-BY", 7: "MPL-2.0"}
    assert not [r for r in got if r["doc_id"] >= 20 and r["confirmed"]]
    assert len(license_scan.TEMPLATES) >= 25


def test_license_model_is_calibrated_on_held_out_lines():
    families, names, w, b, heat = license_scan.model()
    at, rng, right, sure, n = {g: i for i, g in enumerate(names)}, random.Random(77), 0, 0.0, 0
    held = [(f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts] + [("unknown", f"{prose(rng.randint(2, 9))} {rng.choice(license_scan.PROSE)}") for _ in range(60)]
    for family, t in held:
        words = [w for w in license_scan.tokens(t) if len(t) < 60 or rng.random() > 0.1]  # one word in ten of long ones is lost
        on = [at[g] for g in license_scan.grams(words) if g in at]
        z = (w[on].sum(0) / np.sqrt(max(1, len(on))) + b) / heat
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        right, sure, n = right + (families[p.argmax()] == family), sure + p.max(), n + 1
    assert right / n >= 0.95 and abs(right / n - sure / n) < 0.1


def test_license_scan_scores_whatever_the_model_knows(spark):
    families, names, w, b, heat = license_scan.model()
    rng = random.Random(31)
    pool = [g for g in names if len(g.split()) > 1]
    lines = ["Distributed under GPL version 3.", "SPDX: MIT", "Available under the BSD terms", *(" ".join(rng.sample(pool, rng.randint(1, 3))) for _ in range(600)), *(" ".join(rng.sample(names, 2)) for _ in range(300))]
    want = []
    for i, line in enumerate(lines):  # without any gate
        at = [names.index(g) for g in license_scan.grams(license_scan.tokens(line)) if g in names]
        family = families[((w[at].sum(0) / np.sqrt(max(1, len(at))) + b) / heat).argmax()]
        want += [(i, family)] if family != license_scan.UNKNOWN else []
    got = license_scan.scan(docs_of(spark, enumerate(lines))).collect()
    assert sorted((r["doc_id"], r["family"]) for r in got) == want


def _thue_morse(a: str, b: str, bits: int) -> str:
    word = a
    for _ in range(bits):
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_substring_dedup_tells_words_apart_that_collide_modulo_powers_of_two(spark):
    head = [f"w{i}" for i in range(49)]
    x, y = _thue_morse("a", "b", 10), _thue_morse("b", "a", 10)
    words = [" ".join([*head, x]), " ".join([*head, y]), " ".join([*head, x])]
    # the same on the level of words: two windows of 1,024 words
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(spark.createDataFrame(list(enumerate(words, 1)), "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 50}
    rows = [(1, " ".join(x)), (2, " ".join(y)), (3, " ".join(x))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=1024).collect()}
    assert got == {1: 0, 2: 0, 3: 1024}


def test_rolling_windows_are_polynomials():
    rng = np.random.default_rng(3)
    words = [[b"w%d" % i for i in rng.integers(0, 50, n)] for n in (0, 3, 49, 50, 51, 300)]
    known = rolling.Words()
    first, second, counts = known.codes(words)
    key, rest, of = rolling.windows((first, second, counts), 50)
    want, at = [], 0
    for d, n in enumerate(counts.tolist()):
        for i in range(n - 49):
            a = b = 0
            for k in range(at + i, at + i + 50):
                a, b = (a * rolling.BASE61 + int(first[k])) % rolling.P61, (b * rolling.BASE31 + int(second[k])) % rolling.P31
            want.append((d, a << 3 | b >> 28, b & 2**28 - 1))
        at += n
    assert want == list(zip(of.tolist(), key.tolist(), rest.tolist()))
