"""Small cases of the url, language and vector operators, and of the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import language, line_dedup, topk, url_filter

URLS = ["http://a.com/en/7", "https://Example.COM/en/71?x", "http://x.example.com/en/6", "http://example.net/de/8#f", "http://example.net/de/7", "http://q.org/es/", "http://q.org/es", "http://com/en/x", "http://notcom/en/", "no scheme", None, "", "http://", "a://b://com/en/", "http://u@H.org/es/a/b?c://d"]


def judged_by_force(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host) :]
    path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(df).collect()}
    assert got == {i: judged_by_force(u) for i, u in enumerate(URLS * 2)}
    assert url_filter.judge(df.where("false")).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("yes"))
    both = keys.select(*[f.alias(n) for f, n in zip(url_filter.fingerprints(F.col("key")), "ab", strict=True)], "yes")
    cascade = url_filter.build(both.where("yes"), both, rate=0.1)
    rows = both.collect()
    held = cascade.holds(np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows]))
    assert held.tolist() == [r["yes"] for r in rows] and len(cascade.levels) > 2
    assert url_filter.build(both.where("yes"), both, max_bytes=1024) is None


def test_url_rules_beyond_the_bytes_of_a_cascade(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, *URLS])] + [(None, URLS[0])], "page_id long, url string").withColumn("row", F.lit(1)).withColumn("keys", F.lit("k"))
    got = sorted(map(repr, url_filter.judge(df, max_bytes=16).collect()))
    assert got == sorted(map(repr, url_filter.judge(df).collect())) and len(got) == 2 * len(URLS) + 1
    rules = [(f"h{i}.example.com", f"/{i}/", "block" if i % 2 else "allow") for i in range(300)]
    urls = spark.createDataFrame([(i, f"http://a.h{i}.example.com/{i}/x") for i in range(400)], "page_id long, url string")
    want = {i: ("block" if i % 2 else "allow") if i < 300 else "allow" for i in range(400)}
    for most in (64 << 20, 1024):
        assert {r["page_id"]: r["verdict"] for r in url_filter.judge(urls, rules, max_bytes=most).collect()} == want


def test_url_filter_long_hosts_and_paths(spark):
    hosts = ["a." * 20000 + "example.com", "x" * 200_000 + ".org", "." * 5000, "b." * 3000]
    df = spark.createDataFrame([(i, f"http://{h}/en/71" + "/y" * 50_000) for i, h in enumerate(hosts)], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()} == {0: ("example.com/en/7", "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: (None, "allow")}


@pytest.mark.parametrize("query_bytes", [8 << 20, 2000])
def test_topk_matches_brute_force(spark, query_bytes):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8)) * rng.exponential(1, (400, 1))
    x[100:110] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 8), (1050, [float("inf")] * 8), (1100, []), (1150, [3.0])]
    v = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(v, v.where("vec_id % 50 = 0"), query_bytes=query_bytes).collect())
    z = {i: np.floor(256 * np.array(e)).astype(int) for i, e in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)}
    want = []
    for q in (i for i in z if i % 50 == 0):
        scored = sorted((-int(np.dot(*(np.pad(a, (0, 8 - len(a))) for a in (z[q], z[c])))), c) for c in z if c != q)
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored[:5])]
    assert got == sorted(want)


def test_topk_large_components_and_few_rows(spark):
    v = topk.usable(spark.createDataFrame([(0, [2.0**22, 1.0]), (50, [2.0**22, -1.0])], "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, topk.search(v, v).collect())) == [(0, 1, 50, 2**60 - 2**16), (50, 1, 0, 2**60 - 2**16)]
    assert topk.search(v.where("false"), v.where("false")).count() == 0


def test_topk_by_length_prunes_and_keeps_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "LONGEST", 40)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 6))
    x[:50] *= 40  # a few long ones decide
    x[200:260] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    v = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    z = np.floor(256 * x).astype(np.int64)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(v, v.where("vec_id % 50 = 0"), k=7).collect())
    want = []
    for q in range(0, 600, 50):
        scored = sorted((-int(z[q] @ z[c]), c) for c in range(600) if c != q)[:7]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    assert got == sorted(want)


def test_topk_scores_beyond_64_bits(spark):
    v = topk.usable(spark.createDataFrame([(0, [1e300]), (50, [-1e300]), (100, [2.0**50, 2.0**50]), (150, [2.0**50, -(2.0**50)]), (7, [0.0])], "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.search(v, v.where("vec_id % 50 = 0")).collect()}
    assert got[0, 50] == -(2**63) and got[100, 150] == 0 and got[0, 7] == 0 and got[100, 0] == 2**63 - 1


def _linear(seconds_of, *sizes):
    import time

    took = []
    for n in sizes:
        began = time.perf_counter()
        seconds_of(n)
        took.append(time.perf_counter() - began)
    return took


def test_markup_that_is_never_closed_takes_linear_time():
    for what in ("<!--", "<script>", "<", "<html ", '<meta http-equiv="content-language" ', "</script ", "<style"):
        took = _linear(lambda n, what=what: (language.visible(what * n), language.declared_in(what * n)), 2000, 40_000)
        assert took[1] < 200 * took[0] + 0.5, (what, took)
    assert language.visible("a<!-- x -->b<script>s</script >c<p title='>'>d &amp; <!-- e") == "a b c '>d & <!-- e"
    assert language.visible("x < y <b>z</b> <style>p{}</style>q<script>w") == "x  z   q w"
    assert language.declared_in('<html class="a" LANG=de-AT>') == "de" and language.declared_in("<html><p lang=fr>") is None
    assert language.declared_in("""<html><meta http-equiv="Content-Language" content="es">""") == "es"


def posterior_by_force(pages, model):
    """What identify() gives, page by page in plain Python."""
    k, seen = len(model.languages), []
    for i, url, page in pages:
        host = (url or "").split("://", 1)[1].split("/")[0].lower() if "://" in (url or "") else ""
        text = model.likelihood(language.visible(page or "")).tolist()
        seen.append((i, host, host.split(".")[-1], text, text.index(0.0) if min(text) < 0 else None, language.declared_in(page or "")))
    count = lambda rows: [sum(r[4] == j for r in rows) for j in range(k)]
    smooth = lambda n, prior, weight: [(a + b * weight) / (sum(n) + weight) for a, b in zip(n, prior)]
    corpus = [n + 1 for n in count(seen)]
    corpus = [n / sum(corpus) for n in corpus]
    said = np.ones((k, k)) * language.DECLARED_WEIGHT
    for r in seen:
        if r[4] is not None and r[5] in model.languages:
            said[r[4], model.languages.index(r[5])] += 1
    said = np.log(said / said.sum(1, keepdims=True))
    out = []
    for r in seen:
        suffix = smooth(count([x for x in seen if x[2] == r[2]]), corpus, language.SUFFIX_WEIGHT)
        own = count([x for x in seen if x[1] == r[1]])
        own = [n - (j == r[4]) for j, n in enumerate(own)]
        prior = smooth(own, suffix, language.HOST_WEIGHT)
        z = np.array([t + np.log(p) + (said[j, model.languages.index(r[5])] if r[5] in model.languages else 0) for j, (t, p) in enumerate(zip(r[3], prior))])
        out.append((r[0], model.languages[int(z.argmax())], round(float(1 / np.exp(z - z.max()).sum()), 9), None if r[4] is None else model.languages[r[4]], r[5]))
    return out


def test_language_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [(10_001, None, None), (10_002, "x", ""), (10_003, pages[0][1], "<html lang=zz>"), pages[3], (10_004, pages[1][1], pages[1][2] * 40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["language"], round(r["probability"], 9), r["text_language"], r["declared"]) for r in language.identify(df, docs).collect()), key=str)
    want = sorted(posterior_by_force(pages, language.fit(docs)), key=str)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-8)


def test_languages_beyond_the_most_are_one(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7}a w{i % 7}b w{i % 7}c", f"l{i % 7}") for i in range(70)] + [(100, "zz yy", "l0")], "doc_id long, text string, lang string")
    assert language.fit(docs).languages == [f"l{i}" for i in range(7)]
    few = language.fit(docs, max_languages=3)
    assert few.languages == ["l0", "l1", language.REST]
    got = language.identify(spark.createDataFrame([(1, "http://a.b/", "<p>w5a w5b w5c w5a w5b</p>")], "page_id long, url string, html string"), docs, max_languages=3).first()
    assert got["text_language"] == language.REST


def test_language_fusion(spark):
    rng = random.Random(4)
    words = {"en": ["the", "and", "with", "thing", "other"], "fr": ["le", "être", "avec", "chose", "autre"], "de": ["der", "und", "mit", "sache", "über"]}
    say = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    docs = spark.createDataFrame([(i, say(k, 80), k) for i, k in enumerate(list(words) * 30)] + [(999, None, "xx"), (998, "x", None)], "doc_id long, text string, lang string")
    pages = [(i, f"http://h{k}.example.{k}/x", f'<html lang="{k}"><body><p>{say(k, 30)}</p><script>the and with</script></body></html>') for i, k in enumerate(list(words) * 10)]
    pages += [(100, "http://hfr.example.fr/y", None), (101, None, '<html lang=de>'), (102, "http://hfr.example.fr/z", ""), (103, "http://hen.example.en/", f"<p>{say('de', 40)}</p>"), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(0)).withColumn("text", F.lit(1))
    got = language.identify(df, docs).collect()
    assert len(got) == len(pages)
    found = {r["page_id"]: r for r in got}
    assert all(found[i]["language"] == k for i, k in enumerate(list(words) * 10))
    assert found[100]["language"] == "fr" and found[100]["text_language"] is None and found[101]["language"] == "de" and found[103]["language"] == "de"
    assert all(0 < r["probability"] <= 1 + 1e-9 for r in got)
    assert {r["language"] for r in language.identify(df, docs.where("false")).collect()} == {None}
    assert language.identify(df.where("false"), docs).count() == 0


def lines_by_force(docs):
    """Line dedup in plain Python: {place of a document: lines left}."""
    import re
    from collections import Counter, defaultdict

    similar, constant, field = line_dedup.SIMILAR, line_dedup.CONSTANT, line_dedup.FIELD
    rows = []
    for place, (i, text) in enumerate(docs):
        for no, raw in enumerate((text or "").split("\n")):
            ts = raw.strip(" \t\r\v\f").split(" ")
            if len(ts) >= line_dedup.MIN_TOKENS and raw.strip(" \t\r\v\f"):
                fields = [bool(re.search("[0-9]", t)) for t in ts]
                if len(ts) - sum(fields) >= len(ts) * similar:
                    ts = [field if f else t for t, f in zip(ts, fields)]
                rows.append((place, i, no, (len(ts), *ts[: line_dedup.LEAD]), tuple(ts)))
    leaves = defaultdict(set)
    for _, i, _, leaf, line in rows:
        leaves[leaf].add((line, i))
    template = {}
    for leaf, pairs in leaves.items():
        kinds = {line for line, _ in pairs}
        if len(pairs) < line_dedup.MIN_DOCS:
            continue
        shape = []
        for k in range(leaf[0]):
            count = Counter(line[k] for line in kinds)
            top = max(count, key=lambda t: (count[t], t))
            shape.append(top if count[top] >= constant * len(kinds) else field)
        for line in kinds:
            fits = sum(a == b != field for a, b in zip(line, shape)) >= similar * len(line)
            general = len(kinds) > 1 and fits and (field in shape or list(line) == shape)
            template[line] = ("~", leaf, tuple(shape)) if general else ("=", leaf, line)
    seen = defaultdict(set)
    for _, i, _, _, line in rows:
        if line in template:
            seen[template[line]].add(i)
    gone = {(place, no) for place, i, no, _, line in rows if line in template and len(seen[template[line]]) >= line_dedup.MIN_DOCS and i > min(seen[template[line]])}
    return [[raw for no, raw in enumerate((text or "").split("\n")) if (place, no) not in gone] for place, (_, text) in enumerate(docs)]


def test_pipeline_matches_brute_force(spark, tmp_path):
    """Every stage against a plain version of it, each on the input it got, over whole small tables."""
    import re

    from marlstone.llm import decontamination, mixing, near_dedup
    from tests.llm.test_text_operators import scan_by_force, scores_by_force

    here = "/root/testdata/sf0.001"
    docs, columns = spark.read.parquet(f"{here}/documents.parquet"), None
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{here}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{here}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, here).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        after = [r.asDict() for r in docs.collect()]
        pairs = [(r["doc_id"], r["text"]) for r in before]
        if name == "quality":
            want = [r for r, v in zip(before, scores_by_force(pairs, marks)) if v >= 0.5]
        elif name == "line_dedup":
            want = []
            for r, left in zip(before, lines_by_force(pairs)):
                text = "\n".join(left)
                if r["text"] is None or text == r["text"]:
                    want.append(r)
                elif re.search("[^\x20\x09-\x0d]", text):
                    want.append(r | {"text": text, "n_chars": len(text)})
        elif name == "near_dedup":
            sh, of = near_dedup.shingles([(t or "").encode() for _, t in pairs]), {i: i for i, _ in pairs}
            for a in range(len(pairs)):
                for b in range(a + 1, len(pairs)):
                    if pairs[a][1] == pairs[b][1] or min(len(sh[a]), len(sh[b])) >= 0.8 * max(len(sh[a]), len(sh[b])) and near_dedup.similarity(sh[a], sh[b]) >= 0.8:
                        low, high = sorted((of[pairs[a][0]], of[pairs[b][0]]))
                        of = {k: low if v == high else v for k, v in of.items()}
            want = [r for r in before if of[r["doc_id"]] == r["doc_id"]]
        elif name == "decontamination":
            hit = {i: (n, h) for i, n, h, _ in scan_by_force(pairs, items)}
            assert {r["doc_id"] for r in after} == {i for i, (n, h) in hit.items() if h <= decontamination.MAX_COVERAGE * n}
            assert not any(h for _, _, h, _ in scan_by_force([(r["doc_id"], r["text"]) for r in after if hit[r["doc_id"]][1] == 0], items))
            words = lambda t: len(decontamination.words_of((t or "").encode()))
            assert all(words(r["text"]) == hit[r["doc_id"]][0] - hit[r["doc_id"]][1] for r in after)
            continue
        else:
            sizes = {}
            for r in before:
                sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
            sources = sorted(sizes, key=lambda s: (s is None, s))
            weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
            target, open_ = {}, set(sources)
            while open_:
                rest, share = sum(sizes.values()) - sum(target.values()), sum(weight[s] for s in open_)
                full = {s for s in open_ if rest * weight[s] / share > 3 * sizes[s]}
                target |= {s: 3.0 * sizes[s] if full else rest * weight[s] / share for s in (full or open_)}
                open_ -= full or open_
            taken, copies = {}, {}
            for r in after:
                taken[r["source"]] = taken.get(r["source"], 0) + len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
                copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
            for s in sources:
                rate = target[s] / sizes[s]
                largest = max(len((r["text"] or "").split()) for r in before if r["source"] == s)
                assert abs(taken.get(s, 0) - target[s]) <= largest
                assert {copies.get(r["doc_id"], 0) for r in before if r["source"] == s} <= {int(rate), int(rate) + 1}
            continue
        key = lambda r: repr(sorted(r.items(), key=str))
        assert sorted(map(key, after)) == sorted(map(key, want)), name


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    vocab = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(1, 300_000, 97)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = prose(20)
    rows = [(i, prose(120), "en", f"s{i % 3}", 0) for i in range(200)]
    rows += [(300 + i, " ".join(w.upper() + "!!" for w in prose(100).split()), "en", "s0", 0) for i in range(60)]
    rows += [(400, rows[7][1], "en", "s1", 0), (401, rows[8][1] + " " + item + " " + prose(60), "en", "s1", 0), (402, None, "en", None, 0), (403, "", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows[:260]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "quality":
            assert set(range(200)) <= ids and not ids & set(range(300, 360))
        if name == "near_dedup":
            assert 7 in ids and 400 not in ids and set(range(200)) <= ids
        if name == "decontamination":
            text = docs.where("doc_id = 401").first()["text"]
            assert item not in text and text.startswith(rows[8][1])
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == columns
