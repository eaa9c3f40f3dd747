"""Top n, term weights, term counts and site lines against brute force, with dirty input."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexspark.functions.text import tokenize_nostem
from lexspark.llm import salience, site_lines, termstats, topn

RESULTS = "query string, doc_id bigint, score double, part int, g string, position int"


def results(rnd, n=900):
    rows = []
    for _ in range(n):
        q = rnd.choice(["hot"] * 6 + ["a", "b", "ü", "zz", None])
        s = rnd.choice([0.5, 1.0, 2.5, -3.0, 0.0, -0.0, None, float("nan"), float("inf"), float("-inf"), rnd.random()])
        rows.append((q, rnd.choice([None, *range(40)]), s, 1, "x", 2))
    return rows + rows[:50]


def best(rows, n):
    top = defaultdict(dict)
    for q, d, s, *_ in rows:
        if q is not None and d is not None and s is not None and math.isfinite(s):
            top[q][d] = max(s, top[q].get(d, -math.inf))
    return {(q, d, i + 1) for q, ds in top.items() for i, (d, _) in enumerate(sorted(ds.items(), key=lambda x: (-x[1], x[0]))[:n])}


@pytest.mark.parametrize("n,parts", [(1, 7), (3, 2), (10, 16), (100, 5)])
def test_top_n(spark, n, parts):
    rows = results(random.Random(n))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a group has to cross partitions
    try:
        got = topn.top_n_per_group(spark.createDataFrame(rows, RESULTS), "query", "score", "doc_id", n).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {(r.query, r.doc_id, r.position) for r in got} == best(rows, n) and len(got) == len(best(rows, n))


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], RESULTS)
    assert topn.top_n_per_group(df, "query", "score", "doc_id").count() == 0
    df = spark.createDataFrame([(None, None, None, 1, "x", 1)], RESULTS)
    assert topn.top_n_per_group(df, "query", "score", "doc_id").count() == 0


POSTINGS = "segment int, term string, doc_id bigint, tf bigint, salt string, df int, length int"


def postings(rnd, n=600):
    tf = {}
    rows = []
    for _ in range(n):
        t, d = rnd.choice(["hot"] * 5 + ["cold", "Warm ", " warm", "x", None, "ü"] + [f"t{i}" for i in range(30)]), rnd.choice([None, *range(25)])
        key = (t.strip().lower() if t else None, d)
        rows.append((1, t, d, rnd.choice([tf.setdefault(key, rnd.randint(1, 9)), None]), "s", 1, 1))
    return rows + rows[:40]


def pairs_of(rows):
    tf = {}
    for _, t, d, f, *_ in rows:
        if t is not None and d is not None:
            key = (t.strip().lower(), d)
            tf[key] = f if tf.get(key) is None else tf[key]
    return tf


def test_terms(spark):
    rows = postings(random.Random(3))
    tf = pairs_of(rows)
    df = Counter(t for t, _ in tf)
    total = Counter()
    for (t, _), f in tf.items():
        total[t] += f or 0
    frame = spark.createDataFrame(rows, POSTINGS)
    got = {r.term: (r.total_tf, r.df) for r in termstats.term_statistics(frame).collect()}
    assert got == {t: (total[t], df[t]) for t in df}
    n = termstats.page_count(spark.range(25).withColumnRenamed("id", "doc_id"))
    marks = {(r.term, r.mark) for r in termstats.mark_terms(termstats.term_statistics(frame), n).collect()}
    assert marks == {(t, "rare" if k <= 2 else "common") for t, k in df.items() if k <= 2 or k > 7.5}

    length = Counter()
    for (_, d), f in tf.items():
        length[d] += f or 0
    score = {k: math.floor(f / length[k[1]] * math.log10(25 / df[k[0]]) * 1e9 + 0.5) for k, f in tf.items() if f}
    want = {(d, t) for d in length for t, _ in sorted(((t, s) for (t, e), s in score.items() if e == d and s > 0), key=lambda x: (-x[1], x[0]))[:3]}
    assert {(r.doc_id, r.term) for r in salience.distinctive_terms(frame, n).collect()} == want


def test_terms_of_nothing(spark):
    empty = spark.createDataFrame([], POSTINGS)
    n = termstats.page_count(spark.range(0).withColumnRenamed("id", "doc_id"))
    assert termstats.term_statistics(empty).count() == 0 and salience.distinctive_terms(empty, n).count() == 0


TEXTS = [(1, "lamp red lamp red lamp"), (2, "lamp blue"), (3, ""), (4, None), (5, "lamp red lamp"), (5, "lamp red lamp")]


def test_ngrams(spark):
    frame = spark.createDataFrame(TEXTS, "doc bigint, w string")
    got = {tuple(t for t in r[:3] if t): (r.total, r.records) for r in termstats.text_ngrams(frame, "doc", tokenize_nostem("w"), 3).collect()}
    total, docs = Counter(), defaultdict(set)
    for d, t in TEXTS:
        w = (t or "").split()
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                total[tuple(w[i : i + n])] += 1
                docs[tuple(w[i : i + n])].add(d)
    assert got == {g: (total[g], len(docs[g])) for g in total}


def test_stack_over_batches():
    import pyarrow as pa

    # every suffix of a record is one row; the first of a record's rows with a prefix is marked
    rows = sorted([(a, b, d) for a in "zyx" for b in "cba" for d in range(4)], key=lambda r: (-ord(r[0]), -ord(r[1]), r[2]))
    marks = [int(b == "c") for _, b, _ in rows]

    def batches(k):
        for i in range(0, len(rows), k):
            a, b, _ = zip(*rows[i : i + k])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([2] * len(a)), pa.array(marks[i : i + k]), pa.array([1] * len(a))], names=["t1", "t2", "weight", "m1", "m2"])

    for k in (1, 3, 7, 100):
        out = Counter()
        for batch in termstats._stack(2)(batches(k)):
            for r in batch.to_pylist():
                out[(r["t1"], r["t2"], r["total"], r["records"])] += 1
        assert out == Counter({**{(a, None, 24, 4): 1 for a in "xyz"}, **{(a, b, 8, 4): 1 for a in "xyz" for b in "abc"}}), k


def test_graph_of_words(spark):
    frame = spark.createDataFrame([(1, "sun moon sun star"), (2, "sun rain"), (3, None), (4, "")], "doc bigint, w string")
    n = termstats.page_count(spark.range(10).withColumnRenamed("id", "doc_id"))
    got = {(r.doc_id, r.term): r.degree for r in salience.graph_of_words(frame, "doc", tokenize_nostem("w"), n, window=2).collect()}
    assert got == {(1, "sun"): 2, (1, "moon"): 1, (1, "star"): 1, (2, "sun"): 1, (2, "rain"): 1}


PAGES = "doc_id bigint, external_id string, url string, title string, content string, s string, line string"


def test_site_lines(spark):
    rows = []
    for i in range(8):
        rows.append((i, f"e{i}", f"https://WWW.A.example:80/{i}", None, f"Legal  notice {i}\r\n\nown{'x' * i}\n\tlegal NOTICE 9 ", "s", "l"))
    rows += [(20 + i, f"f{i % 4}", "http://b.example/x", None, "Four ids only", "s", "l") for i in range(9)]
    rows += [(40, "g", None, None, "legal notice 1", "s", "l"), (41, "g", "a.example", None, None, "s", "l"), (42, None, "//a.example/y", None, "", "s", "l")]
    got = {(r.doc_id, r.line_no) for r in site_lines.repeated_lines(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {(i, n) for i in range(8) for n in (1, 4)}
    frame = spark.createDataFrame(rows, PAGES)
    clean = {r.doc_id: r.content for r in site_lines.strip_lines(frame, site_lines.repeated_lines(frame)).collect()}
    assert clean[2] == "\nownxx" and clean[41] is None and clean[42] == "" and clean[40] == "legal notice 1" and len(clean) == len(rows)
    assert site_lines.repeated_lines(frame.limit(0)).count() == 0
    ex = site_lines.excess_lines(frame).where("repeated").collect()
    assert len(ex) == 1 and ex[0].docs == 8 and ex[0].significant and ex[0].llr > 0


def test_site_lines_of_pages_without_external_id(spark):
    """Only different external ids count, as in the SQL; the lines of pages without one come out with the others."""
    rows = [(i, f"e{i}" if i < 5 else None, "http://a.example/", None, "five\nnone" if i >= 5 else "five", "", "") for i in range(45)]
    rows += [(50 + i, f"e{i}" if i < 4 else None, "http://b.example/", None, "four", "", "") for i in range(10)]
    rows += [(60 + i, f"doc:{61 + i}" if i < 5 else None, "http://c.example/", None, "like ids", "", "") for i in range(8)]
    got = sorted((r.doc_id, r.line_no) for r in site_lines.repeated_lines(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [(i, 1) for i in range(45)] + [(60 + i, 1) for i in range(8)]


def test_sites(spark):
    urls = {"HTTPS://www.X.example:8080/p": "x.example", "http://u:p@y.example?q": "y.example", "z.example/p": None, "": None, None: None, " http://www.w.example#f": "w.example"}
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(site_lines.site_of("u")).collect()]
    assert got == list(urls.values())


def test_excess_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, f"e{i}", f"http://{rnd.choice('aab')}.example/", None, "\n".join(rnd.sample(["one", "two", "three", f"own words {chr(97 + i % 26)}"], 3)), "", "") for i in range(60)]
    got = sorted((r.docs, r.outside, round(r.llr, 6)) for r in site_lines.excess_lines(spark.createDataFrame(rows, PAGES)).collect())
    site = {i: r[2] for i, r in enumerate(rows)}
    size, held = Counter(site.values()), defaultdict(set)
    for i, r in enumerate(rows):
        for line in r[4].split("\n"):
            held[(site[i], line)].add(i)
    want = []
    for (s, line), docs in held.items():
        a, b = len(docs), sum(len(d) for (o, x), d in held.items() if x == line and o != s)
        n1, n2 = size[s], len(rows) - size[s]
        p = (a + b) / (n1 + n2)
        g = 2 * sum(x * math.log(x / e) for x, e in ((a, n1 * p), (n1 - a, n1 * (1 - p)), (b, n2 * p), (n2 - b, n2 * (1 - p))) if x > 0)
        want.append((a, b, round(g if a * n2 > b * n1 else -g, 6) + 0.0))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want)):
        assert g == pytest.approx(w, abs=1e-5)
