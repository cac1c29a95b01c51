import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import periodic_runs as PR
from quarry.llm.exact_search import exact_topk
from quarry.llm.fill_in_middle import STRIDE, fill_in_middle, restore
from quarry.llm.periodic_runs import collapsed, periodic_runs, runs_of


def brute_runs(w, least, times):
    """Every lag, every maximal stretch, and whether a smaller period holds throughout."""
    n, out = len(w), []
    for q in range(1, n):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            part = w[start:i]
            smaller = any(all(part[k] == part[k - p] for k in range(p, len(part))) for p in range(1, q))
            if len(part) >= max(least, times * q) and not smaller:
                out.append((start, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("many", [-1, 1, 32])
def test_runs_equal_brute_force(monkeypatch, many):
    monkeypatch.setattr(PR, "MANY", many)
    rng = random.Random(many)
    for _ in range(2000):
        n = rng.randrange(0, 70)
        w = [bytes([97 + rng.randrange(rng.choice([1, 2, 3]))]) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least, times in ((6, 4), (6, 2), (2, 2), (9, 3)):
            assert runs_of(w, least, times) == brute_runs(w, least, times)


def test_long_texts_with_many_equal_words_stay_quick():
    assert runs_of([b"a"] * 200_000) == [(0, 200_000, 1)]
    assert runs_of([b"%d" % (i % 10) for i in range(200_000)]) == [(0, 200_000, 10)]
    # One phrase 5,000 times, each time behind another word: every occurrence is a candidate for every later one.
    assert runs_of([x for i in range(5000) for x in (b"w%d" % i, b"a", b"b", b"c", b"d", b"e")]) == []


def test_a_word_goes_only_where_a_run_repeats_it():
    w = b"x y a b a b a b a b z a b".split()
    assert runs_of(w) == [(2, 8, 2)]
    assert collapsed(w, runs_of(w)) == b"x y a b z a b"


def test_runs_of_edge_cases(edges, nothing, make):
    out = periodic_runs(edges.withColumn("runs", F.lit("other")).withColumn("Collapsed", F.lit(1)))
    assert out.columns[-3:] == ["n_words", "runs", "collapsed"] and "kept" in out.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == edges.count()
    for i in (3, 4, 5, 6):
        assert (rows[i]["n_words"], rows[i]["runs"], rows[i]["collapsed"]) == (0, [], "")
    assert rows[2]["collapsed"] == rows[1]["collapsed"]
    # A cycle of 977 words over 30,000.
    assert [tuple(r) for r in rows[10]["runs"]] == [(0, 30_000, 977)] and len(rows[10]["collapsed"].split()) == 977
    # Other white space than the contract's belongs to words.
    text = next(r["text"] for r in edges.collect() if r["doc_id"] == 12)
    assert rows[12]["collapsed"] == " ".join(x.decode() for x in text.encode().split())
    assert periodic_runs(nothing).collect() == []
    ties = periodic_runs(make([(1, "a a a a a a b c c c c c c", "en", "s"), (1, "a a a a a a b c c c c c c", "en", "s")])).collect()
    assert [[tuple(r) for r in t["runs"]] for t in ties] == [[(0, 6, 1), (7, 6, 1)]] * 2
    with pytest.raises(ValueError):
        periodic_runs(edges, times=1)


def expected_middle(key, text):
    text = text or ""
    n = len(text)
    d = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_middle_equals_slices_of_code_points(spark, edges, nothing):
    got = restore(fill_in_middle(edges.withColumn("output", F.lit("other")))).collect()
    assert len(got) == edges.count() and {"kept", "lang"} <= set(got[0].asDict())
    texts = [(r["doc_id"], r["text"]) for r in edges.collect()]
    want = [expected_middle(i, t) for i, t in texts]
    assert [(r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got] == want
    assert [r["restored"] for r in got] == [t or "" for _, t in texts]
    assert restore(fill_in_middle(nothing)).collect() == []


def test_middle_round_trip_of_odd_texts(spark):
    rng = random.Random(3)
    pool = ["a", "<", "P", "S", "M", ">", "é", "🙂", "\n", "\r\n", " ", "$1", "\\", "\x00", " "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 5, 60]))) for _ in range(400)]
    texts += ["🙂" * (STRIDE * 3 + k) for k in (-1, 0, 1)] + ["x" * 300_000, "<P", "<S><", "has <M> in it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    forms = set()
    for r in restore(fill_in_middle(df)).collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == expected_middle(r["doc_id"], texts[r["doc_id"]])
        assert r["restored"] == texts[r["doc_id"]]
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}
    own = restore(fill_in_middle(df, marks=("$1", "\\", "<M>"), plain=0, suffix_first=100), marks=("$1", "\\", "<M>"))
    assert own.filter("restored <> text").count() == 0 and own.filter("form = 'spm'").count() > 50


def test_middle_runs_no_python(edges):
    plan = fill_in_middle(edges)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def brute_topk(rows, k):
    out = []
    for i, q in rows:
        if i % 50:
            continue
        hits = sorted((-int(np.dot(q[:m], v[:m])), j) for j, v in rows if j != i for m in [min(len(q), len(v))])[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(hits, start=1)]
    return sorted(out)


def searched(df, **more):
    return sorted(tuple(r) for r in exact_topk(df, F.col("vec_id") % 50 == 0, **more).collect())


def whole(x):
    return [int(np.floor(256 * float(v))) for v in x]


@pytest.mark.parametrize("lists", [1, 2, 3, 7])
def test_search_equals_brute_force(spark, lists):
    rng = np.random.default_rng(lists)
    v = np.round(rng.normal(size=(400, 7)), 1)
    v[100:160] = v[100]
    v[300:303] = 0
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert searched(df, lists=lists, rows=64, query_rows=3) == brute_topk([(i, whole(x)) for i, x in rows], 5)


def test_all_scores_below_zero_and_all_equal(spark):
    below = spark.createDataFrame([(i, [1.0 + i, 0.0] if i % 50 == 0 else [-1.0, float(i % 3)]) for i in range(120) if i % 50 or i == 50], "vec_id long, embedding array<float>")
    assert searched(below) == brute_topk([(r["vec_id"], whole(r["embedding"])) for r in below.collect()], 5)
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(200)], "vec_id long, embedding array<float>")
    got = searched(same)
    assert [r[2] for r in got if r[0] == 0] == [1, 2, 3, 4, 5] and [r[2] for r in got if r[0] == 50] == [0, 1, 2, 3, 4]


def test_search_edge_cases(spark):
    schema = "vec_id long, embedding array<double>, label int, score string, q long, cls long, list string"
    rows = [(50, [1.0, 0.0]), (100, None), (150, [float("nan"), 1.0]), (200, [1.0, None]), (None, [1.0, 1.0]), (1, [2.0]), (1, [2.0]), (2, []), (3, [float("inf"), 0.0]), (4, [1.0, 1.0, 1.0]), (50, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x", 1, 1, "y") for r in rows], schema)
    got = searched(df)
    # An id with two vectors asks with both, and is no hit of its own.
    assert got == sorted([(50, 1, 1, 131072), (50, 2, 4, 65536), (50, 3, 2, 0), (50, 1, 4, 65536), (50, 2, 1, 0), (50, 3, 2, 0)])
    assert searched(df.limit(0)) == [] and searched(df.filter("vec_id = 2")) == []
    assert searched(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")) == []
    huge = spark.createDataFrame([(0, [1e16]), (1, [1e16])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="may not fit a long"):
        searched(huge)
