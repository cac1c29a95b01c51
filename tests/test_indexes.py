import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.vectors import vector_topk
from quarry.operators import boundaries, code_units, recall, text_index, vector_index
from quarry.operators.vector_index import Model, VectorIndex, centres_of, nearest
from quarry.plans import queries as Q
from quarry.plans.config import Config
from quarry.plans.engine import Engine
from quarry.sources.segments import Change, Segments

SF = "/root/testdata/sf0.01"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<float>")


def ids(df):
    return {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 32))
    return frame(spark, centres[rng.integers(20, size=3000)] + 0.4 * rng.normal(size=(3000, 32)))


def test_centres_and_codes():
    x = np.random.default_rng(0).normal(size=(500, 12))
    own = nearest(x, x[:40])
    assert (own == ((x[:, None] - x[None, :40]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert len(centres_of(x, 10, 0)) == 10 and len(centres_of(x[:3].repeat(5, axis=0), 10, 0)) == 3
    m = Model.fit(x, 8, 5, 0)
    lists, codes, away = m.encode(x)
    stands = m.lists[lists] + np.concatenate([p[codes[:, k]] for k, p in enumerate(m.parts)], axis=1)
    assert np.allclose(np.linalg.norm(x - stands, axis=1), away) and codes.shape == (500, 5)
    some = lists == lists[0]
    assert np.allclose(m.scores(x[:4], int(lists[0]), codes[some]), x[:4] @ stands[some].T)


def test_index_with_all_lists_is_exact_and_finds_most_with_few(spark, clustered, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i")).build(clustered, n_lists=40, sample=1000)
    asked = clustered.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    want = ids(vector_topk(clustered, asked))
    assert ids(index.search(asked)) == want
    found = ids(index.search(asked, probes=6, shortlist=60))
    assert len({(q, c) for (q, _), (c, _) in found.items()} & {(q, c) for (q, _), (c, _) in want.items()}) >= 0.9 * len(want)
    # Another object on the same root has the same model and rows.
    again = VectorIndex(spark, str(tmp_path / "i"))
    assert (again.size(), again.dimensions) == (3000, 32) and ids(again.search(asked, probes=6, shortlist=60)) == found


def test_given_vectors_are_found_with_half_of_the_lists(spark):
    want, found = ({(r["query_id"], r["chunk_id"]) for r in f(spark, SF).collect()} for f in (Q.vector_topk, Q.index_probed))
    assert len(want & found) >= 0.9 * len(want)


def test_only_opened_lists_are_read(spark, clustered, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i")).build(clustered, n_lists=40)
    one = clustered.filter("chunk_id = 7").withColumnRenamed("chunk_id", "query_id")
    plan = index.search(one, probes=2, shortlist=50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan.replace("\n", " ") or "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    names = {r["list"] for r in index.probes(one, 2).collect()}
    assert len(names) == 2 and {r["list"] for r in index.rows().filter(F.col("list").isin(*names)).select("list").distinct().collect()} <= names


def test_index_changes_touch_only_what_they_bring(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(300, 8))
    index = VectorIndex(spark, str(tmp_path / "i")).build(frame(spark, x[:200]), n_lists=5)
    before = {r["path"] for r in index.store.entries("vectors")}
    index.add(frame(spark, x[200:], 200))
    index.add(frame(spark, -x[:3]))
    index.remove(spark.createDataFrame([(i,) for i in range(250, 260)], "chunk_id long"))
    assert before < {r["path"] for r in index.store.entries("vectors")} and index.size() == 290
    now = np.concatenate([-x[:3], x[3:250], x[260:]])
    left = spark.createDataFrame([(i if i < 250 else i + 10, [float(v) for v in r]) for i, r in enumerate(now)], "chunk_id long, embedding array<float>")
    asked = left.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    assert ids(index.search(asked)) == ids(vector_topk(left, asked))
    with pytest.raises(ValueError):
        VectorIndex(spark, str(tmp_path / "none")).build(frame(spark, x[:1]).limit(0))
    index.drop()
    assert not index.built()


def test_edge_cases_of_the_index(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    index = VectorIndex(spark, str(tmp_path / "i")).build(df)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = ids(index.search(asked, k=3))
    assert got == {(1, 1): (2, 1.0), (1, 2): (3, 0.0), (1, 3): (5, -0.894427191), (9, 1): (1, 0.0), (9, 2): (2, 0.0), (9, 3): (3, 0.0)}


def test_many_queries_need_no_scan_each(spark, clustered):
    asked = clustered.filter("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    few = vector_topk(clustered, asked, 5)
    many = vector_topk(clustered, asked, 5, block=64)
    assert ids(many) == ids(few)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


WORDS = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()


def corpus_of(spark, n, rng, topics=30):
    texts = []
    for i in range(n):
        topic = [f"t{i % topics}w{j}" for j in range(12)]
        texts.append((i, " ".join(rng.choice(topic if rng.random() < 0.5 else WORDS) for _ in range(rng.randrange(5, 80)))))
    return spark.createDataFrame(texts, "chunk_id long, content string"), dict(texts)


def brute_bm25(texts, query, k, k1=1.2, b=0.75):
    terms = {i: t.lower().split() for i, t in texts.items()}
    n, mean = len(terms), sum(map(len, terms.values())) / len(terms)
    out = {}
    for token in set(query.lower().split()):
        df = sum(token in t for t in terms.values())
        for i, t in terms.items():
            if tf := t.count(token):
                out[i] = out.get(i, 0) + np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean))
    return sorted(((round(-s, 6), i) for i, s in out.items()))[:k]


def test_blocks_are_skipped_and_nothing_is_lost(spark):
    docs, texts = corpus_of(spark, 1200, random.Random(2))
    asked = {i: f"t{i}w0 t{i}w1 a b c" for i in range(20)} | {20: "a", 21: "nowhere", 22: "", 23: "A a  a"}
    q = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    search = text_index.block_max(docs, q, 5, block=8)
    assert search.opened.count() < 0.6 * search.bounds.count()
    got = {}
    for r in recall.ranked(search.scored, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
    for i, text in asked.items():
        want = brute_bm25(texts, text, 5)
        have = sorted(got.get(i, []))
        assert [c for _, c, _ in have] == [c for _, c in want] and np.allclose([s for *_, s in have], [-s for s, _ in want], atol=2e-6)


def test_many_queries_in_several_visits(spark, monkeypatch):
    docs, _ = corpus_of(spark, 300, random.Random(4))
    q = spark.createDataFrame([(i, f"t{i % 30}w{i % 7} {WORDS[i % 26]}") for i in range(60)], "query_id long, query string")
    want = ids(recall.bm25_topk(docs, q, 4))
    monkeypatch.setattr(text_index, "QUERIES", 7)
    monkeypatch.setattr(text_index, "GROUP", 2)
    monkeypatch.setattr(text_index, "BLOCK", 8)
    assert ids(recall.bm25_topk(docs, q, 4)) == want and len(want) > 200
    assert recall.bm25_topk(docs, q.limit(0), 4).count() == 0 and recall.bm25_topk(docs.limit(0), q, 4).count() == 0


def test_substrings_by_grams_of_the_dictionary(spark):
    rng = random.Random(8)
    texts = {i: "".join(rng.choice("aabBc é\n\t.") for _ in range(rng.randrange(0, 60))) for i in range(150)}
    texts |= {200: "", 201: "   ", 202: "x\n\ny", 203: "ÀB abcabcabc"}
    docs = spark.createDataFrame(list(texts.items()), "chunk_id long, content string")
    needles = ["a", "ab", "abc", "abcabc", " a", "a ", "b a", " ", "\n", "\n\n", "  ", "é", "cc.b", "zzz", "bc a", "àb", "", "a b c", "ab\tc", "..", "bcb"]
    q = spark.createDataFrame(list(enumerate(needles)), "query_id long, query string")
    df = recall.fulltext_topk(docs, q, 500)
    want = {(i, c) for i, n in enumerate(needles) if n for c, t in texts.items() if n.lower() in t.lower()}
    assert {(r["query_id"], r["chunk_id"]) for r in df.collect()} == want
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def cost(cuts, gain, end, least, target):
    sizes = [b - a for a, b in zip(cuts, [*cuts[1:], end], strict=True)]
    return (sum(max(0, least - s) for s in sizes), round(sum(boundaries.SIZE_WEIGHT * ((s - target) / target) ** 2 for s in sizes) - sum(gain.get(c, 0) for c in cuts), 6))


def test_cuts_are_the_best_of_all(spark):
    rng = random.Random(6)
    for _ in range(300):
        end = rng.randrange(1, 60)
        starts = sorted(rng.sample(range(end), min(end, rng.randrange(0, 9))))
        gain = {s: rng.choice([0.0, 0.5, 0.7, 0.9, round(rng.random(), 3)]) for s in starts if s}
        least, target, most = rng.choice([(3, 8, 12), (5, 5, 9), (1, 10, 60)])
        got = boundaries.best_cuts(list(gain), list(gain.values()), end, least, target, most)
        places = [0]
        for s in [*sorted(gain), end]:
            while s - places[-1] > most:
                places.append(places[-1] + most)
            if s > places[-1]:
                places.append(s)
        inner = places[1:-1]
        choices = [(0, *c) for n in range(len(inner) + 1) for c in itertools.combinations(inner, n)]
        fit = [c for c in choices if all(b - a <= most for a, b in zip(c, [*c[1:], end], strict=True))]
        assert cost(got, gain, end, least, target) == min(cost(c, gain, end, least, target) for c in fit)
    assert boundaries.best_cuts([], [], 0) == []


def test_semantic_boundaries(spark):
    cats, ships = "The cat sat on the mat. The cat saw a cat. " * 6, "Ships sail over the wide sea. Sea ships sail far. " * 6
    text = "# One\n" + cats + ships + "\n\n## Two\n" + cats + "因此" + ships
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "short")], "doc_id long, content string")
    found = {r["start"]: r for r in boundaries.scored_pieces(docs).filter("doc_id = 1 AND score > 0").collect()}
    assert "".join(r["piece"] for r in boundaries.scored_pieces(docs).filter("doc_id = 1").orderBy("nth").collect()) == text
    assert found[text.index("## Two")]["score"] >= boundaries.HEADING and found[text.index("因此")]["score"] >= boundaries.TRANSITION
    assert text.index("Ships") in found and found[text.index("Ships")]["similarity"] < boundaries.SIMILAR
    chunks = boundaries.semantic_chunks(docs, 100, 300, 400).orderBy("doc_id", "ordinal").collect()
    own = [r for r in chunks if r["doc_id"] == 1]
    assert "".join(r["content"] for r in own) == text and all(100 <= len(r["content"]) <= 400 for r in own)
    assert all(text[r["start_pos"] : r["end_pos"]] == r["content"] for r in own)
    assert {text.index("Ships"), text.index("## Two")} <= {r["start_pos"] for r in own}
    assert [(r["doc_id"], r["content"]) for r in chunks if r["doc_id"] > 1] == [(3, "short")]


BRACED = """import x from "y";
// class Not { }
export class A extends B {
  name = "class C {";
  constructor(private a: string) { this.a = `}${a}`; }
  async run(x: number): Promise<void> {
    if (x) { return; }
    const f = (y) => { return y; };
  }
}
interface I { go(): void; }
func (s *S) Serve(w int) error { }
function open() { /* never closed
"""
INDENT = '''"""doc
def no(): pass
"""
import os

@deco
class A(B):
    x = "def f():"

    def one(self,
            a=1):
        # class C:
        return {
1: 2}

    async def two(self):
        def inner():
            pass
        return inner

def last(): pass
'''


def test_code_units(spark):
    docs = spark.createDataFrame([(1, BRACED, "ts"), (2, INDENT, "py"), (3, "", "py"), (4, None, "ts"), (5, "just words", "js")], "doc_id long, content string, extension string")
    rows = code_units.code_units(docs).collect()
    of = lambda i: [(r["kind"], r["name"], r["parent"]) for r in rows if r["doc_id"] == i and r["kind"] != "text"]
    assert of(1) == [("class", "A", -1), ("method", "constructor", 1), ("method", "run", 1), ("function", "f", 3), ("interface", "I", -1), ("function", "Serve", -1), ("function", "open", -1)]
    assert of(2) == [("class", "A", -1), ("method", "one", 1), ("method", "two", 1), ("function", "inner", 3), ("function", "last", -1)]
    assert [(r["kind"], r["content"]) for r in rows if r["doc_id"] > 2] == [("text", "just words")]
    for i, text in ((1, BRACED), (2, INDENT)):
        outer = [r for r in rows if r["doc_id"] == i and r["parent"] == -1]
        assert "".join(r["content"] for r in outer) == text
        assert all(text[r["start_pos"] : r["end_pos"]] == r["content"] for r in rows if r["doc_id"] == i)
    one = next(r for r in rows if r["name"] == "one")
    assert one["content"].endswith("1: 2}\n") and next(r for r in rows if r["name"] == "A" and r["doc_id"] == 2)["content"].startswith("@deco")


def test_segments(spark, tmp_path):
    t = Segments(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    assert t.names() == set()
    t.commit(a=Change(rows((1, "x"), (2, "x"), (3, "x"))), b=Change(rows((9, "b"))))
    t.commit(a=Change(rows((2, "y")), {"k": keys(2)}))
    t.commit(a=Change(gone={"k": keys(3), "v": spark.createDataFrame([("z",)], "v string")}))
    state = lambda: sorted(tuple(r) for r in t.read("a").collect())
    assert state() == [(1, "x"), (2, "y")]
    t.commit(a=Change(rows((3, "z"), (3, "again"))))
    want = [(1, "x"), (2, "y"), (3, "again"), (3, "z")]
    assert state() == want and sorted(tuple(r) for r in Segments(spark, str(tmp_path / "s")).read("a").collect()) == want
    before = len(t.entries("a"))
    assert t.compact("a", fan=2) > 0 and state() == want and len(t.entries("a")) < before
    t.commit(a=Change(gone={"k": keys(1)}))
    assert state() == want[1:]
    while t.compact("a", fan=2):
        pass
    assert state() == want[1:]
    t.drop("a")
    assert t.names() == {"b"}
    t.commit(a=Change(rows((7, "new"))))
    assert state() == [(7, "new")]


def test_engine_changes(spark, tmp_path):
    text = lambda w: f"{w} quick brown foxes jump over lazy dogs near the river. " * 12
    d = lambda *r: spark.createDataFrame(list(r), "doc_id string, path string, content string")
    e = Engine(spark, str(tmp_path / "e"), Config({"embedding": {"dimension": 16}}))
    first = e.index(d(("a", "/a.md", text("one")), ("a", "/b.md", text("two")), ("b", "/c.md", text("three")), ("c", "/d.md", None))).first()
    assert (first["documents"], first["indexed"], first["skipped"], first["repeated"], first["errors"]) == (2, 2, 0, 1, 1)
    # Of two rows with one id the last by path stays, with its own chunks.
    assert {r["path"] for r in e.documents().collect()} == {"/b.md", "/c.md"} and all("two" in r["content"] for r in e.chunks_of("a").collect())
    again = e.index(d(("a", "/a.md", text("one")), ("a", "/b.md", text("two")))).first()
    assert (again["indexed"], again["skipped"], again["repeated"]) == (0, 1, 1)
    e.build_vector_index(n_lists=2)
    paths = {r["path"] for r in e.store.entries("chunks")}
    e.index(d(("e", "/e.md", text("five")), ("b", "/c.md", text("changed"))))
    assert paths < {r["path"] for r in e.store.entries("chunks")}
    other = Engine(spark, str(tmp_path / "e"), e.config)
    assert other.status().first()["documents"] == 3 and all("changed" in r["content"] for r in other.chunks_of("b").collect())
    assert {r["chunk_id"] for r in other.vectors.rows().collect()} == {r["chunk_id"] for r in other.table("chunks").collect()}
    q = spark.createDataFrame([(1, e.chunks_of("e").first()["content"])], "query_id long, query string")
    assert other.search(q, "vector", 3, probes=2).filter("rank = 1").first()["doc_id"] == "e"
    one = e.chunks_of("e").first()["chunk_id"]
    e.delete_chunks(spark.createDataFrame([(one,)], "chunk_id string"))
    assert e.chunk(one).count() == 0 and e.vectors.rows().filter(F.col("chunk_id") == one).count() == 0
    report = {r["path"]: (r["deleted"], r["deleted_chunks"] > 0) for r in e.delete(spark.createDataFrame([("/b.md",), ("/none",)], "path string")).collect()}
    assert report == {"/b.md": (True, True), "/none": (False, False)}
    assert {r["chunk_id"] for r in e.vectors.rows().collect()} == {r["chunk_id"] for r in e.table("chunks").collect()}
    e.drop()
    assert e.store.names() == set()
    assert e.index(d(("a", "/a.md", text("one")))).first()["documents"] == 1


def test_exact_search_sends_on_hits_and_not_candidates(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(500, 12)).astype(np.float32)
    v[100:140] = v[99]  # ties beyond k
    m = vector_index.Model.fit(vector_index.unit(v.astype(float)), 20, 4, 0)
    numbers, codes, away = m.encode(vector_index.unit(v.astype(float)))
    ids, q = np.arange(500)[::-1].copy(), vector_index.unit(v[::25].astype(float))
    found = vector_index.best_uncoded(m, ids[::25], q, np.ones((20, 20), bool), ids, vector_index.unit(v.astype(float)), numbers, codes, away, 5, True)
    assert np.bincount(found[0]).max() == 5 and len(found[0]) == 100 and not (found[0] == found[1]).any()
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "chunk_id long, embedding array<float>")
    asked = df.filter("chunk_id % 25 = 0").withColumnRenamed("chunk_id", "query_id")
    # Several groups of lists, one list in several groups, and several packs of queries.
    monkeypatch.setattr(vector_index, "ROWS", 30)
    monkeypatch.setattr(vector_index, "QUERIES", 6)
    index = vector_index.VectorIndex(spark, str(tmp_path)).build(df, n_lists=20)
    plain = lambda r: sorted(tuple(x) for x in r.select("query_id", "chunk_id", "rank", F.round("score", 6)).collect())
    assert plain(index.search(asked, 5)) == plain(vector_topk(df, asked, 5))
    assert index.search(asked, 5, probes=3).count() == 100


def test_postings_and_packs_are_not_broadcast(spark):
    chunks = spark.createDataFrame([(k, " ".join(f"w{k * j % 31}" for j in range(1, 20 + k % 5))) for k in range(300)], "chunk_id long, content string")
    asked = spark.createDataFrame([(k, f"w{k} w{k + 7} w3") for k in range(20)], "query_id long, query string")
    steps = text_index.block_max(chunks, asked, 5)
    for df in (steps.bounds, steps.scored):
        assert df.collect()
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_short_queries_take_the_first_chunks_of_each_piece(spark, monkeypatch):
    texts = [f"a{chr(98 + k % 5)} x{k} de  la" for k in range(400)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    asked = ["a", "X1", "b x", "  ", "e", "zz", "e  l", " ", "a"] * 3
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    held = []
    holding = text_index.pieces_holding
    monkeypatch.setattr(text_index, "pieces_holding", lambda d, p: held.append(p.count()) or holding(d, p))
    got = {(r["query_id"], r["rank"], r["chunk_id"]) for r in recall.fulltext_topk(chunks, queries, 4).collect()}
    assert got == {(i, n + 1, c) for i, q in enumerate(asked) for n, c in enumerate([c for c, t in enumerate(texts) if q.lower() in t][:4])}
    assert held == [len({q.lower() for q in asked})]  # each different query once
