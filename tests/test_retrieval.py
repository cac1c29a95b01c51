import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.vectors import embed, text_hash, vector_topk, with_mock_embedding
from quarry.operators import chunking, evaluation, fusion, query, recall, splitters, store
from quarry.plans.config import Config
from quarry.plans.engine import Engine
from quarry.plans.plugins import Plugin, Registry
from quarry.sources.files import read_folder

DOC = "doc_id long, path string, content string"


def docs(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows, start=1)], DOC)


def test_document_types_and_strategies(spark):
    d = docs(
        spark,
        ("/test.md", "# Title\n\n## Section 1\n\nContent here."),
        ("/a.ts", 'function hello() { return "world"; }'),
        ("/x.bin", '{"a": 1}'),
        ("/y.bin", "<!doctype html><p>"),
        ("/z.bin", "Plain words. And more."),
        ("/h.md", "## First\ntext"),
    )
    r = {x["doc_id"]: x for x in chunking.analyze(d).collect()}
    assert [r[k]["doc_type"] for k in range(1, 7)] == ["markdown", "code", "json", "html", "text", "markdown"]
    assert r[2]["strategy"] == "ast-based" and r[2]["language"] == "javascript"
    # Without multiline the patterns only look at the start of the document.
    assert not r[1]["structure"]["has_sections"] and r[6]["structure"]["has_sections"] and r[6]["strategy"] == "markdown-section"
    multi = {x["doc_id"]: x for x in chunking.analyze(d, multiline=True).collect()}
    assert multi[1]["structure"]["has_sections"]
    assert r[5]["density"]["avg_sentence_length"] == pytest.approx((12 + 9) / 2)


def test_fixed_chunks_cover_the_text(spark):
    content = "".join(chr(97 + k % 26) for k in range(1234))
    d = docs(spark, ("/a", content), ("/b", ""), ("/c", "short"))
    c = chunking.fixed_size(d, 500, 50).orderBy("doc_id", "ordinal").collect()
    own = [x for x in c if x["doc_id"] == 1]
    assert [x["start_pos"] for x in own] == [0, 450, 900]
    assert own[0]["content"] + "".join(x["content"][50:] for x in own[1:]) == content
    assert [x["doc_id"] for x in c if x["doc_id"] > 1] == [3]
    w = chunking.sliding_window(d, 500, 100).filter("doc_id = 1").orderBy("ordinal").collect()
    assert [x["start_pos"] for x in w] == [0, 400, 800, 1200] and w[3]["section"] == "window-3"
    assert all(content[x["start_pos"] : x["end_pos"]] == x["content"] for x in (*own, *w))
    with pytest.raises(ValueError):
        chunking.fixed_size(d, 10, 10)


@pytest.mark.parametrize("content", ["", "a b c", "x" * 130, "one. two. three. " * 20, "p1 " * 10 + "\n\n" + "y" * 200 + "\n\n" + "p3 word " * 9, "a\nb\n" * 60, "q. " + "z" * 61 + ". r"])
def test_recursive_split(content):
    parts = chunking.split_recursively(content, 60, 10)
    assert all(0 < len(t) <= 60 for _, t in parts)
    assert all(content[s : s + len(t)] == t for s, t in parts)
    covered = set()
    for s, t in parts:
        covered.update(range(s, s + len(t)))
    assert all(content[k] in "\n. " for k in set(range(len(content))) - covered)


def test_markdown_sections(spark):
    long = "w. " * 900
    d = docs(spark, ("/a.md", f"intro\n# One\ntext\n## Two\n{long}\n### Three\nend"))
    c = chunking.markdown_sections(d).orderBy("ordinal").collect()
    content = d.first()["content"]
    assert [x["section"] for x in c if x["section"]] == ["One", "Three"]
    assert c[0]["content"] == "intro\n" and len(c) > 5
    assert all(content[x["start_pos"] : x["end_pos"]] == x["content"] and len(x["content"]) <= 2000 for x in c)
    assert [x["ordinal"] for x in c] == list(range(len(c)))


CHUNK = "doc_id long, ordinal int, start_pos int, end_pos int, content string"


def chunks(spark, *contents):
    return spark.createDataFrame([(1, k, 100 * k, 100 * k + len(c), c) for k, c in enumerate(contents)], CHUNK)


def test_sides_that_grow_are_not_broadcast(spark):
    rows = spark.createDataFrame([(k, [float(k % 7), 1.0], k % 3) for k in range(60)], "chunk_id long, embedding array<float>, label int")
    asked = rows.filter("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id")
    hits = vector_topk(rows, asked, 4, block=3)
    assert hits.count() == 48
    each = evaluation.judged_by_class(hits, asked.select("query_id", "label"), rows.select("chunk_id", "label"))
    assert len(each.collect()) == 12
    # One table may be sent to all: the counts by label.
    assert each._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("BroadcastExchange") <= 1


def test_last_sentence_ends_with_the_text(spark):
    # A line break after the last sentence end is what follows it; characters beyond 16 bits count as one.
    texts = ["One. Two.\n", "One. Two.\r\n", "One. Two", "\U0001f600\U0001f600 a. bc", "a.\n\n"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r["s"] for r in d.select("k", chunking.last_sentence(F.col("t")).alias("s")).orderBy("k").collect()]
    assert got == ["\n", "\r\n", " Two", " bc", "\n\n"]


def test_enhance_and_overlap(spark):
    c = chunks(spark, "First chunk.", "Second one. tail", "Third")
    e = chunking.enhance(c, F.lit("Test Title"), keywords=F.array(F.lit("k1"), F.lit("k2"))).orderBy("ordinal").collect()
    assert e[1]["enhanced"] == "[关键词: k1, k2]\n[前文] ...First chunk.\n【Test Title】\nSecond one. tail\n[后文] Third..."
    assert e[0]["enhancement_types"] == ["title-prefix", "context-window", "keyword-injection"]
    o = chunking.overlap(c, 4).orderBy("ordinal").collect()
    assert [x["content"] for x in o] == ["First chunk.", "unk.Second one. tail", "tailThird"]
    assert [x["start_pos"] for x in o] == [0, 96, 196]
    swapped = chunking.overlap(c, 4, compat=True).orderBy("ordinal").collect()
    assert swapped[1]["content"] == "tailSecond one. tail"
    assert [x["content"] for x in chunking.overlap(c, 0).orderBy("ordinal").collect()] == ["First chunk.", "Second one. tail", "Third"]


def test_validate_and_repair(spark):
    good = "This chunk is long enough to be valid and has words in it, see."
    c = chunks(spark, "Too short", good, good, "?! " * 30, "tiny tail", good + " Other text, another ending entirely, so it differs")
    v = chunking.validate(c, code=F.lit(False)).orderBy("ordinal").collect()
    assert [x["invalid_reason"] for x in v] == ["too-small", None, "duplicate", "low-quality", "too-small", None]
    assert v[0]["suggestion"] == "合并到相邻分块"
    r = chunking.repair(chunking.validate(c)).orderBy("ordinal").collect()
    assert len(r) == 2 and r[0]["content"] == good and r[1]["content"].endswith("differs\nToo short\ntiny tail")
    only = chunking.repair(chunking.validate(chunks(spark, "a", "b"))).collect()
    assert [x["content"] for x in only] == ["a\nb"]
    code = chunking.validate(chunks(spark, "function f() { return (1; } and some more words to be long"), code=F.lit(True)).first()
    assert code["invalid_reason"] == "incomplete"
    s = chunking.chunk_stats(chunks(spark, "a", "bb", "cccc", "dddddddd")).first()
    assert tuple(s) == (1, 4, 4, 1, 8, 4)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_query_understanding(spark):
    q = asked(spark, "什么是ANN?", "如何实现ANN系统?", "比较向量检索和全文检索的区别", "function hello() 的作用是什么?", "打开文件然后查找内容", "", "如何实现{A}首先安装然后配置如果失败或者出错因此重试")
    p = query.parse(q)
    r = {x["query_id"]: x for x in p.collect()}
    assert [r[k]["intent"] for k in range(6)] == ["definition", "how-to", "comparison", "general", "multi-hop", "general"]
    assert r[3]["modality"] == "code" and r[2]["core"] == [] and r[5]["language"] == "en"
    assert r[0]["confidence"] == pytest.approx(0.65)
    routes = {x["query_id"]: x["strategy"] for x in query.route(p).collect()}
    assert [routes[k] for k in range(5)] == ["single-hop", "single-hop", "multi-hop", "single-hop", "decomposition"]
    d = {x["query_id"]: x for x in query.decompose(p).collect()}
    assert [s["query"] for s in d[4]["sub_queries"]] == ["打开文件", "查找内容"] and d[4]["fusion"] == "sequential"
    assert d[4]["sub_queries"][1]["depends_on"] == ["q1"]
    assert [s["weight"] for s in d[2]["sub_queries"]] in ([0.4, 0.4, 0.6], [])
    assert len(d[0]["sub_queries"]) == 1
    with_conditions = p.withColumn("intent", F.lit("debug")).withColumn("conditions", F.array(F.lit("x")))
    assert {x["strategy"] for x in query.route(with_conditions.filter("complexity_score <= 6")).collect()} == {"step-back"}
    e = query.expand(asked(spark, "the document")).orderBy("variant").collect()
    assert {x["query"] for x in e} == {"the document", "this document", "that document", "the file", "the text"}


HITS = "query_id long, path string, rank int, chunk_id long, score double"


def hits(spark):
    return spark.createDataFrame([(1, "vector", 1, 1, 0.9), (1, "vector", 2, 2, 0.8), (1, "fulltext", 1, 2, 0.7), (1, "fulltext", 2, 3, 0.6)], HITS)


def test_merge_and_fusion(spark):
    m = recall.merge_recalls(hits(spark), fusion.path_rank(("vector", "fulltext"))).orderBy("rank").collect()
    assert [(x["chunk_id"], x["score"]) for x in m] == [(1, 0.9), (2, 0.8), (3, 0.6)]
    r = fusion.rrf(hits(spark)).orderBy("rank").collect()
    assert [x["chunk_id"] for x in r] == [2, 1, 3] and r[0]["score"] == pytest.approx(1 / 61 + 1 / 62)
    assert r[0]["sources"] == "fulltext,vector"
    both = spark.createDataFrame([(1, "vector", 1, 1, 0.8), (1, "fulltext", 1, 1, 0.6)], HITS)
    assert fusion.weighted_max(both, {"vector": 0.8, "fulltext": 0.2}).first()["score"] == pytest.approx(0.64)
    assert fusion.fuse(hits(spark), "max").orderBy("rank").first()["score"] == 0.9
    assert fusion.fuse(hits(spark), "who knows").count() == 3
    rr = fusion.rrf_rerank(hits(spark)).orderBy("rank").first()
    assert rr["reason"] == "RRF排名 #1" and rr["confidence"] == pytest.approx(10 * (1 / 61 + 1 / 62))
    v, t = hits(spark).filter("path = 'vector'"), hits(spark).filter("path = 'fulltext'")
    assert [x["chunk_id"] for x in recall.hybrid_concat(v, t, 2).orderBy("rank").collect()] == [1, 2]


def test_rule_rerank_and_filters(spark):
    rows = [(1, 1, 1, 0.5, "d1", "ANN implementation in ANN (c++) style", "/a.md", ["ANN", "implementation"]), (1, 2, 2, 0.9, "d2", "nothing", "/b.json", ["ANN", "implementation"]), (1, 3, 3, 0.1, "d2", "nothing", "/b.txt", ["ANN", "c++"])]
    h = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, score double, doc_id string, content string, source string, keywords array<string>")
    r = fusion.rule_rerank(h).orderBy("rank").collect()
    assert r[0]["chunk_id"] == 1 and r[0]["exact"] == 1.0 and r[0]["density"] == 1.0
    assert r[0]["rerank_score"] == pytest.approx(0.3 * 0.5 + 0.7 * (2 + 0.5 + 0.1 + 0.3 * 0.9))
    assert r[0]["reason"] == "关键词高度匹配，关键词密度高，来源质量高" and r[1]["reason"] == "相关性一般"
    assert [x["chunk_id"] for x in fusion.filter_results(h, per_doc=True).orderBy("rank").collect()] == [1, 2]
    assert [x["chunk_id"] for x in fusion.filter_results(h, min_score=0.2, extensions=("md",)).collect()] == [1]


def test_vector_and_text_recall(spark):
    v = spark.createDataFrame([(k, [float(k % 3), 1.0, float(k) / 50]) for k in range(40)] + [(99, None)], "chunk_id long, embedding array<float>")
    q = v.filter("chunk_id IN (0, 7, 30)").withColumnRenamed("chunk_id", "query_id")
    whole = vector_topk(v.repartition(5), q, 6).select("query_id", "chunk_id", "rank").collect()
    blocks = vector_topk(v, q, 6, block=1).select("query_id", "chunk_id", "rank").collect()
    assert sorted(whole) == sorted(blocks) and len(whole) == 18
    c = spark.createDataFrame([(1, "Alpha beta gamma delta"), (2, "xalpha BETA gammax"), (3, "beta"), (4, None), (5, "a%b")], "chunk_id long, content string")
    r = recall.fulltext_topk(c, asked(spark, "alpha beta gamma", "eta", "", "%", "nothing here at")).collect()
    assert sorted((x["query_id"], x["chunk_id"]) for x in r) == [(0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (3, 5)]


def test_mock_embedding(spark):
    def java(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    for s in ("", "hello world", "é" * 9000):
        assert text_hash(s) == java(s)
    assert text_hash("hello world") == 1794106052
    e = spark.createDataFrame([("a",)], "t string")
    e = with_mock_embedding(e, "t", 8).first()["embedding"]
    assert len(e) == 8 and all(abs(x) <= 0.5 for x in e)


def test_metrics(spark):
    h = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 2), (2, 22, 3)], "query_id long, chunk_id long, rank int")
    rel = spark.createDataFrame([(1, 11), (1, 99), (2, 20), (2, 22), (3, 5)], "query_id long, chunk_id long")
    m = {x["k"]: x for x in evaluation.metrics(h, rel, (1, 5)).collect()}
    assert m[1]["hit_rate"] == pytest.approx(1 / 3, abs=1e-6) and m[5]["hit_rate"] == pytest.approx(2 / 3, abs=1e-6)
    assert m[5]["precision"] == pytest.approx(3 / 15, abs=1e-6) and m[5]["recall"] == pytest.approx((0.5 + 1) / 3, abs=1e-6)
    assert m[1]["mrr"] == m[5]["mrr"] == pytest.approx((0.5 + 1) / 3, abs=1e-6)


def test_store(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 5)], "id long, v string, indexed_at long")
    b = spark.createDataFrame([(2, "old", 4), (3, "new", 1), (3, "newer", 2)], "id long, v string, indexed_at long")
    assert sorted(map(tuple, store.upsert(a, b).collect())) == [(1, "x", 1), (2, "y", 5), (3, "newer", 2)]
    s = {x["id"]: x for x in store.sync(a, b.filter("v != 'new'"), "id", "v", "indexed_at", "merge").collect()}
    assert s[2]["v"] == "y" and s[2]["conflict"] and s[3]["origin"] == "local"
    assert store.sync(a, b, "id", "v", "indexed_at", "local-wins").filter("id = 2").first()["v"] == "old"
    p = spark.createDataFrame([("/home/user/.env", 1), ("/big.md", 20 << 20), ("/ok.md", 5)], "p string, n long")
    assert [x[0] for x in p.select(store.constraint(F.col("p"), F.col("n"))).collect()] == ["block", "warn", "allow"]
    look = spark.createDataFrame([(True,), (False,)], "hit boolean")
    assert store.cache_rate(look).first()["hit_rate"] == 0.5
    entries = spark.createDataFrame([("a", 5, 1, 10), ("b", 1, 2, 10), ("c", 1, 3, 10), ("d", 9, 4, 1)], "key string, hits int, seq int, expires_at int")
    assert {x["key"] for x in store.cache_victims(entries, F.lit(5), 2).collect()} == {"b", "d"}
    h = spark.createDataFrame([("healthy",), ("degraded",)], "status string")
    assert store.health(h).first()["status"] == "degraded"


def test_config_and_plugins(tmp_path):
    c = Config()
    assert c.set("retrieval.top_k", 3).get("retrieval.top_k") == 3 and c.get("retrieval.top_k") == 10 and c.get("no.such") is None
    (tmp_path / "c.json").write_text('{"chunking": {"size": 99}}')
    loaded = Config.load(str(tmp_path / "c.json"), {"QUARRY_RETRIEVAL_MODE": "vector", "QUARRY_CACHE_TTL_SECONDS": "7"})
    assert (loaded.get("chunking.size"), loaded.get("retrieval.mode"), loaded.get("cache.ttl_seconds")) == (99, "vector", 7)
    r = Registry()
    r.register(Plugin("e", "embedder", "1.0.0", lambda: "made"))
    assert r.start("e") == "made" and r.get("e").status == "running" and len(r.list("embedder")) == 1
    with pytest.raises(ValueError):
        r.register(Plugin("x", "unknown", "1", lambda: None))
    r.register(Plugin("needs", "reranker", "1.0.0", lambda: None, needs=("missing",)))
    with pytest.raises(ValueError):
        r.start("needs")
    assert r.unregister("e") and not r.unregister("e")


def test_engine(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# Alpha\n" + "The quick brown fox jumps over the lazy dog. " * 20)
    (tmp_path / "in" / "sub" / "b.py").write_text("def f():\n    return 'nothing much to see in here, move along please now'\n")
    (tmp_path / "in" / "c.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "in" / "bad.txt").write_bytes(b"abc\xff")
    found = read_folder(spark, str(tmp_path / "in")).orderBy("path").collect()
    assert [x["path"].rsplit("/")[-1] for x in found] == ["a.md", "bad.txt", "b.py"] and found[1]["error"] == "not UTF-8"
    assert len({x["doc_id"] for x in found}) == 3
    d = read_folder(spark, str(tmp_path / "in"))
    settings = Config({"embedding": {"dimension": 16}})
    e = Engine(spark, str(tmp_path / "store"), settings)
    first = e.index(d).first()
    assert first["documents"] == 2 and first["chunks"] >= 2 and (first["indexed"], first["skipped"], first["errors"]) == (2, 0, 1)
    again = Engine(spark, str(tmp_path / "store"), settings).index(d).first()
    assert (again["documents"], again["chunks"]) == (first["documents"], first["chunks"]) and (again["indexed"], again["skipped"], again["errors"]) == (0, 2, 1)
    some = e.documents().first()["doc_id"]
    shown = e.document(some).first()
    assert shown["chunks"] == sorted(shown["chunks"]) and len(shown["chunks"]) == e.chunks_of(some).count()
    one = e.chunks_of(some).first()
    assert e.chunk(one["chunk_id"]).first() == one
    assert {r["doc_id"] for r in e.search(asked(spark, "fox"), "vector", 3, extensions=("md",)).collect()} == {r["doc_id"] for r in d.filter("path LIKE '%.md'").collect()}
    q = asked(spark, "brown fox jumps")
    for mode in ("vector", "fulltext", "code", "hybrid", "hybrid-concat"):
        assert e.search(q, mode, 3).count() <= 3
    assert "fox" in e.search(q, "fulltext", 3).first()["content"]
    with pytest.raises(ValueError):
        e.search(q, "no such mode")
    gone = e.delete(d.filter("path LIKE '%.md'").select("path")).first()
    assert gone["deleted_chunks"] >= 1 and e.status().first()["documents"] == 1
    assert "fox" in e.prompt("search-optimize", query="fox") and len(e.history) == 7


def test_text_functions(spark):
    df = spark.createDataFrame([("A b. C d!\n\nE",)], "t string")
    r = df.select(X.sentences(F.col("t")), X.paragraphs(F.col("t")), X.word_density(F.col("t"))).first()
    assert r[0] == ["A b.", "C d!", "E"] and len(r[1]) == 2 and r[2] == "low"


PROSE = "# One\n" + "The cat sat there. The cat sat here. " * 12 + "\n\n" + "Ships sail far away over seas. " * 40 + "end"


def test_semantic_parts():
    parts = splitters.semantic_parts(PROSE)
    assert "".join(t for _, t in parts) == PROSE
    assert all(PROSE[s : s + len(t)] == t and len(t) <= 1000 for s, t in parts)
    assert any(t.startswith("Ships") for _, t in parts)
    assert splitters.semantic_parts("") == [] and splitters.semantic_parts("short") == [(0, "short")]
    code = "import x\n\ndef f():\n    return 1\n\nclass A:\n    def g(self):\n        pass\n"
    units = splitters.code_parts(code)
    assert [t.split("\n")[0] for _, t in units] == ["import x", "def f():", "class A:"] and "".join(t for _, t in units) == code


def test_granularities(spark):
    d = docs(spark, ("/a", PROSE * 3), ("/b", ""))
    rows = splitters.multi_granularity(d).orderBy("granularity", "ordinal").collect()
    by = {g: [r for r in rows if r["granularity"] == g] for g in ("coarse", "medium", "fine")}
    for own in by.values():
        assert [r["ordinal"] for r in own] == list(range(len(own))) and "".join(r["content"] for r in own) == PROSE * 3
    for child, parent in (("medium", "coarse"), ("fine", "medium")):
        for r in by[child]:
            p = by[parent][r["parent"]]
            assert p["start_pos"] <= r["start_pos"] and r["end_pos"] <= p["end_pos"]


def test_embedder_keeps_rows_apart(spark):
    def make():
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[float(len(t))] for t in texts]

        return model

    rows = embed(docs(spark, ("/a", "abc"), ("/b", "bad"), ("/c", "abcde")), make).orderBy("doc_id").collect()
    assert [(r["embedding"], r["embed_error"]) for r in rows] == [([3.0], None), (None, "no"), ([5.0], None)]


def test_thresholds_and_conditions(spark):
    assert recall.above(hits(spark), {"vector": 0.85}).count() == 3
    c = spark.createDataFrame([(1, 1, "a", 0.4), (1, 1, "b", 0.6), (1, 2, "a", 0.9)], "query_id long, chunk_id long, condition string, score double")
    assert [tuple(r) for r in recall.in_all(c, 2).collect()] == [(1, 1, 0.5)]
    h = spark.createDataFrame([(1, 1, 0.5, 100), (1, 2, 0.5, 0)], "query_id long, chunk_id long, rerank_score double, age int")
    assert fusion.with_freshness(h, F.col("age"), F.lit(0.5)).filter("rank = 1").first()["chunk_id"] == 2


def test_vector_ties_go_to_lesser_ids(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(400)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (1000, [0.0, 2.0])], "query_id long, embedding array<float>")
    out = sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in vector_topk(v, q, 3).collect())
    assert out == [(1, 1, 3, 1.0), (1, 2, 5, 1.0), (1, 3, 7, 1.0), (1000, 1, 0, 1.0), (1000, 2, 2, 1.0), (1000, 3, 4, 1.0)]


def test_filters_by_age_and_language(spark):
    rows = [(1, k, k + 1, 1.0, f"/d/{k}.md", lang, age) for k, (lang, age) in enumerate([("en", 1.0), ("de", 1.0), ("en", 9.0), (None, 1.0), ("fr", None)])]
    h = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, score double, source string, lang string, age_days double")
    kept = lambda **criteria: [r["chunk_id"] for r in fusion.filter_results(h, **criteria).orderBy("rank").collect()]
    assert kept(languages=("en", "fr")) == [0, 2, 4] and kept(max_age=5.0) == [0, 1, 3] and kept(languages=("en",), max_age=5.0) == [0]


def test_pending_since(spark):
    kind = "id long, v long, at long"
    server = spark.createDataFrame([(1, 1, 1), (2, 2, 5), (3, 3, 1), (4, 4, 9)], kind)
    local = spark.createDataFrame([(1, 1, 1), (2, 9, 7), (5, 5, 2), (4, 7, 3)], kind)
    moves = lambda **more: {(r["id"], r["direction"]) for r in store.pending(server, local, "id", "v", "at", **more).collect()}
    assert moves() == {(2, "upload"), (3, "download"), (4, "download"), (5, "upload")}
    assert moves(since=F.lit(4)) == {(2, "upload"), (4, "download")}


def test_scores_on_one_scale(spark):
    h = spark.createDataFrame([(1, 1, "a", 10.0), (1, 2, "a", 30.0), (1, 3, "a", 20.0), (1, 1, "b", 0.5), (2, 1, "a", 7.0)], "query_id long, chunk_id long, path string, score double")
    out = {(r["query_id"], r["path"], r["chunk_id"]): r["score"] for r in recall.normalised(h).collect()}
    assert out == {(1, "a", 1): 0.0, (1, "a", 2): 1.0, (1, "a", 3): 0.5, (1, "b", 1): 1.0, (2, "a", 1): 1.0}
