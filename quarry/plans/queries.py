"""The registered queries of the retrieval operators. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import chosen
from quarry.functions.vectors import mock_embedding, mock_hash, with_mock_embedding
from quarry.operators import boundaries, chunking, code_units, evaluation, fusion, late, query, recall, senses, splitters, store
from quarry.operators.vector_index import VectorIndex
from quarry.plans import search
from quarry.sources.files import corpus
from quarry.sources.segments import Change, Segments, work_folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as markdown: every fifth line a heading, each line a paragraph."""
    lines = F.split("content", "\n")
    marked = F.transform(lines, lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    return corpus(spark, sf_dir).withColumn("content", F.array_join(marked, "\n\n"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each benchmark passage: the whole of it."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about what users wrote in conversations, in all forms that the parser knows."""
    # Forms of questions, around two words of the turn.
    forms = ("什么是{a}?", "如何实现{a}系统?首先{a},然后{b}", "比较{a}和{b}的区别", "{a} 为什么报错 {b}", "优化{a}的方法", "关于{a}的所有相关信息", "验证{a}是否正确", "打开{a}然后查找{b}", "{a} {b} function", "{a} 排除 {b}")
    turns = read(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    bare = F.filter(F.split(F.regexp_replace("text", "[^a-zA-Z]+", " "), " "), lambda x: F.length(x) > 2)
    a, b = F.coalesce(F.get(bare, F.lit(0)), F.lit("alpha")), F.coalesce(F.get(bare, F.lit(1)), F.lit("beta"))
    form = lambda f: F.replace(F.replace(F.lit(f), F.lit("{a}"), a), F.lit("{b}"), b)
    n = (F.col("conv_id") + F.col("turn")) % len(forms)
    asked = chosen(((n == i, form(f)) for i, f in enumerate(forms)), F.lit(""))
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), asked.alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "label")


def vector_hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return recall.vector_recall(vectors(spark, sf_dir), vector_queries(spark, sf_dir), k)


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).withColumn("chunk_id", F.col("doc_id"))


def text_hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Documents that hold the passages; their queries stand beside those of the vectors with the same number."""
    asked = text_queries(spark, sf_dir).withColumn("query_id", F.col("query_id") * 50)
    return recall.fulltext_topk(whole_documents(spark, sf_dir), asked, k)


def both_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_hits(spark, sf_dir).unionByName(text_hits(spark, sf_dir))


CHUNK = ("doc_id", "ordinal", "start_pos", "end_pos", "content")
HIT = ("query_id", "chunk_id", "score", "rank")


def chunk_fixed(spark, d):
    return chunking.fixed_size(corpus(spark, d)).select(*CHUNK)


def chunk_sliding(spark, d):
    return chunking.sliding_window(corpus(spark, d)).select(*CHUNK, "section")


def chunk_http(spark, d):
    return chunking.fixed_size(corpus(spark, d), 500, 0).select("doc_id", "ordinal", F.lit(0).alias("start_pos"), F.length("content").alias("end_pos"), "content")


def chunk_markdown(spark, d):
    return chunking.markdown_sections(markdown(spark, d)).select(*CHUNK, "section")


def chunk_recursive(spark, d):
    return chunking.recursive(corpus(spark, d)).select(*CHUNK)


def chunk_semantic(spark, d):
    return boundaries.semantic_chunks(corpus(spark, d)).select(*CHUNK)


def chunk_code(spark, d):
    return splitters.code_units(corpus(spark, d).filter(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*chunking.CODE_EXTENSIONS))).select(*CHUNK)


def code_nested(spark, d):
    """Each document as code: a class of its own, with a method for each line that returns it."""
    quoted = lambda line: F.replace(F.replace(line, F.lit("\\"), F.lit("/")), F.lit('"'), F.lit("'"))
    method = lambda line, i: F.concat(F.lit("  m"), i.cast("string"), F.lit('() {\n    return "'), quoted(line), F.lit('";\n  }\n'))
    body = F.array_join(F.transform(F.split("content", "\n"), method), "")
    code = corpus(spark, d).select("doc_id", F.lit("ts").alias("extension"), F.concat(F.lit("class D"), F.col("doc_id").cast("string"), F.lit(" {\n"), body, F.lit("}\n")).alias("content"))
    return code_units.code_units(code).select("doc_id", "ordinal", "kind", "name", "parent", "start_pos", "end_pos", "content")


def chunk_granularities(spark, d):
    return splitters.multi_granularity(corpus(spark, d)).select("doc_id", "granularity", "parent", "ordinal", "start_pos", "end_pos", "content")


def doc_analysis(spark, d):
    a = chunking.analyze(corpus(spark, d))
    return a.select("doc_id", "doc_type", "language", "structure.*", F.col("density.level").alias("density_level"), *(F.round(f"density.{c}", 6).alias(c) for c in ("avg_sentence_length", "avg_paragraph_length", "technical_term_ratio")), "strategy")


def chunk_enhance(spark, d):
    c = chunking.fixed_size(corpus(spark, d))
    e = chunking.enhance(c, F.regexp_extract("path", r"([^/]+)$", 1))
    return e.select("doc_id", "ordinal", "enhanced", F.array_join("enhancement_types", ",").alias("enhancement_types"))


def chunk_overlap_fixed(spark, d):
    return chunking.overlap(chunking.fixed_size(corpus(spark, d), 500, 0), 50).select(*CHUNK, "overlap")


def chunk_overlap_adaptive(spark, d):
    return chunking.overlap(chunking.fixed_size(corpus(spark, d), 500, 0)).select("doc_id", "ordinal", "start_pos", "overlap")


def validated(spark, d):
    return chunking.validate(chunking.sliding_window(corpus(spark, d)))


def chunk_validate(spark, d):
    return validated(spark, d).select("doc_id", "ordinal", "invalid_reason", "suggestion")


def chunk_repair(spark, d):
    return chunking.repair(validated(spark, d)).select(*CHUNK)


def chunk_stats(spark, d):
    return chunking.chunk_stats(chunking.sliding_window(corpus(spark, d)))


def index_pipeline(spark, d):
    return chunking.index_chunks(corpus(spark, d)).select(*CHUNK)


def mock_embed(spark, d):
    h = corpus(spark, d).withColumn("hash", mock_hash(F.col("content")))
    v = mock_embedding(F.col("hash"), 4)
    return h.select("doc_id", "hash", *(F.round(v[i].cast("double"), 6).alias(f"e{i}") for i in range(4)))


def vector_topk(spark, d):
    return vector_hits(spark, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def index_exact(spark, d):
    """The vector index with all its lists open, and rows ruled out only where its codes prove it."""
    found = VectorIndex(spark, work_folder(spark)).build(vectors(spark, d)).search(vector_queries(spark, d))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def index_probed(spark, d):
    """The vector index with half of its lists open for each query, and the best 200 by their codes scored in full."""
    index = VectorIndex(spark, work_folder(spark)).build(vectors(spark, d))
    found = index.search(vector_queries(spark, d), probes=len(index.model.lists) // 2, shortlist=200)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def index_changes(spark, d):
    """A vector index that grew, took rows in place of others, lost some and was compacted."""
    rows = vectors(spark, d)
    index = VectorIndex(spark, work_folder(spark)).build(rows.filter("chunk_id % 3 <> 0"))
    index.add(rows.filter("chunk_id % 3 = 0"))
    index.add(rows.filter("chunk_id % 5 = 1"))
    index.remove(rows.filter("chunk_id % 7 = 1").select("chunk_id"))
    index.compact()
    return index.search(vector_queries(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def code_topk(spark, d):
    kinds = vectors(spark, d).select("chunk_id", F.when(F.col("chunk_id") % 6 + 1 <= 4, F.when(F.col("chunk_id") % 6 >= 1, F.lit("code"))).alias("kind"))
    return recall.code_recall(vectors(spark, d), kinds, vector_queries(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def tiered(spark, d):
    asked = text_queries(spark, d).withColumn("query_id", F.col("query_id") * 50)
    out = recall.tiered(whole_documents(spark, d), vectors(spark, d), asked, vector_queries(spark, d), fusion.path_rank(("bm25", "vector")))
    words = asked.select("query_id", F.slice(recall.tokens(F.col("query")), 1, 5).alias("keywords"))
    docs = corpus(spark, d).select(F.col("doc_id").alias("chunk_id"), "content", F.col("path").alias("source"))
    best = fusion.rule_rerank(out.filter("rank <= 50").join(docs, "chunk_id").join(words, "query_id"))
    return best.filter("rank <= 20").select("query_id", "chunk_id", "path", F.col("rerank_score").alias("score"), "rank")


def semantic_cache(spark, d):
    """Whether a query that was answered before is near enough: the nearest other vector, at a cosine of .95 or more."""
    q = vector_queries(spark, d)
    best = recall.vector_recall(vectors(spark, d), q, 1)
    return q.select("query_id").join(best.select("query_id", F.col("chunk_id").alias("nearest"), F.round("score", 6).alias("score")), "query_id", "left").withColumn("hit", F.coalesce(F.col("score") > 0.95, F.lit(False)))


def fulltext_topk(spark, d):
    chunks = chunking.fixed_size(corpus(spark, d)).withColumn("chunk_id", F.col("doc_id") * 100_000 + F.col("ordinal"))
    return recall.fulltext_topk(chunks, text_queries(spark, d)).select(*HIT)


def fulltext_short(spark, d):
    """Fragments of the passages, most of them inside a word or around one gap between words."""
    part = F.substring(F.col("query"), (F.col("query_id") % 5 + 1).cast("int"), (F.col("query_id") % 9 + 1).cast("int"))
    return recall.fulltext_topk(whole_documents(spark, d), text_queries(spark, d).withColumn("query", part)).select(*HIT)


def bm25_topk(spark, d):
    return recall.bm25_topk(whole_documents(spark, d), text_queries(spark, d)).select(*HIT)


def recall_merge(spark, d):
    order = fusion.path_rank(("vector", "fulltext"))
    return recall.merge_recalls(both_hits(spark, d), order, 20).select("query_id", "chunk_id", "path", F.round("score", 6).alias("score"), "rank")


def hybrid_concat(spark, d):
    return recall.hybrid_concat(vector_hits(spark, d), text_hits(spark, d)).select("query_id", "chunk_id", "path", "rank")


def six(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", *more)


def hybrid_rrf(spark, d):
    return six(fusion.rrf(both_hits(spark, d), k=10), "sources")


def fuse_weighted(spark, d):
    return six(fusion.weighted_max(both_hits(spark, d), {"vector": 0.8, "fulltext": 0.2}))


def fuse_max(spark, d):
    return six(fusion.max_score(both_hits(spark, d)))


def fuse_weighted_rrf(spark, d):
    return six(fusion.weighted_rrf(both_hits(spark, d), {"vector": 0.3, "fulltext": 0.2}))


def rrf_rerank(spark, d):
    return six(fusion.rrf_rerank(both_hits(spark, d)).withColumn("confidence", F.round("confidence", 6)), "confidence", "reason")


def reranked(spark, d):
    hits = recall.bm25_topk(whole_documents(spark, d), text_queries(spark, d), 20)
    words = text_queries(spark, d).select("query_id", F.slice(recall.tokens(F.col("query")), 1, 5).alias("keywords"))
    docs = corpus(spark, d).select(F.col("doc_id").alias("chunk_id"), "doc_id", "content", F.col("path").alias("source"))
    return fusion.rule_rerank(hits.join(docs, "chunk_id").join(words, "query_id"))


def rule_rerank(spark, d):
    return reranked(spark, d).select("query_id", "chunk_id", *(F.round(c, 6).alias(c) for c in ("exact", "density", "source_quality", "confidence")), "rerank_score", "reason")


def result_filter(spark, d):
    out = fusion.filter_results(reranked(spark, d), min_score=1.0, per_content=True, extensions=("md", "ts", "py", "txt"))
    return out.select("query_id", "chunk_id", "rank")


def query_parse(spark, d):
    p = query.parse(questions(spark, d))
    join = lambda c: F.array_join(c, "|").alias(c)
    return p.select("query_id", "intent", F.round("confidence", 6).alias("confidence"), join("core"), join("related"), join("excluded"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("subject", "action", "object")), "complexity_score", "complexity", join("reasons"), "modality", "language")


def query_route(spark, d):
    r = query.route(query.parse(questions(spark, d)))
    return r.select("query_id", "strategy", "route_reason", "estimate.*")


def query_decompose(spark, d):
    s = query.decompose(query.parse(questions(spark, d)))
    each = s.select("query_id", "fusion", F.posexplode("sub_queries").alias("nth", "s"))
    return each.select("query_id", "fusion", "nth", F.col("s.query").alias("sub_query"), F.col("s.type").alias("type"), F.array_join("s.depends_on", ",").alias("depends_on"), F.round("s.weight", 6).alias("weight"))


def query_expand(spark, d):
    return query.expand(text_queries(spark, d)).select("query_id", "variant", "query")


def path_weights(spark, d):
    return fusion.adaptive_weights(query.parse(questions(spark, d))).select("query_id", *(F.round(f"path_weights.{c}", 6).alias(c) for c in ("vector", "fulltext", "keyword", "semantic", "hyde")))


def eval_metrics(spark, d):
    each = evaluation.judged_by_class(vector_hits(spark, d, 20), vector_queries(spark, d).select("query_id", "label"), vectors(spark, d).select("chunk_id", "label"))
    return evaluation.measured(each)


def stored(spark, d):
    docs = corpus(spark, d)
    return docs.select(F.col("doc_id").alias("id"), "path", "n_chars", (F.col("doc_id") % 7).alias("indexed_at"))


def changed(spark, d):
    docs = corpus(spark, d)
    return docs.filter("doc_id % 3 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 1_000_000).otherwise(0)).alias("id"), "path", (F.col("n_chars") + 1).alias("n_chars"), F.lit(3).cast("long").alias("indexed_at"))


def store_upsert(spark, d):
    return store.upsert(stored(spark, d), changed(spark, d))


def store_delete(spark, d):
    docs = corpus(spark, d).select("doc_id", "path", "n_chars")
    chunks = chunking.fixed_size(corpus(spark, d)).select("doc_id", "ordinal")
    gone = docs.filter(F.col("path").endswith(".json")).select("path")
    _, kept, report = store.delete_by_path(docs, chunks, gone)
    counts = kept.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("state", F.lit("kept"))
    return counts.unionByName(report.select("doc_id", F.col("deleted_chunks").alias("n"), F.lit("deleted").alias("state")))


def store_log(spark, d):
    """Chunks in a table of segments: two parts, a third of the documents anew, deletions by document and by chunk, merged."""
    chunks = chunking.fixed_size(corpus(spark, d)).select("doc_id", (F.col("doc_id") * 100_000 + F.col("ordinal")).alias("chunk_id"), F.lit(0).alias("version"), F.length("content").alias("size"))
    table = Segments(spark, work_folder(spark))
    table.commit(chunks=Change(chunks.filter("doc_id % 2 = 0")))
    table.commit(chunks=Change(chunks.filter("doc_id % 2 = 1")))
    anew = chunks.filter("doc_id % 3 = 0").withColumn("version", F.lit(1))
    table.commit(chunks=Change(anew, {"doc_id": anew.select("doc_id")}))
    table.commit(chunks=Change(gone={"doc_id": chunks.filter("doc_id % 5 = 0").select("doc_id"), "chunk_id": chunks.filter("chunk_id % 100000 = 1").select("chunk_id")}))
    table.compact("chunks", fan=3)
    table.commit(chunks=Change(chunks.filter("doc_id % 10 = 0").withColumn("version", F.lit(2))))
    return table.read("chunks")


def store_stats(spark, d):
    return store.stats(corpus(spark, d), chunking.fixed_size(corpus(spark, d)), "n_chars")


def store_sync(spark, d):
    return store.sync(stored(spark, d), changed(spark, d), "id", "n_chars", "indexed_at", "merge")


def doc_listing(spark, d):
    return store.listing(corpus(spark, d).select("doc_id", "path", "n_chars"), chunking.fixed_size(corpus(spark, d)))


def history_last100(spark, d):
    turns = read(spark, d, "conversations").filter(F.col("role") == "user")
    return store.recent(turns.select("conv_id", "turn", "text", (F.col("conv_id") % 4).alias("client")), F.col("client"), [F.col("conv_id").desc(), F.col("turn").desc()])


def metrics_last100(spark, d):
    e = read(spark, d, "events").select("event_id", "ts", "event_type", "value")
    return store.moving_mean(e, "value", "event_type", ["ts", "event_id"])


def doc_view(spark, d):
    at = F.transform("chunks", lambda c: F.concat_ws("-", c["start_pos"].cast("string"), c["end_pos"].cast("string")))
    return store.view(corpus(spark, d), chunking.fixed_size(corpus(spark, d))).select("doc_id", "path", "preview", F.array_join(at, ",").alias("chunks"))


def store_delta(spark, d):
    return store.pending(stored(spark, d), changed(spark, d), "id", "n_chars", "indexed_at")


def late_interaction(spark, d):
    """Documents by the best matches of a passage's tokens, with test vectors of 16 dimensions for tokens."""
    found = late.late_interaction_topk(whole_documents(spark, d), text_queries(spark, d), lambda t: with_mock_embedding(t, "token", 16))
    return found.select(*HIT)


def semantic_merge(spark, d):
    """The first 20 hits of each passage, documents with like words as one."""
    hits = recall.bm25_topk(whole_documents(spark, d), text_queries(spark, d), 20).join(whole_documents(spark, d).select("chunk_id", "content"), "chunk_id")
    return fusion.semantic_merge(hits).select("query_id", "chunk_id", "score", "rank", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


def feedback_rounds(spark, d):
    return recall.feedback_rounds(whole_documents(spark, d), text_queries(spark, d))


def query_senses(spark, d):
    """Which sense of their words passages mean, by what stands beside these words in all documents."""
    return senses.disambiguated(text_queries(spark, d), whole_documents(spark, d))


def library_search(spark, d):
    """Questions about conversations, answered from the documents in all steps of the library."""
    chunks = corpus(spark, d).select(F.col("doc_id").alias("chunk_id"), "content", F.col("path").alias("source"))
    return search.answer(questions(spark, d), chunks).withColumn("score", F.round("score", 6))


def offline_search(spark, d):
    """Every third query's answer is in the cache already; the others are searched by vector and text."""
    known = vector_hits(spark, d).filter("query_id % 3 = 0").select("query_id", "chunk_id", "score", "rank")
    asked = vector_queries(spark, d).select("query_id").unionByName(text_queries(spark, d).select((F.col("query_id") * 50).alias("query_id"))).distinct()
    return six(recall.offline(known, vector_hits(spark, d, 20), text_hits(spark, d, 20), asked), "sources")


def eval_details(spark, d):
    """Whether BM25 finds the documents that hold a passage, at which rank, and its first hits."""
    docs, asked = whole_documents(spark, d), text_queries(spark, d)
    shown = evaluation.details(recall.bm25_topk(docs, asked), recall.fulltext_topk(docs, asked, 1000))
    line = F.transform("shown", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["chunk_id"].cast("string"), F.when(x["relevant"], "1").otherwise("0")))
    return shown.select("query_id", "hit", "first_rank", F.array_join(line, ",").alias("shown"))


def runs_compared(spark, d):
    """Precision among ten by vector and by code hits, compared query by query."""
    kinds = vectors(spark, d).select("chunk_id", F.when((F.col("chunk_id") % 6).between(1, 3), F.lit("code")).alias("kind"))
    labels = vectors(spark, d).select("chunk_id", F.col("label").alias("found"))

    def precision(hits: DataFrame, run: str) -> DataFrame:
        own = hits.join(labels, "chunk_id").join(vector_queries(spark, d).select("query_id", "label"), "query_id")
        return own.groupBy("query_id").agg(F.avg((F.col("found") == F.col("label")).cast("double")).alias("value")).withColumn("run", F.lit(run))

    runs = precision(vector_hits(spark, d), "vector").unionByName(precision(recall.code_recall(vectors(spark, d), kinds, vector_queries(spark, d)), "code"))
    return evaluation.compared(runs, "vector", "code", 500)


def recall_normalised(spark, d):
    asked = text_queries(spark, d).withColumn("query_id", F.col("query_id") * 50)
    hits = recall.bm25_topk(whole_documents(spark, d), asked, 20).unionByName(recall.vector_recall(vectors(spark, d), vector_queries(spark, d), 20))
    out = recall.merge_recalls(recall.normalised(hits), fusion.path_rank(("bm25", "vector")), 20)
    return out.select("query_id", "chunk_id", "path", "score", "rank")


def fusion_report(spark, d):
    return fusion.fusion_report(both_hits(spark, d))


def result_filter_language(spark, d):
    told = reranked(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang"), "chunk_id")
    out = fusion.filter_results(told, min_score=1.0, per_doc=True, languages=("en", "fr"))
    return out.select("query_id", "chunk_id", "rank")


def multi_condition(spark, d):
    """Two conditions for each passage, the first five tokens and the rest: what meets both, and the weighted sum of each."""
    t = recall.tokens(F.col("query"))
    part = lambda name, words: recall.bm25_topk(whole_documents(spark, d), text_queries(spark, d).withColumn("query", F.array_join(words, " ")), 50).withColumn("condition", F.lit(name))
    hits = part("head", F.slice(t, 1, 5)).unionByName(part("rest", F.slice(t, 6, 1_000_000)))
    both = recall.in_all(hits, 2).withColumnRenamed("score", "both")
    out = recall.weighted_conditions(hits, {"head": 0.3, "rest": 0.7}).join(both, ["query_id", "chunk_id"], "left")
    return out.select("query_id", "chunk_id", F.col("score").alias("weighted"), F.round("both", 9).alias("mean_of_both"))


def query_tfidf(spark, d):
    return query.tfidf(text_queries(spark, d), corpus(spark, d))


def query_vague(spark, d):
    q, n = F.col("query"), F.col("query_id") % 4
    form = chosen(((n == 0, F.concat(F.lit("那个什么"), q)), (n == 1, F.concat(F.lit("好像"), q, F.lit("的样子"))), (n == 2, F.concat(F.lit("类似"), q, F.lit("的")))), q)
    return questions(spark, d).withColumn("query", form).select("query_id", "query", query.vague(F.col("query")).alias("vague"))


def query_budget(spark, d):
    return query.budget(query.parse(questions(spark, d))).select("query_id", "budget.*")


def rate_limit(spark, d):
    out = store.rate_limited(read(spark, d, "events").select("event_type", "ts"), "event_type", 2, "10 minutes")
    return out


def constraint_check(spark, d):
    p = read(spark, d, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), (F.length("html") * 1000).alias("size"))
    return p.select("page_id", store.constraint(F.col("url"), F.col("size")).alias("action"))


def event_health(spark, d):
    c = read(spark, d, "events").groupBy("user_id").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("e"))
    c = c.withColumn("status", F.when(F.col("e") < 0.3, "healthy").when(F.col("e") < 0.9, "degraded").otherwise("unhealthy"))
    return store.health(c)


def span_report(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"), F.col("event_type").alias("status"))
    return store.spans(e)


def cache_stats(spark, d):
    """A cache of one entry for each user and kind of event: a lookup hits if the same came before."""
    e = read(spark, d, "events").select("event_id", "user_id", "event_type")
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return store.cache_rate(e.join(first, ["user_id", "event_type"]).select((F.col("event_id") > F.col("first")).alias("hit")))


def coverage(spark, d):
    hits = recall.bm25_topk(whole_documents(spark, d), text_queries(spark, d), 3)
    parsed = query.parse(text_queries(spark, d)).select("query_id", "core", "related")
    c = query.coverage(hits.join(corpus(spark, d).select(F.col("doc_id").alias("chunk_id"), "content"), "chunk_id").join(parsed, "query_id"))
    return c.select("query_id", F.round("coverage", 6).alias("coverage"), "supplement")


def regression_report(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("category"), (F.col("event_type") != "error").alias("passed"), F.col("value").alias("latency_ms"), F.lit(100.0).alias("most_ms"))
    return evaluation.regression(e)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        hybrid_rrf, chunk_fixed, chunk_sliding, chunk_http, chunk_markdown, chunk_recursive, chunk_semantic, chunk_code, chunk_granularities, doc_analysis, tiered, chunk_enhance, chunk_overlap_fixed,
        chunk_overlap_adaptive, chunk_validate, chunk_repair, chunk_stats, index_pipeline, mock_embed, vector_topk, code_topk, semantic_cache,
        fulltext_topk, bm25_topk, recall_merge, hybrid_concat, fuse_weighted, fuse_max, fuse_weighted_rrf, rrf_rerank, rule_rerank,
        result_filter, query_parse, query_route, query_decompose, query_expand, path_weights, eval_metrics, store_upsert, store_delete,
        store_stats, store_sync, doc_listing, history_last100, metrics_last100, rate_limit, constraint_check, event_health, span_report,
        cache_stats, coverage, regression_report, doc_view, store_delta, recall_normalised, fusion_report, result_filter_language,
        multi_condition, query_tfidf, query_vague, query_budget, index_exact, index_probed, index_changes, fulltext_short, code_nested, store_log,
        late_interaction, semantic_merge, feedback_rounds, library_search, offline_search, eval_details, runs_compared,
        query_senses,
    )
}
