"""Recall paths and search modes. Hits have query_id, path, rank, chunk_id, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import vector_topk
from quarry.operators import text_index
from quarry.operators.fusion import rrf
from quarry.operators.text_index import K1, B, tokens

# The score of a full-text hit.
TEXT_SCORE = 0.5


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fulltext_topk(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Chunks (chunk_id, content) that hold the query as a substring, whatever its case; the first k by id.

    A text that holds the query holds its inner tokens whole, so chunks and queries meet
    on the longest of these and are then compared in full. A query without an inner token
    stands, with its longest part, inside one piece (a token or a stretch of white space):
    pieces that hold that part are found by an index of grams over the dictionary of all
    pieces, which grows far slower than the texts. Where the part is the whole query, the first k chunks
    of each such piece are all that is needed; else the pieces meet their chunks like tokens.
    """
    q = queries.select("query_id", F.lower("query").alias("needle")).filter(F.col("needle") != "")
    split = F.split("needle", r"\s+")
    inner = F.slice(split, 2, F.greatest(F.size(split) - 2, F.lit(0)))
    longest = lambda parts: F.array_max(F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.struct(F.length(x).alias("n"), x.alias("token"))))["token"]
    q = q.withColumn("token", longest(inner)).withColumn("part", F.coalesce(longest(split), F.col("needle")))
    body = chunks.select("chunk_id", F.lower("content").alias("body"))
    # Only ids and tokens meet; texts are fetched for those that did.
    held = body.select("chunk_id", F.explode(F.array_distinct(F.split("body", r"\s+"))).alias("token"))
    met = held.join(q.filter("token IS NOT NULL").select("query_id", "token"), "token").select("query_id", "chunk_id")
    hits = met.join(body, "chunk_id").join(q.select("query_id", "needle"), "query_id").filter(F.col("body").contains(F.col("needle"))).select("query_id", "chunk_id")
    short = q.filter("token IS NULL").select("query_id", "needle", "part")
    if short.head(1):
        all_pieces = text_index.written(body.select("chunk_id", F.explode(text_index.pieces(F.col("body"))).alias("piece")))
        # Short queries repeat: each different one is searched once.
        wanted = text_index.written(short.select("needle", "part").distinct())
        found = text_index.written(text_index.pieces_holding(all_pieces.select("piece").distinct(), wanted.select(F.col("needle").alias("query_id"), "part")).withColumnRenamed("query_id", "needle"))
        first = lambda df, key: df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("chunk_id"))).filter(F.col("nth") <= k).drop("nth")
        some = lambda condition: found.join(wanted.filter(condition).select("needle"), "needle", "left_semi")
        # A query that is one part is in a text if it is in a piece: the first k texts of each piece have its first k.
        inside = some("part = needle").join(first(all_pieces.distinct(), "piece"), "piece").select("needle", "chunk_id").distinct()
        around = some("part != needle").join(all_pieces, "piece").select("needle", "chunk_id").distinct().join(body, "chunk_id").filter(F.col("body").contains(F.col("needle"))).select("needle", "chunk_id")
        hits = hits.unionByName(first(inside.unionByName(around), "needle").join(short.select("query_id", "needle"), "needle").select("query_id", "chunk_id"))
    return ranked(hits.withColumn("score", F.lit(TEXT_SCORE)), k).withColumn("path", F.lit("fulltext"))


def vector_recall(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    return vector_topk(vectors, queries, k).withColumn("path", F.lit("vector"))


def code_recall(vectors: DataFrame, kinds: DataFrame, queries: DataFrame, k: int = 10, prefilter: bool = False) -> DataFrame:
    """The best k code chunks among the best 2k; ``prefilter`` searches code chunks alone. ``kinds``: chunk_id, kind."""
    code = kinds.filter(F.col("kind") == "code").select("chunk_id")
    if prefilter:
        return vector_topk(vectors.join(code, "chunk_id", "left_semi"), queries, k).withColumn("path", F.lit("code"))
    wide = vector_topk(vectors, queries, 2 * k).drop("rank")
    return ranked(wide.join(code, "chunk_id", "left_semi"), k).withColumn("path", F.lit("code"))


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 over distinct query tokens; blocks of chunks that cannot reach a query's k-th score are skipped."""
    return ranked(text_index.block_max(chunks, queries, k, k1, b).scored, k).withColumn("path", F.lit("bm25"))


def merge_recalls(hits: DataFrame, path_order: Column, limit: int = 40) -> DataFrame:
    """Hits of all paths, the first seen of each chunk (paths in order, then rank), by score; at most ``limit``."""
    first = Window.partitionBy("query_id", "chunk_id").orderBy(path_order, "rank")
    once = hits.withColumn("nth", F.row_number().over(first)).filter("nth = 1").withColumn("seen", F.struct(path_order.alias("p"), "rank")).drop("nth")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seen")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("seen")


def normalised(hits: DataFrame) -> DataFrame:
    """Scores of each query and path brought to 0..1, so that paths on different scales can be merged; one score alone, or equal ones, are 1."""
    w = Window.partitionBy("query_id", "path")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("score", F.round(F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0), 9))


def hybrid_concat(vector_hits: DataFrame, text_hits: DataFrame, k: int = 10) -> DataFrame:
    """Vector hits, then the full-text hits they lack, cut to k."""
    rest = text_hits.join(vector_hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    both = vector_hits.withColumn("o", F.lit(0)).unionByName(rest.withColumn("o", F.lit(1)))
    order = Window.partitionBy("query_id").orderBy("o", "rank")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("o")


def tiered(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, vector_queries: DataFrame, path_order: Column, fast: int = 200, coarse: int = 100, merged: int = 200) -> DataFrame:
    """Candidates in tiers: BM25 over chunks, cosine over vectors, merged for a reranker that reads the first of them."""
    hits = bm25_topk(chunks, queries, fast).unionByName(vector_recall(vectors, vector_queries, coarse))
    return merge_recalls(hits, path_order, merged)


def above(hits: DataFrame, least: dict[str, float]) -> DataFrame:
    """Hits that reach the least score of their path; paths without one keep all."""
    keep = F.lit(True)
    for path, score in least.items():
        keep = keep & ((F.col("path") != path) | (F.col("score") >= score))
    return hits.filter(keep)


def in_all(hits: DataFrame, n_conditions: int) -> DataFrame:
    """Chunks that every condition of a query found (column ``condition``), with their mean score."""
    met = hits.groupBy("query_id", "chunk_id").agg(F.countDistinct("condition").alias("n"), F.avg("score").alias("score"))
    return met.filter(F.col("n") == n_conditions).drop("n")


def weighted_conditions(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Chunks that any condition of a query found, with the weighted sum of their scores; a condition without a weight counts once."""
    w = F.lit(1.0)
    for name, x in weights.items():
        w = F.when(F.col("condition") == name, F.lit(float(x))).otherwise(w)
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("score") * w), 9).alias("score"))


def feedback_rounds(chunks: DataFrame, queries: DataFrame, k: int = 10, rounds: int = 3, good: float = 0.8, docs: int = 3, terms: int = 5) -> DataFrame:
    """(query_id, chunk_id, round, score, rank): BM25 in rounds, a query growing by terms of its first hits until they are good enough.

    A query leaves once one of its hits holds more than ``good`` of its own tokens. To the
    others the ``terms`` heaviest new tokens of the first ``docs`` hits are added, weighed by
    how often these have them and how rare they are among all chunks. A chunk stays with the
    round that found it first; hits go by round, then rank. The driver only counts rounds:
    queries leave by a filter.
    """
    frequency = text_index.written(chunks.select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("token")).groupBy("token").agg(F.count("*").alias("df")))
    n = chunks.count()
    body = chunks.select("chunk_id", tokens(F.col("content")).alias("t"))
    own = F.array_distinct(tokens(F.col("query")))
    active = text_index.written(queries.select("query_id", own.alias("asked"), F.array_join(own, " ").alias("query")))
    found = None
    for nth in range(1, rounds + 1):
        hits = text_index.written(bm25_topk(chunks, active.select("query_id", "query"), k).select("query_id", "chunk_id", "score", "rank"))
        this = hits.withColumn("round", F.lit(nth))
        found = this if found is None else found.unionByName(this)
        if nth == rounds:
            break
        seen = hits.join(body, "chunk_id").join(active, "query_id")
        held = F.size(F.array_intersect("asked", F.array_distinct("t"))) / F.size("asked")
        done = seen.groupBy("query_id").agg(F.max(held).alias("held")).filter(F.col("held") > good)
        tf = seen.filter(F.col("rank") <= docs).join(done, "query_id", "left_anti").select("query_id", "query", F.explode("t").alias("token")).filter(~F.array_contains(tokens(F.col("query")), F.col("token"))).groupBy("query_id", "token").agg(F.count("*").alias("tf"))
        weight = F.round(F.col("tf") * (F.ln((F.lit(n) + 1) / (F.col("df") + 1)) + 1), 6)
        heaviest = Window.partitionBy("query_id").orderBy(F.col("weight").desc(), "token")
        best = tf.join(frequency, "token").withColumn("weight", weight).withColumn("nth", F.row_number().over(heaviest)).filter(F.col("nth") <= terms)
        more = best.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("token")), " ").alias("more"))
        # Without new terms another round would find the same.
        active = text_index.written(active.join(more, "query_id").select("query_id", "asked", F.concat_ws(" ", "query", "more").alias("query")))
        if not active.head(1):
            break
    first = found.groupBy("query_id", "chunk_id").agg(F.min(F.struct("round", "rank", "score")).alias("x"))
    order = Window.partitionBy("query_id").orderBy("x.round", "x.rank")
    return first.select("query_id", "chunk_id", "x.round", "x.score", F.row_number().over(order).alias("rank"))


def offline(cached: DataFrame, vector_hits: DataFrame, text_hits: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Hits of a cache (query_id, chunk_id, score, rank) for the queries it knows; vector and text hits, fused, for the others alone."""
    missed = queries.select("query_id").join(cached.select("query_id").distinct(), "query_id", "left_anti")
    both = vector_hits.unionByName(text_hits).join(missed, "query_id", "left_semi")
    from_cache = cached.filter(F.col("rank") <= k).withColumn("sources", F.lit("cache"))
    return from_cache.select("query_id", "chunk_id", "score", "rank", "sources").unionByName(rrf(both, k=k).select("query_id", "chunk_id", "score", "rank", "sources"))
