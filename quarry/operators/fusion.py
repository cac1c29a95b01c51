"""Rank fusion, reranking and result filters over hits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import chosen

# The constant of reciprocal ranks; weights, limits and texts of the rule-based reranker.
RRF_K = 60
EXACT, DENSITY, FRESH, SOURCE = 2.0, 0.5, 0.1, 0.3
REASONS = (("exact", 0.8, "关键词高度匹配"), ("density", 0.5, "关键词密度高"), ("source_quality", 0.8, "来源质量高"))
NO_REASON = "相关性一般"


def path_rank(paths: tuple[str, ...]) -> Column:
    """The place of each hit's path in the given order."""
    return chosen(((F.col("path") == p, F.lit(i)) for i, p in enumerate(paths)), F.lit(len(paths)))


def fused(hits: DataFrame, score: Column, paths: tuple[str, ...], k: int | None) -> DataFrame:
    """One row for each query and chunk, by score, then by where it was first seen."""
    seen = F.struct(path_rank(paths).alias("p"), F.col("rank").alias("r"))
    out = hits.withColumn("seen", seen).groupBy("query_id", "chunk_id").agg(F.round(score, 9).alias("score"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("sources"), F.min("seen").alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seen", "chunk_id")
    out = out.withColumn("rank", F.row_number().over(order)).drop("seen")
    return out if k is None else out.filter(F.col("rank") <= k)


def rrf(hits: DataFrame, paths: tuple[str, ...] = ("vector", "fulltext"), k: int | None = None, constant: int = RRF_K) -> DataFrame:
    return fused(hits, F.sum(1 / (constant + F.col("rank"))), paths, k)


def weighted_rrf(hits: DataFrame, weights: dict[str, float], k: int | None = 30, constant: int = RRF_K) -> DataFrame:
    w = chosen(((F.col("path") == p, F.lit(float(x))) for p, x in weights.items()), F.lit(1.0))
    return fused(hits, F.sum(w / (constant + F.col("rank"))), tuple(weights), k)


def weighted_max(hits: DataFrame, weights: dict[str, float], k: int | None = None) -> DataFrame:
    """The largest weighted score of a chunk; a path without a weight counts once."""
    w = chosen(((F.col("path") == p, F.lit(float(x))) for p, x in weights.items()), F.lit(1.0))
    return fused(hits, F.max(F.col("score") * w), tuple(weights), k)


def max_score(hits: DataFrame, paths: tuple[str, ...] = ("vector", "fulltext"), k: int | None = None) -> DataFrame:
    return fused(hits, F.max("score"), paths, k)


def fuse(hits: DataFrame, method: str = "rrf", weights: dict[str, float] | None = None, k: int | None = None) -> DataFrame:
    """By name; a name that is not known is rrf."""
    if method == "weighted":
        return weighted_max(hits, weights or {}, k)
    if method == "max":
        return max_score(hits, k=k)
    return rrf(hits, k=k)


def fusion_report(hits: DataFrame, constant: int = RRF_K) -> DataFrame:
    """For each query: lists that were fused by reciprocal ranks, duplicates that went, mean score before and after."""
    each = hits.groupBy("query_id", "chunk_id").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.collect_set("path").alias("paths"), F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("s"))
    n = F.sum("n")
    return each.groupBy("query_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("lists"),
        (n - F.count("*")).alias("duplicates"),
        F.round(F.sum("total") / n, 6).alias("mean_before"),
        F.round(F.avg("s"), 6).alias("mean_after"),
    )


def first_linked(ranks: list[int], edges: list[tuple[int, int]]) -> list[int]:
    """For each of some ranks the least one that its links reach."""
    top = {r: r for r in ranks}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y in edges:
        a, b = sorted((find(x), find(y)))
        top[b] = a
    return [find(r) for r in ranks]


def semantic_merge(hits: DataFrame, similar: float = 0.8) -> DataFrame:
    """Hits (query_id, chunk_id, score, rank, content) of a query with like contents as one: the first of them, with its members by rank.

    Two contents are alike if their sets of words are, by Jaccard, and so are those that are
    linked by others. Hits of a query meet on the words they share; only links come
    together for the components, so lists must be cut to a bounded number of hits before.
    Contents without words are like each other.
    """
    split = F.array_distinct(F.filter(F.split(F.lower("content"), r"\s+"), lambda x: x != ""))
    words = F.when(F.size(split) > 0, split).otherwise(F.array(F.lit("")))
    each = hits.select("query_id", "rank", words.alias("words")).select("query_id", "rank", F.size("words").alias("n"), F.explode("words").alias("word"))
    other = each.select("query_id", F.col("rank").alias("y"), F.col("n").alias("m"), "word")
    common = each.join(other, ["query_id", "word"]).filter(F.col("rank") < F.col("y")).groupBy("query_id", "rank", "y", "n", "m").agg(F.count("*").alias("c"))
    links = common.filter(F.col("c") / (F.col("n") + F.col("m") - F.col("c")) >= similar).groupBy("query_id").agg(F.collect_list(F.struct(F.col("rank").alias("x"), "y")).alias("links"))

    @F.pandas_udf("array<int>")
    def groups(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ranks, edges in batches:
            yield pd.Series([first_linked(list(r), [] if e is None else [(x["x"], x["y"]) for x in e]) for r, e in zip(ranks, edges, strict=True)])

    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("h"))
    told = listed.join(links, "query_id", "left").select("query_id", "h", groups(F.col("h.rank"), F.col("links")).alias("group"))
    rows = told.select("query_id", F.explode(F.arrays_zip("h", "group")).alias("x")).select("query_id", "x.group", "x.h.*")
    merged = rows.groupBy("query_id", "group").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("m"), F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("group")
    return merged.select("query_id", F.col("m")[0]["chunk_id"].alias("chunk_id"), "score", F.row_number().over(order).alias("rank"), F.col("m.chunk_id").alias("members"))


def rule_rerank(hits: DataFrame) -> DataFrame:
    """Rule scores of hits with content, source and keywords; .3 of the score they had, .7 of the rules'."""
    body = F.lower("content")
    n_words = F.greatest(F.size("keywords"), F.lit(1))
    exact = F.size(F.filter("keywords", lambda w: body.contains(F.lower(w)))) / n_words
    times = lambda w: (F.length(body) - F.length(F.replace(body, F.lower(w), F.lit("")))) / F.length(w)
    counted = F.aggregate(F.filter("keywords", lambda w: w != ""), F.lit(0.0), lambda a, w: a + times(w))
    density = F.least(F.lit(1.0), counted / F.greatest(F.length("content") / 100, F.lit(1.0)))
    quality = chosen(((F.col("source").rlike(r"\.(md|ts)$"), F.lit(0.9)), (F.col("source").rlike(r"\.(js|py)$"), F.lit(0.85)), (F.col("source").endswith(".json"), F.lit(0.7))), F.lit(0.8))
    out = hits.withColumn("exact", exact).withColumn("density", density).withColumn("source_quality", quality)
    rule = EXACT * F.col("exact") + DENSITY * F.col("density") + FRESH + SOURCE * F.col("source_quality")
    out = out.withColumn("rerank_score", F.round(0.3 * F.col("score") + 0.7 * rule, 9)).withColumn("confidence", F.least(F.lit(1.0), F.col("rerank_score") / 3))
    why = F.concat_ws("，", *(F.when(F.col(c) > least, F.lit(text)) for c, least, text in REASONS))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank", "chunk_id")
    return out.withColumn("reason", F.coalesce(F.nullif(why, F.lit("")), F.lit(NO_REASON))).withColumn("rank", F.row_number().over(order))


def rrf_rerank(hits: DataFrame, paths: tuple[str, ...] = ("vector", "fulltext"), k: int | None = None) -> DataFrame:
    out = rrf(hits, paths, k)
    return out.withColumn("confidence", F.least(F.lit(1.0), 10 * F.col("score"))).withColumn("reason", F.concat(F.lit("RRF排名 #"), F.col("rank").cast("string")))


def filter_results(hits: DataFrame, min_score: float | None = None, per_doc: bool = False, per_content: bool = False, extensions: tuple[str, ...] = (), languages: tuple[str, ...] = (), max_age: float | None = None, rules: tuple[Column, ...] = ()) -> DataFrame:
    """Drop by score, extension, language (column ``lang``), age (column ``age_days``) and own rules; then keep the first of each document, or of each content."""
    extension = F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1))
    tests = (
        None if min_score is None else F.col("score") >= min_score,
        extension.isin(*extensions) if extensions else None,
        F.col("lang").isin(*languages) if languages else None,
        None if max_age is None else F.col("age_days") <= max_age,
    )
    for keep in (*tests, *rules):
        hits = hits if keep is None else hits.filter(keep)
    for on, key in ((per_doc, F.col("doc_id")), (per_content, F.sha2("content", 256)) if per_content else (False, None)):
        if on:
            first = Window.partitionBy("query_id", key).orderBy("rank", "chunk_id")
            hits = hits.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    order = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order))


def adaptive_weights(parsed: DataFrame) -> DataFrame:
    """Weights of the five recall paths by the shape of the query, adding up to 1."""
    w = {
        "vector": F.when(F.col("modality") == "code", 0.4).otherwise(0.3),
        "fulltext": F.when(F.size("core") > 3, 0.3).otherwise(0.2),
        "keyword": F.lit(0.2),
        "semantic": chosen(((F.col("complexity_score") > 6, F.lit(0.25)), (F.col("intent") == "definition", F.lit(0.4))), F.lit(0.2)),
        "hyde": F.when(F.col("complexity_score") > 6, 0.25).otherwise(0.1),
    }
    total = sum(w.values(), F.lit(0.0))
    return parsed.withColumn("path_weights", F.struct(*(F.round(x / total, 9).alias(k) for k, x in w.items())))


def with_freshness(hits: DataFrame, age_days: Column, authority: Column, decay: float = 0.1, weight: float = 0.1) -> DataFrame:
    """Rerank scores with a share for how recent (exponential decay by age) and how trusted a source is."""
    fresh = F.exp(-decay * F.greatest(age_days, F.lit(0)))
    score = (1 - 2 * weight) * F.col("rerank_score") + weight * fresh + weight * authority
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "chunk_id")
    return hits.withColumn("rerank_score", F.round(score, 9)).withColumn("rank", F.row_number().over(order))
