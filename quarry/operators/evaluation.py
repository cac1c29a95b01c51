"""Retrieval quality: hits against relevant chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The depths at which quality is measured.
DEPTHS = (1, 5, 10, 20)


def judged(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row per query of ``relevant`` (query_id, chunk_id): ranks of its relevant hits, and how many it expects."""
    expected = relevant.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("expected"))
    found = hits.join(relevant.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    return expected.join(found, "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))


def judged_by_class(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """As :func:`judged`, where all other chunks (chunk_id, label) with the query's label (query_id, label) are relevant.

    Relevant chunks are only counted by label, never listed by query; hits look their label up.
    All sides but the counts by label grow with the tables: they are shuffled, and not sent through the driver however
    well their shuffle files compress.
    """
    sizes = chunks.groupBy("label").agg(F.count("*").alias("n"))
    itself = chunks.select(F.col("chunk_id").alias("query_id"), "label").groupBy("query_id", "label").agg(F.count("*").alias("own"))
    expected = queries.join(sizes, "label", "left").join(itself.hint("merge"), ["query_id", "label"], "left").withColumn("expected", F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).filter("expected > 0")
    found = hits.filter("query_id != chunk_id").join(chunks.select("chunk_id", F.col("label").alias("found")).hint("merge"), "chunk_id").join(queries.hint("merge"), "query_id").filter("found = label")
    ranks = found.groupBy("query_id").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    return expected.select("query_id", "expected").join(ranks.hint("merge"), "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))


def metrics(hits: DataFrame, relevant: DataFrame, depths: Sequence[int] = DEPTHS) -> DataFrame:
    """The metrics of :func:`measured` for hits against relevant chunks (query_id, chunk_id)."""
    return measured(judged(hits, relevant), depths)


def measured(each: DataFrame, depths: Sequence[int] = DEPTHS) -> DataFrame:
    """k, hit_rate, precision, recall, ndcg_micro, ndcg_macro, mrr, over all queries with something relevant.

    ndcg_micro divides the sum of all gains by the sum of all ideal ones; mrr reads the
    whole list at every k.
    """
    per = each.withColumn("k", F.explode(F.array(*map(F.lit, depths))))
    top = F.filter("ranks", lambda r: r <= F.col("k"))
    gain = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    ideal = gain(F.sequence(F.lit(1), F.least(F.col("expected").cast("int"), F.col("k"))))
    per = per.withColumns({"n": F.size(top), "dcg": gain(top), "idcg": ideal, "rr": F.coalesce(1 / F.array_min("ranks"), F.lit(0.0))})
    r = lambda c: F.round(c, 6)
    return per.groupBy("k").agg(
        r(F.avg((F.col("n") > 0).cast("double"))).alias("hit_rate"),
        r(F.avg(F.col("n") / F.col("k"))).alias("precision"),
        r(F.avg(F.col("n") / F.col("expected"))).alias("recall"),
        r(F.sum("dcg") / F.sum("idcg")).alias("ndcg_micro"),
        r(F.avg(F.col("dcg") / F.col("idcg"))).alias("ndcg_macro"),
        r(F.avg("rr")).alias("mrr"),
    )


def regression(cases: DataFrame) -> DataFrame:
    """Pass rate, counts and mean latency by category of cases (category, passed, latency_ms, most_ms)."""
    ok = F.col("passed") & (F.col("most_ms").isNull() | (F.col("latency_ms") <= F.col("most_ms")))
    return cases.groupBy("category").agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("passed"), F.round(F.avg(ok.cast("double")), 6).alias("pass_rate"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"))


def details(hits: DataFrame, relevant: DataFrame, shown: int = 10) -> DataFrame:
    """For each query of ``relevant`` (query_id, chunk_id): hit, rank of the first relevant hit (0 if none), and its first hits with their relevance."""
    truth = relevant.select("query_id", "chunk_id").distinct().withColumn("relevant", F.lit(True))
    each = hits.join(truth, ["query_id", "chunk_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    item = F.struct("rank", "chunk_id", "relevant")
    found = each.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.sort_array(F.collect_list(F.when(F.col("rank") <= shown, item))).alias("shown"))
    out = truth.select("query_id").distinct().join(found, "query_id", "left")
    return out.select("query_id", F.col("first").isNotNull().alias("hit"), F.coalesce("first", F.lit(0)).alias("first_rank"), F.coalesce("shown", F.array().cast("array<struct<rank:int,chunk_id:bigint,relevant:boolean>>")).alias("shown"))


def compared(measures: DataFrame, first: str, second: str, draws: int = 1000) -> DataFrame:
    """Two stored runs (query_id, run, value) by query: n, means, difference, wins, losses, and the p-value of a paired permutation test.

    Under the hypothesis that the runs do not differ, each query's difference may as well
    have the other sign. A draw flips signs by a hash of query and draw, so that reruns agree
    whatever the partitions; the p-value is the share of draws, the data being one of them, whose
    sum is as far from 0. Sums are added up by draw before anything is shuffled. Queries
    that only one run has are left out; of repeated values the mean counts.
    """
    side = lambda run, name: measures.filter(F.col("run") == run).groupBy("query_id").agg(F.avg("value").alias(name))
    both = side(first, "a").join(side(second, "b"), "query_id").withColumn("d", F.round(F.col("a") - F.col("b"), 9))
    plain = both.agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_first"), F.round(F.avg("b"), 6).alias("mean_second"), F.round(F.avg("d"), 6).alias("difference"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.abs(F.sum("d")).alias("far"))
    flips = F.substring(F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.col("draw").cast("string"))), 1, 1).isin(*"01234567")
    sums = both.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).groupBy("draw").agg(F.abs(F.sum(F.when(flips, -F.col("d")).otherwise(F.col("d")))).alias("s"))
    # One row against at most ``draws``.
    p = sums.join(F.broadcast(plain.select("far"))).agg(F.round((F.count_if(F.col("s") >= F.col("far") - 1e-9) + 1) / (F.lit(draws) + 1), 6).alias("p_value"))
    return plain.drop("far").join(F.broadcast(p))
