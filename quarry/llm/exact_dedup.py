"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import all_columns, fresh, normalised, require, saved

SUMMARY = "digest binary, n long"


def shrunk(counts: Counter, counters: int) -> Counter:
    """Misra-Gries reduction: subtract the largest count that finds no place, drop what falls to zero.

    Summaries reduced this way can be added and reduced again; a digest with more
    than rows / (counters + 1) occurrences always survives.
    """
    if len(counts) <= counters:
        return counts
    least = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: v - least for k, v in counts.items() if v > least})


def summarise(counters: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for digest, n in zip(batch["digest"], batch["n"], strict=True):
                held[bytes(digest)] += int(n)
            held = shrunk(held, counters)
        if held:
            yield pd.DataFrame({"digest": list(held), "n": list(held.values())})

    return run


def heavy_candidates(digests: DataFrame, counters: int = 256, fan_in: int = 64) -> list[bytes]:
    """Digests that may make up more than 1 / (counters + 1) of the rows: at most ``counters`` of them.

    One summary for each partition, then a reduction tree of ``fan_in``: no task
    reads more than ``fan_in * counters`` rows of summaries.
    """
    part = F.spark_partition_id().alias("part")
    level = digests.select("digest", F.lit(1).cast("long").alias("n")).mapInPandas(summarise(counters), SUMMARY).select("*", part)
    merge = summarise(counters)
    width = max(1, digests.rdd.getNumPartitions())
    while width > 1:
        width = -(-width // fan_in)
        level = level.withColumn("part", F.col("part") % width).groupBy("part").applyInPandas(lambda key, pdf: pd.concat([pd.DataFrame({"part": [], "digest": [], "n": []}), *(x.assign(part=key[0]) for x in merge(iter([pdf])))])[["part", "digest", "n"]], f"part int, {SUMMARY}")
    return [bytes(r["digest"]) for r in level.select("digest").distinct().limit(counters).collect()]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 256) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space;
    the row with the smallest id stays. A Misra-Gries pass over the SHA-256 digests
    finds at most ``counters`` frequent ones; those that an exact count confirms
    (more than rows / (counters + 1)) are broadcast and their rows decided where they
    lie. All other digests are shuffled: summed up by digest, and the sums joined back.

    Edge cases: null text counts as empty, and all empty texts form one group; a null
    id sorts last within its group; of rows that repeat the same id and text exactly
    one is kept; an empty table gives an empty result; other columns are ignored.
    """
    require(docs, (id_col, text_col))
    spark = docs.sparkSession
    hashed = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))
    hashed = saved(hashed.withColumn("row", F.monotonically_increasing_id()))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    found = heavy_candidates(hashed, counters)
    candidates = F.broadcast(spark.createDataFrame([(x,) for x in found], "digest binary"))
    least = hashed.count() / (counters + 1)
    winners = hashed.join(candidates, "digest", "left_semi").groupBy("digest").agg(F.min(rank).alias("keep"), F.count("*").alias("group_size")).filter(F.col("group_size") > least)
    # At most `counters` rows: collected once so that both joins see the same small table.
    winners = F.broadcast(spark.createDataFrame(winners.collect(), winners.schema))
    # Sums by digest are joined back rather than windowed: no task holds a group of copies.
    rest = hashed.join(winners.select("digest"), "digest", "left_anti")
    sums = rest.groupBy("digest").agg(F.min(rank).alias("keep"), F.count("*").alias("group_size"))
    light = rest.join(sums, "digest").select("id", "row", "digest", "keep", "group_size")
    heavy = hashed.join(winners, "digest").select("id", "row", "digest", "keep", "group_size")
    return light.unionByName(heavy).select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies; every column stays as it is.

    Rows are matched to their decision by id and digest, so that an id given to
    several texts is not taken for one document.
    """
    decided = saved(exact_dedup(docs, id_col, text_col))
    key, sha, copy = (fresh(docs, x) for x in ("keep_key", "keep_sha", "copy_number"))
    kept = decided.filter("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(sha))
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.sha2(normalised(F.col(text_col)), 256) == F.col(sha))
    joined = docs.join(kept, same, "left_semi")
    if decided.filter(~F.col("kept") & F.col(id_col).eqNullSafe(F.col("keep_id"))).isEmpty():
        return joined
    once = Window.partitionBy(id_col, F.sha2(normalised(F.col(text_col)), 256)).orderBy(all_columns(docs))
    return joined.withColumn(copy, F.row_number().over(once)).filter(F.col(copy) == 1).select(*docs.columns)
