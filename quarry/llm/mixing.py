"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, all_columns, fresh, require, saved

# Weights of the sources in code point order, repeating; the share of all words to take; the most copies.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: Documents of a source that one task rounds together at the first level, and residuals that meet at each later one.
LEAF, FAN_IN = 4096, 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with each source's weight and target.

    A target is the source's share by weight, stopped at ``most`` times its size; the
    excess is shared again by weight until none is above. Each round only moves
    three sums to the driver, so the number of sources is not bounded by it.
    """
    # Sources are ranked over ranges of names: a count for each range, then a rank within it.
    ranged = saved(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    inner = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"), F.max(F.col("source").isNull()).alias("last"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("last", "part")) - F.col("n")).alias("offset"))
    place = F.col("offset") + F.row_number().over(inner) - 1
    ranked = ranged.join(F.broadcast(before), "part").withColumn("place", place)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = saved(ranked.select("source", "source_size", weight.alias("weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, F.lit(False)
    while True:
        # A source is full once the level (words per unit of weight) lifts it to its limit.
        full = F.col("weight") * level >= F.col("source_size") * float(most)
        spent, free = ranked.agg(F.sum(F.when(full, F.col("source_size") * float(most))), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        rise = (budget * total - (spent or 0.0)) / free
        if rise <= level or math.isclose(rise, level, rel_tol=1e-15):
            break
        level = rise
    return ranked.withColumn("target", F.least(F.col("weight") * level, F.col("source_size") * float(most)))


def rounded(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of ``p`` (0 to 1) in the given order: the copies, and the place of the one left fractional or -1.

    The open item and the next one trade mass so that words (p * size) are conserved,
    until one of them is 0 or 1; of the two possible trades one is drawn with the odds
    that leave each expectation unchanged.
    """
    p = p.astype(float).copy()
    open_at = -1
    for j in range(len(p)):
        if p[j] < 1e-12 or p[j] > 1 - 1e-12:
            p[j] = round(p[j])
            continue
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        a, b = float(size[i]), float(size[j])
        up = min((1 - p[i]) * a, p[j] * b)  # words that can go from j to i
        down = min(p[i] * a, (1 - p[j]) * b)
        move = up if draw[j] * (up + down) < down else -down
        p[i] += move / a
        p[j] -= move / b
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
        open_at = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p, open_at


def round_group(pdf: pd.DataFrame) -> pd.DataFrame:
    # Long documents first: the one that stays fractional at the end is then a short one.
    pdf = pdf.sort_values(["size", "draw", "row"], ascending=[False, True, True]).reset_index(drop=True)
    p, open_at = rounded(pdf["p"].to_numpy(), pdf["size"].to_numpy(), pdf["draw"].to_numpy())
    pdf["p"] = p
    pdf["open"] = np.arange(len(pdf)) == open_at
    # Each level draws anew.
    pdf["draw"] = (pdf["draw"] * 1_000_003.0) % 1.0
    return pdf


def dealt(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (row, key, n_docs) with draw, group and groups.

    Rows of a source are dealt to groups of about ``LEAF`` by their key, a hash of id and
    text. Equal rows that would overfill a group are told apart by their place in the table.
    """
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF).select("key", F.lit(True).alias("crowded"))
    rows = rows.join(crowded, "key", "left").withColumn("key", F.when(F.col("crowded"), F.xxhash64("key", "row")).otherwise(F.col("key"))).drop("crowded")
    draw = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    groups = F.greatest(F.ceil(F.col("n_docs") / LEAF), F.lit(1)).cast("long")
    return rows.withColumn("draw", draw).withColumn("group", F.pmod(F.xxhash64("key", F.lit(seed + 1)), groups)).withColumn("groups", groups)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, copies, taken.

    Each source takes ``target / source_size`` copies of each of its documents on
    average: everyone gets the whole part, and the fractional parts are rounded by
    the pivotal method. Documents of a source are rounded in groups of about
    ``LEAF``; at most one stays fractional in each, and these residuals meet in groups
    of ``FAN_IN`` until one is left for a source, which a draw settles. The words taken
    therefore differ from the target by less than one document. Groups and draws depend
    on the seed, ids and texts alone, so reruns agree; where more equal rows than a group
    takes share both, on their places in the table too. So no id, null included, fills a group.

    Edge cases: null text has size 0 and gets 0 words; a null source is a source of
    its own, the last one; repeated rows each count; an empty table gives an empty
    result; other columns are ignored.
    """
    require(docs, (id_col, text_col, source_col))
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col).alias("key"))
    slim = saved(slim.withColumn("row", F.monotonically_increasing_id()))
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    aims = targets(per_source.select("source", "source_size"), weights, budget, most)
    aims = aims.join(per_source.select("source", "n_docs"), aims["source"].eqNullSafe(per_source["source"])).select(aims["source"], "source_size", "target", "n_docs")
    aims = aims.withColumn("ratio", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).withColumn("aim", F.xxhash64("source", F.lit(seed)))
    aims = saved(aims)
    # A hash of the source stands for it in keys; the sources themselves, null included, are joined safely.
    full = slim.join(aims, slim["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    full = dealt(full, seed)
    whole = F.floor(F.col("ratio") + 1e-12)
    full = full.withColumn("whole", whole).withColumn("p", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
    full = saved(full)
    shape = "row long, size long, aim long, group long, groups long, p double, draw double, open boolean"
    level = full.filter("p > 0 AND size > 0").select("row", "size", "aim", "group", "groups", "p", "draw", F.lit(True).alias("open"))
    settled, width = [], (full.agg(F.max("groups")).first()[0] or 1)
    while True:
        level = saved(level.groupBy("aim", "group").applyInPandas(round_group, shape))
        settled.append(level.filter(~F.col("open")).select("row", "p"))
        level = level.filter("open")
        if width == 1:
            break
        width = -(-width // FAN_IN)
        level = level.withColumn("groups", F.ceil(F.col("groups") / FAN_IN).cast("long")).withColumn("group", F.pmod("group", "groups"))
    settled.append(level.select("row", (F.col("draw") < F.col("p")).cast("double").alias("p")))
    extra = settled[0]
    for more in settled[1:]:
        extra = extra.unionByName(more)
    extra = extra.withColumnRenamed("p", "extra")
    copies = (F.col("whole") + F.coalesce(F.col("extra"), F.lit(0.0))).cast("int")
    out = full.join(extra, "row", "left").withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (not at all included); the columns stay as they are."""
    taken = mix(docs, id_col, text_col, source_col, **params)
    key, copies, at, size = (fresh(docs, x) for x in ("mix_key", "mix_copies", "mix_at", "mix_size"))
    # Rows that repeat an id share their copies evenly enough: the sum over the id is dealt to them in turn.
    per_id = taken.groupBy(F.col(id_col).alias(key), F.col("size").alias(size)).agg(F.sum("copies").alias(copies), F.count("*").alias(at))
    joined = docs.join(per_id, F.col(id_col).eqNullSafe(F.col(key)) & (n_words(F.col(text_col)) == F.col(size)))
    if not per_id.filter(F.col(at) > 1).isEmpty():
        turn = Window.partitionBy(key, size).orderBy(all_columns(docs))
        nth = F.row_number().over(turn)
        joined = joined.withColumn(copies, F.floor((F.col(copies) + F.col(at) - nth) / F.col(at)))
    times = F.sequence(F.lit(1), F.col(copies).cast("int"))
    return joined.filter(F.col(copies) > 0).withColumn(at, F.explode(times)).select(*docs.columns)
