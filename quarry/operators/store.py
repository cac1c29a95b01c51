"""Table maintenance over Parquet: upsert, delete, sync, statistics, histories, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import chosen

# What is not to be indexed, the largest file without a warning, searches a minute.
SENSITIVE = (".env", "secret", "credential", "password", "key.pem", "id_rsa", ".git")
MOST_BYTES, MOST_SEARCHES = 10 * 1024 * 1024, 100
RECENT, PREVIEW = 100, 500


def upsert(stored: DataFrame, changes: DataFrame, key: str = "id", version: str = "indexed_at") -> DataFrame:
    """The newest row of each key. Only keys that change are compared; all others pass through an anti join.

    Of rows with the same version a change beats what is stored; of such changes, the last by content.
    """
    touched = changes.select(key).distinct()
    both = stored.join(touched, key, "left_semi").withColumn("new", F.lit(0)).unionByName(changes.withColumn("new", F.lit(1)))
    newest = both.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("new").desc(), F.to_json(F.struct(*stored.columns)).desc()))).filter("nth = 1").drop("nth", "new")
    return stored.join(touched, key, "left_anti").unionByName(newest)


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def delete_by_path(documents: DataFrame, chunks: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and chunks without those of ``paths`` (path), and how many chunks each took along."""
    gone = documents.join(paths, "path", "left_semi").select("doc_id")
    counts = chunks.join(gone, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("deleted_chunks"))
    report = gone.join(counts, "doc_id", "left").withColumn("deleted_chunks", F.coalesce("deleted_chunks", F.lit(0)))
    return delete(documents, gone, "doc_id"), delete(chunks, gone, "doc_id"), report


def stats(documents: DataFrame, chunks: DataFrame, size: str = "size") -> DataFrame:
    d = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return d.join(chunks.agg(F.count("*").alias("chunks")), how="cross")


def listing(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their number of chunks."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks_count"))
    return documents.join(n, "doc_id", "left").withColumn("chunks_count", F.coalesce("chunks_count", F.lit(0)))


def view(documents: DataFrame, chunks: DataFrame, preview: int = PREVIEW) -> DataFrame:
    """Each document with the beginning of its content and its chunks in order of position; join ids to look some up."""
    parts = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos"))).alias("chunks"))
    shown = documents.select("doc_id", "path", F.left("content", F.lit(preview)).alias("preview"))
    return shown.join(parts, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<struct<start_pos: int, end_pos: int>>")))


def recent(rows: DataFrame, by: Column, order: list[Column], most: int = RECENT) -> DataFrame:
    """The newest ``most`` rows of each group."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most)


def moving_mean(events: DataFrame, value: str, by: str, order: list[str], width: int = RECENT) -> DataFrame:
    """Mean of the last ``width`` values of each group at every event."""
    w = Window.partitionBy(by).orderBy(*order)
    return events.withColumn("mean", F.round(F.avg(value).over(w.rowsBetween(-(width - 1), 0)), 6)).withColumn("n", F.count("*").over(w))


def rate_limited(events: DataFrame, by: str, most: int = MOST_SEARCHES, length: str = "1 minute") -> DataFrame:
    """Searches of each group in windows of time, and whether they are too many; works on streams too."""
    return events.groupBy(by, F.window("ts", length).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("window_start"), "n", (F.col("n") > most).alias("blocked"))


def constraint(path: Column, size: Column) -> Column:
    """The first rule that speaks: block for sensitive names, warn for large files, else allow."""
    low = F.lower(path)
    named = F.lit(False)
    for s in SENSITIVE:
        named = named | low.contains(s)
    return chosen(((named, F.lit("block")), (size > MOST_BYTES, F.lit("warn"))), F.lit("allow"))


def sync(server: DataFrame, local: DataFrame, key: str, value: str, version: str, rule: str = "server-wins") -> DataFrame:
    """Both sides joined on their key: the value that stays, its origin, and whether they differed."""
    s = server.select(F.col(key), F.col(value).alias("sv"), F.col(version).alias("st"), F.lit(True).alias("s"))
    c = local.select(F.col(key), F.col(value).alias("lv"), F.col(version).alias("lt"), F.lit(True).alias("l"))
    both = s.join(c, key, "full_outer")
    pick_local = {"server-wins": F.lit(False), "local-wins": F.lit(True), "merge": F.coalesce(F.col("lt") > F.col("st"), F.lit(False))}[rule]
    use_local = F.col("s").isNull() | (F.col("l").isNotNull() & pick_local)
    conflict = F.col("s").isNotNull() & F.col("l").isNotNull() & ~F.col("sv").eqNullSafe(F.col("lv"))
    return both.select(key, F.when(use_local, F.col("lv")).otherwise(F.col("sv")).alias(value), F.when(use_local, F.lit("local")).otherwise(F.lit("server")).alias("origin"), conflict.alias("conflict"))


def pending(server: DataFrame, local: DataFrame, key: str, value: str, version: str, since: Column | None = None) -> DataFrame:
    """What an incremental sync moves: keys that either side lacks or holds differently, and in which direction.

    With ``since``, only rows changed after it are compared. Equal rows drop out before
    the sides meet in full, so a small change moves little.
    """
    new = lambda df: df if since is None else df.filter(F.col(version) > since)
    up = new(local).join(server.select(key, value), [key, value], "left_anti").select(key, F.col(version).alias("lt"))
    down = new(server).join(local.select(key, value), [key, value], "left_anti").select(key, F.col(version).alias("st"))
    both = up.join(down, key, "full_outer")
    upload = F.col("st").isNull() | (F.col("lt") > F.col("st"))
    return both.select(key, F.when(upload, F.lit("upload")).otherwise(F.lit("download")).alias("direction"))


def cache_victims(entries: DataFrame, now: Column, room: int) -> DataFrame:
    """What leaves a cache: expired entries, then those with the fewest hits, oldest first, until ``room`` stay."""
    live = entries.filter(F.col("expires_at") > now)
    stay = live.orderBy(F.col("hits").desc(), F.col("seq").desc()).limit(room).select("key")
    return entries.join(stay, "key", "left_anti")


def cache_rate(lookups: DataFrame) -> DataFrame:
    hit = F.col("hit").cast("long")
    return lookups.agg(F.sum(hit).alias("hits"), F.sum(1 - hit).alias("misses"), F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("hit_rate"))


def health(components: DataFrame) -> DataFrame:
    """healthy if all are, unhealthy if one is, else degraded."""
    s = F.col("status")
    roll = chosen(((F.bool_and(s == "healthy"), F.lit("healthy")), (F.bool_or(s == "unhealthy"), F.lit("unhealthy"))), F.lit("degraded"))
    return components.agg(roll.alias("status"), F.count("*").alias("components"))


def spans(events: DataFrame) -> DataFrame:
    """Traces from spans (trace_id, start_ts, end_ts, status): length, spans, failures."""
    return events.groupBy("trace_id").agg(F.count("*").alias("spans"), F.sum((F.col("status") == "error").cast("long")).alias("errors"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
