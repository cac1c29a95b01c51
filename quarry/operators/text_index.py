"""Text search over postings: BM25 with bounds by block, and substrings by grams of the dictionary."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quarry.sources.segments import work_folder

# What BM25 takes as usual.
K1, B = 1.2, 0.75
#: Chunks of a block; queries of a visit; blocks that go together; characters of a gram.
BLOCK, QUERIES, GROUP, GRAM = 64, 512, 16, 3


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, however often it is read."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def visited(visits: DataFrame, columns: str, of: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict], list[list]]) -> DataFrame:
    """Rows that ``of`` makes of each visit: of a block of postings as a matrix of tokens and chunks, and of queries as a matrix of idf."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                field = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
                words, at = np.unique(field("words"), return_inverse=True)
                chunks, of_chunk = np.unique(field("chunk_ids"), return_inverse=True)
                parts = np.zeros((len(words), len(chunks)))
                parts[at, of_chunk] = field("parts")
                q_ids, first, of_query = np.unique(field("q_ids"), return_index=True, return_inverse=True)
                asked, idf = field("asked"), field("idfs")
                place = np.minimum(np.searchsorted(words, asked), len(words) - 1)
                held = words[place] == asked
                weights = np.zeros((len(q_ids), len(words)))
                weights[of_query[held], place[held]] = idf[held]
                more = {"block": batch.column("block")[i].as_py()}
                for c in ("floors", "only"):
                    if c in batch.schema.names:
                        more[c] = field(c)[first] if c == "floors" else field(c)
                bounds = weights @ parts.max(axis=1)
                rows = of(q_ids, chunks, weights, parts, bounds, more)
                if rows and len(rows[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names)

    return visits.mapInArrow(run, columns)


def best_of(q_ids: np.ndarray, chunks: np.ndarray, score: np.ndarray, k: int, floors: np.ndarray | None) -> list:
    """The k best of each query in a block, chunks in order of id: those that tie with the k-th and come later are left out."""
    score = np.round(score, 6)
    m = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - m, axis=1)[:, score.shape[1] - m, None]
    above, tied = score > least, score == least
    taken = (above | (tied & (np.cumsum(tied, axis=1) <= m - above.sum(axis=1, keepdims=True)))) & (score > 0)
    if floors is not None:
        taken &= score >= floors[:, None]
    i, j = np.nonzero(taken)
    return [q_ids[i], chunks[j], score[i, j]]


@dataclass
class BlockMax:
    """Steps of a block-max search, each a DataFrame."""

    bounds: DataFrame  # query_id, block, bound: no chunk of the block scores more
    hits: DataFrame  # query_id, chunk_id, score of the blocks that were scored first
    floor: DataFrame  # query_id, floor: the k-th best score of these
    opened: DataFrame  # query_id, block: those whose bound reaches the floor
    scored: DataFrame  # query_id, chunk_id, score: the k best of each opened block


def block_max(chunks: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B, block: int = BLOCK) -> BlockMax:
    """BM25 over distinct query tokens, skipping blocks that cannot reach a query's k-th score.

    Chunks of like length are dealt to blocks of about ``block``; a block's postings are one
    row. Of each token the largest part of a score in the block is taken, and their sum over a
    query's tokens bounds the score of every chunk there. The k blocks with the highest
    bounds are scored first, as one hit of each may do, which gives a k-th score; then every block is scored for those
    queries whose bound reaches theirs, and passed over for the others. Nothing that could
    be among the k best is left out. A visit of a block by up to ``QUERIES`` queries is a product of
    two small matrices, and sends on k rows for each query at most: postings are never
    joined with queries row by row.

    The corpus is read once: postings of query tokens are written as a table, and number and
    mean length of chunks observed while that is done. Blocks, not tokens, are the key of what
    is shuffled by size, so a token that is everywhere weighs on no task.
    """
    pairs = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))
    wanted = pairs.select("token").distinct()
    seen = Observation()
    terms = chunks.select("chunk_id", tokens(F.col("content")).alias("t"))
    terms = terms.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.size("t").cast("long")).alias("total"))
    each = terms.select("chunk_id", F.size("t").alias("len"), F.explode("t").alias("token")).join(wanted, "token", "left_semi")
    # By chunk, so that a chunk's tokens are counted where they meet.
    raw = written(each.repartition("chunk_id").groupBy("chunk_id", "token", "len").agg(F.count("*").alias("tf")))
    # Without any posting nothing may have been observed, and nothing is to be weighed.
    told = seen.get if raw.head(1) else {"n": 0, "total": 0}
    n = told["n"]
    mean = told["total"] / n if n else 1.0

    like = F.floor(2 * F.log2("len")).cast("int")
    # One row for each power of the square root of two.
    classes = raw.select("chunk_id", like.alias("like")).distinct().groupBy("like").agg(F.ceil(F.count("*") / block).cast("int").alias("n")).collect()
    in_class = F.element_at(F.create_map(*(F.lit(x) for r in classes for x in (r["like"], r["n"]))), like) if classes else F.lit(1)
    place = (like * (1 << 24) + F.pmod(F.xxhash64("chunk_id"), in_class).cast("int")).alias("block")
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean)))
    counted = raw.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    numbered = written(counted.select("token", idf.alias("idf"), F.monotonically_increasing_id().alias("word")))
    # Blocks that go to one place, beside copies of the queries.
    n_groups = max(1, -(-sum(r["n"] for r in classes) // GROUP))
    group = F.pmod(F.xxhash64("block"), F.lit(n_groups)).cast("int").alias("group")
    packed = raw.join(numbered.select("token", "word"), "token").groupBy(place).agg(F.collect_list(F.struct("word", "chunk_id", part.alias("part"))).alias("x"))
    postings = written(packed.select("block", group, F.col("x.word").alias("words"), F.col("x.chunk_id").alias("chunk_ids"), F.col("x.part").alias("parts")))
    n_q = max(1, -(-queries.count() // QUERIES))
    q_block = F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("q_block")
    asked = written(pairs.join(numbered.hint("merge"), "token").select("query_id", q_block, "word", "idf"))

    def packs(rows: DataFrame, *more: str) -> DataFrame:
        own = rows.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "word", "idf", *more)).alias("x"))
        fields = (("query_id", "q_ids"), ("word", "asked"), ("idf", "idfs"), *((m, f"{m}s") for m in more))
        return own.select("q_block", *(F.col(f"x.{a}").alias(c) for a, c in fields)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))

    # Every group of blocks gets every pack of queries: the query set is stated, and meets blocks, not rows.
    # What grows with the tables is shuffled: files of postings and packs are small for what they hold, and would be broadcast.
    to_all = lambda queries_packed: postings.join(queries_packed.hint("merge"), "group")
    id_type, chunk_type = queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
    scores = f"query_id {id_type}, chunk_id {chunk_type}, score double"

    def bounded(q_ids, ids, weights, parts, bounds, more):
        some = bounds > 0
        return [q_ids[some], np.full(some.sum(), more["block"], np.int32), bounds[some]]

    def scored_first(q_ids, ids, weights, parts, bounds, more):
        own = np.isin(q_ids, more["only"])
        return best_of(q_ids[own], ids, weights[own] @ parts, k, None) if own.any() else []

    def opened(q_ids, ids, weights, parts, bounds, more):
        some = (bounds > 0) & (bounds + 2e-6 >= more["floors"])
        return [q_ids[some], np.full(some.sum(), more["block"], np.int32)]

    def scored(q_ids, ids, weights, parts, bounds, more):
        # A rounded score may lie a little above its bound.
        some = (bounds > 0) & (bounds + 2e-6 >= more["floors"])
        return best_of(q_ids[some], ids, weights[some] @ parts, k, more["floors"][some]) if some.any() else []

    bounds = visited(to_all(packs(asked)), f"query_id {id_type}, block int, bound double", bounded)
    by_bound = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    best = bounds.withColumn("nth", F.row_number().over(by_bound)).filter(F.col("nth") <= k)
    chosen = best.groupBy("block", q_block).agg(F.collect_list("query_id").alias("only"))
    hits = written(visited(to_all(packs(asked)).join(chosen.hint("merge"), ["block", "q_block"]), scores, scored_first))
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    floor = written(hits.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") == k).select("query_id", F.col("score").alias("floor")))
    reached = packs(asked.join(floor.hint("merge"), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))), "floor")
    return BlockMax(bounds, hits, floor, visited(to_all(reached), f"query_id {id_type}, block int", opened), visited(to_all(reached), scores, scored))


def pieces(text: Column) -> Column:
    """Tokens and stretches of white space of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\s+|\S+"), F.lit(0)))


def grams(word: Column, n: Column | int) -> Column:
    """All stretches of ``n`` characters of a short text with their places, from 0."""
    size, chars = F.lit(n) if isinstance(n, int) else n, F.split(word, "")
    last = F.size(chars) - size
    every = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.array_join(F.slice(chars, i + 1, size), "").alias("gram"), i.alias("at")))
    return F.when(last >= 0, every).otherwise(F.array().cast("array<struct<gram:string,at:int>>"))


def pieces_holding(dictionary: DataFrame, parts: DataFrame) -> DataFrame:
    """(query_id, piece): pieces of a dictionary that hold a query's part, by an index of grams with their places.

    A part is cut into grams (one of its own length if it is shorter than a gram). The
    rarest of them finds pieces and the place where the part would begin; the second rarest must
    stand at its place behind the same beginning; what is left is compared in full.
    """
    size = F.least(F.length("part"), F.lit(GRAM))
    cut = parts.withColumn("g", F.explode(grams(F.col("part"), size))).select("query_id", "part", F.col("g.gram").alias("gram"), F.col("g.at").alias("offset"))
    wanted = cut.select("gram").distinct()
    every = F.flatten(F.array(*(grams(F.col("piece"), n) for n in range(1, GRAM + 1))))
    index = dictionary.withColumn("g", F.explode(every)).select("piece", F.col("g.gram").alias("gram"), F.col("g.at").alias("at")).join(wanted, "gram", "left_semi")
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("query_id").orderBy("n", "gram", "offset")
    # A gram that no piece has rules its query out.
    ordered = cut.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("nth", F.row_number().over(rarest)).filter("nth <= 2")
    met = lambda nth: ordered.filter(F.col("nth") == nth).join(index, "gram").select("query_id", "part", "piece", (F.col("at") - F.col("offset")).alias("begin"))
    two = ordered.filter("nth = 2").select("query_id")
    first = met(1)
    both = first.join(two, "query_id", "left_anti").unionByName(first.join(met(2).drop("part"), ["query_id", "piece", "begin"], "left_semi"))
    return both.filter(F.col("piece").contains(F.col("part"))).select("query_id", "piece").distinct()
