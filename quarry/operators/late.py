"""Late interaction: a query is as like a chunk as its tokens' best matches there, added up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import unit
from quarry.operators.recall import ranked
from quarry.operators.text_index import tokens, written
from quarry.operators.vector_index import VectorIndex
from quarry.sources.segments import work_folder

#: Tokens of the dictionary that each query token looks for; chunks of a query that are scored in full.
NEAREST, CANDIDATES = 2, 50


def late_interaction_topk(chunks: DataFrame, queries: DataFrame, with_vectors: Callable[[DataFrame], DataFrame], k: int = 10, nearest: int = NEAREST, candidates: int = CANDIDATES, probes: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best chunks by the sum, over a query's tokens, of the best cosine with any token of the chunk.

    ``with_vectors`` adds ``embedding`` to a table of distinct tokens (column ``token``): vectors
    belong to tokens, so each is made once, however often it occurs. An index of the
    dictionary's vectors, lists around centroids, gives each query token its ``nearest``
    tokens (``probes`` lists are opened, or all). Chunks that hold any of these are ranked by
    the sum of what was found, and the first ``candidates`` of each query are scored in full,
    over all their tokens. Repeated tokens count once on either side.
    """
    of = lambda df, key: df.select(key, F.explode(F.array_distinct(tokens(F.col("query" if key == "query_id" else "content")))).alias("token"))
    held, asked = written(of(chunks, "chunk_id")), of(queries, "query_id")
    dictionary = written(with_vectors(held.select("token").distinct()).select("token", "embedding"))
    vectors = written(with_vectors(asked.select("token").distinct()).select("token", "embedding"))
    index = VectorIndex(chunks.sparkSession, work_folder(chunks.sparkSession)).build(dictionary.withColumnRenamed("token", "chunk_id"))
    near = index.search(vectors.withColumnRenamed("token", "query_id"), nearest, probes, exclude_self=False)
    near = near.select(F.col("query_id").alias("asked"), F.col("chunk_id").alias("token"), F.col("score").alias("like"))

    pairs = asked.withColumnRenamed("token", "asked").join(near, "asked").join(held, "token")
    matched = pairs.groupBy("query_id", "chunk_id", "asked").agg(F.max("like").alias("like")).groupBy("query_id", "chunk_id").agg(F.round(F.sum("like"), 6).alias("found"))
    first = Window.partitionBy("query_id").orderBy(F.col("found").desc(), "chunk_id")
    short = written(matched.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= candidates).select("query_id", "chunk_id"))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        flat = lambda rows: unit(np.stack(rows).astype(float))
        for q, c in batches:
            yield pd.Series([(flat(a) @ flat(b).T).max(axis=1).sum() for a, b in zip(q, c, strict=True)], dtype=float)

    # A chunk's own tokens bound what meets here.
    own = held.join(short.select("chunk_id").distinct(), "chunk_id", "left_semi").join(dictionary, "token").groupBy("chunk_id").agg(F.collect_list("embedding").alias("c"))
    theirs = asked.join(vectors, "token").groupBy("query_id").agg(F.collect_list("embedding").alias("q"))
    full = short.join(theirs, "query_id").join(own, "chunk_id").select("query_id", "chunk_id", F.round(score("q", "c"), 6).alias("score"))
    return ranked(full, k).withColumn("path", F.lit("late"))
