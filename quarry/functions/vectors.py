"""Embeddings: the deterministic test embedder, and cosine search over blocks of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that a task holds at a time.
BLOCK = 1024


def text_hash(text: str) -> int:
    """The 32-bit hash h * 31 + c over the characters of a text."""
    codes = np.frombuffer(text.encode("utf-16-le"), np.uint16).astype(np.uint64)
    h = 0
    for k in range(0, len(codes), 4096):
        part = codes[k : k + 4096]
        powers = np.cumprod(np.concatenate(([1], np.full(len(part), 31))).astype(np.uint64))
        h = (h * int(powers[-1]) + int((part * powers[:-1][::-1]).sum(dtype=np.uint64))) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def mock_hash(text: Column) -> Column:
    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else text_hash(t) for t in texts], dtype="Int32")

    return run(text)


def mock_embedding(hashed: Column, dim: int = 384) -> Column:
    """A test vector sin(hash + i) / 2: the same for the same text, without meaning."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.sin(hashed.cast("double") + i) * 0.5).cast("float"))


def with_mock_embedding(df: DataFrame, text_col: str, dim: int = 384, out_col: str = "embedding") -> DataFrame:
    """``df`` with the test vector of a text column; the hash is a column of its own, as lambdas hold no Python."""
    hashed = df.withColumn("text_hash", mock_hash(F.col(text_col)))
    return hashed.withColumn(out_col, mock_embedding(F.col("text_hash"), dim)).drop("text_hash")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows brought to length 1."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def packed(rows: DataFrame, id_col: str, key: list[Column | str], names: tuple[str, str], vec_col: str = "embedding") -> DataFrame:
    """One row for each ``key``: ids, and their vectors one behind the other. Keys must bound how many rows meet in one."""
    each = rows.groupBy(*key).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))).alias("pack"))
    keys = [c for c in each.columns if c != "pack"]
    return each.select(*keys, F.col("pack.id").alias(names[0]), F.flatten("pack.v").alias(names[1]))


def matrix(batch: pa.RecordBatch, row: int, ids: str, values: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one pack, as a matrix."""
    own = batch.column(ids)[row].values.to_numpy(zero_copy_only=False)
    return own, batch.column(values)[row].values.to_numpy(zero_copy_only=False).reshape(len(own), -1)


def best_pairs(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, exclude_self: bool, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best of the pairs in ``mask``, or of all, by cosine rounded to nine digits, then by id; whatever ties, no more than k."""
    # By id first: of those that tie with the k-th best, the first have the lesser ids.
    by_id = np.argsort(ids, kind="stable")
    ids, score = ids[by_id], np.round(q @ v[by_id].T, 9)
    if not len(ids):
        return q_ids[:0], ids, score[:0].reshape(-1)
    if mask is not None:
        score[~mask[:, by_id]] = -np.inf
    if exclude_self:
        score[q_ids[:, None] == ids[None, :]] = -np.inf
    m = min(k, len(ids))
    floor = np.partition(score, len(ids) - m, axis=1)[:, len(ids) - m, None]
    above, tied = score > floor, score == floor
    room = m - above.sum(axis=1, keepdims=True)
    i, j = np.nonzero((above | (tied & (np.cumsum(tied, axis=1) <= room))) & (score > -np.inf))
    return q_ids[i], ids[j], score[i, j]


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = True, block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact cosine top k of every query over all ``vectors`` (chunk_id, embedding).

    Up to ``block`` queries are counted first and then sent to where the vectors lie. More of
    them are dealt in blocks, as the vectors are, and each block meets each other once, in one
    scan and one shuffle however many queries there are. Either way two blocks are one
    matrix product, which sends at most k rows for each query on, so that the last shuffle
    carries candidates, not pairs. Scores are rounded to nine digits, as equal vectors give
    scores that differ in their last digits by place in a block; ties go to the lesser id.
    """
    spark = vectors.sparkSession
    asked, given = queries.select("query_id", "embedding").filter("embedding IS NOT NULL"), vectors.select("chunk_id", "embedding").filter("embedding IS NOT NULL")
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {given.schema['chunk_id'].dataType.simpleString()}, score double"
    names = ["query_id", "chunk_id", "score"]
    rows = lambda found: pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)
    n = asked.count()
    if n <= block:
        own = asked.toArrow()
        shared = spark.sparkContext.broadcast((own.column("query_id").to_numpy(), own.column("embedding").to_pylist()))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, lists = shared.value
            q = unit(np.array(lists, dtype=float)) if len(lists) else np.zeros((0, 0))
            for batch in batches:
                if batch.num_rows and len(q):
                    v = unit(np.array(batch.column(1).to_pylist(), dtype=float))
                    yield rows(best_pairs(ids, q, batch.column(0).to_numpy(zero_copy_only=False), v, k, exclude_self))

        out = given.mapInArrow(best, schema)
    else:
        n_q, n_v = -(-n // block), max(1, -(-given.count() // (4 * block)))
        dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        blocks = packed(given, "chunk_id", [dealt("chunk_id", n_v).alias("block")], ("ids", "v"))
        to_all = packed(asked, "query_id", [dealt("query_id", n_q).alias("q_block")], ("q_ids", "q")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    (q_ids, q), (ids, v) = matrix(batch, i, "q_ids", "q"), matrix(batch, i, "ids", "v")
                    yield rows(best_pairs(q_ids, unit(q), ids, unit(v), k, exclude_self))

        # Both sides grow with the table, so neither may be sent through the driver.
        out = to_all.join(blocks.hint("merge"), "block").mapInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors to nine digits, as a column expression; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.round(F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)), 9)


def embed(df: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str = "content", out_col: str = "embedding", batch: int = 50) -> DataFrame:
    """``df`` with vectors from a model that ``make`` builds once in each task, and ``embed_error``.

    Texts go to the model in batches; if one fails, its texts go one by one, and those
    that still fail get a null vector and the error, so that no vector moves to another row.
    """

    @F.pandas_udf("vector array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()

        def one(text: str) -> tuple[list[float] | None, str | None]:
            try:
                return model([text])[0], None
            except Exception as e:
                return None, str(e)

        for texts in batches:
            rows: list[tuple[list[float] | None, str | None]] = []
            for k in range(0, len(texts), batch):
                some = [t or "" for t in texts.iloc[k : k + batch]]
                try:
                    found = model(some)
                    if len(found) != len(some):
                        raise ValueError(f"{len(found)} vectors for {len(some)} texts")
                    rows += [(v, None) for v in found]
                except Exception:
                    rows += [one(t) for t in some]
            yield pd.DataFrame({"vector": [v for v, _ in rows], "error": [e for _, e in rows]})

    made = df.withColumn("made", run(F.col(text_col)))
    return made.withColumn(out_col, F.col("made.vector")).withColumn("embed_error", F.col("made.error")).drop("made")
