"""An inverted-file index over vectors: coarse lists, product-quantised codes scanned first, exact scores last."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import best_pairs, cosine, matrix, packed, unit
from quarry.sources.segments import Change, Segments

#: Rows that the model is fitted on; most coarse lists; parts of a vector and codes of a part; rounds of fitting.
SAMPLE, MOST_LISTS, PARTS, CODES, ROUNDS = 20_000, 4096, 16, 256, 12
#: Rows of a list, and queries, that one visit holds.
ROWS, QUERIES = 16_384, 512
#: Queries of a pack that are compared at a time.
SLICE = 64
MODEL = "kind string, part int, number int, value array<double>"


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row; of equally near ones the first."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ centres.T - half, axis=1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def centres_of(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Up to ``k`` centres of the rows of ``x`` by Lloyd's rounds; an empty cell takes the row that lies farthest out."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        away = np.argsort(-((x - centres[own]) ** 2).sum(axis=1), kind="stable")
        empty = np.flatnonzero(n == 0)
        centres = sums / np.maximum(n, 1)[:, None]
        centres[empty] = x[away[: len(empty)]]
    return centres


@dataclass
class Model:
    """Centres of the lists, and for each part of the dimensions the centres of what is left over."""

    lists: np.ndarray
    parts: list[np.ndarray]

    @property
    def bounds(self) -> list[int]:
        return np.cumsum([0, *(p.shape[1] for p in self.parts)]).tolist()

    @classmethod
    def fit(cls, x: np.ndarray, n_lists: int, n_parts: int, seed: int) -> Model:
        lists = centres_of(x, n_lists, seed)
        left = x - lists[nearest(x, lists)]
        cuts = np.linspace(0, x.shape[1], min(n_parts, x.shape[1]) + 1).round().astype(int)
        return cls(lists, [centres_of(left[:, a:b], CODES, seed + 1 + k) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and how far what they stand for lies from each row."""
        own = nearest(x, self.lists)
        left = x - self.lists[own]
        codes = np.stack([nearest(left[:, a:b], p) for p, a, b in zip(self.parts, self.bounds, self.bounds[1:], strict=False)], axis=1).astype(np.uint8)
        stands = np.concatenate([p[codes[:, k]] for k, p in enumerate(self.parts)], axis=1)
        return own, codes, np.linalg.norm(left - stands, axis=1)

    def scores(self, q: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with what the codes of a list stand for: sums of entries of a table by part."""
        out = np.repeat((q @ self.lists[number])[:, None], len(codes), axis=1)
        for k, (p, a, b) in enumerate(zip(self.parts, self.bounds, self.bounds[1:], strict=False)):
            out += (q[:, a:b] @ p.T)[:, codes[:, k]]
        return out


def best_uncoded(model: Model, q_ids: np.ndarray, q: np.ndarray, is_open: np.ndarray, ids: np.ndarray, v: np.ndarray, numbers: np.ndarray, codes: np.ndarray, away: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among rows of its open lists: those that their codes cannot rule out are scored in full.

    A score differs from that of the code by no more than the code is away from the row, so a
    row goes if k others, and one for the query itself, are sure to be better.
    """
    by_code = np.full((len(q), len(ids)), -np.inf)
    for number in np.unique(numbers):
        at, some = np.flatnonzero(numbers == number), np.flatnonzero(is_open[:, number])
        if len(some):
            by_code[np.ix_(some, at)] = model.scores(q[some], number, codes[at])
    m = min(k + exclude_self, len(ids))
    floor = np.partition(by_code - away, len(ids) - m, axis=1)[:, len(ids) - m, None]
    mask = (by_code > -np.inf) & (by_code + away >= floor - 1e-6)
    left = np.flatnonzero(mask.any(axis=0))
    return best_pairs(q_ids, q, ids[left], v[left], k, exclude_self, mask[:, left])


class VectorIndex:
    """An index under ``root`` over (chunk_id, embedding), searched by cosine.

    The model, coarse centres and code books, is fitted on a bounded sample taken by a hash
    of ids (``sample`` rows as expected; its size does not grow with the table). Every row is
    then assigned and encoded in place and written to its list, a partition of the table.
    Additions and removals are segments of their own, so they cost what they hold; another
    ``VectorIndex`` on the same root finds all of it. Vectors count by direction; one without
    length is kept as it is and scores 0.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Segments(spark, root)
        self._model: Model | None = None

    @property
    def model(self) -> Model:
        if self._model is None:
            # Bounded: at most MOST_LISTS centres and CODES for each part.
            rows = sorted(self.store.read("vector_model").collect(), key=lambda r: (r["part"], r["number"]))
            part = lambda kind, n: np.array([r["value"] for r in rows if r["kind"] == kind and r["part"] == n], dtype=float)
            self._model = Model(part("list", 0), [part("code", n) for n in range(1 + max(r["part"] for r in rows if r["kind"] == "code"))])
        return self._model

    def build(self, vectors: DataFrame, n_lists: int | None = None, n_parts: int = PARTS, sample: int = SAMPLE, seed: int = 0) -> VectorIndex:
        """Fit the model and index all of ``vectors``, in place of what there was. Without ``n_lists``, the root of the number of rows."""
        given = vectors.filter("embedding IS NOT NULL")
        n = given.count()
        lists = max(1, min(n_lists or round(n**0.5), MOST_LISTS, sample))
        share = 1.0 if n <= sample else sample / n
        taken = given.filter(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
        # By id, so that reruns fit the same model.
        rows = taken.orderBy("chunk_id").select("embedding").toArrow().column(0).to_pylist()
        if not rows:
            raise ValueError("there are no vectors to fit an index on")
        m = Model.fit(unit(np.array(rows, dtype=float)), lists, n_parts, seed)
        values = [("list", 0, i, c.tolist()) for i, c in enumerate(m.lists)] + [("code", k, i, c.tolist()) for k, p in enumerate(m.parts) for i, c in enumerate(p)]
        self.store.drop("vector_model", "vectors")
        self._model = m
        self.store.commit(vector_model=Change(self.spark.createDataFrame(values, MODEL)), vectors=Change(self._encoded(given), partition_by=("list",)))
        return self

    def _encoded(self, vectors: DataFrame) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(self.model)
        id_type = vectors.schema["chunk_id"].dataType.simpleString()
        names = ["chunk_id", "embedding", "list", "code", "away"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = unit(np.array(batch.column(1).to_pylist(), dtype=float))
                    own, codes, away = shared.value.encode(x)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(away)], names)

        given = vectors.filter("embedding IS NOT NULL").select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
        made = given.mapInArrow(run, f"chunk_id {id_type}, embedding array<float>, list int, code binary, away double")
        # A list that many rows share is written by several tasks.
        return made.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(8)))

    def built(self) -> bool:
        return "vectors" in self.store.names()

    def change(self, vectors: DataFrame | None = None, gone: DataFrame | None = None) -> Change:
        """Rows that come and ids that go, to be committed with changes of other tables of the same store."""
        return Change(None if vectors is None else self._encoded(vectors), {} if gone is None else {"chunk_id": gone}, ("list",))

    def add(self, vectors: DataFrame) -> None:
        """Index more rows; a row whose id is there already takes its place."""
        self.store.commit(vectors=self.change(vectors, vectors.select("chunk_id")))

    def remove(self, ids: DataFrame) -> None:
        self.store.commit(vectors=self.change(gone=ids))

    def compact(self) -> int:
        return self.store.compact("vectors", partition_by=("list",))

    def drop(self) -> None:
        self.store.drop("vector_model", "vectors")
        self._model = None

    def rows(self) -> DataFrame:
        return self.store.read("vectors")

    def size(self) -> int:
        return self.rows().count()

    @property
    def dimensions(self) -> int:
        return self.model.lists.shape[1]

    def probes(self, queries: DataFrame, n: int) -> DataFrame:
        """(query_id, embedding, list): each query with the ``n`` lists whose centres are most like it."""
        shared = self.spark.sparkContext.broadcast(self.model.lists)
        id_type = queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    score = unit(np.array(batch.column(1).to_pylist(), dtype=float)) @ shared.value.T
                    best = np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.tolist(), pa.list_(pa.int32()))], ["query_id", "embedding", "lists"])

        asked = queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
        return asked.mapInArrow(run, f"query_id {id_type}, embedding array<float>, lists array<int>").withColumn("list", F.explode("lists")).drop("lists")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, shortlist: int | None = None, exclude_self: bool = True) -> DataFrame:
        """(query_id, chunk_id, score, rank): the best ``k`` by cosine among the lists that each query opens.

        Only the partitions of these lists are read; of them first the codes. With
        ``shortlist``, so many rows of each query are scored in full. Without, those that the
        codes cannot rule out, where they lie (:func:`best_uncoded`). All lists and no ``shortlist`` are therefore the exact answer.
        """
        n_lists = len(self.model.lists)
        probes = n_lists if probes is None else min(probes, n_lists)
        if shortlist is None:
            return self._exact(queries, k, probes, exclude_self)
        opened = self.probes(queries, probes)
        rows = self.rows()
        if probes < n_lists:
            # At most MOST_LISTS numbers: they prune partitions when the scan is planned.
            rows = rows.filter(F.col("list").isin([r[0] for r in opened.select("list").distinct().collect()]))
        # One row for each list.
        sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"))
        n_q = max(1, -(-queries.count() // QUERIES))
        own = rows.select("chunk_id", "list", "code").join(F.broadcast(sizes), "list")
        block = F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int").alias("block")
        codes = own.groupBy("list", block).agg(F.collect_list(F.struct("chunk_id", "code")).alias("x")).select("list", "block", F.col("x.chunk_id").alias("ids"), F.col("x.code").alias("codes"))
        asking = packed(opened, "query_id", ["list", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("q_block")], ("q_ids", "q"))
        to_all = asking.join(F.broadcast(sizes), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        least = self._scanned(to_all.join(codes, ["list", "block"]), queries, rows, shortlist + exclude_self)
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
        short = least.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= shortlist + exclude_self)
        full = short.select("query_id", "chunk_id", "list").join(rows.select("chunk_id", "list", "embedding"), ["chunk_id", "list"])
        scored = full.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").select("query_id", "chunk_id", cosine(F.col("q"), F.col("embedding")).alias("score"))
        if exclude_self:
            scored = scored.filter("query_id <> chunk_id")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def _exact(self, queries: DataFrame, k: int, probes: int, exclude_self: bool) -> DataFrame:
        """The best ``k`` by cosine among the rows of the opened lists, each of which its code rules out or that is scored where it lies.

        Neighbouring lists lie in groups of about ``ROWS`` rows, a longer list in several, and packs of queries go to groups: what
        is shuffled is every vector once, every query once for each group, and k hits of each query and group.
        """
        n_lists, share = len(self.model.lists), probes < len(self.model.lists)
        asked = queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
        n_q = max(1, -(-queries.count() // QUERIES))
        pack_of = F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("q_block")
        rows = self.rows()
        packs = packed(asked, "query_id", [pack_of], ("q_ids", "q"))
        if share:
            opened = self.probes(queries, probes)
            # At most MOST_LISTS numbers: they prune partitions when the scan is planned.
            rows = rows.filter(F.col("list").isin([r[0] for r in opened.select("list").distinct().collect()]))
            lists = opened.groupBy(pack_of).agg(F.collect_list(F.struct("query_id", "list")).alias("x")).select("q_block", F.col("x.query_id").alias("open_ids"), F.col("x.list").alias("open_lists"))
            packs = packs.join(lists, "q_block")
        # One row for each list, at most MOST_LISTS.
        sizes = sorted((r["list"], r["n"]) for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect())
        places, group, filled = [], 0, 0
        for number, n in sizes:
            if filled and filled + n > ROWS:
                group, filled = group + 1, 0
            blocks = -(-n // ROWS)
            places.append((number, group, blocks))
            group, filled = (group + blocks, 0) if blocks > 1 else (group, filled + n)
        n_groups = group + (filled > 0)
        where = self.spark.createDataFrame(places or [(-1, 0, 1)], "list int, first int, blocks int")
        placed = rows.join(F.broadcast(where), "list").withColumn("group", F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))
        fields = ("chunk_id", "list", "code", "away", "embedding")
        held = placed.groupBy("group").agg(F.collect_list(F.struct(*fields)).alias("x")).select("group", *(F.col(f"x.{c}").alias(c) for c in fields[:-1]), F.flatten("x.embedding").alias("v"))
        to_all = packs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(1, n_groups) - 1))))
        shared = self.spark.sparkContext.broadcast(self.model)
        types = (queries.schema["query_id"].dataType.simpleString(), rows.schema["chunk_id"].dataType.simpleString())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    q_ids, q = matrix(batch, i, "q_ids", "q")
                    ids, v = matrix(batch, i, "chunk_id", "v")
                    numbers, away = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("list", "away"))
                    codes = np.frombuffer(b"".join(batch.column("code")[i].as_py()), np.uint8).reshape(len(ids), -1)
                    is_open = np.ones((len(q_ids), n_lists), bool)
                    if share:
                        open_ids, open_lists = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("open_ids", "open_lists"))
                        order = np.argsort(q_ids, kind="stable")
                        is_open[:] = False
                        is_open[order[np.searchsorted(q_ids[order], open_ids)], open_lists] = True
                    q, v = unit(q), unit(v.astype(float))
                    for a in range(0, len(q), SLICE):
                        found = best_uncoded(shared.value, q_ids[a : a + SLICE], q[a : a + SLICE], is_open[a : a + SLICE], ids, v, numbers, codes, away, k, exclude_self)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "chunk_id", "score"])

        found = to_all.join(held.hint("shuffle_merge"), "group").mapInArrow(run, f"query_id {types[0]}, chunk_id {types[1]}, score double")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def _scanned(self, visits: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, list, score): scores by the codes of the best ``k`` rows of each block, and what ties with them."""
        shared = self.spark.sparkContext.broadcast(self.model)
        types = (queries.schema["query_id"].dataType.simpleString(), rows.schema["chunk_id"].dataType.simpleString())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    number = batch.column("list")[i].as_py()
                    q_ids, q = matrix(batch, i, "q_ids", "q")
                    ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
                    codes = np.frombuffer(b"".join(batch.column("codes")[i].as_py()), np.uint8).reshape(len(ids), -1)
                    score = shared.value.scores(unit(q), number, codes)
                    m = min(k, len(ids))
                    floor = np.partition(score, len(ids) - m, axis=1)[:, len(ids) - m, None]
                    a, b = np.nonzero(score >= floor)
                    values = [q_ids[a], ids[b], np.full(len(a), number, np.int32), score[a, b]]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["query_id", "chunk_id", "list", "score"])

        return visits.mapInArrow(run, f"query_id {types[0]}, chunk_id {types[1]}, list int, score double")
