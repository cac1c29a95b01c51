"""The facade: index, search, delete and describe a store of Parquet tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import with_mock_embedding
from quarry.operators import chunking, fusion, recall, store
from quarry.operators.vector_index import VectorIndex
from quarry.plans.config import Config
from quarry.sources.segments import Change, Segments

# Texts of the prompts.
PROMPTS = {
    "search-optimize": "请优化以下搜索查询，使其更适合检索：\n{query}",
    "result-summary": "请根据以下检索结果总结回答：\n查询：{query}\n结果：\n{results}",
}


class Engine:
    """A store under ``root``: the tables documents and chunks, and an index of the chunks' vectors if one was built.

    Tables are segments with one manifest: a change writes what it adds and the keys it
    takes away, whatever else is stored, and becomes current for all tables at once.
    Another engine on the same root finds what is there.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.history: list[dict] = []
        self.store = Segments(spark, self.root)
        self.vectors = VectorIndex(spark, self.root)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def index(self, docs: DataFrame) -> DataFrame:
        """Index documents (doc_id, path, content): the new state of the store, with how many were indexed, skipped, repeated and failed.

        A document that is there already is replaced with all its chunks, but skipped
        where its content is the same; one without content (a file that could not be
        read) is an error and leaves the store as it is. Of rows with the same id the last
        one by path, then by hash of content, counts, and the others are reported as repeated.
        """
        given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "path", "content").withColumn("hash", F.sha2("content", 256))
        good = given.filter("content IS NOT NULL")
        last = Window.partitionBy("doc_id").orderBy(F.col("path").desc(), F.col("hash").desc())
        once = good.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth")
        there = "documents" in self.store.names()
        new = once.join(self.table("documents").select("doc_id", "hash"), ["doc_id", "hash"], "left_anti") if there else once
        counts = [df.agg(F.count("*").alias(name)) for name, df in (("given", given), ("good", good), ("once", once), ("indexed", new))]
        n = {k: v for df in counts for k, v in df.first().asDict().items()}
        if n["indexed"] or not there:
            fresh = new.withColumn("indexed_at", F.current_timestamp()).withColumn("size", F.length("content"))
            # 128 bits: no two chunks share an id, however many there are.
            made = chunking.index_chunks(fresh).withColumn("chunk_id", F.md5(F.concat_ws("\n", "doc_id", F.col("ordinal").cast("string"))))
            made = with_mock_embedding(made, "content", self.config.get("embedding.dimension"))
            gone = {"doc_id": fresh.select("doc_id")} if there else {}
            more = {}
            if self.vectors.built():
                # Chunks of documents that are replaced go, under whatever ids they had.
                made = made.persist()
                more["vectors"] = self.vectors.change(made.select("chunk_id", "embedding"), self._chunk_ids(fresh))
            self.store.commit(documents=Change(fresh, gone), chunks=Change(made, gone), **more)
            made.unpersist()
            for name in ("documents", "chunks"):
                self.store.compact(name)
            if more:
                self.vectors.compact()
        report = {"indexed": n["indexed"], "skipped": n["once"] - n["indexed"], "repeated": n["good"] - n["once"], "errors": n["given"] - n["good"]}
        return self.status().select("*", *(F.lit(v).alias(k) for k, v in report.items()))

    def _chunk_ids(self, docs: DataFrame) -> DataFrame:
        return self.table("chunks").join(docs.select("doc_id"), "doc_id", "left_semi").select("chunk_id")

    def build_vector_index(self, n_lists: int | None = None, **more) -> VectorIndex:
        """An index of the vectors of all chunks as they are; it follows later changes, and searches use it if they say how many lists to open."""
        return self.vectors.build(self.table("chunks").select("chunk_id", "embedding"), n_lists, **more)

    def document(self, doc_id: str) -> DataFrame:
        """One document with the beginning of its content and its chunks by position."""
        own = self.table("documents").filter(F.col("doc_id") == str(doc_id))
        return store.view(own, self.chunks_of(doc_id))

    def chunk(self, chunk_id: str) -> DataFrame:
        return self.table("chunks").filter(F.col("chunk_id") == chunk_id)

    def chunks_of(self, doc_id: str) -> DataFrame:
        return self.table("chunks").filter(F.col("doc_id") == str(doc_id)).orderBy("start_pos")

    def documents(self) -> DataFrame:
        """All documents with their number of chunks, the newest first."""
        return store.listing(self.table("documents").drop("content"), self.table("chunks")).orderBy(F.col("indexed_at").desc(), "doc_id")

    def search(self, queries: DataFrame, mode: str | None = None, k: int | None = None, extensions: tuple[str, ...] = (), paths: str | None = None, probes: int | None = None) -> DataFrame:
        """Hits of ``queries`` (query_id, query) by vector, fulltext, code, hybrid (reciprocal ranks) or hybrid-concat.

        Only documents with one of ``extensions``, and whose path matches the pattern ``paths``, are searched.
        With ``probes``, vectors are looked up in the index, in so many of its lists, and hits
        outside the filters are left out.
        """
        mode, k = mode or self.config.get("retrieval.mode"), k or self.config.get("retrieval.top_k")
        began = time.time()
        chunks = self.table("chunks")
        if extensions or paths:
            docs = self.table("documents")
            docs = docs.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)) if extensions else docs
            docs = docs.filter(F.col("path").rlike(paths)) if paths else docs
            chunks = chunks.join(docs.select("doc_id"), "doc_id", "left_semi")
        vectors = with_mock_embedding(queries, "query", self.config.get("embedding.dimension"))
        indexed = lambda: self.vectors.search(vectors, k, probes, exclude_self=False).join(chunks.select("chunk_id"), "chunk_id", "left_semi").withColumn("path", F.lit("vector"))
        vector = lambda: recall.vector_recall(chunks, vectors, k) if probes is None else indexed()
        text = lambda: recall.fulltext_topk(chunks, queries, k)
        if mode == "vector":
            out = vector()
        elif mode == "fulltext":
            out = text()
        elif mode == "code":
            kinds = chunks.join(self.table("documents").select("doc_id", "path"), "doc_id").select("chunk_id", F.when(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*chunking.CODE_EXTENSIONS), F.lit("code")).otherwise(F.lit("text")).alias("kind"))
            out = recall.code_recall(chunks, kinds, vectors, k)
        elif mode == "hybrid-concat":
            out = recall.hybrid_concat(vector(), text(), k)
        elif mode == "hybrid":
            out = fusion.rrf(vector().unionByName(text()), k=k, constant=self.config.get("retrieval.rrf_k"))
        else:
            raise ValueError(f"unknown mode {mode}")
        self.history.append({"at": began, "mode": mode, "plan_seconds": time.time() - began})
        del self.history[:-100]
        return out.join(chunks.select("chunk_id", "doc_id", "content"), "chunk_id")

    def delete(self, paths: DataFrame) -> DataFrame:
        """Take away the documents of ``paths`` with their chunks: path, doc_id, deleted, deleted_chunks of each path, also of those that are not known."""
        docs = self.table("documents").join(paths.select("path").distinct(), "path", "left_semi").select("path", "doc_id")
        counts = self.table("chunks").join(docs, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))
        report = paths.select("path").distinct().join(docs.join(counts, "doc_id", "left"), "path", "left")
        report = report.select("path", "doc_id", F.col("doc_id").isNotNull().alias("deleted"), F.coalesce("n", F.lit(0)).alias("deleted_chunks"))
        gone = {"doc_id": docs.select("doc_id")}
        # The report is stored with the deletion: what it counted is not there any more when it is read.
        more = {"vectors": self.vectors.change(gone=self._chunk_ids(docs))} if self.vectors.built() else {}
        seq = self.store.commit(deleted=Change(report), documents=Change(gone=gone), chunks=Change(gone=gone), **more)
        return self.store.read_commit("deleted", seq)

    def delete_chunks(self, chunk_ids: DataFrame) -> None:
        """Take away single chunks (chunk_id); their documents stay."""
        more = {"vectors": self.vectors.change(gone=chunk_ids)} if self.vectors.built() else {}
        self.store.commit(chunks=Change(gone={"chunk_id": chunk_ids}), **more)

    def drop(self) -> None:
        """Forget all tables and the index."""
        self.vectors.drop()
        self.store.drop("documents", "chunks", "deleted")

    def status(self) -> DataFrame:
        return store.stats(self.table("documents"), self.table("chunks"))

    def prompt(self, name: str, **values: str) -> str:
        return PROMPTS[name].format(**values)
