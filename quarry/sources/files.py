"""Documents from folders of text files, and tables in Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is indexed unless filters say otherwise.
EXTENSIONS = (".md", ".txt", ".ts", ".js", ".py", ".go", ".java", ".json", ".yaml", ".yml")


def wanted(path: Column, filters: Sequence[str] = ()) -> Column:
    """``*.x`` filters by ending, others by what the path holds; without filters, the usual extensions."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(False)
    for f in filters or [f"*{e}" for e in EXTENSIONS]:
        out = out | (name.endswith(f[1:]) if f.startswith("*.") else name.contains(f))
    return out


def read_folder(spark: SparkSession, folder: str, recursive: bool = True, filters: Sequence[str] = ()) -> DataFrame:
    """doc_id, path, content, size, modified_at, error of each file. Bytes that are not UTF-8 give an error, not a failure.

    Names are filtered before contents are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    kept = files.filter(wanted(F.col("path"), filters))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return kept.select(
        F.sha2("path", 256).alias("doc_id"),
        "path",
        text.alias("content"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
        F.when(text.isNull(), F.lit("not UTF-8")).alias("error"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as documents with a path; the extension goes by the id."""
    ext = F.element_at(F.array(*map(F.lit, ("md", "ts", "js", "py", "json", "txt"))), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("content"), "source", "lang", "n_chars")
