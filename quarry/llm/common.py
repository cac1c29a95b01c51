"""Helpers that the training-data operators share."""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space class of every contract in this package.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# Runs of white space other than one plain space: replacing only these by one space normalises a text.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "a an and are as at be by for from had has have he in is it not of on or that the this to was we were which with you".split(),
    "de": "als am an auf aus bei das dem den der des die ein eine einer es für hat im in ist mit nicht sich sie und von zu zum".split(),
    "fr": "au aux avec ce dans de des du elle en est et il je la le les ne on par pas pour qui que se sur un une".split(),
    "es": "al como con de del el en es la las lo los mi no para pero por que se su un una y".split(),
}

#: Spark's setting that frees the shuffle files of a query at its end.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The folder of this application under the one that driver and executors share (``spark.checkpoint.dir``).

    Where that is unset a local folder will do for a local master alone: on a cluster each
    executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/quarry/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results that were not written yet are lost with them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def all_columns(df: DataFrame) -> Column:
    """A hash of a whole row: an order of rows that agree in their keys which no rerun changes."""
    return F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it as a table in the shared folder and read it again.

    A lost executor then costs only the tasks it was running, and random or
    partition-dependent columns are computed once. Shuffle files go as soon as the table
    is written, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def normalised(text: Column) -> Column:
    """``text`` with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Words of one text as UTF-8, A-Z lower-cased; bytes.split() cuts at exactly the contract's white space."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread(spark: SparkSession, value):
    """Broadcast an object of this package by value: executors need no copy of the package to read it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared):
    return pickle.loads(shared.value)
