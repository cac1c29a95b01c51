"""Tables as immutable segments with a manifest: changes are appended, merged when read, and compacted by size."""

from __future__ import annotations

import math
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The commit that a row came with; the folder of its segment; segments of like size that are merged into one.
SEQ, SEGMENT, FAN = "_seq", "_segment", 8
MANIFEST = "seq long, name string, kind string, path string, rows long, by string, replaces array<string>"


def work_folder(spark: SparkSession) -> str:
    """A folder of this application that driver and executors share: under ``spark.checkpoint.dir``, or local for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/quarry-store/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@dataclass
class Change:
    """Rows that come, and keys that go: column name to a table of its values. Keys go before the rows of the same change come."""

    rows: DataFrame | None = None
    gone: dict[str, DataFrame] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()


class Segments:
    """The tables under ``root``. A change writes only its own rows and keys; nothing that is there is written again.

    One row group appended to the manifest makes a change of several tables current at
    once, so readers and reruns never see half of it, and another ``Segments`` on the same
    root finds it. One writer at a time; any number of readers. What the driver holds is
    the manifest alone: a row for each segment, and compaction keeps these few.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> list:
        try:
            return sorted(self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest").collect(), key=lambda r: r["seq"])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def entries(self, name: str, manifest: list | None = None) -> list:
        """Segments of a table that count: those since it was last dropped that no other has replaced."""
        own = [r for r in (self.manifest() if manifest is None else manifest) if r["name"] == name]
        start = max((r["seq"] for r in own if r["kind"] == "drop"), default=-1)
        replaced = {p for r in own for p in r["replaces"] or ()}
        return [r for r in own if r["seq"] > start and r["kind"] != "drop" and r["path"] not in replaced]

    def names(self) -> set[str]:
        m = self.manifest()
        return {name for name in {r["name"] for r in m} if any(x["kind"] == "rows" for x in self.entries(name, m))}

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _written(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> tuple[str, int]:
        path = f"{self.root}/{name}/{SEGMENT}=s{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(path)
        return path, self._files(name, [path]).count()

    def _files(self, name: str, paths: list[str]) -> DataFrame:
        """Segments side by side: folders of one table, so that partitions inside them are found as such."""
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths).drop(SEGMENT)

    def commit(self, **changes: Change) -> int:
        """Make changes of tables current at once; the number of the commit."""
        seq, out = time.time_ns(), []
        for name, change in changes.items():
            for by, keys in change.gone.items():
                out.append((seq, name, "gone", *self._written(keys.select(by).distinct().withColumn(SEQ, F.lit(seq)), f"{name}-gone"), by, None))
            if change.rows is not None:
                out.append((seq, name, "rows", *self._written(change.rows.withColumn(SEQ, F.lit(seq)), name, change.partition_by), None, None))
        self._append(out)
        return seq

    def _rows(self, name: str, entries: list) -> DataFrame:
        """Rows of some segments without those that a later change took away; each carries its commit."""
        rows = self._files(name, [r["path"] for r in entries if r["kind"] == "rows"])
        oldest = min(r["seq"] for r in entries if r["kind"] == "rows")
        gone: dict[str, list[str]] = {}
        for r in entries:
            if r["kind"] == "gone" and r["seq"] > oldest:
                gone.setdefault(r["by"], []).append(r["path"])
        for by, paths in gone.items():
            last = self._files(f"{name}-gone", paths).groupBy(F.col(by).alias("_key")).agg(F.max(SEQ).alias("_gone"))
            rows = rows.join(last, (rows[by] == last["_key"]) & (rows[SEQ] < last["_gone"]), "left_anti")
        return rows

    def read(self, name: str) -> DataFrame:
        """The table as of now."""
        return self._rows(name, self.entries(name)).drop(SEQ)

    def read_commit(self, name: str, seq: int) -> DataFrame:
        """The rows that one commit brought."""
        return self._files(name, [r["path"] for r in self.manifest() if (r["name"], r["seq"], r["kind"]) == (name, seq, "rows")]).drop(SEQ)

    def drop(self, *names: str) -> None:
        """Forget tables; readers of earlier states keep their files."""
        seq = time.time_ns()
        self._append([(seq, name, "drop", None, 0, None, None) for name in names])

    def compact(self, name: str, fan: int = FAN, partition_by: tuple[str, ...] = ()) -> int:
        """Merge segments of like size, if there are ``fan`` of them, and forget deletions that no segment needs; how many segments went.

        A row is merged about once for each power of ``fan`` that the table has grown by.
        """
        entries = self.entries(name)
        tiers: dict[int, list] = {}
        for r in entries:
            if r["kind"] == "rows":
                tiers.setdefault(int(math.log(max(r["rows"], 1), fan)), []).append(r)
        full = [r for tier in tiers.values() if len(tier) >= fan for r in tier]
        out, seq = [], time.time_ns()
        if full:
            path, n = self._written(self._rows(name, [*full, *(r for r in entries if r["kind"] == "gone")]), name, partition_by)
            out.append((seq, name, "rows", path, n, None, [r["path"] for r in full]))
        merged = {r["path"] for r in full}
        # A segment knows all deletions up to its own commit, or to when it was merged.
        oldest = min((r["seq"] for r in entries if r["kind"] == "rows" and r["path"] not in merged), default=seq)
        needless = [r["path"] for r in entries if r["kind"] == "gone" and r["seq"] <= oldest]
        if needless:
            out.append((seq, name, "forgotten", None, 0, None, needless))
        if out:
            self._append(out)
        return len(full) + len(needless)
