"""Splitters that follow meaning: semantic boundaries, units of code, several granularities.

Their state (where the last chunk ended) needs a function over each text, run on Arrow
batches; documents stay where they lie.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Transition words; smallest and largest chunks and the similarity under which sentences part.
TRANSITIONS = ("然而", "因此", "首先", "其次", "最后", "总之", "另外")
LEAST, MOST, SIMILAR = 200, 1000, 0.1
COARSE, MEDIUM, FINE = (1000, 3000), (200, 500), (50, 150)
HEADING = re.compile(r"^#{1,3}\s.+", re.M)
UNIT = re.compile(r"^(?:export\s+|public\s+|async\s+)*(?:def|class|function|interface|func|type|enum)\b.*", re.M)


def likeness(a: Counter, b: Counter) -> float:
    """The cosine of two bags of words."""
    norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b[k] for k, v in a.items()) / norm if norm else 0.0


def boundaries(content: str, similar: float) -> list[int]:
    """Places where a new topic may begin: headings, blank lines, transition words, sentences with little in common."""
    found = {m.start() for m in HEADING.finditer(content)} | {m.end() for m in re.finditer(r"\n\n+", content)}
    found |= {m.start() for w in TRANSITIONS for m in re.finditer(w, content)}
    starts = [0, *(m.end() for m in re.finditer(r"[.!?。！？]\s+|\n", content))]
    bags = [Counter(content[a:b].lower().split()) for a, b in zip(starts, [*starts[1:], len(content)], strict=True)]
    found |= {starts[k] for k in range(1, len(bags)) if likeness(bags[k - 1], bags[k]) < similar}
    return sorted(p for p in found if 0 < p < len(content))


def semantic_parts(content: str, least: int = LEAST, most: int = MOST, similar: float = SIMILAR) -> list[tuple[int, str]]:
    """Chunks end at the first boundary from ``least`` characters on; longer stretches are cut at ``most``."""
    out, begin = [], 0
    for p in [*boundaries(content, similar), len(content)]:
        if p - begin < least and p < len(content):
            continue
        while p - begin > most:
            out.append((begin, content[begin : begin + most]))
            begin += most
        if p > begin:
            out.append((begin, content[begin:p]))
            begin = p
    # A short rest joins the chunk before it, if that leaves it within bounds.
    if len(out) > 1 and len(out[-1][1]) < least and len(out[-2][1]) + len(out[-1][1]) <= most:
        (start, text), (_, rest) = out[-2:]
        out[-2:] = [(start, text + rest)]
    return out


def code_parts(content: str, most: int = MOST) -> list[tuple[int, str]]:
    """One chunk for each unit that begins a line, with what follows it; units over ``most`` are cut."""
    cuts = sorted({0, *(m.start() for m in UNIT.finditer(content)), len(content)})
    return [(a + k, content[a + k : min(a + k + most, b)]) for a, b in zip(cuts, cuts[1:], strict=False) for k in range(0, b - a, most)]


def by_parts(docs: DataFrame, split: Callable[[str], list[tuple[int, str]]]) -> DataFrame:
    @F.pandas_udf("array<struct<start_pos: int, content: string>>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start_pos": s, "content": c} for s, c in split(t or "")] for t in texts])

    at = docs.withColumn("parts", parts.asNondeterministic()("content")).select("*", F.posexplode("parts").alias("ordinal", "p"))
    out = at.withColumn("content", F.col("p.content")).withColumn("start_pos", F.col("p.start_pos")).drop("p", "parts")
    return out.withColumn("end_pos", F.col("start_pos") + F.length("content")).withColumn("section", F.lit(None).cast("string"))


def semantic_boundary(docs: DataFrame, least: int = LEAST, most: int = MOST, similar: float = SIMILAR) -> DataFrame:
    return by_parts(docs, lambda t: semantic_parts(t, least, most, similar))


def code_units(docs: DataFrame, most: int = MOST) -> DataFrame:
    return by_parts(docs, lambda t: code_parts(t, most))


def nested_parts(content: str) -> list[tuple[str, int, int, int, str]]:
    """(granularity, number of the parent in the granularity above or -1, own number, start, text), coarse parts first."""
    out, above = [], [(-1, 0, content)]
    for name, (least, most) in (("coarse", COARSE), ("medium", MEDIUM), ("fine", FINE)):
        own = [(k, at + s, t) for k, at, whole in above for s, t in semantic_parts(whole, least, most)]
        out += [(name, k, nth, s, t) for nth, (k, s, t) in enumerate(own)]
        above = [(k, s, t) for k, (_, s, t) in enumerate(own)]
    return out


def multi_granularity(docs: DataFrame) -> DataFrame:
    """Chunks at three sizes: granularity, ordinal within it, parent (ordinal in the next larger one, or -1)."""

    @F.pandas_udf("array<struct<granularity: string, parent: int, ordinal: int, start_pos: int, content: string>>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("granularity", "parent", "ordinal", "start_pos", "content")
        for texts in batches:
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in nested_parts(t or "")] for t in texts])

    each = docs.withColumn("x", F.explode(parts.asNondeterministic()("content"))).drop("content")
    out = each.select("*", "x.*").drop("x")
    return out.withColumn("end_pos", F.col("start_pos") + F.length("content"))
