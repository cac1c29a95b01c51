"""Semantic boundaries: valleys of similarity between windows of sentence vectors, and the best cut by dynamic programming."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import cosine, embed

# Scores of boundaries by what marks them; words that turn to something else.
HEADING, PARAGRAPH, TRANSITION = 0.9, 0.7, 0.5
TRANSITIONS = ("然而", "因此", "首先", "其次", "最后", "总之", "另外")
#: Smallest, wished and largest size of a chunk; sentences on either side of a gap; similarity under which a valley parts.
LEAST, TARGET, MOST, SPAN, SIMILAR = 200, 600, 1000, 2, 0.5
#: What a chunk loses when it is twice the wished size, in scores of boundaries.
SIZE_WEIGHT = 0.5
#: Where a piece of text begins: behind the end of a sentence, behind a line, before a transition word.
PIECE = r"(?<=[.!?。！？]\s{1,8})(?=\S)|(?<=\n)|(?=" + "|".join(TRANSITIONS) + ")"


def hashed_words(dims: int = 64) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """An embedder without a model: every word adds or takes one at a place given by its hash."""

    def make():
        def run(texts: list[str]) -> list[list[float]]:
            out = np.zeros((len(texts), dims))
            for row, text in zip(out, texts, strict=True):
                for word in text.lower().split():
                    h = zlib.crc32(word.encode("utf-8", "replace"))
                    row[h % dims] += 1 if h >> 31 else -1
            return out.tolist()

        return run

    return make


def best_cuts(starts: list[int], scores: list[float], end: int, least: int = LEAST, target: int = TARGET, most: int = MOST) -> list[int]:
    """Starts of the chunks of a text of ``end`` characters, for which the sum below is best of all choices.

    A chunk may begin at any of ``starts`` and gains its score there; it loses by how far its
    size is from ``target``, squared. No chunk is larger than ``most``: where two starts are
    farther apart, places at every ``most`` characters between them are added without a score.
    Chunks are no smaller than ``least`` where that is possible: characters missing count
    before everything else. Of equal choices the one whose last cuts come first.
    """
    if end <= 0:
        return []
    gain: dict[int, float] = {}
    for s, x in zip(starts, scores, strict=True):
        if 0 < s < end:
            gain[s] = max(x, gain.get(s, 0.0))
    places = [0]
    for s in [*sorted(gain), end]:
        while s - places[-1] > most:
            places.append(places[-1] + most)
        if s > places[-1]:
            places.append(s)
    # Of the text up to each place: characters missing, minus the sum, and the place before.
    best: list[tuple[int, float, int]] = [(0, 0.0, -1)]
    for j in range(1, len(places)):
        at = places[j]
        choices = []
        for i in range(bisect_left(places, at - most, 0, j), j):
            size = at - places[i]
            loss = SIZE_WEIGHT * ((size - target) / target) ** 2 - gain.get(places[i], 0.0)
            choices.append((best[i][0] + max(0, least - size), round(best[i][1] + loss, 9), i))
        best.append(min(choices))
    cuts, j = [], len(places) - 1
    while j > 0:
        j = best[j][2]
        cuts.append(places[j])
    return cuts[::-1]


def scored_pieces(docs: DataFrame, make: Callable | None = None, span: int = SPAN, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, nth, start, piece, similarity, score): the pieces of each document, and how good a boundary the start of each is.

    Headings, paragraphs and transition words score by what they are. Elsewhere the mean
    vectors of ``span`` pieces before and after are compared; where their similarity is
    lower than at either neighbour and than ``similar``, a valley, it scores 1 - similarity.
    The better of the two counts.
    """
    cut = docs.select("doc_id", F.posexplode(F.split("content", PIECE)).alias("nth", "piece")).filter("piece <> ''")
    told = embed(cut, make or hashed_words(), "piece", "vector").drop("embed_error")
    order = Window.partitionBy("doc_id").orderBy("nth")
    total = lambda rows: F.aggregate(rows, F.array_repeat(F.lit(0.0), F.size(rows[0])), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    before, after = (F.collect_list("vector").over(order.rowsBetween(a, b)) for a, b in ((-span, -1), (0, span - 1)))
    end = F.sum(F.length("piece")).over(order)
    rows = told.select("doc_id", "nth", "piece", (end - F.length("piece")).cast("int").alias("start"), F.lag("piece").over(order).alias("last"), before.alias("before"), after.alias("after"))
    rows = rows.withColumn("similarity", F.when(F.col("start") > 0, cosine(total(F.col("before")), total(F.col("after"))))).drop("before", "after")
    lower = lambda other: F.coalesce(F.col("similarity") < other, F.lit(True))
    valley = (F.col("similarity") < similar) & lower(F.lag("similarity").over(order)) & lower(F.lead("similarity").over(order))
    line = F.col("last").endswith("\n")
    rules = F.greatest(
        F.when(line & F.col("piece").rlike(r"^#{1,3}\s"), HEADING).otherwise(0.0),
        F.when(F.col("last").rlike(r"^\s*\n$") & line, PARAGRAPH).otherwise(0.0),
        F.when(F.col("piece").rlike("^(" + "|".join(TRANSITIONS) + ")"), TRANSITION).otherwise(0.0),
        F.when(valley, 1 - F.col("similarity")).otherwise(0.0),
    )
    return rows.withColumn("score", F.when(F.col("start") > 0, F.round(rules, 9)).otherwise(0.0)).drop("last")


def semantic_chunks(docs: DataFrame, least: int = LEAST, target: int = TARGET, most: int = MOST, make: Callable | None = None, span: int = SPAN, similar: float = SIMILAR) -> DataFrame:
    """Chunks of ``docs`` (doc_id, content) that begin at boundaries of meaning, cut so that scores and sizes together are best.

    Vectors come from ``make`` (as for ``embed``), by default from hashed words. Pieces are
    rows, so vectors are made in batches over all documents; windows compare them by
    document; only starts and scores, not texts, come together for the cut.
    """
    if not 0 < least <= target <= most:
        raise ValueError("sizes must be in order")

    @F.pandas_udf("array<int>")
    def cuts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([best_cuts([s for s, _ in own], [x for _, x in own], n, least, target, most) for own, n in ((sorted((p["start"], p["score"]) for p in places), int(sum(p["size"] for p in places))) for places in rows)])

    place = F.struct("start", "score", F.length("piece").alias("size"))
    starts = scored_pieces(docs, make, span, similar).groupBy("doc_id").agg(F.collect_list(place).alias("places"))
    starts = starts.select("doc_id", cuts("places").alias("starts"))
    own = docs.join(starts, "doc_id")
    each = own.select(*docs.columns, F.posexplode(F.arrays_zip("starts", F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.length("content"))).alias("ends"))).alias("ordinal", "x"))
    out = each.withColumn("start_pos", F.col("x.starts")).withColumn("end_pos", F.col("x.ends")).drop("x")
    text = F.substring("content", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    return out.withColumn("content", text).withColumn("section", F.lit(None).cast("string"))
