"""Periodic runs of words: diagonals of equal words at a lag, followed word by word as sparse dynamic programming."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import fresh, require

# A run has at least so many words, and at least so many times its period.
LEAST, TIMES = 6, 4
#: Rows that are handed on at a time; words before its occurrences from which on a window's are compared as arrays.
TEXTS, MANY = 256, 32
RESULTS = ("n_words", "runs", "collapsed")
RUNS = T.ArrayType(T.StructType([T.StructField(k, T.LongType(), False) for k in ("start", "length", "period")]), False)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def matches_needed(lag: int, least: int, times: int) -> int:
    """Words that equal the one ``lag`` words before them, in a run of that period."""
    return max(least - lag, (times - 1) * lag)


def repeated_windows(ids: np.ndarray, width: int) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Places whose window of ``width`` words has another with the same hash, and the number of the window at each; the same by window, and where each one begins there."""
    n = len(ids) - width + 1
    if n < 2:
        return [], [], ids[:0], ids[:0]
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _MULTIPLIER + ids[k : k + n]
    order = np.argsort(h, kind="stable")
    equal = h[order[1:]] == h[order[:-1]]
    if not equal.any():
        return [], [], ids[:0], ids[:0]
    again = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
    places = order[again]
    first = np.concatenate(([True], h[places[1:]] != h[places[:-1]]))
    number = np.cumsum(first) - 1
    in_text = np.argsort(places)
    return places[in_text].tolist(), number[in_text].tolist(), places, np.append(np.flatnonzero(first), len(places))


def runs_of(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All (start, length, period) of a text: maximal stretches with that smallest period, by start, then period.

    One pass from left to right holds the active lags, each with the word at which its
    match began, so that every further word lengthens all of them. At a word, earlier
    occurrences open new lags; an active lag at which the word differs ends, and gives its
    run at once if it was long enough. Four facts keep this sparse and lose nothing:

    - A run has ``width`` matches in a row at least, so an occurrence opens a lag only where
      the windows of ``width`` words that start there are equal too (by hash; the words
      themselves are compared as the diagonal goes on).
    - A match began earlier, not here, if the words before the two are equal; so occurrences
      are kept by the word before them, and those with the same one are passed over.
    - A lag that the rest of the text is too short for, or whose last needed word differs,
      gives no run.
    - A lag q whose stretch begins where that of an active lag p begins, p dividing q, has
      period p throughout and ends with it: q is not its smallest period.
    """
    n = len(words)
    if n < least:
        return []
    width = min(matches_needed(q, least, times) for q in range(1, least + 1))
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    w = [numbers[x] for x in words]
    ids = np.array([*w, -1])
    places, windows, by_window, begins = repeated_windows(ids[:-1].astype(np.uint64), width)
    out: list[Run] = []
    before: dict[int, dict[int, list[int]]] = {}
    active: dict[int, int] = {}
    # Active lags by the first word of their stretch.
    opened: defaultdict[int, list[int]] = defaultdict(list)

    def end(i: int, lags: list[int]) -> None:
        for q in lags:
            began = active.pop(q)
            opened[began - q].remove(q)
            if i - began >= matches_needed(q, least, times):
                out.append((began - q, i - began + q, q))

    def earlier(i: int, left: int, window: int, met: dict[int, list[int]]) -> Iterator[int]:
        """Earlier occurrences of the window at ``i`` from which a lag may begin here."""
        farthest = i - (n - i) // (times - 1)
        if len(met) > MANY:
            j = by_window[begins[window] : begins[window + 1]]
            j = j[np.searchsorted(j, farthest) : np.searchsorted(j, i)]
            last = np.maximum(least - (i - j), (times - 1) * (i - j)) - 1
            fits = (ids[j - 1] != left) & (i + last < n) & (ids[j] == w[i])
            j, last = j[fits], last[fits]
            yield from j[ids[i + last] == ids[j + last]].tolist()[::-1]
            return
        for other, occurrences in met.items():
            if other == left:
                continue
            for j in occurrences[bisect_left(occurrences, farthest) :]:
                last = matches_needed(i - j, least, times) - 1
                if i + last < n and w[i] == w[j] and w[i + last] == w[j + last]:
                    yield j

    nth, i = 0, places[0] if places else n
    while i < n:
        if active and (over := [q for q in active if w[i] != w[i - q]]):
            end(i, over)
        if nth < len(places) and places[nth] == i:
            left, met = w[i - 1] if i else -1, before.setdefault(windows[nth], {})
            for j in earlier(i, left, windows[nth], met):
                if not any((i - j) % p == 0 for p in opened.get(j, ())):
                    active[i - j] = i
                    opened[j].append(i - j)
            met.setdefault(left, []).append(i)
            nth += 1
        i = i + 1 if active else places[nth] if nth < len(places) else n
    end(n, list(active))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run repeats: of each run only its first period stays."""
    if not runs:
        return b" ".join(words)
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\x01" * (length - period)
    return b" ".join([x for x, g in zip(words, gone, strict=True) if not g])


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period of each, in words from 0) and collapsed.

    Texts are judged where they lie, one at a time in Arrow batches, without a shuffle;
    what is held at a time is one text's words, its repeated windows and active lags.

    Edge cases: null and empty texts have no words, no runs, and an empty ``collapsed``;
    white space of any kind and length parts words, and one space joins those that stay; a
    word repeated throughout is one run of period 1; runs may overlap, and each is judged
    on the whole text, not on what other runs leave; repeated rows get the same result;
    columns that have the name of a result are replaced; an empty table gives an empty result.
    """
    require(docs, (text_col,))
    if least < 1 or times < 2:
        raise ValueError("a run has a word at least, and two periods")
    others = [c for c in docs.columns if c.lower() not in RESULTS]
    # As bytes: whatever a text holds comes back unchanged, and bytes.split() parts at exactly the white space meant.
    given = docs.select(*(f"`{c}`" for c in others), F.col(text_col).cast("string").cast("binary").alias(fresh(docs, "run_text")))
    made = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.BinaryType())]
    schema = T.StructType([*docs.select(*(f"`{c}`" for c in others)).schema.fields, *made])
    names, n_own = schema.names, len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(k, TEXTS)
                sizes, ends, flat, texts = [], [0], [], []
                for text in batch.column(n_own):
                    words = (text.as_py() or b"").split()
                    found = runs_of(words, least, times) if len(words) >= least else []
                    sizes.append(len(words))
                    flat += found
                    ends.append(len(flat))
                    texts.append(collapsed(words, found))
                columns = np.array(flat, np.int64).reshape(-1, 3).T
                fields = [pa.field(f, pa.int64(), False) for f in ("start", "length", "period")]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=fields))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_own], pa.array(sizes, pa.int64()), lists, pa.array(texts, pa.binary())], names)

    return given.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))
