"""Language identification: words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import received, remainder, require, spread

#: Documents of each language that are learnt from, at most.
SAMPLE, SALTS = 4_000, 32
#: Longest n-gram; least occurrences in the sample for a word and for an n-gram.
LONGEST, WORD_LEAST, GRAM_LEAST = 5, 3, 5
LETTERS = re.compile(r"[^\W\d_]+")
#: Terms of the common distribution that are added to each language's.
PRIOR = 200.0
#: Words that a task remembers before it starts anew.
REMEMBERED = 200_000


def words_in(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams_at(word: str, at: int) -> list[str]:
    """The n-grams that start at a place of the bounded word, longest first."""
    return [word[at : at + n] for n in range(min(LONGEST, len(word) - at), 0, -1)]


def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words (kind 0) and n-grams (kind 1) by language."""
    held: dict[str, Counter] = {}

    def flush() -> pd.DataFrame:
        rows = []
        for lang, words in held.items():
            rows += [(lang, 0, w, n) for w, n in words.items()]
            grams: Counter = Counter()
            for w, n in words.items():
                b = f"^{w}$"
                for at in range(len(b)):
                    for g in grams_at(b, at):
                        grams[g] += n
            rows += [(lang, 1, g, n) for g, n in grams.items()]
        return pd.DataFrame(rows, columns=["lang", "kind", "term", "n"])

    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            words = words_in(text if isinstance(text, str) else None)
            held.setdefault(lang, Counter()).update(words)
            size += len(words)
            if size > 250_000:
                yield flush()
                held, size = {}, 0
    if held:
        yield flush()


class Model:
    """Log frequencies by language of words and of n-grams; unseen words back off to their n-grams."""

    def __init__(self, counts: pd.DataFrame):
        self.languages = sorted(counts["lang"].unique())
        place = {x: k for k, x in enumerate(self.languages)}
        self.rows: list[dict[str, int]] = []
        self.logs: list[np.ndarray] = []
        for kind, least in ((0, WORD_LEAST), (1, GRAM_LEAST)):
            own = counts[counts["kind"] == kind]
            terms, number = np.unique(own["term"].to_numpy(object), return_inverse=True) if len(own) else (np.zeros(0, object), np.zeros(0, int))
            table = np.zeros((len(terms), len(self.languages)))
            np.add.at(table, (number, own["lang"].map(place).to_numpy(int)), own["n"].to_numpy(float))
            total = table.sum(axis=0)
            keep = table.sum(axis=1) >= least
            # Each language is smoothed towards what all have in common, so one with few texts is not favoured by unseen terms.
            common = table.sum(axis=1) / max(1.0, total.sum())
            logs = np.log((table[keep] + PRIOR * common[keep, None] + 1e-3) / (total + PRIOR))
            # Only differences between languages matter; a bound keeps single terms from deciding alone.
            logs = np.clip(logs - logs.sum(axis=1, keepdims=True) / max(1, len(self.languages)), -4, 4).astype(np.float32)
            self.rows.append({t: k for k, t in enumerate(terms[keep].tolist())})
            self.logs.append(logs)

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own if it is known, else the mean of the longest known n-gram at each place."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        known, get = self.rows[0].get, self.rows[1].get
        found, who, sizes = [], [], []
        for k, word in enumerate(words):
            row = known(word)
            if row is not None:
                out[k] = self.logs[0][row]
                continue
            b, before = f"^{word}$", len(found)
            for at in range(len(b)):
                for end in range(min(at + LONGEST, len(b)), at, -1):
                    if (row := get(b[at:end])) is not None:
                        found.append(row)
                        break
            if len(found) > before:
                who.append(k)
                sizes.append(len(found) - before)
        if who:
            n = np.array(sizes)
            out[who] = np.add.reduceat(self.logs[1][found], np.cumsum(n) - n, axis=0) / n[:, None]
        return out


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.letters: list[bool] = []
        self.table = np.zeros((0, len(self.model.languages)), np.float32)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.of) > REMEMBERED:
            self.clear()
        split = [words_in(t) for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.of))
        if new:
            self.of.update(zip(new, range(len(self.of), len(self.of) + len(new)), strict=True))
            self.letters += [any(map(str.isalpha, w)) for w in new]
            self.table = np.concatenate((self.table, self.model.vectors(new)))
        letters = np.array(self.letters, bool)
        names, scores = [], []
        get = self.of.__getitem__
        for words in split:
            ids = np.fromiter(map(get, words), np.int64, len(words))
            ids = ids[letters[ids]] if len(ids) else ids
            if not len(ids) or not self.model.languages:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.table[ids].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            names.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


def learnt(docs: DataFrame, trainable: Column, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` documents of each language, the first of each share in the order of a hash of the id."""
    usable = docs.filter(trainable & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    # Hashes are even, so the first n of a language lie below about n / total of their range; only twice that is ranked, dealt to SALTS shares.
    totals = usable.groupBy("lang").agg(F.least(F.lit(1.0), 2.0 * sample / F.count("*")).alias("part"))
    h = F.xxhash64("id")
    # One row a language, of which the model itself holds far more: rows stay where they lie.
    near = usable.join(F.broadcast(totals), "lang").filter(h <= (F.lit(-(2.0**63)) + F.col("part") * (2.0**64 - 4096)).cast("long"))
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SALTS))).orderBy(h, "id")
    ids = near.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= max(1, sample // SALTS)).select("id").distinct()
    texts = docs.filter(trainable & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = texts.join(F.broadcast(ids), "id").select("lang", "text").mapInPandas(count, "lang string, kind int, term string, n long")
    total = counted.groupBy("lang", "kind", "term").agg(F.sum("n").alias("n"))
    # A term is kept if all languages together reach the least count.
    enough = total.groupBy("kind", "term").agg(F.sum("n").alias("all")).filter((F.col("all") >= F.when(F.col("kind") == 0, WORD_LEAST).otherwise(GRAM_LEAST)))
    rows = total.join(enough.drop("all"), ["kind", "term"]).select("lang", "kind", "term", "n").toArrow().to_pandas()
    return Model(rows)


def language_id(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    Each word known from the sample adds its log frequency in each language; an unseen
    word the mean over its places of the longest known n-gram there. The language with
    the largest sum wins (the first by name on ties); the score is its share after a
    softmax. Only the text of a row is read for its prediction. The sample is bounded
    for each language, so the model is; it is broadcast, and rows are scored where they lie.

    Edge cases: null text, empty text and text without a letter give ``und`` and 0, as do
    all rows where nothing could be learnt; null languages are not learnt from; repeated
    rows get equal results; other columns are ignored; an empty table gives an empty result.
    """
    require(docs, (id_col, text_col, lang_col))
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    shared = spread(docs.sparkSession, learnt(docs, ~held, id_col, text_col, lang_col, sample))

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(received(shared))
        for texts in batches:
            parts = [scorer.score(texts.iloc[k : k + 200].tolist()) for k in range(0, len(texts), 200)]
            yield pd.DataFrame({"lang": [x for a, _ in parts for x in a], "score": [x for _, b in parts for x in b]})

    out = docs.select(F.col(id_col), held.alias("held_out"), predicted(F.col(text_col).cast("string")).alias("p"))
    return out.select(id_col, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def held_out_fold(id_col: Column) -> Column:
    return remainder(id_col, 4) == 2
