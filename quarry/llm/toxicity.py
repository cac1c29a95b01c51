"""Toxicity: a convolutional text classifier in numpy, calibrated by language."""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import FUNCTION_WORDS, received, require, saved, spread, words_of

#: Rows of the hashed embedding, its length, filters of each width.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 16, 8, (1, 2, 3)
#: Labelled rows that one task descends over between two means of all nets; rows of the embedding that travel together.
SHARD, SLICE = 4096, 4096
#: Logits of several shards' held-back rows are told apart to so many digits when thresholds are chosen.
DIGITS = 2
EPOCHS, BATCH, RATE = 3, 32, 0.05
#: Beginnings of a word that are hashed beside the word itself, in characters.
BEGINNINGS = (4, 5, 6, 7, 8)
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Tokens that are scored at a time; longer texts are scored in pieces and pooled again.
TOKENS = 100_000
LANGUAGES = tuple(FUNCTION_WORDS)
#: Examples of each class that a language needs for a threshold of its own.
ENOUGH = 25


def hashed_features(bare: bytes) -> tuple[int, ...]:
    """Rows of the embedding whose sum stands for a word without the marks around it: the word, and its beginnings (0: it has none of that length)."""
    text = bare.decode("utf-8", "replace").lower()
    size, rows = len(text), [crc32(text.encode()) % (BUCKETS - 1) + 1]
    rows += [crc32(text[:n].encode(), n) % (BUCKETS - 1) + 1 if n < size else 0 for n in BEGINNINGS]
    return tuple(rows)


class Words:
    """Distinct words met so far: number, hashed features, language whose function words hold it (-1: none or several).

    Words that differ only in the marks around them share a number.
    """

    def __init__(self):
        self.of: dict[bytes, int] = {}
        self.bare: dict[bytes, int] = {}
        self.features = array("i", (0,) * (1 + len(BEGINNINGS)))  # a row for each number, in a row; number 0 is the padding
        self.languages = [-1]
        self.vectors, self.language = np.zeros((0, DIM), np.float32), np.zeros(0, np.int64)
        known = {}
        for k, words in enumerate(FUNCTION_WORDS.values()):
            for w in words:
                known[w.encode()] = -1 if w.encode() in known else k
        self.known = known

    def numbers(self, words: list[bytes]) -> list[int]:
        found = list(map(self.of.get, words))
        if None in found:
            for w in {w for w, n in zip(words, found, strict=True) if n is None}:
                bare = w.strip(EDGES) or w
                number = self.bare.get(bare)
                if number is None:
                    number = self.bare[bare] = len(self.languages)
                    self.features.extend(hashed_features(bare))
                    self.languages.append(self.known.get(bare, -1))
                self.of[w] = number
            found = list(map(self.of.get, words))
        return found

    def ready(self, net: Net) -> tuple[np.ndarray, np.ndarray]:
        """The vectors under one net, and the languages, of all words so far; only new ones are worked out."""
        done = len(self.vectors)
        if done < len(self.languages):
            new = self.rows()[done:]
            self.vectors = np.concatenate((self.vectors, *(net.table[new[k : k + 20_000]].sum(axis=1) for k in range(0, len(new), 20_000))))
            self.language = np.array(self.languages)
        return self.vectors, self.language

    def rows(self) -> np.ndarray:
        """The hashed features of all words so far, a row for each number."""
        return np.array(self.features, np.int32).reshape(-1, 1 + len(BEGINNINGS))


class Net:
    """Embeddings, filters of each width over neighbouring words, the maximum of each over the text, one logit."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.table[0] = 0
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.filters[0][0, :, 0] = 0
        self.filters[0][0, 0, 0] = 1  # this filter reads the first dimension, which starts as the word's log odds
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = np.full((len(WIDTHS), FILTERS), 0.1, np.float32)
        self.out[0, 0] = 1
        self.shift = -1.5
        self.threshold = np.zeros(len(LANGUAGES) + 1)

    def maps(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter values at each place; ``x`` ends each text with paddings, so no window reaches into the next."""
        out = []
        for k, w in enumerate(WIDTHS):
            z = x @ self.filters[k][0] + self.bias[k]
            for j in range(1, w):
                z[:-j] += x[j:] @ self.filters[k][j]
            out.append(z)
        return out

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out.reshape(-1) + self.shift


PAD = max(WIDTHS) - 1


def padded(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of texts in a row, each followed by padding, and where each starts."""
    flat, starts = [], []
    for d in docs:
        starts.append(len(flat))
        flat += d or [0]
        flat += [0] * PAD
    return np.array(flat), np.array(starts)


def train_and_held(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Four fifths of ``n`` texts to train on, and the rest, by which thresholds are chosen."""
    fold = np.arange(n) % 5 == 4
    return np.flatnonzero(~fold), np.flatnonzero(fold)


def rows_seen(features: np.ndarray, docs: list[np.ndarray], toxic: np.ndarray, train: np.ndarray) -> np.ndarray:
    """How many texts of each class have each hashed row."""
    seen = np.zeros((2, BUCKETS))
    for d in train:
        rows = np.unique(features[np.unique(docs[d])]) if len(docs[d]) else np.zeros(0, int)
        seen[int(toxic[d]), rows] += 1
    return seen


def begun(seen: np.ndarray, sizes: np.ndarray, seed: int = 5) -> Net:
    """A net whose first dimension holds the log odds of each hashed row between the classes, over the texts that have it."""
    net = Net(seed)
    share = (seen + 0.5) / (sizes[:, None] + 1.0)
    net.table[:, 0] = np.clip(np.log(share[1] / share[0]), -3, 5) / (1 + len(BEGINNINGS))
    net.table[(seen.sum(axis=0) < 2), 0] = 0
    net.table[0] = 0
    return net


class Past:
    """Sums of squared gradients so far, by which steps get shorter."""

    def __init__(self, net: Net):
        self.table, self.shift = np.full(BUCKETS, 0.1, np.float32), 0.1
        self.params = [np.full_like(p, 0.1) for p in (net.bias, net.out, *net.filters)]


def descend(net: Net, past: Past, features: np.ndarray, docs: list[np.ndarray], toxic: np.ndarray, order: np.ndarray) -> None:
    """One round of steps over the texts in ``order``; changes the net and its past."""
    params = [net.bias, net.out, *net.filters]
    for some in np.array_split(order, max(1, len(order) // BATCH)):
        flat, starts = padded([docs[d].tolist() for d in some])
        x = net.table[features[flat]].sum(axis=1)
        maps = net.maps(x)
        ends = np.append(starts[1:], len(flat)) - PAD
        best = np.array([[z[a:b].argmax(axis=0) + a for z in maps] for a, b in zip(starts, ends, strict=True)])
        pooled = np.stack([maps[k][best[:, k], np.arange(FILTERS)] for k in range(len(WIDTHS))], axis=1)
        p = 1 / (1 + np.exp(-net.logit(pooled.reshape(len(some), -1))))
        d = ((p - toxic[some]) / len(some)).astype(np.float32)
        live = np.maximum(pooled, 0)
        g_out = np.einsum("n,nkf->kf", d, live)
        g_pool = d[:, None, None] * net.out * (pooled > 0)
        grads = [g_pool.sum(axis=0), g_out]
        rows, deltas = [], []
        for k, w in enumerate(WIDTHS):
            at = best[:, k, :, None] + np.arange(w)
            grads.append(np.einsum("nf,nfwd->wdf", g_pool[:, k], x[at]))
            back = np.einsum("nf,wdf->nfwd", g_pool[:, k], net.filters[k])
            for c in range(features.shape[1]):
                rows.append(features[flat[at], c].reshape(-1))
                deltas.append(back.reshape(-1, DIM))
        rows, deltas = np.concatenate(rows), np.concatenate(deltas)
        some_rows, where = np.unique(rows, return_inverse=True)
        g = np.zeros((len(some_rows), DIM), np.float32)
        np.add.at(g, where, deltas)
        past.table[some_rows] += (g * g).mean(axis=1) * 100
        net.table[some_rows] -= RATE * g / np.sqrt(past.table[some_rows])[:, None]
        net.table[0] = 0
        for q, v, g in zip(params, past.params, grads, strict=True):
            v += g * g * 100
            q -= RATE * g / np.sqrt(v)
        past.shift += float(d.sum()) ** 2 * 100
        net.shift -= RATE * float(d.sum()) / past.shift**0.5


def choose_thresholds(net: Net, scores: np.ndarray, languages: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray) -> None:
    """The net's threshold for each language, from logits of texts it was not trained on: class, weight and number of the texts of each."""
    net.threshold[:] = best_threshold(scores, y, w)
    for k in range(len(LANGUAGES)):
        own = languages == k
        if min(n[own & (y == 1)].sum(), n[own & (y == 0)].sum()) >= ENOUGH:
            net.threshold[k] = best_threshold(scores[own], y[own], w[own])


def fit(words: Words, docs: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, seed: int = 5) -> Net:
    """Train on four fifths of the texts of one shard, given as word numbers; choose the languages' thresholds on the rest."""
    rng = np.random.default_rng(seed)
    features = words.rows()
    train, held = train_and_held(len(docs))
    sizes = np.array([(toxic[train] == c).sum() for c in (0, 1)])
    net = begun(rows_seen(features, docs, toxic, train), sizes, seed)
    if len(train) and sizes.all():
        past = Past(net)
        for _ in range(EPOCHS):
            descend(net, past, features, docs, toxic, rng.permutation(train))
    scores, languages = raw_scores(net, words, [docs[d].tolist() for d in held])
    choose_thresholds(net, scores, languages, toxic[held], weight[held], np.ones(len(held), int))
    return net


def best_threshold(score: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The logit between two examples that gives the best F1 under the weights; 0 where a class is missing."""
    if not len(score) or not (toxic == 1).any() or not (toxic == 0).any():
        return 0.0
    order = np.argsort(-score, kind="stable")
    s, hit, w = score[order], toxic[order] == 1, weight[order]
    caught, called = np.cumsum(w * hit), np.cumsum(w)
    f1 = 2 * caught / (called + (w * hit).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 1)


def raw_scores(net: Net, words: Words, docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Logits and guessed languages of texts given as word numbers."""
    vectors, language = words.ready(net)
    pooled = np.full((len(docs), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    votes = np.zeros((len(docs), len(LANGUAGES) + 1), np.int64)
    owner, parts, size = [], [], 0

    def flush() -> None:
        flat, starts = padded(parts)
        # Windows that start in the padding are left out, except for an empty text, and so are those of the next piece.
        n = np.array([min(max(1, len(p)), TOKENS) for p in parts])
        of = np.repeat(owner, n)
        np.add.at(votes, (of, language[flat[np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)]]), 1)
        inside = np.stack((starts, starts + n), axis=1).reshape(-1)
        top = np.concatenate([np.maximum.reduceat(z, inside, axis=0)[::2] for z in net.maps(vectors[flat])], axis=1)
        np.maximum.at(pooled, owner, top)

    for d, numbers in enumerate(docs):
        for k in range(0, max(1, len(numbers)), TOKENS):
            owner.append(d)
            parts.append(numbers[k : k + TOKENS + PAD])
            size += len(parts[-1])
            if size > TOKENS:
                flush()
                owner, parts, size = [], [], 0
    if parts:
        flush()
    guess = votes[:, :-1].argmax(axis=1) if len(docs) else np.zeros(0, np.int64)
    return net.logit(pooled), np.where(votes[:, :-1].max(axis=1, initial=0) > 0, guess, len(LANGUAGES))


def score_column(text: Column, shared) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net, words = received(shared), Words()
        for texts in batches:
            out = []
            for k in range(0, len(texts), 200):
                if len(words.of) > 150_000:
                    words = Words()
                docs = [words.numbers(words_of(t)) for t in texts.iloc[k : k + 200]]
                logit, language = raw_scores(net, words, docs)
                out.append(1 / (1 + np.exp(-np.clip(logit - net.threshold[language], -30, 30))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return run(text)


def numbered(batch_sizes: int):
    """What a task does with labelled texts in order of shard, id and text: (shard, part, blob) with the word numbers of each shard."""

    def packed(shard: int, part: int, words: Words, docs: list, toxic: list) -> pd.DataFrame:
        order = np.random.default_rng(3).permutation(len(docs))
        sizes = [len(docs[k]) for k in order]
        flat = np.concatenate([docs[k] for k in order]) if docs else np.zeros(0, np.int32)
        state = (words.rows(), np.array(words.languages, np.int8), flat, np.array(sizes), np.array(toxic, np.int64)[order])
        return pd.DataFrame({"shard": [shard], "part": [part], "blob": [zlib.compress(pickle.dumps(state), 1)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, part, words, docs, toxic = None, 0, Words(), [], []
        for batch in batches:
            for s, text, y in zip(batch["shard"], batch["text"], batch["y"], strict=True):
                # Copies of one row all have one shard; more of them than two shards hold are parted.
                if docs and (s != shard or len(docs) >= 2 * batch_sizes):
                    yield packed(shard, part, words, docs, toxic)
                    words, docs, toxic, part = Words(), [], [], part + 1
                part = part if s == shard else 0
                shard = s
                docs.append(np.array(words.numbers(words_of(text if isinstance(text, str) else None)), np.int32))
                toxic.append(int(y))
        if docs:
            yield packed(shard, part, words, docs, toxic)

    return run


def unpacked(blob: bytes) -> tuple[Words, list[np.ndarray], np.ndarray]:
    """Words, texts as word numbers, and classes of a shard."""
    features, languages, flat, sizes, toxic = pickle.loads(zlib.decompress(blob))
    words = Words()
    words.features, words.languages = array("i", features.reshape(-1).tobytes()), languages.tolist()
    return words, np.split(flat, np.cumsum(sizes)[:-1]), toxic


def by_shard(shards: DataFrame, of, schema: str) -> DataFrame:
    """Rows that ``of(shard, part, words, docs, toxic)`` gives of each shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, part, blob in zip(batch["shard"], batch["part"], batch["blob"], strict=True):
                yield of(shard, part, *unpacked(blob))

    return shards.mapInPandas(run, schema)


def counted(shard, part, words, docs, toxic) -> pd.DataFrame:
    """Texts to train on that have each hashed row, by class; row -1: all of them."""
    train, _ = train_and_held(len(docs))
    seen = rows_seen(words.rows(), docs, toxic, train)
    rows = np.flatnonzero(seen.sum(axis=0))
    sizes = [[(toxic[train] == c).sum()] for c in (0, 1)]
    return pd.DataFrame({"row": np.concatenate(([-1], rows)), "plain": np.concatenate((sizes[0], seen[0, rows])).astype(int), "toxic": np.concatenate((sizes[1], seen[1, rows])).astype(int)})


def descended(shared, turn: int):
    """One round over a shard from the common net: rows of the embedding that moved and their past, by slice; slice -1 has the other parameters."""

    def of(shard, part, words, docs, toxic) -> pd.DataFrame:
        net, past = received(shared)
        old = np.concatenate((net.table, past.table[:, None]), axis=1)
        train, _ = train_and_held(len(docs))
        descend(net, past, words.rows(), docs, toxic, np.random.default_rng([5, int(shard), int(part), turn]).permutation(train))
        new = np.concatenate((net.table, past.table[:, None]), axis=1)
        moved = (new != old).any(axis=1)
        new[~moved] = 0
        rest = np.concatenate([x.reshape(-1) for x in (net.bias, net.out, *net.filters, *past.params)] + [[net.shift, past.shift]])
        cuts = range(0, BUCKETS, SLICE)
        values = [rest.astype(np.float32).tobytes(), *(new[a : a + SLICE].tobytes() for a in cuts)]
        times = [np.ones(1, np.int64).tobytes(), *(moved[a : a + SLICE].astype(np.int64).tobytes() for a in cuts)]
        return pd.DataFrame({"slice": np.arange(-1, len(cuts)), "shard": shard, "part": part, "value": values, "times": times})

    return of


def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums by slice of rows that come in order of slice: one slice is held at a time."""
    at, value, times = None, None, None
    row = lambda: pd.DataFrame({"slice": [at], "value": [value.tobytes()], "times": [times.tobytes()]})
    for batch in batches:
        for s, v, t in zip(batch["slice"], batch["value"], batch["times"], strict=True):
            v, t = np.frombuffer(v, np.float32).astype(float), np.frombuffer(t, np.int64)
            if at is not None and s != at:
                yield row()
            at, value, times = s, (value + v if s == at else v), (times + t if s == at else t)
    if at is not None:
        yield row()


def follow(net: Net, past: Past, sums: list) -> None:
    """Set the net to the mean over shards: each row of the embedding over those that moved it, all else over all."""
    for r in sums:
        value, times = np.frombuffer(r["value"]), np.frombuffer(r["times"], np.int64)
        if r["slice"] >= 0:
            rows = r["slice"] * SLICE + np.flatnonzero(times)
            mean = value.reshape(len(times), -1)[times > 0] / times[times > 0, None]
            net.table[rows], past.table[rows] = mean[:, :-1], mean[:, -1]
            continue
        rest, k = value / times, 0
        for x in (net.bias, net.out, *net.filters, *past.params):
            x[...] = rest[k : k + x.size].reshape(x.shape)
            k += x.size
        net.shift, past.shift = float(rest[k]), float(rest[k + 1])


def held_back(shared):
    """How many held-back texts of a shard have each logit, by language and class."""

    def of(shard, part, words, docs, toxic) -> pd.DataFrame:
        _, held = train_and_held(len(docs))
        scores, languages = raw_scores(received(shared), words, [docs[d].tolist() for d in held])
        each = pd.DataFrame({"language": languages, "score": np.round(scores.astype(float), DIGITS), "y": toxic[held]})
        return each.groupby(["language", "score", "y"], as_index=False).size().rename(columns={"size": "n"})

    return of


def trained(totals: dict[int, int]):
    """What a task does with the only shard there is: it gives the net's state."""

    def of(shard, part, words, docs, toxic) -> pd.DataFrame:
        weight = np.array([totals.get(c, 0) / max(1, (toxic == c).sum()) for c in (0, 1)])
        return pd.DataFrame({"net": [pickle.dumps(vars(fit(words, docs, toxic, weight[toxic])))]})

    return of


def learnt(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", shard_rows: int | None = None) -> Net:
    """A net fitted on all labelled rows of ``docs`` for which ``trainable`` is true.

    The rows are dealt to shards of about ``shard_rows`` by a hash of the id, and each shard is
    kept as word numbers. Log odds are counted over all of them. Then every shard descends from
    the common net, and the net becomes the mean of theirs, once for each of ``EPOCHS``
    rounds; rows of the embedding are averaged over the shards that moved them. Thresholds
    are chosen by the held-back fifth of all shards. One shard alone is fitted in one task.
    The driver holds a net and counts, whose size is fixed. Null labels are left out, and an id with
    several labels counts as toxic if one says so.
    """
    size = shard_rows or SHARD
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    if trainable is not None:
        docs = docs.filter(trainable)
        y = y.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    totals = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL")
    y = y.withColumn("id", F.col("id").cast(texts.schema["id"].dataType))
    n_shards = max(1, round(texts.select("id").join(y, "id").count() / size))
    # Texts and labels meet in the shard of their id: one shuffle, whether or not the labels would fit a broadcast.
    both = texts.withColumn("y", F.lit(None).cast("int")).unionByName(y.withColumn("text", F.lit(None).cast("string")).withColumn("told", F.lit(True)), allowMissingColumns=True)
    both = both.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards))).repartition(n_shards, "shard")
    met = both.withColumn("y", F.max("y").over(Window.partitionBy("shard", "id"))).filter("y IS NOT NULL AND told IS NULL")
    rows = met.sortWithinPartitions("shard", "id", F.col("text").asc_nulls_last())
    shards = saved(rows.select("shard", "text", "y").mapInPandas(numbered(size), "shard long, part long, blob binary"))
    net = Net()
    n_parts = shards.select("shard").count()
    if n_parts <= 1:
        for r in by_shard(shards, trained(totals), "net binary").collect():  # none without rows: the net keeps its start
            vars(net).update(pickle.loads(r["net"]))
        return net
    spark = docs.sparkSession
    found = by_shard(shards, counted, "row int, plain long, toxic long").groupBy("row").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"))
    table = found.toArrow()  # at most one row for each of the embedding
    at, seen = table.column("row").to_numpy(), np.zeros((2, BUCKETS + 1))
    seen[0, at], seen[1, at] = table.column("plain").to_numpy(), table.column("toxic").to_numpy()
    sizes = seen[:, -1]
    net = begun(seen[:, :-1], sizes)
    if sizes.all():
        past = Past(net)
        for turn in range(EPOCHS):
            shared = spread(spark, (net, past))
            moved = by_shard(shards, descended(shared, turn), "slice int, shard long, part long, value binary, times binary")
            sums = moved.repartition(-(-BUCKETS // SLICE), "slice").sortWithinPartitions("slice", "shard", "part").select("slice", "value", "times").mapInPandas(summed, "slice int, value binary, times binary")
            follow(net, past, saved(sums).collect())
            shared.destroy()
    shared = spread(spark, net)
    logits = by_shard(shards, held_back(shared), "language int, score double, y int, n long").groupBy("language", "score", "y").agg(F.sum("n").alias("n"))
    h = {c: v.to_numpy() for c, v in zip(logits.columns, logits.toArrow().columns, strict=True)}
    shared.destroy()
    choose_thresholds(net, h["score"], h["language"], h["y"], h["n"].astype(float), h["n"])
    return net


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", shard_rows: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Hashed embeddings of words and their beginnings, filters over one to three words, the
    maximum of each over the whole text, a logit. The score is the sigmoid of the logit
    less a threshold that was chosen for the text's language, which its function words
    tell; 0.5 is therefore where F1 was best. Scores read the text alone.

    Edge cases: null and empty texts get the score of a text without words; with one
    class or no labels the net keeps its start; repeated rows get equal scores; other
    columns are ignored; an empty table gives an empty result.
    """
    require(docs, (id_col, text_col))
    require(labels, (id_col, label_col))
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    net = learnt(docs, labels, None if held_out is None else ~held, id_col, text_col, label_col, shard_rows)
    shared = spread(docs.sparkSession, net)
    out = docs.select(F.col(id_col), held.alias("held_out"), score_column(F.col(text_col).cast("string"), shared).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the rows that the classifier calls toxic; all columns stay."""
    net = learnt(docs, labels, None, text_col=text_col, **params)
    shared = spread(docs.sparkSession, net)
    return docs.filter(score_column(F.col(text_col).cast("string"), shared) < 0.5)
