"""Language-model scores from a weighted backoff automaton that is dealt to blocks of texts."""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import remainder, require, saved

#: The end of a text as a token: no word holds a line feed.
END = b"\n"
#: What a context of one and of two tokens takes from the next shorter one, in tokens (Dirichlet smoothing); taken from each word's count for words not seen.
PRIOR, DISCOUNT = (200.0, 20.0), 0.75
#: Tokens of a block of texts, tokens whose n-grams meet in a shard, places that a walk takes in step.
BLOCK, SHARD, PIECE = 1 << 19, 1 << 21, 512
START_HASH = np.uint64(0x2545F4914F6CDD1D)
NONE = np.zeros(0, np.int64)


def small(raw: bytes, level: int = 1) -> bytes:
    return zstandard.compress(raw, level)


def full(raw: bytes) -> bytes:
    return zstandard.decompress(raw)


def planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then their second ones, and so on: these compress far better."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def whole(raw: bytes, kind: type) -> np.ndarray:
    """The numbers that ``planes`` took apart."""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def blocks_of(size: int):
    """Texts in blocks of about ``size`` tokens, each a row: ids, folds, numbers of tokens, tokens as numbers of the block's words."""

    def block(ids: list[pa.Array], held: list[bool], sizes: list[int], tokens: array, words: Iterable[bytes]) -> pa.RecordBatch:
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        all_ids = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids), one(held, pa.bool_()), one(sizes, pa.int32()), pa.array([small(planes(np.frombuffer(tokens, np.int32)), 6)], pa.binary()), pa.array([small(b" ".join(words), 6)], pa.binary())],
            ["ids", "held", "sizes", "tokens", "words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = lambda: ([], [], [], array("i"), defaultdict(count().__next__))
        ids, held, sizes, tokens, number = new()
        for batch in batches:
            first = 0
            for k, (text, out) in enumerate(zip(batch.column(2), batch.column(1).to_pylist(), strict=True)):
                text = text.as_py()
                words = text.lower().split() if text else []
                tokens.extend(map(number.__getitem__, words))
                tokens.append(number[END])
                held.append(out)
                sizes.append(len(words) + 1)
                if len(tokens) >= size:
                    yield block([*ids, batch.column(0).slice(first, k + 1 - first)], held, sizes, tokens, number)
                    (ids, held, sizes, tokens, number), first = new(), k + 1
            ids.append(batch.column(0).slice(first))
        if tokens:
            yield block(ids, held, sizes, tokens, number)

    return run


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from zero as a byte each; those of 255 and more in full behind them."""
    return small(np.minimum(numbers, 255).astype(np.uint8).tobytes() + numbers[numbers >= 255].astype(np.int64).tobytes())


def unpacked(raw: bytes, n: int) -> np.ndarray:
    raw = full(raw)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.int64, offset=n)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The n-grams of one block of texts: distinct ones, where they end, how often the training texts hold them.

    ``tokens`` has the start of a text as the number after the last word. At a place,
    ``two`` and ``three`` are the numbers of the pair and the triple that end there; a
    text's first token ends a pair with the start and no triple (-1).
    """

    def __init__(self, row: dict):
        self.words: list[bytes] = full(row["words"]).split(b" ")
        self.sizes = np.array(row["sizes"], np.int64)
        self.start = len(self.words)
        own = whole(full(row["tokens"]), np.int32)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.tokens = np.full(len(own) + len(self.sizes), self.start, np.int32)
        inside = np.ones(len(self.tokens), bool)
        inside[self.begins] = False
        self.tokens[inside] = own
        learnt = np.repeat(~np.array(row["held"], bool), self.sizes + 1) & inside
        self.own_words = np.bincount(self.tokens[learnt], minlength=self.start)[: self.start]
        width = self.start + 1
        at = np.flatnonzero(inside)
        pairs, first, place = np.unique(self.tokens[at - 1] * np.int64(width) + self.tokens[at], return_index=True, return_inverse=True)
        self.head2, self.last2 = (x.astype(np.int32) for x in np.divmod(pairs, width))
        self.two = np.full(len(self.tokens), -1, np.int32)
        self.two[at] = place
        self.own2 = np.bincount(place[learnt[at]], minlength=len(pairs))
        at = at[inside[at - 1]]
        triples, first, place = np.unique(self.two[at - 1] * np.int64(width) + self.tokens[at], return_index=True, return_inverse=True)
        self.head3, self.last3 = (x.astype(np.int32) for x in np.divmod(triples, width))
        self.tail3 = self.two[at[first]]
        self.three = np.full(len(self.tokens), -1, np.int32)
        self.three[at] = place
        self.own3 = np.bincount(place[learnt[at]], minlength=len(triples))

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, and those of the pairs followed by those of the triples; alike in all blocks."""
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        h = np.append(word, START_HASH)
        two = mixed(h[self.head2] * np.uint64(0x9E3779B97F4A7C15) + h[self.last2])
        three = mixed(two[self.head3] * np.uint64(0xD1342543DE82EF95) + h[self.last3])
        return word, np.concatenate((two, three))

    def dealt(self, n_shards: int) -> tuple[dict[int, list[np.ndarray]], np.ndarray]:
        """For each shard that this block asks, the numbers of its words, in order of their first bytes, and of its pairs and triples, in order of their hashes; the hashes of the latter."""
        word, gram = self.codes()
        parts: dict[int, list[np.ndarray]] = defaultdict(lambda: [NONE, NONE])
        heads = np.frombuffer(b"".join([w[:8].ljust(8, b"\0") for w in self.words]), ">u8")
        for k, (h, by) in enumerate(((word, heads), (gram, gram))):
            order = np.argsort(by, kind="stable")
            shard = (h[order] % np.uint64(n_shards)).astype(np.int64)
            place = np.argsort(shard, kind="stable")
            some, first = np.unique(shard[place], return_index=True)
            for s, numbers in zip(some.tolist(), np.split(order[place], first[1:]), strict=False):
                parts[s][k] = numbers
        return parts, gram

    def scores(self, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its known tokens, base score and score, given the corpus counts of this block's words, pairs and triples.

        The automaton's states are the root, the words and the pairs that the training texts
        hold. Where a state has an arc for a token, its weight is the token's log
        probability in that context; else the failure arc leads to the next shorter
        context, at the weight of what the context leaves to it. All texts of the block are
        walked from left to right in step, each carrying its state; long ones in pieces
        that begin two tokens early, after which the state is the same as on the whole.
        """
        texts = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        real = self.tokens != self.start
        count = np.append(n1, 0)[self.tokens]
        known = np.bincount(texts[real], count[real] > 0, minlength=len(self.sizes)).astype(np.int64)
        base = np.bincount(texts[real], np.log10((count[real] + 1.0) / (total + distinct + 1)), minlength=len(self.sizes))
        if not total:
            return known, base, np.zeros(len(self.sizes))
        context = np.append(n1, n1[self.words.index(END)] if END in self.words else 0).astype(float)
        p1 = np.where(n1 > 0, n1 - DISCOUNT, DISCOUNT * distinct) / total
        p2 = (n2 + PRIOR[0] * p1[self.last2]) / (context[self.head2] + PRIOR[0])
        p3 = (n3 + PRIOR[1] * p2[self.tail3]) / (n2[self.head3] + PRIOR[1])
        arc1, arc2, arc3 = np.log10(p1), np.log10(p2), np.append(np.log10(p3), 0.0)
        fail1, fail2 = np.log10(PRIOR[0] / (context + PRIOR[0])), np.log10(PRIOR[1] / (n2 + PRIOR[1]))
        has1, has2, has3 = n1 > 0, n2 > 0, np.append(n3 > 0, False)
        starts = np.concatenate([np.arange(0, n, PIECE) for n in self.sizes.tolist()])
        owner = np.repeat(np.arange(len(self.sizes)), -(-self.sizes // PIECE))
        early = np.minimum(starts, 2)
        length = np.minimum(self.sizes[owner] - starts, PIECE) + early
        order = np.argsort(-length, kind="stable")
        owner, early, length = owner[order], early[order], length[order]
        at = self.begins[owner] + 1 + starts[order] - early
        level = np.where(early == 0, 1, 0)  # tokens that the state stands for: the start of a text, or the root
        sums = np.zeros(len(order))
        going = np.searchsorted(-length, -np.arange(length.max(initial=0)), side="left")
        for t, n in enumerate(going.tolist()):
            here = at[:n] + t
            token, before, two, three = self.tokens[here], self.tokens[here - 1], self.two[here], self.three[here]
            state, gain = level[:n].copy(), np.zeros(n)
            arc = (state == 2) & has3[three]
            gain[arc] = arc3[three[arc]]
            fail = (state == 2) & ~arc
            gain[fail] = fail2[self.two[here[fail] - 1]]
            state[fail] = 1
            reached = arc
            arc = (state == 1) & has2[two]
            gain[arc] += arc2[two[arc]]
            reached = reached | arc
            fail = (state == 1) & ~arc
            gain[fail] += fail1[before[fail]]
            state[fail] = 0
            rest = state == 0
            gain[rest] += arc1[token[rest]]
            level[:n] = np.where(reached, 2, np.where(has1[token], 1, 0))
            sums[:n] += np.where(t >= early[:n], gain, 0.0)
        return known, base, np.bincount(owner, sums, minlength=len(self.sizes))


REQUEST = "shard int, block long, n_words int, words binary, own_words binary, n_grams int, grams binary, own_grams binary"
ANSWER = "block long, shard int, more_words binary, more_grams binary, n_distinct long"
#: Bytes of the steps between hashes that are kept as they are; those above are mostly zero and compress.
RAW = 5


def coded(hashes: np.ndarray, n_shards: int) -> bytes:
    """The ascending hashes of one shard in full: what the shard's number leaves of them, as steps from one to the next."""
    if not len(hashes):
        return b""
    steps = np.diff(hashes // np.uint64(n_shards), prepend=np.uint64(0)).astype(np.uint64).view(np.uint8).reshape(-1, 8)
    return steps[:, :RAW].tobytes() + small(steps[:, RAW:].T.tobytes())


def decoded(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` hashes that ``coded`` was given, divided by the number of shards."""
    steps = np.zeros((n, 8), np.uint8)
    if n:
        steps[:, :RAW] = np.frombuffer(raw, np.uint8, n * RAW).reshape(n, RAW)
        steps[:, RAW:] = np.frombuffer(full(raw[n * RAW :]), np.uint8).reshape(8 - RAW, n).T
    return np.cumsum(steps.view(np.uint64).reshape(-1), dtype=np.uint64)


def requests(n_shards: int):
    """What a block asks of the shards that hold some of its n-grams: the corpus counts of its words, pairs and triples; with its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row.as_py() for batch in batches for row in batch.to_struct_array()):
            b = Block(row)
            parts, code = b.dealt(n_shards)
            own, asked = np.concatenate((b.own2, b.own3)), sorted(parts)
            for lo in range(0, len(asked), 64):
                some = asked[lo : lo + 64]
                words, grams = zip(*(parts[s] for s in some), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int32()),
                        pa.array([row["block"]] * len(some), pa.int64()),
                        pa.array([len(x) for x in words], pa.int32()),
                        pa.array([small(b" ".join([b.words[i] for i in x.tolist()]), 6) for x in words], pa.binary()),
                        pa.array([packed(b.own_words[x]) for x in words], pa.binary()),
                        pa.array([len(x) for x in grams], pa.int32()),
                        pa.array([coded(code[x], n_shards) for x in grams], pa.binary()),
                        pa.array([packed(own[x]) for x in grams], pa.binary()),
                    ],
                    ["shard", "block", "n_words", "words", "own_words", "n_grams", "grams", "own_grams"],
                )

    return run


def answered(asked: pa.Table) -> pa.Table:
    """A shard's answer to each block: how much more often than in the block itself the training texts hold each item."""
    column = lambda name: asked.column(name).to_pylist()
    words = [full(x).split(b" ") if n else [] for x, n in zip(column("words"), column("n_words"), strict=True)]
    own_words = [unpacked(x, len(w)) for x, w in zip(column("own_words"), words, strict=True)]
    n: defaultdict[bytes, int] = defaultdict(int)
    for some, own in zip(words, own_words, strict=True):
        for w, k in zip(some, own.tolist(), strict=True):
            n[w] += k
    more_words = [packed(np.fromiter(map(n.__getitem__, some), np.int64, len(some)) - own) for some, own in zip(words, own_words, strict=True)]
    distinct = sum(k > 0 for k in n.values())
    del n, words
    sizes = column("n_grams")
    own = np.concatenate([unpacked(x, k) for x, k in zip(column("own_grams"), sizes, strict=True)])
    code = np.concatenate([decoded(x.as_py(), k) for x, k in zip(asked.column("grams"), sizes, strict=True)])
    order = np.argsort(code)
    code = code[order]
    group = np.cumsum(np.concatenate(([0], code[1:] != code[:-1])), dtype=np.int32) if len(code) else np.zeros(0, np.int32)
    del code
    total = np.bincount(group, own[order]).astype(np.int64)
    more = np.empty_like(own)
    more[order] = total[group]
    more -= own
    answers = [packed(x) for x in np.split(more, np.cumsum(sizes)[:-1])]
    return pa.table([asked.column("block"), asked.column("shard"), pa.array(more_words, pa.binary()), pa.array(answers, pa.binary()), pa.array([distinct] + [0] * (len(sizes) - 1), pa.int64())], names=["block", "shard", "more_words", "more_grams", "n_distinct"])


def scored(n_shards: int, total: int, distinct: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = blocks.to_pylist() if blocks.num_rows else (None,)
        b = Block(row)
        parts, _ = b.dealt(n_shards)
        n1, n = b.own_words.astype(np.int64), np.concatenate((b.own2, b.own3)).astype(np.int64)
        for a in answers.to_pylist():
            w, g = parts[a["shard"]]
            n1[w] += unpacked(a["more_words"], len(w))
            n[g] += unpacked(a["more_grams"], len(g))
        known, base, score = b.scores(n1, n[: len(b.own2)], n[len(b.own2) :], total, distinct)
        ids = blocks.column("ids").combine_chunks()
        ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).flatten()
        return pa.table([ids, pa.array(row["held"], pa.bool_()), pa.array(b.sizes), pa.array(known), pa.array(base), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def lm_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is all words, pairs and triples of tokens of the rows where ``held_out`` is
    false, with exact counts: none is dropped at any size of the corpus, and none is
    held in one place. Texts are first written as blocks of token numbers. Each block then
    asks the shards, to which n-grams are dealt by hash, for the counts of what it holds;
    a shard adds up what all blocks have of its n-grams and answers with the difference,
    which is nothing for the many n-grams of a single block. So each block gets the part
    of the automaton that its texts can reach, and walks them. A block asks no shard
    that holds none of its n-grams, so requests grow with the corpus alone. Pairs and
    triples are told apart by all 64 bits of their hashes, which two of some billions of
    n-grams hardly ever share; words by their bytes.

    Smoothing: a context seen c times gives a token seen n times after it the
    probability (n + m p) / (c + m), p being the next shorter context's, down to
    discounted word frequencies with one class for all words not seen; each context's
    probabilities sum to one.

    Edge cases: null and empty texts hold the end token alone; with nothing to learn
    from, base_score is that of N = V = 0 and score is 0; repeated rows and ids are
    scored each for itself; other columns are ignored.
    """
    require(docs, (id_col, text_col))
    held = F.coalesce(held_out, F.lit(False))
    id_type = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).cast("string").cast("binary").alias("text"))
    blocks = slim.mapInArrow(blocks_of(block), f"ids array<{id_type}>, held array<boolean>, sizes array<int>, tokens binary, words binary")
    blocks = saved(blocks.withColumn("block", F.monotonically_increasing_id()))
    learnt = F.aggregate(F.arrays_zip("sizes", "held"), F.lit(0).cast("long"), lambda n, x: n + F.when(x["held"], 0).otherwise(x["sizes"]))
    every = F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x)
    tokens, total = blocks.agg(F.coalesce(F.sum(every), F.lit(0)), F.coalesce(F.sum(learnt), F.lit(0))).first()
    n_shards = max(1, math.ceil(tokens / shard))
    answers = saved(blocks.mapInArrow(requests(n_shards), REQUEST).groupBy("shard").applyInArrow(answered, ANSWER))
    distinct = answers.agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0]
    shape = f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored(n_shards, total, distinct), shape)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out_fold(id_col: Column, modulus: int = 7, part: int = 2) -> Column:
    return remainder(id_col, modulus) == part
