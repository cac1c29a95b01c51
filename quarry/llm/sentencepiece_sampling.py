"""Sampled segmentation over a piece lattice, and lossless decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import fresh, received, require, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The character that stands for a space in pieces.
SPACE = "▁"
#: Sharpness of the sampling: 0 draws all segmentations alike, large values draw the likeliest.
ALPHA = 0.5
#: Texts encoded at a time, and lattice nodes that a task remembers before it starts anew.
TEXTS, NODES = 256, 2_500_000
PRIME = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Pieces:
    """What encoding needs of a model: pieces with ids and log weights, byte ids, and the bytes of each id."""

    ids: dict[str, int]
    log_weight: dict[str, float]
    byte_ids: tuple[int, ...]
    raw: list[bytes]
    bounded: bool

    @classmethod
    def load(cls, model_file: str = MODEL) -> Pieces:
        """Read a model with byte fallback on the driver.

        A model of ranked merges has no probabilities; a piece of rank r gets weight
        1 / (r + 2), as frequencies of pieces fall.
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids, weight, raw, byte_ids = {}, {}, [], [-1] * 256
        rank = 0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                ids[piece], weight[piece] = i, -float(np.log(rank + 2.0))
                raw.append(piece.replace(SPACE, " ").encode())
                rank += 1
        if min(byte_ids) < 0:
            raise ValueError("the model has no byte fallback, so decoding could lose characters")
        # Pieces that hold a space only in front, and no line feed, never reach over the cuts of segments().
        bounded = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in ids)
        return cls(ids, weight, tuple(byte_ids), raw, bounded)


def segments(text: str, bounded: bool) -> list[str]:
    """Cut a text, with spaces written as SPACE, where no piece can reach over."""
    return re.findall(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n", text) if bounded else [text]


#: Stands for a SPACE character that the text itself holds; only bytes may spell it. No text holds this code point.
LITERAL = "\ud800"


def hashes(rows: np.ndarray) -> np.ndarray:
    """A rolling hash of each row of code points."""
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = h * PRIME + column
    return h


class Lattices:
    """Lattices of segments as flat arrays, filtered forwards once for each distinct segment.

    A node is a place in a segment; its edges come from earlier places. ``bound`` holds
    for each edge the share of its node's probability up to and with this edge, in units of
    2^-32, ``back`` how many places before the edge starts.
    """

    def __init__(self, pieces: Pieces, alpha: float):
        self.pieces = pieces
        longest = max(map(len, pieces.ids))
        # By length: the hashes of all beginnings of pieces in order, with id and weight where one is a piece.
        self.beginnings = []
        for n in range(1, longest + 1):
            heads = sorted({p[:n] for p in pieces.ids if len(p) >= n})
            h = hashes(np.array([[ord(c) for c in x] for x in heads], np.uint64))
            order = np.argsort(h)
            ids = np.array([pieces.ids.get(x, -1) for x in heads], np.int32)
            weight = np.array([alpha * pieces.log_weight.get(x, 0.0) for x in heads])
            self.beginnings.append((h[order], ids[order], weight[order]))
        self.byte_weight = -alpha * float(np.log(len(pieces.raw)))
        self.byte_ids = np.array(pieces.byte_ids, np.int32)
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each segment: its first node, its nodes
        self.bound, self.back, self.piece = np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.int32)  # of each edge
        self.edges_to = np.zeros(0, np.int64)  # of each node: the number of edges up to and with its own

    def edges(self, code: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
        """All pieces in a row of characters, each with ``room`` up to its segment's end: start, length, id, log weight.

        A character without a piece of its own is an edge too, with id -1 - code point.
        """
        start, h, found = np.arange(len(code)), np.zeros(len(code), np.uint64), []
        for n, (known, ids, weight) in enumerate(self.beginnings, start=1):
            inside = room[start] >= n
            start, h = start[inside], h[inside]
            h = h * PRIME + code[start + n - 1]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            if n == 1:
                alone = np.ones(len(code), bool)
                alone[start[hit][ids[at[hit]] >= 0]] = False
                alone = np.flatnonzero(alone)
                c = code[alone].astype(np.int64)
                n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                found.append((alone, np.ones(len(alone), np.int64), np.where(c < 0x80, self.byte_ids[np.minimum(c, 127)], -1 - c).astype(np.int32), n_bytes * self.byte_weight))
            start, h, at = start[hit], h[hit], at[hit]
            whole = ids[at] >= 0
            found.append((start[whole], np.full(whole.sum(), n), ids[at[whole]], weight[at[whole]]))
            if not len(start):
                break
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def add(self, new: list[str]) -> None:
        """Forward filtering of new segments: log masses of nodes, by distance from the segment's start, then the shares of edges."""
        n = np.fromiter(map(len, new), np.int64, len(new))
        code = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        segment = np.repeat(np.arange(len(new)), n)
        begin = np.cumsum(n) - n
        place = np.arange(len(code)) - begin[segment]
        start, length, piece, weight = self.edges(code, n[segment] - place)
        source = start + segment[start]
        node, depth = source + length, place[start] + length
        order = np.lexsort((node, depth))
        mass = np.zeros(len(code) + len(new))
        cuts = np.searchsorted(depth[order], np.arange(1, n.max() + 2))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            e = order[lo:hi]
            to = node[e]
            heads = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            x = mass[source[e]] + weight[e]
            most = np.maximum.reduceat(x, heads)
            total = np.add.reduceat(np.exp(x - np.repeat(most, np.diff(np.append(heads, len(x))))), heads)
            mass[to[heads]] = most + np.log(total)
        order = np.argsort(node, kind="stable")
        node, source, piece, weight = node[order], source[order], piece[order], weight[order]
        share = np.exp(mass[source] + weight - mass[node])
        per_node = np.bincount(node, minlength=len(mass))
        last = np.cumsum(per_node) - 1
        # Shares are added up inside each node, so that a bound does not depend on the segments beside it.
        several = np.flatnonzero(per_node > 1)
        edge, room = last[several] - per_node[several] + 1, per_node[several] - 1
        while len(edge):
            edge, room = edge + 1, room - 1
            share[edge] += share[edge - 1]
            edge, room = edge[room > 0], room[room > 0]
        up = np.minimum(np.floor(share * 2.0**32), 2.0**32 - 1).astype(np.uint32)
        base = len(self.edges_to)
        self.edges_to = np.concatenate((self.edges_to, last + len(self.bound) + 1))
        self.bound = np.concatenate((self.bound, up))
        self.back = np.concatenate((self.back, (node - source).astype(np.uint8)))
        self.piece = np.concatenate((self.piece, piece))
        self.of.update(zip(new, range(len(self.first), len(self.first) + len(new)), strict=True))
        self.first = np.concatenate((self.first, base + begin + np.arange(len(new))))
        self.size = np.concatenate((self.size, n + 1))

    def numbers(self, parts: list[str]) -> list[int]:
        if len(self.edges_to) > NODES:
            self.clear()
        found = list(map(self.of.get, parts))
        if None in found:
            self.add(list(dict.fromkeys(p for p, x in zip(parts, found, strict=True) if x is None)))
            found = list(map(self.of.get, parts))
        return found


def spelled(ids: np.ndarray, ends: np.ndarray, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of -1 - code point replaced by the ids of the character's UTF-8 bytes."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, ends
    spelling = [chr(c).replace(LITERAL, SPACE).encode() for c in (-1 - ids[odd]).tolist()]
    extra = np.zeros(len(ids), np.int64)
    extra[odd] = [len(x) - 1 for x in spelling]
    out = np.repeat(ids, extra + 1)
    first = np.cumsum(extra + 1) - extra - 1
    at = np.concatenate([np.arange(len(x)) + f for x, f in zip(spelling, first[odd].tolist(), strict=True)])
    out[at] = byte_ids[np.frombuffer(b"".join(spelling), np.uint8)]
    return out, ends + np.concatenate(([0], np.cumsum(extra)))[ends]


def uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits that depend on seed and place alone (SplitMix64)."""
    x = seed + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def encode_batch(lattices: Lattices, texts: list[str | None], keys: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling for a batch of whole texts: all ids in a row, and each text's end in them."""
    parts, text_of = [], []
    for t, text in enumerate(texts):
        if text:
            cut = segments(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE), lattices.pieces.bounded)
            parts += cut
            text_of.append(np.full(len(cut), t))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    number, text_of = np.array(lattices.numbers(parts)), np.concatenate(text_of)
    bound, back, piece, edges_to = lattices.bound, lattices.back, lattices.piece, lattices.edges_to
    start, n = lattices.first[number], lattices.size[number]
    # The place of a decision: nodes before this segment in the text, then within the segment.
    before = np.cumsum(n) - n
    before -= before[np.searchsorted(text_of, text_of)]
    seeds = np.array([xxhash.xxh64_intdigest(k.encode(), seed) for k in keys], np.uint64)[text_of]
    # In the order of segments, neighbours read the same lattice.
    left = np.argsort(number, kind="stable")
    at, steps, count = (start + n - 1)[left], [], np.zeros(len(number), np.int64)
    while len(left):
        draw = uniform(seeds[left], before[left] + at - start[left])
        edge = edges_to[at - 1]
        below = np.flatnonzero((bound[edge] <= draw) & (edge + 1 < edges_to[at]))
        while len(below):
            edge[below] += 1
            e = edge[below]
            below = below[(bound[e] <= draw[below]) & (e + 1 < edges_to[at[below]])]
        steps.append((left, piece[edge]))
        count[left] += 1
        at = at - back[edge]
        go = at != start[left]
        left, at = left[go], at[go]
    last = np.cumsum(count) - 1
    ids = np.empty(last[-1] + 1, np.int32)
    for k, (who, what) in enumerate(steps):
        ids[last[who] - k] = what
    ends = np.cumsum(np.bincount(text_of, count, minlength=len(texts))).astype(np.int64)
    return spelled(ids, ends, lattices.byte_ids)


def decode_ids(ids: list[int], raw: list[bytes]) -> str:
    """The text of a row of ids: pieces and bytes in a row, without the space put in front."""
    return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids", model_file: str = MODEL, alpha: float = ALPHA, seed: int = 11) -> DataFrame:
    """``docs`` with ``out_col``, a sampled segmentation of each whole text as piece ids, and ``lossless``.

    Forward filtering sums, for each place of a text, the weights of all segmentations up
    to it; backward sampling draws pieces from the end in proportion. Draws depend on
    seed, id and place alone, so a row gets the same segmentation in any run, batch or
    partition. ``lossless`` says that decoding the ids gave the text back. The model (a
    bounded vocabulary) is read on the driver and broadcast; rows are encoded where they
    lie, without a shuffle.

    Edge cases: null text gives null ids and is lossless, empty text gives no ids;
    characters without a piece, SPACE itself and control characters are spelled in bytes;
    rows that repeat an id and text get the same ids; a null id counts as the empty text;
    columns that have the name of a result are replaced; an empty table gives an empty result.
    """
    require(docs, (id_col, text_col))
    shared = spread(docs.sparkSession, Pieces.load(model_file))
    results = {out_col.lower(), "lossless"}
    others = docs.select(*(c for c in docs.columns if c.lower() not in results))
    own = [c.lower() for c in others.columns]
    # The text travels once: from its own column where that is a string.
    place = own.index(text_col.lower()) if text_col.lower() in own and isinstance(others.schema[own.index(text_col.lower())].dataType, T.StringType) else -1
    given = docs.select(*others.columns, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(fresh(docs, "piece_key")), *([F.col(text_col).cast("string").alias(fresh(docs, "piece_text"))] if place < 0 else []))
    n_own = len(own)
    schema = T.StructType([*others.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = received(shared)
        lattices, raw = Lattices(pieces, alpha), pieces.raw
        for whole in batches:
            for k in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(k, TEXTS)
                keys, texts = batch.column(n_own).to_pylist(), batch.column(place).to_pylist()
                flat, ends = encode_batch(lattices, texts, keys, seed)
                cuts = np.concatenate(([0], ends))
                missing = np.array([t is None for t in texts] + [False])
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32), mask=missing), pa.array(flat, pa.int32()))
                ids = flat.tolist()
                same = [t is None or decode_ids(ids[a:b], raw) == t for t, a, b in zip(texts, cuts[:-1].tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_own], lists, pa.array(same)], names)

    return given.mapInArrow(run, schema)


def decode(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_file: str = MODEL) -> DataFrame:
    """``docs`` with ``out_col``: the text of each row's ids; null stays null."""
    require(docs, (ids_col,))
    shared = spread(docs.sparkSession, Pieces.load(model_file).raw)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        raw = received(shared)
        for ids in batches:
            yield pd.Series([None if x is None else decode_ids(x.tolist(), raw) for x in ids], dtype=object)

    return docs.withColumn(out_col, text(F.col(ids_col)))
