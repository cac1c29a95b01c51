"""SimHash near-duplicates: a binary trie joined with itself, then connected components; for whole texts an exact join of the rest."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh, require, saved, words_of

# Words in a shingle, seed of XXH64, bits that may differ.
WIDTH, SEED, MAX_BITS = 3, 42, 3
#: Fingerprints under one trie node that a task takes on, on average; pairs of nodes larger than this squared, four times, are split first.
LEAF = 16_384
#: Shingles whose bits are added at a time, node pairs of the trie that are walked at a time, pairs of fingerprints from which equal keys are compared one by one (leaves: a quarter at a time).
CHUNK, WALK, MANY = 65_535, 200_000, 1 << 20
#: Near copies of whole texts: words in a shingle, least Jaccard similarity, and budgets of bits in the first quarter and in all 128, tight ones first.
NEAR_WIDTH, LEAST = 5, 0.8
BUDGETS = ((2, 8), (4, 16), (4, 26))
#: As LEAF, where budgets are wide: a fingerprint goes to all nodes within its budget, so nodes are few and large.
WIDE_LEAF = 1 << 20
#: Texts that share a shingle and are paired one by one; more are compared by what sets them apart.
SHORT = 8
#: One in so many nodes of large groups is tried first: what that links needs no more pairs.
FIRST = 16
#: What rounding may add to a product of a similarity and a number of shingles; bounds are looser by it.
SLACK = 1e-6


def shingles(text: str | None, width: int) -> list[bytes]:
    """The shingles of one whole text in order, repeats included; a text with fewer words is one."""
    words = words_of(text)
    n = len(words)
    if n <= width:
        return [b" ".join(words)] if n else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> bytes:
    """The bits that more than half of the hashes have, given as rows of bytes."""
    total, size = np.zeros(8 * hashes.shape[1], np.int64), hashes.shape[1]
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK], axis=1).view(np.uint64).reshape(-1, size)
        # Eight counters of a byte each in a word: 255 rows can be added without a carry.
        for k in range(0, len(bits), 255):
            total += np.add.reduce(bits[k : k + 255], axis=0).view(np.uint8)
    return np.packbits(2 * total > len(hashes)).tobytes()


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The SimHash of all shingles of one whole text; no word at all: 0."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in shingles(text, width)], dtype=">u8")
    return int.from_bytes(majority(hashes.view(np.uint8).reshape(-1, 8)), "big")


def distinct_hashes(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of one whole text as rows of 16 bytes of hash."""
    found = set(map(xxhash.xxh3_128_digest, shingles(text, width)))
    return np.frombuffer(b"".join(found), np.uint8).reshape(-1, 16)


def fewest(n: np.ndarray | int, least: float) -> np.ndarray:
    """Of ``n`` shingles, those that a text at least has in common with one that is similar at ``least``."""
    return np.ceil(np.asarray(n) * least - SLACK).astype(np.int64)


def sure(n: np.ndarray | int) -> np.ndarray:
    """Shingles in common that are asked of the lowest ones of a text of ``n`` shingles, see :func:`rest_links`."""
    return 1 + np.asarray(n) // 10


def described(text: Column, width: int = NEAR_WIDTH, least: float = LEAST) -> Column:
    """Each text's distinct shingles: 128 bits of SimHash as two longs, a hash of the set, their number, and the lowest hashes."""

    @F.pandas_udf("hi long, lo long, node long, n long, low array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                hashes = distinct_hashes(t, width)
                hi, lo = np.frombuffer(majority(hashes), ">i8").tolist()
                held = np.sort(np.ascontiguousarray(hashes[:, :8]).view(np.int64).reshape(-1))
                n = len(held)
                low = held[: n - int(fewest(n, least)) + int(sure(n))]
                node = np.uint64(xxhash.xxh3_64_intdigest(held.tobytes())).astype(np.int64)
                rows.append((hi, lo, int(node), n, low))
            yield pd.DataFrame(rows, columns=["hi", "lo", "node", "n", "low"])

    return run(text)


def shingle_sets(text: Column, width: int = NEAR_WIDTH) -> Column:
    """The distinct shingles of each text, as 64 bits of hash each."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.ascontiguousarray(distinct_hashes(t, width)[:, :8]).view(np.int64).reshape(-1) for t in texts], dtype=object)

    return run(text)


def fingerprints(text: Column, width: int = WIDTH) -> Column:
    """The fingerprints of a column of texts, as signed longs with the same bits."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text)


def joined_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of ``i`` and ``j`` in ``label``, where each item points to the root of its own."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def walk(keys: np.ndarray, rest: np.ndarray, split: int, same: bool, depth: int, err: int, max_bits: int, first_bits: int, label: np.ndarray) -> list[np.ndarray]:
    """Walk a pair of trie nodes together: links between items as pairs of places, one for each two components that met.

    ``keys`` are sorted in either part: those of one node up to ``split``, then those of
    the other (``same``: one node, paired with itself). Both nodes lie ``depth`` bits deep
    and differ in ``err`` bits so far. Pairs of children add a bit where they differ and
    are left out beyond ``max_bits``, or beyond ``first_bits`` within the first 32 bits.
    Bits in ``rest`` follow those of the keys and are counted at the leaves. Components
    are kept in ``label``; a pair of nodes whose items all share one needs no walk.
    """
    found = [np.zeros((0, 2), np.int64)]

    def linked(i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(keys[i] ^ keys[j]).astype(np.int64) + np.bitwise_count(rest[i] ^ rest[j]) <= max_bits
        near &= label[i] != label[j]
        i, j = i[near], j[near]
        if len(i):
            a, b = label[i], label[j]
            _, one = np.unique(np.minimum(a, b) * len(keys) + np.maximum(a, b), return_index=True)
            found.append(np.stack((i[one], j[one]), axis=1))
            joined_labels(label, i, j)

    cut = len(keys) if same else split
    start = (0, cut, 0 if same else cut, len(keys))
    stack = [(depth, *(np.array([x]) for x in (*start, err)))] if err <= first_bits and len(keys) else []
    while stack:
        depth, alo, ahi, blo, bhi, e = stack.pop()
        if len(alo) > WALK:
            stack += [(depth, *(x[k : k + WALK] for x in (alo, ahi, blo, bhi, e))) for k in range(0, len(alo), WALK)]
            continue
        change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        one = (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (label[alo] == label[blo])
        keep = ~one
        alo, ahi, blo, bhi, e = (x[keep] for x in (alo, ahi, blo, bhi, e))
        many = (ahi - alo) * (bhi - blo)
        large = (depth >= 64) & (many > MANY)
        for a0, a1, b0, b1 in zip(*(x[large].tolist() for x in (alo, ahi, blo, bhi)), strict=True):
            # Equal keys: each against all, until one component holds them.
            b = np.arange(b0, b1)
            for i in range(a0, a1):
                linked(np.full(len(b), i), b)
                if (label[a0:a1] == label[a0]).all() and (label[b] == label[a0]).all():
                    break
        leaf = ((many <= 32) | (depth >= 64)) & ~large
        for some in np.array_split(np.flatnonzero(leaf), 1 + int(many[leaf].sum()) // (MANY // 4)):
            n = many[some]
            pair = np.repeat(some, n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = (bhi - blo)[pair]
            linked(alo[pair] + nth // wide, blo[pair] + nth % wide)
        go = ~(leaf | large)
        if not go.any():
            continue
        alo, ahi, blo, bhi, e = (x[go] for x in (alo, ahi, blo, bhi, e))
        # Within a node the keys with a zero at this bit come first.
        zeros = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1) == 0)))
        amid, bmid = alo + zeros[ahi] - zeros[alo], blo + zeros[bhi] - zeros[blo]
        twin = (alo == blo) & (ahi == bhi)
        most = first_bits if depth < 32 else max_bits
        parts = [(alo, amid, blo, bmid, e, True), (amid, ahi, bmid, bhi, e, True), (alo, amid, bmid, bhi, e + 1, e + 1 <= most), (amid, ahi, blo, bmid, e + 1, (e + 1 <= most) & ~twin)]
        children = []
        for a0, a1, b0, b1, x, ok in parts:
            ok = ok & (a1 > a0) & (b1 > b0)
            children.append([y[ok] for y in (a0, a1, b0, b1, x)])
        nxt = [np.concatenate(x) for x in zip(*children, strict=True)]
        if len(nxt[0]):
            stack.append((depth + 1, *nxt))
    return found


def in_turns(points: DataFrame, *words: Column) -> DataFrame:
    """(turn, key, rest, node): each fingerprint, given in parts of 32 bits, once with each part in front; two parts make a key."""
    n = len(words)
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    joined = lambda a, b: F.shiftleft(low(words[a % n]), 32).bitwiseOR(low(words[b % n]))
    turns = [F.struct(F.lit(t).alias("turn"), joined(t, t + 1).alias("key"), (joined(t + 2, t + 3) if n == 4 else F.lit(0).cast("long")).alias("rest")) for t in range(n)]
    return points.select("node", F.explode(F.array(*turns)).alias("x")).select("x.*", "node")


def halves(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, 32), fp]


def links(both: DataFrame, n: int, budgets: Sequence[tuple[int, int]], leaf: int) -> DataFrame:
    """Links (u, v) between nodes that join all whose fingerprints lie within a budget; ``both`` as from :func:`in_turns`, ``n`` its rows in a turn.

    A budget is (bits in the first part, all bits). Of a pair with that many errors, one
    part has at most its share of them. So a trie is walked for each part in front, with
    the smaller budget for the first 32 bits. The walk starts at a depth where nodes hold
    about ``leaf`` fingerprints: a node is paired with itself and with those that differ
    within the budget. Node pairs that are still large are split four bits at a time, by
    joins; the others are each walked in one task. Tighter budgets are walked first, and
    each task sends a spanning forest of what it links, not all pairs.
    """
    spark = both.sparkSession
    first, most = budgets[-1]
    depth = min(32, max(1, math.ceil(math.log2(max(n, 2) / leaf))))
    prefix = lambda d: F.shiftrightunsigned("key", 64 - d) if d < 64 else F.col("key")
    nodes = saved(both.groupBy("turn", prefix(depth).alias("trie")).agg(F.count("*").alias("n")))
    masks = [0]
    for _ in range(first):
        masks = sorted({m ^ (1 << k) for m in masks for k in range(depth)} | set(masks))
    flips = F.explode(F.array(*(F.struct(F.col("trie").bitwiseXOR(F.lit(m)).alias("b"), F.lit(m.bit_count()).alias("err")) for m in masks)))
    pairs = nodes.select("turn", F.col("trie").alias("a"), F.col("n").alias("na"), flips.alias("x")).select("turn", "a", "na", "x.b", "x.err").filter("a <= b")
    pairs = saved(pairs.join(nodes.select("turn", F.col("trie").alias("b"), F.col("n").alias("nb")), ["turn", "b"]).withColumn("depth", F.lit(depth)))
    walked = []
    while True:
        large = (F.col("na") * F.col("nb").cast("double") > 4.0 * leaf * leaf) & (F.col("depth") < 64)
        small = pairs.filter(~large)
        sides = small.select("turn", "depth", "a", "b", "err", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.col("a"))).otherwise(F.array("a", "b"))).alias("trie"))
        walked.append(sides.join(both.withColumn("trie", prefix(depth)), ["turn", "trie"]).withColumn("second", F.col("trie") != F.col("a")).drop("trie"))
        big = pairs.filter(large)
        if big.isEmpty():
            break
        depth = min(64, depth + 4)
        step = depth - big.first()["depth"]
        busy = big.select("turn", F.col("a").alias("up")).union(big.select("turn", F.col("b").alias("up"))).distinct()
        child = both.groupBy("turn", prefix(depth).alias("trie")).agg(F.count("*").alias("n")).withColumn("up", F.shiftrightunsigned("trie", step))
        child = saved(child.join(busy, ["turn", "up"], "left_semi"))
        left = child.select("turn", F.col("up").alias("a"), F.col("trie").alias("a2"), F.col("n").alias("na"))
        right = child.select("turn", F.col("up").alias("b"), F.col("trie").alias("b2"), F.col("n").alias("nb"))
        err = F.col("err") + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")).bitwiseAND(F.lit((1 << step) - 1)))
        down = big.select("turn", "a", "b", "err").join(left, ["turn", "a"]).join(right, ["turn", "b"]).withColumn("err", err)
        within = F.col("err") <= (first if depth <= 32 else most)
        ordered = (F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2"))
        pairs = saved(down.filter(within & ordered).select("turn", F.col("a2").alias("a"), F.col("b2").alias("b"), "na", "nb", "err", F.lit(depth).alias("depth")))

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        same, depth, err = bool(row["a"] == row["b"]), int(row["depth"]), int(row["err"])
        keys, second = pdf["key"].to_numpy().view(np.uint64), pdf["second"].to_numpy(bool)
        order = np.lexsort((keys, second))
        keys, rest, node = keys[order], pdf["rest"].to_numpy().view(np.uint64)[order], pdf["node"].to_numpy()[order]
        split, label = int((~second).sum()), np.arange(len(keys))
        found = np.concatenate([x for first, most in budgets for x in walk(keys, rest, split, same, depth, err, most, first, label)])
        return pd.DataFrame({"u": node[found[:, 0]], "v": node[found[:, 1]]})

    out = None
    for part in walked:
        found = part.groupBy("turn", "depth", "a", "b", "err").applyInPandas(task, "u long, v long")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v); the root is the smallest node reachable.

    Alternating large-star and small-star rounds: each is a minimum by node and a join,
    so no component is ever gathered in one place; the edges only move in Spark.
    """
    edges = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    mark = None
    while True:
        two = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(two.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = two.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = saved(large)
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = saved(small.filter("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def grouped(marked: DataFrame, max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of ``marked`` (id, fp): the smallest fingerprint and the smallest id of its component."""
    fps = saved(marked.groupBy("fp").agg(F.min("id").alias("id")))
    both = in_turns(fps.select(F.col("fp").alias("node")), *halves(F.col("node")))
    comp = saved(components(links(both, fps.count(), [(max_bits // 2, max_bits)], leaf)))
    linked = saved(comp.join(fps, comp["node"] == fps["fp"]).select("fp", "root", "id"))
    least = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    named = linked.join(least, "root").select("fp", "root", "component_id")
    return saved(fps.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "id").alias("component_id")))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that can be reached over links of at most
    ``max_bits`` differing bits. Equal fingerprints are one node of the graph, so a group
    of copies costs one fingerprint, however large it is.

    Edge cases: a null or empty text has fingerprint zero and is linked like any other;
    texts with fewer words than a shingle are one shingle; a null id never becomes a
    component_id unless the component has no other; repeated rows share a component;
    an empty table gives an empty result; other columns are ignored.
    """
    require(docs, (id_col, text_col))
    marked = saved(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), width).alias("fp")))
    named = grouped(marked, max_bits, leaf).select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets (node, s) of shingles have a Jaccard similarity of ``least`` or more."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.filter(common >= least * (F.size("a") + F.size("b") - common)).select("u", "v")


def at_least(n: Column, share: float) -> Column:
    return F.ceil(n * F.lit(share) - F.lit(SLACK))


def unexplained(rooted: DataFrame, least: float) -> DataFrame:
    """The rows of ``rooted`` (node, root, n, low) that may be similar to a node of another root.

    Of a similar pair either set holds all but a few shingles of the other. Whatever order
    all shingles are put in, the first n - fewest(n) + k of either set then have k shingles
    in common (``k`` at most that of the smaller set). The lowest hashes are such an order:
    nodes with fewer of them in nodes of other roots are left out.
    """
    each = rooted.select("node", "root", F.explode("low").alias("shingle"))
    shared = saved(each.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("shingle"))
    met = each.join(shared, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("met"))
    asked = 1 + F.floor(at_least(F.col("n"), least) / 10)
    return rooted.join(met, "node").filter(F.col("met") >= asked).select("node", "root", "n")


def posted(rooted: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(node, root, n, left, shingle): the shingles by which a node can meet a similar one of another root, ``left`` with those after it.

    Shingles are ordered by the number of nodes that hold them, rare ones first, in front
    of them those that nodes of one root alone hold. A similar pair has a shingle in
    common among the first n - fewest(n) + 1 of either; after the first one enough must
    be left in both to reach the similarity.
    """
    n = F.col("n")
    each = rooted.join(sets, "node").select("node", "root", "n", F.explode("s").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("df"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("shingle", "df")
    held = each.join(saved(shared), "shingle").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("x"))
    # n - size(x) shingles come before; of the first n - fewest(n) + 1 these are left.
    size, take = F.size("x"), (F.size("x") - at_least(n, least) + 1).cast("int")
    held = held.filter(take > 0).select("node", "root", "n", size.alias("size"), F.posexplode(F.slice("x", 1, take)).alias("at", "y"))
    return saved(held.select("node", "root", "n", (F.col("size") - F.col("at")).alias("left"), F.col("y.shingle").alias("shingle")))


def met_in_short(held: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of nodes of different roots that meet in a short list of ``lists`` (shingle, size) and can be similar."""
    held = held.join(lists.filter(F.col("size") <= SHORT).select("shingle"), "shingle", "left_semi")
    one, two = (held.select("shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "n", "left"))) for k in "uv")
    met = one.join(two, "shingle").filter("node_u < node_v AND root_u != root_v")
    met = met.filter(F.least("n_u", "n_v") >= at_least(F.greatest("n_u", "n_v"), least))
    met = met.filter(F.least("left_u", "left_v") >= at_least(F.col("n_u") + F.col("n_v"), least / (1 + least)))
    return met.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))


def around_hubs(held: DataFrame, lists: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(hub, node, root, far, diff): the nodes of each long list, by the shingles that they or the list's hub hold alone.

    The hub is the smallest node of a list, so that lists of the same near copies mostly
    share it and a node has few of them. Nodes that can have no partner in a list by the
    bounds of length and place over all of it are left out.
    """
    n, lo = F.col("n"), F.col("lo")
    cells = held.join(lists.filter(F.col("size") > SHORT), "shingle")
    cells = cells.filter((F.col("hi") >= at_least(n, least)) & (n >= at_least(lo, least)))
    cells = cells.filter(F.least("left", "most") >= at_least(n + F.greatest(lo, at_least(n, least)), least / (1 + least)))
    cells = saved(cells.select("hub", "node", "root", "n").distinct())
    mixed = cells.groupBy("hub").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("hub")
    cells = cells.join(mixed, "hub", "left_semi").join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("s").alias("h")), "hub")
    cells = cells.withColumn("diff", F.concat(F.array_except("s", "h"), F.array_except("h", "s")))
    return saved(cells.select("hub", "node", "root", (F.size("diff") - n * F.lit((1 - least) / (1 + least))).alias("far"), "diff"))


def met_in_long(near: DataFrame, every: int = 1) -> DataFrame:
    """Pairs (u, v) of nodes of different roots around one hub, ``near`` from :func:`around_hubs`, whose links join all that are similar.

    Two sets that differ from the hub's in d and e shingles differ in d + e - 2c from each
    other, c of them in common. Similar at ``least`` are those of n and m shingles that
    differ in at most k(n + m), k = (1 - least) / (1 + least), so that c must be at least
    half of (d - kn) + (e - km), the sum of their ``far``. Where that is not above zero no
    c is needed, and both are similar to the node with the smallest ``far`` too: one link
    each will do. All others meet by a prefix join over what differs, in which the text
    that near copies share has no part. One of a pair is of those one in ``every`` nodes
    that a hash chooses.
    """
    mins = near.groupBy("hub").agg(F.min(F.struct("far", "node", "root")).alias("m"))
    second = near.join(mins, "hub").filter("root != m.root").groupBy("hub").agg(F.min("far").alias("second"))
    mins = saved(mins.join(second, "hub"))
    half = lambda a, b: F.ceil((a + b) / 2 - F.lit(SLACK))
    far = F.col("far")
    star = near.join(mins, "hub").filter("root != m.root").filter(half(far, F.col("m.far")) <= 0).select(F.col("node").alias("u"), F.col("m.node").alias("v"))
    # What c must be at least with any node of another root.
    need = F.greatest(F.lit(1), half(far, F.when(F.col("root") == F.col("m.root"), F.col("second")).otherwise(F.col("m.far"))))
    asked = near.join(mins, "hub").withColumn("need", need).filter(F.size("diff") >= F.col("need"))
    each = asked.select("hub", "node", "root", "far", "need", F.explode("diff").alias("shingle"))
    shared = each.groupBy("hub", "shingle").agg(F.count("*").alias("df"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b")
    held = each.join(saved(shared.select("hub", "shingle", "df")), ["hub", "shingle"])
    held = held.groupBy("hub", "node", "root", "far", "need").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("x"))
    size, take = F.size("x"), (F.size("x") - F.col("need") + 1).cast("int")
    held = held.filter(take > 0).select("hub", "node", "root", "far", size.alias("size"), F.posexplode(F.slice("x", 1, take)).alias("at", "y"))
    held = saved(held.select("hub", "node", "root", "far", (F.col("size") - F.col("at")).alias("left"), F.col("y.shingle").alias("shingle")))
    # Of two roots one is not the most frequent of a list: its many nodes are not paired with each other.
    main = held.groupBy("hub", "shingle", "root").agg(F.count("*").alias("n")).groupBy("hub", "shingle").agg(F.max(F.struct("n", "root")).alias("x"), F.count("*").alias("roots"))
    main = saved(main.filter("roots > 1").select("hub", "shingle", F.col("x.root").alias("main")))
    one, two = (held.select("hub", "shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "far", "left"))) for k in "uv")
    two = two.filter(F.pmod(F.xxhash64("node_v"), F.lit(every)) == 0)
    met = one.join(main, ["hub", "shingle"]).filter("root_u != main").join(two, ["hub", "shingle"])
    met = met.filter("root_u != root_v")
    c = half(F.col("far_u"), F.col("far_v"))
    met = met.filter((c > 0) & (F.least("left_u", "left_v") >= c))
    return met.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).union(star)


def raised(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """``rooted`` with the roots that ``links`` (u, v) between roots bring together."""
    above = components(links).select(F.col("node").alias("root"), F.col("root").alias("above"))
    return saved(rooted.join(above, "root", "left").withColumn("root", F.coalesce("above", "root")).drop("above"))


def joined_rest(rooted: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``rooted`` (node, root, n) with new roots where nodes of different roots are similar at ``least``; ``sets`` (node, s).

    A prefix join. Nodes that meet in a short list of a shingle are paired; those of a long
    one, as of a large group of near copies and texts beside it, by what sets them apart
    from one of them: first with a few of these nodes, then, where roots still differ,
    with all.
    """
    held = posted(rooted, sets, least)
    bounds = [F.count("*").alias("size"), F.min("node").alias("hub"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("left").alias("most")]
    lists = held.groupBy("shingle").agg(*bounds, F.min("root").alias("a"), F.max("root").alias("b"))
    lists = saved(lists.filter("a != b").drop("a", "b"))

    def linked(met: DataFrame) -> DataFrame:
        met = saved(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        more, root = confirmed(met, sets, least), rooted.select("node", "root")
        more = more.join(root.toDF("u", "a"), "u").join(root.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        return saved(more.distinct())

    met = met_in_short(held, lists, least)
    if lists.filter(F.col("size") > SHORT).isEmpty():
        return raised(rooted, linked(met))
    near = around_hubs(held, lists, sets, least)
    some = linked(met.union(met_in_long(near, FIRST)))
    if not some.isEmpty():
        rooted = raised(rooted, some)
        near = saved(near.drop("root").join(rooted.select("node", "root"), "node"))
    more = linked(met_in_long(near))
    return rooted if more.isEmpty() else raised(rooted, more)


def similar(docs: DataFrame, id_col: str, text_col: str, width: int, least: float, budgets: Sequence[tuple[int, int]], leaf: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, digest, node) of the documents, and (node, root) of their sets of shingles: those joined by links share a root.

    Links that the trie self-join finds are confirmed by the Jaccard similarity of the
    whole texts' shingles, worked out in Spark for the texts that have any. Pairs that it
    does not meet, or that stood behind a refuted one, are in different groups then: an
    exact prefix join over the texts that may have such a pair finds all of these.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    marked = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), described(F.col(text_col), width, least).alias("x"))
    marked = saved(marked.select("id", "digest", "x.*"))
    chosen = F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "digest", "hi", "lo", "n", "low")).alias("x")
    nodes = saved(marked.groupBy("node").agg(chosen).select("node", "x.*"))
    points = saved(nodes.groupBy("hi", "lo").agg(F.min("node").alias("node")))
    both = in_turns(points, *halves(F.col("hi")), *halves(F.col("lo")))
    n = points.count()
    # At least a few nodes, so that a small table too is walked by several tasks.
    found = links(both, n, budgets, min(leaf, max(4096, n // 4)))
    same = nodes.join(points.withColumnRenamed("node", "v"), ["hi", "lo"]).filter("node != v").select(F.col("node").alias("u"), "v")
    found = saved(found.unionByName(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = nodes.join(some.select("node"), "node", "left_semi").select("node", F.col("id").alias("wanted_id"), F.col("digest").alias("wanted_digest"))
        texts = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.col(text_col).alias("text"))
        texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("digest") == F.col("wanted_digest"))).select("node", "text")
        return saved(texts.dropDuplicates(["node"]).select("node", shingle_sets(F.col("text"), width).alias("s")))

    sets = sets_of(found.select(F.col("u").alias("node")).union(found.select("v")).distinct())
    comp = saved(components(confirmed(found, sets, least)))
    rooted = saved(nodes.select("node", "n", "low").join(comp, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", "low"))
    rest = saved(unexplained(rooted, least))
    named = rooted.select("node", "root")
    if rest.isEmpty():
        return marked, named
    rest = joined_rest(rest, sets_of(rest), least).select("node", F.col("root").alias("above"))
    above = rest.join(named, "node").select("root", "above").distinct()
    return marked, named.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = NEAR_WIDTH, least: float = LEAST, budgets: Sequence[tuple[int, int]] = BUDGETS, leaf: int = WIDE_LEAF) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id; all columns stay.

    Texts are linked whose shingles of ``width`` words have a Jaccard similarity of
    ``least`` or more: first those that the trie self-join of 128-bit fingerprints brings
    together within ``budgets``, then all others by an exact join, so ``budgets`` and
    ``leaf`` change the cost and not the groups. Rows are told apart by id and digest of
    the text, groups by their root: so a null or repeated id costs no document, and a
    document without an id stays where its group has no other. Texts without a word are
    one group; an empty table gives an empty result.
    """
    require(docs, (id_col, text_col))
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    marked, named = similar(docs, id_col, text_col, width, least, budgets, leaf)
    each = marked.groupBy("node", "id", "digest").agg(F.count("*").alias("n"))
    first = each.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "digest", "n")).alias("x"))
    stays = named.join(first, "node").groupBy("root").agg(F.min("x").alias("x"))
    key, text_key = fresh(docs, "near_key"), fresh(docs, "near_digest")
    stays = saved(stays.select(F.col("x.id").alias(key), F.col("x.digest").alias(text_key), "x.n"))
    rest = docs.join(stays.select(key, text_key), F.col(id_col).eqNullSafe(F.col(key)) & (digest == F.col(text_key)), "left_semi")
    if stays.filter("n > 1").isEmpty():
        return rest
    return rest.withColumn(text_key, digest).dropDuplicates([id_col, text_key]).select(*docs.columns)
