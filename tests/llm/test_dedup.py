import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

from quarry.llm.exact_dedup import drop_exact_copies, exact_dedup, heavy_candidates, shrunk
from quarry.llm.simhash import components, confirmed, drop_near_copies, fingerprint, simhash, walk


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_misra_gries_keeps_what_is_frequent():
    items = ["a"] * 40 + ["b"] * 30 + [str(k) for k in range(60)]
    random.Random(1).shuffle(items)
    held = Counter()
    for k in range(0, len(items), 7):
        held = shrunk(held + Counter(items[k : k + 7]), 5)
    assert {"a", "b"} <= set(held) and len(held) <= 5


def test_exact_edges(spark, edges):
    rows = edges.collect()
    groups = {}
    for r in rows:
        groups.setdefault(plain(r["text"]), []).append(r["doc_id"])
    out = exact_dedup(edges).collect()
    assert len(out) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in out:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min((x for x in ids if x is not None), default=None)
    assert sum(r["kept"] for r in out) == len(groups)


def test_exact_light_and_heavy_agree(make):
    rows = [(k, "same text" if k % 3 else f"text {k % 50}", "en", "a") for k in range(600)]
    df = make(rows).repartition(5)
    key = lambda counters: sorted(tuple(r) for r in exact_dedup(df, counters=counters).collect())
    assert key(1) == key(4) == key(256)
    assert len(heavy_candidates(exact_dedup(df).selectExpr("unhex(text_sha256) AS digest"), 3)) <= 3


def test_drop_exact(spark, edges, nothing):
    kept = drop_exact_copies(edges)
    assert kept.columns == edges.columns
    texts = [plain(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({plain(r["text"]) for r in edges.collect()})
    assert exact_dedup(nothing).count() == drop_exact_copies(nothing).count() == 0


def slow_fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def slow_components(prints, bits=3):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(x) for x in range(len(prints))]


def test_fingerprint_is_the_contract():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 4, 5, 300, 1500):
        t = " ".join(rng.choice(["Aa", "b", "Ç", "dd"]) for _ in range(n))
        assert fingerprint(t) == slow_fingerprint(t)


def test_walk_finds_all_links():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    keys = [int(b) for b in base]
    for b in list(keys):
        for _ in range(6):
            x = b
            for k in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(k)
            keys.append(x)
    keys = np.array(sorted(set(keys)), np.uint64)
    label = np.arange(len(keys))
    found = np.concatenate(walk(keys, np.zeros_like(keys), len(keys), True, 0, 0, 3, 3, label))
    assert all((int(keys[i]) ^ int(keys[j])).bit_count() <= 3 for i, j in found)
    want = slow_components([int(k) for k in keys])
    assert len(set(zip(label.tolist(), want, strict=True))) == len(set(label.tolist())) == len(set(want))


def test_simhash_small_leaves_match_brute_force(make):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 60, 200]))]
        for _ in range(4):
            copy = list(words)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), "en", "a"))
    rows += [(len(rows) + k, t, "en", "a") for k, t in enumerate([None, "", "a", "a b", "A  B"])]
    got = {r["doc_id"]: r for r in simhash(make(rows).repartition(3), leaf=4).collect()}
    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    want = slow_components(prints)
    for k, (i, *_) in enumerate(rows):
        assert got[i]["fingerprint"] == f"{prints[k]:016x}"
        assert got[i]["component_id"] == rows[want[k]][0]


def test_simhash_edges(edges, nothing):
    out = simhash(edges).collect()
    assert len(out) == edges.count() and simhash(nothing).count() == 0
    empty = {r["component_id"] for r in out if r["fingerprint"] == "0" * 16}
    assert empty == {3}
    kept = drop_near_copies(edges)
    assert kept.columns == edges.columns and drop_near_copies(nothing).count() == 0
    rows = edges.collect()
    want = near_groups([r["text"] for r in rows])
    assert kept.count() == len(set(want))


def near_groups(texts, least=0.8):
    """The group of each text by definition: a chain of pairs whose sets of five-word shingles are similar enough."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(x) for x in range(len(sets))]


def test_near_copies_are_those_of_brute_force(make):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 150, 400]))]
        for n_edits in (0, 1, 1, 2, len(words) // 20):
            copy = list(words)
            for _ in range(n_edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), "en", "a"))
    # A large group of copies of one text, each with an edit of its own, and one where a third of each text is shared.
    long = [rng.choice(vocabulary) for _ in range(200)]
    for k in range(300):
        rows.append((len(rows), " ".join([*long[: k % 200], f"own{k}", *long[k % 200 + 1 :]]), "en", "a"))
        rows.append((len(rows), " ".join([*long[:60], *(rng.choice(vocabulary) for _ in range(120))]), "en", "a"))
    kept = {r["doc_id"] for r in drop_near_copies(make(rows).repartition(3)).collect()}
    want = near_groups([t for _, t, *_ in rows])
    assert kept == set(want)


def borderline(rng, vocabulary, n_words, n_edits):
    """A text and a copy with edits six words apart, so that each changes five shingles of its own."""
    words = [rng.choice(vocabulary) for _ in range(n_words)]
    copy = list(words)
    for k in range(n_edits):
        copy[5 + 6 * k] = f"edit{rng.randrange(10**9)}"
    return " ".join(words), " ".join(copy)


def test_near_copies_at_the_threshold_are_all_linked(make):
    """Pairs at a similarity of just 0.8 or more, some of whose fingerprints lie far apart, and pairs just below."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(400):
        texts += borderline(rng, vocabulary, 94, 2)  # 80 of 100 shingles
        texts += borderline(rng, vocabulary, 49, 1)  # 40 of 50
        texts += borderline(rng, vocabulary, 48, 1)  # 39 of 49
    kept = {r["doc_id"] for r in drop_near_copies(make([(k, t, "en", "a") for k, t in enumerate(texts)]).repartition(3)).collect()}
    want = [k for k in range(len(texts)) if k % 2 == 0 or k % 6 == 5]
    assert sorted(kept) == want


def test_near_copies_do_not_depend_on_fingerprints(make):
    """Chains, hubs, shared beginnings and short texts: the same groups as brute force, at one similarity with next to no help of the trie."""
    rng = random.Random(13)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [None, "", " ", "a", "a a a a a a a", "a b c d e", "a b c d", "A  b c d e"]
    for k in range(50):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([5, 6, 9, 10, 24, 49, 94, 150]))]
        shared = [f"w{k % 3}"] * 3 + [f"s{x}" for x in range(rng.choice([0, 30, 60]))]
        for _ in range(rng.choice([2, 5, 9])):
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join([*shared, *words[: rng.randint(len(words) * 3 // 4, len(words))]]))
    rng.shuffle(texts)
    docs = make([(k, t, "en", "a") for k, t in enumerate(texts)]).repartition(3)
    for least, budgets in ((0.8, ((0, 0),)), (0.5, ((2, 8), (4, 16), (4, 26)))):
        kept = {r["doc_id"] for r in drop_near_copies(docs, least=least, budgets=budgets).collect()}
        assert kept == set(near_groups(texts, least))


def test_texts_beside_a_large_group_are_not_paired_with_all_of_it(make, monkeypatch):
    """Near copies with few edits, and one in ten with so many that it lies about the threshold of the others: fewer pairs than texts."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(5000)}" for _ in range(300)]
    texts = []
    for k in range(1000):
        words = list(base)
        for x in rng.sample(range(300), rng.choice([1, 2, 3]) if k % 10 else rng.randint(6, 14)):
            words[x] = f"own{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    counts = []

    def counted(pairs, sets, least):
        counts.append(pairs.count())
        return confirmed(pairs, sets, least)

    monkeypatch.setattr("quarry.llm.simhash.confirmed", counted)
    kept = {r["doc_id"] for r in drop_near_copies(make([(k, t, "en", "a") for k, t in enumerate(texts)]).repartition(3)).collect()}
    assert kept == set(near_groups(texts))
    # The first are those of the trie, a forest for each of its tasks.
    assert sum(counts[1:]) < len(texts)


def test_drop_near_copies_keeps_one_of_each_group_whatever_the_ids(make):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(90)) for _ in range(60)) for _ in range(10)]
    # Null ids, one id for two texts, copies with and without an id, and a row that is there twice.
    ids = [None, None, None, 1, 1, 2, 3, None, 5, 5]
    rows = [(i, t, "en", "a") for i, t in zip(ids, texts, strict=True)]
    rows += [(None, texts[5], "en", "a"), (4, texts[7], "en", "a"), rows[8], (None, texts[0], "en", "a")]
    kept = [(r["doc_id"], r["text"]) for r in drop_near_copies(make(rows).repartition(3)).collect()]
    want = [(i, t) for i, t in zip([*ids[:7], 4, *ids[8:]], texts, strict=True)]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id AS u", "id + 1 AS v").union(spark.range(500, 510).selectExpr("id AS u", "id + 1 AS v"))
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert roots == {**{k: 0 for k in range(201)}, **{k: 500 for k in range(500, 511)}}
