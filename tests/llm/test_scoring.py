import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import language_id, lm_scoring, mixing, quality_rules, toxicity
from quarry.llm.common import remainder


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow_counts(text):
    w, text = words(text), text or ""
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


REPEATS = [
    (20, "a b c d e f a b c d e g", "en", "a"),
    (21, "x x x x x x x x x x x x", "en", "a"),
    (22, "line one\nline one\n \n\nline two # $ |\nline one", "en", "a"),
]


def test_quality_counts(make, edges, nothing):
    df = edges.unionByName(make(REPEATS))
    out = quality_rules.quality_rules(df)
    for r in out.collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == slow_counts(r["text"])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(nothing).count() == 0


def slow_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = budget * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        if not free:
            return {s: most * sizes[s] for s in names}
        target = {s: most * sizes[s] if s in full else left * weight[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(make):
    rng = np.random.default_rng(1)
    rows = [(k, "w " * int(rng.integers(0, 60)), "en", ["hot", "b", "c", None, "e"][int(min(4, rng.exponential(1)))]) for k in range(3000)]
    df = make(rows).repartition(7)
    a, b = (sorted(map(tuple, mixing.mix(df.repartition(n)).collect())) for n in (3, 5))
    assert a == b
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want = slow_targets(sizes)
    by_id = {r[0]: r for r in a}
    taken = Counter()
    for i, t, _, s in rows:
        _, size, source_size, target, copies, took = by_id[i]
        assert size == len(words(t)) and source_size == sizes[s] and target == pytest.approx(want[s])
        assert took == copies * size <= 2 * size
        taken[s] += took
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60


@pytest.mark.parametrize("same_text", [False, True])
def test_rows_of_one_id_take_many_groups(make, monkeypatch, same_text):
    monkeypatch.setattr(mixing, "LEAF", 50)
    n = 4000
    rows = [(None if k % 2 else k, f"w {0 if same_text else k}", "en", "hot") for k in range(n)]
    keyed = make(rows).select(F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", "text").alias("key"), F.lit(n).alias("n_docs"))
    sizes = [r["count"] for r in mixing.dealt(keyed, 17).groupBy("group").count().collect()]
    assert sum(sizes) == n and max(sizes) < 100
    taken = mixing.mix(make(rows)).agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).first()
    assert abs(taken["taken"] - taken["target"]) <= 2


def test_rounding_keeps_words_and_expectation():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 50, 200)
    p = np.full(200, 0.37)
    ends = []
    for _ in range(300):
        out, at = mixing.rounded(p, size, rng.random(200))
        assert sum(0 < x < 1 for x in out) <= 1 and (at < 0 or 0 < out[at] < 1)
        assert (out * size).sum() == pytest.approx((p * size).sum())
        ends.append(out)
    assert np.abs(np.mean(ends, axis=0) - 0.37).mean() < 0.05


def test_mixing_edges(edges, nothing):
    out = mixing.mix(edges)
    assert out.count() == edges.count() and mixing.mix(nothing).count() == 0
    assert mixing.mixed(edges).columns == edges.columns
    assert mixing.mixed(edges).count() == out.agg(F.sum("copies")).first()[0]


def slow_model(train):
    """The probabilities of the model by definition, from counts of all words, pairs and triples."""
    start = b" S"
    n = Counter()
    for text in train:
        z = [start, *text]
        for i in range(1, len(z)):
            n[z[i],] += 1
            n[tuple(z[i - 1 : i + 1])] += 1
            if i > 1:
                n[tuple(z[i - 2 : i + 1])] += 1
    total, distinct = sum(map(len, train)), sum(len(g) == 1 for g in n)

    def p(w, h):
        if not h:
            return (n[w,] - lm_scoring.DISCOUNT if (w,) in n else lm_scoring.DISCOUNT * distinct) / total
        times, prior = len(train) if h == (start,) else n[h], lm_scoring.PRIOR[len(h) - 1]
        return (n[(*h, w)] + prior * p(w, h[1:])) / (times + prior)

    return n, total, distinct, p, start


@pytest.mark.parametrize(("block", "shard", "piece"), [(1 << 20, 1 << 21, 512), (50, 300, 4), (1, 100, 2)])
def test_lm_score_by_definition(make, monkeypatch, block, shard, piece):
    monkeypatch.setattr(lm_scoring, "PIECE", piece)
    rng = np.random.default_rng(5)
    vocabulary = ["the", "a", "of", "Cat", "dog", *(f"rare{k}" for k in range(60))]
    rows = [(k, " ".join(vocabulary[min(64, int(rng.exponential(4)))] for _ in range(int(rng.integers(0, 30)))), "en", "a") for k in range(200)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, "unseen word here", "en", "a"), (1002, "unseen word here", "en", "a")]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t, *_ in rows}
    n, total, distinct, p, start = slow_model([tokens[i] for i, *_ in rows if i not in held])
    out = lm_scoring.lm_score(make(rows).repartition(3), lm_scoring.held_out_fold(F.col("doc_id")), block=block, shard=shard).collect()
    assert len(out) == len(rows)
    for r in out:
        z = [start, *tokens[r["doc_id"]]]
        score = sum(math.log10(p(z[i], tuple(z[max(0, i - 2) : i]))) for i in range(1, len(z)))
        base = sum(math.log10((n[w,] + 1) / (total + distinct + 1)) for w in z[1:])
        assert r["held_out"] == (r["doc_id"] in held) and r["n_tokens"] == len(z) - 1 and r["train_tokens"] == total
        assert r["n_known"] == sum((w,) in n for w in z[1:])
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_a_block_asks_only_shards_of_its_own():
    """Three words at a thousand shards: no empty request, and each n-gram in one."""
    for text in ([b"one two three", b"two three"], [b""], [b"a " * 3000]):
        raw = pa.RecordBatch.from_arrays([pa.array(range(len(text))), pa.array([False] * len(text)), pa.array(text)], ["id", "held", "text"])
        (batch,) = lm_scoring.blocks_of(1 << 19)(iter([raw]))
        b = lm_scoring.Block(batch.to_pylist()[0])
        batch = batch.append_column("block", pa.array([7]))
        asked = [r for x in lm_scoring.requests(1000)(iter([batch])) for r in x.to_pylist()]
        assert all(r["n_words"] + r["n_grams"] > 0 for r in asked) and len({r["shard"] for r in asked}) == len(asked)
        assert sum(r["n_words"] for r in asked) == len(b.words)
        got = sorted(int(q) * 1000 + r["shard"] for r in asked for q in lm_scoring.decoded(r["grams"], r["n_grams"]))
        assert got == sorted(b.codes()[1].tolist())


def test_hashes_are_kept_in_full():
    rng = np.random.default_rng(1)
    for n, shards in [(0, 1), (1, 1), (1, 10**7), (5000, 1), (5000, 997)]:
        h = np.sort(rng.integers(0, 1 << 64, n, np.uint64) // np.uint64(shards) * np.uint64(shards))
        h = np.sort(np.concatenate((h, h[:2])))  # two n-grams of one hash
        assert (lm_scoring.decoded(lm_scoring.coded(h, shards), len(h)) == h // np.uint64(shards)).all()


def test_lm_probabilities_sum_to_one():
    train = [[*w.split(), b"\n"] for w in (b"a b a b c", b"a b a c", b"b a b a b")]
    n, _, _, p, start = slow_model(train)
    for h in [(), (b"a",), (b"b",), (start,), (b"a", b"b"), (start, b"a")]:
        assert sum(p(w, h) for w in [*(g[0] for g in n if len(g) == 1), b"never"]) == pytest.approx(1.0)


def test_lm_edges(edges, nothing):
    fold = lm_scoring.held_out_fold(F.col("doc_id"))
    assert lm_scoring.lm_score(edges, fold).count() == edges.count()
    assert lm_scoring.lm_score(nothing, fold).count() == 0
    alone = lm_scoring.lm_score(edges, F.lit(True)).collect()
    assert {(r["train_tokens"], r["n_known"], r["score"], r["base_score"]) for r in alone} == {(0, 0, 0.0, 0.0)}


TEXTS = {"en": "the cat and the dog were with you at that house", "de": "der hund und die katze sind nicht in dem haus", "fr": "le chat et le chien sont dans la maison avec vous"}


def language_rows(n=240):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(n):
        lang = list(TEXTS)[k % 3]
        rows.append((1000 + k, " ".join(rng.permutation(TEXTS[lang].split())[: int(rng.integers(4, 9))]), lang, "a"))
    return rows


def test_language_id(make, edges, nothing):
    fold = language_id.held_out_fold(F.col("doc_id"))
    df = make(language_rows()).unionByName(edges)
    out = language_id.language_id(df, fold).join(df.filter("doc_id IS NOT NULL").select("doc_id", "text", "lang").distinct(), "doc_id").collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] >= 1000]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    # Words never seen are told by their letters.
    model = language_id.Model(next(language_id.count(iter([df.select("lang", "text").filter("lang IS NOT NULL").toPandas()]))))
    assert language_id.Scorer(model).score(["hundekatze", "", None, "12 34"])[0] == ["de", "und", "und", "und"]
    for r in out:
        assert 0 <= r["score"] <= 1
        if not any(ch.isalpha() for ch in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language_id.language_id(nothing, fold).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(edges, F.lit(True)).collect()} == {"und"}


def slow_language(train, text):
    """Shares of the languages for one text by definition, with the words and n-grams of ``train`` (text, lang)."""
    letters, longest = re.compile(r"[^\W\d_]+"), language_id.LONGEST
    names = sorted({lang for _, lang in train})
    counts = [{lang: Counter() for lang in names} for _ in range(2)]
    for t, lang in train:
        for w in letters.findall((t or "").lower()):
            counts[0][lang][w] += 1
            b = f"^{w}$"
            for i in range(len(b)):
                for n in range(1, min(longest, len(b) - i) + 1):
                    counts[1][lang][b[i : i + n]] += 1
    tables = []
    for by_lang, least in zip(counts, (language_id.WORD_LEAST, language_id.GRAM_LEAST), strict=True):
        every = sum(by_lang.values(), Counter())
        kept = [t for t in every if every[t] >= least]
        size = {lang: sum(by_lang[lang][t] for t in kept) for lang in names}
        table = {}
        for t in kept:
            common = every[t] / max(1, sum(size.values()))
            logs = [math.log((by_lang[lang][t] + language_id.PRIOR * common + 1e-3) / (size[lang] + language_id.PRIOR)) for lang in names]
            table[t] = [min(4, max(-4, x - sum(logs) / len(names))) for x in logs]
        tables.append(table)
    total = [0.0] * len(names)
    for w in letters.findall((text or "").lower()):
        if w in tables[0]:
            found = [tables[0][w]]
        else:
            b = f"^{w}$"
            found = [next((tables[1][b[i:j]] for j in range(min(i + longest, len(b)), i, -1) if b[i:j] in tables[1]), None) for i in range(len(b))]
            found = [x for x in found if x]
        for k in range(len(names) if found else 0):
            total[k] += sum(x[k] for x in found) / len(found)
    best = max(range(len(names)), key=lambda k: total[k])
    return names[best], 1 / sum(math.exp(x - total[best]) for x in total)


def test_language_by_definition(make):
    rows = language_rows(120) + [(1, "katzenhaus undx maisonette", None, "a"), (2, "12 The zz CAT", None, "a"), (3, "qqq", "en", "a")]
    fold = language_id.held_out_fold(F.col("doc_id"))
    train = [(t, lang) for i, t, lang, _ in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    text = {i: t for i, t, *_ in rows}
    for r in language_id.language_id(make(rows).repartition(3), fold).collect():
        lang, score = slow_language(train, text[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, rel=1e-3)


def test_toxicity(spark, make, edges, nothing):
    rng = np.random.default_rng(12)
    plain = [f"word{k}" for k in range(200)]
    rows = []
    for k in range(600):
        w = [plain[int(x)] for x in rng.integers(0, 200, int(rng.integers(5, 60)))]
        if k % 4 == 0:
            w[int(rng.integers(0, len(w)))] = ["nasty,", "Awful", "vile"][k // 4 % 3]
        rows.append((k, " ".join(w), "en", "a"))
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(600)] + [(3, 0, None), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    held = remainder(F.col("doc_id"), 5) == 0
    out = toxicity.toxicity(make(rows).unionByName(edges), labels, held).collect()
    scored = [(r["predicted"], int(r["doc_id"] % 4 == 0)) for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] > 20]
    assert sum(a == b for a, b in scored) / len(scored) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert toxicity.toxicity(nothing, labels, held).count() == 0
    # Rows that any given fold holds out are not learnt from: with all toxic rows held out there is one class, and the net keeps its start.
    start = toxicity.learnt(make(rows), labels, F.lit(False))
    without = toxicity.learnt(make(rows), labels, F.col("doc_id") % 4 != 0)
    assert np.array_equal(start.out, without.out) and not np.array_equal(start.out, toxicity.learnt(make(rows), labels, F.col("doc_id") % 8 != 0).out)
    assert toxicity.toxicity(edges, labels.limit(0), held).count() == edges.count()
    assert toxicity.drop_toxic(make(rows), labels).columns == edges.columns


def test_toxicity_learns_in_a_task(spark, make, monkeypatch):
    rows = [(k, None if k == 50 else " ".join(f"word{j * k % 41}" for j in range(5 + k % 9)) + " Vile!" * (k % 4 == 0), "en", "a") for k in range(200)]
    rows += [(7, text, "en", "a") for text in ("z", "\U0001f642", "\ue000", None)]  # several texts of one id: nulls last, by code point
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)], "doc_id long, quality int, toxic int")
    rows.sort(key=lambda r: (r[0], r[1] is None, r[1] or ""))
    order = np.random.default_rng(3).permutation(len(rows))
    words_met, toxic = toxicity.Words(), np.array([int(rows[k][0] % 4 == 0) for k in order])
    docs = [np.array(words_met.numbers(toxicity.words_of(rows[k][1])), np.int32) for k in order]
    weight = np.array([150, 50]) / np.bincount(toxic)
    want = toxicity.fit(words_met, docs, toxic, weight[toxic])
    fit = toxicity.fit

    def watched(*args):
        from pyspark import TaskContext

        assert TaskContext.get() is not None, "the fit takes the driver's memory"
        return fit(*args)

    monkeypatch.setattr(toxicity, "fit", watched)
    net = toxicity.learnt(make(rows[::-1]), labels)
    for name, value in vars(want).items():
        for a, b in zip(value if name == "filters" else [value], vars(net)[name] if name == "filters" else [vars(net)[name]], strict=True):
            assert np.allclose(a, b, atol=1e-6), name


def test_toxicity_learns_from_all_labelled_rows(spark, make, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join([*(f"word{int(x)}" for x in rng.integers(0, 90, int(rng.integers(3, 30)))), *([f"vile{k % 3}!"] if k % 4 == 0 else [])]), "en", "a") for k in range(1500)]
    rows += [(4, "word1 vile0 word2", "en", "a")] * 200  # one shard holds all copies, and parts them
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(1500)], "doc_id long, quality int, toxic int")
    begun, sizes = toxicity.begun, []
    monkeypatch.setattr(toxicity, "begun", lambda seen, n, *a: sizes.append(n) or begun(seen, n, *a))
    nets = [toxicity.learnt(make(r).repartition(n), labels, F.col("doc_id") % 7 != 0, shard_rows=60) for r, n in ((rows, 2), (rows[::-1], 5))]
    given = [k for k, *_ in rows if k % 7 != 0]
    # Four fifths of the rows of all shards, whatever their number; the rest chooses thresholds.
    assert 0.8 * len(given) <= sizes[0].sum() <= 0.8 * len(given) + 40
    assert np.allclose(nets[0].table, nets[1].table) and np.allclose(nets[0].threshold, nets[1].threshold)
    scored = make(rows).filter("doc_id % 7 = 0").select("doc_id", toxicity.score_column(F.col("text"), toxicity.spread(spark, nets[0])).alias("s")).collect()
    assert sum((r["s"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in scored) / len(scored) > 0.97
    assert not np.allclose(nets[0].out, toxicity.Net().out)


def test_toxicity_pieces_of_long_texts(monkeypatch):
    net, w = toxicity.Net(1), toxicity.Words()
    docs = [w.numbers([b"x%d" % (k % 97) for k in range(n)]) for n in (0, 1, 2, 3, 500)]
    whole, _ = toxicity.raw_scores(net, w, docs)
    monkeypatch.setattr(toxicity, "TOKENS", 7)
    parts, _ = toxicity.raw_scores(net, w, docs)
    assert whole == pytest.approx(parts, abs=1e-4)


def slow_toxicity(net, text):
    """The score of one text by definition: the sum of rows for each word, filters at each place, their maximum, a logit, a threshold."""
    edges = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    bare = [w.strip(edges) or w for w in (re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text))]
    vectors = [sum((net.table[r] for r in toxicity.hashed_features(w.encode())), np.zeros(toxicity.DIM)) for w in bare] or [np.zeros(toxicity.DIM)]
    pooled = np.zeros((len(toxicity.WIDTHS), toxicity.FILTERS))
    for k, width in enumerate(toxicity.WIDTHS):
        padded = [*vectors, *[np.zeros(toxicity.DIM)] * width]
        pooled[k] = np.max([net.bias[k] + sum(padded[i + j] @ net.filters[k][j] for j in range(width)) for i in range(len(vectors))], axis=0)
    logit = (np.maximum(pooled, 0) * net.out).sum() + net.shift
    seen = Counter()
    for k, own in enumerate(toxicity.FUNCTION_WORDS.values()):
        seen[k] += sum(w in own and sum(w in x for x in toxicity.FUNCTION_WORDS.values()) == 1 for w in bare)
    language = max(seen, key=lambda k: (seen[k], -k)) if any(seen.values()) else len(seen)
    return 1 / (1 + math.exp(-min(30, max(-30, logit - net.threshold[language]))))


def test_toxicity_by_definition(spark, make, edges):
    rng = np.random.default_rng(4)
    plain = ["the", "and", "der", "und", "le", *(f"word{k}" for k in range(60))]
    rows = [(k, " ".join([*(plain[int(x)] for x in rng.integers(0, len(plain), int(rng.integers(1, 30)))), *(["(Vile)"] if k % 3 == 0 else [])]), "en", "a") for k in range(150)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(150)], "doc_id long, quality int, toxic int")
    df = make(rows).unionByName(edges.filter("doc_id != 10 AND doc_id != 11"))
    net = toxicity.learnt(df, labels)
    net.threshold[:] = np.arange(len(net.threshold)) / 10
    scored = df.select("text", toxicity.score_column(F.col("text"), toxicity.spread(spark, net)).alias("score")).collect()
    for r in scored:
        assert r["score"] == pytest.approx(slow_toxicity(net, r["text"]), abs=1e-3)
