import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm.html_extraction import FRESH, LEVELS, MAIN, NOISE, PLAIN, PRIOR, SHAPES, TREE, blocks, extract, page_key, page_tree, style_tree
from quarry.llm.sentencepiece_sampling import LITERAL, SPACE, Lattices, Pieces, decode, decode_ids, encode, encode_batch, segments
from quarry.llm.url_filter import CONFIDENCE, LEAST_URLS, RULES, url_filter
from quarry.llm.url_filter import tokens as url_tokens

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav>
<div class="ad">Buy</div><article><h1>Title &amp; more</h1><p><b>One<br>two<p>three&#32; four</p><script>var t="</p>"; "<p>no</p>"</script>
<ul><li>a<li>b</ul><p title="x>y">five <!-- hidden --> six</p><aside>Side</aside><div id="comments"><p>Me too</p></div></article>
<form><input><label>Mail</label></form><footer>Foot</footer>"""


def wanted(page):
    """The blocks of a page that no mark calls unwanted."""
    return [t for _, part, _, t in blocks(page) if part != NOISE]


def test_blocks():
    assert [t for _, part, _, t in blocks(PAGE) if part == NOISE] == ["Home", "Buy", "Side", "Me too", "Mail", "Foot"]
    assert wanted(PAGE) == ["Title & more", "One two", "three four", "a", "b", "five six"]
    assert blocks(None) == blocks("") == []


def test_extract(spark):
    plain = lambda k: f"<body><div class='content'><p>own text {k}</p></div><div class='box'><p>same on each page</p></div></body>"
    rows = [(1, "https://a.example/x", PAGE), (1, "https://a.example/x", PAGE), (2, None, None), (3, "no host", "")]
    rows += [(10 + k, f"http://b.example/{k}", plain(k)) for k in range(6)]
    df = spark.createDataFrame([(*r, "h", "b") for r in rows], "page_id long, url string, html string, host string, blocks string")
    out = {r["page_id"]: r for r in extract(df).collect()}
    assert out[1]["text"] == "Title & more\nOne two\nthree four\na\nb\nfive six"
    assert out[2]["text"] == out[3]["text"] == "" and out[2]["url"] is None
    assert [out[10 + k]["text"] for k in range(6)] == [f"own text {k}" for k in range(6)]
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert extract(df).count() == len(rows) and extract(df.limit(0)).count() == 0


def test_tree_decides_on_marked_pages(spark):
    boxed = lambda k: f"<body><article><h1>title {k}</h1><p>own text {k}</p><div class='box'><p>same on each page</p></div></article></body>"
    teased = lambda k: f"<body><article><p>teaser</p></article><div class='content'><p>body {k}</p></div><div class='box'><p>same on each page</p></div></body>"
    copied = "<body><article><p>fetched again</p></article><p>beside</p></body>"
    rows = [(k, "http://a.example/", boxed(k)) for k in range(6)] + [(10 + k, "http://b.example/", teased(k)) for k in range(6)] + [(20 + k, "http://c.example/", copied) for k in range(6)]
    out = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[k] for k in range(6)] == [f"title {k}\nown text {k}" for k in range(6)]
    assert [out[10 + k] for k in range(6)] == [f"body {k}" for k in range(6)]
    assert {out[20 + k] for k in range(6)} == {"fetched again"}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>x <span class="ad">Buy now</span> y</p></article>', ["x y"]),
        ("<article><p>x <button>Share</button> y</p><label>Mail</label></article>", ["x y"]),
        ('<article><p>a</p><a class="nav-link">Home</a></article>', ["a"]),
        ('<article><h2 class="related-work">R</h2><h1 class="search-results-title">S</h1><div class="text-form">body</div></article>', ["R", "S", "body"]),
        ('<div class="ad-slot">q</div><div class="site-header">r</div><ol class="comment-list"><li>c</ol>ok', ["ok"]),
        ("a < b <3 c", ["a < b <3 c"]),
        ('<p title="x>unbalanced</p> next', ["unbalanced", "next"]),
        ('a<SCRIPT>"</scriptx>"</SCRIPT >b', ["a b"]),
        ("a<!-- never closed <p>b", ["a"]),
        (f'a <p title="{"x" * 9000}>leak"> b', ["a", "b"]),
        ("<div>" * 600 + '<nav>Home</nav><div class="ad">Buy</div>deep' + "</div>" * 600 + "<article>end</article>", ["deep", "end"]),
        ('<article>a<div class="reader-comments">c</div><div class="sponsored-content">d</div></article>', ["a"]),
        ('<article>a<ul class="comment-thread">c</ul><div class="user-reviews">d</div><div id="disqus_thread">e</div></article>', ["a"]),
        ('<article><section class="discussion"><h2>b</h2><p>c</p></section><blockquote class="share">d</blockquote><p class="alert">e</p></article>', ["b", "c", "d", "e"]),
    ],
)
def test_blocks_of_odd_pages(page, want):
    assert wanted(page) == want


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<b>", "<b></i>", "<li><b>", "<![CDATA[", "<!--", "<script>", "<", '<a ">', "<p>x", "<div>", '">"<a ', "<nav><p>x"])
def test_time_to_parse_grows_with_the_page_alone(unit):
    began = time.perf_counter()
    blocks(unit * (500_000 // len(unit)))
    assert time.perf_counter() - began < 20


def slow_importance(hosts):
    """Importance of each node by definition, from the pages (page_tree) of each host."""

    def entropy(counts):
        return -sum(n / sum(counts) * math.log(n / sum(counts)) for n in counts)

    def told(pages):
        """(pages, content, presentation, holds text) of each path."""
        shapes, texts, out = defaultdict(list), defaultdict(Counter), {}
        for found, nodes in pages:
            for path, (_, _, _, shape) in nodes.items():
                shapes[path].append(shape)
            for path, text in {(b[0], b[3]) for b in found}:
                texts[path][text] += 1
        for path, each in shapes.items():
            m, held = len(each), texts[path]
            lost = sum(n * math.log(n) for n in held.values()) / (sum(held.values()) * math.log(m)) if held and m > 1 else 0
            varied = entropy(list(Counter(each).values())) / math.log(min(m, SHAPES)) if m > 1 else 0
            out[path] = m, 1 - min(1, lost), min(1, varied), bool(held)
        return out

    def drawn(m, x, to):
        return ((m - 1) * x + PRIOR * to) / (m - 1 + PRIOR)

    def key(found):
        chars = sum(len(b[3]) * (1 if b[1] != NOISE else -1) for b in found)
        return tuple((b[0], b[3]) for b in found if chars < 0 or b[1] != NOISE)

    distinct = {h: list({key(p[0]): p for p in reversed(pages)}.values()) for h, pages in hosts.items()}
    every = {path: (drawn(m, c, 1), drawn(m, v, 0)) for path, (m, c, v, _) in told([p for pages in distinct.values() for p in pages]).items()}
    out = {}
    for host, pages in distinct.items():
        nodes = {path: node for _, nodes in pages for path, node in nodes.items()}
        own = {path: (drawn(m, c, every[path][0]), drawn(m, v, every[path][1]), holds) for path, (m, c, v, holds) in told(pages).items()}
        reach = {path: max(own[a][1] for a in nodes[path][0]) for path in nodes}
        leaves = {path: own[path][0] * (FRESH + reach[path]) for path in nodes if own[path][2]}
        best = max([s for path, s in leaves.items() if nodes[path][1] != NOISE], default=0)
        other = max([own[path][0] for path in leaves if nodes[path][1] != NOISE], default=0)
        for path, score in leaves.items():
            by_part = {PLAIN: score / max(best, FRESH), MAIN: own[path][0], NOISE: own[path][0] * reach[path] * (1 - other)}
            for a in nodes[path][0]:
                out[host, a] = max(out.get((host, a), 0), min(1, by_part[nodes[path][1]]))
    return out


TREES = f"host string, {TREE}"


def test_importance_by_definition(spark):
    rng = np.random.default_rng(3)
    hosts, rows = {}, []
    for host, n in (("a", 9), ("b", 2), ("c", 1), ("d", 30)):
        hosts[host] = []
        for k in range(n):
            links = "".join(f"<li>{x}" for x in rng.integers(0, 9, int(rng.integers(1, 5))))
            body = "".join(f"<p>{host} {k} {x}</p>" for x in range(int(rng.integers(1, 9))))
            page = page_tree(f"<nav><ul>{links}</ul></nav><div class='related-box'>{k % 3}</div><div><article>{body}</article></div><div class='share'><p>{k}<p>{host}</div>top {k % 2}")
            hosts[host].append(page)
            nodes = [(p, list(a), part, doubt) for p, (a, part, doubt, _) in page[1].items()]
            shapes = [(p, shape) for p, (*_, shape) in page[1].items()]
            found = [(p, part, len(t), t) for p, part, _, t in page[0]]
            rows += [(host, page_key(page[0]), found, shapes, nodes)] * (1 + k % 2)
    got = {(r["host"], r["path"]): r["importance"] for r in style_tree(spark.createDataFrame(rows, TREES)).collect()}
    assert got == pytest.approx(slow_importance(hosts)) and len(got) == 40


def test_presentation_tells_menus_of_new_texts_from_articles(spark):
    """With names and tags off: nothing repeats but the build of menu, advert and footer."""
    rng = np.random.default_rng(5)

    def page(k):
        links = "".join(f"<li><a>go {k} {x}</a>" for x in range(rng.choice([4, 5, 6], p=[0.1, 0.15, 0.75])))
        body = "".join(f"<p>text {k} {x}</p>" for x in range(rng.integers(1, 30)))
        return f"<body><div class='x'><ul>{links}</ul></div><div class='y'>buy {k}</div><div class='z'><h1>title {k}</h1>{body}</div><div class='w'>by {k}</div></body>"

    rows = [(k, f"http://{'abc'[k % 3]}.example/{k}", page(k)) for k in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for k, text in ((r["page_id"], r["text"]) for r in extract(df, markup=False).collect()):
        assert text == "\n".join([f"title {k}", *re.findall(rf"text {k} \d+", rows[k][2])])
    everything = {r["page_id"]: r["text"] for r in extract(df, markup=False, least=-1.0, least_open=-1.0).collect()}
    assert all(f"go {k} 0" in t and f"buy {k}" in t and f"by {k}" in t for k, t in everything.items())


def test_entropy_overrules_marks(spark):
    """Articles in a part named like a page part stay; a part marked as article that repeats goes."""
    share = lambda k: "<body><div class='share'>" + "".join(f"<p>own {k} {x}</p>" for x in range(1 + k % 7)) + "</div><article>same</article></body>"
    df = spark.createDataFrame([(k, "http://a.example/", share(k)) for k in range(40)], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in extract(df).collect()}
    assert out == {k: "\n".join(f"own {k} {x}" for x in range(1 + k % 7)) for k in range(40)}


def test_levels_below_the_last_keep_their_parts():
    found, nodes = page_tree("<div>" * 3000 + "a<nav>b</nav><p>c" + "</div>" * 3000 + "<p>d")
    assert [(t, part) for _, part, _, t in found] == [("a", PLAIN), ("b", NOISE), ("c", PLAIN), ("d", PLAIN)]
    assert max(len(a) for a, *_ in nodes.values()) == LEVELS + 2 and len(nodes) < LEVELS + 6


def test_trees_alone_tell_what_a_site_repeats(spark):
    def page(host, k):
        links = "".join(f"<li><a>{host} link {x}</a>" for x in range(5))
        return f"<nav><ul>{links}</ul></nav><article><h1>title {host} {k}</h1><p>text {host} {k}</p><p>more {k}</p></article><footer>by {host}</footer>"

    rows = [(f"{host} {k}", f"http://{host}.example/{k}", page(host, k)) for host in "abc" for k in range(12)]
    out = extract(spark.createDataFrame(rows, "page_id string, url string, html string"), markup=False)
    assert {r["page_id"]: r["text"] for r in out.collect()} == {x: f"title {x}\ntext {x}\nmore {x.split()[1]}" for x, *_ in rows}


def test_few_and_many_branches_give_the_same(spark):
    boxed = lambda k: f"<body><p>own text {k}</p><div class='box'><p>same on each page</p></div></body>"
    df = spark.createDataFrame([(k, "http://a.example/", boxed(k)) for k in range(9)], "page_id long, url string, html string")
    few, many = ({r["page_id"]: r["text"] for r in extract(df, broadcast=n).collect()} for n in (1000, 0))
    assert few == many == {k: f"own text {k}" for k in range(9)}


def slow_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


URLS = ["http://A.Example.com/en/7x", "https://example.com/en/1", "http://x.example.net/de/8", "http://net/de/", "http://notnet/de/1", "ftp://a.org?x=/es/", "http://org/es/#/en/", "//x.com/en/", "", None, "http://com/en/ é"]


def test_url_filter(spark):
    rows = [(k, u) for k, u in enumerate(URLS)]
    for k in range(200):
        bad = k % 2
        rows.append((100 + k, f"http://site{k % 7}.example.edu/{'cheap' if bad else 'good'}/offer{k}?ref={k}"))
    rows.append((500, "http://other.example.edu/cheap/offer9"))
    pages = spark.createDataFrame([(*r, "t", "v") for r in rows], "page_id long, url string, items string, verdict string")
    labels = spark.createDataFrame([(100 + k, 1 - k % 2) for k in range(200)] + [(0, None)], "doc_id long, quality int")
    out = {r["page_id"]: r for r in url_filter(pages, labels).collect()}
    assert len(out) == len(rows)
    for i, u in rows:
        host, path, rule, verdict = slow_rule(u)
        r = out[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        mined = "block" if u and "/cheap/" in u else "allow"
        assert r["verdict"] == (verdict or mined)
    assert url_filter(pages, labels.limit(0)).filter("rule IS NULL AND verdict = 'block'").count() == 0
    assert url_filter(pages.limit(0), labels).count() == 0


CONTRACT = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_given_rules_are_the_contract(spark):
    """Each rule's word, on its own host, on a subdomain and beside a longer path, is the contract's, whatever the labels say."""
    assert sorted((v, h + p) for v, h, p in RULES) == sorted(CONTRACT)
    rows = [(f"http://{sub}{rule}{end}", rule, verdict) for verdict, rule in CONTRACT for sub in ("", "a.", "a.b.") for end in ("", "x", "?q=1", "/z#f")]
    pages = spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(k, 0) for k in range(len(rows))], "doc_id long, quality int")
    for marks in (labels, labels.limit(0)):
        out = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter(pages, marks).collect()}
        assert out == {k: (rule, verdict) for k, (_, rule, verdict) in enumerate(rows)}


def test_rules_of_long_shared_paths(spark):
    """Tokens that always come together are mined as one, and nested paths make no more rules than their number."""
    rows, marks = [], []
    for k in range(300):
        bad = k % 3 == 0
        depth = 20 if k % 2 else 5 + k % 15
        path = "/".join(f"{'cheap' if bad else 'good'}{'abcdefghijklmnopqrst'[x]}" for x in range(depth))
        rows.append((k, f"http://one.example.edu/{path}/x{k}"))
        marks.append((k, 0 if bad else 1))
    rows += [(1000, None), (1001, "http://other.example.edu/cheapa/" + "y/" * 3000), rows[0]]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int")
    began = time.perf_counter()
    out = [(r["page_id"], r["verdict"]) for r in url_filter(pages, labels).collect()]
    assert time.perf_counter() - began < 90
    assert sorted(out) == sorted((i, "block" if i == 1001 or (i < 300 and i % 3 == 0) else "allow") for i, _ in rows)


def test_rules_by_definition(spark):
    """Verdicts are those of all combinations of all tokens that have the support and confidence, in urls of up to 20 tokens."""
    rng = np.random.default_rng(5)
    names = [f"s{'abcdefghijklmn'[x]}" for x in range(14)]
    rows, marks = [], []
    for k in range(1500):
        has = rng.random(14) < np.where(np.arange(14) % 2, 0.5, 0.35)
        has[4] |= has[5]  # a token that another one implies
        has[6] = has[7]  # and two that always come together
        bad = (has[0] and has[1] and has[3]) or (has[8] and has[9] and not has[2]) if rng.random() < 0.9 else rng.random() < 0.2
        rows.append((k, "http://one.example.edu/" + "/".join(n for n, h in zip(names, has, strict=True) if h)))
        if k < 1200:
            marks.append((k, 0 if bad else 1))
    rows += [(2000 + k, "http://x.test/" + "/".join(rng.choice(names, k % 9, replace=False))) for k in range(300)]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int")
    out = {r["page_id"]: r["verdict"] for r in url_filter(pages, labels).collect()}
    items = {r["page_id"]: r["x"] for r in pages.select("page_id", url_tokens(F.col("url")).alias("x")).collect()}
    bad = {i for i, q in marks if q == 0}
    held = Counter(t for i in bad for t in items[i])
    number = {t: 1 << n for n, t in enumerate(sorted(t for t, n in held.items() if n >= LEAST_URLS))}
    mask = {i: sum(number.get(t, 0) for t in x) for i, x in items.items()}
    every, wrong = np.zeros(1 << len(number), int), np.zeros(1 << len(number), int)
    for i, _ in marks:
        every[mask[i]] += 1
        wrong[mask[i]] += i in bad
    for bit in number.values():
        for x in (every, wrong):
            x = x.reshape(-1, 2, bit)
            x[:, 0] += x[:, 1]  # of all urls that hold the combination
    fits = (wrong >= LEAST_URLS) & (wrong >= CONFIDENCE * every)
    fits[0] = False
    for bit in number.values():
        x = fits.reshape(-1, 2, bit)
        x[:, 1] |= x[:, 0]
    want = {i: "block" if fits[m] else "allow" for i, m in mask.items()}
    assert max(map(len, items.values())) > 14 and 100 < sum(v == "block" for v in want.values()) < 1000
    assert out == want


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load()


def segmentations(text, ids):
    return [(p, *rest) for k in range(1, len(text) + 1) if (p := text[:k]) in ids for rest in segmentations(text[k:], ids)] if text else [()]


def test_samples_follow_the_lattice(pieces):
    every = segmentations(SPACE + "then", pieces.ids)
    weight = {tuple(pieces.ids[p] for p in s): np.exp(0.5 * sum(pieces.log_weight[p] for p in s)) for s in every}
    n = 20_000
    flat, ends = encode_batch(Lattices(pieces, 0.5), ["then"] * n, [str(k) for k in range(n)], 3)
    seen = {}
    for part in np.split(flat, ends[:-1]):
        seen[tuple(part.tolist())] = seen.get(tuple(part.tolist()), 0) + 1
    assert set(seen) <= set(weight) and len(every) > 5
    for s, w in weight.items():
        assert seen.get(s, 0) / n == pytest.approx(w / sum(weight.values()), abs=0.02)


TEXTS = ["a", "  x  y ", f"{SPACE}a{SPACE} b", "é\n\n日本語🙂\x00\t z", "x" * 5000, "🙂" * 300, "\n", " ", "The cat. The cat."]


def test_round_trip_and_batches(pieces):
    both = encode_batch(Lattices(pieces, 0.5), TEXTS, [str(k) for k in range(len(TEXTS))], 3)
    for k, (t, part) in enumerate(zip(TEXTS, np.split(both[0], both[1][:-1]), strict=True)):
        assert decode_ids(part.tolist(), pieces.raw) == t
        alone, _ = encode_batch(Lattices(pieces, 0.5), [t], [str(k)], 3)
        assert alone.tolist() == part.tolist()
    assert LITERAL not in "".join(TEXTS)


def test_bounds_do_not_depend_on_the_batch(spark, pieces):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    parts = list(dict.fromkeys(x for t in texts if t for x in segments(SPACE + t.replace(" ", SPACE), pieces.bounded)))
    every = Lattices(pieces, 0.5)
    every.add(parts)
    at, some = 0, Lattices(pieces, 0.5)
    for k in range(0, len(parts), 7):
        some.clear()
        some.add(parts[k : k + 7])
        assert np.array_equal(some.bound, every.bound[at : at + len(some.bound)]) and np.array_equal(some.piece, every.piece[at : at + len(some.bound)])
        at += len(some.bound)
    assert at == len(every.bound) and len(parts) > 10_000


def test_encode(edges, nothing):
    out = encode(edges)
    assert out.columns == [*edges.columns, "ids", "lossless"]
    rows = decode(out).collect()
    assert all(r["decoded"] == r["text"] and r["lossless"] for r in rows)
    assert all((r["ids"] is None) == (r["text"] is None) for r in rows)
    again = encode(edges.repartition(5))
    key = lambda df: sorted(str((r["doc_id"], r["ids"])) for r in df.collect())
    assert key(out) == key(again)
    assert encode(nothing).count() == 0


def test_pipeline(spark, edges, tmp_path):
    edges.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{k}"
        before = docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == before
    assert counts[0] == edges.count() and counts[1] < counts[0] and docs.filter(~F.col("lossless")).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]
