"""Main text of web pages by a site style tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import require, saved

# HTML elements by how they are laid out, and the words that sites use in class, id and role for page parts.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GAPS = frozenset("br td th img wbr".split()) - {"wbr", "img"}
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math object canvas audio video select".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog button fieldset head label".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner banners sponsor sponsored promo promotion promoted "
    "menu menus nav navbar navigation navi breadcrumb breadcrumbs topbar toolbar pagination pager masthead header footer foot "
    "sidebar sidebars aside rail widget widgets related recommended recommendations "
    "cookie cookies consent gdpr notice notices alert alerts notification notifications popup modal overlay disclaimer "
    "newsletter subscribe subscription signup login search share sharing social form "
    "comment comments commentlist respond disqus replies reply reviews discussion contentinfo complementary".split()
)
#: Words that beside one of the above name a page part too, and in other names leave it open ("nav-link", but not "related-work").
LAYOUT_NAMES = frozenset(
    "box bar list item items link links wrap wrapper wrapping container section block area top bottom left right inner outer col column row grid "
    "site page main global post posts entry article articles story stories user slot unit zone panel group button buttons btn field fields "
    "icon icons label primary secondary sticky fixed mobile desktop js is has 0 reader readers thread threads content feed".split()
)
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that hold text of an article more often than a part of the page: inside an article a name there leaves open what they are.
TEXT_TAGS = frozenset("p blockquote h1 h2 h3 h4 h5 h6 pre section figure figcaption table dl".split())
#: Names that leave nothing open, even there.
SURE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle comment comments commentlist respond disqus replies reviews".split())
#: An open element ends where one of these begins inside it.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ENDED_BY = {tag: frozenset(open_tag for open_tag, by in ENDS.items() if tag in by) for tag in set().union(*ENDS.values())}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag, with quoted values.
REST = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Levels of block elements that the style tree tells apart; deeper ones belong to their ancestor at the last level. No text goes for that.
LEVELS = 64

#: The importance under which a branch goes: one inside a marked part, whose importance is that of its content, and any other.
LEAST, LEAST_OPEN = 0.3, 0.5
#: Pages of all hosts together that weigh as much as the pages of one host: what a tree says of few pages is drawn to what all say.
PRIOR = 2
#: What new content counts for in a branch that looks the same on every page, beside 1 for the presentation of one that never does.
FRESH = 0.1
#: Different presentations, equally frequent, of a branch that counts as one that never looks the same.
SHAPES = 16

PLAIN, MAIN, NOISE, GONE = 0, 1, 2, 3


def named(attributes: str, above: int) -> tuple[list[str], bool, bool, bool]:
    """Names of an element; whether one of them names an unwanted part, whether one surely does, and whether one might."""
    names = [re.sub(r"\d+", "0", w) for m in NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()]
    noise = sure = doubt = False
    unwanted = NOISE_NAMES - {"header", "masthead"} if above == MAIN else NOISE_NAMES
    for name in names:
        words = [w.rstrip("0") or w for w in re.split(r"[-_:]+", name) if w]
        if any(w in unwanted for w in words):
            if all(w in unwanted or w in LAYOUT_NAMES for w in words):
                noise = True
                sure = sure or any(w in SURE_NAMES for w in words)
            else:
                doubt = True
    return names, noise, sure, doubt


def part(tag: str, attributes: str, above: int) -> tuple[str, int, bool]:
    """The signature of an element in the style tree, what part of the page its mark says it opens, and whether its names leave that open."""
    names, noise, sure, doubt = named(attributes, above) if "=" in attributes else ([], False, False, False)
    signature = ".".join([tag, *names])
    if above in (NOISE, GONE):
        return signature, above, False
    if noise and above == MAIN and tag in TEXT_TAGS and not sure:
        noise, doubt = False, True
    # The header of a page goes, that of an article holds its title.
    if tag in NOISE_TAGS or (tag == "header" and above != MAIN) or (noise and tag not in MAIN_TAGS and tag not in ("html", "body")):
        # The tree judges blocks; of a part inside a line of text, and of the head, the mark alone decides.
        return signature, NOISE if tag in BLOCKS else GONE, False
    return signature, MAIN if tag in MAIN_TAGS or (tag in BLOCKS and ("main" in names or "article" in names)) else above, doubt


class Open:
    """An open element, with its node of the style tree: path of signatures, the paths from the root to it, the signatures inside it."""

    __slots__ = ("above", "doubt", "inside", "kind", "own", "path", "tag")

    def __init__(self, tag: str, kind: int, doubt: bool, above: tuple[int, ...], inside: list[str], own: bool) -> None:
        # An element that has no node of its own belongs to the node of the element around it.
        self.tag, self.kind, self.doubt, self.above, self.inside, self.own = tag, kind, doubt, above, inside, own
        self.path = above[-1]


def digest(value: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "replace"), seed) >> 1


def page_tree(page: str | None, markup: bool = True) -> tuple[list[tuple[int, int, bool, str]], dict[int, tuple[tuple[int, ...], int, bool, int]]]:
    """The blocks of one whole page in order (path, part, doubt, text), and its nodes: by path the paths from the root
    to it, part, doubt, and a hash of its presentation, the signatures of the children of each such element in order.

    Without ``markup`` no element or name says that a part is unwanted. Time grows with the
    length of the page, whatever it holds. Quotes that never close make this and all later
    tags of the page end at the next ``>``.
    """
    out: list[tuple[int, int, bool, str]] = []
    shapes: dict[int, tuple[tuple[int, ...], int, bool, int]] = {}
    root = Open("", PLAIN, False, (0,), [], True)
    stack: list[Open] = [root]
    marks: list[int] = []  # places in the stack of blocks and of elements that end by themselves
    opened: Counter[str] = Counter()
    held: list[str] = []
    at_block = root  # the element that the held text belongs to
    page = page or ""
    low = None
    loose = False

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((at_block.path, at_block.kind, at_block.doubt, text))
                at_block.inside.append("#")

    def note(x: Open) -> None:
        shape = digest("\n".join(x.inside), shapes[x.path][3] if x.path in shapes else 0)
        shapes[x.path] = x.above, x.kind, x.doubt, shape

    def close(k: int) -> None:
        inner = []
        while marks and marks[-1] >= k:
            inner.append(stack[marks.pop()])
        if any(x.tag in BLOCKS for x in inner):
            flush()
        for x in inner:
            if x.own and x.kind != GONE:
                note(x)
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def say(text: str) -> None:
        nonlocal at_block
        if text and stack[-1].kind != GONE:
            if not held:
                at_block = stack[-1]
            held.append(text)

    at, end, missing = 0, len(page), set()

    def until(what: str, start: int) -> int:
        """Behind the next ``what``, or -1; what is missing once is missing from there on."""
        if what in missing:
            return -1
        k = page.find(what, start)
        if k < 0:
            missing.add(what)
            return -1
        return k + len(what)

    while at < end:
        k = page.find("<", at)
        say(page[at:] if k < 0 else page[at:k])
        if k < 0:
            break
        at = k + 1
        if page.startswith("!--", at):
            at = until("-->", at + 3)
            if at < 0:
                break
            continue
        if page.startswith("![CDATA[", at) and (behind := until("]]>", at)) > 0:
            at = behind
            continue
        if page.startswith(("!", "?"), at):
            at = until(">", at)
            if at < 0:
                break
            continue
        closing = page.startswith("/", at)
        name = NAME.match(page, at + closing)
        if not name:
            say("<")
            continue
        rest = None if loose else REST.match(page, name.end())
        loose = rest is None
        behind = rest.end() if rest else until(">", name.end())
        if behind < 0:
            break
        tag, attributes, at = name[0].lower(), page[name.end() : behind - 1], behind
        if closing:
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in RAW:
            # What scripts, styles and embedded parts hold is not text of the page, whatever it looks like.
            if not attributes.endswith("/"):
                low = page.lower() if low is None else low
                if len(low) != end:
                    low = page
                k = at
                while True:
                    k = low.find(f"</{tag}", k)
                    if k < 0 or not low[k + len(tag) + 2 : k + len(tag) + 3].isalnum():
                        break
                    k += 1
                at = end if k < 0 else until(">", k)
                if at < 0:
                    break
            say(" ")
            continue
        enders = ENDED_BY.get(tag)
        if enders and any(opened[x] > 0 for x in enders):
            for k in reversed(marks):
                if stack[k].tag in enders:
                    close(k)
                    break
                if stack[k].tag in BLOCKS and stack[k].tag not in ENDS:
                    break
        if tag in BLOCKS:
            flush()
        elif tag in GAPS:
            say(" ")
        if tag not in VOID:
            above = stack[-1]
            signature, kind, doubt = part(tag, attributes, above.kind)
            if not markup:
                kind, doubt = PLAIN, False
            doubt = doubt or above.doubt
            if tag in BLOCKS or tag in ENDS:
                marks.append(len(stack))
                node, over = signature, above.above
                if len(over) > LEVELS:
                    node, over = f"* {kind} {doubt}", over[: LEVELS + 1]
                path = digest(node, over[-1])
                own = path != above.path
                if own and kind != GONE:
                    above.inside.append(node)
                stack.append(Open(tag, kind, doubt, (*over, path) if own else above.above, [] if own else above.inside, own))
            else:
                stack.append(Open(tag, kind, above.doubt, above.above, above.inside, False))
            opened[tag] += 1
    close(1)
    flush()
    note(root)
    return out, shapes


def blocks(page: str | None, markup: bool = True) -> list[tuple[int, int, bool, str]]:
    return page_tree(page, markup)[0]


def page_key(found: list[tuple[int, int, bool, str]]) -> int:
    """One key for the pages that count as one: equal but for parts marked as unwanted, if these do not hold most of the text."""
    rest = sum(len(t) * (1 if part != NOISE else -1) for _, part, _, t in found)
    key = xxhash.xxh3_64()
    for path, part, _, text in found:
        if rest < 0 or part != NOISE:
            key.update(f"{path}\n{text}\n".encode("utf-8", "replace"))
    return key.intdigest() >> 1


#: Nodes that a task remembers having described.
DESCRIBED = 100_000


def parsed(markup: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            columns: dict[str, list] = {"page": [], "blocks": [], "shapes": [], "nodes": []}
            for value in batch["html"]:
                found, nodes = page_tree(value if isinstance(value, str) else None, markup)
                columns["page"].append(page_key(found))
                columns["blocks"].append([{"path": p, "part": k, "chars": len(t), "text": t} for p, k, _, t in found])
                columns["shapes"].append([{"path": p, "h": s} for p, (_, _, _, s) in nodes.items()])
                columns["nodes"].append([{"path": p, "above": list(a), "part": k, "doubt": d} for p, (a, k, d, _) in nodes.items() if p not in seen])
                if len(seen) > DESCRIBED:
                    seen.clear()
                seen.update(nodes)
            yield batch.drop(columns="html").assign(**columns)

    return run


#: What ``parsed`` adds to a page; nodes are described once or more by a task, not on every page.
TREE = (
    "page long, blocks array<struct<path: long, part: int, chars: int, text: string>>, shapes array<struct<path: long, h: long>>, "
    "nodes array<struct<path: long, above: array<long>, part: int, doubt: boolean>>"
)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, above, part, doubt, importance) of every element node of the merged trees of each host's pages.

    A path of signatures is a node. Its *presentation* is the entropy, over the pages that
    have it, of the sequences of its children's signatures, in units of the entropy of
    ``SHAPES`` even ones (or of as many as there are pages). The *content* of a node that
    holds text is one less the entropy over the pages of each of its texts, averaged, in
    units of the largest one possible. Both are drawn from a host's few pages to what
    the pages of all hosts say of the same path, and that to a page of its own (content
    1, presentation 0), so no number of pages switches the tree on. Pages that
    differ only in parts marked as unwanted are one page, if these do not hold most of the
    text: copies are no boilerplate.

    Down the tree, a text stands in the most varied branch around it: score = content *
    (``FRESH`` + largest presentation from the root to it). Importances, at most 1: inside
    a part marked as article or main, the content; elsewhere the score in units of the
    site's best one; in a part marked as unwanted content * presentation, as far as no other branch of the
    site has content of its own (so a site that keeps its articles in ``div.share`` overrules the
    name, and a repeated article its mark). Up the tree, a branch is as important as the
    most important text in it. Texts and shapes are counted by hash, so a host's rows
    meet as counts only.
    """
    slim = F.array_distinct(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("h"))))
    # Saved, so that pages are compared once for all counts below.
    once = saved(pages.select("host", "page", slim.alias("texts"), "shapes").dropDuplicates(["host", "page"]))
    counted = lambda name: once.select("host", F.explode(name).alias("x")).groupBy("host", "x.path", "x.h").agg(F.count("*").alias("n"))
    texts, shapes = counted("texts"), counted("shapes")
    # A path is a hash of all signatures from the root, so these are the same wherever it occurs.
    nodes = pages.select(F.explode("nodes").alias("x")).select("x.*").dropDuplicates(["path"])

    def told(texts: DataFrame, shapes: DataFrame, *by: str) -> DataFrame:
        spread = lambda df, n, log: df.groupBy(*by).agg(F.sum("n").alias(n), F.sum(F.col("n") * F.ln("n")).alias(log))
        both = spread(shapes, "pages", "shape_log").join(spread(texts, "n", "log"), list(by), "left")
        content = 1 - F.least(F.lit(1.0), F.try_divide(F.col("log"), F.col("n") * F.ln("pages")))
        entropy = F.ln("pages") - F.col("shape_log") / F.col("pages")
        varied = F.least(F.lit(1.0), F.try_divide(entropy, F.ln(F.least(F.col("pages"), F.lit(SHAPES)))))
        return both.select(*by, (F.col("pages") - 1).alias("more"), F.coalesce(content, F.lit(1.0)).alias("content"), F.coalesce(varied, F.lit(0.0)).alias("varied"), F.col("n").isNotNull().alias("holds"))

    drawn = lambda n, x, to: (n * x + PRIOR * to) / (n + PRIOR)
    every = told(texts.groupBy("path", "h").agg(F.sum("n").alias("n")), shapes.groupBy("path", "h").agg(F.sum("n").alias("n")), "path")
    every = every.select("path", drawn(F.col("more"), F.col("content"), F.lit(1.0)).alias("all_content"), drawn(F.col("more"), F.col("varied"), F.lit(0.0)).alias("all_varied"))
    own = told(texts, shapes, "host", "path").join(every, "path").join(nodes, "path")
    own = own.select("host", "path", "above", "part", "doubt", "holds", drawn(F.col("more"), F.col("content"), F.col("all_content")).alias("content"), drawn(F.col("more"), F.col("varied"), F.col("all_varied")).alias("varied"))
    own = saved(own)
    around = own.select("host", "path", F.explode("above").alias("a")).join(own.select("host", F.col("path").alias("a"), F.col("varied").alias("v")), ["host", "a"])
    leaves = own.filter("holds").join(around.groupBy("host", "path").agg(F.max("v").alias("reach")), ["host", "path"])
    leaves = leaves.withColumn("score", F.col("content") * (FRESH + F.col("reach")))
    wanted = F.col("part") != NOISE
    best = leaves.groupBy("host").agg(F.max(F.when(wanted, F.col("score"))).alias("best"), F.max(F.when(wanted, F.col("content"))).alias("other"))
    relative = F.col("score") / F.greatest(F.lit(FRESH), F.coalesce("best", F.lit(0.0)))
    unwanted = F.col("content") * F.col("reach") * (1 - F.coalesce("other", F.lit(0.0)))
    importance = F.least(F.lit(1.0), F.when(F.col("part") == MAIN, F.col("content")).when(F.col("part") == NOISE, unwanted).otherwise(relative))
    leaves = leaves.join(best, "host").select("host", "above", importance.alias("importance"))
    up = leaves.select("host", F.explode("above").alias("path"), "importance").groupBy("host", "path").agg(F.max("importance").alias("importance"))
    return own.join(up, ["host", "path"]).select("host", "path", "above", "part", "doubt", "importance")


def within(path: Column, low: Column) -> Column:
    return F.coalesce(F.array_contains(low, path), F.lit(False))


#: Unimportant branches of all hosts that are broadcast; more are matched to pages by a shuffle.
BROADCAST = 200_000


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", markup: bool = True, broadcast: int = BROADCAST, least: float = LEAST, least_open: float = LEAST_OPEN) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Pages are parsed once, where they lie, into blocks with the path of elements that
    leads to them. The trees of a host are merged by counting, and every page loses the
    branches that the tree calls unimportant, each at its highest such node: under
    ``LEAST`` inside a part marked as article or main, under ``LEAST_OPEN`` elsewhere and
    where names leave open what a part is. Elements and names are one sign among
    others (see ``style_tree``); alone they decide only on parts inside a line of text. Beside a marked part
    a page keeps the others only where they hold more text than it. Without ``markup``
    elements and names say nothing and the trees decide alone. Text: references decoded,
    white space one space, blocks joined by a line feed.

    Edge cases: null and empty html give an empty text; unclosed and crossed tags are
    closed where HTML implies it; a null url is a host of its own; repeated rows give
    equal results; other columns are ignored; an empty table gives an empty result.
    """
    require(pages, (id_col, url_col, html_col))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"://([^/?#]*)", 1))
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.monotonically_increasing_id().alias("row"), F.col(html_col).cast("string").alias("html"))
    id_type = pages.schema[id_col].dataType.simpleString()
    url_type = pages.schema[url_col].dataType.simpleString()
    trees = saved(slim.mapInPandas(parsed(markup), f"id {id_type}, url {url_type}, host string, row long, {TREE}"))
    tree = saved(style_tree(trees))
    weak = F.col("importance") < F.when((F.col("part") == MAIN) & ~F.col("doubt"), least).otherwise(least_open)
    # A node inside a branch that goes is unimportant itself, so the nodes that hold text tell which blocks go.
    told = saved(tree.filter(weak).select("host", "path"))
    if told.count() <= broadcast:
        both = trees.join(F.broadcast(told.groupBy("host").agg(F.collect_list("path").alias("low"))), "host", "left")
    else:
        held = trees.select("row", "host", F.explode(F.array_distinct("blocks.path")).alias("path"))
        both = trees.join(held.join(told, ["host", "path"]).groupBy("row").agg(F.collect_list("path").alias("low")), "row", "left")
    low = lambda b: within(b["path"], F.col("low"))
    more = lambda b, part: F.when((b["part"] == part) & ~low(b), b["chars"]).otherwise(0)
    beside = F.aggregate("blocks", F.lit(0), lambda n, b: n + more(b, PLAIN) + more(b, NOISE) - more(b, MAIN)) > 0
    both = both.select("id", "url", "blocks", "low", beside.alias("beside"))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: (F.col("beside") | (b["part"] == MAIN)) & ~low(b)), lambda b: b["text"]), "\n")
    return both.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
