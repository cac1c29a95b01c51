"""URL filters: given rules first, then association rules mined from labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import require, saved

# The rules of the contract, as verdict, host and path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least share of the labelled urls that a combination of tokens must be in, and of those the least share that is bad.
SUPPORT, CONFIDENCE = 0.002, 0.6
#: Bad urls that a combination must have been seen in, so that chance alone makes no rule of a small table.
LEAST_URLS = 20
BAD = "bad"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct of rule and verdict, or null. The rules are compiled into one expression."""
    cases = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return cases


def tokens(url: Column) -> Column:
    """The distinct tokens of a url: labels of the host, its last two together, words in labels, path segments
    (digits as one sign), query parameters and fragment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    marked = lambda values, kind: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    words = F.filter(F.split(host, r"[.\-_]"), lambda x: ~F.array_contains(labels, x))
    segments = F.transform(F.split(path_of(url), "/"), lambda x: F.regexp_replace(x, r"[0-9]+", "0"))
    query = F.split(F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), r"[0-9]+", "0"), "&")
    fragment = F.array(F.regexp_extract(url, r"(?s)#(.*)$", 1))
    domain = F.array(F.concat_ws(".", F.slice(labels, -2, 2)))
    two = F.when(F.size(labels) >= 2, domain).otherwise(F.array().cast("array<string>"))
    parts = [marked(labels, "h="), marked(two, "d="), marked(words, "w="), marked(segments, "p="), marked(query, "q="), marked(fragment, "f=")]
    return F.coalesce(F.array_distinct(F.concat(*parts)), F.array().cast("array<string>"))


def classes(labelled: DataFrame, least: float) -> DataFrame:
    """(token, class, n, bad) of the tokens of ``labelled`` (row, items, bad) that at least ``least`` bad urls hold.

    Others can be in no rule. Tokens that the very same urls hold, like the segments of one
    path, are one class: they can stand for each other in each combination.
    """
    each = labelled.select("row", "bad", F.explode("items").alias("token"))
    same = [F.bit_xor(F.xxhash64("row")).alias("urls"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("more")]
    # At most tokens of a url x bad urls / least, at any size of the input.
    held = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), *same).filter(F.col("bad") >= least)
    return held.select("token", F.xxhash64("n", "urls", "more").alias("class"), "n", "bad")


def conditional(labelled: DataFrame, known: DataFrame, least: float, confidence: float) -> DataFrame:
    """The conditional tables of all classes, one below the other: (base, items, bad), a row for each class ``base`` of a url.

    ``items`` are the more frequent classes of the same url, so that a combination is met
    in the table of its rarest class alone. Left out are classes that fewer than ``least``
    bad urls hold there; those that all urls with ``base`` hold, as a combination fits the
    same labelled urls without them, and no fewer of the others; and those that make a
    rule by themselves, as each combination with them fits no url that they do not fit.
    All three leave the urls that the rules fit as they are. So a path of nested segments
    makes a combination for each segment, not one for each set of segments.
    """
    each = labelled.select("row", "bad", F.explode("items").alias("token")).join(known.select("token", "class", "n", (F.col("bad") >= confidence * F.col("n")).alias("alone")), "token")
    sets = each.groupBy("row", "bad").agg(F.sort_array(F.collect_set(F.struct("n", "class", "alone"))).alias("x"))
    bases = sets.select("row", "bad", F.posexplode("x").alias("at", "own"), "x")
    rest = F.filter(F.slice("x", F.col("at") + 2, F.size("x")), lambda x: ~x["alone"] & ~F.col("own.alone"))
    bases = saved(bases.select("row", "bad", F.col("own.class").alias("base"), F.col("own.n").alias("n"), F.transform(rest, lambda x: x["class"]).alias("rest")))
    pairs = bases.select("row", "bad", "base", "n", F.explode("rest").alias("class"))
    useful = pairs.groupBy("base", "n", "class").agg(F.count("*").alias("both"), F.count_if("bad").alias("both_bad"))
    useful = useful.filter((F.col("both_bad") >= least) & (F.col("both") < F.col("n"))).select("base", "class")
    some = pairs.join(useful, ["base", "class"]).groupBy("row", "base").agg(F.collect_list("class").alias("some"))
    return bases.join(some, ["row", "base"], "left").select("base", F.coalesce("some", F.array().cast("array<bigint>")).alias("items"), "bad")


def mined(labelled: DataFrame, known: DataFrame, least: float, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (antecedent: classes, confidence) for bad urls, by FP-growth over all conditional tables at once.

    An item is named by its table's base and its class, so that no combination spans two tables.
    """
    tables = saved(conditional(labelled, known, least, confidence))
    n = tables.count()
    if not n:
        return tables.select(F.col("items").alias("antecedent"), F.lit(0.0).alias("confidence"))
    named = F.transform(F.concat(F.array("base"), "items"), lambda x: F.concat_ws(":", F.col("base"), x))
    items = F.when(F.col("bad"), F.concat(named, F.array(F.concat_ws(":", F.col("base"), F.lit(BAD))))).otherwise(named).alias("items")
    # Half a url less, so that rounding of the quotient leaves no combination of just ``least`` urls out.
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, least - 0.5) / n, minConfidence=confidence).fit(tables.select(items))
    rules = model.associationRules.filter(F.element_at("consequent", 1).endswith(f":{BAD}"))
    base = F.substring_index(F.element_at("antecedent", 1), ":", 1)
    whole = F.array_distinct(F.concat(F.array(base), F.transform("antecedent", lambda x: F.substring_index(x, ":", -1))))
    return rules.select(F.sort_array(whole.cast("array<bigint>")).alias("antecedent"), "confidence").distinct()


def matched(urls: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """The urls (column url, items) that hold all classes of a rule, by an inverted index.

    A url holds a class if it holds one of its tokens. Each rule is posted under its
    rarest class alone; a url looks its classes up there, and the rest of the rule is then
    compared.
    """
    numbered = rules.withColumn("rule", F.xxhash64("antecedent"))
    posted = numbered.select("rule", F.explode("antecedent").alias("class")).join(known.select("class", "n").distinct(), "class")
    rarest = posted.groupBy("rule").agg(F.min_by("class", F.struct("n", "class")).alias("class"))
    index = saved(numbered.join(rarest, "rule").select("class", "antecedent", "confidence"))
    used = known.join(posted.select("class").distinct(), "class", "left_semi").select("token", "class")
    held = urls.select("url", F.explode("items").alias("token")).join(used, "token").groupBy("url").agg(F.collect_set("class").alias("classes"))
    looked = held.withColumn("class", F.explode("classes")).join(index, "class")
    full = F.size(F.array_except("antecedent", "classes")) == 0
    return looked.filter(full).groupBy("url").agg(F.max("confidence").alias("confidence"))


def url_filter(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", rules: Sequence[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, confidence.

    The longest given rule that fits decides. Else the url is blocked where a mined rule
    fits, with its confidence; else it is allowed. FP-growth mines combinations of url
    tokens from the pages that have a label of their id (bad: ``label_col`` is 0): all of
    a url's tokens, and combinations of any length. The verdicts are those of all rules of
    the given support and confidence; ``confidence`` is the highest of the rules that are
    mined, which hold none that adds a token to a rule of one token (see ``conditional``).
    Verdicts are worked out once for each distinct url. DataFrame functions only.

    Edge cases: a null url, or one without ``://``, has empty host and path and no tokens
    of theirs; null labels are left out, and an id with several labels is bad if one says
    so; without labelled urls nothing is mined; repeated rows get equal results; other
    columns are ignored; an empty table gives an empty result.
    """
    require(pages, (id_col, url_col))
    require(labels, (label_id, label_col))
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("id")).agg((F.min(label_col) == 0).alias("bad"))
    labelled = saved(slim.join(marks, "id").filter("url IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("items"), "bad"))
    out = slim.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.withColumn("given", fitting(F.col("host"), F.col("path"), rules))
    least = max(support * labelled.count(), LEAST_URLS)
    known = saved(classes(labelled, least))
    urls = slim.select("url").filter("url IS NOT NULL").distinct().withColumn("items", tokens(F.col("url")))
    hits = saved(matched(urls, saved(mined(labelled, known, least, confidence)), known))
    out = out.join(hits, "url", "left")
    verdict = F.coalesce(F.col("given.verdict"), F.when(F.col("confidence").isNotNull(), F.lit("block")), F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("given").isNull(), F.col("confidence")).alias("confidence"))
