"""Query understanding: parse, route and decompose a DataFrame of raw queries (column ``query``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import chosen

# Words, patterns and texts of the rules, in their order.
STOP_WORDS = ("的", "是", "在", "有", "和", "了", "如何", "怎么", "什么", "请", "帮我")
INTENTS = (
    ("definition", "什么是|定义|解释|概念"),
    ("how-to", "如何实现|怎么做|步骤|方法"),
    ("example", "示例|例子|代码示例|demo"),
    ("comparison", "比较|区别|对比|vs"),
    ("debug", "为什么报错|出错|错误|bug|调试"),
    ("optimization", "优化|提升|改进|更快"),
    ("exploration", "所有|全部|关于|相关信息"),
    ("fact-check", "是否正确|验证|检查|确认"),
    ("multi-hop", "然后|接着|之后|首先.*其次"),
)
CONFIDENCE_WORDS = {
    "definition": ("什么", "定义", "概念"),
    "how-to": ("如何", "怎么", "方法"),
    "example": ("示例", "例子", "代码"),
    "comparison": ("比较", "区别", "对比"),
    "debug": ("报错", "错误", "bug"),
    "optimization": ("优化", "提升", "改进"),
    "exploration": ("所有", "全部", "关于"),
    "fact-check": ("是否", "正确", "验证"),
    "multi-hop": ("然后", "接着", "首先"),
}
NAME = "[一-龥a-zA-Z]+"
SYNONYMS = {"retrieval": ("search", "recall"), "document": ("file", "text"), "the": ("this", "that")}


def intent(query: Column) -> Column:
    return chosen(((query.rlike(p), F.lit(name)) for name, p in INTENTS), F.lit("general"))


def intent_confidence(query: Column, kind: Column) -> Column:
    hits = lambda words: sum((query.contains(w).cast("int") for w in words), F.lit(0))
    n = chosen(((kind == name, hits(words)) for name, words in CONFIDENCE_WORDS.items()), F.lit(0))
    return F.least(F.lit(0.9), F.lit(0.5) + F.lit(0.15) * n)


def without_stop_words(query: Column) -> Column:
    for w in STOP_WORDS:
        query = F.replace(query, F.lit(w), F.lit(" "))
    return F.trim(query)


def keywords(query: Column) -> Column:
    """Tokens between white space, each Chinese character one of its own; those of one character are left out."""
    parts = F.split(without_stop_words(query), r"\s+|(?<=[一-龥])|(?=[一-龥])")
    return F.filter(parts, lambda x: F.length(x) > 1)


def slot(query: Column, words: str) -> Column:
    return F.nullif(F.regexp_extract(query, rf"(?:{words})\s*({NAME})", 1), F.lit(""))


def parse(queries: DataFrame) -> DataFrame:
    """``queries`` with intent, confidence, core, related, excluded, semantic slots, complexity, modality, language."""
    q, n = F.col("query"), F.length("query")
    entities = F.regexp_count(q, F.lit("[a-zA-Z]{3,}")) + F.regexp_count(q, F.lit("[一-龥]{2,}"))
    signals = {
        "multipleEntities": entities > 2,
        "multipleConditions": F.regexp_count(q, F.lit("如果|当|条件|要求|并且|或者")) > 1,
        "needsInference": q.rlike("然后|接着|因此|所以"),
        "longQuery": n > 50,
    }
    score = sum((s.cast("int") for s in signals.values()), F.lit(0)) * 2
    cjk = F.coalesce(F.try_divide(F.regexp_count(q, F.lit("[一-龥]")), n), F.lit(0.0))
    out = queries.withColumn("intent", intent(q)).withColumn("words", keywords(q))
    return out.withColumns(
        {
            "confidence": intent_confidence(q, F.col("intent")),
            "core": F.slice("words", 1, 5),
            "related": F.slice("words", 6, 5),
            "excluded": F.filter(F.regexp_extract_all(q, F.lit(r"(?:不包含|不包括|排除)\s*(\S+)"), F.lit(1)), lambda x: x != ""),
            "subject": slot(q, "关于|针对|对于"),
            "action": slot(q, "如何|怎么|怎样"),
            "object": slot(q, "实现|获取|查找|搜索"),
            "conditions": F.array().cast("array<string>"),
            "complexity_score": score,
            "complexity": chosen(((score <= 2, F.lit("simple")), (score <= 6, F.lit("medium"))), F.lit("complex")),
            "reasons": F.array_compact(F.array(*(F.when(s, F.lit(k)) for k, s in signals.items()))),
            "modality": F.when(q.rlike("代码|function|class|import|def"), F.when(q.contains("代码"), F.lit("mixed")).otherwise(F.lit("code"))).otherwise(F.lit("text")),
            "language": F.when(cjk > 0.3, F.lit("zh")).otherwise(F.lit("en")),
        }
    ).drop("words")


def route(parsed: DataFrame) -> DataFrame:
    """Strategy, reason and what it is expected to take: paths, candidates, tokens, latency."""
    kind, score, n = F.col("intent"), F.col("complexity_score"), F.length("query")
    # Rules in order, as condition, strategy and reason.
    rules = (
        ((F.col("complexity") == "simple") & (kind == "definition"), "single-hop", "简单定义查询，单次检索足够"),
        ((kind == "multi-hop") | (score > 6), "decomposition", "复杂查询，需要分解为子查询"),
        (kind == "comparison", "multi-hop", "比较查询需要检索多个实体"),
        ((kind == "debug") & (F.size("conditions") > 0), "step-back", "调试问题需要退步思考上下文"),
        (kind == "exploration", "exploratory", "探索式查询需要广度检索"),
        (kind == "fact-check", "fact-verification", "事实验证需要精确匹配"),
    )
    out = parsed.withColumn("strategy", chosen(((c, F.lit(s)) for c, s, _ in rules), F.lit("single-hop")))
    out = out.withColumn("route_reason", chosen(((c, F.lit(r)) for c, _, r in rules), F.lit("默认单次检索")))
    parts = F.ceil(score / 2).cast("int")
    numbers = lambda a, b, c, d: F.struct(F.lit(a).cast("int").alias("paths"), F.lit(b).cast("int").alias("candidates"), F.lit(c).cast("int").alias("tokens"), F.lit(d).cast("int").alias("latency_ms"))
    s = F.col("strategy")
    estimate = chosen(
        (
            (s == "decomposition", numbers(parts, parts * 20, n * parts + 1000, parts * 100)),
            (s == "multi-hop", numbers(2, 40, n * 2 + 800, 200)),
            (s == "exploratory", numbers(3, 50, n + 1500, 150)),
        ),
        numbers(1, 20, n + 500, 100),
    )
    return out.withColumn("estimate", estimate)


def decompose(parsed: DataFrame) -> DataFrame:
    """``sub_queries`` in an order that respects their dependencies, and ``fusion``: sequential if any depends on another."""
    q = F.col("query")
    both = rf"比较\s*({NAME})\s*(?:和|与|同)\s*({NAME})"
    named = F.array(F.regexp_extract(q, both, 1), F.regexp_extract(q, both, 2))
    entities = F.when(q.rlike(both), named).otherwise(F.slice("core", 1, 2))
    none = F.array().cast("array<string>")

    def sub(number: Column, text: Column, kind: Column, needs: Column, weight: Column) -> Column:
        return F.struct(F.concat(F.lit("q"), number.cast("string")).alias("id"), text.alias("query"), kind.alias("type"), needs.alias("depends_on"), weight.alias("weight"))

    single = F.transform(entities, lambda e, i: sub(i + 1, F.concat(e, F.lit(" 的特点和特性")), F.lit("atomic"), none, F.lit(0.4)))
    versus = F.array(sub(F.lit(3), F.concat(F.get(entities, F.lit(0)), F.lit(" 和 "), F.get(entities, F.lit(1)), F.lit(" 的区别")), F.lit("derived"), F.array(F.lit("q1"), F.lit("q2")), F.lit(0.6)))
    comparison = F.when(F.size(entities) >= 2, F.concat(single, versus)).otherwise(single)
    steps = F.filter(F.split(q, "首先|然后|接着|最后|第一步|第二步"), lambda x: x.rlike(r"\S"))
    how_to = F.transform(steps, lambda x, i: sub(i + 1, x, F.lit("atomic"), none, 1 / F.size(steps)))
    hops = F.split(q, "然后|接着|之后")
    chain = F.transform(
        hops,
        lambda x, i: sub(i + 1, F.trim(x), F.when(i == 0, F.lit("atomic")).otherwise(F.lit("derived")), F.when(i > 0, F.array(F.concat(F.lit("q"), i.cast("string")))).otherwise(none), 1 / F.size(hops)),
    )
    whole = F.array(sub(F.lit(1), q, F.lit("atomic"), none, F.lit(1.0)))
    kind = F.col("intent")
    cases = ((kind == "comparison", comparison), ((kind == "how-to") & (F.col("complexity_score") > 4), how_to), (kind == "multi-hop", chain))
    out = parsed.withColumn("sub_queries", chosen(cases, whole))
    # A sub-query only ever depends on earlier ones, so the order of numbers is one of execution.
    depends = F.exists("sub_queries", lambda s: F.size(s["depends_on"]) > 0)
    return out.withColumn("fusion", F.when(depends, F.lit("sequential")).otherwise(F.lit("parallel")))


def expand(queries: DataFrame, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> DataFrame:
    """Each query with its variants, one word replaced by each of its synonyms: query_id, variant, query."""
    rows = [(w, s) for w, others in synonyms.items() for s in others]
    table = F.array(*(F.struct(F.lit(a).alias("word"), F.lit(b).alias("other")) for a, b in rows))
    q = F.concat(F.lit(" "), F.lower("query"), F.lit(" "))
    found = F.filter(table, lambda x: q.contains(F.concat(F.lit(" "), x["word"], F.lit(" "))))
    variants = F.transform(found, lambda x: F.trim(F.replace(q, F.concat(F.lit(" "), x["word"], F.lit(" ")), F.concat(F.lit(" "), x["other"], F.lit(" ")))))
    return queries.select("query_id", F.posexplode(F.concat(F.array(F.col("query")), variants)).alias("variant", "query"))


def coverage(hits: DataFrame) -> DataFrame:
    """How much of a query's keywords its hits hold: .7 core + .3 related; a mean below .7 asks for a supplement."""
    held = lambda words: F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.lower("content").contains(F.lower(w)))), F.size(words)), F.lit(0.0))
    each = hits.withColumn("coverage", 0.7 * held(F.col("core")) + 0.3 * held(F.col("related")))
    mean = each.groupBy("query_id").agg(F.avg("coverage").alias("coverage"))
    return mean.withColumn("supplement", F.col("coverage") < 0.7)


# Forms of a vague query with their kinds; tokens that each step may use, by complexity.
VAGUE = (("那个什么.*", "vague-reference"), ("好像.*的样子", "uncertain"), ("类似.*的", "analogy"))
BUDGET = {"complex": {"rewrite": 200, "decompose": 300, "rerank": 500}, "other": {"rewrite": 100, "decompose": 0, "rerank": 200}}


def vague(text: Column) -> Column:
    """The kind of a vague query, or null."""
    return chosen(((text.rlike(pattern), F.lit(kind)) for pattern, kind in VAGUE), F.lit(None).cast("string"))


def budget(parsed: DataFrame) -> DataFrame:
    """Tokens that each step of a parsed query may use."""
    share = lambda step: F.when(F.col("complexity") == "complex", BUDGET["complex"][step]).otherwise(BUDGET["other"][step]).alias(step)
    return parsed.withColumn("budget", F.struct(*map(share, BUDGET["complex"])))


def tfidf(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` heaviest tokens of each query: how often it has them, by how rare they are among the chunks."""
    split = lambda text: F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    tf = queries.select("query_id", F.explode(split(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("tf"))
    wanted = tf.select("token").distinct()
    df = chunks.select(F.explode(F.array_distinct(split(F.col("content")))).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    n = chunks.agg(F.count("*").alias("n"))
    idf = F.ln((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weighed = tf.join(df, "token", "left").join(F.broadcast(n), how="cross").withColumn("weight", F.round(F.col("tf") * idf, 6))
    order = Window.partitionBy("query_id").orderBy(F.col("weight").desc(), "token")
    return weighed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "token", "weight", "rank")
