"""From documents to validated chunks, as DataFrame transformations.

Documents have doc_id, path, content; chunks have doc_id, ordinal, start_pos, end_pos,
content, section. Splitters are narrow: they compute all starts of a document as an array
and explode it, so a document never leaves its row before it is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import splitters

# Default sizes, separators, limits and messages.
SIZE, OVERLAP, WINDOW_OVERLAP = 500, 50, 100
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SECTION_MOST, SECTION_SIZE = 2000, 1000
LEAST, MOST, QUALITY = 50, 5000, 0.3
SUGGESTIONS = {
    "too-small": "合并到相邻分块",
    "too-large": "进一步切分",
    "incomplete": "调整边界确保代码完整",
    "low-quality": "过滤低质量内容",
    "duplicate": "去重处理",
}
CODE_EXTENSIONS = tuple(k for k, v in X.EXTENSIONS.items() if v == "code")


def checked(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"overlap must be at least 0 and below the size; got {overlap} and {size}")


def cut(docs: DataFrame, starts: Column, size: int, section: bool = False) -> DataFrame:
    """Chunks of up to ``size`` characters at the places in ``starts`` (an array, counted from 0)."""
    at = docs.select("*", F.posexplode(starts).alias("ordinal", "start_pos"))
    content = F.substring("content", F.col("start_pos") + 1, F.lit(size))
    out = at.withColumn("content", content)
    name = F.concat(F.lit("window-"), F.col("ordinal").cast("string")) if section else F.lit(None).cast("string")
    return out.withColumn("end_pos", F.col("start_pos") + F.length("content")).withColumn("section", name)


def fixed_size(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks start every size - overlap characters and end with the first that reaches the end; no text, no chunk."""
    checked(size, overlap)
    n = F.length("content")
    more = F.greatest(F.ceil((n - size) / F.lit(float(size - overlap))), F.lit(0)).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), more), lambda i: i * (size - overlap)))
    return cut(docs, starts, size)


def sliding_window(docs: DataFrame, size: int = SIZE, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """A window at every step while it starts within the text, so the last ones may lie inside the one before."""
    checked(size, overlap)
    starts = F.when(F.length("content") > 0, F.sequence(F.lit(0), F.length("content") - 1, F.lit(size - overlap)))
    return cut(docs, starts, size, section=True)


def split_recursively(content: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    """Greedy merging of segments up to ``size``; a segment that is too long is split at the next separator.

    Returns exact starts and texts. The separator between two chunks belongs to neither.
    """
    if len(content) <= size:
        return [(0, content)] if content else []
    if not separators or not separators[0]:
        starts = range(0, max(1, len(content) - overlap), size - overlap)
        return [(s, content[s : s + size]) for s in starts]
    sep, out = separators[0], []
    begin = end = at = 0  # the chunk in hand is content[begin:end]
    for k, segment in enumerate(content.split(sep)):
        stop = at + len(segment)
        grown = (stop - begin) if k and end > begin else len(segment) + (len(sep) if k and begin == end and k else 0)
        if grown > size:
            if end > begin:
                out.append((begin, content[begin:end]))
            if len(segment) > size:
                out += [(at + s, t) for s, t in split_recursively(segment, size, overlap, separators[1:])]
                begin = end = stop
            else:
                begin, end = at, stop
        elif end > begin or not k:
            end = stop
        else:  # what is kept after an oversized segment starts with its separator
            begin, end = at - len(sep), stop
        at = stop + len(sep)
    if end > begin:
        out.append((begin, content[begin:end]))
    return out


def recursive(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The recursive splitter: its greedy state needs a function over each text, run on Arrow batches."""
    checked(size, overlap)

    @F.pandas_udf("array<struct<start_pos: int, content: string>>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start_pos": s, "content": c} for s, c in split_recursively(t or "", size, overlap)] for t in texts])

    at = docs.withColumn("parts", parts.asNondeterministic()("content")).select("*", F.posexplode("parts").alias("ordinal", "p"))
    out = at.withColumn("content", F.col("p.content")).withColumn("start_pos", F.col("p.start_pos"))
    return out.withColumn("end_pos", F.col("start_pos") + F.length("content")).withColumn("section", F.lit(None).cast("string")).drop("p", "parts")


def markdown_sections(docs: DataFrame) -> DataFrame:
    """One chunk for each heading with what follows it, the part before the first heading included.

    Sections over ``SECTION_MOST`` characters are split recursively and lose their title.
    """
    return by_strategy(docs.withColumn("strategy", F.lit("markdown-section"))).drop("strategy")


def markdown_parts(content: str) -> list[tuple[int, str, str | None]]:
    """The sections of one text: start, text and title of each chunk."""
    cuts = sorted({0, *(m.start() for m in HEADING.finditer(content)), len(content)})
    out: list[tuple[int, str, str | None]] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = content[a:b]
        if not part.strip():
            continue
        if len(part) > SECTION_MOST:
            out += [(a + s, t, None) for s, t in split_recursively(part, SECTION_SIZE, OVERLAP)]
        else:
            title = TITLE.match(part)
            out.append((a, part, title[1] if title else None))
    return out


HEADING, TITLE = re.compile(r"^#{1,6}\s+.+$", re.M), re.compile(r"#{1,6}\s+(.+)")
untitled = lambda split: lambda t: [(s, c, None) for s, c in split(t)]
#: Splitters with state; sliding windows are cut by expressions.
STRATEGIES = {"recursive": untitled(split_recursively), "markdown-section": markdown_parts, "semantic-boundary": untitled(splitters.semantic_parts), "ast-based": untitled(splitters.code_parts)}


def analyze(docs: DataFrame, multiline: bool = False) -> DataFrame:
    """``docs`` with doc_type, language, structure, density and the recommended strategy."""
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    out = docs.withColumn("doc_type", X.doc_type(ext, F.col("content"))).withColumn("language", X.programming_language(F.col("content")))
    out = out.withColumn("structure", X.structure(F.col("content"), F.col("doc_type"), multiline)).withColumn("density", X.density(F.col("content")))
    return out.withColumn("strategy", X.strategy(F.col("doc_type"), F.col("structure"), F.col("density")))


PARTS = "array<struct<start_pos: int, content: string, section: string>>"


def by_strategy(docs: DataFrame) -> DataFrame:
    """Cut each document by its ``strategy``, all in one pass; a name that is not known is recursive.

    The function is declared nondeterministic so that Spark does not run it once more to
    leave out documents without chunks before they are exploded.
    """

    @F.pandas_udf(PARTS)
    def parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, names in batches:
            cut_up = [[] if t is None else STRATEGIES.get(n, STRATEGIES["recursive"])(t) for t, n in zip(texts, names, strict=True)]
            yield pd.Series([[{"start_pos": s, "content": c, "section": h} for s, c, h in rows] for rows in cut_up])

    sliding = F.col("strategy") == "sliding-window"
    starts = F.when(sliding & (F.length("content") > 0), F.sequence(F.lit(0), F.length("content") - 1, F.lit(SIZE - WINDOW_OVERLAP)))
    windows = F.transform(starts, lambda at, i: F.struct(at.alias("start_pos"), F.substring(F.col("content"), at + 1, F.lit(SIZE)).alias("content"), F.concat(F.lit("window-"), i.cast("string")).alias("section")))
    # Texts that expressions cut are not sent to Python.
    out = docs.withColumn("cut", parts.asNondeterministic()(F.when(~sliding, F.col("content")), F.col("strategy")))
    out = out.withColumn("cut", F.when(sliding, windows.cast(PARTS)).otherwise(F.col("cut")))
    out = out.select("*", F.posexplode("cut").alias("ordinal", "p")).withColumns({"content": F.col("p.content"), "start_pos": F.col("p.start_pos"), "section": F.col("p.section")})
    return out.withColumn("end_pos", F.col("start_pos") + F.length("content")).drop("cut", "p")


def neighbours():
    """Neighbours within a document; every later step uses this one order, so they share one shuffle."""
    return Window.partitionBy("doc_id").orderBy("ordinal")


def enhance(chunks: DataFrame, title: Column, context: int = 100, keywords: Column | None = None) -> DataFrame:
    """``enhanced``: the first five keywords, the end of the chunk before, the chunk under its title, the beginning of the one after."""
    before, after = F.lag("content").over(neighbours()), F.lead("content").over(neighbours())
    head = F.concat(F.lit("【"), title, F.lit("】\n"))
    prev = F.when(before.isNotNull(), F.concat(F.lit("[前文] ..."), F.right(before, F.lit(context))))
    post = F.when(after.isNotNull(), F.concat(F.lit("[后文] "), F.left(after, F.lit(context)), F.lit("...")))
    some = F.lit(False) if keywords is None else F.coalesce(F.size(keywords) > 0, F.lit(False))
    listed = F.lit(None).cast("string") if keywords is None else F.when(some, F.concat(F.lit("[关键词: "), F.array_join(F.slice(keywords, 1, 5), ", "), F.lit("]")))
    types = F.array_compact(F.array(F.lit("title-prefix"), F.when(before.isNotNull() | after.isNotNull(), F.lit("context-window")), F.when(some, F.lit("keyword-injection"))))
    return chunks.withColumn("enhanced", F.concat_ws("\n", listed, prev, F.concat(head, F.col("content")), post)).withColumn("enhancement_types", types)


def last_sentence(content: Column) -> Column:
    """What follows the last sentence end; else the last paragraph if it lies in the second half; else the last tenth, 50 characters at most."""
    n = F.length(content)
    # The very end: ``$`` would also stand before a last line break. Places are not taken from the match, which counts UTF-16 units.
    end = r"[.!?。！？](\s*[^\s]*)\z"
    # The place of the last blank line: what is left of the text after the longest prefix that ends in one.
    tail = F.length(F.substring_index(content, "\n\n", -1))
    para = F.when(content.contains("\n\n") & (n - tail - 2 > n * 0.5), n - tail)
    start = F.coalesce(para, F.floor(n - F.least(F.lit(50.0), n * 0.1)))
    return F.when(content.rlike(end), F.regexp_extract(content, end, 1)).otherwise(F.substring(content, (start + 1).cast("int"), n))


def overlap_text(content: Column) -> Column:
    """Adaptive overlap: a fifth, tenth or twentieth of the chunk by density, or the last sentence where it is not much longer."""
    level = X.word_density(content)
    size = F.floor(F.length(content) * X.chosen(((level == "high", F.lit(0.2)), (level == "low", F.lit(0.05))), F.lit(0.1))).cast("int")
    semantic = last_sentence(content)
    return F.when(F.length(semantic) <= size * 1.5, semantic).otherwise(F.right(content, size))


def overlap(chunks: DataFrame, size: int | None = None, compat: bool = False) -> DataFrame:
    """Put the end of the previous chunk before each chunk: ``size`` characters, or adaptively.

    ``compat`` takes the chunk's own end instead, as the original implementation does.
    """
    source = F.col("content") if compat else F.lag("content").over(neighbours())
    out = chunks.withColumn("carried", F.when(F.col("ordinal") > 0, source))
    added = F.right("carried", F.lit(size)) if size is not None else overlap_text(F.col("carried"))
    out = out.withColumn("overlap", F.coalesce(added, F.lit(""))).drop("carried")
    if compat:
        start = F.when(F.col("ordinal") > 0, F.col("end_pos") - F.length("overlap")).otherwise(F.col("start_pos"))
    else:
        start = F.greatest(F.col("start_pos") - F.length("overlap"), F.lit(0))
    return out.withColumn("start_pos", start).withColumn("content", F.concat("overlap", "content"))


def validate(chunks: DataFrame, least: int = LEAST, most: int = MOST, quality: float = QUALITY, code: Column | None = None) -> DataFrame:
    """``invalid_reason`` (null: valid) and ``suggestion``. A repeat of the first 100 characters of an earlier valid chunk of the document is a duplicate."""
    c, n = F.col("content"), F.length("content")
    unbalanced = None
    for a, b in ("{}", "()", "[]"):
        differ = F.length(F.replace(c, F.lit(a), F.lit(""))) != F.length(F.replace(c, F.lit(b), F.lit("")))
        unbalanced = differ if unbalanced is None else unbalanced | differ
    solid = F.length(F.regexp_replace(c, r"[\s\p{P}]", ""))
    enough = (F.regexp_count(c, F.lit(r"[a-zA-Z]{3,}")) >= 3) | (F.regexp_count(c, F.lit(r"[一-龥]")) >= 10)
    poor = (solid < n * quality) | ((n < 20) & ~enough)
    first = X.chosen(((n < least, F.lit("too-small")), (n > most, F.lit("too-large")), ((code if code is not None else F.lit(False)) & unbalanced, F.lit("incomplete")), (poor, F.lit("low-quality"))), F.lit(None).cast("string"))
    prefix = F.left(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(100))
    out = chunks.withColumn("first_reason", first).withColumn("prefix", prefix)
    nth = F.row_number().over(Window.partitionBy("doc_id", F.col("first_reason").isNull(), "prefix").orderBy("ordinal"))
    reason = F.coalesce("first_reason", F.when(nth > 1, F.lit("duplicate")))
    out = out.withColumn("invalid_reason", reason).drop("first_reason", "prefix")
    return out.withColumn("suggestion", F.try_element_at(F.create_map(*(F.lit(x) for kv in SUGGESTIONS.items() for x in kv)), F.col("invalid_reason")))


def repair(validated: DataFrame) -> DataFrame:
    """Valid chunks first, then the invalid: small ones join the last one kept, duplicates and poor ones go, others stay."""
    v = validated.filter(F.col("invalid_reason").isNull() | ~F.col("invalid_reason").isin("duplicate", "low-quality"))
    order = Window.partitionBy("doc_id").orderBy(F.col("invalid_reason").isNotNull(), "ordinal")
    small = F.coalesce(F.col("invalid_reason") == "too-small", F.lit(False))
    # A small chunk with nothing before it is kept, and takes in those that follow.
    opens = (~small) | (F.row_number().over(order) == 1)
    v = v.withColumn("seq", F.row_number().over(order)).withColumn("grp", F.sum(opens.cast("int")).over(order))
    return v.groupBy("doc_id", "grp").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n").alias("content"),
        F.min_by("start_pos", "seq").alias("start_pos"),
        F.max_by("end_pos", "seq").alias("end_pos"),
    ).withColumn("ordinal", F.col("grp") - 1).drop("grp")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Count, mean (rounded), least, most and upper median size for each document."""
    sizes = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.length("content"))).alias("s"))
    mean = F.round(F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("s")).cast("long")
    return sizes.select("doc_id", F.size("s").alias("n_chunks"), mean.alias("avg_size"), F.array_min("s").alias("min_size"), F.array_max("s").alias("max_size"), F.get("s", (F.size("s") / 2).cast("int")).alias("median_size"))


def index_chunks(docs: DataFrame) -> DataFrame:
    """The whole pipeline: analyse, cut, enhance, overlap, validate, repair."""
    cut_up = by_strategy(analyze(docs)).withColumn("filename", F.regexp_extract("path", r"([^/]+)$", 1))
    enhanced = enhance(cut_up, F.col("filename"))
    return repair(validate(overlap(enhanced)))
