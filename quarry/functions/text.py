"""Column expressions over text: document analysis. All are built-in functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and the document types they stand for; patterns of languages, in order.
EXTENSIONS = {
    "md": "markdown",
    "markdown": "markdown",
    "ts": "code",
    "tsx": "code",
    "js": "code",
    "jsx": "code",
    "py": "code",
    "go": "code",
    "java": "code",
    "json": "json",
    "html": "html",
    "htm": "html",
    "pdf": "pdf",
}
LANGUAGE_PATTERNS = (
    (r"function\s+\w+\s*\(", "javascript"),
    (r"const\s+\w+\s*=", "javascript"),
    (r"def\s+\w+\s*\(", "python"),
    (r"package\s+\w+", "go"),
    (r"class\s+\w+\s*:", "typescript"),
    (r"interface\s+\w+", "typescript"),
)
#: White space as the analysis understands it.
SPACE = r"\s"


def chosen(cases, default: Column) -> Column:
    """The value of the first case (condition, value) that holds."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return default if out is None else out.otherwise(default)


def nonblank(parts: Column) -> Column:
    return F.filter(parts, lambda x: x.rlike(r"\S"))


def paragraphs(content: Column) -> Column:
    return nonblank(F.split(content, r"\n\n+"))


def sentences(content: Column) -> Column:
    return nonblank(F.split(F.regexp_replace(content, r"([.!?])\s+", "$1\n"), "\n"))


def words(content: Column) -> Column:
    return F.filter(F.split(content, r"\s+"), lambda x: x != "")


def total_length(parts: Column) -> Column:
    return F.length(F.array_join(parts, ""))


def mean_length(parts: Column) -> Column:
    return F.coalesce(F.try_divide(total_length(parts).cast("double"), F.size(parts)), F.lit(0.0))


def doc_type(extension: Column, content: Column) -> Column:
    """By extension, else by content: code, markdown, json, html, text."""
    by_name = F.try_element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), F.lower(extension))
    begin = F.regexp_replace(content, r"^\s+", "")
    by_content = chosen(
        (
            (content.contains("```") | content.rlike(r"^function\s|class\s|import\s"), F.lit("code")),
            (content.rlike(r"^#{1,6}\s"), F.lit("markdown")),
            (begin.startswith("{") | begin.startswith("["), F.lit("json")),
            (content.rlike(r"(?i)<html|<!DOCTYPE"), F.lit("html")),
        ),
        F.lit("text"),
    )
    return F.coalesce(by_name, by_content)


def programming_language(content: Column) -> Column:
    return chosen(((content.rlike(p), F.lit(name)) for p, name in LANGUAGE_PATTERNS), F.lit("unknown"))


def structure(content: Column, kind: Column, multiline: bool = False) -> Column:
    """Seven features by document type. Without ``multiline`` the patterns only see the start of the document."""
    m = "(?m)" if multiline else ""
    is_md, is_code = kind == "markdown", kind == "code"
    sections = F.regexp_count(content, F.lit(rf"{m}^#{{2,3}}\s"))
    units = F.regexp_count(content, F.lit(r"function\s+\w+|class\s+\w+"))
    return F.struct(
        (is_md & content.rlike(rf"{m}^#\s")).alias("has_title"),
        chosen(((is_md, sections > 0), (is_code, content.rlike(r"function\s|class\s"))), F.lit(False)).alias("has_sections"),
        chosen(((is_md, sections), (is_code, units)), F.lit(0)).cast("int").alias("section_count"),
        (~is_code & content.rlike(rf"{m}^\s*[-*]\s")).alias("has_list"),
        (is_md & content.rlike(r"\|.*\|")).alias("has_table"),
        (is_code | (is_md & content.contains("```"))).alias("has_code_block"),
        chosen(((is_md, F.size(F.split(content, r"\n\n+"))), (is_code, F.lit(0))), F.size(paragraphs(content))).cast("int").alias("paragraph_count"),
    )


def density(content: Column) -> Column:
    """Mean sentence and paragraph length, share of technical terms, level."""
    sentence, term_words = mean_length(sentences(content)), words(content)
    terms = F.size(F.filter(term_words, lambda w: w.rlike(r"^[A-Z][a-z]+$") | (F.length(w) > 8)))
    ratio = F.coalesce(F.try_divide(terms.cast("double"), F.size(term_words)), F.lit(0.0))
    level = chosen((((sentence > 100) & (ratio > 0.2), F.lit("high")), (sentence < 50, F.lit("low"))), F.lit("medium"))
    return F.struct(level.alias("level"), sentence.alias("avg_sentence_length"), mean_length(paragraphs(content)).alias("avg_paragraph_length"), ratio.alias("technical_term_ratio"))


def strategy(kind: Column, features: Column, dense: Column) -> Column:
    return chosen(
        (
            (kind == "code", F.lit("ast-based")),
            ((kind == "markdown") & features["has_sections"], F.lit("markdown-section")),
            (dense["level"] == "high", F.lit("semantic-boundary")),
            (features["paragraph_count"] > 10, F.lit("recursive")),
        ),
        F.lit("sliding-window"),
    )


def word_density(content: Column) -> Column:
    """Level by the mean length of words: over 7 high, under 4 low."""
    mean = mean_length(words(content))
    return chosen(((mean > 7, F.lit("high")), (mean < 4, F.lit("low"))), F.lit("medium"))
