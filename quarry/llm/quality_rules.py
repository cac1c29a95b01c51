"""Quality rules: one table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import FUNCTION_WORDS, SPACE_RUN, fresh, require

# The symbols that the contract counts.
SYMBOLS = r"[#*$%&|<>]"
#: Running text has several of them.
STOP_WORDS = tuple(dict.fromkeys(w for words in FUNCTION_WORDS.values() for w in words))
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails where ``measure`` is below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The base rules of the contract, and the method's own.
BASE_RULES = (
    Rule("too_short", "n_words", least=10),
    Rule("repeated_words", "pct_repeat_words", most=20),
)
RULES = (
    Rule("word_length", "mean_word_chars", least=1.5, most=20),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("stop_words", "stop_word_share", least=0.02),
    Rule("repeated_lines", "dup_line_share", most=0.3),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def counted(docs: DataFrame, text: Column) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the counts as columns, and their names; built-in functions only, no shuffle."""
    name = {k: fresh(docs, k) for k in (*COUNTS, "words", "lines", "windows", "order", "starts")}
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE_RUN), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({name["words"]: words, name["lines"]: lines, name["n_symbols"]: F.regexp_count(text, F.lit(SYMBOLS)).cast("long")})
    w, n = F.col(name["words"]), F.size(name["words"])
    places = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    # A window stands as the hash of its words.
    out = out.withColumn(name["windows"], F.transform(places, lambda i: F.xxhash64(F.slice(w, i + 1, WINDOW))))
    # Only where a window occurs twice: sorted by hash, then place, equal windows are neighbours.
    win = F.col(name["windows"])
    order = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(name["order"], F.when(F.size(F.array_distinct(win)) < F.size(win), order))
    o = F.col(name["order"])
    again = F.filter(o, lambda x, j: F.coalesce(x["h"] == F.get(o, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(o, j + 1)["h"], F.lit(False)))
    out = out.withColumn(name["starts"], F.sort_array(F.transform(again, lambda x: x["i"])))
    # Each start covers the words up to the next one, at most a window.
    s = F.col(name["starts"])
    covered = F.aggregate(F.transform(s, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    out = out.withColumns(
        {
            name["n_words"]: n.cast("long"),
            name["word_chars"]: F.length(F.array_join(w, "")).cast("long"),
            name["n_dup_lines"]: (F.size(name["lines"]) - F.size(F.array_distinct(name["lines"]))).cast("long"),
            name["n_repeat_words"]: F.coalesce(covered, F.lit(0)).cast("long"),
            name["n_lines"]: F.size(name["lines"]).cast("long"),
            name["n_stop_words"]: F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
        }
    )
    return out.drop(*(name[k] for k in ("words", "lines", "windows", "order", "starts"))), name


def compiled(rules: Sequence[Rule], name: dict[str, str]) -> Column:
    """The names of the rules that a row fails, as one array expression over the counts."""
    n = F.col(name["n_words"])
    measure = {
        "n_words": n,
        "pct_repeat_words": F.try_divide(100 * F.col(name["n_repeat_words"]), n),
        "mean_word_chars": F.try_divide(name["word_chars"], n),
        "symbols_per_word": F.try_divide(name["n_symbols"], n),
        "stop_word_share": F.try_divide(name["n_stop_words"], n),
        "dup_line_share": F.try_divide(name["n_dup_lines"], name["n_lines"]),
    }
    fails = []
    for r in rules:
        low = F.lit(False) if r.least is None else measure[r.measure] < r.least
        high = F.lit(False) if r.most is None else measure[r.measure] > r.most
        fails.append(F.when(low | high, F.lit(r.name)))
    return F.array_compact(F.array(*fails))


def quality_rules(docs: DataFrame, text_col: str = "text", base: Sequence[Rule] = BASE_RULES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with counts, failed rules, base_failed and kept.

    Everything is one chain of projections over the row: no shuffle, no user function.
    Measures: words (runs without white space), code points in words, symbols, repeated
    lines, words inside repeated windows of five, stop words.

    Edge cases: null text has no words and fails ``too_short``; ratios over no words or
    no lines are null and fail nothing; columns of ``docs`` that have the name of a
    result are given up for it; rows are judged one by one, so ties, repeats and empty
    tables need no rule.
    """
    require(docs, (text_col,))
    results = {*COUNTS, "base_failed", "kept", "failed_rules"}
    text = fresh(docs, "rule_text")
    plain = docs.withColumn(text, F.col(text_col)).drop(*(c for c in docs.columns if c.lower() in results))
    out, name = counted(plain, F.col(text))
    bad = compiled(base, name)
    out = out.withColumns({"failed_rules": F.concat(bad, compiled(rules, name)), "base_failed": F.size(bad) > 0})
    return out.withColumn("kept", F.size("failed_rules") == 0).drop(text)
