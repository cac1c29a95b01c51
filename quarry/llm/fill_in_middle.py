"""Fill-in-middle transformation: texts cut in three and put together in another order, by one match of a pattern made for each row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh, require

# Marks of prefix, suffix and middle; shares of plain and of suffix-first texts in percent.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, SUFFIX_FIRST = 10, 20
#: Code points that one match counts at a time, so that a long text is not taken apart into single ones.
STRIDE = 1024
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def code_points(text: Column) -> Column:
    """Code points of a text: full strides, then those of the rest one by one."""
    stride = rf"(?s).{{{STRIDE}}}+"
    rest = F.regexp_replace(text, stride, "")
    return F.regexp_count(text, F.lit(stride)).cast("long") * STRIDE + F.regexp_count(rest, F.lit("(?s).")).cast("long")


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def replacement(text: str) -> str:
    """``text`` as it must be written in a replacement, where a backslash and a dollar sign mean something."""
    return re.sub(r"([\\$])", r"\\\1", text)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, seed: int = 1) -> DataFrame:
    """``docs`` with n, form (plain, psm or spm), prefix_chars, middle_chars and output.

    A text is cut after two of its code points, drawn by row key. The pattern of a row
    counts them out: possessive groups of a and of b - a units, then the rest, so that the
    one match never goes back, and its groups are put together around the marks. Built-in
    functions only; rows are cut where they lie, without a shuffle.

    Edge cases: null text counts as empty and stays plain, as a text that holds a mark
    does; a null id counts as the empty text; either cut may fall on an end of the text, so
    that parts are empty; rows that repeat an id and text get the same output; columns that
    have the name of a result are replaced; an empty table gives an empty result. Texts
    are taken to be valid UTF-8.
    """
    require(docs, (id_col, text_col))
    if not 0 <= plain <= 100 or not 0 <= suffix_first <= 100:
        raise ValueError("shares are percentages")
    name = {k: fresh(docs, f"fim_{k}") for k in ("text", "h1", "h2", "h3", "h4", "n", "form", "a", "b")}
    c = {k: F.col(v) for k, v in name.items()}
    h = draws(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumns({name["text"]: text, **{name[f"h{k}"]: x for k, x in enumerate(h, start=1)}})
    out = out.drop(*(x for x in docs.columns if x.lower() in RESULTS)).withColumn(name["n"], code_points(c["text"]))
    held = F.lit(False)
    for mark in marks:
        held = held | c["text"].contains(mark)
    kept = (c["n"] == 0) | held | (c["h3"] % 100 >= 100 - plain)
    form = F.when(kept, "plain").when(c["h4"] % 100 < suffix_first, "spm").otherwise("psm")
    one, two = c["h1"] % (c["n"] + 1), c["h2"] % (c["n"] + 1)
    out = out.withColumns({name["form"]: form, name["a"]: F.least(one, two), name["b"]: F.greatest(one, two)})
    middle = c["b"] - c["a"]
    pattern = F.concat(F.lit(r"(?s)\A(.{"), c["a"].cast("string"), F.lit("}+)(.{"), middle.cast("string"), F.lit(r"}+)(.*+)\z"))
    p, s, m = (replacement(x) for x in marks)
    order = F.when(c["form"] == "spm", F.lit(f"{s}$3{p}$1{m}$2")).otherwise(F.lit(f"{p}$1{s}$3{m}$2"))
    cut = c["form"] != "plain"
    results = {
        "n": c["n"],
        "form": c["form"],
        "prefix_chars": F.when(cut, c["a"]),
        "middle_chars": F.when(cut, middle),
        "output": F.when(cut, F.regexp_replace(c["text"], pattern, order)).otherwise(c["text"]),
    }
    return out.select(*(f"`{x}`" for x in docs.columns if x.lower() not in RESULTS), *(x.alias(k) for k, x in results.items()))


def restore(docs: DataFrame, output_col: str = "output", form_col: str = "form", out_col: str = "restored", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``docs`` with ``out_col``, the text that an output of ``fill_in_middle`` was made of; null stays null.

    As a text with a mark in it is never cut, the first mark of each kind is the one put in.
    """
    require(docs, (output_col, form_col))
    p, s, m = (re.escape(x) for x in marks)
    x, form = F.col(output_col), F.col(form_col)
    psm = F.regexp_replace(x, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(x, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z", "$2$3$1")
    return docs.withColumn(out_col, F.when(form == "psm", psm).when(form == "spm", spm).otherwise(x))
