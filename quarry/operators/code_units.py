"""Units of code with their parents: a scan that blanks strings and comments, then brackets or indentation on a stack."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strings and comments of either family of languages; how units begin; words before a bracket that are no names of methods.
BRACED_QUIET = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)", re.S)
INDENTED_QUIET = re.compile(r"(?:\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z))|(?:'''(?:\\.|.)*?(?:'''|\Z))|#[^\n]*|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)", re.S)
TYPE = re.compile(r"\b(class|interface|enum|struct|trait|namespace)\s+([A-Za-z_$][\w$]*)")
FUNCTION = re.compile(r"\b(?:function\s*\*?|func(?:\s*\([^()]*\))?)\s+([A-Za-z_$][\w$]*)")
ARROW = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*=>\s*(?=\{)")
METHOD = re.compile(r"([A-Za-z_$][\w$]*)\s*\([^(){};]*\)\s*(?::\s*[\w$<>\[\]|., ]+?\s*)?(?=\{)")
NO_METHODS = frozenset("if for while switch catch return function func with else do try new typeof await throw in of".split())
INDENTED = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)", re.M)
INDENTED_EXTENSIONS = ("py",)

Unit = tuple[int, int, str, str]


def blanked(code: str, quiet: re.Pattern) -> str:
    """``code`` with strings and comments as spaces, line breaks kept, so that places stay as they are."""
    return quiet.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def closing(code: str) -> dict[int, int]:
    """Where each opening curly bracket is closed; one that is not ends with the text."""
    stack, out = [], {}
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out | {at: len(code) for at in stack}


def braced_units(code: str) -> list[Unit]:
    """(start, end, kind, name) of the units of a language with brackets, by start; a unit begins with its line."""
    plain = blanked(code, BRACED_QUIET)
    ends, found = closing(plain), {}
    for pattern, kind in ((TYPE, None), (FUNCTION, "function"), (ARROW, "function"), (METHOD, "method")):
        for m in pattern.finditer(plain):
            name = m[m.lastindex]
            opens = plain.find("{", m.end())
            # A declaration without a body ends before any bracket opens.
            if opens < 0 or ";" in plain[m.end() : opens] or "}" in plain[m.end() : opens] or (kind == "method" and name in NO_METHODS):
                continue
            line = plain.rfind("\n", 0, m.start()) + 1
            begin = line if not re.search(r"[{};]", plain[line : m.start()]) else m.start()
            found.setdefault(opens, (begin, ends[opens], kind or m[1], name))
    return sorted(found.values(), key=lambda u: (u[0], -u[1]))


def indented_units(code: str) -> list[Unit]:
    """(start, end, kind, name) of the units of a language with indentation: a unit ends before the first line that is indented no deeper."""
    plain = blanked(code, INDENTED_QUIET)
    heads = {m.start(): m for m in INDENTED.finditer(plain)}
    open_units: list[tuple[int, int, str, str]] = []
    out: list[Unit] = []
    depth, at, last, decorated = 0, 0, 0, None
    for line in plain.splitlines(keepends=True):
        text = line.strip()
        if text and depth == 0:
            indent = len(line) - len(line.lstrip(" \t"))
            while open_units and open_units[-1][1] >= indent:
                start, _, kind, name = open_units.pop()
                out.append((start, last, kind, name))
            if head := heads.get(at):
                open_units.append((at if decorated is None else decorated, indent, head[2] if head[2] == "class" else "method" if open_units and open_units[-1][2] == "class" else "function", head[3]))
            decorated = (at if decorated is None else decorated) if text.startswith("@") else None
        depth = max(0, depth + len(re.findall(r"[(\[{]", line)) - len(re.findall(r"[)\]}]", line)))
        at += len(line)
        # What a unit ends with is its last line that is not blank; a string or comment counts as a line.
        if code[at - len(line) : at].strip():
            last = at
    out += [(start, last, kind, name) for start, _, kind, name in open_units]
    return sorted(out, key=lambda u: (u[0], -u[1]))


def nested(units: list[Unit], size: int) -> list[tuple[int, int, str, str, int]]:
    """Units with the number of the one around them, or -1, and what lies between the outer ones as rows of kind ``text``."""
    rows: list[tuple[int, int, str, str, int]] = []
    stack: list[int] = []
    covered = 0
    for start, end, kind, name in units:
        while stack and rows[stack[-1]][1] <= start:
            stack.pop()
        if not stack:
            if start > covered:
                rows.append((covered, start, "text", "", -1))
            covered = end
        rows.append((start, end, kind, name, stack[-1] if stack else -1))
        stack.append(len(rows) - 1)
    return [*rows, (covered, size, "text", "", -1)] if covered < size else rows


def code_units(docs: DataFrame, extension: str = "extension") -> DataFrame:
    """Units of ``docs`` (content, and the column ``extension``): ordinal, kind, name, parent (an ordinal, or -1), start_pos, end_pos, content.

    Outer units and the text between them cover each document; inner units come again as
    rows of their own. Documents are scanned where they lie; only places leave the scan.
    """

    @F.pandas_udf("array<struct<start_pos: int, end_pos: int, kind: string, name: string, parent: int>>")
    def units(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = ("start_pos", "end_pos", "kind", "name", "parent")
        for texts, extensions in batches:
            scan = lambda t, e: nested((indented_units if e in INDENTED_EXTENSIONS else braced_units)(t), len(t))
            yield pd.Series([[dict(zip(names, u, strict=True)) for u in scan(t or "", e)] for t, e in zip(texts, extensions, strict=True)])

    each = docs.withColumn("units", units.asNondeterministic()("content", F.col(extension))).select("*", F.posexplode("units").alias("ordinal", "u")).drop("units")
    out = each.select("*", "u.*").drop("u")
    return out.withColumn("content", F.substring("content", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")))
