"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACE_RUN, remainder, table
from quarry.llm.exact_dedup import exact_dedup
from quarry.llm.exact_search import exact_topk
from quarry.llm.fill_in_middle import fill_in_middle, restore
from quarry.llm.html_extraction import extract
from quarry.llm.language_id import held_out_fold as language_fold
from quarry.llm.language_id import language_id
from quarry.llm.lm_scoring import held_out_fold, lm_score
from quarry.llm.mixing import mix
from quarry.llm.periodic_runs import periodic_runs
from quarry.llm.quality_rules import STOP_WORDS, quality_rules
from quarry.llm.sentencepiece_sampling import encode
from quarry.llm.simhash import simhash
from quarry.llm.toxicity import toxicity
from quarry.llm.url_filter import url_filter


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), held_out_fold(F.col("doc_id")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "lossless")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"), language_fold(F.col("doc_id")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = F.array_join("failed_rules", ",").alias("failed_rules")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", rules)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) == 0)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of one document in ten repeat from some place on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.filter(F.split("text", SPACE_RUN), lambda x: x != "")
    own = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    own = own.select("*", F.when(n > 0, g % n).alias("a"), (g % 8).alias("r"))
    own = own.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("r"))))
    a, p = F.col("a"), F.col("p")
    again = F.transform("w", lambda x, i: F.when(i < a, x).otherwise(F.get("w", (a + (i - a) % p).cast("int"))))
    return own.select("doc_id", F.when(a.isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("longest", longest)
    length, period = -F.col("longest.minus"), F.col("longest.period")
    line = lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digests = (F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_url_filter,
        op3_lm_scoring,
        op4_html_extraction,
        op5_sentencepiece,
        op6_language_id,
        op7_mixing,
        op8_simhash,
        op9_quality_rules,
        op10_toxicity,
        op11_periodic_runs,
        op12_fill_in_middle,
        op13_exact_search,
    )
}

OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), k AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""

OP9_SQL = (
    r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), E'\n'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)
), r AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), cov AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM r GROUP BY ALL
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN (STOP))) AS stops
  FROM t LEFT JOIN cov USING (doc_id)
), f AS (
  SELECT *, concat_ws(',', CASE WHEN n_words < 10 THEN 'too_short' END, CASE WHEN 100 * n_repeat_words / n_words > 20 THEN 'repeated_words' END,
    CASE WHEN word_chars / n_words < 1.5 OR word_chars / n_words > 20 THEN 'word_length' END, CASE WHEN n_symbols / n_words > 0.1 THEN 'symbols' END,
    CASE WHEN stops / n_words < 0.02 THEN 'stop_words' END, CASE WHEN n_dup_lines / n_lines > 0.3 THEN 'repeated_lines' END) AS failed_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failed_rules = '' AS kept, failed_rules FROM f
"""
).replace("STOP", ", ".join(f"'{w}'" for w in STOP_WORDS))

OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), c AS (
  SELECT *, len(w) AS n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(k[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) AS h FROM t
), g AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS r FROM c
), d AS (
  SELECT doc_id, row_number() OVER () AS row, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + r)) END]) END AS w FROM g
), win AS (
  SELECT row, i, w[i + 1:i + 5] AS win FROM (SELECT *, unnest(range(n - 4)) AS i FROM d)
), seen AS (
  SELECT * FROM win WHERE (row, win) IN (SELECT (row, win) FROM win GROUP BY ALL HAVING count(*) > 1)
), lag AS (
  SELECT x.row, x.i, x.i - y.i AS q FROM seen x JOIN seen y ON x.row = y.row AND x.win = y.win AND y.i < x.i
), diagonal AS (
  SELECT row, q, min(i) - q AS b, max(i) + 5 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS part FROM lag) GROUP BY row, q, part
), long AS (
  SELECT *, e - b AS l FROM diagonal WHERE e - b >= greatest(6, 4 * q)
), run AS (
  SELECT row, b, l, q FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.row = x.row AND y.b = x.b AND y.e = x.e AND y.q < x.q AND x.q % y.q = 0)
), gone AS (
  SELECT DISTINCT row, unnest(range(b + q, b + l)) AS i FROM run
), dropped AS (
  SELECT row, list(i) AS i FROM gone GROUP BY ALL
), kept AS (
  SELECT d.row, CASE WHEN i IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(w[j + 1], ' ' ORDER BY j) FROM (SELECT unnest(range(n)) AS j) AS places WHERE NOT list_contains(i, j)), '') END AS text FROM d LEFT JOIN dropped USING (row)
), digest AS (
  SELECT row, count(*) AS n_runs, sha256(string_agg(b || ',' || l || ',' || q || chr(10), '' ORDER BY b, q)) AS runs, min((-l, b, q)) AS best FROM run GROUP BY ALL
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[2] AS start, -best[1] AS length, best[3] AS period, 1000 * -best[1] // best[3] AS exponent_milli,
  coalesce(runs, sha256('')) AS runs_sha256, sha256(text) AS collapsed_sha256
FROM d JOIN kept USING (row) LEFT JOIN digest USING (row)
"""

OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), h AS (
  SELECT *, ('0x' || d[1:8])::UBIGINT AS h1, ('0x' || d[9:16])::UBIGINT AS h2, ('0x' || d[17:24])::UBIGINT AS h3, ('0x' || d[25:32])::UBIGINT AS h4 FROM t
), f AS (
  SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b FROM h
), p AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op9_quality_rules": OP9_SQL, "op11_periodic_runs": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_exact_search": OP13_SQL}
