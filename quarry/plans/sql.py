"""SQL for DuckDB that gives the rows of the registered queries."""

from __future__ import annotations

from quarry.operators.chunking import CODE_EXTENSIONS

CODE = ", ".join(f"'{x}'" for x in CODE_EXTENSIONS)
DOCS = """docs AS (
  SELECT doc_id, '/corpus/' || source || '/' || doc_id || '.' || (['md', 'ts', 'js', 'py', 'json', 'txt'])[(doc_id % 6 + 1)::INT] AS path,
         coalesce(text, '') AS content, source, lang, n_chars
  FROM documents
)"""


def fixed(name: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""{name} AS (
  SELECT doc_id, path, ordinal, ordinal * {step} AS start_pos, substr(content, ordinal * {step} + 1, {size}) AS content,
         ordinal * {step} + length(substr(content, ordinal * {step} + 1, {size})) AS end_pos
  FROM (SELECT *, unnest(range(CASE WHEN length(content) = 0 THEN 0 ELSE 1 + greatest(0, ceil((length(content) - {size}) / {step}.0))::INT END))::INT AS ordinal FROM docs)
)"""


SLIDING = """sliding AS (
  SELECT doc_id, ordinal, ordinal * 400 AS start_pos, substr(content, ordinal * 400 + 1, 500) AS content,
         ordinal * 400 + length(substr(content, ordinal * 400 + 1, 500)) AS end_pos, 'window-' || ordinal AS section
  FROM (SELECT *, unnest(range(CASE WHEN length(content) = 0 THEN 0 ELSE 1 + (length(content) - 1) // 400 END))::INT AS ordinal FROM docs)
)"""

VALIDATED = SLIDING + r""", checked AS (
  SELECT *, CASE WHEN length(content) < 50 THEN 'too-small' WHEN length(content) > 5000 THEN 'too-large'
    WHEN length(regexp_replace(content, '[\s\pP]', '', 'g')) < length(content) * 0.3 THEN 'low-quality' END AS first_reason,
    left(regexp_replace(regexp_replace(content, '^\s+', ''), '\s+$', ''), 100) AS prefix
  FROM sliding
), validated AS (
  SELECT * EXCLUDE (first_reason, prefix), coalesce(first_reason, CASE WHEN row_number() OVER (PARTITION BY doc_id, first_reason IS NULL, prefix ORDER BY ordinal) > 1 THEN 'duplicate' END) AS invalid_reason
  FROM checked
)"""

VECTOR = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 50 = 0),
sims AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(q.e, v.embedding::DOUBLE[]), 9) AS score, v.label FROM q, embeddings v WHERE query_id <> vec_id),
vhits AS (SELECT query_id, chunk_id, score, 'vector' AS path, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims) WHERE rank <= 10)"""

TEXT_QUERIES = "tq AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
TEXT_HITS = DOCS + ", " + TEXT_QUERIES + """,
thits AS (SELECT query_id, chunk_id, score, 'fulltext' AS path, rank FROM (
  SELECT query_id * 50 AS query_id, doc_id AS chunk_id, 0.5::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank
  FROM docs, tq WHERE contains(lower(content), lower(query))) WHERE rank <= 10)"""
BOTH = VECTOR + ", " + TEXT_HITS + ", hits AS (SELECT *, 0 AS p FROM vhits UNION ALL SELECT *, 1 AS p FROM thits)"


def fused(score: str, limit: str = "") -> str:
    return f"""WITH {BOTH}, f AS (
  SELECT query_id, chunk_id, round({score}, 9) AS s, min((p, rank)) AS seen, string_agg(DISTINCT path, ',' ORDER BY path) AS sources FROM hits GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, seen, chunk_id) AS rank FROM f)
SELECT query_id, chunk_id, round(s, 6) AS score, rank{{extra}} FROM r {limit}"""


WEIGHT = "CASE path WHEN 'vector' THEN {v} ELSE {t} END"

BM25 = DOCS + ", " + TEXT_QUERIES + r""",
terms AS (SELECT doc_id AS chunk_id, list_filter(string_split_regex(lower(content), '\s+'), lambda x: x <> '') AS t FROM docs),
size AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM terms),
qt AS (SELECT DISTINCT query_id, unnest(list_filter(string_split_regex(lower(query), '\s+'), lambda x: x <> '')) AS token FROM tq),
post AS (SELECT token, chunk_id, len, count(*) AS tf FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS token FROM terms) WHERE token IN (SELECT token FROM qt) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY ALL),
scored AS (
  SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
  FROM post JOIN df USING (token) JOIN qt USING (token), size GROUP BY ALL
), bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"""



def reranked(hits: str, factor: int = 1) -> str:
    """Rule scores of ``hits`` (query_id, chunk_id, score, rank, path_found), for the keywords of the text queries."""
    return rf"""kw AS (SELECT query_id * {factor} AS query_id, list_filter(string_split_regex(lower(query), '\s+'), lambda x: x <> '')[1:5] AS keywords FROM tq),
feats AS (
  SELECT h.query_id, h.chunk_id, h.score, h.rank, h.path_found, content, docs.path AS source,
    len(list_filter(keywords, lambda w: contains(lower(content), w)))::DOUBLE / greatest(len(keywords), 1) AS exact,
    least(1.0::DOUBLE, list_sum(list_transform(keywords, lambda w: (length(content) - length(replace(lower(content), w, '')))::DOUBLE / length(w))) / greatest(length(content) / 100.0::DOUBLE, 1.0::DOUBLE)) AS density,
    (CASE WHEN regexp_matches(docs.path, '\.(md|ts)$') THEN 0.9 WHEN regexp_matches(docs.path, '\.(js|py)$') THEN 0.85 WHEN docs.path LIKE '%.json' THEN 0.7 ELSE 0.8 END)::DOUBLE AS source_quality
  FROM ({hits}) h JOIN docs ON doc_id = chunk_id JOIN kw ON kw.query_id = h.query_id
), rr AS (SELECT *, round(0.3::DOUBLE * score + 0.7::DOUBLE * (2.0 * exact + 0.5::DOUBLE * density + 0.1::DOUBLE + 0.3::DOUBLE * source_quality), 9) AS rerank_score FROM feats),
ranked AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, chunk_id) AS rank FROM rr)"""


RERANKED = BM25 + ", " + reranked("SELECT *, 'bm25' AS path_found FROM bm WHERE rank <= 20")

FORMS = """forms AS (
  SELECT conv_id * 1000 + turn AS query_id, (conv_id + turn) % 10 AS n,
    coalesce(list_filter(string_split(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'), ' '), lambda x: length(x) > 2)[1], 'alpha') AS a,
    coalesce(list_filter(string_split(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'), ' '), lambda x: length(x) > 2)[2], 'beta') AS b
  FROM conversations WHERE role = 'user'
), asked AS (
  SELECT query_id, a, b, n, replace(replace((['什么是{a}?', '如何实现{a}系统?首先{a},然后{b}', '比较{a}和{b}的区别', '{a} 为什么报错 {b}', '优化{a}的方法', '关于{a}的所有相关信息', '验证{a}是否正确', '打开{a}然后查找{b}', '{a} {b} function', '{a} 排除 {b}'])[(n + 1)::INT], '{a}', a), '{b}', b) AS query
  FROM forms
)"""
PARSED = FORMS + r""", p AS (
  SELECT *, CASE
      WHEN regexp_matches(query, '什么是|定义|解释|概念') THEN 'definition' WHEN regexp_matches(query, '如何实现|怎么做|步骤|方法') THEN 'how-to'
      WHEN regexp_matches(query, '示例|例子|代码示例|demo') THEN 'example' WHEN regexp_matches(query, '比较|区别|对比|vs') THEN 'comparison'
      WHEN regexp_matches(query, '为什么报错|出错|错误|bug|调试') THEN 'debug' WHEN regexp_matches(query, '优化|提升|改进|更快') THEN 'optimization'
      WHEN regexp_matches(query, '所有|全部|关于|相关信息') THEN 'exploration' WHEN regexp_matches(query, '是否正确|验证|检查|确认') THEN 'fact-check'
      WHEN regexp_matches(query, '然后|接着|之后|首先.*其次') THEN 'multi-hop' ELSE 'general' END AS intent,
    (len(regexp_extract_all(query, '[a-zA-Z]{3,}')) + len(regexp_extract_all(query, '[一-龥]{2,}')) > 2)::INT AS s1,
    (len(regexp_extract_all(query, '如果|当|条件|要求|并且|或者')) > 1)::INT AS s2,
    regexp_matches(query, '然后|接着|因此|所以')::INT AS s3, (length(query) > 50)::INT AS s4,
    list_filter(string_split_regex(trim(regexp_replace(
      replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(query, '的', ' '), '是', ' '), '在', ' '), '有', ' '), '和', ' '), '了', ' '), '如何', ' '), '怎么', ' '), '什么', ' '), '请', ' '), '帮我', ' '),
      '([一-龥])', ' \1 ', 'g')), '\s+'), lambda x: length(x) > 1) AS words
  FROM asked
), parsed AS (SELECT *, (s1 + s2 + s3 + s4) * 2 AS score FROM p)"""

SQL: dict[str, str] = {}

SQL["hybrid_rrf"] = fused("sum(1.0::DOUBLE / (60 + rank))", "WHERE rank <= 10").replace("{extra}", ", sources")
SQL["fuse_weighted"] = fused("max(score * " + WEIGHT.format(v="0.8::DOUBLE", t="0.2::DOUBLE") + ")").replace("{extra}", "")
SQL["fuse_max"] = fused("max(score)").replace("{extra}", "")
SQL["fuse_weighted_rrf"] = fused("sum(" + WEIGHT.format(v="0.3::DOUBLE", t="0.2::DOUBLE") + " / (60 + rank))", "WHERE rank <= 30").replace("{extra}", "")
SQL["rrf_rerank"] = fused("sum(1.0::DOUBLE / (60 + rank))").replace("{extra}", ", round(least(1.0, 10 * s), 6) AS confidence, 'RRF排名 #' || rank AS reason")
SQL["vector_topk"] = f"WITH {VECTOR} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vhits"
SQL["code_topk"] = f"""WITH {VECTOR}, wide AS (SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM sims) WHERE r <= 20),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM wide WHERE chunk_id % 6 BETWEEN 1 AND 3)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM c WHERE rank <= 10"""
SQL["semantic_cache"] = f"""WITH {VECTOR}, best AS (SELECT query_id, chunk_id AS nearest, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM sims) WHERE r = 1)
SELECT q.query_id, nearest, score, coalesce(score > 0.95, false) AS hit FROM q LEFT JOIN best USING (query_id)"""
SQL["recall_merge"] = f"""WITH {BOTH}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY p, rank) AS nth FROM hits) WHERE nth = 1),
m AS (SELECT query_id, chunk_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p, rank) AS r FROM once)
SELECT query_id, chunk_id, path, round(score, 6) AS score, r AS rank FROM m WHERE r <= 20"""
SQL["hybrid_concat"] = f"""WITH {BOTH}, rest AS (SELECT h.* FROM hits h WHERE p = 0 OR NOT EXISTS (SELECT 1 FROM vhits v WHERE v.query_id = h.query_id AND v.chunk_id = h.chunk_id)),
c AS (SELECT query_id, chunk_id, path, row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS r FROM rest)
SELECT query_id, chunk_id, path, r AS rank FROM c WHERE r <= 10"""
SQL["eval_metrics"] = f"""WITH {VECTOR}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims),
rel AS (SELECT q.query_id, count(*) AS expected FROM q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.query_id GROUP BY ALL),
found AS (SELECT t.query_id, t.rank FROM top t JOIN q ON q.query_id = t.query_id AND q.label = t.label WHERE t.rank <= 20),
per AS (
  SELECT k, rel.query_id, expected, count(rank) FILTER (rank <= k) AS n, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg, coalesce(1.0 / min(rank), 0) AS rr,
    list_sum(list_transform(range(1, least(expected, k) + 1), lambda i: 1 / log2(i + 1))) AS idcg
  FROM rel CROSS JOIN (SELECT unnest([1, 5, 10, 20]) AS k) LEFT JOIN found USING (query_id) GROUP BY k, rel.query_id, expected
)
SELECT k, round(avg((n > 0)::INT), 6) AS hit_rate, round(avg(n / k), 6) AS precision, round(avg(n / expected), 6) AS recall, round(sum(dcg) / sum(idcg), 6) AS ndcg_micro, round(avg(dcg / idcg), 6) AS ndcg_macro, round(avg(rr), 6) AS mrr FROM per GROUP BY k"""

SQL["chunk_fixed"] = f"WITH {DOCS}, {fixed('f', 500, 50)} SELECT doc_id, ordinal, start_pos, end_pos, content FROM f"
SQL["chunk_sliding"] = f"WITH {DOCS}, {SLIDING} SELECT * FROM sliding"
SQL["chunk_http"] = f"WITH {DOCS}, {fixed('f', 500, 0)} SELECT doc_id, ordinal, 0 AS start_pos, length(content) AS end_pos, content FROM f"
SQL["doc_analysis"] = f"WITH {DOCS}" + r""", t AS (
  SELECT doc_id, content, CASE regexp_extract(path, '\.([^./]+)$', 1) WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'txt' THEN NULL ELSE 'code' END AS ext FROM docs
), k AS (
  SELECT *, coalesce(ext, CASE WHEN contains(content, '```') OR regexp_matches(content, '^function\s|class\s|import\s') THEN 'code' WHEN regexp_matches(content, '^#{1,6}\s') THEN 'markdown'
    WHEN regexp_matches(content, '^\s*[\{\[]') THEN 'json' WHEN regexp_matches(content, '(?i)<html|<!DOCTYPE') THEN 'html' ELSE 'text' END) AS doc_type,
    list_filter(string_split(regexp_replace(content, '([.!?])\s+', E'\\1\n', 'g'), E'\n'), lambda x: regexp_matches(x, '\S')) AS sent,
    list_filter(string_split_regex(content, '\n\n+'), lambda x: regexp_matches(x, '\S')) AS para,
    list_filter(string_split_regex(content, '\s+'), lambda x: x <> '') AS w
  FROM t
), m AS (
  SELECT *, CASE WHEN regexp_matches(content, 'function\s+\w+\s*\(') OR regexp_matches(content, 'const\s+\w+\s*=') THEN 'javascript' WHEN regexp_matches(content, 'def\s+\w+\s*\(') THEN 'python'
      WHEN regexp_matches(content, 'package\s+\w+') THEN 'go' WHEN regexp_matches(content, 'class\s+\w+\s*:') OR regexp_matches(content, 'interface\s+\w+') THEN 'typescript' ELSE 'unknown' END AS language,
    coalesce(list_sum(list_transform(sent, lambda x: length(x))) / nullif(len(sent), 0), 0)::DOUBLE AS s, coalesce(list_sum(list_transform(para, lambda x: length(x))) / nullif(len(para), 0), 0)::DOUBLE AS pl,
    coalesce(len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z][a-z]+$') OR length(x) > 8)) / nullif(len(w), 0), 0)::DOUBLE AS r,
    doc_type = 'markdown' AS md, doc_type = 'code' AS code
  FROM k
), z AS (
  SELECT doc_id, doc_type, language, md AND regexp_matches(content, '^#\s') AS has_title,
    CASE WHEN md THEN regexp_matches(content, '^#{2,3}\s') WHEN code THEN regexp_matches(content, 'function\s|class\s') ELSE false END AS has_sections,
    CASE WHEN md THEN len(regexp_extract_all(content, '^#{2,3}\s')) WHEN code THEN len(regexp_extract_all(content, 'function\s+\w+|class\s+\w+')) ELSE 0 END::INT AS section_count,
    NOT code AND regexp_matches(content, '^\s*[-*]\s') AS has_list, md AND regexp_matches(content, '\|.*\|') AS has_table, code OR (md AND contains(content, '```')) AS has_code_block,
    CASE WHEN md THEN len(string_split_regex(content, '\n\n+')) WHEN code THEN 0 ELSE len(para) END::INT AS paragraph_count,
    CASE WHEN s > 100 AND r > 0.2 THEN 'high' WHEN s < 50 THEN 'low' ELSE 'medium' END AS density_level,
    round(s, 6) AS avg_sentence_length, round(pl, 6) AS avg_paragraph_length, round(r, 6) AS technical_term_ratio
  FROM m
)
SELECT *, CASE WHEN doc_type = 'code' THEN 'ast-based' WHEN doc_type = 'markdown' AND has_sections THEN 'markdown-section' WHEN density_level = 'high' THEN 'semantic-boundary' WHEN paragraph_count > 10 THEN 'recursive' ELSE 'sliding-window' END AS strategy FROM z"""
SQL["chunk_enhance"] = f"WITH {DOCS}, {fixed('f', 500, 50)}" + """, n AS (
  SELECT *, lag(content) OVER w AS prev, lead(content) OVER w AS nxt FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)
)
SELECT doc_id, ordinal, concat_ws(E'\\n', '[前文] ...' || right(prev, 100), '【' || regexp_extract(path, '([^/]+)$', 1) || E'】\\n' || content, '[后文] ' || left(nxt, 100) || '...') AS enhanced,
  CASE WHEN prev IS NULL AND nxt IS NULL THEN 'title-prefix' ELSE 'title-prefix,context-window' END AS enhancement_types FROM n"""
SQL["chunk_overlap_fixed"] = f"WITH {DOCS}, {fixed('f', 500, 0)}" + """, n AS (SELECT *, coalesce(right(lag(content) OVER (PARTITION BY doc_id ORDER BY ordinal), 50), '') AS overlap FROM f)
SELECT doc_id, ordinal, greatest(start_pos - length(overlap), 0) AS start_pos, end_pos, overlap || content AS content, overlap FROM n"""
SQL["chunk_validate"] = f"WITH {DOCS}, {VALIDATED}" + """ SELECT doc_id, ordinal, invalid_reason, CASE invalid_reason WHEN 'too-small' THEN '合并到相邻分块' WHEN 'too-large' THEN '进一步切分' WHEN 'low-quality' THEN '过滤低质量内容' WHEN 'duplicate' THEN '去重处理' END AS suggestion FROM validated"""
SQL["chunk_repair"] = f"WITH {DOCS}, {VALIDATED}" + """, kept AS (SELECT *, invalid_reason = 'too-small' AND invalid_reason IS NOT NULL AS small FROM validated WHERE invalid_reason IS NULL OR invalid_reason NOT IN ('duplicate', 'low-quality')),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY invalid_reason IS NOT NULL, ordinal) AS seq FROM kept),
grp AS (SELECT *, sum((NOT coalesce(small, false) OR seq = 1)::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS grp FROM seq)
SELECT doc_id, (grp - 1)::INT AS ordinal, arg_min(start_pos, seq) AS start_pos, arg_max(end_pos, seq) AS end_pos, string_agg(content, E'\\n' ORDER BY seq) AS content FROM grp GROUP BY doc_id, grp"""
SQL["chunk_stats"] = f"WITH {DOCS}, {SLIDING}, s AS (SELECT doc_id, list(length(content) ORDER BY length(content)) AS s FROM sliding GROUP BY ALL)" + """
SELECT doc_id, len(s)::INT AS n_chunks, round(list_sum(s) / len(s))::BIGINT AS avg_size, list_min(s) AS min_size, list_max(s) AS max_size, s[len(s) // 2 + 1] AS median_size FROM s"""
SQL["fulltext_topk"] = f"WITH {DOCS}, {TEXT_QUERIES}, {fixed('f', 500, 50)}" + """, h AS (
  SELECT query_id, doc_id * 100000 + ordinal AS chunk_id, 0.5::DOUBLE AS score FROM f, tq WHERE contains(lower(content), lower(query))
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM h)
SELECT * FROM r WHERE rank <= 10"""
SQL["bm25_topk"] = f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 10"
SQL["rule_rerank"] = f"WITH {RERANKED}" + """ SELECT query_id, chunk_id, round(exact, 6) AS exact, round(density, 6) AS density, round(source_quality, 6) AS source_quality, rerank_score,
  round(least(1.0, rerank_score / 3), 6) AS confidence, coalesce(nullif(concat_ws('，', CASE WHEN exact > 0.8 THEN '关键词高度匹配' END, CASE WHEN density > 0.5 THEN '关键词密度高' END, CASE WHEN source_quality > 0.8 THEN '来源质量高' END), ''), '相关性一般') AS reason FROM ranked"""
SQL["result_filter"] = f"WITH {RERANKED}" + r""", ok AS (SELECT * FROM ranked WHERE score >= 1.0 AND regexp_matches(lower(source), '\.(md|ts|py|txt)$')),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY rank, chunk_id) AS nth FROM ok) WHERE nth = 1)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS rank FROM once"""
SQL["coverage"] = f"WITH {BM25}" + r""", kw AS (SELECT query_id, list_filter(string_split_regex(trim(query), '\s+'), lambda x: length(x) > 1) AS w FROM tq),
c AS (SELECT bm.query_id, 0.7 * coalesce(len(list_filter(w[1:5], lambda x: contains(lower(content), lower(x)))) / nullif(len(w[1:5]), 0), 0) + 0.3 * coalesce(len(list_filter(w[6:10], lambda x: contains(lower(content), lower(x)))) / nullif(len(w[6:10]), 0), 0) AS c
  FROM bm JOIN docs ON doc_id = chunk_id JOIN kw ON kw.query_id = bm.query_id WHERE bm.rank <= 3)
SELECT query_id, round(avg(c), 6) AS coverage, avg(c) < 0.7 AS supplement FROM c GROUP BY ALL"""

SQL["query_parse"] = f"WITH {PARSED}" + r"""
SELECT query_id, intent,
  round(least(0.9::DOUBLE, 0.5 + 0.15 * len(list_filter((CASE intent WHEN 'definition' THEN ['什么', '定义', '概念'] WHEN 'how-to' THEN ['如何', '怎么', '方法'] WHEN 'example' THEN ['示例', '例子', '代码'] WHEN 'comparison' THEN ['比较', '区别', '对比']
    WHEN 'debug' THEN ['报错', '错误', 'bug'] WHEN 'optimization' THEN ['优化', '提升', '改进'] WHEN 'exploration' THEN ['所有', '全部', '关于'] WHEN 'fact-check' THEN ['是否', '正确', '验证'] WHEN 'multi-hop' THEN ['然后', '接着', '首先'] ELSE []::VARCHAR[] END),
    lambda w: contains(query, w)))), 6) AS confidence,
  array_to_string(words[1:5], '|') AS core, array_to_string(words[6:10], '|') AS related,
  array_to_string(list_filter(regexp_extract_all(query, '(?:不包含|不包括|排除)\s*(\S+)', 1), lambda x: x <> ''), '|') AS excluded,
  regexp_extract(query, '(?:关于|针对|对于)\s*([一-龥a-zA-Z]+)', 1) AS subject, regexp_extract(query, '(?:如何|怎么|怎样)\s*([一-龥a-zA-Z]+)', 1) AS action, regexp_extract(query, '(?:实现|获取|查找|搜索)\s*([一-龥a-zA-Z]+)', 1) AS object,
  score AS complexity_score, CASE WHEN score <= 2 THEN 'simple' WHEN score <= 6 THEN 'medium' ELSE 'complex' END AS complexity,
  concat_ws('|', CASE WHEN s1 = 1 THEN 'multipleEntities' END, CASE WHEN s2 = 1 THEN 'multipleConditions' END, CASE WHEN s3 = 1 THEN 'needsInference' END, CASE WHEN s4 = 1 THEN 'longQuery' END) AS reasons,
  CASE WHEN regexp_matches(query, '代码') THEN 'mixed' WHEN regexp_matches(query, 'function|class|import|def') THEN 'code' ELSE 'text' END AS modality,
  CASE WHEN len(regexp_extract_all(query, '[一-龥]')) / length(query) > 0.3 THEN 'zh' ELSE 'en' END AS language
FROM parsed"""
SQL["query_route"] = f"WITH {PARSED}" + """, r AS (
  SELECT query_id, score, length(query) AS n, CASE WHEN score <= 2 AND intent = 'definition' THEN ['single-hop', '简单定义查询，单次检索足够'] WHEN intent = 'multi-hop' OR score > 6 THEN ['decomposition', '复杂查询，需要分解为子查询']
    WHEN intent = 'comparison' THEN ['multi-hop', '比较查询需要检索多个实体'] WHEN intent = 'exploration' THEN ['exploratory', '探索式查询需要广度检索'] WHEN intent = 'fact-check' THEN ['fact-verification', '事实验证需要精确匹配'] ELSE ['single-hop', '默认单次检索'] END AS s, ceil(score / 2)::INT AS parts
  FROM parsed
)
SELECT query_id, s[1] AS strategy, s[2] AS route_reason,
  CASE s[1] WHEN 'decomposition' THEN parts WHEN 'multi-hop' THEN 2 WHEN 'exploratory' THEN 3 ELSE 1 END AS paths, CASE s[1] WHEN 'decomposition' THEN parts * 20 WHEN 'multi-hop' THEN 40 WHEN 'exploratory' THEN 50 ELSE 20 END AS candidates,
  (CASE s[1] WHEN 'decomposition' THEN n * parts + 1000 WHEN 'multi-hop' THEN n * 2 + 800 WHEN 'exploratory' THEN n + 1500 ELSE n + 500 END)::INT AS tokens, CASE s[1] WHEN 'decomposition' THEN parts * 100 WHEN 'multi-hop' THEN 200 WHEN 'exploratory' THEN 150 ELSE 100 END AS latency_ms
FROM r"""
SQL["query_expand"] = f"WITH {TEXT_QUERIES}" + """, pairs AS (SELECT * FROM (VALUES (1, 'retrieval', 'search'), (2, 'retrieval', 'recall'), (3, 'document', 'file'), (4, 'document', 'text'), (5, 'the', 'this'), (6, 'the', 'that')) t(o, word, other)),
v AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o)::INT AS variant, trim(replace(' ' || lower(query) || ' ', ' ' || word || ' ', ' ' || other || ' ')) AS query FROM tq, pairs WHERE contains(' ' || lower(query) || ' ', ' ' || word || ' '))
SELECT query_id, 0 AS variant, query FROM tq UNION ALL SELECT query_id, variant, query FROM v"""
SQL["path_weights"] = f"WITH {PARSED}" + """, w AS (
  SELECT query_id, (CASE WHEN NOT regexp_matches(query, '代码') AND regexp_matches(query, 'function|class|import|def') THEN 0.4 ELSE 0.3 END)::DOUBLE AS v, (CASE WHEN len(words[1:5]) > 3 THEN 0.3 ELSE 0.2 END)::DOUBLE AS f, 0.2::DOUBLE AS k,
    (CASE WHEN score > 6 THEN 0.25 WHEN intent = 'definition' THEN 0.4 ELSE 0.2 END)::DOUBLE AS s, (CASE WHEN score > 6 THEN 0.25 ELSE 0.1 END)::DOUBLE AS h FROM parsed
)
SELECT query_id, round(v / (v + f + k + s + h), 6) AS vector, round(f / (v + f + k + s + h), 6) AS fulltext, round(k / (v + f + k + s + h), 6) AS keyword, round(s / (v + f + k + s + h), 6) AS semantic, round(h / (v + f + k + s + h), 6) AS hyde FROM w"""

STORED = "stored AS (SELECT doc_id AS id, path, n_chars, doc_id % 7 AS indexed_at FROM docs), changed AS (SELECT doc_id + CASE WHEN doc_id % 2 = 0 THEN 1000000 ELSE 0 END AS id, path, n_chars + 1 AS n_chars, 3::BIGINT AS indexed_at FROM docs WHERE doc_id % 3 = 0)"
SQL["store_upsert"] = f"""WITH {DOCS}, {STORED}, b AS (SELECT *, 0 AS new FROM stored UNION ALL SELECT *, 1 AS new FROM changed)
SELECT id, path, n_chars, indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, new DESC) AS nth FROM b) WHERE nth = 1"""
SQL["store_sync"] = f"""WITH {DOCS}, {STORED}
SELECT coalesce(s.id, c.id) AS id, CASE WHEN s.id IS NULL OR (c.id IS NOT NULL AND c.indexed_at > s.indexed_at) THEN c.n_chars ELSE s.n_chars END AS n_chars,
  CASE WHEN s.id IS NULL OR (c.id IS NOT NULL AND c.indexed_at > s.indexed_at) THEN 'local' ELSE 'server' END AS origin, s.id IS NOT NULL AND c.id IS NOT NULL AND s.n_chars IS DISTINCT FROM c.n_chars AS conflict
FROM stored s FULL JOIN changed c ON s.id = c.id"""
SQL["store_delete"] = f"WITH {DOCS}, {fixed('f', 500, 50)}, n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY ALL)" + """
SELECT d.doc_id, coalesce(n, 0) AS n, CASE WHEN path LIKE '%.json' THEN 'deleted' ELSE 'kept' END AS state FROM docs d LEFT JOIN n USING (doc_id) WHERE n IS NOT NULL OR path LIKE '%.json'"""
SQL["store_stats"] = f"WITH {DOCS}, {fixed('f', 500, 50)} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT coalesce(sum(n_chars), 0)::BIGINT FROM docs) AS bytes, (SELECT count(*) FROM f) AS chunks"
SQL["doc_listing"] = f"WITH {DOCS}, {fixed('f', 500, 50)}, n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY ALL) SELECT doc_id, path, n_chars, coalesce(n, 0) AS chunks_count FROM docs LEFT JOIN n USING (doc_id)"
SQL["history_last100"] = "SELECT * FROM (SELECT conv_id, turn, text, conv_id % 4 AS client, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id DESC, turn DESC) AS nth FROM conversations WHERE role = 'user') WHERE nth <= 100"
SQL["metrics_last100"] = "SELECT event_id, ts, event_type, value, round(avg(value) OVER w, 6) AS mean, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
SQL["rate_limit"] = "SELECT event_type, time_bucket(INTERVAL '10 minutes', ts) AS window_start, count(*) AS n, count(*) > 2 AS blocked FROM events GROUP BY ALL"
SQL["constraint_check"] = "SELECT page_id, CASE WHEN regexp_matches(lower(coalesce(url, '')), '\\.env|secret|credential|password|key\\.pem|id_rsa|\\.git') THEN 'block' WHEN length(html) * 1000 > 10485760 THEN 'warn' ELSE 'allow' END AS action FROM pages"
SQL["event_health"] = "WITH c AS (SELECT user_id, avg((event_type = 'error')::INT) AS e FROM events GROUP BY ALL), s AS (SELECT CASE WHEN e < 0.3 THEN 'healthy' WHEN e < 0.9 THEN 'degraded' ELSE 'unhealthy' END AS status FROM c) SELECT CASE WHEN bool_and(status = 'healthy') THEN 'healthy' WHEN bool_or(status = 'unhealthy') THEN 'unhealthy' ELSE 'degraded' END AS status, count(*) AS components FROM s"
SQL["span_report"] = "SELECT user_id AS trace_id, count(*) AS spans, sum((event_type = 'error')::INT)::BIGINT AS errors, min(ts) AS start_ts, max(ts) AS end_ts FROM events GROUP BY ALL"
SQL["cache_stats"] = "WITH f AS (SELECT event_id > min(event_id) OVER (PARTITION BY user_id, event_type) AS hit FROM events) SELECT sum(hit::INT)::BIGINT AS hits, sum(1 - hit::INT)::BIGINT AS misses, avg(hit::INT)::DOUBLE AS hit_rate FROM f"
SQL["regression_report"] = "WITH c AS (SELECT event_type AS category, value, event_type <> 'error' AND value <= 100.0 AS ok FROM events) SELECT category, count(*) AS n, sum(ok::INT)::BIGINT AS passed, round(avg(ok::INT), 6) AS pass_rate, round(avg(value), 6) AS avg_latency_ms FROM c GROUP BY ALL"

SQL["mock_embed"] = f"WITH {DOCS}" + """, h AS (
  SELECT doc_id, list_reduce(list_transform(string_split(content, ''), lambda c: unicode(c)::BIGINT), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::BIGINT) AS hash FROM docs WHERE content <> ''
  UNION ALL SELECT doc_id, 0 FROM docs WHERE content = ''
)
SELECT doc_id, hash, round((sin(hash::DOUBLE) * 0.5)::FLOAT::DOUBLE, 6) AS e0, round((sin(hash::DOUBLE + 1) * 0.5)::FLOAT::DOUBLE, 6) AS e1, round((sin(hash::DOUBLE + 2) * 0.5)::FLOAT::DOUBLE, 6) AS e2, round((sin(hash::DOUBLE + 3) * 0.5)::FLOAT::DOUBLE, 6) AS e3 FROM h"""
SQL["chunk_overlap_adaptive"] = f"WITH {DOCS}, {fixed('f', 500, 0)}" + r""", n AS (SELECT *, coalesce(lag(content) OVER (PARTITION BY doc_id ORDER BY ordinal), '') AS c FROM f),
w AS (SELECT *, list_filter(string_split_regex(c, '\s+'), lambda x: x <> '') AS words, regexp_extract(c, '[.!?。！？](\s*[^\s]*)$', 1) AS tail, regexp_matches(c, '[.!?。！？]\s*[^\s]*$') AS ended FROM n),
d AS (SELECT *, coalesce(list_sum(list_transform(words, lambda x: length(x))) / nullif(len(words), 0), 0) AS m FROM w),
e AS (SELECT *, floor(length(c) * (CASE WHEN m > 7 THEN 0.2 WHEN m < 4 THEN 0.05 ELSE 0.1 END)::DOUBLE)::INT AS size,
  CASE WHEN ended THEN tail ELSE substr(c, floor(length(c) - least(50.0::DOUBLE, length(c) * 0.1::DOUBLE))::INT + 1) END AS semantic FROM d),
o AS (SELECT doc_id, ordinal, start_pos, CASE WHEN length(semantic) <= size * 1.5 THEN semantic WHEN size = 0 THEN '' ELSE right(c, size) END AS overlap FROM e)
SELECT doc_id, ordinal, greatest(start_pos - length(overlap), 0) AS start_pos, overlap FROM o"""
SQL["query_decompose"] = f"WITH {PARSED}" + r""", e AS (
  SELECT *, CASE WHEN regexp_matches(query, '比较\s*[一-龥a-zA-Z]+\s*(?:和|与|同)\s*[一-龥a-zA-Z]+')
    THEN [regexp_extract(query, '比较\s*([一-龥a-zA-Z]+)\s*(?:和|与|同)\s*([一-龥a-zA-Z]+)', 1), regexp_extract(query, '比较\s*([一-龥a-zA-Z]+)\s*(?:和|与|同)\s*([一-龥a-zA-Z]+)', 2)] ELSE words[1:2] END AS ent,
    list_filter(string_split_regex(query, '首先|然后|接着|最后|第一步|第二步'), lambda x: regexp_matches(x, '\S')) AS steps, string_split_regex(query, '然后|接着|之后') AS hops
  FROM parsed
), s AS (
  SELECT query_id, CASE WHEN intent = 'comparison' THEN
      list_concat(list_transform(ent, lambda x, i: {'q': x || ' 的特点和特性', 't': 'atomic', 'd': '', 'w': 0.4::DOUBLE}), CASE WHEN len(ent) >= 2 THEN [{'q': ent[1] || ' 和 ' || ent[2] || ' 的区别', 't': 'derived', 'd': 'q1,q2', 'w': 0.6::DOUBLE}] ELSE [] END)
    WHEN intent = 'how-to' AND score > 4 THEN list_transform(steps, lambda x, i: {'q': x, 't': 'atomic', 'd': '', 'w': 1.0::DOUBLE / len(steps)})
    WHEN intent = 'multi-hop' THEN list_transform(hops, lambda x, i: {'q': trim(x), 't': CASE WHEN i = 1 THEN 'atomic' ELSE 'derived' END, 'd': CASE WHEN i = 1 THEN '' ELSE 'q' || (i - 1) END, 'w': 1.0::DOUBLE / len(hops)})
    ELSE [{'q': query, 't': 'atomic', 'd': '', 'w': 1.0::DOUBLE}] END AS subs
  FROM e
), u AS (SELECT query_id, len(list_filter(subs, lambda x: x.d <> '')) > 0 AS dep, unnest(subs) AS x, unnest(range(len(subs))) AS nth FROM s)
SELECT query_id, CASE WHEN dep THEN 'sequential' ELSE 'parallel' END AS fusion, nth, x.q AS sub_query, x.t AS type, x.d AS depends_on, round(x.w, 6) AS weight FROM u"""

SQL["tiered"] = f"WITH {VECTOR}, {BM25}" + """, fast AS (SELECT query_id * 50 AS query_id, chunk_id, score, rank, 'bm25' AS path, 0 AS p FROM bm WHERE rank <= 200),
wide AS (SELECT query_id, chunk_id, score, rank, 'vector' AS path, 1 AS p FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims) WHERE rank <= 100),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY p, rank) AS nth FROM (FROM fast UNION ALL FROM wide)) WHERE nth = 1),
m AS (SELECT query_id, chunk_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p, rank) AS r FROM once), """ + reranked("SELECT query_id, chunk_id, score, r AS rank, path AS path_found FROM m WHERE r <= 50", 50) + """
SELECT query_id, chunk_id, path_found AS path, rerank_score AS score, rank FROM ranked WHERE rank <= 20"""
SQL["doc_view"] = f"WITH {DOCS}, {fixed('f', 500, 50)}, n AS (SELECT doc_id, string_agg(start_pos || '-' || end_pos, ',' ORDER BY start_pos) AS chunks FROM f GROUP BY ALL) SELECT doc_id, path, left(content, 500) AS preview, coalesce(chunks, '') AS chunks FROM docs LEFT JOIN n USING (doc_id)"
SQL["store_delta"] = f"""WITH {DOCS}, {STORED}
SELECT coalesce(s.id, c.id) AS id, CASE WHEN s.id IS NULL OR c.indexed_at > s.indexed_at THEN 'upload' ELSE 'download' END AS direction
FROM stored s FULL JOIN changed c ON s.id = c.id WHERE s.id IS NULL OR c.id IS NULL OR s.n_chars <> c.n_chars"""
SQL["recall_normalised"] = f"WITH {VECTOR}, {BM25}" + """, h AS (
  SELECT query_id * 50 AS query_id, chunk_id, score, rank, 'bm25' AS path, 0 AS p FROM bm WHERE rank <= 20
  UNION ALL SELECT query_id, chunk_id, score, rank, 'vector' AS path, 1 AS p FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims) WHERE rank <= 20
), scaled AS (
  SELECT query_id, chunk_id, rank, path, p, CASE WHEN high > low THEN round((score - low) / (high - low), 9) ELSE 1.0 END AS score
  FROM (SELECT *, min(score) OVER w AS low, max(score) OVER w AS high FROM h WINDOW w AS (PARTITION BY query_id, path))
), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY p, rank) AS nth FROM scaled) WHERE nth = 1)
SELECT query_id, chunk_id, path, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p, rank) AS r FROM once) WHERE r <= 20"""
SQL["fusion_report"] = f"WITH {BOTH}" + """, f AS (SELECT query_id, chunk_id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS s FROM hits GROUP BY ALL),
b AS (SELECT query_id, count(DISTINCT path) AS lists, count(*) AS n, round(avg(score), 6) AS mean_before FROM hits GROUP BY ALL),
a AS (SELECT query_id, count(*) AS m, round(avg(s), 6) AS mean_after FROM f GROUP BY ALL)
SELECT query_id, lists, n - m AS duplicates, mean_before, mean_after FROM b JOIN a USING (query_id)"""
SQL["result_filter_language"] = f"WITH {RERANKED}" + """, ok AS (SELECT ranked.* FROM ranked JOIN documents d ON d.doc_id = chunk_id WHERE score >= 1.0 AND d.lang IN ('en', 'fr'))
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS rank FROM ok"""


def bm25_of(name: str, words: str) -> str:
    """BM25 of the text queries cut to some of their tokens; tables with names of their own."""
    return rf"""{name}_qt AS (SELECT DISTINCT query_id, unnest((list_filter(string_split_regex(lower(query), '\s+'), lambda x: x <> '')){words}) AS token FROM tq),
{name}_s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
  FROM post JOIN df USING (token) JOIN {name}_qt USING (token), size GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_s) WHERE rank <= 50)"""


SQL["multi_condition"] = f"WITH {BM25}, {bm25_of('head', '[1:5]')}, {bm25_of('rest', '[6:]')}" + """, h AS (SELECT *, 0.3::DOUBLE AS w FROM head UNION ALL SELECT *, 0.7::DOUBLE AS w FROM rest)
SELECT query_id, chunk_id, round(sum(score * w), 9) AS weighted, CASE WHEN count(*) = 2 THEN round(avg(score), 9) END AS mean_of_both FROM h GROUP BY ALL"""
SQL["query_tfidf"] = f"WITH {BM25}" + r""", tf AS (SELECT query_id, token, count(*) AS tf FROM (SELECT query_id, unnest(list_filter(string_split_regex(lower(query), '\s+'), lambda x: x <> '')) AS token FROM tq) GROUP BY ALL),
w AS (SELECT query_id, token, round(tf * (ln((1.0::DOUBLE + n) / (1 + coalesce(df, 0))) + 1), 6) AS weight FROM tf LEFT JOIN df USING (token), size)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, token) AS rank FROM w) WHERE rank <= 5"""
SQL["query_vague"] = f"WITH {FORMS}" + """, v AS (SELECT query_id, CASE query_id % 4 WHEN 0 THEN '那个什么' || query WHEN 1 THEN '好像' || query || '的样子' WHEN 2 THEN '类似' || query || '的' ELSE query END AS query FROM asked)
SELECT query_id, query, CASE WHEN regexp_matches(query, '那个什么.*') THEN 'vague-reference' WHEN regexp_matches(query, '好像.*的样子') THEN 'uncertain' WHEN regexp_matches(query, '类似.*的') THEN 'analogy' END AS vague FROM v"""
SQL["query_budget"] = "SELECT query_id, CASE WHEN complexity = 'complex' THEN 200 ELSE 100 END AS rewrite, CASE WHEN complexity = 'complex' THEN 300 ELSE 0 END AS decompose, CASE WHEN complexity = 'complex' THEN 500 ELSE 200 END AS rerank FROM (" + SQL["query_parse"] + ")"
SQL["chunk_code"] = f"WITH {DOCS}" + r""", code AS (SELECT doc_id, content FROM docs WHERE regexp_extract(path, '\.([^./]+)$', 1) IN (CODE) AND length(content) > 0),
lines AS (SELECT doc_id, content, i, l, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l) - 1 AS pos FROM (SELECT doc_id, content, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS l FROM (SELECT *, string_split(content, E'\n') AS x FROM code))),
cuts AS (SELECT doc_id, content, pos AS a, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), length(content)) AS b FROM lines
  WHERE i = 1 OR regexp_matches(l, '^(?:export\s+|public\s+|async\s+)*(?:def|class|function|interface|func|type|enum)\b')),
pieces AS (SELECT doc_id, content, b, a + unnest(range(0, (b - a)::BIGINT, 1000)) AS s FROM cuts)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS ordinal, s::INT AS start_pos, least(s + 1000, b)::INT AS end_pos, substr(content, (s + 1)::BIGINT, (least(s + 1000, b) - s)::BIGINT) AS content FROM pieces""".replace("CODE", CODE)

SQL["index_exact"] = SQL["vector_topk"]
SQL["index_changes"] = f"""WITH {VECTOR}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims WHERE chunk_id % 7 <> 1)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kept WHERE rank <= 10"""
SQL["fulltext_short"] = f"""WITH {DOCS}, {TEXT_QUERIES}, part AS (SELECT query_id, lower(substr(query, query_id % 5 + 1, query_id % 9 + 1)) AS needle FROM tq),
hits AS (SELECT query_id, doc_id AS chunk_id, 0.5::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM docs JOIN part ON contains(lower(content), needle) WHERE needle <> '')
SELECT * FROM hits WHERE rank <= 10"""
SQL["code_nested"] = f"WITH {DOCS}" + r""", lines AS (
  SELECT doc_id, 'class D' || doc_id || ' {' || chr(10) AS head, i, string_split(content, chr(10)) AS l FROM (SELECT *, unnest(range(len(string_split(content, chr(10))))) AS i FROM docs)
), m AS (
  SELECT doc_id, head, i, '  m' || i || '() {' || chr(10) || '    return "' || replace(replace(l[i + 1], '\', '/'), '"', '''') || '";' || chr(10) || '  }' || chr(10) AS body FROM lines
), placed AS (
  SELECT *, length(head) + sum(length(body)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, sum(length(body)) OVER (PARTITION BY doc_id) + length(head) + 1 AS size FROM m
)
SELECT doc_id, i + 1 AS ordinal, 'method' AS kind, 'm' || i AS name, 0 AS parent, stop - length(body) AS start_pos, stop - 1 AS end_pos, left(body, length(body) - 1) AS content FROM placed
UNION ALL SELECT doc_id, 0, 'class', 'D' || doc_id, -1, 0, any_value(size), any_value(head) || string_agg(body, '' ORDER BY i) || '}' FROM placed GROUP BY doc_id
UNION ALL SELECT doc_id, count(*) + 1, 'text', '', -1, any_value(size), any_value(size) + 1, chr(10) FROM placed GROUP BY doc_id"""
SQL["store_log"] = f"""WITH {DOCS}, {fixed('f', 500, 50)}
SELECT doc_id, doc_id * 100000 + ordinal AS chunk_id, CASE WHEN doc_id % 10 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS version, length(content) AS size FROM f
WHERE doc_id % 10 = 0 OR (doc_id % 5 <> 0 AND ordinal <> 1)"""
WORDS = r"list_filter(string_split_regex(lower({}), '\s+'), lambda x: x <> '')"
HASH = "list_reduce(list_transform(string_split(token, ''), lambda c: unicode(c)::BIGINT), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::BIGINT)"
SQL["late_interaction"] = f"""WITH {DOCS}, {TEXT_QUERIES}, held AS (SELECT DISTINCT doc_id AS chunk_id, unnest({WORDS.format('content')}) AS token FROM docs),
asked AS (SELECT DISTINCT query_id, unnest({WORDS.format('query')}) AS token FROM tq),
v AS (SELECT token, list_transform(range(16), lambda i: (sin(h::DOUBLE + i) * 0.5)::FLOAT::DOUBLE) AS e FROM (SELECT token, {HASH} AS h FROM (SELECT token FROM held UNION SELECT token FROM asked))),
sims AS (SELECT q.token AS asked, t.token, list_cosine_similarity(q.e, t.e) AS c FROM (SELECT * FROM v WHERE token IN (SELECT token FROM asked)) q, (SELECT * FROM v WHERE token IN (SELECT token FROM held)) t),
near AS (SELECT * FROM (SELECT asked, token, round(c, 9) AS c, row_number() OVER (PARTITION BY asked ORDER BY round(c, 9) DESC, token) AS r FROM sims) WHERE r <= 2),
found AS (SELECT query_id, chunk_id, round(sum(c), 6) AS found FROM (SELECT query_id, chunk_id, near.asked, max(c) AS c FROM asked JOIN near ON near.asked = asked.token JOIN held ON held.token = near.token GROUP BY ALL) GROUP BY ALL),
short AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY found DESC, chunk_id) AS r FROM found) WHERE r <= 50),
best AS (SELECT query_id, chunk_id, sims.asked, max(c) AS c FROM short JOIN asked USING (query_id) JOIN held USING (chunk_id) JOIN sims ON sims.asked = asked.token AND sims.token = held.token GROUP BY ALL),
full_ AS (SELECT query_id, chunk_id, round(sum(c), 6) AS score FROM best GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM full_)
SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10"""
SQL["semantic_merge"] = f"""WITH RECURSIVE {BM25}, m AS (SELECT query_id, chunk_id, score, rank, list_distinct({WORDS.format('content')}) AS w FROM bm JOIN docs ON doc_id = chunk_id WHERE rank <= 20),
link AS (SELECT a.query_id, a.rank AS x, b.rank AS y FROM m a JOIN m b ON a.query_id = b.query_id WHERE a.rank = b.rank OR len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.8),
reach AS (SELECT query_id, x, y FROM link UNION SELECT r.query_id, r.x, l.y FROM reach r JOIN link l ON l.query_id = r.query_id AND l.x = r.y),
lab AS (SELECT query_id, x AS rank, min(y) AS g FROM reach GROUP BY ALL),
g AS (SELECT m.query_id, g, arg_min(chunk_id, m.rank) AS chunk_id, max(score) AS score, string_agg(chunk_id, ',' ORDER BY m.rank) AS members FROM m JOIN lab ON lab.query_id = m.query_id AND lab.rank = m.rank GROUP BY ALL)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY g) AS rank, members FROM g"""


def feedback(rounds: int = 3) -> str:
    """Rounds of BM25, each with the tokens that the one before added."""
    parts = [f"""WITH {DOCS}, {TEXT_QUERIES}, terms AS (SELECT doc_id AS chunk_id, {WORDS.format('content')} AS t FROM docs),
size AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM terms),
post AS (SELECT token, chunk_id, len, count(*) AS tf FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS token FROM terms) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY ALL),
a1 AS (SELECT query_id, list_distinct({WORDS.format('query')}) AS asked, list_distinct({WORDS.format('query')}) AS q FROM tq)"""]
    for r in range(1, rounds + 1):
        parts.append(f"""s{r} AS (
  SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
  FROM (SELECT query_id, unnest(q) AS token FROM a{r}) x JOIN post USING (token) JOIN df USING (token), size GROUP BY ALL
), h{r} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s{r}) WHERE rank <= 10)""")
        if r < rounds:
            parts.append(f"""d{r} AS (SELECT query_id FROM h{r} JOIN terms USING (chunk_id) JOIN a{r} USING (query_id) GROUP BY query_id HAVING max(len(list_intersect(asked, t))::DOUBLE / len(asked)) > 0.8),
f{r} AS (SELECT query_id, token, count(*) AS tf FROM (SELECT query_id, q, unnest(t) AS token FROM h{r} JOIN terms USING (chunk_id) JOIN a{r} USING (query_id) WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM d{r})) WHERE NOT list_contains(q, token) GROUP BY ALL),
b{r} AS (SELECT query_id, token FROM (SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY round(tf * (ln((n + 1)::DOUBLE / (df + 1)) + 1), 6) DESC, token) AS nth FROM f{r} JOIN df USING (token), size) WHERE nth <= 5),
a{r + 1} AS (SELECT query_id, any_value(asked) AS asked, list_concat(any_value(q), list(token)) AS q FROM a{r} JOIN b{r} USING (query_id) GROUP BY query_id)""")
    every = " UNION ALL ".join(f"SELECT *, {r} AS round FROM h{r}" for r in range(1, rounds + 1))
    parts.append(f"al AS ({every}), once AS (SELECT query_id, chunk_id, min((round, rank, score)) AS x FROM al GROUP BY ALL)")
    return ", ".join(parts) + " SELECT query_id, chunk_id, x[1] AS round, x[3] AS score, row_number() OVER (PARTITION BY query_id ORDER BY x[1], x[2]) AS rank FROM once"


SQL["feedback_rounds"] = feedback()
DECOMPOSED = SQL["query_decompose"].rsplit("SELECT query_id, CASE WHEN dep", 1)[0]
ROUTED = SQL["query_route"]
SQL["library_search"] = DECOMPOSED + ", " + BM25.replace(TEXT_QUERIES, "tq AS (SELECT query_id || '/' || nth AS query_id, x.q AS query FROM u)") + f""",
ft AS (SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM docs JOIN tq ON contains(lower(content), lower(query)) WHERE query <> ''),
hits AS (SELECT query_id AS part, chunk_id, rank, 'keyword' AS path FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank, 'fulltext' FROM ft WHERE rank <= 20),
pw AS ({SQL["path_weights"].split("), w AS (", 1)[1].split(chr(10) + ")" + chr(10))[0].strip().join(["SELECT query_id, v, f, k, s, h FROM (", ")"])}),
fused AS (
  SELECT query_id, chunk_id, round(sum(round((CASE path WHEN 'keyword' THEN k ELSE f END) / (v + f + k + s + h), 9) * x.w / (60 + rank)), 9) AS score, string_agg(DISTINCT path, ',' ORDER BY path) AS sources, count(DISTINCT nth) AS parts
  FROM hits JOIN u ON part = query_id || '/' || nth JOIN pw USING (query_id) GROUP BY ALL
), few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS first FROM fused) WHERE first <= 30),
feats AS (
  SELECT few.*, len(list_filter(words[1:5], lambda w: contains(lower(content), lower(w))))::DOUBLE / greatest(len(words[1:5]), 1) AS exact,
    least(1.0::DOUBLE, coalesce(list_sum(list_transform(words[1:5], lambda w: (length(content) - length(replace(lower(content), lower(w), '')))::DOUBLE / length(w))), 0) / greatest(length(content) / 100.0::DOUBLE, 1.0::DOUBLE)) AS density,
    (CASE WHEN regexp_matches(docs.path, '\\.(md|ts)$') THEN 0.9 WHEN regexp_matches(docs.path, '\\.(js|py)$') THEN 0.85 WHEN docs.path LIKE '%.json' THEN 0.7 ELSE 0.8 END)::DOUBLE AS quality
  FROM few JOIN docs ON doc_id = chunk_id JOIN parsed USING (query_id)
), rr AS (SELECT *, round(0.3::DOUBLE * score + 0.7::DOUBLE * (2.0 * exact + 0.5::DOUBLE * density + 0.1::DOUBLE + 0.3::DOUBLE * quality), 9) AS best FROM feats),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first, chunk_id) AS rank FROM rr),
routed AS (SELECT query_id, strategy FROM ({ROUTED}))
SELECT query_id, strategy, rank, chunk_id, round(best, 6) AS score, sources, parts FROM placed JOIN routed USING (query_id) WHERE rank <= 10"""
SQL["offline_search"] = f"""WITH {VECTOR}, {TEXT_HITS.replace("WHERE rank <= 10", "WHERE rank <= 20")}, wide AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims) WHERE rank <= 20),
known AS (SELECT query_id, chunk_id, score, rank FROM vhits WHERE query_id % 3 = 0),
hits AS (SELECT query_id, chunk_id, rank, 'vector' AS path, 0 AS p FROM wide UNION ALL SELECT query_id, chunk_id, rank, 'fulltext', 1 FROM thits),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s, min((p, rank)) AS seen, string_agg(DISTINCT path, ',' ORDER BY path) AS sources FROM hits WHERE query_id NOT IN (SELECT query_id FROM known) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, seen, chunk_id) AS rank FROM f)
SELECT query_id, chunk_id, round(s, 6) AS score, rank, sources FROM r WHERE rank <= 10 UNION ALL SELECT query_id, chunk_id, round(score, 6), rank, 'cache' FROM known"""
SQL["eval_details"] = f"""WITH {BM25}, rel AS (SELECT query_id, doc_id AS chunk_id FROM docs JOIN tq ON contains(lower(content), lower(query)) WHERE query <> ''),
e AS (SELECT bm.query_id, bm.chunk_id, rank, rel.chunk_id IS NOT NULL AS relevant FROM bm LEFT JOIN rel ON rel.query_id = bm.query_id AND rel.chunk_id = bm.chunk_id WHERE rank <= 10),
a AS (SELECT query_id, min(rank) FILTER (relevant) AS first, string_agg(rank || ':' || chunk_id || ':' || relevant::INT, ',' ORDER BY rank) AS shown FROM e GROUP BY ALL)
SELECT query_id, first IS NOT NULL AS hit, coalesce(first, 0) AS first_rank, coalesce(shown, '') AS shown FROM (SELECT DISTINCT query_id FROM rel) LEFT JOIN a USING (query_id)"""
SQL["runs_compared"] = f"""WITH {VECTOR}, wide AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM sims) WHERE r <= 20),
code AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM wide WHERE chunk_id % 6 BETWEEN 1 AND 3) WHERE rank <= 10),
a AS (SELECT query_id, avg((w.label = q.label)::INT) AS a FROM wide w JOIN q USING (query_id) WHERE r <= 10 GROUP BY ALL),
b AS (SELECT query_id, avg((c.label = q.label)::INT) AS b FROM code c JOIN q USING (query_id) GROUP BY ALL),
d AS (SELECT query_id, a, b, round(a - b, 9) AS d FROM a JOIN b USING (query_id)),
t AS (SELECT count(*) AS n, round(avg(a), 6) AS mean_first, round(avg(b), 6) AS mean_second, round(avg(d), 6) AS difference, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, abs(sum(d)) AS far FROM d),
s AS (SELECT draw, abs(sum(CASE WHEN md5(query_id || ':' || draw)[1] < '8' THEN -d ELSE d END)) AS s FROM d, range(1, 501) AS x(draw) GROUP BY draw)
SELECT n, mean_first, mean_second, difference, wins, losses, round((SELECT count(*) FILTER (s >= far - 1e-9) + 1 FROM s, t) / 501.0::DOUBLE, 6) AS p_value FROM t"""
PLAIN = "list_filter(string_split(lower(regexp_replace(coalesce({}, ''), '[^a-zA-Z]+', ' ', 'g')), ' '), lambda w: length(w) > 2)"
SQL["query_senses"] = f"""WITH RECURSIVE asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_distinct({PLAIN.format("text")})) AS word FROM benchmark),
d AS (SELECT {PLAIN.format("text")} AS w FROM documents),
p AS (SELECT unnest(list_transform(range(1, len(w) + 1), lambda i: {{'word': w[i], 'near': list_filter(list_distinct(list_concat(w[greatest(i - 3, 1):i - 1], w[i + 1:i + 3])), lambda y: y <> w[i])}})) AS x FROM d),
s AS (SELECT row_number() OVER () AS r, x.word AS word, x.near AS near FROM p WHERE x.word IN (SELECT word FROM asked)),
o AS MATERIALIZED (SELECT r, word, unnest(near) AS b FROM s),
c AS MATERIALIZED (SELECT word, b, count(*) AS n FROM o GROUP BY ALL),
two AS (SELECT x.word, x.b AS a, y.b, count(*) AS k FROM o x JOIN o y ON x.r = y.r AND x.b < y.b GROUP BY ALL HAVING count(*) >= 3),
t AS (SELECT word, count(*) AS times FROM s GROUP BY ALL),
l AS MATERIALIZED (SELECT two.word, a, two.b FROM two JOIN c ca ON ca.word = two.word AND ca.b = a JOIN c cb ON cb.word = two.word AND cb.b = two.b JOIN t ON t.word = two.word WHERE 200 * k >= 30 * (ca.n + cb.n) AND 100.0::DOUBLE * k * times >= 120.0::DOUBLE * ca.n * cb.n),
e AS MATERIALIZED (SELECT * FROM l UNION ALL SELECT word, b, a FROM l),
reach AS (SELECT DISTINCT word, a, a AS m FROM e UNION SELECT r.word, e.b, r.m FROM reach r JOIN e ON e.word = r.word AND e.a = r.a WHERE r.m < e.b),
g AS (SELECT c.word, c.b, n, sense FROM c JOIN (SELECT word, a AS b, min(m) AS sense FROM reach GROUP BY ALL) USING (word, b)),
z AS (SELECT word, sense, sum(n) AS size, count(*) OVER (PARTITION BY word) AS senses FROM g GROUP BY word, sense),
f AS (SELECT a.query_id, g.word, sense, sum(n) AS score, string_agg(g.b, ',' ORDER BY g.b) AS fitting FROM asked a JOIN g USING (word) JOIN asked t ON t.query_id = a.query_id AND t.word = g.b GROUP BY ALL),
ranked AS (SELECT a.query_id, a.word, senses, z.sense, coalesce(fitting, '') AS fitting, coalesce(score, 0)::BIGINT AS score, row_number() OVER (PARTITION BY a.query_id, a.word ORDER BY coalesce(score, 0) DESC, size DESC, z.sense) AS r
  FROM asked a JOIN z USING (word) LEFT JOIN f ON f.query_id = a.query_id AND f.word = a.word AND f.sense = z.sense WHERE senses > 1)
SELECT query_id, word, senses, sense, fitting, score FROM ranked WHERE r = 1"""
