"""One registered query for each operator, over the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm import decontaminate, filter_audit, html_extract, jaccard_join, langid, lexical, masked_lm, minhash, packing, quality, token_store, topk, url_filter
from skysift.llm.common import shared_dir

URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict", "url")


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}.orc"
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_store.token_index(spark, path)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    weight = html_extract.weights(pages)
    out = html_extract.extract(pages.select("page_id", "url", "html"), weight).select("page_id", "url", "text")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    learned = langid.sample(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "text", "held_out"), learned).select("doc_id", "held_out", "lang_pred", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"), scale=64.0)
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op9_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score_documents(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.classify(docs, table(spark, sf_dir, "labels"), host="source", path="lang")
    return out.select("doc_id", "evidence", "prior", "posterior", "kept")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


AUDITED = {
    "A": filter_audit.fewer_words(100),
    "B": filter_audit.fewer_distinct(80),
    "C": filter_audit.more_capitals(10),
    "D": filter_audit.holds("[#$%&*|]"),
    "E": filter_audit.EARLIER_COPY,
}


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), AUDITED, part="lang")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"), words=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_token_orc": op2_token_orc,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_topk_search": op8_topk_search,
    "op9_masked_lm": op9_masked_lm,
    "op10_quality": op10_quality,
    "op11_lexical_search": op11_lexical_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_jaccard_join": op13_jaccard_join,
}

_RULES_SQL = ", ".join(f"('{r}', '{a}')" for r, a in URL_RULES)
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": rf"""
WITH rules(rule, action) AS (VALUES {_RULES_SQL}),
p AS (
  SELECT row_number() OVER () AS rid, page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r AS (SELECT rule, action, split_part(rule, '/', 1) AS rh, substr(rule, length(split_part(rule, '/', 1)) + 1) AS rp FROM rules),
m AS (
  SELECT p.rid, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.action, length(r.rule)) AS action
  FROM p JOIN r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp) GROUP BY p.rid)
SELECT p.page_id, p.url, p.host, p.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
""",
    "op6_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(len(w), 10) AS n FROM i WHERE len(w) > 0))),
dw AS (
  SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT rid, s, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS pos FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
""",
    "op8_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""",
    "op3_minhash_dedup": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
z AS (SELECT rid, list(g ORDER BY g) AS gs, count(*) AS n FROM s GROUP BY rid),
k AS (SELECT gs, n, min(rid) AS node FROM z GROUP BY gs, n),
of AS (SELECT z.rid, k.node, z.n FROM z JOIN k USING (gs)),
ks AS (SELECT node, n, unnest(gs) AS g FROM k),
link AS (
  SELECT x.node AS a, y.node AS b FROM ks x JOIN ks y ON x.g = y.g AND x.node < y.node AND x.n * 5 >= y.n * 4 AND y.n * 5 >= x.n * 4
  GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT node, node FROM k UNION SELECT r.a, two.b FROM reach r JOIN two ON r.b = two.a),
root AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
c AS (SELECT root, min(doc_id) AS component_id FROM root JOIN of USING (node) JOIN d USING (rid) GROUP BY root)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN of USING (rid) LEFT JOIN root USING (node) LEFT JOIN c USING (root)
""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {
    'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(x.doc_id > first, false)} AS fails
  FROM x LEFT JOIN l USING (doc_id)),
f(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
r AS (
  SELECT part, filter_order, step, n, good, toxic, fails[filter_order[step]] AS here,
    len(list_filter(range(1, step), lambda i: fails[filter_order[i]])) > 0 AS before, len(list_filter(map_values(fails), lambda v: v)) AS k
  FROM g, s),
z AS (
  SELECT part, filter_order, step, sum(CASE WHEN NOT before AND NOT here THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT before AND here THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN before AND here THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND k = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT before AND here THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT before AND here THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM z
""",
    "op11_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
f AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY rid, term),
v AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, s GROUP BY term, n_docs),
c AS (
  SELECT i.item_id, f.rid, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM f JOIN v USING (term) JOIN i USING (term) JOIN d USING (rid), s GROUP BY i.item_id, f.rid),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c JOIN d USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
""",
    "op13_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
z AS (SELECT rid, list(g ORDER BY g) AS gs, count(*) AS n FROM s GROUP BY rid),
k AS (SELECT gs, n, min(rid) AS node FROM z GROUP BY gs, n),
of AS (SELECT z.rid, k.node, z.n FROM z JOIN k USING (gs)),
ks AS (SELECT node, n, unnest(gs) AS g FROM k),
link AS (
  SELECT x.node AS a, y.node AS b FROM ks x JOIN ks y ON x.g = y.g AND x.node < y.node AND x.n * 100 >= y.n * 85 AND y.n * 100 >= x.n * 85
  GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT node, node FROM k UNION SELECT r.a, two.b FROM reach r JOIN two ON r.b = two.a),
root AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
c AS (SELECT root, min(doc_id) AS component_id FROM root JOIN of USING (node) JOIN d USING (rid) GROUP BY root)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN of USING (rid) LEFT JOIN root USING (node) LEFT JOIN c USING (root)
""",
}
