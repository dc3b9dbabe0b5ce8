"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.llm.common import read_table

#: The listed rules of the URL query, in the order of their contract (fixed values).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklode.llm.quality import score_quality

    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklode.llm.ann import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklode.llm.debruijn import dedup_substrings

    return dedup_substrings(read_table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklode.llm.minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklode.llm.decontaminate import decontaminate

    out = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklode.llm.toxicity import score_toxicity

    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sparklode.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklode.llm.urlfilter import filter_urls

    return filter_urls(read_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklode.llm.suffix import dedup_bytes

    return dedup_bytes(read_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparklode.llm.html_extract import extract_main_text

    return extract_main_text(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_url_filter": op8_url_filter,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_html_extraction": op10_html_extraction,
}

ORACLE: dict[str, str] = {
    "op8_url_filter": """
WITH u AS (SELECT page_id, row_number() OVER () AS rn, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT u.rn, h || p AS rule, v, row_number() OVER (PARTITION BY u.rn ORDER BY length(h) + length(p) DESC, length(h) DESC) AS k
  FROM u JOIN r ON (u.host = h OR u.host LIKE '%.' || h) AND starts_with(u.path, p))
SELECT page_id, host, path, m.rule AS rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN m ON m.rn = u.rn AND m.k = 1
""",
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
g AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM win JOIN f USING (s) WHERE m < doc_id), range(0, 13) AS t(k)),
a AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT a.doc_id, count(g.p) AS n_removed, string_agg(a.word, ' ' ORDER BY a.p) FILTER (g.p IS NULL) AS kept FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.p = a.p GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
""",
    "op4_minhash_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n na ON na.doc_id = x.doc_id JOIN n nb ON nb.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id FROM d LEFT JOIN r ON r.a = d.doc_id GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
""",
    "op9_suffix_array_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, len(h) // 2 AS n, k, substr(h, k * 2000 + 1, 2200) AS part FROM (SELECT doc_id, h, unnest(range(0, (len(h) + 1999) // 2000)) AS k FROM d)),
b AS (SELECT doc_id, n, k * 1000 + i AS p, i, part FROM (SELECT doc_id, n, k, part, unnest(range(0, least(1000, n - k * 1000))) AS i FROM c)),
w AS (SELECT doc_id, p, substr(part, 2 * i + 1, 2) AS x, CASE WHEN p + 100 <= n THEN substr(part, 2 * i + 1, 200) END AS s FROM b),
r AS (SELECT doc_id, p, x, (s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1)::INT AS again FROM w),
g AS (SELECT doc_id, p, x, max(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
e AS (SELECT doc_id, p, x, gone, (gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0)::INT AS starts FROM g),
a AS (SELECT doc_id, count(*) AS n_bytes, sum(gone) AS n_removed, sum(starts) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (gone = 0) AS kept FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id
""",
    "op5_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS l FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM b)),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM b) WHERE len(w) >= l)),
h AS (SELECT doc_id, item_id, i, dw.l AS l FROM dw JOIN bw ON bw.s = dw.s AND bw.l = dw.l),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS q FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS v FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
""",
}
