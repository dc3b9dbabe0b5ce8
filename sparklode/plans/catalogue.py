"""Queries over the driver's tables that exercise each operator, with SQL that gives the same rows.

The tables hold prose and keys, so values that mining meets are derived from key columns by the same expression on both sides.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparklode.functions import context as C
from sparklode.functions import rules as R
from sparklode.functions import shapes as S
from sparklode.operators import classify as K
from sparklode.operators import noise as N
from sparklode.operators import store as D
from sparklode.plans.pipeline import findings_of
from sparklode.plans.taxonomy import CATEGORIES, TYPES, expand_groups, type_dimension
from sparklode.sources.extract import extract
from sparklode.sources.files import shared_folder
from sparklode.streaming.scan import read_items, start_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(words: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _like_any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _starts_any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{w}')" for w in words) + ")"


def _ends_any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"ends_with({column}, '{w}')" for w in words) + ")"


TYPE_ROWS = ", ".join(f"({i}, '{slug}', '{category}', {CATEGORIES[category]}, {risk}, '{action}')" for i, slug, category, risk, action in TYPES)
TYPE_TABLE = f"types(type_id, slug, category, category_id, risk_level, action) AS (VALUES {TYPE_ROWS})"

# --- literals and tokens in documents -----------------------------------------------------------------------

LITERAL = r'([A-Za-z_][A-Za-z0-9_]*)[ ]*=[ ]*"([^"\n]+)"'


def literals(docs: DataFrame) -> DataFrame:
    """doc_id, at, key, value of key = "value" in texts. A cheap test for the quote keeps other texts from the pattern."""
    rows = docs.filter(F.col("text").contains('"')).select("doc_id", F.regexp_extract_all("text", F.lit(LITERAL), F.lit(1)).alias("k"), F.regexp_extract_all("text", F.lit(LITERAL), F.lit(2)).alias("v"))
    return rows.select("doc_id", F.posexplode(F.arrays_zip("k", "v")).alias("at", "m")).select("doc_id", "at", F.col("m.k").alias("key"), F.col("m.v").alias("value"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '{LITERAL}', 1)) AS key, unnest(regexp_extract_all(text, '{LITERAL}', 2)) AS value FROM documents)
SELECT doc_id, key, sha256(value) AS value_sha, length(value) AS n, len(list_distinct(string_split(value, ''))) AS n_distinct FROM l"""
)
def literal_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(table(spark, sf_dir, "documents")).select("doc_id", "key", F.sha2("value", 256).alias("value_sha"), F.length("value").alias("n"), S.unique_chars(F.col("value")).alias("n_distinct"))


@query(
    f"""WITH {TYPE_TABLE}, l AS (SELECT doc_id, unnest(regexp_extract_all(text, '{LITERAL}', 1)) AS key, unnest(regexp_extract_all(text, '{LITERAL}', 2)) AS value FROM documents),
f AS (SELECT DISTINCT doc_id, value, CASE WHEN key = 'token' AND regexp_matches(value, '^[0-9a-f]{{40}}$') AND len(list_distinct(string_split(value, ''))) >= 4 THEN 'server_cred_token' END AS slug FROM l)
SELECT slug, type_id, risk_level, count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(DISTINCT value) AS n_values FROM f JOIN types USING (slug) GROUP BY ALL"""
)
def token_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: literals of texts through filter, classification and typing, counted by type. A literal that a text repeats nearby counts once."""
    found = literals(table(spark, sf_dir, "documents")).filter("key = 'token'")
    constants = found.select(F.lit("documents").alias("pkg"), F.col("doc_id").cast("string").alias("file"), F.col("at").alias("sid"), "value", F.lit("text").alias("src"), F.concat("key", F.lit(' = "'), "value", F.lit('"')).alias("stmt"))
    rows = findings_of(constants, spark)
    return rows.groupBy("slug", "type_id", (F.col("risk_id") - 200).alias("risk_level")).agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_docs"), F.countDistinct("value").alias("n_values"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+"


@query(
    f"""WITH e AS (SELECT unnest(regexp_extract_all(text, '{EMAIL}')) AS v FROM documents),
c AS (SELECT v, CASE WHEN length(v) - length(replace(v, '@', '')) = 1 AND length(split_part(v, '@', 2)) >= 3 AND contains(split_part(v, '@', 2), '.') AND {_ends_any('lower(v)', R.EMAIL_SUFFIXES)} THEN
  CASE WHEN regexp_matches(v, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+$') AND NOT regexp_matches(lower(split_part(v, '@', 2)), '(^|[.])example[.](com|net|org)$|[.](test|example|invalid|localhost)$') THEN 'strict' ELSE 'loose' END ELSE 'none' END AS class FROM e)
SELECT class, count(*) AS n, count(DISTINCT v) AS n_values FROM c GROUP BY class"""
)
def email_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").filter(F.col("text").contains("@")).select(F.explode(F.regexp_extract_all("text", F.lit(f"({EMAIL})"), F.lit(1))).alias("v"))
    return v.groupBy(F.coalesce(S.email_class(F.col("v")), F.lit("none")).alias("class")).agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_values"))


QUAD = "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"


@query(
    f"""WITH q AS (SELECT unnest(regexp_extract_all(text, '{QUAD}')) AS v FROM documents),
p AS (SELECT v, list_transform(string_split(v, '.'), lambda x: try_cast(x AS INTEGER)) AS o FROM q),
c AS (SELECT v, CASE WHEN list_max(o) > 255 OR len(list_filter(o, lambda x: x IS NULL)) > 0 THEN 'none' WHEN o[1] = 127 OR list_sum(o) = 0 THEN 'noise'
  WHEN o[1] = 10 OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) THEN 'private' ELSE 'public' END AS kind FROM p)
SELECT kind, count(*) AS n, count(DISTINCT v) AS n_values FROM c GROUP BY kind"""
)
def ip_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(f"({QUAD})"), F.lit(1))).alias("v"))
    return v.groupBy(F.coalesce(S.ip_kind(F.col("v")), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_values"))


@query(
    """WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{15,18}')) AS v FROM documents),
l AS (SELECT doc_id, v, length(v) = 15 AND len(list_distinct(string_split(v, ''))) >= 3 AND
  list_sum(list_transform(range(1, 16), lambda i: CASE WHEN (15 - i) % 2 = 1 THEN CASE WHEN substr(v, i, 1)::INT > 4 THEN substr(v, i, 1)::INT * 2 - 9 ELSE substr(v, i, 1)::INT * 2 END ELSE substr(v, i, 1)::INT END)) % 10 = 0 AS imei FROM r WHERE length(v) < 18)
SELECT doc_id, v AS value, CASE WHEN imei THEN 'id_device_identifier' ELSE 'pii_noise' END AS slug FROM l"""
)
def digit_prefixed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]{15,18})"), F.lit(1))).alias("v")).filter("length(v) < 18")
    return v.select("doc_id", F.explode(K.digit_rows(F.col("v"), F.lit("value"))).alias("f")).select("doc_id", F.col("f.value").alias("value"), F.col("f.slug").alias("slug"))


# --- checksums and shapes from keys --------------------------------------------------------------------------


def _digits(spark: SparkSession, sf_dir: str, n: int, factor: int, add: int = 0) -> DataFrame:
    """o_orderkey and n digits that follow from it."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(((F.col("o_orderkey") * factor + add) % 10**n).cast("string"), n, "0").alias("v"))


@query(
    """WITH v AS (SELECT o_orderkey, lpad(((o_orderkey * 987654321 + 490154203237510) % 1000000000000000)::VARCHAR, 15, '0') AS v FROM orders)
SELECT o_orderkey, v AS value, len(list_distinct(string_split(v, ''))) >= 3 AND list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN substr(v, i, 1)::INT > 4 THEN substr(v, i, 1)::INT * 2 - 9 ELSE substr(v, i, 1)::INT * 2 END ELSE substr(v, i, 1)::INT END)) % 10 = 0 AS imei FROM v"""
)
def luhn_imei(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digits(spark, sf_dir, 15, 987654321, 490154203237510).select("o_orderkey", F.col("v").alias("value"), S.is_imei(F.col("v")).alias("imei"))


_ID_SUM = " + ".join(f"substr(b, {i}, 1)::INT * {w}" for i, w in enumerate(R.ID_WEIGHTS, 1))


@query(
    f"""WITH b AS (SELECT o_orderkey, lpad((11 + o_orderkey % 73)::VARCHAR, 2, '0') || lpad((o_orderkey % 9999)::VARCHAR, 4, '0') || (1890 + o_orderkey % 140)::VARCHAR || lpad((1 + o_orderkey % 12)::VARCHAR, 2, '0') || lpad((1 + o_orderkey % 31)::VARCHAR, 2, '0') || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') AS b FROM orders),
s AS (SELECT o_orderkey, b, substr('10X98765432', (({_ID_SUM}) % 11) + 1, 1) AS c, substr('10X98765432', (o_orderkey % 11 + 1)::INT, 1) AS d FROM b),
v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN b || c ELSE b || d END AS v, CASE WHEN o_orderkey % 2 = 0 THEN true ELSE c = d END AS sum_ok, b FROM s)
SELECT o_orderkey, v AS value, CASE WHEN len(list_distinct(string_split(b, ''))) < 4 OR substr(v, 7, 4)::INT NOT BETWEEN 1900 AND 2026 THEN '' WHEN sum_ok AND substr(v, 1, 2) IN ({_list(R.ID_PROVINCES)}) AND try_strptime(substr(v, 7, 8), '%Y%m%d') IS NOT NULL THEN 'id' ELSE 'reject' END AS digit_type FROM v"""
)
def sfz_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    body = F.concat(pad(11 + k % 73, 2), pad(k % 9999, 4), (1890 + k % 140).cast("string"), pad(1 + k % 12, 2), pad(1 + k % 31, 2), pad(k % 1000, 3))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("b"))
    last = F.when(k % 2 == 0, S.id_checksum(F.col("b"))).otherwise(F.lit(R.ID_CHECK).substr((k % 11 + 1).cast("int"), F.lit(1)))
    rows = rows.select("o_orderkey", F.concat("b", last).alias("value"))
    return rows.select("o_orderkey", "value", S.digit_type(F.col("value")).alias("digit_type"))


@query(
    """WITH v AS (SELECT o_orderkey, '1' || lpad(((o_orderkey * 7654321) % 10000000000)::VARCHAR, 10, '0') AS v FROM orders)
SELECT o_orderkey, v AS value, CASE WHEN len(list_distinct(string_split(v, ''))) < 3 THEN '' WHEN regexp_matches(v, '^1([0-2][0-9]{9}|4[0-4][0-9]{8})$') THEN 'reject' ELSE 'phone' END AS digit_type FROM v"""
)
def phone_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _digits(spark, sf_dir, 10, 7654321).select("o_orderkey", F.concat(F.lit("1"), "v").alias("value"))
    return rows.select("o_orderkey", "value", S.digit_type(F.col("value")).alias("digit_type"))


@query("SELECT o_orderkey, substr(md5(o_orderkey::VARCHAR), 1, 24) AS value, cast('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8) AS BIGINT) BETWEEN 1426063360 AND 1771674009 AS object_id FROM orders")
def objectid_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 24)
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("value")).select("o_orderkey", "value", S.is_object_id(F.col("value")).alias("object_id"))


_HEX = "md5(c_custkey::VARCHAR)"


@query(
    f"""WITH h AS (SELECT c_custkey, {_HEX} AS m, c_custkey % 6 AS k FROM customer),
v AS (SELECT c_custkey, k, m, CASE k WHEN 0 THEN substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) WHEN 1 THEN m
  WHEN 2 THEN substr(m, 1, 2) || ':' || substr(m, 3, 2) || ':' || substr(m, 5, 2) || ':' || substr(m, 7, 2) || ':' || substr(m, 9, 2) || ':' || substr(m, 11, 2) WHEN 3 THEN substr(m, 1, 16) WHEN 4 THEN 'o' || substr(m, 1, 27) ELSE 'wx' || substr(m, 1, 16) END AS v FROM h)
SELECT c_custkey, v AS value, k = 0 AS uuid, k = 2 AS mac, k = 2 AND regexp_matches(v, '^.[13579bdf]') AS multicast, k = 1 AND len(list_distinct(string_split(v, ''))) >= 4 AS hex_token, k = 4 AS openid, k = 5 AS app_id,
  k = 3 AND len(list_distinct(string_split(v, ''))) >= 3 AS android_id FROM v"""
)
def value_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = F.md5(F.col("c_custkey").cast("string").cast("binary")), F.col("c_custkey") % 6
    sub = lambda a, n: F.substring(m, a, n)
    value = (
        F.when(k == 0, F.concat_ws("-", sub(1, 8), sub(9, 4), sub(13, 4), sub(17, 4), sub(21, 12))).when(k == 1, m)
        .when(k == 2, F.concat_ws(":", *[sub(i, 2) for i in range(1, 12, 2)])).when(k == 3, sub(1, 16)).when(k == 4, F.concat(F.lit("o"), sub(1, 27))).otherwise(F.concat(F.lit("wx"), sub(1, 16)))
    )
    v = F.col("value")
    return table(spark, sf_dir, "customer").select("c_custkey", value.alias("value")).select(
        "c_custkey", "value", S.is_uuid(v).alias("uuid"), S.is_mac(v).alias("mac"), S.is_multicast_mac(v).alias("multicast"), S.is_hex_token(v).alias("hex_token"), S.is_openid(v).alias("openid"), S.is_app_id(v).alias("app_id"), S.is_android_id(v).alias("android_id")
    )


# --- URLs ---------------------------------------------------------------------------------------------------

_URL_CASE = "CASE WHEN " + _ends_any("low", R.STATIC_EXTENSIONS) + " THEN 'server_url_static' " + " ".join(f"WHEN contains(low, '{w}') THEN '{s}'" for w, s in R.URL_WORDS) + " ELSE 'server_url_api_plain' END"


@query(
    f"""WITH u AS (SELECT page_id, url, lower(regexp_replace(url, '^[a-z]+://', '')) AS low, regexp_replace(url, '^[a-z]+://', '') AS rest FROM pages),
q AS (SELECT page_id, unnest(string_split(split_part(rest, '?', 2), '&')) AS p FROM u WHERE length(rest) - length(replace(rest, '?', '')) = 1 AND contains(split_part(rest, '?', 2), '='))
SELECT page_id, {_URL_CASE} AS slug, url AS value FROM u
UNION ALL SELECT page_id, 'pii_noise' AS slug, split_part(p, '=', 2) AS value FROM q WHERE regexp_matches(p, '^[^=]+=[0-9][^=]*$')"""
)
def url_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(K.url_rows(F.col("url"))).alias("f")).select("page_id", F.col("f.slug").alias("slug"), F.col("f.value").alias("value"))


@query(
    """WITH q AS (SELECT page_id, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS p FROM pages WHERE contains(url, '?'))
SELECT split_part(p, '=', 1) AS key, split_part(p, '=', 2) AS value, count(*) AS n FROM q WHERE contains(p, '=') GROUP BY ALL"""
)
def url_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "pages").filter(F.col("url").contains("?")).select(F.explode(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")).alias("p")).filter(F.col("p").contains("="))
    return parts.groupBy(F.substring_index("p", "=", 1).alias("key"), F.substring_index(F.substring_index("p", "=", 2), "=", -1).alias("value")).agg(F.count("*").alias("n"))


@query(
    """WITH h AS (SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'b' || s_suppkey || '.oss-cn-hangzhou.aliyuncs.com' WHEN 1 THEN 'b' || s_suppkey || '-1317426693.cos.ap-shanghai.myqcloud.com' WHEN 2 THEN 'b' || s_suppkey || '.s3.us-east-1.amazonaws.com'
  WHEN 3 THEN 'dashscope.aliyuncs.com' WHEN 4 THEN 'img' || s_suppkey || '.alicdn.com' WHEN 5 THEN 'b' || s_suppkey || '.cdn.bcebos.com' WHEN 6 THEN 'b' || s_suppkey || '.bj.bcebos.com' ELSE 's3.bitiful.net' END AS host FROM supplier)
SELECT s_suppkey, host, s_suppkey % 8 IN (0, 1, 2, 5, 7) AS storage FROM h"""
)
def url_hosts_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, b = F.col("s_suppkey") % 8, F.concat(F.lit("b"), F.col("s_suppkey").cast("string"))
    forms = ["{}.oss-cn-hangzhou.aliyuncs.com", "{}-1317426693.cos.ap-shanghai.myqcloud.com", "{}.s3.us-east-1.amazonaws.com", "dashscope.aliyuncs.com", "img", "{}.cdn.bcebos.com", "{}.bj.bcebos.com", "s3.bitiful.net"]
    host = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        made = F.concat(F.lit("img"), F.col("s_suppkey").cast("string"), F.lit(".alicdn.com")) if form == "img" else F.concat(b, F.lit(form[2:])) if form.startswith("{}") else F.lit(form)
        host = F.when(k == i, made).otherwise(host)
    return table(spark, sf_dir, "supplier").select("s_suppkey", host.alias("host")).select("s_suppkey", "host", S.is_storage_host(F.col("host")).alias("storage"))


# --- formats --------------------------------------------------------------------------------------------------


@query("SELECT a AS attribute, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<[a-z0-9]+ ([a-z-]+)=\"[^\"]*\"', 1)) AS a FROM pages) GROUP BY a")
def html_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<[a-z0-9]+ ([a-z-]+)="[^"]*"'), F.lit(1))).alias("attribute"))
    return found.groupBy("attribute").agg(F.count("*").alias("n"))


def _files(df: DataFrame, key: str, content: Column, ext: str) -> DataFrame:
    return df.select(F.lit("tables").alias("pkg"), F.col(key).cast("string").alias("file"), F.lit(ext).alias("ext"), content.alias("content"))


@query()
def html_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(_files(table(spark, sf_dir, "pages"), "page_id", F.col("html"), "html")).filter("value is not null")
    return found.groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@query("""SELECT cast(page_id AS VARCHAR) AS file, '</p>' AS value FROM pages WHERE false UNION ALL SELECT cast(page_id AS VARCHAR), 'utf-8' FROM pages WHERE contains(html, 'charset="utf-8"')""")
def html_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(_files(table(spark, sf_dir, "pages"), "page_id", F.col("html"), "html"))
    return found.filter("src = 'html-attr' and value = 'utf-8'").select("file", "value").distinct()


@query(
    """WITH v AS (SELECT c_custkey, c_name AS value, 'c_name: "' || c_name || '"' AS stmt FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 'c_mktsegment: "' || c_mktsegment || '"' FROM customer WHERE c_mktsegment <> c_name)
SELECT c_custkey::VARCHAR AS file, value, stmt FROM v WHERE length(value) > 4"""
)
def json_string_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    return extract(_files(table(spark, sf_dir, "customer"), "c_custkey", content, "json")).filter("value is not null").select("file", "value", "stmt")


@query("SELECT count(*) AS n_files, 0::BIGINT AS n_constants FROM events")
def json_props_no_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(_files(table(spark, sf_dir, "events"), "event_id", F.col("props"), "json"))
    return found.agg(F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).alias("n_files"), F.count("value").alias("n_constants"))


@query(
    """SELECT p_partkey::VARCHAR AS file, 'wxss' AS src, unnest(['/img/' || p_partkey || '.png', p_brand]) AS value, 'background: url("/img/' || p_partkey || '.png"); ' || 'content: ' || chr(39) || p_brand || chr(39) || ';' AS stmt FROM part WHERE false
UNION ALL SELECT p_partkey::VARCHAR, 'wxss', '/img/' || p_partkey || '.png', '.a { background: url("/img/' || p_partkey || '.png");' FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'wxss', p_brand, 'content: ' || chr(39) || p_brand || chr(39) || '; }' FROM part WHERE length(p_brand) > 4"""
)
def wxss_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    content = F.concat(F.lit('/* "none" */ .a { background: url("/img/'), k, F.lit('.png");\n content: \''), F.col("p_brand"), F.lit("'; }\n"))
    return extract(_files(table(spark, sf_dir, "part"), "p_partkey", content, "wxss")).filter("value is not null").select("file", "src", "value", "stmt")


@query(
    """WITH v AS (SELECT p_partkey, unnest([p_name, p_type, p_brand]) AS value, unnest(['const name' || p_partkey || ' = "' || p_name || '"', 'type: ' || chr(39) || p_type || chr(39), 'brand = `' || p_brand || '`']) AS stmt FROM part)
SELECT p_partkey::VARCHAR AS file, value, stmt FROM v WHERE length(value) > 4"""
)
def js_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    content = F.concat(F.lit("// \"comment\"\nconst name"), k, F.lit(' = "'), F.col("p_name"), F.lit("\";\nvar o = { type: '"), F.col("p_type"), F.lit("' };\nbrand = `"), F.col("p_brand"), F.lit("`;\nvar re = /\"[\"/]/g;\n"))
    return extract(_files(table(spark, sf_dir, "part"), "p_partkey", content, "js")).filter("value is not null").select("file", "value", "stmt")


@query(
    """WITH p AS (SELECT p_partkey::VARCHAR AS k, md5(p_partkey::VARCHAR) AS m FROM part)
SELECT k AS file, 'js-regex' AS src, unnest(['https://h' || k || '.acme.cn/a', '/api/v1/' || k, m, 'plain words ' || k]) AS value FROM p UNION ALL SELECT k, 'js-ast', 'words of ' || k FROM p"""
)
def js_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script with a comment that nothing ends: what the scan reads before it, and what patterns find besides, named or of a known kind."""
    k = F.col("p_partkey").cast("string")
    content = F.concat(
        F.lit("var first = 'words of "), k, F.lit("';\nvar late /* is open\n, late = \"plain words "), k, F.lit('";\nfunction f(x) {\n  y("https:\\/\\/h'), k, F.lit(".acme.cn/a\", '/api/v1/"), k, F.lit("', `"), F.md5(k.cast("binary")),
        F.lit("`, 'no kind at all', { key: \"nor this one\" })\n"),
    )
    return extract(_files(table(spark, sf_dir, "part"), "p_partkey", content, "js")).filter("value is not null").select("file", "src", "value").distinct()


_FALLBACK_FORMS = (
    "'https://h' || k || '.acme.cn/a?b=' || m", "'/api/v' || k || '/list?x=1&y=2'", "'./img/' || k || '.png'", "'pages/a' || k || '/index'", "'/0/' || k", "'lib/node_modules/x' || k", "'wx' || substr(m, 1, 16)",
    "'eyJ' || m || '.' || m || '.' || m", "'AKID' || m", "'ghp_' || m", "'Bearer ' || m", "'AIza' || m || 'abc'", "'ABCDE-12345-ABCDE-12345-ABCDE-1' || substr(upper(m), 1, 4)", "'-----BEGIN KEY-----' || chr(10) || m",
    "'MIG' || m || m || '=='", "m", "'00000000000000000000000000000000'", "'a' || k || '@b.cn'", "'10.0.' || (o_orderkey % 256) || '.7:8080'", "'138' || lpad((o_orderkey % 100000000)::VARCHAR, 8, '0')",
    "'1101011990' || lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') || 'X'", "'two words ' || k", "m || chr(10)", "'line' || chr(10) || '/a/b'", "'abc'",
)


def _fallback_sql() -> str:
    cases = []
    for kind, pattern in R.FALLBACK_RULES:
        hit = f"regexp_full_match(v, '{pattern.replace('(?!/)', '').replace(chr(39), chr(39) * 2)}')"
        if kind != "pem":
            hit += " AND NOT regexp_matches(v, '[\\r\\n]')"
        if kind in R.FALLBACK_PATHS:
            hit += " AND regexp_matches(v, '[A-Za-z]')"
        if kind in R.FALLBACK_VARIED:
            hit += f" AND len(list_distinct(string_split(v, ''))) >= {R.FALLBACK_LEAST_VARIED}"
        result = f"CASE WHEN list_has_any(string_split(split_part(v, '?', 1), '/'), [{_list(R.THIRD_PARTY_FOLDERS)}]) THEN NULL ELSE '{kind}' END" if kind in R.FALLBACK_PATHS else f"'{kind}'"
        cases.append(f"WHEN {hit} THEN {result}")
    values = " UNION ALL ".join(f"SELECT {form} AS value FROM o" for form in _FALLBACK_FORMS)
    return f"""WITH o AS (SELECT o_orderkey, o_orderkey::VARCHAR AS k, md5(o_orderkey::VARCHAR) AS m FROM orders), {WORDS},
a AS ({values} UNION ALL SELECT url FROM pages WHERE url IS NOT NULL UNION ALL SELECT w FROM w), t AS (SELECT value, regexp_replace(regexp_replace(value, '^[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\pZ]+', ''), '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\pZ]+$', '') AS v FROM a),
k AS (SELECT value, CASE WHEN length(v) < {R.FALLBACK_LEAST_LENGTH} THEN NULL {" ".join(cases)} END AS kind FROM t)
SELECT coalesce(kind, 'none') AS kind, count(*) AS n, min(value) AS smallest, max(value) AS largest FROM k GROUP BY 1"""


def fallback_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of values made from order keys, of urls and of the documents' words."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_orderkey as string) as k", "md5(cast(cast(o_orderkey as string) as binary)) as m")
    forms = [F.expr(re.sub(r"\((o_orderkey[^()]*)\)::VARCHAR|\((o_orderkey[^()]*)\)", r"cast((\1\2) as string)", form)) for form in _FALLBACK_FORMS]
    values = o.select(F.explode(F.array(*forms)).alias("value")).unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("value")).filter("value is not null"))
    values = values.unionByName(words(spark, sf_dir).select(F.col("w").alias("value")))
    kind = F.coalesce(S.fallback_kind(F.col("value")), F.lit("none"))
    return values.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("value").alias("smallest"), F.max("value").alias("largest"))


def _page_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, brand = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand")
    content = F.concat(
        F.lit("<!doctype html><body><div title='"), brand, F.lit("' data-x='{{bound}}'><p>"), name, F.lit(" &amp; more<br>after "), k, F.lit("</p>{{ bound }}</div><script>// 'comment'\nvar a = \""), F.col("p_type"),
        F.lit("\", b = 'it\\'s "), k, F.lit("';\n/* \"gone away\" */ c = `left ${f('inner text')} right"), k, F.lit("`;\n</script><style>p{content:'nothing'}</style></body>"),
    )
    return extract(_files(table(spark, sf_dir, "part"), "p_partkey", content, "html")).filter("value is not null")


@query(
    """WITH p AS (SELECT p_partkey::VARCHAR AS k, p_type AS t FROM part), l AS (SELECT k, 'var a = "' || t || '", b = ' || chr(39) || 'it' || chr(92) || chr(39) || 's ' || k || chr(39) || ';' AS one, '/* "gone away" */ c = `left ${f(' || chr(39) || 'inner text' || chr(39) || ')} right' || k || '`;' AS two, t FROM p),
v AS (SELECT k AS file, unnest([t, 'it' || chr(39) || 's ' || k, 'left', 'right' || k]) AS value, unnest([one, one, two, two]) AS stmt FROM l)
SELECT file, value, stmt FROM v WHERE length(value) > 4"""
)
def html_script_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_of(spark, sf_dir).filter("src = 'html-script'").select("file", "value", "stmt")


@query(
    """WITH p AS (SELECT p_partkey::VARCHAR AS k, p_name AS n FROM part), v AS (SELECT k AS file, unnest([n || ' & more', 'after ' || k]) AS value, unnest(['<p>' || n || ' & more</p>', '<br>after ' || k || '</br>']) AS stmt FROM p)
SELECT file, value, stmt FROM v WHERE length(value) > 4"""
)
def html_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_of(spark, sf_dir).filter("src = 'html-text'").select("file", "value", "stmt")


@query(
    """WITH p AS (SELECT p_partkey, p_partkey::VARCHAR AS k, p_name AS n, p_brand AS b FROM part),
v AS (SELECT k AS file, unnest(['wxml-attr', 'wxml-attr', 'wxml-text', 'wxml-attr']) AS src, unnest([b, 'onTap' || k, n || ' & co', '/img/' || k || '.png']) AS value,
  unnest(['<view data-b="' || b || '">', '<text bind:tap="onTap' || k || '">', '<text>' || n || ' & co</text>', '<image src="/img/' || k || '.png">']) AS stmt FROM p
  UNION ALL SELECT k, 'wxml-text', 'tail ' || k || ' text', CASE WHEN p_partkey % 3 = 2 THEN '<view>tail ' || k || ' text</view>' END FROM p WHERE p_partkey % 3 = 2)
SELECT file, src, value, stmt FROM v WHERE length(value) > 4"""
)
def wxml_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup with bindings, bare ampersands and attributes without a value: one root, several, and (each third) not well formed,
    where text after a child is read too."""
    k, r = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    view = F.concat(
        F.lit("<view wx:if=\"{{a < b && c}}\" data-b=\""), F.col("p_brand"), F.lit("\" hidden>{{ x > y }}<text bind:tap='onTap"), k, F.lit("'>"), F.col("p_name"), F.lit(" & co</text> tail "), k, F.lit(" text <image src='/img/"),
        k, F.lit(".png'/>"),
    )
    content = F.concat(F.lit("<!-- \"none\" -->\n"), view, F.lit("</view>"), F.when(r == 1, "<view/>").when(r == 2, "</block><a:b>").otherwise(""))
    return extract(_files(table(spark, sf_dir, "part"), "p_partkey", content, "wxml")).filter("value is not null").select("file", "src", "value", "stmt")


@query(
    """WITH p AS (SELECT p_partkey, p_partkey::VARCHAR AS k, p_name AS n, md5(p_partkey::VARCHAR) AS m FROM part),
v AS (SELECT k AS file, unnest([n, 'tail' || k]) AS value, unnest(['name: "' || n || '"', 'b = `${x}tail' || k || '`']) AS stmt FROM p WHERE p_partkey % 2 = 0 UNION ALL SELECT k, m, 'hash: "' || m || '"' FROM p WHERE p_partkey % 2 = 0
UNION ALL SELECT k, m, 'var a = { name: "' || n || '", hash: "' || m || '" }, b = `${x}tail' || k || '`; it' || chr(39) || 's' FROM p WHERE p_partkey % 2 = 1)
SELECT file, value, stmt FROM v WHERE length(value) > 4"""
)
def wxs_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View scripts; every other one doesn't parse, and keeps only values of a known kind with their lines."""
    k = F.col("p_partkey").cast("string")
    content = F.concat(F.lit('var a = { name: "'), F.col("p_name"), F.lit('", hash: "'), F.md5(k.cast("binary")), F.lit('" }, b = `${x}tail'), k, F.lit("`;"), F.when(F.col("p_partkey") % 2 == 1, " it's").otherwise(""))
    found = extract(_files(table(spark, sf_dir, "part"), "p_partkey", content, "wxs")).filter("value is not null")
    # of a broken script the pattern for named literals gives a second statement for the same value
    return found.filter("stmt not like 'hash:%' or cast(file as int) % 2 = 0").select("file", "value", "stmt")


# --- the noise filter -----------------------------------------------------------------------------------------


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of the documents. Texts are taken apart and words folded before the shuffle."""
    return table(spark, sf_dir, "documents").select(F.explode(F.split(F.col("text"), r"[ \t\n]+")).alias("w")).filter("w != ''").distinct()


WORDS = "w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n]+')) AS w FROM documents) WHERE w <> '')"


query(_fallback_sql())(fallback_kind)


@query(f"WITH {WORDS} SELECT count(*) AS n, count(*) FILTER (length(w) > 4) AS over_4, count(*) FILTER (length(w) > 6) AS over_6, max(length(w)) AS longest FROM w")
def length_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("w")
    return words(spark, sf_dir).agg(F.count("*").alias("n"), F.count(F.when(n > 4, 1)).alias("over_4"), F.count(F.when(n > 6, 1)).alias("over_6"), F.max(n).alias("longest"))


_UNWANTED = f"""CASE WHEN regexp_matches(w, '[''"`<>()\\[\\]{{}}]') THEN true
 WHEN regexp_matches(w, '[^\\x00-\\x7F\\x{{3000}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{FF00}}-\\x{{FFEF}}]') OR length(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) < 6 THEN true
 WHEN regexp_full_match(w, '[0-9]{{1,5}}') THEN true WHEN regexp_full_match(w, '[0-9]{{6}}') THEN regexp_full_match(w, '[0-9]{{2}}[0-2][0-9][0-2][0-9]')
 ELSE w IN ({_list(R.HOT_WORDS)}) OR {_starts_any('w', R.NOISE_PREFIXES)} OR ends_with(w, 'rpx') OR regexp_full_match(w, '#[0-9a-fA-F]{{3,8}}') OR regexp_full_match(w, 'sha(256|384|512)-[A-Za-z0-9+/]+=*')
 OR (regexp_full_match(w, '\\pL+') AND regexp_matches(w, '\\p{{Lu}}') AND regexp_matches(w, '\\p{{Ll}}')) OR lower(w) IN ({_list(R.HTML_STOP_WORDS + R.UI_STOP_WORDS + R.JS_STOP_WORDS)}) OR regexp_full_match(w, '[0-9a-f]{{8}}-[0-9]+-?') END"""


@query(f"WITH {WORDS} SELECT length(w) AS n_chars, {_UNWANTED} AS unwanted, count(*) AS n FROM w GROUP BY ALL")
def noise_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy(F.length("w").alias("n_chars"), N.is_unwanted(F.col("w")).alias("unwanted")).agg(F.count("*").alias("n"))


@query(f"WITH {WORDS}, e AS (SELECT w, list_entropy(string_split(w, '')) AS e FROM w) SELECT length(w) AS n_chars, count(*) AS n, round(min(e), 6) AS least, round(max(e), 6) AS most FROM e GROUP BY 1")
def word_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words(spark, sf_dir).select("w", S.entropy(F.col("w")).alias("e"))
    return rows.groupBy(F.length("w").alias("n_chars")).agg(F.count("*").alias("n"), F.round(F.min("e"), 6).alias("least"), F.round(F.max("e"), 6).alias("most"))


@query(
    f"""WITH {WORDS} SELECT CASE WHEN len(list_intersect(regexp_split_to_array(lower(w), '[\\s._-]+'), [{_list(R.TIME_DATE_NOISE)}])) > 0 THEN 'FILTER: UI/Noise'
 WHEN regexp_full_match(w, '[a-z]+(-[a-z0-9]+)+') OR (contains(w, '__') AND NOT regexp_matches(w, '\\p{{Lu}}')) THEN 'FILTER: CSS Class' WHEN contains(w, '://') THEN '!!! URI: Service Scheme'
 WHEN regexp_full_match(w, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') THEN '!!! IP: Internal/Ext' WHEN regexp_full_match(w, '[0-9]{{13,}}') THEN '!!! DATA: Long ID/Num'
 WHEN regexp_matches(w, '[0-9]') AND regexp_matches(w, '[^a-zA-Z0-9\\s]') AND NOT regexp_matches(w, '[a-zA-Z]') AND NOT regexp_full_match(w, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') THEN '!!! PASS: Digit+Symbol'
 WHEN regexp_full_match(w, '[0-9a-fA-F]{{15,}}') THEN '!!! KEY: Hex Token' WHEN regexp_matches(w, '[a-zA-Z]') AND regexp_matches(w, '[0-9]') THEN '!!! PASS: AlphaNumeric'
 WHEN regexp_full_match(w, '[a-zA-Z\\s]{{4,}}') AND regexp_matches(w, '[a-zA-Z]') THEN '!!! SUSPECT: Unknown Alpha' ELSE 'IGNORE: Low Value' END AS decision, count(*) AS n FROM w GROUP BY 1"""
)
def smart_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy(N.smart_decision(F.col("w")).alias("decision")).agg(F.count("*").alias("n"))


@query(
    f"""WITH d AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part), v AS (SELECT DISTINCT replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '-' ELSE '.' END) || CASE p_partkey % 5 WHEN 0 THEN 's' WHEN 1 THEN '_jan_7' WHEN 2 THEN '_btn' WHEN 3 THEN '_qxz' ELSE '' END AS value FROM part),
p AS (SELECT value, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(value, '[-_.]', ' ', 'g')), '\\s+'), lambda w: w <> '')) AS part FROM v),
k AS (SELECT value, part IN (SELECT word FROM d) OR (ends_with(part, 's') AND (substr(part, 1, length(part) - 1) IN (SELECT word FROM d) OR substr(part, 1, length(part) - 1) IN ({_list(R.TIME_DATE_NOISE)}))) OR part IN ({_list(R.TIME_DATE_NOISE)}) OR part IN ({_list(R.CSS_STEMS)}) OR regexp_full_match(part, '[0-9]+') AS ok FROM p)
SELECT value, bool_and(ok) AS composed FROM k GROUP BY value"""
)
def word_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of the parts' words against those words as the dictionary."""
    parts = table(spark, sf_dir, "part")
    r, t = F.col("p_partkey") % 3, F.col("p_partkey") % 5
    end = F.when(t == 0, "s").when(t == 1, "_jan_7").when(t == 2, "_btn").when(t == 3, "_qxz").otherwise("")
    value = F.concat(F.replace("p_name", F.lit(" "), F.when(r == 0, "_").when(r == 1, "-").otherwise(".")), end)
    return N.composed_of_words(parts.select(value.alias("value")), parts.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")))


@query(
    """WITH n AS (SELECT p_partkey, replace(p_type, ' ', '') || '_' || p_brand AS name FROM part),
s AS (SELECT p_partkey, name, regexp_replace(regexp_replace(regexp_replace(name, '(.)([A-Z][a-z]+)', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[-_.]', ' ', 'g') AS s FROM n)
SELECT p_partkey, name, array_to_string(list_filter(regexp_split_to_array(lower(s), '\\s+'), lambda x: x <> ''), ' ') AS parts FROM s"""
)
def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.replace("p_type", F.lit(" "), F.lit("")), F.lit("_"), F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", "name", F.array_join(N.split_words(F.col("name")), " ").alias("parts"))


_GAPS = """g AS (SELECT event_type, user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS gap FROM events),
t AS (SELECT event_type, user_id, count(*) AS n, CASE WHEN count(*) < 3 OR count(gap) FILTER (gap > 0) = 0 THEN 30 ELSE least(120, greatest(10, round_even(median(gap) FILTER (gap > 0) * 1.5, 0)))::INT END AS threshold FROM g GROUP BY 1, 2)"""


def _event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))


@query(f"WITH {_GAPS} SELECT event_type, user_id, n, threshold FROM t")
def near_dup_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_ids(spark, sf_dir).select("event_type", "user_id", F.size("ids").alias("n"), N.near_threshold(F.col("ids")).cast("int").alias("threshold"))


@query(
    f"""WITH RECURSIVE {_GAPS}, l AS (SELECT event_type, user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1, 2),
k(event_type, user_id, ids, threshold, e) AS (SELECT l.event_type, l.user_id, ids, threshold, ids[1] FROM l JOIN t ON t.event_type = l.event_type AND t.user_id = l.user_id
 UNION ALL SELECT event_type, user_id, ids, threshold, list_filter(ids, lambda x: x - e > threshold)[1] FROM k WHERE len(list_filter(ids, lambda x: x - e > threshold)) > 0)
SELECT event_type, user_id, count(*) AS kept, sum(e)::BIGINT AS sum_ids FROM k GROUP BY 1, 2"""
)
def near_dup_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_ids(spark, sf_dir).withColumn("t", N.near_threshold(F.col("ids")))
    return rows.select("event_type", "user_id", F.explode(N.far_enough(F.col("ids"), F.col("t"))).alias("e")).groupBy("event_type", "user_id").agg(F.count("*").alias("kept"), F.sum("e").alias("sum_ids"))


@query(
    """WITH l AS (SELECT user_id % 50 AS bucket, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1),
i AS (SELECT DISTINCT bucket, CASE WHEN len(ids) <= 25 THEN k ELSE round_even(k * (len(ids) - 1) / 24.0, 0)::BIGINT END AS spot, ids FROM l, range(0, 25) AS r(k) WHERE k < len(ids))
SELECT bucket, ids[spot + 1] AS event_id FROM i"""
)
def even_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("bucket")).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return ids.select("bucket", F.explode(N.evenly(F.col("ids"))).alias("event_id"))


# --- the store ------------------------------------------------------------------------------------------------

def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents as findings of the app that the source names."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("pkg"), F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", r"[ \t\n]+")).alias("pos", "value"))
    return docs.filter("value != ''").select("pkg", "file", "pos", "value", F.lit(9901).alias("type_id"), F.lit("text").alias("src"), F.col("value").alias("context"))


_LONG = "o AS (SELECT source AS appid, doc_id::VARCHAR AS source_file, w AS value FROM (SELECT source, doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n]+')) AS w FROM documents) WHERE w <> '')"


@query(f"WITH {_LONG} SELECT sha256(value) AS hash_sha256, 9901 AS type_id, min(value) AS raw_value, count(*) - 1 AS ref_count FROM o GROUP BY value")
def dedupe_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.items_of(_occurrences(spark, sf_dir))


@query(f"WITH {_LONG} SELECT appid, count(*) AS n, count(DISTINCT value) AS n_items, count(DISTINCT source_file) AS n_files FROM o GROUP BY appid")
def occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _occurrences(spark, sf_dir)
    joined = D.occurrences_of(found).join(D.items_of(found), "hash_sha256")
    return joined.groupBy("appid").agg(F.count("*").alias("n"), F.countDistinct("hash_sha256").alias("n_items"), F.countDistinct("source_file").alias("n_files"))


@query(
    f"""WITH {_LONG}, i AS (SELECT value, count(*) AS n FROM o GROUP BY value), top AS (SELECT value FROM i ORDER BY n DESC, value LIMIT 1), {TYPE_TABLE}
SELECT o.appid, o.source_file, sha256(o.value) AS hash_sha256, 'other' AS slug, row_number() OVER (ORDER BY o.appid, o.source_file) AS place FROM o JOIN top USING (value) QUALIFY place <= 10"""
)
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest item, with its type and first ten occurrences."""
    found = _occurrences(spark, sf_dir)
    items = D.items_of(found)
    best = items.orderBy(F.desc("ref_count"), "raw_value").limit(1).join(F.broadcast(type_dimension(spark)), "type_id", "left").select("hash_sha256", "slug")
    where = D.occurrences_of(found).join(F.broadcast(best), "hash_sha256").select("appid", "source_file", "hash_sha256", "slug").orderBy("appid", "source_file").limit(10)
    return where.withColumn("place", F.row_number().over(W.Window.orderBy("appid", "source_file")))


@query("SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").join(done, "doc_id", "left_anti").select("doc_id", "source")


@query(
    f"""WITH {TYPE_TABLE}, v AS (SELECT o_orderkey, md5((o_orderkey % 100)::VARCHAR) || substr(md5('x' || (o_orderkey % 100)::VARCHAR), 1, 8) AS token, 'https://api' || (o_orderkey % 40) || '.acme.cn/oauth/login' AS url FROM orders),
u AS (SELECT token AS value, 'server_cred_token' AS slug FROM v UNION ALL SELECT url, 'server_url_auth' FROM v)
SELECT sha256(value) AS hash_sha256, any_value(type_id) AS type_id, value AS raw_value, count(*) - 1 AS ref_count FROM u JOIN types USING (slug) GROUP BY value"""
)
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script from every order, read as a stream in several batches into a store, whose items come back merged."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    k, t = F.col("o_orderkey"), (F.col("o_orderkey") % 100).cast("string")
    token = F.concat(F.md5(t.cast("binary")), F.substring(F.md5(F.concat(F.lit("x"), t).cast("binary")), 1, 8))
    content = F.concat(F.lit('var token = "'), token, F.lit('", url = "https://api'), (k % 40).cast("string"), F.lit('.acme.cn/oauth/login";'))
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("app"), (k % 20).cast("string")).alias("pkg"), F.concat(k.cast("string"), F.lit(".js")).alias("file"), F.lit("js").alias("ext"), content.alias("content"))
    # small row groups: a batch of two large files is read by more than two tasks
    files.repartition(4).write.option("parquet.block.size", 4 << 20).parquet(f"{base}/files")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/files")
    start_stream(stream, f"{base}/store").awaitTermination()
    return read_items(spark, f"{base}/store")


_STATUS = "CASE event_id % 11 WHEN 3 THEN 'aborted' WHEN 5 THEN 'timeout' WHEN 7 THEN 'error:commit_failed' WHEN 8 THEN 'empty' ELSE 'ok' END"
_RESULTS = f"e AS (SELECT 'p' || (user_id % 40) AS pkg, event_type AS rel_path, event_id AS seq, {_STATUS} AS status FROM events)"
_MERGED = f"m AS (SELECT pkg, rel_path, coalesce(arg_min(status, seq) FILTER (status IN ({_list(R.INFRA_STATUSES)})), arg_min(status, seq)) AS status FROM e GROUP BY 1, 2)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 11
    status = F.when(k == 3, "aborted").when(k == 5, "timeout").when(k == 7, "error:commit_failed").when(k == 8, "empty").otherwise("ok")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("pkg"), F.col("event_type").alias("rel_path"), F.col("event_id").alias("seq"), status.alias("status"))


@query(f"WITH {_RESULTS}, {_MERGED} SELECT pkg, rel_path, status FROM m")
def ledger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.merge_statuses(_results(spark, sf_dir)).select("pkg", "rel_path", "status")


@query(f"WITH {_RESULTS}, {_MERGED}, d AS (SELECT pkg, count(DISTINCT rel_path) AS n FROM e GROUP BY 1) SELECT d.pkg, (count(m.status) = any_value(d.n)) AND NOT bool_or(m.status IN ({_list(R.INFRA_STATUSES)})) AS completed FROM d LEFT JOIN m ON m.pkg = d.pkg GROUP BY d.pkg")
def ledger_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _results(spark, sf_dir)
    dispatched = results.groupBy("pkg").agg(F.countDistinct("rel_path").alias("n"))
    return D.completed_packages(D.merge_statuses(results), dispatched)


@query(f"WITH {_RESULTS}, {_MERGED} SELECT status, CASE WHEN status IN ({_list(R.INFRA_STATUSES)}) THEN 'infra' WHEN status = 'timeout' THEN 'file' ELSE 'none' END AS kind, count(*) AS n FROM m GROUP BY ALL")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = D.merge_statuses(_results(spark, sf_dir))
    kinds = D.failures(statuses).select("pkg", "rel_path", "kind")
    return statuses.join(kinds, ["pkg", "rel_path"], "left").groupBy("status", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN strlen(t) <= 400 THEN t ELSE substr(t, 1, 400) END AS capped FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS t FROM documents)")
def byte_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_text = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    return table(spark, sf_dir, "documents").select("doc_id", D.cap_bytes(ascii_text, 400).alias("capped"))


@query(f"WITH {TYPE_TABLE} SELECT type_id, slug, category, risk_level FROM types")
def taxonomy_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types again, from nested groups whose items inherit the group's commonest risk."""
    rows = type_dimension(spark)
    start = (F.col("type_id") / 100).cast("int") * 100
    risk = rows.groupBy("category").agg(F.mode("risk_level", True).alias("default_risk"))
    items = rows.join(risk, "category").withColumn("own", F.when(F.col("risk_level") != F.col("default_risk"), F.col("risk_level")))
    groups = items.groupBy(start.alias("start_index"), "category", "default_risk").agg(F.array_sort(F.collect_list(F.struct("type_id", "slug", F.col("own").alias("risk")))).alias("items"))
    return expand_groups(groups)


# --- the chain ------------------------------------------------------------------------------------------------

#: (remainder, value, statement, slug) of constants made from an order key; {m} is its md5, {k} the key, " stands for a quote.
SUITE = [
    ("{m}{m8}", 'token: "{v}"', "server_cred_token"),
    ("{m}{m8}", 'id: "{v}", token', None),
    ("https://api{k}.acme.cn/oauth/login", 'url: "{v}"', "server_url_auth"),
    ("https://api{k}.acme.cn/v1/list", 'url: "{v}"', "server_url_api_plain"),
    ("http://192.168.1.7:8080/x{k}", 'url: "{v}"', "backend_ip_private"),
    ("https://b{k}.oss-cn-hangzhou.aliyuncs.com/a.webp", 'url: "{v}"', "cloud_storage_path"),
    ("pages/user/index{k}", 'navigateTo("{v}")', "miniapp_page_path"),
    ("/pages/admin/index{k}", 'navigateTo("{v}")', "miniapp_page_path_sensitive"),
    ("/components/loading{k}", 'load("{v}")', "miniapp_path_module"),
    ("/common/getDictData{k}", 'request("{v}")', "miniapp_api_params"),
    ("user{k}@mail.acme.com", 'email: "{v}"', "pii_email_name"),
    ("user{k}@mail.example.com", 'email: "{v}"', "pii_noise"),
    ("plugin://my{k}/hello", 'open("{v}")', "miniapp_plugin_url"),
    ("data:image/gif;base64,{m}", 'src: "{v}"', "encoding_base64"),
    ("wx{m16}", 'appid: "{v}"', "miniapp_noise"),
    ("npm_{m}{m4}", 'run("{v}")', "cloud_cred_token"),
    ("cn-hangzhou-{k}", 'place: "{v}"', "cloud_region"),
    ("data-v-{m8}", 'el("{v}")', None),
    ("x-trace-{k9}", 'head("{v}")', None),
    ("eyJhbGciOi{m}.eyJ{k}.sig", 'call("{v}")', "platform_access_token"),
    ("o{m27}", 'who("{v}")', "id_user_identifier"),
]
#: The same for every other gate: what it takes, and what is near to that.
GATES = [
    ("data-{m8}", 'el("{v}")', None),
    ("&b{k}=", 'x("{v}")', None),
    ("&b{k}", 'x("{v}")', "other"),
    (";h{m8}", 'x("{v}")', None),
    ("@@{m8}", 'x("{v}")', None),
    ("_x{m8}", 'x("{v}")', "other"),
    ("https%3a%2f%2fh{k}.cn", 'u("{v}")', "encoding_url"),
    ("-----BEGIN PRIVATE KEY-----{m}", 'k("{v}")', "crypto_private_key"),
    ("-----BEGIN PUBLIC KEY-----{m}", 'k("{v}")', "crypto_public_key"),
    ("MIIE{m}{m}{m}{m}{m}{m}{m}", 'k("{v}")', "crypto_private_key"),
    ("MIGf{m}{m}{m}{m}", 'k("{v}")', "crypto_public_key"),
    ("{m}", 'iv: "{v}"', "crypto_static_iv"),
    ("{m}", 'cfg.vector = n, e = ["one/{k}", "two", "{v}", "three", "four", "five", "six"]', "id_noise"),
    ("{m}", 'cfg.vector = n, e = ["{v}", "{v}"]', "crypto_static_iv"),
    ("{m}", 'aesKey: "{v}"', "crypto_static_iv"),
    ("a{m}", 'accessKey: "{v}"', "platform_app_secret"),
    ("a{m}", 'appkey: "{v}"', "saas_analytics_key"),
    ("{m}", 'appSecret: "{v}"', "platform_app_secret"),
    ("{m}{m}{m}{m}{m}{m}{m}{m}", 'rsa.setPublic("{v}")', "crypto_public_key"),
    ("{m}{m16}", 'publicKey: "{v}"', "crypto_public_key"),
    ("{m}{m16}", 'privKeyHex: "{v}"', "crypto_private_key"),
    ("04{m}{m}{m}{m}", 'x("{v}")', "crypto_public_key"),
    ("/api/list{k}?a=b", 'x("{v}")', "miniapp_api_params"),
    ("shop-{k}-1300000001", 'bucket: "{v}"', "cloud_bucket_name"),
    ("shop-{k}-dir", 'x("{v}"), bucketList', "id_noise"),
    ("AIzaSy{m}", 'x("{v}")', "saas_map_key"),
    ("{m}", 'amapKey: "{v}"', "saas_map_key"),
    ("a{m}", 'umeng: "{v}"', "saas_analytics_key"),
    ("ev_{m8}1", 'getApp().sensors.track("{v}", 1)', "id_noise"),
    ("{b64}", 'session_key: "{v}"', "platform_session_key"),
    ("{m}", 'mchKey: "{v}"', "payment_secret"),
    ("prepay_id=wx1{m}", 'package: "{v}"', "payment_package"),
    ("N{m}", 'nonceStr: "{v}"', None),
    ("A{m}", 'idfa: "{v}"', None),
    ("u{m16}", 'userId: "{v}"', "id_user_identifier"),
    ("T{m16}", 'orderNo: "{v}"', "id_order_identifier"),
    ("P@ss{m8}", 'password: "{v}"', "cloud_cred_password"),
    ("P@ss{m8}", 'name: "{v}"', None),
    ("Pq{m8}X1", 'pwd; console.log("{v}")', None),
    ("Pq{m8}X&", 'pwd; x = "a" + "{v}"', "cloud_cred_password"),
    ("pq{m4}xy&", 'pwd; x = "a" + "{v}"', None),
    ("pq_{m8}", 'isPwd && e(["{v}", "b1", "c1", "d1", "e1", "f1"])', "cloud_cred_noise"),
    ("sid={m}", 'cookie: "{v}"', "server_cred_cookie"),
    ("{m}", 'session: "{v}"', "server_cred_session_key"),
    ("{m}{m8}", 'token = x ? id : "{v}"', "server_cred_token"),
    ("two words {k}", 'x("{v}")', None),
    (".cls{k}", 'x("{v}")', None),
    ("pages/x{k}/view.wxml", '__wxAppCode__["pages/x{k}/view.wxml"] = {}', "miniapp_noise"),
]
_PIECES = {
    "{m}": "m", "{m4}": "substr(m, 1, 4)", "{m8}": "substr(m, 1, 8)", "{m16}": "substr(m, 1, 16)", "{m27}": "substr(m, 1, 27)", "{k}": "k", "{k9}": "k", "{b64}": "base64(unhex(m))",
}


def _pieces(form: str) -> list[tuple[bool, str]]:
    """A form as text and pieces in turn: (is a piece, text or expression)."""
    out, rest = [], form
    while rest:
        at = min((i for p in _PIECES if (i := rest.find(p)) >= 0), default=-1)
        if at < 0:
            return [*out, (False, rest)]
        if at:
            out.append((False, rest[:at]))
        name = next(p for p in _PIECES if rest.startswith(p, at))
        out.append((True, _PIECES[name]))
        rest = rest[at + len(name) :]
    return out


def _suite_sql(suite: list[tuple[str, str, str | None]] = SUITE) -> str:
    value = " ".join(f"WHEN {i} THEN " + " || ".join(e if piece else "'" + e + "'" for piece, e in _pieces(form)) for i, (form, _, _) in enumerate(suite)).replace("base64(", "to_base64(")
    slug = " ".join(f"WHEN {i} THEN '{s}'" for i, (_, _, s) in enumerate(suite) if s)
    return f"""WITH s AS (SELECT o_orderkey % {len(suite)} AS r, o_orderkey::VARCHAR AS k, md5(o_orderkey::VARCHAR) AS m FROM orders), v AS (SELECT r, k, CASE r {value} END AS value, CASE r {slug} END AS slug FROM s)
SELECT k AS file, regexp_replace(value, '^plugin://', '') AS value, slug FROM v WHERE slug IS NOT NULL"""


@query(_suite_sql())
def classify_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One constant a file through the whole chain."""
    return _suite(spark, sf_dir, SUITE)


@query(_suite_sql(GATES))
def gate_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other gates of the chain, with what is near to what they take."""
    return _suite(spark, sf_dir, GATES)


def _suite(spark: SparkSession, sf_dir: str, suite: list[tuple[str, str, str | None]]) -> DataFrame:
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("m"), (F.col("o_orderkey") % len(suite)).alias("r"))
    value, stmt = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (form, around, _) in enumerate(suite):
        made = F.concat(*[F.expr(e) if piece else F.lit(e) for piece, e in _pieces(form)])
        value = F.when(F.col("r") == i, made).otherwise(value)
        parts = [F.lit(part) if at % 2 == 0 else made if part == "v" else F.col("k") for at, part in enumerate(re.split(r"\{([vk])\}", around))]
        stmt = F.when(F.col("r") == i, F.concat(*parts)).otherwise(stmt)
    rows = base.select(F.col("k").alias("file"), F.lit(0).alias("sid"), F.lit(1).cast("long").alias("pos"), value.alias("value"), F.lit("js-ast").alias("src"), stmt.alias("stmt"))
    return K.classify(rows).select("file", "value", "slug")


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber, 'AKID' || substr(md5(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR), 1, 20) AS ak, substr(sha256(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR), 1, 40) AS sk FROM lineitem)
SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS file, 'cloud_cred_ak_sk_pair' AS slug, 'AK=' || ak || ', SK=' || sk AS value FROM p"""
)
def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An access key followed by its secret: the pair is one finding, the secret none of its own."""
    base = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("file")).distinct().withColumn("k", F.col("file"))
    ak = F.concat(F.lit("AKID"), F.substring(F.md5(F.col("k").cast("binary")), 1, 20))
    sk = F.substring(F.sha2("k", 256), 1, 40)
    each = base.select("file", F.explode(F.array(F.struct(F.lit(0).alias("sid"), ak.alias("value"), F.lit("secretId").alias("key")), F.struct(F.lit(1).alias("sid"), sk.alias("value"), F.lit("secretKey").alias("key")))).alias("c"))
    rows = each.select("file", F.col("c.sid").alias("sid"), (F.col("c.sid") + 1).cast("long").alias("pos"), F.col("c.value").alias("value"), F.lit("js-ast").alias("src"), F.concat(F.col("c.key"), F.lit(': "'), F.col("c.value"), F.lit('"')).alias("stmt"))
    return K.classify(rows).select("file", "slug", "value")


@query(
    """WITH n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem), p AS (SELECT l_orderkey, 'AKID' || substr(md5(l_orderkey::VARCHAR || '-' || i::VARCHAR), 1, 20) AS ak, substr(sha256(l_orderkey::VARCHAR || '-' || i::VARCHAR), 1, 40) AS sk FROM n)
SELECT l_orderkey::VARCHAR AS file, 'cloud_cred_ak_sk_pair' AS slug, 'AK=' || ak || ', SK=' || sk AS value FROM p"""
)
def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair from every line of an order, in one file by line number: a secret has an access key on both sides and goes with the one before it."""
    line = F.row_number().over(W.Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    base = table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("i"))
    base = base.select(F.col("l_orderkey").cast("string").alias("file"), "i", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("i").cast("string")).alias("k"))
    ak = F.concat(F.lit("AKID"), F.substring(F.md5(F.col("k").cast("binary")), 1, 20))
    sk = F.substring(F.sha2("k", 256), 1, 40)
    each = base.select("file", "i", F.explode(F.array(F.struct(F.lit(0).alias("half"), ak.alias("value"), F.lit("secretId").alias("key")), F.struct(F.lit(1).alias("half"), sk.alias("value"), F.lit("secretKey").alias("key")))).alias("c"))
    place = 2 * F.col("i") + F.col("c.half")
    rows = each.select("file", place.cast("int").alias("sid"), place.cast("long").alias("pos"), F.col("c.value").alias("value"), F.lit("js-ast").alias("src"), F.concat(F.col("c.key"), F.lit(': "'), F.col("c.value"), F.lit('"')).alias("stmt"))
    return K.classify(rows).select("file", "slug", "value")


@query(
    """WITH s AS (SELECT doc_id, text, regexp_extract(text, '([A-Za-z]{9,})', 1) AS first FROM documents), w AS (SELECT doc_id, text, first, regexp_split_to_array(text, '[ \\t\\n\\f\\v\\r]+') AS ws FROM s WHERE first <> ''),
p AS (SELECT doc_id, text, ws, list_position(list_transform(ws, lambda x: contains(x, first)), true) AS spot FROM w)
SELECT doc_id, CASE WHEN length(text) <= 512 THEN text WHEN spot IS NOT NULL AND spot > 0 THEN array_to_string(ws[greatest(spot - 1, 1):spot + 1], ' ') ELSE substr(text, 1, 512) END AS window_text FROM p"""
)
def first_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", "([A-Za-z]{9,})", 1).alias("first")).filter("first != ''")
    return rows.select("doc_id", C.window_of(F.col("text"), F.col("first")).alias("window_text"))


@query(
    f"""WITH {TYPE_TABLE}, f AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'server_cred_token' WHEN o_orderkey % 3 = 1 THEN 'pii_phone_name' ELSE 'other' END AS slug FROM orders), j AS (SELECT category, slug, risk_level FROM f JOIN types USING (slug))
SELECT category, slug, count(*) AS n, max(risk_level) AS risk FROM j GROUP BY ROLLUP (category, slug)"""
)
def risk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    found = table(spark, sf_dir, "orders").select(F.when(k == 0, "server_cred_token").when(k == 1, "pii_phone_name").otherwise("other").alias("slug"))
    joined = found.join(F.broadcast(type_dimension(spark)), "slug")
    return joined.rollup("category", "slug").agg(F.count("*").alias("n"), F.max("risk_level").alias("risk"))
