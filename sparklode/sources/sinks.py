"""Where results go: JSON folders, a relational store by SQL or JDBC, counts alone."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparklode.functions import rules as R
from sparklode.operators.noise import drop_near_duplicates, keeps

# --- JSON -----------------------------------------------------------------------------------------------------


def as_interchange(constants: DataFrame) -> DataFrame:
    """A row for each file: file, statements and constants [[value, statement, source]], as read_interchange reads them.

    constants: file, sid, value, src, stmt. Statements are numbered again by their ids; what one row holds is bounded by a file.
    """
    numbers = F.array_sort(F.collect_set(F.struct("sid", "stmt")))
    rows = F.array_sort(F.collect_set(F.struct("sid", "value", "src")))
    folded = constants.filter("value is not null").groupBy("file").agg(numbers.alias("s"), rows.alias("c"))
    sids = F.transform("s", lambda s: s["sid"])
    place = lambda c: (F.array_position(sids, c["sid"]) - 1).cast("string")
    return folded.select("file", F.transform("s", lambda s: s["stmt"]).alias("statements"), F.transform("c", lambda c: F.array(c["value"], place(c), c["src"])).alias("constants"))


def split_constants(constants: DataFrame, smart: bool = False) -> tuple[DataFrame, DataFrame]:
    """What the noise filter keeps of constants (file, sid, value, src, stmt), and what it removes."""
    kept = drop_near_duplicates(constants.filter(F.coalesce(keeps(F.col("value"), smart), F.lit(False))))
    key = ["file", "sid", "value", "src"]
    removed = constants.join(kept.select(*key).distinct(), [constants[c].eqNullSafe(kept[c]) for c in key], "left_anti")
    return kept, removed


def write_json(constants: DataFrame, findings: DataFrame, path: str, smart: bool = False) -> None:
    """Folders filtered, removed and classified below path, one JSON object a file of origin or finding."""
    kept, removed = split_constants(constants, smart)
    as_interchange(kept).write.mode("overwrite").json(f"{path}/filtered")
    as_interchange(removed).write.mode("overwrite").json(f"{path}/removed")
    findings.write.mode("overwrite").json(f"{path}/classified")


# --- counts alone ---------------------------------------------------------------------------------------------


def dry_run(findings: DataFrame) -> DataFrame:
    """slug, n, n_files, n_values: what a scan would store, with nothing written."""
    return findings.groupBy("slug").agg(F.count("*").alias("n"), F.countDistinct("pkg", "file").alias("n_files"), F.countDistinct("value").alias("n_values"))


# --- a relational store ---------------------------------------------------------------------------------------

TABLES = {
    "data_type": ("id INT PRIMARY KEY", "slug VARCHAR(64) NOT NULL", "category_id INT NOT NULL", "risk_level INT NOT NULL"),
    "miniapp": ("id BIGINT PRIMARY KEY", f"appid VARCHAR({R.MOST_APP_ID}) NOT NULL"),
    "data_item": ("hash_sha256 CHAR(64) PRIMARY KEY", "type_id INT", "raw_value TEXT", "ref_count BIGINT NOT NULL"),
    "data_occurrence": (f"appid VARCHAR({R.MOST_APP_ID}) NOT NULL", "hash_sha256 CHAR(64) NOT NULL", "source_file VARCHAR(1024)", "detector_source VARCHAR(32)", "source_snippet TEXT"),
}


def ddl(tables: Mapping[str, Iterable[str]] = TABLES) -> str:
    """Statements that make the store's tables where they are not there."""
    return "\n".join(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(columns)});" for name, columns in tables.items())


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    return "'" + value.replace("\\", "\\\\").replace("'", "''") + "'" if isinstance(value, str) else str(value)


def insert_sql(table: str, rows: list[Mapping[str, object]], key: str = "id") -> str:
    """One statement that inserts the rows, or updates those whose key is there; columns are those of any row, in order of name."""
    if not rows:
        return ""
    columns = sorted(set().union(*rows))
    values = ",\n".join("(" + ", ".join(_literal(r.get(c)) for c in columns) + ")" for r in rows)
    update = ", ".join(f"`{c}`=VALUES(`{c}`)" for c in columns if c != key)
    return f"INSERT INTO `{table}` ({', '.join(f'`{c}`' for c in columns)}) VALUES\n{values}" + (f"\nON DUPLICATE KEY UPDATE {update};" if update else ";")


def seed_sql(types: DataFrame) -> str:
    """The statement that fills data_type; types is the taxonomy (a fixed, small table)."""
    rows = types.select(F.col("type_id").alias("id"), "slug", "category_id", "risk_level").orderBy("id").collect()
    return insert_sql("data_type", [r.asDict() for r in rows])


_SQL_PART = re.compile(r"""(?s)'(?:[^']|'')*(?:'|\Z)|"[^"]*(?:"|\Z)|`[^`]*(?:`|\Z)|(?:--(?=[ \t\r\n])|\#)[^\n]*|/\*.*?(?:\*/|\Z)|(;)|.""")


def split_sql(script: str) -> list[str]:
    """The statements of a script: semicolons in quotes and comments end none."""
    out, start = [], 0
    for m in _SQL_PART.finditer(script):
        if m[1]:
            out.append(script[start : m.start()].strip())
            start = m.end()
    return [s for s in [*out, script[start:].strip()] if s]


def upsert_items(items: DataFrame, url: str, table: str = "data_item", properties: Mapping[str, str] | None = None) -> None:
    """Merges items into a table over JDBC: they are appended to a staging table, and one MERGE statement adds new ones and
    counts the occurrences of known ones, which keep type and value. A run that died between the two is repeated from an empty staging table."""
    spark, staging, options = items.sparkSession, f"{table}_staging", dict(properties or {})
    items.select("hash_sha256", "type_id", "raw_value", "ref_count").write.mode("overwrite").option("truncate", "true").option("createTableColumnTypes", "hash_sha256 VARCHAR(64)").jdbc(url, staging, properties=options)
    quote = '"'
    q = lambda name: quote + name + quote
    merge = (
        f"MERGE INTO {table} t USING {staging} s ON t.hash_sha256 = s.{q('hash_sha256')} "
        f"WHEN MATCHED THEN UPDATE SET ref_count = t.ref_count + s.{q('ref_count')} + 1 "
        f"WHEN NOT MATCHED THEN INSERT (hash_sha256, type_id, raw_value, ref_count) VALUES (s.{q('hash_sha256')}, s.{q('type_id')}, s.{q('raw_value')}, s.{q('ref_count')})"
    )
    execute(spark, url, [merge], options)


def execute(spark: SparkSession, url: str, statements: Iterable[str], properties: Mapping[str, str] | None = None) -> None:
    """Runs statements over one JDBC connection of the driver."""
    settings = spark._jvm.java.util.Properties()
    for name, value in (properties or {}).items():
        settings.setProperty(name, value)
    if "driver" in (properties or {}):
        spark._jvm.java.lang.Class.forName(properties["driver"])
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        for statement in statements:
            prepared = connection.createStatement()
            prepared.execute(statement.rstrip().rstrip(";"))
            prepared.close()
    finally:
        connection.close()


# --- ids ------------------------------------------------------------------------------------------------------


def type_ids(groups: DataFrame) -> DataFrame:
    """slug, type_id, category, category_id, risk: ids of the items of nested groups (start_index, category, default_risk, items of (slug, risk)),
    counted from the start index in order, a repeated slug of a group once. Categories count from 1 by start index; others is 99."""
    rows = groups.select("start_index", "category", "default_risk", F.posexplode("items").alias("i", "x"))
    rows = rows.groupBy("start_index", "category", "default_risk", F.col("x.slug").alias("slug")).agg(F.min_by("x.risk", "i").alias("risk"), F.min("i").alias("i"))
    of_group = W.Window.partitionBy("category").orderBy("i")
    heads = groups.select("start_index", "category").distinct().filter("category != 'others'")
    # the groups of a taxonomy are few: this window is over their heads alone
    heads = heads.select("category", F.row_number().over(W.Window.orderBy("start_index")).alias("category_id"))
    numbered = rows.withColumn("type_id", (F.col("start_index") + F.row_number().over(of_group)).cast("int")).join(F.broadcast(heads), "category", "left")
    return numbered.select("slug", "type_id", "category", F.coalesce("category_id", F.lit(99)).alias("category_id"), F.coalesce("risk", "default_risk", F.lit(0)).cast("int").alias("risk"))


def constants_module(types: Iterable[Row]) -> Iterator[str]:
    """Lines of a Python module with an id for each slug."""
    yield from (f"{r['slug'].upper()} = {r['type_id']}" for r in types)
