"""The noise filter: rules on a value alone, the optional smart decision, near-duplicate suppression in a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparklode.functions import rules as R
from sparklode.functions import shapes as S

#: Ranges of code points that count as CJK.
CJK = "　-〿぀-ゟ゠-ヿ㐀-䶿一-鿿＀-￯"


def is_wanted(value: Column) -> Column:
    """Algorithm names and what names a person's data are kept whatever else they look like."""
    names = [*R.ALGORITHM_WHITELIST_LOWER, *(n.upper() for n in R.ALGORITHM_WHITELIST_LOWER), *R.ALGORITHM_WHITELIST_MIXED]
    return value.isin(*names) | F.lower(value).rlike(S.any_of(R.PII_KEYS))


def is_unwanted(value: Column) -> Column:
    """Quotes, brackets, foreign scripts, short digits, interface words, styles, colours, hashes of packages, plain names."""
    v = F.regexp_replace(value, r"(?U)\A\s+|\s+\z", "")
    letters = F.length(F.regexp_replace(v, "[^A-Za-z0-9]", ""))
    six = S.whole(v, "[0-9]{6}")
    code = S.whole(v, "[0-9]{2}[0-2][0-9][0-2][0-9]")
    mixed = S.is_alpha(v) & v.rlike(r"\p{Lu}") & v.rlike(r"\p{Ll}")
    rest = (
        v.isin(*R.HOT_WORDS) | S.starts_with(v, R.NOISE_PREFIXES) | v.endswith("rpx") | S.whole(v, "#[0-9a-fA-F]{3,8}")
        | S.whole(v, r"sha(?:256|384|512)-[A-Za-z0-9+/]+=*") | mixed | F.lower(v).isin(*R.HTML_STOP_WORDS, *R.UI_STOP_WORDS, *R.JS_STOP_WORDS)
        | S.whole(v, r"[0-9a-f]{8}-[0-9]+-?")
    )
    return (
        F.when(v == "", True)
        .when(v.rlike("""['"`<>()\\[\\]{}]"""), True)
        .when(v.rlike(rf"[^\x00-\x7F{CJK}]") | (letters < R.LEAST_LENGTH), True)
        .when(S.is_digits(v) & (F.length(v) < R.LEAST_DIGITS), True)
        .when(six, code)
        .otherwise(rest)
    )


def is_oversized_data_uri(value: Column) -> Column:
    return (F.length(value) > R.MOST_DATA_URI) & F.lower(value).startswith("data:")


def split_words(text: Column) -> Column:
    """Lower-case words of a camel, snake or kebab case name."""
    one = F.regexp_replace(text, "(.)([A-Z][a-z]+)", "$1 $2")
    two = F.regexp_replace(one, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(two, "[-_.]", " ")), r"\s+"), lambda w: w != "")


def composed_of_words(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """value, composed of distinct values (column value): all parts of a name are digits, words of the dictionary (column word, lower case), words
    of dates or of styles, or plurals of the first or third. Parts meet the dictionary by a join, which Spark broadcasts only if its size allows."""
    names = values.select("value").filter("value is not null").distinct()
    parts = names.select("value", F.explode_outer(F.array_distinct(split_words(F.col("value")))).alias("part"))
    single = F.when(F.col("part").endswith("s"), F.col("part").substr(F.lit(1), F.length("part") - 1))
    known = dictionary.select(F.col("word").alias("known")).distinct()
    asked = parts.select("part").unionByName(parts.select(single.alias("part"))).filter("part is not null").distinct()
    found = asked.join(known, F.col("part") == F.col("known"), "left_semi")
    both = parts.withColumn("single", single).join(found.select(F.col("part").alias("a")), F.col("part") == F.col("a"), "left").join(found.select(F.col("part").alias("b")), F.col("single") == F.col("b"), "left")
    dates = lambda c: F.col(c).isin(*R.TIME_DATE_NOISE)
    valid = F.col("a").isNotNull() | F.col("b").isNotNull() | dates("part") | F.coalesce(dates("single"), F.lit(False)) | F.col("part").isin(*R.CSS_STEMS) | S.is_digits(F.col("part"))
    folded = both.groupBy("value").agg(F.min(F.coalesce(valid, F.lit(False))).alias("all_valid"))
    return folded.select("value", (F.col("all_valid") & F.col("value").rlike(r"\p{L}")).alias("composed"))


def smart_decision(value: Column, composed: Column | None = None, language: Column | None = None) -> Column:
    """The smart filter's decision. composed: whether the value's parts are words (composed_of_words); language: that of a value
    which is prose, null if it is none; without them those steps are left out."""
    never = F.lit(False)
    prose = never if language is None else language.isNotNull() & value.contains(" ") & (F.length(value) > 10) & ~F.exists(F.split(value, r"\s+"), lambda w: F.length(w) >= 25)
    digit, alpha, symbol = value.rlike("[0-9]"), value.rlike("[a-zA-Z]"), value.rlike(r"[^a-zA-Z0-9\s]")
    words = F.split(F.lower(value), r"[\s._-]+")
    css = S.whole(value, "[a-z]+(?:-[a-z0-9]+)+") | (value.contains("__") & ~value.rlike(r"\p{Lu}"))
    return (
        F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in R.TIME_DATE_NOISE])), "FILTER: UI/Noise")
        .when(css, "FILTER: CSS Class")
        .when(value.contains("://"), "!!! URI: Service Scheme")
        .when(S.whole(value, r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), "!!! IP: Internal/Ext")
        .when(S.is_digits(value) & (F.length(value) > 12), "!!! DATA: Long ID/Num")
        .when(value.rlike(r"(?s)\A(?:Basic|Bearer|Token|Auth)\s+\S.{10,}"), "!!! KEY: Auth Header")
        .when(digit & symbol & ~alpha & ~S.whole(value, "20[0-9]{2}-[0-9]{2}-[0-9]{2}"), "!!! PASS: Digit+Symbol")
        .when(never if composed is None else F.coalesce(composed, never), "FILTER: Variables/Code")
        .when(prose, F.concat(F.lit("FILTER: Lang ("), never.cast("string") if language is None else language, F.lit(")")))
        .when(~value.contains(" ") & S.whole(value, "[0-9a-fA-F]{15,}"), "!!! KEY: Hex Token")
        .when(~value.contains(" ") & alpha & digit, "!!! PASS: AlphaNumeric")
        .when(~value.contains(" ") & alpha & ~digit & ~symbol & (F.length(value) > 3), "!!! SUSPECT: Unknown Alpha")
        .otherwise("IGNORE: Low Value")
    )


def smart_keeps(value: Column) -> Column:
    return value.contains("/") | S.is_digits(value) | ~smart_decision(value).rlike("FILTER|IGNORE")


def keeps(value: Column, smart: bool = False) -> Column:
    """Whether the rules on a value alone keep it."""
    plain = ~is_unwanted(value) & (smart_keeps(value) if smart else F.lit(True))
    return (F.length(value) > R.LEAST_LENGTH) & ~is_oversized_data_uri(value) & (is_wanted(value) | plain)


def near_threshold(ids: Column) -> Column:
    """Distance up to which an id is near the last kept one: half-even rounding of 1.5 times the median positive gap, within bounds.

    ids: a sorted array."""
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1))), lambda i: F.try_element_at(ids, i + 1) - F.element_at(ids, i)), lambda g: g > 0)
    s, n = F.array_sort(gaps), F.size(gaps)
    middle = (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2
    return F.when((F.size(ids) < 3) | (n == 0), R.NEAR_FALLBACK).otherwise(F.least(F.lit(R.NEAR_MAX), F.greatest(F.lit(R.NEAR_MIN), F.bround(middle * 1.5, 0).cast("int"))))


def far_enough(ids: Column, threshold: Column) -> Column:
    """Of a sorted array the first id, and each that is further than the threshold from the last kept one."""
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("kept"), F.lit(None).cast("long").alias("last"))

    def step(acc: Column, i: Column) -> Column:
        take = acc["last"].isNull() | (i - acc["last"] > threshold)
        return F.struct(F.when(take, F.concat(acc["kept"], F.array(i))).otherwise(acc["kept"]).alias("kept"), F.when(take, i).otherwise(acc["last"]).alias("last"))

    return F.aggregate(ids, start, step, lambda acc: acc["kept"])


def evenly(items: Column, most: int = R.NEAR_KEEP) -> Column:
    """At most that many items of an array, evenly spread, with both ends."""
    n = F.size(items)
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(most - 1)), 0).cast("int")))
    return F.when(n <= most, items).otherwise(F.transform(at, lambda i: F.element_at(items, i + 1)))


def drop_near_duplicates(constants: DataFrame) -> DataFrame:
    """Of equal (value, src) in a file those far enough apart in statement ids, at most NEAR_KEEP evenly spread.

    constants: file, value, src, sid and others. A bucket is one value of one file, so what one task folds is bounded by a
    file; equal rows of one sid are one occurrence, as in the extractors. One pass: the constants are not read twice.
    """
    sid = F.col("sid").cast("long")
    bucket = W.Window.partitionBy("file", "value", "src")
    ids = constants.withColumn("_ids", F.array_sort(F.collect_set(sid).over(bucket)))
    # explode keeps the optimizer from folding the threshold once for every use
    ids = ids.withColumn("_thr", F.explode(F.array(near_threshold(F.col("_ids")))))
    kept = F.when(F.size("_ids") < 2, F.col("_ids")).otherwise(evenly(far_enough(F.col("_ids"), F.col("_thr"))))
    return ids.filter(F.coalesce(F.array_contains(kept, sid), F.lit(False))).drop("_ids", "_thr")


def filter_constants(constants: DataFrame, smart: bool = False) -> DataFrame:
    """What the rules keep, without near duplicates, numbered again in order: pos by (sid, value, src).

    constants: file, sid, value, src, stmt. Null values go.
    """
    kept = drop_near_duplicates(constants.filter(F.coalesce(keeps(F.col("value"), smart), F.lit(False))))
    return kept.withColumn("pos", F.row_number().over(W.Window.partitionBy("file").orderBy("sid", "value", "src")).cast("long"))
