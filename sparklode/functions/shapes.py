"""Predicates on a value's shape, as Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklode.functions import rules as R


def any_of(words: Iterable[str]) -> str:
    """An alternation of literal words."""
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def has_substring(text: Column, words: Iterable[str]) -> Column:
    """A word is in the text, whatever its case."""
    return F.lower(text).rlike(any_of(words))


def starts_with(text: Column, words: Iterable[str]) -> Column:
    return text.rlike(r"\A" + any_of(words))


def ends_with(text: Column, words: Iterable[str]) -> Column:
    return text.rlike(any_of(words) + r"\z")


def whole(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def chars(text: Column) -> Column:
    """The characters of a text; none of an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def unique_chars(text: Column) -> Column:
    return F.size(F.array_distinct(chars(text)))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(F.length(text) > 0, -F.aggregate(F.array_sort(F.array_distinct(chars(text))), F.lit(0.0), lambda acc, c: acc + share(c) * F.log2(share(c))) + F.lit(0.0)).otherwise(0.0)


def is_digits(text: Column) -> Column:
    return whole(text, "[0-9]+")


def is_hex(text: Column) -> Column:
    return whole(text, "[0-9a-fA-F]*")


def is_alnum(text: Column) -> Column:
    return whole(text, r"[\p{L}\p{Nd}]+")


def is_alpha(text: Column) -> Column:
    return whole(text, r"\p{L}+")


def is_upper(text: Column) -> Column:
    """Has a letter with case, and none of lower case."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")


def is_lower(text: Column) -> Column:
    return text.rlike(r"\p{Ll}") & ~text.rlike(r"\p{Lu}")


def is_placeholder(text: Column) -> Column:
    return unique_chars(text) < 3


def is_camel_start(text: Column) -> Column:
    """Begins with a lower-case letter and has an upper-case one."""
    return text.rlike(r"\A\p{Ll}") & text.rlike(r"\p{Lu}")


# --- addresses ------------------------------------------------------------------------------------------


def is_ipv4(text: Column) -> Column:
    """Four numbers of up to 255."""
    return whole(text, r"(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])")


def ip_kind(text: Column) -> Column:
    """noise (loopback, unspecified), private or public; null for what is no address."""
    part = F.split(text, r"\.")
    n = lambda i: F.try_element_at(part, F.lit(i + 1)).try_cast("int")
    private = (n(0) == 10) | ((n(0) == 172) & n(1).between(16, 31)) | ((n(0) == 192) & (n(1) == 168))
    nothing = (n(0) == 127) | ((n(0) == 0) & (n(1) == 0) & (n(2) == 0) & (n(3) == 0))
    return F.when(is_ipv4(text), F.when(nothing, "noise").when(private, "private").otherwise("public"))


def is_oid(text: Column) -> Column:
    return whole(text, r"[0-9]+(?:\.[0-9]+){2,}")


def is_mac(text: Column) -> Column:
    return whole(text, "[0-9a-fA-F]{2}(?:(?::[0-9a-fA-F]{2}){5}|(?:-[0-9a-fA-F]{2}){5})")


def is_multicast_mac(text: Column) -> Column:
    return is_mac(text) & whole(text, "[0-9a-fA-F][13579bdfBDF].*")


def is_uuid(text: Column) -> Column:
    return whole(text, "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


# --- identifiers ----------------------------------------------------------------------------------------


def luhn_ok(text: Column) -> Column:
    """Digits whose Luhn sum is a multiple of ten."""
    digits = F.reverse(chars(text))

    def weigh(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when(i % 2 == 1, twice).otherwise(n).cast("long")

    return F.when(is_digits(text), F.aggregate(F.transform(digits, weigh), F.lit(0).cast("long"), lambda a, b: a + b) % 10 == 0).otherwise(False)


def is_imei(text: Column) -> Column:
    return whole(text, "[0-9]{15}") & ~is_placeholder(text) & luhn_ok(text)


def is_android_id(text: Column) -> Column:
    return whole(text, "[0-9a-fA-F]{16}") & ~is_placeholder(text)


def is_asn1_hex(text: Column) -> Column:
    return F.lower(text).startswith("2a8648")


def is_oaid(text: Column) -> Column:
    return whole(text, "[0-9a-fA-F]{32}") & ~is_placeholder(text) & ~is_asn1_hex(text)


def is_openid(text: Column) -> Column:
    return (F.length(text) == 28) & text.startswith("o") & is_alnum(text)


def is_app_id(text: Column) -> Column:
    return whole(text, "(?:wx|ww)[a-f0-9]{15,18}|gh_[a-f0-9]{11,16}")


def is_object_id(text: Column) -> Column:
    """24 lower-case hex digits that begin with a time in the window."""
    low, high = R.OBJECT_ID_TIMES
    return F.when(whole(text, "[0-9a-f]{24}"), F.conv(F.substring(text, 1, 8), 16, 10).cast("long").between(low, high)).otherwise(False)


def is_hex_token(text: Column) -> Column:
    return F.length(text).isin(*R.HEX_TOKEN_LENGTHS) & is_hex(text) & ~is_object_id(text) & (unique_chars(text) >= 4)


def is_identifier_noise(text: Column) -> Column:
    """Shapes that look like identifiers and are none."""
    repeated = whole(text, r"(.+)\1|(.+)\2{2}|(.+)\3{3}|(.+)\4{7}")
    step = lambda i: F.pmod(F.substring(text, i + 1, 1).try_cast("int") - F.substring(text, i, 1).try_cast("int"), F.lit(10)).isin(0, 1, 9)
    steps = whole(text, "[0-9]{16}")
    for i in range(1, 16):
        steps = steps & F.coalesce(step(i), F.lit(False))
    alphabet = (F.length(text) == 16) & (F.concat_ws("", F.array_sort(F.array_distinct(chars(F.lower(text))))) == "0123456789abcdef")
    return whole(text, r"2021[0-9]{12}") | alphabet | is_multicast_mac(text) | whole(text, "(?i)2b0601[0-9a-f]{10}") | (whole(text, "[0-9a-fA-F]{16}") & (repeated | steps))


def is_segmented_name(text: Column) -> Column:
    return whole(text, r"[A-Za-z]+[0-9]*(?:(?:--|__|[.\-_])[A-Za-z]+[0-9]*)+")


def is_single_name(text: Column) -> Column:
    return whole(text, r"[a-z]{3,}|[A-Z]{3,}|[a-z]+(?:[A-Z][a-z]+)+|[A-Za-z][A-Za-z0-9]*_") | text.rlike(r"\A(?:[#.]|===|_)")


def is_name_like(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]") | is_alpha(text)


def is_ad_name_like(text: Column) -> Column:
    return is_name_like(text) | ((F.length(text) <= 24) & (whole(text, "[A-Za-z]+[0-9]+|[a-z][a-z0-9]*(?:[A-Z][A-Za-z0-9]*)+|[0-9]{6}[A-Za-z]{6}") | is_segmented_name(text)))


# --- personal data --------------------------------------------------------------------------------------


def is_phone_segment_impossible(text: Column) -> Column:
    return whole(text, "1(?:[0-2][0-9]{9}|4[0-4][0-9]{8})")


def id_checksum(text: Column) -> Column:
    """The check character of an 18-character id number's first 17 digits."""
    total = F.lit(0)
    for i, w in enumerate(R.ID_WEIGHTS, 1):
        total = total + F.substring(text, i, 1).try_cast("int") * w
    return F.substring(F.lit(R.ID_CHECK), 1, 11).substr(total % 11 + 1, F.lit(1))


def is_id_number(text: Column) -> Column:
    """Province, calendar date and check character hold."""
    date = F.try_to_date(F.substring(text, 7, 8), "yyyyMMdd")
    shaped = whole(text, "[0-9]{17}[0-9Xx]")
    return F.when(shaped, F.substring(text, 1, 2).isin(*R.ID_PROVINCES) & date.isNotNull() & (id_checksum(text) == F.upper(F.substring(text, 18, 1)))).otherwise(False)


def digit_type(text: Column) -> Column:
    """id, phone, reject (looks like one and cannot be) or an empty string."""
    year, month, day = (F.substring(text, a, n).try_cast("int") for a, n in ((7, 4), (11, 2), (13, 2)))
    low, high = R.BIRTH_YEARS
    id_like = whole(text, "[0-9]{17}[0-9Xx]") & (unique_chars(F.substring(text, 1, 17)) >= 4) & year.between(low, high) & month.between(1, 12) & day.between(1, 31)
    phone_like = whole(text, "1[0-9]{10}") & (unique_chars(text) >= 3)
    return (
        F.when(F.coalesce(id_like, F.lit(False)), F.when(is_id_number(text), "id").otherwise("reject"))
        .when(phone_like, F.when(is_phone_segment_impossible(text), "reject").otherwise("phone"))
        .otherwise("")
    )


def email_class(text: Column) -> Column:
    """strict, loose (reserved domains and odd characters too) or null."""
    domain = F.lower(F.substring_index(text, "@", -1))
    loose = whole(text, r"(?s)[^@]+@[^@]{3,}") & domain.contains(".") & ends_with(F.lower(text), R.EMAIL_SUFFIXES)
    reserved = domain.rlike(rf"(?:\A|\.){any_of(R.RESERVED_DOMAINS)}\z|{any_of(R.RESERVED_TLDS)}\z")
    strict = whole(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+") & ~reserved
    return F.when(loose, F.when(strict, "strict").otherwise("loose"))


# --- credentials ----------------------------------------------------------------------------------------


def is_sk(text: Column) -> Column:
    return whole(text, r"[A-Za-z0-9+/=]{16,64}")


def is_strong_ak(text: Column) -> Column:
    return starts_with(text, R.AK_PREFIXES) & F.length(text).between(16, 40) & is_alnum(text)


def cloud_token(text: Column) -> Column:
    """token, noise (the prefix alone) or null."""
    prefixed = starts_with(text, R.CLOUD_TOKEN_PREFIXES) & F.length(text).between(20, 200) & (~text.startswith("npm_") | whole(text, "npm_[A-Za-z0-9]{36}"))
    body = F.regexp_replace(text, r"\A" + any_of(R.CLOUD_TOKEN_PREFIXES), "")
    good = whole(body, r"[A-Za-z0-9_\-./+=:~@]+") & (~starts_with(text, R.PAYMENT_TOKEN_PREFIXES) | whole(body, "[A-Za-z0-9]{24,}"))
    return F.when(prefixed, F.when(good, "token").otherwise("noise"))


def cloud_cookie(text: Column) -> Column:
    """cookie, noise or null."""
    header = text.rlike(r"\A[^=;\s]+=[^;]*;") & text.rlike(r"(?i);\s*(?:path|domain|expires|max-age|secure|httponly|samesite|version|comment)\b")
    pair = whole(text, r"[A-Za-z0-9_.\-]+=[A-Za-z0-9._~%+\-]+={0,2}")
    hit = (F.length(text) >= 10) & text.contains("=") & has_substring(text, R.CLOUD_COOKIE_WORDS)
    return F.when(hit, F.when(header | pair, "cookie").otherwise("noise"))


def is_access_token(text: Column) -> Column:
    odd = r"""[,;:./@?&=#!*()\[\]{}'"\\|<> \t\n\r]"""
    return (F.length(text) >= 20) & text.rlike(r"\p{L}") & text.rlike(r"\p{Nd}") & (unique_chars(text) >= 4) & ~text.rlike(odd) & ~is_camel_start(text)


def is_region(text: Column) -> Column:
    names = any_of(R.REGION_DIRECTIONS) + "|" + any_of(R.REGION_PLACES)
    return (F.length(text) < 30) & whole(F.lower(text), f"{any_of(R.REGION_PREFIXES)}(?:{names})(?:-[0-9]+)*")


def is_storage_host(host: Column) -> Column:
    return whole(F.lower(host), "|".join(R.STORAGE_HOSTS))


def algorithm(text: Column) -> Column:
    """weak, strong or null."""
    names = sorted({a.replace("-", "") for a in R.ALGORITHM_WHITELIST_LOWER})
    return F.when(F.replace(F.lower(text), F.lit("-"), F.lit("")).isin(*names), F.when(starts_with(F.lower(text), R.WEAK_ALGORITHMS), "weak").otherwise("strong"))


def fallback_kind(value: Column) -> Column:
    """The first of the ordered kinds whose pattern a value is as a whole; null for none, and for paths of third-party folders."""
    v = F.regexp_replace(value, r"(?U)\A\s+|\s+\z", "")
    third = F.arrays_overlap(F.split(F.substring_index(v, "?", 1), "/"), F.array(*[F.lit(f) for f in R.THIRD_PARTY_FOLDERS]))
    none = F.lit(None).cast("string")
    out = F.when(F.length(v) < R.FALLBACK_LEAST_LENGTH, none)
    for kind, pattern in R.FALLBACK_RULES:
        hit = v.rlike(rf"(?U)\A(?:{pattern})\z")
        if kind != "pem":
            hit = hit & ~v.rlike(r"[\r\n]")
        if kind in R.FALLBACK_PATHS:
            hit = hit & v.rlike("[A-Za-z]")
        if kind in R.FALLBACK_VARIED:
            hit = hit & (unique_chars(v) >= R.FALLBACK_LEAST_VARIED)
        out = out.when(hit, F.when(third, none).otherwise(kind) if kind in R.FALLBACK_PATHS else F.lit(kind))
    return out.otherwise(none)
