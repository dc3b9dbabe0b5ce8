"""The classification chain: ordered gates, as Catalyst expressions, that give each constant its findings.

A gate is a condition and the rows it emits. The first gate whose condition holds decides; a gate may emit none. A
constant's findings are an array of (slug, value), which explode turns into rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparklode.functions import context as C
from sparklode.functions import positions as P
from sparklode.functions import rules as R
from sparklode.functions import shapes as S

NONE = "cast(array() as array<struct<slug:string,value:string>>)"


def row(slug: Column | str, value: Column) -> Column:
    return F.array(F.struct((F.lit(slug) if isinstance(slug, str) else slug).alias("slug"), value.alias("value")))


def nothing() -> Column:
    return F.expr(NONE)


def rows_if(condition: Column, slug: Column | str, value: Column) -> Column:
    return F.when(condition, row(slug, value)).otherwise(nothing())


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# --- pieces ------------------------------------------------------------------------------------------------


def is_secret_key(value: Column, stmt: Column) -> Column:
    """An application secret: words of the statement around it and a material shape."""
    letter, digit = value.rlike(r"\p{L}"), value.rlike(r"\p{Nd}")
    client = F.lower(stmt).contains("clientsecret") | F.lower(stmt).contains("client_secret")
    padded = client & S.whole(value, "[A-Za-z0-9+/=_-]{16,64}") & letter & digit & (S.unique_chars(value) >= 10)
    material = (
        F.length(value).between(24, 64) & letter & digit & ~value.rlike(r"[/:@?&=\-_\s]") & ~S.ends_with(F.lower(value), R.MODULE_EXTENSIONS + R.ASSET_EXTENSIONS)
        & ~(S.is_upper(value) & ~S.is_hex(value)) & (S.unique_chars(value) >= 10)
    )
    plain = S.whole(value, "[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}") | material
    return C.has_word(C.external(stmt, value), R.SECRET_WORDS) & ~value.startswith("U2FsdGVk") & (F.length(value) <= 128) & F.when(value.endswith("=="), padded).otherwise(plain)


def query_rows(query: Column) -> Column:
    """Secrets and personal numbers among the parameters of a query string."""
    pairs = F.filter(F.split(query, "&"), lambda p: S.whole(p, "(?s)[^=]+=[^=]+"))

    def of(pair: Column) -> Column:
        key, value = F.substring_index(pair, "=", 1), F.substring_index(pair, "=", -1)
        kind = S.digit_type(value)
        slug = (
            F.when(S.has_substring(key, R.SECRET_WORDS) & is_secret_key(value, key), F.lit("platform_app_secret"))
            .when(value.rlike(r"\A\p{Nd}"), F.when(kind == "id", "pii_sfzid_name").when(kind == "phone", "pii_phone_name").otherwise("pii_noise"))
        )
        return F.struct(slug.alias("slug"), value.alias("value"))

    return F.filter(F.transform(pairs, of), lambda r: r["slug"].isNotNull())


def first_word_slug(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The slug of the first word of the table that the text holds."""
    out = F.lit(None).cast("string")
    for word, slug in reversed(table):
        out = F.when(text.contains(word), F.lit(slug)).otherwise(out)
    return out


def url_rows(url: Column) -> Column:
    """Findings of a URL: credentials, address, parameters, then what the URL itself is."""
    body = F.regexp_replace(url, r"(?i)\A(?:https?|wss?)://", "")
    user = F.regexp_extract(body, r"(?s)\A([^@]*)@", 1)
    has_user = body.contains("@") & ~user.contains("/") & ~body.rlike(r"(?s)\A[^@]*@[0-9]x")
    login = has_user & S.whole(user, "(?s)[^:]+:.+")
    rest = F.when(has_user, F.regexp_replace(body, r"(?s)\A[^@]*@", "")).otherwise(body)
    low = F.lower(rest)
    host = F.substring_index(F.substring_index(rest, "/", 1), ":", 1)
    kind = S.ip_kind(host)
    query = F.when((F.length(rest) - F.length(F.replace(rest, F.lit("?"), F.lit(""))) == 1), F.substring_index(rest, "?", -1))
    slug = (
        F.when(S.ends_with(low, R.STATIC_EXTENSIONS), F.lit("server_url_static"))
        .otherwise(F.coalesce(first_word_slug(low, R.URL_WORDS), F.when(S.is_storage_host(host) | low.contains("x-oss-process"), "cloud_storage_path").otherwise("server_url_api_plain")))
    )
    params = F.when((F.length(query) >= 3) & query.contains("="), query_rows(query)).otherwise(nothing())
    main = (
        F.when(F.substring_index(rest, "/", 1) == "", row("server_url_noise", url))
        .when(kind.isNotNull(), row(F.concat(F.lit("backend_ip_"), kind), url))
        .otherwise(F.concat(params, row(slug, url)))
    )
    logins = F.when(_sure(login), F.concat(row("server_url_with_credentials", url), row("server_cred_password", url))).otherwise(nothing())
    return (
        F.when(F.trim(url).rlike(r"(?i)\Ahttps?://www\.w3\.org(?:/|\z)"), row("other", url))
        .when(~body.rlike(r"\A[\p{L}\p{Nd}]"), nothing())
        .otherwise(F.concat(logins, main))
    )


def is_page_route(path: Column, page_dir: bool = False) -> Column:
    """A route of pages or packages, and no interface."""
    before = F.substring_index(path, "?", 1)
    routes = r"(?i)/pages/|\A/(?:package|subpackage|subpages)"
    return ~S.has_substring(path, R.API_MARKS) & (before.rlike(routes) | (before.rlike(r"\A/page/") if page_dir else F.lit(False)))


def page_rows(value: Column, path: Column) -> Column:
    """Findings of a page path; path is the value without its prefix."""
    low = F.lower(path)
    slug = (
        F.when(path.startswith("plugin"), F.lit("miniapp_plugin_url"))
        .when(~path.contains("?") & S.ends_with(low, R.ASSET_EXTENSIONS), "miniapp_path_asset")
        .when(~path.contains("?") & S.ends_with(low, R.MODULE_EXTENSIONS), "miniapp_path_module")
        .when(low.rlike(S.any_of(R.SENSITIVE_PAGE_WORDS)), "miniapp_page_path_sensitive")
        .when(path.contains("?"), "miniapp_scene_param")
        .when(low.contains("pay.php"), "server_url_payment")
        .when(low.contains("login.php"), "miniapp_page_path_sensitive")
        .otherwise("miniapp_page_path")
    )
    return row(slug, value)


def slash_rows(value: Column, stmt: Column) -> Column:
    """Findings of a value that begins with a slash."""
    low = F.lower(value)
    body = F.substring_index(F.substring_index(low, "?", 1), "#", 1)
    no_api = ~low.rlike(S.any_of(R.API_MARKS))
    declared = F.lower(stmt).contains("usingcomponents")
    component = no_api & (
        S.starts_with(low, R.COMPONENT_PREFIXES)
        | (~is_page_route(value) & (S.starts_with(low, R.COMPONENT_PREFIXES_MORE) | (S.starts_with(low, R.COMPONENT_PREFIXES_IN_CONTEXT) & declared)))
        | (S.starts_with(low, R.PACKAGE_ROOTS) & low.rlike(S.any_of(R.COMPONENT_DIRS)) & declared)
    )
    word = first_word_slug(low, R.URL_WORDS)
    return (
        F.when(value.startswith("/./"), nothing())
        .when(S.ends_with(low, R.MODULE_EXTENSIONS), row("miniapp_path_module", value))
        .when(S.ends_with(body, R.PATH_ASSET_EXTENSIONS), row("miniapp_path_asset", value))
        .when(value.contains("://"), nothing())
        .when(low.rlike(S.any_of(R.THIRD_PARTY_MARKS)) | component, row("miniapp_path_module", value))
        .when(value.contains("?") & value.contains("="), F.concat(query_rows(value), row("miniapp_api_params", value)))
        .when(is_page_route(value), page_rows(value, value))
        .when(word.isNotNull(), row(word, value))
        .when(value.rlike(r"\p{L}") & (F.length(value) >= 4), row("miniapp_api_params", value))
        .otherwise(nothing())
    )


def payment_slug(value: Column, stmt: Column) -> Column:
    """The slug of the payment key that the value is bound to; null if it is bound to none."""
    evidence = F.lower(stmt).rlike(S.any_of(R.PAYMENT_EVIDENCE))
    names = F.create_map(*[F.lit(x) for pair in R.PAYMENT_NAMES for x in pair])

    def of(key: Column) -> Column:
        low = F.lower(key)
        slug = F.coalesce(names[low], first_word_slug(low, R.PAYMENT_KEY_WORDS))
        return F.when((slug == "payment_request_params") & (key != "timeStamp") & ~evidence, F.lit(None).cast("string")).otherwise(slug)

    return F.try_element_at(F.filter(F.transform(C.bound_keys(stmt, value), of), lambda s: s.isNotNull()), F.lit(1))


def has_no_address_key(value: Column, stmt: Column) -> Column:
    """The value is a certificate or version number: by its arc, or by the key left of it."""
    oid = (
        "(?:^|[^\\w$])(?:oid|keyusage|extkeyusage|extendedkeyusage|basicconstraints|subjectaltname|subjectkeyidentifier|authoritykeyidentifier|"
        "certificatepolicies|inhibitanypolicy|nameconstraints|policyconstraints|crldistributionpoints|freshestcrl|x509|asn1)"
    )
    version = "(?:^|[^\\w$])(?:version\\w*|ver|(?-i:[a-z][a-z0-9]*Version\\w*))"
    tail = "\\s*[\"']?\\s*[\\)\\]]?\\s*[:=(]\\s*(?:[\"']\\s*)?"
    return value.startswith("2.5.29.") | F.regexp_like(stmt, F.concat(F.lit(f"(?i)(?:{oid}|{version}){tail}(?-i:"), C.quoted(value), F.lit(")")))


def looks_like_bucket(value: Column, stmt: Column) -> Column:
    head = F.substring_index(value, "-", 1)
    shape = S.whole(value, "[a-z0-9][a-z0-9-]*[a-z0-9]") & F.length(value).between(6, 63) & ~S.is_digits(value) & ~S.whole(value, "[a-z]+[0-9]+[a-z]+") & value.rlike("[-0-9]")
    return S.has_substring(stmt, R.BUCKET_WORDS) & shape & ~head.rlike(S.any_of(R.BUCKET_HEAD_WORDS)) & ~S.is_region(value)


def has_bucket_evidence(value: Column, stmt: Column) -> Column:
    named = F.exists(C.bound_keys(stmt, value), lambda k: F.lower(k).contains("bucket"))
    return ~value.isin(*R.BUCKET_OPERATORS) & ~S.whole(value, "[0-9a-f]{32}") & (S.whole(value, r"[a-z0-9][a-z0-9-]*-[0-9]{10}") | named)


def _credential_material(value: Column) -> Column:
    body = F.regexp_replace(value, "[-_.]", "")
    parted = F.length(value).between(16, 64) & (body != value) & S.is_alnum(body) & body.rlike(r"\p{L}") & body.rlike(r"\p{Nd}")
    return (F.length(value).between(16, 40) & S.is_alnum(value)) | S.is_sk(value) | parted


def _visible_pair(stmt: Column) -> Column:
    return F.lower(stmt).rlike(rf"(?<![\p{{L}}\p{{Nd}}_$]){S.any_of(R.AK_SK_WORDS)}(?=[^\p{{L}}\p{{Nd}}_$])") | stmt.rlike(S.any_of(R.AK_PREFIXES) + "[A-Za-z0-9]{12,36}")


def is_pair(value: Column) -> Column:
    return S.whole(value, r"AK=[\p{L}\p{Nd}]{16,40}, SK=[A-Za-z0-9+/=]{16,64}")


def digit_rows(value: Column, stmt: Column) -> Column:
    """Findings of a value that begins with a digit."""
    low = F.lower(stmt)
    address = F.substring_index(value, ":", 1)
    kind = S.ip_kind(address)
    digits = S.digit_type(value)
    paid = payment_slug(value, stmt)
    no_slash = ~value.contains("/")
    pair_words = low.rlike("secret_key|secretkey|secretid")
    pair_ok = is_pair(value) | _credential_material(value) | _visible_pair(stmt)
    return (
        F.when(low.contains("point"), nothing())
        .when(S.is_imei(value), row("id_device_identifier", value))
        .when(kind.isNotNull() & ~has_no_address_key(address, stmt), row(F.concat(F.lit("backend_ip_"), kind), value))
        .when(digits == "id", row("pii_sfzid_name", value))
        .when(digits == "phone", row("pii_phone_name", value))
        .when((digits == "reject") | S.is_oid(value), row("pii_noise", value))
        .when(paid.isNotNull() & no_slash, row(paid, value))
        .when(no_slash & low.rlike("access_token|accesstoken") & S.is_access_token(value), row("platform_access_token", value))
        .when(no_slash & pair_words, F.when(pair_ok, row("cloud_cred_ak_sk_pair", value)).otherwise(row("pii_noise", value)))
        .when(no_slash & low.contains("cookie"), row("server_cred_cookie", value))
        .when(no_slash & low.contains("bucket") & looks_like_bucket(value, stmt) & has_bucket_evidence(value, stmt), row("cloud_bucket_name", value))
        .otherwise(row("pii_noise", value))
    )


def upload_policy(value: Column) -> Column:
    """A signed upload policy: base64 of a JSON object with expiry and conditions that names a store's terms."""
    text = F.try_to_binary(value, F.lit("base64")).cast("string")
    fields = F.json_object_keys(text)
    return value.startswith("eyJ") & (F.length(value) >= 20) & ~S.whole(value, r"(?s)[^.]*\.[^.]*\.[^.]*") & _sure(F.array_contains(fields, "expiration") & F.array_contains(fields, "conditions")) & _sure(S.has_substring(text, R.UPLOAD_POLICY_WORDS))


def alpha_rows(value: Column, stmt: Column, name_reject: Column) -> Column:
    """Findings of a value that begins with a letter."""
    low, no_slash = F.lower(stmt), ~value.contains("/")
    kind = S.algorithm(value)
    name = S.is_segmented_name(value) | (value.rlike(r"[_.\-]\z") & (F.length(value) >= 3) & S.is_segmented_name(F.regexp_replace(value, r"[_.\-]+\z", "")))
    cookie_bound = F.exists(C.bound_keys(stmt, value), lambda k: F.lower(k).isin("cookie", "cookies"))
    late = (
        F.when(low.rlike("appsecret|app_secret") & no_slash & is_secret_key(value, stmt), F.lit("platform_app_secret"))
        .when(low.rlike("access_token|accesstoken") & no_slash & S.is_access_token(value), "platform_access_token")
        .when(low.contains("cookie") & no_slash & ~S.is_single_name(value) & (~name | cookie_bound), "server_cred_cookie")
    )
    return (
        F.when(low.contains("point"), nothing())
        .when(S.starts_with(F.lower(value), R.CLOUD_URL_PREFIXES), row("cloud_storage_path", value))
        .when(upload_policy(value), row("cloud_cred_upload_policy_signed", value))
        .when(value.startswith("eyJ"), row(F.when(S.whole(value, r"(?s)[^.]*\.[^.]*\.[^.]*"), "platform_access_token").otherwise("server_cred_token"), value))
        .when(S.is_openid(value), row("id_user_identifier", value))
        .when(kind.isNotNull(), row(F.when((kind == "weak") & S.has_substring(stmt, R.SENSITIVE_CRYPTO_WORDS), "crypto_weak_algorithm").otherwise("crypto_algorithm_name"), value))
        .when(S.is_region(value), row("cloud_region", value))
        .when((F.length(value) >= 3) & value.contains("="), query_rows(value))
        .when(late.isNotNull(), F.when(name_reject, row("id_noise", value)).otherwise(row(late, value)))
        .otherwise(nothing())
    )


def identifier_slug(value: Column, stmt: Column) -> Column:
    """(slug, reject): the slug of an identifier, or that only its name-like form keeps it from being one."""
    out = C.external(stmt, value)
    device, order = C.has_word(stmt, R.DEVICE_WORDS), C.has_word(stmt, R.ORDER_WORDS)
    ad = C.has_word(out, R.AD_WORDS)
    for word, first, second in R.AD_SEGMENTS:
        ad = ad | C.has_pair(out, word, first, second)
    user = C.has_segment(out, "uid", ("uuid", "guid", "guide")) | C.has_word(out, R.USER_WORDS)
    sized = F.length(value).isin(*R.DEVICE_LENGTHS) & S.is_alnum(value)
    ad_slug = F.when(S.is_ad_name_like(value), "id_noise").otherwise("id_ad_identifier")
    lower_name = S.is_lower(value) & S.is_alpha(value)
    user_shape, order_shape = F.length(value).between(8, 64) & S.is_alnum(value), F.length(value).between(12, 64) & S.is_alnum(value)
    found = lambda slug: F.struct((F.lit(slug) if isinstance(slug, str) else slug).alias("slug"), F.lit(False).alias("reject"))
    none = F.struct(F.lit(None).cast("string").alias("slug"), F.lit(False).alias("reject"))
    reject = F.struct(F.lit(None).cast("string").alias("slug"), F.lit(True).alias("reject"))
    return (
        F.when(S.is_placeholder(value) | S.is_asn1_hex(value), none)
        .when(S.is_identifier_noise(value), found("id_noise"))
        .when(S.is_imei(value) | S.is_android_id(value) | S.is_mac(value) | (S.is_oaid(value) & device) | (S.is_uuid(value) & device), found("id_device_identifier"))
        .when(S.is_uuid(value) & ad, found(ad_slug))
        .when(S.is_uuid(value) & user, found("id_user_identifier"))
        .when(S.is_uuid(value) & order, found("id_order_identifier"))
        .when(device & sized, found("id_device_identifier"))
        .when(ad & sized, found(ad_slug))
        .when(user & user_shape, F.when(lower_name | S.is_camel_start(value), none).when(S.is_name_like(value), reject).otherwise(found("id_user_identifier")))
        .when(order & order_shape, F.when(lower_name | S.is_camel_start(value) | S.is_name_like(value), reject).otherwise(found("id_order_identifier")))
        .otherwise(none)
    )


def is_server_cookie(value: Column, stmt: Column) -> Column:
    low = F.lower(value)
    name = F.trim(F.regexp_replace(F.substring_index(value, "=", 1), "[\"']", ""))
    empty = S.whole(value, r"[\"']?[A-Za-z][A-Za-z0-9_.\-]*[\"']?=\s*") & (F.lower(name).isin(*R.COOKIE_NAMES) | (S.has_substring(name, R.COOKIE_NAME_WORDS) & (S.is_segmented_name(name) | S.is_single_name(name))))
    odd_syntax = low.rlike(S.any_of(R.COOKIE_SYNTAX_WORDS)) & value.contains(";") & ~value.rlike(r"\A[a-zA-Z0-9_-]+=.+")
    versioned = low.rlike(r"v[12]\z") & value.contains("_") & S.is_alnum(F.replace(value, F.lit("_"), F.lit("")))
    return (
        S.has_substring(stmt, R.COOKIE_CONTEXT_WORDS) & F.length(value).between(10, 500) & value.contains("=") & ~value.rlike(r"\A[{\[&?]") & ~empty
        & ~S.is_single_name(value) & ~value.rlike("[一-鿿]") & ~odd_syntax & ~versioned & ~S.whole(value, "(?s)[^=]*=[0-9]+")
    )


def near_password(value: Column, stmt: Column) -> Column:
    """A password word near the value that is no part of a path."""
    out = F.regexp_replace(C.external(stmt, value), r"(?i)(?<=/)(?:password|passwd|pwd)(?![\"'\t ]*[:=])|(?:password|passwd|pwd)(?=/)", " ")
    return C.has_segment(out, "pwd") | C.has_word(out, R.PASSWORD_WORDS)


def is_password_shape(value: Column) -> Column:
    """A shape that no name, path, style or placeholder has; where the value stands is another question."""
    low = F.lower(value)
    code = "(?:get|set|send|check|update|input|show|handle|on|is|has|can|do|will|did|loop|anonymous|member|thumb)"
    style = r"::after|::before|:before|:after|content:|text-align|position:|width:|height:|margin|padding|border|font-|,\."
    dotted = value.contains(".") & S.whole(value, r"[\p{L}._]+") & F.forall(F.split(value, r"\."), lambda p: (p == "") | p.rlike(r"\A\p{Lu}") | (~p.rlike(r"\p{Lu}") & p.rlike(r"\p{Ll}")))
    return (
        F.length(value).between(6, 64) & ~S.is_segmented_name(value) & ~S.is_single_name(value) & ~S.is_digits(value) & ~dotted
        & ~value.rlike(r"[ /一-鿿]|\A(?:eyJ|Bearer |Basic )|\A[0-9].*\.|\A0\p{L}") & ~low.isin(*R.PASSWORD_PLACEHOLDERS) & ~low.rlike(style)
        & ~low.rlike(r"\A(?:[a-z]+-[a-z]+-[a-z]+-[0-9]+|[a-z]+-[0-9]+,?\.|icon[-_]|[a-z-]+:[a-z-]+\z)") & ~(S.is_alpha(value) & S.is_lower(value))
        & ~(low.rlike(r"\A" + code) & value.rlike(r"\p{Lu}")) & ~S.whole(value, r"[\p{L}\p{Nd}_-]+\.") & value.rlike(r"\p{L}")
    )


def password_rows(value: Column, place: Column, reject: Column) -> Column:
    """A password, unless it is none in the window around its own place."""
    kept = value.isin(*R.PASSWORD_KNOWN) | (near_password(value, place["anchor"]) & ~place["anchor_noise"])
    return row(F.when(kept, F.when(reject, "id_noise").otherwise("cloud_cred_password")).otherwise("cloud_cred_noise"), value)


def is_iv(value: Column, stmt: Column) -> Column:
    out = F.replace(stmt, value, F.lit(""))
    near = out.rlike(r"(?<![0-9A-Za-z])(?:iv|Iv|IV)(?![a-z])|(?<=[a-z0-9])I[Vv](?![a-z])") | S.has_substring(out, R.IV_WORDS)
    decoded = F.try_to_binary(F.translate(value, "-_", "+/"), F.lit("base64"))
    camel = S.whole(value, "[a-z0-9]+(?:[A-Z][a-z]{2,}[a-z0-9]*)+|[A-Z][a-z]{2,}[a-z0-9]*(?:[A-Z][a-z]{2,}[a-z0-9]*)+")
    words = S.whole(value, "(?:(?:[a-z]{2,}|[A-Z][a-z]{2,}|[A-Z]{2,})[0-9]*[-_]+)+(?:[a-z]{2,}|[A-Z][a-z]{2,}|[A-Z]{2,})?[0-9]*") | value.rlike("__|--")
    name = S.whole(value, "[0-9]+|[A-Z0-9]+(?:_[A-Z0-9]+)*|[a-z]+") | camel | words
    random = ~name & value.rlike("[A-Z]") & value.rlike("[a-z]") & decoded.isNotNull()
    sized = F.length(value)
    return (
        (~value.contains("/") | decoded.isNotNull()) & ~F.lower(value).rlike(S.any_of(R.IV_NOISE_WORDS)) & near
        & F.when(sized.isin(*R.IV_HEX_LENGTHS) & S.is_hex(value), True).when(sized.isin(*R.IV_BASE64_LENGTHS) & S.whole(value, "[A-Za-z0-9+/=_-]+"), random).otherwise(sized.isin(*R.IV_TEXT_LENGTHS) & S.is_alnum(value) & random)
    )


def is_aes_key(value: Column, stmt: Column) -> Column:
    camel = S.whole(value, "[a-z0-9]+(?:[A-Z][a-z]{2,}[a-z0-9]*)+|[A-Z][a-z]{2,}[a-z0-9]*(?:[A-Z][a-z]{2,}[a-z0-9]*)+")
    shape = S.whole(value, "[0-9a-fA-F]{32}|[0-9a-fA-F]{48}|[0-9a-fA-F]{64}") | (F.length(value).isin(16, 24, 32) & S.is_alnum(value) & ~camel)
    return C.has_word(C.external(stmt, value), R.AES_WORDS) & shape


def app_key_slug(value: Column, stmt: Column) -> Column:
    hit = (
        S.has_substring(C.external(stmt, value), R.APP_KEY_WORDS) & S.whole(value, "[A-Za-z0-9]{16,40}") & value.rlike("[A-Za-z]") & value.rlike("[0-9]")
        & ~(S.is_upper(value) & ~S.is_hex(value)) & ~S.is_camel_start(value) & (S.unique_chars(value) >= 10)
    )
    public = S.has_substring(stmt, R.APP_KEY_PUBLIC_WORDS) & ~S.has_substring(stmt, R.APP_KEY_CREDENTIAL_WORDS)
    return F.when(hit, F.when(public, "saas_analytics_key").otherwise("platform_app_secret"))


def is_map_key(value: Column, stmt: Column) -> Column:
    api = (
        S.whole(value, "[A-Za-z0-9_-]{16,}") & ~S.is_digits(value) & ~(S.is_lower(value) & S.is_alpha(value)) & ~value.rlike(r"\A[0-9].*_")
        & ~(value.contains("_") & S.is_lower(F.replace(value, F.lit("_"), F.lit(""))))
    )
    bound = F.exists(C.bound_keys(stmt, value), lambda k: F.lower(k).isin(*R.MAP_KEY_NAMES))
    return value.rlike(r"\A[A-Za-z0-9]{3}BZ-") | value.startswith("AIzaSy") | (C.has_word(stmt, R.MAP_WORDS) & api & (~S.is_segmented_name(value) | bound))


def is_map_secret(value: Column, stmt: Column) -> Column:
    low = F.lower(stmt)
    return low.rlike("mapkey|map_key") & low.rlike("secretkey|secret_key") & F.length(value).between(24, 64) & S.is_alnum(value) & value.rlike(r"\p{L}") & value.rlike(r"\p{Nd}")


def is_analytics_key(value: Column, stmt: Column) -> Column:
    code = value.rlike("(?i)" + r"\A" + S.any_of(R.CODE_PREFIXES)) & value.rlike(r"\A(?i:" + "|".join(R.CODE_PREFIXES) + r")[a-z]")
    return C.has_word(stmt, R.ANALYTICS_WORDS) & S.whole(value, "[A-Za-z0-9_-]{8,}") & ~code & (value.rlike("[0-9]") | F.length(value).isin(32, 64))


def is_session_key(value: Column, stmt: Column) -> Column:
    raw = F.hex(F.try_to_binary(value, F.lit("base64")))
    codes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(raw.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    counts = F.transform(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda d: d == c)) / F.lit(16.0))
    bits = -F.aggregate(counts, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))
    printable = F.size(F.filter(codes, lambda c: c.between(0x20, 0x7E)))
    return C.has_word(C.external(stmt, value), R.SESSION_KEY_WORDS) & S.whole(value, "[A-Za-z0-9+/]{22}==") & F.substring(value, 1, 22).rlike("[A-Z]") & _sure((bits >= 3.0) & (printable < 12))


def payment_value_slug(value: Column, stmt: Column) -> Column:
    low = F.lower(value)
    names = F.create_map(*[F.lit(x) for pair in R.PAYMENT_NAMES for x in pair])
    plain = ~value.rlike(r"""[./&^:;{}\[\]="' ]|[^\x00-\x7F]""") & ~(S.is_lower(value) & S.is_alpha(value)) & ~value.rlike(r"\A\p{L}.*_") & ~S.is_digits(value) & (F.length(value) >= 5)
    return (
        F.when(S.whole(value, "[0-9a-fA-F]{32}") & S.has_substring(stmt, R.PAYMENT_SECRET_WORDS), F.lit("payment_secret"))
        .when(low.startswith("prepay_id="), F.when(S.whole(low, r"prepay_id=wx(?=.*[0-9])[0-9a-z]{12,}"), "payment_package").otherwise("payment_noise"))
        .when(value.contains("/"), F.lit(None).cast("string"))
        .when(F.upper(value).isin("MD5", "SHA256", "HMAC-SHA256", "RSA") & F.lower(stmt).contains("sign"), "payment_sign_type")
        .when(plain, names[low])
    )


def curve_key_slug(value: Column, raw: Column) -> Column:
    low = F.lower(raw)
    private = S.has_substring(raw, R.PRIVATE_KEY_WORDS) | C.has_segment(raw, "priv")
    public = S.has_substring(raw, R.PUBLIC_KEY_WORDS) | C.has_segment(raw, "pub")
    shaped = S.whole(value, "[0-9a-fA-F]{48}|[0-9a-fA-F]{64}|04[0-9a-fA-F]{128}")
    table = low.contains("point") | (low.contains("doubles") & low.contains("naf")) | low.rlike(S.any_of(R.CURVE_WORDS))
    ok = shaped & ~table & (S.unique_chars(F.upper(value)) >= 6) & (private | public | S.whole(value, "04[0-9a-fA-F]{128}"))
    return F.when(ok, F.when(private & ~public, "crypto_private_key").otherwise("crypto_public_key"))


def hex_token_rows(value: Column, stmt: Column, id_bound: Column) -> Column:
    return (
        F.when(S.has_substring(stmt, R.HEX_TOKEN_WORDS), rows_if(~id_bound, "server_cred_token", value))
        .when(S.has_substring(stmt, R.HEX_SESSION_WORDS) | C.has_segment(stmt, "sid"), row("server_cred_session_key", value))
        .otherwise(nothing())
    )


def is_framework_mark(value: Column) -> Column:
    """Marks that compilers and frameworks leave: scopes, directives, attributes, header names, fragments."""
    scope = "data-v-[0-9a-f]{6,10}"
    directive = r"\Av-(?:bind|on|if|else-if|else|for|model|show|html|text|slot|cloak|once|pre)(?:[:.]|\z)"
    return (
        value.rlike(rf"\A{scope}(?:\z|[,;])|\A.+[ _]{scope}\z") | value.rlike(directive) | S.whole(value, "wx:[a-z][a-z0-9-]*")
        | S.whole(value, "data-[A-Za-z0-9_-]+")
        | F.lower(value).isin(*R.HTTP_HEADERS) | S.whole(F.lower(value), r"x-[a-z0-9]+(?:-[a-z0-9]+)+=?")
        | S.whole(value, r"&[A-Za-z][A-Za-z0-9_.\-]*=|\^[A-Za-z_][A-Za-z0-9_\-]*|[A-Za-z0-9_#][A-Za-z0-9_\-]*-module__[A-Za-z0-9_\-]+")
        | value.rlike(r"\A(?:;|__|@@)")
    )


# --- the chain ---------------------------------------------------------------------------------------------


def gates(value: Column, stmt: Column, raw: Column, pair: Column, near_map_key: Column, ident: Column, place: Column) -> list[tuple[str, Column, Callable[[], Column]]]:
    """(name, condition, rows) in the order in which they are asked."""
    low = F.lower(value)
    pem = F.when(S.starts_with(value, ("-----BEGIN PRIVATE", "-----BEGIN RSA PRIVATE")), "crypto_private_key").when(value.startswith("-----BEGIN PUBLIC"), "crypto_public_key")
    app_key, pay, curve = app_key_slug(value, stmt), payment_value_slug(value, stmt), curve_key_slug(value, raw)
    cookie, token, email = S.cloud_cookie(value), S.cloud_token(value), S.email_class(value)
    api = ~value.contains("://") & ~low.rlike(r"\A/?pages/") & ~value.rlike(r"\A(?:\.\.?|@)/") & value.contains("?") & value.contains("=") & (value.startswith("/") | low.rlike(S.any_of(R.API_MARKS)))
    body = F.substring_index(F.substring_index(low, "?", 1), "#", 1)
    reject = ident["reject"]
    or_noise = lambda slug: row(F.when(reject, "id_noise").otherwise(slug), value)
    return [
        ("framework", is_framework_mark(value), nothing),
        ("url", S.starts_with(low, R.URL_PREFIXES), lambda: url_rows(value)),
        ("app_id", S.is_app_id(value), lambda: row("miniapp_noise", value)),
        ("pages", value.rlike(r"\A/?pages/"), lambda: page_rows(value, F.regexp_replace(value, r"\A/?pages/", ""))),
        ("plugin", S.starts_with(value, R.PLUGIN_PREFIXES), lambda: row("miniapp_plugin_url", F.regexp_replace(value, r"\Aplugin(?:-private)?://", ""))),
        ("url_encoded", S.starts_with(low, R.URL_ENCODED_PREFIXES), lambda: row("encoding_url", value)),
        ("pair", pair.isNotNull(), lambda: rows_if(is_pair(pair), "cloud_cred_ak_sk_pair", pair)),
        ("cloud_cookie", cookie.isNotNull(), lambda: row(F.concat(F.lit("cloud_cred_"), cookie), value)),
        ("pem", pem.isNotNull() & ~S.whole(value, r"-----BEGIN [A-Z0-9 ]*KEY-----[\s\\nrt]*"), lambda: row(pem, value)),
        ("private_key", S.starts_with(value, R.BASE64_PRIVATE_PREFIXES) & S.whole(value, "[A-Za-z0-9+/=_-]{200,}"), lambda: row("crypto_private_key", value)),
        ("public_key", S.starts_with(value, R.BASE64_PUBLIC_PREFIXES) & S.whole(value, "[A-Za-z0-9+/=_-]{100,}"), lambda: row("crypto_public_key", value)),
        ("iv", is_iv(value, stmt) | is_aes_key(value, stmt), lambda: row(F.when(F.coalesce(place["iv"], F.lit(True)), "crypto_static_iv").otherwise("id_noise"), value)),
        ("app_key", app_key.isNotNull(), lambda: row(app_key, value)),
        ("map_neighbour", near_map_key & F.lower(stmt).rlike("secretkey|secret_key") & F.length(value).between(24, 64) & S.is_alnum(value) & value.rlike(r"\p{L}") & value.rlike(r"\p{Nd}"), lambda: row("saas_map_key", value)),
        ("secret", is_secret_key(value, stmt), lambda: row("platform_app_secret", value)),
        ("rsa_hex", (F.length(value) >= 256) & S.is_hex(value) & S.has_substring(raw, R.RSA_WORDS), lambda: row("crypto_public_key", value)),
        ("curve", curve.isNotNull(), lambda: row(curve, value)),
        ("api", api, lambda: F.when(is_page_route(value, True), page_rows(value, value)).otherwise(row(F.when(S.ends_with(body, R.PATH_ASSET_EXTENSIONS), "miniapp_path_asset").otherwise("miniapp_api_params"), value))),
        ("data_uri", low.startswith("data:"), lambda: row("encoding_base64", value)),
        ("bucket", looks_like_bucket(value, stmt), lambda: row(F.when(has_bucket_evidence(value, stmt), "cloud_bucket_name").otherwise("id_noise"), value)),
        ("email", email.isNotNull(), lambda: row(F.when(email == "strict", "pii_email_name").otherwise("pii_noise"), value)),
        ("map_key", is_map_key(value, stmt) | is_map_secret(value, stmt), lambda: row("saas_map_key", value)),
        ("analytics", is_analytics_key(value, stmt), lambda: row(F.when(place["reported"], "id_noise").otherwise("saas_analytics_key"), value)),
        ("session_key", is_session_key(value, stmt), lambda: row("platform_session_key", value)),
        ("payment", pay.isNotNull(), lambda: row(pay, value)),
        ("identifier", ident["slug"].isNotNull(), lambda: row(ident["slug"], value)),
        ("password", is_password_shape(value) & near_password(value, stmt) & ~place["window_noise"], lambda: password_rows(value, place, reject)),
        ("server_cookie", is_server_cookie(value, stmt), lambda: or_noise("server_cred_cookie")),
        ("cloud_token", token.isNotNull(), lambda: row(F.concat(F.lit("cloud_cred_"), token), value)),
        ("hex_token", S.is_hex_token(value), lambda: hex_token_rows(value, stmt, _sure(place["id_bound"]))),
        ("spaced", value.rlike(r"(?U)\s"), nothing),
        ("digit", value.rlike(r"\A\p{Nd}"), lambda: digit_rows(value, stmt)),
        ("alpha", value.rlike(r"\A\p{L}"), lambda: alpha_rows(value, stmt, reject)),
        ("dot", value.startswith("."), nothing),
        ("slash", value.startswith("/"), lambda: slash_rows(value, stmt)),
        ("unknown", F.lit(True), lambda: row("other", value)),
    ]


def is_identity(value: Column, stmt: Column) -> Column:
    """A compiler marker of the window names the value, a template, style or configuration file."""
    norm = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"\A(?:\./)+", "")
    marks = r"""(?i)__wxappcode__\s*\[\s*(['"])([^'"]*)\1\s*\]"""
    files = r"""(?i)__wxapp(?:currentfile|file)__\s*=\s*(['"])([^'"]*)\1"""
    keys = F.concat(F.regexp_extract_all(stmt, F.lit(marks), F.lit(2)), F.regexp_extract_all(stmt, F.lit(files), F.lit(2)))
    return S.ends_with(F.lower(value), R.IDENTITY_EXTENSIONS) & F.exists(keys, lambda k: norm(k) == norm(value))


def is_access_key(value: Column, stmt: Column) -> Column:
    sk = S.is_sk(value) & S.has_substring(stmt, R.SK_WORDS)
    return ~sk & F.length(value).between(16, 40) & S.is_alnum(value) & (S.starts_with(value, R.AK_PREFIXES) | S.has_substring(stmt, R.AK_WORDS))


def is_impossible_pair(ak: Column, sk: Column) -> Column:
    same = (ak == sk) | ak.startswith(sk) | sk.startswith(ak)
    bad = lambda v: S.whole(v, "wx[0-9a-f]{16}|2021[0-9]{12}") | (v.contains("/") & ~v.rlike("[+=]")) | v.rlike("ABCDEFGH|abcdefgh")
    return same | (~S.is_strong_ak(ak) & (bad(ak) | bad(sk)))


def classify(constants: DataFrame) -> DataFrame:
    """Findings of constants.

    constants: file, sid, pos (order in the file), value, src, stmt (whole statement). Returns file, src, slug,
    value, context (the statement's window). The window of a statement is that of its first constant. Pairs of access
    and secret keys are looked for in the next, then the previous constant of the file; a partner that another has
    used gives no finding of its own, and the members of an impossible pair lose findings of high risk (a fold over a file's
    key-like constants alone, so a file's other rows are never gathered).
    """
    by_file = W.Window.partitionBy("file").orderBy("pos")
    by_stmt = W.Window.partitionBy("file", "sid").orderBy("pos")
    rows = constants.withColumn("first", F.first("value").over(by_stmt)).withColumn("ctx", C.window_of(F.col("stmt"), F.col("first")))
    near = rows
    for name, step in (("next", F.lead), ("prev", F.lag)):
        near = near.withColumn(f"{name}_value", step("value").over(by_file)).withColumn(f"{name}_stmt", step("stmt").over(by_file)).withColumn(f"{name}_pos", step("pos").over(by_file))
    near = near.withColumn("near_map_key", _sure(is_map_key(F.col("next_value"), F.col("next_stmt"))) | _sure(is_map_key(F.col("prev_value"), F.col("prev_stmt"))))
    value, ctx = F.col("value"), F.col("ctx")
    own = F.when(is_access_key(value, ctx), "ak").when(S.is_sk(value) & S.has_substring(ctx, R.SK_WORDS), "sk")

    def partner(name: str) -> Column:
        v, s = F.col(f"{name}_value"), F.col(f"{name}_stmt")
        return F.when(F.col("half") == "ak", S.is_sk(v)).when(F.col("half") == "sk", is_access_key(v, s))

    near = near.withColumn("half", own).withColumn("side", F.when(_sure(partner("next")), "next").when(_sure(partner("prev")), "prev"))
    other = F.when(F.col("side") == "next", F.col("next_value")).otherwise(F.col("prev_value"))
    near = near.withColumn("ak", F.when(F.col("half") == "ak", value).otherwise(other)).withColumn("sk", F.when(F.col("half") == "ak", other).otherwise(value))
    near = near.withColumn("bad", _sure(is_impossible_pair(F.col("ak"), F.col("sk")))).withColumn("mate", F.when(F.col("side") == "next", F.col("next_pos")).otherwise(F.col("prev_pos")))
    # the fold over a file's candidates: (consumed positions, vetoed positions, owners)
    seed = F.when(F.col("side").isNotNull(), F.struct("pos", "mate", "bad"))
    near = near.withColumn("seeds", F.array_sort(F.collect_list(seed).over(W.Window.partitionBy("file"))))
    start = F.expr("named_struct('used', cast(array() as array<bigint>), 'veto', cast(array() as array<bigint>), 'own', cast(array() as array<bigint>))")

    def step(acc: Column, s: Column) -> Column:
        skip = F.array_contains(acc["used"], s["pos"]) | F.array_contains(acc["veto"], s["pos"])
        add = lambda name, xs, when: F.when(when & ~skip, F.concat(acc[name], xs)).otherwise(acc[name]).alias(name)
        return F.struct(add("used", F.array(s["mate"]), ~s["bad"]), add("veto", F.array(s["pos"], s["mate"]), s["bad"]), add("own", F.array(s["pos"]), ~s["bad"]))

    # only seeds and their mates ask for the fold; explode keeps the optimizer from copying it into every use
    asked = F.col("side").isNotNull() | F.exists("seeds", lambda s: s["mate"] == F.col("pos"))
    joined = near.withColumn("fold", F.explode(F.array(F.when(asked, F.aggregate("seeds", start, step)))))
    has = lambda name: _sure(F.array_contains(F.col(f"fold.{name}"), F.col("pos")))
    # a partner is used up only if its owner comes before it in the fold; the fold saw to that
    joined = joined.filter(~(has("used") & ~has("own")))
    pair = F.when(has("own"), F.concat(F.lit("AK="), F.col("ak"), F.lit(", SK="), F.col("sk")))
    # explode keeps the optimizer from copying these into every gate that reads them
    once = F.explode(F.array(F.struct("near_map_key", pair.alias("pair"), has("veto").alias("vetoed"), identifier_slug(value, ctx).alias("ident"), is_identity(value, ctx).alias("identity"))))
    staged = joined.select("file", "src", "sid", "pos", "value", "ctx", "stmt", once.alias("s"))
    staged = staged.withColumn("place", P.position_of(value, ctx, F.col("stmt"), _sure(_asks_for_place(value, ctx))))
    found = staged.withColumn("found", F.explode(_chain(spark_id())))
    risky = F.col("found.slug").isin(*HIGH_RISK)
    slug = F.when(F.col("s.identity"), "miniapp_noise").when(F.col("s.vetoed") & risky & (F.col("found.value") == value), "cloud_cred_noise").otherwise(F.col("found.slug"))
    return found.select("file", "src", "pos", slug.alias("slug"), F.when(F.col("s.identity"), value).otherwise(F.col("found.value")).alias("value"), F.col("ctx").alias("context"))


def _asks_for_place(value: Column, stmt: Column) -> Column:
    """Values that a gate may ask the place of, by cheap tests."""
    words = S.has_substring(stmt, ("pwd", *R.PASSWORD_WORDS, *R.ANALYTICS_WORDS, *R.IV_WORDS, *R.AES_WORDS, "iv", *R.HEX_TOKEN_WORDS))
    return F.length(value).between(6, 128) & ~value.rlike(r"\s") & words | S.is_hex_token(value)


def spark_id() -> str:
    return SparkContext.getOrCreate().applicationId


@functools.cache
def _chain(application: str) -> Column:
    """The gates as one expression over the staged columns; thousands of nodes, so made once an application."""
    chain = None
    for _, condition, emit in gates(F.col("value"), F.col("ctx"), F.col("stmt"), F.col("s.pair"), F.col("s.near_map_key"), F.col("s.ident"), F.col("place")):
        chain = F.when(_sure(condition), emit()) if chain is None else chain.when(_sure(condition), emit())
    return chain


def _high_risk() -> tuple[str, ...]:
    from sparklode.plans.taxonomy import TYPES

    return tuple(slug for _, slug, _, risk, _ in TYPES if risk >= 4)


HIGH_RISK = _high_risk()
