"""The taxonomy of findings: types, their categories, risk levels and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id, slug, category, risk level (0 to 5), action.
TYPES = [
    (1101, "platform_app_secret", "platform_credential", 5, "block"),
    (1102, "platform_session_key", "platform_credential", 5, "block"),
    (1103, "platform_access_token", "platform_credential", 5, "block"),
    (1201, "cloud_cred_ak_sk_pair", "cloud_credential", 5, "block"),
    (1202, "cloud_cred_upload_policy_signed", "cloud_credential", 4, "redact"),
    (1203, "cloud_cred_password", "cloud_credential", 5, "block"),
    (1204, "cloud_cred_basic_auth", "cloud_credential", 5, "block"),
    (1205, "cloud_cred_token", "cloud_credential", 5, "block"),
    (1206, "cloud_cred_cookie", "cloud_credential", 4, "redact"),
    (1207, "cloud_cred_noise", "cloud_credential", 0, "allow"),
    (1301, "cloud_bucket_name", "cloud_storage", 2, "warn"),
    (1302, "cloud_region", "cloud_storage", 1, "allow"),
    (1303, "cloud_storage_path", "cloud_storage", 2, "warn"),
    (1304, "cloud_upload_config", "cloud_storage", 3, "warn"),
    (1305, "cloud_noise", "cloud_storage", 0, "allow"),
    (1401, "saas_map_key", "saas_credential", 2, "warn"),
    (1402, "saas_analytics_key", "saas_credential", 1, "allow"),
    (1501, "webhook_url", "webhook_url", 5, "block"),
    (1601, "server_cred_password", "server_credential", 5, "block"),
    (1602, "server_cred_token", "server_credential", 5, "block"),
    (1603, "server_cred_session_key", "server_credential", 5, "block"),
    (1604, "server_cred_cookie", "server_credential", 5, "block"),
    (1605, "server_cred_noise", "server_credential", 0, "allow"),
    (1701, "server_url_with_credentials", "server_url", 5, "block"),
    (1702, "server_url_auth", "server_url", 4, "redact"),
    (1703, "server_url_payment", "server_url", 4, "redact"),
    (1704, "server_url_internal", "server_url", 3, "warn"),
    (1705, "server_url_api_plain", "server_url", 1, "allow"),
    (1706, "server_url_static", "server_url", 1, "allow"),
    (1707, "server_url_noise", "server_url", 0, "allow"),
    (1801, "backend_ip_public", "backend_ip", 3, "warn"),
    (1802, "backend_ip_private", "backend_ip", 2, "warn"),
    (1803, "backend_ip_noise", "backend_ip", 0, "allow"),
    (1901, "miniapp_page_path_sensitive", "miniapp_internal", 3, "warn"),
    (1902, "miniapp_page_path", "miniapp_internal", 1, "allow"),
    (1903, "miniapp_plugin_url", "miniapp_internal", 2, "warn"),
    (1904, "miniapp_scene_param", "miniapp_internal", 2, "warn"),
    (1905, "miniapp_path_asset", "miniapp_internal", 1, "allow"),
    (1906, "miniapp_path_module", "miniapp_internal", 1, "allow"),
    (1907, "miniapp_noise", "miniapp_internal", 0, "allow"),
    (2001, "miniapp_api_params", "miniapp_api", 1, "warn"),
    (2101, "crypto_algorithm_name", "crypto_config", 1, "allow"),
    (2102, "crypto_private_key", "crypto_config", 5, "block"),
    (2103, "crypto_public_key", "crypto_config", 2, "warn"),
    (2104, "crypto_static_iv", "crypto_config", 2, "warn"),
    (2105, "crypto_weak_algorithm", "crypto_config", 3, "warn"),
    (2106, "crypto_noise", "crypto_config", 0, "allow"),
    (2201, "encoding_base64", "data_encoding", 0, "allow"),
    (2202, "encoding_url", "data_encoding", 0, "allow"),
    (2203, "encoding_others", "data_encoding", 0, "allow"),
    (2301, "pii_sfzid_name", "pii", 5, "block"),
    (2302, "pii_phone_name", "pii", 4, "redact"),
    (2303, "pii_email_name", "pii", 3, "redact"),
    (2304, "pii_noise", "pii", 0, "allow"),
    (2401, "payment_request_params", "payment", 3, "warn"),
    (2402, "payment_nonce", "payment", 3, "redact"),
    (2403, "payment_package", "payment", 3, "redact"),
    (2404, "payment_sign_type", "payment", 1, "allow"),
    (2405, "payment_pay_sign", "payment", 4, "redact"),
    (2406, "payment_secret", "payment", 5, "block"),
    (2407, "payment_noise", "payment", 0, "allow"),
    (2501, "id_device_identifier", "identifier", 3, "redact"),
    (2502, "id_ad_identifier", "identifier", 3, "redact"),
    (2503, "id_user_identifier", "identifier", 3, "redact"),
    (2504, "id_order_identifier", "identifier", 2, "warn"),
    (2505, "id_noise", "identifier", 0, "allow"),
    (9901, "other", "others", 0, "allow"),
]

#: Category ids.
CATEGORIES = {
    "platform_credential": 1,
    "cloud_credential": 2,
    "cloud_storage": 3,
    "saas_credential": 4,
    "webhook_url": 5,
    "server_credential": 6,
    "server_url": 7,
    "backend_ip": 8,
    "miniapp_internal": 9,
    "miniapp_api": 10,
    "crypto_config": 11,
    "data_encoding": 12,
    "pii": 13,
    "payment": 14,
    "identifier": 15,
    "others": 99,
}


def type_dimension(spark: SparkSession) -> DataFrame:
    """type_id, slug, category, category_id, risk_level, action: one row a type, small enough to broadcast always."""
    rows = [(i, slug, category, CATEGORIES[category], risk, action) for i, slug, category, risk, action in TYPES]
    return spark.createDataFrame(rows, "type_id int, slug string, category string, category_id int, risk_level int, action string")


def expand_groups(groups: DataFrame) -> DataFrame:
    """Types of nested groups: type_id = start_index + place (from 1), risk and category from the group unless an item has its own.

    groups: start_index, category, default_risk, items (array of slug and risk, null to inherit).
    """
    items = groups.select("start_index", "category", "default_risk", F.posexplode("items").alias("at", "item"))
    return items.select((F.col("start_index") + F.col("at") + 1).cast("int").alias("type_id"), F.col("item.slug").alias("slug"), "category", F.coalesce("item.risk", "default_risk").cast("int").alias("risk_level"))
