"""Word sets, tables and patterns of the rules.

Everything here is a fixed value: results depend on these exact words, so they stand as plain data.
"""

from __future__ import annotations

# --- fixed values: noise filter -------------------------------------------------------------------------

ALGORITHM_WHITELIST_LOWER = (
    "md5", "sha1", "sha256", "sha384", "sha512", "sha-1", "sha-256", "sha-384", "sha-512", "aes", "aes128", "aes256", "aes-128", "aes-256",
    "aes-cbc", "aes-gcm", "aes-ecb", "des", "3des", "des3", "triple-des", "rsa", "rsa1024", "rsa2048", "rsa4096", "rsa-1024", "rsa-2048",
    "rsa-4096", "ecdsa", "ed25519", "ecdh", "sm2", "sm3", "sm4", "hmac", "hmac-sha256", "hmac-sha1", "hmac-md5",
)
#: The one spelling besides all lower and all upper case.
ALGORITHM_WHITELIST_MIXED = ("HMAC-sha256",)

HTML_STOP_WORDS = (
    "value", "values", "key", "keys", "label", "name", "title", "id", "type", "data", "item", "items", "list", "info", "detail", "class", "style",
    "width", "height", "url", "path", "success", "fail", "message", "msg", "status", "code", "object", "array", "string", "number", "boolean",
    "bindtap", "bindinput", "bindchange", "bindblur", "bindfocus", "catchtap", "catchtouchmove", "catchtouchstart", "catchtouchend",
)
UI_STOP_WORDS = ("view", "text", "image", "button", "input", "form", "scroll-view", "swiper", "swiper-item", "navigator", "picker", "icon", "canvas")
JS_STOP_WORDS = (
    "index", "length", "floor", "map", "filter", "reduce", "push", "pop", "slice", "splice", "join", "split", "default", "null", "undefined", "none",
    "test", "demo", "true", "false",
)

HOT_WORDS = (
    "authPhoneSwitch", "authStyle", "avatarUrl", "base64Path", "bindanimationfinish", "bindgetuserinfo", "bindscrolltolower", "brochureCurrentIndex",
    "cardListItem", "cdeSqn", "compare", "computed", "current", "cursor", "cursorSpacing", "customClass", "email", "empBusiCardPicTbls", "foldSwitch",
    "fontColor", "holdKeyboard", "imageName", "infoSummary", "maltNameItem", "matlId", "matlListItem2", "modal", "pictureIndex", "selectionEnd",
    "selectionStart", "selectModule", "shareParams", "showgwDialog", "showSubMsgModal", "showTitle", "showType", "target", "templetIndex", "textarea",
    "workBadge", "adjustPosition", "autoFocus", "binderror", "border", "center", "confirmType", "currentOptionDateIndex", "customStyle",
    "empBusiCardTbls", "error", "headerText", "hoverClass", "inputAlign", "inputValue", "isShow", "lang", "loginHeight", "loginName",
    "lotteryConfigFlag", "modalTitle", "navHeight", "needAuthNick", "officeAddress", "orgCode", "protocolParam", "quantity", "searchFocus",
    "shareGwParams", "showDate", "showDialog", "showLayer", "showNewInfo", "templateId", "authNickModal", "bindconfirm", "bindtouchend",
    "bindtouchstart", "brief", "btnName", "decode", "fixed", "lable", "lev4Item", "newInfo", "newsId", "range", "refresherEnabled", "selectArr",
    "showChooseAvatar", "span", "userInfo", "userSelect", "chkSts", "dailyNews", "enhanced", "hidden", "indicatorActiveColor", "indicatorColor",
    "indicatorDots", "informationId", "isProgress", "position", "qrCode", "showMenuByLongpress", "showNormalNews", "showScrollbar", "showTopNews",
    "actId", "active", "baseImgUrl", "bubInfo", "count", "indexTemp", "orgName", "scrollX", "shareCount", "showShare", "avatar", "circular", "color",
    "currentIndex", "date", "employee", "interval", "lev3Item", "matlMapList2", "modules", "quickNews", "size", "actInfoList", "showNickAuthModal",
    "showSwitchBox", "space", "userFlag", "cName", "mainNavbar", "moduleId", "placeholderClass", "placeholderStyle", "showBtnType", "uploadConfig",
    "userCode", "scrollY", "autoplay", "handleAbnormalData", "infoFlag", "item1", "focus", "nodes", "positionsOrgName", "cardBgId", "matlMapList",
    "placeholder", "maxlength", "openType", "disabled", "resFld1", "matlTempTyp", "matlListItem", "slot", "utils", "euifBcInfo", "imgUrl", "mode",
    "white", "function", "Function", "minute", "minutes", "Minutes", "Minute", "render", "result", "return", "right", "horizontal", "primary",
    "process", "product", "onLoad", "navigateTo", "month", "months", "columns", "warning", "Month", "u-icon", "__esModule", "throw",
)

NOISE_PREFIXES = (
    "filter", "card", "form", "handle", "img", "modal", "position", "remark", "search", "send", "swiper", "switch", "picture", "close", "show",
    "title", "upload", "view", "resFld", "manager", "loading", "get", "disable", "content", "confirm", "click", "cancle", "button", "block", "bind",
    "width:", "status", "stop", "YYYY", "yyyy", "dddd", "DDDD", "MM-DD", "mm-dd", "HH:mm", "hh:mm", "D MMM", "font-size:", "fontSize", "fontWeight",
    "%d ", "%s ", "leave-", "-leave-", "color:", "border-color:", "border: ", "background-color:", "Cannot ", "van-", "Jan_Feb", "nv_", "uicon-",
    "Januar",
)

PII_KEYS = ("patientname", "iccardno", "idcard", "身份证", "phone", "mobile")

TIME_DATE_NOISE = (
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "okt", "nov", "dec", "january", "february", "march", "april", "may",
    "june", "july", "september", "october", "november", "december", "august", "gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno",
    "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre", "januar", "februar", "marts", "maj", "juni", "juli", "oktober", "mon",
    "tue", "wed", "thu", "fri", "sat", "sun", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "domingu", "segunda",
    "tersa", "kuarta", "kinta", "sesta", "sabadu", "do", "lu", "ma", "me", "gi", "ve", "sa", "min", "sec", "hour", "day", "week", "month", "year",
    "minutt", "minuta", "godzina", "sekunde", "stunde", "tag", "woche", "seconden", "zh", "cn", "en", "us", "tw", "hk", "hant", "hans", "latn",
    "save", "cancel", "ok", "yes", "no", "loading", "error", "success", "fail", "null", "undefined", "nan", "string", "number", "boolean", "object",
    "function", "array",
)

NEAR_MIN, NEAR_MAX, NEAR_FALLBACK, NEAR_KEEP = 10, 120, 30, 25
LEAST_LENGTH, LEAST_DIGITS, MOST_DATA_URI = 6, 6, 200

# --- fixed values: prefixes, suffixes and path words --------------------------------------------------------

URL_PREFIXES = ("https://", "http://", "wss://", "ws://")
URL_ENCODED_PREFIXES = ("https%3a%2f%2f", "http%3a%2f%2f")
CLOUD_URL_PREFIXES = ("cloud://", "cos://", "oss://", "s3://")
PLUGIN_PREFIXES = ("plugin://", "plugin-private://")
STATIC_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".css", ".js", ".mp3", ".mp4", ".pdf")
ASSET_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".mp3", ".mp4", ".wav", ".ogg", ".webm", ".ttf", ".woff", ".woff2", ".eot")
MODULE_EXTENSIONS = (".js", ".ts", ".json", ".wxs", ".wxss", ".wxml")
PATH_ASSET_EXTENSIONS = (*ASSET_EXTENSIONS, ".css", ".pdf")
IDENTITY_EXTENSIONS = (".wxml", ".wxss", ".json")
API_MARKS = ("/api/", "/v1/", "/v2/", "/v3/", "api/")
COMPONENT_PREFIXES = ("/components/", "/component/", "/wxcomponents/", "/vant/", "/components-common/", "/commpents/")
COMPONENT_PREFIXES_MORE = ("/@y/", "/maincomponents/", "/wigets/", "/ext-tee-passport/")
COMPONENT_PREFIXES_IN_CONTEXT = ("/src/", "/common/", "/usercenter/")
COMPONENT_DIRS = ("/components/", "/component/", "/components-common/", "/commpents/", "/wxcomponents/")
PACKAGE_ROOTS = ("/package", "/subpackage", "/subpages")
THIRD_PARTY_MARKS = ("miniprogram_npm/", "node_modules/", "uni_modules/", "@babel/", "@vant/", "uview-ui/", "/dist/", "/assets/dist/")
SENSITIVE_PAGE_WORDS = ("admin", "test", "debug", "config", "internal", "manage")

#: Words of a URL and the slug that the first of them gives, in this order.
URL_WORDS = (
    ("webhook/send", "webhook_url"), ("cgi-bin/webhook", "webhook_url"), ("robot/send", "webhook_url"), ("bot/v2/hook", "webhook_url"), ("bot/hook", "webhook_url"),
    ("login", "server_url_auth"), ("signin", "server_url_auth"), ("oauth", "server_url_auth"), ("auth", "server_url_auth"),
    ("payment", "server_url_payment"), ("pay", "server_url_payment"),
    ("admin", "server_url_internal"), ("internal", "server_url_internal"), ("debug", "server_url_internal"),
)

#: Endpoints of object stores, matched against the whole lower-case host.
STORAGE_HOSTS = (
    r"(?:[a-z0-9][a-z0-9.-]*\.)?oss(?:-[a-z0-9-]+)?\.aliyuncs\.com",
    r"(?:[a-z0-9][a-z0-9.-]*\.)?(?:cos|ci|pic|image|file)[a-z]{0,4}(?:\.[a-z0-9-]+)?\.myqcloud\.com",
    r"(?:[a-z0-9][a-z0-9.-]*\.)?s3\.(?:[a-z0-9-]+\.)?amazonaws\.com(?:\.cn)?",
    r"(?:[a-z0-9][a-z0-9.-]*\.)?cdn\.bcebos\.com",
    r"(?:[a-z0-9][a-z0-9-]*\.)?s3\.[a-z0-9-]+\.jdcloud-oss\.com",
    r"(?:[a-z0-9][a-z0-9-]*\.)?s3\.bitiful\.net",
)

REGION_PREFIXES = ("cn-", "ap-", "us-", "eu-", "sa-", "me-", "af-", "na-")
REGION_DIRECTIONS = ("north", "south", "east", "west", "central", "northeast", "northwest", "southeast", "southwest")
REGION_PLACES = (
    "beijing", "shanghai", "guangzhou", "shenzhen", "chengdu", "hangzhou", "nanjing", "chongqing", "wuhan", "changsha", "xian", "jinan", "fuzhou",
    "hongkong", "taipei", "macau", "singapore", "tokyo", "osaka", "seoul", "mumbai", "bangkok", "jakarta", "kualalumpur", "manila", "hanoi",
    "hochiminh", "sydney", "melbourne", "siliconvalley", "ashburn", "virginia", "toronto", "dallas", "seattle", "saopaulo", "santiago", "frankfurt",
    "london", "dublin", "paris", "amsterdam", "milan", "madrid", "stockholm", "zurich", "moscow", "dubai", "riyadh", "johannesburg", "cairo",
)
BUCKET_WORDS = ("bucket", "bucketname", "bucket_name", "ossbucket", "oss_bucket", "cosbucket", "cos_bucket", "s3bucket", "s3_bucket", "storagebucket", "storage_bucket")
BUCKET_HEAD_WORDS = (
    "bucket", "token", "secret", "key", "name", "list", "conf", "config", "param", "setting", "option", "md5", "sha", "hash", "sign", "encrypt",
    "time", "date", "hour", "minute", "second", "url", "http", "path", "dir", "folder", "route", "container", "prog", "app", "service", "handler",
    "video", "image", "photo", "file", "media", "audio", "watermark", "thumb", "resize", "crop", "miniprogram", "wechat", "weixin", "alipay",
)
BUCKET_OPERATORS = ("starts-with", "eq", "content-length-range")

# --- fixed values: personal data ----------------------------------------------------------------------------

EMAIL_SUFFIXES = (".com", ".cn", ".net", ".org", ".edu", ".gov", ".io", ".co", ".cc", ".me", ".info", ".biz")
RESERVED_DOMAINS = ("example.com", "example.net", "example.org")
RESERVED_TLDS = (".test", ".example", ".invalid", ".localhost")
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECK = "10X98765432"
ID_PROVINCES = (
    "11", "12", "13", "14", "15", "21", "22", "23", "31", "32", "33", "34", "35", "36", "37", "41", "42", "43", "44", "45", "46", "50", "51", "52",
    "53", "54", "61", "62", "63", "64", "65", "71", "81", "82",
)
BIRTH_YEARS = (1900, 2026)
OBJECT_ID_TIMES = (0x55000000, 0x69999999)

# --- fixed values: credentials ------------------------------------------------------------------------------

CLOUD_TOKEN_PREFIXES = (
    "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "sk_live_", "sk_test_", "pk_live_", "pk_test_", "rk_live_",
    "rk_test_", "npm_", "pypi-", "hrku-", "SG.", "shpat_", "shpca_", "shppa_", "oauth:", "dop_v1_", "doo_v1_", "sl.",
)
PAYMENT_TOKEN_PREFIXES = ("sk_live_", "sk_test_", "pk_live_", "pk_test_", "rk_live_", "rk_test_")
CLOUD_COOKIE_WORDS = (
    "aliyun_", "alicloud_", "acs_", "login_aliyunid", "qcloud_", "tencent_", "uin=", "skey=", "aws-", "awsalb", "awsalbcors", "x-amz-",
    "huaweicloud_", "hws_", "bce_", "baidu_", "qiniu_", "upyun_",
)
COOKIE_CONTEXT_WORDS = ("cookie", "cookies", "set-cookie", "setcookie", "set_cookie", "sessionid", "session_id", "jsessionid", "phpsessid", "asp.net_sessionid")
COOKIE_NAMES = (
    "sessionid", "jsessionid", "phpsessid", "cookie2", "usercookie", "localstorage", "sessionstorage", "visitkey", "globalmemory", "shshshfp",
    "referer", "msgreaded", "logedout", "removelogincache",
)
COOKIE_SYNTAX_WORDS = ("path=/", "httponly", "expires=", "secure", "samesite", "domain=", "max-age=")
COOKIE_NAME_WORDS = ("token", "session", "sid", "auth", "cookie", "login", "ticket", "jwt", "credential")
AK_PREFIXES = ("LTAI", "AKID", "AKIA", "ABIA", "ACCA", "ASIA")
AK_WORDS = ("accesskeyid", "access_key_id", "ossaccesskeyid", "secretid", "secret_id", "akid", "accesskey", "access_key")
SK_WORDS = ("accesskeysecret", "access_key_secret", "secretaccesskey", "secret_access_key", "ossaccesskeysecret", "secretkey")
AK_SK_WORDS = ("secret_key", "secretkey", "secret_id", "secretid", "akid")
CURVE_WORDS = ("p521", "p384", "p256", "p224", "p192", "curve", "ed25519", "secp256k1", "gred", "prime:", "type:", "basis:", "lambda:", "beta:")
PUBLIC_KEY_WORDS = ("public", "pubkey", "publickey")
PRIVATE_KEY_WORDS = ("private", "privatekey", "privkey", "secret", "secretkey")
RSA_WORDS = ("setpublic", "setpublickey", "set_public", "set_public_key", "publickey", "public_key", "rsapublic", "rsa_public", "modulus", "exponent", "rsa")
BASE64_PUBLIC_PREFIXES = ("MIGf", "MIIBIj", "MIIBoj", "MHQ", "MHY")
BASE64_PRIVATE_PREFIXES = ("MIICd", "MIICe", "MIICX", "MIIE", "MIGH", "MIGE")
HEX_TOKEN_LENGTHS = (24, 32, 40, 64)
HEX_TOKEN_WORDS = ("token", "auth", "authorization", "bearer", "apikey", "api_key", "appkey", "app_key", "accesstoken", "access_token", "secretkey", "secret_key")
HEX_SESSION_WORDS = ("session", "sessionid", "session_id", "credential")
HEX_ID_KEYS = ("id", "target_id", "source_id", "_shasum", "docid", "objectid", "uid", "card_id", "_id", "doc_id")
APP_KEY_WORDS = ("appkey", "app_key", "apikey", "api_key", "accesskey", "access_key")
APP_KEY_PUBLIC_WORDS = ("appkey", "app_key", "apikey", "api_key")
APP_KEY_CREDENTIAL_WORDS = ("accesskey", "access_key", "secret")
SECRET_WORDS = (
    "secret", "appsecret", "app_secret", "clientsecret", "client_secret", "secretkey", "secret_key", "memberappid", "memberappsecret",
    "member_app_id", "member_app_secret", "invoiceappid", "invoiceappsecret", "invoice_app_id", "invoice_app_secret", "ticketappid",
    "ticketappsecret", "ticket_app_id", "ticket_app_secret", "v2appid", "v2appsecret", "v2_app_id", "v2_app_secret", "signappid", "sign_app_id",
    "wxcontactkey", "wx_contact_key", "alipayappid", "alipay_app_id",
)
SESSION_KEY_WORDS = ("session_key", "sessionkey")
PASSWORD_WORDS = ("password", "passwd", "dbpwd", "db_pwd", "mysqlpwd", "redispwd", "ftppwd")
PASSWORD_PLACEHOLDERS = ("xxx", "***", "password", "123456", "admin", "root", "test", "null", "none", "empty", "undefined", "default")
MAP_WORDS = ("mapkey", "map_key", "amap", "qqmap", "bmap", "googlemap", "tencentmap", "gaodemap", "baidumap")
MAP_KEY_NAMES = (
    "mapkey", "map_key", "amapkey", "amap_key", "amapwxkey", "amapwebkey", "amapwebservicekey", "amapmpkey", "gdmapkey", "gaodemapkey", "qqmapkey",
    "tencentmapkey", "bmapkey", "bmapak", "bmapwxak", "baidumapkey", "baidumapak", "googlemapkey", "vite_app_map_key",
)
ANALYTICS_WORDS = (
    "mobkey", "umeng", "umengkey", "bugly", "buglyid", "buglykey", "sentry", "sentrydsn", "mixpanel", "sensors", "sensorsdata", "growingio", "zhugeio",
    "analyticskey", "analyticsid", "trackingid", "siteid", "site_id",
)
CODE_PREFIXES = ("on", "get", "set", "is", "has", "can", "do", "will", "did")
UPLOAD_POLICY_WORDS = ("bucket", "content-length-range", "starts-with", "x-amz-credential", "x-oss-")

#: Payment parameter names, lower case, and their slugs.
PAYMENT_NAMES = (
    ("timestamp", "payment_request_params"), ("time_stamp", "payment_request_params"), ("noncestr", "payment_nonce"), ("nonce_str", "payment_nonce"),
    ("paysign", "payment_pay_sign"), ("pay_sign", "payment_pay_sign"), ("signtype", "payment_sign_type"), ("sign_type", "payment_sign_type"),
)
PAYMENT_KEY_WORDS = (("paysign", "payment_pay_sign"), ("pay_sign", "payment_pay_sign"), ("noncestr", "payment_nonce"), ("nonce_str", "payment_nonce"))
PAYMENT_EVIDENCE = ("requestpayment", "prepay_id", "noncestr", "nonce_str", "paysign", "pay_sign", "signtype", "sign_type", "package")
PAYMENT_SECRET_WORDS = (
    "mchkey", "mch_key", "merchantkey", "merchant_key", "mchsecret", "mch_secret", "merchantsecret", "merchant_secret", "paykey", "pay_key",
    "paysecret", "pay_secret", "wxpaykey", "wxpay_key", "alipaykey", "alipay_key", "signkey", "sign_key", "apisecret", "api_secret", "partnerkey",
    "partner_key",
)

# --- fixed values: identifiers ------------------------------------------------------------------------------

DEVICE_WORDS = ("idfa", "idfv", "imei", "imsi", "meid", "androidid", "android_id", "deviceid", "device_id", "macaddress", "mac_address", "oaid", "udid")
AD_WORDS = ("advertisingid", "advertising_id", "trackingid", "tracking_id")
AD_SEGMENTS = (("adid", "ad", "id"), ("ad_id", "ad", "id"), ("gaid", "ga", "id"))
USER_WORDS = ("userid", "user_id", "memberid", "member_id", "openid", "unionid", "accountid", "account_id", "tenantid", "tenant_id", "orgid", "org_id", "companyid", "company_id")
ORDER_WORDS = ("orderid", "order_id", "orderno", "order_no", "transactionid", "transaction_id", "tradeno", "trade_no")
DEVICE_LENGTHS = (12, 15, 16, 32, 36)

# --- fixed values: cryptography -----------------------------------------------------------------------------

WEAK_ALGORITHMS = ("md5", "sha1", "sha-1", "des", "rc4", "md4", "md2")
SENSITIVE_CRYPTO_WORDS = (
    "password", "passwd", "pwd", "secret", "token", "key", "sign", "signature", "verify", "encrypt", "decrypt", "hash", "digest", "auth", "credential",
)
IV_WORDS = ("nonce", "sm4_iv", "sm4iv", "vector")
AES_WORDS = ("aeskey", "aes_key", "encryptkey", "encrypt_key", "deskey", "des_key", "sm4key", "sm4_key")
IV_HEX_LENGTHS, IV_BASE64_LENGTHS, IV_TEXT_LENGTHS = (16, 24, 32), (12, 16, 22, 24), (8, 12, 16)
IV_NOISE_WORDS = (
    "enterkeyhint", "controlslist", "autocomplete", "hreflang", "datetime", "contenteditable", "spellcheck", "draggable", "inputmode", "tabindex",
    "collected", "activity", "status", "signup", "avatar", "native", "relative", "sensitive", "positive", "negative", "primitive", "interactive",
    "alternative", "representative", "administrative",
)

# --- fixed values: headers ------------------------------------------------------------------------------------

HTTP_HEADERS = (
    "accept", "accept-charset", "accept-encoding", "accept-language", "accept-ranges", "access-control-allow-credentials",
    "access-control-allow-headers", "access-control-allow-methods", "access-control-allow-origin", "access-control-expose-headers",
    "access-control-max-age", "access-control-request-headers", "access-control-request-method", "age", "allow", "authorization", "cache-control",
    "connection", "content-disposition", "content-encoding", "content-language", "content-length", "content-location", "content-range",
    "content-security-policy", "content-type", "cookie", "date", "etag", "expect", "expires", "forwarded", "from", "host", "if-match",
    "if-modified-since", "if-none-match", "if-range", "if-unmodified-since", "last-modified", "link", "location", "max-forwards", "origin", "pragma",
    "proxy-authenticate", "proxy-authorization", "range", "referer", "referrer", "retry-after", "server", "set-cookie", "strict-transport-security",
    "te", "trailer", "transfer-encoding", "upgrade", "user-agent", "vary", "via", "warning", "www-authenticate", "x-content-type-options",
    "x-frame-options", "x-xss-protection", "x-requested-with", "x-forwarded-for", "x-forwarded-proto", "x-forwarded-host", "x-real-ip",
    "x-csrf-token", "x-xsrf-token", "x-api-key", "x-request-id", "x-correlation-id", "x-trace-id", "x-sdk-version", "x-seqid", "x-amz-signature",
    "x-timestamp", "x-nonce", "x-signature", "x-token", "x-auth", "x-client-time",
)

# --- fixed values: ledger --------------------------------------------------------------------------------------

INFRA_STATUSES = ("error:result_queue_full", "error:worker_crash", "error:commit_failed", "error:miniapp_meta_failed", "error:writer_dead", "aborted")
FILE_FAILURE_STATUSES = ("timeout", "skipped_too_large", "missing", "error:sandbox_crash")
MOST_APP_ID, MOST_HTML_BYTES, MOST_TEXT_BYTES = 32, 2 * 1024 * 1024, 65_000
EXCLUDED_FOLDERS = (
    "@babel", "miniprogram_npm", "npm", "unpackage", "node_modules", "uni_modules", "external", "uview-ui", "third_party", "third-party", "vendor",
    "dist", "build", "out", "static", "assets", "images", "img", "fonts", "icons", "media", "audio", "video",
)
SCANNED_EXTENSIONS = ("js", "json", "wxml", "wxs", "wxss", "html")

# --- fixed values: what may be kept of scripts that do not parse; the first kind whose pattern is the whole value -------

FALLBACK_RULES = (
    ("url", r"""(?i:(?:https?|wss?|ftp|cloud|cos|oss|s3|plugin|plugin-private)://)[^\s"'<>\\^`{}|]+"""),
    ("abs_path", r"/(?!/)[A-Za-z0-9._~%@+\-]+(?:/[A-Za-z0-9._~%@+\-]*)*(?:\?[A-Za-z0-9._~%@+\-=&/,:;]*)?"),
    ("rel_path", r"\.\.?/[A-Za-z0-9._~%@+\-]+(?:/[A-Za-z0-9._~%@+\-]*)*(?:\?[A-Za-z0-9._~%@+\-=&/,:;]*)?"),
    ("bare_path", r"[A-Za-z0-9_@][A-Za-z0-9._~%@+\-]*(?:/[A-Za-z0-9._~%@+\-]+)+/?(?:\?[A-Za-z0-9._~%@+\-=&/,:;]*)?"),
    ("wx_appid", r"wx[0-9a-f]{16}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"),
    ("cloud_ak", r"(?:LTAI|AKID|AKIA|ASIA|ABIA|ACCA)[A-Za-z0-9]{12,40}"),
    ("token_prefix", r"(?:ghp_|gho_|ghu_|ghs_|ghr_|glpat-|xox[bpar]-|sk_live_|sk_test_|rk_live_|pk_live_|SG\.)[A-Za-z0-9_.\-]{16,}"),
    ("auth_header", r"(?:Bearer|Basic) [A-Za-z0-9+/=._\-]{10,}"),
    ("google_key", r"AIza[0-9A-Za-z_\-]{35}"),
    ("tmap_key", r"[A-Z0-9]{5}(?:-[A-Z0-9]{5}){5}"),
    ("pem", r"-----BEGIN [A-Z ]+-----[\s\S]*"),
    ("der_key_b64", r"MI[IG][A-Za-z0-9+/]{60,}={0,2}"),
    ("hex_secret", r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}"),
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"),
    ("ipv4", r"(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?"),
    ("cn_mobile", r"1[3-9]\d{9}"),
    ("cn_id18", r"\d{17}[\dXx]"),
)
#: Kinds that are paths (they need a letter, and no part in a third-party folder), and kinds that need eight different characters.
FALLBACK_PATHS = ("abs_path", "rel_path", "bare_path")
FALLBACK_VARIED, FALLBACK_LEAST_VARIED = ("der_key_b64", "hex_secret"), 8
FALLBACK_LEAST_LENGTH = 4
THIRD_PARTY_FOLDERS = ("@babel", "miniprogram_npm", "node_modules")
STYLE_SCRIPT, STYLE_SCRIPT_ENDS = "app-wxss.js", ("-wxss.js", ".wxss.js")
#: Longest line that is its own statement, and the characters kept on each side of a value in a longer one.
MOST_LINE, LINE_AROUND = 512, 200

# --- fixed values: places of values ------------------------------------------------------------------------------

URL_FRAGMENT_CHARS, MATERIAL_CHARS = "/\\:?&=", "@!#*^$%~+"
#: Passwords that stay such whatever their place.
PASSWORD_KNOWN = (
    "password1", "password123", "admin123", "Admin123", "emoney5", "video123", "Nihao123", "1Passw0rd!xyz", "jia23xia4kaoshi5t2", "123456a",
    "o0IN8wTN50QMxX-V4siq_GSRFuts", "mnP7XKDCaWFjINWi", "signBoardPassword_S8hY", "vPYkA3HAAviBMiXnWQUxWdoPKPs=",
    "Zq0s69O6YrvG090LgOg19z1l8RW99993=", "2019userperm=", "cndcarezIUAGNu5=", "xXxxx9xXX9XxXXx9X9x=", "Admin@123:456", "QwErTy&2024",
    "s3cr3tSalt&pepper", "MyPwd__2024", "67884E9%^&*67899A26C18DC28",
)
ALGORITHM_NAME = (
    r"hmacWith(?:SHA|MD)[0-9]*|[a-z0-9]+With(?:RSA|DSA|ECDSA)Encryption|rsaEncryption|RSAES-OAEP|mgf1|pSpecified|PBKDF2|scrypt|ecdsa-with-[A-Za-z0-9-]+"
)
#: CJK letters as a class, and the literals that make a table, an array, and the most of a run that are counted.
CJK_LETTERS = "\u3400-\u9fff\uf900-\ufaff\u3040-\u30ff"
TABLE_LEAST, ARRAY_LEAST, LITERAL_RUN_MOST, LITERAL_RUN_WINDOW = 3, 6, 64, 4096
IV_KEY_WORDS = ("aes", "encrypt", "decrypt", "sm4", "des", "nonce", "vector")
IV_LIST_MOST, IV_ELEMENT_HEX, IV_ELEMENT_BASE64 = 5, (16, 24, 32, 48, 64), (16, 22, 24)
REPORTING_CALLS = (
    "sensors.track", "sensorsclick.send", "track.clickevent", "track.pageshowevent", "ehisensors.track", "_mixpanel.send", "exposure.removeobserverbyclassname",
)
REPORTING_NAMES = ("sensorstrack", "satrack", "sensorstrackclick", "saevent", "sentrycaptureevent", "emotionalrulereport", "xjsensorstrack")

# --- fixed values: beginnings of style class names -------------------------------------------------------------------

CSS_STEMS = (
    "bg", "text", "font", "border", "m", "p", "row", "col", "flex", "grid", "btn", "icon", "fade", "slide", "active", "hover", "focus", "dropdown",
    "item", "option", "menu", "nav",
)
