"""Shape predicates on single values."""

import math

import pytest
from pyspark.sql import functions as F

from sparklode.functions import context as C
from sparklode.functions import shapes as S
from sparklode.operators import noise as N


def ask(spark, expression, *values):
    """The expression's results for the values of a column v."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expression.alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def v():
    return F.col("v")


CASES = [
    (S.is_imei, ["490154203237518", "000000000000000", "49015420323751x"], [True, False, False]),
    (S.ip_kind, ["10.0.0.1", "172.31.0.1", "172.32.0.1", "127.0.0.1", "0.0.0.0", "8.8.8.256", "1.2.3", "192.168.0.9"], ["private", "private", "public", "noise", "noise", None, None, "private"]),
    (S.is_uuid, ["123e4567-e89b-12d3-a456-426614174000", "123e4567e89b12d3a456426614174000"], [True, False]),
    (S.is_mac, ["00:1b:44:11:3a:b7", "00-1B-44-11-3A-B7", "00:1b-44:11:3a:b7"], [True, True, False]),
    (S.is_object_id, ["5f0000000000000000000000", "ff0000000000000000000000", "5F0000000000000000000000"], [True, False, False]),
    (S.is_hex_token, ["0123456789abcdef0123456789abcdef", "00000000000000000000000000000000", "0123"], [True, False, False]),
    (S.digit_type, ["11010119900307704X", "110101199003077051", "13800138000", "12345678901", "14012345678", "123", "999999199003077051"], [None, "reject", "phone", "reject", "reject", "", "reject"]),
    (S.email_class, ["zhangsan@qq.com", "a@b.cn", "zhangsan@example.com", "noreply@mail.example.net", "a@b@c.com", "a@localhost", "@demo.com", "****@demo-mail.com"], ["strict", "strict", "loose", "loose", None, None, None, "loose"]),
    (S.cloud_token, ["ghp_" + "a" * 36, "sk_live_" + "0" * 24, "npm_" + "d" * 36, "SG." + "c" * 22, "pk_test_panel_title flex-c", "ghp_abcdefgh ijklmnopqrst", "ghp_a", "plain"], ["token"] * 4 + ["noise", "noise", None, None]),
    (S.is_region, ["ap-shanghai-1", "cn-northwest-1", "eu-moscow", "na-toronto", "me-avatar", "0x1f1e6", "cn-big5"], [True, True, True, True, False, False, False]),
    (S.is_storage_host, ["b1.oss-cn-hangzhou.aliyuncs.com", "b1.s3.us-east-1.amazonaws.com", "cos.ap-shanghai.myqcloud.com", "at.alicdn.com", "dashscope.aliyuncs.com", "b1.bj.bcebos.com"], [True, True, True, False, False, False]),
    (S.algorithm, ["MD5", "sha-256", "HmacSHA", "SHA256"], ["weak", "strong", None, "strong"]),
    (S.is_identifier_noise, ["0123456789abcdef", "abcdabcdabcdabcd", "2021000123456789", "1234567890123456", "01:00:5e:00:00:01", "9f86d081884c7d65"], [True, True, True, True, True, False]),
    (N.is_unwanted, ["getUserInfo", "#FF0066aa", "12345", "110101", "339999", "sha256-abcDEF==", "deadbeef-12", "abc(def", "", "hello world1"], [True, True, True, True, False, True, True, True, True, False]),
    (N.is_wanted, ["MD5", "myPhoneNumber", "plainword"], [True, True, False]),
]


@pytest.mark.parametrize("predicate, values, wanted", CASES, ids=[c[0].__name__ for c in CASES])
def test_shapes(spark, predicate, values, wanted):
    got = ask(spark, predicate(v()), *values)
    if predicate is S.digit_type:
        got, wanted = got[1:], wanted[1:]
    assert got == wanted


def test_id_number(spark):
    """A number is valid exactly with its own check character, a province and a real date."""
    body = "11010119900307704"
    weights, signs = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"
    good = signs[sum(int(c) * w for c, w in zip(body, weights)) % 11]
    assert ask(spark, S.is_id_number(v()), *[body + c for c in "0123456789X"]) == [c == good for c in "0123456789X"]
    no_day = "11010120260230704"
    assert ask(spark, S.digit_type(v()), *[no_day + c for c in "0123456789"]) == ["reject"] * 10


def test_entropy(spark):
    def brute(t):
        return -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) if t else 0

    values = ["", "a", "aabb", "abcdefgh", "mississippi", "日本日本語", "a.b*c\\Q"]
    assert ask(spark, S.entropy(v()), *values) == pytest.approx([brute(v) for v in values])


def test_external(spark):
    rows = [('H5PayTradeNo: "H5PayTradeNo"', "H5PayTradeNo", 'H5PayTradeNo: ""'), ('password: "password"', "password", 'password: ""'), ('["auth.updatePassword"]', "auth.updatePassword", '[""]'), ("a(b*c", "(b*", "ac"), (r"x\Ey", r"\E", "xy")]
    got = spark.createDataFrame(rows, "s string, v string, w string").select(C.external(F.col("s"), F.col("v")).alias("r"), "w").collect()
    assert all(r.r == r.w for r in got)


def test_bound_keys(spark):
    rows = [('timeStamp: "123", other', "123", ["timeStamp"]), ('a = b || "v1"; c: "v1"', "v1", ["a", "c"]), ('key: "xv1x"', "v1", []), ('f("v1")', "v1", []), ('"nonceStr":"v1"', "v1", ["nonceStr"])]
    got = spark.createDataFrame(rows, "s string, v string, w array<string>").select(C.bound_keys(F.col("s"), F.col("v")).alias("r"), "w").collect()
    assert [r.r for r in got] == [r.w for r in got]


def test_segments(spark):
    yes = ["o.uid", "visitorUid", "uidRule", "uid:"]
    no = ["uuid", "mobxGuid", "guide", "skuId", "fluid"]
    assert ask(spark, C.has_segment(v(), "uid", ("uuid", "guid", "guide")), *yes, *no) == [True] * len(yes) + [False] * len(no)


def test_near_duplicates(spark):
    def brute(ids):
        gaps = sorted(b - a for a, b in zip(ids, ids[1:]) if b > a)
        if len(ids) < 3 or not gaps:
            t = 30
        else:
            n = len(gaps)
            t = max(10, min(120, round((gaps[(n - 1) // 2] + gaps[n // 2]) / 2 * 1.5)))
        kept = []
        for i in ids:
            if not kept or i - kept[-1] > t:
                kept.append(i)
        n = len(kept)
        return t, kept if n <= 25 else [kept[i] for i in dict.fromkeys(round(i * (n - 1) / 24) for i in range(25))]

    lists = [[1], [1, 5], [1, 2, 3], [0, 40, 80, 400], list(range(0, 4000, 121)), [5, 5, 5], list(range(0, 9000, 130)), [0, 7, 21, 22, 60, 61, 300]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<bigint>").withColumn("t", N.near_threshold(F.col("ids")))
    got = rows.select("i", "t", N.evenly(N.far_enough(F.col("ids"), F.col("t"))).alias("k")).orderBy("i").collect()
    assert [(r.t, r.k) for r in got] == [brute(x) for x in lists]
