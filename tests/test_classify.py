"""The chain on single constants: a positive and a negative for the gates, pairs, tail rules."""

import pytest
from pyspark.sql import functions as F

from sparklode.functions import positions as P
from sparklode.operators.classify import classify
from sparklode.operators.noise import filter_constants
from sparklode.plans.taxonomy import TYPES, type_dimension

ID = {slug: i for i, slug, *_ in TYPES}

CASES = [
    # numbers with dots: certificate numbers, versions, addresses
    ("2.5.29.37", 'cert.oid="2.5.29.37"', [2304]),
    ("1.2.16.9", 'oid: "1.2.16.9"', [2304]),
    ("4.0.2.117", 'sdkVersion: "4.0.2.117"', [2304]),
    ("10.8.44.3", 'gateway: "10.8.44.3"', [1802]),
    ("110101199003077051", 'holder: "110101199003077051"', [2304]),
    # mail, tokens
    ("orders@shop-north.com", 'to: "orders@shop-north.com"', [2303]),
    ("orders@example.org", 'to: "orders@example.org"', [2304]),
    ("gho_" + "b7" * 18, 'x("v")', [1205]),
    ("sk_live_two words here ok", 'x("v")', [1207]),
    # addresses
    ("https://fonts.acme.cn/t/face.ttf?v=3", "u", [1705, 2304]),
    ("https://h1.acme.cn/pull?from=cos-north", "u", [1705]),
    ("https://depot9.oss-cn-beijing.aliyuncs.com/y/2.png?x-oss-process=a", "u", [1303]),
    ("https://s3.eu-west-1.amazonaws.com/depot9/y", "u", [1303]),
    ("https://img.acme.cn/a@3x.png", "u", [1706]),
    ("https://anna:secret7@h2.acme.cn/list", "u", [1601, 1701, 1705]),
    ("http://www.w3.org/1999/xlink", "u", [9901]),
    ("http://127.0.0.1:9000/ping", "u", [1803]),
    ("https://h3.acme.cn/z?mobile=13912345678&n=4", "u", [1705, 2302, 2304]),
    ("us-west-2", 'zone: "us-west-2"', [1302]),
    # pages and modules
    ("pages/media/photo.png", "p", [1905]),
    ("pages/shop/cart.js", "p", [1906]),
    ("pages/demo/start", "p", [1902]),
    ("pages/shop/list?kind=2", "p", [1904]),
    ("pages/plugin-x/main", "p", [1903]),
    ("pages/shop/page.json", "__wxAppCode__['pages/shop/page.json']={}", [1907]),
    ("/member/login", "u", [1702]),
    ("/admin/orders", "u", [1704]),
    ("/components/dialog", "u", [1906]),
    ("/src/components/price-login/index", '"usingComponents":{"p":"/src/components/price-login/index"}', [1906]),
    ("/src/components/price-login/index", 'link: "/src/components/price-login/index"', [1702]),
    ("/stock/queryAll", 'post("/stock/queryAll")', [2001]),
    ("/app/pages/cart/index", "u", [1902]),
    # marks of tools
    (";width:", "x", []),
    ("__proto_1", "x", []),
    ("data-v-0f1e2d3c", "x", []),
    ("x-shop-trace", "x", []),
    ("wxfedcba9876543210", "x", [1907]),
    ("http%3a%2f%2fb.cn", "x", [2202]),
    ("plugin://chart/draw", "x", [1903]),
    ("-----BEGIN RSA PRIVATE KEY-----MIIC", "x", [2102]),
    ("data:text/plain;base64,QUJD", "x", [2201]),
    # payment, devices, people
    ("prepay_id=wx20987654321012", "x", [2403]),
    ("prepay_id=none", "x", [2407]),
    ("490154203237518", 'sn: "490154203237518"', [2501]),
    ("13912345678", 'call: "13912345678"', [2302]),
    ("1712345678", 'timeStamp: "1712345678"', [2401]),
    ("1712345678", 'BuildTimestamp: "1712345678"', [2304]),
    ("fedcba9876543210fedcba9876543210fedcba98", 'token: "fedcba9876543210fedcba9876543210fedcba98"', [1602]),
    ("fedcba9876543210fedcba9876543210fedcba98", 'colour: "fedcba9876543210fedcba9876543210fedcba98"', []),
    ("several plain words", "x", []),
    ("./near/here", "x", []),
    ("?strange=1", "x", [9901]),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "file string, sid int, pos long, value string, src string, stmt string")


def test_chain(spark):
    rows = [(str(i), 0, 1, v, "js-ast", s.replace('"v"', f'"{v}"')) for i, (v, s, _) in enumerate(CASES)]
    got = {}
    for r in classify(frame(spark, rows)).collect():
        got.setdefault(int(r.file), []).append(ID[r.slug])
    wrong = [(CASES[i][:2], sorted(got.get(i, [])), w) for i, (_, _, w) in enumerate(CASES) if sorted(got.get(i, [])) != w]
    assert not wrong


AK, SK = "AKID" + "z8Kd93hQx1TbY7Lm", "Zx9" + "kQ2wE4rT6yU8iO0pA1sD3fG5hJ7"


def test_pairs(spark):
    rows = [
        ("next", 0, 1, AK, "js", f'secretId: "{AK}"'), ("next", 1, 2, SK, "js", f'secretKey: "{SK}"'),
        ("before", 0, 1, SK, "js", f'secretKey: "{SK}"'), ("before", 1, 2, AK, "js", f'secretId: "{AK}"'),
        ("alone", 0, 1, AK, "js", f'name: "{AK}"'),
        ("same", 0, 1, AK, "js", f'secretId: "{AK}"'), ("same", 1, 2, AK, "js", f'secretId: "{AK}"'),
    ]
    got = {}
    for r in classify(frame(spark, rows)).collect():
        got.setdefault(r.file, []).append((r.slug, r.value))
    pair = [("cloud_cred_ak_sk_pair", f"AK={AK}, SK={SK}")]
    assert got["next"] == pair and got["before"] == pair
    assert all(s != "cloud_cred_ak_sk_pair" for s, _ in got.get("alone", []) + got.get("same", []))
    risk = {slug: r for _, slug, _, r, _ in TYPES}
    assert all(risk[s] < 4 for s, _ in got.get("same", []))


def test_filter(spark):
    rows = [("f", s, v, "js", "stmt") for s in range(0, 400, 5) for v in ["https://a.cn/x"]] + [("f", 1, "short", "js", "s"), ("f", 1, None, "js", "s"), ("f", 2, "getUserName", "js", "s"), ("f", 2, "data:" + "A" * 300, "js", "s")]
    got = filter_constants(spark.createDataFrame(rows, "file string, sid int, value string, src string, stmt string")).orderBy("pos").collect()
    assert {r.value for r in got} == {"https://a.cn/x"} and [r.pos for r in got] == list(range(1, len(got) + 1))
    ids = [r.sid for r in got]
    assert len(ids) <= 25 and all(b - a > 10 for a, b in zip(ids, ids[1:]))


def test_types(spark):
    rows = type_dimension(spark).collect()
    assert len(rows) == len({r.type_id for r in rows}) == 67 and {r.risk_level for r in rows} == set(range(6))


def test_empty(spark):
    assert classify(frame(spark, [])).collect() == []


def test_partitions_do_not_matter(spark):
    rows = [(str(i % 7), i, i, v, "js", s) for i, (v, s, _) in enumerate(CASES)]
    found = lambda n: sorted((r.file, r.pos, r.slug, r.value) for r in classify(frame(spark, rows).repartition(n)).collect())
    assert found(1) == found(5)


@pytest.mark.parametrize("bad", [None, "", "((", "\\E", "[a-z"])
def test_odd_values(spark, bad):
    classify(frame(spark, [("f", 0, 1, bad, "js", bad), ("f", 1, 2, "x", None, None)])).filter(F.lit(True)).collect()


# --- places -----------------------------------------------------------------------------------------------------

HEX = "a1b2c3d4e5f60718293a4b5c6d7e8f90"


@pytest.mark.parametrize("value, stmt, by_position, noise", [
    ("Sun2024x", 'f(pwd); console.info("Sun2024x")', False, True),
    ("Sun2024x", 'setPwd("Sun2024x")', False, False),
    ("Sun2024x", 'x = pwd ? "Sun2024x" : y', False, False),
    ("Sun2024x", 'key: "Sun2024x"', False, False),
    ("sunset:", 'pwd + "sunset:"', False, True),
    ("Sun:24xY", 'pwd + "Sun:24xY"', False, False),
    ("c2Fs1GVkX18xyz0=", 'return pwd("c2Fs1GVkX18xyz0=")', False, False),
    ("sunset-a", '["sunset-a", "b", "c"]', False, False),
    ("sunset-a", '["sunset-a", "b", "c"]', True, True),
    ("sunset-a", 'f("sunset-a", "b", "c")', True, False),
    ("Sun2024x", '["Sun2024x", "b", "c"]', True, False),
    ("moon_x", "wx.set(t.data.moon_x)", True, True),
    ("admin123", '["admin123", "b", "c"]', True, False),
    ("forgotHint", 't(o, "forgotHint", "忘记密码")', False, True),
    ("forgotHint", 't(o, "forgotHint", "forgot it")', False, False),
    ("blowfishName", 'a("1.2.840.113549.3.9", "blowfishName")', False, True),
    ("hmacWithSHA512", 'x("hmacWithSHA512")', False, True),
    ("1234567AbCdEfG"[:13], '["1234567AbCdEf", "7xYZ12", "c", "d", "e", "f"]'.replace("AbCdEf", "AbCdEf"), False, True),
    ("EVNT00123", '"EVNT00123" === r.code', False, True),
    ("moonlit7", '"moonlit7" === r.code', False, False),
    ("EVNT00123", 'u.beforeLog("EVNT00123", 1)', False, True),
    (HEX, f'eq(pbkdf2("password", "s", 1), "{HEX}")', False, True),
    ("absent", 'console.log("other")', False, False),
])
def test_password_places(value, stmt, by_position, noise):
    assert P.is_password_noise(value, stmt, by_position) == noise


@pytest.mark.parametrize("value, stmt, kept", [
    (HEX, f'iv: "{HEX}"', True), (HEX, f'f("{HEX}")', True), (HEX, f'vector; e = ["a", "b", "c", "d", "e", "{HEX}"]', False), (HEX, f'vector; e = ["{HEX}", "{HEX[::-1]}"]', True),
    (HEX, f'aesKeys = ["a", "b", "c", "d", "e", "{HEX}"]', True), (HEX, f'e["{HEX}"]', True), (HEX, f'vector; e = [["a/b", "c"], "{HEX}", f(1, [2]), "x", "y", "z"]', False), (HEX, "vector", True),
])
def test_iv_places(value, stmt, kept):
    assert P.is_iv_place(value, stmt) == kept


@pytest.mark.parametrize("value, stmt, reported", [
    ("home_click1", 'a.$sensors.track("home_click1", {})', True), ("home_click1", 'a.sensors.track({n: "home_click1"})', False), ("home_click1", 'saTrack(["home_click1"])', True), ("home_click1", 'wx.get("home_click1")', False),
    ("home_click1", 'saTrack("home_click1"); wx.get("home_click1")', False), ("1732848545", 'saTrack("1732848545")', False), ("home_click1", "none", False),
])
def test_reported(value, stmt, reported):
    assert P.is_reported(value, stmt) == reported


@pytest.mark.parametrize("stmt, bound", [
    ('id: "v"', True), ('{token: "v", id: "v"}', False), ('var token = d.id ? d.id : "v"', False), ('x = {token: c.id ? c.id : "v"}', False), ('switch (x) { case id: "v" }', False), ('{a: b ? c : d, id: "v"}', True), ('f("v")', False), ('uid = u || "v"', True),
])
def test_id_bound(stmt, bound):
    assert P.is_id_bound(HEX, stmt.replace("v\"", HEX + "\"")) == bound
