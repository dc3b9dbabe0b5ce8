"""Lexers, file trees, the store, the stream."""

import json
import os
import shutil

import pytest

from pyspark.sql import functions as F

from sparklode.functions import rules as R
from sparklode.functions.shapes import fallback_kind as fallback_column
from sparklode.operators import store as D
from sparklode.plans.pipeline import findings_of, scan
from sparklode.sources.extract import constants_of, fallback_kind, is_style_script, unescape
from sparklode.sources.files import read_interchange, scan_tree
from sparklode.plans.taxonomy import type_dimension
from sparklode.sources.sinks import constants_module, ddl, dry_run, execute, insert_sql, seed_sql, split_sql, type_ids, upsert_items, write_json
from sparklode.streaming.scan import read_completed, read_items, read_ledger, start_scan


def values(text, ext):
    rows, status = constants_of(text, ext)
    return {r[0] for r in rows}, status


@pytest.mark.parametrize(
    "ext, text, wanted",
    [
        ("js", 'const u = opt ?? "https://api.example.com/v1/login";', {"https://api.example.com/v1/login"}),
        ("js", "a = `plain text`; b = `has${x + 'inner' + `deep one`}interp`", {"plain text", "inner", "deep one", "interp"}),
        ("js", "// 'comment'\n/* \"also one\" */ var r = /['\"]x/g, s = 'right one';", {"right one"}),
        ("js", "x = 1 / 2; y = 'after division' / z", {"after division"}),
        ("js", "f('it\\'s here', \"tab\\there\")", {"it's here", "tab\there"}),
        ("js", "'unterminated\nvar a = 'good value'", {"good value"}),
        ("json", '{"a":1,"b":true,"c":null,"d":"okay!","e":["okay!",{"f":"deeper"}]}', {"okay!", "deeper"}),
        ("json", 'var x = {"k":"value1"}; rest', {"value1"}),
        ("json", "{broken", set()),
        ("html", '<div title="{{x}}"><span>{{ hello }}</span></div>', set()),
        ("html", '<img src="/images/logo.png" alt="Logos"><p>Order Now</p>', {"/images/logo.png", "Logos", "Order Now"}),
        ("html", '<script>var t="</p>right";</script><style>p{content:"nothing"}</style>', {"</p>right"}),
        ("wxml", '<view wx:if="{{show}}" bind:tap="onTap">hello</view>', {"onTap", "hello"}),
        ("wxml", "<text>Tom & Jerry</text>", {"Tom & Jerry"}),
        ("wxs", "module.exports = { key: 'some value' }", {"some value"}),
        ("wxss", '/* "gone away" */ .a { background-image: url("/images/bg.png"); content: "Order Now"; }', {"/images/bg.png", "Order Now"}),
    ],
)
def test_lexers(ext, text, wanted):
    assert values(text, ext)[0] == wanted


def tagged(text, ext, file=""):
    return {(r[0], r[2]) for r in constants_of(text, ext, file=file)[0]}


def test_broken_scripts():
    text = "var a = 'words one';\nvar b /* no end\n, c = 'words two', d = { k: 'words three' };\nfunction f() { g('words four', '/api/four', '/node_modules/x', \"http:\\u002F\\u002Fh.cn/p\") }"
    assert tagged(text, "js") == {("words one", "js-ast"), ("words two", "js-regex"), ("words three", "js-regex"), ("/api/four", "js-regex"), ("http://h.cn/p", "js-regex")}
    # a style script keeps named literals only; a view script nothing but known kinds
    assert tagged(text, "js", "app1/app-wxss.js") == {("words one", "js-ast"), ("words two", "js-regex"), ("words three", "js-regex")}
    assert tagged(text, "wxs") == {("/api/four", "wxs"), ("http://h.cn/p", "wxs")}
    assert tagged("f(`a ${ {x: 'inner one'} } tail part`)", "js") == {("inner one", "js-ast"), (" tail part", "js-ast")}
    assert is_style_script("a\\b\\X.WXSS.js") and is_style_script("p/x-wxss.js") and not is_style_script("p/wxss.js")


def test_long_lines_keep_what_is_near():
    text = "x " * 2000 + "g('/api/one/two') /* open" + " y" * 2000
    assert all(len(r[3]) <= R.MOST_LINE for r in constants_of("/* open " + text, "js")[0])
    rows = {r[2]: r[3] for r in constants_of(text + "'", "js")[0]}
    assert "/api/one/two" in rows["js-ast"]


@pytest.mark.parametrize("value, kind", [
    ("https://a.cn/x", "url"), ("HTTP://a", "url"), ("http://", None), ("//a/b", None), ("/a", None), ("/a/b", "abs_path"), ("/1/2", None), ("./a/b", "rel_path"), ("a/b", None), ("aa/b", "bare_path"), ("/x/@babel/y", None),
    ("/x/y?@babel/", "abs_path"), ("12345678901234567X", "cn_id18"), ("13800000000", "cn_mobile"), ("0" * 32, None), ("0123456789abcdef" * 2, "hex_secret"), ("a@b.c", "email"), ("1.2.3.4:80", "ipv4"), ("  /a/b ", "abs_path"), ("/a\n/b", None),
])
def test_fallback_kinds(spark, value, kind):
    assert fallback_kind(value) == kind
    assert spark.createDataFrame([(value,)], "v string").select(fallback_column(F.col("v"))).first()[0] == kind


def test_view_markup():
    rows = constants_of('<view a:b="value one" hidden>first text<i>inner text</i>tail text</view><view b="value two">{{a<b}}</view>', "wxml")[0]
    assert {(r[0], r[3]) for r in rows} == {("value one", '<view a:b="value one">'), ("first text", "<view>first text</view>"), ("inner text", "<i>inner text</i>"), ("value two", '<view b="value two">')}
    rows = constants_of("<view a='value one'>first text<i>inner text</view>tail text", "wxml")[0]
    assert {(r[0], r[3]) for r in rows} == {("value one", '<view a="value one">'), ("first text", "<view>first text</view>"), ("inner text", "<i>inner text</i>"), ("tail text", "<>tail text</>")}


def test_lexer_status():
    assert values("", "js") == (set(), "empty")
    assert values("x" * (R.MOST_HTML_BYTES + 1), "html") == (set(), "skipped_too_large")
    assert constants_of("a" * 100_000 + "'x", "js", -1.0)[1] == "timeout"
    assert values("[" * 100_000, "json")[1] == "empty"


def test_unescape():
    assert unescape("https://a.b/c?x\\x3d1") == "https://a.b/c?x=1"
    assert unescape("\\u{110000}") == "\\u{110000}" and unescape("\\uZZZZ") == "uZZZZ" and unescape("\\u0041\\n") == "A\n"


def test_statements():
    rows, _ = constants_of('{"a": {"b": "value"}}', "json")
    assert rows == [("value", 0, "json", 'a/b: "value"')]
    rows, _ = constants_of('const token = "abcdef";\nfoo("other one");', "js")
    assert [(r[0], r[3]) for r in rows] == [("abcdef", 'const token = "abcdef"'), ("other one", 'foo("other one")' + ";")]


TOKEN = "0123456789abcdef0123456789abcdef01234567"


@pytest.fixture
def tree(tmp_path):
    files = {
        "app1/main.js": f'var token = "{TOKEN}"; var u = "https://api1.acme.cn/oauth/login";',
        "app1/node_modules/x.js": 'var token = "https://never.acme.cn/seen"',
        "app1/mygame.js": 'var token = "https://never.acme.cn/seen"',
        "app1/notes.txt": '"https://never.acme.cn/seen"',
        "app2/conf.json": json.dumps({"url": "https://api1.acme.cn/oauth/login", "n": 1}),
        "app2/blank.js": " ",
        "a" * 40 + "/x.js": 'var token = "https://never.acme.cn/seen"',
    }
    for name, text in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    return tmp_path


def test_scan(spark, tree):
    found, statuses = scan(scan_tree(spark, str(tree / "in")), spark)
    rows = found.collect()
    assert sorted((r.pkg, r.slug, r.value) for r in rows) == [
        ("app1", "server_cred_token", TOKEN), ("app1", "server_url_auth", "https://api1.acme.cn/oauth/login"), ("app2", "server_url_auth", "https://api1.acme.cn/oauth/login"),
    ]
    assert {(r.rel_path, r.status) for r in statuses.collect()} == {("app1/main.js", "ok"), ("app2/conf.json", "ok"), ("app2/blank.js", "empty")}
    items = {r.raw_value: r.ref_count for r in D.items_of(found).collect()}
    assert items == {TOKEN: 0, "https://api1.acme.cn/oauth/login": 1}
    assert D.occurrences_of(found).count() == 3
    done = spark.createDataFrame([("app1",)], "pkg string")
    assert {r.pkg for r in scan_tree(spark, str(tree / "in"), done).collect()} == {"app2"}


def test_files_are_read_once(spark, tree):
    found, _ = scan(scan_tree(spark, str(tree / "in")), spark)
    found.collect()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_stream_equals_batch(spark, tree):
    start_scan(spark, str(tree / "in"), str(tree / "store"), 1).awaitTermination()
    found, _ = scan(scan_tree(spark, str(tree / "in")), spark)
    want = {(r.hash_sha256, r.type_id, r.ref_count) for r in D.items_of(found).collect()}
    assert {(r.hash_sha256, r.type_id, r.ref_count) for r in read_items(spark, str(tree / "store")).collect()} == want


def test_stream_goes_on_after_a_batch_that_died(spark, tree, monkeypatch):
    import sparklode.streaming.scan as scanning

    real, calls = scanning.occurrences_of, []

    def dies(found):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(found)

    monkeypatch.setattr(scanning, "occurrences_of", dies)
    store = str(tree / "store")
    with pytest.raises(Exception):
        start_scan(spark, str(tree / "in"), store, 1).awaitTermination()
    assert len(read_ledger(spark, store).collect()) == 1
    start_scan(spark, str(tree / "in"), store, 1).awaitTermination()
    found, statuses = scan(scan_tree(spark, str(tree / "in")), spark)
    assert {(r.hash_sha256, r.ref_count) for r in read_items(spark, store).collect()} == {(r.hash_sha256, r.ref_count) for r in D.items_of(found).collect()}
    assert {tuple(r) for r in read_ledger(spark, store).collect()} == {tuple(r) for r in statuses.collect()}
    # without its checkpoint a scan leaves complete packages out
    shutil.rmtree(store + "/checkpoint")
    (tree / "in/app3").mkdir()
    (tree / "in/app3/a.js").write_text(f'var token = "{TOKEN}"')
    assert {r.pkg for r in read_completed(spark, str(tree / "in"), store).filter("completed").collect()} == {"app1", "app2"}
    start_scan(spark, str(tree / "in"), store + "2", 1, every="1 second").stop()


def test_stream_batch_without_files_to_scan_writes_nothing(spark, tmp_path):
    for age, name in enumerate(("app1/main.js", "app1/node_modules/x.js", "app2/mygame.js")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(f'var token = "{TOKEN}"')
        os.utime(tmp_path / "in" / name, (1_700_000_000 - 100 * age,) * 2)  # the oldest file is the first batch
    store = str(tmp_path / "store")
    start_scan(spark, str(tmp_path / "in"), store, 1).awaitTermination()
    assert [tuple(r) for r in read_ledger(spark, store).collect()] == [("app1", "app1/main.js", "ok")]
    for table in ("items", "occurrences", "ledger"):
        assert [p.name for p in (tmp_path / "store" / table).iterdir()] == ["batch=2"]


def test_stream_reads_equal_contents_once(spark, tmp_path, monkeypatch):
    import sparklode.streaming.scan as scanning

    real, counts = scanning.extract, []
    monkeypatch.setattr(scanning, "extract", lambda files: counts.append(files.count()) or real(files))
    script, broken = f'var token = "{TOKEN}", url = "https://api1.acme.cn/oauth/login"', 'function f() { g(`https://api2.acme.cn/oauth/login'
    rows = [
        ("app1", "a.js", "js", script), ("app2", "a.js", "js", script), ("app2", "b.js", "js", script), ("app2", "x-wxss.js", "js", broken), ("app2", "y.js", "js", broken), ("app3", "z/y.js", "js", broken),
        ("app3", "c.json", "json", script), ("app3", "d.js", "js", None), ("app4", "d.js", "js", None), ("app4", "e.js", "js", " "),
    ]
    schema, store = "pkg string, file string, ext string, content string", str(tmp_path / "store")
    files = spark.createDataFrame(rows, schema)
    files.coalesce(1).write.parquet(str(tmp_path / "files"))
    scanning.start_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "files")), store).awaitTermination()
    found, statuses = scan(files, spark)
    assert {tuple(r) for r in read_ledger(spark, store).collect()} == {tuple(r) for r in statuses.collect()}
    assert {(r.hash_sha256, r.type_id, r.ref_count) for r in read_items(spark, store).collect()} == {(r.hash_sha256, r.type_id, r.ref_count) for r in D.items_of(found).collect()}
    kept = spark.read.parquet(f"{store}/occurrences").drop("batch").collect()
    assert len(kept) >= 6 and sorted(tuple(r) for r in kept) == sorted(tuple(r) for r in D.occurrences_of(found).collect())
    assert counts == [6]


def test_content_key_tells_style_scripts(spark):
    from sparklode.sources.extract import content_key, is_style_script

    names = ["app-wxss.js", "p/APP-WXSS.js", "x/y.wxss.js", "a\\app-wxss.js", "x-wxss.js/z.js", "app-wxss.jsx", "b.js", "", None]
    rows = spark.createDataFrame([(n, "js", "x") for n in names], "file string, ext string, content string").select("file", content_key().alias("key")).collect()
    assert [r.key.split(":")[1] == "true" for r in rows] == [is_style_script(n or "") for n in names]
    other = spark.createDataFrame([("b.js", "js", "y"), ("b.js", "json", "x"), ("b.js", "js", None)], "file string, ext string, content string").select(content_key()).collect()
    assert len({r[0] for r in other} | {r.key for r in rows}) == 5


def test_sinks(spark, tree):
    found, _ = scan(scan_tree(spark, str(tree / "in")), spark)
    assert {(r.slug, r.n, r.n_files, r.n_values) for r in dry_run(found).collect()} == {("server_cred_token", 1, 1, 1), ("server_url_auth", 2, 2, 1)}
    rows = [("f", 0, "value one", "js-ast", "a = 'value one'"), ("f", 0, "https://a.acme.cn/x", "js-ast", "a = 'value one'"), ("f", 3, "token-abc-1", "js-ast", "b"), ("f", 5, None, None, None)]
    constants = spark.createDataFrame(rows, "file string, sid int, value string, src string, stmt string")
    write_json(constants, found, str(tree / "out"))
    kept, removed = read_interchange(spark, str(tree / "out/filtered")).collect(), read_interchange(spark, str(tree / "out/removed")).collect()
    assert sorted([(r.value, r.stmt) for r in kept + removed]) == sorted([(r[2], r[4]) for r in rows[:3]]) and {r.value for r in kept} >= {"https://a.acme.cn/x"}
    assert spark.read.json(str(tree / "out/classified")).count() == 3


def test_sql_sinks(spark):
    assert split_sql("a 'x;''y' ; -- c;d\nb \"q;\" `r;` /* e; */ # f;\n;;g") == ["a 'x;''y'", '-- c;d\nb "q;" `r;` /* e; */ # f;', "g"]
    assert insert_sql("t", []) == "" and insert_sql("t", [{"id": 1, "b": "it's"}, {"id": 2, "c": True}]).startswith("INSERT INTO `t` (`b`, `c`, `id`) VALUES\n('it''s', NULL, 1),\n(NULL, 1, 2)\nON DUPLICATE KEY UPDATE `b`=VALUES(`b`), `c`=VALUES(`c`);")
    assert len(split_sql(ddl())) == 4 and seed_sql(type_dimension(spark)).count("\n(") >= 67
    groups = [(100, "one", 2, [("a", None), ("b", 5), ("a", 1)]), (300, "others", None, [("o", None)]), (200, "two", 1, [("c", None)])]
    ids = type_ids(spark.createDataFrame(groups, "start_index int, category string, default_risk int, items array<struct<slug:string,risk:int>>")).collect()
    assert {tuple(r) for r in ids} == {("a", 101, "one", 1, 2), ("b", 102, "one", 1, 5), ("c", 201, "two", 2, 1), ("o", 301, "others", 99, 0)}
    assert list(constants_module([r for r in ids if r.slug == "c"])) == ["C = 201"]


def test_jdbc_store(spark):
    url, driver = "jdbc:derby:memory:store;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    execute(spark, url, ["CREATE TABLE data_item (hash_sha256 VARCHAR(64) PRIMARY KEY, type_id INT, raw_value CLOB, ref_count BIGINT)"], driver)
    items = lambda rows: spark.createDataFrame(rows, "hash_sha256 string, type_id int, raw_value string, ref_count long")
    upsert_items(items([("h1", 1, "one", 0), ("h2", 2, "two", 3)]), url, "data_item", driver)
    upsert_items(items([("h2", 9, "other", 1), ("h3", 3, "three", 0)]), url, "data_item", driver)
    got = spark.read.jdbc(url, "data_item", properties=driver).collect()
    assert {tuple(r) for r in got} == {("h1", 1, "one", 0), ("h2", 2, "two", 5), ("h3", 3, "three", 0)}


def test_interchange(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"statements": ['token: "v"', "s2"], "constants": [["https://a.acme.cn/login", 0, "js"], ["other one", 1, "js"]]}))
    rows = read_interchange(spark, str(tmp_path / "x.json")).orderBy("pos").collect()
    assert [(r.value, r.sid, r.src, r.stmt) for r in rows] == [("https://a.acme.cn/login", 0, "js", 'token: "v"'), ("other one", 1, "js", "s2")]


def test_byte_cap(spark):
    texts = ["", "abc", "é" * 5, "字" * 5, "a字字字", "ab字字字", "𝒳" * 5, "a𝒳𝒳", "ab𝒳𝒳", "abc𝒳𝒳", "é字𝒳é字𝒳", None, "x" * 12]
    for most in range(1, 12):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(D.cap_bytes(F.col("t"), most).alias("c")).collect()
        assert [r.c for r in got] == [t if t is None else t.encode()[:most].decode(errors="ignore") for t in texts]
    plan = spark.createDataFrame([("a",)], "t string").select(D.cap_bytes(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_store(spark):
    long1, long2 = "字" * 30_000, "字" * 29_999 + "x"
    rows = [("a", "f", 1, 1602, "v1"), ("b", "f", 1, 1702, "v1"), ("a", "f", 2, 9901, long1), ("a", "f", 3, 9901, long2)]
    found = spark.createDataFrame(rows, "pkg string, file string, pos long, type_id int, value string")
    items = {r.hash_sha256: r for r in D.items_of(found).collect()}
    assert len(items) == 3 and {r.type_id for r in items.values() if r.raw_value == "v1"} == {1602}
    assert all(len(r.raw_value.encode()) <= 65_000 for r in items.values())
    merged = D.merge_items(D.items_of(found), D.items_of(found))
    assert {r.raw_value[:2]: r.ref_count for r in merged.collect()}["v1"] == 3


def test_ledger(spark):
    rows = [("p", "a", 1, "ok"), ("p", "b", 2, "timeout"), ("q", "a", 1, "ok"), ("q", "a", 2, "error:commit_failed"), ("q", "b", 3, "ok"), ("r", "a", 1, "aborted"), ("r", "a", 2, "ok"), ("s", "a", 1, "ok")]
    statuses = D.merge_statuses(spark.createDataFrame(rows, "pkg string, rel_path string, seq int, status string"))
    done = D.completed_packages(statuses, spark.createDataFrame([("p", 2), ("q", 2), ("r", 1), ("s", 2), ("t", 0)], "pkg string, n int"))
    assert {r.pkg: r.completed for r in done.collect()} == {"p": True, "q": False, "r": False, "s": False, "t": True}
    assert {(r.pkg, r.rel_path, r.kind) for r in D.failures(statuses).collect()} == {("p", "b", "file"), ("q", "a", "infra"), ("r", "a", "infra")}


def test_findings_of_nothing(spark):
    assert findings_of(spark.createDataFrame([], "pkg string, file string, sid int, value string, src string, stmt string"), spark).collect() == []
