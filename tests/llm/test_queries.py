"""The registered queries against their SQL, and odd tables through every operator."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from sparklode.llm.common import Scratch
from sparklode.llm.debruijn import dedup_substrings
from sparklode.llm.decontaminate import decontaminate
from sparklode.llm.html_extract import extract_main_text
from sparklode.llm.minhash import near_duplicates
from sparklode.llm.packing import pack_documents
from sparklode.llm.quality import fit, score_quality
from sparklode.llm.queries import ORACLE, QUERIES
from sparklode.llm.suffix import dedup_bytes
from sparklode.llm.toxicity import score_toxicity

DATA = Path("/root/testdata/sf0.001")


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", ORACLE)
def test_query_against_sql(spark, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    db = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    want = db.execute(ORACLE[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda frame: sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))
    assert key(got) == key(want)


ON_DOCUMENTS = {
    "quality": lambda d, s: score_quality(d, s.createDataFrame([], "doc_id long, quality int")),
    "substrings": lambda d, s: dedup_substrings(d),
    "minhash": lambda d, s: near_duplicates(d),
    "decontaminate": lambda d, s: decontaminate(d, s.createDataFrame([(1, "some words")], "item_id long, text string")),
    "toxicity": lambda d, s: score_toxicity(d, s.createDataFrame([], "doc_id long, toxic int")),
    "packing": lambda d, s: pack_documents(d, vocabulary()),
    "bytes": lambda d, s: dedup_bytes(d),
}
#: Names that the operators use for columns of their own.
CLASH = "part string, n string, key string, row string, h string, w string, p string, mini string, mark string, marks string, at string, rep string, comp string, total string, v string, y string, x string, site string"
SCHEMA = "doc_id long, text string, source string, lang string, " + CLASH


def table(spark, rows):
    return spark.createDataFrame([(d, t, "s", None, *["?"] * len(CLASH.split(","))) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_empty_documents(spark, name):
    assert ON_DOCUMENTS[name](table(spark, []), spark).collect() == []


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_nulls_repeats_and_a_very_long_text(spark, name):
    """Texts of nothing, one over a million bytes, and columns whose names clash."""
    rng = random.Random(1)
    long = " ".join(str(rng.randrange(10**9)) for _ in range(130_000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, long), (5, "idiot 1d10t \x00 é 字"), (5, "idiot 1d10t \x00 é 字"), (None, "lost"), (6, "x" * 300_000)]
    got = ON_DOCUMENTS[name](table(spark, rows), spark).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6}
    if name != "packing":
        assert len(got) == 6


def test_empty_and_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    assert extract_main_text(spark.createDataFrame([], schema)).collect() == []
    long = "<article>" + "<p>It is a long page and there is more of it to read.</p>" * 30_000
    rows = [(1, "u", long, "t", "n"), (1, "u", None, None, None), (None, None, "<p", "", "")]
    got = extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 30_000 * 51 - 1] and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def strength(n, s, s2, mean):
    """Prior rows of a level, from the moments of its groups."""
    n, s, s2, mean = map(np.asarray, (n, s, s2, mean))
    if n.sum() <= len(n):
        return 100.0
    inside = max(1e-9, (s2 - s * s / n).sum() / (n.sum() - len(n)))
    spread = ((n * (s / n - mean) ** 2).sum() - len(n) * inside) / n.sum()
    return min(10_000.0, max(1.0, inside / spread)) if spread > 0 else 10_000.0


def test_site_posteriors_against_numpy(spark):
    """Hosts and paths shrunk level by level without the document itself, and the weights of evidence and site."""
    rng = random.Random(3)
    docs, labels = [], []
    for d in range(400):
        host, path = f"h{rng.choice([0, 0, 0, 1, 2, 3, d])}", rng.choice("ab")
        good = rng.random() < (0.9 if host in ("h0", "h2") else 0.3)
        docs.append((d, "Plain words and more of them, said well enough. " * 3 if rng.random() < (0.8 if good else 0.4) else "x*** y$$$\n" * 20, host, path))
        if d % 3 == 0:
            labels.append((d, int(good)))
    got = {r.doc_id: r for r in score_quality(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    known = dict(labels)
    v = {d: float(known.get(d, got[d].evidence)) for d in got}
    of = lambda *key: [d for d in got if (got[d].host, got[d].path)[: len(key)] == key]
    hosts, paths = sorted({(r.host,) for r in got.values()}), sorted({(r.host, r.path) for r in got.values()})
    sums = {k: (len(of(*k)), sum(v[d] for d in of(*k)), sum(v[d] ** 2 for d in of(*k))) for k in hosts + paths}
    m = sum(v.values()) / len(v)
    k_host = strength(*zip(*[sums[k] for k in hosts]), [m] * len(hosts))
    above = {k: (sums[k][1] + k_host * m) / (sums[k][0] + k_host) for k in hosts}
    k_path = strength(*zip(*[sums[k] for k in paths]), [above[k[:1]] for k in paths])
    own, shift = {}, {}
    for d, r in got.items():
        n_h, s_h, _ = sums[(r.host,)]
        n_p, s_p, _ = sums[(r.host, r.path)]
        higher = (s_h - v[d] + k_host * m) / (n_h - 1 + k_host)
        site = min(0.999, max(0.001, (s_p - v[d] + k_path * higher) / (n_p - 1 + k_path)))
        assert abs(site - r.site) < 1e-9
        p = min(1 - 1e-12, max(1e-12, r.evidence))
        own[d], shift[d] = np.log(p / (1 - p)), np.log(site / (1 - site)) - np.log(m / (1 - m))
    a, b, c = fit(np.array([[own[d], shift[d]] for d in known]), np.array([known[d] for d in known], float))
    assert all(abs(r.score - 1 / (1 + np.exp(-np.clip(a * own[d] + b * shift[d] + c, -30, 30)))) < 1e-6 for d, r in got.items())


def test_scratch_tables_go(spark):
    since = len(Scratch.made)
    near_duplicates(table(spark, [(1, "a b c d e"), (2, "a b c d e")])).collect()
    made = Scratch.made[since:]
    assert made
    Scratch.clear(spark, since)
    assert Scratch.made[since:] == [] and not any(Path(m.removeprefix("file://")).exists() for m in made)
