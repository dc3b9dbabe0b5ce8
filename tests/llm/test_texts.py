"""Operators on texts against brute force, on rows with every odd case at once."""

import hashlib
import random
import re
import zlib

import pytest

from sparklode.llm.common import Scratch
from sparklode.llm.debruijn import dedup_substrings
from sparklode.llm.decontaminate import decontaminate
from sparklode.llm.minhash import near_duplicates
from sparklode.llm.packing import best_fit, pack_documents
from sparklode.llm import suffix
from sparklode.llm.suffix import dedup_bytes, equal_windows, suffix_array
from sparklode.llm.superkmer import Alphabet, Cutter
from sparklode.llm.toxicity import LetterModel, Restorer, lattice_of, score_toxicity, symbols_of

import numpy as np

SPACES = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijé", k=rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    base = " ".join(rng.choices(vocabulary, k=120))
    out = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(1, 200)))
        kind = i % 6
        if kind == 1:
            text = text[: len(text) // 2] + "  " + passage + "\t" + text[len(text) // 2 :]
        elif kind == 2:
            words = base.split()
            words[rng.randrange(len(words))] = "changed"
            text = "\n".join(words)
        elif kind == 3:
            text = base
        out.append((i * 3, text))
    out += [(1000, None), (1001, ""), (1002, "   "), (1003, "one two"), (1004, "one two"), (1005, "x" * 5000), (1006, "ab " * 2000), (1007, "ONE Two"), (1008, "long " + passage * 3)]
    rng.shuffle(out)
    return out


def frame(spark, rows, extra=True):
    schema = "doc_id long, text string" + (", mini long, marks array<long>, n string" if extra else "")
    return spark.createDataFrame([(*r, 1, [2], "x") if extra else r for r in rows], schema).repartition(3)


def test_substrings(spark):
    rows = corpus()
    got = {r.doc_id: r for r in dedup_substrings(frame(spark, rows + rows[:5])).collect()}
    words = {d: SPACES.findall((t or "").encode()) for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    assert len(got) == len(rows)
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - 12):
            if first[tuple(ws[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(ws), len(gone), hashlib.sha256(kept).hexdigest()), d


def twins(n=512):
    """Two words of many letters whose polynomial hashes modulo 2**64 are equal whatever the odd base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_hash_are_not_equal(spark):
    one, two = twins(2048)
    rest = " ".join(f"w{i}" for i in range(12))
    docs = frame(spark, [(1, f"{rest} {one}"), (2, f"{rest} {two}"), (3, f"{rest} {one}")], False)
    assert sorted((r.doc_id, r.n_removed) for r in dedup_substrings(docs).collect()) == [(1, 0), (2, 0), (3, 13)]
    docs = frame(spark, [(1, f"a b c {one}"), (2, f"a b c {two}"), (3, f"a b c {one}")], False)
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_bytes_of_equal_hash_are_not_equal(spark):
    one, two = twins(128)
    rows = [(i, one[a : a + n] + two[b : b + 128 - n] + "x" * i) for i, (a, b, n) in enumerate([(0, 0, 128), (0, 0, 0), (5, 28, 100), (28, 0, 100), (0, 64, 64), (64, 0, 64), (0, 0, 64)])]
    rows += [(20 + i, t[::-1]) for i, t in rows]
    seen, got = set(), {r.doc_id: r.n_removed for r in dedup_bytes(frame(spark, rows, False)).collect()}
    for d, t in rows:
        gone = set()
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone |= set(range(i, i + 100))
            seen.add(t[i : i + 100])
        assert got[d] == len(gone), d


def test_long_paths_and_branches(spark):
    """Paths longer than a mark counts, that branch where documents part."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(1500)]
    rows = [(9, " ".join(words))]
    for d in range(10, 25):
        a, b = sorted(rng.sample(range(1500), 2))
        rows.append((d, " ".join(["new", str(d), *words[a:b], *(words[:200] if d % 2 else []), "end"])))
    got = {r.doc_id: r.n_removed for r in dedup_substrings(frame(spark, rows, False)).collect()}
    first = {}
    for d, t in rows:
        ws, gone = t.split(), set()
        for i in range(len(ws) - 12):
            if first.setdefault(tuple(ws[i : i + 13]), d) < d:
                gone |= set(range(i, i + 13))
        assert got[d] == len(gone), d


def test_bytes(spark):
    rows = corpus(2)
    got = {r.doc_id: r for r in dedup_bytes(frame(spark, rows + rows[:5])).collect()}
    seen = set()
    assert len(got) == len(rows)
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), d


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rng = random.Random(seed)
    text = [rng.randint(1, rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(0, 200))]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_equal_windows():
    classes = {frozenset(c) for c in equal_windows([b"abcdeabc", b"xabcd", b"ab"], 3)}
    assert classes == {frozenset([(0, 0), (0, 5), (1, 1)]), frozenset([(0, 1), (1, 2)])}


@pytest.mark.parametrize("seed", range(8))
def test_a_minimizer_is_one_letter(seed, monkeypatch):
    """Its bytes, and what all entries have beside it, are one letter of the suffix array; the classes are those of all windows."""
    rng = random.Random(seed)
    signs = rng.choice(["a", "ab", "abcdefgh"])
    passages = ["".join(rng.choices(signs, k=rng.randint(40, 260))) for _ in range(4)]
    texts = [(rng.choice(passages) + "".join(rng.choices(signs, k=rng.randint(0, 30))) + rng.choice(passages)).encode() for _ in range(12)]
    cutter = Cutter(Alphabet(False, 100, 48))
    groups = {}
    for doc, start, n, mini, place in zip(*[c.tolist() for c in cutter.segments(cutter.symbols(texts))], strict=True):
        groups.setdefault(mini, []).append((texts[doc][start : start + n + 99], place))
    arrays, sort = [], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda text: arrays.append(text) or sort(text))
    for group in [*groups.values(), [row for group in groups.values() for row in group][:40]]:
        entries = [e for e, _ in group]
        windows = {}
        for e, entry in enumerate(entries):
            for at in range(len(entry) - 99):
                windows.setdefault(entry[at : at + 100], []).append((e, at))
        want = sorted(places for places in windows.values() if len(places) > 1)
        assert sorted(sorted(c) for c in equal_windows(entries, 100, [p for _, p in group], 48)) == want
        assert len(arrays[-1]) <= sum(map(len, entries)) - 47 * len(entries) + len(entries)
        assert want or not arrays[-1] or len(entries) > 2


def test_large_classes_are_dealt(spark, monkeypatch):
    """A minimizer with more entries than are sorted together gives the same result."""
    import sparklode.llm.suffix as suffix

    monkeypatch.setattr(suffix, "TOGETHER", 4)
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefgh", k=130))
    rows = [(i, "".join(rng.choices("ijkl", k=50)) + passage + "".join(rng.choices("mnop", k=50))) for i in range(40)]
    got = {r.doc_id: r.n_removed for r in dedup_bytes(frame(spark, rows, False)).collect()}
    seen = set()
    for d, t in rows:
        gone = set()
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone |= set(range(i, i + 100))
            seen.add(t[i : i + 100])
        assert got[d] == len(gone)


def shingles(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows, k):
    sets = {d: shingles(t, k) for d, t in rows}
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = corpus(4)
    got = {r.doc_id: r for r in near_duplicates(frame(spark, rows + rows[:4]), shingle=k).collect()}
    want = brute_components(rows, k)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_in_chains(spark):
    """Links that no hub has: each text is near the next one only."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(30):
        rows.append((100 - i, " ".join(words)))
        for _ in range(9):
            words[rng.randrange(400)] = f"n{rng.random()}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows, 4)


def test_near_duplicates_join_by_what_they_need(spark, monkeypatch):
    """Buckets are made of bands without signatures, and the last comparison's rows hold signatures without bands."""
    real, reads = Scratch.table, {}

    def table(self, df, name):
        reads[name] = re.findall(r"FileScan parquet \[([^\]]*)\]", df._jdf.queryExecution().sparkPlan().toString())
        return real(self, df, name)

    monkeypatch.setattr(Scratch, "table", table)
    rows = corpus(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows, 4)
    made = [x for name in ("bands", "shared", "buckets") for x in reads[name]]
    assert any("bands#" in x for x in made) and not any("sig#" in x for x in made)
    assert any("sig#" in x for x in reads["pairs2"]) and not any("bands#" in x for x in reads["pairs2"])


ITEM_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def item_words(text):
    return ITEM_WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontaminate(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcÉß", k=rng.randint(1, 4))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 13, 14, 30])))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (None, "a b c"), (5, "the second text of five " * 3), (53, "solo")]
    docs = []
    for d in range(40):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))
        if d % 2:
            words = rng.choice(items[:12])[1].split()
            text += ", " + "-".join(words[rng.randint(0, 3) :]).upper() + "! " + text
        docs.append((d, text))
    docs += [(90, None), (91, ""), (92, "Solo"), (93, "the second text of five the second text of five the second text of five")]
    got = {r.doc_id: r for r in decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    windows = {}
    for i, t in items:
        words = item_words(t)
        n = min(13, len(words))
        if i is not None and words:
            windows.setdefault(str(i), set()).update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    assert len(got) == len(docs)
    for d, t in docs:
        words = item_words(t)
        hit, found = set(), set()
        for i, ws in windows.items():
            for w in ws:
                for k in range(len(words) - len(w) + 1):
                    if tuple(words[k : k + len(w)]) == w:
                        hit |= set(range(k, k + len(w)))
                        found.add(i)
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) == (len(words), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(words)), d


def brute_hits(items, docs):
    windows, out = {}, {}
    for i, t in items:
        words = item_words(t)
        n = min(13, len(words))
        if i is not None and words:
            windows.setdefault(str(i), set()).update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    for d, t in docs:
        words, hit, found = item_words(t), set(), set()
        for i, ws in windows.items():
            for w in ws:
                for k in range(len(words) - len(w) + 1):
                    if tuple(words[k : k + len(w)]) == w:
                        hit |= set(range(k, k + len(w)))
                        found.add(i)
        out[d] = (len(words), len(hit), sorted(found))
    return out


def test_decontaminate_templates_and_words(spark):
    """Many items of one template, of the same text, and of one word that is everywhere."""
    rng = random.Random(16)
    template = "what is the name of the old town that lies on the river {} in the land of {} today"
    items = [(i, template.format(f"r{i % 40}", f"l{i % 30}")) for i in range(300)]
    items += [(1000 + i, "the") for i in range(50)] + [(2000 + i, "the same text in every item") for i in range(50)] + [(3000, "the the the the"), (3001, "of the")]
    docs = [(d, " ".join(rng.choices(["the", "of", "a", "town", "r1"], k=rng.randint(0, 40)))) for d in range(20)]
    docs += [(100 + i, f"so {template.format(f'r{i}', f'l{i}')} and more, the same text in every item") for i in range(20)] + [(200, None), (201, "The"), (202, template.format("rx", "lx"))]
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_hits(items, docs)


def test_decontaminate_empty_documents(spark):
    assert decontaminate(frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_decontaminate_against_nothing(spark):
    rows = decontaminate(frame(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in rows) == [(1, 2, 0, False), (2, 0, 0, False)]


def vocabulary_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [*corpus(7), (2000, "Don't <|endoftext|> I'LL 12ab ²´  x\x1cy " * 300), (None, "left out")]
    size = 256
    got = pack_documents(frame(spark, rows + rows[:3]), vocabulary_path(), size).collect()
    tokens = Tokenizer.from_file(vocabulary_path())
    pieces = {}
    for d, t in rows:
        if d is not None:
            ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 0]
            for p, s in enumerate(range(0, len(ids), size)):
                cut = ids[s : s + size]
                pieces[(d, p)] = (s, len(cut), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in cut)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(n for _, n, _ in pieces.values())
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    assert len(bins) <= total / size * 1.08 + 1


def test_packing_rounds(spark):
    """Many partitions merge their rests."""
    from pyspark.sql import functions as F

    from sparklode.llm.common import Scratch
    from sparklode.llm.packing import pack

    rng = random.Random(8)
    rows = [(i, 0, rng.randint(1, 90)) for i in range(2000)]
    out = pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 100, Scratch(spark, "test"), items_per_task=100)
    assert out.count() == out.select("doc_id").distinct().count() == 2000
    n = out.select("sequence_id").distinct().count()
    assert n <= len(best_fit(np.array([r[2] for r in rows]), 100)) * 1.05
    both = out.join(spark.createDataFrame(rows, "doc_id long, p int, length long"), "doc_id").groupBy("sequence_id").agg(F.sum("length").alias("s"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert both.filter("s != e or s > 100").isEmpty()


def pack_rows(spark, lengths, size, items_per_task):
    from sparklode.llm.common import Scratch
    from sparklode.llm.packing import pack

    scratch = Scratch(spark, "test")
    frame = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    got = {}
    for r in pack(frame, size, scratch, items_per_task=items_per_task).collect():
        got.setdefault(r.sequence_id, []).append((r.offset, lengths[r.doc_id], r.doc_id))
    assert sorted(d for b in got.values() for _, _, d in b) == list(range(len(lengths)))
    for b in got.values():
        at = 0
        for offset, n, _ in sorted(b):
            assert offset == at
            at += n
        assert at <= size
    return got


@pytest.mark.parametrize(
    "lengths, most",
    [
        ([1500] * 3000 + [1] * 30, 3000),  # nothing joins but the shortest
        ([1] * 3000, 2),  # empty texts only
        ([1030] * 500 + [1000] * 500, 530),
        ([700] * 900, 450),
        ([2047] * 300 + [2] * 300, 301),
        ([], 0),
    ],
)
def test_packing_rounds_are_bounded(spark, lengths, most):
    """However little joins, no task takes more than its share of items."""
    assert len(pack_rows(spark, lengths, 2048, 100)) <= most


def test_restoring():
    text = ("the idiot was a stupid loser and a moron, the trash of pathetic clowns is worthless to all ordinary readers of the text " * 50)
    counts = np.zeros(28**3, np.int64)
    s = symbols_of("  " + text.lower() + "  ").astype(np.int64)
    counts += np.bincount((s[:-2] * 28 + s[1:-1]) * 28 + s[2:], minlength=28**3)
    restorer = Restorer(LetterModel(counts))
    for seen, word in [("1d10t", "idiot"), ("i d i o t", "idiot"), ("idiooooot", "idiot"), ("l0s3r", "loser"), ("$tup1d", "stupid"), ("m.o.r.o.n", "moron"), ("tr@sh", "trash"), ("W0rthl3ss", "worthless")]:
        assert word in restorer.words(f"this {seen} here"), seen
    assert restorer.words("") == set()
    assert lattice_of("") == []


def test_toxicity(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("aeioubcdfglmnrst", k=rng.randint(2, 7))) for _ in range(400)]
    bad = ["idiot", "moron", "scumbag"]
    docs, labels = [], []
    for d in range(900):
        words, toxic = rng.choices(vocabulary, k=40), d % 3 == 0
        if toxic:
            for _ in range(2):
                words[rng.randrange(40)] = rng.choice(bad)
        docs.append((d, " ".join(words)))
        labels.append((d, 1, int(toxic)))
    docs += [(2000, None), (2001, ""), (2002, "you are such a m0r0n my friend"), (2003, "i d i o t says the man"), (None, "x")]
    labels += [(0, 1, 0), (None, 1, 1), (5, 1, None)]
    got = {r.doc_id: r for r in score_toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 904
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for d, r in got.items())
    held = [(got[d].predicted, t) for d, _, t in labels[:900] if got[d].held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert got[2002].predicted == 1 and got[2003].predicted == 1 and got[2000].predicted == got[2001].predicted == 0


def test_toxicity_without_labels(spark):
    rows = score_toxicity(frame(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [r.score for r in rows] == [0.5, 0.5]


@pytest.mark.parametrize("operator", [dedup_substrings, dedup_bytes, near_duplicates, lambda d: pack_documents(d, vocabulary_path())])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).collect() == []


@pytest.fixture(scope="module")
def restorer():
    words = "you are such an idiot and a moron dumb ass what a dumbass the good people of this letter are not scumbag said it is in that class"
    s = symbols_of(f"  {words}  " * 50).astype(np.int64)
    return Restorer(LetterModel(np.bincount((s[:-2] * 28 + s[1:-1]) * 28 + s[2:], minlength=28**3)))


@pytest.mark.parametrize(
    "text, word",
    [
        ("i d i o t", "idiot"),
        ("i  d  i  o  t", "idiot"),
        ("i. d. i. o. t", "idiot"),
        ("i, d, i, o, t", "idiot"),
        ("i - d - i - o - t", "idiot"),
        ("mo.ron", "moron"),
        ("mo-ron", "moron"),
        ("id.iot", "idiot"),
        ("id,iot", "idiot"),
        ("dumba$$", "dumbass"),
        ("a$$", "ass"),
        ("a$$.", "ass"),
        ("m0r0n!!", "moron"),
        ("iiddiioott", "idiot"),
        ("ïidiot", "idiot"),
        (", ".join(c for c in "the good people " * 12 if c != " ") + ", i, d, i, o, t", "idiot"),
    ],
)
def test_read_without_gates(restorer, text, word):
    """Alone and after plain words: nothing else in the text makes it suspect."""
    assert word in restorer.words(text)
    assert word in restorer.words(f"people said: {text}")


def test_long_token_is_read_whole(restorer):
    for at in range(190, 201):
        assert "idiot" in restorer.words("the-good-people-" * 12 + "-" * (at - 192) + "1d10t-the-good-people")


def walk(span, log, n=28):
    """The best score of all readings of a lattice, one by one."""
    best = (-1e300, "")
    paths = [((0, 0), 0.0, ())]
    for step in [*lattice_of(span), [((0,), 0.0)]]:
        after = []
        for (a, b), score, out in paths:
            for emitted, cost in step:
                x, y, s, o = a, b, score + cost, out
                for c in emitted:
                    if c or y:
                        s += log[(x * n + y) * n + c]
                        x, y, o = y, c, (*o, c)
                after.append(((x, y), s, o))
        paths = after
    best = max(s for _, s, _ in paths)
    return {"".join(" " if c == 0 else chr(96 + c) for c in o).strip() for _, s, o in paths if s > best - 1e-9}


@pytest.mark.parametrize("span", ["1d10t", "i-d-i-o-t", "m00rr0n", "a$$", "!!d!0t", "b.4.d", "sscc11", "l0s3rr", "(|o0"])
def test_viterbi_finds_the_best_reading(restorer, span):
    assert restorer.read(span) in walk(span, restorer.model.log)


def test_reading_does_not_depend_on_order(restorer):
    texts = ["a.b.c is", "so a.b.c, a.b.c! and a . b . c", "i d i o t", "i-d-i-o-t! i-d-i-o-t", "a$$ a$$. a$$!"]
    alone = [Restorer(restorer.model).words(t) for t in texts]
    assert [restorer.words(t) for t in reversed(texts)] == alone[::-1]
