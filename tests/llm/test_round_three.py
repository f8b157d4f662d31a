"""Fill-in-middle, source audit and line dedup against plain Python, on rows with nulls, empty and very long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest

from auditlake.llm import fill_middle, langid_kn, line_dedup, queries, source_audit

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, h string, g string, t string, pos string, n string, keep string, output string, form string, p string"
R = random.Random(11)
PIECES = ["ab", "Zeta", " ", "\n", "é", "ß", "日本", "<", ">", "P", "<P", "0", "9.", "\t", "🙂", "x" * 70]


def odd(n):
    return "".join(R.choice(PIECES) for _ in range(n))


def corpus():
    texts = [None, "", " ", "a", "é", "<P>", "a<S>b", "<M", "<", ">", "P><S", "日本 語", "Abc" * 30, "\n\n", "\x00a\x00", *(odd(R.randint(1, 60)) for _ in range(120)), "word " * 300_000, odd(100_000)]
    rows = [(i, t, R.choice(["en", "de", None]), R.choice(["s", "t", None]), *"abcdefghi") for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, odd(30), "en", "s", *"abcdefghi")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --------------------------------------------------------------------------- fill in middle


def test_wavelet_ranks_equal_counts():
    s = np.random.default_rng(1).integers(0, 6, 1000).astype(np.uint8)
    m = fill_middle.WaveletMatrix(s, 3)
    lo, hi = np.sort(np.random.default_rng(2).integers(0, 1001, (2, 300)), axis=0)
    for c in range(8):
        assert m.rank(c, lo, hi).tolist() == [int((s[a:b] == c).sum()) for a, b in zip(lo, hi)]


def rearranged_by_hand(doc_id, text, rate=90):
    text = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(w), "plain", None, None, text
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < 20:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate", [90, 100, 0])
def test_fill_in_middle_equals_plain_python(spark, docs, rows, rate):
    made = fill_middle.fill_in_middle(docs, rate=rate)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored(made.output, made.form).alias("back")).collect()
    want = Counter((r[0], *rearranged_by_hand(r[0], r[1], rate), r[1] or "") for r in rows)
    assert Counter(map(tuple, got)) == want
    if rate == 100:
        assert {"psm", "spm"} <= {r.form for r in got}


def test_fill_in_middle_of_nothing(empty):
    assert fill_middle.fill_in_middle(empty).collect() == []


# --------------------------------------------------------------------------- source audit

WORDS = ["Straße", "été", "zebra", "Apfel", "apfel", "日本", "Z", "a", "b"]


def audit_rows():
    out = [(i, " ".join(R.choices(WORDS, range(1, 10), k=R.randint(0, 40))), R.choice(["de", "de", "fr", None]), R.choice(["s0", "s0", "s0", "s1", "é", None]), *"abcdefghi") for i in range(160)]
    out += [(900 + i, f"once{i} twice_{i % 5}", "en", f"s{i % 2}", *"abcdefghi") for i in range(9)]  # a language without kept terms
    return [*out, out[3], out[3], (None, None, None, None, *"abcdefghi"), (1000, "only", "it", "alone", *"abcdefghi"), (1001, "many words " * 200_000, "fr", "é", *"abcdefghi")]


def audit_by_hand(rows, least, top):
    docs, by, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, r in enumerate(rows):
        lang, source = r[2] or "", r[3] or ""
        groups[lang].add(source)
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            docs[lang, w].add(i)
            by[lang, source][w] += 1
    out = []
    for lang, sources in groups.items():
        kept = [w for (k, w), d in docs.items() if k == lang and len(d) >= least]
        whole = sum((by[lang, s] for s in sources), Counter())

        def shares(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        far = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(by[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum(far(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(far(p[s][w], q[w]), w) for w in kept if by[lang, s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(10, 10), (1, 2)])
def test_audit_equals_plain_python(spark, least, top):
    rows = audit_rows()
    got = source_audit.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), least=least, top=top).collect()
    assert sorted(map(tuple, got)) == audit_by_hand(rows, least, top)


def test_audit_of_nothing(empty):
    assert source_audit.audit(empty).collect() == []


def test_skyband_equals_all_pairs():
    r = np.random.default_rng(5)
    for n, k in ((1, 1), (40, 3), (1500, 10)):
        c, t, s = r.integers(0, 9, n), r.integers(0, 30, n), r.permutation(n)
        over = [int(((c >= c[i]) & (t <= t[i]) & (s < s[i])).sum()) for i in range(n)]
        assert sorted(source_audit.skyband(c, t, s, k)) == [i for i in range(n) if over[i] < k]


def test_skyband_passes_keep_the_first(spark, monkeypatch):
    """The same first terms whatever the partitions."""
    rows = audit_rows()
    few, many = (source_audit.audit(spark.createDataFrame(rows, SCHEMA).repartition(n), least=1, top=3).collect() for n in (1, 9))
    assert sorted(few) == sorted(many)


# --------------------------------------------------------------------------- line dedup


def line_rows():
    shared = ["Same line", "  SAME LINE\t", "same line\r", "É", "é"]
    texts = ["\n".join(R.choices([*shared, "", " ", *(f"own {R.randint(0, 400)}" for _ in range(6))], k=R.randint(1, 12))) for _ in range(150)]
    texts += [None, "", "\n", "\n\n x \n", "last\n", "Same line\n" * 200_000 + "end"]
    rows = [(i * 2, t, *"abcdefghijk") for i, t in enumerate(texts)]
    return [*rows, *[rows[5]] * 12, *((None, f"no id\n{i}", *"abcdefghijk") for i in range(12)), *((777, f"one id\nmany texts {i}", *"abcdefghijk") for i in range(10))]


def lines_by_hand(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            seen[key(x)].add((r[0], r[1]))
    out = []
    for r in rows:
        all_ = (r[1] or "").split("\n")
        kept = [x for x in all_ if key(x) == "" or len(seen[key(x)]) < least]
        out.append((r[0], len(all_), len(all_) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("partitions,batch", [(1, 10_000), (4, 7), (60, 3)])
def test_lines_equal_plain_python(spark, partitions, batch):
    """A key over many partitions, batches of a few rows."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    rows = line_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        for least in (10, 2):
            got = line_dedup.without_lines(docs, line_dedup.keep_bitmaps(docs, least=least), "doc_id").collect()
            assert Counter(map(tuple, got)) == lines_by_hand(rows, least)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_bitmaps_hold_bits():
    assert line_dedup.unpack(line_dedup.pack(11, np.array([0, 10])), 11).tolist() == [False, *[True] * 9, False]
    assert len(line_dedup.pack(100_000, np.arange(1000))) < 200


def test_lines_of_nothing(empty):
    assert line_dedup.without_lines(empty, line_dedup.keep_bitmaps(empty)).collect() == []


def test_language_sample_is_bounded(spark, monkeypatch):
    """One id many times over, very long texts: rows that repeat count once, bytes are bounded, the same sample whatever the layout."""
    rows = [(1, "the same text", "en")] * 500 + [(1, f"text {i}", "en") for i in range(40)] + [(None, f"no id {i}", "de") for i in range(5)] + [(i, "x " * 3000, "fr") for i in range(10, 40)] + [(7, None, "en"), (8, "x", None)]
    monkeypatch.setattr(langid_kn, "SAMPLE_BYTES", 20_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, other = (langid_kn.sample(docs.repartition(n), bound=20) for n in (1, 6))
    assert one == other and one[0] == ["de", "en", "fr"]
    de, en, fr = one[1]
    assert len(en) == len(set(en)) == 20 and len(de) == 5 and 1 <= len(fr) <= 3
    monkeypatch.setattr(langid_kn, "SAMPLE_BYTES", 10)
    assert [len(t) for t in langid_kn.sample(docs, bound=20)[1]][2] == 1


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_source_divergence", "op13_line_dedup"])
def test_query_equals_sql(spark, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), compare.connect(SF).execute(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert compare.tidy(ours) == compare.tidy(theirs)
