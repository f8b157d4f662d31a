"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from auditlake.llm import bagminhash, bitpack, byte_cnn, common, decontaminate, encode, hmm_lm, iblt, langid_kn, packing, subword_toxicity, suffix_dedup

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, part string, low string"
R = random.Random(7)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(400)]
LANGS = {"en": "the and with that this there which their about would".split(), "de": "und der nicht über größe straße auch wieder können".split()}


def prose(n, words=WORDS, r=R):
    return " ".join(r.choice(words) for _ in range(n))


def corpus():
    base = prose(120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = prose(90)
    texts = [base, base, near, base.upper() + " ", None, "", "   \n ", "one two", "One  TWO", prose(4000), "ß é ü " * 50, passage + " " + prose(20), prose(15) + "\n" + passage, "\x00 odd \t tab\r\n" + prose(30), "De " * 300, prose(40) + " " + "x" * 5000]
    rows = [(i * 3, t, "en" if i % 2 else "de", "s", len(t or ""), "n", "p", "l") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, "no id " + prose(10), None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def groups_by_hand(rows, threshold=0.8):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w))
    own = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            low = sum((sets[i] & sets[j]).values())
            if (not sets[i] and not sets[j]) or (low and low / (sum(sets[i].values()) + sum(sets[j].values()) - low) >= threshold):
                a, b = own[i], own[j]
                own = [min(a, b) if x in (a, b) else x for x in own]
    return own


def test_near_duplicates(docs, rows, empty):
    got = {}
    for r in bagminhash.near_duplicates(docs).collect():
        got.setdefault(r.group_id, []).append(r.doc_id)
    want = {}
    for own, r in zip(groups_by_hand(rows), rows):
        want.setdefault(own, []).append(r[0])
    key = lambda x: (x is None, x)
    assert sorted((sorted(v, key=key) for v in got.values()), key=str) == sorted((sorted(v, key=key) for v in want.values()), key=str)
    assert bagminhash.near_duplicates(empty).count() == 0
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(want)
    assert bagminhash.keep_one(empty).count() == 0


def test_large_near_group(spark):
    """Edits of one text around a common centre: one group, whatever pairs lie below the threshold."""
    words = prose(200).split()
    texts = []
    for k in range(60):
        w = list(words)
        for at in (k * 3 % 200, (k * 7 + 50) % 200):
            w[at] = f"edit{k}"
        texts.append((k, " ".join(w)))
    got = bagminhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    want = groups_by_hand(texts)
    assert {(r.doc_id, r.group_id) for r in got} == {(k, texts[g][0]) for k, g in enumerate(want)}


def test_groups_without_an_id_of_their_own(spark):
    """Different texts with null ids, or with one id, are groups of their own."""
    r = random.Random(3)
    texts = [(None, prose(30, r=r)), (None, prose(30, r=r)), (5, prose(30, r=r)), (5, prose(30, r=r)), (7, prose(30, r=r))]
    table = spark.createDataFrame([*texts, texts[1], (9, texts[3][1] + " ")], "doc_id long, text string")
    assert sorted(bagminhash.keep_one(table).collect(), key=str) == sorted(texts, key=str)
    groups = bagminhash.near_duplicates(table).collect()
    assert len({x.label for x in groups}) == 5
    assert sorted((str(x.doc_id), str(x.group_id)) for x in groups) == [("5", "5")] * 2 + [("7", "7"), ("9", "5")] + [("None", "None")] * 3


def test_link_by_one_member_of_a_family(spark):
    """Texts that reach 0.8 with one of hundreds of revisions only, whose sketch is not among the likeliest."""
    r = random.Random(5)
    base = prose(900, r=r).split()
    places = [5 * i + 2 for i in range(179)]
    edited = lambda at, by: " ".join(f"{by}{i}" if i in at else w for i, w in enumerate(base))
    family = [(k, edited({places[k]}, "edit")) for k in range(150)]
    for k in range(6):
        own = set(r.sample([p for i, p in enumerate(places) if i != 20 * k], 19))
        w = edited(own, f"far{k}x").split()
        w[places[20 * k]] = f"edit{places[20 * k]}"
        family.append((1000 + k, " ".join(w)))
    got = bagminhash.near_duplicates(spark.createDataFrame(family, "doc_id long, text string")).collect()
    want = groups_by_hand(family)
    assert len(set(want)) == 1
    assert {(r.doc_id, r.group_id) for r in got} == {(x[0], family[g][0]) for x, g in zip(family, want)}


def test_signatures_are_unbiased():
    a = np.array([1, 2, 3, 4, 5], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s, d = np.concatenate([a, a]), np.repeat([0, 1], 5)
    w = np.array([1, 5, 2, 9, 4, 3, 5, 1, 2, 8])
    sig = bagminhash.signatures(s, d, w, 2, 4000)
    want = np.minimum(w[:5], w[5:]).sum() / np.maximum(w[:5], w[5:]).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4000)


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def test_language_model(docs, rows, empty):
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    c = Counter(x for r in rows if not out(r[0]) for x in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    got = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.held_out, r.train_tokens, round(r.base_score, 6)) for r in hmm_lm.likelihoods(docs).collect()), key=str)
    want = sorted(((str(r[0]), len(tokens(r[1])), sum(x in c for x in tokens(r[1])), out(r[0]), n, round(sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in tokens(r[1])), 6)) for r in rows), key=str)
    assert got == want
    assert hmm_lm.likelihoods(empty).count() == 0


def test_forward_and_baum_welch():
    r = np.random.default_rng(0)
    k, m = 3, hmm_lm._SYMBOLS
    start, move = r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k)
    emit = np.zeros((m, k))
    emit[:4] = r.dirichlet(np.ones(4), k).T
    model = hmm_lm.Model(start, move, emit)
    seqs = [np.array(s, np.uint16) for s in ([0, 1, 2], [3], [1, 1], [2, 0, 3])]
    for s, got in zip(seqs, model.log10(seqs)):
        paths = np.array(np.meshgrid(*[range(k)] * len(s))).reshape(len(s), -1).T
        p = sum(start[q[0]] * emit[s[0], q[0]] * math.prod(move[q[i - 1], q[i]] * emit[s[i], q[i]] for i in range(1, len(s))) for q in paths)
        assert abs(got - math.log10(p)) < 1e-9
    starts, moves, emits = model.expected(seqs)
    assert abs(starts.sum() - 4) < 1e-9
    assert abs(moves.sum() - sum(len(s) - 1 for s in seqs)) < 1e-9
    assert abs(emits.sum() - sum(map(len, seqs))) < 1e-9
    stretched = hmm_lm.Model(start, move, emit)
    before = model.log10(seqs).sum()
    s, t, e = (x for x in model.expected(seqs))
    better = hmm_lm.Model(s / s.sum(), t / t.sum(axis=1, keepdims=True), e / e.sum(axis=0))
    assert better.log10(seqs).sum() > before
    assert stretched.log10(seqs).sum() == before


def test_expected_counts_of_whole_texts(monkeypatch):
    """Starts, moves and emissions over whole texts in plain Python, whatever the stretches."""
    r = np.random.default_rng(3)
    k = 4
    start, move, emit = r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), np.zeros((hmm_lm._SYMBOLS, k))
    emit[:9] = r.dirichlet(np.ones(9), k).T
    model = hmm_lm.Model(start, move, emit)
    texts = [r.integers(0, 9, n).astype(np.uint16) for n in (1, 7, 8, 9, 24, 25, 300, 8)]
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((9, k))
    for x in texts:
        a = [start * emit[x[0]]]
        for s in x[1:]:
            a.append(a[-1] @ move * emit[s])
            a[-1] /= a[-1].sum()
        b = [np.ones(k)]
        for s in x[:0:-1]:
            b.append(move @ (emit[s] * b[-1]))
            b[-1] /= b[-1].sum()
        b = b[::-1]
        for t, s in enumerate(x):
            g = a[t] * b[t]
            emits[s] += g / g.sum()
            if t == 0:
                starts += g / g.sum()
            if t + 1 < len(x):
                m = a[t][:, None] * move * (emit[x[t + 1]] * b[t + 1])[None]
                moves += m / m.sum()
    for stretch in (8, 5, 1, 1000):
        monkeypatch.setattr(hmm_lm, "STRETCH", stretch)
        got = model.expected(texts)
        assert np.allclose(got[0], starts) and np.allclose(got[1], moves) and np.allclose(got[2][:9], emits)


def test_language_model_does_not_depend_on_the_layout(spark):
    r = random.Random(8)
    rows = [(i, prose(r.randint(0, 400), r=r)) for i in range(150)]
    one, other = ({x.doc_id: x.score for x in hmm_lm.likelihoods(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()} for n in (1, 7))
    assert max(abs(one[i] - other[i]) for i in one) < 0.01


def test_fingerprints(docs, rows, empty, spark):
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows))
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in iblt.fingerprints(docs).collect()))
    want = []
    for k, (has, i, a) in enumerate(order):
        b = order[(k + 1) % len(order)][2]
        e = iblt.edited(a, b)
        da, de, db = (set(iblt.digests(pa.array([t]))[0].tolist()) for t in (a, e, b))
        like = lambda x, y: round(len(x & y) / len(x | y), 9) if x | y else 1.0
        want.append((has, i, len(a), hashlib.sha256(e.encode()).hexdigest(), like(da, de), like(da, db)))
    assert got == sorted(want)
    prints = {}
    for r in iblt.fingerprints(docs).collect():
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[0] == prints[3]
    assert iblt.fingerprints(empty).count() == 0
    one = iblt.fingerprints(spark.createDataFrame([(5, "alone. here.")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_digests_by_hand():
    texts = ["a b. c d\ne f", None, "", "x " * 30 + "y", "same. same. same.", "é! é! z", "A b. c d\ne f"]
    d, per = iblt.digests(pa.array(texts))
    assert per.tolist() == [3, 0, 0, 3, 3, 3, 3] and len(set(d.tolist())) == len(d) - 2
    assert d[:3].tolist()[1:] == d[-3:].tolist()[1:] and d[0] != d[-3]


def test_sketches_peel_or_fail():
    a, b = np.arange(1, 4000, dtype=np.uint64), np.arange(2000, 6000, dtype=np.uint64)
    d, per = common.mix64(np.concatenate([a, b])), np.array([len(a), len(b)])
    one, two = np.array([0]), np.array([1])
    assert not iblt.Sketches.of(d, per, 48).minus(one, two).peel()[3].any()
    _, found, sign = iblt.differences(d, per, one, two)
    first, second = set(d[: len(a)].tolist()), set(d[len(a) :].tolist())
    assert set(found[sign > 0].tolist()) == first - second and set(found[sign < 0].tolist()) == second - first
    assert len(iblt.differences(d, per, one, one)[0]) == 0


def test_large_differences_end():
    n = 3_000_000
    d = common.mix64(np.arange(n, dtype=np.uint64))
    assert len(iblt.differences(d, np.array([n, 0]), np.array([0]), np.array([1]))[0]) == n


def test_hot_ids_are_dealt_on(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{i} " + "x" * 200) for i in range(3000)]
    parts, n = common.in_ranges(spark.createDataFrame(rows, "doc_id long, text string"), 20_000)
    got = parts.groupBy("part").agg({"doc_id": "min", "*": "count"}).collect()
    assert max(r["count(1)"] for r in got) < 400 and max(r.part for r in got) < n
    spans = sorted((r.part, r.lo is not None, r.lo or 0, r.hi or 0) for r in parts.groupBy("part").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "lo").join(parts.groupBy("part").agg({"doc_id": "max"}).withColumnRenamed("max(doc_id)", "hi"), "part").collect())
    assert all(a[3] <= b[2] for a, b in zip(spans, spans[1:]))


def labelled(n, bad, word):
    r = random.Random(3)
    out = []
    for i in range(n):
        y = r.random() < 0.3
        t = prose(r.randint(5, 80), r=r)
        out.append((i, bad(t) if y and bad else t + (" " + word + " " + prose(5, r=r) if y else ""), int(y)))
    return out


def test_quality(spark, docs, empty):
    data = labelled(500, lambda t: " ".join(w + "###" for w in t.split()), "")
    d = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - y, 0) for i, _, y in data], "doc_id long, quality int, toxic int")
    truth = {i: 1 - y for i, _, y in data}
    got = [r for r in byte_cnn.predict(d, labels).collect() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in got) / len(got) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    none = labels.limit(0)
    assert {r.score for r in byte_cnn.predict(docs, none).collect()} == {0.5}
    assert byte_cnn.predict(docs, labels).count() == docs.count()
    assert byte_cnn.predict(empty, labels).count() == 0
    assert byte_cnn.keep_good(docs, labels).columns == docs.columns


def test_toxicity_catches_misspellings(spark, docs, empty):
    data = labelled(500, None, "zzidiotzz")
    d = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    truth = {i: y for i, _, y in data}
    got = [r for r in subword_toxicity.predict(d, labels).collect() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in got) / len(got) > 0.95
    odd = spark.createDataFrame([(1, prose(300) + " zzidiottzz " + prose(300))], "doc_id long, text string")
    model = subword_toxicity.fit([(t, y) for _, t, y in data])
    score = subword_toxicity.scorer(model, spark)
    assert odd.select(score("text").alias("s")).first().s > 0.3
    assert subword_toxicity.predict(docs, labels.limit(0)).count() == docs.count()
    assert subword_toxicity.predict(empty, labels).count() == 0


def test_word_sums_equal_features():
    texts = pa.array(["Some WORDS, here", None, "", "x", "a\tbb\nccc"])
    f, total, per = subword_toxicity.features(texts)
    table = np.random.default_rng(1).normal(size=subword_toxicity.BUCKETS).astype(np.float32)
    sums, n, per2 = subword_toxicity.word_sums(texts, table)
    assert (total == n).all() and (per == per2).all()
    assert np.allclose(np.bincount(np.repeat(np.arange(len(total)), total), table[f], len(total)), sums, atol=1e-4)


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31])
def test_packing_bits(bits):
    v = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    assert (bitpack.unpack(bitpack.pack(v, bits), len(v), bits) == v).all()


def library(name):
    """Ids by the library as it is, little-endian."""
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoding_is_the_librarys(name, rows, monkeypatch):
    plain, r = library(name), random.Random(3)
    odd = ["", " ", "  a  b\n\n c", "a\tb c", "don't  stop\n'll we'll", "e ́x", "ΑΣ ΣΑΣ.", "1234 56\n7", "a <|endoftext|> b", "<|startoftext|>x", "a \n b", "日本 語、", "thus###", "ﬁ ½ x²!", "a\u00a0 b\u3000", "\x1ca \x1f", "İ ıI é, ×,", *(r[1] for r in rows)]
    odd += ["".join(r.choice("abAB \n\t.,'’é ×  <|>ñÑ1Σ") for _ in range(r.randint(1, 40))) for _ in range(500)]
    want = [plain(t) for t in odd]
    assert encode.Encoder(public_tokenizers.path(name)).batch(odd) == want
    monkeypatch.setattr(encode, "PIECES", 60)  # pieces go and come back
    e = encode.Encoder(public_tokenizers.path(name))
    assert [x for a in range(0, len(odd), 7) for x in e.batch(odd[a : a + 7])] == want and len(e.known.key) <= 4000


def test_token_files(docs, rows, empty, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = library("word_bpe_49k.json")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in bitpack.read_index(bitpack.write(docs, common.scratch_dir(spark) + "/t", path, 1)).collect())
    want, at = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain(t) + (1).to_bytes(4, "little")
        want.append((at, i, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
    assert bitpack.read_index(bitpack.write(empty, common.scratch_dir(spark) + "/t", path, 1)).count() == 0


def test_random_access(tmp_path):
    ids = np.random.default_rng(0).integers(0, 49_000, 5000).astype(np.uint32)
    p = tmp_path / "x"
    p.write_bytes(bitpack.serialize([4, None, 9], [10, 0, 4990], ids, 16, block=64))
    with p.open("rb") as f:
        r = bitpack.Reader(f)
        assert (r.span(63, 130) == ids[63:130]).all()
        assert (r.document(2) == ids[10:]).all()
        assert [(d, s, len(x)) for d, s, x in r.documents(100)] == [(4, 0, 10), (None, 10, 0), (9, 10, 4990)]


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def test_decontamination(spark, docs, empty):
    r = random.Random(5)
    items = [(i, prose(r.randint(8, 30), r=r)) for i in range(12)] + [(98, None), (99, "...")]
    texts = []
    for k in range(40):
        item = list(r.choice(items[:12])[1])
        for _ in range(k % 10):
            item[r.randrange(len(item))] = r.choice("abcxyz ")
        texts.append((k, prose(30, r=r) + " " + "".join(item) + ", " + prose(30, r=r)))
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(d, b).collect()}
    want = {}
    for k, t in texts:
        for i, q in items:
            p = decontaminate.plain(q)
            if p and (n := distance(p, decontaminate.plain(t))) <= int(len(p) * decontaminate.ERRORS):
                want[k, i] = n
    assert got == want and want
    assert {x.doc_id for x in decontaminate.keep_clean(d, b).collect()} == {k for k, _ in texts} - {k for k, _ in want}
    assert decontaminate.contaminated(docs, b.limit(0)).count() == 0
    assert decontaminate.contaminated(empty, b).count() == 0
    assert decontaminate.keep_clean(docs, b).columns == docs.columns


def test_language(spark, docs, empty):
    r = random.Random(2)
    data = [(i, prose(r.randint(3, 40), LANGS[lang], r), lang) for i in range(200) for lang in [r.choice(["en", "de"])]]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "123 ... !", "en"), (1003, "über der Straße", None)]
    got = {x.doc_id: x for x in langid_kn.predict(spark.createDataFrame(data + odd, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in data)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert langid_kn.predict(docs).count() == docs.count()
    assert langid_kn.predict(empty).count() == 0


def test_kneser_ney_sums_to_one():
    m = langid_kn.Models(["x"]).fit([["abab abba baab", "aab bba"]])
    total = 0.0
    for c in ["a", "b", "\n"]:
        words = ["ab" + c] if c != "\n" else ["ab"]
        codes, starts, ends, _ = langid_kn.words(words)
        marked, at, back = langid_kn._marked(codes, starts, ends)
        p = 2.0 ** -m.costs(codes, starts, ends)[0, 0]
        shorter = 2.0 ** -m.costs(*langid_kn.words(["a"])[:3])[0, 0]
        assert p > 0 and shorter > 0
        total += p
    assert total < 1


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = library("byte_bpe_50k.json")
    got = packing.pack(docs, path, 2).toPandas()
    want = []
    for r in rows:
        ids = plain(r[1]) + (2).to_bytes(4, "little")
        want += [(str(r[0]), k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(packing.cut(len(ids) // 4, 1024))]
    ours = [(str(None if x.doc_id != x.doc_id else int(x.doc_id)), x.piece, x.start, x.length, x.ids_crc32) for x in got.itertuples()]
    assert sorted(ours) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 1024
    assert packing.pack(empty, path, 2).count() == 0


def test_plan_is_full_where_it_can_be():
    histogram = {600: 10, 424: 10, 512: 8, 100: 3, 1024: 2}
    rows = packing.plan(histogram)
    sequences = 1 + max(first + (high - low) // k - 1 for _, low, high, first, k, _ in rows)
    assert sequences == 10 + 4 + 1 + 2
    for n, k in histogram.items():
        spans = sorted((low, high) for m, low, high, *_ in rows if m == n)
        assert [s[0] for s in spans] == [0, *(s[1] for s in spans[:-1])] and spans[-1][1] == k


def test_fullest_is_the_fullest():
    r = random.Random(8)
    for _ in range(200):
        room, counts = r.randint(1, 30), np.zeros(31, np.int64)
        for _ in range(r.randint(0, 6)):
            counts[r.randint(1, 30)] += r.randint(1, 2)
        items = [n for n in range(31) for _ in range(counts[n])]
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums if s + n <= room}
        got = packing.fullest(np.where(np.arange(31) <= room, counts, 0), room)
        assert sum(got) == max(sums) and not Counter(got) - Counter(items)


@pytest.mark.parametrize("bucket", [1, suffix_dedup.BUCKET])
def test_repeats(spark, docs, rows, empty, bucket):
    r = random.Random(9)
    shared = ["".join(r.choice("abcd ") for _ in range(n)) for n in (399, 400, 401, 650, 1200)]
    more = [(1000 + i, prose(r.randint(0, 40), r=r) + s[r.randint(0, 3) :] + prose(r.randint(0, 40), r=r)) for i in range(30) for s in [r.choice(shared)]]
    more += [(2000, shared[3] + "é" + shared[3]), (2001, "é" * 500), (2002, "z" * 399)]
    data = [(x[0], x[1]) for x in rows] + more
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    n = 400
    raw = [(i, (t or "").encode()) for i, t in data]
    seen = Counter(b[k : k + n] for _, b in raw for k in range(len(b) - n + 1))
    want = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((str(i), len(b), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone))), hashlib.sha256(kept).hexdigest()))
    got = [(str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digest(suffix_dedup.remove_repeats(d, bucket=bucket)).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    clean = suffix_dedup.without_repeats(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()


def test_suffix_sort():
    r = np.random.default_rng(4)
    buf = r.integers(97, 99, 600).astype(np.uint8)
    starts = r.permutation(500)[:200]
    segment = np.sort(r.integers(0, 7, 200))
    order = suffix_dedup.suffix_sort(buf, suffix_dedup.Prefix(buf), starts, segment, 50)
    want = sorted(range(200), key=lambda i: (segment[i], buf[starts[i] : starts[i] + 50].tobytes()))
    assert [(segment[i], buf[starts[i] : starts[i] + 50].tobytes()) for i in order] == [(segment[i], buf[starts[i] : starts[i] + 50].tobytes()) for i in want]


def test_quality_scores_are_those_of_a_slow_forward_pass():
    net, r = byte_cnn.Network(), random.Random(4)
    texts = ["", "a", prose(3, r=r), prose(60, r=r), "é" * 700, "x" * 248, "x" * 249, prose(400, r=r)]
    filters = np.einsum("bd,odf->obf", net.p["bytes"], net.p["filters"])
    step, want = byte_cnn.HALF * byte_cnn.STRIDE, []
    for t in texts:
        raw = t.encode()
        n = max(2, -(-(len(raw) + byte_cnn.WIDTH) // step))
        raw = raw.ljust(n * step, b"\0") + bytes(byte_cnn.WIDTH)
        value = [sum(filters[o][raw[i + o]] for o in range(byte_cnn.WIDTH)) for i in range(0, n * step, byte_cnn.STRIDE)]
        chunks = [np.maximum(np.max(value[h * byte_cnn.HALF : (h + 2) * byte_cnn.HALF], axis=0) + net.p["bias"], 0) for h in range(n - 1)]
        z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.p["out"] + net.p["last"][0]
        want.append(1 / (1 + math.exp(-z)))
    together, alone = net.scores([t.encode() for t in texts]), [net.scores([t.encode()])[0] for t in texts]
    assert np.allclose(together, want, atol=1e-5) and np.allclose(alone, want, atol=1e-5)


def test_kneser_ney_by_dictionaries():
    text = ["abab abba baab", "aab bba abc"]
    m = langid_kn.Models(["x"]).fit([text])
    marked = [[0, *map(ord, w), 0] for t in text for w in t.split()]
    tables = []
    for n in range(1, langid_kn.ORDER + 1):
        seen = Counter() if n == langid_kn.ORDER else set()
        for w in marked:
            for p in range(1, len(w)):
                if p < n - 1:
                    continue
                gram = tuple(w[p - n + 1 : p + 1])
                if n == langid_kn.ORDER:
                    seen[gram] += 1
                else:
                    seen.add((gram, tuple(w[p - n : p + 1]) if p >= n else gram))
        count = seen if n == langid_kn.ORDER else Counter(g for g, _ in seen)
        total, kinds = Counter(), Counter()
        for g, c in count.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        tables.append((count, total, kinds))
    alphabet = len({c for w in marked for c in w}) + 1

    def cost(word):
        w, bits = [0, *map(ord, word), 0], 0.0
        for p in range(1, len(w)):
            q = 1 / alphabet
            for n, (count, total, kinds) in enumerate(tables, 1):
                context = tuple(w[p - n + 1 : p])
                if p >= n - 1 and total[context]:
                    q = max(count[(*context, w[p])] - langid_kn.DISCOUNT, 0) / total[context] + min(1, langid_kn.DISCOUNT * kinds[context] / total[context]) * q
            bits -= math.log2(q)
        return bits

    for word in ["abab", "abba", "ccc", "a", "abcabc", "zz"]:
        codes, starts, ends, _ = langid_kn.words([word])
        assert abs(m.costs(codes, starts, ends)[0, 0] - cost(word)) < 1e-3


def test_language_model_score_in_plain_python(spark, monkeypatch):
    """The score of held-out and training texts by a loop over states, from the model and the counts alone."""
    r, kept = random.Random(6), {}
    rows = [(i, prose(r.randint(0, 60), r=r) + (" unseen" if i % 5 == 0 else "")) for i in range(60)] + [(100, None), (101, "only unknown words here"), (None, "no id")]
    scored, vocabulary = hmm_lm._scored, hmm_lm.vocabulary
    monkeypatch.setattr(hmm_lm, "_scored", lambda sent: kept.update(model=sent.value) or scored(sent))
    monkeypatch.setattr(hmm_lm, "vocabulary", lambda t: kept.update(v=vocabulary(t)) or kept["v"])
    got = sorted(((str(x.doc_id), x.score) for x in hmm_lm.likelihoods(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    model, (v, _) = kept["model"], kept["v"]
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts = Counter(x for d, t in rows if not out(d) for x in tokens(t))
    want = []
    for d, t in rows:
        h, kind, _ = hmm_lm._tokens(pa.array([t or ""]))
        total, a = 0.0, None
        for s, token in zip(v.symbol(h, kind).tolist(), tokens(t)):
            e = [float(x) for x in model.emit[s]]
            a = [float(model.start[j]) * e[j] for j in range(hmm_lm.STATES)] if a is None else [sum(a[i] * float(model.move[i, j]) for i in range(hmm_lm.STATES)) * e[j] for j in range(hmm_lm.STATES)]
            c = sum(a)
            total, a = total + math.log10(c), [x / c for x in a]
            if s >= hmm_lm.HEAD:
                total += math.log10((counts.get(token, 0) + 1) / float(v.room[s - hmm_lm.HEAD]))
        want.append((str(d), total))
    assert [x for x, _ in got] == [x for x, _ in sorted(want)]
    assert all(abs(a - b) < 1e-3 * max(1, abs(b)) for (_, a), (_, b) in zip(got, sorted(want)))


def test_very_long_texts_are_cut_into_runs_in_parts(monkeypatch):
    r = random.Random(12)
    text = "".join(r.choice("abc ") for _ in range(9000))
    b = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, "short"], pa.string())], names=["doc_id", "text"])
    whole = pa.Table.from_batches(suffix_dedup._spans(400, 100)(iter([b])))
    monkeypatch.setattr(suffix_dedup, "PART", 1000)
    parts = pa.Table.from_batches(suffix_dedup._spans(400, 100)(iter([b])))

    def anchors(t):
        return {w: a for lo, hi, a in zip(t["low"].to_pylist(), t["high"].to_pylist(), t["anchor"].to_pylist()) for w in range(lo, hi + 1)}

    assert anchors(whole) == anchors(parts) and sorted(anchors(parts)) == list(range(len(text) - 399))
    assert sum(h - lo + 1 for lo, h in zip(parts["low"].to_pylist(), parts["high"].to_pylist())) == len(text) - 399


def test_names_that_clash(spark):
    r = random.Random(13)
    shared = prose(120, r=r)
    rows = [(i, (prose(20, r=r) + " " + shared) if i < 3 else prose(50, r=r), f"k{i}", f"n{i}", i, "w", b"x") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, keep_node string, keep_id int, windows string, row_key binary")
    cut = {x.doc_id: x for x in suffix_dedup.without_repeats(docs).collect()}
    assert all((cut[i].key, cut[i].windows, bytes(cut[i].row_key)) == (k, w, b"x") for i, _, k, _, _, w, _ in rows)
    assert len(cut[0].text) < len(rows[0][1]) - 400 and cut[5].text == rows[5][1]
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns and {x.key for x in kept.collect()} <= {f"k{i}" for i in range(6)}


def test_components(spark):
    r = random.Random(14)
    names = [bytes([r.randrange(256) for _ in range(16)]) for _ in range(60)]
    links = [(names[i], names[i + 1]) for i in range(0, 29)] + [(names[30], names[40]), (names[40], names[30]), (names[45], names[45]), (names[50], names[51]), (names[51], names[52])]
    got = {bytes(x.node): bytes(x.label) for x in bagminhash.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert len({got[n] for n in names[:30]}) == 1 and got[names[30]] == got[names[40]] and len({got[names[i]] for i in (50, 51, 52)}) == 1
    assert len(set(got.values())) == 3
    assert bagminhash.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_suffix_dedup_groups_equal_spans_of_a_block():
    """A passage of all texts of a block is one row for each of its spans, with all places; nothing is lost."""
    r = np.random.default_rng(5)
    words = lambda n: " ".join("".join(map(chr, r.integers(97, 123, 7))) for _ in range(n))
    passage = words(120)
    texts = [f"{words(60)} {passage} {words(60)}" for _ in range(50)] + ["", passage]
    b = pa.RecordBatch.from_arrays([pa.array(range(52), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    one = pa.Table.from_batches(suffix_dedup._spans(400, 100)(iter([b]))).to_pylist()
    rows = pa.Table.from_batches(suffix_dedup._grouped(suffix_dedup._spans(400, 100))(iter([b]))).to_pylist()
    assert len(rows) == len({x["h"] for x in one}) < len(one)
    places = [(x["h"], p["doc"], p["low"], p["high"]) for x in rows for p in [x, *x["more"]]]
    assert sorted(places) == sorted((x["h"], x["doc"], x["low"], x["high"]) for x in one)
    assert max(len(x["more"]) for x in rows) >= 49
    assert all([(p["doc"], p["low"]) for p in [x, *x["more"]]] == sorted((p["doc"], p["low"]) for p in [x, *x["more"]]) for x in rows)


def test_suffix_dedup_groups_equal_windows_of_a_hot_bucket():
    """A window of all runs of a block is one row with all its places; neighbours come back as one run."""
    r = np.random.default_rng(6)
    text = lambda n: r.integers(97, 123, n).astype(np.uint8).tobytes()
    core, docs = text(410), [bytes([i]) * 16 for i in r.permutation(60)]
    rows = [(d, 5, 25, 30, i % 4 == 0, b"c", 60, text(4) + bytes([i]) + core + bytes([i]) + text(4)) for i, d in enumerate(docs)]
    b = pa.RecordBatch.from_pylist([dict(zip(suffix_dedup._CUT_NAMES, x)) for x in rows], pa.schema([("doc", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("anchor", pa.int32()), ("whole", pa.bool_()), ("core", pa.binary()), ("k", pa.int64()), ("bytes", pa.binary())]))
    got = pa.Table.from_batches(suffix_dedup._window_digests(400)(iter([b])))
    shared = [x for x in got.to_pylist() if x["n"] > 1]
    assert len(shared) == 11 and got.num_rows == 11 + 60 * 10
    assert sum(x["n"] for x in got.to_pylist()) == 60 * 21
    for x in shared:
        assert x["n"] == 60 and x["at"]["doc"] == min(docs) and x["other"]["doc"] == max(docs)
        assert [p["doc"] for p in x["places"]] == sorted(d for i, d in enumerate(docs) if i % 4)
    part = pa.RecordBatch.from_pylist([{"places": x["places"]} for x in shared], pa.schema([got.schema.field("places")]))
    runs = pa.Table.from_batches(suffix_dedup._merged(iter([part]))).to_pylist()
    assert sorted((x["doc"], x["low"], x["high"]) for x in runs) == sorted((d, 10, 20) for i, d in enumerate(docs) if i % 4)
