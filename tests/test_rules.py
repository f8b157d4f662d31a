"""Rules on requirement texts, decisions and outlines by hand-made rows."""

import compare
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake import config as K
from auditlake.operators import decide as D
from auditlake.operators import evaluate as E
from auditlake.operators import evidence as V
from auditlake.operators import jobs as J
from auditlake.operators import provider as A
from auditlake.operators import rules as R
from auditlake.operators import search as S
from auditlake.operators import template as M
from auditlake.operators import topics as TP
from auditlake.plans import registry
from auditlake.sources import files


def over(spark, texts, expr):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.x for r in df.select("i", expr(F.col("text")).alias("x")).orderBy("i").collect()]


def test_fixed_values():
    """Damage, error kinds, levels and times as published."""
    assert (K.DAMAGE["T", "E"], K.DAMAGE["T", "A"], K.DAMAGE["A", "N"], K.DAMAGE["N", "E"], K.DAMAGE["N", "T"], K.DAMAGE["N", "A"]) == (0.3, 0.3, 1.0, 0.7, 0.6, 0.4)
    assert sum(map(len, K.ERROR_KINDS.values())) == 12 and K.EMPHASIS == [0.5, 0.75, 1.0, 1.5, 2.0]
    assert D.LEVELS["targeted"] == ["cost", "contradiction", "material", "opposite"] and D.LEVELS["thorough"][4:] == ["duty", "probability"]
    assert (K.SILENCE_S, K.START_S) == (60, 180)


def test_costs(spark):
    texts = [
        "Werden Termine nicht eingehalten, gehen die Kosten zu Lasten des Lieferanten.", "Die Kosten trägt der Lieferant nicht.", "Die Kosten der Reparatur trägt der Auftraggeber, nicht der Lieferant.", "Der Lieferant weist die Kosten im Angebot zu Lasten aus.",
        "Repairs are charged to the contractor.", "Mehrkosten sind nicht zu Lasten des Lieferanten.", None, "", "Vertragsstrafe zahlt der Lieferant; es wird nichts weiterberechnet.",
    ]
    assert over(spark, texts, R.is_cost) == [True, False, False, False, True, False, False, False, True]


def test_edges_of_words(spark):
    """Words within other words: as the published patterns have them, with edges where they have them and none elsewhere."""
    costs = ["Die Kosten für den Lieferanten betragen 500 EUR.", "Der Lieferant ist mit den Kosten zu beauftragen.", "Die Kosten des Umbaus tragen Lieferant und Hersteller.", "Kosten trägt der Lieferant", "Kosten trägtx der Lieferant", "Die Herstellerkosten, gehen"]
    assert over(spark, costs, R.is_cost) == [False, False, True, True, False, True]
    signs = ["Eine maximale Härte und zwingende Vorgaben.", "Das ist nurmehr so", "Unfrist", "en detail", "nach EN Norm", "DIN", "dina4", "Seite 9 und S12", "S. 4,2 mit 7", "Max. Druck", "maxi", "Übermaximal"]
    assert over(spark, signs, R.reason_signs) == [["duty"], ["duty"], [], [], ["number"], ["number"], ["number"], [], ["number"], ["duty"], [], []]
    words = ["Markenname", "Das Sofa.", "Firmament", "Fa. Muster, Firma; Marke", "Fabrikatsbindung des Herstellers", "alfa.", None, "a.fa.", "Großfirma"]
    assert over(spark, words, R.procurement_words) == [[], [], [], ["fa.", "firma", "marke"], ["fabrikat", "hersteller"], [], [], ["fa."], []]
    values = ["5 Hubwerke", "5 Hub", "5 Hub, 7 Hübe", "3 Barren", "3 bar", "4 mmx", "4 mm 5 mm", "150 Abgüsse"]
    assert [[(v.unit, v.value) for v in x] for x in over(spark, values, R.values)] == [[], [("hübe", 5.0)], [("hübe", 5.0), ("hübe", 7.0)], [], [("bar", 3.0)], [], [("mm", 4.0), ("mm", 5.0)], [("schuss", 150.0)]]


def test_vendors(spark):
    texts = ["Es sind nur Normalien von HASCO zu verwenden.", "Normalien von HASCO oder gleichwertig verwenden.", "Hascos sind nur gut.", "Hydraulics must be Rexroth.", None]
    assert over(spark, texts, R.is_binding) == [True, False, False, True, False]


def test_contents(spark):
    texts = ["Inhaltsverzeichnis\n1 A", "Im Inhaltsverzeichnis sind Blätter genannt", "3.4 Toleranzauslegung ......... 12", "Protokolle mit folgendem Inhalt", "Inhalt der Lieferung", "... und was Inhalt sein muss", "1 A ..... 3\n2 B ..... 4\nText", "", None, "Text\n1 A ..... 3\nText"]
    assert over(spark, texts, R.is_contents) == [True, False, True, False, True, False, True, False, False, False]


@pytest.mark.parametrize(("text", "want"), [("150.000 Schuss", ("schuss", 150000.0)), ("150,000 shots", ("schuss", 150000.0)), ("0,025 mm", ("mm", 0.025)), ("150,000 mm", ("mm", 150.0)), ("1,500,000 Zyklen", ("schuss", 1500000.0)), ("0.7 bar", ("bar", 0.7)), ("200 °C", ("°c", 200.0)), ("12 %", ("%", 12.0))])
def test_values(spark, text, want):
    got = over(spark, [text], R.values)[0]
    assert [(v.unit, v.value) for v in got] == [want]


def test_answers(spark):
    texts = ['x {"a": "}{", "b": {"c": 1}} y}', '{"a": "\\"}"} z', "no", '{"a": 1', None, '[1] {"k": [2]}']
    assert over(spark, texts, R.first_object) == ['{"a": "}{", "b": {"c": 1}}', '{"a": "\\"}"}', None, None, None, '{"k": [2]}']
    df = spark.createDataFrame([(1, '{"status": " a", "begruendung": " x ", "fundstelle": "S3"}'), (2, '{"status": "n", "begruendung": "x"}'), (3, '{"status": "Q"}'), (4, "{bad}")], "i int, answer string")
    got = {r.i: r for r in R.parsed(df).collect()}
    assert tuple(got[1].said) == ("A", "x", "S3") and tuple(got[2].said) == ("N", "", "") and got[3].unreadable and got[4].said is None
    assert over(spark, ["S3", "Abschnitt 4.2", "S. 3; Seite 12, 7", "12345", None], R.page_numbers) == [["3"], [], ["3", "12", "7"], [], []]


def test_evidence_rule(spark):
    said = spark.createDataFrame([(1, n, (s, r, e)) for n, (s, r, e) in enumerate([("E", "r", "S3"), ("E", "", "S3"), ("N", "r", "S3"), ("A", "r", "S97"), ("T", "r", "S3, S97, S5"), ("E", "r", "ohne")])] + [(2, 0, ("E", "r", "S8")), (2, 1, ("E", "r", "none"))], "doc_id int, nr int, said struct<status:string,reason:string,evidence:string>")
    p = spark.createDataFrame([(1, n, k, page) for n in range(6) for k, page in ((1, 5), (2, 3))], "doc_id int, nr int, rank int, page int")
    got = {(r.doc_id, r.nr): (r.status, r.evidence) for r in R.with_evidence(said, p).collect()}
    assert got == {(1, 0): ("E", "S3"), (1, 1): ("N", ""), (1, 2): ("N", ""), (1, 3): ("A", "S5"), (1, 4): ("T", "S3, S5"), (1, 5): ("E", "S5"), (2, 0): ("E", "S8"), (2, 1): ("N", "")}


def test_reasons(spark):
    texts = ["Widerspricht dem Standard.", "Steht nicht im Widerspruch.", "Seite 9, Abschnitt 3.2", "Nach DIN 2768", "nur einmal", "Firma X", None]
    assert over(spark, texts, R.reason_signs) == [["contradiction"], [], [], ["number"], ["duty"], ["procurement"], []]
    assert over(spark, ["ACME und acme ACME WKZ42, 2768 DIN 1.2312", None], R.facts_of) == [["ACME", "WKZ42", "2768", "1.2312"], []]


def test_facts_share_no_dot_or_comma(spark, tmp_path):
    """Two facts with one dot or comma between them, held against the SQL of the same texts."""
    texts = ["THEANT,IBDA!! X.ABC LA!! QUE!! AB", "ABC.DEF.GHI 1.2312,2768\n4711", "1.000.ABC-XYZ DIN ABC", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert over(spark, texts, R.facts_of) == [["THEANT", "ABC", "QUE"], ["ABC", "GHI", "1.2312,2768", "4711"], ["1.000", "XYZ", "ABC"], [], []]
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare.tidy(registry.QUERIES["p15_hard_facts"](spark, str(tmp_path)).toPandas()) == compare.tidy(con.execute(registry.ORACLES["p15_hard_facts"]).df())


def test_texts_without_a_unit_have_no_values(spark):
    """No unit is looked for where no number has one; blanks in a unit that fall together in a sentence still count."""
    assert over(spark, ["Blatt 5 mmx", "12 Teile", None, "5 bar"], R.values)[:3] == [None] * 3
    p = spark.createDataFrame([(1, 0, 1, 7, "Die Form hat 90 °  C im Betrieb."), (1, 1, 1, 8, "Der Druck liegt bei 5\n bar")], "doc_id int, nr int, rank int, page int, text string")
    r = spark.createDataFrame([(0, 1, "required", "10 °C"), (1, 1, "required", "9 bar")], "nr int, pos int, field string, text string")
    assert sorted(map(tuple, R.value_signs(p, r).select("nr", "found", "page").collect())) == [(0, "90 °c", 7), (1, "5 bar", 8)]


def test_headings(spark):
    text = "1 Allgemeines\n1.1 Geltung\n1 Aufzählung eins\n1.4 Zeichnungen\n3 Werkzeug\n3.1 Aufbau ..... 7\n9 Zu weit weg\n2 Zurück geht nicht\n4.1 Kein Kapitel davor\n4 Abnahme"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "7 Zu hoch")], "doc_id int, text string")
    assert [(r.number, r.title) for r in M.headings(M.lines_of(docs)).orderBy("line").collect()] == [("1", "Allgemeines"), ("1.1", "Geltung"), ("1.4", "Zeichnungen"), ("3", "Werkzeug"), ("4", "Abnahme")]
    s = M.chapter_sections(M.lines_of(spark.createDataFrame([(1, "1 Allgemeines\n" + "Satz eins. " * 8 + "\n2 Werkzeug\n" + "Satz zwei. " * 8)], "doc_id int, text string")), with_title=True).orderBy("section_idx").collect()
    assert [(r.section_idx, r.chapter, r.text[:13]) for r in s] == [(0, "1 Allgemeines", "1 Allgemeines"), (1, "2 Werkzeug", "2 Werkzeug Sa")]


def newton(x, y, k, c, steps=40):
    """Multinomial logistic regression of C-form by Newton's method: sum of losses times C and half the squared weights; intercepts are free."""
    n, d = x.shape
    z, onehot, w = np.hstack([x, np.ones((n, 1))]), np.eye(k)[y], np.zeros((k, d + 1))
    ridge = np.diag([1.0] * d + [0.0])
    for _ in range(steps):
        s = z @ w.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = c * (p - onehot).T @ z + w @ ridge
        h = np.zeros((k, d + 1, k, d + 1))
        for i in range(k):
            for j in range(k):
                h[i, :, j, :] = c * (z * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ z + (i == j) * ridge
        w -= np.linalg.lstsq(h.reshape(k * (d + 1), -1), g.ravel(), rcond=None)[0].reshape(k, d + 1)
    s = z @ w.T
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("classes", [["E", "T"], ["E", "T", "A"]])
def test_training_is_newtons(spark, classes):
    r = np.random.default_rng(1)
    x = r.normal(size=(120, 3)) * [1, 5, 0.1]
    y = np.clip((x[:, 0] + x[:, 1] / 5 + r.normal(size=120) > 0).astype(int) + (x[:, 1] > 6), 0, len(classes) - 1)
    rows = spark.createDataFrame([(i, *map(float, v), classes[k]) for i, (v, k) in enumerate(zip(x, y))], "i int, a double, b double, c double, ref string")
    m = D.train(rows, ["a", "b", "c"], D.CLASSES)
    got = D.probabilities(rows, m, "i").orderBy("i").toPandas()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = newton(z, y, len(classes), 0.5)
    # The binary model has one row of weights: its penalty is on one row, not two.
    tolerance = 0.03 if len(classes) == 2 else 2e-3
    assert np.abs(got[[f"p_{k.lower()}" for k in classes]].to_numpy() - want).max() < tolerance
    assert (got.p_n == 0).all() and m.cases == 120


def test_training_without_rows(spark):
    rows = spark.createDataFrame([], "i int, a double, ref string")
    m = D.train(rows, ["a"], D.CLASSES)
    assert D.probabilities(spark.createDataFrame([(1, None)], "i int, a double"), m, "i").first().p_e == 0.25
    assert m.state({}) == "active" and m.moved("x").search["template"] == "x"


def facts(spark, rows):
    kind = "doc_id int, nr int, status string, p double, ranked double, reason string, evidence string, lifted boolean, share_a double, hint struct<page:string,words:string>, vendor struct<sentence:string,page:int>, cost struct<sentence:string,page:int>, value struct<found:string,known:string,page:int>, material struct<found:string,known:string,page:int>, opposite string"
    full = [(1, nr, s, p, None, reason, "S1", False, share, hint, None, cost, None, None, None) for nr, s, p, reason, share, hint, cost in rows]
    return spark.createDataFrame(full, kind)


def test_flagging(spark):
    rows = [
        (0, "A", 0.1, "r", None, None, None), (1, "N", 0.9, "", None, ("S4", "firma"), ("Der Lieferant zahlt.", 7)), (2, "E", 0.9, "widerspricht", None, None, None), (3, "E", 0.8, "ok", None, None, None),
        (4, "E", 0.7, "ok", 0.5, None, None), (5, "T", 0.6, "ok", None, None, None), (6, "E", 0.5, "ok", None, None, None), (7, "E", 0.4, "ok", None, None, None), (8, "E", 0.3, "ok", None, None, None), (9, "E", 0.0, "ok", None, None, None), (10, None, 0.9, "", None, None, None),
    ]
    got = {r.nr: r for r in D.flagged(facts(spark, rows)).collect()}
    assert (got[0].status, got[0].status_model, got[0].origin) == ("A", None, "model")
    assert (got[1].status, got[1].status_model, got[1].evidence) == ("A", "N", "S7") and "Lieferant" in got[1].reason
    assert (got[2].origin, got[2].reason) == ("contradiction", "widerspricht")
    assert [got[n].status for n in (3, 4, 5, 6, 7, 8, 9)] == ["A", "A", "A", "A", "A", "E", "E"]
    assert got[10].status is None
    old = {r.nr: r for r in D.flagged(facts(spark, rows), "cautious", D.LEVELS_1_1).collect()}
    assert (old[1].status, old[1].evidence, old[4].origin, old[3].status) == ("A", "S4", "accumulation", "E")
    with pytest.raises(ValueError):
        D.flagged(facts(spark, rows), "loud")


def test_circuit_breaker(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * 7) for i in range(10)], "nr int, prompt string").coalesce(1)
    got = {r.nr: r.cause for r in A.ask(df, A.ByLength(7)).collect()}
    assert [got[i] for i in range(3)] == ["LLM-Aufruf fehlgeschlagen"] * 3 and got[3] == A.NO_CANDIDATE and {got[i] for i in range(4, 10)} == {A.NOT_ASKED}


def test_model_backed_operators(spark):
    p = spark.createDataFrame([(1, 5, 1, 9, "Die Fertigung erfolgt nach Freigabe durch den Kunden.")], "doc_id int, nr int, rank int, page int, text string")
    open_ = spark.createDataFrame([(5, "nach Freigabe")], "nr int, wording string")
    said = '[{"text": "Fertigung nach Freigabe durch Kunden", "fundstelle": "S99"}, {"text": "keine Angabe", "fundstelle": ""}, {"text": "third", "fundstelle": ""}]'
    assert [tuple(r) for r in A.hints(open_, p, lambda _: (said, True, "")).collect()] == [(1, 5, "S9", "Fertigung nach Freigabe durch Kunden")]
    affected = spark.createDataFrame([(5, 1, "a"), (5, 2, "b")], "nr int, pos int, text string")
    found = A.opposites(affected, p, lambda _: ('["q1", "q2"]', True, ""), lambda x: ('{"opposite": %s}' % str("q2" in x or "b" in x).lower(), True, ""))
    assert [tuple(r) for r in found.collect()] == [(1, 5, "q1", "b")]
    left = spark.createDataFrame([(1, 0, "x"), (1, 4, "y")], "doc_id int, section_idx int, text string")
    assert [tuple(r) for r in A.extras(left, lambda _: ('so: ["a", " ", "b "]', True, "")).orderBy("pos").collect()] == [(1, 0, "a"), (1, 1, "b")]
    reqs = spark.createDataFrame([(1, 1, "required", "nach Freigabe"), (2, 1, "required", "fest")], "nr int, pos int, field string, text string")
    none = spark.createDataFrame([], "nr int, print string, stance string")
    assert {r.nr: r.stance for r in A.stances(reqs, lambda _: ("", False, "x"), none).collect()} == {1: "open", 2: "silent"}
    pairs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i int, prompt string")
    say = {"a": ('{"wert": 140, "unterschied": "%s"}' % ("z" * 500), True, ""), "b": ("no", True, ""), "c": ("", False, "down")}
    got = {r.i: (r.value, len(r.note), r.error) for r in A.judged_pairs(pairs, say.__getitem__).collect()}
    assert got == {1: (100, 400, ""), 2: (None, 0, "no JSON"), 3: (None, 0, "down")}


def test_null_vectors_and_empty_archives(spark):
    kind = "vec_id long, label int, embedding array<float>"
    rows = [(0, 1, [1.0, 0.0]), (1, 2, [1.0, 0.1]), (2, 2, None), (3, 3, [None, 1.0]), (100, 2, [0.0, 1.0])]
    hits = S.best_hits(spark.createDataFrame(rows, kind), 0.5, 3, foreign=False).collect()
    assert {(r.query_id, r.vec_id) for r in hits} == {(0, 1)}
    assert S.document_ranking(spark.createDataFrame([], kind)).count() == 0


def test_liveness(spark):
    rows = [(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 00:09:30"), (2, 3, "2024-01-01 00:07:30"), (3, 4, "2024-01-01 00:05:00"), (3, 5, "2024-01-01 00:08:00"), (4, 6, "2024-01-01 00:06:00"), (1, 7, "2024-01-01 00:10:00")]
    e = spark.createDataFrame(rows, "user_id int, event_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.user_id: r.state for r in V.liveness(e).collect()} == {1: "running", 2: "running", 3: "dead", 4: "dead"}


def test_corpus_parts_and_resuming(spark):
    docs = spark.range(6).withColumnRenamed("id", "doc_id")
    assert sorted(r.doc_id for r in J.corpus_part(docs, "training", [1, 2], [3]).collect()) == [0, 3, 4, 5]
    assert sorted(r.doc_id for r in J.corpus_part(docs, "sample", [1, 2], [3]).collect()) == [3]
    with pytest.raises(ValueError):
        J.corpus_part(docs, "x", [], [])
    a = spark.createDataFrame([(1, "m", None), (2, "m", 1), (3, "m", 1)], "doc_id int, model string, n int")
    d = spark.createDataFrame([(1, "m", None), (2, "o", 1)], "doc_id int, model string, n int")
    assert sorted(r.doc_id for r in J.to_do(a, d, ["model", "n"]).collect()) == [2, 3]


def test_complete_linkage_small():
    v = np.array([[1, 0], [0.99, 0.1], [0.9, 0.44], [0, 1], [0.05, 1]])
    g = TP.complete_linkage(v, 0.05)
    assert g[0] == g[1] != g[2] and g[3] == g[4] != g[0]


def test_files(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>end</w:t><w:br w:type=\"page\"/><w:t>Two</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "A, B.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "t.txt").write_text("x\fy")
    (tmp_path / "bad.docx").write_bytes(b"no")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "skip.bin").write_bytes(b"0")
    f = files.folder(spark, f"file://{tmp_path}")
    got = {(r.doc_id, r.page): r.text for r in files.pages(f).collect()}
    assert got["A_B", 1] == "One\na | b\nend" and got["A_B", 2] == "Two" and got["t", 2] == "y"
    assert {d for d, p in got if p is None} == {"bad", "scan"}
    assert files.not_cached(f, f.filter("suffix = 'txt'").select("sha1")).count() == 3


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"version": "1", "kriterien": [{"nr": "4.10", "titel": "T", "kapitel": "K", "einstufung": "Pflicht", "abgleichbegriffe": ["a"]}, {"nr": "11", "titel": "U"}]}')
    assert [(r.ord, r.nr, r.terms) for r in files.read_criteria(spark, f"file://{tmp_path}/c.json").orderBy("ord").collect()] == [(0, "4.10", ["a"]), (1, "11", [])]
    (tmp_path / "s.jsonl").write_text('{"abschnitt_nr": "1", "standardanforderungen": ["old"]}\n{"abschnitt_nr": "1", "standardanforderungen": [" new ", ""], "auspraegungen_im_korpus": ["v"]}\n')
    s = files.read_standard(spark, f"file://{tmp_path}/s.jsonl")
    assert sorted((r.field, r.text) for r in files.statements(s).collect()) == [("required", "new"), ("variant", "v")]
    assert files.read_standard(spark, f"file://{tmp_path}/none.jsonl").count() == 0
    files.write_sheet(spark.createDataFrame([("=1+1", 2), ("a\x01b", 3)], "t string, n int"), f"file://{tmp_path}/out")
    assert sorted(r.t for r in spark.read.option("header", "true").csv(f"file://{tmp_path}/out").collect()) == ["'=1+1", "ab"]


def test_orientation(spark):
    rows = [(1, p, 8, a, 0.5 if a == 90 else 0.1) for p in range(1, 9) for a in (0, 90, 180, 270)] + [(2, p, 8, a, 0.01) for p in range(1, 9) for a in (0, 90)]
    got = {r.doc_id: r.angle for r in files.orientation(spark.createDataFrame(rows, "doc_id int, page int, pages int, angle int, readability double")).collect()}
    assert got == {1: 90, 2: 0}


def test_documents_without_damage(spark):
    v = spark.createDataFrame([], "doc_id int, nr int, klass string, status string, before string, ref string, other string, p double")
    assert E.damage_classes(v).count() == 0 and E.sensitivity(v).count() == 0


def test_first_object_with_and_without_inner_ones(spark, monkeypatch):
    """The match and the way by character give the same; the match does not need the latter."""
    import random

    r = random.Random(5)
    texts = ["".join(r.choices('{}"\\a\n[]', k=r.randint(0, 14))) for _ in range(600)] + ['{"a": "' + "x" * 3000 + '"} z', '{' + '"\\n",' * 900 + "}"]
    for opener in "{[":
        both = over(spark, texts, lambda c: R.first_object(c, opener))
        monkeypatch.setattr(R, "FLAT_CHARS", 0)
        assert over(spark, texts, lambda c: R.first_object(c, opener)) == both and sum(x is not None for x in both) > 20
        monkeypatch.undo()


def test_a_model_is_asked_once(spark):
    from auditlake.operators import provider as A

    p = spark.createDataFrame([(1, 1, 1, 7, "text")], "doc_id int, nr int, rank int, page int, text string")
    prompts = spark.createDataFrame([(1, 1, "x"), (1, 2, None)], "doc_id int, nr int, prompt string")
    got = A.verdicts(prompts, p, A.ByLength())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert {(r.nr, r.cause) for r in got.collect()} == {(1, ""), (2, "no candidate")}


def test_contents_gates(spark):
    """A title holds one of the words, a row the gap: texts without both are told apart by them alone, all others by the whole rule."""
    import itertools
    import re

    from auditlake import words as L

    for title in L.CONTENTS_TITLE.replace("s?", "").split("|") + ["inhaltsverzeichnis"]:
        assert re.fullmatch(L.CONTENTS_TITLE, title) and re.search(L.CONTENTS_WORDS, title)
    rows = [f"{a}1.2{b}Text{gap}{c}12 " for a, b, gap, c in itertools.product(["", " \t"], [" ", ". ", " "], ["...", "......", "   ", "\t", " .. ", " "], ["", " ", "\r"])]
    for row in rows:
        if re.search(L.CONTENTS_ROW, row, re.ASCII):
            assert re.search(L.CONTENTS_GAP, row, re.ASCII), row
    plain = [f"Satz {i} über die Form, {i} bar und 1.2343." for i in range(20)]
    titles = ["Inhalt", "INHALTSVERZEICHNIS", "im Inhaltsverzeichnis", "Table of Contents", "Revisionshistorie", "Abkürzungsverzeichnis", "inhaltlich", "der Inhalt"]
    assert over(spark, plain + titles + ["1 A ... 3", "1 A ... 3\nx", "1 A ... 3\nx\ny", None], R.is_contents) == [False] * 20 + [True, True, False, True, True, True, False, False, True, True, False, False]
