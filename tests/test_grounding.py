"""Quotations, second looks, template content and distribution functions against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from auditlake.functions import statistics as ST
from auditlake.operators import evaluate as E
from auditlake.operators import grounding as G

R = random.Random(2)


def words(t):
    return re.findall(r"[0-9a-zäöüß]{3,}", re.sub(r"-\s*\n\s*", "", t or "").lower())


def test_quotations_equal_all_pairs(spark):
    vocabulary = [f"wort{i}" for i in range(25)] + ["und", "die", "mit"] * 6
    sections = [(d, i, " ".join(R.choices(vocabulary, k=R.randint(0, 40)))) for d in (1, 2, None) for i in range(30)] + [(1, 30, None), (1, 31, ""), (1, 32, "Wort1 wort2 wort3-\n  wort4 wort5 ende")]
    quotes = [(d, " ".join(R.sample(vocabulary, R.randint(3, 9)))) for d in (1, 2) for _ in range(60)]
    quotes += [(1, " ".join(R.choices(t.split(), k=6)) + " anders") for d, _, t in sections if d == 1 and t and len(t.split()) > 5]
    quotes += [quotes[0], (1, None), (1, ""), (1, "kurz"), (1, "Wort1 wort2 wort3wort4 wort5"), (1, "ab cd ef gh ij kl mn op qr st uv wx"), (1, "1 Wort1 wort2 wort3 wort5 wort6 ........ 3"), (3, "wort1 wort2 wort3 wort4 wort5"), (1, "wort1 " * 2000)]
    q = spark.createDataFrame(quotes, "d int, quote string")
    s = spark.createDataFrame(sections, "d int, i int, text string").repartition(3)
    got = {(r.d, r.quote): (r.share, r.i) for r in G.quoted(q, s, ["d"], ["i"]).collect()}
    want = {}
    for d, t in set(quotes):
        w = words(t)
        if len((t or "").strip()) < 25 or len(w) < 4 or "...." in t:
            continue
        shares = [(-sum(x in set(words(text)) for x in w) / len(w), i) for e, i, text in sections if e == d]
        if shares and -min(shares)[0] >= 0.8:
            want[d, t] = (-min(shares)[0], min(shares)[1])
    assert got == want and len(want) > 20
    assert G.quoted(q.limit(0), s, ["d"], ["i"]).collect() == [] == G.quoted(q, s.limit(0), ["d"], ["i"]).collect()


def test_second_look(spark):
    text = "Der Lieferant trägt die Kosten der Nacharbeit in voller Höhe. " + "wort " * 40
    s = spark.createDataFrame([(1, n, 1, 7, text) for n in range(8)] + [(1, n, 2, 9, text) for n in range(8)], "doc_id int, nr int, rank int, page int, text string")
    quote = "trägt die Kosten der  Nacharbeit in voller"
    a = [(1, 0, quote, "ja", ""), (1, 1, quote, "nein", "Kein Unterschied zu sehen"), (1, 2, quote, None, "Die Kosten sind anders verteilt."), (1, 3, quote, " True", "zu kurz"), (1, 4, "", "ja", "egal was hier steht"), (1, 5, None, None, None), (1, 6, "etwas das nirgends in den Stellen steht", "ja", "x"), (1, 7, text[:200], "ja", "- "), (2, 0, quote, "ja", "")]
    got = {(r.doc_id, r.nr): (r.status, r.reason, r.evidence) for r in G.rechecked(spark.createDataFrame(a, "doc_id int, nr int, zitat string, verbindlich string, abweichung string"), s).collect()}
    flat = "trägt die Kosten der Nacharbeit in voller"
    assert got[1, 0] == ("E", f"Geregelt: „{flat}“", "S7") and got[1, 1][0] == "T" and got[1, 3][0] == "E"
    assert got[1, 2] == ("A", f"Die Kosten sind anders verteilt. (Stelle: „{flat}“)", "S7")
    assert {got[1, 4], got[1, 5], got[1, 6], got[2, 0]} == {("N", "", "")}
    assert got[1, 7][1] == f"Geregelt: „{text[:157].rstrip()} …“"


def test_claims_stand_in_sources(spark):
    rows = [("150.000 Schuss", "mindestens 150,000 Schuss", True), ("150 Schuss", "150.000 Schuss", False), ("5 Teile werden geliefert", "Teile werden geprüft", True), ("Lieferung frei", "nichts davon", False), ("ab", "ab", False), ("12 und 34", "34 12", True), ("12 und 35", "34 12", False)]
    df = spark.createDataFrame(rows, "claim string, source string, want boolean")
    assert [r.ok for r in df.select(G.stands_in(F.col("claim"), F.col("source")).alias("ok")).collect()] == [r[2] for r in rows]


def test_content_of_a_row(spark):
    shown = spark.createDataFrame([("T1", "A", "Die Standzeit beträgt 150.000 Schuss nach DIN"), ("T1", "B", "Härte 45 HRC der Einsätze")], "row string, doc_id string, text string")
    kind = "row string, title string, requirements array<string>, variants array<string>, placeholders array<string>, terms array<string>"
    a = [
        ("T1", "Standzeit der Form", ["Die Standzeit ist  einzuhalten.", "kurz", "Laut dokument-a ist es so geregelt", None], ["150,000 Schuss (A).", "150.000 Schuss (B)", "45 HRC (B);", "ohne Kennung", "46 HRC (B)", "45 HRC (C)"], ["[Wert]", "eins zwei drei vier fünf sechs sieben", " "], ["Schuss", "schuss", "fremd", "form"]),
        ("T2", "Kosten", None, None, None, None),
    ]
    got = {r.row: r for r in G.checked_content(spark.createDataFrame(a, kind), shown, ["Dokument-A"]).collect()}
    assert got["T1"].requirements == ["Die Standzeit ist einzuhalten."] and got["T1"].variants == ["150,000 Schuss (A).", "45 HRC (B);"]
    assert got["T1"].placeholders == ["Wert"] and got["T1"].terms == ["Schuss", "form", "Standzeit"]
    assert (got["T2"].requirements, got["T2"].variants, got["T2"].placeholders, got["T2"].terms) == ([], [], [], ["Kosten"])


def test_chi_square_and_erfc(spark):
    z = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.9, 2.5, 2.9999, 3.0, 4.0, 6.0, 20.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(ST.erfc(F.col("z")).alias("e"), ST.chi_square_p(2 * F.col("z") * F.col("z")).alias("p")).collect()
    for x, r in zip(z, got):
        assert abs(r.e - math.erfc(x)) < 1e-12 and abs(r.p - math.erfc(x)) < 1e-12
        if 3 <= x < 20:
            assert abs(r.e / math.erfc(x) - 1) < 1e-9


@pytest.mark.parametrize("n,k", [(1, 0), (10, 3), (24, 12), (1000, 470), (1_000_000, 499_000), (1_000_000, 500_000), (7, 7)])
def test_binomial_tail(spark, n, k):
    got = spark.createDataFrame([(n, k)], "n long, k long").select(ST.binomial_tail(F.col("n"), F.col("k")).alias("p")).first().p
    if n <= 1000:
        want = sum(math.comb(n, i) for i in range(k + 1)) / 2**n
    else:
        at = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
        want = math.fsum(math.exp(at(i)) for i in range(max(0, k - 20_000), k + 1))
    assert abs(got - want) < 5e-7


def test_mcnemar(spark):
    one = lambda a, b, n: [("E", "E" if a else "T", "E" if b else "T")] * n
    for only_a, only_b, p, exact, significant in ((0, 0, 1.0, 1.0, False), (5, 5, 1.0, 1.0, False), (1, 9, 0.026857, 0.021484, True), (40, 20, 0.014171, 0.013489, True)):
        v = spark.createDataFrame(one(1, 0, only_a) + one(0, 1, only_b) + one(1, 1, 3) + [(None, "E", "E")], "ref string, status string, other string")
        r = E.mcnemar(v).first()
        assert (r.p, r.p_exact, r.significant, r.both) == (p, exact, significant, 3)


def test_what_grows_is_not_broadcast(spark):
    """Small tables are, unless the plan says otherwise: on a small driver a few hundred thousand passages were too many."""
    s = spark.createDataFrame([(1, n, 1, 7, f"Der Lieferant trägt die Kosten der Nacharbeit {n}00") for n in range(8)], "doc_id int, nr int, rank int, page int, text string")
    a = s.selectExpr("doc_id", "nr", "text AS zitat", "'ja' AS verbindlich", "'' AS abweichung")
    got = G.rechecked(a, s)
    assert {r.status for r in got.collect()} == {"E"}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_quotations_move_no_words(spark):
    """Sections that are dealt by document stay there: no text, no word and no pair is shuffled but the quotations with theirs."""
    s = spark.range(4000).select((F.col("id") % 7).alias("d"), F.col("id").alias("i"), F.concat(F.lit("Der Lieferant liefert Ersatzteile Nummer "), F.col("id").cast("string")).alias("text")).repartition("d")
    q = s.filter("i < 700").select("d", F.col("text").alias("quote"))
    found = G.quoted(q, s, ["d"], ["i"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    before = s._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert plan.count("Exchange hashpartitioning") == 2 * before, plan
    assert found.count() == 700 and found.filter("share = 1").count() == 700
