"""Prompts: rules by their switches, transfer, blocks."""

import pytest

from auditlake.operators import prompts as Q

PASSAGES = "doc_id long, nr int, rank int, page int, text string, score double"


def test_rules_by_switch():
    plain = Q.rules()
    assert "contradict the standard? Then A." in plain and "most frequent case" in plain and "casting die" in plain and "is E." in plain and "list of contents" not in plain
    assert "ask for more" in Q.rules(stricter=True) and "prescribed make is A" in Q.rules(make_deviates=True) and "list of contents" in Q.rules(lists=True)
    assert "prescribed make" not in Q.rules(narrow=True) and "prescribed make" not in Q.rules(beyond=True, stricter=True)
    assert '"<E, T, A or N>"' in Q.rules(neutral_example=True) and '"E"' not in Q.rules(neutral_example=True)
    with pytest.raises(ValueError, match="exclude one another"):
        Q.rules(beyond=True, narrow=True)


def test_transfer():
    other = Q.Subject("a switch cabinet", "switch cabinets", 7, False)
    text = Q.rules(other, stricter=True)
    assert "switch cabinet" in text and "casting" not in text and "7 documents" in text and "corpus" not in text
    assert Q.transferred("67 criteria on casting dies from 18 documents", other, 12) == "12 criteria on switch cabinets from 7 documents"
    assert Q.transferred("18 documents", Q.Subject(corpus=None)) == "several documents"
    assert Q.transferred("67 criteria, 18 documents, a casting die", Q.MEASURED) == "67 criteria, 18 documents, a casting die"


def test_shortened(spark):
    texts = ["", None, "  a\n b ", "eins zwei drei", "x" * 12, "(LHD-13,3) sagt lhd-7 ja", "eins zwei LHD-1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in df.select("i", Q.shortened(df.t, 9).alias("s")).orderBy("i").collect()]
    assert got == ["", "", "a b", "eins …", "x" * 9 + " …", "sagt ja", "eins zwei"]


def test_passage_blocks(spark):
    p = [(1, 1, 2, 4, "zwei", 0.456), (1, 1, 1, 3, "eins", 0.5), (1, 2, 1, None, None, 1.0), (1, 2, 1, None, None, 1.0), (1, 1, 99, 1, "weit", 0.3), (None, None, 1, 1, "ohne", 0.3)]
    got = {(r.doc_id, r.nr): r.block for r in Q.passage_blocks(spark.createDataFrame(p, PASSAGES)).collect()}
    one = "[page ?, relevance 100 %]\n"
    assert got == {(1, 1): "[page 3, relevance 50 %]\neins\n---\n[page 4, relevance 46 %]\nzwei", (1, 2): f"{one}\n---\n{one}", (None, None): "[page 1, relevance 30 %]\nohne"}
    assert Q.passage_blocks(spark.createDataFrame([], PASSAGES)).count() == 0


def test_prompts(spark):
    v = spark.createDataFrame([(1, 1), (1, 2), (2, 9), (None, 1)], "doc_id long, nr int")
    c = spark.createDataFrame([(1, "T", "Regel"), (2, None, None)], "nr int, title string, klass string")
    p = spark.createDataFrame([(1, 1, 1, 3, "eins", 0.5)], PASSAGES)
    e = spark.createDataFrame([(1, 2, "A", "LHD-1 y", "w"), (1, 1, "E", "x", None)], "nr int, place int, status string, text string, reason string")
    got = {(r.doc_id, r.nr): r.prompt for r in Q.prompts(v, c, p, e, "R", rules_first=True).collect()}
    shown = "Example 1, status E\nPassage: x\nWhy: \nExample 2, status A\nPassage: y\nWhy: w"
    assert got == {
        (1, 1): f"R\n\nCriterion 1 T [Regel]\n\n[page 3, relevance 50 %]\neins\n\n{shown}", (1, 2): "R\n\nCriterion 2  [-]\n\n(no passages)",
        (None, 1): f"R\n\nCriterion 1 T [Regel]\n\n(no passages)\n\n{shown}",
    }
    assert Q.prompts(v, c, p, e.limit(0), "R").filter("nr = 1 and doc_id = 1").first().prompt.startswith("Criterion 1 T [Regel]\n\nR\n\n[page")
    assert Q.prompts(v.limit(0), c, p, e, "R").count() == 0
