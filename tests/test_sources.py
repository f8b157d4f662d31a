"""The library of templates, data sources and table functions."""


import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from auditlake.functions import tables
from auditlake.operators import template as M
from auditlake.sources import datasource, files, library
from auditlake.sources import standins as I

SF = "/root/testdata/sf0.001"


def _snapshot(folder, key):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in folder.rglob("*") if f"template_key={key}" in str(p)}


def test_library(spark, tmp_path):
    lib = library.Library(spark, str(tmp_path))
    criteria = lambda n, t: spark.createDataFrame([(i, f"{t} {i}") for i in range(n)], "nr int, title string")
    assert lib.entries().collect() == [] and lib.active() is None
    a = lib.deposit("Druckgießwerkzeuge", "Werkzeuge", criteria(3, "a"), criteria(2, "s"))
    assert a == "druckgiesswerkzeuge" and lib.active() == a and lib.work("criteria").count() == 3  # the first one is active
    b = lib.deposit("  Schaltschränke / Prüfstände ", "Schränke", criteria(5, "b"), criteria(1, "s"))
    assert lib.active() == a and [(r.template_key, r.name, r.criteria, r.active) for r in lib.entries().collect()] == [(a, "Druckgießwerkzeuge", 3, True), (b, "Schaltschränke / Prüfstände", 5, False)]
    lib.save_work("archive", criteria(4, "practice"))
    assert lib.table("archive", a) is None and lib.work("archive").count() == 4 and lib.work("criteria").count() == 3
    before = _snapshot(tmp_path, b)
    lib.activate(b)  # saves the archive back to a, leaves b as it is
    assert lib.active() == b and lib.table("archive", a).count() == 4 and lib.work("archive") is None and lib.work("criteria").count() == 5
    assert _snapshot(tmp_path, b) == before
    others = _snapshot(tmp_path, b)
    assert lib.deposit("Druckgießwerkzeuge", "neu", criteria(7, "a2"), criteria(2, "s")) == a
    assert lib.active() == b and lib.table("criteria", a).count() == 7 and lib.table("archive", a).count() == 4 and _snapshot(tmp_path, b) == others
    lib.deposit("Schaltschränke / Prüfstände", "", criteria(6, "b2"), criteria(1, "s"))  # a new version of the active one
    assert lib.work("criteria").count() == 6
    with pytest.raises(ValueError):
        lib.remove(b)
    with pytest.raises(KeyError):
        lib.activate("none")
    (tmp_path / "work" / "99").mkdir()  # a switch that was killed before its pointer
    assert lib.active() == b and lib.work("criteria").count() == 6
    lib.remove(a)
    assert [r.template_key for r in lib.entries().collect()] == [b] and lib.table("criteria", a) is None
    lib.save_work("standard", criteria(0, "none"))
    lib.back_save()
    assert lib.table("standard", b) is None  # what is gone from the working copy goes from the entry


def test_template_files(spark, tmp_path):
    c = spark.createDataFrame([(1, "1.2", "Zweites", "K", "Regel", ["a"]), (0, "1.1", "Erstes", "K", "Pflicht", [])], "ord int, nr string, titel string, kapitel string, einstufung string, abgleichbegriffe array<string>")
    s = spark.createDataFrame([("1.1", ["muss"])], "abschnitt_nr string, standardanforderungen array<string>")
    for _ in range(2):
        library.write_template(c, s, str(tmp_path))
    got = files.read_criteria(spark, str(tmp_path / "structure")).orderBy("ord").collect()
    assert [(r.nr, r.title, list(r.terms)) for r in got] == [("1.1", "Erstes", []), ("1.2", "Zweites", ["a"])]
    assert [r.text for r in files.statements(files.read_standard(spark, str(tmp_path / "standard"))).collect()] == ["muss"]


def test_folder_of_files(spark, tmp_path):
    datasource.register(spark)
    for i in range(5):
        (tmp_path / f"d{i}.txt").write_text(f"eins {i}\fzwei")
    (tmp_path / "A, B.TXT").write_text("ä")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "y.docx").write_bytes(b"no zip")
    (tmp_path / "z.csv").write_text("left out")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text("left out")
    df = spark.read.format("requirement_files").option("group_bytes", "14").load(str(tmp_path))
    got = {(r.doc_id, r.page, r.text, (r.error or "").split(":")[0]) for r in df.collect()}
    assert got == {("A_B", 1, "ä", ""), ("x", None, None, "ValueError"), ("y", None, None, "BadZipFile"), *((f"d{i}", p, t, "") for i in range(5) for p, t in ((1, f"eins {i}"), (2, "zwei")))}
    assert df.rdd.getNumPartitions() >= 5
    same = files.pages(files.folder(spark, str(tmp_path))).filter("error is null").select("doc_id", "page", "text")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, df.filter("error is null").select("doc_id", "page", "text").collect()))
    (tmp_path / "none").mkdir()
    assert spark.read.format("requirement_files").load(str(tmp_path / "none")).collect() == []


def _sheets(path):
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{ns['m']}}}sheet")]
        return {n: [["".join(c.itertext()) for c in r.findall("m:c", ns)] for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i + 1}.xml")).iter(f"{{{ns['m']}}}row")] for i, n in enumerate(names)}


def test_workbooks(spark, tmp_path):
    datasource.register(spark)
    rows = [(1, "=SUM(A1)", 1.5, True), (2, "a\x00b\x0b<&>", None, False), (None, "ä" * 40_000, 2.0, None)]
    df = spark.createDataFrame(rows, "nr int, text string, x double, b boolean").coalesce(1)
    for _ in range(2):
        df.write.format("workbook").option("sheet", "Deviations").mode("overwrite").save(str(tmp_path / "r"))
    books = list((tmp_path / "r").iterdir())
    assert [p.suffix for p in books] == [".xlsx"]
    assert _sheets(books[0]) == {"Deviations": [["nr", "text", "x", "b"], ["1", "=SUM(A1)", "1.5", "1"], ["2", "ab<&>", "", "0"], ["", "ä" * 32_767, "2.0", ""]]}
    spark.range(100).repartition(4).write.format("workbook").mode("append").save(str(tmp_path / "r"))
    assert len(list((tmp_path / "r").iterdir())) == 5
    spark.range(0).write.format("workbook").mode("append").save(str(tmp_path / "e"))
    assert [_sheets(p) for p in (tmp_path / "e").iterdir()] == [{"Sheet": [["id"]]}]
    fails = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 70, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        fails.write.format("workbook").mode("append").save(str(tmp_path / "f"))
    assert not (tmp_path / "f").exists() or [p for p in (tmp_path / "f").iterdir() if p.suffix == ".xlsx"] == []


def test_full_sheets_go_on(tmp_path):
    with open(tmp_path / "b.xlsx", "wb") as f:
        assert datasource.write_workbook(f, ["n"], iter([(i,) for i in range(7)]), "S", most=4) == 7
    assert _sheets(tmp_path / "b.xlsx") == {"S": [["n"], ["0"], ["1"], ["2"]], "S 2": [["n"], ["3"], ["4"], ["5"]], "S 3": [["n"], ["6"]]}


def test_chapter_chunks_equal_the_plan(spark):
    odd = ["1 Alpha\n" + "Text der Zeile " * 90 + "\n\nkurz\n1.1 Beta eins\n" + "Wort " * 30 + "\f2 Gamma\n" + "\n".join(f"{i}.1 Titel ....... {i}" for i in range(1, 8)) + "\f 3 Delta Teil\nkurz", "", None, "\f\f", "kein Kapitel " * 300, "0 Null\n1 Eins\n4 Vier\n9 Neun\n5. Fünf und mehr\n5.3 Drei zu weit\n5.1. Eins dabei\n4 Vier zurück " + "x" * 2000]
    docs = spark.createDataFrame(list(enumerate(odd, start=10**9)), "doc_id long, text string").unionByName(I.outlines(spark, SF))
    lines = M.lines_of(docs).repartition(5)
    plan, made = M.chapter_sections(lines, with_title=True), tables.chapter_chunks(lines)
    want = sorted(map(tuple, plan.select("doc_id", "section_idx", "page", "chapter", "text").collect()))
    assert sorted(map(tuple, made.collect())) == want and len(want) > 100
    assert tables.chapter_chunks(lines.limit(0)).collect() == []
