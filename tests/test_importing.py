"""Import of templates against a plain walk over the blocks, and from word-processor files."""

import random
import re
import zipfile
from collections import Counter

from auditlake.operators import importing as M
from auditlake.sources import files

SCHEMA = "doc_id string, i int, kind string, text string, cells array<string>"
LINES = [
    ("heading", "1 Werkzeug"), ("heading", "2  Form "), ("heading", "1.2 Toleranzen"), ("heading", "1.2.3 Kernzüge"), ("heading", "Zweck"), ("heading", None), ("heading", "3. Rest"),
    ("table", ["Pflicht", " belegt in 3 von 18", "A-1, B-13,3,C\nD"]), ("table", ["REGEL", None, "Belegt  in 2 von 9 Dokumenten", ""]), ("table", ["Art", "", "Art", "Guss"]), ("table", ["optional"]), ("table", ["Optional", "X", "Y, Z"]), ("table", None),
    ("line", "Standardanforderungen:"), ("line", "Der Lieferant liefert."), ("line", "AUSPRÄGUNGEN im Korpus"), ("line", "Projektspezifisch festzulegen::"), ("line", "[Maß in %] · [ Lage ], [ ]"), ("line", "Abgleichbegriffe: a · b;; c • "), ("line", " "), ("line", "Härte [x]"),
]


def walk(blocks):
    """Criteria, sizes of the corpus and metadata of one document, a block at a time."""
    out, sizes, meta, section, chapter, met, caption = [], Counter(), [], None, None, False, None
    for i, kind, text, cells in blocks:
        text, cells = (text or "").strip(), [c for c in ((c or "").strip() for c in cells or []) if c]
        if kind == "table":
            if not met:
                c = [x for k, x in enumerate(cells) if k == 0 or x != cells[k - 1]]
                meta += [(i, *c[:2])] if len(c) >= 2 else []
            if section is None:
                continue
            hits = [re.search(r"belegt\s+in\s+(\d+)\s+von\s+(\d+)", c.lower()) for c in cells]
            sizes.update(int(m[2]) for m in hits if m)
            if len(cells) >= 2 and cells[0].lower() in ("pflicht", "regel", "optional") and section["klass"] is None:
                first = next((m for m in hits if m), None)
                docs = [d.strip() for c, m in zip(cells[1:], hits[1:]) if not m for d in re.split(r",(?=\s|[A-Za-zÄÖÜ])|\n", c) if d.strip()]
                section.update(klass=cells[0].capitalize(), n_in=int(first[1]) if first else 0, docs=docs)
            continue
        if not text:
            continue
        if kind == "heading" and not re.match(r"\d+(\.\d+){2,}\.?\s+\S", text):
            m, caption = re.match(r"(\d+(?:\.\d+)?)\s+(\S.*)$", text), None
            section = None
            if m:
                met = True
                chapter = (m[1], m[2]) if "." not in m[1] else chapter
                section = {"pos": i, "nr": m[1], "title": m[2], "chapter": chapter or (m[1], m[2]), "klass": None, "required": [], "variants": [], "placeholders": [], "terms": []}
                out.append(section)
            continue
        if section is None:
            continue
        name = {"standardanforderungen": "required", "ausprägungen im korpus": "variants", "projektspezifisch festzulegen": "placeholders"}.get(text.rstrip(":").lower())
        if name:
            caption = name
        elif text.lower().startswith("abgleichbegriffe:"):
            section["terms"], caption = [t.strip() for t in re.split("[·•;]", text.split(":", 1)[1]) if t.strip()], None
        elif caption == "placeholders":
            section["placeholders"] += [x.strip() for x in re.findall(r"\[([^\]]+)\]", text) if x.strip()]
        elif caption:
            section[caption].append(text)
    best = max(sizes, key=lambda m: (sizes[m], -m)) if sizes else None
    return [s for s in out if s["klass"]], best, meta


def row(doc, i, x):
    kind, value = x
    return (doc, i, kind, None, value) if kind == "table" else (doc, i, kind, value, None)


def test_import_equals_walk(spark):
    rng = random.Random(3)
    docs = {f"d{k}": [row(f"d{k}", i, rng.choice(LINES)) for i in range(rng.choice([0, 1, 5, 40, 90]))] for k in range(160)}
    rows = [r for d in docs.values() for r in d]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    want = {d: walk([r[1:] for r in b]) for d, b in docs.items()}
    keep = ("pos", "nr", "title", "klass", "n_in", "docs", "required", "variants", "placeholders", "terms")
    got = sorted((r.doc_id, *(list(r[x]) if isinstance(r[x], list) else r[x] for x in keep), (r.chapter_nr, r.chapter)) for r in M.criteria(df).collect())
    assert got == sorted((d, *(s[x] for x in keep), s["chapter"]) for d, (found, _, _) in want.items() for s in found) and len(got) > 100
    assert {r.doc_id: r.corpus for r in M.corpus_sizes(df).collect()} == {d: m for d, (_, m, _) in want.items() if m}
    assert sorted(map(tuple, M.metadata(df).collect())) == sorted((d, *x) for d, (_, _, meta) in want.items() for x in meta)


def test_empty_and_without_headings(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [f(none).count() for f in (M.criteria, M.corpus_sizes, M.metadata)] == [0, 0, 0]
    loose = spark.createDataFrame([("a", 0, "line", "Standardanforderungen", None), ("a", 1, "table", None, ["Pflicht", "x"]), (None, 0, None, None, None)], SCHEMA)
    assert M.criteria(loose).count() == 0 and [tuple(r) for r in M.metadata(loose).collect()] == [("a", 1, "Pflicht", "x")]


def test_warnings(spark):
    rows = [("a", 0, "n", [], [], 0, []), ("a", 1, "m", ["r"], ["t"], 3, ["x"]), ("a", 2, "o", ["r"], ["t"], 0, ["x"]), ("a", 3, "p", ["r"], ["t"], 1, ["x"])]
    df = spark.createDataFrame(rows, "doc_id string, pos int, nr string, required array<string>, terms array<string>, n_in int, docs array<string>")
    assert sorted((r.pos, r.rule) for r in M.warnings(df).collect()) == [(0, "no requirements"), (0, "no terms"), (1, "number of documents")]


def test_word_processor_file(spark, tmp_path):
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>' if style else f"<w:p><w:r><w:t>{text[:3]}</w:t></w:r><w:r><w:t>{text[3:]}</w:t></w:r></w:p>"
    table = lambda *rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    body = table(("Werkzeugtyp", "Form")) + p("1 Werkzeug", "h1") + p("1.1 Toleranzen", "h1") + table(("Kopf", ""), ("Pflicht", "belegt in 2 von 4", "A, B")) + p("Standardanforderungen") + p("eins") + p("1.1.1 Tiefer", "h1") + p("Abgleichbegriffe: x; y")
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "T 1.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {ns}><w:style w:styleId="h1"><w:name w:val="Überschrift 1"/></w:style></w:styles>')
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "x.txt").write_text("1 Text")
    b = files.blocks(files.folder(spark, str(tmp_path))).cache()
    assert [(r.doc_id, r.error.split(":")[0]) for r in b.filter("error is not null").collect()] == [("broken", "BadZipFile")]
    (c,) = M.criteria(b).collect()
    assert (c.doc_id, c.nr, c.chapter, c.klass, c.n_in, list(c.docs), list(c.required), list(c.terms)) == ("T 1", "1.1", "Werkzeug", "Pflicht", 2, ["A", "B"], ["eins", "1.1.1 Tiefer"], ["x", "y"])
    assert [tuple(r)[2:] for r in M.metadata(b).collect()] == [("Werkzeugtyp", "Form")]
    assert [tuple(r) for r in M.corpus_sizes(b).collect()] == [("T 1", 4)]
