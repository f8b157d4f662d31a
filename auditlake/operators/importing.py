"""Import of templates: blocks of word-processor documents become criteria, by gaps and islands.

blocks(doc_id, i, kind, text, cells): the body of a document in order, one row a
paragraph ('heading' or 'line', with text) or a table's row ('table', with cells).
One window by document carries the section, the chapter and the block that a row
belongs to, and one aggregate makes the criteria: two shuffles, the second one of
rows that are in a section.

Defined cases: null and blank texts are no rows, null cells are blank ones; rows of
one place are ordered by kind and text; documents without a numbered heading give
nothing; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import words as L


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{L.BLANK}+|{L.BLANK}+$", "")


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), _stripped), lambda x: x != "")


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks with number, title (of numbered headings), start (place of the section's heading, -1 outside), chapter (number, title) and block (what the lines after a caption are)."""
    b = blocks.select("doc_id", "i", "kind", _stripped(F.col("text")).alias("text"), F.filter(F.transform(F.coalesce("cells", F.array().cast("array<string>")), _stripped), lambda c: c != "").alias("cells")).filter("kind = 'table' or text <> ''")
    heading = F.col("kind") == "heading"
    numbered = heading & F.col("text").rlike(L.NUMBERED)
    ends = heading & ~F.col("text").rlike(L.DEEPER)
    b = b.withColumns({"number": F.when(numbered, F.regexp_extract("text", L.NUMBERED, 1)), "title": F.when(numbered, F.regexp_extract("text", L.NUMBERED, 2))})
    caption = F.lower(F.regexp_replace("text", ":+$", ""))
    block = F.when(ends, "").when(F.col("kind") == "table", F.lit(None))
    for name, words in L.CAPTIONS.items():
        block = block.when(caption == words, name)
    b = b.withColumn("caption", block.when(F.startswith(F.lower("text"), F.lit(L.TERMS_PREFIX)), "terms"))
    w = Window.partitionBy("doc_id").orderBy("i", "kind", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    chapter = F.when(F.col("number").isNotNull() & ~F.contains("number", F.lit(".")), F.struct("number", "title"))
    return b.withColumns({"start": F.coalesce(last(F.when(F.col("number").isNotNull(), F.col("i")).when(ends, -1)), F.lit(-1)), "chapter": last(chapter), "block": last(F.col("caption"))})


def criteria(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, nr, title, chapter_nr, chapter, klass, n_in, docs, required, variants, placeholders, terms): sections with a head table.

    A heading of one or two numbers starts a section; deeper ones stay inside as lines, others end it. The head is the first row of a
    table whose first cell is a class: how many documents have the point, and which ones. Lines belong to the caption before them;
    of placeholders only what is in brackets counts, of several lists of terms the last one does. ``pos`` orders the criteria of a document.
    """
    cells = F.col("cells")
    klass = F.get(F.filter(F.array(*(F.lit(k) for k in L.CLASSES)), lambda k: F.lower(k) == F.lower(F.get(cells, F.lit(0)))), F.lit(0))
    counts = F.filter(cells, lambda c: F.lower(c).rlike(L.FOUND_IN))
    docs = F.flatten(F.transform(F.filter(F.slice(cells, 2, 1_000_000), lambda c: ~F.lower(c).rlike(L.FOUND_IN)), lambda c: _parts(c, L.DOCUMENT_LIST)))
    n_in = F.coalesce(F.regexp_extract(F.lower(F.get(counts, F.lit(0))), L.FOUND_IN, 1).try_cast("int"), F.lit(0))
    head = F.when((F.col("kind") == "table") & (F.size(cells) >= 2) & klass.isNotNull(), F.struct("i", klass.alias("klass"), n_in.alias("n_in"), docs.alias("docs")))
    line = F.col("number").isNull() & (F.col("kind") != "table") & F.col("caption").isNull()
    of = lambda name: F.transform(F.array_sort(F.collect_list(F.when(line & (F.col("block") == name), F.struct("i", "text")))), lambda x: x["text"])
    g = _placed(blocks).filter("start >= 0").withColumn("head", head).groupBy("doc_id", F.col("start").alias("pos")).agg(
        F.max(F.when(F.col("number").isNotNull(), F.struct("number", "title", "chapter"))).alias("h"), F.min("head").alias("head"), of("required").alias("required"), of("variants").alias("variants"), of("placeholders").alias("open"),
        F.max(F.when(F.col("caption") == "terms", F.struct("i", "text"))).alias("t"),
    )
    bracketed = F.filter(F.flatten(F.transform("open", lambda t: F.regexp_extract_all(t, F.lit(L.BRACKETED), 1))), lambda x: _stripped(x) != "")
    terms = F.coalesce(_parts(F.regexp_replace("t.text", "^[^:]*:", ""), L.TERM_LIST), F.array().cast("array<string>"))
    return g.filter("head is not null").select(
        "doc_id", "pos", F.col("h.number").alias("nr"), "h.title", F.coalesce("h.chapter.number", "h.number").alias("chapter_nr"), F.coalesce("h.chapter.title", "h.title").alias("chapter"),
        "head.klass", "head.n_in", "head.docs", "required", "variants", F.transform(bracketed, _stripped).alias("placeholders"), terms.alias("terms"),
    )


def warnings(imported: DataFrame) -> DataFrame:
    """(doc_id, pos, nr, rule): criteria without requirements, without terms, or whose head names another number of documents than it lists."""
    rules = {"no requirements": F.size("required") == 0, "no terms": F.size("terms") == 0, "number of documents": (F.size("docs") > 0) & (F.col("n_in") > 0) & (F.size("docs") != F.col("n_in"))}
    hit = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
    return imported.select("doc_id", "pos", "nr", F.explode(hit).alias("rule"))


def corpus_sizes(blocks: DataFrame) -> DataFrame:
    """(doc_id, corpus): the most frequent M of 'found in N of M' in the tables of a document's sections, the smallest of equal ones."""
    m = _placed(blocks).filter("start >= 0 and kind = 'table'").select("doc_id", F.explode(F.transform(F.filter("cells", lambda c: F.lower(c).rlike(L.FOUND_IN)), lambda c: F.regexp_extract(F.lower(c), L.FOUND_IN, 2).try_cast("int"))).alias("corpus"))
    n = m.groupBy("doc_id", "corpus").agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.max_by("corpus", F.struct("n", (-F.col("corpus")).alias("least"))).alias("corpus"))


def metadata(blocks: DataFrame) -> DataFrame:
    """(doc_id, i, key, value): the first two different cells in a row of each table's row before the first numbered heading."""
    before = _placed(blocks).withColumn("first", F.min(F.when(F.col("number").isNotNull(), F.col("i"))).over(Window.partitionBy("doc_id")))
    c = F.col("cells")
    kept = F.filter(c, lambda x, k: (k == 0) | (x != F.get(c, k - 1)))
    return before.filter("kind = 'table' and (first is null or i < first)").select("doc_id", "i", kept.alias("c")).filter(F.size("c") >= 2).select("doc_id", "i", F.get("c", F.lit(0)).alias("key"), F.get("c", F.lit(1)).alias("value"))
