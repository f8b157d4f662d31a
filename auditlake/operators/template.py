"""Outlines of documents and the template built from them: headings, chapters, chapter-wise sections, imports, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import words as L
from . import rules as R
from . import text as T

# The line of a heading, how far its number may jump, levels it may have at the start.
HEADING = r"^\s*([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\.?\s+([A-Za-zÄÖÜäöü].*)$"
JUMP = 3
# The stricter line of a heading for templates, lines that are not, and limits of its title.
TEMPLATE_HEADING = r"^\s*([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\.?\s+([A-ZÄÖÜ].{2,80}?)\s*:?\s*$"
NO_HEADING = r"\.{4,}|…{2,}|\s[0-9]{1,3}\s*$|[|]"
DATE = "(januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember|january|february|march|may|june|july|october|december)[^a-z].*(19|20)[0-9][0-9]"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, page, line, text): lines of pages that are parted by form feeds; empty pages keep their number."""
    pages = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f")).alias("page", "t"))
    return pages.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode(F.split("t", "\n")).alias("line", "text"))


def plausible_title(title: Column) -> Column:
    """Whether the rest of a line looks like a title: a word of four letters, no page number or dots at its end, letters for the most part."""
    t = F.trim(title)
    letters = F.length(F.regexp_replace(t, "[^A-Za-zÄÖÜäöüß]", ""))
    return t.rlike("[A-Za-zÄÖÜäöüß]{4,}") & ~t.rlike(r"(\.{3,}|…|\s[0-9]{1,3})\s*$") & (letters >= 3) & (letters >= 0.6 * F.length(F.replace(t, F.lit(" "), F.lit(""))))


def follows(last: Column, new: Column) -> Column:
    """Whether a number may follow another: the first is flat and small; then a first child, or a step of up to ``JUMP`` at the same or a higher level; never back."""
    a, n = F.size(last), F.size(new)
    at = lambda x, i: F.element_at(x, i)
    first = (n <= 2) & at(new, F.lit(1)).between(1, JUMP) & ~F.exists(new, lambda x: x < 1)
    child = at(new, n).between(1, 2)
    step = (n <= a) & (F.slice(new, 1, n - 1) == F.slice(last, 1, n - 1)) & (at(new, n) > F.try_element_at(last, n)) & (at(new, n) <= F.try_element_at(last, n) + JUMP)
    return F.when(a == 0, first).when((n == a + 1) & (F.slice(new, 1, a) == last), child).otherwise(F.coalesce(step, F.lit(False)))


def headings(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line, number, title): headings whose numbers follow each other; pages of contents are passed over.

    Candidates of a document are gathered in order and folded within the row: lines that look like headings only.
    """
    full = F.filter(F.collect_list("text"), lambda x: F.trim(x) != "")
    numbered = F.size(F.filter(full, lambda x: x.rlike(r"(\.{3,}|…|\s)\s*[0-9]{1,3}\s*$")))
    contents = lines.groupBy("doc_id", "page").agg((numbered >= 5).alias("five"), (numbered >= 0.3 * F.size(full)).alias("share")).filter("five and share").select("doc_id", "page")
    c = lines.filter(F.col("text").rlike(HEADING)).withColumn("title", F.trim(F.regexp_extract("text", HEADING, 2))).filter(plausible_title(F.col("title")))
    c = c.join(contents, ["doc_id", "page"], "left_anti").withColumn("number", F.regexp_extract("text", HEADING, 1))
    one = F.struct("page", "line", "number", "title", F.transform(F.split("number", r"\."), lambda x: x.cast("int")).alias("n"))
    rows = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    kind = "array<struct<page:int,line:int,number:string,title:string,n:array<int>>>"
    state = F.struct(F.array().cast("array<int>").alias("last"), F.array().cast(kind).alias("done"))

    def step(a: Column, x: Column) -> Column:
        ok = follows(a["last"], x["n"])
        return F.struct(F.when(ok, x["n"]).otherwise(a["last"]).alias("last"), F.when(ok, F.array_append(a["done"], x)).otherwise(a["done"]).alias("done"))

    kept = rows.select("doc_id", F.explode(F.aggregate("c", state, step, lambda a: a["done"])).alias("h"))
    return kept.select("doc_id", "h.page", "h.line", "h.number", "h.title")


def chapter_sections(lines: DataFrame, with_title: bool = False) -> DataFrame:
    """(doc_id, section_idx, page, chapter, text): sections that never cross a heading or a page; short rests join within their chapter.

    ``with_title`` puts the chapter before a text that doesn't begin with it.
    """
    h = headings(lines).select("doc_id", "page", "line", F.concat_ws(" ", "number", "title").alias("head"))
    w = Window.partitionBy("doc_id").orderBy("page", "line")
    marked = lines.join(h, ["doc_id", "page", "line"], "left").withColumn("chapter", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit(""))).withColumn("island", F.sum(F.col("head").isNotNull().cast("int")).over(w))
    runs = marked.groupBy("doc_id", "page", "island", "chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("t"))
    parts = runs.select("doc_id", "page", "island", "chapter", F.posexplode(T._merged(T._cut(T._blocks(F.col("t"))))).alias("k", "text"))
    if with_title:
        own = (F.col("chapter") == "") | F.startswith("text", F.substring("chapter", 1, 20))
        parts = parts.withColumn("text", F.when(own, F.col("text")).otherwise(F.concat(F.lit("["), F.substring("chapter", 1, 80), F.lit("] "), F.col("text"))))
    order = Window.partitionBy("doc_id").orderBy("page", "island", "k")
    return parts.select("doc_id", (F.row_number().over(order) - 1).alias("section_idx"), "page", "chapter", "text")


def template_headings(lines: DataFrame) -> DataFrame:
    """(doc_id, number, title, page, own_chars, position, container, parent): numbered headings for a template, of equal ones the last.

    Lines of contents, tables and dates are no headings, nor are long, punctuated or numeric titles; all lines up to the next
    heading are its own text. A heading is a container if another number starts with its own; its parent is the title of the number above.
    """
    p = F.col("text")
    title = F.trim(F.regexp_replace(F.trim(F.regexp_extract("text", TEMPLATE_HEADING, 2)), ":+$", ""))
    solid, letters = F.length(F.regexp_replace(title, r"\s", "")), F.length(F.regexp_replace(title, "[^A-Za-zÄÖÜäöüß]", ""))
    noise = (
        (F.size(F.filter(F.split(title, r"\s+"), lambda x: x != "")) > 9) | title.rlike("[.,;]$") | title.rlike(r"[\[\]{}<>=]") | (letters < 0.7 * solid) | (F.length(F.regexp_replace(title, "[^0-9]", "")) > 4)
        | (F.substring_index(F.regexp_extract("text", TEMPLATE_HEADING, 1), ".", 1).try_cast("int") > 30) | (letters < 4)
    )
    is_ = p.rlike(TEMPLATE_HEADING) & ~p.rlike(NO_HEADING) & ~F.lower(p).rlike(DATE) & ~noise
    w = Window.partitionBy("doc_id").orderBy("page", "line")
    m = lines.withColumn("is", F.coalesce(is_, F.lit(False))).withColumn("island", F.sum(F.col("is").cast("int")).over(w)).filter("island > 0")
    h = m.groupBy("doc_id", "island").agg(F.min(F.when(F.col("is"), F.struct("page", "text"))).alias("h"), F.sum(F.when(~F.col("is"), F.length(F.trim("text"))).otherwise(0)).alias("own_chars"))
    h = h.select("doc_id", "island", "own_chars", F.col("h.page").alias("page"), F.regexp_extract("h.text", TEMPLATE_HEADING, 1).alias("number"), F.trim(F.regexp_replace(F.trim(F.regexp_extract("h.text", TEMPLATE_HEADING, 2)), ":+$", "")).alias("title"))
    last = Window.partitionBy("doc_id", "number", F.lower("title")).orderBy(F.desc("island"))
    h = h.withColumn("k", F.row_number().over(last)).filter("k = 1").drop("k")
    parts = F.transform(F.split("number", r"\."), lambda x: x.cast("int"))
    order = Window.partitionBy("doc_id").orderBy("page", parts, "title")
    h = h.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    above = h.groupBy("doc_id", F.col("number").alias("up")).agg(F.max_by("title", "i").alias("parent"))
    up = F.when(F.contains("number", F.lit(".")), F.regexp_replace("number", r"\.[0-9]+$", ""))
    children = h.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("number", r"\.")) - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split("number", r"\."), F.lit(1), k), "."))).alias("up"), "number").filter("up <> number").select("doc_id", "up").distinct().withColumn("container", F.lit(True))
    j = h.withColumn("up", up).join(above, ["doc_id", "up"], "left").drop("up").join(children.withColumnRenamed("up", "number"), ["doc_id", "number"], "left")
    return j.select("doc_id", "number", "title", "page", "own_chars", F.round(F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("position"), F.coalesce("container", F.lit(False)).alias("container"), F.coalesce("parent", F.lit("")).alias("parent"))


def topics(headings_: DataFrame, examples: int = 8) -> DataFrame:
    """(topic, docs, n, middle, examples): headings of one title over documents, generic ones left out: in how many documents, median position, first examples."""
    t = F.array_join(R.words_of(F.col("title")), " ")
    h = headings_.withColumn("topic", t).filter(~F.col("topic").isin(L.GENERIC_TITLES) & (F.col("topic") != ""))
    w = Window.partitionBy("topic").orderBy("doc_id", "number")
    few = h.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= examples).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(F.col("title"), F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")")).alias("e")))), lambda x: x["e"]), "; ").alias("examples"))
    return h.groupBy("topic").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("n"), F.round(F.percentile("position", 0.5), 6).alias("middle")).join(few, "topic")


def split_repeats(headings_: DataFrame) -> DataFrame:
    """(topic, part, docs): a document counts once for a topic; its k-th heading of the topic belongs to the k-th part."""
    t = F.array_join(R.words_of(F.col("title")), " ")
    w = Window.partitionBy("doc_id", "topic").orderBy("page", "number", "title")
    return headings_.withColumn("topic", t).withColumn("part", F.row_number().over(w)).groupBy("topic", "part").agg(F.count("*").alias("docs"))


# --------------------------------------------------------------------------- the template as tables


def outline(criteria: DataFrame) -> DataFrame:
    """(nr, chapter_no, line): the outline as text, chapters counted by their first criterion; the first line of a chapter has its name before it."""
    first = criteria.groupBy("chapter").agg(F.min("nr").alias("start"))  # chapters are few
    chapters = first.withColumn("chapter_no", F.row_number().over(Window.orderBy("start")))
    j = criteria.join(F.broadcast(chapters), "chapter")
    own = F.format_string("  %d  %s  [%s]", "nr", "title", "klass")
    return j.select("nr", "chapter_no", F.when(F.col("nr") == F.col("start"), F.concat(F.format_string("%d %s", "chapter_no", "chapter"), F.lit("\n"), own)).otherwise(own).alias("line"))


def with_dictionary(criteria: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(nr, title, terms): terms of criteria with those of the dictionary (nr, title, more) where number and title match."""
    j = criteria.join(F.broadcast(dictionary), ["nr", "title"], "left")
    return j.select("nr", "title", F.concat("terms", F.coalesce("more", F.array().cast("array<string>"))).alias("terms"))


def with_standard(criteria: DataFrame, requirements: DataFrame) -> DataFrame:
    """(nr, title, required, variants, query): criteria with their entry of the standard, if there is one; search text from title and first requirement."""
    s = requirements.groupBy("nr").agg(F.count_if(F.col("field") == "required").alias("required"), F.count_if(F.col("field") == "variant").alias("variants"), F.min_by("text", F.struct("field", "pos")).alias("text"))
    j = criteria.join(s, "nr", "left")
    return j.select("nr", "title", F.coalesce("required", F.lit(0)).alias("required"), F.coalesce("variants", F.lit(0)).alias("variants"), F.concat_ws(". ", "title", "text").alias("query"))


def import_warnings(criteria: DataFrame, requirements: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(nr, rule): what is wrong with a template: criteria without requirements, without placeholders, without any reference; critical if no number has one."""
    none = criteria.join(requirements.filter("field = 'required'").select("nr").distinct(), "nr", "left_anti").select("nr", F.lit("no requirements").alias("rule"))
    bare = criteria.filter(~F.exists("placeholders", lambda p: F.lower(p).rlike(L.PLACEHOLDER))).select("nr", F.lit("no placeholders").alias("rule"))
    known = verdicts.filter("ref is not null").select("nr").distinct()
    unknown = criteria.join(known, "nr", "left_anti").select("nr", F.lit("no reference").alias("rule"))
    critical = criteria.join(known, "nr", "left_semi").agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(None).cast("int").alias("nr"), F.lit("critical: no number matches").alias("rule"))
    return none.unionByName(bare).unionByName(unknown).unionByName(critical)


def template_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """(nr, change, fields): new against stored template by number, full outer, with the fields that differ."""
    fields = [c for c in new.columns if c != "nr"]
    a = new.select("nr", F.lit(True).alias("in_new"), *(F.col(c).alias(f"new_{c}") for c in fields))
    b = old.select("nr", F.lit(True).alias("in_old"), *(F.col(c).alias(f"old_{c}") for c in fields))
    differ = F.filter(F.array(*(F.when(~F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}")), F.lit(c)) for c in fields)), lambda x: x.isNotNull())
    change = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "gone").when(F.size(differ) > 0, "changed").otherwise("unchanged")
    return a.join(b, "nr", "full_outer").select("nr", change.alias("change"), F.when(change == "changed", F.array_join(differ, ", ")).alias("fields"))


def slug(name: Column) -> Column:
    """A key from a name: lower case, umlauts written out, all else as hyphens."""
    s = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "template").otherwise(s)


def document_id(path: Column) -> Column:
    """The id of a document from its path: the file name without suffix, commas before white space as underscores."""
    name = F.trim(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))
    return F.regexp_replace(F.regexp_replace(name, ",[ \t]", "_"), "\n", " ")


def subject(value: Column) -> Column:
    """The subject of a template: cut at the first bracket, comma, semicolon or colon, or at 'einschlie...' and 'inkl'."""
    s = F.trim(F.element_at(F.split(value, "[(,;:]| einschlie| inkl", 2), 1))
    return F.when(s != "", s)


def corpus_size(texts: DataFrame) -> DataFrame:
    """(corpus, n): the most frequent M of 'belegt in N von M', the smallest of equal ones."""
    m = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("belegt in ([0-9]+) von ([0-9]+)"), 2)).alias("m")).groupBy(F.col("m").cast("int").alias("corpus")).agg(F.count("*").alias("n"))
    return m.orderBy(F.desc("n"), "corpus").limit(1)
