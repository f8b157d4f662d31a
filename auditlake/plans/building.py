"""Queries on building a template: topics by likeness, their chapters and passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import template as M
from ..operators import text as T
from ..operators import topics as P
from ..sources import package, store
from ..sources import standins as I
from ..sources.standins import table
from .rules_sql import is_contents, q

#: Rows of a template: the titles of the catalogue, which headings begin with.
ROWS = [(f"T{i:03d}", t) for i, t in enumerate(I.TITLES, start=1)]


def saving(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a table to the shared folder and reads it back; shuffle files go when it is written."""
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def saved(df: DataFrame) -> DataFrame:
        path, before = store.scratch(spark), spark.conf.get(clean, "false")
        spark.conf.set(clean, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(clean, before)
        return spark.read.schema(df.schema).parquet(path)

    return saved


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic): the first 80 characters of the first line of each document, in lower case: stand-ins for titles, each once."""
    return table(spark, sf_dir, "documents").filter("text is not null").select(F.lower(F.substring(F.substring_index("text", "\n", 1), 1, 80)).alias("topic")).filter("topic <> ''").distinct()


def topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    package.send(spark)
    return P.topic_groups(first_lines(spark, sf_dir).withColumn("v", S.embedded("topic")), saving(spark))


def grouped_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of outlines, grouped by likeness, a document's repeats in parts of their own."""
    package.send(spark)
    saved = saving(spark)
    h = saved(M.template_headings(M.lines_of(I.outlines(spark, sf_dir))).withColumn("topic", F.lower("title")))
    groups = P.topic_groups(h.select("topic").distinct().withColumn("v", S.embedded("topic")), saved)
    return P.grouped_topics(h, groups)


def _half_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines with a chapter by their first letter, but where the second one has code 3 modulo 7."""
    code = lambda i: F.ascii(F.substring("topic", i, 1))
    chapter = F.when(code(2) % 7 != 3, F.format_string("Kapitel %d", code(1) % 6 + 1))
    return first_lines(spark, sf_dir).withColumns({"v": S.embedded("topic"), "chapter": chapter})


def nearest_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    package.send(spark)
    return P.nearest_chapters(_half_assigned(spark, sf_dir))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of the outlines' topics without any answer of a model: by k-means."""
    package.send(spark)
    t = M.template_headings(M.lines_of(I.outlines(spark, sf_dir))).select(F.lower("title").alias("topic")).distinct()
    return P.chapters(saving(spark)(t.withColumn("v", S.embedded("topic")).withColumn("chapter", F.lit(None).cast("string"))))


def template_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    package.send(spark)
    docs = I.outlines(spark, sf_dir)
    rows = F.filter(F.array(*(F.struct(F.lit(r).alias("row"), F.lit(t.lower()).alias("t")) for r, t in ROWS)), lambda x: F.startswith(F.lower("title"), x["t"]))
    h = M.template_headings(M.lines_of(docs)).select("doc_id", "title", F.explode(rows).alias("x")).select("x.row", "doc_id", "title")
    return P.passages(ROWS, h, T.sections(docs)).select("row", "doc_id", F.round("weight", 4).alias("weight"), "shown", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "a21_topic_groups": topic_groups,
    "a22_grouped_topics": grouped_topics,
    "a23_chapters": chapters,
    "a23_nearest_chapters": nearest_chapters,
    "x10_template_passages": template_passages,
}


def oracles(sections: str, headings: str) -> dict[str, str]:
    """SQL of the queries that it can express; the others are held against plain Python. Parts: SQL of the outlines' sections and headings."""
    pairs = lambda key, text, rows: f"SELECT {key}, k, count(*)::DOUBLE AS n FROM (SELECT {key}, (unicode(substr({text}, i, 1)) * 31 + unicode(substr({text}, i + 1, 1))) % 64 AS k FROM (SELECT *, unnest(range(1, length({text}))) AS i FROM {rows})) GROUP BY ALL"
    nearest = f"""WITH t AS (SELECT DISTINCT lower(left(split_part(text, chr(10), 1), 80)) AS topic FROM documents WHERE text IS NOT NULL), u AS (SELECT topic, CASE WHEN unicode(substr(topic, 2, 1)) % 7 <> 3 THEN 'Kapitel ' || (unicode(topic) % 6 + 1) END AS chapter FROM t WHERE topic <> ''),
p AS ({pairs('topic', 'topic', 'u')}), l AS (SELECT topic, sqrt(sum(n * n)) + 1e-10 AS l FROM p GROUP BY topic), v AS (SELECT topic, k, n / l AS x FROM p JOIN l USING (topic)),
o AS (SELECT * FROM u WHERE chapter IS NULL), c AS (SELECT * FROM u WHERE chapter IS NOT NULL),
d AS (SELECT o.topic, v2.topic AS near, round(sum(v1.x * v2.x), 9) AS dot FROM o JOIN v v1 ON v1.topic = o.topic JOIN v v2 ON v2.k = v1.k JOIN c ON c.topic = v2.topic GROUP BY ALL),
z AS (SELECT o.topic, coalesce(d.near, (SELECT min(topic) FROM c)) AS near FROM o LEFT JOIN d ON o.topic = d.topic QUALIFY row_number() OVER (PARTITION BY o.topic ORDER BY dot DESC NULLS LAST, d.near) = 1)
SELECT topic, chapter FROM c UNION ALL SELECT z.topic, c.chapter FROM z JOIN c ON c.topic = z.near"""
    norm = lambda t: f"array_to_string(regexp_extract_all(regexp_replace(lower(coalesce({t}, '')), '([a-zäöüß])-\\s*\\n\\s*([a-zäöüß])', '\\1\\2', 'g'), '[a-z0-9_äöüß]+'), ' ')"
    values = ", ".join(f"({q(r)}, {q(t)})" for r, t in ROWS)
    passages = f"""WITH s0 AS ({sections}), hd AS ({headings}), cat AS (SELECT * FROM (VALUES {values}) AS t(row, query)),
s AS (SELECT *, concat_ws(' ', text, lead(text, 1) OVER w) AS two, concat_ws(' ', text, lead(text, 1) OVER w, lead(text, 2) OVER w) AS three, {is_contents('text')} AS contents FROM s0 WINDOW w AS (PARTITION BY doc_id ORDER BY section_idx)),
sp AS ({pairs('doc_id, section_idx', 'text', 's')}), sl AS (SELECT doc_id, section_idx, sqrt(sum(n * n)) + 1e-10 AS l FROM sp GROUP BY ALL),
cp AS ({pairs('row', 'query', 'cat')}), cl AS (SELECT row, sqrt(sum(n * n)) + 1e-10 AS l FROM cp GROUP BY ALL),
dots AS (SELECT doc_id, section_idx, row, sum(sp.n * cp.n) AS d FROM sp JOIN cp USING (k) GROUP BY ALL),
e AS (SELECT s.doc_id, s.section_idx, cat.row, s.contents, s.two, CASE WHEN s.contents THEN 0.0 ELSE round(coalesce(d, 0) / sl.l / cl.l, 6) END AS cos FROM s CROSS JOIN cat JOIN sl USING (doc_id, section_idx) JOIN cl ON cl.row = cat.row LEFT JOIN dots ON dots.doc_id = s.doc_id AND dots.section_idx = s.section_idx AND dots.row = cat.row),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY row, doc_id ORDER BY cos DESC, section_idx) = 1),
own AS (SELECT DISTINCT row, doc_id, {norm('title')} AS title FROM hd JOIN cat ON starts_with(lower(title), lower(query))),
f AS (SELECT own.row, own.doc_id, arg_min(three, section_idx) AS head FROM own JOIN s USING (doc_id) WHERE own.title <> '' AND NOT contents AND contains({norm('s.text')}, own.title) GROUP BY ALL),
j AS (SELECT b.row, b.doc_id, h.row IS NOT NULL AS has, CASE WHEN h.row IS NOT NULL THEN 2.0 ELSE cos END AS weight, left(trim(regexp_replace(coalesce(head, CASE WHEN cos >= {P.PASSAGE_LIKENESS} AND NOT contents THEN two END), '\\s+', ' ', 'g'), ' '), {P.PASSAGE_CHARS}) AS text
  FROM b LEFT JOIN (SELECT DISTINCT row, doc_id FROM own) h ON h.row = b.row AND h.doc_id = b.doc_id LEFT JOIN f ON f.row = b.row AND f.doc_id = b.doc_id)
SELECT row, doc_id, round(weight, 4) AS weight, text IS NOT NULL AS shown, coalesce(text, '') AS text FROM j WHERE text IS NOT NULL OR has QUALIFY text IS NULL OR row_number() OVER (PARTITION BY row ORDER BY (text IS NULL), weight DESC, doc_id) <= {P.PASSAGES}"""
    return {"a23_nearest_chapters": nearest, "x10_template_passages": passages}
