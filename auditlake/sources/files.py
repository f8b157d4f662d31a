"""Files as tables: folders of documents, word-processor files, catalogues in JSON, caches by content, exports.

Bytes are read by Spark's ``binaryFile`` source and parsed where they are; nothing passes the driver.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.template import document_id

SUFFIXES = ("pdf", "docx", "txt")
CRITERIA_SCHEMA = "version string, anzahl int, hinweis string, kriterien array<struct<nr:string,titel:string,kapitel:string,einstufung:string,abgleichbegriffe:array<string>>>"
STANDARD_SCHEMA = "chunk_id string, kapitel_nr string, kapitel_titel string, abschnitt_nr string, abschnitt_titel string, einstufung string, geregelt_in_dokumenten array<string>, belegt_laut_haeufigkeitsmatrix array<string>, standardanforderungen array<string>, auspraegungen_im_korpus array<string>, platzhalter array<string>, abgleichbegriffe array<string>, embedding_text string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, suffix, sha1, content): the files of a folder with a suffix that can be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(suffix.isin(*SUFFIXES)).select(document_id(F.col("path")).alias("doc_id"), "path", suffix.alias("suffix"), F.sha1("content").alias("sha1"), "content")


def docx_pages(content: bytes) -> list[str]:
    """Pages of a word-processor file: paragraphs and tables in order, a table's row as its cells that aren't empty; explicit page breaks part pages."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    pages: list[list[str]] = [[]]

    def text_of(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t"))

    for child in body if body is not None else ():
        if child.tag == f"{_W}tbl":
            for row in child.iter(f"{_W}tr"):
                cells = [c for c in (text_of(c).strip() for c in row.iter(f"{_W}tc")) if c]
                if cells:
                    pages[-1].append(" | ".join(cells))
        elif child.tag == f"{_W}p":
            line = ""
            for node in child.iter():
                if node.tag == f"{_W}t":
                    line += node.text or ""
                elif node.tag == f"{_W}br" and node.get(f"{_W}type") == "page":
                    pages[-1].append(line)
                    pages.append([])
                    line = ""
            pages[-1].append(line)
    return ["\n".join(p) for p in pages]


def docx_blocks(content: bytes) -> list[tuple[str, str | None, list[str] | None]]:
    """(kind, text, cells) of the body of a word-processor file in order: paragraphs by their style's name, tables by row; a merged cell counts once."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else ()
    names = {s.get(f"{_W}styleId"): s.find(f"{_W}name").get(f"{_W}val") for s in styles if s.tag == f"{_W}style" and s.find(f"{_W}name") is not None}
    out: list[tuple[str, str | None, list[str] | None]] = []
    text_of = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    for child in body if body is not None else ():
        if child.tag == f"{_W}tbl":
            out += [("table", None, ["\n".join(text_of(p) for p in c.iter(f"{_W}p")) for c in row.findall(f"{_W}tc")]) for row in child.findall(f"{_W}tr")]
        elif child.tag == f"{_W}p":
            style = child.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else ""
            out.append(("heading" if names.get(key, key).lower().startswith(("heading", "überschrift")) else "line", text_of(child), None))
    return out


def blocks(files: DataFrame) -> DataFrame:
    """(doc_id, i, kind, text, cells, error) of the word-processor files of folder(): one row a paragraph or a table's row. A file that can't be read is one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, content in zip(b.doc_id, b.content):
                try:
                    rows += [(doc, i, *x, None) for i, x in enumerate(docx_blocks(bytes(content)))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((doc, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "i", "kind", "text", "cells", "error"]).astype({"i": "Int64"})

    return files.filter("suffix = 'docx'").select("doc_id", "content").mapInPandas(run, "doc_id string, i int, kind string, text string, cells array<string>, error string")


def pages(files: DataFrame, readers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """(doc_id, page, text, error) of folder(): every page of every file by the reader of its suffix. A file that can't be read is one row with the error.

    Readers of other formats (a PDF text layer, optical recognition) are passed in; page texts that are blank are left to them.
    """
    known = {"docx": docx_pages, "txt": lambda b: b.decode("utf-8", "replace").split("\f"), **(readers or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, suffix, content in zip(b.doc_id, b.suffix, b.content):
                try:
                    if suffix not in known:
                        raise ValueError(f"no reader for {suffix}")
                    rows += [(doc, i + 1, t, None) for i, t in enumerate(known[suffix](bytes(content)))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((doc, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "error"])

    return files.select("doc_id", "suffix", "content").mapInPandas(run, "doc_id string, page int, text string, error string")


def not_cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content, by SHA-1, isn't in the cache of texts."""
    return files.join(cache.select("sha1").distinct(), "sha1", "left_anti")


def orientation(readable: DataFrame, least: float = 0.02) -> DataFrame:
    """(doc_id, angle): the rotation under which three sampled pages read best, 0 where none reaches the least. readable(doc_id, page, pages, angle, readability).

    Of n pages those at i * n // 4 (i = 1, 2, 3) are looked at.
    """
    at = F.array(*(F.floor(F.lit(i) * F.col("pages") / 4) + 1 for i in (1, 2, 3)))
    sampled = readable.filter(F.array_contains(F.transform(at, lambda x: x.cast("int")), F.col("page").cast("int")))
    mean = sampled.groupBy("doc_id", "angle").agg(F.avg("readability").alias("r"))
    best = mean.groupBy("doc_id").agg(F.max_by(F.struct("angle", "r"), F.struct("r", (-F.col("angle")).alias("a"))).alias("b"))
    return best.select("doc_id", F.when(F.col("b.r") < least, 0).otherwise(F.col("b.angle")).alias("angle"))


# --------------------------------------------------------------------------- catalogues


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    """(ord, nr, title, chapter, klass, terms): the ordered catalogue of a JSON file."""
    c = spark.read.schema(CRITERIA_SCHEMA).option("multiLine", "true").json(path).select(F.posexplode("kriterien").alias("ord", "k"))
    return c.select("ord", "k.nr", F.col("k.titel").alias("title"), F.col("k.kapitel").alias("chapter"), F.col("k.einstufung").alias("klass"), F.coalesce("k.abgleichbegriffe", F.array().cast("array<string>")).alias("terms"))


def read_standard(spark: SparkSession, path: str) -> DataFrame:
    """One row a criterion of a file of JSON lines; of several for a number the last. A missing file is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(STANDARD_SCHEMA).json(path)
        rows.schema
    except AnalysisException:
        return spark.createDataFrame([], STANDARD_SCHEMA)
    w = Window.partitionBy("abschnitt_nr").orderBy(F.desc("_i"))
    return rows.withColumn("_i", F.monotonically_increasing_id()).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_i", "_k")


def statements(standard: DataFrame) -> DataFrame:
    """(nr, field, pos, text): requirements and variants of the standard, trimmed, none of them empty."""
    of = lambda col, name: standard.select(F.col("abschnitt_nr").alias("nr"), F.lit(name).alias("field"), F.posexplode(col).alias("pos", "text"))
    both = of("standardanforderungen", "required").unionByName(of("auspraegungen_im_korpus", "variant"))
    return both.withColumn("text", F.trim("text")).filter("text <> ''")


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; readers see the old files or the new ones: Spark commits a write as a whole."""
    df.write.mode("overwrite").json(path)


def clean_cell(c: Column) -> Column:
    """Text for a sheet: control characters go, and a text that would be a formula stays text."""
    t = F.regexp_replace(c.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(F.substring(t, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), t)).otherwise(t)


def write_sheet(df: DataFrame, path: str) -> None:
    """A report as CSV with a header, text cells cleaned."""
    cells = [clean_cell(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes]
    df.select(*cells).write.mode("overwrite").option("header", "true").csv(path)
