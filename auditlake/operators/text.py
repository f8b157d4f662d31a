"""Documents into sections and sentences, and what can be told from their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as K


def _blocks(text: Column) -> Column:
    """Stripped lines gathered to blocks: a blank line ends a block, so does reaching the target length."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc, line):
        opened = F.when(acc["n"] == 0, line).otherwise(F.concat(acc["open"], F.lit(" "), line))
        n = acc["n"] + F.length(line) + 1
        blank, full = F.length(line) == 0, n >= K.SECTION_TARGET
        flushed = F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.struct(
            F.when(blank, flushed).when(full, F.concat(acc["done"], F.array(opened))).otherwise(acc["done"]).alias("done"),
            F.when(blank | full, F.lit("")).otherwise(opened).alias("open"),
            F.when(blank | full, F.lit(0)).otherwise(n).alias("n"),
        )

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def _cut(blocks: Column) -> Column:
    """Blocks above the maximum are cut every maximum characters."""
    at = lambda b: F.sequence(F.lit(0), F.greatest((F.length(b) - 1) / K.SECTION_MAX, F.lit(0)).cast("int"))
    return F.flatten(F.transform(blocks, lambda b: F.transform(at(b), lambda i: F.trim(F.substring(b, i * K.SECTION_MAX + 1, F.lit(K.SECTION_MAX))))))


def _merged(pieces: Column) -> Column:
    """A short piece joins the one before it; a short one before takes the next in. What stays short goes."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))

    def step(acc, p):
        join = acc["last"].isNotNull() & ((F.length(p) < K.SECTION_MIN) | (F.length(acc["last"]) < K.SECTION_MIN))
        return F.struct(
            F.when(acc["last"].isNull() | join, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))).alias("done"),
            F.when(join, F.concat(acc["last"], F.lit(" "), p)).otherwise(p).alias("last"),
        )

    whole = F.aggregate(pieces, start, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))
    return F.filter(whole, lambda x: F.length(x) >= K.SECTION_MIN)


def sectioned(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_sections, page, section_idx, text): sections with the number that their document has; pages are parted by form feeds, sections numbered from 0 over the document."""
    # All pages of a document stay one row until they are numbered, so nothing is shuffled.
    listed = docs.select(
        "doc_id",
        F.flatten(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\f"), lambda t, i: F.transform(_merged(_cut(_blocks(t))), lambda s: F.struct((i + 1).alias("page"), s.alias("text"))))).alias("s"),
    )
    return listed.select("doc_id", F.size("s").alias("n_sections"), F.posexplode("s").alias("section_idx", "s")).select("doc_id", "n_sections", "s.page", "section_idx", "s.text")


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, page, section_idx, text)."""
    return sectioned(docs, text).drop("n_sections")


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence): sentences longer than 12 characters."""
    from .rules import split_sentences

    return docs.select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("pos", "sentence"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def junk_signs(parts: DataFrame) -> DataFrame:
    """Adds tokens, short_share, digit_share and is_junk: dot leaders, a letter five times over, few or short words, digits."""
    w = words(F.col("text"))
    out = parts.withColumn("tokens", F.size(w)).withColumn("short", F.size(F.filter(w, lambda x: F.length(x) <= 2))).withColumn("digits", F.length(F.regexp_replace("text", "[^0-9]", "")))
    out = out.withColumn("short_share", F.col("short") / F.greatest("tokens", F.lit(1))).withColumn("digit_share", F.col("digits") / F.greatest(F.length("text"), F.lit(1)))
    odd = F.col("text").rlike(r"\.{4,}") | F.lower("text").rlike(r"([a-zäöüß])\1{4,}")
    return out.withColumn("is_junk", odd | (F.col("tokens") < 5) | (F.col("short_share") > 0.35) | (F.col("digit_share") > 0.18)).drop("short", "digits")


def readability(docs: DataFrame, frequent: list[str], least: int = 15) -> DataFrame:
    """(doc_id, n_words, readability): the share of frequent function words among words of two letters and more; 0 for few words."""
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-zäöüß]+"), lambda x: F.length(x) >= 2)
    n, hit = F.size("w"), F.size(F.filter("w", lambda x: x.isin(frequent)))
    return docs.select("doc_id", w.alias("w")).select("doc_id", n.alias("n_words"), F.when(n < least, F.lit(0.0)).otherwise(F.round(hit / F.greatest(n, F.lit(1)), 6)).alias("readability"))


def leader_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lines, numbered, is_toc_page): lines that end in a page number; five of them and 30 % make a page of contents."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = docs.select("doc_id", F.size(lines).alias("lines"), F.size(F.filter(lines, lambda x: x.rlike("[0-9]{1,4}$"))).alias("numbered"))
    return out.withColumn("is_toc_page", (F.col("numbered") >= 5) & (F.col("numbered") >= 0.3 * F.col("lines")))


def unit_values(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, raw, value): numbers of a text by the rules for thousands and decimals.

    A leading 0 and a mark: decimal. Groups of three after dots: thousands. Two and more groups after commas: thousands. Else the comma is the decimal mark.
    """
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), 0)).alias("pos", "raw"))
    r = F.col("raw")
    plain = (
        F.when(r.rlike(r"^0[.,][0-9]+$"), F.replace(r, F.lit(","), F.lit(".")))
        .when(r.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), F.replace(r, F.lit("."), F.lit("")))
        .when(r.rlike(r"^[0-9]{1,3}(,[0-9]{3}){2,}$"), F.replace(r, F.lit(","), F.lit("")))
        .otherwise(F.replace(r, F.lit(","), F.lit(".")))
    )
    return found.withColumn("value", plain.try_cast("double"))
