"""Whether what a model says is in the texts that it was shown: quotations, numbers and words, and the content of a template row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rules as R

# Characters and words of a quotation at least, share of its words that one section must have.
QUOTE_CHARS, QUOTE_WORDS, QUOTE_PARTS = 25, 4, (4, 5)
#: Quotations of the same keys that meet a section in one row.
TOGETHER = 64
# An answer of the re-check that says there is no deviation; least length of a deviation; how much of a quotation a reason shows.
NO_DEVIATION = "(?i)^\\s*((kein[a-z0-9_äöüß]*|nicht|nichts|nein|n/?a|entf[äa]llt)($|[^a-zA-Z0-9_äöüßÄÖÜ])|-[a-zA-Z0-9_äöüßÄÖÜ])"
DEVIATION_CHARS, SHOWN = 12, 160
# Limits of a row's content: characters of a requirement, entries of a list, words of a placeholder, terms before the title's words help.
REQUIREMENT_CHARS, ENTRIES, PLACEHOLDER_WORDS, FEW_TERMS = 15, 8, 6, 3


def quote_words(text: Column) -> Column:
    """Words of three characters and more, in lower case; a hyphen at the end of a line joins its halves."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"-\s*\n\s*", "")), F.lit("[0-9a-zäöüß]{3,}"), 0)


def quoted(quotes: DataFrame, sections: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """quotes(keys, quote) -> (keys, quote, share, place of the section): the section with the same keys that has most of a quotation's words, four fifths at least; of equal shares the first by ``order``.

    sections(keys, order, text). A section meets the quotations of its keys in rows of ``TOGETHER`` each, so that no word and no
    pair is ever shuffled; what is already dealt by ``keys`` stays where it is. A prefix filter finds the quotations worth counting:
    if four fifths of n words are in a section, one of any n / 5 + 1 of them is. The longest are taken, which are seldom the
    frequent ones. They and the shares are compared by words' hashes, which can only add words; those that pass are counted by
    the words themselves. Nothing that grows is broadcast: texts are compressed well, and what looks small enough for it is a
    multiple on the driver. Quotations that are too short, lists of contents, or in no section, have no row.
    """
    a, b = QUOTE_PARTS
    # As the output of a generator, words are found once and not once for each use.
    once = lambda *c: F.explode(F.array(F.struct(*c)))
    q = quotes.select(*keys, "quote").filter(F.length(F.trim("quote")) >= QUOTE_CHARS).select(*keys, "quote", once(quote_words(F.col("quote")).alias("w")).alias("x")).select(*keys, "quote", "x.w")
    q = q.filter((F.size("w") >= QUOTE_WORDS) & ~R.is_contents(F.col("quote")))
    hashes = lambda words: F.transform(words, lambda x: F.xxhash64(x))
    longest = F.slice(F.array_sort(F.transform("w", lambda x: F.struct((-F.length(x)).alias("l"), x.alias("word")))), 1, (F.size("w") - F.ceil(F.size("w") * a / b) + 1).cast("int"))
    one = F.struct("quote", hashes(F.col("w")).alias("w"), hashes(F.array_distinct(F.transform(longest, lambda x: x["word"]))).alias("prefix"))
    numbered = q.select(*keys, "quote", one.alias("one")).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("quote")))
    together = numbered.groupBy(*keys, F.floor(F.col("i") / TOGETHER).alias("i")).agg(F.collect_list("one").alias("quotes")).drop("i")
    have = sections.select(*keys, *order, "text", once(hashes(F.array_distinct(quote_words(F.col("text")))).alias("have")).alias("x")).select(*keys, *order, "text", "x.have")
    # The words of a row's quotations that the section has are few, so they are looked up in place of all.
    hit = lambda: F.array_intersect(F.flatten(F.col("quotes.prefix")), "have")
    j = have.join(together.hint("merge"), keys).select(*keys, *order, "text", "have", "quotes", once(hit().alias("hit")).alias("x"))
    share = lambda w, words: F.size(F.filter(w, lambda x: F.array_contains(words, x))) / F.size(w)
    near = F.filter("quotes", lambda x: F.arrays_overlap(x["prefix"], F.col("x.hit")) & (share(x["w"], F.col("have")) >= a / b))
    j = j.filter(F.size("x.hit") > 0).select(*keys, *order, "text", F.explode(F.transform(near, lambda x: x["quote"])).alias("quote"))
    j = j.select(*keys, *order, "quote", once(quote_words(F.col("quote")).alias("w"), quote_words(F.col("text")).alias("have")).alias("x")).select(*keys, *order, "quote", "x.*")
    best = j.select(*keys, "quote", once(share(F.col("w"), F.col("have")).alias("share"), F.struct(*order).alias("place")).alias("x")).select(*keys, "quote", "x.*").filter(F.col("share") >= a / b)
    return best.groupBy(*keys, "quote").agg(F.min_by(F.struct("share", "place"), F.struct((-F.col("share")).alias("m"), "place")).alias("b")).select(*keys, "quote", "b.share", "b.place.*")


def rechecked(answers: DataFrame, sections: DataFrame) -> DataFrame:
    """answers(doc_id, nr, zitat, verbindlich, abweichung) of a second look at verdicts N -> (doc_id, nr, status, reason, evidence).

    Without a quotation that is in a candidate the verdict stays N. A deviation that is named makes it A, else a binding
    passage E, another one T. sections(doc_id, nr, rank, page, text): the candidates.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    a = answers.select("doc_id", "nr", flat("zitat").alias("quote"), flat("abweichung").alias("deviation"), F.lower(flat("verbindlich")).rlike("^(ja|true)").alias("binding"))
    found = quoted(a, sections, ["doc_id", "nr"], ["rank", "page"]).drop("share", "rank")
    j = a.join(found.hint("merge"), ["doc_id", "nr", "quote"], "left")
    short = F.when(F.length("quote") <= SHOWN, F.col("quote")).otherwise(F.concat(F.rtrim(F.substring("quote", 1, SHOWN - 3)), F.lit(" …")))
    deviates = (F.length("deviation") >= DEVIATION_CHARS) & ~F.col("deviation").rlike(NO_DEVIATION)
    status = F.when(F.col("page").isNull(), "N").when(deviates, "A").when(F.col("binding"), "E").otherwise("T")
    reason = F.when(F.col("page").isNull(), "").when(deviates, F.concat("deviation", F.lit(" (Stelle: „"), short, F.lit("“)"))).otherwise(F.concat(F.lit("Geregelt: „"), short, F.lit("“")))
    return j.select("doc_id", "nr", status.alias("status"), reason.alias("reason"), F.when(F.col("page").isNull(), "").otherwise(F.concat(F.lit("S"), F.col("page").cast("string"))).alias("evidence"))


# --------------------------------------------------------------------------- template rows


def numbers(text: Column) -> Column:
    """Numbers of a text without dots and commas, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[0-9]+(?:[.,][0-9]+)*"), 0), lambda x: F.translate(x, ".,", "")))


def stands_in(claim: Column, source: Column) -> Column:
    """Whether a claim stands in a source: all its numbers of two digits and more; without any, half of its words of four characters and more, as parts of words."""
    n = F.filter(numbers(claim), lambda x: F.length(x) >= 2)
    low = F.lower(source)
    w = F.array_distinct(F.regexp_extract_all(F.lower(claim), F.lit("[a-z0-9_äöüß]{4,}"), 0))
    return F.when(F.size(n) > 0, F.size(F.array_except(n, numbers(low))) == 0).otherwise((F.size(w) > 0) & (2 * F.size(F.filter(w, lambda x: F.contains(low, x))) >= F.size(w)))


def grounded_variants(variants: DataFrame, shown: DataFrame) -> DataFrame:
    """variants(row, pos, text) -> those that stand in the passage of the very document that they name in brackets at their end. shown(row, doc_id string, text)."""
    tail = r"\(([^()]*)\)[\s.;,:!?]*$"
    v = variants.withColumn("doc_id", F.trim(F.regexp_extract("text", tail, 1))).filter(F.col("text").rlike(tail) & (F.col("doc_id") != ""))
    claim = F.regexp_replace("text", r"\([^()]*\)[\s.;,:!?]*$", "")
    j = v.withColumn("claim", claim).join(shown.select("row", "doc_id", F.col("text").alias("source")), ["row", "doc_id"])
    return j.filter(stands_in(F.col("claim"), F.col("source"))).select("row", "pos", "text", "doc_id")


def checked_content(answers: DataFrame, shown: DataFrame, documents: list[str]) -> DataFrame:
    """(row, requirements, variants, placeholders, terms): of a model's answer for each template row what can be held against the passages it was shown.

    answers(row, title, requirements, variants, placeholders, terms: arrays). Requirements have 15 characters and name no
    document; variants are grounded in their document; placeholders have six words at most; terms are in the passages or the
    title, and where fewer than three are left the title's own words of five letters and more join them. ``documents`` are the
    template's sources, configuration.
    """
    listed = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))), lambda x: x != "")
    a = answers.select("row", "title", *(listed(c).alias(c) for c in ("requirements", "variants", "placeholders", "terms")))
    named = lambda x: F.exists(F.array(*(F.lit(d.lower()) for d in documents)).cast("array<string>"), lambda d: F.contains(F.lower(x), d))
    kept = grounded_variants(a.select("row", F.posexplode("variants").alias("pos", "text")), shown)
    kept = kept.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("grounded"))
    texts = shown.groupBy("row").agg(F.lower(F.array_join(F.array_sort(F.collect_list("text")), " ")).alias("all"))  # eight passages of 1,200 characters at most
    j = a.join(kept, "row", "left").join(texts, "row", "left")
    known = F.filter("terms", lambda t: F.contains(F.coalesce(F.col("all"), F.lit("")), F.lower(t)) | F.contains(F.lower("title"), F.lower(t)))
    once = lambda c: F.filter(c, lambda t, i: F.array_position(F.transform(c, lambda y: F.lower(y)), F.lower(t)) == i + 1)
    own = F.regexp_extract_all("title", F.lit("[A-Za-zÄÖÜäöüß-]{5,}"), 0)
    terms = once(F.when(F.size(once(known)) < FEW_TERMS, F.concat(known, own)).otherwise(known))
    holders = F.filter(F.transform("placeholders", lambda p: F.regexp_replace(p, r"^[\[\]() ]+|[\[\]() ]+$", "")), lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda x: x != "")) > 0)
    few = F.filter(holders, lambda p: F.size(F.split(p, r"\s+")) <= PLACEHOLDER_WORDS)
    long = F.filter("requirements", lambda r: (F.length(r) >= REQUIREMENT_CHARS) & ~named(r))
    return j.select("row", F.slice(long, 1, ENTRIES).alias("requirements"), F.coalesce("grounded", F.array().cast("array<string>")).alias("variants"), F.slice(few, 1, ENTRIES).alias("placeholders"), F.slice(terms, 1, ENTRIES).alias("terms"))
