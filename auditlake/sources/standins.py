"""Facts of audits derived from the given tables.

Verdicts come from ``events``: the user is the document, the event's number modulo
the number of criteria is the criterion, the latest event of both decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as K

# Which event stands for which status; signup stands for "not rated".
STATUS = {"view": "E", "click": "T", "error": "A", "purchase": "N"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, nr, klass, status, before, ref, other, p): status and reference of each document and criterion.

    ``before`` is the model's status where a sign changed it, ``other`` a second run's status, ``p`` a probability of deviation.
    """
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % K.CRITERIA).cast("int").alias("nr"), "ts", "event_id", "event_type", "value")
    last = e.groupBy("doc_id", "nr").agg(F.max_by(F.struct("event_type", "value", "event_id"), F.struct("ts", "event_id")).alias("e"))
    cents = F.round(F.col("e.value") * 100).cast("long")
    letter = lambda n: F.element_at(F.array(*(F.lit(s) for s in "ETAN")), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    status = F.coalesce(*(F.when(F.col("e.event_type") == k, F.lit(v)) for k, v in STATUS.items()))
    return last.select(
        "doc_id", "nr",
        F.element_at(F.array(F.lit("mandatory"), F.lit("regular"), F.lit("optional")), (F.col("nr") % 3 + 1).cast("int")).alias("klass"),
        status.alias("status"),
        F.when((status == "A") & (F.col("e.event_id") % 5 == 0), F.lit("E")).alias("before"),
        F.when(F.pmod(cents, F.lit(11)) != 0, letter(cents)).alias("ref"),
        letter(cents + F.col("e.event_id") % 3).alias("other"),
        F.round(F.pmod(cents, F.lit(1000)) / 1000.0, 3).alias("p"),
    )


# --------------------------------------------------------------------------- texts of audits

#: Sentences of requirement documents; {c}: the event's value in cents, {k}: the number in its props. One passage has two of them.
PASSAGES = [
    "Der Lieferant trägt die Kosten der Nacharbeit in Höhe von {c} EUR.",
    "Der Lieferant trägt die Kosten der Bemusterung nicht.",
    "Mehrkosten gehen zu Lasten des Auftragnehmers; dies gilt auch für {k} Teile.",
    "Die Reparatur wird dem Kunden in Rechnung gestellt, der Hersteller ist zu informieren.",
    "Im Angebot sind die Kosten vom Lieferanten auszuweisen und zu tragen.",
    "Es sind nur Normalien der Firma HASCO zu verwenden.",
    "Es dürfen Normalien von Meusburger oder gleichwertig eingesetzt werden.",
    "Hydraulikzylinder must be supplied by Merkle only.",
    "Die Standzeit beträgt mindestens {c} Schuss bei {k} bar.",
    "Die Oberfläche hat {k} HRC und eine Toleranz von 0,0{k} mm.",
    "Der Werkstoff ist 1.2343 oder 1.2{k}44 nach Freigabe.",
    "Zulässig sind die Werkstoffe 1.2343, 1.2344 und 1.2367 für alle Einsätze.",
    "Die Temperatur der Form liegt bei {k} °C und {k},5 % Feuchte.",
    "Inhaltsverzeichnis 1 Allgemeines ...... 3 und 2 Werkzeug ...... {k}",
    "Im Inhaltsverzeichnis sind sämtliche Zeichnungen aufgeführt, auch Blatt {k}.",
    "3.{k} Toleranzauslegung ......... {k}",
    "Der Hersteller ist verantwortlich für die Freigabe und die Genehmigung der Zeichnung.",
    "Das Werkzeug verbleibt beim Kunden - die Fa. Muster liefert {k} Ersatzteile.",
    "The tool shall reach 150,000 shots; the contractor is charged to {k} hours.",
    "Kein Nachweis liegt vor, die Angabe ist unklar und nicht anwendbar.",
    "Die Auslegung erfolgt herstellerneutral und nach Rücksprache mit dem Auftraggeber.",
    "Protokolle mit folgendem Inhalt sind wöchentlich zu liefern: Maße, Gewichte, {k} Bilder.",
    "Bei Verzug wird eine Vertragsstrafe von {k} % vom Lieferanten fällig.",
    "Die Frist beträgt {k} Wochen und ist zwingend einzuhalten.",
]
#: Reasons of verdicts; {p}: the page.
REASONS = [
    "Das Lastenheft regelt den Punkt auf Seite {p} wie der Standard.",
    "Die Vorgabe widerspricht dem Standard in Abschnitt 3.{p}.",
    "Der Text steht nicht im Widerspruch zum Standard.",
    "Es wird das Fabrikat der Firma Siemens gefordert, Lieferant nach Wahl.",
    "Die Garantie gilt mindestens {k} Monate.",
    "Nach DIN ISO 2768 sind die Toleranzen festgelegt.",
    "Der Lieferant trägt die Kosten ausschließlich.",
    "Keine Angabe im Dokument.",
    "LHD-{k} nennt den Werkstoff 1.2343 und die Marke ACME{k}.",
    "",
]
#: Where a verdict says that it is from.
EVIDENCE = ["S{p}", "Seite {p}, Seite 997", "Abschnitt 4.2", "S. {p}; S{k}", "", "S998", "Punkt 3.{k}, S{p}", "{p}"]
#: Answers of a model; {s}: the status it gives, {r}: the reason, {e}: the evidence.
ANSWERS = [
    '{"status": "{s}", "begruendung": "{r}", "fundstelle": "{e}"}',
    'Gern: ```json {"status": " {s}x", "begruendung": "{r} (a } b)", "fundstelle": "{e}", "x": {"y": [1, {"z": 2}]}} ``` {"status": "N"}',
    '<think>ist es {A}?</think>Antwort {"begruendung": "sagt \\"{r}\\" {", "status": "{s}", "fundstelle": "{e}"} Ende }',
    'Leider keine Antwort, status: A',
    '{"status": "{s}", "begruendung": "{r}"',
    '{"status": "X", "begruendung": "{r}"}',
]
#: Requirements of the standard, one a part; {s}: its size, {r}: the whole units of its price.
REQUIREMENTS = [
    "Die Standzeit beträgt {r}00 Schuss.", "Der Druck liegt bei {s} bar.", "Die Härte ist {s} HRC.", "Der Werkstoff 1.2{r} ist zu verwenden, sonst 1.2343.", "Kosten der Nacharbeit trägt der Lieferant.",
    "Das Fabrikat wird nach Freigabe vereinbart.", "Die Temperatur ist {s} °C.", "Der Kunde ist zuständig für die Freigabe.", "Die Toleranz ist 0,{s} mm.", "Ersatzteile sind vereinbart.",
]
TITLES = ["Auswerfer", "Kosten und Preise", "Hydraulik", "Toleranzen", "Werkstoffauswahl", "Allgemeines", "Temperierung"]


def _one_of(some: list[str], n):
    return F.element_at(F.array(*(F.lit(x) for x in some)), (F.pmod(n, F.lit(len(some))) + 1).cast("int"))


def _filled(text, **values):
    for k, v in values.items():
        text = F.replace(text, F.lit("{" + k + "}"), v.cast("string"))
    return text


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), (F.col("event_id") % K.CRITERIA).cast("int").alias("nr"), "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("c"),
        F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k"), "event_type",
    )


def passages(spark: SparkSession, sf_dir: str, by_document: bool = False) -> DataFrame:
    """(doc_id, nr, rank, page, text, score): what a search has found for each criterion, one passage an event, the latest first.

    ``by_document``: a document's passages are in one partition, for plans that go on by document.
    """
    from pyspark.sql import Window

    e = _events(spark, sf_dir)
    if by_document:
        e = e.repartition("doc_id")
    w = Window.partitionBy("doc_id", "nr").orderBy(F.desc("ts"), F.desc("event_id"))
    text = F.concat(_filled(_one_of(PASSAGES, F.col("event_id") % 997), c=F.col("c"), k=F.col("k")), F.lit(" "), _filled(_one_of(PASSAGES, F.col("event_id") * 7 % 991), c=F.col("c"), k=F.col("k")))
    return e.select("doc_id", "nr", F.row_number().over(w).alias("rank"), (F.col("k") % 40 + 1).alias("page"), text.alias("text"), F.round(F.pmod(F.col("c"), F.lit(700)) / 1000.0 + 0.3, 3).alias("score"))


def reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verdicts() with the reason, the evidence, the model's answer and whether its call failed, all of the latest event."""
    e = _events(spark, sf_dir)
    last = e.groupBy("doc_id", "nr").agg(F.max_by(F.struct("event_id", "c", "k"), F.struct("ts", "event_id")).alias("e")).select("doc_id", "nr", "e.*")
    page = F.col("k") % 40 + 1
    r = _filled(_one_of(REASONS, F.col("event_id") % 983), k=F.col("k"), p=page)
    ev = _filled(_one_of(EVIDENCE, F.col("event_id") % 977), k=F.col("k"), p=page)
    v = verdicts(spark, sf_dir).join(last, ["doc_id", "nr"])
    cause = F.when(F.col("status").isNull(), F.when(F.col("event_id") % 2 == 0, F.lit("LLM-Aufruf fehlgeschlagen: timeout")).otherwise(F.lit("Antwort nicht lesbar"))).when((F.col("status") == "N") & (F.col("event_id") % 3 == 0), F.lit("kein Kandidat")).otherwise(F.lit(""))
    answer = _filled(_one_of(ANSWERS, F.col("event_id") % 971), s=F.coalesce(F.lower("status"), F.lit("n")), r=r, e=ev)
    return v.withColumns({"reason": F.when(F.col("status") == "N", F.lit("")).otherwise(r), "evidence": ev, "answer": answer, "cause": cause, "lifted": F.col("event_id") % 17 == 0, "opposed": F.col("event_id") % 13 == 0, "ranked": F.when(F.col("event_id") % 19 == 0, 0.5)}).drop("c", "k")


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nr, pos, field, text): statements of the standard, one a part: what is required, and every third one a variant that was seen."""
    p = table(spark, sf_dir, "part")
    text = _filled(_one_of(REQUIREMENTS, F.col("p_partkey") % 101), s=F.col("p_size"), r=F.floor("p_retailprice").cast("long"))
    return p.select((F.col("p_partkey") % K.CRITERIA).cast("int").alias("nr"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 3 == 0, "variant").otherwise("required").alias("field"), text.alias("text"))


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nr, title, chapter, klass, placeholders): the catalogue, of the first part of each criterion."""
    p = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % K.CRITERIA).cast("int").alias("nr")).agg(F.min_by(F.struct("p_brand", "p_type"), "p_partkey").alias("p"))
    return p.select("nr", _one_of(TITLES, F.col("nr")).alias("title"), F.col("p.p_type").alias("chapter"), F.element_at(F.array(F.lit("mandatory"), F.lit("regular"), F.lit("optional")), (F.col("nr") % 3 + 1).cast("int")).alias("klass"),
                    F.when(F.col("nr") % 4 == 0, F.array(F.lit("Typ und Fabrikat"), F.col("p.p_brand"))).otherwise(F.array(F.col("p.p_brand"))).alias("placeholders"))


def tokens(v: DataFrame) -> DataFrame:
    """(doc_id, nr, tokens): the tokens of an answer with the likeliest alternatives at the status, of verdicts with a status."""
    one = lambda t, top: F.struct(t.alias("token"), top.alias("top"))
    alt = lambda t, p: F.struct(t.alias("token"), p.alias("logprob"))
    none = F.array().cast("array<struct<token:string,logprob:double>>")
    p = F.col("p")
    top = F.array(alt(F.col("status"), -p), alt(F.lit(" A"), -2 * p - 0.1), alt(F.lit("S"), F.lit(-0.01)), alt(F.lit("E"), F.lit(-3.0)))
    said = F.array(one(F.lit("E"), none), one(F.lit('{"sta'), none), one(F.lit('tus": "'), none), one(F.concat(F.col("status"), F.lit(" ")), top), one(F.lit('"}'), none), one(F.lit("T"), none))
    return v.filter("status is not null").select("doc_id", "nr", said.alias("tokens"))


#: Lines of outlines; {a}, {b}: numbers that mostly ascend over a document, {k}: the number in the event's props.
LINES = [
    "{a} Auswerfer und Schieber", "{a}.{b} Toleranzen der Form", "Die Toleranz der Form ist auf Blatt {k} angegeben und gilt für alle Einsätze des Werkzeugs, auch für Ersatzteile.", "{a}.{b}. Werkstoffe", "4 mm 18mm",
    "{a}.{b} Temperierung ......... {k}", "{a}.{b}.1 Anschlüsse am Werkzeug:", "", "1 Allgemeines", "Alle Anschlüsse sind zu beschriften; die Beschriftung ist dauerhaft, lesbar und auf der Bedienseite angebracht, wie es die Zeichnung verlangt.",
    "{a} März 2024 Stand", "{b}. aufgezählter Punkt mit Text, der weitergeht.", "{a}.{b} Kühlung [Zeichnung]", "belegt in {b} von {k}",
]


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents of lines, one an event in order of time, 25 on a page; pages are parted by form feeds."""
    from pyspark.sql import Window

    e = _events(spark, sf_dir)
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("ts", "event_id")) - 1
    e = e.withColumn("i", i)
    a, b = F.floor(F.col("i") / 9) + 1, F.col("i") % 9 + 1
    line = _filled(_one_of(LINES, F.col("event_id") * 5 % 967), a=a.cast("int"), b=b.cast("int"), k=F.col("k"))
    pages = e.select("doc_id", F.floor(F.col("i") / 25).alias("page"), F.struct("i", line.alias("t")).alias("l")).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), "\n").alias("t"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\f").alias("text"))


#: Blocks of template documents: H heading, L line, T a table's row with its cells; {a}, {b}, {k} as in LINES.
BLOCKS = [
    "H{a} Werkzeug {k}", "H{a}.{b} Toleranzen der Form", "H{a}.{b}.1 Kernzüge und Schieber", "HZweck und Aufbau", "TPflicht|belegt in {b} von 18|A-1, B-13,3,C", "Tregel|Belegt in 2 von {k}|X-{k}, Y", "TWerkzeugtyp||Form {k}|Form {k}|rund",
    "LStandardanforderungen:", "LDer Lieferant liefert {k} Teile.", "LAusprägungen im Korpus", "LProjektspezifisch festzulegen::", "L[Schwindmaß in %]  ·  [ Lage {k} ] und [ ]", "LAbgleichbegriffe: druck · bar;{k} •  ; mm", "L  ", "L  Härte {k} HRC [x] ", "TOptional|{k}",
]


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, kind, text, cells): template documents, a block an event in order of time."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("ts", "event_id")) - 1
    e = _events(spark, sf_dir).withColumn("i", i)
    t = _filled(_one_of(BLOCKS, F.col("event_id") * 5 % 967), a=(F.floor(F.col("i") / 9) + 1).cast("int"), b=(F.col("i") % 9 + 1).cast("int"), k=F.col("k"))
    e = e.withColumns({"t": F.substring(t, 2, 1_000_000), "mark": F.substring(t, 1, 1)})
    kind = F.when(F.col("mark") == "H", "heading").when(F.col("mark") == "T", "table").otherwise("line")
    return e.select("doc_id", "i", kind.alias("kind"), F.when(kind != "table", F.col("t")).alias("text"), F.when(kind == "table", F.split("t", "[|]")).alias("cells"))


#: nr -> (title, more terms) of the catalogue of requirement texts; one entry has a title that is not the criterion's.
DICTIONARY = {0: ("Auswerfer", ["ejector", "shots"]), 1: ("Kosten und Preise", ["cost"]), 2: ("Pneumatik", ["air"]), 10: ("Toleranzen", ["tolerance"]), 66: ("Toleranzen", ["fit"])}


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(nr, title, more) for nr, (title, more) in DICTIONARY.items()], "nr int, title string, more array<string>")


def with_terms(criteria_: DataFrame) -> DataFrame:
    """Criteria with the terms of their title."""
    terms = F.coalesce(*(F.when(F.col("title") == t, F.array(*(F.lit(x) for x in w))) for t, w in K.AUDIT_TERMS.items()))
    return criteria_.withColumn("terms", terms)
