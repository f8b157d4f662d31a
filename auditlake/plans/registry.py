"""The queries on audits, by name, and the SQL that their results are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as K
from .. import words as L
from ..functions import tables
from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import evidence as V
from ..operators import jobs as J
from ..operators import provider as A
from ..operators import report as P
from ..operators import rules as R
from ..operators import search as S
from ..operators import template as M
from ..operators import text as T
from ..sources import package
from ..sources import standins as I
from ..sources import store
from ..sources.standins import table, verdicts
from . import building, grounded, imported, measured, rules_sql, running, sql

#: The vectors of the tables are spread more widely than those of a text model: their least likeness.
LEAST = 0.25


def _on_verdicts(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(verdicts(spark, sf_dir))


def _on(name: str, f) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        package.send(spark)
        return f(table(spark, sf_dir, name))

    return query


def _with_labels(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: package.send(spark) or f(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _on_reasoned(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(I.reasoned(spark, sf_dir))


def _on_passages(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: package.send(spark) or f(I.passages(spark, sf_dir))


def _on_outlines(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(I.outlines(spark, sf_dir))


def _noted(h: DataFrame) -> DataFrame:
    return h.select("doc_id", "nr", "page", F.concat_ws(" ", "nr", "words").alias("text"))


def _cases(v: DataFrame, p: DataFrame, r: DataFrame, c: DataFrame) -> DataFrame:
    """Cases of flagged verdicts; the model is known to have said E where the reference is missing."""
    n = p.groupBy("doc_id", "nr").agg(F.count("*").alias("candidates"))
    asked = v.select("doc_id", "nr", "cause", F.when(F.col("ref").isNull(), "E").alias("said_status"), "lifted").join(n, ["doc_id", "nr"], "left").join(R.echoes(v, p, r), ["doc_id", "nr"], "left")
    return D.case_of(_flags(v, p, r, c).select("doc_id", "nr", "status", "status_model"), asked)


def _changes(c: DataFrame, r: DataFrame) -> DataFrame:
    """The template against an older one, which lacks some criteria and has other titles and classes."""
    full = c.select("nr", "title", "klass").join(M.with_standard(c, r).select("nr", "required"), "nr")
    old = full.filter("nr % 7 <> 0").withColumns({"title": F.when(F.col("nr") % 3 == 0, F.upper("title")).otherwise(F.col("title")), "klass": F.when(F.col("nr") % 4 == 0, "optional").otherwise(F.col("klass"))})
    return M.template_changes(full.filter("nr % 5 <> 0"), old)


def _on_requirements(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(I.requirements(spark, sf_dir))


def _on_audit(f) -> Callable[[SparkSession, str], DataFrame]:
    """Queries on verdicts with reasons, passages, requirements and criteria."""
    return lambda spark, sf_dir: package.send(spark) or f(I.reasoned(spark, sf_dir), I.passages(spark, sf_dir), I.requirements(spark, sf_dir), I.criteria(spark, sf_dir))


def _flags(v: DataFrame, p: DataFrame, r: DataFrame, c: DataFrame, level: str = "thorough", levels=D.LEVELS) -> DataFrame:
    return D.flagged(D.evidence_of_verdicts(v, p, r, c), level, levels)


def _found(f) -> Callable[[DataFrame], DataFrame]:
    return lambda docs: f(docs, S.candidates(docs))


#: The frozen decider: features as they are, coefficients by class.
FROZEN = D.Model(D.FEATURES, D.CLASSES, [0.0] * 12, [1.0] * 12, [K.FROZEN[k][1] for k in D.CLASSES], [K.FROZEN[k][0] for k in D.CLASSES])


def learning_rows(docs: DataFrame, labels: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Features of labelled documents with a reference status: by the best lexical score, A for documents of no quality that have the terms."""
    f = (S.features(S.candidates(docs), docs) if found is None else found).join(labels.select("doc_id", "quality"), "doc_id")
    ref = F.when((F.col("max_lex") > 0.5) & (F.col("quality") == 0), "A").when(F.col("max_lex") > 0.5, "E").when(F.col("max_lex") > 0, "T").otherwise("N")
    return f.withColumn("ref", ref).drop("quality")


def _trained(docs: DataFrame, labels: DataFrame) -> DataFrame:
    # The search over all documents is made once; the training goes over its rows many times.
    found = store.written(S.features(S.candidates(docs), docs))
    model = D.train(learning_rows(docs, labels, found), D.FEATURES, D.CLASSES)
    return D.probabilities(found, model, "doc_id", "nr")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_sections": _on("documents", T.sections),
    "p6_sentences": _on("documents", T.sentences),
    "p8_numbers": _on("documents", T.unit_values),
    "f2_contents_pages": _on("documents", T.leader_lines),
    "f3_junk": _on("documents", lambda d: T.junk_signs(d).select("doc_id", "tokens", "short_share", "digit_share", "is_junk")),
    "f4_readability": _on("documents", lambda d: T.readability(d, L.FUNCTION_WORDS)),
    "x4_hybrid_search": _on("documents", S.candidates),
    "k1_features": _on("documents", lambda d: S.features(S.candidates(d), d)),
    "j8_residual_sections": _on("documents", _found(S.residual_sections)),
    "a16_mean_similarity": _on("documents", S.mean_similarity),
    "x6_archive_search": _on("embeddings", lambda d: S.archive_search(d, LEAST)),
    "x7_cross_references": _on("embeddings", lambda d: S.cross_references(d, LEAST)),
    "x8_document_ranking": _on("embeddings", S.document_ranking),
    "x9_best_pairs": _on("embeddings", lambda d: S.best_pairs(d, LEAST)),
    "a1_kpis": _on_verdicts(E.kpis),
    "a3_by_class": _on_verdicts(E.by_class),
    "a4_why_not": _on_reasoned(E.why_not),
    "a5_confusion": _on_verdicts(E.confusion),
    "a5_regulated_scores": _on_verdicts(E.regulated_scores),
    "a5_baselines": _on_verdicts(E.baselines),
    "a6_mcnemar": _on_verdicts(E.mcnemar),
    "a7_damage": _on_verdicts(E.damage),
    "a7_damage_classes": _on_verdicts(E.damage_classes),
    "a8_damage_baselines": _on_verdicts(E.damage_baselines),
    "a9_sensitivity": _on_verdicts(E.sensitivity),
    "a13_placement": _on_verdicts(E.placement),
    "a14_placement_summary": _on_verdicts(E.placement_summary),
    "a17_class_from_frequency": _on_verdicts(E.class_from_frequency),
    "a18_deviation_share": _on_verdicts(E.deviation_share),
    "a24_fingerprint": _on_verdicts(E.fingerprint),
    "k10_signs": _on_audit(lambda v, p, r, c: D.with_signs(D.evidence_of_verdicts(v, p, r, c)).selectExpr("doc_id", "nr", "array_join(signs, ',') AS signs")),
    "k11_flagged": _on_audit(_flags),
    "k11_flagged_1_1": _on_audit(lambda v, p, r, c: _flags(v, p, r, c, "high", D.LEVELS_1_1)),
    "w3_top_flags": _on_audit(lambda v, p, r, c: D.likeliest(D.with_signs(D.evidence_of_verdicts(v, p, r, c)), D.LEVELS["thorough"]).select("doc_id", "nr", "place", "p")),
    "r3_deviations": _on_audit(lambda v, p, r, c: _flags(v, p, r, c).filter("status = 'A'").join(c.select("nr", "title"), "nr").selectExpr("doc_id", "nr", "title", "origin", "substring(reason, 1, 500) AS reason", "evidence")),
    "x7_statement_references": lambda spark, sf_dir: package.send(spark) or S.statement_references(I.requirements(spark, sf_dir), I.with_terms(I.criteria(spark, sf_dir))),
    "p2_paged_sections": _on_outlines(T.sections),
    "p3_chapter_sections": _on_outlines(lambda d: M.chapter_sections(M.lines_of(d), with_title=True)),
    "p3_chapter_chunks": lambda spark, sf_dir: package.send(spark) or tables.chapter_chunks(M.lines_of(I.outlines(spark, sf_dir))),
    "p4_headings": _on_outlines(lambda d: M.headings(M.lines_of(d))),
    "p5_headings": _on_outlines(lambda d: M.template_headings(M.lines_of(d))),
    "a21_topic_parts": _on_outlines(lambda d: M.split_repeats(M.template_headings(M.lines_of(d)))),
    "a22_topics": _on_outlines(lambda d: M.topics(M.template_headings(M.lines_of(d)))),
    "p18_outline": lambda spark, sf_dir: M.outline(I.criteria(spark, sf_dir)),
    "p23_slugs": _on("part", lambda p: p.select(F.concat("p_name", F.lit(" Ä/ß "), "p_type").alias("name")).distinct().select("name", M.slug(F.col("name")).alias("slug"))),
    "p23_document_ids": _on("pages", lambda p: p.select("page_id", M.document_id(F.col("url")).alias("id"))),
    "p24_corpus_size": _on_outlines(lambda d: M.corpus_size(M.lines_of(d))),
    "p24_subjects": _on("documents", lambda d: d.select("doc_id", M.subject(F.coalesce("text", F.lit(""))).alias("subject"))),
    "s10_dictionary_terms": lambda spark, sf_dir: M.with_dictionary(I.with_terms(I.criteria(spark, sf_dir)), I.dictionary(spark)).select("nr", "title", F.array_join("terms", ",").alias("terms")),
    "j1_with_standard": lambda spark, sf_dir: M.with_standard(I.criteria(spark, sf_dir), I.requirements(spark, sf_dir)),
    "j11_template_changes": lambda spark, sf_dir: _changes(I.criteria(spark, sf_dir), I.requirements(spark, sf_dir)),
    "v4_import_warnings": _on_audit(lambda v, p, r, c: M.import_warnings(c, r, v)),
    "x11_excerpts": _on_audit(lambda v, p, r, c: P.excerpts(v, p)),
    "r1_cover": _on_verdicts(P.cover),
    "r2_criteria_list": _on_audit(lambda v, p, r, c: P.criteria_list(v, p, c)),
    "r8_model_comparison": _on_verdicts(P.model_comparison),
    "j10_reference_distribution": _on_verdicts(P.reference_distribution),
    "x13_reference_examples": _on_audit(lambda v, p, r, c: P.reference_examples(v, p)),
    "u1_corpus": _on_verdicts(P.corpus),
    "u3_run_sets": _on_verdicts(P.run_sets),
    "u4_common_documents": _on_verdicts(P.common_documents),
    "w10_practice": _on_verdicts(P.practice),
    "w12_context": _on_passages(P.context),
    "p21_density": _on_passages(P.density),
    "a15_pair_summary": _on_verdicts(lambda v: S.pair_summary(v.select("doc_id", F.when(F.col("status").isNotNull(), F.round(F.col("p") * 100).cast("int")).alias("value")))),
    "m1_run_folders": _on("events", lambda e: J.folder_names(J.states(e))),
    "m2_run_states": _on("events", lambda e: J.states(e).select("run", "state")),
    "m3_newest_runs": _on("events", lambda e: J.newest(J.states(e))),
    "f23_training_part": _on("documents", lambda d: J.corpus_part(d, "training", list(range(0, 200, 3)), [1, 2]).select("doc_id")),
    "f24_other_conditions": _on_verdicts(lambda v: J.differing_conditions(v.select(F.concat_ws("-", "doc_id", "nr").alias("id"), "status", "before", "ref"), v.select(F.concat_ws("-", "doc_id", "nr").alias("id"), F.col("other").alias("status"), "before", F.lit("E").alias("ref")), "id")),
    "u6_hints_of_both": _on_audit(lambda v, p, r, c: P.hints_of_both(_noted(R.reason_hints(v.filter("p < 0.5"), p, c, v.limit(0))), _noted(R.reason_hints(v, p, c, v.limit(0))))),
    "l1_verdicts": _on_audit(lambda v, p, r, c: A.verdicts(A.verdict_prompts(c, v, p, 3), p, A.ByLength())),
    "l9_judged_pairs": _on_passages(lambda p: A.judged_pairs(p.select("doc_id", "nr", "rank", F.col("text").alias("prompt")), A.ByLength(7, "too long")).select("doc_id", "nr", "rank", F.col("value").cast("double").alias("value"), "error")),
    "k14_cases": _on_audit(_cases),
    "s18_sections_seen": _on_passages(lambda p: p.groupBy("doc_id").agg(F.count_distinct("page", F.substring("text", 1, 40)).alias("sections"), F.count("*").alias("passages"))),
    "p6_bullets": _on_passages(lambda p: p.select("doc_id", "nr", "rank", F.posexplode(R.split_sentences(F.col("text"))).alias("pos", "sentence"))),
    "f1_contents": _on_passages(lambda p: p.select("doc_id", "nr", "rank", R.is_contents(F.col("text")).alias("is_contents"))),
    "f7_cost_sentences": _on_passages(lambda p: R.sentence_signs(p).drop("page", "score")),
    "f8_cost_criteria": _on_requirements(R.cost_criteria),
    "f9_bought_in": lambda spark, sf_dir: R.bought_in_criteria(I.criteria(spark, sf_dir)),
    "f10_placeholders": lambda spark, sf_dir: R.placeholders(I.criteria(spark, sf_dir)),
    "f11_open_criteria": _on_requirements(R.open_criteria),
    "f12_procurement_words": _on_reasoned(lambda v: v.select("doc_id", "nr", F.array_join(R.procurement_words(F.col("reason")), ",").alias("words")).filter("words <> ''")),
    "f13_negated_hints": _on_reasoned(lambda v: v.select("doc_id", "nr", R.matches(F.col("reason"), L.NEGATED_HINT).alias("negated"))),
    "f14_affected_criteria": _on_requirements(lambda r: r.filter((F.col("field") == "required") & R.matches(F.col("text"), L.AFFECTED)).groupBy("nr").agg(F.count("*").alias("n"))),
    "f15_f16_reason_signs": _on_reasoned(lambda v: v.select("doc_id", "nr", F.array_join(R.reason_signs(F.col("reason")), ",").alias("signs"))),
    "f17_evidence": _on_audit(lambda v, p, r, c: R.with_evidence(R.parsed(v), p)),
    "f18_failures": _on_reasoned(E.failures),
    "f19_grounded": _on_audit(lambda v, p, r, c: R.grounded(v.select("doc_id", "nr", F.col("reason").alias("hint")), p)),
    "f20_echoes": _on_audit(lambda v, p, r, c: R.echoes(v, p, r)),
    "p7_unit_values": _on_passages(lambda p: R.text_values(p, "doc_id", "nr", "rank").drop("pos")),
    "p9_materials": _on_passages(lambda p: p.select("doc_id", "nr", "rank", F.array_join(R.materials(F.col("text")), ",").alias("materials")).filter("materials <> ''")),
    "p10_page_numbers": _on_reasoned(lambda v: v.select("doc_id", "nr", F.array_join(R.page_numbers(F.col("evidence")), ",").alias("pages"))),
    "p12_parsed_answers": _on_reasoned(lambda v: R.parsed(v).select("doc_id", "nr", "said.status", "said.reason", "said.evidence", "unreadable")),
    "p13_status_shares": _on_verdicts(lambda v: R.status_shares(I.tokens(v))),
    "p14_without_thoughts": _on_reasoned(lambda v: v.select("doc_id", "nr", F.length(R.without_thoughts(F.col("answer"))).alias("n"))),
    "p16_words": _on_reasoned(lambda v: v.select("doc_id", "nr", F.size(R.words_of(F.col("reason"), 3)).alias("n3"), F.size(R.words_of(F.col("reason"), 5)).alias("n5"))),
    "p20_statements": _on_requirements(lambda r: r.withColumn("t", F.trim("text")).filter("t <> ''").groupBy("nr", "field").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"))),
    "a10_vendor_sentences": _on_audit(lambda v, p, r, c: R.assigned(R.sentence_signs(p), "binding", R.bought_in_criteria(c), only=True)),
    "a10_cost_sentences": _on_audit(lambda v, p, r, c: R.assigned(R.sentence_signs(p), "cost", R.cost_criteria(r))),
    "a11_standard_ranges": _on_requirements(R.standard_ranges),
    "a11_standard_materials": _on_requirements(lambda r: R.standard_materials(r).select("nr", F.array_join("materials", ",").alias("materials"))),
    "a12_value_signs": _on_audit(lambda v, p, r, c: R.value_signs(p, r)),
    "a18_regulated_share": _on_verdicts(D.regulated_share),
    "k7_share_attached": _on_verdicts(D.share_attached),
    "k13_reason_hints": _on_audit(lambda v, p, r, c: R.reason_hints(v, p, c, v.limit(0))),
    "a9_stability": _on_verdicts(E.stability),
    "x1_sections_kept": _on("documents", lambda d: T.sections(d).groupBy("doc_id").agg(F.count("*").alias("sections"), F.count_if(~R.is_contents(F.col("text"))).alias("kept"))),
    "x6_archive_passages": _on("documents", S.archive_passages),
    "x9_comparable": _on("embeddings", lambda d: S.comparable(d, LEAST)),
    "v1_violations": _on_audit(lambda v, p, r, c: P.violations(v, c)),
    "j11_run_differences": _on_verdicts(E.run_differences),
    "f6_binding_sentences": _on("documents", V.binding_sentences),
    "a10_sentence_assignment": _on("documents", V.sentence_assignment),
    "p15_hard_facts": _on("documents", V.hard_facts),
    "a11_value_ranges": _with_labels(V.value_ranges),
    "a12_out_of_range": _with_labels(V.out_of_range),
    "p12_json_answers": _on("events", V.json_answers),
    "a20_common_titles": _on("documents", V.common_titles),
    "a22_topic_means": _on("embeddings", V.topic_means),
    "k4_softmax": _on("documents", lambda d: D.probabilities(S.features(S.candidates(d), d), FROZEN, "doc_id", "nr").drop("most")),
    "k2_train_decider": _with_labels(lambda d, labels: _trained(d, labels)),
    "s11_archive": _on("documents", V.archive),
    "x5_slots": _on("documents", V.slots),
    "a19_regulated_by": _on_verdicts(V.regulated_by),
    "p19_renumbered": _on_verdicts(V.renumbered),
    "liveness": _on("events", V.liveness),
    "sessions": _on("events", V.sessions),
    **running.QUERIES,
    **building.QUERIES,
    **grounded.QUERIES,
    **measured.QUERIES,
    **imported.QUERIES,
}

ORACLES: dict[str, str] = sql.oracles(L.FUNCTION_WORDS, K, LEAST)
ORACLES |= running.oracles(ORACLES["s11_archive"], lambda source: sql._sections(K, source), rules_sql.is_contents)
ORACLES |= building.oracles(ORACLES["p2_paged_sections"], ORACLES["p5_headings"])
ORACLES |= grounded.oracles()
ORACLES |= measured.oracles(sql._V, ORACLES["x13_reference_examples"])
ORACLES |= imported.oracles()
ORACLES["p3_chapter_chunks"] = ORACLES["p3_chapter_sections"]
ORACLES |= grounded.readers(f"WITH {sql._V}", ORACLES)
