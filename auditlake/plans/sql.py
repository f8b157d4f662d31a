"""The same questions in SQL for DuckDB."""

from __future__ import annotations

from .. import words as L
from ..operators import evidence as V
from . import rules_sql as Q
from . import template_sql as T

_V = """
e AS (SELECT user_id AS doc_id, CAST(event_id % 67 AS INTEGER) AS nr, event_type, value, event_id FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 67 ORDER BY ts DESC, event_id DESC) = 1),
c AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM e),
v AS (SELECT doc_id, nr, ['mandatory', 'regular', 'optional'][nr % 3 + 1] AS klass,
      CASE event_type WHEN 'view' THEN 'E' WHEN 'click' THEN 'T' WHEN 'error' THEN 'A' WHEN 'purchase' THEN 'N' END AS status,
      CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'E' END AS before,
      CASE WHEN cents % 11 <> 0 THEN ['E', 'T', 'A', 'N'][cents % 4 + 1] END AS ref,
      ['E', 'T', 'A', 'N'][(cents + event_id % 3) % 4 + 1] AS other, round((cents % 1000) / 1000.0, 3) AS p FROM c),
m AS (SELECT *, coalesce(status = 'A' AND before IS NOT NULL AND before <> 'A', false) AS flagged FROM v),
ms AS (SELECT *, CASE WHEN flagged THEN before ELSE status END AS model_status FROM m)"""


SENTENCES = f"""WITH g AS (SELECT doc_id, {Q.sentences('text')} AS s FROM documents),
sent AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM g))"""
NUMBERS = r"""WITH f AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)*') AS r FROM documents),
g AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, r[i] AS raw FROM (SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS i FROM f)),
num AS (SELECT doc_id, pos, raw, TRY_CAST(CASE WHEN regexp_full_match(raw, '0[.,][0-9]+') THEN replace(raw, ',', '.') WHEN regexp_full_match(raw, '[0-9]{1,3}(\.[0-9]{3})+') THEN replace(raw, '.', '')
  WHEN regexp_full_match(raw, '[0-9]{1,3}(,[0-9]{3}){2,}') THEN replace(raw, ',', '') ELSE replace(raw, ',', '.') END AS DOUBLE) AS value FROM g)"""


def _weights(damage: dict) -> str:
    return "w AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{f}', {w})" for (r, f), w in damage.items()) + ") AS t(ref, found, weight))"


def _sections(k, source: str = "documents") -> str:
    """Sections by three folds, as in the DataFrame version."""
    return f"""
b0 AS (SELECT doc_id, list_reduce(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')),
       lambda acc, line: CASE
         WHEN length(line) = 0 THEN {{'done': CASE WHEN acc.n > 0 THEN list_append(acc.done, acc.open) ELSE acc.done END, 'open': '', 'n': 0}}
         WHEN acc.n + length(line) + 1 >= {k.SECTION_TARGET} THEN {{'done': list_append(acc.done, CASE WHEN acc.n = 0 THEN line ELSE acc.open || ' ' || line END), 'open': '', 'n': 0}}
         ELSE {{'done': acc.done, 'open': CASE WHEN acc.n = 0 THEN line ELSE acc.open || ' ' || line END, 'n': CAST(acc.n + length(line) + 1 AS INTEGER)}} END,
       {{'done': CAST([] AS VARCHAR[]), 'open': '', 'n': 0}}) AS acc FROM {source}),
b1 AS (SELECT doc_id, CASE WHEN acc.n > 0 THEN list_append(acc.done, acc.open) ELSE acc.done END AS blocks FROM b0),
b2 AS (SELECT doc_id, flatten(list_transform(blocks, lambda b: list_transform(range(0, greatest(length(b) - 1, 0) // {k.SECTION_MAX} + 1), lambda i: trim(substr(b, i * {k.SECTION_MAX} + 1, {k.SECTION_MAX}), ' ')))) AS pieces FROM b1),
b3 AS (SELECT doc_id, list_reduce(pieces, lambda acc, p: CASE
         WHEN acc.last IS NOT NULL AND (length(p) < {k.SECTION_MIN} OR length(acc.last) < {k.SECTION_MIN}) THEN {{'done': acc.done, 'last': acc.last || ' ' || p}}
         ELSE {{'done': CASE WHEN acc.last IS NULL THEN acc.done ELSE list_append(acc.done, acc.last) END, 'last': p}} END,
       {{'done': CAST([] AS VARCHAR[]), 'last': CAST(NULL AS VARCHAR)}}) AS acc FROM b2),
b4 AS (SELECT doc_id, list_filter(CASE WHEN acc.last IS NULL THEN acc.done ELSE list_append(acc.done, acc.last) END, lambda x: length(x) >= {k.SECTION_MIN}) AS parts FROM b3),
sec AS (SELECT doc_id, 1 AS page, CAST(i - 1 AS INTEGER) AS section_idx, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM b4))"""


def _vectors(k) -> str:
    """Vectors of sections and of the catalogue, cosines and lexical scores."""
    more = lambda nr, title: k.DICTIONARY[nr][1] if k.DICTIONARY.get(nr, ("",))[0] == title else []
    rows = ", ".join(f"({nr}, '{title}. {', '.join(terms)}', [{', '.join(repr(t) for t in [*terms, *more(nr, title)])}])" for nr, title, terms in k.CATALOGUE)
    return f"""
cat AS (SELECT * FROM (VALUES {rows}) AS t(nr, query, terms)),
sk AS (SELECT doc_id, section_idx, (unicode(substr(text, i, 1)) * 31 + unicode(substr(text, i + 1, 1))) % 64 AS k FROM (SELECT *, unnest(range(1, length(text))) AS i FROM sec)),
sn AS (SELECT doc_id, section_idx, k, count(*)::DOUBLE AS n FROM sk GROUP BY ALL),
sl AS (SELECT doc_id, section_idx, sqrt(sum(n * n)) + 1e-10 AS l FROM sn GROUP BY ALL),
ck AS (SELECT nr, (unicode(substr(query, i, 1)) * 31 + unicode(substr(query, i + 1, 1))) % 64 AS k FROM (SELECT *, unnest(range(1, length(query))) AS i FROM cat)),
cn AS (SELECT nr, k, count(*)::DOUBLE AS n FROM ck GROUP BY ALL),
cl AS (SELECT nr, sqrt(sum(n * n)) + 1e-10 AS l FROM cn GROUP BY ALL),
dots AS (SELECT doc_id, section_idx, nr, sum(sn.n * cn.n) AS d FROM sn JOIN cn USING (k) GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS sections FROM sec GROUP BY doc_id),
kept AS (SELECT * FROM sec WHERE NOT {Q.is_contents('text')}),
cosines AS (SELECT s.doc_id, s.section_idx, cat.nr, cat.terms, s.text, coalesce(d, 0) / sl.l / cl.l AS cos FROM kept s JOIN sl USING (doc_id, section_idx) CROSS JOIN cat JOIN cl ON cl.nr = cat.nr
            LEFT JOIN dots ON dots.doc_id = s.doc_id AND dots.section_idx = s.section_idx AND dots.nr = cat.nr),
lexed AS (SELECT doc_id, nr, section_idx, cos, least(len(list_filter(terms, lambda t: CASE WHEN length(t) <= 3
          THEN contains(' ' || regexp_replace(lower(text), '[^0-9a-zäöüß]', ' ', 'g') || ' ', ' ' || t || ' ') ELSE contains(lower(text), t) END)) / 3.0, 1.0) AS lex FROM cosines),
ranked AS (SELECT *, {1 - k.LEXICAL_WEIGHT} * cos + {k.LEXICAL_WEIGHT} * lex AS score FROM lexed),
best AS (SELECT *, greatest({k.CANDIDATES}, least({k.CANDIDATES_MAX}, (SELECT sections FROM sizes WHERE sizes.doc_id = ranked.doc_id) // {k.SECTIONS_A_SLOT})) AS slots, row_number() OVER (PARTITION BY doc_id, nr ORDER BY round(score, 9) DESC, section_idx) AS rank FROM ranked WHERE score >= {k.MIN_SCORE}),
cand AS (SELECT doc_id, nr, CAST(rank AS INTEGER) AS rank, section_idx, round(cos, 6) AS cos, round(lex, 6) AS lex, round(score, 6) AS score FROM best WHERE rank <= slots)"""


def _pairs() -> str:
    return """
nv AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))) + 1e-10)) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, q.label AS query_label, r.vec_id, r.label, list_dot_product(q.v, r.v) AS cos, round(list_dot_product(q.v, r.v), 9) AS s FROM nv q JOIN nv r ON q.vec_id % 100 = 0)"""


def oracles(frequent: list[str], k, least: float) -> dict[str, str]:
    v, w, sec, vec, pairs = f"WITH {_V}", _weights(k.DAMAGE), f"WITH {_sections(k)}", _vectors(k), f"WITH {_pairs()}"
    known = "(SELECT * FROM ms WHERE ref IS NOT NULL AND model_status IS NOT NULL)"
    share = lambda a, b: f"round(CASE WHEN {b} <> 0 THEN ({a})::DOUBLE / {b} END, 6)"
    place = f"""
r AS (SELECT * FROM v WHERE ref IS NOT NULL AND ref <> 'N'), corpus AS (SELECT count(DISTINCT doc_id) - 1 AS corpus FROM r), per AS (SELECT nr, count(*) AS n FROM r GROUP BY nr),
pl AS (SELECT doc_id, nr, status, coalesce(n, 0) - CASE WHEN ref IS NOT NULL AND ref <> 'N' THEN 1 ELSE 0 END AS regulating, corpus FROM v LEFT JOIN per USING (nr) CROSS JOIN corpus),
ps AS (SELECT *, coalesce(CASE WHEN corpus <> 0 THEN regulating::DOUBLE / corpus END, 0.0) AS s FROM pl),
placed AS (SELECT doc_id, nr, status, regulating, corpus, round(s, 6) AS share, CASE WHEN status IS NULL THEN 'unremarkable' WHEN status = 'N' AND s >= {k.ESTABLISHED} THEN 'gap'
  WHEN status <> 'N' AND s <= {k.RARE} THEN 'rare' WHEN status <> 'N' AND s >= {k.ESTABLISHED} THEN 'usual' ELSE 'unremarkable' END AS placed FROM ps)"""
    steps = ", ".join(map(str, k.EMPHASIS))
    rank = f"""f AS (SELECT a::DOUBLE AS fa, b::DOUBLE AS fn FROM (SELECT unnest([{steps}]) AS a) CROSS JOIN (SELECT unnest([{steps}]) AS b)),
r AS (SELECT ref, 'a model' AS run, model_status AS found FROM {known} UNION ALL SELECT ref, 'b other', other FROM {known} UNION ALL SELECT ref, 'c always E', 'E' FROM {known}),
d AS (SELECT fa, fn, run, round(sum(least(1.0, weight::DOUBLE * CASE w.ref WHEN 'A' THEN fa WHEN 'N' THEN fn ELSE 1.0 END)), 6) AS damage FROM r JOIN w ON r.ref = w.ref AND r.found = w.found CROSS JOIN f GROUP BY ALL)"""
    rules = Q.oracles(v, _sections(k), vec, pairs)
    why = rules.pop("a4_reasons")
    rules |= T.oracles(v, lambda source: _sections(k, source))
    feat = f"""ag AS (SELECT doc_id, nr, count(*) AS n, sum(CAST(round(score * 1000000) AS BIGINT)) FILTER (rank <= 1) AS s1, sum(CAST(round(score * 1000000) AS BIGINT)) FILTER (rank <= 3) AS s3, sum(CAST(round(score * 1000000) AS BIGINT)) FILTER (rank <= 10) AS s10,
  max(cos) AS c, max(lex) AS l, count(*) FILTER (lex > 0) AS t, count(*) FILTER (score >= {k.STRONG}) AS g FROM cand GROUP BY doc_id, nr),
ft AS (SELECT z.doc_id, cat.nr, CASE WHEN cat.nr % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS mandatory, CASE WHEN cat.nr % 3 = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS regular, CASE WHEN cat.nr % 3 = 2 THEN 1.0::DOUBLE ELSE 0.0 END AS optional,
  round(coalesce(n, 0) / 30.0, 6)::DOUBLE AS filled, coalesce(s1, 0)::DOUBLE / 1000000 AS first, ((2 * coalesce(s3, 0) + 3) // 6)::DOUBLE / 1000000 AS three, ((coalesce(s10, 0) + 5) // 10)::DOUBLE / 1000000 AS ten, coalesce(c, 0.0) AS max_cos, coalesce(l, 0.0)::DOUBLE AS max_lex,
  round(coalesce(t, 0) / 30.0, 6)::DOUBLE AS with_terms, round(coalesce(g, 0) / 30.0, 6)::DOUBLE AS strong, round(ln(1.0 + sections), 6) AS log_sections FROM sizes z CROSS JOIN cat LEFT JOIN ag ON ag.doc_id = z.doc_id AND ag.nr = cat.nr)"""
    return {
        "p1_sections": f"{sec} SELECT doc_id, page, section_idx, text FROM sec",
        **rules,
        "p6_sentences": f"{SENTENCES} SELECT doc_id, pos, sentence FROM sent",
        "p8_numbers": r"""
WITH f AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)*') AS r FROM documents),
g AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, r[i] AS raw FROM (SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS i FROM f))
SELECT doc_id, pos, raw, TRY_CAST(CASE WHEN regexp_full_match(raw, '0[.,][0-9]+') THEN replace(raw, ',', '.') WHEN regexp_full_match(raw, '[0-9]{1,3}(\.[0-9]{3})+') THEN replace(raw, '.', '')
  WHEN regexp_full_match(raw, '[0-9]{1,3}(,[0-9]{3}){2,}') THEN replace(raw, ',', '') ELSE replace(raw, ',', '.') END AS DOUBLE) AS value FROM g""",
        "f2_contents_pages": """
WITH f AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents),
g AS (SELECT doc_id, CAST(len(l) AS INTEGER) AS lines, CAST(len(list_filter(l, lambda x: regexp_matches(x, '[0-9]{1,4}$'))) AS INTEGER) AS numbered FROM f)
SELECT *, numbered >= 5 AND numbered >= 0.3 * lines AS is_toc_page FROM g""",
        "f3_junk": r"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS t, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT *, CAST(len(w) AS INTEGER) AS tokens, len(list_filter(w, lambda x: length(x) <= 2)) / greatest(len(w), 1)::DOUBLE AS short_share, length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)::DOUBLE AS digit_share FROM f)
SELECT doc_id, tokens, short_share, digit_share, regexp_matches(text, '\.{4,}') OR regexp_matches(lower(text), '"""
        + "|".join(f"{c}{{5,}}" for c in "abcdefghijklmnopqrstuvwxyzäöüß")
        + """') OR tokens < 5 OR short_share > 0.35 OR digit_share > 0.18 AS is_junk FROM g""",
        "f4_readability": f"""
WITH f AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-zäöüß]+'), lambda x: length(x) >= 2) AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CASE WHEN len(w) < 15 THEN 0.0 ELSE round(len(list_filter(w, lambda x: list_contains({frequent!r}, x)))::DOUBLE / greatest(len(w), 1), 6) END AS readability FROM f""",
        "x4_hybrid_search": f"{sec}, {vec} SELECT * FROM cand",
        "k1_features": f"{sec}, {vec}, {feat} SELECT * FROM ft",
        "j8_residual_sections": f"""{sec}, {vec} SELECT doc_id, section_idx, CAST(length(text) AS INTEGER) AS n_chars FROM sec s WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.doc_id = s.doc_id AND c.section_idx = s.section_idx)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, section_idx) <= {k.RESIDUAL_SECTIONS}""",
        "a16_mean_similarity": f"""{sec}, {vec} SELECT doc_id, round(avg(cos), 6) AS mean_cos, CASE WHEN avg(cos) < {k.QUALITY_WEAK} THEN 'weak' WHEN avg(cos) < {k.QUALITY_MEDIUM} THEN 'medium' ELSE 'good' END AS class FROM cosines GROUP BY doc_id""",
        "x6_archive_search": f"""{pairs}, own AS (SELECT * FROM pairs WHERE vec_id <> query_id AND cos >= {least} QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, vec_id) <= {k.ARCHIVE_PER_DOC})
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank, vec_id, label, round(cos, 6) AS cos FROM own QUALIFY rank <= {k.ARCHIVE_N}""",
        "x7_cross_references": f"""{pairs} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank, vec_id, label, round(cos, 6) AS cos
FROM pairs WHERE label <> query_label AND cos >= {least} QUALIFY rank <= {k.CROSS_N}""",
        "x8_document_ranking": f"""{pairs}, p AS (SELECT * FROM pairs WHERE vec_id <> query_id AND label <> query_label),
fw AS (SELECT query_label, label, avg(b) AS forward, count(*) FILTER (b >= {k.PAIR_MIN}) AS strong FROM (SELECT query_label, label, query_id, max(cos) AS b FROM p GROUP BY ALL) GROUP BY ALL),
rw AS (SELECT label, vec_id, query_label, max(cos) AS b FROM p GROUP BY ALL),
us AS (SELECT r.*, coalesce((SELECT avg(o.b) FROM rw o WHERE o.vec_id = r.vec_id AND o.query_label <> r.query_label), 0.0) AS usual FROM rw r),
bw AS (SELECT label, query_label, avg(b - usual) AS backward, avg(b) AS back, count(*) AS size FROM us GROUP BY ALL)
SELECT query_label, label, round(forward, 6) AS forward, round(backward, 6) AS backward, round((forward + back) / 2, 6) AS raw, strong, size, CAST(row_number() OVER (PARTITION BY query_label ORDER BY round((forward + backward) / 2, 9) DESC, label) AS INTEGER) AS rank FROM fw JOIN bw USING (label, query_label)""",
        "x9_comparable": f"""{pairs}, n AS (SELECT label AS query_label, count(*) AS queries FROM nv WHERE vec_id % 100 = 0 GROUP BY ALL), c AS (SELECT query_label, count(DISTINCT query_id) AS comparable FROM pairs WHERE label <> query_label AND cos >= {least} GROUP BY ALL)
SELECT query_label, queries, coalesce(comparable, 0) AS comparable FROM n LEFT JOIN c USING (query_label)""",
        "x6_archive_passages": f"""{sec}, {vec}, ar AS (SELECT doc_id, nr, section_idx, round({1 - k.ARCHIVE_WEIGHT} * cos + {k.ARCHIVE_WEIGHT} * lex, 9) AS s, {1 - k.ARCHIVE_WEIGHT} * cos + {k.ARCHIVE_WEIGHT} * lex AS raw FROM lexed JOIN sec USING (doc_id, section_idx) WHERE length(trim(text, ' ')) >= {k.ARCHIVE_MIN_CHARS}),
ow AS (SELECT * FROM ar WHERE raw >= {k.ARCHIVE_MIN_SCORE} QUALIFY row_number() OVER (PARTITION BY nr, doc_id ORDER BY s DESC, section_idx) <= {k.ARCHIVE_PER_DOC})
SELECT nr, CAST(row_number() OVER (PARTITION BY nr ORDER BY s DESC, doc_id, section_idx) AS INTEGER) AS rank, doc_id, section_idx, round(s, 6) AS score FROM ow QUALIFY rank <= {k.ARCHIVE_N}""",
        "x9_best_pairs": f"""{pairs}, b AS (SELECT * FROM pairs WHERE label <> query_label AND cos >= {least} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) = 1)
SELECT query_id, vec_id, round(cos, 6) AS cos FROM b ORDER BY s DESC, query_id LIMIT {k.PAIR_MAX}""",
        "a1_kpis": f"""{v}, k AS (SELECT doc_id, count(*) FILTER (model_status = 'E') AS n_e, count(*) FILTER (model_status = 'T') AS n_t, count(*) FILTER (model_status = 'A') AS n_a, count(*) FILTER (model_status = 'N') AS n_n,
count(*) FILTER (status IS NULL) AS unrated, count(*) FILTER (flagged) AS marked FROM ms GROUP BY doc_id), r AS (SELECT *, n_e + n_t + n_a AS regulated FROM k)
SELECT *, {share('n_a + 0.5 * n_t', 'regulated')} AS deviation, {share('regulated', str(k.CRITERIA))} AS coverage, {share('n_e', 'regulated')} AS conformity FROM r""",
        "a3_by_class": f"{v} SELECT klass, " + ", ".join(f"count(*) FILTER (model_status = '{s}') AS n_{s.lower()}" for s in "ETAN") + " FROM (SELECT unnest(['mandatory', 'regular', 'optional']) AS klass) LEFT JOIN ms USING (klass) GROUP BY klass",
        "a4_why_not": why,
        "a5_confusion": f"{v} SELECT ref, coalesce(model_status, '-') AS found, count(*) AS n FROM ms WHERE ref IS NOT NULL GROUP BY ALL",
        "a5_regulated_scores": f"""{v}, x AS (SELECT doc_id, klass, ref <> 'N' AS want, coalesce(model_status <> 'N', false) AS got, coalesce(ref = model_status, false) AS hit FROM ms WHERE ref IS NOT NULL),
g AS (SELECT klass, doc_id, count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (want AND got) AS tp, count(*) FILTER (NOT want AND got) AS fp, count(*) FILTER (want AND NOT got) AS fn FROM x GROUP BY GROUPING SETS ((), (klass), (doc_id))),
h AS (SELECT *, coalesce(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END, 0.0) AS pr, coalesce(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, 0.0) AS rc FROM g)
SELECT klass, doc_id, n, hits, tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(coalesce(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) END, 0.0), 6) AS f1, {share('hits', 'n')} AS match FROM h""",
        "a5_baselines": f"{v} SELECT {share(chr(99) + 'ount(*) FILTER (ref = ' + repr('E') + ')', 'count(*)')} AS always_e, {share('count(*) FILTER (ref = ' + repr('N') + ')', 'count(*)')} AS always_n FROM v WHERE ref IS NOT NULL",
        "a6_mcnemar": f"""{v}, x AS (SELECT coalesce(status = ref, false) AS a, coalesce(other = ref, false) AS b FROM v WHERE ref IS NOT NULL),
c4 AS (SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM x),
x2 AS (SELECT *, coalesce(CASE WHEN only_a + only_b > 0 THEN greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b)::DOUBLE END, 0.0) AS chi2 FROM c4),
-- the upper tail of the normal distribution by Simpson's rule, from sqrt(chi2) on over ten units
sf AS (SELECT 2 * sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-((sqrt(chi2) + i * 0.0005) ** 2) / 2) / sqrt(2 * pi())) * 0.0005 / 3 AS p FROM (SELECT chi2, unnest(range(0, 20001)) AS i FROM x2)),
ex AS (SELECT least(1.0, coalesce(2 * (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0))) FROM (SELECT only_a + only_b AS n, unnest(range(0, least(only_a, only_b) + 1)) AS i FROM c4)), 1.0)) AS p_exact)
SELECT "both", only_a, only_b, neither, round(chi2, 6) AS chi2, round(p, 6) AS p, round(p_exact, 6) AS p_exact, only_a + only_b > 0 AND CASE WHEN only_a + only_b < 25 THEN p_exact ELSE p END < 0.05 AS significant FROM x2, sf, ex""",
        "a7_damage": f"""{v}, {w}, worst AS (SELECT ref, max(weight) AS worst FROM w GROUP BY ref), s AS (SELECT count(*) AS n, sum(weight) AS damage, sum(worst) AS worst FROM {known} x JOIN w ON x.ref = w.ref AND x.model_status = w.found JOIN worst ON worst.ref = x.ref)
SELECT n, round(damage::DOUBLE, 6) AS damage, {share('damage', 'n')} AS per_case, round(worst::DOUBLE, 6) AS worst, round(1 - coalesce(CASE WHEN worst <> 0 THEN damage::DOUBLE / worst END, 0.0), 6) AS goodness FROM s""",
        "a7_damage_classes": f"""{v}, {w}, g AS (SELECT CASE {' '.join(f"WHEN w.ref || w.found IN ({', '.join(repr(c) for c in cells)}) THEN '{kind}'" for kind, cells in k.ERROR_KINDS.items())} END AS kind, count(*) AS n, sum(weight)::DOUBLE AS points FROM {known} x JOIN w ON x.ref = w.ref AND x.model_status = w.found GROUP BY ALL)
SELECT kind, n, round(points, 2) AS points, round(coalesce(points / nullif(sum(points) OVER (), 0), 0.0), 6) AS share FROM g WHERE kind IS NOT NULL""",
        "a8_damage_baselines": f"""{v}, {w}, worst AS (SELECT ref, max(weight)::DOUBLE AS worst FROM w GROUP BY ref), g AS (SELECT w.found, sum(weight)::DOUBLE AS d, sum(worst) AS t FROM {known} x JOIN w ON x.ref = w.ref JOIN worst ON worst.ref = x.ref GROUP BY w.found)
SELECT found, round(d, 6) AS damage, round(1 - coalesce(d / nullif(t, 0), 0.0), 6) AS goodness FROM g""",
        "a9_sensitivity": f"{v}, {w}, {rank} SELECT fa, fn, string_agg(run, ' < ' ORDER BY damage, run) AS ranking FROM d GROUP BY ALL",
        "a9_stability": f"""{v}, {w}, {rank}, rk AS (SELECT fa, fn, string_agg(run, ' < ' ORDER BY damage, run) AS ranking FROM d GROUP BY ALL), fs AS (SELECT string_split(ranking, ' < ')[1] AS run, count(*) AS n FROM rk GROUP BY ALL)
SELECT count(*) AS variants, count(DISTINCT ranking) AS rankings, count(DISTINCT ranking) = 1 AS stable, (SELECT string_agg(run || ':' || n, ', ' ORDER BY run || ':' || n) FROM fs) AS winners FROM rk""",
        "a13_placement": f"{v}, {place} SELECT * FROM placed",
        "a14_placement_summary": f"{v}, {place} SELECT doc_id, " + ", ".join(f"count(*) FILTER (placed = '{x}') AS {x}" for x in ("gap", "rare", "usual", "unremarkable")) + ", count(*) FILTER (placed IN ('gap', 'rare')) AS notable FROM placed GROUP BY doc_id",
        "a17_class_from_frequency": f"""{v}, d AS (SELECT count(DISTINCT doc_id) AS m FROM v WHERE ref IS NOT NULL), n AS (SELECT nr, count(*) FILTER (ref IN ('E', 'T', 'A')) AS n FROM v GROUP BY nr)
SELECT nr, n, m, CASE WHEN n * 18 >= 14 * m THEN 'mandatory' WHEN n * 18 >= 8 * m THEN 'regular' ELSE 'optional' END AS klass FROM n CROSS JOIN d""",
        "a18_deviation_share": f"""{v}, r AS (SELECT * FROM v WHERE ref IS NOT NULL)
SELECT a.doc_id, a.nr, round(coalesce(count(*) FILTER (b.ref = 'A')::DOUBLE / nullif(count(b.ref), 0), 0.0), 4) AS share_a FROM r a LEFT JOIN r b ON a.nr = b.nr AND a.doc_id <> b.doc_id GROUP BY a.doc_id, a.nr""",
        "a24_fingerprint": f"{v} SELECT doc_id, left(sha256(string_agg(lpad(nr::VARCHAR, 3, '0') || '=' || coalesce(status, '-'), ';' ORDER BY nr)), 16) AS print FROM v GROUP BY doc_id",
        "j11_run_differences": f"""{v}, a AS (SELECT doc_id, nr, status AS old FROM v WHERE status IS NOT NULL), b AS (SELECT doc_id, nr, other AS new FROM v WHERE p >= 0.05)
SELECT doc_id, nr, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old = new THEN 'same' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b USING (doc_id, nr)""",
        "f6_binding_sentences": f"{SENTENCES} SELECT doc_id, pos, sentence FROM sent WHERE regexp_matches(lower(sentence), '{V.NAMES}') AND regexp_matches(lower(sentence), '{V.PRESCRIBES}') AND NOT regexp_matches(lower(sentence), '{V.LEAVES_OPEN}')",
        "a10_sentence_assignment": f"""{SENTENCES}, cat AS (SELECT * FROM (VALUES {", ".join(f"({nr}, {t!r})" for nr, _, t in k.CATALOGUE)}) AS t(nr, terms)),
fit AS (SELECT doc_id, pos, nr, least(len(list_filter(terms, lambda t: CASE WHEN length(t) <= 3 THEN contains(' ' || regexp_replace(lower(sentence), '[^0-9a-zäöüß]', ' ', 'g') || ' ', ' ' || t || ' ') ELSE contains(lower(sentence), t) END)) / 3.0, 1.0) AS lex FROM sent CROSS JOIN cat),
b AS (SELECT * FROM fit WHERE lex > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY lex DESC, nr) = 1)
SELECT doc_id, nr, pos, round(lex, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, nr ORDER BY pos) = 1""",
        "p15_hard_facts": f"""WITH f AS (SELECT doc_id, regexp_extract_all(regexp_replace(' ' || coalesce(text, '') || ' ', '([^0-9A-Za-z_ÄÖÜäöüß.,])', '\\1\\1', 'g'), '[^0-9A-Za-z_ÄÖÜäöüß]([A-ZÄÖÜ]{{3,}}[0-9]*|[0-9][0-9.,]{{2,}}[0-9])[^0-9A-Za-z_ÄÖÜäöüß]', 1) AS r FROM documents),
g AS (SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS i FROM f), h AS (SELECT doc_id, i, r[i] AS x FROM g WHERE NOT list_contains({[*L.EVERYDAY]!r}, upper(r[i])) QUALIFY row_number() OVER (PARTITION BY doc_id, upper(x) ORDER BY i) = 1)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_facts, string_agg(x, ' ' ORDER BY i) AS facts FROM h GROUP BY doc_id""",
        "a11_value_ranges": f"{NUMBERS} SELECT lang, min(value) AS low, max(value) AS high, count(*) AS n FROM num JOIN documents USING (doc_id) WHERE value IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang",
        "a12_out_of_range": f"""{NUMBERS}, r AS (SELECT lang, min(value) AS low, max(value) AS high FROM num JOIN documents USING (doc_id) WHERE value IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang)
SELECT doc_id, raw, value FROM num JOIN documents USING (doc_id) JOIN r USING (lang) WHERE value < low OR value > high QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1""",
        "p12_json_answers": "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL",
        "a20_common_titles": """WITH t AS (SELECT source, string_split(text, chr(10))[1] AS title, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT source, title, n FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, length(title), title) = 1""",
        "a22_topic_means": "SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL",
        "s11_archive": _archive(k),
        "x5_slots": f"{sec} SELECT doc_id, count(*) AS sections, CAST(greatest({k.CANDIDATES}, least({k.CANDIDATES_MAX}, count(*) // {k.SECTIONS_A_SLOT})) AS INTEGER) AS slots FROM sec GROUP BY doc_id",
        "k4_softmax": _softmax(f"{sec}, {vec}, {feat}", k),
        "a19_regulated_by": f"{v} SELECT nr, doc_id, count(*) OVER (PARTITION BY nr) AS n FROM v WHERE ref IN ('E', 'T', 'A')",
        "p19_renumbered": f"""{v}, s AS (SELECT doc_id, nr, klass, min(nr) OVER (PARTITION BY doc_id, klass) AS start FROM v)
SELECT doc_id, nr, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY start) AS INTEGER) AS chapter, CAST(row_number() OVER (PARTITION BY doc_id, klass ORDER BY nr) AS INTEGER) AS position FROM s""",
        "liveness": f"""WITH l AS (SELECT user_id, max(ts) AS last, count(*) AS n FROM events GROUP BY user_id), x AS (SELECT user_id, n, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(last)) // 1000000 AS silent_s FROM l)
SELECT user_id, silent_s, CASE WHEN silent_s < CASE WHEN n > 1 THEN {k.SILENCE_S} ELSE {k.START_S} END THEN 'running' ELSE 'dead' END AS state FROM x""",
        "sessions": """WITH s AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events),
k AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s), n AS (SELECT user_id, k, count(*) AS n FROM k GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY user_id""",
    }


def _archive(k) -> str:
    return f"""WITH {_sections(k)}, g AS (SELECT doc_id, length(trim(text, ' ')) < {k.ARCHIVE_MIN_CHARS} AS short, {Q.is_contents('text')} AS contents FROM sec)
SELECT doc_id, count(*) FILTER (NOT short AND NOT contents) AS kept, count(*) FILTER (short) AS short, count(*) FILTER (NOT short AND contents) AS contents FROM g GROUP BY doc_id"""


def _softmax(prefix: str, k) -> str:
    names = ["mandatory", "regular", "optional", "filled", "first", "three", "ten", "max_cos", "max_lex", "with_terms", "strong", "log_sections"]
    z = ", ".join(f"{b} + " + " + ".join(f"({w}) * {x}" for w, x in zip(c, names)) + f" AS z_{s.lower()}" for s, (b, c) in k.FROZEN.items())
    return f"""{prefix}, z AS (SELECT doc_id, nr, {z} FROM ft),
x AS (SELECT *, greatest(z_e, z_t, z_a, z_n) AS top FROM z), e AS (SELECT *, exp(z_e - top) AS e, exp(z_t - top) AS t, exp(z_a - top) AS a, exp(z_n - top) AS n FROM x)
SELECT doc_id, nr, round(e / (e + t + a + n), 4) AS p_e, round(t / (e + t + a + n), 4) AS p_t, round(a / (e + t + a + n), 4) AS p_a, round(n / (e + t + a + n), 4) AS p_n FROM e"""
