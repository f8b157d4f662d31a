"""Outlines, templates and reports in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from .. import config as K
from .. import words as L
from ..operators import template as M
from ..sources import standins as S
from .rules_sql import _E, _filled, _list, _one_of, _reasoned, has, is_contents, page_numbers, q, words

_LINES = f"""{_E},
ol AS (SELECT doc_id, event_id, k, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i FROM ev),
lns AS (SELECT doc_id, CAST(i // 25 + 1 AS INTEGER) AS page, CAST(i % 25 AS INTEGER) AS line, {_filled(_one_of(S.LINES, 'event_id * 5 % 967'), a='(i // 9 + 1)', b='(i % 9 + 1)', k='k')} AS text FROM ol)"""

_FOLLOWS = f"""CASE WHEN len(a.last) = 0 THEN len(x.n) <= 2 AND x.n[1] BETWEEN 1 AND {M.JUMP} AND list_min(x.n) >= 1 WHEN len(x.n) = len(a.last) + 1 AND x.n[1:len(a.last)] = a.last THEN x.n[len(x.n)] BETWEEN 1 AND 2
 ELSE coalesce(len(x.n) <= len(a.last) AND x.n[1:len(x.n) - 1] = a.last[1:len(x.n) - 1] AND x.n[len(x.n)] > a.last[len(x.n)] AND x.n[len(x.n)] <= a.last[len(x.n)] + {M.JUMP}, false) END"""


def _letters(t: str) -> str:
    return f"length(regexp_replace({t}, '[^A-Za-zÄÖÜäöüß]', '', 'g'))"


def oracles(v: str, sections: Callable[[str], str]) -> dict[str, str]:
    base, rs = f"WITH {_E}", _reasoned(v)
    title = f"trim(regexp_extract(text, {q(M.HEADING)}, 2), ' ')"
    heads = f"""{_LINES},
toc AS (SELECT doc_id, page FROM lns WHERE trim(text, ' ') <> '' GROUP BY ALL HAVING count(*) FILTER (regexp_matches(text, '(\\.{{3,}}|…|\\s)\\s*[0-9]{{1,3}}\\s*$')) >= 5 AND count(*) FILTER (regexp_matches(text, '(\\.{{3,}}|…|\\s)\\s*[0-9]{{1,3}}\\s*$')) >= 0.3 * count(*)),
hc0 AS (SELECT doc_id, page, line, regexp_extract(text, {q(M.HEADING)}, 1) AS number, {title} AS title FROM lns WHERE regexp_matches(text, {q(M.HEADING)}) AND NOT EXISTS (SELECT 1 FROM toc WHERE toc.doc_id = lns.doc_id AND toc.page = lns.page)),
hc AS (SELECT *, list_transform(string_split(number, '.'), lambda z: CAST(z AS INTEGER)) AS n FROM hc0 WHERE regexp_matches(title, '[A-Za-zÄÖÜäöüß]{{4,}}') AND NOT regexp_matches(title, '(\\.{{3,}}|…|\\s[0-9]{{1,3}})\\s*$') AND {_letters('title')} >= 3 AND {_letters('title')} >= 0.6 * length(replace(title, ' ', ''))),
hl AS (SELECT doc_id, list({{'page': page, 'line': line, 'number': number, 'title': title, 'n': n}} ORDER BY page, line) AS c FROM hc GROUP BY doc_id),
hf AS (SELECT doc_id, list_reduce(c, lambda a, x: CASE WHEN {_FOLLOWS} THEN {{'last': x.n, 'done': list_append(a.done, {{'page': x.page, 'line': x.line, 'number': x.number, 'title': x.title}})}} ELSE a END,
  {{'last': CAST([] AS INTEGER[]), 'done': CAST([] AS STRUCT(page INTEGER, line INTEGER, number VARCHAR, title VARCHAR)[])}}).done AS d FROM hl),
hd AS (SELECT doc_id, h.page AS page, h.line AS line, h.number AS number, h.title AS title FROM (SELECT doc_id, unnest(d) AS h FROM hf))"""
    runs = f"""{heads}, mk AS (SELECT l.*, h.number || ' ' || h.title AS head FROM lns l LEFT JOIN hd h USING (doc_id, page, line)),
isl AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER w, '') AS chapter, count(head) OVER w AS island FROM mk WINDOW w AS (PARTITION BY doc_id ORDER BY page, line ROWS UNBOUNDED PRECEDING)),
rn AS (SELECT doc_id, page, island, chapter, string_agg(text, chr(10) ORDER BY line) AS t FROM isl GROUP BY ALL), src AS (SELECT (doc_id * 1000 + page) * 1000 + island AS doc_id, t AS text FROM rn)"""
    tt = f"trim(regexp_replace(trim(regexp_extract(text, {q(M.TEMPLATE_HEADING)}, 2), ' '), ':+$', ''), ' ')"
    noise = f"""(len(list_filter(regexp_split_to_array({tt}, '\\s+'), lambda z: z <> '')) > 9 OR regexp_matches({tt}, '[.,;]$') OR regexp_matches({tt}, '[\\[\\]{{}}<>=]') OR {_letters(tt)} < 0.7 * length(regexp_replace({tt}, '\\s', '', 'g')) OR length(regexp_replace({tt}, '[^0-9]', '', 'g')) > 4
 OR TRY_CAST(string_split(regexp_extract(text, {q(M.TEMPLATE_HEADING)}, 1), '.')[1] AS INTEGER) > 30 OR {_letters(tt)} < 4)"""
    th = f"""{_LINES}, ti AS (SELECT *, coalesce(regexp_matches(text, {q(M.TEMPLATE_HEADING)}) AND NOT regexp_matches(text, {q(M.NO_HEADING)}) AND NOT regexp_matches(lower(text), {q(M.DATE)}) AND NOT {noise}, false) AS is_ FROM lns),
tj AS (SELECT *, sum(is_::INTEGER) OVER (PARTITION BY doc_id ORDER BY page, line) AS island FROM ti),
tk AS (SELECT doc_id, island, min(page) FILTER (is_) AS page, min(regexp_extract(text, {q(M.TEMPLATE_HEADING)}, 1)) FILTER (is_) AS number, min({tt}) FILTER (is_) AS title, CAST(sum(CASE WHEN NOT is_ THEN length(trim(text, ' ')) ELSE 0 END) AS BIGINT) AS own_chars FROM tj WHERE island > 0 GROUP BY doc_id, island),
tl AS (SELECT * FROM tk QUALIFY row_number() OVER (PARTITION BY doc_id, number, lower(title) ORDER BY island DESC) = 1),
tm0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, list_transform(string_split(number, '.'), lambda z: CAST(z AS INTEGER)), title) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM tl),
thd AS (SELECT doc_id, number, title, page, own_chars, round(i / greatest(n - 1, 1)::DOUBLE, 6) AS position, EXISTS (SELECT 1 FROM tm0 o WHERE o.doc_id = x.doc_id AND starts_with(o.number, x.number || '.')) AS container,
  coalesce(CASE WHEN contains(number, '.') THEN (SELECT arg_max(o.title, o.i) FROM tm0 o WHERE o.doc_id = x.doc_id AND o.number = regexp_replace(x.number, '\\.[0-9]+$', '')) END, '') AS parent FROM tm0 x)"""
    topic = f"array_to_string({words('title')}, ' ')"
    exc = f"""ej AS (SELECT p.doc_id, p.nr, p.page, p.text, row_number() OVER (PARTITION BY p.doc_id, p.nr ORDER BY CASE WHEN list_contains({page_numbers('r.evidence')}, CAST(p.page AS VARCHAR)) THEN 0 ELSE 1 END, rank) AS k FROM passages p JOIN rs r ON p.doc_id = r.doc_id AND p.nr = r.nr), ex AS (SELECT doc_id, nr, page, left(text, 300) AS excerpt FROM ej WHERE k = 1)"""
    w5 = lambda t: f"list_distinct(regexp_extract_all(lower(coalesce({t}, '')), '[a-zäöüß]{{5,}}'))"
    kp = """k1 AS (SELECT doc_id, count(*) FILTER (model_status = 'E') AS e, count(*) FILTER (model_status = 'T') AS t, count(*) FILTER (model_status = 'A') AS a, count(*) FILTER (model_status = 'N') AS n, count(*) FILTER (status IS NULL) AS unrated FROM ms GROUP BY doc_id)"""
    req = "rq AS (SELECT nr, count(*) FILTER (field = 'required') AS required, count(*) FILTER (field = 'variant') AS variants, arg_min(text, (field, pos)) AS text FROM reqs GROUP BY nr)"
    dic = ", ".join(f"({nr}, {q(t)}, {_list(m)})" for nr, (t, m) in S.DICTIONARY.items())
    terms = "CASE title " + " ".join(f"WHEN {q(t)} THEN {_list(m)}" for t, m in K.AUDIT_TERMS.items()) + " END"
    return {
        "p2_paged_sections": f"WITH {_LINES}, src AS (SELECT doc_id * 1000 + page AS doc_id, string_agg(text, chr(10) ORDER BY line) AS text FROM lns GROUP BY doc_id, page), {sections('src')} SELECT doc_id // 1000 AS doc_id, CAST(doc_id % 1000 AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id, section_idx) - 1 AS INTEGER) AS section_idx, text FROM sec",
        "p3_chapter_sections": f"""WITH {runs}, {sections('src')}, ps AS (SELECT doc_id // 1000000 AS doc_id, CAST(doc_id // 1000 % 1000 AS INTEGER) AS page, doc_id % 1000 AS island, section_idx AS k, text FROM sec)
SELECT ps.doc_id, CAST(row_number() OVER (PARTITION BY ps.doc_id ORDER BY ps.page, ps.island, k) - 1 AS INTEGER) AS section_idx, ps.page, chapter, CASE WHEN chapter = '' OR starts_with(text, left(chapter, 20)) THEN text ELSE '[' || left(chapter, 80) || '] ' || text END AS text FROM ps JOIN rn USING (doc_id, page, island)""",
        "p4_headings": f"WITH {heads} SELECT doc_id, page, line, number, title FROM hd",
        "p5_headings": f"WITH {th} SELECT * FROM thd",
        "a22_topics": f"""WITH {th}, tp AS (SELECT *, {topic} AS topic FROM thd), tg AS (SELECT * FROM tp WHERE NOT list_contains({_list(L.GENERIC_TITLES)}, topic) AND topic <> ''), tn AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY doc_id, number) AS k FROM tg)
SELECT topic, count(DISTINCT doc_id) AS docs, count(*) AS n, round(quantile_cont(position, 0.5), 6) AS middle, string_agg(title || ' (' || doc_id || ')', '; ' ORDER BY k) FILTER (k <= 8) AS examples FROM tn GROUP BY topic""",
        "a21_topic_parts": f"WITH {th}, tp AS (SELECT *, {topic} AS topic FROM thd), tn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, topic ORDER BY page, number, title) AS part FROM tp) SELECT topic, CAST(part AS INTEGER) AS part, count(*) AS docs FROM tn GROUP BY ALL",
        "p18_outline": f"""{base}, ch AS (SELECT chapter, min(nr) AS start, row_number() OVER (ORDER BY min(nr)) AS chapter_no FROM crit GROUP BY chapter)
SELECT nr, CAST(chapter_no AS INTEGER) AS chapter_no, CASE WHEN nr = start THEN chapter_no || ' ' || chapter || chr(10) ELSE '' END || '  ' || nr || '  ' || title || '  [' || klass || ']' AS line FROM crit JOIN ch USING (chapter)""",
        "p23_slugs": "WITH n AS (SELECT DISTINCT p_name || ' Ä/ß ' || p_type AS name FROM part) SELECT name, regexp_replace(regexp_replace(replace(replace(replace(replace(lower(trim(name, ' ')), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM n",
        "p23_document_ids": "SELECT page_id, regexp_replace(trim(regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', ''), ' '), ',[ \\t]', '_', 'g') AS id FROM pages",
        "p24_corpus_size": f"WITH {_LINES} SELECT CAST(m AS INTEGER) AS corpus, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), 'belegt in ([0-9]+) von ([0-9]+)', 2)) AS m FROM lns) GROUP BY ALL ORDER BY n DESC, corpus LIMIT 1",
        "p24_subjects": "WITH s AS (SELECT doc_id, trim(regexp_split_to_array(coalesce(text, ''), '[(,;:]| einschlie| inkl')[1], ' ') AS t FROM documents) SELECT doc_id, nullif(t, '') AS subject FROM s",
        "s10_dictionary_terms": f"""{base}, d AS (SELECT * FROM (VALUES {dic}) AS t(nr, title, more)), c AS (SELECT nr, title, {terms} AS terms FROM crit) SELECT c.nr, c.title, array_to_string(list_concat(terms, coalesce(more, [])), ',') AS terms FROM c LEFT JOIN d USING (nr, title)""",
        "j1_with_standard": f"{base}, {req} SELECT nr, title, coalesce(required, 0) AS required, coalesce(variants, 0) AS variants, title || coalesce('. ' || text, '') AS query FROM crit LEFT JOIN rq USING (nr)",
        "j11_template_changes": f"""{base}, {req}, nw AS (SELECT nr, title, klass, coalesce(required, 0) AS required FROM crit LEFT JOIN rq USING (nr) WHERE nr % 5 <> 0), od AS (SELECT nr, CASE WHEN nr % 3 = 0 THEN upper(title) ELSE title END AS title, CASE WHEN nr % 4 = 0 THEN 'optional' ELSE klass END AS klass, coalesce(required, 0) AS required FROM crit LEFT JOIN rq USING (nr) WHERE nr % 7 <> 0)
SELECT coalesce(n.nr, o.nr) AS nr, CASE WHEN o.nr IS NULL THEN 'new' WHEN n.nr IS NULL THEN 'gone' WHEN n.title IS DISTINCT FROM o.title OR n.klass IS DISTINCT FROM o.klass THEN 'changed' ELSE 'unchanged' END AS change,
CASE WHEN o.nr IS NOT NULL AND n.nr IS NOT NULL AND (n.title <> o.title OR n.klass <> o.klass) THEN array_to_string(list_filter([CASE WHEN n.title <> o.title THEN 'title' END, CASE WHEN n.klass <> o.klass THEN 'klass' END], lambda z: z IS NOT NULL), ', ') END AS fields FROM nw n FULL OUTER JOIN od o ON n.nr = o.nr""",
        "v4_import_warnings": f"""{v}, {_E} SELECT nr, 'no requirements' AS rule FROM crit WHERE nr NOT IN (SELECT nr FROM reqs WHERE field = 'required') UNION ALL SELECT nr, 'no placeholders' FROM crit WHERE len(list_filter(placeholders, lambda p: {has('p', L.PLACEHOLDER)})) = 0
UNION ALL SELECT nr, 'no reference' FROM crit WHERE nr NOT IN (SELECT nr FROM v WHERE ref IS NOT NULL) UNION ALL SELECT NULL, 'critical: no number matches' WHERE NOT EXISTS (SELECT 1 FROM crit WHERE nr IN (SELECT nr FROM v WHERE ref IS NOT NULL))""",
        "x7_statement_references": f"""{base}, c AS (SELECT nr, title, {terms} AS terms FROM crit), cq AS (SELECT nr, terms, title || '. ' || array_to_string(terms, ', ') AS t FROM c),
ch AS (SELECT nr, (unicode(substr(t, i, 1)) * 31 + unicode(substr(t, i + 1, 1))) % 64 AS k FROM (SELECT *, unnest(range(1, length(t))) AS i FROM cq)), cn AS (SELECT nr, k, count(*)::DOUBLE AS n FROM ch GROUP BY ALL), cl AS (SELECT nr, sqrt(sum(n * n)) + 1e-10 AS l FROM cn GROUP BY nr),
sh AS (SELECT pos, (unicode(substr(text, i, 1)) * 31 + unicode(substr(text, i + 1, 1))) % 64 AS k FROM (SELECT *, unnest(range(1, length(text))) AS i FROM reqs)), sn AS (SELECT pos, k, count(*)::DOUBLE AS n FROM sh GROUP BY ALL), sl AS (SELECT pos, sqrt(sum(n * n)) + 1e-10 AS l FROM sn GROUP BY pos),
dt AS (SELECT nr, pos, sum(cn.n * sn.n) AS d FROM cn JOIN sn USING (k) GROUP BY ALL),
xr AS (SELECT cq.nr, r.nr AS other, r.pos, round(dt.d / cl.l / sl.l, 9) AS cos FROM cq JOIN cl USING (nr) JOIN dt ON dt.nr = cq.nr JOIN reqs r ON r.pos = dt.pos JOIN sl ON sl.pos = r.pos
  WHERE r.nr <> cq.nr AND (len(list_filter(cq.terms, lambda z: length(z) >= {K.CROSS_TERM})) = 0 OR len(list_filter(cq.terms, lambda z: length(z) >= {K.CROSS_TERM} AND contains(lower(r.text), z))) > 0))
SELECT nr, CAST(row_number() OVER (PARTITION BY nr ORDER BY cos DESC, pos) AS INTEGER) AS rank, other, pos, round(cos, 6) AS cos FROM xr WHERE cos >= {K.CROSS_MIN} QUALIFY rank <= {K.CROSS_N}""",
        "x11_excerpts": f"{rs}, {exc} SELECT * FROM ex",
        "r1_cover": f"""{v}, {kp}, s AS (SELECT *, e + t + a AS reg, e + t + a + n AS total FROM k1)
SELECT doc_id, 'ratio' AS part, 'deviation' AS name, round((a + 0.5 * t) / nullif(reg, 0)::DOUBLE, 6) AS value FROM s UNION ALL SELECT doc_id, 'ratio', 'coverage', round(reg / {K.CRITERIA}::DOUBLE, 6) FROM s UNION ALL SELECT doc_id, 'ratio', 'conformity', round(e / nullif(reg, 0)::DOUBLE, 6) FROM s
UNION ALL SELECT doc_id, 'status', 'E', round(e / nullif(total, 0)::DOUBLE, 6) FROM s UNION ALL SELECT doc_id, 'status', 'T', round(t / nullif(total, 0)::DOUBLE, 6) FROM s UNION ALL SELECT doc_id, 'status', 'A', round(a / nullif(total, 0)::DOUBLE, 6) FROM s UNION ALL SELECT doc_id, 'status', 'N', round(n / nullif(total, 0)::DOUBLE, 6) FROM s
UNION ALL SELECT doc_id, 'class', klass || ' ' || model_status, count(*)::DOUBLE FROM ms WHERE model_status IS NOT NULL GROUP BY ALL UNION ALL SELECT doc_id, 'open', 'unrated', unrated::DOUBLE FROM s""",
        "r2_criteria_list": f"{rs}, {exc} SELECT rs.doc_id, rs.nr, title, chapter, status, evidence, excerpt FROM rs LEFT JOIN crit USING (nr) LEFT JOIN ex ON ex.doc_id = rs.doc_id AND ex.nr = rs.nr",
        "r8_model_comparison": f"""{v}, r AS (SELECT status = ref AS f, other = ref AS s, ref = 'E' AS e FROM v WHERE ref IS NOT NULL AND status IS NOT NULL AND other IS NOT NULL),
h AS (SELECT 'first run' AS run, count(*) AS n, count(*) FILTER (f) AS hits FROM r UNION ALL SELECT 'second run', count(*), count(*) FILTER (s) FROM r UNION ALL SELECT 'always E', count(*), count(*) FILTER (e) FROM r), k AS (SELECT *, CAST(row_number() OVER (ORDER BY hits DESC, run) AS INTEGER) AS rank FROM h),
lg AS (SELECT 'first run' AS run, f AS ok, row_number() OVER () AS i FROM r), b AS (SELECT run AS best FROM k WHERE rank = 1),
bx AS (SELECT f, s, e, CASE (SELECT best FROM b) WHEN 'first run' THEN f WHEN 'second run' THEN s ELSE e END AS x FROM r)
SELECT run, n, hits, round(hits / n::DOUBLE, 6) AS match, rank, CASE run WHEN 'first run' THEN (SELECT count(*) FILTER (x AND NOT f) FROM bx) WHEN 'second run' THEN (SELECT count(*) FILTER (x AND NOT s) FROM bx) ELSE (SELECT count(*) FILTER (x AND NOT e) FROM bx) END AS only_best,
CASE run WHEN 'first run' THEN (SELECT count(*) FILTER (f AND NOT x) FROM bx) WHEN 'second run' THEN (SELECT count(*) FILTER (s AND NOT x) FROM bx) ELSE (SELECT count(*) FILTER (e AND NOT x) FROM bx) END AS only_this FROM k""",
        "j10_reference_distribution": f"""{v}, a AS (SELECT nr, count(*) FILTER (ref = 'E') AS e, count(*) FILTER (ref = 'T') AS t, count(*) FILTER (ref = 'A') AS a FROM v GROUP BY nr)
SELECT doc_id, nr, e - CASE WHEN ref = 'E' THEN 1 ELSE 0 END AS e, t - CASE WHEN ref = 'T' THEN 1 ELSE 0 END AS t, a.a - CASE WHEN ref = 'A' THEN 1 ELSE 0 END AS a FROM v JOIN a USING (nr)""",
        "x13_reference_examples": f"""{rs}, r0 AS (SELECT doc_id, nr, ref AS status, {w5('reason')} AS w, TRY_CAST(unnest(regexp_extract_all(evidence, '[0-9]+')) AS INTEGER) AS page FROM rs WHERE ref IN ('E', 'T', 'A') AND reason <> ''),
p0 AS (SELECT doc_id, nr AS of_, rank, page, {w5('text')} AS t FROM passages WHERE NOT {is_contents('text')}), sh AS (SELECT r0.doc_id, r0.nr, status, r0.page, of_, rank, len(list_intersect(w, t)) AS k FROM r0 JOIN p0 ON r0.doc_id = p0.doc_id AND r0.page = p0.page),
be AS (SELECT * FROM sh WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, nr, status ORDER BY k DESC, page, of_, rank) = 1),
g AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY nr, status ORDER BY doc_id) = 1 THEN CASE status WHEN 'E' THEN 0 WHEN 'T' THEN 1 ELSE 2 END ELSE 3 END AS g FROM be)
SELECT nr, CAST(row_number() OVER (PARTITION BY nr ORDER BY g, doc_id) AS INTEGER) AS place, doc_id, status, page FROM g QUALIFY place <= 3""",
        "v1_violations": f"""{rs}, d AS (SELECT DISTINCT doc_id FROM rs) SELECT d.doc_id, crit.nr, 'missing' AS rule FROM d CROSS JOIN crit WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.doc_id = d.doc_id AND rs.nr = crit.nr) UNION ALL SELECT doc_id, nr, 'unknown' FROM rs WHERE nr NOT IN (SELECT nr FROM crit)
UNION ALL SELECT doc_id, nr, 'illegal status' FROM rs WHERE status IS NULL UNION ALL SELECT doc_id, nr, 'N with a reason or evidence' FROM rs WHERE status = 'N' AND (reason <> '' OR evidence <> '') UNION ALL SELECT doc_id, nr, 'no reason' FROM rs WHERE status IN ('E', 'T', 'A') AND trim(reason, ' ') = ''
UNION ALL SELECT doc_id, nr, 'no evidence' FROM rs WHERE status IN ('E', 'T', 'A') AND trim(evidence, ' ') = '' UNION ALL SELECT DISTINCT doc_id, NULL::INTEGER, 'unrated' FROM rs WHERE cause NOT IN ('', 'kein Kandidat')""",
        **_jobs(v, rs),
        "u1_corpus": f"{v} SELECT nr, doc_id FROM v WHERE ref IN ('E', 'T', 'A') UNION SELECT nr, doc_id FROM v WHERE other IN ('E', 'T', 'A') AND p < 0.2",
        "u3_run_sets": f"{v}, a AS (SELECT DISTINCT nr FROM v WHERE status IS NOT NULL), b AS (SELECT DISTINCT nr FROM v WHERE p >= 0.985) SELECT nr, 'first' AS only_in FROM a WHERE nr NOT IN (SELECT nr FROM b) UNION ALL SELECT nr, 'second' FROM b WHERE nr NOT IN (SELECT nr FROM a)",
        "u4_common_documents": f"{v} SELECT doc_id FROM v WHERE status IS NOT NULL INTERSECT SELECT doc_id FROM v WHERE p >= 0.5",
        "w10_practice": f"""{v}, r AS (SELECT * FROM v WHERE ref IS NOT NULL AND ref <> 'N'), corpus AS (SELECT count(DISTINCT doc_id) - 1 AS corpus FROM r), per AS (SELECT nr, count(*) AS n FROM r GROUP BY nr),
pl AS (SELECT doc_id, nr, status, coalesce(CASE WHEN corpus <> 0 THEN (coalesce(n, 0) - CASE WHEN ref IS NOT NULL AND ref <> 'N' THEN 1 ELSE 0 END)::DOUBLE / corpus END, 0.0) AS s FROM v LEFT JOIN per USING (nr) CROSS JOIN corpus),
pk AS (SELECT doc_id, nr, round(s, 6) AS share, CASE WHEN status IS NULL THEN 'unremarkable' WHEN status = 'N' AND s >= {K.ESTABLISHED} THEN 'gap' WHEN status <> 'N' AND s <= {K.RARE} THEN 'rare' WHEN status <> 'N' AND s >= {K.ESTABLISHED} THEN 'usual' ELSE 'unremarkable' END AS placed FROM pl)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY placed NOT IN ('gap', 'rare'), share DESC, nr) AS INTEGER) AS place, nr, placed, share FROM pk""",
        "w12_context": f"{base} SELECT doc_id, nr, rank, array_to_string(list(text) OVER (PARTITION BY doc_id, nr ORDER BY rank ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), ' ') AS text FROM passages",
        "p21_density": f"{base}, g AS (SELECT doc_id, nr, count(*) AS n, count(*) FILTER (score >= {K.STRONG}) AS strong, count(DISTINCT page) AS pages FROM passages GROUP BY ALL) SELECT *, CASE WHEN strong = 0 THEN 'marginal' WHEN strong >= 3 THEN 'treated' ELSE 'some' END AS level FROM g",
        "a15_pair_summary": f"""{v}, j AS (SELECT doc_id, CASE WHEN status IS NOT NULL THEN CAST(round(p * 100) AS INTEGER) END AS value FROM v)
SELECT doc_id, ((20000 * sum(value) + count(value)) // nullif(2 * count(value), 0))::DOUBLE / 1000000.0 AS agreement, count(*) FILTER (value IS NULL) AS unrated, count(*) FILTER (value >= 90) AS identical, count(*) FILTER (value >= 60 AND value < 90) AS similar, count(*) FILTER (value >= 25 AND value < 60) AS different, count(*) FILTER (value < 25) AS unrelated FROM j GROUP BY doc_id""",
    }


def _jobs(v: str, rs: str) -> dict[str, str]:
    state = f"""st AS (SELECT user_id AS run, min(ts) AS created, max(ts) AS last, arg_max(event_type, (ts, event_id)) AS e, count(*) AS n FROM events GROUP BY user_id),
sx AS (SELECT *, CASE e WHEN 'signup' THEN 'waiting' WHEN 'click' THEN 'running' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'error' END AS said, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(last)) / 1e6 >= CASE WHEN n > 1 THEN {K.SILENCE_S} ELSE {K.START_S} END AS dead FROM st),
sr AS (SELECT run, created, last, CASE WHEN said IN ('waiting', 'running') AND dead THEN 'crashed' ELSE said END AS state FROM sx)"""
    prompt = "title || chr(10) || t"
    return {
        "m1_run_folders": f"WITH {state}, b AS (SELECT run, created, strftime(created, '%Y%m%d_%H%M') AS base FROM sr), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY created, run) AS k FROM b) SELECT run, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS folder FROM k",
        "m2_run_states": f"WITH {state} SELECT run, state FROM sr",
        "m3_newest_runs": f"WITH {state} SELECT run, state FROM sr ORDER BY created DESC, run LIMIT 10",
        "f23_training_part": "SELECT doc_id FROM documents WHERE NOT (doc_id < 200 AND doc_id % 3 = 0)",
        "f24_other_conditions": f"""{v}, d AS (SELECT doc_id || '-' || nr AS id, array_to_string(list_filter([CASE WHEN status IS DISTINCT FROM other THEN 'status' END, CASE WHEN ref IS DISTINCT FROM 'E' THEN 'ref' END], lambda z: z IS NOT NULL), ',') AS fields FROM v) SELECT * FROM d WHERE fields <> ''""",
        "l1_verdicts": f"""{rs}, pt AS (SELECT doc_id, nr, string_agg('[S' || page || '] ' || text, chr(10) ORDER BY rank) AS t, arg_min(page, rank) AS best FROM passages WHERE rank <= 3 GROUP BY ALL), pg AS (SELECT doc_id, nr, list(DISTINCT page) AS pages FROM passages GROUP BY ALL),
ls AS (SELECT d.doc_id, c.nr, length({prompt}) AS n, best, pages FROM (SELECT DISTINCT doc_id FROM rs) d CROSS JOIN crit c LEFT JOIN pt USING (doc_id, nr) LEFT JOIN pg USING (doc_id, nr))
SELECT doc_id, nr, CASE WHEN n IS NULL THEN 'N' ELSE ['E', 'T', 'A', 'N'][n % 4 + 1] END AS status, CASE WHEN n IS NULL OR n % 4 = 3 THEN '' ELSE 'length ' || n END AS reason,
CASE WHEN n IS NULL OR n % 4 = 3 THEN '' WHEN list_contains(pages, n % 40 + 1) THEN 'S' || (n % 40 + 1) ELSE 'S' || best END AS evidence, CASE WHEN n IS NULL THEN 'no candidate' ELSE '' END AS cause FROM ls""",
        "l9_judged_pairs": f"WITH {_E} SELECT doc_id, nr, rank, CASE WHEN length(text) % 7 <> 0 THEN greatest(0, least(100, length(text) % 140 - 20))::DOUBLE END AS value, CASE WHEN length(text) % 7 = 0 THEN 'too long' ELSE '' END AS error FROM passages",
        "s18_sections_seen": f"WITH {_E} SELECT doc_id, count(DISTINCT (page, left(text, 40))) AS sections, count(*) AS passages FROM passages GROUP BY doc_id",
    }
