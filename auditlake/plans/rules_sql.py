"""The questions on requirement texts in SQL for DuckDB: the same word lists, other constructions."""

from __future__ import annotations

from .. import config as K
from .. import words as L
from ..operators import decide as D
from ..sources import standins as S


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(some) -> str:
    return "[" + ", ".join(q(x) for x in some) + "]"


def _one_of(some: list[str], n: str) -> str:
    return f"{_list(some)}[(({n}) % {len(some)}) + 1]"


def _filled(text: str, **values: str) -> str:
    for k, v in values.items():
        text = f"replace({text}, '{{{k}}}', CAST({v} AS VARCHAR))"
    return text


def has(text: str, pattern: str) -> str:
    return f"regexp_matches(lower(coalesce({text}, '')), {q(pattern)})"


def sentences(text: str) -> str:
    """Sentences of a text as a list."""
    flat = f"regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g')"
    cut = f"regexp_replace(regexp_replace(regexp_replace({flat}, '([.;!?]) ', '\\1' || chr(1), 'g'), ' [•«»>▪] | - ', chr(1), 'g'), ' [e«] ([A-ZÄÖÜ])', chr(1) || '\\1', 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > 12)"


def words(text: str, least: int = 1) -> str:
    joined = f"regexp_replace(lower(coalesce({text}, '')), '([a-zäöüß])-\\s*\\n\\s*([a-zäöüß])', '\\1\\2', 'g')"
    return f"regexp_extract_all({joined}, {q(L.W + '{' + str(least) + ',}')})"


def is_cost(s: str) -> str:
    """Windows of words around each formula, from the pieces of the sentence between the formulas."""
    low = f"lower({s})"
    w = lambda t: f"regexp_extract_all({t}, {q(L.W + '+')})"
    hits, pieces = f"regexp_extract_all({low}, {q(COSTS)})", f"regexp_split_to_array({low}, {q(COSTS)})"
    left = f"array_to_string(list_transform(range(1, i + 1), lambda k: {pieces}[k] || CASE WHEN k < i THEN {hits}[k] ELSE '' END), '')"
    right = f"array_to_string(list_transform(range(i + 1, len({pieces}) + 1), lambda k: {pieces}[k] || coalesce({hits}[k], '')), '')"
    near = f"{w(right)}[1:4]"
    all_ = f"list_concat(list_concat({w(left)}[-3:], {w(f'{hits}[i]')}[-3:]), {near})"
    bears = f"len(list_filter({all_}, lambda x: regexp_matches(x, {q(L.NEGATION)}))) = 0 AND len(list_filter({near}, lambda x: regexp_matches(x, {q(L.CUSTOMER)}))) = 0"
    return f"({has(s, L.PARTY)} AND NOT {has(s, L.OFFER)} AND len(list_filter(range(1, len({hits}) + 1), lambda i: {bears})) > 0)"


def is_binding(s: str) -> str:
    return f"({has(s, L.VENDORS)} AND {has(s, L.PRESCRIBES)} AND NOT {has(s, L.LEAVES_OPEN)})"


def is_contents(t: str) -> str:
    head, p = f"lower(left(coalesce({t}, ''), 120))", q(f"(?:^|[^a-z0-9_äöüß])({L.CONTENTS_TITLE})(?:$|[^a-z0-9_äöüß])")
    hits, pieces = f"regexp_extract_all({head}, {p}, 1)", f"regexp_split_to_array({head}, {p})"
    before = f"list_filter(regexp_split_to_array(array_to_string(list_transform(range(1, i + 1), lambda k: {pieces}[k] || CASE WHEN k < i THEN ' ' || {hits}[k] ELSE '' END), ' '), '\\s+'), lambda x: x <> '')"
    last = f"trim({before}[-1], '.,;:()')"
    counts = f"CASE WHEN len({before}) = 0 THEN true WHEN list_contains({_list(L.SENTENCE_WORDS)}, {last}) THEN false ELSE {hits}[i] <> 'inhalt' END"
    lines = f"list_filter(string_split(coalesce({t}, ''), chr(10)), lambda x: trim(x, ' ') <> '')"
    rows = f"len(list_filter({lines}, lambda x: regexp_matches(x, {q(L.CONTENTS_ROW)})))"
    return f"(len(list_filter(range(1, len({hits}) + 1), lambda i: {counts})) > 0 OR CASE WHEN len({lines}) < 2 THEN {rows} = 1 ELSE {rows} >= 0.5 * len({lines}) END)"


def number(raw: str, counting: str) -> str:
    return (
        f"TRY_CAST(CASE WHEN regexp_full_match({raw}, '0[.,][0-9]+') THEN replace({raw}, ',', '.') WHEN regexp_full_match({raw}, '[0-9]{{1,3}}(\\.[0-9]{{3}})+') THEN replace({raw}, '.', '') "
        f"WHEN {counting} AND regexp_full_match({raw}, '[0-9]{{1,3}}(,[0-9]{{3}})+') THEN replace({raw}, ',', '') WHEN regexp_full_match({raw}, '[0-9]{{1,3}}(,[0-9]{{3}}){{2,}}') THEN replace({raw}, ',', '') ELSE replace({raw}, ',', '.') END AS DOUBLE)"
    )


# Fixed values, as the rules state them but for the form: words are told apart by splitting, not by edges in a pattern.
UNITS = {"schuss": "schuss|abg[üu]ss|castings?|shots?|gießzyklen|zyklen", "hübe": "hübe|hub[^a-z0-9_äöüß]|strokes?", "hrc": "hrc", "khz": "khz", "bar": "bar[^a-z0-9_äöüß]", "°c": "°\\s?c", "mm": "mm[^a-z0-9_äöüß]", "%": "%"}
COSTS = (
    "zu lasten|in rechnung gestellt|in rechnung stellt|weiterberechne|weiterrechne|angelastet|nach aktuellem stundensatz|kostenpflichtig|fester betrag|pauschal[a-z0-9_äöüß]* betrag|vertragsstrafe|pönale|"
    "kosten[a-z0-9_äöüß]*[^a-z0-9_äöüß](?:|.{0,58}[^a-z0-9_äöüß])(?:trägt|tragen|übernimmt|übernehmen|gehen)(?:[^a-z0-9_äöüß]|$)|at the expense|charged to"
)
ANYWHERE, WHOLE_WORDS = ["fabrikat", "hersteller", "lieferant", "typenbezeichnung"], ["firma", "marke"]
NORMS = ["DIN", "EN", "ISO", "VDI", "VDA", "VDE", "SEP", "ASTM", "IEC"]
DUTIES = ["nur", "ausschließlich", "ausschliesslich", "zwingend", "verpflichtet", "trägt", "übernimmt", "kosten", "garantie", "gewährleistung", "frist", "innerhalb", "spätestens", "wöchentlich", "zusätzlich", "mindestens", "maximal", "max.", "min."]


def tokens(text: str, letters: str = "a-z0-9_äöüß") -> str:
    return f"regexp_split_to_array({text}, '[^{letters}]+')"


def procurement(text: str) -> str:
    """Procurement words of a text, ascending."""
    low = f"lower(coalesce({text}, ''))"
    found = [f"CASE WHEN contains({low}, {q(w)}) THEN {q(w)} END" for w in ANYWHERE] + [f"CASE WHEN list_contains({tokens(low)}, {q(w)}) THEN {q(w)} END" for w in WHOLE_WORDS]
    found.append(f"CASE WHEN list_contains({tokens(low, 'a-z0-9_äöüß.')}, 'fa.') OR len(list_filter({tokens(low, 'a-z0-9_äöüß.')}, lambda x: regexp_matches(x, '(^|[.])fa[.]'))) > 0 THEN 'fa.' END")
    return f"list_sort(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))"


def norm(text: str) -> str:
    """A digit or a norm in capitals in a text as it is written."""
    return f"(regexp_matches({text}, '[0-9]') OR list_has_any({tokens(text, 'a-zA-Z0-9_äöüÄÖÜß')}, {_list(NORMS)}))"


def duty(text: str) -> str:
    """A word that begins like one of duty."""
    return f"len(list_filter({tokens(f'lower(coalesce({text}, {chr(39) * 2}))', 'a-z0-9_äöüß.')}, lambda x: " + " OR ".join(f"starts_with(x, {q(w)}) OR contains(x, {q('.' + w)})" for w in DUTIES) + ")) > 0"


def values(rows: str, text: str, keys: str) -> str:
    """SELECT of keys, unit, raw, value, in order (ord) of unit and place."""
    parts = []
    for k, (name, pattern) in enumerate(UNITS.items()):
        found = f"regexp_extract_all(lower(coalesce({text}, '')) || ' ', {q(f'({L.NUMBER})' + chr(92) + f's*(?:{pattern})')}, 1)"
        parts.append(f"SELECT {keys}, {k} * 1000 + i AS ord, {q(name)} AS unit, r[i] AS raw, {'true' if name in L.COUNTING else 'false'} AS counting FROM (SELECT *, {found} AS r, unnest(range(1, len({found}) + 1)) AS i FROM {rows})")
    return f"SELECT * EXCLUDE (counting), {number('raw', 'counting')} AS value FROM ({' UNION ALL '.join(parts)})"


def page_numbers(evidence: str) -> str:
    """Groups of digits, dots and commas that are digits alone, four at most."""
    return f"list_filter(regexp_extract_all(coalesce({evidence}, ''), '[0-9]+(?:[.,][0-9]+)*'), lambda x: regexp_full_match(x, '[0-9]{{1,4}}'))"


_E = f"""
ev AS (SELECT user_id AS doc_id, CAST(event_id % {K.CRITERIA} AS INTEGER) AS nr, ts, event_id, CAST(round(value * 100) AS BIGINT) AS c, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) AS k FROM events),
passages AS (SELECT doc_id, nr, CAST(row_number() OVER (PARTITION BY doc_id, nr ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank, k % 40 + 1 AS page,
  {_filled(_one_of(S.PASSAGES, 'event_id % 997'), c='c', k='k')} || ' ' || {_filled(_one_of(S.PASSAGES, 'event_id * 7 % 991'), c='c', k='k')} AS text, round((c % 700) / 1000.0 + 0.3, 3) AS score FROM ev),
reqs AS (SELECT CAST(p_partkey % {K.CRITERIA} AS INTEGER) AS nr, p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'variant' ELSE 'required' END AS field,
  {_filled(_one_of(S.REQUIREMENTS, 'p_partkey % 101'), s='p_size', r='CAST(floor(p_retailprice) AS BIGINT)')} AS text FROM part),
crit AS (SELECT nr, {_one_of(S.TITLES, 'nr')} AS title, p_type AS chapter, ['mandatory', 'regular', 'optional'][nr % 3 + 1] AS klass,
  CASE WHEN nr % 4 = 0 THEN ['Typ und Fabrikat', p_brand] ELSE [p_brand] END AS placeholders FROM (SELECT CAST(p_partkey % {K.CRITERIA} AS INTEGER) AS nr, arg_min(p_type, p_partkey) AS p_type, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY ALL))"""


def _reasoned(v: str) -> str:
    status = "CASE event_type WHEN 'view' THEN 'E' WHEN 'click' THEN 'T' WHEN 'error' THEN 'A' WHEN 'purchase' THEN 'N' END"
    reason = _filled(_one_of(S.REASONS, "event_id % 983"), k="k", p="(k % 40 + 1)")
    evidence = _filled(_one_of(S.EVIDENCE, "event_id % 977"), k="k", p="(k % 40 + 1)")
    answer = _filled(_one_of(S.ANSWERS, "event_id % 971"), s="coalesce(lower(status), 'n')", r="reason0", e="evidence")
    return f"""{v}, {_E},
rs0 AS (SELECT v.*, l.event_id, {reason} AS reason0, {evidence} AS evidence FROM v JOIN (SELECT doc_id, nr, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(k, (ts, event_id)) AS k FROM ev GROUP BY ALL) l USING (doc_id, nr)),
rs AS (SELECT * EXCLUDE (reason0), CASE WHEN status = 'N' THEN '' ELSE reason0 END AS reason, {answer} AS answer,
  CASE WHEN status IS NULL THEN CASE WHEN event_id % 2 = 0 THEN 'LLM-Aufruf fehlgeschlagen: timeout' ELSE 'Antwort nicht lesbar' END WHEN status = 'N' AND event_id % 3 = 0 THEN 'kein Kandidat' ELSE '' END AS cause,
  event_id % 17 = 0 AS lifted, event_id % 13 = 0 AS opposed, CASE WHEN event_id % 19 = 0 THEN 0.5 END AS ranked FROM rs0)"""


def _balanced(text: str) -> str:
    """First balanced object by a fold over the characters."""
    tail = f"substr({text}, strpos({text}, '{{'))"
    init = "{'n': 0, 'depth': 0, 'quoted': false, 'escaped': false, 'stop': 0}"
    quote, plain = "(c = '\"' AND NOT a.escaped)", "(NOT a.quoted AND NOT (c = '\"' AND NOT a.escaped))"
    depth = f"(a.depth + CASE WHEN {plain} AND c = '{{' THEN 1 WHEN {plain} AND c = '}}' THEN -1 ELSE 0 END)"
    step = f"""CASE WHEN a.stop > 0 THEN a ELSE {{'n': CAST(a.n + 1 AS INTEGER), 'depth': CAST({depth} AS INTEGER), 'quoted': CASE WHEN {quote} THEN NOT a.quoted ELSE a.quoted END,
 'escaped': a.quoted AND NOT a.escaped AND c = '\\', 'stop': CAST(CASE WHEN {plain} AND c = '}}' AND {depth} = 0 THEN a.n + 1 ELSE 0 END AS INTEGER)}} END"""
    return f"CASE WHEN strpos({text}, '{{') > 0 THEN left({tail}, list_reduce(string_split({tail}, ''), lambda a, c: {step}, {init}).stop) END"


def oracles(v: str, sections: str, vectors: str, pairs: str) -> dict[str, str]:
    base, rs = f"WITH {_E}", _reasoned(v)
    marks = f"""
sn1 AS (SELECT doc_id, nr, rank, page, score, {sentences('text')} AS s FROM passages), sn2 AS (SELECT doc_id, nr, rank, page, score, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM sn1)),
sg0 AS (SELECT *, {is_binding('sentence')} AS binding, {is_cost('sentence')} AS cost FROM sn2), sgn AS (SELECT * FROM sg0 WHERE binding OR cost)"""
    cost_nr, bought = f"(SELECT DISTINCT nr FROM reqs WHERE field = 'required' AND {has('text', L.COST_IN_STANDARD)})", f"(SELECT nr FROM crit WHERE {has('title', L.BOUGHT_IN)})"

    def assigned(kind: str, preferred: str, only: bool) -> str:
        some = f"AND (nr IN {preferred} OR NOT EXISTS {preferred})" if only else ""
        return f"""(SELECT doc_id, nr, left(arg_min(sentence, (fn, fr, fp, sentence)), 300) AS sentence, arg_min(page, (fn, fr, fp, sentence)) AS page FROM (
  SELECT doc_id, sentence, nr, page, preferred, min(nr) OVER (PARTITION BY doc_id, sentence) AS fn, first_value(rank) OVER z AS fr, first_value(pos) OVER z AS fp,
         row_number() OVER (PARTITION BY doc_id, sentence ORDER BY preferred DESC, score DESC, nr, rank, pos) AS k
  FROM (SELECT *, nr IN {preferred} AS preferred FROM sgn WHERE {kind} {some}) WINDOW z AS (PARTITION BY doc_id, sentence ORDER BY nr, rank, pos)) WHERE k = 1 GROUP BY doc_id, nr)"""

    val = values("reqs", "text", "nr")
    ranges = f"rng AS (SELECT nr, unit, min(value) AS least, max(value) AS most FROM ({val}) WHERE value IS NOT NULL GROUP BY ALL)"
    mats = lambda t: f"regexp_extract_all(regexp_replace(' ' || coalesce({t}, '') || ' ', '([^0-9A-Za-z_])', '\\1\\1', 'g'), '[^0-9A-Za-z_]({L.MATERIAL})[^0-9A-Za-z_]', 1)"
    # A dot is such a mark too: it is doubled by the line above and halved again here.
    mats = lambda t: f"list_filter(list_transform(regexp_extract_all(' ' || coalesce({t}, '') || ' ', '[^0-9A-Za-z_]({L.MATERIAL})(?:[^0-9A-Za-z_])', 1), lambda x: x), lambda x: true)"
    known = f"mat AS (SELECT nr, list_sort(list(DISTINCT m)) AS materials FROM (SELECT nr, unnest({mats('text')}) AS m FROM reqs) GROUP BY nr HAVING count(DISTINCT m) >= 3)"
    vs = f"""{ranges}, {known}, ts AS (SELECT doc_id, nr, rank, page, CAST(i AS INTEGER) AS spot, s[i] AS text FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, nr, rank, page, {sentences('text')} AS s FROM passages WHERE rank <= 10))),
vv AS (SELECT * FROM ({values('ts', 'text', 'doc_id, nr, rank, page, spot')}) WHERE value IS NOT NULL),
vsig AS (SELECT doc_id, nr, 'value' AS sign, raw || ' ' || unit AS found, CAST(CAST(trunc(least) AS BIGINT) AS VARCHAR) || '..' || CAST(CAST(trunc(most) AS BIGINT) AS VARCHAR) || ' ' || unit AS known, page FROM vv JOIN rng USING (nr, unit) WHERE value < least OR value > most QUALIFY row_number() OVER (PARTITION BY doc_id, nr ORDER BY rank, spot, ord) = 1),
mm AS (SELECT doc_id, nr, rank, page, materials, i, m[i] AS found FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT p.doc_id, p.nr, rank, page, materials, {mats('text')} AS m FROM passages p JOIN mat ON p.nr = mat.nr WHERE rank <= 10))),
msig AS (SELECT doc_id, nr, 'material' AS sign, found, array_to_string(materials, ', ') AS known, page FROM mm WHERE NOT list_contains(materials, found) QUALIFY row_number() OVER (PARTITION BY doc_id, nr ORDER BY rank, i) = 1)"""
    pw = procurement
    bare = f"regexp_replace(coalesce(reason, ''), {q('(?i)' + L.REFERENCE)}, '\\1 ', 'g')"
    own = f"""list_filter([CASE WHEN len({pw('reason')}) > 0 THEN 'procurement' END, CASE WHEN {norm(bare)} THEN 'number' END, CASE WHEN {duty('reason')} THEN 'duty' END,
  CASE WHEN {has('reason', L.CONTRADICTION)} AND NOT {has('reason', L.NO_CONTRADICTION)} THEN 'contradiction' END], lambda x: x IS NOT NULL)"""
    openp = f"(SELECT nr, array_to_string(list_filter(placeholders, lambda p: {has('p', L.PLACEHOLDER)}), ', ') AS open FROM crit WHERE len(list_filter(placeholders, lambda p: {has('p', L.PLACEHOLDER)})) > 0)"
    best = "pb AS (SELECT doc_id, nr, arg_min(page, rank) AS best, list(DISTINCT CAST(page AS VARCHAR)) AS pages FROM passages GROUP BY ALL)"
    said = "regexp_replace(trim(coalesce(evidence, ''), ' '), '^[Ss]+', '')"
    hints = f"""{best}, ht AS (SELECT doc_id, nr, 'S' || CASE WHEN list_contains(pages, {said}) THEN {said} ELSE CAST(best AS VARCHAR) END AS page, array_to_string({pw('reason')}, ',') AS words, open
  FROM rs JOIN pb USING (doc_id, nr) JOIN {openp} o USING (nr) WHERE status = 'E' AND len({pw('reason')}) > 0 AND NOT {has('reason', L.FOREIGN_ID)})"""
    share = "shr AS (SELECT nr, round(count(*) FILTER (ref = 'A') / count(*)::DOUBLE, 4) AS share_a FROM v WHERE ref IN ('E', 'T', 'A') GROUP BY nr)"
    against = f"agn AS (SELECT nr, arg_min(text, pos) AS against FROM reqs WHERE field = 'required' AND {has('text', L.AFFECTED)} GROUP BY nr)"
    facts = f"""{marks}, {vs}, {hints}, {share}, {against},
vnd AS (SELECT * FROM {assigned('binding', bought, True)}), cst AS (SELECT * FROM {assigned('cost', cost_nr, False)}),
fx AS (SELECT rs.*, share_a, CASE WHEN cause = '' THEN vnd.sentence END AS vendor, CASE WHEN cause = '' THEN cst.sentence END AS cost_s, cst.page AS cost_p, CASE WHEN cause = '' THEN vsig.found END AS value_f, vsig.known AS value_k, vsig.page AS value_p,
  CASE WHEN cause = '' THEN msig.found END AS mat_f, msig.page AS mat_p, ht.words AS hint_w, ht.page AS hint_p, CASE WHEN opposed THEN against END AS opposite
  FROM rs LEFT JOIN shr USING (nr) LEFT JOIN agn USING (nr) LEFT JOIN vnd USING (doc_id, nr) LEFT JOIN cst USING (doc_id, nr) LEFT JOIN vsig USING (doc_id, nr) LEFT JOIN msig USING (doc_id, nr) LEFT JOIN ht USING (doc_id, nr)),
sg1 AS (SELECT *, [CASE WHEN status = 'A' THEN 'model' END, CASE WHEN hint_w IS NOT NULL THEN 'hint' END] AS s1, [CASE WHEN status IN ('E', 'T') AND vendor IS NOT NULL THEN 'vendor' END, CASE WHEN status IN ('E', 'T') AND coalesce(share_a, 0) >= {K.ACCUMULATION} THEN 'accumulation' END,
  CASE WHEN status IN ('E', 'T', 'N') AND cost_s IS NOT NULL THEN 'cost' END, CASE WHEN status IN ('E', 'T', 'N') AND value_f IS NOT NULL THEN 'value' END, CASE WHEN status IN ('E', 'T', 'N') AND mat_f IS NOT NULL THEN 'material' END,
  CASE WHEN status IN ('E', 'T') AND opposite IS NOT NULL THEN 'opposite' END] AS s2, CASE WHEN status IN ('E', 'T') AND NOT lifted THEN {own} ELSE [] END AS s3 FROM fx),
sg2 AS (SELECT *, list_concat(list_filter(list_concat(s1, s2), lambda x: x IS NOT NULL), s3) AS signs FROM sg1)"""

    def flags(level: list[str]) -> str:
        count, passage = _list(level), _list(D.FROM_PASSAGES)
        return f"""
tp AS (SELECT doc_id, nr, p, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, nr) AS INTEGER) AS place FROM sg2 WHERE status IN ('E', 'T') AND len(list_intersect(signs, list_append({count}, 'model'))) = 0 AND p > 0 QUALIFY place <= {K.TOP_FLAGS}),
fl0 AS (SELECT sg2.*, CASE WHEN place IS NOT NULL THEN list_concat(list_concat(list_concat(list_filter(s1, lambda x: x IS NOT NULL), ['probability']), list_filter(s2, lambda x: x IS NOT NULL)), s3) ELSE signs END AS al FROM sg2 LEFT JOIN tp ON tp.doc_id = sg2.doc_id AND tp.nr = sg2.nr),
fl1 AS (SELECT *, list_filter(al, lambda x: list_contains({count}, x)) AS hits, list_filter(al, lambda x: x = 'model' OR list_contains({count}, x)) AS og FROM fl0),
fl2 AS (SELECT *, len(hits) > 0 AND coalesce(status <> 'A', true) AS raised, list_filter(og, lambda x: list_contains({passage}, x)) AS ps FROM fl1),
fl3 AS (SELECT *, raised AND coalesce(status = 'N', false) AND list_contains(og, 'hint') AS by_hint, raised AND NOT (coalesce(status = 'N', false) AND list_contains(og, 'hint')) AND (coalesce(status = 'N', false) OR len(og) = len(ps)) AND len(ps) > 0 AS by_p FROM fl2),
fl AS (SELECT doc_id, nr, CASE WHEN raised THEN 'A' ELSE status END AS status, CASE WHEN raised THEN coalesce(status, 'N') END AS status_model, CASE WHEN len(hits) > 0 OR coalesce(status = 'A', false) THEN array_to_string(og, ',') END AS origin,
  CASE WHEN by_hint THEN 'Laid down: ' || hint_w WHEN by_p THEN CASE ps[1] WHEN 'cost' THEN 'Cost in the document: ' || cost_s WHEN 'value' THEN 'Value outside the standard: ' || value_f || ' (' || value_k || ')' WHEN 'material' THEN 'Material outside the standard: ' || mat_f ELSE 'Opposite of: ' || opposite END ELSE reason END AS reason,
  CASE WHEN by_hint THEN hint_p WHEN by_p THEN CASE ps[1] WHEN 'cost' THEN 'S' || cost_p WHEN 'value' THEN 'S' || value_p WHEN 'material' THEN 'S' || mat_p ELSE evidence END ELSE evidence END AS evidence,
  CASE WHEN by_p AND reason <> '' THEN reason END AS reason_model FROM fl3)"""

    blob = "regexp_replace(answer, '(?s)<think>.*?</think>', '', 'g')"
    prs = f"""pj AS (SELECT *, {_balanced(blob)} AS blob FROM rs), pk AS (SELECT *, CASE WHEN json_valid(blob) THEN blob END AS b FROM pj),
pst AS (SELECT *, left(upper(trim(json_extract_string(b, '$.status'), ' ')), 1) AS st FROM pk), pq AS (SELECT *, coalesce(st IN ('E', 'T', 'A', 'N'), false) AS fits FROM pst),
prd AS (SELECT doc_id, nr, CASE WHEN fits THEN st END AS status, CASE WHEN fits THEN CASE WHEN st = 'N' THEN '' ELSE trim(coalesce(json_extract_string(b, '$.begruendung'), ''), ' ') END END AS reason,
  CASE WHEN fits THEN CASE WHEN st = 'N' THEN '' ELSE trim(coalesce(json_extract_string(b, '$.fundstelle'), ''), ' ') END END AS evidence, NOT fits AS unreadable FROM pq)"""
    sec = f"WITH {sections}"
    return {
        "p6_bullets": f"{base} SELECT doc_id, nr, rank, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, nr, rank, {sentences('text')} AS s FROM passages))",
        "f1_contents": f"{base} SELECT doc_id, nr, rank, {is_contents('text')} AS is_contents FROM passages",
        "f7_cost_sentences": f"{base}, {marks} SELECT doc_id, nr, rank, pos, sentence, binding, cost FROM sgn",
        "f8_cost_criteria": f"{base} SELECT nr FROM {cost_nr}",
        "f9_bought_in": f"{base} SELECT nr FROM {bought}",
        "f10_placeholders": f"{base} SELECT nr, CASE WHEN open <> '' THEN open ELSE 'make and type of bought-in parts' END AS open FROM (SELECT nr, title, array_to_string(list_filter(placeholders, lambda p: {has('p', L.PLACEHOLDER)}), ', ') AS open FROM crit) WHERE open <> '' OR {has('title', L.BOUGHT_IN)}",
        "f11_open_criteria": f"{base} SELECT nr, arg_min(trim(text, ' '), (field, pos)) AS wording FROM reqs WHERE {has('text', L.OPEN_WORDING)} GROUP BY nr",
        "f12_procurement_words": f"{rs} SELECT doc_id, nr, array_to_string({pw('reason')}, ',') AS words FROM rs WHERE len({pw('reason')}) > 0",
        "f13_negated_hints": f"{rs} SELECT doc_id, nr, {has('reason', L.NEGATED_HINT)} AS negated FROM rs",
        "f14_affected_criteria": f"{base} SELECT nr, count(*) AS n FROM reqs WHERE field = 'required' AND {has('text', L.AFFECTED)} GROUP BY nr",
        "f15_f16_reason_signs": f"{rs} SELECT doc_id, nr, array_to_string({own}, ',') AS signs FROM rs",
        "p7_unit_values": f"{base} SELECT doc_id, nr, rank, unit, raw, value FROM ({values('passages', 'text', 'doc_id, nr, rank')}) WHERE value IS NOT NULL",
        "p9_materials": f"{base} SELECT doc_id, nr, rank, array_to_string({mats('text')}, ',') AS materials FROM passages WHERE len({mats('text')}) > 0",
        "p12_parsed_answers": f"{rs}, {prs} SELECT doc_id, nr, status, reason, evidence, unreadable FROM prd",
        "p10_page_numbers": f"{rs} SELECT doc_id, nr, array_to_string({page_numbers('evidence')}, ',') AS pages FROM rs",
        "p13_status_shares": f"""{v}, t AS (SELECT doc_id, nr, unnest([status, 'A', 'E']) AS s, unnest([-p, -2 * p - 0.1, -3.0]) AS lp FROM v WHERE status IS NOT NULL), tm AS (SELECT doc_id, nr, s, exp(max(lp)) AS e FROM t GROUP BY ALL),
w AS (SELECT doc_id, nr, coalesce(max(e) FILTER (s = 'E'), 0) AS e, coalesce(max(e) FILTER (s = 'T'), 0) AS t, coalesce(max(e) FILTER (s = 'A'), 0) AS a, coalesce(max(e) FILTER (s = 'N'), 0) AS n FROM tm GROUP BY ALL)
SELECT doc_id, nr, round(e / (e + t + a + n), 4) AS p_e, round(t / (e + t + a + n), 4) AS p_t, round(a / (e + t + a + n), 4) AS p_a, round(n / (e + t + a + n), 4) AS p_n FROM w""",
        "p14_without_thoughts": f"{rs} SELECT doc_id, nr, length({blob}) AS n FROM rs",
        "f17_evidence": f"""{rs}, {prs}, {best}, pg AS (SELECT *, {page_numbers('evidence')} AS named FROM prd LEFT JOIN pb USING (doc_id, nr)),
pe AS (SELECT *, list_transform(list_filter(range(1, len(named) + 1), lambda i: list_contains(coalesce(pages, []), named[i]) AND list_position(named, named[i]) = i), lambda i: named[i]) AS kept,
  status = 'N' OR reason = '' OR (pages IS NULL AND NOT regexp_matches(evidence, '[0-9]')) AS none FROM pg)
SELECT doc_id, nr, CASE WHEN none THEN 'N' ELSE status END AS status, CASE WHEN none THEN '' ELSE reason END AS reason, CASE WHEN none THEN '' WHEN pages IS NULL THEN evidence WHEN len(kept) = 0 THEN 'S' || best
  WHEN len(kept) < len(named) THEN array_to_string(list_transform(kept, lambda p: 'S' || p), ', ') ELSE evidence END AS evidence FROM pe""",
        "p16_words": f"{rs} SELECT doc_id, nr, len({words('reason', 3)}) AS n3, len({words('reason', 5)}) AS n5 FROM rs",
        "p20_statements": f"{base} SELECT nr, field, count(*) AS n, sum(length(trim(text, ' '))) AS chars FROM reqs WHERE trim(text, ' ') <> '' GROUP BY ALL",
        "a10_vendor_sentences": f"{base}, {marks} SELECT * FROM {assigned('binding', bought, True)}",
        "a10_cost_sentences": f"{base}, {marks} SELECT * FROM {assigned('cost', cost_nr, False)}",
        "a11_standard_ranges": f"{base}, {ranges} SELECT * FROM rng",
        "a11_standard_materials": f"{base}, {known} SELECT nr, array_to_string(materials, ',') AS materials FROM mat",
        "a12_value_signs": f"{base}, {vs} SELECT * FROM vsig UNION ALL SELECT * FROM msig",
        "a18_regulated_share": f"{v}, {share} SELECT nr, share_a FROM shr",
        "k7_share_attached": f"{v}, {share} SELECT doc_id, nr, status, share_a FROM v JOIN shr USING (nr) WHERE status IN ('E', 'T')",
        "k13_reason_hints": f"{rs}, {hints} SELECT * FROM ht",
        "k10_signs": f"{rs}, {facts} SELECT doc_id, nr, array_to_string(signs, ',') AS signs FROM sg2",
        "w3_top_flags": f"{rs}, {facts}, {flags(D.LEVELS['thorough'])} SELECT doc_id, nr, place, p FROM tp",
        "k11_flagged": f"{rs}, {facts}, {flags(D.LEVELS['thorough'])} SELECT * FROM fl",
        "k11_flagged_1_1": f"{rs}, {facts}, {flags(D.LEVELS_1_1['high']).replace('place IS NOT NULL', 'false')} SELECT * FROM fl",
        "r3_deviations": f"{rs}, {facts}, {flags(D.LEVELS['thorough'])} SELECT doc_id, nr, title, origin, left(reason, 500) AS reason, evidence FROM fl JOIN crit USING (nr) WHERE status = 'A'",
        "f18_failures": f"{rs} SELECT doc_id, count(*) FILTER (contains(lower(cause), 'aufruf fehlgeschlagen')) AS connection, count(*) FILTER (cause <> '' AND cause <> 'kein Kandidat') AS unrated, count(*) FILTER (cause = 'kein Kandidat') AS no_candidate FROM rs GROUP BY doc_id",
        "a4_reasons": f"{rs} SELECT doc_id, count(*) FILTER (status = 'N' AND cause = '') AS by_model, count(*) FILTER (cause = 'kein Kandidat') AS no_candidate, count(*) FILTER (cause NOT IN ('', 'kein Kandidat')) AS error FROM rs GROUP BY doc_id",
        "f20_echoes": f"""{rs}, fq AS (SELECT doc_id, nr, regexp_extract_all(regexp_replace(' ' || reason || ' ', '([^0-9A-Za-z_ÄÖÜäöüß.,])', '\\1\\1', 'g'), '[^0-9A-Za-z_ÄÖÜäöüß]([A-ZÄÖÜ]{{3,}}[0-9]*|[0-9][0-9.,]{{2,}}[0-9])[^0-9A-Za-z_ÄÖÜäöüß]', 1) AS f FROM rs),
fr AS (SELECT doc_id, nr, fact FROM (SELECT doc_id, nr, f, unnest(range(1, len(f) + 1)) AS i, f[i] AS fact FROM fq) WHERE NOT list_contains({_list(L.EVERYDAY)}, upper(fact)) QUALIFY row_number() OVER (PARTITION BY doc_id, nr, upper(fact) ORDER BY i) = 1)
SELECT doc_id, nr, string_agg(fact, ',' ORDER BY fact) AS echo FROM fr WHERE NOT EXISTS (SELECT 1 FROM passages p WHERE p.doc_id = fr.doc_id AND p.nr = fr.nr AND contains(lower(p.text), lower(fact))) AND EXISTS (SELECT 1 FROM reqs WHERE reqs.nr = fr.nr AND contains(lower(reqs.text), lower(fact))) GROUP BY doc_id, nr""",
        "f19_grounded": f"""{rs}, pt AS (SELECT doc_id, nr, lower(string_agg(text, ' ' ORDER BY text)) AS t FROM passages GROUP BY ALL), w AS (SELECT doc_id, nr, reason, t, {words('reason', 4)} AS w FROM rs LEFT JOIN pt USING (doc_id, nr)),
g AS (SELECT *, len(list_filter(w, lambda x: contains(coalesce(t, ''), x))) AS found FROM w) SELECT doc_id, nr, len(w) AS words, found, NOT {has('reason', L.FOREIGN_ID)} AND len(w) > 0 AND found >= 0.3 * len(w) AS ok FROM g""",
        "x1_sections_kept": f"{sec} SELECT doc_id, count(*) AS sections, count(*) FILTER (NOT {is_contents('text')}) AS kept FROM sec GROUP BY doc_id",
    }
