"""Reference SQL for the registered queries, run by DuckDB over the same tables."""

from __future__ import annotations

from scholarlake.config import (
    CODE_DOMAINS, CODE_HEADINGS, CODE_HINTS, CODE_KEYWORDS, DATA_DOMAINS, DATA_HEADINGS, DATA_HINTS, DATA_KEYWORDS, DATASET_PREFIXES, DENIED, EMBEDDED,
    FUTURE, GATEWAY, INVISIBLE, LICENSES, RESOLVER_STOPWORDS, RESTRICTED, STATEMENT_GAP, STATEMENT_WORDS, TITLE_STOPWORDS, URL_CHARS, URL_CLASS, URL_ENDS,
)
from scholarlake.operators.answers import RULES
from scholarlake.plans.views import with_views


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def among(words) -> str:
    return "(" + ", ".join(map(text, words)) + ")"


def has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(w)})" for w in words) + ")"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def n_words(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


def alpha(x: str) -> str:
    return rf"(length(regexp_replace({x}, '[^\p{{L}}]', '', 'g')) / length({x}))"


def states(x: str, kind: str) -> str:
    subject, verb = STATEMENT_WORDS[kind]
    return f"regexp_matches({x}, '(?i){subject}{STATEMENT_GAP}{verb}')"


CLEAN = r"10\.\d{4,9}/[A-Za-z0-9._\-/:]+"
HEADER = r"(?i)^[a-z\s]+\(\d{4}\)\s+\d+,\s+\d+-\d+$"


def doi_of(table: str, raw: str, keep: str) -> str:
    """A chain of sub-selects that adds doi, from column raw."""
    strip = rf"SELECT *, trim(regexp_replace(trim({raw}), '^(?:doi:|DOI:|https?://(?:dx\.)?doi\.org/)', '')) AS d1 FROM {table}"
    head = rf"SELECT *, CASE WHEN contains(d1, '(') AND regexp_matches(trim(split_part(d1, '(', 1)), '^{CLEAN}$') THEN trim(split_part(d1, '(', 1)) ELSE d1 END AS d2 FROM ({strip})"
    clean = rf"SELECT *, regexp_replace(coalesce(nullif(regexp_extract(d2, '^({CLEAN})', 1), ''), d2), '[.,;)\]]+$', '') AS d3 FROM ({head})"
    return rf"SELECT {keep}, CASE WHEN regexp_matches(d3, '^10\.\d{{4,9}}/[^\s" + '"' + rf"<>]+$') THEN d3 END AS doi FROM ({clean})"


CAND = r'(?i)(?:doi:\s*)?(?:https?://(?:dx\.)?doi\.org/)?(10\.\d{4,9}/[^\s"<>]+)'
DOIS = rf"""
joined AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page, col, seq) AS text FROM papers_view GROUP BY doc_id),
front AS (SELECT doc_id, text, 0 AS f, substr(regexp_replace(text, '(?ims)^\s*(?:references|bibliography)\b.*', ''), 1, 20000) AS part FROM joined UNION ALL SELECT doc_id, text, 1, text FROM joined),
raws AS (SELECT doc_id, text, f, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS raw FROM (SELECT *, regexp_extract_all(part, '{CAND}', 1) AS l FROM front)),
valid AS ({doi_of("raws", "raw", "doc_id, text, f, i")}),
kept AS (SELECT doc_id, text, f, doi, min(i) AS i FROM valid WHERE doi IS NOT NULL AND NOT ({" OR ".join(f"starts_with(doi, '{p}/')" for p in DATASET_PREFIXES)}) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal, instr(text, doi) AS ix FROM (SELECT * FROM kept QUALIFY f = min(f) OVER (PARTITION BY doc_id))),
around AS (SELECT *, substr(text, greatest(1, ix - 30), least(30, ix - 1)) AS before FROM placed),
candidates AS (SELECT doc_id, ordinal, doi, CAST(round(CASE WHEN ix > 0 AND ix <= 5000 THEN 1.0 ELSE 0.6 END + CASE WHEN ix > 0 AND regexp_matches(before, '(?i)doi:\s*$') THEN 0.4 ELSE 0 END
 + CASE WHEN ix > 0 AND regexp_matches(before, '(?i)https?://(?:dx\.)?doi\.org/$') THEN 0.3 ELSE 0 END, 3) AS DOUBLE) AS score FROM around),
best AS (SELECT doc_id, doi, CAST(least(1.0, score) AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS n FROM candidates) WHERE n = 1)"""

SEGMENTS = rf"""
g0 AS (SELECT doc_id, seq, regexp_split_to_array(text, '\n{{2,}}') AS a FROM papers_view),
g1 AS (SELECT doc_id, seq, unnest(range(1, len(a) + 1)) AS part, trim(unnest(a)) AS block FROM g0),
g2 AS (SELECT *, {collapse("block")} AS text FROM g1 WHERE block <> ''),
g3 AS (SELECT *, CASE WHEN regexp_matches(lower(text), '^(?:{"|".join(DATA_HEADINGS)})') THEN 'data' WHEN regexp_matches(lower(text), '^(?:{"|".join(CODE_HEADINGS)})') THEN 'code'
  WHEN {n_words("text")} <= 6 AND upper(text) = text AND lower(text) <> text THEN 'generic' END AS label, instr(block, ':') AS ix FROM g2),
g4 AS (SELECT *, coalesce(label IN ('data', 'code'), false) AND ix > 1 AND ix <= 80 AND substr(block, ix, 3) <> '://' AND instr(split_part(block, chr(10), 1), ':') > 0 AS cut FROM g3),
g5 AS (SELECT doc_id, seq, part, 0 AS piece, label, CASE WHEN cut THEN {collapse("substr(block, 1, ix - 1)")} || ':' ELSE text END AS text FROM g4
  UNION ALL SELECT doc_id, seq, part, 1, NULL, {collapse("substr(block, ix + 1)")} FROM g4 WHERE cut AND {collapse("substr(block, ix + 1)")} <> ''),
seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, part, piece) - 1 AS idx, label, text FROM g5)"""


def _points(kind: str) -> str:
    words = " + ".join(f"CASE WHEN contains(low, {text(w)}) THEN 14 ELSE 0 END" for w in (DATA_KEYWORDS if kind == "data" else CODE_KEYWORDS))
    return f"""CASE WHEN label = '{kind}' THEN 50 WHEN label = 'generic' THEN 10 ELSE 0 END
 + CASE WHEN lag(coalesce(label = '{kind}', false), 1, false) OVER w OR lag(coalesce(label = '{kind}', false), 2, false) OVER w THEN 22 ELSE 0 END + {words}
 + CASE WHEN contains(low, 'available') AND contains(low, '{kind}') THEN 12 ELSE 0 END
 + CASE WHEN contains(low, 'upon request') OR contains(low, 'reasonable request') THEN 5 ELSE 0 END
 + CASE WHEN contains(low, 'supplementary') OR contains(low, 'supporting information') THEN 4 ELSE 0 END
 - CASE WHEN {has("low", DENIED)} THEN 15 ELSE 0 END - CASE WHEN ends_with(text, ':') AND length(text) < 80 THEN 30 ELSE 0 END"""


CONTEXTS = (
    SEGMENTS
    + f""",
scored AS (
 {" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, idx, label, text, {_points(k)} AS points FROM (SELECT *, lower(text) AS low FROM seg) WINDOW w AS (PARTITION BY doc_id ORDER BY idx)" for k in ("data", "code"))}),
above AS (SELECT *, max(points) OVER (PARTITION BY doc_id, kind) > 5 AS found FROM scored),
ctx0 AS (SELECT doc_id, kind, points, CASE WHEN label = kind THEN 'heading' ELSE 'phrase' END AS source, idx, text FROM above WHERE points > 5
 UNION ALL SELECT doc_id, kind, 10, 'global', 0, {collapse("string_agg(text, ' ' ORDER BY idx)")} FROM above WHERE NOT found GROUP BY doc_id, kind),
ctx AS (SELECT * FROM (SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY points DESC, idx) AS rank, points, source, idx, text FROM ctx0) WHERE rank <= 8)"""
)

_S = r"list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def _first(kind: str) -> str:
    one = f"list_filter(s, lambda x: {states('x', kind)})[1]"
    two = f"list_filter(list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1]), lambda x: {states('x', kind)})[1]"
    return f"coalesce({one}, {two})"


def repair_spacing(x: str) -> str:
    x = rf"regexp_replace({x}, '(\w)-\s+(\w)', '\1\2', 'g')"
    return rf"regexp_replace(regexp_replace(replace({x}, ' - ', '-'), '\s+', ' ', 'g'), '\s+([,.:])', '\1', 'g')"


def canonical(x: str) -> str:
    x = f"regexp_replace({x}, '[\u200b\u200c\u200d\u00ad\ufeff]', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)https?://\s*urlde\s*fense\s*\.\s*com\s*/\s*v3\s*/\s*__\s*/?', '', 'g')"
    x = rf"regexp_replace({x}, '(__\s*;?\s*!!\s*[A-Za-z0-9!$\-_\s+/=]+?)(\s+(?:and|the|on|at|in|from|or|to|is|are)\b|$)', '\2', 'g')"
    for name in ("zenodo", "dryad", "github", "gitlab", "osf"):
        spaced = r"\s*".join(name)
        x = rf"regexp_replace({x}, '(?i)(https?://(?:www\.)?){spaced}\s*\.\s*(org|com|io)', '\1{name}.\2', 'g')"
    for _ in range(10):
        x = rf"regexp_replace({x}, '(https?://\S*[=\-_])\s+(\S)', '\1\2', 'g')"
        x = rf"regexp_replace({x}, '(https?://\S+)\s+([/?\-_=.]|\S[^/?\-_=.]{{0,11}}[/?\-_=.])', '\1\2', 'g')"
    return x


STATEMENTS = (
    CONTEXTS
    + f""",
clean AS (SELECT * REPLACE ({canonical("text")} AS text) FROM ctx),
top AS (SELECT doc_id, kind, {canonical(repair_spacing("text"))} AS whole_text FROM clean WHERE rank = 1),
cut AS (SELECT *, CASE kind WHEN 'data' THEN {_first("data")} ELSE {_first("code")} END AS trimmed,
 rank = 1 AND CASE kind WHEN 'data' THEN {states("whole_text", "data")} ELSE {states("whole_text", "code")} END AS whole FROM (SELECT *, {_S} AS s FROM clean JOIN top USING (doc_id, kind))),
picked AS (SELECT doc_id, kind, min_by(trimmed, rank) FILTER (trimmed IS NOT NULL) AS a, min_by(points, rank) FILTER (trimmed IS NOT NULL) AS pa,
 min_by(whole_text, rank) FILTER (whole) AS b, min_by(points, rank) FILTER (whole) AS pb FROM cut GROUP BY doc_id, kind),
stmt AS (SELECT doc_id, kind, coalesce(a, b) AS statement, round(CASE WHEN a IS NOT NULL THEN least(0.6, pa / 80) WHEN b IS NOT NULL THEN least(0.4, pb / 100) END, 6) AS confidence FROM picked)"""
)


def domain(x: str) -> str:
    return f"regexp_replace(lower(regexp_extract({x}, '(?i)^https?://([^/]+)', 1)), '^www\\.', '')"


def is_url(x: str) -> str:
    return rf"(length({x}) >= 10 AND regexp_matches({x}, '^https?://[a-zA-Z0-9][\w\-.]*\.[a-zA-Z]{{2,}}(?:/\S*)?$'))"


def clean_link(x: str) -> str:
    bare = rf"regexp_replace(trim({x}), '[.,;)\]}}]+$', '')"
    return f"CASE WHEN regexp_matches({bare}, '^https?://') THEN {bare} WHEN starts_with(lower({bare}), 'www.') THEN 'https://' || {bare} END"


LINKS = (
    STATEMENTS
    + rf""",
l0 AS (SELECT doc_id, kind, {canonical("statement")} AS text FROM stmt WHERE statement IS NOT NULL),
l1 AS (SELECT doc_id, kind, list_filter(flatten(list_transform(regexp_extract_all(text, '(https?://[^\s)]+)', 1), lambda u: string_split(regexp_replace(u, '(https?://)', chr(1) || '\1', 'g'), chr(1)))), lambda u: u <> '') AS l FROM l0),
l2 AS (SELECT doc_id, kind, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS raw FROM l1),
l3 AS (SELECT doc_id, kind, i, {clean_link("raw")} AS url FROM l2),
l4 AS (SELECT doc_id, kind, url, min(i) AS i FROM l3 WHERE url IS NOT NULL AND NOT {has("lower(url)", DENIED)} AND {is_url("url")}
 AND CASE kind WHEN 'data' THEN {domain("url")} IN {among(DATA_DOMAINS)} OR ({domain("url")} IN ('doi.org', 'dx.doi.org') AND ({" OR ".join(f"regexp_matches(lower(url), '^.*?doi\\.org/{p}')" for p in DATASET_PREFIXES)}))
  ELSE {domain("url")} IN {among(CODE_DOMAINS)} END GROUP BY doc_id, kind, url),
links AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) - 1 AS pos, url FROM l4)"""
)

STATUS = (
    LINKS
    + f""",
counted AS (SELECT s.*, (SELECT count(*) FROM links l WHERE l.doc_id = s.doc_id AND l.kind = s.kind) AS n_links, lower(s.statement) AS low FROM stmt s),
status AS (SELECT doc_id, kind, n_links, CASE WHEN coalesce(statement, '') = '' THEN 'none' WHEN {has("low", FUTURE)} THEN 'future' WHEN {has("low", RESTRICTED)} THEN 'restricted'
 WHEN kind = 'data' AND {has("low", EMBEDDED)} AND n_links = 0 THEN 'embedded' WHEN n_links > 0 THEN 'open' ELSE 'none' END AS status FROM counted)"""
)

_LINES = rf"""
ln0 AS (SELECT doc_id, seq, string_split(text, chr(10)) AS a FROM papers_view WHERE page = 1 AND col = 0 AND text <> '' AND NOT regexp_matches(text, '{HEADER}')),
ln1 AS (SELECT doc_id, seq, unnest(range(1, len(a) + 1)) AS i, trim(unnest(a)) AS line FROM ln0),
ln2 AS (SELECT doc_id, {collapse("line")} AS line, row_number() OVER (PARTITION BY doc_id ORDER BY seq, i) AS n FROM ln1 WHERE line <> '' AND NOT regexp_matches(line, '{HEADER}')),
ok AS (SELECT doc_id, line, n, length(line) BETWEEN 8 AND 280 AND {n_words("line")} BETWEEN 2 AND 50 AND NOT regexp_matches(line, '(?i)\b(?:{"|".join(RESOLVER_STOPWORDS)})\b') AND {alpha("line")} >= 0.4 AS good FROM ln2 WHERE n <= 4),
title AS (SELECT doc_id, min_by(line, n) FILTER (good) AS title, CAST(CASE WHEN bool_or(good) THEN 0.6 ELSE 0 END AS DOUBLE) AS confidence FROM ok GROUP BY doc_id)"""

_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '([a-z0-9]+)', 1), lambda t: length(t) >= 3))"
_MATCH = f"""
mine AS (SELECT doc_id, title, {_TOKENS.format("title")} AS t FROM titles),
entries AS (SELECT lower(trim(doi)) AS doi, title AS record_title, source, {_TOKENS.format("title")} AS r FROM registry_view),
sims AS (SELECT m.doc_id, e.doi, e.source, len(list_intersect(m.t, e.r)) / len(list_distinct(list_concat(m.t, e.r))) AS similarity FROM mine m, entries e WHERE len(m.t) > 0 AND len(e.r) > 0),
matched AS (SELECT doc_id, doi, similarity, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, source = 'crossref' DESC, doi) AS n FROM sims WHERE similarity >= 0.4) WHERE n = 1)"""
_TITLES = "titles AS (SELECT doc_id, text AS title FROM papers_view WHERE seq = 1)"
_VERIFY = f"""
own AS (SELECT t.doc_id, b.doi, b.confidence, e.record_title, m.doi AS found, coalesce(m.similarity, 0) AS sim,
 CASE WHEN e.record_title IS NOT NULL THEN CASE WHEN len(i.t) > 0 AND len(e.r) > 0 THEN len(list_intersect(i.t, e.r)) / len(list_distinct(list_concat(i.t, e.r))) ELSE 0 END END AS rs
 FROM titles t JOIN mine i USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN entries e ON e.doi = lower(trim(b.doi)) LEFT JOIN matched m ON m.doc_id = t.doc_id),
verified AS (SELECT doc_id,
 CASE WHEN doi IS NULL AND found IS NOT NULL AND sim >= 0.4 THEN found WHEN doi IS NULL THEN NULL WHEN (rs IS NULL OR rs < 0.2) AND found IS NOT NULL AND confidence < 0.9 AND sim >= greatest(0.6, coalesce(rs, 0) + 0.25) THEN found ELSE doi END AS doi,
 round(CASE WHEN doi IS NULL AND found IS NOT NULL AND sim >= 0.4 THEN least(1.0, sim + 0.6) WHEN doi IS NULL THEN NULL
  WHEN (rs IS NULL OR rs < 0.2) AND found IS NOT NULL AND confidence < 0.9 AND sim >= greatest(0.6, coalesce(rs, 0) + 0.25) THEN least(1.0, sim + 0.55)
  WHEN rs IS NULL OR rs < 0.2 THEN greatest(confidence * 0.7, 0.3) ELSE least(1.0, confidence + 0.2 + rs) END, 6) AS confidence,
 (doi IS NULL AND found IS NOT NULL AND sim >= 0.4) OR (doi IS NOT NULL AND (rs IS NULL OR rs < 0.2) AND found IS NOT NULL AND confidence < 0.9 AND sim >= greatest(0.6, coalesce(rs, 0) + 0.25)) AS doi_from_title_search
 FROM own)"""


def license_sql(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN NULL " + " ".join(f"WHEN regexp_matches(lower(trim({x})), '{p}') THEN '{n}'" for p, n in LICENSES) + f" ELSE {collapse(x)} END"


_LICENSE_LINES = rf"""
lic AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?im)^[^\n]*(?:license|licence|creative commons|cc[- ]by|cc0)[^\n]*$')) AS line FROM documents)"""

_COLUMNS = """
c0 AS (SELECT page_id, word_id, page_width, (x0 + x1) / 2 AS center FROM words_view),
c1 AS (SELECT *, lead(center) OVER (PARTITION BY page_id ORDER BY center, word_id) AS next, count(*) OVER (PARTITION BY page_id) AS words, row_number() OVER (PARTITION BY page_id ORDER BY center, word_id) AS rank FROM c0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY next - center DESC, center, word_id) AS n FROM c1 WHERE next IS NOT NULL),
splits AS (SELECT page_id, (center + next) / 2 AS split FROM c2 WHERE n = 1 AND next - center >= 0.15 * page_width AND (center + next) / 2 BETWEEN 0.35 * page_width AND 0.65 * page_width
 AND rank >= 0.25 * words AND words - rank >= 0.25 * words)"""
_LAYOUT = (
    _COLUMNS
    + """,
wcol AS (SELECT w.*, CASE WHEN (x0 + x1) / 2 > split THEN 1 ELSE 0 END AS col FROM words_view w LEFT JOIN splits USING (page_id)),
w1 AS (SELECT *, CASE WHEN abs(top - lag(top) OVER (PARTITION BY page_id, col ORDER BY top, x0, word_id)) > 2.5 THEN 1 ELSE 0 END AS opens FROM wcol),
lines AS (SELECT * EXCLUDE (opens), CAST(sum(opens) OVER (PARTITION BY page_id, col ORDER BY top, x0, word_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM w1)"""
)

_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _mark(x: str) -> str:
    return f"coalesce({x} <> '' AND contains('.!?;', {x}), false)"


_D = "docs_view"
_PROGRESS = """
per AS (SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('done', 'error')) AS current, count(*) FILTER (status IN ('queued', 'processing')) AS remaining FROM docs_view GROUP BY job_id),
prog AS (SELECT j.job_id, j.status, coalesce(total, 0) AS total, coalesce(current, 0) AS current, coalesce(remaining, 0) AS remaining,
 CAST(coalesce(CASE WHEN total > 0 THEN round_even(current / total * 100, 0) END, 0) AS INT) AS percent FROM jobs_view j LEFT JOIN per USING (job_id))"""
_OPEN, _FAILED, _DONE = ("SELECT job_id FROM jobs_view WHERE status IN " + x for x in ("('pending', 'running')", "('error')", "('done')"))

SQL = {
    "validate_doi": f"SELECT doc_id, raw, doi FROM ({doi_of('(SELECT doc_id, text AS raw FROM papers_view WHERE seq = 2)', 'raw', 'doc_id, raw')})",
    "doi_candidates_scored": f"WITH {DOIS} SELECT * FROM candidates",
    "doi_best_per_paper": f"WITH {DOIS} SELECT * FROM best",
    "doi_registry_verify": f"WITH {DOIS}, {_TITLES}, {_MATCH}, {_VERIFY} SELECT * FROM verified",
    "title_similarity_best_match": f"WITH {_TITLES}, {_MATCH} SELECT doc_id, doi, round(similarity, 6) AS similarity, source FROM matched",
    "heuristic_title": rf"""
WITH c AS (SELECT doc_id, seq, {collapse("text")} AS title FROM papers_view WHERE page = 1 AND col = 0)
SELECT doc_id, min_by(title, seq) AS title FROM c WHERE NOT regexp_matches(title, '{HEADER}') AND NOT ends_with(title, ':') AND length(title) BETWEEN 8 AND 250 AND {n_words("title")} BETWEEN 2 AND 40
 AND NOT regexp_matches(title, '(?i)\b(?:{"|".join(TITLE_STOPWORDS)})\b') AND {alpha("title")} >= 0.4 GROUP BY doc_id""",
    "resolved_title": f"WITH {_LINES} SELECT * FROM title",
    "segment_paragraphs": f"WITH {SEGMENTS} SELECT * FROM seg",
    "rank_contexts_topk": f"WITH {CONTEXTS} SELECT * FROM ctx",
    "availability_statement": f"WITH {STATEMENTS} SELECT * FROM stmt",
    "availability_status": f"WITH {STATUS} SELECT * FROM status",
    "extract_links": f"WITH {LINKS} SELECT * FROM links",
    "classify_links": rf"""
WITH u AS (SELECT page_id, CASE WHEN starts_with(trim(url), 'www.') THEN 'https://' || trim(url) ELSE trim(url) END AS u FROM pages),
i AS (SELECT page_id, regexp_replace(u, '[),.;\]]+$', '') AS url FROM u WHERE regexp_matches(u, '(?i)^https?://')
 UNION ALL SELECT doc_id, regexp_replace(raw, '[),.;\]]+$', '') FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(https?://[^\s)]+)', 1)) AS raw FROM papers_view)),
k AS (SELECT DISTINCT page_id AS id, url, CASE WHEN {has("lower(url)", DATA_HINTS)} THEN 'data' WHEN {has("lower(url)", CODE_HINTS)} THEN 'code' ELSE 'other' END AS kind FROM i)
SELECT * FROM k""",
    "url_domains": f"SELECT {domain('url')} AS domain, count(*) AS n, count(*) FILTER ({is_url('url')}) AS valid FROM pages GROUP BY 1",
    "url_repair": r"SELECT doc_id, seq, regexp_replace(text, '(https?://[a-z]+)\s+([a-z]+\.(?:org|com|io))', '\1\2', 'g') AS text FROM papers_view WHERE contains(text, 'http')",
    # one URL a step: what is before its scheme is done, then the run up to an end word, another character or the most characters
    "layout_url_repair": rf"""
WITH RECURSIVE u0 AS (
 SELECT doc_id, seq, '' AS done, regexp_replace(regexp_replace(regexp_replace(text, '{INVISIBLE}', '', 'g'), '{GATEWAY}', '', 'g'), '(?i)(https?)\s*:\s*/\s*/\s*', '\1://', 'g') AS rest
 FROM papers_view WHERE contains(text, 'http')
 UNION ALL
 SELECT doc_id, seq, done || before || scheme || regexp_replace(run, '[ \t\n\r]', '', 'g'), substr(tail, length(run) + 1)
 FROM (SELECT *, CASE WHEN full_ <> '' THEN full_ ELSE piece END AS run
  FROM (SELECT *, regexp_extract(piece, '^(?:[ \t\n\r]*[^ \t\n\r]){{{URL_CHARS}}}', 0) AS full_
   FROM (SELECT *, left(tail, CAST(least(length(regexp_extract(tail, '^(?:[ \t\n\r]|{URL_CLASS})*', 0)), {", ".join(f"CASE WHEN contains(tail, ' {w} ') THEN instr(tail, ' {w} ') - 1 END" for w in URL_ENDS)}) AS INT)) AS piece
    FROM (SELECT *, left(rest, instr(rest, scheme) - 1) AS before, substr(rest, instr(rest, scheme) + length(scheme)) AS tail
     FROM (SELECT *, regexp_extract(rest, '(?i)https?://', 0) AS scheme FROM u0) WHERE scheme <> '')))))
SELECT doc_id, seq, done || rest AS text FROM u0 WHERE NOT regexp_matches(rest, '(?i)https?://')""",
    "sanitize_filename": r"SELECT doc_id, CASE WHEN f = '' THEN 'unnamed.pdf' ELSE f END AS safe, lower(regexp_extract(filename, '[^/]*$', 0)) AS base FROM (SELECT doc_id, filename, regexp_replace(replace(replace(filename, '/', '_'), '\', '_'), '^[. ]+', '') AS f FROM docs_view)",
    "file_gate": "SELECT job_id, count(*) AS files, count(*) FILTER (lower(split_part(filename, '.', -1)) = 'pdf') AS pdf, count(*) FILTER (size_bytes <= 50000) AS small FROM docs_view GROUP BY job_id",
    "pdf_magic_gate": "SELECT status, n_code_links, count(*) AS n, CAST(sum(CASE WHEN n_data_links > 0 THEN 1 ELSE 0 END) AS BIGINT) AS pdf FROM docs_view GROUP BY ALL",
    "license_normalize": f"WITH {_LICENSE_LINES} SELECT doc_id, line, {license_sql('line')} AS license FROM lic",
    "license_rollup": f"WITH {_LICENSE_LINES} SELECT {license_sql('line')} AS license, count(*) AS n, count(DISTINCT doc_id) AS docs FROM lic GROUP BY 1",
    "quality_warnings": f"""
WITH {STATUS},
p AS (SELECT doc_id, max(statement) FILTER (kind = 'data') AS ds, max(statement) FILTER (kind = 'code') AS cs, sum(n_links) AS n FROM counted GROUP BY doc_id),
w AS (SELECT doc_id, 0 AS o, 'data_statement_truncated_url' AS warning FROM p WHERE regexp_matches(trim(ds), 'https:?$')
 UNION ALL SELECT doc_id, 1, 'code_statement_truncated_url' FROM p WHERE regexp_matches(trim(cs), 'https:?$')
 UNION ALL SELECT doc_id, 2, 'data_fused_links_possible' FROM p WHERE len(regexp_extract_all(lower(ds), 'https?://')) > n + 1
 UNION ALL SELECT doc_id, 3, 'code_fused_links_possible' FROM p WHERE len(regexp_extract_all(lower(cs), 'https?://')) > n + 1
 UNION ALL SELECT doc_id, 4, 'data_license_missing_version' FROM p WHERE doc_id % 2 = 0)
SELECT doc_id, warning FROM w""",
    "sentence_split": rf"""
WITH a AS (SELECT doc_id, regexp_split_to_array(text, '[.!?;]{_WS}+') AS t, regexp_extract_all(text, '([.!?;]){_WS}+', 1) AS m FROM documents),
b AS (SELECT doc_id, list_filter(flatten(list_transform(range(1, len(t) + 1), lambda i: [t[i], m[i]])), lambda x: x IS NOT NULL) AS l FROM a),
c AS (SELECT doc_id, list_transform(range(1, len(l) + 1), lambda i: CASE
  WHEN {_mark("l[i]")} THEN l[i] || CASE WHEN {_stripped("l[i + 1]")} IS NULL OR {_stripped("l[i + 1]")} = '' OR regexp_matches({_stripped("l[i + 1]")}, '^[\p{{Lu}}\p{{Nd}}]') THEN chr(1) WHEN {_mark("l[i + 1]")} THEN '' ELSE ' ' END
  ELSE {_stripped("l[i]")} || CASE WHEN {_mark("l[i + 1]")} THEN '' ELSE ' ' END END) AS z FROM b),
d AS (SELECT doc_id, list_filter(list_transform(string_split(array_to_string(z, ''), chr(1)), lambda s: {_stripped("s")}), lambda s: s <> '') AS s FROM c)
SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM d""",
    "dehyphenate_and_collapse": rf"SELECT doc_id, {collapse(r'''regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g')''')} AS text FROM documents",
    "content_sha256_duplicates": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "text_blocks_meta": r"""
SELECT doc_id, count(*) AS blocks, count(*) FILTER (page = 1) AS first_page_blocks, count(DISTINCT CASE WHEN page = 1 THEN col END) AS first_page_columns, substr(min_by(text, seq), 1, 200) AS preview,
 round(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: regexp_matches(t, '^[A-Za-z]$')))) / nullif(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> ''))), 0), 6) AS singletons
FROM papers_view GROUP BY doc_id""",
    "chunk_documents": """
WITH n AS (SELECT doc_id, text, greatest(0, CAST(ceil((length(text) - 250) / 1550) AS BIGINT) - 1) AS last FROM documents WHERE text <> ''),
c AS (SELECT doc_id, text, unnest(range(0, last + 1)) AS chunk FROM n)
SELECT doc_id, chunk, substr(text, chunk * 1550 + 1, 1800) AS text FROM c""",
    "vector_topk_within": """
WITH q AS (SELECT label, vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT label, query_id, vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), q) AS similarity FROM q JOIN embeddings USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM s)
SELECT label, query_id, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 4""",
    "vector_topk": """
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), q) AS similarity FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 4""",
    "context_concat_capped": """
WITH f AS (SELECT doc_id, text, min(seq) AS ord FROM papers_view WHERE text <> '' GROUP BY doc_id, text),
b AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT doc_id, substr(string_agg(text, chr(10) ORDER BY ord), 1, 300) AS context FROM b WHERE before < 300 GROUP BY doc_id""",
    "layout_columns": f"WITH {_COLUMNS} SELECT * FROM splits",
    "layout_lines": f"WITH {_LAYOUT} SELECT page_id, col, line, count(*) AS words, min(top) AS top FROM lines GROUP BY ALL",
    "layout_tokens": f"""
WITH {_LAYOUT}, t0 AS (SELECT *, greatest(1.0, 0.6 * median(x1 - x0) OVER (PARTITION BY page_id, col, line)) AS lim FROM lines),
t1 AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page_id, col, line ORDER BY x0, word_id) > lim THEN 1 ELSE 0 END AS opens FROM t0),
t2 AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY page_id, col, line ORDER BY x0, word_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS token FROM t1)
SELECT page_id, col, line, token, min(x0) AS x0, max(x1) AS x1, count(*) AS words FROM t2 GROUP BY page_id, col, line, token""",
    "layout_paragraphs": f"""
WITH {_LAYOUT}, p0 AS (SELECT page_id, col, line, min(top) AS top, arg_max(bottom, (top, x0, word_id)) AS bottom, count(*) AS words FROM lines GROUP BY page_id, col, line),
p1 AS (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY page_id, col ORDER BY line) > 12 THEN 1 ELSE 0 END AS opens FROM p0),
p2 AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY page_id, col ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM p1)
SELECT page_id, col, paragraph, count(*) AS lines, CAST(sum(words) AS BIGINT) AS words FROM p2 GROUP BY page_id, col, paragraph""",
    "llm_response_parse": f"SELECT doc_id, CASE WHEN k IN (0, 2) THEN {canonical(repair_spacing('text'))} END AS statement, CAST(CASE WHEN k IN (0, 2) THEN 0.9 END AS DOUBLE) AS confidence FROM papers_view WHERE seq = 5",
    "list_jobs_newest": "SELECT job_id, user_id, status, created_at FROM jobs_view ORDER BY created_at DESC, job_id DESC LIMIT 100",
    "list_user_jobs": "SELECT job_id, user_id, status, created_at FROM jobs_view WHERE user_id = 7 ORDER BY created_at DESC, job_id DESC LIMIT 100",
    "list_pending": "SELECT job_id, user_id, status, created_at FROM jobs_view WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 100",
    "queue_position": "SELECT job_id, created_at, rank() OVER (ORDER BY created_at) AS queue_position FROM jobs_view WHERE status = 'pending'",
    "promote_next_job": """
SELECT job_id, created_at FROM jobs_view WHERE status = 'pending'
 AND NOT EXISTS (SELECT 1 FROM jobs_view j JOIN docs_view d ON d.job_id = j.job_id WHERE j.status = 'running' AND d.status IN ('queued', 'processing'))
ORDER BY created_at, job_id LIMIT 1""",
    "claim_next_document": "SELECT job_id, doc_id, created_at FROM (SELECT job_id, doc_id, created_at, row_number() OVER (PARTITION BY job_id ORDER BY created_at, doc_id) AS n FROM docs_view WHERE status = 'queued') WHERE n = 1",
    "job_progress": f"WITH {_PROGRESS} SELECT * FROM prog",
    "jobs_to_finalize": "SELECT job_id FROM jobs_view j WHERE status = 'running' AND EXISTS (SELECT 1 FROM docs_view d WHERE d.job_id = j.job_id) AND NOT EXISTS (SELECT 1 FROM docs_view d WHERE d.job_id = j.job_id AND d.status IN ('queued', 'processing', 'uploaded'))",
    "jobless_documents": "SELECT doc_id, job_id FROM docs_view d WHERE status = 'queued' AND NOT EXISTS (SELECT 1 FROM jobs_view j WHERE j.job_id = d.job_id AND j.status <> 'error')",
    "job_detail": f"""
WITH {_PROGRESS} SELECT p.job_id, p.status, p.total, p.current, p.percent, CAST(floor((epoch_us(j.finished_at) - epoch_us(j.started_at)) / 1000) AS BIGINT) AS duration_ms, j.error FROM prog p JOIN jobs_view j USING (job_id)""",
    "cancel_job": f"""
SELECT doc_id, job_id, CASE WHEN hit THEN 'error' ELSE status END AS status, CASE WHEN hit THEN 'Cancelled by user' ELSE error END AS error
FROM (SELECT *, job_id IN ({_OPEN}) AND status IN ('queued', 'processing', 'uploaded') AS hit FROM docs_view)""",
    "rerun_job": f"SELECT job_id + 100000000 AS job_id, doc_id || '-r' AS doc_id, filename, size_bytes, 'queued' AS status FROM docs_view WHERE job_id IN (SELECT job_id FROM jobs_view WHERE status IN ('done', 'error') AND job_id IN ({_FAILED}))",
    "delete_job": f"SELECT doc_id, job_id FROM docs_view WHERE job_id NOT IN ({_DONE})",
    "cancel_job_rows": f"SELECT job_id, CASE WHEN hit THEN 'error' ELSE status END AS status, CASE WHEN hit THEN 'Cancelled by user' ELSE error END AS error FROM (SELECT *, job_id IN ({_OPEN}) AS hit FROM jobs_view)",
    "rerun_job_rows": f"SELECT j.job_id + 100000000 AS job_id, j.job_id AS original_job_id, user_id, 'pending' AS status, TIMESTAMP '2024-06-01 00:00:00' AS created_at, total FROM jobs_view j JOIN (SELECT job_id, count(*) AS total FROM docs_view GROUP BY job_id) USING (job_id) WHERE status IN ('done', 'error') AND job_id IN ({_FAILED})",
    "delete_job_rows": f"SELECT job_id, status FROM jobs_view WHERE job_id NOT IN ({_DONE})",
    "job_op_sequence": "SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, log_id) - 1 AS pos, op FROM logs_view",
    "log_download": "SELECT l.job_id, l.log_id, l.op, NULL AS info FROM logs_view l WHERE l.job_id IN (SELECT job_id FROM jobs_view) UNION ALL SELECT job_id, NULL, NULL, 'no logs available' FROM jobs_view WHERE job_id NOT IN (SELECT job_id FROM logs_view)",
    "list_jobs_admin": """
WITH q AS (SELECT job_id, rank() OVER (ORDER BY created_at) AS queue_position FROM jobs_view WHERE status = 'pending')
SELECT j.job_id, j.status, j.user_id, c.c_name AS email, q.queue_position, CAST(floor((epoch_us(j.finished_at) - epoch_us(j.started_at)) / 1000) AS BIGINT) AS duration_ms
FROM jobs_view j LEFT JOIN q USING (job_id) LEFT JOIN customer c ON c.c_custkey = j.user_id""",
    "workflow_report": """
WITH r AS (SELECT user_id, status = 'done' AS success, (epoch_us(finished_at) - epoch_us(started_at)) / 1000 AS ms, status = 'done' AND coalesce(t, false) AND coalesce(d, false) AS accurate
 FROM jobs_view LEFT JOIN (SELECT job_id, bool_and(title IS NOT NULL) AS t, bool_and(doi IS NOT NULL) AS d FROM docs_view GROUP BY job_id) USING (job_id))
SELECT user_id, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, round(count(*) FILTER (success) * 100 / count(*), 1) AS success_rate,
 round(avg(ms) FILTER (success), 3) AS avg_ms, CAST(min(ms) FILTER (success) AS BIGINT) AS min_ms, CAST(max(ms) FILTER (success) AS BIGINT) AS max_ms,
 count(*) FILTER (accurate) AS accurate, round(count(*) FILTER (accurate) * 100 / nullif(count(*) FILTER (success), 0), 1) AS accuracy_rate FROM r GROUP BY user_id""",
    "status_fold": "SELECT job_id, arg_max(op, (ts, log_id)) AS op, max(ts) AS at, count(*) AS events FROM logs_view GROUP BY job_id",
    "status_fold_incremental": "SELECT job_id, arg_max(op, (ts, log_id)) AS op, max(ts) AS at, count(*) AS events FROM logs_view GROUP BY job_id",
    "job_logs_page": "SELECT log_id, job_id, ts, op FROM logs_view WHERE (ts, log_id) > (TIMESTAMP '2024-01-10 00:00:00', 0) ORDER BY ts, log_id LIMIT 1000",
    "job_logs_page_desc": "SELECT log_id, job_id, ts, op FROM logs_view ORDER BY ts DESC, log_id DESC LIMIT 1000",
    "job_log_rollup": """
WITH s AS (SELECT job_id, count(*) AS total_logs, count(*) FILTER (level = 'error') AS error_logs_count, arg_min(log_id, (ts, log_id)) FILTER (level = 'error') AS first_error, arg_max(op, (ts, log_id)) AS last_phase FROM logs_view GROUP BY job_id),
t AS (SELECT job_id, string_agg(CAST(log_id AS VARCHAR), ',' ORDER BY ts, log_id) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, log_id DESC) AS n FROM logs_view WHERE level = 'error') WHERE n <= 5 GROUP BY job_id)
SELECT j.job_id, j.error AS job_error_field, coalesce(total_logs, 0) AS total_logs, coalesce(error_logs_count, 0) AS error_logs_count, first_error, last_phase, coalesce(tail, '') AS error_log_tail
FROM jobs_view j LEFT JOIN s USING (job_id) LEFT JOIN t USING (job_id)""",
    "job_quality_rollup": """
WITH q AS (SELECT job_id, list_sort(list(confidence) FILTER (status = 'done')) AS l, count(*) AS total_docs, count(*) FILTER (status = 'error') AS error_docs, count(*) FILTER (status = 'done') AS analyzed_docs,
 count(*) FILTER (status = 'done' AND title IS NULL) AS missing_title, count(*) FILTER (status = 'done' AND doi IS NULL) AS missing_doi,
 count(*) FILTER (status = 'done' AND n_data_links = 0) AS empty_data_links, count(*) FILTER (status = 'done' AND n_code_links = 0) AS empty_code_links, round(avg(confidence) FILTER (status = 'done'), 6) AS confidence_mean, arg_min(error, (created_at, doc_id)) FILTER (error IS NOT NULL) AS sample_error FROM docs_view GROUP BY job_id)
SELECT * EXCLUDE (l), round(l[CAST(floor(0.25 * (len(l) - 1)) AS BIGINT) + 1], 6) AS confidence_p25, round(l[CAST(floor(0.75 * (len(l) - 1)) AS BIGINT) + 1], 6) AS confidence_p75 FROM q""",
    "export_csv_rows": """
SELECT job_id, doc_id, split_part(filename, '/', -1) AS filename, coalesce(title, '') AS title, coalesce(doi, '') AS doi, n_data_links AS data_links_count, n_code_links AS code_links_count
FROM docs_view d WHERE status IN ('done', 'error') AND EXISTS (SELECT 1 FROM jobs_view j WHERE j.job_id = d.job_id)""",
    "export_documents": f"""
WITH {STATUS}, {DOIS}, {_LINES}, titles AS (SELECT doc_id, title FROM title), {_MATCH}, {_VERIFY},
per AS (SELECT doc_id, kind, max(statement) AS statement FROM stmt GROUP BY doc_id, kind),
urls AS (SELECT doc_id, kind, count(*) AS n, string_agg(url, '; ' ORDER BY pos) AS l FROM links GROUP BY doc_id, kind),
f AS (SELECT *, coalesce(filename, 'unknown.pdf') AS file FROM runs_view WHERE status IN ('done', 'error'))
SELECT f.job_id, file AS source_file, split_part(file, '/', -1) AS filename, coalesce(t.title, '') AS title, CASE WHEN t.title IS NULL THEN '' ELSE 'heuristic' END AS title_source, coalesce(v.doi, '') AS doi,
 CASE WHEN v.doi_from_title_search THEN 'true' ELSE '' END AS doi_from_title_search, coalesce(pd.statement, '') AS data_availability_statement, coalesce(pc.statement, '') AS code_availability_statement,
 '' AS data_sharing_license, '' AS code_license, CAST(coalesce(ud.n, 0) AS VARCHAR) AS data_links_count, CAST(coalesce(uc.n, 0) AS VARCHAR) AS code_links_count, coalesce(ud.l, '') AS data_links, coalesce(uc.l, '') AS code_links, coalesce(f.error, '') AS error
FROM f LEFT JOIN title t ON t.doc_id = f.doc_id LEFT JOIN verified v ON v.doc_id = f.doc_id LEFT JOIN per pd ON pd.doc_id = f.doc_id AND pd.kind = 'data' LEFT JOIN per pc ON pc.doc_id = f.doc_id AND pc.kind = 'code'
 LEFT JOIN urls ud ON ud.doc_id = f.doc_id AND ud.kind = 'data' LEFT JOIN urls uc ON uc.doc_id = f.doc_id AND uc.kind = 'code'""",
    "llm_prompts": f"WITH {CONTEXTS} SELECT doc_id, {' || chr(10) || '.join(map(text, RULES))} || chr(10) || string_agg('[' || kind || ' ' || rank || '] ' || text, chr(10) ORDER BY kind, rank) AS prompt FROM ctx GROUP BY doc_id",
    "export_records": f"""
WITH {STATUS}, {DOIS}, {_LINES}, titles AS (SELECT doc_id, title FROM title), {_MATCH}, {_VERIFY},
per AS (SELECT doc_id, kind, max(statement) AS statement FROM stmt GROUP BY doc_id, kind),
urls AS (SELECT doc_id, kind, count(*) AS n, string_agg(url, '; ' ORDER BY pos) AS l FROM links GROUP BY doc_id, kind)
SELECT CAST(t.doc_id AS VARCHAR) AS source_file, 'unknown.pdf' AS filename, coalesce(t.title, '') AS title, 'heuristic' AS title_source, coalesce(v.doi, '') AS doi,
 CASE WHEN v.doi_from_title_search THEN 'true' ELSE '' END AS doi_from_title_search, coalesce(pd.statement, '') AS data_availability_statement, coalesce(pc.statement, '') AS code_availability_statement,
 '' AS data_sharing_license, '' AS code_license, CAST(coalesce(ud.n, 0) AS VARCHAR) AS data_links_count, CAST(coalesce(uc.n, 0) AS VARCHAR) AS code_links_count, coalesce(ud.l, '') AS data_links, coalesce(uc.l, '') AS code_links, '' AS error
FROM title t JOIN verified v ON v.doc_id = t.doc_id LEFT JOIN per pd ON pd.doc_id = t.doc_id AND pd.kind = 'data' LEFT JOIN per pc ON pc.doc_id = t.doc_id AND pc.kind = 'code'
 LEFT JOIN urls ud ON ud.doc_id = t.doc_id AND ud.kind = 'data' LEFT JOIN urls uc ON uc.doc_id = t.doc_id AND uc.kind = 'code'""",
    "layout_line_text": f"WITH {_LAYOUT} SELECT page_id, col, line, coalesce(string_agg(trim(text), ' ' ORDER BY x0, word_id) FILTER (trim(text) <> ''), '') AS text FROM lines GROUP BY page_id, col, line",
    "split_simple": r"""
WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS l FROM documents)
SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS text FROM a""",
    "export_ndjson_rows": r"""
SELECT '{"log_id":' || log_id || ',"job_id":' || job_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '","op":' || to_json(op) || ',"level":' || to_json(level)
 || ',"duration_ms":' || duration_ms || CASE WHEN extra IS NULL THEN '' ELSE ',"extra":' || to_json(extra) END || '}' AS value FROM logs_view""",
    "logs_tumbling": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, op, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM logs_view GROUP BY 1, 2",
    "logs_session": """
WITH o AS (SELECT job_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM logs_view),
s AS (SELECT job_id, ts, CAST(sum(opens) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM o)
SELECT job_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY job_id, s""",
    "registry_cache_distinct": f"SELECT DISTINCT lower(trim(doi)) AS key FROM ({doi_of('(SELECT text AS raw FROM papers_view WHERE seq = 2)', 'raw', 'raw')}) WHERE doi IS NOT NULL",
    "paper_record": f"""
WITH {STATUS}, {DOIS}, {_LINES}, titles AS (SELECT doc_id, title FROM title), {_MATCH}, {_VERIFY},
pivoted AS (SELECT doc_id, max(status) FILTER (kind = 'data') AS data_status, max(status) FILTER (kind = 'code') AS code_status, max(n_links) FILTER (kind = 'data') AS data_links, max(n_links) FILTER (kind = 'code') AS code_links FROM status GROUP BY doc_id),
said AS (SELECT doc_id, max(statement) FILTER (kind = 'data') AS data_statement, max(statement) FILTER (kind = 'code') AS code_statement FROM stmt GROUP BY doc_id)
SELECT t.doc_id, t.title, v.doi, v.doi_from_title_search, data_statement, code_statement, data_status, code_status, data_links, code_links
FROM title t JOIN verified v USING (doc_id) LEFT JOIN pivoted USING (doc_id) LEFT JOIN said USING (doc_id)""",
}

ORACLES = {name: with_views(sql) for name, sql in SQL.items()}
