"""SQL (of DuckDB) that yields the rows of the registered queries from the same tables."""

from __future__ import annotations

from lodestone.operators.index import BOOSTS
from lodestone.operators.search import COVERAGE, EXACT, PHRASE, checked
from lodestone.plans.queries import SEARCH
from lodestone.sources import notes

W = r"[\s\p{Z}]"
FILES = f"files AS (SELECT {notes.PATH} AS path, text AS content FROM documents)"
NOTES = f"files AS ({notes.SQL})"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def lines(x: str) -> str:
    return rf"CASE WHEN {x} = '' THEN [] WHEN ends_with({x}, chr(10)) THEN string_split_regex({x}, '\r?\n')[:-2] ELSE string_split_regex({x}, '\r?\n') END"


def identity(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[\"'']', '', 'g'), '[#]|[._/\\-]+', ' ', 'g'), '{W}+', ' ', 'g'))"


def stem(x: str) -> str:
    return rf"regexp_extract({x}, '(?s)^(?:.*/)?(.+?)(\.[^.]*)?$', 1)"


def folders(x: str) -> str:
    return f"string_split({x}, '/')[:-2]"


def distinct(x: str) -> str:
    """A list's values at their first places, without ''."""
    return f"list_filter({x}, lambda v, i: v <> '' AND list_position({x}, v) = i)"


def unquoted(x: str) -> str:
    t = trim(x)
    return f"CASE WHEN (starts_with({t}, '\"') AND ends_with({t}, '\"')) OR (starts_with({t}, '''') AND ends_with({t}, '''')) THEN {trim(f'substr({t}, 2, greatest(length({t}) - 2, 0))')} ELSE {t} END"


def numbered_cells(cells: str) -> str:
    return f"coalesce(array_to_string(list_transform({cells}, lambda s: CAST(s.line AS VARCHAR) || ':' || s.text), chr(10)), '')"


def cells(of: str) -> str:
    """A list of lines as (line, text)."""
    return f"list_transform({of}, lambda x, i: {{'line': i, 'text': x}})"


def grep(files: str, hit: str, limit: str = "", context: int = 0) -> str:
    around = f", {numbered_cells(f'c[greatest(i - {context}, 1):i - 1]')} AS context_before, {numbered_cells(f'c[i + 1:i + {context}]')} AS context_after" if context else ""
    return f"""WITH {files}, l AS (SELECT path, {cells(lines('content'))} AS c FROM files),
m AS (SELECT path, c, unnest(range(1, len(c) + 1)) AS i FROM l)
SELECT path, i AS line, c[i].text AS text{around} FROM m WHERE {hit.format(x='c[i].text')} {limit}"""


def read(start: str, end: str, ok: str = "true", cap: int = 20000, extra: str = "") -> str:
    capped = lambda c: f"CASE WHEN length({c}) > {cap} THEN substr({c}, 1, {cap}) || chr(10) || '... truncated ...' ELSE {c} END"
    return f"""WITH {FILES}, a AS (SELECT path, {lines('content')} AS a FROM files), b AS (SELECT *, len(a) AS total {extra} FROM a),
c AS (SELECT path, total, a, {start} AS s, {end} AS e FROM b WHERE {ok}),
d AS (SELECT *, array_to_string(a[s:e], chr(10)) AS content, array_to_string(list_transform(a[s:e], lambda x, i: lpad(CAST(s + i - 1 AS VARCHAR), CAST(length(CAST(greatest(s + len(a[s:e]) - 1, 1) AS VARCHAR)) AS INTEGER), ' ') || ' | ' || x), chr(10)) AS n FROM c)
SELECT path, CAST(s AS BIGINT) AS first_line, CAST(e AS BIGINT) AS last_line, CAST(total AS BIGINT) AS total, length(n) > {cap} AS truncated, {capped('content')} AS content, {capped('n')} AS numbered_text FROM d"""


def listed(keys: str, tag: bool) -> str:
    pattern = rf"'(?im)^(?:{keys}):[ \t]*(.*)((?:\n[ \t]+-[ \t]+.*)*)'"
    bare = lambda r: f"CASE WHEN starts_with({r}, '[') AND ends_with({r}, ']') THEN substr({r}, 2, greatest(length({r}) - 2, 0)) ELSE {r} END"
    item = (lambda v: trim(f"regexp_replace({unquoted(v)}, '^#+', '')")) if tag else unquoted
    inline = f"list_transform(list_filter(list_transform(string_split({bare(trim('p.a'))}, ','), lambda v: {unquoted('v')}), lambda v: v <> ''), lambda v: {item('v')})"
    below = rf"list_transform(list_filter(string_split(p.b, chr(10)), lambda v: v <> ''), lambda v: {item(r'''regexp_replace(v, '^\s+-\s+', '')''')})"
    pairs = f"list_transform(list_zip(regexp_extract_all(yaml, {pattern}, 1), regexp_extract_all(yaml, {pattern}, 2)), lambda q: {{'a': q[1], 'b': q[2]}})"
    return f"flatten(list_transform({pairs}, lambda p: CASE WHEN p.b <> '' THEN {below} ELSE {inline} END))"


HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
TAG = r"(^|[\s(\[>{])#([\p{L}\p{N}_/-]+)"


def docs(files: str = NOTES, name: str = "docs") -> str:
    """CTEs that end in one of parsed notes."""
    p = name
    return rf"""{files}, {p}1 AS (SELECT path, content, string_split_regex(content, '\r?\n') AS a FROM files),
{p}2 AS (SELECT *, CASE WHEN starts_with(content, '---' || chr(10)) OR starts_with(content, '---' || chr(13) || chr(10)) THEN coalesce(list_position(list_transform(a[2:], lambda x: {trim('x')} IN ('---', '...')), true), 0) ELSE 0 END AS k FROM {p}1),
{p}3 AS (SELECT path, content, CASE WHEN k > 0 THEN array_to_string(a[2:k], chr(10)) ELSE '' END AS yaml, CASE WHEN k > 0 THEN array_to_string(a[k + 2:], chr(10)) ELSE content END AS body FROM {p}2),
{p}4 AS (SELECT *, list_filter(list_transform(regexp_extract_all(yaml, '(?im)^title:[ \t]*(.*)', 1), lambda x: {trim('x')}), lambda x: x <> '') AS given,
  list_filter(string_split_regex(body, '\r?\n'), lambda x: regexp_matches(x, '{HEADING}')) AS h,
  {listed('aliases|alias', False)} AS al, list_concat({listed('tags', True)}, regexp_extract_all(body, '{TAG}', 2)) AS ta FROM {p}3),
{p} AS (SELECT path, content, body, list_transform(h, lambda x: {trim(f"regexp_extract(x, '{HEADING}', 2)")}) AS headings, {distinct('al')} AS aliases, {distinct('ta')} AS tags,
  coalesce(nullif(CASE WHEN len(given) > 0 THEN {unquoted('given[-1]')} END, ''), nullif({trim(f"regexp_extract(list_filter(h, lambda x: regexp_extract(x, '{HEADING}', 1) = '#')[1], '{HEADING}', 2)")}, ''),
    nullif({trim(f"regexp_replace({stem('path')}, '[_-]+', ' ', 'g')")}, ''), path) AS title FROM {p}4)"""


def fields(names: list[str] | tuple[str, ...]) -> str:
    value = {"title": "title", "aliases": "array_to_string(aliases, chr(10))", "tags": "array_to_string(tags, chr(10))", "headings": "array_to_string(headings, chr(10))", "path": "path", "body": "body"}
    each = " UNION ALL ".join(f"SELECT path, '{f}' AS field, {value[f]} AS value FROM docs" for f in names)
    return rf"""texts AS ({each}), toks AS (SELECT path, field, regexp_extract_all(lower(value), '[\p{{L}}\p{{N}}]+') AS t FROM texts),
stats AS (SELECT field, count(*) AS n, avg(len(t)) AS avg_len FROM toks GROUP BY 1),
post AS (SELECT path, field, len, token, count(*) AS tf FROM (SELECT path, field, len(t) AS len, unnest(t) AS token FROM toks) GROUP BY ALL)"""


def bm25(names: list[str] | tuple[str, ...]) -> str:
    tokens = ", ".join(f"'{t}'" for t in checked(SEARCH).tokens)
    boost = " ".join(f"WHEN '{f}' THEN {BOOSTS[f]}" for f in names)
    return f"""hit AS (SELECT * FROM post WHERE token IN ({tokens})), df AS (SELECT field, token, count(*) AS df FROM hit GROUP BY ALL),
scored AS (SELECT path, round(sum(CASE field {boost} END::DOUBLE * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)))), 6) AS score
  FROM hit JOIN df USING (field, token) JOIN stats USING (field) GROUP BY path)"""


def features(source: str = "docs", allowed: tuple[str, ...] = tuple(BOOSTS)) -> str:
    q = checked(SEARCH)
    norm = {"title": f"[{identity('title')}]", "aliases": f"list_transform(aliases, lambda x: {identity('x')})", "tags": f"list_transform(tags, lambda x: {identity('x')})", "headings": f"list_transform(headings, lambda x: {identity('x')})", "stem": f"[{identity(stem('path'))}]", "folders": f"list_transform({folders('path')}, lambda x: {identity('x')})"}
    norm = {k: v if (k if k in BOOSTS else "path") in allowed else "[]::VARCHAR[]" for k, v in norm.items()}
    any_ = lambda k, test: f"coalesce(list_bool_or(list_transform(n_{k}, lambda x: {test})), false)"
    exact = ", ".join(f"CASE WHEN {any_(k, f'''x = '{q.phrase}' ''')} THEN {r} END" for k, r in EXACT.items())
    phrase = ", ".join(f"CASE WHEN {any_(k, f'''x <> '' AND contains(x, '{q.phrase}')''')} THEN {r} END" for k, r in PHRASE.items())
    holds = lambda f, t: any_(f, f"contains(x, '{t}')") if f != "path" else f"({any_('stem', f'''contains(x, '{t}')''')} OR {any_('folders', f'''contains(x, '{t}')''')})"
    terms = " + ".join("(CASE WHEN " + " OR ".join(holds(f, t) for f in COVERAGE) + " THEN 1 ELSE 0 END)" for t in q.terms)
    score = " + ".join(f"(CASE WHEN {holds(f, t)} THEN {w} ELSE 0 END)" for t in q.terms for f, w in COVERAGE.items())
    return f"""norm AS (SELECT *, {', '.join(f'{v} AS n_{k}' for k, v in norm.items())} FROM {source}),
feat0 AS (SELECT *, least({exact}) AS exact_priority, least({phrase}) AS phrase_priority, {terms} AS coverage_terms, {score} AS coverage_score FROM norm),
feat AS (SELECT *, CASE WHEN exact_priority IS NOT NULL THEN 0 WHEN phrase_priority IS NOT NULL THEN 1 WHEN coverage_terms > 0 THEN 2 ELSE 3 END AS bucket FROM feat0)"""


def snippets(terms: list[str]) -> str:
    holds = " OR ".join(f"contains(lower(s.text), '{t}')" for t in terms) or "false"
    head = r"regexp_matches(s.text, '^#{1,6}\s+')"
    return rf"""sn0 AS (SELECT *, {lines('content')} AS l FROM best),
sn1 AS (SELECT *, CASE WHEN len(l) > 0 AND {trim('l[1]')} = '---' THEN coalesce(list_position(list_transform(l[2:], lambda x: {trim('x')} IN ('---', '...')), true), 0) ELSE 0 END AS k FROM sn0),
sn2 AS (SELECT *, list_filter({cells('l')}, lambda s: s.line > CASE WHEN k > 0 THEN k + 1 ELSE 0 END) AS b FROM sn1),
sn3 AS (SELECT *, list_filter(b, lambda s: {head} AND ({holds})) AS heads, list_filter(b, lambda s: NOT {head} AND ({holds})) AS rest FROM sn2),
sn AS (SELECT *, CASE WHEN len(rest) > 0 THEN list_concat(heads[:1], rest)[:3] WHEN len(heads) > 0 THEN heads[:3]
  WHEN len(list_filter(b, lambda s: {head})) > 0 THEN list_filter(b, lambda s: {head})[:1] ELSE list_filter(b, lambda s: {trim('s.text')} <> '')[:1] END AS snippets FROM sn3)"""


FOUND = f"path, title, CAST(position AS BIGINT) AS position, CAST(bucket AS BIGINT) AS bucket, CAST(base_rank AS BIGINT) AS base_rank, array_to_string(tags, chr(10)) AS tags, {numbered_cells('snippets')} AS snippets, score, round(rrf, 6) AS rrf"


def search(allowed: tuple[str, ...] = tuple(BOOSTS), keep: str = "true", limit: int = 10, files: str = NOTES, columns: str = FOUND) -> str:
    cover = "coverage_terms DESC, coverage_score DESC, base_rank, path"
    return f"""WITH {docs(files)}, {fields(allowed)}, {bm25(allowed)},
pool AS (SELECT * FROM scored ORDER BY score DESC, path LIMIT {checked(SEARCH, limit=limit).pool}),
cand AS (SELECT docs.*, score, row_number() OVER (ORDER BY score DESC, path) AS base_rank FROM pool JOIN docs USING (path) WHERE {keep}), {features('cand', allowed)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket = 0 ORDER BY exact_priority, base_rank, path) AS r0, row_number() OVER (PARTITION BY bucket = 1 ORDER BY phrase_priority, {cover}) AS r1, row_number() OVER (PARTITION BY bucket IN (1, 2) ORDER BY {cover}) AS r2 FROM feat),
fused AS (SELECT *, 1.0::DOUBLE / (10 + base_rank) + CASE bucket WHEN 0 THEN 4.0::DOUBLE / (10 + r0) WHEN 1 THEN 3.0::DOUBLE / (10 + r1) + 2.0::DOUBLE / (10 + r2) WHEN 2 THEN 2.0::DOUBLE / (10 + r2) ELSE 0 END AS rrf FROM ranked),
best AS (SELECT *, row_number() OVER (ORDER BY bucket, rrf DESC, path) AS position FROM fused ORDER BY bucket, rrf DESC, path LIMIT {limit}), {snippets(checked(SEARCH).terms)}
SELECT {columns} FROM sn"""


SNAPS = f"""every_doc AS (SELECT {notes.PATH} AS path, text, lang, source, CAST(doc_id AS DOUBLE) AS mtime_ms FROM documents),
old AS (SELECT path, mtime_ms, text AS content, strlen(text) AS size FROM every_doc WHERE source <> 'src5'),
new0 AS (SELECT path, mtime_ms, CASE WHEN lang = 'de' THEN text || chr(10) || '#changed' ELSE text END AS content FROM every_doc WHERE source <> 'src3'),
new AS (SELECT *, strlen(content) AS size FROM new0)"""


def edit(after: str, error: str = "NULL") -> str:
    return f"""WITH {FILES}, e AS (SELECT path, content, {after} AS a, {error} AS x FROM files),
f AS (SELECT path, a, coalesce(x, CASE WHEN a = content THEN 'Edit produced no changes' END) AS error FROM e)
SELECT 'M' AS code, path, CASE WHEN error IS NULL THEN md5(a) END AS after_md5, CAST(error AS VARCHAR) AS error FROM f"""


def rejoined(of: str) -> str:
    crlf, lf = "chr(13) || chr(10)", "chr(10)"
    one = lambda end: f"array_to_string({of}, {end}) || CASE WHEN ends_with(content, chr(10)) THEN {end} ELSE '' END"
    return f"CASE WHEN contains(content, {crlf}) THEN {one(crlf)} ELSE {one(lf)} END"


L, COUNT = lines("content"), "CAST((length(content) - length(replace(content, '{0}', ''))) // {1} AS BIGINT)"

DIFF = f"""WITH {FILES}, e AS (SELECT path, content AS x, replace(content, 'the', 'THE') AS y FROM files WHERE contains(content, 'the')),
f AS (SELECT path, {lines('x')} AS a, {lines('y')} AS b FROM e),
g AS (SELECT *, coalesce(list_min(list_filter(list_transform(a, lambda v, i: CASE WHEN v <> b[i] THEN i END), lambda v: v IS NOT NULL)), len(a) + 1) - 1 AS head, coalesce(list_max(list_filter(list_transform(a, lambda v, i: CASE WHEN v <> b[i] THEN i END), lambda v: v IS NOT NULL)), 0) AS n FROM f)
SELECT path, array_to_string(list_concat(['--- ' || path, '+++ ' || path, '@@'], list_transform(a[greatest(1, head - 2):head], lambda v: ' ' || v), list_transform(a[head + 1:n], lambda v: '-' || v), list_transform(b[head + 1:n], lambda v: '+' || v), list_transform(a[n + 1:n + 3], lambda v: ' ' || v)), chr(10)) AS diff FROM g"""


def diffed(source: str) -> str:
    """CTEs `diffed` with a column diff, from (path, before, after, ...) of a CTE."""
    first = lambda x, y: f"coalesce(list_min(list_filter(list_transform(range(1, least(len({x}), len({y})) + 1), lambda i: CASE WHEN {x}[i] <> {y}[i] THEN i END), lambda i: i IS NOT NULL)) - 1, least(len({x}), len({y})))"
    return f"""d0 AS (SELECT *, {lines('before')} AS x, {lines('after')} AS y FROM {source}),
d1 AS (SELECT *, {first('x', 'y')} AS head FROM d0),
d2 AS (SELECT *, least({first('list_reverse(x)', 'list_reverse(y)')}, len(x) - head, len(y) - head) AS tail FROM d1),
d3 AS (SELECT *, len(x) - tail AS n, len(y) - tail AS m FROM d2),
diffed AS (SELECT *, CASE WHEN before = after THEN '' ELSE array_to_string(list_concat(['--- ' || path, '+++ ' || path, '@@'], list_transform(x[greatest(1, head - 2):head], lambda v: ' ' || v), list_transform(x[head + 1:n], lambda v: '-' || v),
  list_transform(y[head + 1:m], lambda v: '+' || v), list_transform(x[n + 1:n + least(tail, least(3, tail) + greatest(0, m - n))], lambda v: ' ' || v)), chr(10)) END AS diff FROM d3)"""


#: What the notes' template (see sources/notes.py) gives, by doc_id modulo 6: lines of frontmatter and body. A block of kind 2 isn't YAML, one of kind 3 never ends.
BLOCKS = f"""{NOTES}, parts AS (SELECT {notes.PATH} AS path, doc_id % 6 AS kind, lang, source, doc_id, text,
  CASE doc_id % 6 WHEN 1 THEN ['title: "Note ' || doc_id || ' of ' || source || '"'] WHEN 4 THEN ['Title:', 'title: Alpha checklist ' || lang] ELSE [] END AS head,
  CASE doc_id % 6 WHEN 1 THEN ['tags:', '  - ' || lang, '  - ' || chr(39) || '#' || source || chr(39)] WHEN 4 THEN ['tags: project, ' || lang || ','] ELSE [] END AS tags,
  CASE doc_id % 6 WHEN 1 THEN ['aliases:', '  - Project ' || lang] ELSE [] END AS rest,
  CASE doc_id % 6 WHEN 1 THEN '# ' || {notes._HEAD} || chr(10) || chr(10) || text || chr(10) || chr(10) || '#' || lang || '/inline' || chr(10) WHEN 4 THEN text || ' (#Project) x#no ' || chr(10) END AS body FROM documents),
f AS (SELECT parts.*, content, coalesce(body, content) AS own FROM parts JOIN files USING (path))"""


def block(*lists: str) -> str:
    whole = f"list_concat({', '.join(lists)})"
    return f"'---' || chr(10) || CASE WHEN len({whole}) > 0 THEN array_to_string({whole}, chr(10)) || chr(10) ELSE '' END || '---' || chr(10) || own"


def front(after: str, error: str = "NULL") -> str:
    """Change sets of frontmatter: the text and the reason of notes whose block can be read."""
    return f"""WITH {BLOCKS}, e AS (SELECT path, content AS before, CASE kind WHEN 2 THEN 'Invalid frontmatter YAML' WHEN 3 THEN 'Frontmatter opening delimiter has no closing delimiter' ELSE {error} END AS error, {after} AS new FROM f),
g AS (SELECT path, before, error, CASE WHEN error IS NULL THEN new END AS after FROM e), {diffed('g')}
SELECT 'M' AS code, path, after, CASE WHEN after IS NOT NULL THEN diff END AS diff, CAST(error AS VARCHAR) AS error FROM diffed"""


NO_KEY, NO_LIST = "'Frontmatter key not found'", "'Frontmatter key is not a list'"
FRONT = {
    "frontmatter_read": f"""WITH {BLOCKS} SELECT path, CASE WHEN kind NOT IN (2, 3) THEN kind IN (1, 4) END AS has_frontmatter,
  CASE kind WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 1 THEN '{{"aliases":["Project ' || lang || '"],"tags":["' || lang || '","#' || source || '"],"title":"Note ' || doc_id || ' of ' || source || '"}}'
    WHEN 4 THEN '{{"Title":null,"tags":"project, ' || lang || ',","title":"Alpha checklist ' || lang || '"}}' ELSE '{{}}' END AS frontmatter, kind IN (2, 3) AS failed FROM f""",
    "frontmatter_set": front(block("head", "tags", "rest", "['status:', '  state: active', '  n: 3']")),
    "frontmatter_add": front(block("head", "CASE kind WHEN 1 THEN list_append(tags, '  - new tag') ELSE ['tags:', '  - new tag'] END", "rest"), f"CASE kind WHEN 4 THEN {NO_LIST} END"),
    "frontmatter_remove": front(block("head", "list_filter(tags, lambda x: x <> '  - en')", "rest"), f"CASE WHEN kind = 4 THEN {NO_LIST} WHEN kind <> 1 THEN {NO_KEY} WHEN lang <> 'en' THEN 'Frontmatter list value not found for key' END"),
    "frontmatter_delete": front(block("head", "rest"), f"CASE WHEN kind NOT IN (1, 4) THEN {NO_KEY} END"),
}
APPLIED = f"""WITH {BLOCKS}, h(seq, id) AS (VALUES (0, NULL), (1, 0), (2, 1), (3, 5), (4, 2), (5, NULL)),
g AS (SELECT seq, CASE seq WHEN 0 THEN 'added/note.md' WHEN 2 THEN 'moved/one.md' WHEN 5 THEN 'added/never.md' ELSE path END AS path, CASE seq WHEN 2 THEN path END AS from_path, CASE seq WHEN 0 THEN '' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE content END AS before,
  CASE seq WHEN 0 THEN '# New' || chr(10) || 'Text with $HOME and `code`' || chr(10) WHEN 1 THEN CASE WHEN ends_with(content, chr(10)) THEN content ELSE content || chr(10) END || 'appended at the end' || chr(10)
    WHEN 2 THEN replace(content, 'title: "Note 1 of ' || source || '"', 'title: Moved') WHEN 3 THEN '' END AS after FROM h LEFT JOIN f ON f.doc_id = h.id), {diffed('g')}
SELECT CAST(seq AS BIGINT) AS seq, ['A', 'M', 'M', 'D', 'M', 'A'][seq + 1] AS code, path, from_path, before, after, CASE WHEN seq IN (1, 2) THEN diff END AS diff, seq > 3 AS failed FROM diffed"""

_D = f"WITH {docs()}"
SQL: dict[str, str] = {
    "grep_literal": grep(FILES, "contains(lower({x}), 'license')", "ORDER BY string_split(path, '/'), i LIMIT 50"),
    "grep_literal_case": grep(FILES, "contains({x}, 'The and')"),
    "grep_context": grep(FILES, "contains(lower({x}), 'license')", context=2),
    "grep_regex": grep("files AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS path, text AS content FROM conversations)", "regexp_matches({x}, '(?i)(the|of) [a-z]{{3}}[.,]')"),
    "grep_regex_named": grep(FILES, "regexp_matches({x}, '(?i)(?P<first>È[a-zéè]+) ')"),
    "grep_path_scope": grep(NOTES, "contains(lower({x}), 'plan for') AND starts_with(path, 'src3/en/')"),
    "read_head": read("1", "least(5, total)"),
    "read_tail": read("greatest(1, total - 2)", "total"),
    "read_range": read("2", "least(4, total)", "2 <= total"),
    "read_around": read("greatest(1, hit - 1)", "least(total, hit + 1)", "hit > 0", extra=", coalesce(list_position(list_transform(a, lambda x: contains(x, 'the')), true), 0) AS hit"),
    "read_capped": read("1", "total", cap=200),
    "line_numbered": read("1", "total"),
    "render_read": f"SELECT path, 'path: ' || path || chr(10) || 'lines: ' || first_line || '-' || last_line || '/' || total || chr(10) || 'truncated: ' || truncated || chr(10) || chr(10) || numbered_text || chr(10) AS rendered FROM ({read('1', 'least(3, total)')})",
    "render_grep": f"""WITH {FILES}, l AS (SELECT path, {cells(lines('content'))} AS c FROM files), m AS (SELECT path, c, unnest(range(1, len(c) + 1)) AS i FROM l)
SELECT path, i AS line, array_to_string(list_transform(c[greatest(i - 1, 1):i + 1], lambda s: path || ':' || s.line || CASE WHEN s.line < i THEN '-' WHEN s.line = i THEN ':' ELSE '+' END || ' | ' || s.text), chr(10)) AS rendered FROM m WHERE contains(lower(c[i].text), 'license')""",
    "render_changes": f"SELECT path, CASE WHEN error IS NULL THEN code || ' ' || path ELSE 'error: ' || error END AS rendered FROM ({edit(rejoined(f'list_transform({L}, lambda x, i: CASE WHEN i = 2 THEN {chr(39)}new second line{chr(39)} ELSE x END)'), f'CASE WHEN len({L}) < 2 THEN {chr(39)}line 2 is beyond end of file ({chr(39)} || CAST(len({L}) AS VARCHAR) || {chr(39)}){chr(39)} END')})",
    "line_shapes": f"WITH {NOTES} SELECT path, len({L}) AS n_lines, contains(content, chr(13) || chr(10)) AS crlf, ends_with(content, chr(10)) AS final_newline, md5({rejoined(L)}) AS joined_md5 FROM files",
    "identities": f"WITH {NOTES} SELECT path, {identity('path')} AS identity, {stem('path')} AS stem, array_to_string({folders('path')}, '|') AS folders FROM files",
    "note_titles": f"{_D} SELECT path, title FROM docs",
    "note_headings": f"{_D} SELECT path, array_to_string(headings, chr(10)) AS headings FROM docs",
    "note_tags": f"{_D} SELECT path, array_to_string(tags, chr(10)) AS tags FROM docs",
    "note_aliases": f"{_D} SELECT path, array_to_string(aliases, chr(10)) AS aliases FROM docs",
    "note_bodies": f"{_D} SELECT path, md5(body) AS body_md5 FROM docs",
    "heading_levels": rf"WITH {NOTES}, h AS (SELECT unnest(list_filter(string_split_regex(content, '\r?\n'), lambda x: regexp_matches(x, '{HEADING}'))) AS x FROM files) SELECT length(regexp_extract(x, '{HEADING}', 1)) AS level, count(*) AS n, count(DISTINCT {trim(f'''regexp_extract(x, '{HEADING}', 2)''')}) AS texts FROM h GROUP BY 1",
    "inline_tags": f"WITH {NOTES}, t AS (SELECT unnest(list_distinct(regexp_extract_all(content, '{TAG}', 2))) AS tag FROM files) SELECT tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY 1",
    "tag_filter_all": f"{_D} SELECT path, title FROM docs WHERE list_has_all(list_transform(tags, lambda x: lower(x)), ['project', 'en'])",
    "tag_search_topk": f"{_D}, best AS (SELECT * FROM docs WHERE list_has_all(list_transform(tags, lambda x: lower(x)), ['project', 'en']) ORDER BY string_split(path, '/') LIMIT 10), {snippets([])} SELECT path, title, array_to_string(tags, chr(10)) AS tags, {numbered_cells('snippets')} AS snippets FROM sn",
    "postings_stats": f"{_D}, {fields(tuple(BOOSTS))} SELECT field, count(*) AS entries, CAST(sum(tf) AS BIGINT) AS tokens, count(DISTINCT token) AS different, n, round(avg_len, 6) AS avg_len FROM post JOIN stats USING (field) GROUP BY field, n, avg_len",
    "bm25_topk": f"{_D}, {fields(('body',))}, {bm25(('body',))} SELECT path, score FROM scored ORDER BY score DESC, path LIMIT 50",
    "bm25_fielded": f"{_D}, {fields(tuple(BOOSTS))}, {bm25(tuple(BOOSTS))} SELECT path, score FROM scored ORDER BY score DESC, path LIMIT 50",
    "exact_priority": f"{_D}, {features()} SELECT path, CAST(exact_priority AS BIGINT) AS exact_priority FROM feat",
    "phrase_priority": f"{_D}, {features()} SELECT path, CAST(phrase_priority AS BIGINT) AS phrase_priority FROM feat",
    "coverage_score": f"{_D}, {features()} SELECT path, CAST(coverage_terms AS BIGINT) AS coverage_terms, CAST(coverage_score AS BIGINT) AS coverage_score FROM feat",
    "rank_buckets": f"{_D}, {features()} SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n FROM feat GROUP BY 1",
    "search_rrf": search(),
    "search_scoped": search(keep="(path = 'src4' OR starts_with(path, 'src4/')) AND list_has_all(list_transform(tags, lambda x: lower(x)), ['project'])"),
    "search_field_restricted": search(("title", "path")),
    "render_search": search(columns="CAST(position AS BIGINT) AS position, CAST(to_json({'path': path, 'title': title, 'tags': tags, 'snippets': snippets}) AS VARCHAR) AS rendered"),
    "index_search": search(files=f"{SNAPS}, files AS (SELECT path, content FROM new)"),
    **FRONT,
    "apply_patch": APPLIED,
    "manifest_diff": f"WITH {SNAPS}, j AS (SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'deleted' WHEN old.size <> new.size OR old.mtime_ms <> new.mtime_ms THEN 'changed' END AS change FROM old FULL JOIN new ON old.path = new.path) SELECT path, change FROM j WHERE change IS NOT NULL",
    "index_merge": f"WITH {SNAPS}, {docs('files AS (SELECT path, content FROM new)')} SELECT path, title, array_to_string(tags, chr(10)) AS tags, md5(body) AS body_md5 FROM docs",
    "edit_replace_all": edit("replace(content, 'the', '$& <the>')", "CASE WHEN NOT contains(content, 'the') THEN 'replace text was not found' END"),
    "edit_replace_once": edit("replace(content, 'license', 'LICENSE')", f"CASE WHEN NOT contains(content, 'license') THEN 'replace text was not found' WHEN {COUNT.format('license', 7)} > 1 THEN 'replace text matched ' || CAST({COUNT.format('license', 7)} AS VARCHAR) || ' times; pass all to replace all' END"),
    "edit_replace_first": edit("CASE WHEN contains(content, 'the') THEN substr(content, 1, instr(content, 'the') - 1) || '$1' || substr(content, instr(content, 'the') + 3) ELSE content END", "CASE WHEN NOT contains(content, 'the') THEN 'replace text was not found' END"),
    "edit_regex": edit(r"regexp_replace(content, '[aeiou]{3,}', '$0\\', 'g')", "CASE WHEN NOT regexp_matches(content, '[aeiou]{3,}') THEN 'regex did not match' END"),
    "edit_regex_end": f"""WITH files AS (SELECT {notes.PATH} AS path, text, doc_id % 3 = 0 AS hit FROM documents)
SELECT 'M' AS code, path, CASE WHEN hit THEN md5(text || chr(10) || '$0 [END]') END AS after_md5, CASE WHEN NOT hit THEN 'regex did not match' END AS error FROM files""",
    "edit_line": edit(rejoined(f"list_transform({L}, lambda x, i: CASE WHEN i = 2 THEN 'new second line' ELSE x END)"), f"CASE WHEN len({L}) < 2 THEN 'line 2 is beyond end of file (' || CAST(len({L}) AS VARCHAR) || ')' END"),
    "edit_range": edit(rejoined(f"list_concat(({L})[:1], ['one', 'two'], ({L})[4:])"), f"CASE WHEN len({L}) < 3 THEN 'range end 3 is beyond end of file (' || CAST(len({L}) AS VARCHAR) || ')' END"),
    "simple_diff": DIFF,
    "write_changes": f"WITH {SNAPS} SELECT CASE WHEN old.path IS NULL THEN 'A' ELSE 'M' END AS code, new.path, md5(coalesce(old.content, '')) AS before_md5, md5(new.content) AS after_md5 FROM new LEFT JOIN old ON old.path = new.path",
    "copy_tree": f"WITH {FILES}, m AS (SELECT 'src2' || substr(path, 5) AS path, path AS from_path, content FROM files WHERE starts_with(path, 'src1/')) SELECT CASE WHEN f.path IS NULL THEN 'A' ELSE 'M' END AS code, m.path, from_path, CASE WHEN f.path IS NOT NULL THEN 'Refusing to overwrite existing path: ' || m.path END AS error, CASE WHEN f.path IS NULL THEN md5(m.content) END AS after_md5 FROM m LEFT JOIN files f ON f.path = m.path",
}
