"""SQL for DuckDB that computes what each query computes, by another route.

Where the Spark job works inside a row (arrays, patterns), the SQL works on rows
(windows, recursion), so that the two check each other.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# White space and control characters in DuckDB's pattern language and as text.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WS_CHARS = "||".join(
    f"chr({n})"
    for n in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"
NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"


def tokens(x: str) -> str:
    return f"greatest(1, CAST(floor(length({x}) * 0.5) AS INTEGER))"


# --- shapes of the given tables ------------------------------------------------

CATALOG = """
catalog AS (
  SELECT o_orderkey AS id, o_custkey AS user_id,
    lower(o_orderpriority) || '_' || o_orderkey || ext AS filename, ext AS file_type,
    CAST(round(o_totalprice * 100, 0) AS BIGINT) AS file_size,
    'uploads/' || strftime(o_orderdate, '%Y/%m') || '/doc-' || o_orderkey || ext AS storage_path,
    CASE o_orderstatus WHEN 'O' THEN 'uploaded' WHEN 'P' THEN 'parsing' ELSE 'ready' END AS status,
    o_orderdate AS created_at, o_orderdate AS updated_at
  FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN '.pdf' WHEN '2-HIGH' THEN '.md'
      WHEN '3-MEDIUM' THEN '.txt' WHEN '4-NOT SPECIFIED' THEN '.csv' ELSE '.json' END AS ext FROM orders)
)"""
PUBLIC = f"SELECT id, user_id, filename, status, {iso('created_at')} AS created_at"

LINES = f"""
lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, {NL})) AS line,
    CAST(generate_subscripts(string_split(text, {NL}), 1) - 1 AS INTEGER) AS line_no
  FROM documents
)"""

FILES = """
files AS (
  SELECT doc_id, lang, 'doc_' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md'
      WHEN 'de' THEN '.TXT' ELSE '.csv' END AS filename,
    CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.txt' ELSE '.csv' END AS file_type,
    text || CASE WHEN doc_id % 2 = 1 THEN chr(65533) ELSE '' END AS text
  FROM documents
)"""

ACCESS = """
access_log AS (
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id, user_id, event_type, ts
  FROM events
)"""

LINE_PAGES = f"""{LINES},
line_pages AS (
  SELECT doc_id, line_no + 1 AS page_number, line AS text, length(trim(line, ' ')) AS text_len,
    CAST((doc_id + line_no + 1) % 3 AS INTEGER) AS image_count,
    CAST((doc_id * 7 + (line_no + 1) * 13) % 600 AS DOUBLE)
      * CAST((doc_id * 11 + (line_no + 1) * 5) % 800 AS DOUBLE) AS image_area
  FROM lines
),
ratios AS (SELECT *, image_count * image_area / (600.0 * 800.0) AS image_ratio FROM line_pages),
classes AS (
  SELECT *, CASE WHEN text_len <= 10 AND image_count = 0 THEN 'blank'
    WHEN text_len <= 50 AND image_count > 0 AND image_ratio > 0.3 THEN 'scanned'
    WHEN text_len > 10 AND image_count > 0 THEN 'hybrid' ELSE 'text' END AS page_type
  FROM ratios
)"""

RAW_TABLES = f"""
word_rows AS (
  SELECT doc_id, list_transform(string_split(text, {NL}), lambda x: string_split(x, ' ')) AS cells FROM documents
),
tables AS (
  SELECT doc_id, 1 AS page_number, len(cells) - 1 AS n, len(cells[1]) AS w,
    array_to_string(list_concat([array_to_string(cells[1], ' | '), array_to_string(list_transform(cells[1], lambda c: '---'), ' | ')],
      list_transform(cells[2:], lambda r: array_to_string(r, ' | '))), {NL}) AS text
  FROM word_rows
)"""


def paragraphs(source: str, keep: str = "TRUE") -> str:
    """Stripped pieces between blank lines of ``source(doc_id, text)``, numbered from 0."""
    return f"""
pieces AS (
  SELECT doc_id, {strip('p')} AS text, i FROM (
    SELECT doc_id, unnest(regexp_split_to_array(text, '\\n{WS}*\\n')) AS p,
      generate_subscripts(regexp_split_to_array(text, '\\n{WS}*\\n'), 1) AS i
    FROM {source})
),
blocks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS position,
    'paragraph' AS block_type, text
  FROM pieces WHERE text <> '' AND ({keep})
)"""


def cut(n: str, target: str, text: str) -> str:
    """Characters past ``target`` up to the end of the best delimiter in the window."""
    window = f"substr({text}, {target} + 1, CAST(least(200, {n} - {target} - 1) AS BIGINT))"
    found = ", ".join(
        f"nullif(instr({window}, {d}), 0) + {size - 1}"
        for d, size in ((f"{NL} || {NL}", 2), (NL, 1), ("'。'", 1), ("'；'", 1), ("'，'", 1))
    )
    return f"CASE WHEN {n} - {target} - 1 <= 0 THEN 0 ELSE coalesce({found}, 0) END"


def chunks(size: int = 1000, overlap: int = 200, short: int = 100) -> str:
    """From ``blocks`` to ``parts`` and on to ``merged`` (CTEs; needs WITH RECURSIVE)."""

    def end(start: str) -> str:
        target = f"({start} + {size})"
        return f"CASE WHEN {target} >= n THEN n ELSE {target} + {cut('n', target, 'text')} END"

    return f"""
long_blocks AS (
  SELECT doc_id, position, block_type, text, length(text) AS n FROM blocks
  WHERE block_type NOT IN ('heading', 'code') AND length(text) > {size}
),
cuts AS (
  SELECT doc_id, position, block_type, text, n, 0 AS part, CAST(0 AS BIGINT) AS s,
    CAST({end('0')} AS BIGINT) AS e FROM long_blocks
  UNION ALL
  SELECT doc_id, position, block_type, text, n, part + 1, e - {overlap},
    CAST({end(f'(e - {overlap})')} AS BIGINT)
  FROM cuts WHERE e < n
),
parts AS (
  SELECT doc_id, position AS source_position, block_type, part, substr(text, s + 1, e - s) AS text,
    part + 1 AS split_part, CAST(count(*) OVER (PARTITION BY doc_id, position) AS INTEGER) AS split_total,
    CAST(s AS INTEGER) AS char_offset_start, CAST(e AS INTEGER) AS char_offset_end
  FROM cuts
  UNION ALL
  SELECT doc_id, position, block_type, 0, text, NULL, NULL, NULL, NULL FROM blocks
  WHERE block_type IN ('heading', 'code') OR length(text) <= {size}
),
flags AS (
  SELECT *, CASE WHEN block_type NOT IN ('heading', 'code') AND length(text) < {short}
      AND lag(block_type) OVER w NOT IN ('heading', 'code') THEN 0 ELSE 1 END AS opens
  FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY source_position, part)
),
runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY source_position, part
    ROWS UNBOUNDED PRECEDING) AS run FROM flags
),
merged AS (
  SELECT doc_id, CAST(run - 1 AS INTEGER) AS position,
    first(block_type ORDER BY source_position, part) AS block_type,
    string_agg(text, {NL} ORDER BY source_position, part) AS text,
    first(split_part ORDER BY source_position, part) AS split_part,
    first(split_total ORDER BY source_position, part) AS split_total,
    first(char_offset_start ORDER BY source_position, part) AS char_offset_start,
    first(char_offset_end ORDER BY source_position, part) AS char_offset_end,
    CASE WHEN count(*) > 1 THEN coalesce(first(split_part ORDER BY source_position, part), 0) END AS merged_from,
    CASE WHEN count(*) > 1 THEN coalesce(last(split_part ORDER BY source_position, part), 0) END AS merged_to
  FROM runs GROUP BY doc_id, run
),
chunk_table AS (
  SELECT doc_id AS document_id, position AS chunk_index, chunk_text,
    sha256(chunk_text) AS chunk_hash, {tokens('chunk_text')} AS token_count
  FROM (SELECT *, regexp_replace(text, '{CONTROL}', '', 'g') AS chunk_text FROM merged)
)"""


SPACED = f"spaced AS (SELECT doc_id, replace(text, {NL}, {NL} || {NL}) AS text FROM documents)"

# --- Markdown: lines, kinds, islands --------------------------------------------

MD_DOCS = f"""
md_docs AS (
  SELECT doc_id, '# Source **' || source || '**' || {NL} || {NL} || replace(text, {NL}, {NL} || {NL})
    || {NL} || {NL} || '## Extract `' || lang || '`' || {NL} || {NL} || '```' || lang || {NL} || text || {NL}
    || '```' || {NL} || {NL} || '- doc ' || doc_id || {NL} || '- *lang* ' || lang || {NL}
    || '  1. nested [link](http://example.com/' || doc_id || ')' || {NL} || {NL}
    || '> ' || string_split(text, {NL})[1] || {NL} || '> quoted' || {NL} || {NL} || '***' || {NL} || {NL}
    || '| key | value |' || {NL} || '|-----|:-----:|' || {NL} || '| doc | ' || doc_id || ' |' || {NL}
    || '| lang | ' || lang || ' |' || {NL} AS text
  FROM documents
)"""


def inline(x: str) -> str:
    for pattern, by in (
        (r"!\[\]\([^)]*\)", "[image]"),
        (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"),
        (r"<((?:https?://|mailto:)[^>\s]+)>", r"\1"),
        (r"</?[A-Za-z][^>]*>|<!--[^>]*-->", ""),
        (r"\*\*([^*\n]+)\*\*", r"\1"),
        (r"\*([^*\s\n]|[^*\s\n][^*\n]*[^*\s\n])\*", r"\1"),
        (r"(^|[^\w\\])__([^_\n]+)__($|[^\w])", r"\1\2\3"),
        (r"(^|[^\w\\])_([^_\n]+)_($|[^\w])", r"\1\2\3"),
        (r"`+([^`\n]+)`+", r"\1"),
        (r"\\([!-/:-@\[-`{-~])", r"\1"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


MD_RULES = f"""
md_lines AS (
  SELECT doc_id, unnest(string_split(text, {NL})) AS line,
    generate_subscripts(string_split(text, {NL}), 1) AS line_no FROM md_docs
),
fences AS (
  SELECT *, CASE WHEN regexp_matches(line, '^ {{0,3}}(```|~~~)') THEN 1 ELSE 0 END AS fence FROM md_lines
),
fenced AS (
  SELECT *, sum(fence) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS fc FROM fences
),
kinds AS (
  SELECT *, CASE WHEN fence = 1 THEN 'fence' WHEN fc % 2 = 1 THEN 'code'
    WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}([ \\t]|$)') THEN 'heading'
    WHEN regexp_matches(line, '^[ \\t]*\\|[ \\t]*:?-+:?[ \\t]*(\\|[ \\t]*:?-+:?[ \\t]*)+\\|?[ \\t]*$') THEN 'delimiter'
    WHEN regexp_matches(line, '^ {{0,3}}((\\*[ \\t]*){{3,}}|(-[ \\t]*){{3,}}|(_[ \\t]*){{3,}})$') THEN 'rule'
    WHEN regexp_matches(line, '^[ \\t]*([-*+]|\\d{{1,9}}[.)])[ \\t]+\\S') THEN 'item'
    WHEN regexp_matches(line, '^ {{0,3}}>') THEN 'quote'
    WHEN regexp_matches(line, '^[ \\t]*$') THEN 'blank' ELSE 'text' END AS kind
  FROM fenced
),
heads AS (
  SELECT *, kind = 'text' AND contains(line, '|') AND lead(kind) OVER w = 'delimiter' AS is_head,
    max(CASE WHEN kind = 'delimiter' THEN line_no ELSE 0 END) OVER w AS last_delimiter,
    max(CASE WHEN NOT (kind = 'delimiter' OR (kind = 'text' AND contains(line, '|'))) THEN line_no ELSE 0 END)
      OVER w AS last_other
  FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
),
labelled AS (
  SELECT *, CASE WHEN kind = 'delimiter' OR is_head
      OR (kind = 'text' AND contains(line, '|') AND last_delimiter > last_other) THEN 'table' ELSE kind END AS k
  FROM heads
),
starts AS (
  SELECT *, CASE WHEN k IN ('heading', 'item') OR is_head OR k IS DISTINCT FROM lag(k) OVER w
    THEN 1 ELSE 0 END AS start,
    max(CASE WHEN fence = 1 AND fc % 2 = 1 THEN line_no END) OVER w AS fence_line
  FROM labelled WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
),
islands AS (
  SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM starts
),
grouped AS (
  SELECT i.doc_id, island, min(k) AS k, list(line ORDER BY line_no) AS ls, min(line_no) AS line_at,
    min(fence_line) AS fence_line
  FROM islands i WHERE k NOT IN ('fence', 'rule', 'blank') GROUP BY i.doc_id, island
),
trimmed AS (
  SELECT g.doc_id, line_at, k, ls,
    trim(regexp_replace(coalesce(f.line, ''), '^ *[`~]+', ''), {WS_CHARS}) AS info,
    list_transform(ls, lambda x: trim(regexp_replace(x, CASE k WHEN 'quote' THEN '^ {{0,3}}> ?'
      WHEN 'item' THEN '^[ \\t]*([-*+]|\\d{{1,9}}[.)])[ \\t]+' ELSE '^' END, ''), ' ' || chr(9))) AS bare,
    list_transform(list_filter(ls, lambda x: NOT regexp_matches(x, '^[-| :\\t]*-[-| :\\t]*$')),
      lambda x: list_transform(string_split(trim(trim(x, ' '), '|'), '|'), lambda c: trim(c, ' '))) AS grid
  FROM grouped g LEFT JOIN md_lines f ON f.doc_id = g.doc_id AND f.line_no = g.fence_line AND g.k = 'code'
),
md AS (
  SELECT doc_id, line_at,
    CASE k WHEN 'item' THEN 'list_item' WHEN 'text' THEN 'paragraph' WHEN 'quote' THEN 'paragraph' ELSE k END AS block_type,
    CASE k WHEN 'code' THEN array_to_string(ls, {NL})
      WHEN 'heading' THEN {inline("trim(regexp_replace(regexp_replace(ls[1], '^ {0,3}#{1,6}', ''), '[ \\t]+#+[ \\t]*$', ''), ' ' || chr(9))")}
      WHEN 'table' THEN array_to_string(list_concat([array_to_string(grid[1], ' | '),
        array_to_string(list_transform(grid[1], lambda h: '---'), ' | ')],
        list_transform(grid[2:], lambda r: array_to_string(r, ' | '))), {NL})
      ELSE {inline("array_to_string(bare, ' ')")} END AS text,
    CASE k WHEN 'heading' THEN length(regexp_extract(ls[1], '#+'))
      WHEN 'item' THEN CAST(floor(length(regexp_extract(ls[1], '^ *')) / 2) AS BIGINT) + 1 END AS level,
    CASE k WHEN 'code' THEN coalesce(nullif(info, ''), 'unknown') END AS language,
    CASE k WHEN 'item' THEN regexp_matches(ls[1], '^[ \\t]*\\d') END AS ordered,
    CASE k WHEN 'quote' THEN TRUE END AS is_quote,
    CASE k WHEN 'table' THEN len(grid) - 1 END AS rows,
    CASE k WHEN 'table' THEN len(grid[1]) END AS cols
  FROM trimmed
),
blocks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_at) - 1 AS INTEGER) AS position,
    block_type, text, CAST(level AS INTEGER) AS level, language, ordered, is_quote,
    CAST(rows AS INTEGER) AS rows, CAST(cols AS INTEGER) AS cols
  FROM md WHERE block_type <> 'paragraph' OR trim(text, {WS_CHARS}) <> ''
)"""

MD_BLOCKS = f"{MD_DOCS},{MD_RULES}"

# --- repeated regions -------------------------------------------------------------

REPEATED = f"""
src_pages AS (
  SELECT source AS doc_id, doc_id AS page_number, text, lang FROM documents
  UNION ALL SELECT source, -doc_id - 1, '', lang FROM documents WHERE doc_id % 7 = 0
),
spans AS (
  SELECT doc_id, page_number, CAST(0 AS BIGINT) AS seq, 'Report ' || doc_id || '  page ' || page_number AS text,
    CAST(0 AS DOUBLE) AS y0 FROM src_pages WHERE {strip('text')} <> ''
  UNION ALL
  SELECT doc_id, page_number, i, line, 200 + CAST(600 AS DOUBLE) * (i - 1) / n FROM (
    SELECT doc_id, page_number, unnest(string_split(text, {NL})) AS line,
      generate_subscripts(string_split(text, {NL}), 1) AS i, len(string_split(text, {NL})) AS n
    FROM src_pages WHERE {strip('text')} <> '')
  UNION ALL
  SELECT doc_id, page_number, len(string_split(text, {NL})) + 1, ' ' || lang || ' edition - ' || page_number || ' ',
    1000 FROM src_pages WHERE {strip('text')} <> ''
),
guards AS (
  SELECT doc_id, count(*) AS total_pages, count(*) FILTER (WHERE {strip('text')} = '') AS empty_pages,
    count(*) FILTER (WHERE {strip('text')} <> '') AS valid_pages,
    CASE WHEN count(*) FILTER (WHERE {strip('text')} <> '') = 0 THEN 'skipped_no_text'
      WHEN count(*) FILTER (WHERE {strip('text')} <> '') < 3 THEN 'skipped_few_pages'
      WHEN count(*) FILTER (WHERE {strip('text')} = '') > 0 THEN 'limited' ELSE 'full' END AS detection
  FROM src_pages GROUP BY doc_id
),
placed AS (
  SELECT *, max(y0) OVER (PARTITION BY doc_id, page_number) AS height FROM spans
),
sides AS (
  SELECT *, 'header' AS region FROM placed WHERE y0 <= height * 0.15
  UNION ALL SELECT *, 'footer' AS region FROM placed WHERE y0 >= height * 0.85
),
region_text AS (
  SELECT doc_id, page_number, region, trim(string_agg(text, '' ORDER BY seq), {WS_CHARS}) AS text
  FROM sides GROUP BY doc_id, page_number, region
),
regions AS (
  SELECT *, trim(regexp_replace(regexp_replace(text, '\\b\\d+\\b', '#', 'g'), '{WS}+', ' ', 'g'), {WS_CHARS}) AS norm
  FROM region_text WHERE text <> '' AND length(text) <= 200
),
groups AS (
  SELECT doc_id, region, norm, min_by(text, page_number) AS text, min(page_number) AS first_page,
    count(DISTINCT page_number) AS page_count
  FROM regions GROUP BY doc_id, region, norm
),
confirmed AS (
  SELECT g.*, total_pages FROM groups g JOIN guards USING (doc_id)
  WHERE detection IN ('limited', 'full') AND page_count / total_pages >= 0.5
),
ranges AS (
  SELECT doc_id, region, norm, min(page_number) AS first_page, max(page_number) AS last_page,
    CASE WHEN min(page_number) = max(page_number) THEN CAST(min(page_number) AS VARCHAR)
      ELSE min(page_number) || '-' || max(page_number) END AS pages
  FROM (SELECT doc_id, region, norm, page_number,
      page_number - row_number() OVER (PARTITION BY doc_id, region, norm ORDER BY page_number) AS island
    FROM regions SEMI JOIN confirmed USING (doc_id, region, norm))
  GROUP BY doc_id, region, norm, island
)"""

# --- prompts ------------------------------------------------------------------------

PROMPTS = """
names AS (SELECT * FROM (VALUES ('plain', 0), ('for_newcomers', 1), ('claims_with_sources', 2), ('two_sides', 3),
  ('csv_facts', 4)) t(prompt_name, ord)),
asked AS (SELECT conv_id || '-' || turn AS input_id, text FROM conversations WHERE role = 'user'),
newest AS (SELECT conv_id, max(turn) AS asked, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id),
answers AS (
  SELECT conv_id || '-' || (turn - 1) AS input_id, conv_id, prompt_name, ord, turn AS run_no, text, length(text) AS n
  FROM conversations JOIN names ON ord = (conv_id + turn // 2) %% 5 WHERE role = 'assistant'
),
results AS (
  SELECT a.input_id, g.prompt_name, g.ord, f.run_no, a.text AS input_text, f.text, n AS char_count,
    len(list_filter(regexp_split_to_array(f.text, '%(ws)s+'), lambda w: w <> '')) AS word_count,
    json_valid(f.text) AS has_json,
    (contains(f.text, '[1]') OR contains(f.text, '[2]') OR contains(f.text, '来源') OR contains(f.text, 'reference')
      OR contains(f.text, 'Reference') OR contains(f.text, '引用') OR contains(f.text, '参见')) AS has_citation,
    round(n * CAST(1.23456 AS DOUBLE), 2) AS latency_ms, n * 3 AS token_total
  FROM asked a CROSS JOIN names g LEFT JOIN answers f ON f.input_id = a.input_id AND f.prompt_name = g.prompt_name
)""" % {"ws": WS}

REPORT = f"""
reports AS (
  SELECT input_id, count(text) AS answers, count(*) - count(text) AS missing,
    '# Prompt comparison' || {NL} || {NL} || '**Input**: ' || min(input_text) || {NL} || {NL}
    || '| Prompt | Characters | Latency (ms) | Tokens | JSON | Citation |' || {NL} || '|---|---|---|---|---|---|' || {NL}
    || string_agg('| ' || prompt_name || coalesce(' #' || run_no, '') || ' | ' || CASE WHEN text IS NULL THEN 'no answer | | | |' ELSE
      char_count || ' | ' || CAST(round_even(latency_ms, 0) AS BIGINT)
      || ' | ' || token_total || ' | ' || CASE WHEN has_json THEN '✅' ELSE '—' END || ' | '
      || CASE WHEN has_citation THEN '✅' ELSE '—' END END || ' |', {NL} ORDER BY ord, run_no)
    || {NL} || {NL} || '## Outputs' || {NL} || {NL}
    || coalesce(string_agg('### ' || prompt_name || ' #' || run_no || {NL} || {NL} || '```' || {NL} || substr(text, 1, 500)
      || CASE WHEN length(text) > 500 THEN {NL} || '...(truncated)' ELSE '' END || {NL} || '```' || {NL}, {NL} ORDER BY ord, run_no), '')
      AS report
  FROM results GROUP BY input_id
)"""


def add(name: str, body: str, *ctes: str, recursive: bool = False) -> None:
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} " if ctes else ""
    ORACLE[name] = head + body


# --- files ----------------------------------------------------------------------
WEB = """
web AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS filename, strlen(html) AS length FROM pages),
typed AS (SELECT *, lower(regexp_extract(filename, '[^/](\\.[^./]+)$', 1)) AS file_type FROM web)"""
ALLOWED = "('.pdf', '.txt', '.md', '.docx', '.csv', '.json', '.xml')"
REJECT = f"""CASE WHEN coalesce(filename, '') = '' THEN 'empty_name' WHEN file_type NOT IN {ALLOWED}
  THEN 'extension_not_allowed' WHEN length > 52428800 THEN 'too_large' END AS reject_reason"""
add("file_type", "SELECT page_id, file_type FROM typed", WEB)
add("admit_web_files", f"SELECT page_id, file_type, {REJECT} FROM typed", WEB)
add("admit_files", "SELECT doc_id, file_type, CAST(NULL AS VARCHAR) AS reject_reason FROM files", FILES)
add("storage_paths", """SELECT id, file_type, 'uploads/' || strftime(created_at, '%Y/%m') || '/doc-'
  || substr(sha256(user_id || '|' || filename), 1, 12) || file_type AS storage_path FROM catalog""", CATALOG)
STORED = "'uploads/2026/08/doc-' || substr(sha256(filename), 1, 12) || file_type AS storage_path"
BYTES = "encode(d.text) || CASE WHEN doc_id % 2 = 1 THEN '\\xFF'::BLOB ELSE ''::BLOB END"
add("save_files", f"""SELECT doc_id, {STORED}, octet_length({BYTES}) AS file_size, sha256({BYTES}) AS content_hash,
  CAST(2026 AS INTEGER) AS year, CAST(8 AS INTEGER) AS month FROM files JOIN documents d USING (doc_id)
  WHERE d.lang = 'en' AND doc_id IN (SELECT doc_id FROM labels)""", FILES)
add("catalog_rows", f"""SELECT substr(sha256(filename), 1, 12) AS id, doc_id % 10 AS user_id, filename, file_type,
  octet_length({BYTES}) AS file_size, {STORED}, 'ready' AS status FROM files JOIN documents d USING (doc_id)""", FILES)
add("save_partitioned", """SELECT CAST(year(created_at) AS INTEGER) AS year, CAST(month(created_at) AS INTEGER) AS month,
  count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM catalog GROUP BY 1, 2""", CATALOG)
add("write_documents", f"SELECT id, filename, status, {iso('created_at')} AS created_at FROM catalog", CATALOG)
CHUNKS_OF_DOCS = (paragraphs("documents"), chunks())
CHUNKS_OF_LINES = (SPACED, paragraphs("spaced"), chunks())
add("write_chunks", "SELECT document_id, chunk_index, chunk_hash, token_count FROM chunk_table", *CHUNKS_OF_DOCS, recursive=True)
add("upsert_documents", f"""SELECT id, filename, CASE WHEN id % 7 = 0 THEN 'failed' ELSE status END AS status, {iso('created_at')} AS created_at
  FROM catalog WHERE (id % 11 <> 0 OR id % 7 = 0) AND NOT (id % 7 = 0 AND id % 3 = 0)""", CATALOG)
add("upsert_chunks", """SELECT document_id, chunk_index, chunk_hash, token_count FROM chunk_table
  WHERE document_id % 3 <> 0 OR (document_id % 2 = 0 AND chunk_index = 0)""", *CHUNKS_OF_DOCS, recursive=True)
LATEST = """latest AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN substr(text, CAST(floor(length(text) / 2) AS INTEGER) + 1)
  ELSE text END AS text FROM documents)"""
add("version_stream", "SELECT document_id, chunk_index, chunk_hash, token_count FROM chunk_table", LATEST, paragraphs("latest"), chunks(), recursive=True)
add("write_report", f"""SELECT line, count(*) AS n FROM (SELECT unnest(string_split(report, {NL})) AS line FROM reports)
  GROUP BY line""", PROMPTS, REPORT)
PARSED_FILES = (
    FILES,
    "md_docs AS (SELECT doc_id, text FROM files WHERE file_type = '.md')",
    MD_RULES.replace("blocks AS", "md_blocks AS"),
    "txt_docs AS (SELECT doc_id, text FROM files WHERE file_type = '.txt')",
    paragraphs("txt_docs").replace("blocks AS", "txt_blocks AS"),
    """blocks AS (SELECT doc_id, position, block_type, text FROM md_blocks
      UNION ALL SELECT doc_id, position, block_type, text FROM txt_blocks)""",
)
add("route_by_type", """SELECT doc_id, count(*) AS blocks, CAST(NULL AS VARCHAR) AS error FROM blocks GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, 'no parser for \'\'.csv\'\'; have .md, .txt' FROM files WHERE file_type = '.csv'""", *PARSED_FILES)
add("isolate_failures", """SELECT f.doc_id, file_type, CASE WHEN file_type <> '.csv' THEN 'utf-8' END AS encoding,
  'ready' AS status, CASE WHEN file_type <> '.csv' THEN CAST(f.doc_id % 2 AS INTEGER) END AS replacement_chars,
  CAST(count(b.text) AS INTEGER) AS blocks
  FROM files f LEFT JOIN blocks b USING (doc_id) GROUP BY ALL""", *PARSED_FILES)

# --- catalog --------------------------------------------------------------------
ORDER = "ORDER BY created_at DESC, id DESC"
add("get_by_id", f"{PUBLIC} FROM catalog WHERE id = 42", CATALOG)
add("get_by_ids", f"{PUBLIC} FROM catalog WHERE id IN (SELECT doc_id FROM labels)", CATALOG)
add("get_by_id_list", f"{PUBLIC} FROM catalog WHERE id IN (3, 5, 8, 13, 21, 34)", CATALOG)
add("filter_keyword", f"{PUBLIC} FROM catalog WHERE filename ILIKE '%URG_NT%7%'", CATALOG)
add("filter_status", f"{PUBLIC} FROM catalog WHERE status = 'parsing'", CATALOG)
add("filter_file_type", f"{PUBLIC} FROM catalog WHERE file_type = '.md'", CATALOG)
add("catalog_search", f"""{PUBLIC} FROM catalog WHERE contains(filename, 'high_1') AND status = 'ready'
  AND file_type = '.md'""", CATALOG)
add("keyset_after", f"{PUBLIC} FROM catalog WHERE (created_at, id) < (TIMESTAMP '1998-01-01', 5000)", CATALOG)
add("keyset_page", f"{PUBLIC} FROM (SELECT * FROM catalog WHERE status = 'ready' {ORDER} LIMIT 50)", CATALOG)
add("keyset_second_page", f"{PUBLIC} FROM (SELECT * FROM catalog WHERE status = 'ready' {ORDER} LIMIT 50 OFFSET 50)", CATALOG)
CURSOR = f"""translate(to_base64(encode('{{"created_at":"' || {iso('created_at')} || '","id":"' || id || '"}}')), '+/', '-_')"""
add("keyset_page_info", f"""SELECT CAST(50 AS INTEGER) AS item_count, TRUE AS has_more, {CURSOR} AS next_cursor
  FROM (SELECT * FROM catalog WHERE status = 'ready' {ORDER} LIMIT 1 OFFSET 49)""", CATALOG)
add("encode_cursor_round_trip", f"""SELECT id, {CURSOR} AS cursor, {iso('created_at')} AS created_at, id AS decoded_id
  FROM (SELECT event_id AS id, ts AS created_at FROM events)""")
add("list_documents", f"""SELECT CAST(id AS VARCHAR) AS id, filename, file_type, file_size, status,
  {iso('created_at')} AS created_at,
  (SELECT count(*) FROM catalog WHERE user_id = 7) AS total,
  (SELECT count(*) FROM catalog WHERE user_id = 7 AND status = 'ready') AS filtered_total,
  (SELECT greatest(1, CAST(ceil(count(*) / 5) AS BIGINT)) FROM catalog WHERE user_id = 7) AS total_pages,
  (SELECT count(*) > 5 FROM catalog WHERE user_id = 7 AND status = 'ready') AS has_more,
  (SELECT {CURSOR} FROM (SELECT *, row_number() OVER ({ORDER}) AS r, count(*) OVER () AS n FROM catalog WHERE user_id = 7 AND status = 'ready')
    WHERE r = 5 AND n > 5) AS next_cursor
  FROM (SELECT * FROM catalog WHERE user_id = 7 AND status = 'ready' {ORDER} LIMIT 5)""", CATALOG)
add("sorted_listing", f"{PUBLIC} FROM (SELECT * FROM catalog ORDER BY file_size, id LIMIT 100 OFFSET 100)", CATALOG)
add("deep_page", f"{PUBLIC} FROM (SELECT * FROM catalog ORDER BY file_size DESC, id DESC LIMIT 100 OFFSET 1300)", CATALOG)
add("offset_page", f"{PUBLIC} FROM (SELECT * FROM catalog WHERE file_type = '.pdf' {ORDER} LIMIT 20 OFFSET 40)", CATALOG)
TIMES = f"{iso('created_at')} AS created_at, {iso('updated_at')} AS updated_at"
add("document_info", f"SELECT id, filename, file_type, file_size, status, {TIMES} FROM catalog", CATALOG)
add("document_response", f"""SELECT CAST(id AS VARCHAR) AS id, filename, file_type, file_size, status, storage_path,
  {TIMES} FROM catalog""", CATALOG)
add("typed_from_strings", f"""SELECT CAST(id AS VARCHAR) AS id, CASE WHEN file_type <> '.json' THEN file_size END AS file_size,
  status, {iso('created_at')} AS created_at, CASE WHEN file_type = '.json' THEN 'file_size' END AS reject_reason
  FROM catalog""", CATALOG)
add("count_where", "SELECT count(*) AS n FROM catalog WHERE file_size > 20000000", CATALOG)
add("count_by_status", "SELECT user_id, status, count(*) AS cnt FROM catalog GROUP BY ALL", CATALOG)
add("count_by_status_user", "SELECT status, count(*) AS cnt FROM catalog WHERE user_id = 7 GROUP BY ALL", CATALOG)
add("catalog_totals", """SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'ready') AS filtered_total,
  greatest(1, CAST(ceil(count(*) / 20) AS BIGINT)) AS total_pages FROM catalog GROUP BY user_id""", CATALOG)
add("maintained_totals", """SELECT user_id, CASE WHEN id % 7 = 0 THEN 'failed' WHEN id % 5 = 0 THEN 'uploaded' ELSE status END AS status,
  count(*) AS cnt, CAST(sum(file_size) AS BIGINT) AS bytes FROM catalog WHERE (id % 11 <> 0 OR id % 7 = 0) AND NOT (id % 7 = 0 AND id % 3 = 0) GROUP BY 1, 2""", CATALOG)
add("owner_lookup", "SELECT id, c_name AS username, filename FROM catalog JOIN customer ON c_custkey = user_id", CATALOG)

# --- text -----------------------------------------------------------------------
add("is_blank_text", f"""SELECT doc_id, line_no, length(regexp_replace(line, '{WS}+', '', 'g')) < 10 AS is_blank FROM lines""", LINES)
add("is_noise", """SELECT doc_id, line_no, coalesce(
    (length(regexp_replace(t, '[\\p{C}\\p{Z}]', '', 'g')) + length(t) - length(translate(t, ' ' || chr(9) || chr(10) || chr(13), '')))
      / nullif(length(t), 0) < 0.6, TRUE) AS is_noise
  FROM (SELECT doc_id, line_no, translate(line, 'etaoins', repeat(chr(1), 7)) AS t FROM lines)""", LINES)
NARROW = "length(text) = octet_length(encode(text))"
add("decode_text_files", f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'utf-8' WHEN {NARROW} THEN 'gbk' ELSE 'utf-16' END AS encoding,
  CAST(length(t) AS INTEGER) AS chars, sha256(t) AS text_hash
  FROM (SELECT *, CASE WHEN doc_id % 2 = 1 AND {NARROW} THEN '编码' || text ELSE text END AS t FROM documents)""")
FILE = f"text || {NL}"
add("charset_of_files", """SELECT doc_id, charset, lower(charset) AS encoding, true AS same_text
  FROM documents, (SELECT unnest(['GBK', 'Big5', 'Shift_JIS', 'EUC-KR']) AS charset) c WHERE regexp_matches(text, '[A-Za-z]')
  UNION ALL SELECT doc_id, 'ISO-8859-1', 'iso-8859-1', true FROM documents WHERE regexp_matches(text, '[\\x{A0}-\\x{FF}]') AND NOT regexp_matches(text, '[^\\x{00}-\\x{FF}]')""")
add("parsed_files", f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS position, 'paragraph' AS block_type, regexp_replace(p[i], '<[^>]*>', '', 'g') AS text,
    CAST(NULL AS VARCHAR) AS error FROM (SELECT page_id, regexp_extract_all(html || {NL}, '(?s)<p>(.*?)</p>', 1) AS p, unnest(range(1, len(p) + 1)) AS i
    FROM pages WHERE page_id <> (SELECT max(page_id) FROM pages))
  UNION ALL SELECT max(page_id), NULL, NULL, NULL, 'not a page' FROM pages""")
add("scan_files", f"""SELECT doc_id, '.txt' AS file_type, octet_length(encode({FILE})) AS length,
  CASE WHEN octet_length(encode({FILE})) <= 52428800 THEN sha256({FILE}) END AS content_hash,
  CASE WHEN octet_length(encode({FILE})) > 52428800 THEN 'too_large' END AS reject_reason
  FROM documents""")
add("stream_files", f"""SELECT doc_id, octet_length(encode({FILE})) AS length, '.txt' AS file_type, sha256({FILE}) AS content_hash
  FROM documents""")
LOST = "SELECT doc_id, translate(text, 'h', chr(65533)) AS t FROM documents"
COUNT_LOST = "length(t) - length(replace(t, chr(65533), ''))"
WARNING = f"""CASE WHEN ({COUNT_LOST}) / greatest(length(t), 1) > 0.05 THEN 'encoding_quality_poor: ' || ({COUNT_LOST})
  || ' characters lost (' || printf('%.1f', ({COUNT_LOST}) / greatest(length(t), 1) * 100) || '%)' END AS warning"""
add("garbled_warning", f"SELECT doc_id, {WARNING} FROM ({LOST})")
add("text_stats", f"""SELECT doc_id, CAST(strlen(t) AS INTEGER) AS byte_size, CAST(length(t) AS INTEGER) AS char_count,
  CAST({COUNT_LOST} AS INTEGER) AS replacement_chars FROM ({LOST})""")
add("sanitize_text", f"""SELECT doc_id, CAST(length(c) AS INTEGER) AS chars, sha256(c) AS text_hash FROM (
  SELECT doc_id, regexp_replace(translate(text, 'wly', chr(7) || chr(127) || chr(133)), '{CONTROL}', '', 'g') AS c
  FROM documents)""")
add("split_paragraphs", "SELECT doc_id, position, text FROM blocks",
    f"padded AS (SELECT doc_id, replace(text, {NL}, {NL} || ' ' || {NL}) AS text FROM documents)", paragraphs("padded"))
add("token_estimate", f"SELECT doc_id, line_no, {tokens('line')} AS token_count FROM lines", LINES)
add("chunk_hash", "SELECT doc_id, line_no, sha256(line) AS chunk_hash FROM lines", LINES)
add("status_flow", """SELECT CAST(doc_id AS VARCHAR) AS id, filename,
  CASE WHEN file_type = '.csv' OR b.n IS NOT NULL THEN 'ready' ELSE 'uploaded' END AS status
  FROM files LEFT JOIN (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id) b USING (doc_id)""", *PARSED_FILES)
add("parse_warnings", f"""SELECT doc_id, warning FROM (SELECT doc_id, {WARNING} FROM (
  SELECT doc_id, translate(text, 'h', chr(65533)) AS t FROM files WHERE file_type <> '.csv')) WHERE warning IS NOT NULL""", FILES)

# --- Markdown -------------------------------------------------------------------
add("md_blocks", "SELECT * FROM blocks", MD_BLOCKS)
# The blocks of the six shapes, told from the lines they are made of.
add("md_nested_blocks", """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INTEGER) AS position, block_type, text,
  level, language, ordered, contains(path, 'q') AS is_quote, path
  FROM (SELECT doc_id, i, t, unnest(CASE i % 6
    WHEN 0 THEN [{'k': 0, 'block_type': 'paragraph', 'text': t, 'level': NULL, 'language': NULL, 'ordered': NULL, 'path': ''}]
    WHEN 1 THEN [{'k': 0, 'block_type': 'paragraph', 'text': t || ' and on', 'level': NULL, 'language': NULL, 'ordered': NULL, 'path': 'q'}]
    WHEN 2 THEN [{'k': 0, 'block_type': 'list_item', 'text': t, 'level': 1, 'language': NULL, 'ordered': false, 'path': 'qu'},
      {'k': 1, 'block_type': 'list_item', 'text': 'deeper ' || t, 'level': 2, 'language': NULL, 'ordered': false, 'path': 'quu'},
      {'k': 2, 'block_type': 'paragraph', 'text': 'then ' || t, 'level': NULL, 'language': NULL, 'ordered': NULL, 'path': 'qu'}]
    WHEN 3 THEN [{'k': 0, 'block_type': 'list_item', 'text': t, 'level': 1, 'language': NULL, 'ordered': true, 'path': 'o'},
      {'k': 1, 'block_type': 'code', 'text': t || chr(10) || chr(10) || '  more', 'level': NULL, 'language': 'sql', 'ordered': NULL, 'path': 'o'},
      {'k': 2, 'block_type': 'paragraph', 'text': 'said ' || t, 'level': NULL, 'language': NULL, 'ordered': NULL, 'path': 'oq'}]
    WHEN 4 THEN [{'k': 0, 'block_type': 'paragraph', 'text': t || ' and r' || i, 'level': NULL, 'language': NULL, 'ordered': NULL, 'path': ''}]
    ELSE [{'k': 0, 'block_type': 'paragraph', 'text': t, 'level': NULL, 'language': NULL, 'ordered': NULL, 'path': 'qq'},
      {'k': 1, 'block_type': 'heading', 'text': t, 'level': 1, 'language': NULL, 'ordered': NULL, 'path': 'q'}] END, recursive := true)
    FROM (SELECT doc_id, unnest(lines) AS t, generate_subscripts(lines, 1) - 1 AS i
      FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
        lambda x: trim(regexp_replace(regexp_replace(x, '[^\\pL ]', '', 'g'), ' +', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents))) s""")
add("md_tables", "SELECT doc_id, cols, rows, text FROM blocks WHERE block_type = 'table'", MD_BLOCKS)
add("parse_stats", """SELECT doc_id, count(*) AS total_blocks, count(*) FILTER (WHERE block_type = 'heading') AS heading_count,
  count(*) FILTER (WHERE block_type = 'code') AS code_block_count, count(*) FILTER (WHERE block_type = 'table') AS table_count,
  count(*) FILTER (WHERE block_type = 'table') > 0 AS has_tables FROM blocks GROUP BY doc_id""", MD_BLOCKS)
add("renumber", """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1 AS INTEGER) AS position,
  block_type FROM blocks WHERE block_type <> 'code'""", MD_BLOCKS)

for _kind, _columns in {"heading": "level", "code": "language", "list_item": "ordered, level"}.items():
    add(f"md_{_kind}", f"SELECT doc_id, position, text, {_columns} FROM blocks WHERE block_type = '{_kind}'", MD_BLOCKS)
add("md_quote", "SELECT doc_id, position, text FROM blocks WHERE is_quote", MD_BLOCKS)

# --- pages ----------------------------------------------------------------------
add("classify_pages", "SELECT doc_id, page_number, image_count, page_type FROM classes", LINE_PAGES)
add("image_ratio_of_pages", "SELECT doc_id, page_number, round(image_ratio, 10) AS image_ratio FROM ratios", LINE_PAGES)
add("page_summary", """SELECT doc_id, count(*) AS total_pages, count(*) FILTER (WHERE page_type = 'text') AS text_pages,
  count(*) FILTER (WHERE page_type = 'scanned') AS scanned_pages, count(*) FILTER (WHERE page_type = 'hybrid') AS hybrid_pages,
  count(*) FILTER (WHERE page_type = 'blank') AS blank_pages FROM classes GROUP BY doc_id""", LINE_PAGES)
add("ocr_placeholder", """SELECT doc_id, page_number, 'paragraph' AS block_type, '' AS text, page_type, TRUE AS needs_ocr,
  image_count FROM classes WHERE page_type = 'scanned'""", LINE_PAGES)
add("page_warnings", """SELECT doc_id, page_number, 'page ' || page_number || CASE page_type
  WHEN 'scanned' THEN ' scanned: no text, needs OCR, images=' || image_count ELSE ' hybrid: text kept, images skipped' END AS warning
  FROM classes WHERE page_type IN ('scanned', 'hybrid')""", LINE_PAGES)
PAGE_PARAS = f"""
page_paras AS (SELECT doc_id, page_number, page_type, {strip('text')} AS text FROM classes
  WHERE length(regexp_replace(text, '{WS}+', '', 'g')) >= 10)"""
add("split_paragraphs_page", "SELECT doc_id, page_number, CAST(0 AS INTEGER) AS seq, text FROM page_paras", LINE_PAGES, PAGE_PARAS)
add("page_tables", """SELECT doc_id, page_number, CAST(n AS INTEGER) AS rows, CAST(w AS INTEGER) AS cols, text
  FROM tables WHERE n > 0""", RAW_TABLES)
add("table_warnings", """SELECT doc_id, page_number, 'page 1 table: headers only, skipped' AS warning FROM tables
  WHERE n = 0""", RAW_TABLES)
NUMBERED = """SELECT doc_id, page_number, block_type, text, rows, cols, needs_ocr, image_count,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, kind) - 1 AS INTEGER) AS position
  FROM (
    SELECT doc_id, page_number, 1 AS kind, 'paragraph' AS block_type, text, CAST(NULL AS INTEGER) AS rows,
      CAST(NULL AS INTEGER) AS cols, CAST(NULL AS BOOLEAN) AS needs_ocr, CAST(NULL AS INTEGER) AS image_count
    FROM page_paras WHERE page_type IN ('text', 'hybrid')
    UNION ALL
    SELECT doc_id, page_number, 2, 'table', t.text, CAST(n AS INTEGER), CAST(w AS INTEGER), NULL, NULL
    FROM tables t JOIN classes c USING (doc_id, page_number) WHERE n > 0 AND page_type IN ('text', 'hybrid')
    UNION ALL
    SELECT doc_id, page_number, 0, 'paragraph', '', NULL, NULL, TRUE, image_count FROM classes WHERE page_type = 'scanned')"""
add("page_blocks", NUMBERED, LINE_PAGES, PAGE_PARAS, RAW_TABLES)
PAGED = f"numbered AS ({NUMBERED}), blocks AS (SELECT doc_id, position, block_type, text FROM numbered)"
SEAM = "chr(64976)"
add("join_across_pages", f"""WITH cut AS (
    SELECT source AS doc_id, doc_id AS page_number, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '[^\\pL]+$', '') ELSE text END
      || CASE WHEN doc_id % 4 = 0 THEN '-' ELSE '' END AS text FROM documents),
  page AS (SELECT doc_id, page_number, CASE WHEN page_number % 3 = 0 THEN lower(left(text, 1)) || substr(text, 2) ELSE text END AS text FROM cut),
  line AS (SELECT doc_id, page_number, unnest(list_filter(list_transform(string_split(text, {NL}), lambda x: {strip('x')}), lambda x: x <> '')) AS text,
      generate_subscripts(list_filter(list_transform(string_split(text, {NL}), lambda x: {strip('x')}), lambda x: x <> ''), 1) AS i FROM page),
  seen AS (SELECT *, lag(text) OVER w AS before, lag(page_number) OVER w AS page_before FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, i)),
  marked AS (SELECT *, CASE WHEN page_before <> page_number AND NOT regexp_matches(before, '[.!?:;。！？：；…]["''”’)\\]}}»]*$')
      AND regexp_matches(text, '^[\\p{{Ll}}\\p{{Lo}}]') THEN 0 ELSE 1 END AS opens FROM seen),
  runs AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY page_number, i) AS run FROM marked)
  SELECT doc_id, CAST(run - 1 AS INTEGER) AS position, 'paragraph' AS block_type,
    replace(regexp_replace(regexp_replace(string_agg(text, {SEAM} ORDER BY page_number, i), '(\\pL)-' || {SEAM}, '\\1', 'g'),
      {SEAM} || '(\\p{{Lo}})', '\\1', 'g'), {SEAM}, ' ') AS text,
    min(page_number) AS page_number, max(page_number) AS last_page, count(*) AS pieces, count(*) > 1 AS cross_page_boundary, count(*) = 1 AS page_number_certain
  FROM runs GROUP BY doc_id, run""")
add("page_chunk_rows", """SELECT document_id, chunk_index, chunk_hash, token_count, CAST(p.page_number AS INTEGER) AS page_number
  FROM chunk_table JOIN (SELECT doc_id, run - 1 AS spot, min(source_position) AS head FROM runs GROUP BY doc_id, run) f
    ON f.doc_id = document_id AND spot = chunk_index
  JOIN numbered p ON p.doc_id = document_id AND p.position = head""", LINE_PAGES, PAGE_PARAS, RAW_TABLES, PAGED, chunks(), recursive=True)
WARNINGS = """warned AS (
  SELECT doc_id, page_number, 'page ' || page_number || CASE page_type WHEN 'scanned'
    THEN ' scanned: no text, needs OCR, images=' || image_count ELSE ' hybrid: text kept, images skipped' END AS warning
  FROM classes WHERE page_type IN ('scanned', 'hybrid')
  UNION ALL SELECT doc_id, 1, 'page 1 table: headers only, skipped' FROM tables WHERE n = 0)"""
add("parsed_documents", f"""SELECT doc_id, count(*) AS total_pages, count(*) FILTER (WHERE page_type = 'text') AS text_pages,
  count(*) FILTER (WHERE page_type = 'scanned') AS scanned_pages, count(*) FILTER (WHERE page_type = 'hybrid') AS hybrid_pages,
  count(*) FILTER (WHERE page_type = 'blank') AS blank_pages,
  (SELECT count(*) FROM blocks b WHERE b.doc_id = c.doc_id) AS total_blocks,
  CAST((SELECT count(*) FROM warned w WHERE w.doc_id = c.doc_id) AS INTEGER) AS n_warnings,
  sha256(coalesce((SELECT string_agg(warning, {NL} ORDER BY page_number, warning) FROM warned w WHERE w.doc_id = c.doc_id), '')) AS warnings,
  CASE WHEN (SELECT count(*) FROM blocks b WHERE b.doc_id = c.doc_id) > 0 THEN 'ready' ELSE 'failed' END AS status
  FROM classes c GROUP BY doc_id""", LINE_PAGES, PAGE_PARAS, RAW_TABLES, PAGED, WARNINGS)

# --- repeated regions -------------------------------------------------------------
add("hf_guards", "SELECT * FROM guards", REPEATED)
add("hf_guard_warnings", """SELECT doc_id, CASE detection WHEN 'limited' THEN 'repeated regions looked for on part of the pages: '
    || empty_pages || ' of ' || total_pages || ' have no text'
  WHEN 'skipped_few_pages' THEN 'repeated regions not looked for: pages with text: ' || valid_pages || ', needed: 3'
  ELSE 'repeated regions not looked for: no page has text' END AS warning FROM guards WHERE detection <> 'full'""", REPEATED)
add("hf_regions", "SELECT doc_id, page_number, region, text, norm FROM regions", REPEATED)
add("hf_normalize", f"""SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(line, '\\b\\d+\\b', '#', 'g'),
  '{WS}+', ' ', 'g'), {WS_CHARS}) AS norm FROM lines""", LINES)
add("hf_groups", "SELECT * FROM groups", REPEATED)
add("hf_confirm", "SELECT * FROM confirmed", REPEATED)
MISREAD = """misread AS (SELECT doc_id, region, page_number, regexp_replace(text, '^Report ', word) AS text, regexp_replace(norm, '^Report ', word) AS norm
    FROM (SELECT *, CASE WHEN region = 'header' AND page_number % 3 = 1 THEN 'Reports ' WHEN region = 'header' AND page_number % 3 = 2 THEN 'Rport '
      ELSE 'Report ' END AS word FROM regions)),
  mgroups AS (SELECT doc_id, region, norm, arg_min(text, page_number) AS text, min(page_number) AS first_page, count(*) AS page_count FROM misread GROUP BY ALL),
  less AS (SELECT DISTINCT doc_id, region, norm, left(norm, i) || substr(norm, i + 2) AS k FROM mgroups, LATERAL (SELECT unnest(range(length(norm) + 1)) AS i) x),
  near AS (SELECT DISTINCT a.doc_id, a.region, a.norm, b.norm AS other FROM less a JOIN less b USING (doc_id, region, k)),
  reach AS (SELECT doc_id, region, norm, norm AS other FROM mgroups
    UNION SELECT r.doc_id, r.region, r.norm, n.other FROM reach r JOIN near n ON n.doc_id = r.doc_id AND n.region = r.region AND n.norm = r.other),
  merged AS (SELECT r.doc_id, r.region, r.norm AS variant, first(r.other ORDER BY g.page_count DESC, r.other) AS norm
    FROM reach r JOIN mgroups g ON g.doc_id = r.doc_id AND g.region = r.region AND g.norm = r.other GROUP BY r.doc_id, r.region, r.norm),
  similar_groups AS (SELECT m.doc_id, m.region, m.norm, max(CASE WHEN m.variant = m.norm THEN g.text END) AS text, min(g.first_page) AS first_page,
    CAST(sum(g.page_count) AS BIGINT) AS page_count, count(*) AS n_variants
    FROM merged m JOIN mgroups g ON g.doc_id = m.doc_id AND g.region = m.region AND g.norm = m.variant GROUP BY m.doc_id, m.region, m.norm)"""
add("hf_variants", """SELECT m.doc_id, m.region, m.variant, m.norm, g.page_count
  FROM merged m JOIN mgroups g ON g.doc_id = m.doc_id AND g.region = m.region AND g.norm = m.variant""", REPEATED, MISREAD, recursive=True)
add("hf_similar_groups", "SELECT * FROM similar_groups", REPEATED, MISREAD, recursive=True)
add("hf_similar_confirm", """SELECT s.*, total_pages FROM similar_groups s JOIN guards USING (doc_id)
  WHERE detection IN ('limited', 'full') AND page_count / total_pages >= 0.5""", REPEATED, MISREAD, recursive=True)
add("hf_page_ranges", "SELECT * FROM ranges", REPEATED)
add("hf_warnings", """SELECT c.doc_id, c.region, c.norm, c.region || '_detected: ''' || substr(c.text, 1, 80) || ''' on '
  || page_count || '/' || total_pages || ' pages (' || string_agg(pages, ', ' ORDER BY r.first_page) || ')' AS warning
  FROM confirmed c JOIN ranges r USING (doc_id, region, norm)
  GROUP BY c.doc_id, c.region, c.norm, c.text, page_count, total_pages""", REPEATED)

# --- chunks -----------------------------------------------------------------------
ONE_BLOCK = "blocks AS (SELECT doc_id, CAST(0 AS INTEGER) AS position, 'paragraph' AS block_type, text FROM documents)"
add("split_long", """SELECT doc_id, CAST(part AS INTEGER) AS part, CASE WHEN split_part IS NOT NULL THEN lang <> 'fr' END AS page_number_certain, CAST(split_part AS INTEGER) AS split_part, split_total,
  char_offset_start, char_offset_end, sha256(p.text) AS text_hash FROM parts p JOIN documents USING (doc_id)""", ONE_BLOCK, chunks(), recursive=True)
MARKS = "CAST(merged_from AS INTEGER) AS merged_from, CAST(merged_to AS INTEGER) AS merged_to"
add("merge_short", f"""SELECT doc_id, position, block_type, {MARKS}, sha256(text) AS text_hash FROM merged""",
    MD_BLOCKS, chunks(), recursive=True)
add("chunk_blocks", f"""SELECT doc_id, position, block_type, CAST(split_part AS INTEGER) AS split_part, split_total,
  char_offset_start, char_offset_end, {MARKS}, sha256(text) AS text_hash FROM merged""", MD_BLOCKS, chunks(), recursive=True)
add("chunk_rows", "SELECT * FROM chunk_table", *CHUNKS_OF_DOCS, recursive=True)
add("chunk_rows_small", "SELECT document_id, chunk_index, chunk_hash, token_count FROM chunk_table",
    SPACED, paragraphs("spaced"), chunks(100, 20, 30), recursive=True)
add("ingest_files", """SELECT document_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens
  FROM chunk_table GROUP BY document_id""", *PARSED_FILES, chunks(), recursive=True)
add("dedup_chunks", """SELECT document_id, chunk_index, chunk_hash FROM chunk_table
  QUALIFY row_number() OVER (PARTITION BY chunk_hash ORDER BY document_id, chunk_index) = 1""", *CHUNKS_OF_LINES, recursive=True)
add("chunk_summary", """SELECT document_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens,
  CAST(sum(length(chunk_text)) AS BIGINT) AS chars, round(avg(length(chunk_text)), 4) AS avg_chars
  FROM chunk_table GROUP BY document_id""", *CHUNKS_OF_LINES, recursive=True)

# --- ranking and sessions -----------------------------------------------------------
SCORES = "scores AS (SELECT doc_id, count(*) AS score FROM access_log GROUP BY doc_id)"
add("hot_counts", "SELECT * FROM scores", ACCESS, SCORES)
add("hot_top_n", "SELECT * FROM scores ORDER BY score DESC, doc_id DESC LIMIT 20", ACCESS, SCORES)
add("hot_remove", """SELECT * FROM scores WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  ORDER BY score DESC, doc_id DESC LIMIT 20""", ACCESS, SCORES)
add("hot_sketches", """SELECT strftime(period, '%Y-%m-%d %H') AS period, CAST(sum(n) OVER (PARTITION BY period) AS BIGINT) AS total, CAST(0 AS BIGINT) AS error,
  doc_id AS item, n FROM (SELECT date_trunc('hour', ts) AS period, doc_id, count(*) AS n FROM access_log WHERE doc_id IS NOT NULL GROUP BY ALL)""", ACCESS)
RANGES = """ranges AS (SELECT unnest(['all', 'week', 'morning']) AS range,
    unnest([TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-08 00:00:00', TIMESTAMP '2024-01-20 06:00:00']) AS a,
    unnest([TIMESTAMP '2024-02-01 00:00:00', TIMESTAMP '2024-01-15 00:00:00', TIMESTAMP '2024-01-20 12:00:00']) AS b),
  range_scores AS (SELECT range, doc_id, count(*) AS score FROM access_log JOIN ranges ON ts >= a AND ts < b WHERE doc_id IS NOT NULL GROUP BY ALL),
  range_top AS (SELECT * FROM range_scores QUALIFY row_number() OVER (PARTITION BY range ORDER BY score DESC, doc_id DESC) <= 20)"""
add("hot_of_ranges", "SELECT * FROM range_top", ACCESS, RANGES)
add("hot_stream_ranges", "SELECT doc_id, score FROM range_top WHERE range = 'week'", ACCESS, RANGES)
add("recent_access", f"""SELECT user_id, CAST(rank AS INTEGER) AS rank, doc_id, {iso('last_ts')} AS last_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, doc_id DESC) AS rank FROM (
    SELECT user_id, doc_id, max(ts) AS last_ts FROM access_log GROUP BY user_id, doc_id)) WHERE rank <= 20""", ACCESS)
SESSIONS = """
gaps AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM gaps),
found AS (SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS last_access,
  count(*) AS accesses FROM numbered GROUP BY user_id, session_no)"""
add("session_timeout", f"""SELECT user_id, session_no, {iso('session_start')} AS session_start,
  {iso('last_access')} AS last_access, accesses FROM found""", SESSIONS)
ORACLE["hot_stream"] = ORACLE["hot_top_n"]
add("session_stream", f"""SELECT user_id, {iso('session_start')} AS session_start,
  {iso('last_access + INTERVAL 30 MINUTE')} AS session_end, accesses FROM found
  WHERE last_access + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""", SESSIONS)
add("count_stream", "SELECT o_orderstatus AS status, count(*) AS cnt FROM orders GROUP BY 1")
add("ingest_stream", "SELECT document_id, chunk_index, chunk_hash, token_count FROM chunk_table", *CHUNKS_OF_DOCS, recursive=True)

# --- tables -------------------------------------------------------------------------
add("insert_if_absent", """SELECT user_id, file_type, id, filename FROM catalog WHERE status = 'ready'
  UNION ALL (SELECT user_id, file_type, id, filename FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM catalog e
    WHERE e.status = 'ready' AND e.user_id = c.user_id AND e.file_type = c.file_type)
  QUALIFY row_number() OVER (PARTITION BY user_id, file_type ORDER BY id) = 1)""", CATALOG)
add("update_rows", """SELECT id, CASE WHEN l.doc_id IS NULL THEN status WHEN quality = 1 THEN 'ready' END AS status, filename
  FROM catalog LEFT JOIN labels l ON l.doc_id = id""", CATALOG)
add("delete_rows", f"{PUBLIC} FROM catalog WHERE id NOT IN (SELECT doc_id FROM labels)", CATALOG)
add("deleted_flags", """SELECT event_id AS id, event_id IN (SELECT id FROM catalog WHERE status = 'ready') AS deleted
  FROM events""", CATALOG)
add("cascade_delete", """SELECT id, user_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = id) AS chunks FROM catalog
  WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""", CATALOG)
GONE = "gone AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)"
add("delete_documents", """SELECT 'catalog' AS part, count(*) AS n FROM catalog WHERE id NOT IN (FROM gone)
  UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM gone)
  UNION ALL SELECT 'scores', count(*) FROM scores WHERE doc_id NOT IN (FROM gone)
  UNION ALL SELECT 'deleted', count(*) FROM catalog WHERE id IN (FROM gone)""", CATALOG, ACCESS, SCORES, GONE)
add("replace_document_chunks", """SELECT document_id, count(*) AS chunks, CAST(sum(t) AS BIGINT) AS tokens FROM (
    SELECT l_orderkey AS document_id, CAST(l_quantity AS INTEGER) AS t FROM lineitem
    WHERE l_orderkey NOT IN (SELECT id FROM catalog WHERE status = 'parsing')
    UNION ALL SELECT id, length(filename) FROM catalog WHERE status = 'parsing') GROUP BY document_id""", CATALOG)
add("check_unique", """SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, count(*) AS n FROM lineitem
  GROUP BY ALL HAVING count(*) > 1""")
add("check_fk", """SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, CAST(l_quantity AS INTEGER) AS token_count
  FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM documents)""")
add("check_domain", "UNPIVOT (SELECT " + ", ".join(
    f"count(*) FILTER (WHERE NOT coalesce({rule}, FALSE)) AS {name}" for name, rule in [
        ("status_domain", "status IN ('uploaded', 'parsing', 'chunking', 'ready', 'failed')"),
        ("file_size_not_negative", "file_size >= 0"), ("filename_length", "length(filename) <= 512"),
        ("file_type_length", "length(file_type) <= 16"), ("storage_path_length", "length(storage_path) <= 1024"),
        *[(f"{c}_required", f"{c} IS NOT NULL") for c in
          ("id", "user_id", "filename", "file_type", "file_size", "storage_path", "status")]]
) + " FROM catalog) ON COLUMNS(*) INTO NAME rule VALUE violations", CATALOG)

# --- conversations and prompts --------------------------------------------------------
TURNS = """turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role, text AS content
  FROM conversations WHERE role IN ('user', 'assistant'))"""
add("build_conversation", "SELECT * FROM turns", TURNS)
add("message_json", """SELECT conv_id, turn, CAST(CASE role WHEN 'assistant' THEN json_object('role', role, 'content', text,
  'reasoning_content', 'weighed turn ' || turn) ELSE json_object('role', role, 'content', text) END AS VARCHAR) AS message
  FROM conversations""")
add("assemble_request", """SELECT conv_id, CAST(0 AS INTEGER) AS section, CAST(0 AS BIGINT) AS position,
    'system' AS role, 'Be brief.' AS content FROM newest
  UNION ALL SELECT conv_id, 1, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, role, c.text
    FROM conversations c JOIN newest USING (conv_id) WHERE role IN ('user', 'assistant') AND turn < asked
  UNION ALL SELECT conv_id, 2, 0, 'user', text FROM newest""", PROMPTS)
add("request_params", """SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 16000 ELSE CAST(user_id % 5 AS INTEGER) END AS max_tokens,
  CASE WHEN event_type = 'view' THEN 'low' ELSE 'high' END AS reasoning_effort,
  CASE WHEN event_type = 'error' THEN 'disabled' ELSE 'enabled' END AS thinking FROM events""")
add("parse_response", """SELECT input_id, prompt_name, run_no, text, CASE WHEN run_no % 3 = 0 THEN 'thought' END AS reasoning_content,
  CASE WHEN conv_id % 2 = 0 THEN 'model-a' ELSE 'model-z' END AS model,
  CASE WHEN run_no % 4 = 1 THEN 'length' ELSE 'stop' END AS finish_reason, n AS prompt_tokens,
  CASE WHEN run_no % 5 = 3 THEN 0 ELSE n * 2 END AS completion_tokens, n * 3 AS total_tokens,
  round(n * CAST(1.23456 AS DOUBLE), 2) AS latency_ms, CAST(NULL AS VARCHAR) AS parse_error FROM answers""", PROMPTS)
add("unreadable_responses", """SELECT input_id, prompt_name, run_no, CASE WHEN run_no % 4 = 1 THEN 'not a JSON object'
  WHEN run_no % 8 = 3 THEN 'no response' ELSE 'no choices' END AS parse_error FROM answers WHERE run_no % 4 IN (1, 3)""", PROMPTS)
add("prompt_registry", """SELECT prompt_name, CAST(ord AS INTEGER) AS ord, CAST(CASE prompt_name WHEN 'claims_with_sources' THEN 26 WHEN 'two_sides' THEN 18
  ELSE 7 END AS INTEGER) AS template_chars, (SELECT count(*) FROM answers a WHERE a.prompt_name = n.prompt_name) AS responses FROM names n""", PROMPTS)
add("explode_messages", f"""SELECT conv_id || '-' || turn AS id, CAST(i - 1 AS INTEGER) AS position,
  CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, content,
  '2026-01-01T00:00:' || lpad(CAST((i - 1) % 60 AS VARCHAR), 2, '0') || 'Z' AS timestamp, CAST(NULL AS VARCHAR) AS error
  FROM (SELECT conv_id, turn, unnest(string_split(text, {NL})) AS content,
    generate_subscripts(string_split(text, {NL}), 1) AS i FROM conversations)""")
add("render_prompts", """SELECT doc_id, CASE WHEN lang <> 'es' THEN 'In ' || lang || ', {from} ' || source || '?' END AS user_message,
  CASE WHEN lang = 'es' THEN 'missing value' END AS reject_reason FROM documents""")
add("render_grid", """SELECT input_id, prompt_name, CAST(ord AS INTEGER) AS ord,
  CASE WHEN prompt_name = 'two_sides' THEN 'Statement: ' ELSE '' END || text AS user_message FROM asked
  CROSS JOIN (VALUES ('csv_facts', 0), ('plain', 1), ('two_sides', 2)) t(prompt_name, ord)""", PROMPTS)
add("unknown_names", "SELECT event_type AS prompt_name, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
add("has_json", """SELECT event_id, json_valid(CASE event_type WHEN 'view' THEN props WHEN 'click' THEN props || ' x'
  WHEN 'error' THEN '"error"' WHEN 'purchase' THEN '[' || user_id || ', null]' ELSE event_type END) AS has_json FROM events""")
add("output_metrics", f"""SELECT doc_id, CAST(length(t) AS INTEGER) AS char_count,
  CAST(len(list_filter(regexp_split_to_array(t, '{WS}+'), lambda w: w <> '')) AS INTEGER) AS word_count, json_valid(t) AS has_json,
  (contains(t, '[1]') OR contains(t, '[2]') OR contains(t, 'reference') OR contains(t, 'Reference') OR contains(t, '来源')
    OR contains(t, '引用') OR contains(t, '参见')) AS has_citation
  FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' see [1]' ELSE '' END AS t FROM documents)""")
add("prompt_metrics_summary", """SELECT prompt_name, count(*) AS outputs, round(avg(char_count), 4) AS avg_chars,
  round(avg(word_count), 4) AS avg_words, round(avg(latency_ms), 4) AS avg_latency_ms, CAST(sum(token_total) AS BIGINT) AS tokens,
  count(*) FILTER (WHERE has_json) AS json_outputs, count(*) FILTER (WHERE has_citation) AS cited_outputs
  FROM results WHERE text IS NOT NULL GROUP BY prompt_name""", PROMPTS)
add("run_experiment", "SELECT * FROM reports", PROMPTS, REPORT)

# --- vectors --------------------------------------------------------------------------
SIM = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
add("cosine_top_k", f"""SELECT a.vec_id, round({SIM}, 6) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
  ORDER BY {SIM} DESC, a.vec_id LIMIT 10""")
NEAREST = f"""SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT q.vec_id AS query_id, a.vec_id, {SIM} AS s,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIM} DESC, a.vec_id) AS INTEGER) AS rank
  FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= """
add("cosine_top_k_batch", f"{NEAREST}5")
add("cosine_index_top_k", f"{NEAREST}10")
