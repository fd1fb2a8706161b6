"""The queries' results in DuckDB's SQL, written by itself: no expression is shared with the Spark side."""

from __future__ import annotations

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def low(x: str) -> str:
    return f"translate({x}, {_ABC})"


def trim(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def md(x: str) -> str:
    return rf"regexp_replace({x}, '([\\`*_\[\]<>|~$])', '\\\1', 'g')"


def vault(x: str) -> str:
    tag = rf"regexp_replace({md(x)}, '#([A-Za-z0-9_\-/\\]|[^\x00-\x7F])', '\\#\1', 'g')"
    return rf"replace(replace({tag}, '==', '\=\='), '%%', '\%\%')"


def html(x: str, quotes: bool = False) -> str:
    out = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"replace(replace({out}, '\"', '&quot;'), '''', '&#39;')" if quotes else out


def xml(x: str) -> str:
    return html(rf"regexp_replace({x}, '[^\t\n\r\x{{20}}-\x{{FDCF}}\x{{FDF0}}-\x{{FFFD}}\x{{10000}}-\x{{10FFFF}}]', '', 'g')", True)


def yaml(x: str) -> str:
    return rf"""('"' || replace(regexp_replace({x}, '(["\\])', '\\\1', 'g'), chr(10), '\n') || '"')"""


def line_start(x: str) -> str:
    return rf"""CASE WHEN regexp_matches({x}, '(?s)^(?:#{{1,6}}|[-+])(?: .*)?\z') OR regexp_matches({x}, '^(?:-+|=+)\z') THEN '\' || {x}
        ELSE regexp_replace(regexp_replace({x}, '^([0-9]{{1,9}})([.)]) ', '\1\\\2 '), '^([0-9]{{1,9}})([.)])\z', '\1\\\2') END"""


def cut(x: str, most: int) -> str:
    return f"CASE WHEN strlen({x}) <= {most} THEN {x} ELSE left({x}, list_max(list_filter(range(0, {most + 1}), lambda i: strlen(left({x}, i)) <= {most}))) END"


def name(x: str, most: int, table: str) -> str:
    """Two steps of WITH: n1 (before the cut) and n2 over ``table``'s rows."""
    one = rf"""regexp_replace(regexp_replace(regexp_replace({x}, '[\x00-\x1F\x7F\x{{FDD0}}-\x{{FDEF}}]', '', 'g'), '[<>:"/\\|?*]', '_', 'g'), '[ \t]+', ' ', 'g')"""
    two = rf"regexp_replace(regexp_replace({trim(one)}, '[. ]+\z', ''), '^\.+', '')"
    return f"""n1 AS (SELECT *, {two} AS n FROM {table}),
        n2 AS (SELECT * EXCLUDE (n), CASE WHEN strlen(n) <= {most} THEN n ELSE {trim(cut('n', most))} END AS n FROM n1),
        n3 AS (SELECT * EXCLUDE (n), CASE WHEN regexp_matches(n, '^(?i:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\\.|\\z)') THEN '_' || n WHEN n = '' THEN 'untitled' ELSE n END AS n FROM n2)"""


def url(x: str) -> str:
    return rf"""array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9\-_.~/]$') OR ord(c) >= 128 THEN c ELSE '%' || printf('%02X', ord(c)) END), '')"""


def md_url(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[ ()<>]') THEN '<' || replace(replace({x}, '<', '%3C'), '>', '%3E') || '>' ELSE {x} END"


TITLED = """titled AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)"""
LEVELS = "levels AS (SELECT user_id, event_id, (event_id * 31 + floor(value)::BIGINT) % 4 AS level FROM events)"
STROKES = """strokes AS (
        SELECT vec_id, i, sum(dx) OVER w AS x, sum(dy) OVER w AS y FROM (
            SELECT vec_id, unnest(range(0, 32)) AS i, unnest([embedding[2 * k + 1]::DOUBLE for k in range(0, 32)]) AS dx, unnest([embedding[2 * k + 2]::DOUBLE for k in range(0, 32)]) AS dy FROM embeddings)
        WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING))"""
KINDS = "['para', 'bullet', 'ordered', 'task', 'done', 'quote', 'ordered']"
ELEMENTS = f"""elements AS (
        SELECT conv_id AS page, turn AS pos, CASE WHEN turn = 0 THEN 'heading' ELSE {KINDS}[length(text) % 7 + 1] END AS kind, text FROM conversations)"""


def px(x: str) -> str:
    return f"regexp_replace(printf('%.2f', {x}), '\\.?0+$', '')"


def fixed(x: str) -> str:
    return f"CASE WHEN {px(x)} IN ('-0', '-') THEN '0' ELSE {px(x)} END"


def _markdown(escape, line_break: str) -> str:
    body = escape("text")
    flat = f"replace({body}, chr(10), ' ')"
    lines = f"array_to_string(list_transform(string_split({body}, chr(10)), lambda l: {line_start('l')}), {line_break})"
    return f"""CASE kind WHEN 'heading' THEN '# ' || {flat} WHEN 'quote' THEN '> ' || replace({body}, chr(10), chr(10) || '> ')
        WHEN 'bullet' THEN '- ' || {flat} WHEN 'ordered' THEN number::VARCHAR || '. ' || {flat}
        WHEN 'task' THEN '- [ ] ' || {flat} WHEN 'done' THEN '- [x] ' || {flat} ELSE {lines} END"""


SQL = {
    "page_title_sanitized": rf"""
        WITH {TITLED}, {name('title', 40, 'titled')},
        long AS (WITH {name('title', 120, 'titled')} SELECT page_id, n AS long FROM n3)
        SELECT page_id, title, n AS name, replace(translate(long, '#^[]|', '_____'), '%%', '%') AS vault,
               regexp_matches({low(trim('title'))}, '^(?:|image|image\..*|untitled picture.*)\z') AS generic
        FROM n3 JOIN long USING (page_id)""",
    "unique_page_names": f"""
        WITH {TITLED}, named AS (SELECT host, page_id, coalesce(nullif(title, ''), 'Untitled Page') AS t FROM titled), {name('t', 80, 'named')},
        nth AS (SELECT host, page_id, n, row_number() OVER (PARTITION BY host, {low('n')} ORDER BY page_id) + ({low('n')} = 'assets')::INT AS k FROM n3)
        SELECT host, page_id, n AS name, CASE WHEN k = 1 THEN n ELSE n || ' (' || k || ')' END AS unique_name FROM nth""",
    "page_nav": f"""
        WITH {TITLED}
        SELECT host, page_id, title, lag(page_id) OVER w AS prev_page_id, lead(page_id) OVER w AS next_page_id, lag(title) OVER w AS prev_title, lead(title) OVER w AS next_title
        FROM titled WINDOW w AS (PARTITION BY host ORDER BY page_id)""",
    "toc_index": f"""
        WITH {TITLED}
        SELECT host, string_agg('- [' || {md("coalesce(nullif(title, ''), 'Untitled Page')")} || '](' || {md_url('url')} || ')', chr(10) ORDER BY page_id) AS text FROM titled GROUP BY host""",
    "parent_page": f"""
        WITH {LEVELS},
        above AS (
            SELECT *, {', '.join(f'last_value(CASE WHEN level = {k} THEN event_id END IGNORE NULLS) OVER w AS at{k}, max(CASE WHEN level < {k} THEN event_id END) OVER w AS cut{k}' for k in range(3))}
            FROM levels WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT user_id, event_id, level, CASE {' '.join(f'WHEN level = {k + 1} AND (cut{k} IS NULL OR cut{k} < at{k}) THEN at{k}' for k in range(3))} END AS parent FROM above""",
    "nested_lists": f"""
        WITH {LEVELS}
        SELECT user_id, event_id, level, greatest(0, level - coalesce(lag(level) OVER w, -1)) AS opens, greatest(0, level - coalesce(lead(level) OVER w, -1)) AS closes
        FROM levels WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "list_numbering": """
        WITH c AS (SELECT conv_id, turn, length(text) % 3 > 0 AS o, CASE WHEN length(text) % 5 = 0 THEN 3 END AS r FROM conversations),
        runs AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, o ORDER BY turn) AS run FROM (SELECT * EXCLUDE (turn), turn AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn FROM c))
        SELECT conv_id, t AS turn, CASE WHEN o THEN greatest(1, coalesce(first(r) OVER w, 1) + row_number() OVER w - 1) END AS number
        FROM runs WINDOW w AS (PARTITION BY conv_id, o, run ORDER BY turn)""",
    "merge_runs": """
        WITH c AS (SELECT conv_id, turn, length(text) % 2 AS style, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, length(text) % 2 ORDER BY turn) AS run FROM conversations)
        SELECT conv_id, style, min(turn) AS first, max(turn) AS last, count(*) AS parts, md5(string_agg(text, '' ORDER BY turn)) AS text FROM c GROUP BY conv_id, style, run""",
    "escapes": f"""
        SELECT doc_id, md5({md('text')}) AS md, md5({vault('text')}) AS vault, md5({html('text', True)}) AS html, md5({xml('text')}) AS xml, md5({yaml('text')}) AS yaml, md5({line_start('text')}) AS line FROM documents""",
    "html_escapes": f"SELECT page_id, md5({html('html')}) AS html, md5({xml('html')}) AS xml, md5({md('html')}) AS md FROM pages",
    "url_codec": f"""
        SELECT page_id, {url('url')} AS coded, url AS decoded, {md_url('url')} AS shown,
               CASE WHEN regexp_matches(url, '^(?i:https?|mailto|ftp|tel|file):') THEN {trim('url')} END AS allowed,
               CASE WHEN regexp_extract(url, '(?i)ref=([^&]*)', 1) = '' THEN '' ELSE '{{' || upper(regexp_extract(url, '(?i)ref=([^&]*)', 1)) || '}}' END AS ref
        FROM pages""",
    "wiki_links": f"""
        WITH {TITLED}, {name('title', 80, 'titled')},
        s AS (SELECT *, replace(translate(n, '#^[]|', '_____'), '%%', '%') AS stem FROM n3),
        w AS (SELECT *, count(*) OVER (PARTITION BY {low('stem')}) AS same_name FROM s),
        t AS (SELECT *, CASE WHEN same_name = 1 THEN stem ELSE host || '/' || stem END AS wiki, {trim("replace(regexp_replace(title, '[\\[\\]\\n\\r]', '', 'g'), '|', '-')")} AS label FROM w)
        SELECT page_id, same_name, wiki, '[[' || wiki || CASE WHEN label <> '' AND label <> wiki THEN '|' || label ELSE '' END || ']]' AS link,
               '![[' || wiki || CASE WHEN label <> '' AND label <> wiki THEN '\\|' || label ELSE '' END || ']]' AS embed FROM t""",
    "digests": r"SELECT doc_id, md5(text) AS md5, md5(regexp_replace(base64(encode(text)), '(.{1,76})', '\1' || chr(10), 'g')) AS lines FROM documents",
    "time_formats": """
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso32, strftime(ts, '%Y%m%dT%H%M%SZ') AS compact FROM events""",
    "colors": """
        WITH c AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS c, p_size FROM part)
        SELECT p_partkey, CASE WHEN p_size <= 45 THEN printf('#%02x%02x%02x', c & 255, (c >> 8) & 255, (c >> 16) & 255) END AS color, round(p_size / 3.0::DOUBLE * 48)::BIGINT AS px FROM c""",
    "ink_bounds": f"""
        WITH {STROKES}, b AS (SELECT vec_id, min(x) - 0.25 AS x0, min(y) - 0.25 AS y0, max(x) + 0.25 AS x1, max(y) + 0.25 AS y1 FROM strokes GROUP BY vec_id)
        SELECT vec_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1,
               round(greatest(1, (x1 - x0) * 96 / 2540), 6) AS width_px, round(greatest(1, (y1 - y0) * 96 / 2540), 6) AS height_px FROM b""",
    "ink_paths": f"""
        WITH {STROKES}, p AS (SELECT vec_id, i, x * 100 AS x, y * 100 AS y FROM strokes), b AS (SELECT vec_id, min(x - 26.5) AS x0, min(y - 26.5) AS y0 FROM p GROUP BY vec_id)
        SELECT vec_id, 'M' || string_agg({fixed('(x - x0) / (2540.0 / 96.0)::DOUBLE')} || ' ' || {fixed('(y - y0) / (2540.0 / 96.0)::DOUBLE')}, 'L' ORDER BY i) AS path FROM p JOIN b USING (vec_id) GROUP BY vec_id""",
    "reading_order": """
        SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY floor(embedding[2] * 5::FLOAT), embedding[1], vec_id) AS place FROM embeddings""",
    "newest_wins": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "revision_chain": """
        SELECT o_orderkey, row_number() OVER w - 1 AS depth, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "nearest_declaration": """
        WITH c AS (
            SELECT o_orderkey, row_number() OVER w AS n, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER w AS declared, o_custkey FROM orders
            WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))
        SELECT c.o_orderkey AS revision, c.declared, c.n - p.n AS depth FROM c JOIN c AS p ON p.o_orderkey = c.declared""",
    "tree_paths": """
        WITH RECURSIVE nodes AS (
            SELECT 'r' || r_regionkey AS id, NULL AS parent, r_regionkey::BIGINT AS pos, r_name AS name FROM region
            UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name FROM nation
            UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, c_name FROM customer),
        walk AS (
            SELECT id, 0 AS depth, lpad(pos::VARCHAR, 10, '0') AS path, name AS shown FROM nodes WHERE parent IS NULL
            UNION ALL SELECT n.id, w.depth + 1, w.path || '/' || lpad(n.pos::VARCHAR, 10, '0'), w.shown || ' › ' || n.name FROM nodes n JOIN walk w ON n.parent = w.id)
        SELECT id, depth, path, shown FROM walk""",
    "toc_order": """
        SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal <= 3000, CASE WHEN s_acctbal > 3000 THEN -s_suppkey END, lower(s_name), s_name) AS place,
               s_acctbal > 3000 AS listed, CASE WHEN s_acctbal > 3000 THEN '#000000' END AS color FROM supplier""",
    "resource_dedup": """
        SELECT source, min(doc_id) AS doc_id, md5(text) AS md5, count(*) AS uses FROM documents GROUP BY source, md5(text)""",
    "mime_lookup": """
        SELECT page_id, 'file' || page_id || '.' || ['PNG', 'html', 'tar.gz', 'jpeg', '', 'Pdf'][page_id % 6 + 1] AS name, ['png', 'html', 'gz', 'jpeg', '', 'pdf'][page_id % 6 + 1] AS ext,
               ['image/png', 'text/html', 'application/octet-stream', 'image/jpeg', 'application/octet-stream', 'application/pdf'][page_id % 6 + 1] AS mime FROM pages""",
    "tags_first_seen": """
        WITH t AS (SELECT user_id, event_id, event_type || ' & ' || floor(value)::BIGINT AS label, event_type || '-' || abs(floor(value)::BIGINT) AS key FROM events),
        g AS (SELECT user_id, key, arg_min(label, event_id) AS label, min(event_id) AS f FROM t GROUP BY user_id, key)
        SELECT user_id, key, label, row_number() OVER (PARTITION BY user_id ORDER BY f) AS place FROM g""",
    "reference_faults": """
        SELECT DISTINCT doc_id, 'missing' AS fault FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT DISTINCT doc_id, 'unused' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "link_resolution": """
        WITH s AS (SELECT source, min(doc_id) AS first FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source)
        SELECT d.doc_id, coalesce('page/' || l.doc_id || '.md', 'section/' || s.first || '.md', 'doc:' || d.doc_id) AS target
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN s ON s.source = d.source""",
    "note_sizes": "SELECT source, sum(strlen(text))::BIGINT AS bytes, count(*) AS payloads FROM documents GROUP BY source HAVING sum(strlen(text)) > 60000",
    "export_stats": """
        SELECT count(DISTINCT source) AS sections, count(*) AS pages, sum(strlen(text))::BIGINT AS bytes, count(*) FILTER (coalesce(text, '') = '') AS failed, count(*) FILTER (lang = 'de') AS german FROM documents""",
    "front_matter": f"""
        WITH f AS (SELECT *, split_part(text, chr(10), 1) AS first FROM documents), t AS (SELECT *, {cut('first', 80)} AS t FROM f)
        SELECT doc_id, '---' || chr(10) || concat_ws(chr(10), 'title: ' || {yaml("CASE WHEN t = '' THEN 'Untitled Page' ELSE coalesce(t, 'Untitled Page') END")}, 'lang: ' || {yaml('lang')}, 'section: ' || {yaml('source')}) || chr(10) || '---' || chr(10) AS head FROM t""",
    "table_render": r"""
        WITH c AS (SELECT n_regionkey, n_nationkey, '| ' || n_nationkey || ' | ' || replace(n_name, '_', '\_') || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN 'a\|b ' || replace(n_name, '_', '\_') ELSE '' END || ' |' AS line,
                row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, max(CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 2 END) OVER (PARTITION BY n_regionkey) AS wide FROM nation)
        SELECT n_regionkey, string_agg(line || CASE WHEN k = 1 THEN chr(10) || '|' || repeat(' --- |', wide) ELSE '' END, chr(10) ORDER BY n_nationkey) AS text FROM c GROUP BY n_regionkey""",
    "page_markdown": f"""
        WITH {ELEMENTS},
        runs AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) - row_number() OVER (PARTITION BY page, kind = 'ordered' ORDER BY pos) AS run, kind IN ('bullet', 'ordered', 'task', 'done') AS listed FROM elements),
        n AS (SELECT *, row_number() OVER (PARTITION BY page, kind = 'ordered', run ORDER BY pos) AS number, lag(listed) OVER (PARTITION BY page ORDER BY pos) AS before FROM runs),
        l AS (SELECT page, pos, CASE WHEN before IS NULL THEN '' WHEN before AND listed THEN chr(10) ELSE chr(10) || chr(10) END AS gap, {_markdown(md, "'\\' || chr(10)")} AS plain, {_markdown(vault, "'  ' || chr(10)")} AS vault FROM n),
        p AS (SELECT page, string_agg(gap || plain, '' ORDER BY pos) AS plain, string_agg(gap || vault, '' ORDER BY pos) AS vault FROM l GROUP BY page)
        SELECT page, md5(plain) AS md5, length(plain) AS chars, md5(vault) AS vault_md5 FROM p""",
    "page_html": f"""
        WITH {ELEMENTS},
        k AS (SELECT *, CASE WHEN kind = 'ordered' THEN 'ol' WHEN kind IN ('bullet', 'task', 'done') THEN 'ul' ELSE '' END AS list FROM elements),
        r AS (SELECT *, lag(list) OVER w AS before, lead(list) OVER w AS after FROM k WINDOW w AS (PARTITION BY page ORDER BY pos)),
        t AS (SELECT *, CASE WHEN kind = 'heading' THEN 'h1' WHEN kind = 'quote' THEN 'blockquote' WHEN list <> '' THEN 'li' ELSE 'p' END AS tag,
                CASE kind WHEN 'done' THEN '<input type="checkbox" checked disabled> ' WHEN 'task' THEN '<input type="checkbox" disabled> ' ELSE '' END AS box FROM r),
        l AS (SELECT page, pos, CASE WHEN list <> '' AND before IS DISTINCT FROM list THEN '<' || list || '>' ELSE '' END || '<' || tag || '>' || box || replace({html('text')}, chr(10), '<br>') || '</' || tag || '>'
                || CASE WHEN list <> '' AND after IS DISTINCT FROM list THEN '</' || list || '>' ELSE '' END AS line FROM t),
        p AS (SELECT page, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><style></style></head><body>' || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10) || '</body></html>' || chr(10) AS text FROM l GROUP BY page)
        SELECT page, md5(text) AS md5, length(text) AS chars FROM p""",
    "page_notes": f"""
        WITH b AS (SELECT conv_id, string_agg('<div>' || {xml('text')} || '</div>', '' ORDER BY turn) AS body, arg_min(text, turn) AS title FROM conversations GROUP BY conv_id),
        t AS (SELECT *, {trim("left(regexp_replace(title, '[\\x00-\\x1F\\x7F]', ' ', 'g'), 255)")} AS t FROM b),
        n AS (SELECT conv_id, '<note><title>' || {xml("CASE WHEN t = '' THEN 'Untitled Page' ELSE t END")} || '</title><content><![CDATA[' ||
            replace('<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE en-note SYSTEM "http://xml.evernote.com/pub/enml2.dtd"><en-note>' || body || '</en-note>', ']]>', ']]]]><![CDATA[>') ||
            ']]></content><created>20240101T000000Z</created><tag>a &amp; b</tag><tag>chat</tag></note>' AS note FROM t)
        SELECT conv_id, md5(note) AS md5, length(note) AS chars FROM n""",
    "cabinet_roundtrip": "SELECT 'texts/d' || doc_id || '.txt' AS path, strlen(coalesce(text, '')) AS bytes, md5(coalesce(text, '')) AS md5, NULL::VARCHAR AS error FROM documents",
    "typed_properties": """
        SELECT l_orderkey, arg_min(l_quantity, l_linenumber * 1000000000000 + l_partkey * 100000 + l_quantity::BIGINT) FILTER (l_partkey % 3 = 0) AS a, arg_min(l_quantity, l_linenumber * 1000000000000 + l_partkey * 100000 + l_quantity::BIGINT) FILTER (l_partkey % 3 = 1)::BIGINT AS b,
               arg_min(l_quantity, l_linenumber * 1000000000000 + l_partkey * 100000 + l_quantity::BIGINT) FILTER (l_partkey % 3 = 2) AS c FROM lineitem GROUP BY l_orderkey""",
    "references": "SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 1 AS place, s_suppkey, s_name FROM supplier",
    "id_tables": """
        WITH o AS (SELECT l_orderkey AS revision, l_linenumber::BIGINT AS index, max(l_partkey) AS guid FROM lineitem GROUP BY ALL),
        c AS (SELECT o_orderkey AS revision, 3 + k AS index, 1 + k AS source FROM orders, range(0, 3) AS r(k) WHERE k < o_custkey % 4),
        e AS (SELECT revision, index, guid, 0 AS rank FROM o WHERE guid % 2 = 0 UNION ALL SELECT c.revision, c.index, p.guid, 1 FROM c JOIN o AS p ON p.revision = c.revision AND p.index = c.source)
        SELECT revision, index, arg_min(guid, rank) AS guid FROM e GROUP BY revision, index""",
    "object_parts": """
        SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber = 1) AS content, max(l_quantity) FILTER (l_linenumber = 2) AS metadata, max(l_quantity) FILTER (l_linenumber = 4) AS file FROM lineitem GROUP BY l_orderkey""",
    "page_plan": f"""
        WITH d AS (SELECT doc_id, source, n_chars % 3 AS level, coalesce(nullif(split_part(text, chr(10), 1), ''), 'Untitled Page') AS t FROM documents), {name('t', 80, 'd')},
        k AS (SELECT *, row_number() OVER (PARTITION BY source, {low('n')} ORDER BY doc_id) + ({low('n')} = 'assets')::INT AS nth FROM n3),
        s AS (SELECT *, CASE WHEN nth = 1 THEN n ELSE n || ' (' || nth || ')' END AS stem FROM k),
        a AS (SELECT *, {', '.join(f'last_value(CASE WHEN level = {k} THEN doc_id END IGNORE NULLS) OVER w AS at{k}, max(CASE WHEN level < {k} THEN doc_id END) OVER w AS cut{k}' for k in range(2))},
              count(*) OVER (PARTITION BY {low('stem')}) AS same FROM s WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT doc_id AS page, source || '/' || stem || '.md' AS path, CASE WHEN same = 1 THEN stem ELSE source || '/' || stem END AS wiki,
               CASE {' '.join(f'WHEN level = {k + 1} AND (cut{k} IS NULL OR cut{k} < at{k}) THEN at{k}' for k in range(2))} END AS parent FROM a""",
}
