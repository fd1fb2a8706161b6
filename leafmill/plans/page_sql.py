"""SQL of page_queries, for DuckDB; with the Spark side it shares fixed values alone."""

from __future__ import annotations

from leafmill.operators.projections import CHECKBOXES, EMBEDDED, PICTURES, SYMBOLS
from leafmill.plans.sql import TITLED, cut, fixed, low, md, md_url, trim, vault

_STYLE_FLAGS = ("bold", "italic", "underline", "strike", "superscript", "subscript", "hidden", "hyperlink", "math", "embedded")
_FLAGS = {"bold": 2, "italic": 3, "underline": 11, "strike": 5, "superscript": 13, "subscript": 17, "highlight": 7}
_ADDRESS = r"""'https?://(?:[^\x09-\x0D <>"]*[^\x09-\x0D <>".,;:!?)\]''])?'"""
_PARTS = r"CASE WHEN kind = 'text' THEN string_split_regex(regexp_replace(t, '[\x00-\x08\x0C\x0E-\x1F\x7F\x{FDD0}-\x{FDEF}]', '', 'g'), '[\x0B\n\r\x{2028}]') ELSE [t] END"
RUNS = f"""
        c AS (
            SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN 'math' ELSE 'text' END AS kind, CASE WHEN turn % 4 > 1 THEN 'doc:' || conv_id ELSE '' END AS href,
                   left(text, 60) || CASE WHEN turn % 3 = 0 THEN chr(11) || 'see http://x.org/a_b(1), ok ' ELSE '' END || CASE WHEN turn % 5 = 1 THEN chr(9) || ' ' ELSE '' END AS t,
                   {', '.join(f'length(text) % {m} = 0 AS {s}' for s, m in _FLAGS.items())} FROM conversations),
        parts AS (SELECT * EXCLUDE (t), unnest({_PARTS}) AS text, generate_subscripts({_PARTS}, 1) AS n FROM c),
        inl AS (
            SELECT conv_id, turn * 1000 + 2 * n - 1 AS spot, kind, text, href, {', '.join(_FLAGS)} FROM parts WHERE kind <> 'text' OR text <> ''
            UNION ALL SELECT conv_id, turn * 1000 + 2 * n - 2, 'break', '', href, {', '.join(_FLAGS)} FROM parts WHERE n > 1)"""


def _differs(*columns: str) -> str:
    return " OR ".join(f"lag({c}) OVER w IS DISTINCT FROM {c}" for c in columns)


def _lines(name: str, in_vault: bool, in_table: bool) -> str:
    """Steps of WITH, the last of which, ``name``, has (conv_id, text)."""
    esc = vault if in_vault else md
    said = f"array_to_string(list_transform(list_zip(string_split_regex(core, {_ADDRESS}), regexp_extract_all(core, {_ADDRESS})), lambda z: {esc('z[1]')} || coalesce(z[2], '')), '')"
    light = "'==' || s3 || '=='" if in_vault else "'<mark>' || s3 || '</mark>'"
    label = trim("replace(regexp_replace(plain, '[\\[\\]\\n\\r]', '', 'g'), '|', '-')")
    bar = "'\\|'" if in_table else "'|'"
    wiki = f"CASE WHEN conv_id % 4 = 0 THEN '[[Note ' || conv_id || CASE WHEN {label} <> '' AND {label} <> 'Note ' || conv_id THEN {bar} || {label} ELSE '' END || ']]' END"
    to = md_url("coalesce(CASE WHEN conv_id % 2 = 0 THEN 'pages/a b ' || conv_id END, href)")
    link = f"'[' || CASE WHEN {trim('label')} = '' THEN {esc('href')} ELSE label END || '](' || {to} || ')'"
    hard = "'  ' || chr(10)" if in_vault else "'\\' || chr(10)"
    return f"""
        {name}1 AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY spot) AS run FROM (SELECT *, (kind <> 'text' OR {_differs('kind', 'href', *_FLAGS)})::INT AS s FROM inl WINDOW w AS (PARTITION BY conv_id ORDER BY spot))),
        {name}2 AS (SELECT conv_id, run, kind, href, {', '.join(_FLAGS)}, string_agg(text, '' ORDER BY spot) AS text, min(spot) AS spot FROM {name}1 GROUP BY conv_id, run, kind, href, {', '.join(_FLAGS)}),
        {name}3 AS (
            SELECT *, trim(text, ' ' || chr(9)) AS core, {said} AS s0, CASE WHEN superscript THEN '<sup>' || s0 || '</sup>' ELSE s0 END AS s1, CASE WHEN subscript THEN '<sub>' || s1 || '</sub>' ELSE s1 END AS s2,
                   CASE WHEN underline THEN '<u>' || s2 || '</u>' ELSE s2 END AS s3, CASE WHEN highlight THEN {light} ELSE s3 END AS s4, CASE WHEN strike THEN '~~' || s4 || '~~' ELSE s4 END AS s5,
                   CASE WHEN bold THEN '**' ELSE '' END || CASE WHEN italic THEN '*' ELSE '' END AS marks,
                   CASE WHEN kind = 'break' THEN {"'<br>'" if in_table else 'chr(11)'} WHEN kind <> 'text' THEN {esc('text')} WHEN core = '' THEN text
                        ELSE regexp_extract(text, '^[ \\t]*') || marks || s5 || marks || regexp_extract(text, '[ \\t]*$') END AS shown FROM {name}2),
        {name}4 AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY spot) AS link FROM (SELECT *, (kind <> 'text' OR href = '' OR {_differs('kind', 'href')})::INT AS s FROM {name}3 WINDOW w AS (PARTITION BY conv_id ORDER BY spot))),
        {name}5 AS (SELECT conv_id, link, kind, href, string_agg(shown, '' ORDER BY spot) AS label, string_agg(text, '' ORDER BY spot) AS plain, min(spot) AS spot FROM {name}4 GROUP BY conv_id, link, kind, href),
        {name}6 AS (SELECT conv_id, spot, CASE WHEN kind = 'text' AND href <> '' THEN {f'coalesce({wiki}, {link})' if in_vault else link} ELSE label END AS piece FROM {name}5),
        {name} AS (SELECT conv_id, array_to_string(list_transform(string_split(string_agg(piece, '' ORDER BY spot), chr(11)), lambda x: rtrim(x, ' ')), {hard}) AS text FROM {name}6 GROUP BY conv_id)"""


_SYMBOL = " ".join(f"WHEN shape IN ({', '.join(map(str, shapes))}) THEN '{symbol}'" for symbol, shapes in SYMBOLS.items())
_SLUG = rf"trim(regexp_replace({low('label')}, '[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+', '-', 'g'), '-')"
_HOST_PATH = "ltrim(CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END || 'top/' || CASE WHEN page_id % 4 = 0 THEN 'inner/' ELSE '' END || 'p' || page_id || CASE WHEN page_id % 7 = 0 THEN '.ONE' ELSE '.txt' END, '/')"
_ICON = "CASE media WHEN 1 THEN '🎵' WHEN 2 THEN '🎬' ELSE '📎' END"
_EXT = r"regexp_extract({}, '\.([^./\\]*)$', 1)"


def _alt(esc) -> str:
    return f"replace(replace({esc('replace(name, chr(10), chr(32))')}, chr(13), ''), '  ', ' ')"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


SQL = {
    "inline_lines": f"""
        WITH {RUNS}, {_lines('plain', False, False)}, {_lines('noted', True, False)}, {_lines('cell', True, True)}
        SELECT conv_id, md5(plain.text) AS plain, md5(noted.text) AS vault, md5(cell.text) AS cell, length(plain.text) AS chars FROM plain JOIN noted USING (conv_id) JOIN cell USING (conv_id)""",
    "plain_paragraphs": f"""
        WITH {RUNS}
        SELECT conv_id, md5(string_agg(CASE WHEN kind = 'break' THEN chr(10) ELSE text END, '' ORDER BY spot)) AS text, bool_and(kind = 'break' OR kind = 'text' AND {trim('text')} = '') AS empty FROM inl GROUP BY conv_id""",
    "section_index": r"""
        SELECT c_custkey, regexp_replace(CASE WHEN c_custkey % 5 > 0 THEN c_name || CASE WHEN c_custkey % 3 = 0 THEN '.ONE' ELSE '' END ELSE 'file' || c_custkey || '.one' END, '(?i)\.one$', '') AS name,
               CASE WHEN c_acctbal < 0 THEN ' (could not be read: bad)' WHEN c_custkey % 7 = 0 THEN ' (password protected — not exported)' WHEN c_custkey % 3 = 0 THEN ' (empty)' ELSE '' END AS note,
               c_acctbal >= 0 AND c_custkey % 7 > 0 AS readable FROM customer""",
    "page_titles": f"""
        WITH t AS (SELECT *, {trim('split_part(text, chr(10), 1)')} AS first FROM documents)
        SELECT doc_id, coalesce(CASE doc_id % 4 WHEN 0 THEN nullif({trim('source')}, '') WHEN 1 THEN nullif(lang, '') WHEN 2 THEN nullif({trim('lang')}, '') END, {cut('first', 80)}, '') AS title,
               greatest(0, CASE WHEN doc_id % 5 > 0 THEN n_chars % 4 ELSE 0 END - 1) AS level, CASE WHEN doc_id % 12 BETWEEN 1 AND 6 THEN doc_id % 12 ELSE 0 END AS heading FROM t""",
    "title_blocks": f"""
        SELECT conv_id, {trim("coalesce(string_agg(left(text, 12), ' ' ORDER BY turn) FILTER (turn % 4 <> 1), '')")} AS title, {trim("coalesce(string_agg(left(text, 12), ' ' ORDER BY turn) FILTER (turn % 4 = 1), '')")} AS date
        FROM conversations GROUP BY conv_id""",
    "tag_marks": rf"""
        WITH t AS (SELECT user_id, event_id, floor(value)::BIGINT % 2 = 0 AS completed, coalesce(p_name, '') AS label, coalesce(p_partkey % 150, 0) AS shape FROM events LEFT JOIN part ON p_partkey = event_id % 250),
        m AS (SELECT *, shape IN ({', '.join(map(str, CHECKBOXES))}) AS box, CASE WHEN shape = 0 THEN '' {_SYMBOL} ELSE '●' END AS symbol, {_SLUG} AS s, CASE WHEN regexp_matches(s, '^[0-9-]+$') THEN 'tag-' || s ELSE s END AS slug FROM t)
        SELECT user_id, arg_min(completed, event_id) FILTER (box) AS checked, coalesce(string_agg(symbol || ' ', '' ORDER BY event_id) FILTER (NOT box AND symbol <> ''), '') AS prefix,
               coalesce(string_agg(' #' || slug, '' ORDER BY event_id) FILTER (slug <> '' AND shape <> 3), '') AS suffix FROM m GROUP BY user_id""",
    "images": rf"""
        WITH p AS (
            SELECT p_partkey, s_suppkey IS NULL AS missing, CASE p_partkey % 4 WHEN 0 THEN 'Image' WHEN 1 THEN p_name || '.PNG' ELSE p_name END AS name, ['', 'png', '.tif'][p_partkey % 3 + 1] AS detected,
                   CASE WHEN s_suppkey % 2 = 0 THEN 'gif' ELSE '' END AS held, floor(p_size / 3.0::DOUBLE * (p_partkey % 5) * 48 + 0.5)::BIGINT AS px FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 700),
        e AS (SELECT *, coalesce(nullif(detected, ''), nullif(held, ''), {low(r"regexp_extract(name, '\.[^.]*$')")}, '') AS e0, CASE WHEN e0 <> '' AND e0[1] <> '.' THEN '.' || e0 ELSE e0 END AS ext FROM p),
        f AS (SELECT *, CASE WHEN name = 'Image' THEN 'page-image-' || p_partkey || CASE WHEN ext = '' THEN '.bin' ELSE ext END WHEN ext <> '' AND NOT ends_with({low('name')}, {low('ext')}) THEN name || ext ELSE name END AS file FROM e)
        SELECT p_partkey, ext, file, CASE WHEN missing THEN '*[image unavailable: ' || {_alt(md)} || ']*' ELSE '![' || {_alt(md)} || '](' || {md_url("('assets/' || file)")} || ')' END AS md,
               CASE WHEN missing THEN '*[image unavailable: ' || {_alt(vault)} || ']*' WHEN {low(_EXT.format('file'))} IN ({_quoted(PICTURES)}) THEN '![[' || file || CASE WHEN px BETWEEN 16 AND 4000 THEN '\|' || px ELSE '' END || ']]'
                    ELSE '🖼️ [[' || file || ']]' END AS vault FROM f""",
    "attachments": f"""
        WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '.mp3' WHEN 1 THEN p_brand || '.PDF' ELSE 'attachment' END AS name, p_partkey % 4 AS media, p_partkey % 5 = 0 AS missing FROM part)
        SELECT p_partkey, name, CASE WHEN missing THEN {_ICON} || ' ' || {md('name')} || ' *(file not available)*' ELSE '[' || {_ICON} || ' ' || {md('name')} || '](' || {md_url("('assets/' || name)")} || ')' END AS md,
               CASE WHEN missing THEN {_ICON} || ' ' || {vault('name')} || ' *(file not available)*' WHEN {low(_EXT.format('name'))} IN ({_quoted(EMBEDDED)}) THEN '![[' || name || ']]' ELSE {_ICON} || ' [[' || name || ']]' END AS vault FROM p""",
    "asset_names": """
        WITH p AS (SELECT p_type, p_partkey, lower(p_brand) || CASE WHEN p_partkey % 3 = 0 THEN '.PNG' ELSE '.png' END AS name, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS k FROM part)
        SELECT p_type, p_partkey, name, CASE WHEN k = 1 THEN name ELSE left(name, length(name) - 4) || '-' || k || right(name, 4) END AS unique_name FROM p""",
    "page_canvas": """
        WITH e AS (SELECT label, vec_id, vec_id % 4 AS kind, CASE WHEN vec_id % 9 > 0 THEN embedding[1]::DOUBLE ELSE 0 END * 48 AS x, embedding[2]::DOUBLE * 48 AS y, embedding[3]::DOUBLE AS wide, embedding[4]::DOUBLE AS high FROM embeddings),
        h AS (SELECT label, printf('%.0fpx', greatest(0, max(y + CASE WHEN kind = 1 AND high > 0 THEN high * 48 WHEN kind = 2 THEN high ELSE 200 END)) + 200) AS min_height FROM e GROUP BY label)
        SELECT label, vec_id, printf('left:%.0fpx;top:%.0fpx', x, y) || CASE WHEN vec_id % 8 = 0 THEN printf(';width:%.0fpx', wide * 48 + 20) ELSE '' END AS style, min_height FROM e JOIN h USING (label)""",
    "drawings": """
        WITH e AS (SELECT label, vec_id, vec_id % 3 > 0 AS ink, embedding[1] AS x, embedding[2] AS y FROM embeddings),
        s AS (SELECT *, (NOT (ink AND coalesce(lag(ink) OVER (PARTITION BY label ORDER BY vec_id), false)))::INT AS s FROM e)
        SELECT label, vec_id, (sum(s) OVER (PARTITION BY label ORDER BY vec_id))::BIGINT AS "group", CASE WHEN ink THEN round((x * 1270::FLOAT)::DOUBLE, 3) END AS dx, CASE WHEN ink THEN round((y * 1270::FLOAT)::DOUBLE, 3) END AS dy FROM s""",
    "contents_note": f"""
        WITH {TITLED}, t AS (SELECT host, page_id, coalesce(nullif(title, ''), 'Untitled Page') AS t, repeat('  ', (page_id % 3)::INT) || '- ' AS dash, replace(regexp_replace(t, '[\\[\\]\\n]', '', 'g'), '|', '-') AS label FROM titled)
        SELECT host, md5(string_agg(dash || '[[' || t || CASE WHEN label <> t THEN '|' || label ELSE '' END || ']]', chr(10) ORDER BY page_id)) AS notes, md5(string_agg(dash || t, chr(10) ORDER BY page_id)) AS titles FROM t GROUP BY host""",
    "contents_name": """
        WITH taken AS (SELECT lower(c_name) AS n FROM customer UNION SELECT 'customer#000000001 (contents)' || CASE WHEN r_regionkey > 0 THEN ' ' || (r_regionkey + 1) ELSE '' END FROM region),
        tries AS (SELECT i, 'Customer#000000001' || CASE WHEN i = 0 THEN '' WHEN i = 1 THEN ' (contents)' ELSE ' (contents) ' || i END AS stem FROM range(0, 100) AS r(i))
        SELECT arg_min(stem, i) AS stem FROM tries WHERE lower(stem) NOT IN (SELECT n FROM taken)""",
    "archive_listing": f"""
        WITH {TITLED}, p AS (SELECT host AS archive, {_HOST_PATH} AS path FROM titled), r AS (SELECT archive, path, substr(path, 5) AS rest FROM p)
        SELECT archive, split_part(rest, '/', 1) AS name, arg_min(contains(rest, '/'), path) AS is_folder FROM r GROUP BY archive, split_part(rest, '/', 1)""",
    "package_roots": f"""
        WITH {TITLED} SELECT host AS archive, CASE WHEN bool_or(page_id % 4 = 0) AND NOT bool_or(page_id % 4 > 0 AND page_id % 7 = 0) THEN 'top/inner' ELSE 'top' END AS root FROM titled GROUP BY host""",
    "payload_files": """
        WITH f AS (SELECT DISTINCT p_partkey % 3 AS dir, 'f' || p_partkey % 500 || CASE WHEN p_partkey % 4 = 0 THEN '.onebin' ELSE '' END AS name FROM part WHERE p_partkey % 2 = 0),
        r AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS dir, 'f' || l_partkey % 500 AS name FROM lineitem)
        SELECT l_orderkey, l_linenumber, r.name, coalesce(a.name, b.name) AS found FROM r LEFT JOIN f a ON a.dir = r.dir AND a.name = r.name LEFT JOIN f b ON b.dir = r.dir AND b.name = r.name || '.onebin'""",
    "cell_manifests": """
        WITH maps AS (SELECT o_orderkey + 7 AS id, o_orderkey * 10 AS manifest, o_orderkey % 1000 AS serial FROM orders WHERE o_orderkey % 5 = 0),
        leads AS (SELECT id, manifest FROM maps UNION ALL SELECT o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey NOT IN (SELECT id FROM maps)),
        serials AS (SELECT serial, arg_min(manifest, id) AS manifest FROM maps GROUP BY serial)
        SELECT o_orderkey AS cell, o_orderkey % 1000 AS serial, coalesce(a.manifest, b.manifest, s.manifest) AS manifest
        FROM orders LEFT JOIN leads a ON o_orderkey % 3 = 0 AND a.id = o_orderkey + 7 LEFT JOIN leads b ON b.id = o_orderkey LEFT JOIN serials s ON s.serial = o_orderkey % 1000""",
    "file_payloads": """
        WITH r AS (SELECT p_partkey, p_partkey % 4 AS kind, p_partkey % 900 AS k, ['<ifndf>', '<file>', '<invfdo>', 'what '][p_partkey % 4 + 1] || p_partkey % 900 AS reference FROM part)
        SELECT p_partkey, reference, s_name AS payload, CASE WHEN s_name IS NULL THEN ['not embedded', 'no file', 'invalid', 'unknown'][kind + 1] END AS fault
        FROM r LEFT JOIN supplier ON s_suppkey = k AND (kind = 0 AND s_suppkey % 2 = 0 OR kind = 1)""",
    "space_roots": "SELECT user_id AS space, arg_max(floor(value)::BIGINT + event_id, event_id) AS root FROM events WHERE event_id % 3 = 1 GROUP BY user_id",
    "referenced_spaces": """
        WITH s AS (SELECT c_custkey % 400 AS a, CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS b, min(c_custkey * 2) AS space FROM customer WHERE c_custkey * 2 % 5 > 0 GROUP BY ALL),
        f AS (SELECT a, arg_min(space, coalesce(b, -1)) AS least, max(space) FILTER (b IS NULL) AS open FROM s GROUP BY a),
        r AS (SELECT o_orderkey, o_orderkey % 500 AS a, CASE WHEN o_orderkey % 2 > 0 THEN o_orderkey % 1500 END AS b FROM orders)
        SELECT o_orderkey, coalesce(s.space, f.open, CASE WHEN r.b IS NULL THEN f.least END) AS space FROM r LEFT JOIN s ON s.a = r.a AND s.b IS NOT DISTINCT FROM r.b LEFT JOIN f ON f.a = r.a""",
    "resolved_ids": """
        WITH t AS (SELECT l_orderkey AS revision, l_linenumber AS index, max(l_partkey) AS guid FROM lineitem GROUP BY ALL)
        SELECT o_orderkey AS revision, o_custkey % 6 AS index, coalesce(guid, 0) AS guid FROM orders LEFT JOIN t ON revision = o_orderkey AND index = o_custkey % 6""",
    "fixed_decimals": f"SELECT l_orderkey, l_linenumber, l_partkey, {fixed('((l_partkey % 20000 - 10000) / 1000.0::DOUBLE)')} AS shown, {fixed('(l_extendedprice / 8.0::DOUBLE)')} AS eighth FROM lineitem",
    "run_styles": f"""
        WITH p AS (
            SELECT p_partkey AS style, concat_ws(',', {', '.join(f"CASE WHEN p_partkey % {i + 3} > 0 AND p_partkey % {i + 2} = 0 THEN '{f}' END" for i, f in enumerate(_STYLE_FLAGS))}) AS flags,
                   CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS font, CASE WHEN p_partkey % 5 > 0 THEN p_size END AS size, p_partkey % 4 AS c FROM part WHERE p_partkey % 9 > 0)
        SELECT l_orderkey, l_linenumber, coalesce(o.flags, '') AS flags, coalesce(b.flags, '') AS base_flags, coalesce(o.font, '') AS font, coalesce(b.size, 0) AS base_size,
               CASE o.c WHEN 0 THEN '#ffffff' WHEN 3 THEN '#12ab34' END AS color, CASE o.c WHEN 1 THEN '#000000' WHEN 3 THEN '#12ab34' END AS highlight
        FROM lineitem LEFT JOIN p o ON o.style = l_partkey LEFT JOIN p b ON b.style = l_suppkey * 18""",
    "list_formats": """
        WITH p AS (SELECT p_partkey, p_partkey % 7 AS u, p_partkey % 5 AS f FROM part)
        SELECT p_partkey, u = 0 AS ordered, CASE WHEN u = 0 AND p_partkey % 8 <= 4 THEN p_partkey % 8 ELSE 0 END AS number_style,
               CASE WHEN u = 0 THEN '' WHEN f = 0 THEN CASE u WHEN 4 THEN chr(11045) ELSE chr(9642) END WHEN f = 1 AND u = 5 THEN chr(8226) WHEN f IN (1, 2) THEN chr(9670)
                    ELSE [chr(167), chr(8226), chr(8226), 'w', chr(183), chr(65533)][u] END AS bullet FROM p""",
    "paragraph_kinds": """
        WITH c AS (
            SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'math' WHEN (turn + conv_id) % 5 = 0 THEN 'break' ELSE 'text' END AS kind,
                   (conv_id % 4 > 0 AND turn > 0) OR conv_id % 8 > 0 OR trim(left(text, 9), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS blank FROM conversations)
        SELECT conv_id, NOT bool_or(kind = 'math' OR kind = 'text' AND NOT blank) AND conv_id % 5 <> 1 AS empty, bool_and(kind = 'math' OR kind = 'text' AND blank) AS display FROM c GROUP BY conv_id""",
    "code_elements": "SELECT conv_id, turn, conv_id % 3 > 0 AND turn % 5 <> 4 AND turn % 4 <> 3 AND length(text) % 2 = 0 AS code FROM conversations",
    "ink_offsets": """
        WITH RECURSIVE n AS (
            SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey WHEN o_orderkey % 13 > 0 THEN o_orderkey // 3 END AS parent,
                   coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 / 2 * 1270 END, 0)::DOUBLE AS x, (o_orderkey % 9 / 4 * 1270)::DOUBLE AS y FROM orders),
        walk AS (
            SELECT id, id AS root, 0::BIGINT AS depth, 0::DOUBLE AS dx, 0::DOUBLE AS dy FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
            UNION ALL SELECT n.id, w.root, w.depth + 1, w.dx + n.x, w.dy + n.y FROM n JOIN walk w ON n.parent = w.id WHERE w.depth < 16)
        SELECT id, root, depth, dx, dy FROM walk""",
    "structure": f"""
        WITH {TITLED}
        SELECT host, 0::BIGINT AS place, '# ' || upper(host) || CASE WHEN length(host) % 3 = 0 THEN '  [error: unreadable]' ELSE '' END || CASE WHEN length(host) % 2 = 0 THEN '  [password protected]' ELSE '' END || '  (' || count(*) || ' pages)' AS line FROM titled GROUP BY host
        UNION ALL SELECT host, page_id + 1, repeat('  ', 1 + (page_id % 3)::INT) || '- ' || CASE WHEN page_id % 10 = 0 OR title = '' THEN 'Untitled Page' ELSE title END FROM titled""",
}
