"""Queries of loading, pieces and assets of an export, with their SQL; the tables stand in for a notebook's."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import export, notes, pieces, render
from leafmill.plans.queries import read, titled
from leafmill.plans.sql import TITLED, md, md_url, xml
from leafmill.sources import folders


def folder_load(spark, d):
    """Customers as section files in groups, below the recycle bin, in hidden folders, and as other files; suppliers as tables of contents."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    group = F.concat(F.lit("Group "), (k % 7).cast("string"))
    folder = F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(group, F.lit("/"))).when(k % 6 == 2, F.concat(group, F.lit("/sub"), (k % 4).cast("string"), F.lit("/"))).when(k % 6 == 3, "OneNote_RecycleBin/").when(k % 6 == 4, ".hidden/").otherwise(F.concat(F.lit("Empty/deep"), (k % 3).cast("string"), F.lit("/")))
    path = F.concat(F.lit("/nb/"), folder, F.lit("S"), k.cast("string"), F.when(k % 6 == 5, ".txt").when(k % 2 == 0, ".ONE").otherwise(".one"))
    files = read(spark, d, "customer").select(path.alias("path"), F.when(k % 5 == 0, "own").alias("color"))
    t = read(spark, d, "supplier")
    toc = t.select(F.when(s % 2 == 0, "").otherwise(F.concat(F.lit("group "), (s % 7).cast("string"))).alias("dir"), F.when(s % 10 == 0, F.concat(F.lit("GROUP "), (s % 8).cast("string"))).otherwise(F.concat(F.lit("s"), (s * 6 + s % 2).cast("string"), F.lit(".one"))).alias("name"), (s * 37 % 101).alias("pos"), F.concat(F.lit("#"), s.cast("string")).alias("color"))
    toc = toc.withColumn("dir", F.initcap("dir"))
    return folders.loaded(folders.entries(files, "/nb"), toc, "color").drop("path")


def toc_pieces(spark, d):
    """The contents of hosts in pieces of about 300 bytes."""
    line = F.concat(F.lit("- ["), text.md_escape(text.fallback(F.col("title"), "Untitled Page")), F.lit("]("), text.md_url(F.col("url")), F.lit(")"))
    return pieces.pieces(titled(spark, d), ["host"], "page_id", line, most=300)


def section_notes(spark, d):
    """Turns as notes of one exchange file a day of the week, in pieces of about 4,000 bytes."""
    c = read(spark, d, "conversations").select((F.col("conv_id") % 7).alias("section"), (F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"), "text")
    body = F.concat(F.lit("<div>"), text.xml_escape(F.col("text")), F.lit("</div>"))
    n = render.notes(c, F.left("text", F.lit(40)), body, F.lit(""), F.array(F.lit("chat")))
    out = pieces.pieces(n, ["section"], "note_id", F.col("note"), "\n", "<en-export>\n", "\n</en-export>\n", 4000)
    return out.select("section", "piece", "lines", "bytes", F.md5("text").alias("md5"))


def asset_files(spark, d):
    """Parts as uses of pictures: a brand's parts of one size and remainder are one content."""
    k = F.col("p_partkey")
    p = read(spark, d, "part").select("p_brand", k.alias("use"), F.concat(F.lit("Pic"), (k % 5).cast("string"), F.when(k % 3 == 0, ".PNG").otherwise(".png")).alias("name"), (F.col("p_size") % 9).alias("hash"), F.when(k % 4 > 0, k % 2).alias("bytes"))
    return export.asset_plan(p, "p_brand", "use", "name", ["hash", "bytes"])


def note_check(spark, d):
    """Turns as notes with a resource and a box each, some of them with faults; what the check counts, by day of the week."""
    c = read(spark, d, "conversations").select("text", (F.col("conv_id") * 8 + F.col("turn")).alias("k"))
    k, data, mime = F.col("k"), F.encode("text", "UTF-8"), F.lit("text/plain")
    body = F.concat(
        F.lit("<div>"), F.when(k % 3 == 0, '<en-todo checked="true"/>').when(k % 21 == 1, '<en-todo checked="yes"/>').otherwise(""), text.xml_escape(F.col("text")), F.when(k % 11 == 0, "").otherwise("</div>"),
        F.when(k % 5 == 0, F.lit('<a href="x.html">x</a>')).otherwise('<a href="https://e.com">e</a>'), notes.media(F.when(k % 7 == 0, F.encode(F.lit("gone"), "UTF-8")).otherwise(data), F.when(k % 13 == 0, F.lit("a/b")).otherwise(mime)), F.when(k % 17 == 0, '<p class="c"/><blink/>').otherwise(""),
    )
    n = render.notes(c, F.concat(F.lit("Note "), k.cast("string")), body, F.when(k % 19 == 0, "today").otherwise("20240101T000000Z"), F.when(k % 23 == 0, F.array(F.lit("Chat"), F.lit("chat"))).otherwise(F.array(F.lit("chat"))))
    n = n.withColumn("note", notes.with_resources(F.col("note"), F.array(notes.resource(data, mime, F.lit("a.txt")))))
    found = notes.checked(n, "note").withColumn("fault", F.explode_outer("faults"))
    counts = found.groupBy((k % 7).alias("day"), "fault").agg(F.count(F.lit(1)).alias("notes"), F.sum("resources").alias("resources"), F.sum("media").alias("media"), F.sum("todos").alias("todos"))
    return counts.withColumn("fault", F.coalesce("fault", F.lit("none")))


QUERIES = {f.__name__: f for f in (folder_load, toc_pieces, section_notes, asset_files, note_check)}


def _pieces(group: str, order: str, line: str, head: str, tail: str, most: int) -> str:
    return f"""
        l AS (SELECT {group}, {line} AS line, {order} AS spot FROM lines),
        t AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY {group} ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, count(*) OVER w AS n, row_number() OVER (PARTITION BY {group} ORDER BY spot) AS k FROM l WINDOW w AS (PARTITION BY {group})),
        p AS (SELECT {group}, start // {most} AS piece, count(*) AS lines, string_agg(CASE WHEN k = 1 THEN {head} ELSE chr(10) END || line || CASE WHEN k = n THEN {tail} ELSE '' END, '' ORDER BY spot) AS text FROM t GROUP BY ALL)"""


SQL = {
    "note_check": """
        WITH c AS (SELECT conv_id * 8 + turn AS k, k % 11 = 0 AS broken, text FROM conversations),
        f AS (
            SELECT *, list_filter([
                CASE WHEN k % 19 = 0 THEN 'time' END, CASE WHEN k % 23 = 0 THEN 'tags' END, CASE WHEN broken THEN 'malformed' END, CASE WHEN NOT broken AND k % 17 = 0 THEN 'element' END, CASE WHEN NOT broken AND k % 17 = 0 THEN 'attribute' END,
                CASE WHEN NOT broken AND k % 5 = 0 THEN 'address' END, CASE WHEN NOT broken AND k % 21 = 1 THEN 'todo' END, CASE WHEN NOT broken AND k % 7 = 0 THEN 'media' END, CASE WHEN NOT broken AND k % 7 = 0 THEN 'unused' END,
                CASE WHEN NOT broken AND k % 13 = 0 AND k % 7 > 0 THEN 'type' END], lambda x: x IS NOT NULL) AS faults FROM c),
        e AS (SELECT k, broken, unnest(CASE WHEN len(faults) = 0 THEN ['none'] ELSE faults END) AS fault FROM f)
        SELECT k % 7 AS day, fault, count(*) AS notes, count(*) AS resources, count(*) FILTER (NOT broken) AS media, count(*) FILTER (NOT broken AND (k % 3 = 0 OR k % 21 = 1)) AS todos FROM e GROUP BY ALL""",
    "folder_load": """
        WITH RECURSIVE f AS (
            SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Group ' || c_custkey % 7 WHEN 2 THEN 'Group ' || c_custkey % 7 || '/sub' || c_custkey % 4 WHEN 3 THEN NULL ELSE NULL END AS dir FROM customer),
        s AS (SELECT 'section' AS kind, dir, 'S' || k || CASE WHEN k % 2 = 0 THEN '.ONE' ELSE '.one' END AS name, CASE WHEN k % 5 = 0 THEN 'own' END AS color FROM f WHERE dir IS NOT NULL),
        g AS (SELECT DISTINCT 'group' AS kind, CASE WHEN contains(dir, '/') AND n = 2 THEN split_part(dir, '/', 1) ELSE '' END AS dir, split_part(dir, '/', n) AS name, NULL AS color FROM s, (SELECT unnest([1, 2]) AS n) WHERE dir <> '' AND split_part(dir, '/', n) <> ''),
        toc AS (
            SELECT CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'Group ' || s_suppkey % 7 END AS dir, lower(CASE WHEN s_suppkey % 10 = 0 THEN 'GROUP ' || s_suppkey % 8 ELSE 's' || (s_suppkey * 6 + s_suppkey % 2) || '.one' END) AS low, s_suppkey * 37 % 101 AS pos, '#' || s_suppkey AS color FROM supplier),
        listed AS (SELECT dir, low, min(pos) AS pos, max_by(color, pos) AS color FROM toc GROUP BY ALL),
        items AS (
            SELECT i.kind, i.dir, i.name, CASE WHEN i.kind = 'section' THEN coalesce(i.color, l.color) END AS color, row_number() OVER (PARTITION BY i.dir ORDER BY l.pos NULLS LAST, lower(i.name), i.name) AS "order"
            FROM (SELECT * FROM s UNION ALL SELECT * FROM g) i LEFT JOIN listed l ON l.dir = i.dir AND l.low = lower(i.name)),
        tree AS (
            SELECT *, 0::BIGINT AS depth, ["order"] AS path FROM items WHERE dir = ''
            UNION ALL SELECT i.*, t.depth + 1, list_append(t.path, i."order") FROM tree t JOIN items i ON i.dir = CASE WHEN t.dir = '' THEN '' ELSE t.dir || '/' END || t.name WHERE t.kind = 'group')
        SELECT kind, dir, name, name AS title, depth, "order", row_number() OVER (ORDER BY path) AS place, color FROM tree""",
    "toc_pieces": f"""
        WITH {TITLED}, lines AS (SELECT * FROM titled),
        {_pieces("host", "page_id", f"'- [' || {md("coalesce(nullif(title, ''), 'Untitled Page')")} || '](' || {md_url('url')} || ')'", "''", "''", 300)}
        SELECT host, piece, lines, strlen(text) AS bytes, text FROM p""",
    "section_notes": f"""
        WITH n AS (SELECT conv_id % 7 AS section, conv_id * 1000 + turn AS note_id, {xml("text")} AS body, {xml("coalesce(nullif(trim(regexp_replace(left(text, 40), '[' || chr(13) || chr(10) || ']', ' ', 'g'), ' ' || chr(9)), ''), 'Untitled Page')")} AS title FROM conversations),
        lines AS (
            SELECT *, '<note><title>' || title || '</title><content><![CDATA[<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE en-note SYSTEM "http://xml.evernote.com/pub/enml2.dtd"><en-note><div>' || body || '</div></en-note>]]></content><tag>chat</tag></note>' AS note FROM n),
        {_pieces("section", "note_id", "note", "'<en-export>' || chr(10)", "chr(10) || '</en-export>' || chr(10)", 4000)}
        SELECT section, piece, lines, strlen(text) AS bytes, md5(text) AS md5 FROM p""",
    "asset_files": """
        WITH u AS (SELECT p_brand, p_partkey AS use, 'Pic' || p_partkey % 5 || CASE WHEN p_partkey % 3 = 0 THEN '.PNG' ELSE '.png' END AS name, p_size % 9 AS hash, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 2 END AS bytes FROM part),
        f AS (SELECT *, min(use) OVER (PARTITION BY p_brand, hash, bytes) AS first FROM u),
        n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(name) ORDER BY use) AS k FROM f WHERE use = first)
        SELECT f.p_brand, f.use, f.name, f.hash, f.bytes, CASE WHEN k = 1 THEN n.name ELSE left(n.name, 4) || '-' || k || right(n.name, 4) END AS file, f.use = f.first AS writes
        FROM f JOIN n ON n.p_brand = f.p_brand AND n.first = f.first""",
}
