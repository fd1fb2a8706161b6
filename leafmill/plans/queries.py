"""One query for each conversion operator, over whole tables.

The tables stand in for a notebook: hosts of ``pages`` and sources of ``documents`` are sections, their rows pages; turns of
``conversations`` are elements of a page; ``embeddings`` are strokes (x and y in turn, as deltas); ``events`` and ``orders`` are
revisions; region, nation and customer are folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import numbers, text
from leafmill.operators import assets, export, graph, ink, links, render, sequence, store
from leafmill.sources import cabinet


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def titled(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    return pages.select("page_id", "url", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))


def page_title_sanitized(spark, d):
    return titled(spark, d).select("page_id", "title", text.file_name(F.col("title"), 40).alias("name"), text.vault_name(text.file_name(F.col("title"))).alias("vault"), text.generic_image_name(F.col("title")).alias("generic"))


def unique_page_names(spark, d):
    pages = titled(spark, d).withColumn("name", text.file_name(text.fallback(F.col("title"), "Untitled Page"), 80)).select("host", "page_id", "name")
    return sequence.unique_names(pages, "host", "page_id", "name", ("assets",))


def page_nav(spark, d):
    return sequence.navigation(titled(spark, d).select("host", "page_id", "title"), "host", "page_id", "page_id", "title")


def toc_index(spark, d):
    line = F.concat(F.lit("- ["), text.md_escape(text.fallback(F.col("title"), "Untitled Page")), F.lit("]("), text.md_url(F.col("url")), F.lit(")"))
    return sequence.joined_lines(titled(spark, d), ["host"], "page_id", line)


def levels(spark, d):
    return read(spark, d, "events").select("user_id", "event_id", ((F.col("event_id") * 31 + F.floor("value")) % 4).cast("int").alias("level"))


def parent_page(spark, d):
    return sequence.parent_page(levels(spark, d), "user_id", "event_id", "level")


def nested_lists(spark, d):
    return sequence.nested_list_tags(levels(spark, d), "user_id", "event_id", "level")


def list_numbering(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", (F.char_length("text") % 3 > 0).alias("ordered"), F.when(F.char_length("text") % 5 == 0, 3).alias("restart"))
    return sequence.list_numbers(c, "conv_id", "turn", F.col("ordered"), F.col("restart")).select("conv_id", "turn", "number")


def merge_runs(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", (F.char_length("text") % 2).alias("style"), "text")
    return sequence.merged_runs(c, "conv_id", "turn", ["style"], "text").withColumn("text", F.md5("text"))


def escapes(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.md5(text.md_escape(t)).alias("md"), F.md5(text.vault_escape(t)).alias("vault"), F.md5(text.html_escape(t, True)).alias("html"), F.md5(text.xml_escape(t)).alias("xml"), F.md5(text.yaml_string(t)).alias("yaml"), F.md5(text.escape_line_start(t)).alias("line"))


def html_escapes(spark, d):
    h = F.col("html")
    return read(spark, d, "pages").select("page_id", F.md5(text.html_escape(h)).alias("html"), F.md5(text.xml_escape(h)).alias("xml"), F.md5(text.md_escape(h)).alias("md"))


def url_codec(spark, d):
    u = F.col("url")
    coded = text.url_encode_path(u)
    return read(spark, d, "pages").select("page_id", coded.alias("coded"), text.url_decode(coded).alias("decoded"), text.md_url(u).alias("shown"), text.allowed_url(u).alias("allowed"), text.link_parameter(u, "ref").alias("ref"))


def wiki_links(spark, d):
    p = titled(spark, d).withColumn("stem", text.vault_name(text.file_name(F.col("title"), 80))).withColumn("path", F.concat_ws("/", "host", "stem"))
    return links.wiki_targets(p, "stem", "path").select("page_id", "same_name", "wiki", text.wikilink(F.col("wiki"), F.col("title")).alias("link"), text.wikilink(F.col("wiki"), F.col("title"), True, True).alias("embed"))


def digests(spark, d):
    b = F.encode("text", "UTF-8")
    return read(spark, d, "documents").select("doc_id", F.md5(b).alias("md5"), F.md5(text.base64_lines(b)).alias("lines"))


def time_formats(spark, d):
    seconds = F.unix_timestamp("ts")
    e = read(spark, d, "events").select("event_id", (seconds.cast("decimal(20,0)") * 10_000_000 + numbers.FILETIME_EPOCH).cast("decimal(20,0)").alias("ft"), (seconds - numbers.TIME32_EPOCH).alias("t32"))
    return e.select("event_id", numbers.filetime_iso(F.col("ft")).alias("iso"), numbers.time32_iso(F.col("t32")).alias("iso32"), numbers.compact_time(numbers.filetime_iso(F.col("ft"))).alias("compact"))


def colors(spark, d):
    c = F.col("p_partkey") * 7919 % 16_777_216 + F.when(F.col("p_size") > 45, 4_278_190_080).otherwise(0)
    return read(spark, d, "part").select("p_partkey", numbers.color_hex(c).alias("color"), numbers.half_inch_px(F.col("p_size") / 3.0).alias("px"))


def strokes(spark, d):
    """(vec_id, i, x, y): each vector as deltas of x and y in turn."""
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("n", "v"))
    pairs = e.groupBy("vec_id", F.floor(F.col("n") / 2).alias("i")).agg(F.max(F.when(F.col("n") % 2 == 0, F.col("v"))).alias("x"), F.max(F.when(F.col("n") % 2 == 1, F.col("v"))).alias("y"))
    return sequence.running_sums(pairs, "vec_id", "i", "x", "y")


def ink_bounds(spark, d):
    b = ink.bounds(strokes(spark, d), "vec_id", F.lit(0.5))
    return b.select("vec_id", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "width_px", "height_px")))


def ink_paths(spark, d):
    p = strokes(spark, d).withColumns({"x": F.col("x") * 100, "y": F.col("y") * 100})
    return ink.svg_paths(p, ink.bounds(p, "vec_id", F.lit(53.0)), "vec_id", "i")


def ink_pictures(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((F.get("embedding", 2 * i) * 1000).alias("x"), (F.get("embedding", 2 * i + 1) * 1000).alias("y"))).alias("points"))
    return ink.pictures(e, "vec_id", "points", 53.0).select("vec_id", numbers.image_type(F.col("png")).alias("kind"), F.octet_length("png").alias("bytes"), F.md5("png").alias("md5"))


def reading_order(spark, d):
    e = read(spark, d, "embeddings").select("label", "vec_id", F.get("embedding", 0).alias("x"), F.get("embedding", 1).alias("y"))
    return sequence.reading_order(e, "label", "vec_id").select("label", "vec_id", "place")


def newest_wins(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return graph.latest(e, ["user_id", "event_type"], "event_id")


def revision_chain(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return graph.chain_depth(o, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "depth", "previous")


def nearest_declaration(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    c = graph.chain_depth(o, "o_custkey", "o_orderdate", "o_orderkey")
    declared = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("declared"))
    return graph.nearest_declared(c.join(declared, "o_orderkey"), "o_orderkey", "previous", "declared")


def tree_paths(spark, d):
    r = read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("name"))
    n = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("name"))
    c = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"))
    return graph.tree_paths(spark, r.unionAll(n).unionAll(c)).select("id", "depth", "path", "shown")


def toc_order(spark, d):
    s = read(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    listed = read(spark, d, "supplier").filter("s_acctbal > 3000").select("s_nationkey", F.upper("s_name").alias("s_name"), (-F.col("s_suppkey")).alias("pos"), F.lit("#000000").alias("color"))
    return links.toc_ordered(s, listed, "s_nationkey", "s_name", "pos").select("s_nationkey", "s_suppkey", "place", "listed", "color")


def resource_dedup(spark, d):
    docs = read(spark, d, "documents").select("source", "doc_id", "text")
    return assets.resources(docs, "source", "doc_id", F.encode("text", "UTF-8")).select("source", "doc_id", "md5", "uses")


def mime_lookup(spark, d):
    ext = F.element_at(F.array(*(F.lit(e) for e in ("PNG", "html", "tar.gz", "jpeg", "", "Pdf"))), (F.col("page_id") % 6 + 1).cast("int"))
    files = read(spark, d, "pages").select("page_id", F.concat(F.lit("file"), F.col("page_id").cast("string"), F.lit("."), ext).alias("name"))
    return assets.with_mime(files, "name")


def tags_first_seen(spark, d):
    label = F.concat(F.col("event_type"), F.lit(" & "), F.floor("value").cast("string"))
    e = read(spark, d, "events").withColumn("label", label)
    return links.first_seen(e, "user_id", "event_id", text.tag_slug(F.col("label")), F.col("label"))


def reference_faults(spark, d):
    return assets.reference_faults(read(spark, d, "labels").select("doc_id"), read(spark, d, "documents").select("doc_id"), "doc_id")


def link_resolution(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("href"))
    labels = read(spark, d, "labels")
    pages = labels.select(F.col("doc_id").alias("key"), F.concat(F.lit("page/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("target"))
    first = docs.join(labels.filter("toxic = 1"), "doc_id").groupBy("source").agg(F.min("doc_id").alias("first"))
    sections = first.select(F.col("source").alias("key"), F.concat(F.lit("section/"), F.col("first").cast("string"), F.lit(".md")).alias("target"))
    return links.resolve(docs, pages, sections, "doc_id", "source", "href").select("doc_id", "target")


def note_sizes(spark, d):
    return assets.oversized(read(spark, d, "documents"), "source", F.octet_length("text"), 60_000)


def export_stats(spark, d):
    docs = read(spark, d, "documents")
    return docs.agg(F.count_distinct("source").alias("sections"), F.count(F.lit(1)).alias("pages"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.coalesce(F.col("text"), F.lit("")) == "").alias("failed"), F.count_if(F.col("lang") == "de").alias("german"))


def front_matter(spark, d):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    head = render.front_matter({"title": text.fallback(text.cut_bytes(first, 80), "Untitled Page"), "lang": F.col("lang"), "section": F.col("source")})
    return read(spark, d, "documents").select("doc_id", head.alias("head"))


def table_render(spark, d):
    n = read(spark, d, "nation")
    cells = n.select("n_regionkey", "n_nationkey", F.posexplode(F.array(F.col("n_nationkey").cast("string"), "n_name", F.concat(F.lit("a|b "), "n_name"))).alias("col", "cell")).filter("col < 2 OR n_nationkey % 2 = 0")
    return render.md_table(cells, "n_regionkey", "n_nationkey", "col", F.col("cell"))


def elements(spark, d):
    """Turns as elements: the first is the heading, then by the length of the text."""
    kind = F.element_at(F.array(*(F.lit(k) for k in ("para", "bullet", "ordered", "task", "done", "quote", "ordered"))), (F.char_length("text") % 7 + 1).cast("int"))
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("page"), F.col("turn").alias("pos"), F.when(F.col("turn") == 0, F.lit("heading")).otherwise(kind).alias("kind"), F.lit(0).alias("depth"), "text")


def page_markdown(spark, d):
    plain, vault = render.markdown_pages(elements(spark, d)), render.markdown_pages(elements(spark, d), vault=True).select("page", F.col("text").alias("vault"))
    return plain.join(vault, "page").select("page", F.md5("text").alias("md5"), F.char_length("text").alias("chars"), F.md5("vault").alias("vault_md5"))


def page_html(spark, d):
    return render.html_pages(elements(spark, d)).select("page", F.md5("text").alias("md5"), F.char_length("text").alias("chars"))


def page_notes(spark, d):
    c = read(spark, d, "conversations").withColumn("line", F.concat(F.lit("<div>"), text.xml_escape(F.col("text")), F.lit("</div>")))
    bodies = sequence.joined_lines(c, ["conv_id"], "turn", F.col("line"), between="", name="body")
    titles = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))
    n = render.notes(bodies.join(titles, "conv_id"), F.col("title"), F.col("body"), F.lit("20240101T000000Z"), F.array(F.lit("a & b"), F.lit("chat")))
    return n.select("conv_id", F.md5("note").alias("md5"), F.char_length("note").alias("chars"))


def cabinet_roundtrip(spark, d):
    """All documents packed into compressed cabinets, and read from those again."""
    docs = read(spark, d, "documents").select(F.floor(F.col("doc_id") / 64).alias("archive"), F.concat(F.lit("texts\\d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    files = cabinet.extract(cabinet.pack(docs, "archive"))
    return files.select("path", F.octet_length("content").alias("bytes"), F.md5("content").alias("md5"), "error")


def typed_properties(spark, d):
    props = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_quantity").cast("long")).alias("pos"), (F.col("l_partkey") % 3 + F.shiftleft(F.lit(5).cast("long"), 26)).alias("prop_id"), "l_quantity")
    return store.typed_properties(props, ["l_orderkey"], {"a": (0, "double"), "b": (1, "long"), "c": (2, "double")}, value="l_quantity")


def references(spark, d):
    held = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("own"))
    parents = held.select("s_nationkey", F.concat(F.array(F.lit(None).cast("long"), F.lit(-1).cast("long")), "own").alias("refs"))
    return store.dereferenced(parents, "refs", read(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")


def id_tables(spark, d):
    o = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("revision"), F.col("l_linenumber").cast("long").alias("index"), F.col("l_partkey").alias("guid")).groupBy("revision", "index").agg(F.max("guid").alias("guid"))
    copies = read(spark, d, "orders").select(F.col("o_orderkey").alias("revision"), F.lit(3).cast("long").alias("index"), F.lit(1).cast("long").alias("source"), (F.col("o_custkey") % 4).alias("count"))
    return store.id_table(o.filter("guid % 2 = 0"), copies, o)


def object_parts(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return store.parts(rows.select("l_orderkey", "l_linenumber"), rows, ["l_orderkey"], "l_linenumber", "l_linenumber", {1: "content", 2: "metadata", 4: "file"}, "l_quantity")


def page_plan(spark, d):
    docs = read(spark, d, "documents")
    pages = docs.select(F.col("doc_id").alias("page"), "source", F.col("doc_id").alias("seq"), (F.col("n_chars") % 3).cast("int").alias("level"), F.substring_index("text", "\n", 1).alias("title")).withColumnRenamed("source", "section")
    return export.planned(pages).select("page", "path", "wiki", "parent")


QUERIES = {
    f.__name__: f
    for f in (
        page_title_sanitized, unique_page_names, page_nav, toc_index, parent_page, nested_lists, list_numbering, merge_runs, escapes, html_escapes, url_codec, wiki_links, digests, time_formats, colors,
        ink_bounds, ink_paths, ink_pictures, reading_order, newest_wins, revision_chain, nearest_declaration, tree_paths, toc_order, resource_dedup, mime_lookup, tags_first_seen, reference_faults,
        link_resolution, note_sizes, export_stats, front_matter, table_render, page_markdown, page_html, page_notes, cabinet_roundtrip, typed_properties, references, id_tables, object_parts, page_plan,
    )
}
