"""Queries of inlines, projections, archives and revision stores; the tables stand in for a notebook's, as in queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import graph, ink, inlines, manifests, projections, sequence, styles
from leafmill.plans.queries import read, titled
from leafmill.sources import listing


def _when(mask, value):
    return F.when(mask, F.lit(value)).otherwise(F.lit(""))


def runs(spark, d):
    """Turns as inlines: some with an address, a break, a link; style by the length of the text."""
    n = F.char_length("text")
    said = F.concat(F.left("text", F.lit(60)), _when(F.col("turn") % 3 == 0, "\x0bsee http://x.org/a_b(1), ok "), _when(F.col("turn") % 5 == 1, "\t "))
    flags = {s: n % m == 0 for s, m in zip(inlines.STYLE, (2, 3, 11, 5, 13, 17, 7), strict=True)}
    href = F.when(F.col("turn") % 4 > 1, F.concat(F.lit("doc:"), F.col("conv_id").cast("string"))).otherwise(F.lit(""))
    c = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 6 == 5, F.lit("math")).otherwise(F.lit("text")).alias("kind"), said.alias("text"), href.alias("href"), *(v.alias(k) for k, v in flags.items()))
    c = c.withColumn("target", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("pages/a b "), F.col("conv_id").cast("string")))).withColumn("wiki", F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("Note "), F.col("conv_id").cast("string"))))
    return inlines.cleaned(c, "conv_id", "turn").withColumn("at", F.col("turn") * 1000 + F.col("part"))


def inline_lines(spark, d):
    r = runs(spark, d)
    plain, vault, cell = (inlines.lines(r, "conv_id", "at", *how).withColumnRenamed("text", name) for name, how in (("plain", ()), ("vault", (True,)), ("cell", (True, True))))
    return plain.join(vault, "conv_id").join(cell, "conv_id").select("conv_id", *(F.md5(c).alias(c) for c in ("plain", "vault", "cell")), F.char_length("plain").alias("chars"))


def plain_paragraphs(spark, d):
    return inlines.plain_text(runs(spark, d), "conv_id", "at").select("conv_id", F.md5("text").alias("text"), "empty")


def section_index(spark, d):
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select("c_custkey", F.when(k % 5 > 0, F.concat("c_name", _when(k % 3 == 0, ".ONE"))).alias("name"), F.concat(F.lit("file"), k.cast("string"), F.lit(".one")).alias("stem"), F.when(F.col("c_acctbal") < 0, F.lit("bad")).alias("error"), (k % 7 == 0).alias("encrypted"), (k % 3).alias("pages"))
    whole = c.select("c_custkey", projections.section_name(F.col("name"), F.col("stem")).alias("name"), projections.section_note(F.col("error"), F.col("encrypted"), F.col("pages")).alias("note"))
    return whole.join(projections.readable(c).select("c_custkey", F.lit(True).alias("readable")), "c_custkey", "left").withColumn("readable", F.coalesce("readable", F.lit(False)))


def page_titles(spark, d):
    k = F.col("doc_id")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    title = projections.page_title(F.when(k % 4 == 0, F.concat(F.lit("  "), F.col("source"))).otherwise(F.lit(" ")), F.when(k % 4 == 1, F.col("lang")), F.when(k % 4 == 2, F.concat(F.col("lang"), F.lit(" "))), first)
    return read(spark, d, "documents").select("doc_id", title.alias("title"), projections.page_level(F.when(k % 5 > 0, F.col("n_chars") % 4)).alias("level"), projections.heading_level(F.concat(F.lit("h"), (k % 12).cast("string"))).alias("heading"))


def title_blocks(spark, d):
    style = F.when(F.col("turn") % 4 == 1, F.lit("PageDateTime"))
    return projections.title_texts(read(spark, d, "conversations"), "conv_id", "turn", style, F.left("text", F.lit(12)))


def tag_marks(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 250).alias("definition"), (F.floor("value") % 2 == 0).alias("completed"))
    shapes = read(spark, d, "part").select(F.col("p_partkey").alias("definition"), F.col("p_name").alias("label"), (F.col("p_partkey") % 150).cast("int").alias("shape"))
    return projections.tag_marks(projections.note_tags(e, shapes, "definition"), "user_id", "event_id")


def images(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.lit("Image")).when(k % 4 == 1, F.concat("p_name", F.lit(".PNG"))).otherwise(F.col("p_name"))
    p = read(spark, d, "part").select("p_partkey", (k % 700).alias("container"), name.alias("name"), F.element_at(F.array(*map(F.lit, ("", "png", ".tif"))), (k % 3 + 1).cast("int")).alias("detected"), (F.col("p_size") / 3.0 * (k % 5)).alias("width"))
    held = read(spark, d, "supplier").select(F.col("s_suppkey").alias("container"), F.col("s_name").alias("data"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("gif")).otherwise(F.lit("")).alias("ext"))
    i = projections.with_payload(p, held, "container")
    i = i.withColumn("ext", projections.image_extension(F.col("detected"), F.col("container_ext"), F.col("name")))
    i = i.withColumn("file", projections.image_name(F.col("name"), F.col("ext"), F.lit("page"), k))
    path = F.concat(F.lit("assets/"), F.col("file"))
    return i.select(
        "p_partkey", "ext", "file", projections.image_markdown(F.col("name"), F.col("file"), path, F.col("width"), F.col("missing")).alias("md"), projections.image_markdown(F.col("name"), F.col("file"), path, F.col("width"), F.col("missing"), True, True).alias("vault")
    )


def attachments(spark, d):
    k = F.col("p_partkey")
    source = F.when(k % 3 == 1, F.concat(F.lit("C:\\tmp/x\\"), F.col("p_brand"), F.lit(".PDF")))
    name = projections.attachment_name(F.when(k % 3 == 0, F.concat("p_name", F.lit(".mp3"))), source)
    p = read(spark, d, "part").select("p_partkey", name.alias("name"), (k % 4).alias("media"), (k % 5 == 0).alias("missing"))
    of = lambda vault: projections.attachment_markdown(F.col("name"), F.col("name"), F.concat(F.lit("assets/"), F.col("name")), F.col("media"), F.col("missing"), vault)
    return p.select("p_partkey", "name", of(False).alias("md"), of(True).alias("vault"))


def asset_names(spark, d):
    p = read(spark, d, "part").select("p_type", "p_partkey", F.concat(F.lower("p_brand"), F.when(F.col("p_partkey") % 3 == 0, F.lit(".PNG")).otherwise(F.lit(".png"))).alias("name"))
    return sequence.unique_names(p, "p_type", "p_partkey", "name", files=True)


def page_canvas(spark, d):
    v = lambda i: F.get("embedding", i).cast("double")
    kind = F.element_at(F.array(*map(F.lit, ("outline", "image", "ink", "attachment"))), (F.col("vec_id") % 4 + 1).cast("int"))
    e = read(spark, d, "embeddings").select("label", "vec_id", kind.alias("kind"), F.when(F.col("vec_id") % 9 > 0, v(0)).alias("x"), v(1).alias("y"), F.when(F.col("vec_id") % 8 == 0, v(2)).alias("width"), v(3).alias("height"))
    placed, heights = projections.canvas(e, "label")
    return placed.select("label", "vec_id", "style").join(heights, "label")


def drawings(spark, d):
    e = read(spark, d, "embeddings").select("label", "vec_id", F.when(F.col("vec_id") % 3 > 0, F.lit("ink")).otherwise(F.lit("image")).alias("kind"), F.get("embedding", 0).alias("x"), F.get("embedding", 1).alias("y"))
    return projections.ink_groups(e, "label", "vec_id").select("label", "vec_id", "group", F.round(F.col("dx").cast("double"), 3).alias("dx"), F.round(F.col("dy").cast("double"), 3).alias("dy"))


def contents_note(spark, d):
    p = titled(spark, d).withColumn("wiki", text.fallback(F.col("title"), "Untitled Page")).withColumn("level", (F.col("page_id") % 3).cast("int"))
    of = lambda wiki, name: sequence.joined_lines(p, ["host"], "page_id", projections.contents_lines(p, wiki), name=name)
    return of(True, "notes").join(of(False, "titles"), "host").select("host", F.md5("notes").alias("notes"), F.md5("titles").alias("titles"))


def contents_name(spark, d):
    """The contents note of a notebook named as a customer that has twins among the notes."""
    c = read(spark, d, "customer").select(F.upper("c_name").alias("stem"))
    more = read(spark, d, "region").select(F.concat(F.lit("customer#000000001 (Contents)"), F.when(F.col("r_regionkey") > 0, F.concat(F.lit(" "), (F.col("r_regionkey") + 1).cast("string"))).otherwise(F.lit(""))).alias("stem"))
    return projections.free_name(c.unionAll(more), "stem", "Customer#000000001")


def archived(spark, d):
    n = F.col("page_id")
    path = F.concat(F.when(n % 3 == 0, F.lit("/")).otherwise(F.lit("")), F.lit("top/"), F.when(n % 4 == 0, F.lit("inner/")).otherwise(F.lit("")), F.lit("p"), n.cast("string"), F.when(n % 7 == 0, F.lit(".ONE")).otherwise(F.lit(".txt")))
    return titled(spark, d).select(F.col("host").alias("archive"), path.alias("path"))


def archive_listing(spark, d):
    return listing.listing(archived(spark, d), "top")


def package_roots(spark, d):
    return listing.package_roots(archived(spark, d))


def payload_files(spark, d):
    k = F.col("l_partkey")
    refs = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("dir"), F.concat(F.lit("f"), (k % 500).cast("string")).alias("name"))
    files = read(spark, d, "part").filter("p_partkey % 2 = 0").select((F.col("p_partkey") % 3).alias("dir"), F.concat(F.lit("f"), (F.col("p_partkey") % 500).cast("string"), F.when(F.col("p_partkey") % 4 == 0, F.lit(".onebin")).otherwise(F.lit(""))).alias("name")).distinct()
    return listing.beside(refs, files).select("l_orderkey", "l_linenumber", "name", "found")


def cell_manifests(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    cells = o.select(k.alias("cell"), (k % 1000).alias("serial"))
    current = o.filter("o_orderkey % 3 = 0").select(k.alias("cell"), (k + 7).alias("revision"))
    revisions = o.filter("o_orderkey % 5 = 0").select((k + 7).alias("revision"), (k * 10).alias("manifest"), (k % 1000).alias("serial"))
    return manifests.cell_manifests(cells, current, revisions, o.filter("o_orderkey % 7 = 0").select(k.alias("manifest")))


def file_payloads(spark, d):
    k = F.col("p_partkey")
    mark = F.element_at(F.array(*map(F.lit, ("<ifndf>", "<file>", "<invfdo>", "what "))), (k % 4 + 1).cast("int"))
    refs = read(spark, d, "part").select("p_partkey", F.concat(mark, (k % 900).cast("string")).alias("reference"))
    held = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("payload"))
    return manifests.file_payloads(refs, held.filter("key % 2 = 0"), held)


def space_roots(spark, d):
    labels = read(spark, d, "events").select(F.col("user_id").alias("space"), (F.col("event_id") % 3).alias("role"), F.col("event_id").alias("seq"), (F.floor("value") + F.col("event_id")).alias("root"))
    return manifests.roots(labels, 1)


def referenced_spaces(spark, d):
    c = F.col("c_custkey")
    spaces = read(spark, d, "customer").select((c % 400).alias("a"), F.when(c % 3 > 0, c).alias("b"), (c * 2).alias("space")).filter("space % 5 > 0")
    spaces = spaces.groupBy("a", "b").agg(F.min("space").alias("space"))
    k = F.col("o_orderkey")
    return manifests.spaces_of(read(spark, d, "orders").select("o_orderkey", (k % 500).alias("a"), F.when(k % 2 > 0, k % 1500).alias("b")), spaces).select("o_orderkey", "space")


def resolved_ids(spark, d):
    table = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("revision"), F.col("l_linenumber").cast("long").alias("index")).agg(F.max("l_partkey").alias("guid"))
    ids = read(spark, d, "orders").select(F.col("o_orderkey").alias("revision"), (F.col("o_custkey") % 6).alias("index"))
    return manifests.resolved_ids(ids, table)


def fixed_decimals(spark, d):
    """Thousandths, and the same a bit further on, with two decimals as C prints them."""
    x = (F.col("l_partkey") % 20_000 - 10_000) / 1000.0
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ink.fixed2(x).alias("shown"), ink.fixed2(F.col("l_extendedprice") / 8.0).alias("eighth"))


def run_styles(spark, d):
    """Style objects from part: those of runs by part, those of paragraphs by supplier, some of which are missing."""
    k = F.col("p_partkey")
    flags = (F.when(k % (i + 3) > 0, k % (i + 2) == 0).alias(f) for i, f in enumerate(styles.FLAGS))
    color = F.element_at(F.array(F.lit("#FFFFFF"), F.lit("#000000"), F.lit(None).cast("string"), F.lit("#12aB34")), (k % 4 + 1).cast("int"))
    held = read(spark, d, "part").filter("p_partkey % 9 > 0").select(k.alias("style"), *flags, F.when(k % 3 > 0, F.col("p_brand")).alias("font"), F.when(k % 5 > 0, F.col("p_size")).alias("size"), color.alias("color"), color.alias("highlight"))
    runs = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("own"), (F.col("l_suppkey") * 18).alias("paragraph"))
    r = styles.with_styles(runs, held, "own", "paragraph")
    set_ = lambda s: F.array_join(F.array(*(F.when(F.col(f"{s}.{f}"), F.lit(f)) for f in styles.FLAGS)), ",")
    return r.select(
        "l_orderkey", "l_linenumber", set_("style").alias("flags"), set_("base").alias("base_flags"), F.col("style.font").alias("font"), F.col("base.size").alias("base_size"),
        styles.shown_colour(F.col("style.color"), "#000000").alias("color"), styles.shown_colour(F.col("style.highlight"), "#ffffff").alias("highlight"),
    )


def list_formats(spark, d):
    k = F.col("p_partkey").cast("int")
    units = F.element_at(F.array(F.array(F.lit(0xFFFD), k % 8), F.array(F.lit(0xA7)), F.array(F.lit(0xF0B7)), F.array().cast("array<int>"), F.array(F.lit(0x77), k), F.array(F.lit(0xB7)), F.array(F.lit(0xD801))), k % 7 + 1)
    font = F.element_at(F.array(*map(F.lit, ("Wingdings", "Symbol", "Wingdings 2", "", "Arial"))), k % 5 + 1)
    return read(spark, d, "part").select("p_partkey", styles.list_format(units, font).alias("f")).select("p_partkey", "f.ordered", "f.number_style", "f.bullet")


def paragraph_kinds(spark, d):
    n = F.col("turn") + F.col("conv_id")
    kind = F.when(F.col("conv_id") % 3 == 0, F.lit("math")).when(n % 5 == 0, F.lit("break")).otherwise(F.lit("text"))
    said = F.when((F.col("conv_id") % 4 > 0) & (F.col("turn") > 0), F.lit(" \t")).when(F.col("conv_id") % 8 > 0, F.lit("")).otherwise(F.left("text", F.lit(9)))
    c = read(spark, d, "conversations").select("conv_id", kind.alias("kind"), said.alias("text"))
    return styles.paragraph_kinds(c, "conv_id", (F.col("conv_id") % 5 == 1).cast("int"))


def code_elements(spark, d):
    of = F.struct(F.when(F.col("turn") % 4 == 3, F.lit("ink")).otherwise(F.lit("paragraph")).alias("kind"), F.when(F.char_length("text") % 2 == 0, F.lit("code")).alias("style"))
    c = read(spark, d, "conversations").select("conv_id", "turn", styles.is_code(F.col("conv_id") % 3 == 0, F.when(F.col("turn") % 5 == 4, F.array(of, of)).otherwise(F.array(of))).alias("code"))
    return c


def ink_offsets(spark, d):
    """Containers in trees of three below one another, a few of them below themselves."""
    k = F.col("o_orderkey")
    nodes = read(spark, d, "orders").select(k.alias("id"), F.when(k % 11 == 0, k).when(k % 13 > 0, F.floor(k / 3)).alias("parent"), F.when(k % 5 > 0, (k % 7) / 2 * 1270).alias("x"), ((k % 9) / 4 * 1270).alias("y"))
    return graph.folded_offsets(nodes, 16)


def structure(spark, d):
    t = titled(spark, d)
    n = F.char_length("host")
    sections = t.select("host").distinct().select("host", F.upper("host").alias("name"), F.when(n % 3 == 0, F.lit("unreadable")).alias("error"), (n % 2 == 0).alias("encrypted"))
    pages = t.select("host", (F.col("page_id") + 1).alias("at"), (F.col("page_id") % 3).alias("level"), F.when(F.col("page_id") % 10 > 0, F.col("title")).alias("title"))
    return projections.structure(sections, pages, "host", "at")


QUERIES = {
    f.__name__: f
    for f in (
        inline_lines, plain_paragraphs, section_index, page_titles, title_blocks, tag_marks, images, attachments, asset_names, page_canvas, drawings, contents_note, contents_name, archive_listing, package_roots,
        payload_files, cell_manifests, file_payloads, space_roots, referenced_spaces, resolved_ids, fixed_decimals, run_styles, list_formats, paragraph_kinds, code_elements, ink_offsets,
        structure,
    )
}
