"""Sections, pages, tags and payloads as a notebook shows them: fallbacks, names, marks, as Column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text

# --------------------------------------------------------------------------- sections and pages


def section_name(name: Column, stem: Column) -> Column:
    """The section's own name, else its file's, without the file's ending."""
    return F.regexp_replace(F.coalesce(F.when(name != "", name), stem), r"(?i)\.one\z", "")


def section_note(error: Column, encrypted: Column, pages: Column) -> Column:
    """What the contents say of a section that shows no pages."""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit(" (could not be read: "), error, F.lit(")")))
        .when(encrypted, F.lit(" (password protected — not exported)"))
        .when(pages == 0, F.lit(" (empty)"))
        .otherwise(F.lit(""))
    )


def readable(sections: DataFrame) -> DataFrame:
    """Sections that are neither protected nor broken."""
    return sections.filter(~F.coalesce("encrypted", F.lit(False)) & (F.coalesce("error", F.lit("")) == ""))


def title_texts(paragraphs: DataFrame, page: str, order: str, style: Column, said: Column) -> DataFrame:
    """(page, title, date) of a title block: its paragraphs by single spaces, those in the style of dates apart."""
    is_date = F.coalesce(style == "PageDateTime", F.lit(False))
    of = lambda mask: text.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(mask, F.struct(F.col(order).alias("o"), said.alias("s"))))), lambda x: x["s"]), " "))
    return paragraphs.groupBy(page).agg(of(~is_date).alias("title"), of(is_date).alias("date"))


def page_title(block: Column, metadata: Column, cached: Column, first_line: Column, most: int = 80) -> Column:
    """The title block's text, else the title in the metadata, else the page's cached one, else its first line of text, cut at ``most`` bytes."""
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(text.trim(block)), filled(metadata), filled(text.trim(cached)), text.cut_bytes(text.trim(first_line), most), F.lit(""))


def page_level(stored: Column) -> Column:
    """Levels are stored from 1 on; 0 and none are the top."""
    return F.greatest(F.lit(0), F.coalesce(stored, F.lit(0)) - 1).cast("int")


def heading_level(style: Column) -> Column:
    return F.coalesce(F.regexp_extract(style, r"^h([1-6])\z", 1).try_cast("int"), F.lit(0))


def notebook_name(stem: Column) -> Column:
    """A folder of deleted sections has one name, however it is written."""
    return F.when(text.lower(stem).isin("onenote_recyclebin", "recycle bin"), F.lit("Recycle Bin")).otherwise(stem)


# --------------------------------------------------------------------------- tags

#: Fixed: shapes of tags that are boxes to tick.
CHECKBOXES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 28, 30, 32, 48, 50, 52, 69, 71, 73, 94, 95, 96, 97, 98, 99)
#: Fixed: marks of the other shapes; 0 has none, and all that are not listed have a dot.
SYMBOLS = {
    "⭐": (13, 40, 61), "🚩": (14, 89, 90, 91, 92, 93), "❓": (15, 111), "➡️": (16, 59, 80), "❗": (17, 115), "📇": (18, 118), "📅": (19, 120), "⏰": (20, 117), "💡": (21,), "📌": (22,), "🏠": (23,), "💬": (24,),
    "🙂": (25,), "🎗️": (26,), "🔑": (27,), "✔️": (35, 55, 76), "❌": (47, 68, 88), "✉️": (106, 107, 108), "📱": (109, 110), "📎": (112,), "🙁": (113,), "👥": (116,), "🌹": (119,), "🎵": (121,), "🎬": (122,),
    "❝": (123,), "🌐": (124, 125), "💻": (126,), "✈️": (127,), "🚗": (128,), "🔭": (129,), "📊": (130,), "🔒": (131,), "📖": (132, 133), "📄": (134,), "🔎": (135,), "🖊️": (136,), "💲": (137, 138), "🗓️": (139,),
    "⚡": (140,), "☁️": (141,), "❤️": (142,), "🌻": (143,),
}


def is_checkbox(shape: Column) -> Column:
    return F.coalesce(shape.isin(*CHECKBOXES), F.lit(False))


def tag_symbol(shape: Column, completed: Column) -> Column:
    by_shape = F.create_map(*(F.lit(x) for symbol, shapes in SYMBOLS.items() for s in shapes for x in (s, symbol)))
    box = F.when(F.coalesce(completed, F.lit(False)), F.lit("☑")).otherwise(F.lit("☐"))
    return F.when(is_checkbox(shape), box).when(F.coalesce(shape, F.lit(0)) == 0, F.lit("")).otherwise(F.coalesce(F.try_element_at(by_shape, shape.cast("int")), F.lit("●")))


def note_tags(states: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """Tags with the label and shape of their definition; without one, an empty label and shape 0.  definitions: (key, label, shape)."""
    d = definitions.select(F.col(key).alias("_key"), F.col("label").alias("_label"), F.col("shape").alias("_shape"))
    found = states.join(d, F.col(key) == F.col("_key"), "left")
    return found.withColumn("label", F.coalesce("_label", F.lit(""))).withColumn("shape", F.coalesce("_shape", F.lit(0)).cast("int")).drop("_key", "_label", "_shape")


def tag_marks(tags: DataFrame, element: str, order: str) -> DataFrame:
    """(element, checked, prefix, suffix) from (element, order, label, shape, completed): the state of the first box (null without one),
    marks before the text but for boxes, and vault tags after it but for the plain box."""
    symbol, slug = tag_symbol(F.col("shape"), F.col("completed")), text.tag_slug(F.col("label"))
    of = lambda value, mask: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(mask, F.struct(F.col(order).alias("o"), value.alias("v"))))), lambda x: x["v"]), "")
    box = is_checkbox(F.col("shape"))
    return tags.groupBy(element).agg(
        F.min_by(F.when(box, F.coalesce("completed", F.lit(False))), F.when(box, F.col(order))).alias("checked"),
        of(F.concat(symbol, F.lit(" ")), ~box & (symbol != "")).alias("prefix"),
        of(F.concat(F.lit(" #"), slug), (slug != "") & (F.coalesce("shape", F.lit(0)) != 3)).alias("suffix"),
    )


# --------------------------------------------------------------------------- payloads

#: Fixed: endings that a vault shows in the page, pictures first.
PICTURES = ("avif", "bmp", "gif", "jpeg", "jpg", "png", "svg", "webp")
EMBEDDED = (*PICTURES, "flac", "m4a", "mp3", "ogg", "wav", "webm", "3gp", "mkv", "mov", "mp4", "ogv", "pdf")


def with_payload(items: DataFrame, containers: DataFrame, key: str) -> DataFrame:
    """``data``, ``container_ext`` and ``missing`` of each item, by the container that it points to.  containers: (key, data, ext)."""
    c = containers.select(F.col(key).alias("_key"), F.col("data"), F.col("ext").alias("container_ext"))
    return items.join(c, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("missing", F.col("data").isNull())


def image_extension(detected: Column, container: Column, name: Column) -> Column:
    """With its dot: what the bytes say, else the container, else the name; empty without any."""
    filled = lambda c: F.when(c != "", c)
    ext = F.coalesce(filled(detected), filled(container), filled(text.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1))), F.lit(""))
    return F.when((ext != "") & ~ext.startswith("."), F.concat(F.lit("."), ext)).otherwise(ext)


def attachment_name(name: Column, source: Column) -> Column:
    """Its own name, else the last part of the path it came from."""
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(name), filled(F.regexp_extract(source, r"([^/\\]*)\z", 1)), F.lit("attachment"))


def image_name(name: Column, ext: Column, slug: Column, number: Column) -> Column:
    """A picture's file: its own name, with the ending of what it holds, or the page's name and a number where it has none of its own."""
    own = F.when((ext != "") & ~text.lower(name).endswith(text.lower(ext)), F.concat(name, ext)).otherwise(name)
    made = F.concat(slug, F.lit("-image-"), number.cast("string"), F.when(ext == "", F.lit(".bin")).otherwise(ext))
    return F.when(text.generic_image_name(name), made).otherwise(own)


def embed_width(half_inches: Column) -> Column:
    """In pixels, where a vault can use it: 16 to 4000; else empty."""
    px = F.floor(F.coalesce(half_inches, F.lit(0.0)) * 48 + 0.5)
    return F.when(px.between(16, 4000), px.cast("long").cast("string")).otherwise(F.lit(""))


def image_markdown(alt: Column, file: Column, path: Column, width: Column, missing: Column, vault: bool = False, in_table: bool = False) -> Column:
    escape = text.vault_escape if vault else text.md_escape
    shown = F.replace(F.replace(escape(F.replace(alt, F.lit("\n"), F.lit(" "))), F.lit("\r"), F.lit("")), F.lit("  "), F.lit(" "))
    if vault:
        there = F.when(text.extension(file).isin(*PICTURES), text.wikilink(file, embed_width(width), in_table, True)).otherwise(F.concat(F.lit("🖼️ "), text.wikilink(file, F.lit(""), in_table)))
    else:
        there = F.concat(F.lit("!["), shown, F.lit("]("), text.md_url(path), F.lit(")"))
    return F.when(missing, F.concat(F.lit("*[image unavailable: "), shown, F.lit("]*"))).otherwise(there)


def attachment_markdown(name: Column, file: Column, path: Column, media: Column, missing: Column, vault: bool = False) -> Column:
    """media: 1 sound, 2 film, else a file."""
    escape = text.vault_escape if vault else text.md_escape
    icon = F.when(media == 1, F.lit("🎵")).when(media == 2, F.lit("🎬")).otherwise(F.lit("📎"))
    if vault:
        link = text.wikilink(file, F.lit(""))
        there = F.when(text.extension(file).isin(*EMBEDDED), F.concat(F.lit("!"), link)).otherwise(F.concat(icon, F.lit(" "), link))
    else:
        there = F.concat(F.lit("["), icon, F.lit(" "), text.md_escape(name), F.lit("]("), text.md_url(path), F.lit(")"))
    return F.when(missing, F.concat(icon, F.lit(" "), escape(name), F.lit(" *(file not available)*"))).otherwise(there)


# --------------------------------------------------------------------------- layout


def px(x: Column) -> Column:
    """Whole pixels, half to even, as C prints them."""
    whole = F.bround(x, 0)
    return F.concat(F.when((whole == 0) & (x < 0), F.lit("-0")).otherwise(whole.cast("long").cast("string")), F.lit("px"))


def canvas(items: DataFrame, page: str, per_half_inch: float = 48.0) -> tuple[DataFrame, DataFrame]:
    """Items (page, kind, x, y, width, height) with the ``style`` of their place, and (page, min_height) of the page that holds them."""
    at = lambda c: F.coalesce(c, F.lit(0.0)) * per_half_inch
    wide = F.when((F.col("kind") == "outline") & F.col("width").isNotNull(), F.concat(F.lit(";width:"), px(F.col("width") * per_half_inch + 20))).otherwise(F.lit(""))
    placed = items.withColumn("style", F.concat(F.lit("left:"), px(at(F.col("x"))), F.lit(";top:"), px(at(F.col("y"))), wide))
    tall = F.when((F.col("kind") == "image") & (F.col("height") > 0), F.col("height") * per_half_inch).when(F.col("kind") == "ink", F.col("height")).otherwise(200.0)
    heights = items.groupBy(page).agg(px(F.greatest(F.lit(0.0), F.max(at(F.col("y")) + tall)) + 200).alias("min_height"))
    return placed, heights


def ink_groups(items: DataFrame, page: str, place: str) -> DataFrame:
    """``group`` of each item in reading order: neighbouring ink is one drawing, any other item stands alone; and what moves the
    ink's points into the page, in units of ink."""
    w = Window.partitionBy(page).orderBy(place)
    is_ink = F.col("kind") == "ink"
    starts = ~(is_ink & F.coalesce(F.lag(is_ink).over(w), F.lit(False)))
    numbered = items.withColumn("group", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    move = lambda c: F.when(is_ink, F.coalesce(F.col(c).cast("float"), F.lit(0).cast("float")) * F.lit(1270).cast("float"))
    return numbered.withColumn("dx", move("x")).withColumn("dy", move("y"))


# --------------------------------------------------------------------------- contents


def free_name(names: DataFrame, name: str, wanted: str) -> DataFrame:
    """(name): ``wanted``, or where it is taken (ASCII case aside) the first of ``wanted (contents)``, ``wanted (contents) 2`` ... that is free.

    Only names of that form are looked at; of n taken numbers one of the first n + 1 is free, so one anti-join finds it.
    """
    base = f"{wanted} (contents)"
    low = text.lower(F.col(name))
    taken = names.select(low.alias("_taken")).filter((F.col("_taken") == wanted.lower()) | F.col("_taken").startswith(base.lower())).distinct()
    tries = taken.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + 1)).alias("i"))
    named = tries.withColumn(name, F.when(F.col("i") == 0, F.lit(wanted)).when(F.col("i") == 1, F.lit(base)).otherwise(F.concat(F.lit(f"{base} "), F.col("i").cast("string"))))
    free = named.join(taken, text.lower(F.col(name)) == F.col("_taken"), "left_anti")
    return free.agg(F.min_by(name, "i").alias(name))


def contents_lines(pages: DataFrame, wiki: bool = True) -> Column:
    """A page's line in the contents of a vault (or in a plain listing): indented by its level."""
    title = text.fallback(F.col("title"), "Untitled Page")
    label = F.replace(F.regexp_replace(title, r"[\[\]\n]", ""), F.lit("|"), F.lit("-"))
    shown = F.concat(F.lit("[["), F.col("wiki"), F.when(label != F.col("wiki"), F.concat(F.lit("|"), label)).otherwise(F.lit("")), F.lit("]]")) if wiki else title
    return F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level"))), F.lit("- "), shown)


def structure(sections: DataFrame, pages: DataFrame, section: str, order: str) -> DataFrame:
    """(section, place, line): what a notebook holds, a line a section (place 0, with faults and the number of pages) and a line a page
    below it, indented by its level.  Lines stay rows: a section of very many pages is no one string.

    sections: (section, name, error, encrypted); pages: (section, order, level, title), in the place that ``order`` (over 0) says.
    """
    count = pages.groupBy(F.col(section).alias("_section")).agg(F.count(F.lit(1)).alias("_pages"))
    s = sections.join(count, F.col(section) == F.col("_section"), "left")
    error = F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit("  [error: "), "error", F.lit("]"))).otherwise(F.lit(""))
    locked = F.when(F.coalesce("encrypted", F.lit(False)), F.lit("  [password protected]")).otherwise(F.lit(""))
    head = F.concat(F.lit("# "), "name", error, locked, F.lit("  ("), F.coalesce("_pages", F.lit(0)).cast("string"), F.lit(" pages)"))
    line = F.concat(F.lit("  "), F.repeat(F.lit("  "), F.col("level").cast("int")), F.lit("- "), text.fallback(F.col("title"), "Untitled Page"))
    return s.select(section, F.lit(0).cast("long").alias("place"), head.alias("line")).unionAll(pages.select(section, F.col(order).cast("long").alias("place"), line.alias("line")))
