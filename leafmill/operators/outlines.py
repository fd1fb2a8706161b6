"""Outlines as nested markup: lists inside lists, code blocks, indents, for HTML pages and for notes.

An element is a row (page, place, size, depth, above, list, done, code, glyph, number_style, restart, text, body): its place, depth first,
and how many places its subtree takes, as ``trees.outline`` finds them; ``above`` is the element it stands below.  ``list`` is
ordered, bullet or null; ``done`` says whether a box is ticked (null: no box); ``body`` is its paragraph as markup, ``text`` as
plain text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators.graph import checkpointed

#: Types of ordered lists by number style, and glyphs with a list style of their own.
TYPES, CIRCLES, SQUARES, DISC = {1: "I", 2: "i", 3: "A", 4: "a"}, ("◦", "o"), ("▪", "■"), "•"
#: Fixed: the style of a note's code block, by which readers know it.
NOTE_CODE = (
    "box-sizing: border-box; padding: 8px; font-family: Monaco, Menlo, Consolas, &quot;Courier New&quot;, monospace; font-size: 12px; color: rgb(51, 51, 51); "
    "border-radius: 4px; background-color: rgb(251, 250, 248); border: 1px solid rgba(0, 0, 0, 0.15);-en-codeblock:true;"
)


def _shown(condition: Column, value) -> Column:
    return F.when(condition, F.lit(value) if isinstance(value, str) else value).otherwise(F.lit(""))


def list_kinds(tasks: bool) -> Column:
    """What decides which neighbours share a block: code, task, ordered, bullet or none.  Code is what has no list of its own;
    where ``tasks`` have no lists, an element with a box is none."""
    box, code = F.col("done").isNotNull(), F.coalesce("code", F.lit(False)) & F.col("list").isNull()
    return F.when(code, "code").when(box, "task" if tasks else "none").otherwise(F.coalesce("list", F.lit("none")))


def blocks(elements: DataFrame, kind: Column, glyphs: bool) -> DataFrame:
    """Elements with ``kind``, ``first`` and ``last`` (of the neighbours below the same element that share its block) and
    ``parent`` (whether some element stands below it).  With ``glyphs``, bullets of another glyph are another block.  What is below code is
    left out, as code has no children."""
    page = Window.partitionBy("page").orderBy("place")
    e = elements.withColumn("kind", kind).withColumn("end", F.col("place") + F.col("size") - 1)
    covered = F.max(F.when(F.col("kind") == "code", F.col("end"))).over(page.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("_covered", covered).filter(F.col("_covered").isNull() | (F.col("place") > F.col("_covered"))).drop("_covered")
    siblings = Window.partitionBy("page", "above").orderBy("place")
    key = F.struct("kind", F.when(F.col("kind") == "bullet", F.coalesce("glyph", F.lit(""))) if glyphs else F.lit(None).cast("string"))
    e = e.withColumn("_key", key)
    other = lambda at: at("_key").over(siblings).isNull() | ~at("_key").over(siblings).eqNullSafe(F.col("_key")) | (F.col("kind") == "none")
    e = e.withColumns({"first": other(F.lag), "last": other(F.lead)}).drop("_key")
    return e.withColumn("parent", F.coalesce(F.lead("depth").over(page) > F.col("depth"), F.lit(False)) & (F.coalesce(F.lead("place").over(page), F.lit(-1)) <= F.col("end")))


def nested(blocks_: DataFrame, before: Column, after: Column) -> DataFrame:
    """(page, text): what comes before each element and, behind all that stands below it, what comes after it.

    An element ends at its last place; of those that end together the deepest ends first.  So brackets match at any depth, and
    each element is two pieces that are sorted, whatever the tree's shape."""
    pieces = F.array(
        F.struct(F.col("place").alias("at"), F.lit(0).alias("phase"), F.lit(0).cast("long").alias("rank"), before.alias("piece")),
        F.struct(F.col("end").alias("at"), F.lit(1).alias("phase"), (0 - F.col("depth")).cast("long").alias("rank"), after.alias("piece")),
    )
    rows = blocks_.select("page", F.explode(pieces).alias("p"))
    return rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("text"))


def _ordered_open(start: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    kind = F.try_element_at(kinds, F.coalesce("number_style", F.lit(0)))
    return F.concat(F.lit("<ol"), _shown(kind.isNotNull(), F.concat(F.lit(' type="'), kind, F.lit('"'))), _shown(start, F.concat(F.lit(' start="'), F.col("restart").cast("string"), F.lit('"'))), F.lit(">"))


def html_outline(elements: DataFrame) -> DataFrame:
    """(page, text): a page's outline in HTML.

    Neighbours of one kind of list (tasks, numbers, bullets of one glyph) share a list; code shares a block of its lines; other
    elements are paragraphs, what is below them is indented.  Null bodies and texts are empty, a null glyph the usual one.  A
    page without elements has no row; of an empty table nothing is made.  Other columns are ignored.
    """
    e = blocks(elements.withColumns({c: F.coalesce(c, F.lit("")) for c in ("body", "text", "glyph")}), list_kinds(True), True)
    kind, glyph = F.col("kind"), F.col("glyph")
    bullets = (
        F.when(glyph.isin("", DISC), "<ul>").when(glyph.isin(*CIRCLES), '<ul style="list-style-type:circle">').when(glyph.isin(*SQUARES), '<ul style="list-style-type:square">')
        .otherwise('<ul class="bullets-custom">')
    )
    opens = F.when(kind == "code", '<pre class="code"><code>').when(kind == "task", '<ul class="tasks">').when(kind == "ordered", _ordered_open(F.coalesce(F.col("restart") != 1, F.lit(False)))).when(kind == "bullet", bullets).otherwise("")
    custom = (kind == "bullet") & ~glyph.isin("", DISC, *CIRCLES, *SQUARES)
    mark = F.when(kind == "task", F.concat(F.lit('<input type="checkbox" disabled'), _shown(F.col("done"), " checked"), F.lit(">"))).when(custom, F.concat(F.lit('<span class="bullet">'), text.html_escape(glyph, quotes=True), F.lit("</span>"))).otherwise(F.lit(""))
    item = (
        F.when(kind == "code", F.concat(text.html_escape(F.col("text")), F.lit("\n")))
        .when(kind == "none", F.concat(F.lit("<p>"), F.col("body"), F.lit("</p>"), _shown(F.col("parent"), '<div class="indent">')))
        .otherwise(F.concat(F.lit("<li>"), mark, F.col("body")))
    )
    ends = F.when(kind == "code", "</code></pre>").when(kind == "ordered", "</ol>").when(kind == "none", "").otherwise("</ul>")
    after = F.when(kind == "code", "").when(kind == "none", _shown(F.col("parent"), "</div>")).otherwise("</li>")
    return nested(e, F.concat(_shown(F.col("first"), opens), item), F.concat(after, _shown(F.col("last"), ends)))


def _code_lines(code: Column) -> Column:
    """Each line of code as a division; blanks that lead a line would collapse, so they are written as such."""

    def line(s: Column) -> Column:
        lead = F.regexp_extract(s, r"^[ \t]*", 0)
        held = F.replace(F.replace(lead, F.lit("\t"), F.lit("&#160;" * 4)), F.lit(" "), F.lit("&#160;"))
        whole = F.concat(held, text.xml_escape(F.substr(s, F.char_length(lead) + 1)))
        return F.concat(F.lit("<div>"), F.when(whole == "", "<br/>").otherwise(whole), F.lit("</div>"))

    return F.array_join(F.transform(F.split(code, "\n", -1), line), "")


def note_outline(elements: DataFrame) -> DataFrame:
    """(page, text): a page's outline as a note's markup: as ``html_outline``, but tasks are lines of their own, bullets of any glyph share a
    list, and lines are divisions.  Nulls, pages without elements and empty tables are as there."""
    e = blocks(elements.withColumns({c: F.coalesce(c, F.lit("")) for c in ("body", "text", "glyph")}), list_kinds(False), False)
    kind = F.col("kind")
    opens = F.when(kind == "code", f'<div style="{NOTE_CODE}">').when(kind == "ordered", _ordered_open(F.coalesce(F.col("restart") > 1, F.lit(False)))).when(kind == "bullet", "<ul>").otherwise("")
    todo = F.when(F.col("done").isNull(), "").otherwise(F.when(F.col("done"), '<en-todo checked="true"/>').otherwise('<en-todo checked="false"/>'))
    line = F.concat(F.lit("<div>"), todo, F.when(F.col("body") == "", F.when(todo == "", "<br/>").otherwise("")).otherwise(F.col("body")), F.lit("</div>"))
    item = (
        F.when(kind == "code", _code_lines(F.col("text")))
        .when(kind == "none", F.concat(line, _shown(F.col("parent"), '<div style="padding-left: 40px;">')))
        .otherwise(F.concat(F.lit("<li>"), line))
    )
    ends = F.when(kind == "code", "</div>").when(kind == "ordered", "</ol>").when(kind == "none", "").otherwise("</ul>")
    after = F.when(kind == "code", "").when(kind == "none", _shown(F.col("parent"), "</div>")).otherwise("</li>")
    return nested(e, F.concat(_shown(F.col("first"), opens), item), F.concat(after, _shown(F.col("last"), ends)))


# --------------------------------------------------------------------------- Markdown


def markdown_outline(elements: DataFrame, vault: bool = False, heading_offset: int = 1) -> DataFrame:
    """(page, text, tags): a page's outline in Markdown, and the slugs of its tags as they first come (vault notes only).

    Besides the columns above: ``style`` (h1 to h6, PageTitle, blockquote, cite, any other), ``lines`` (the paragraph's lines as
    ``inlines.lines`` makes them; null: no paragraph), ``prefix`` (its tags' marks) and ``slugs`` (its tags' slugs).

    An element with a list or a box is an item; what is below it is indented by its marker's width.  Items that follow an item,
    or what is below one, have no blank line before them, all other blocks have one.  Neighbours that are code are one block;
    a heading in a list is bold.  Nulls are empty.  A page without elements has no row.

    One ordered stream of events a page, each element's begin and its end: a window over it gives the indent, as the widths of
    the items that are open, and whether an item came last.  So no element knows the tree, and depth costs nothing.
    """
    text_of = {c: F.coalesce(c, F.lit("")) for c in ("text", "prefix", "style")}
    e = elements.withColumns({**text_of, "slugs": F.coalesce("slugs", F.array().cast("array<string>")), "body": F.lit(""), "glyph": F.lit("")})
    code = F.coalesce("code", F.lit(False)) & F.col("list").isNull()
    item = ~code & (F.col("list").isNotNull() | F.col("done").isNotNull())
    # Blocks of code, and runs of ordered items for their numbers.
    e = blocks(e, F.when(code, "code").when(F.coalesce(F.col("list") == "ordered", F.lit(False)), "ordered").otherwise("none"), False).withColumnRenamed("kind", "run_kind")
    siblings = Window.partitionBy("page", "above").orderBy("place")
    e = e.withColumn("_run", F.sum(F.col("first").cast("int")).over(siblings.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("page", "above", "_run")
    ordered = F.col("run_kind") == "ordered"
    e = e.withColumn("_number", F.greatest(F.lit(1), F.coalesce(F.first("restart").over(run.orderBy("place")), F.lit(1)) + F.row_number().over(run.orderBy("place")) - 1))
    e = e.withColumn("_fence", F.when(F.max(F.contains("text", F.lit("```")).cast("int")).over(run) == 1, "~~~").otherwise("```"))
    box = F.when(F.col("done").isNull(), "").when(F.col("done"), " [x]").otherwise(" [ ]")
    e = e.withColumn("_item", item).withColumn("_marker", F.when(item, F.concat(F.when(ordered, F.concat(F.col("_number").cast("string"), F.lit("."))).otherwise(F.lit("-")), box)))
    e = e.withColumn("_width", F.when(item, F.when(F.col("done").isNotNull() & ~ordered, 2).otherwise(F.char_length("_marker") + 1)).otherwise(0))

    lines = F.coalesce("lines", F.array().cast("array<string>"))
    level = F.when(F.col("style") == "PageTitle", 1).otherwise(F.coalesce(F.regexp_extract("style", r"^h([1-6])\z", 1).try_cast("int"), F.lit(0)))
    said = F.array_position(F.transform(lines, lambda s: s != ""), True)
    title = F.when(said > 0, text.trim(F.array_join(F.slice(lines, F.greatest(said, F.lit(1)).cast("int"), F.greatest(F.size(lines), F.lit(1))), " "))).otherwise(F.lit(""))
    e = e.withColumns({"_level": level, "_title": title, "_suffix": F.array_join(F.transform("slugs", lambda s: F.concat(F.lit(" #"), s)), "") if vault else F.lit("")})
    blank = text.trim(F.concat("prefix", F.array_join(lines, ""))) == ""
    shows = code | item | F.when(F.col("lines").isNull(), False).when(F.col("_level") > 0, F.col("_title") != "").otherwise(~blank | (F.size(lines) > 1) | (F.col("style") == "blockquote"))
    # Written: both branches of the events read it, and the plan would state its columns again for each use.
    e = checkpointed(e.withColumn("_shows", F.coalesce(shows, F.lit(False))))

    whole = F.struct(*(c for c in e.columns if c not in ("page", "place", "end")))
    begin = F.struct(F.col("place").alias("at"), F.lit(0).alias("phase"), F.lit(0).cast("long").alias("rank"), F.col("_width").alias("width"), F.when(F.col("_shows"), F.col("_item")).alias("state"), whole.alias("e"))
    end = F.struct(F.col("end").alias("at"), F.lit(1).alias("phase"), (0 - F.col("depth")).cast("long").alias("rank"), (0 - F.col("_width")).alias("width"), F.when(F.col("_item"), F.lit(True)).alias("state"), F.lit(None).cast(_type_of(e, whole)).alias("e"))
    events = e.select("page", F.explode(F.array(begin, end)).alias("v")).select("page", "v.*")
    before = Window.partitionBy("page").orderBy("at", "phase", "rank").rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumns({"_indent": F.coalesce(F.sum("width").over(before), F.lit(0)), "_after_item": F.coalesce(F.last("state", ignorenulls=True).over(before), F.lit(False))})
    b = checkpointed(events.filter("phase = 0").select("page", "at", "_indent", "_after_item", "e.*"))

    blanks = lambda n: F.repeat(F.lit(" "), n.cast("int"))
    indent = blanks(F.col("_indent"))
    cont = blanks(F.col("_indent") + F.col("_width"))
    in_list = F.col("_item") | (F.col("_indent") > 0)
    heading = F.when(F.col("_title") == "", "").when(in_list, F.concat(F.col("prefix"), F.lit("**"), "_title", F.lit("**"), "_suffix")).otherwise(
        F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.col("_level") + heading_offset))), F.lit(" "), "prefix", "_title", "_suffix")
    )
    quoted = F.col("style") == "blockquote"
    marked = F.transform(lines, lambda s, i: F.concat(F.when(i == 0, F.col("prefix")).otherwise(F.lit("")), text.escape_line_start(s)))
    joined = F.array_join(marked, "\0")
    flat = F.replace(F.concat(_shown(quoted, "> "), joined), F.lit("\0"), F.concat(F.lit("  \n" if vault else "\\\n"), cont, _shown(quoted, "> ")))
    cited = F.when((F.col("style") == "cite") & (text.trim(flat) != "") & ~F.contains(flat, F.lit("\n")), F.concat(F.lit("*"), flat, F.lit("*"))).otherwise(flat)
    body = F.when(F.col("lines").isNull(), "").when(F.col("_level") > 0, heading).otherwise(F.concat(cited, F.when(text.trim(cited) != "", F.col("_suffix")).otherwise(F.lit(""))))
    gap = F.when(F.col("_item") & F.col("_after_item"), "").otherwise("\n")
    code_text = F.array_join(F.transform(F.split("text", "\n", -1), lambda s: F.concat(indent, s, F.lit("\n"))), "")
    fence = F.concat(indent, "_fence", F.lit("\n"))
    block = (
        F.when(F.col("run_kind") == "code", F.concat(_shown(F.col("first"), F.concat(F.lit("\n"), fence)), code_text, _shown(F.col("last"), fence)))
        .when(F.col("_item"), F.concat(gap, indent, "_marker", _shown(body != "", F.concat(F.lit(" "), body)), F.lit("\n")))
        .when(F.col("_shows"), F.concat(F.lit("\n"), indent, body, F.lit("\n")))
        .otherwise("")
    )
    used = F.when(F.lit(vault) & (text.trim(body) != "") & (F.col("run_kind") != "code") & F.col("lines").isNotNull(), F.col("slugs")).otherwise(F.array().cast("array<string>"))
    out = b.select("page", F.struct("at", block.alias("block"), used.alias("slugs")).alias("b")).groupBy("page").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    return out.select("page", F.array_join(F.transform("bs", lambda x: x["block"]), "").alias("text"), F.array_distinct(F.flatten(F.transform("bs", lambda x: x["slugs"]))).alias("tags"))


def _type_of(df: DataFrame, column: Column) -> str:
    return df.select(column.alias("c")).schema["c"].dataType.simpleString()


def vault_head(title: Column, stem: Column, fields: dict[str, Column], parent: Column, tags: Column) -> Column:
    """YAML head of a vault note: the title, where the file's name is another, as an alias; fields that are said; the note
    above; the page's tags."""
    some = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), text.yaml_string(v), F.lit("\n"))) for k, v in fields.items()]
    alias = F.when(title != stem, F.concat(F.lit("aliases:\n  - "), text.yaml_string(title), F.lit("\n")))
    up = F.when(F.coalesce(parent, F.lit("")) != "", F.concat(F.lit("parent: "), text.yaml_string(F.concat(F.lit("[["), parent, F.lit("]]"))), F.lit("\n")))
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), t, F.lit("\n"))), "")))
    return F.concat(F.lit("---\n"), *(F.coalesce(x, F.lit("")) for x in (alias, *some, up, listed)), F.lit("---\n"))
