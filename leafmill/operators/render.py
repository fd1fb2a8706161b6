"""Pages as text: Markdown, vault notes, HTML and note-exchange XML, from tables of elements.

An element is a row (page, pos, kind, depth, text, number): kind is heading, para, quote, code, bullet, ordered, task or done.
Each line is a Column expression; a page is its lines in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators.sequence import changed, islands, joined_lines, list_numbers

LISTS = ("bullet", "ordered", "task", "done")


def numbered(elements: DataFrame, page: str = "page", pos: str = "pos") -> DataFrame:
    return list_numbers(elements, page, pos, F.col("kind") == "ordered", F.lit(None).cast("int"))


def front_matter(fields: dict[str, Column]) -> Column:
    """YAML head of a page; fields that are null or empty are left out."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), text.yaml_string(v))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def md_line(vault: bool = False, heading_offset: int = 0) -> Column:
    """One element in Markdown, without its spacing."""
    escape = text.vault_escape if vault else text.md_escape
    body = escape(F.col("text"))
    guarded = F.array_join(F.transform(F.split(body, "\n"), text.escape_line_start), "  \n" if vault else "\\\n")
    flat = F.replace(body, F.lit("\n"), F.lit(" "))
    indent = F.repeat(F.lit("    "), F.col("depth"))
    level = F.least(F.lit(6), F.greatest(F.lit(1), F.col("depth") + 1 + heading_offset))
    kind = F.col("kind")
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), flat))
        .when(kind == "quote", F.concat(F.lit("> "), F.replace(body, F.lit("\n"), F.lit("\n> "))))
        .when(kind == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .when(kind == "bullet", F.concat(indent, F.lit("- "), flat))
        .when(kind == "ordered", F.concat(indent, F.col("number").cast("string"), F.lit(". "), flat))
        .when(kind.isin("task", "done"), F.concat(indent, F.when(kind == "done", F.lit("- [x] ")).otherwise(F.lit("- [ ] ")), flat))
        .otherwise(guarded)
    )


def markdown_pages(elements: DataFrame, vault: bool = False, heading_offset: int = 0) -> DataFrame:
    """(page, text): elements in order, a blank line between blocks but not between list items."""
    w = Window.partitionBy("page").orderBy("pos")
    in_list = F.col("kind").isin(*LISTS)
    before = F.lag(in_list).over(w)
    e = numbered(elements).withColumn("gap", F.when(before.isNull(), F.lit("")).when(before & in_list, F.lit("\n")).otherwise(F.lit("\n\n")))
    return joined_lines(e, ["page"], "pos", F.concat("gap", md_line(vault, heading_offset)), between="")


def html_pages(elements: DataFrame, style: str = "") -> DataFrame:
    """(page, text): consecutive items of one kind of list share a list; headings, quotes and paragraphs stand alone."""
    kind = F.col("kind")
    listed = F.when(kind == "ordered", F.lit("ol")).when(kind.isin("bullet", "task", "done"), F.lit("ul")).otherwise(F.lit(""))
    e = islands(elements.withColumn("list", listed), "page", "pos", changed("page", "pos", "list"), "run")
    run = Window.partitionBy("page", "run").orderBy("pos")
    first, last = F.row_number().over(run) == 1, F.lead("pos").over(run).isNull()
    body = F.replace(text.html_escape(F.col("text")), F.lit("\n"), F.lit("<br>"))
    tag = F.when(kind == "heading", F.concat(F.lit("h"), F.least(F.lit(6), F.col("depth") + 1).cast("string"))).when(kind == "quote", F.lit("blockquote")).when(kind == "code", F.lit("pre")).when(F.col("list") != "", F.lit("li")).otherwise(F.lit("p"))
    box = F.when(kind == "done", F.lit('<input type="checkbox" checked disabled> ')).when(kind == "task", F.lit('<input type="checkbox" disabled> ')).otherwise(F.lit(""))
    opens = F.when((F.col("list") != "") & first, F.concat(F.lit("<"), F.col("list"), F.lit(">"))).otherwise(F.lit(""))
    closes = F.when((F.col("list") != "") & last, F.concat(F.lit("</"), F.col("list"), F.lit(">"))).otherwise(F.lit(""))
    e = e.withColumns({"_open": opens, "_close": closes, "_tag": tag})
    line = F.concat("_open", F.lit("<"), "_tag", F.lit(">"), box, body, F.lit("</"), "_tag", F.lit(">"), "_close")
    pages = joined_lines(e, ["page"], "pos", line, between="\n")
    head = f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><style>{style}</style></head><body>\n'
    return pages.withColumn("text", F.concat(F.lit(head), "text", F.lit("\n</body></html>\n")))


def notes(pages: DataFrame, title: Column, body: Column, created: Column, tags: Column) -> DataFrame:
    """Each page as one note of the exchange format: ``note``.  body is valid markup; the end of a CDATA section is split."""
    clean = F.regexp_replace(F.regexp_replace(title, r"[\r\n]", " "), r"[\x00-\x1F\x7F]", " ")
    name = text.fallback(text.trim(F.left(text.xml_clean(clean), F.lit(255))), "Untitled Page")
    content = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE en-note SYSTEM "http://xml.evernote.com/pub/enml2.dtd"><en-note>'), body, F.lit("</en-note>"))
    content = F.replace(content, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    when = F.when(created != "", F.concat(F.lit("<created>"), created, F.lit("</created>"))).otherwise(F.lit(""))
    tag = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("<tag>"), text.xml_escape(t), F.lit("</tag>"))), "")
    return pages.withColumn("note", F.concat(F.lit("<note><title>"), text.xml_escape(name), F.lit("</title><content><![CDATA["), content, F.lit("]]></content>"), when, tag, F.lit("</note>")))


def md_table(cells: DataFrame, table: str, row: str, col: str, cell: Column) -> DataFrame:
    """(table, text): a Markdown table; the first row is the head, short rows are filled up to the widest."""
    body = F.replace(text.md_escape(cell), F.lit("\n"), F.lit(" "))
    rows = cells.groupBy(table, row).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(col).alias("c"), body.alias("b")))), lambda x: x["b"]).alias("cells"))
    rows = rows.withColumn("wide", F.max(F.size("cells")).over(Window.partitionBy(table)))
    filled = F.concat("cells", F.array_repeat(F.lit(""), F.col("wide") - F.size("cells")))
    line = F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("wide")))
    first = F.row_number().over(Window.partitionBy(table).orderBy(row)) == 1
    lines = rows.withColumn("line", F.concat(line, F.when(first, rule).otherwise(F.lit(""))))
    return joined_lines(lines, [table], row, F.col("line"))
