"""Inlines: runs of styled text, links and breaks to lines of Markdown.

An inline is a row (element, pos, kind, text, href, and a flag for each of STYLE); kind is text, break or math.  Each element's
rows meet in one task, as an element is a paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators.sequence import changed, islands, joined_lines

STYLE = ("bold", "italic", "underline", "strike", "superscript", "subscript", "highlight")

#: Fixed: an address in running text, without the punctuation of the sentence after it.
ADDRESS = r"""https?://(?:[^\x09-\x0D <>"]*[^\x09-\x0D <>".,;:!?)\]'])?"""
#: Fixed: characters that break a line, and characters that are dropped.
BREAKS, DROPPED = r"[\x0B\n\r\x{2028}]", r"[\x00-\x08\x0C\x0E-\x1F\x7F\x{FDD0}-\x{FDEF}]"
#: Stands for a break while lines are put together; no text holds it any more.
_MARK = "\x0b"


def cleaned(inlines: DataFrame, element: str, pos: str) -> DataFrame:
    """Text without control characters, divided at line breaks: the parts and a break between two of them are rows of their own, in the
    order of (pos, part).  Empty parts are left out."""
    parts = F.split(F.regexp_replace("text", DROPPED, ""), BREAKS)
    rows = inlines.select("*", F.posexplode(F.when(F.col("kind") == "text", parts).otherwise(F.array("text"))).alias("_n", "_part"))
    both = rows.withColumn("_kind", F.explode(F.when(F.col("_n") > 0, F.array(F.lit("break"), F.col("kind"))).otherwise(F.array("kind"))))
    out = both.withColumn("part", F.col("_n") * 2 + F.when(F.col("_kind") == "break", 0).otherwise(1)).withColumn("text", F.when(F.col("_kind") == "break", F.lit("")).otherwise(F.col("_part")))
    return out.withColumn("kind", F.col("_kind")).drop("_n", "_part", "_kind").filter((F.col("kind") != "text") | (F.col("text") != ""))


def escaped_but_addresses(s: Column, escape) -> Column:
    """Escaped, but for addresses: viewers turn them into links, and an escape would become part of them."""
    pieces = F.regexp_extract_all(s, F.lit(rf"(?s){ADDRESS}|.+?(?=https?://|\z)"), F.lit(0))
    return F.when(s.contains("http"), F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^https?://"), p).otherwise(escape(p))), "")).otherwise(escape(s))


def styled(raw: Column, vault: bool = False, tags: bool = True) -> Column:
    """Text in its style's marks; blanks around it stay outside of them, and blank text has none."""
    escape = text.vault_escape if vault else text.md_escape
    core = F.btrim(raw, F.lit(" \t"))
    s = escaped_but_addresses(core, escape)
    shown = lambda flag, mark: F.when(F.col(flag), F.lit(mark)).otherwise(F.lit(""))
    wrap = lambda s, flag, a, b: F.concat(shown(flag, a), s, shown(flag, b))
    if tags:
        for flag, tag in (("superscript", "sup"), ("subscript", "sub"), ("underline", "u")):
            s = wrap(s, flag, f"<{tag}>", f"</{tag}>")
        s = s if vault else wrap(s, "highlight", "<mark>", "</mark>")
    if vault:
        s = wrap(s, "highlight", "==", "==")
    s = wrap(s, "strike", "~~", "~~")
    marks = F.concat(shown("bold", "**"), shown("italic", "*"))
    return F.when(core == "", raw).otherwise(F.concat(F.regexp_extract(raw, r"^[ \t]*", 0), marks, s, marks, F.regexp_extract(raw, r"[ \t]*\z", 0)))


def lines(inlines: DataFrame, element: str, pos: str, vault: bool = False, in_table: bool = False, tags: bool = True) -> DataFrame:
    """(element, text): neighbours that look the same are one run, neighbours with the same href one link.

    ``target`` and ``wiki`` are what href leads to (null: href itself; no note).  Blanks at the ends of lines go; lines are
    joined by hard breaks, in a table by <br>.
    """
    is_text, escape = F.col("kind") == "text", text.vault_escape if vault else text.md_escape
    runs = islands(inlines, element, pos, changed(element, pos, "kind", "href", *STYLE) | ~is_text, "_run")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "text"))), lambda x: x["text"]), "")
    rest = [F.first(c, ignorenulls=True).alias(c) for c in ("target", "wiki")]
    merged = runs.groupBy(element, "_run", "kind", "href", *STYLE).agg(joined.alias("text"), F.min(pos).alias(pos), *rest)
    shown = F.when(is_text, styled(F.col("text"), vault, tags)).otherwise(F.when(F.col("kind") == "break", F.lit("<br>" if in_table else _MARK)).otherwise(escape(F.col("text"))))
    links = islands(merged.withColumn("_shown", shown), element, pos, changed(element, pos, "kind", "href") | ~is_text | (F.col("href") == ""), "_link")
    of = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(c).alias("c")))), lambda x: x["c"]), "")
    each = links.groupBy(element, "_link", "kind", "href").agg(of("_shown").alias("label"), of("text").alias("plain"), F.min(pos).alias(pos), *rest)
    label = F.when(text.trim(F.col("label")) == "", escape(F.col("href"))).otherwise(F.col("label"))
    link = F.concat(F.lit("["), label, F.lit("]("), text.md_url(F.coalesce("target", "href")), F.lit(")"))
    if vault:
        link = F.when(F.col("wiki").isNotNull(), text.wikilink(F.col("wiki"), F.col("plain"), in_table)).otherwise(link)
    piece = F.when(is_text & (F.col("href") != ""), link).otherwise(F.col("label"))
    whole = joined_lines(each, [element], pos, piece, between="")
    trimmed = F.transform(F.split("text", _MARK), lambda line: F.rtrim(line))
    return whole.select(element, F.array_join(trimmed, "  \n" if vault else "\\\n").alias("text"))


def plain_text(inlines: DataFrame, element: str, pos: str) -> DataFrame:
    """(element, text, empty): what is said, without style; empty where all of it is blank and nothing but text."""
    said = F.when(F.col("kind") == "break", F.lit("\n")).otherwise(F.col("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("o"), said.alias("s")))), lambda x: x["s"]), "")
    blank = F.min((F.col("kind") == "break") | ((F.col("kind") == "text") & (text.trim(F.col("text")) == "")))
    return inlines.groupBy(element).agg(joined.alias("text"), blank.alias("empty"))
