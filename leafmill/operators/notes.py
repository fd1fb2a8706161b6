"""Notes of the exchange format: resources beside the text, and a check of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text

#: Fixed by the format: elements of a note's text, attributes that it may not have, schemes of its addresses, and its times.
ELEMENTS = (
    "a abbr acronym address area b bdo big blockquote br caption center cite code col colgroup dd del dfn div dl dt em en-crypt en-media en-note en-todo font h1 h2 h3 h4 h5 h6 hr i img ins kbd li map "
    "ol p pre q s samp small span strike strong sub sup table tbody td tfoot th thead title tr tt u ul var xmp"
).split()
BAD_ATTRIBUTES = "id class accesskey data dynsrc tabindex".split()
ADDRESS, TIME = r"^(?:https?|ftp|mailto|tel|file):", r"^[0-9]{8}T[0-9]{6}Z\z"
HEADER, DOCTYPE = '<?xml version="1.0" encoding="UTF-8"', '<!DOCTYPE en-note SYSTEM "http://xml.evernote.com/pub/enml2.dtd">'


def resource(data: Column, mime: Column, name: Column) -> Column:
    """A payload as a note's resource; its text refers to it by the MD5 of its bytes (``media``)."""
    return F.concat(F.lit('<resource><data encoding="base64">'), F.base64(data), F.lit("</data><mime>"), text.xml_escape(mime), F.lit("</mime><resource-attributes><file-name>"), text.xml_escape(name), F.lit("</file-name></resource-attributes></resource>"))


def media(data: Column, mime: Column) -> Column:
    return F.concat(F.lit('<en-media hash="'), F.md5(data), F.lit('" type="'), text.xml_escape(mime), F.lit('"/>'))


def with_resources(note: Column, resources: Column) -> Column:
    """A note with its resources (an array), which come last."""
    return F.concat(F.regexp_replace(note, r"</note>\s*\z", ""), F.array_join(resources, ""), F.lit("</note>"))


def _inner(s: Column, tag: str) -> Column:
    return F.regexp_extract_all(s, F.lit(rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), F.lit(1))


def checked(notes: DataFrame, note: str) -> DataFrame:
    """notes with ``resources``, ``media``, ``todos`` (how many each has) and ``faults`` (array, sorted): what is wrong with them.

    * ``title``: blank, over 255 characters, with blanks at its ends or a line end; ``time``: one that is no time of the format;
      ``tags``: blank, over 100 characters, with a comma, or there twice (ASCII case aside).
    * ``resource``: no base64, or no type; ``unused``: its hash is nowhere in the text.
    * ``header``, ``doctype``: missing; ``malformed``: the text is no XML, and is looked at no further.
    * ``element``, ``attribute``, ``address``, ``todo``: what the format does not allow; ``media``: no resource has the hash;
      ``type``: one has, of another type.

    A null note has no content and faults of what is missing.  Rows are looked at where they are; nothing is shuffled.
    """
    whole = F.coalesce(F.col(note), F.lit(""))
    tag = r'<([A-Za-z][\w:-]*)((?:\s+[\w:-]+\s*=\s*(?:"[^"]*"|\'[^\']*\'))*)\s*/?>'
    n = notes.withColumn("_outer", F.regexp_replace(whole, r"(?s)<content>.*</content>", "")).withColumn("_content", F.regexp_replace(F.regexp_extract(whole, r"(?s)<content>\s*<!\[CDATA\[(.*)\]\]>\s*</content>", 1), r"\]\]\]\]><!\[CDATA\[>", "]]>"))
    n = n.withColumn("_body", F.when(F.contains("_content", F.lit("<en-note")), F.regexp_extract("_content", r"(?s)(<en-note.*)", 1)).otherwise(F.lit("")))
    parsed = F.from_xml("_body", "_bad string", {"columnNameOfCorruptRecord": "_bad"})
    n = n.withColumn("_broken", (F.col("_body") == "") | parsed["_bad"].isNotNull() | ~F.col("_body").rlike(r"(?:</en-note>|/>)\s*\z"))
    n = n.withColumn("_tags", F.when(~F.col("_broken"), F.arrays_zip(F.regexp_extract_all("_body", F.lit(tag), F.lit(1)).alias("name"), F.regexp_extract_all("_body", F.lit(tag), F.lit(2)).alias("said"))).otherwise(F.array().cast("array<struct<name:string,said:string>>")))
    n = n.withColumn("_resources", F.transform(_inner(F.col("_outer"), "resource"), lambda r: F.struct(
        F.md5(F.try_to_binary(F.get(_inner(r, "data"), F.lit(0)), F.lit("base64"))).alias("hash"), F.get(_inner(r, "mime"), F.lit(0)).alias("mime"), r.rlike('<data encoding="base64">').alias("coded"))))
    said = lambda s, name: F.regexp_extract(s, rf"""\s{name}\s*=\s*["']([^"']*)["']""", 1)
    of = lambda name: F.transform(F.filter("_tags", lambda t: t["name"] == name), lambda t: t["said"])
    n = n.withColumns({"_media": F.transform(of("en-media"), lambda s: F.struct(said(s, "hash").alias("hash"), said(s, "type").alias("mime"))), "_todos": of("en-todo")})
    attributes = F.flatten(F.transform("_tags", lambda t: F.regexp_extract_all(t["said"], F.lit(r"([\w:-]+)\s*="), F.lit(1))))
    addresses = F.flatten(F.transform("_tags", lambda t: F.regexp_extract_all(t["said"], F.lit(r"""\s(?:href|src)\s*=\s*["']([^"']*)["']"""), F.lit(1))))
    names = _inner(F.col("_outer"), "tag")
    title = F.coalesce(F.get(_inner(F.col("_outer"), "title"), F.lit(0)), F.lit(""))
    times = F.concat(_inner(F.col("_outer"), "created"), _inner(F.col("_outer"), "updated"))
    held = F.transform("_resources", lambda r: r["hash"])
    faults = {
        "title": (text.trim(title) == "") | (F.char_length(title) > 255) | (text.trim(title) != title) | F.contains(title, F.lit("\n")),
        "time": F.exists(times, lambda t: ~t.rlike(TIME)),
        "tags": F.exists(names, lambda t: (text.trim(t) == "") | (F.char_length(t) > 100) | F.contains(t, F.lit(","))) | (F.size(F.array_distinct(F.transform(names, text.lower))) < F.size(names)),
        "resource": F.exists("_resources", lambda r: ~r["coded"] | r["hash"].isNull() | (F.coalesce(r["mime"], F.lit("")) == "")),
        "unused": ~F.col("_broken") & F.exists(held, lambda h: ~F.array_contains(F.transform("_media", lambda m: m["hash"]), F.coalesce(h, F.lit("")))),
        "header": ~F.startswith("_content", F.lit(HEADER)), "doctype": ~F.contains("_content", F.lit(DOCTYPE)), "malformed": F.col("_broken"),
        "element": F.exists("_tags", lambda t: ~t["name"].isin(*ELEMENTS)), "attribute": F.exists(attributes, lambda a: a.isin(*BAD_ATTRIBUTES) | a.startswith("on")),
        "address": F.exists(addresses, lambda a: ~a.rlike(ADDRESS)), "todo": F.exists("_todos", lambda s: s.rlike(r"\schecked\s*=") & ~said(s, "checked").isin("true", "false")),
        "media": F.exists("_media", lambda m: ~F.coalesce(F.array_contains(held, m["hash"]), F.lit(False))),
        "type": F.exists("_media", lambda m: F.exists("_resources", lambda r: (r["hash"] == m["hash"]) & (F.coalesce(r["mime"], F.lit("")) != m["mime"]))),
    }
    found = F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in faults.items()))))
    out = n.withColumns({"resources": F.size("_resources"), "media": F.size("_media"), "todos": F.size("_todos"), "faults": found})
    return out.drop("_outer", "_content", "_body", "_broken", "_tags", "_resources", "_media", "_todos")
