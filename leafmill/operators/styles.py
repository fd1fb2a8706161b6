"""What objects of styles, lists and paragraphs say: flags and fonts of runs, bullets, colours that show, kinds of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text

FLAGS = ("bold", "italic", "underline", "strike", "superscript", "subscript", "hidden", "hyperlink", "math", "embedded")
PROPERTIES = (*FLAGS, "font", "size", "color", "highlight")


def style(prefix: str = "") -> Column:
    """A style as a struct, from columns of its properties: flags are false, the font empty, the size 0 and colours null where unset."""
    at = lambda c: F.col(prefix + c)
    return F.struct(
        *(F.coalesce(at(f).cast("boolean"), F.lit(False)).alias(f) for f in FLAGS), F.coalesce(at("font"), F.lit("")).alias("font"), F.coalesce(at("size").cast("int"), F.lit(0)).alias("size"),
        at("color").alias("color"), at("highlight").alias("highlight"),
    )


def with_styles(runs: DataFrame, styles: DataFrame, own: str, base: str) -> DataFrame:
    """``style`` of each run and ``base`` of its paragraph, by the style objects they point to; without one, or where it is missing,
    all is unset.  styles: (style, properties as in ``style``), a row a style."""
    for key, name in ((own, "style"), (base, "base")):
        held = styles.select(F.col("style").alias("_key"), *(F.col(c).alias(f"_{c}") for c in PROPERTIES))
        found = runs.withColumnRenamed(key, "_at").join(held, F.col("_at") == F.col("_key"), "left")
        runs = found.withColumn(f"_of_{name}", style("_")).drop("_at", "_key", *(f"_{c}" for c in PROPERTIES))
    return runs.withColumnsRenamed({"_of_style": "style", "_of_base": "base"})


def shown_colour(color: Column, page: str) -> Column:
    """A colour as #rrggbb text, or null where it is the page's own: a white highlight, or black letters."""
    return F.when(F.lower(color) != page, F.lower(color))


# --------------------------------------------------------------------------- lists

#: Fixed: what stands first in the format of a numbered list; styles of numbers go up to 4.
NUMBERED, NUMBER_STYLES = 0xFFFD, 4
#: Fixed: glyphs of a symbol font as characters; others of that font are U+25AA.
WINGDINGS = {0xA7: 0x25AA, 0xA8: 0x25FB, 0x77: 0x2B25, 0xD8: 0x27A2, 0xFC: 0x2714, 0x76: 0x2756}
BULLET, SQUARE, DIAMOND = 0x2022, 0x25AA, 0x25C6


def list_format(units: Column, font: Column) -> Column:
    """struct<ordered, number_style, bullet> from a list's format, as UTF-16 units behind its length, and its font.

    Bullets of symbol fonts become characters that any font has; private ones (U+F000 to U+F0FF), and a format without any unit, are
    a plain bullet; half a surrogate pair is U+FFFD.  A numbered list has an empty bullet.
    """
    first, second = F.coalesce(F.get(units, 0), F.lit(BULLET)), F.coalesce(F.get(units, 1), F.lit(0))
    ordered = first == NUMBERED
    of_font = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in WINGDINGS.items() for x in pair)), first), F.lit(SQUARE))
    name = F.coalesce(font, F.lit(""))
    code = F.when(name == "Wingdings", of_font).when((name == "Symbol") & (first == 0xB7), BULLET).when(name.isin("Wingdings 2", "Wingdings 3", "Symbol"), DIAMOND).otherwise(first)
    code = F.when(code.between(0xF000, 0xF0FF), BULLET).when(code.between(0xD800, 0xDFFF), 0xFFFD).otherwise(code)
    return F.struct(
        ordered.alias("ordered"), F.when(ordered & (second <= NUMBER_STYLES), second).otherwise(0).alias("number_style"),
        F.when(ordered, F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")).alias("bullet"),
    )


# --------------------------------------------------------------------------- elements


def paragraph_kinds(inlines: DataFrame, paragraph: str, tags: Column) -> DataFrame:
    """(paragraph, empty, display): empty without formula, ink, tag or letter; display where all its inlines are formulas or blank.

    inlines: (paragraph, kind, text), and ``tags``, how many tags the paragraph has.  One pass with map-side combining.
    """
    kind, blank = F.col("kind"), text.trim(F.coalesce("text", F.lit(""))) == ""
    said = kind.isin("math", "ink") | ((kind == "text") & ~blank)
    return inlines.groupBy(paragraph).agg((~F.bool_or(said) & (F.max(tags) == 0)).alias("empty"), F.bool_and((kind == "math") | ((kind == "text") & blank)).alias("display"))


def is_code(listed: Column, contents: Column) -> Column:
    """An element is code if it is in no list and its one content is a paragraph of that style; contents: array<struct<kind, style>>."""
    only = F.get(contents, 0)
    return ~listed & (F.size(contents) == 1) & (only["kind"] == "paragraph") & (F.coalesce(only["style"], F.lit("")) == "code")
