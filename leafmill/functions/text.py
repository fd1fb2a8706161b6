"""Text functions as Column expressions: escapes, names, links.  No Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"

#: Fixed: characters that Markdown gives a meaning.
MARKDOWN = r"([\\`*_\[\]<>|~$])"
#: Fixed: device names that no file may have.
DEVICES = r"^(?i:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|\z)"


def lower(s: Column) -> Column:
    """ASCII only: ``F.lower`` would make more names equal."""
    return F.translate(s, UPPER, LOWER)


def upper(s: Column) -> Column:
    return F.translate(s, LOWER, UPPER)


def trim(s: Column) -> Column:
    """Six kinds of white space; ``F.trim`` knows the space alone."""
    return F.btrim(s, F.lit(BLANKS))


def fallback(s: Column, other: str) -> Column:
    """``other`` in place of a null or empty string."""
    return F.coalesce(F.when(s != "", s), F.lit(other))


# --------------------------------------------------------------------------- escapes


def html_escape(s: Column, quotes: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#39;")) if quotes else ())):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def md_escape(s: Column) -> Column:
    return F.regexp_replace(s, MARKDOWN, r"\\$1")


def vault_escape(s: Column) -> Column:
    """md_escape, and what vault notes read as tags, highlights and comments."""
    s = F.regexp_replace(md_escape(s), r"#(?=[A-Za-z0-9_\-/\\]|[^\x00-\x7F])", r"\\#")
    return F.replace(F.replace(s, F.lit("=="), F.lit(r"\=\=")), F.lit("%%"), F.lit(r"\%\%"))


def escape_line_start(s: Column) -> Column:
    """Keep a line from being read as a heading, a list item or a rule."""
    marked = s.rlike(r"(?s)^(?:#{1,6}|[-+])(?: .*)?\z|^(?:-+|=+)\z")
    return F.when(marked, F.concat(F.lit("\\"), s)).otherwise(F.regexp_replace(s, r"^([0-9]{1,9})([.)])(?= |\z)", r"$1\\$2"))


def xml_clean(s: Column) -> Column:
    """Without characters that XML 1.0 forbids, and without U+FDD0 to U+FDEF."""
    return F.regexp_replace(s, r"[^\t\n\r\x{20}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def xml_escape(s: Column) -> Column:
    return html_escape(xml_clean(s), quotes=True)


def yaml_string(s: Column) -> Column:
    s = F.replace(F.regexp_replace(s, r'(["\\])', r"\\$1"), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), s, F.lit('"'))


def md_url(s: Column) -> Column:
    """A link's target: in angle brackets where it holds blanks or brackets."""
    inner = F.replace(F.replace(s, F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))
    return F.when(s.rlike(r"[ ()<>]"), F.concat(F.lit("<"), inner, F.lit(">"))).otherwise(s)


def wikilink(target: Column, label: Column, in_table: bool = False, embed: bool = False) -> Column:
    text = trim(F.replace(F.regexp_replace(label, r"[\[\]\n\r]", ""), F.lit("|"), F.lit("-")))
    shown = F.when((text != "") & (text != target), F.concat(F.lit("\\|" if in_table else "|"), text)).otherwise(F.lit(""))
    return F.concat(F.lit("![[" if embed else "[["), target, shown, F.lit("]]"))


# --------------------------------------------------------------------------- urls


def url_encode_path(s: Column) -> Column:
    """Percent escapes for all ASCII but unreserved characters and ``/``; other characters stay.  ``F.url_encode`` is for
    form fields: it writes ``+`` for a space and escapes ``/`` and all that is not ASCII."""
    coded = F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c.rlike(r"^[\x00-\x7F&&[^A-Za-z0-9\-_.~/]]\z"), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)), "")
    return F.when(s.rlike(r"[\x00-\x7F&&[^A-Za-z0-9\-_.~/]]"), coded).otherwise(s)


def url_decode(s: Column) -> Column:
    """Percent escapes to bytes; ``+`` and malformed escapes stay.  The bytes are put together in hexadecimal, since one
    character may be escaped in several parts."""
    parts = F.regexp_extract_all(s, F.lit(r"(?s)%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    coded = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^%[0-9A-Fa-f]{2}\z"), F.substring(p, 2, 2)).otherwise(F.hex(p))), "")
    return F.when(s.contains("%"), F.unhex(coded).cast("string")).otherwise(s)


def link_parameter(href: Column, name: str) -> Column:
    """A braced, upper-cased id out of a link's parameters; empty without it."""
    value = upper(url_decode(F.regexp_extract(href, rf"(?i){name}=([^&]*)", 1)))
    return F.when((value != "") & ~value.startswith("{"), F.concat(F.lit("{"), value, F.lit("}"))).otherwise(value)


def allowed_url(s: Column) -> Column:
    """The address where its scheme may stand in a note, else null."""
    t = trim(s)
    return F.when(t.rlike(r"^(?i:https?|mailto|ftp|tel|file):"), t)


def relative_path(from_dir: Column, to: Column) -> Column:
    """The way from a folder to a file, both below the same root; parts are divided by ``/``."""
    a, b = F.filter(F.split(from_dir, "/"), lambda x: x != ""), F.filter(F.split(to, "/"), lambda x: x != "")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(a), F.size(b) - 1))), lambda i: (i <= F.least(F.size(a), F.size(b) - 1)) & (F.slice(a, 1, i) == F.slice(b, 1, i))))
    return F.concat(F.repeat(F.lit("../"), F.size(a) - shared), F.array_join(F.slice(b, shared + 1, F.size(b)), "/"))


# --------------------------------------------------------------------------- names


def once(s: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it; as a plain expression it would be, each time."""
    return F.get(F.transform(F.array(s), f), F.lit(0))


def cut_bytes(s: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` bytes in UTF-8 that ends with a whole character."""

    def cut(s: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda i: F.octet_length(F.left(s, i)) <= most)
        return F.when(F.octet_length(s) > most, F.left(s, F.array_max(fits))).otherwise(s)

    return once(s, cut)


def file_name(s: Column, most: int = 120) -> Column:
    """A name that all common file systems take."""
    s = F.regexp_replace(s, r"[\x00-\x1F\x7F\x{FDD0}-\x{FDEF}]", "")
    s = F.regexp_replace(F.regexp_replace(s, r'[<>:"/\\|?*]', "_"), r"[ \t]+", " ")
    s = F.regexp_replace(F.regexp_replace(trim(s), r"[. ]+\z", ""), r"^\.+", "")
    s = once(s, lambda s: F.when(F.octet_length(s) > most, trim(cut_bytes(s, most))).otherwise(s))
    s = once(s, lambda s: F.when(s.rlike(DEVICES), F.concat(F.lit("_"), s)).otherwise(s))
    return once(s, lambda s: fallback(s, "untitled"))


def vault_name(s: Column) -> Column:
    """Without what a wiki link gives a meaning."""
    return F.replace(F.translate(s, "#^[]|", "_____"), F.lit("%%"), F.lit("%"))


def tag_slug(s: Column) -> Column:
    slug = F.btrim(F.regexp_replace(lower(s), r"[\x00-\x7F&&[^A-Za-z0-9_]]+", "-"), F.lit("-"))
    return F.when(slug.rlike(r"^[0-9\-]+\z"), F.concat(F.lit("tag-"), slug)).otherwise(slug)


def stem(s: Column) -> Column:
    return F.regexp_replace(s, r"\.[^.]*\z", "")


def extension(s: Column) -> Column:
    """Lower-cased, without the dot; empty without one."""
    return lower(F.regexp_extract(s, r"\.([^./\\]*)\z", 1))


def generic_image_name(s: Column) -> Column:
    return lower(trim(s)).rlike(r"^(?:|image|image\..*|untitled picture.*)\z")


def base64_lines(b: Column) -> Column:
    """Base64 in lines of 76, each with a line feed, as mail has it."""
    plain = F.regexp_replace(F.base64(b), r"[\r\n]", "")
    return F.regexp_replace(plain, r"(.{1,76})", "$1\n")
