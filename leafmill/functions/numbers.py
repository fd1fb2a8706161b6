"""Times, colours, units and bit fields as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: 100 ns units from 1601 to 1970; seconds from 1970 to 1980; the last second of year 9999.
FILETIME_EPOCH, TIME32_EPOCH, LAST_SECOND = 116444736000000000, 315532800, 253402300799
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), ISO)


def filetime_iso(ft: Column) -> Column:
    """100 ns units since 1601 in UTC (the session's time zone must be UTC); empty before 1970, after 9999 and for 0."""
    seconds = F.floor((ft - FILETIME_EPOCH) / F.lit(10_000_000).cast("decimal(20,0)")).cast("long")
    return F.when((ft < FILETIME_EPOCH) | (seconds > LAST_SECOND), F.lit("")).otherwise(_iso(F.least(F.greatest(seconds, F.lit(0)), F.lit(LAST_SECOND))))


def time32_iso(t: Column) -> Column:
    return F.when(t == 0, F.lit("")).otherwise(_iso(t + TIME32_EPOCH))


def compact_time(iso: Column) -> Column:
    """yyyymmddThhmmssZ; empty for what has not that length."""
    short = F.regexp_replace(iso, "[-:]", "")
    return F.when(F.char_length(short) == 16, short).otherwise(F.lit(""))


def color_hex(colorref: Column) -> Column:
    """#rrggbb of 0x00bbggrr; null for automatic colours (a highest byte other than 0)."""
    byte = lambda shift: F.shiftright(colorref, shift).bitwiseAND(255)
    return F.when(byte(24) == 0, F.format_string("#%02x%02x%02x", byte(0), byte(8), byte(16)))


def half_inch_px(x: Column) -> Column:
    return F.round(x * 48).cast("long")


def himetric_px(x: Column) -> Column:
    return x * 96.0 / 2540.0


def guid_text(raw: Column) -> Column:
    """Canonical text of 16 bytes, the first three parts little-endian."""
    h = F.lower(F.hex(raw))
    pair = lambda *at: F.concat(*(F.substring(h, 2 * i + 1, 2) for i in at))
    return F.concat_ws("-", pair(3, 2, 1, 0), pair(5, 4), pair(7, 6), pair(8, 9), pair(10, 11, 12, 13, 14, 15))


def image_type(raw: Column) -> Column:
    """Extension by the first bytes; empty for what is none of the known kinds."""
    h = F.hex(F.substring(raw, 1, 512))
    kinds = {"89504E470D0A1A0A": "png", "FFD8FF": "jpg", "47494638": "gif", "424D": "bmp", "49492A00": "tif", "4D4D002A": "tif", "D7CDC69A": "wmf", "25504446": "pdf"}
    out = F.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp").when(h.startswith("01000000") & (F.substring(h, 81, 8) == "20454D46"), "emf")
    for magic, kind in kinds.items():
        out = out.when(h.startswith(magic), kind)
    return out.when(F.substring(raw, 1, 512).cast("string").rlike(r"^\s*(?:<\?xml[^>]*\?>\s*)?(?:<!--.*?-->\s*)?<svg"), "svg").otherwise("")
