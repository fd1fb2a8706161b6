"""Runs of stored text: a paragraph's text cut at stored offsets, and the hyperlinks that its runs spell out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: what begins a hyperlink's field code; the address follows, up to a quote.
MARKER = '﷟HYPERLINK "'
#: Fixed: stands for half of a character.
REPLACEMENT = "�"


def utf16(text: Column) -> Column:
    return F.encode(text, "UTF-16BE")


def utf16_cut(units: Column, start: Column, end: Column) -> Column:
    """The text between two offsets in UTF-16 units; half a surrogate pair, at either edge, becomes U+FFFD.  The text is whole
    elsewhere, so only the edges can part a pair."""
    piece = F.substring(units, (start * 2 + 1).cast("int"), ((end - start) * 2).cast("int"))
    high = lambda at, byte: F.hex(F.substring(piece, at, 1)).rlike(byte)
    size = F.octet_length(piece)
    first = (size > 0) & high(F.lit(1), "^D[C-F]")
    last = (size > 0) & high((size - 1).cast("int"), "^D[89AB]")
    inner = F.substring(piece, F.when(first, 3).otherwise(1), (size - F.when(first, 2).otherwise(0) - F.when(last, 2).otherwise(0)).cast("int"))
    mark = lambda c: F.when(c, F.lit(REPLACEMENT)).otherwise(F.lit(""))
    return F.concat(mark(first), F.decode(inner, "UTF-16BE"), mark(last))


def split_runs(paragraphs: DataFrame, styles: DataFrame, element: str, pos: str, text: str = "text", ends: str = "ends") -> DataFrame:
    """(element, run, start, end, text, and the styles' other columns): the text of each run of a paragraph.

    paragraphs: (element, text, ends), ends an array of offsets in UTF-16 units, where runs end; styles: a row (element, pos,
    ...) for each run, in the order of pos.  An end is never before the one of an earlier run, nor past the text; a run without
    an end goes on to the text's end.  A paragraph without styles is one run, whose style columns are null.

    A text that begins with a vertical tab and has 1 as its first end, and as many styles as ends or one more, was shifted:
    the tab and that end go, the other ends fall by one (an end of 0 by this means none), and of one style more the last goes.

    A null text is empty, null ends are none, and an end that is null or negative is past the text.  Styles of elements that are no paragraph are left out.
    Extra columns of paragraphs are ignored.  Texts are joined and cut once, as arrays of runs; what is windowed and shuffled
    more are the ends alone, so a paragraph of very many runs costs time in their number.
    """
    p = paragraphs.select(F.col(element), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(ends).cast("array<long>"), F.array().cast("array<long>")).alias("_ends"))
    about = p.select(element, F.expr("octet_length(encode(_text, 'UTF-16BE')) div 2").alias("_units"), F.size("_ends").alias("_n_ends"), F.startswith("_text", F.lit("\x0b")).alias("_tab"), F.get("_ends", F.lit(0)).alias("_first"))
    own = [c for c in styles.columns if c not in (element, pos)]
    over = Window.partitionBy(element)
    numbered = styles.select(element, F.struct(*own).alias("_style") if own else F.lit(None).cast("string").alias("_style"), (F.row_number().over(over.orderBy(pos)) - 1).alias("_i"), F.count(F.lit(1)).over(over).alias("_n"))
    shifted = F.col("_tab") & (F.coalesce("_first", F.lit(0)) == 1) & (F.col("_n") - F.col("_n_ends")).isin(0, 1)
    known = numbered.join(about, element).withColumn("_shift", shifted.cast("int")).withColumn("_units", F.col("_units") - F.col("_shift"))
    known = known.filter((F.col("_shift") == 0) | (F.col("_n") == F.col("_n_ends")) | (F.col("_i") < F.col("_n") - 1)).withColumn("_at", F.col("_i") + F.col("_shift"))
    each = p.select(element, F.posexplode("_ends").alias("_at", "_end"))
    said = F.col("_end") - F.col("_shift")
    found = known.join(each, [element, "_at"], "left").withColumn("_end", F.when((said >= 0) & (said < F.col("_units")), said).otherwise(F.col("_units")))
    ordered = over.orderBy("_i")
    found = found.withColumn("_end", F.max("_end").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.withColumn("_start", F.lag("_end", 1, 0).over(ordered))
    per = found.groupBy(element).agg(F.max("_shift").alias("_shift"), F.array_sort(F.collect_list(F.struct(F.col("_i").alias("run"), F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_style").alias("style")))).alias("_runs"))
    if not own:
        per = per.withColumn("_runs", F.transform("_runs", lambda r: F.struct(r["run"].alias("run"), r["start"].alias("start"), r["end"].alias("end"))))
    joined = p.join(per, element, "left").select(element, utf16(F.substr("_text", F.coalesce("_shift", F.lit(0)) + 1)).alias("_units"), "_runs")
    whole = F.array(F.struct(F.lit(0).alias("run"), F.lit(0).cast("long").alias("start"), (F.octet_length("_units") / 2).cast("long").alias("end"), *([F.lit(None).cast(found.schema["_style"].dataType).alias("style")] if own else [])))
    runs = F.coalesce(F.col("_runs").cast(_array_of(own, found)), whole.cast(_array_of(own, found)))
    # The units are the variable of a function of their own, so that they are worked out once, not for each run.
    cut = F.flatten(F.transform(F.array("_units"), lambda u: F.transform(runs, lambda r: F.struct(r.alias("r"), utf16_cut(u, r["start"], r["end"]).alias("text")))))
    rows = joined.select(element, F.explode(cut).alias("_cut"))
    return rows.select(element, "_cut.r.run", "_cut.r.start", "_cut.r.end", "_cut.text", *(F.col(f"_cut.r.style.{c}").alias(c) for c in own))


def _array_of(own: list[str], found: DataFrame) -> str:
    style = f",style:{found.schema['_style'].dataType.simpleString()}" if own else ""
    return f"array<struct<run:int,start:bigint,end:bigint{style}>>"


def hyperlinks(runs: DataFrame, element: str, pos: str) -> DataFrame:
    """Runs that show, with ``part`` and ``href`` (empty: none); of the columns text, hidden and hyperlink, hidden goes.

    Hidden runs spell field codes, over as many runs as they like: the address that their last marker names, up to a quote or
    the end, becomes pending at the next run that shows.  A code in a run that shows, if its quote closes, is cut out of it: what
    is before it keeps the address that was pending, what is after it has the new one.  A run of a hyperlink's style has the
    pending address; a run without that style has none at its end, and ends the link for all that follow.  Parts without text
    are left out; what is neither text nor hidden (``kind``, if there is such a column) passes by and changes nothing.

    A null text is empty, null flags are false.  Extra columns stay.  Windows of an element's runs; no loop over them.
    """
    is_text = (F.col("kind") == "text") if "kind" in runs.columns else F.lit(True)
    r = runs.withColumns({"text": F.coalesce("text", F.lit("")), "hidden": F.coalesce("hidden", F.lit(False)), "hyperlink": F.coalesce("hyperlink", F.lit(False)), "_is_text": F.coalesce(is_text, F.lit(False))})
    seen = F.col("_is_text") & ~F.col("hidden")
    over = Window.partitionBy(element).orderBy(pos)
    so_far, before = over.rowsBetween(Window.unboundedPreceding, 0), over.rowsBetween(Window.unboundedPreceding, -1)
    # A run that shows is in the island of the hidden runs before it.
    r = r.withColumn("_n", F.coalesce(F.sum(F.when(seen, 1).otherwise(0)).over(before), F.lit(0)))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_is_text") & F.col("hidden"), F.struct(F.col(pos).alias("p"), F.col("text").alias("t")))).over(Window.partitionBy(element, "_n"))), lambda x: x["t"]), "")
    r = r.withColumn("_code", F.when(seen, code)).filter(~F.col("_is_text") | ~F.col("hidden"))
    link = rf'{MARKER}([^"]*)'
    r = r.withColumn("_hidden_set", F.when(F.contains("_code", F.lit(MARKER)), F.regexp_extract("_code", f"(?s).*{link}", 1)))
    r = r.withColumn("_urls", F.when(F.col("_is_text"), F.regexp_extract_all("text", F.lit(link + '"'), F.lit(1))).otherwise(F.array().cast("array<string>")))
    r = r.withColumn("_parts", F.when(F.size("_urls") > 0, F.split("text", link + '"', -1)).otherwise(F.array("text")))
    # The address at the run's end, if the run says one; the number of shown runs is the place.
    said = F.when(F.size("_urls") > 0, F.get("_urls", F.size("_urls") - 1)).otherwise(F.col("_hidden_set"))
    r = r.withColumn("_said", said).withColumn("_last_said", F.last("_said", ignorenulls=True).over(before))
    place = lambda c: F.max(F.when(c, F.col("_n"))).over(before)
    r = r.withColumn("_said_at", F.coalesce(place(F.col("_said").isNotNull()), F.lit(-1))).withColumn("_ended_at", F.coalesce(place(F.col("_is_text") & ~F.col("hyperlink")), F.lit(-1)))
    pending = F.coalesce(F.col("_hidden_set"), F.when(F.col("_said_at") > F.col("_ended_at"), F.col("_last_said")))
    r = r.withColumn("_pending", pending)
    out = r.select("*", F.posexplode("_parts").alias("part", "_part"))
    of_part = F.when(F.col("part") == 0, F.col("_pending")).otherwise(F.get("_urls", F.col("part") - 1))
    last = F.col("part") == F.size("_urls")
    href = F.when(F.col("_is_text") & (~last | F.col("hyperlink")), of_part)
    out = out.withColumn("href", F.coalesce(href, F.lit(""))).withColumn("text", F.col("_part")).filter(~F.col("_is_text") | (F.col("text") != ""))
    return out.drop("hidden", *(c for c in out.columns if c in ("_is_text", "_n", "_code", "_hidden_set", "_urls", "_parts", "_said", "_last_said", "_said_at", "_ended_at", "_pending", "_part")))
