"""Secret scan: fixed patterns, and strings of high entropy.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import documents

#: Fixed patterns, in the order in which spans of one start are listed.  The bounds on length in "access" and "hex" are those
#: of the whole runs, so they find what the open patterns find with short matches dropped.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
LEAST_VALUE = 6

#: Candidates for the entropy test: runs of these characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits in a window of 20 from which a class of strings counts as random; the most is log2(16) for the first, log2(20) for others.
#: Strings without digits may be words, so they must look more random.
CLASSES = {
    r"^[0-9A-Fa-f]+$": 3.15, r"^[0-9a-z]*[0-9][0-9a-z]*$": 3.55, r"[0-9]": 3.75, r"^[A-Z]?[a-z]+$": 3.65, r"^[A-Z]+$": 3.65, r"^.*$": 3.95,
}
#: Strings that look random but are no secrets: UUIDs, digests named as such, dates and versions.
ALLOW = (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"(?i)^(sha1|sha224|sha256|sha384|sha512|md5)[-=_]", r"^[0-9_=+/-]+$")
#: Words that hold a secret's place, in either case, one after the other: no window that one of them touches counts as random.
HOLDERS = (
    "example", "placeholder", "xxxx", "changeme", *(f"your{dash}{what}" for dash in ("", "-", "_") for what in ("key", "token", "secret")), "abcdefghij", "0123456789",
)
#: Characters of a candidate that are folded at once; pieces overlap by a window less one.
PIECE = 256


def masked(candidate: Column) -> Column:
    """A candidate with blanks, which none has, in the place of HOLDERS."""
    for word in HOLDERS:
        candidate = F.regexp_replace(candidate, f"(?i){word}", " " * len(word))
    return candidate


def _high_windows(piece: Column, least: Column) -> Column:
    """struct<first, last>: the first place and the place after the last of all windows of a piece that reach ``least`` bits.

    A window's entropy is log2(w) - sum(c log2 c) / w over its counts c.  The fold holds the last 20 characters and that sum; a
    step to the right changes the sum only through the counts of the character that comes in and the one that goes out.
    """
    f = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    count = lambda held, c: F.char_length(held) - F.char_length(F.replace(held, c, F.lit("")))
    none = F.lit(None).cast("int")
    start = F.struct(F.lit("").alias("held"), F.lit(0.0).alias("sum"), F.lit(0).alias("end"), none.alias("first"), none.alias("last"))

    def come(state: Column, c: Column) -> Column:
        here = count(state["held"], c)
        return F.struct(F.concat(state["held"], c).alias("held"), (state["sum"] + f(here + 1) - f(here)).alias("sum"), (state["end"] + 1).alias("end"), state["first"].alias("first"), state["last"].alias("last"))

    def go(state: Column) -> Column:
        full = state["end"] > WINDOW
        there = count(state["held"], F.left(state["held"], F.lit(1)))
        return F.struct(
            F.when(full, F.substring(state["held"], 2, WINDOW)).otherwise(state["held"]).alias("held"), F.when(full, state["sum"] + f(there - 1) - f(there)).otherwise(state["sum"]).alias("sum"),
            state["end"].alias("end"), state["first"].alias("first"), state["last"].alias("last"),
        )

    def judge(state: Column) -> Column:
        high = (state["end"] >= WINDOW) & (F.lit(math.log2(WINDOW)) - state["sum"] / WINDOW >= least) & ~F.contains(state["held"], F.lit(" "))
        return F.struct(
            state["held"].alias("held"), state["sum"].alias("sum"), state["end"].alias("end"),
            F.coalesce(state["first"], F.when(high, state["end"] - WINDOW)).alias("first"), F.when(high, state["end"]).otherwise(state["last"]).alias("last"),
        )

    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  a value that is worked out once
    return F.aggregate(F.split(piece, ""), start, lambda state, c: bound(bound(come(state, c), go), judge), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _entropy_span(candidate: Column, least: Column) -> Column:
    """struct<first, last> of a candidate: from the first to the last of its random windows.  It is folded in pieces, so that
    time grows with its length alone; each piece begins with the end of the one before.

    What is worked out from the whole candidate is an element of an array of one, and so a function's variable inside: as a
    column, the optimiser would put it into the fold, to be worked out again at each step."""
    once = F.struct(F.regexp_extract_all(masked(candidate), F.lit(f".{{1,{PIECE}}}"), F.lit(0)).alias("parts"), least.alias("least"))

    def pieces(of: Column) -> Column:
        parts = of["parts"]

        def one(part: Column, i: Column) -> Column:
            found = _high_windows(F.concat(F.coalesce(F.right(F.get(parts, i - 1), F.lit(WINDOW - 1)), F.lit("")), part), of["least"])
            at = F.when(i > 0, i * PIECE - (WINDOW - 1)).otherwise(0)
            return F.transform(F.array(found), lambda s: F.struct((s["first"] + at).alias("first"), (s["last"] + at).alias("last")))

        return F.flatten(F.transform(parts, one))

    whole = F.flatten(F.transform(F.array(once), pieces))
    return F.get(F.transform(F.array(whole), lambda s: F.struct(F.array_min(F.transform(s, lambda x: x["first"])).alias("first"), F.array_max(F.transform(s, lambda x: x["last"])).alias("last"))), F.lit(0))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of likely secrets in each whole text.

    Returns doc_id and spans, array<struct<begin, kind, end, name>> in code points (end exclusive), ordered by begin, then kind
    (its place in the list assign, access, hex, entropy); a row for each input row.

    * A null or empty text has none.  Rows that repeat, null doc_ids too, each have their own spans.
    * Each kind is matched from the left without overlap; spans of different kinds may overlap.
    * Other columns are ignored; an empty table gives an empty one.

    Places come from running sums over the lengths of the pieces between matches, a row a match, so that a text with very
    many matches takes time in their number.  Only matches are shuffled, and texts nowhere.
    """
    d = documents(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    patterns = [*PATTERNS.items(), ("entropy", CANDIDATE)]

    def matched(kind: str, pattern: str) -> Column:
        text = F.col("text")
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        matches = F.arrays_zip(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), value.alias("value"))
        place = list(dict(patterns)).index(kind)
        return F.when(text.rlike(pattern), F.struct(F.lit(place).alias("kind"), matches.alias("matches")))

    each = d.select("doc_id", "text_hash", F.explode(F.array_compact(F.array(*(matched(*p) for p in patterns)))).alias("of"))
    rows = each.select("doc_id", "text_hash", "of.kind", F.posexplode("of.matches").alias("n", "m")).filter("m.match IS NOT NULL")
    rows = rows.select("doc_id", "text_hash", "kind", "n", F.char_length("m.between").alias("before"), F.char_length("m.match").alias("length"), F.when(F.col("kind") == len(PATTERNS), F.col("m.value")).alias("candidate"), F.char_length("m.value").alias("value_length"))
    rows = rows.dropDuplicates(["doc_id", "text_hash", "kind", "n"])
    so_far = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("before") + F.col("length")).over(so_far)).withColumn("begin", F.col("end") - F.col("length"))

    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | F.col("candidate").rlike(pattern)
    least = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES.items()):
        least = F.when(F.col("candidate").rlike(pattern), F.lit(bits)).otherwise(least)
    # One branch for all kinds: the text is looked through once.
    wanted = F.when(F.col("kind") == len(PATTERNS), ~allowed).otherwise((F.col("kind") > 0) | (F.col("value_length") >= LEAST_VALUE))
    judged = placed.filter(wanted).withColumn("s", F.when(F.col("kind") == len(PATTERNS), _entropy_span(F.col("candidate"), least)))
    judged = judged.filter((F.col("kind") < len(PATTERNS)) | F.col("s.first").isNotNull())
    begin, end = (F.col("begin") + F.coalesce("s.first", F.lit(0))), F.coalesce(F.col("begin") + F.col("s.last"), F.col("end"))
    found = judged.select("doc_id", "text_hash", "kind", begin.alias("begin"), end.alias("end"))
    name = F.element_at(F.array(*(F.lit(k) for k, _ in patterns)), F.col("kind") + 1)
    per = found.groupBy(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash")).agg(F.array_sort(F.collect_list(F.struct("begin", "kind", "end", name.alias("name")))).alias("spans"))
    none = F.array().cast("array<struct<begin:bigint,kind:int,end:bigint,name:string>>")
    joined = d.select("doc_id", "text_hash").join(per, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_hash") == F.col("span_hash")), "left")
    return joined.select("doc_id", F.coalesce(F.col("spans").cast("array<struct<begin:bigint,kind:int,end:bigint,name:string>>"), none).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Texts (doc_id, text) with each secret replaced; spans that overlap or touch are one.  doc_ids must be unique."""
    s = F.col("spans")
    merged = F.aggregate(
        s, F.array().cast("array<struct<begin:bigint,end:bigint>>"),
        lambda out, x: F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] >= x["begin"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.get(out, F.size(out) - 1)["begin"].alias("begin"), F.greatest(F.get(out, F.size(out) - 1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(out, F.array(F.struct(x["begin"].alias("begin"), x["end"].alias("end"))))),
    )
    rows = documents(docs).join(secret_spans(docs), "doc_id").withColumn("spans", merged)
    begin = lambda i: F.coalesce(F.get(s, i - 1)["end"], F.lit(0))
    end = lambda i: F.coalesce(F.get(s, i)["begin"], F.char_length("text").cast("long"))
    pieces = F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.substring(F.col("text"), (begin(i) + 1).cast("int"), (end(i) - begin(i)).cast("int")))
    return rows.select("doc_id", F.array_join(pieces, mark).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and one-line forms of secret_spans()."""
    said = lambda s: F.concat_ws(":", s["name"], s["begin"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] < len(PATTERNS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["name"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in PATTERNS), F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"))
