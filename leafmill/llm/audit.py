"""Filter interaction audit: what each filter removes, in every order in which the filters could run."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialise, spread_join

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> list[Column]:
    """Whether a text fails filters A to D: few words, repeated words, capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals > 2 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, fails, n, good, toxic): for each part and combination of failed filters, its documents.  ``fails`` is an array of
    five booleans, A to E; E is failed by a text that a smaller doc_id has, in any part.

    Texts are looked at once, where they are read; what is shuffled are 96 bits of hash for each of them.  Copies are counted
    with map-side combining, and a text of very many copies is dealt to several places when its smallest doc_id is joined back.
    """
    text = F.col("text")
    parts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    seen = parts.select("doc_id", "part", F.array(*failures(text)).alias("own"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), F.octet_length(text).alias("h3"))
    seen = materialise(seen, "audit-seen")
    key = ["h1", "h2", "h3"]
    copies = seen.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("least_null")).filter("copies > 1")
    joined = spread_join(seen, materialise(copies, "audit-copies"), key, "copies", F.struct("doc_id", "part"), "left")
    copy = F.coalesce(F.col("doc_id").isNotNull() & (F.col("least_null") | (F.col("doc_id") > F.col("least"))), F.lit(False))
    marked = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    return (
        joined.select("doc_id", "part", F.concat("own", F.array(copy)).alias("fails"))
        .join(marked, "doc_id", "left")
        .groupBy("part", "fails")
        .agg(F.count(F.lit(1)).alias("n"), one("good").alias("good"), one("toxic").alias("toxic"))
    )


def _folded(orders: Column, credit: Column) -> Column:
    """The 600 weighted structs of one cell: a fold along each order carries whether the cell is gone, and each step adds what
    its filter does to the cell there."""
    n, zero, fails = F.col("n"), F.lit(0).cast("long"), F.col("fails")
    failed = lambda letter: F.get(fails, letter)
    alone = F.size(F.filter(fails, lambda f: f)) == 1
    none = F.array().cast(f"array<struct<{', '.join(f'{s}:bigint' for s in SUMS)}>>")

    def step(state: Column, letter: Column) -> Column:
        gone, hit = state["gone"], failed(letter)
        here = hit & ~gone
        cell = F.struct(
            F.when(gone | hit, zero).otherwise(n).alias("kept"), F.when(here, n).otherwise(zero).alias("removed"), F.when(hit & gone, n).otherwise(zero).alias("redundant"),
            F.when(hit & alone, n).otherwise(zero).alias("unique_fails"), F.when(here, F.col("good")).otherwise(zero).alias("good_lost"), F.when(here, F.col("toxic")).otherwise(zero).alias("toxic_lost"),
            F.get(credit, letter).alias("shapley"),
        )
        return F.struct((gone | hit).alias("gone"), F.concat(state["steps"], F.array(cell)).alias("steps"))

    along = lambda order: F.aggregate(order, F.struct(F.lit(False).alias("gone"), none.alias("steps")), step, lambda s: s["steps"])
    return F.flatten(F.transform(orders, along))


def _credit(orders: Column) -> Column:
    """For each letter, the cell's documents that it removes, over all orders: those in which it is the first failed filter."""
    first = lambda order: F.get(F.filter(order, lambda letter: F.get("fails", letter)), 0)
    return F.transform(F.sequence(F.lit(0), F.lit(len(LETTERS) - 1)), lambda k: F.aggregate(orders, F.lit(0).cast("long"), lambda s, o: s + F.when(first(o) == k, F.col("n")).otherwise(0)))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the five filters and step in it: part, filter_order, step, and the counts of SUMS.

    A: under 200 words; B: fewer than half of the words are distinct; C: over 2 % capitals; D: a symbol of ``#$%&*|``; E: the
    text of a smaller doc_id.  Counts are of the part's documents: kept after the step, removed by it, redundant (it would fail
    them, they are gone), failing this filter only, removed with label quality or toxic 1, and what the filter removes in all
    orders together.

    * A null text is empty, a null part the empty string.  An empty text fails A only (and E, if it is a copy).
    * Each row counts, repeated rows too; rows of one doc_id and text are no copies of each other.  A null doc_id is smaller
      than all others and no copy.  Labels of null doc_ids are ignored; of several labels of a doc_id the highest counts.
    * Very long texts are whole.  Other columns are ignored; an empty table gives an empty one.

    A part has 32 cells at most, so what the folds make is bounded by the number of parts, whatever the number of documents;
    the structs of the cells are summed by place, with map-side combining.
    """
    cells = masks(docs, labels, id_col, text_col, part_col)
    names = F.split(F.lit(" ".join(ORDERS)), " ")
    orders = F.transform(names, lambda o: F.transform(F.split(o, ""), lambda x: F.ascii(x) - ord(LETTERS[0])))  # a constant, which goes out with the plan
    # The credit is the variable of a function of its own: a column would be worked out again at each step.
    folded = F.flatten(F.transform(F.array(_credit(orders)), lambda credit: _folded(orders, credit)))
    structs = cells.select("part", F.posexplode(folded).alias("place", "cell"))
    summed = structs.select("part", "place", "cell.*").groupBy("part", "place").agg(*(F.sum(s).alias(s) for s in SUMS))
    step = (F.col("place") % len(LETTERS)).cast("int")
    order = F.get(names, F.floor(F.col("place") / len(LETTERS)).cast("int"))
    return summed.select("part", order.alias("filter_order"), (step + 1).alias("step"), *SUMS)
