"""Objects with typed property bags, as flat tables: lookup, dereference, id tables, parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: the low bits of a property's id that tell its meaning; the bits above tell its type.
MEANING, TYPE_SHIFT, TYPE_MASK = 0x03FFFFFF, 26, 31


def property_type(prop_id: Column) -> Column:
    return F.shiftright(prop_id, TYPE_SHIFT).bitwiseAND(TYPE_MASK)


def typed_properties(props: DataFrame, keys: list[str], wanted: dict[str, tuple[int, str]], prop_id: str = "prop_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """One row an object with a column for each wanted property, (meaning, type): the first by position that has the meaning,
    null where none has or where its value is not of the type.  One aggregation, however many properties."""
    meaning = F.col(prop_id).bitwiseAND(MEANING)
    columns = [F.min_by(F.when(meaning == m, F.col(value)), F.when(meaning == m, F.col(pos))).try_cast(kind).alias(name) for name, (m, kind) in wanted.items()]
    return props.groupBy(*keys).agg(*columns)


def dereferenced(parents: DataFrame, references: str, objects: DataFrame, object_id: str) -> DataFrame:
    """A row for each reference to an object that exists, with ``place`` in the list; nil references and missing objects go, the
    places of the others stay."""
    each = parents.select("*", F.posexplode(references).alias("place", "_ref")).drop(references).filter(F.col("_ref").isNotNull())
    return each.join(objects, F.col("_ref") == F.col(object_id)).drop("_ref")


def id_table(own: DataFrame, copies: DataFrame, parent: DataFrame) -> DataFrame:
    """(revision, index, guid): a revision's id table out of its own entries and ranges copied from its parent's.

    own: (revision, index, guid); copies: (revision, index, source, count): ``count`` entries of the parent table from ``source`` on, to
    ``index`` on; parent: (revision, index, guid) of the table copied from.  Own entries win.
    """
    each = copies.filter("count > 0").select("revision", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("k"), "index", "source")
    copied = each.select("revision", (F.col("index") + F.col("k")).alias("index"), (F.col("source") + F.col("k")).alias("from"))
    found = copied.join(parent.select("revision", F.col("index").alias("from"), "guid"), ["revision", "from"]).select("revision", "index", "guid", F.lit(1).alias("rank"))
    every = own.select("revision", "index", "guid", F.lit(0).alias("rank")).unionByName(found)
    return every.groupBy("revision", "index").agg(F.min_by("guid", "rank").alias("guid"))


def parts(declared: DataFrame, data: DataFrame, keys: list[str], pos: str, part: str, kinds: dict[int, str], value: str) -> DataFrame:
    """Declarations joined with data by position, and an object's parts side by side, a column for each kind."""
    rows = declared.join(data, [*keys, pos])
    return rows.groupBy(*keys).agg(*(F.max(F.when(F.col(part) == k, F.col(value))).alias(name) for k, name in kinds.items()))
