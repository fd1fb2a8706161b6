"""Revision stores as joins: current revisions of cells, payloads of file references, roots by role, ids.

Tables of a store grow with it, so how they are joined is Spark's choice by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_manifests(cells: DataFrame, current: DataFrame, revisions: DataFrame, manifests: DataFrame) -> DataFrame:
    """``manifest`` of each cell (cell, serial): its current revision's, else that of its own id, else the first of the same serial number.

    current: (cell, revision); revisions: (revision, manifest, serial); manifests: (manifest).  An id leads to the manifest
    that it is mapped to, or is a manifest's itself.  Null where nothing leads anywhere.
    """
    mapped = revisions.select(F.col("revision").alias("id"), F.col("manifest").alias("to"))
    own = manifests.select(F.col("manifest").alias("id"), F.col("manifest").alias("to")).join(mapped.select("id"), "id", "left_anti")
    leads = mapped.unionByName(own)
    by = lambda a: leads.select(F.col("id").alias(f"_{a}"), F.col("to").alias(f"_to_{a}"))
    serial = revisions.groupBy(F.col("serial").alias("_serial")).agg(F.min_by("manifest", "revision").alias("_to_serial"))
    found = cells.join(current.select(F.col("cell").alias("_cell"), F.col("revision").alias("_revision")), F.col("cell") == F.col("_cell"), "left")
    found = found.join(by("current"), F.col("_revision") == F.col("_current"), "left").join(by("own"), F.col("cell") == F.col("_own"), "left")
    found = found.join(serial, F.col("serial") == F.col("_serial"), "left")
    return found.select(*cells.columns, F.coalesce("_to_current", "_to_own", "_to_serial").alias("manifest"))


def file_payloads(references: DataFrame, embedded: DataFrame, external: DataFrame) -> DataFrame:
    """``payload`` and ``fault`` of each reference: <ifndf>id of an embedded payload, <file>name of a file, or <invfdo> for none.

    embedded, external: (key, payload).
    """
    ref = F.col("reference")
    key = lambda mark: F.when(ref.startswith(mark), F.substring(ref, len(mark) + 1, 1 << 30))
    e, x = (t.select(F.col("key").alias(f"_{n}"), F.col("payload").alias(f"_of_{n}")) for t, n in ((embedded, "embedded"), (external, "external")))
    found = references.join(e, key("<ifndf>") == F.col("_embedded"), "left").join(x, key("<file>") == F.col("_external"), "left")
    payload = F.coalesce("_of_embedded", "_of_external")
    fault = F.when(payload.isNotNull(), F.lit(None).cast("string")).when(ref.startswith("<ifndf>"), F.lit("not embedded")).when(ref.startswith("<file>"), F.lit("no file")).when(ref.startswith("<invfdo>"), F.lit("invalid")).otherwise(F.lit("unknown"))
    return found.select(*references.columns, payload.alias("payload"), fault.alias("fault"))


def roots(labels: DataFrame, role: int) -> DataFrame:
    """(space, root) by a role's label; of a space's labels for the role the last (by seq) wins."""
    return labels.filter(F.col("role") == role).groupBy("space").agg(F.max_by("root", "seq").alias("root"))


def resolved_ids(ids: DataFrame, table: DataFrame) -> DataFrame:
    """``guid`` of compact ids (revision, index) by their revision's table; those that it lacks are nil."""
    t = table.select(F.col("revision").alias("_r"), F.col("index").alias("_i"), F.col("guid").alias("_guid"))
    found = ids.join(t, (F.col("revision") == F.col("_r")) & (F.col("index") == F.col("_i")), "left")
    return found.withColumn("guid", F.coalesce("_guid", F.lit(0).cast(table.schema["guid"].dataType))).drop("_r", "_i", "_guid")


def spaces_of(references: DataFrame, spaces: DataFrame) -> DataFrame:
    """``space`` that each reference (a, b) means: that of the same two ids, else where either lacks the second (null) the first of the same first id."""
    s = spaces.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("space").alias("_exact"))
    per = spaces.groupBy(F.col("a").alias("_a1")).agg(F.min_by("space", F.struct(F.coalesce("b", F.lit(-1)))).alias("_any"), F.max(F.when(F.col("b").isNull(), F.col("space"))).alias("_open"))
    found = references.join(s, (F.col("a") == F.col("_a")) & F.col("b").eqNullSafe(F.col("_b")), "left").join(per, F.col("a") == F.col("_a1"), "left")
    return found.select(*references.columns, F.coalesce("_exact", "_open", F.when(F.col("b").isNull(), F.col("_any"))).alias("space"))
