"""Object spaces out of chains of revisions that only pointers state: what each cell holds, where newer revisions win.

Only keys and places go along the chains; values join once, when it is known which of them stand.  A null id leads nowhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.graph import checkpointed, gone, next_round

#: Fixed: the parts of an object in a group, and what a group's entry may hold.
DATA, FILE, META = 1, 2, 4
OBJECT, BLOB = "object", "blob"

#: Groups are worked on in so many slices by hash, one after the other: each shuffles its part of all entries, which bounds the disk.
SLICES = 4

#: Faults that leave a cell without objects.
FATAL = ("no manifest", "missing manifest", "missing group", "counts differ")


def role_labels(starts: DataFrame, declared: DataFrame) -> DataFrame:
    """(space, context, role, revision): the last label of each context and role, by seq.

    starts, declared: (space, seq, revision, context, role).  A revision's start labels it; a declaration labels one that has
    started before it, and is passed over otherwise.  A null context is the default one.
    """
    columns = ["space", "seq", "revision", "context", "role"]
    first = starts.groupBy(F.col("space").alias("_s"), F.col("revision").alias("_r")).agg(F.min("seq").alias("_first"))
    known = declared.join(first, (F.col("space") == F.col("_s")) & (F.col("revision") == F.col("_r")) & (F.col("_first") < F.col("seq")))
    every = starts.select(*columns).unionByName(known.select(*columns))
    return every.groupBy("space", "context", "role").agg(F.max_by("revision", "seq").alias("revision"))


def _bases(manifests: DataFrame) -> DataFrame:
    return manifests.filter("manifest IS NOT NULL").groupBy("manifest").agg(F.min("base").alias("base"))


def chains(heads: DataFrame, manifests: DataFrame) -> DataFrame:
    """(cell, manifest, rank): the manifests from each cell's newest, at 0, back through their bases.

    heads: (cell, manifest); manifests: (manifest, base), of rows with the same manifest the least base.  A base that no row
    describes ends the chain and is in it; so does one that the chain has already.  Pointers double: a chain of n takes
    log2(n) rounds, a row for each of its places.
    """
    jump = checkpointed(_bases(manifests).filter("base IS NOT NULL").select(F.col("manifest").alias("_from"), F.col("base").alias("_to")))
    known = checkpointed(heads.filter("manifest IS NOT NULL").select("cell", "manifest", F.lit(0).cast("long").alias("rank")).distinct())
    reach, rows = 1, known.count()
    while True:
        on = known.join(jump, F.col("manifest") == F.col("_from"))
        on = on.select("cell", F.col("_to").alias("manifest"), (F.col("rank") + reach).alias("rank"))
        known = next_round(known.unionByName(on).groupBy("cell", "manifest").agg(F.min("rank").alias("rank")), known)
        more = known.count()
        if more == rows:
            return known
        far = jump.alias("a").join(jump.alias("b"), F.col("a._to") == F.col("b._from"))
        jump, reach, rows = next_round(far.select(F.col("a._from").alias("_from"), F.col("b._to").alias("_to")), jump), reach * 2, more


def faults(heads: DataFrame, chain: DataFrame, manifests: DataFrame, groups: DataFrame, held: DataFrame, declared: DataFrame, data: DataFrame) -> DataFrame:
    """(cell, fault, id, rank): cells without a manifest, manifests and groups that are missing, chains that come back to
    themselves (id: the place they come from), groups with as many declarations as not data.

    groups: (manifest, pos, group); held: (group), the groups that there are; declared, data: with a row an entry of a group.
    """
    none = F.lit(None).cast(manifests.schema["manifest"].dataType)
    headless = heads.filter("manifest IS NULL").select("cell", F.lit("no manifest").alias("fault"), none.alias("id"), F.lit(0).cast("long").alias("rank"))
    known = _bases(manifests).select(F.col("manifest").alias("_m"), F.col("base").alias("_base"))
    at = chain.join(known, F.col("manifest") == F.col("_m"), "left")
    missing = at.filter("_m IS NULL").select("cell", F.lit("missing manifest").alias("fault"), F.col("manifest").alias("id"), "rank")
    last = at.groupBy("cell").agg(F.max_by(F.struct("manifest", "_base", "rank"), "rank").alias("_l")).select("cell", "_l.*")
    cycles = last.filter("_base IS NOT NULL").select("cell", F.lit("cycle").alias("fault"), F.col("manifest").alias("id"), "rank")
    count = lambda rows, n: rows.groupBy("group").agg(F.sum(F.lit(n)).alias("n"))
    uneven = count(declared, 1).unionByName(count(data, -1)).groupBy("group").agg(F.sum("n").alias("n")).filter("n <> 0").select("group", F.lit("counts differ").alias("fault"))
    used = groups.select("group").distinct()
    bad = used.join(held.select("group"), "group", "left_anti").select("group", F.lit("missing group").alias("fault")).unionByName(uneven.join(held.select("group"), "group", "left_semi"))
    in_groups = chain.join(groups, "manifest").join(bad, "group").groupBy("cell", "fault", F.col("group").alias("id")).agg(F.min("rank").alias("rank"))
    return headless.unionByName(missing).unionByName(cycles).unionByName(in_groups)


def roots(chain: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, role, root): a role's root by the newest manifest that has one, the first by seq (ties: the least) in it.  labels: (manifest, seq, role, root)."""
    return chain.join(labels, "manifest").groupBy("cell", "role").agg(F.min_by("root", F.struct("rank", "seq", "root")).alias("root"))


def objects(chain: DataFrame, groups: DataFrame, declared: DataFrame, data: DataFrame, blobs: DataFrame, last: bool = False) -> DataFrame:
    """(cell, object, rank, group, meta, data, cells, file, file_missing): each object as the newest manifest with a whole one gives it.

    groups: (manifest, pos, group); declared: (group, pos, object, part); data: (group, pos, kind, value, blob, cells), joined by
    place; blobs: (blob, payload).  An object is whole in a group where its last META and its last DATA entry are objects;
    its FILE entry counts if it is a blob.  Of a manifest's groups the first wins, or the last.  A group of very many objects
    is a key of a join that Spark splits; counts and places combine before they are shuffled.
    """
    # What is the last entry of a part: its place, with its kind in the last two bits.  Steps and slices are written, so that the shuffles of one go before the next.
    code = F.when(F.col("kind") == OBJECT, 2).when(F.col("kind") == BLOB, 1).otherwise(0)
    entry = lambda part: F.max(F.when(F.col("part") == part, F.col("pos").cast("long") * 4 + F.col("_code")))
    of = lambda c, kind: F.pmod(F.col(c), F.lit(4)) == kind
    place = lambda c: F.shiftright(c, 2)
    wholes = []
    for k in range(SLICES):
        kinds = _slice(declared.filter("object IS NOT NULL"), k).join(_slice(data, k).select("group", "pos", code.alias("_code")), ["group", "pos"])
        found = kinds.groupBy("group", "object").agg(entry(META).alias("_meta"), entry(DATA).alias("_data"), entry(FILE).alias("_file")).filter(of("_meta", 2) & of("_data", 2))
        wholes.append(checkpointed(found.select("group", "object", place("_meta").alias("meta"), place("_data").alias("data"), F.when(of("_file", 1), place("_file")).alias("file"))))
    order = F.struct("rank", (-F.col("pos") if last else F.col("pos")).alias("pos"))
    won = chain.join(groups, "manifest").join(reduce(DataFrame.unionByName, wholes), "group").groupBy("cell", "object").agg(F.min_by(F.struct("rank", "group", "meta", "data", "file"), order).alias("_w"))
    won = checkpointed(won.select("cell", "object", "_w.*"))
    for df in wholes:
        gone(df)

    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(c).alias("pos")) for p, c in ((META, "meta"), (DATA, "data"), (FILE, "file")))))
    each = won.select("cell", "object", "rank", "group", wanted.alias("_e")).select("cell", "object", "rank", "group", "_e.*").filter("pos IS NOT NULL")
    # Objects give values and cells, blobs their ids, other entries nothing.  An object's entries are of one group, so of one slice.
    is_object = F.col("kind") == OBJECT
    held = data.filter(F.col("kind").isin(OBJECT, BLOB)).select("group", "pos", F.when(is_object, F.col("value")).alias("value"), F.when(~is_object, F.col("blob")).alias("blob"), F.when(is_object, F.col("cells")).alias("cells"))
    kept = lambda part, c: F.any_value(F.when(F.col("part") == part, F.col(c)), True)
    outs = []
    for k in range(SLICES):
        values = _slice(each, k).join(_slice(held, k), ["group", "pos"])
        outs.append(checkpointed(values.groupBy("cell", "object").agg(
            F.first("rank").alias("rank"), F.first("group").alias("group"), kept(META, "value").alias("meta"), kept(DATA, "value").alias("data"), kept(DATA, "cells").alias("cells"),
            kept(FILE, "blob").alias("_blob"), F.max(F.col("part") == FILE).alias("_has_file"),
        )))
    out = reduce(DataFrame.unionByName, outs).join(blobs.select(F.col("blob").alias("_b"), F.col("payload").alias("file"), F.lit(True).alias("_found")), F.col("_blob") == F.col("_b"), "left")
    return out.select("cell", "object", "rank", "group", "meta", "data", "cells", "file", (F.col("_has_file") & F.col("_found").isNull()).alias("file_missing"))


def _slice(rows: DataFrame, k: int) -> DataFrame:
    return rows.filter(F.pmod(F.xxhash64("group"), F.lit(SLICES)) == k)


def without_faults(rows: DataFrame, found: DataFrame, fatal: tuple[str, ...] = FATAL) -> DataFrame:
    """Rows of cells that have none of the fatal faults."""
    return rows.join(found.filter(F.col("fault").isin(*fatal)).select("cell").distinct(), "cell", "left_anti")


def split_references(rows: DataFrame, cells: str, space: str) -> DataFrame:
    """``contexts``: the first ids of references (a, b) into the row's own space; ``spaces``: the references to others, in order."""
    own = lambda c: F.coalesce(c["b"] == F.col(space), F.lit(False))
    contexts = F.transform(F.filter(cells, own), lambda c: c["a"])
    return rows.withColumns({"contexts": contexts, "spaces": F.filter(cells, lambda c: ~own(c))}).drop(cells)
