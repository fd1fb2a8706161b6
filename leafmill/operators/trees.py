"""Outlines as trees: depth-first numbers, groups that do not show, limits, and folds from the leaves up.

A tree is a table of references (id, parent, pos, ...): what stands below what, at which place.  Roots have no parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.graph import checkpointed, nearest_declared, next_round
from leafmill.operators.sequence import ranks_within

#: Fixed limits: levels below a page's outline, and references that are followed on a page.
DEEPEST, BUDGET = 64, 1_000_000


def toured(refs: DataFrame, weight: Column | None = None, holds: Column | None = None) -> DataFrame:
    """refs with root, place (depth first; 0 is the root), depth (0 is the root), size (references in its subtree, itself
    included), weighed (the sum of ``weight`` over all above it) and fault.

    (id, parent, pos) with ids as they are referred to; rows need no order, ties of pos go by id.  ``holds``: false where nothing can hang
    on a reference.  Faults, whose other columns are null but for ``shared``:

    * ``shared``: the id is referred to before, by a smaller (parent, pos); this reference has a place, and nothing below it.
    * ``cycle``: it hangs below itself, or below what does.
    * ``loose``: its parent, or one above, is referred to nowhere, or holds nothing.

    Each reference is gone through down and up once: down to its first child, or up again; from up to the next sibling, or up
    to the parent.  Places along that list are found by pointers that double, two rows a reference and one join a round, so that
    a tree of any shape takes as many rounds as the logarithm of its size, and no task walks it.
    """
    ordered = Window.partitionBy("id").orderBy("parent", "pos")
    n = refs.withColumn("_nth", F.row_number().over(ordered)).withColumn("_weight", (weight if weight is not None else F.lit(0)).cast("long"))
    n = checkpointed(n.withColumn("_holds", holds if holds is not None else F.lit(True)).withColumn("_no", F.monotonically_increasing_id()))
    # Children hang on the first reference to an id.
    ups = n.filter("_nth = 1 AND _holds").select(F.col("id").alias("parent"), F.col("_no").alias("_up"))
    tree = n.select("_no", "id", "parent", "pos", "_nth", "_weight").join(ups, "parent", "left")
    siblings = Window.partitionBy("parent").orderBy("pos", "id", "_nth")
    tree = tree.withColumn("_next", F.when(F.col("parent").isNotNull(), F.lead("_no").over(siblings)))
    tree = checkpointed(tree.select("_no", "_up", "_next", "_weight", F.struct("pos", "id", "_nth").alias("_order"), F.col("parent").isNull().alias("_root")))
    firsts = tree.filter("_up IS NOT NULL").groupBy(F.col("_up").alias("_no")).agg(F.min_by("_no", "_order").alias("_child"))
    # Arcs: twice a reference's number down into it, and one more up from it.  What is added on the way from an arc to where it points: arcs, levels, weight.
    into, out_of = F.col("_no") * 2, F.col("_no") * 2 + 1
    down = F.struct(into.alias("arc"), F.coalesce(F.col("_child") * 2, out_of).alias("to"), F.lit(1).cast("long").alias("steps"), F.lit(1).cast("long").alias("levels"), F.col("_weight").alias("weights"), F.col("_no").alias("end"))
    back = F.when(~F.col("_root"), F.coalesce(F.col("_next") * 2, F.col("_up") * 2 + 1))
    up = F.struct(out_of.alias("arc"), back.alias("to"), F.lit(1).cast("long").alias("steps"), F.lit(-1).cast("long").alias("levels"), (-F.col("_weight")).alias("weights"), F.col("_no").alias("end"))
    arcs = checkpointed(tree.join(firsts, "_no", "left").select(F.explode(F.array(down, up)).alias("a")).select("a.*"))
    left = arcs.filter("to IS NOT NULL").count()
    for _ in range(max(1, arcs.count()).bit_length() + 1):
        if not left:
            break
        on = arcs.select(F.col("arc").alias("to"), F.col("to").alias("_to"), *(F.col(c).alias(f"_{c}") for c in ("steps", "levels", "weights", "end")))
        moved = arcs.filter("to IS NOT NULL").join(on, "to")
        moved = moved.select("arc", F.col("_to").alias("to"), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in ("steps", "levels", "weights")), F.col("_end").alias("end"))
        arcs = next_round(arcs.filter("to IS NULL").unionByName(moved), arcs)
        left, before = arcs.filter("to IS NOT NULL").count(), left
        # A list that ends has arcs at all distances from its end, so a round that finishes none leaves cycles alone.
        if left == before:
            break
    # From an arc to the end of its root's list: an arc's place is what is left for the root's own first arc, less what is left for it.
    is_down = F.col("arc") % 2 == 0
    of = arcs.filter("to IS NULL").groupBy(F.shiftright("arc", 1).alias("_no"), "end").agg(
        F.max(F.when(is_down, F.col("steps"))).alias("d_steps"), F.max(F.when(~is_down, F.col("steps"))).alias("u_steps"), F.max(F.when(is_down, F.col("levels"))).alias("d_levels"), F.max(F.when(is_down, F.col("weights"))).alias("d_weights")
    )
    heads = arcs.filter(is_down & F.col("to").isNull()).join(tree.filter("_root").select("_no"), (F.col("arc") == F.col("_no") * 2) & (F.col("end") == F.col("_no")))
    heads = heads.select("end", F.col("steps").alias("_all")).join(n.select(F.col("_no").alias("end"), F.col("id").alias("root")), "end")
    # Levels and weights from an arc to its root's end are minus those above it.  What leads to no root ends in a list of its own, where a parent is missing, or in none.
    of = of.join(heads, "end", "left")
    at, size = F.col("_all") - F.col("d_steps"), F.when(F.col("root").isNotNull(), F.col("d_steps") - F.col("u_steps") + 1) / 2
    depth = F.when(F.col("root").isNotNull(), 0 - F.col("d_levels"))
    place = ((at + depth) / 2).cast("long")
    weighed = F.when(F.col("root").isNotNull(), 0 - F.col("d_weights"))
    placed = of.select("_no", "root", place.alias("place"), depth.alias("depth"), size.cast("long").alias("size"), weighed.alias("weighed"), F.lit(True).alias("_ended"))
    out = n.join(placed, "_no", "left")
    fault = F.when(F.col("root").isNull() & F.col("_ended"), "loose").when(F.col("root").isNull(), "cycle").when(F.col("_nth") > 1, "shared")
    return checkpointed(out.withColumn("fault", fault).drop("_no", "_nth", "_holds", "_weight", "_ended"))


def outline(refs: DataFrame, kind: str = "kind", deepest: int = DEEPEST, budget: int = BUDGET) -> DataFrame:
    """refs of a page's outlines with root, place, depth, size, ``above`` (the element that shows above it, null below a root),
    ``level`` (how many elements stand above it), and ``fault``.

    ``kind``: ``element``; ``group``, which does not show, so that what is below it belongs to the element above it; null where
    the object is missing.  Faults are those of ``toured`` and ``missing``, ``deep`` (more than ``deepest`` levels down, groups
    included) and ``budget`` (not among the first ``budget`` references of its root that are not too deep, depth first).  A
    reference with a fault does not show, nor do those below it; references without, of kind element, are the outline.
    """
    element = F.coalesce(F.col(kind) == "element", F.lit(False))
    t = toured(refs, element.cast("int"), F.col(kind).isNotNull())
    # A root has no place of its own among the references below it; only those that are not too deep are counted.
    shallow = (F.col("depth") <= deepest) & (F.col("depth") > 0)
    # A root of no more references than the budget, itself aside, can't run out of it.
    large = t.filter((F.col("depth") == 0) & (F.col("size") > budget + 1)).select("root")
    if large.head(1):
        spent = ranks_within(t.filter(shallow).join(large.distinct(), "root", "left_semi"), ["root"], ["place"], "_spent").select("root", "place", "_spent")
        t = t.join(spent, ["root", "place"], "left")
    else:
        t = t.withColumn("_spent", F.lit(None).cast("long"))
    fault = F.coalesce("fault", F.when(F.col("depth") > deepest, "deep").when(F.col("_spent") >= budget, "budget").when((F.col("depth") > 0) & F.col(kind).isNull(), "missing"))
    t = checkpointed(t.withColumn("fault", fault).withColumn("level", F.col("weighed")).drop("weighed", "_spent"))
    firsts = t.filter((F.col("fault").isNull() | (F.col("fault") != "shared")) & F.col("root").isNotNull())
    shown = firsts.select("id", "parent", F.when((F.col("depth") == 0) | (F.col(kind) == "element"), F.struct("id", "depth")).alias("at"))
    up = nearest_declared(shown, "id", "parent", "at").select(F.col("revision").alias("parent"), "at")
    return checkpointed(t.join(up, "parent", "left").withColumn("above", F.when(F.col("root").isNotNull() & (F.col("at.depth") > 0), F.col("at.id"))).drop("at"))


# --------------------------------------------------------------------------- nested tables


def cell_texts(nodes: DataFrame) -> DataFrame:
    """(id, text) of all cells: the lines of their elements, joined by <br>.

    nodes: (id, parent, pos, kind, text, prefix).  Kinds: ``cell`` and ``element`` hold elements, an element also contents;
    contents are ``leaf`` (whose text is given) and ``table``, which holds ``row``s of ``cell``s.  Of an element, contents that
    are not blank are lines, the first content after the element's prefix (a list's mark or a box); what is below it is one
    more line.  A table inside a cell is flat: cells are joined by `` / ``, rows by <br>, without the empty rows before the
    first that says anything.  Line ends become blanks.

    Bottom up, level by level from the deepest, each level one aggregation by parent that is written: a node is touched once.
    Null texts and prefixes are empty.  Ids are unique; nodes below a parent that is missing, or in a cycle, are left out.
    """
    steps = nearest_declared(nodes.select("id", "parent", F.when(F.col("parent").isNull(), True).alias("_root")), "id", "parent", "_root")
    n = nodes.join(steps.select(F.col("revision").alias("id"), "depth"), "id")
    n = checkpointed(n.select("id", "parent", "pos", "depth", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("prefix", F.lit("")).alias("prefix")))
    deepest = n.agg(F.max("depth")).first()[0]
    lines = "array<string>"
    flat = lambda parts: F.translate(F.array_join(parts, "<br>"), "\n", " ")
    blank = lambda s: F.btrim(s, F.lit(" \t\r\n\x0b\x0c")) == ""
    below, cells = None, None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = n.filter(F.col("depth") == depth)
        if below is None:
            here = here.withColumn("under", F.array().cast("array<struct<pos:bigint,kind:string,lines:array<string>>>"))
        else:
            per = below.groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "kind", "lines"))).alias("under"))
            here = here.join(per, "id", "left").withColumn("under", F.coalesce("under", F.array().cast("array<struct<pos:bigint,kind:string,lines:array<string>>>")))
        under = F.col("under")
        all_lines = F.flatten(F.transform(under, lambda u: u["lines"]))
        contents = F.filter(under, lambda u: u["kind"] != "element")
        said = F.transform(contents, lambda u, i: F.struct(u["lines"][0].alias("s"), F.when(i == 0, F.col("prefix")).otherwise(F.lit("")).alias("p")))
        own = F.transform(F.filter(said, lambda x: ~blank(x["s"])), lambda x: F.concat(x["p"], x["s"]))
        children = flat(F.flatten(F.transform(F.filter(under, lambda u: u["kind"] == "element"), lambda u: u["lines"])))
        rows = F.transform(under, lambda u: u["lines"][0])
        some = F.array_position(F.transform(rows, lambda r: r != ""), True)
        table = F.when(some > 0, F.array_join(F.slice(rows, some.cast("int"), F.greatest(F.size(rows), F.lit(1))), "<br>")).otherwise(F.lit(""))
        value = (
            F.when(F.col("kind") == "element", F.concat(own, F.when(children == "", F.array().cast(lines)).otherwise(F.array(children))))
            .when(F.col("kind") == "cell", F.array(flat(all_lines)))
            .when(F.col("kind") == "row", F.array(F.array_join(rows, " / ")))
            .when(F.col("kind") == "table", F.array(table))
            .otherwise(F.array("text"))
        )
        below = checkpointed(here.select("id", "parent", "pos", "kind", value.alias("lines")))
        found = below.filter("kind = 'cell'").select("id", F.get("lines", F.lit(0)).alias("text"))
        cells = found if cells is None else cells.unionByName(found)
    return cells if cells is not None else n.select("id", "text").limit(0)
