"""Queries of object spaces along chains of revisions, with their SQL: orders are revisions, line items groups, customers cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import spaces
from leafmill.operators.graph import checkpointed
from leafmill.plans.queries import read


def _chained(spark, d):
    """A customer's orders base on one another; one in 97 bases on none that there is, a customer in 50 on its own newest."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, d, "orders").select(c.alias("cell"), k.alias("manifest"), F.lag("o_orderkey").over(w).alias("_before"), F.max("o_orderkey").over(Window.partitionBy("o_custkey")).alias("_newest"))
    manifests = o.select("manifest", F.when(F.col("_before").isNull() & (F.col("cell") % 50 == 0), F.col("_newest")).when(F.col("manifest") % 97 == 0, -F.col("manifest")).otherwise(F.col("_before")).alias("base"))
    newest = o.groupBy("cell").agg(F.max("manifest").alias("_m"))
    heads = read(spark, d, "customer").select(F.col("c_custkey").alias("cell")).join(newest, "cell", "left").select("cell", F.col("_m").alias("manifest"))
    return heads, manifests


def _store(spark, d):
    """The chains and their groups.  Numbered lines are written, as four tables come from them."""
    heads, manifests = _chained(spark, d)
    line = checkpointed(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("manifest"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")))
    group = (F.col("manifest") * 100 + F.col("n")).alias("group")
    groups = line.select("manifest", F.col("n").alias("pos"), group)
    held = groups.filter(F.col("group") % 211 != 0).select("group")
    each = line.select(group, "p", "s", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("pos"))
    part = F.element_at(F.array(*map(F.lit, (spaces.META, spaces.DATA, spaces.FILE, spaces.DATA))), (F.col("pos") + 1).cast("int"))
    declared = each.select("group", "pos", (F.col("p") % 12 + F.when(F.col("pos") == 3, F.col("n") % 2).otherwise(0)).alias("object"), part.alias("part"))
    kind = F.when((F.col("pos") == 2) & (F.col("p") % 3 > 0), spaces.BLOB).when(F.col("p") % 7 == F.col("pos"), "excluded").otherwise(spaces.OBJECT)
    cells = F.array(F.struct(F.col("s").alias("a"), (F.col("p") % 100).alias("b")), F.struct(F.col("p").alias("a"), (F.col("s") % 3).alias("b")))
    data = each.filter("group % 223 <> 0 OR pos <> 3").select("group", "pos", kind.alias("kind"), (F.col("p") * 10 + F.col("pos")).alias("value"), F.col("s").alias("blob"), cells.alias("cells"))
    blobs = read(spark, d, "supplier").filter("s_suppkey % 4 > 0").select(F.col("s_suppkey").alias("blob"), F.col("s_name").alias("payload"))
    return heads, manifests, groups, held, declared, data, blobs


def space_objects(spark, d):
    """The objects of customers whose chains have no fault that counts."""
    heads, manifests, groups, held, declared, data, blobs = _store(spark, d)
    chain = spaces.chains(heads, manifests)
    found = spaces.faults(heads, chain, manifests, groups, held, declared, data)
    got = spaces.objects(spaces.without_faults(chain, found), groups, declared, data, blobs)
    got = spaces.split_references(got.withColumn("space", F.col("cell") % 3), "cells", "space")
    return got.select("cell", "object", "rank", "group", "meta", "data", "file", "file_missing", F.concat_ws(",", F.transform("contexts", lambda x: x.cast("string"))).alias("contexts"), F.size("spaces").alias("n_spaces"))


def space_faults(spark, d):
    heads, manifests, groups, held, declared, data, _ = _store(spark, d)
    return spaces.faults(heads, spaces.chains(heads, manifests), manifests, groups, held, declared, data)


def chain_roots(spark, d):
    heads, manifests = _chained(spark, d)
    k = F.col("l_orderkey")
    labels = read(spark, d, "lineitem").select(k.alias("manifest"), F.col("l_linenumber").alias("seq"), (F.col("l_partkey") % 4).alias("role"), F.col("l_partkey").alias("root"))
    return spaces.roots(spaces.chains(heads, manifests), labels)


def role_labels(spark, d):
    """Events as starts of revisions and as labels, some of which come before their revision's start."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = read(spark, d, "events").select((u % 40).alias("space"), e.alias("seq"), (e * 7 % 50).alias("revision"), F.when(e % 3 == 0, u % 2).alias("context"), (u % 5).alias("role"))
    return spaces.role_labels(rows.filter("seq % 4 = 0"), rows.filter("seq % 4 > 0"))


_STORE = """
    RECURSIVE o AS (SELECT o_custkey AS cell, o_orderkey AS manifest, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, max(o_orderkey) OVER (PARTITION BY o_custkey) AS newest FROM orders),
    manifests AS (SELECT manifest, CASE WHEN before IS NULL AND cell % 50 = 0 THEN newest WHEN manifest % 97 = 0 THEN -manifest ELSE before END AS base FROM o),
    heads AS (SELECT c_custkey AS cell, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS manifest FROM customer),
    walk AS (SELECT cell, manifest, 0 AS rank, [manifest] AS seen FROM heads WHERE manifest IS NOT NULL
        UNION ALL SELECT cell, base, rank + 1, list_append(seen, base) FROM walk JOIN manifests USING (manifest) WHERE base IS NOT NULL AND NOT list_contains(seen, base)),
    lines AS (SELECT l_orderkey AS manifest, n, l_orderkey * 100 + n AS grp, p, s FROM (SELECT l_orderkey, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)),
    entries AS (SELECT grp, pos, p, s, p % 12 + CASE WHEN pos = 3 THEN n % 2 ELSE 0 END AS object, [4, 1, 2, 1][pos + 1] AS part,
        CASE WHEN pos = 2 AND p % 3 > 0 THEN 'blob' WHEN p % 7 = pos THEN 'excluded' ELSE 'object' END AS kind, p * 10 + pos AS value, grp % 223 <> 0 OR pos <> 3 AS there FROM lines, range(4) AS r(pos)),
    bad AS (SELECT grp, CASE WHEN grp % 211 = 0 THEN 'missing group' ELSE 'counts differ' END AS fault FROM lines WHERE grp % 211 = 0 OR grp % 223 = 0),
    found AS (SELECT cell, 'no manifest' AS fault, NULL AS id, 0 AS rank FROM heads WHERE manifest IS NULL
        UNION ALL SELECT cell, 'missing manifest', manifest, rank FROM walk WHERE manifest NOT IN (SELECT manifest FROM manifests)
        UNION ALL SELECT cell, 'cycle', manifest, rank FROM walk JOIN manifests USING (manifest) WHERE list_contains(seen, base)
        UNION ALL SELECT cell, fault, grp, min(rank) FROM walk JOIN lines USING (manifest) JOIN bad USING (grp) GROUP BY ALL)
"""

SQL = {
    "space_objects": f"""
        WITH {_STORE},
        whole AS (SELECT grp, object, max(pos) FILTER (WHERE part = 4) AS meta, max(pos) FILTER (WHERE part = 1) AS data, max(pos) FILTER (WHERE part = 2) AS file FROM entries WHERE there GROUP BY ALL),
        placed AS (SELECT cell, w.object, rank, n, w.grp, m.value AS meta, e.value AS data, e.p, e.s, f.s AS blob, row_number() OVER (PARTITION BY cell, w.object ORDER BY rank, n) AS nth
            FROM walk JOIN lines USING (manifest) JOIN whole w USING (grp) JOIN entries m ON m.grp = w.grp AND m.pos = w.meta AND m.kind = 'object' JOIN entries e ON e.grp = w.grp AND e.pos = w.data AND e.kind = 'object'
            LEFT JOIN entries f ON f.grp = w.grp AND f.pos = w.file AND f.kind = 'blob')
        SELECT cell, object, rank, grp AS "group", meta, data, s_name AS file, blob IS NOT NULL AND s_suppkey IS NULL AS file_missing,
            concat_ws(',', CASE WHEN p % 100 = cell % 3 THEN s END, CASE WHEN s % 3 = cell % 3 THEN p END) AS contexts, (p % 100 <> cell % 3)::int + (s % 3 <> cell % 3)::int AS n_spaces
        FROM placed LEFT JOIN supplier ON s_suppkey = blob AND s_suppkey % 4 > 0 WHERE nth = 1 AND cell NOT IN (SELECT cell FROM found WHERE fault <> 'cycle')""",
    "space_faults": f"WITH {_STORE} SELECT cell, fault, id, rank FROM found",
    "chain_roots": f"WITH {_STORE} SELECT cell, l_partkey % 4 AS role, arg_min(l_partkey, (rank * 100 + l_linenumber)::bigint * 1000000000 + l_partkey) AS root FROM walk JOIN lineitem ON l_orderkey = manifest GROUP BY ALL",
    "role_labels": """
        WITH rows AS (SELECT user_id % 40 AS space, event_id AS seq, event_id * 7 % 50 AS revision, CASE WHEN event_id % 3 = 0 THEN user_id % 2 END AS context, user_id % 5 AS role FROM events)
        SELECT space, context, role, arg_max(revision, seq) AS revision FROM rows r
        WHERE seq % 4 = 0 OR EXISTS (SELECT 1 FROM rows s WHERE s.seq % 4 = 0 AND s.space = r.space AND s.revision = r.revision AND s.seq < r.seq) GROUP BY space, context, role""",
}

QUERIES = {f.__name__: f for f in (space_objects, space_faults, chain_roots, role_labels)}
