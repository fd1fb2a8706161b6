"""Tables between rounds: what they hold, what the planner knows of them, and how many there are."""

import os
import time

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import graph, spaces, trees
from leafmill.sources import folders


def counted(monkeypatch):
    made = []
    whole = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: made.append(1) or whole(df))
    return made


def test_tables_keep_names_types_and_rows(spark):
    df = spark.sql("SELECT id AS `a b`, -id AS `A B`, NULL AS none, named_struct('x.y', id) AS s, array(id, NULL) AS l, id + 1 AS `c,d` FROM range(5)")
    for of in (df, df.drop("none")):
        got = graph.checkpointed(of)
        assert got.columns == of.columns and got.dtypes == of.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, of.collect()))
    assert graph.checkpointed(df.drop("none").limit(0)).collect() == []


def test_rounds_leave_sizes_as_they_are(spark, capsys):
    rows = [(i, i - 1 if i else None, 1.0, 2.0) for i in range(300)] + [(1000 + i, 1000 + (i + 1) % 64, 1.0, 1.0) for i in range(64)]
    df = spark.createDataFrame(rows, "id long, parent long, x double, y double")
    offsets = graph.folded_offsets(df)
    found = graph.nearest_declared(df.withColumn("v", F.when(F.col("id") == 0, 7)), "id", "parent", "v")
    assert {(r["id"], r["root"], r["depth"], r["dx"], r["dy"]) for r in offsets.collect()} == {(i, 0, i, float(i), 2.0 * i) for i in range(300)}
    assert {tuple(r) for r in found.collect()} == {(i, 7, i) for i in range(300)}
    for out in (offsets, found):
        capsys.readouterr()
        out.explain("cost")
        said = capsys.readouterr().out
        assert "sizeInBytes" in said and not any(unit in said for unit in (" GiB", " TiB", " PiB", " EiB", "E+"))


def test_cycles_take_no_rounds(spark, monkeypatch):
    df = spark.createDataFrame([(i, i) for i in range(2000)] + [(5000 + i, 4999 + i) for i in range(6)], "id long, parent long").withColumns({"x": F.lit(1.0), "y": F.lit(1.0), "v": F.when(F.col("id") == 5000, 1)})
    made = counted(monkeypatch)
    assert graph.folded_offsets(df).agg(F.max("depth")).first()[0] == 5
    assert len(made) <= 6
    made.clear()
    assert graph.nearest_declared(df, "id", "parent", "v").agg(F.max("depth")).first()[0] == 5
    assert len(made) <= 6


def test_rounds_keep_one_table(spark):
    folder = spark.sparkContext.getCheckpointDir() or graph.checkpointed(spark.range(1)) and spark.sparkContext.getCheckpointDir()
    if not folder.startswith("file:"):
        pytest.skip("the folder is not local")
    tables = lambda: {x for x in os.listdir(folder[len("file:") :]) if x.startswith("table-")}
    before = tables()
    df = spark.createDataFrame([(i, i - 1 if i else None, 1.0, 1.0) for i in range(300)], "id long, parent long, x double, y double")
    assert graph.folded_offsets(df).count() == 300
    assert len(tables() - before) == 1


def test_outlines_beside_cycles_end_early(spark, monkeypatch, capsys):
    refs = [(0, None, 0, "outline")] + [(i, 0, i, "element") for i in range(1, 4)] + [(100 + i, 100 + (i ^ 1), 0, "element") for i in range(1000)]
    df = spark.createDataFrame(refs, "id long, parent long, pos long, kind string")
    made = counted(monkeypatch)
    monkeypatch.setattr(trees, "checkpointed", graph.checkpointed)
    out = trees.outline(df)
    # Eight arcs are three rounds and one that finishes none; the rest is what is written besides.
    assert len(made) <= 11
    assert {(r["id"], r["place"]) for r in out.filter("fault IS NULL").collect()} == {(i, i) for i in range(4)}
    assert out.filter("fault = 'cycle'").count() == 1000
    capsys.readouterr()
    out.explain("cost")
    said = capsys.readouterr().out
    assert "sizeInBytes" in said and not any(unit in said for unit in (" GiB", " TiB", " PiB", " EiB", "E+"))


@pytest.mark.parametrize("budget, cut", [(3, 1), (4, 0), (5, 0)])
def test_budgets_at_the_size_of_a_root(spark, budget, cut):
    df = spark.createDataFrame([(0, None, 0, "outline")] + [(i, 0, i, "element") for i in range(1, 5)], "id long, parent long, pos long, kind string")
    assert trees.outline(df, budget=budget).filter("fault = 'budget'").count() == cut


def test_folders_leave_sizes_as_they_are(spark, capsys):
    files = spark.createDataFrame([(f"/nb/G{i % 9}/H{i % 4}/S{i}.one",) for i in range(400)], "path string")
    toc = spark.createDataFrame([("G1", "h1", 0, "#1")], "dir string, name string, pos int, color string")
    out = folders.loaded(folders.entries(files, "/nb"), toc)
    assert out.count() == 400 + 9 + 36 and out.agg(F.max("place")).first()[0] == 445
    capsys.readouterr()
    out.explain("cost")
    said = capsys.readouterr().out
    assert "sizeInBytes" in said and not any(unit in said for unit in (" GiB", " TiB", " PiB", " EiB", "E+"))


def test_written_tables_keep_no_shuffles(spark):
    shuffles = lambda: {x for _, _, names in os.walk(spark.conf.get("spark.local.dir")) for x in names if x.startswith("shuffle_")}
    before, said = shuffles(), spark.conf.get(graph._CLEANUP)
    assert graph.checkpointed(spark.range(1000).repartition(7, "id")).count() == 1000
    assert spark.conf.get(graph._CLEANUP) == said
    until = time.time() + 20
    while (left := {x for x in shuffles() - before if x.endswith(".data")}) and time.time() < until:
        time.sleep(0.2)
    # The count over what is read back has one of its own.
    assert len({x.split("_")[1] for x in left}) <= 1


def test_objects_at_negative_and_large_places(spark):
    big = 1 << 40
    chain = spark.createDataFrame([(1, 10, 0)], "cell long, manifest long, rank long")
    groups = spark.createDataFrame([(10, 1, 7)], "manifest long, pos long, group long")
    declared = spark.createDataFrame([(7, -3, 5, spaces.META), (7, -2, 5, spaces.META), (7, big, 5, spaces.DATA), (7, 0, 5, spaces.FILE), (7, 1, 6, spaces.META), (7, 2, 6, spaces.DATA)], "group long, pos long, object long, part int")
    kinds = [(-3, "excluded"), (-2, "object"), (big, "object"), (0, "blob"), (1, "object"), (2, None)]
    data = spark.createDataFrame([(7, p, k, p * 10, 3, [(p, 1)]) for p, k in kinds], "group long, pos long, kind string, value long, blob long, cells array<struct<a:long,b:long>>")
    blobs = spark.createDataFrame([(3, "file")], "blob long, payload string")
    got = spaces.objects(chain, groups, declared, data, blobs).collect()
    assert [(r["object"], r["meta"], r["data"], r["cells"], r["file"], r["file_missing"]) for r in got] == [(5, -20, big * 10, [(big, 1)], "file", False)]


def test_names_are_made_once(spark, capsys):
    """What a name comes from is computed once; as plain expressions its steps were stated again for each use."""
    df = spark.createDataFrame([("a" * 200,), ("é" * 60,), (" con.txt",), ("..",), (None,), ("x:y",)], "t string")
    named = df.select(text.file_name(F.col("t"), 80).alias("n"))
    named.explain()
    assert 5 <= capsys.readouterr().out.count("regexp_replace") <= 10
    assert [r["n"] for r in named.collect()] == ["a" * 80, "é" * 40, "_con.txt", "untitled", "untitled", "x_y"]
