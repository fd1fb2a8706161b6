from pathlib import Path

from pyspark.sql import functions as F

from leafmill.operators import export, pieces
from leafmill.sources import cabinet, folders
from leafmill.streaming import watch


def notebook(spark):
    pages = spark.createDataFrame(
        [("p1", "A/B", 1, 0, "Intro"), ("p2", "A/B", 2, 1, "intro"), ("p3", "A/B", 3, 1, ""), ("p4", "C", 1, 0, "assets"), ("p5", "C", 2, 2, "Deep")],
        "page string, section string, seq int, level int, title string",
    )
    elements = spark.createDataFrame([("p1", 0, "para", 0, "x_y"), ("p1", 1, "bullet", 0, "b"), ("p4", 0, "quote", 0, "q")], "page string, pos int, kind string, depth int, text string")
    return pages, elements


def test_plan(spark):
    pages, _ = notebook(spark)
    got = {r["page"]: (r["path"], r["wiki"], r["parent"]) for r in export.planned(pages).collect()}
    assert got == {
        "p1": ("A_B/Intro.md", "Intro", None), "p2": ("A_B/intro (2).md", "intro (2)", 1), "p3": ("A_B/Untitled Page.md", "Untitled Page", 1),
        "p4": ("C/assets (2).md", "assets (2)", None), "p5": ("C/Deep.md", "Deep", None),
    }


def test_files(spark, tmp_path):
    pages, elements = notebook(spark)
    for kind in ("md", "vault", "html"):
        options = export.ExportOptions(format=kind)
        out = export.write(export.rendered(pages, elements, options), f"file://{tmp_path}/{kind}")
        s = export.statistics(out).first()
        assert (s["pages"], s["failed"]) == (5, 0)
    assert (tmp_path / "md/A_B/Intro.md").read_text() == '---\ntitle: "Intro"\nsection: "A/B"\n---\n\nx\\_y\n\n- b\n'
    assert "<ul><li>b</li></ul>" in (tmp_path / "html/A_B/Intro.html").read_text()
    assert not list(Path(tmp_path).rglob("*.tmp"))


def test_folders(spark, tmp_path):
    for name in ("a/Two.one", "a/one.one", "a/.hidden/x.one", "a/OneNote_RecycleBin/y.one", "a/z.txt", "b/three.ONE"):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    found = folders.entries(folders.scan(spark, str(tmp_path / "root")), str(tmp_path / "root"))
    assert sorted((r["dir"], r["name"]) for r in found.collect()) == [("a", "Two.one"), ("a", "one.one"), ("b", "three.ONE")]
    toc = spark.createDataFrame([("a", "t1", "TWO.one", 1, "#f00"), ("a", "t0", "one.one", 1, None), ("a", "t1", "one.one", 2, None)], "dir string, file string, name string, pos int, color string")
    best = folders.largest_toc(toc)
    assert {r["file"] for r in best.collect()} == {"t1"}
    got = [(r["dir"], r["name"], r["place"], r["listed"]) for r in folders.ordered(found, best).orderBy("dir", "place").collect()]
    assert got == [("a", "Two.one", 1, True), ("a", "one.one", 2, True), ("b", "three.ONE", 1, False)]


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.cab").write_bytes(cabinet.build([("x.txt", b"hello")]))
    q = watch.cabinet_files(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert [(r["path"], bytes(r["content"])) for r in spark.sql("SELECT * FROM arrived").collect()] == [("x.txt", b"hello")]
    finally:
        q.stop()


def test_pieces_are_the_whole(spark):
    import random

    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), i, r.choice(["", None, "é" * r.randrange(9), "line", "x" * 70])) for i in range(400)] + [("one", 0, None)]
    want = {}
    for g, _, line in rows:
        want.setdefault(g, []).append(line or "")
    df = spark.createDataFrame(rows, "g string, o int, line string").repartition(5)
    for between, head, tail in (("\n", "", ""), ("", "<", ">"), ("--", "<h>\n", "\n</h>")):
        out = pieces.pieces(df, ["g"], "o", F.col("line"), between, head, tail, 50).collect()
        for g, lines in want.items():
            mine = sorted((x for x in out if x["g"] == g), key=lambda x: x["piece"])
            assert "".join(x["text"] for x in mine) == head + between.join(lines) + tail
            assert sum(x["lines"] for x in mine) == len(lines) and all(x["bytes"] == len(x["text"].encode()) <= 50 + 80 + len(head + tail) for x in mine)
    assert pieces.pieces(df.limit(0), ["g"], "o", F.col("line")).count() == 0
    named = pieces.piece_paths(pieces.pieces(df, ["g"], "o", F.col("line"), most=50), F.coalesce("g", F.lit("none")), ".md").collect()
    assert "".join(x["text"] for x in sorted(named, key=lambda x: x["path"]) if x["path"].startswith("a.")) == "\n".join(want["a"])


def test_assets_are_named_by_content(spark):
    rows = [("s", 1, "a.png", "h1"), ("s", 2, "a.png", "h1"), ("s", 3, "A.png", "h2"), ("s", 4, "a.png", None), ("s", 5, "z.png", None), ("t", 6, "a.png", "h1"), (None, 7, "a.png", "h1"), (None, 8, None, "h9"), ("s", 9, "a-2.png", "h5")]
    got = {r["o"]: (r["file"], r["writes"]) for r in export.asset_plan(spark.createDataFrame(rows, "scope string, o int, name string, hash string"), "scope", "o", "name", ["hash"]).collect()}
    assert got == {1: ("a.png", True), 2: ("a.png", False), 3: ("A-2.png", True), 4: ("a-3.png", True), 5: ("a-3.png", False), 6: ("a.png", True), 7: ("a.png", True), 8: (None, True), 9: ("a-2-2.png", True)}


def test_writing_again_changes_nothing(spark, tmp_path):
    pages = spark.createDataFrame([("a/x.md", "one"), ("a/y.md", "zwei é"), ("z.md", "")], "path string, text string")
    for _ in range(2):
        out = export.write(pages, f"file://{tmp_path}/out")
        assert export.statistics(out).first().asDict() == {"pages": 3, "failed": 0, "bytes": 10}
        times = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.md")}
        if _:
            assert times == before
        before = times
    assert (tmp_path / "out/a/y.md").read_text() == "zwei é" and not list((tmp_path / "out").rglob("*.tmp"))


def test_folders_load_without_what_is_empty(spark):
    names = ["b.one", "A.one", "g/x.one", "g/deep/deeper/y.ONE", "gone/only.txt", "OneNote_RecycleBin/old.one", "h/OneNote_DeletedPages.one", ".h/z.one", "G2/a.one"]
    files = spark.createDataFrame([(f"/nb/{n}",) for n in names], "path string")
    toc = spark.createDataFrame([("", "G", 1, "#1"), ("", "B.ONE", 0, "#2"), ("g", "deep", 3, None), ("g", "X.one", 4, "#3"), ("", "b.one", 9, "#9"), ("", "nowhere", 2, None)], "dir string, name string, pos int, color string")
    shown = lambda **how: [(r["depth"], r["title"], r["color"]) for r in folders.loaded(folders.entries(files, "/nb", **how), toc).orderBy("place").collect()]
    assert shown() == [(0, "b.one", "#9"), (0, "g", None), (1, "deep", None), (2, "deeper", None), (3, "y.ONE", None), (1, "x.one", "#3"), (0, "A.one", None), (0, "G2", None), (1, "a.one", None)]
    assert [x[1] for x in shown(with_deleted=True)][-2:] == ["Recycle Bin", "old.one"] and len(shown(with_deleted=True)) == 13
    assert folders.loaded(folders.entries(files.limit(0), "/nb"), toc.limit(0)).count() == 0


def test_notes_are_checked(spark):
    from leafmill.operators import notes

    head = '<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE en-note SYSTEM "http://xml.evernote.com/pub/enml2.dtd">'
    note = lambda body, title="T", rest="": f"<note><title>{title}</title><content><![CDATA[{head}{body}]]></content>{rest}</note>"
    rows = {
        1: (note("<en-note><div>a</div></en-note>"), 0, 0, 0, []), 2: (None, 0, 0, 0, ["doctype", "header", "malformed", "title"]), 3: ("", 0, 0, 0, ["doctype", "header", "malformed", "title"]),
        4: (note("<en-note><div>a</en-note>"), 0, 0, 0, ["malformed"]), 5: (note("<en-note>&lt;en-media&gt; <!-- a --> <en-todo/><en-todo checked='true'/><en-todo checked='1'/></en-note>"), 0, 0, 3, ["todo"]),
        6: (note("<en-note/>", " T ", "<created>2024</created><tag>a,b</tag>"), 0, 0, 0, ["tags", "time", "title"]), 7: (note('<en-note onclick="x"><a href="mailto:a">b</a></en-note>'), 0, 0, 0, ["attribute"]),
        8: (note('<en-note><en-media hash="5d41402abc4b2a76b9719d911017c592" type="a/b"/></en-note>', rest='<resource><data encoding="base64">aGVsbG8=</data><mime>a/b</mime></resource>'), 1, 1, 0, []),
        9: (note("<en-note>x</en-note>", rest='<resource><data encoding="base64">%%</data></resource>'), 1, 0, 0, ["resource", "unused"]), 10: (note("<en-note>" + "<div>y</div>" * 20_000 + "</en-note>"), 0, 0, 0, []),
    }
    df = spark.createDataFrame([(k, v[0], "kept") for k, v in rows.items()], "id int, note string, resources_of string")
    found = {r["id"]: (r["resources"], r["media"], r["todos"], r["faults"]) for r in notes.checked(df, "note").collect()}
    assert found == {k: v[1:] for k, v in rows.items()}
    assert notes.checked(df.limit(0), "note").count() == 0
