"""Vectors from the formats' public descriptions, and properties."""

import base64
import hashlib
import struct
import zlib
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import numbers, text
from leafmill.operators import graph, ink, render, sequence
from leafmill.sources import cabinet


def one(spark, column, value, kind="string"):
    value = Decimal(value) if kind.startswith("decimal") else value
    return spark.createDataFrame([(value,)], f"s {kind}").select(column(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (text.md_escape, r"a*b_[c]<d>|~$\`", r"a\*b\_\[c\]\<d\>\|\~\$\\\`"),
        (text.vault_escape, "#tag a# b == c %% #1 #é # x", r"\#tag a# b \=\= c \%\% \#1 \#é # x"),
        (text.escape_line_start, "# x", r"\# x"),
        (text.escape_line_start, "####### x", "####### x"),
        (text.escape_line_start, "-", r"\-"),
        (text.escape_line_start, "---", r"\---"),
        (text.escape_line_start, "12) x", r"12\) x"),
        (text.escape_line_start, "12.5", "12.5"),
        (text.html_escape, "<a&\"'>", "&lt;a&amp;\"'&gt;"),
        (lambda s: text.html_escape(s, True), "<a&\"'>", "&lt;a&amp;&quot;&#39;&gt;"),
        (text.xml_escape, "a\x01﷐￾<\t", "a&lt;\t"),
        (text.yaml_string, 'a"b\\c\nd', '"a\\"b\\\\c\\nd"'),
        (text.md_url, "http://a b/<c>", "<http://a b/%3Cc%3E>"),
        (text.url_encode_path, "a b/é+%~", "a%20b/é%2B%25~"),
        (text.url_decode, "a%20b+%C3%A9%zz%", "a b+é%zz%"),
        (text.file_name, " ..a<b>:c?  d. ", "a_b__c_ d"),
        (text.file_name, "con.txt", "_con.txt"),
        (text.file_name, "..", "untitled"),
        (lambda s: text.file_name(s, 5), "aéééé", "aéé"),
        (text.vault_name, "a#b^[c]|%%%", "a_b__c__%%"),
        (text.tag_slug, " Remember for Later! ", "remember-for-later"),
        (text.tag_slug, "12 34", "tag-12-34"),
        (text.tag_slug, "Éa_b", "Éa_b"),
        (text.generic_image_name, " Untitled Picture 3", True),
        (text.generic_image_name, "cat.png", False),
        (text.stem, "a.b.c", "a.b"),
        (text.extension, "x/y.TAR.Gz", "gz"),
        (text.allowed_url, " javascript:x", None),
        (text.allowed_url, " HTTPS://x ", "HTTPS://x"),
        (lambda s: text.link_parameter(s, "page-id"), "x#page-id={ab%2Dc}&end", "{AB-C}"),
        (lambda s: text.link_parameter(s, "page-id"), "PAGE-ID=abc", "{ABC}"),
        (lambda s: text.relative_path(F.lit("a/b"), s), "a/c/d.md", "../c/d.md"),
        (lambda s: text.relative_path(F.lit(""), s), "a/c.md", "a/c.md"),
        (lambda s: text.wikilink(F.lit("T"), s), " a|[b]\n", "[[T|a-b]]"),
        (lambda s: text.wikilink(s, s, embed=True), "T", "![[T]]"),
    ],
)
def test_text(spark, function, value, want):
    assert one(spark, function, value) == want


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="\x00"), max_size=40))
def test_round_trips(spark, s):
    row = spark.createDataFrame([(s,)], "s string").select(text.url_decode(text.url_encode_path(F.col("s"))).alias("url"), text.base64_lines(F.encode("s", "UTF-8")).alias("b"), F.octet_length(text.file_name(F.col("s"), 20)).alias("n")).first()
    assert row["url"] == s
    assert base64.b64decode(row["b"]) == s.encode()
    assert 0 < row["n"] <= 21 or s == ""


def test_base64_lines(spark):
    b = bytes(range(200))
    assert one(spark, text.base64_lines, b, "binary") == base64.encodebytes(b).decode()


def test_times(spark):
    assert one(spark, numbers.filetime_iso, 116444736000000000 + 86_400 * 10_000_000, "decimal(20,0)") == "1970-01-02T00:00:00Z"
    assert one(spark, numbers.filetime_iso, 5, "decimal(20,0)") == ""
    assert one(spark, numbers.filetime_iso, 2**64 - 1, "decimal(20,0)") == ""
    assert one(spark, numbers.time32_iso, 0, "long") == ""
    assert one(spark, numbers.time32_iso, 86_400, "long") == "1980-01-02T00:00:00Z"
    assert one(spark, numbers.compact_time, "2024-01-02T03:04:05Z") == "20240102T030405Z"
    assert one(spark, numbers.compact_time, "x") == ""


def test_numbers(spark):
    assert one(spark, numbers.color_hex, 0x00332211, "long") == "#112233"
    assert one(spark, numbers.color_hex, 0xFF332211, "long") is None
    assert one(spark, numbers.guid_text, bytes(range(16)), "binary") == "03020100-0504-0706-0809-0a0b0c0d0e0f"
    for raw, want in ((b"\x89PNG\r\n\x1a\n..", "png"), (b"\xff\xd8\xff\xe0", "jpg"), (b"RIFF1234WEBPxx", "webp"), (b"<?xml version='1.0'?><svg>", "svg"), (b"%PDF-1", "pdf"), (b"", ""), (b"hello", "")):
        assert one(spark, numbers.image_type, raw, "binary") == want
    for x in (0.0, -0.001, 0.125, 0.375, 1.005, -12.5, 100.0, 1234.567, 0.1 + 0.2):
        want = f"{x:.2f}".rstrip("0").rstrip(".")
        assert one(spark, ink.fixed2, x, "double") == ("0" if want == "-0" else want)


def greedy(names, reserved=()):
    used, out = {r.lower() for r in reserved}, []
    for n in names:
        c, i = n, 2
        while c.lower() in used:
            c, i = f"{n} ({i})", i + 1
        used.add(c.lower())
        out.append(c)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "A", "a (2)", "a (2) (2)", "A (3)", "b", "assets", "assets (2)", " (2)", "(2)"]), max_size=14))
def test_unique_names(spark, names):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate(names)], "g string, i int, n string")
    got = [r["unique_name"] for r in sequence.unique_names(rows, "g", "i", "n", ("assets",)).orderBy("i").collect()]
    assert got == greedy(names, ("assets",))


def test_unique_names_with_clash(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate(["a", "a (2)", "a", "A"])], "g string, i int, n string")
    assert [r["unique_name"] for r in sequence.unique_names(rows, "g", "i", "n").orderBy("i").collect()] == ["a", "a (2)", "a (3)", "A (4)"]


def test_ancestry_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (8, 9), (9, 8)], "n long, p long")
    got = {(r[0], r[1], r[2]) for r in graph.ancestry(spark, edges, "n", "p", most=4).collect()}
    assert {(4, 4, 0), (4, 3, 1), (4, 2, 2), (4, 1, 3), (1, 1, 0)} <= got and max(d for _, _, d in got) <= 4


def test_nearest_declaration_over_a_long_chain(spark, tmp_path):
    """A chain of 1,500 whose first order alone is declared: every revision finds it, at any distance."""
    from leafmill.plans import registry

    spark.sql("SELECT id AS o_orderkey, 1L AS o_custkey, timestamp_seconds(id) AS o_orderdate, IF(id = 0, 'F', 'O') AS o_orderstatus FROM range(1500)").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["revision"]: (r["declared"], r["depth"]) for r in registry.QUERIES["nearest_declaration"](spark, str(tmp_path)).collect()}
    assert got == {i: (0, i) for i in range(1500)}


def test_nearest_declared_with_cycles(spark):
    edges = spark.createDataFrame([(1, None, "a"), (2, 1, None), (3, 2, None), (4, 5, None), (5, 4, None), (6, 4, None), (7, 8, None), (8, 7, "b"), (9, 99, None)], "n long, p long, v string")
    assert {tuple(r) for r in graph.nearest_declared(edges, "n", "p", "v").collect()} == {(1, "a", 0), (2, "a", 1), (3, "a", 2), (7, "b", 1), (8, "b", 0)}


def test_picture_round_trip():
    picture = ink.drawing(np.array([[0.0, 0.0], [500.0, 300.0]]), 53.0, (255, 0, 0))
    data = ink.png(picture)
    at, parts = 8, {}
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", data, at + 8 + n)[0] == zlib.crc32(kind + body)
        parts[kind] = body
        at += 12 + n
    w, h = struct.unpack(">II", parts[b"IHDR"][:8])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, 1 + 3 * w)
    assert (rows[:, 1:].reshape(h, w, 3) == picture).all() and (picture == [255, 0, 0]).all(2).sum() > 50


def test_cabinets(spark):
    entries = [("d\\a.txt", b"x" * 70_000), ("é.txt", b""), ("b.bin", bytes(range(256)) * 300)]
    whole = cabinet.build(entries)
    assert list(cabinet.files(whole)) == [(n.replace("\\", "/"), c) for n, c in entries]
    bad = bytearray(whole)
    for i in range(150, len(bad), 7):
        bad[i] ^= 0xFF
    rows = spark.createDataFrame([("ok", whole), ("bad", bytes(bad)), ("junk", b"\xab" * 4096), ("none", b"")], "archive string, content binary")
    got = cabinet.extract(rows).collect()
    assert [(r["path"], hashlib.md5(r["content"]).hexdigest()) for r in got if r["archive"] == "ok"] == [(n.replace("\\", "/"), hashlib.md5(c).hexdigest()) for n, c in entries]
    assert {r["archive"] for r in got if r["error"]} == {"bad", "junk", "none"}


def test_pages(spark):
    rows = [("p", 0, "heading", 0, "T*"), ("p", 1, "ordered", 0, "one"), ("p", 2, "ordered", 1, "two"), ("p", 3, "done", 0, "d"), ("p", 4, "para", 0, "# no\nline"), ("p", 5, "ordered", 0, "again")]
    e = spark.createDataFrame(rows, "page string, pos int, kind string, depth int, text string")
    assert render.markdown_pages(e).first()["text"] == "# T\\*\n\n1. one\n    2. two\n- [x] d\n\n\\# no\\\nline\n\n1. again"
    html = render.html_pages(e).first()["text"]
    assert "<ol><li>one</li>\n<li>two</li></ol>" in html and "<p># no<br>line</p>" in html


def test_fixed2_of_thousandths(spark):
    """As C prints them: ties and near-ties by the exact binary value."""
    values = [k / 1000 for k in range(-3000, 3001)] + [1.115, 0.005, 0.015, 0.125, 0.375, 2.5, 1e7 + 0.005, -0.005]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ink.fixed2(F.col("v")).alias("s")).collect()
    for r in rows:
        want = f"{r['v']:.2f}"
        want = want.rstrip("0").rstrip(".")
        assert r["s"] == ("0" if want == "-0" else want)


def test_deep_parents_and_trees(spark):
    """Levels beyond any usual depth; a long chain of nodes; a cycle hangs on no root."""
    pages = spark.createDataFrame([("s", i, i) for i in range(13)], "section string, seq int, level int")
    got = {r["seq"]: r["parent"] for r in sequence.parent_page(pages, "section", "seq", "level").collect()}
    assert got == {0: None, **{i: i - 1 for i in range(1, 13)}}
    nodes = [("n0", None, 1, "0"), *((f"n{i}", f"n{i - 1}", 1, str(i)) for i in range(1, 20)), ("x", "y", 1, "x"), ("y", "x", 1, "y")]
    tree = graph.tree_paths(spark, spark.createDataFrame(nodes, "id string, parent string, pos long, name string")).collect()
    assert sorted(r["depth"] for r in tree) == list(range(20))


def test_unique_names_keep_other_columns(spark):
    """Ids beside nulls that no double holds, carried along names with numbers of their own."""
    rows = [("g", 1, "a", 2**60 + 1), ("g", 2, "a", None), ("g", 3, "a (2)", 2**60 + 3), ("g", 4, "A", 5)]
    got = {r["o"]: (r["unique_name"], r["kept"]) for r in sequence.unique_names(spark.createDataFrame(rows, "g string, o int, name string, kept long"), "g", "o", "name").collect()}
    assert got == {1: ("a", 2**60 + 1), 2: ("a (2)", None), 3: ("a (2) (2)", 2**60 + 3), 4: ("A (3)", 5)}
    files = [("g", 1, "a.png"), ("g", 2, "a.png"), ("g", 3, "a-2.png"), ("g", 4, "A.PNG"), ("g", 5, "b"), ("g", 6, "b")]
    got = {r["o"]: r["unique_name"] for r in sequence.unique_names(spark.createDataFrame(files, "g string, o int, name string"), "g", "o", "name", files=True).collect()}
    assert got == {1: "a.png", 2: "a-2.png", 3: "a-2-2.png", 4: "A-3.PNG", 5: "b", 6: "b-2"}


def test_unique_names_of_nulls(spark):
    rows = [("g", 1, "a"), ("g", 2, None), ("g", 3, "A"), (None, 4, "a"), (None, 5, None), (None, 6, "a"), ("g", 7, "b (2)"), ("g", 8, "b"), ("g", 9, "b"), ("g", 10, "")]
    for files in (False, True):
        got = {r["o"]: r["unique_name"] for r in sequence.unique_names(spark.createDataFrame(rows, "g string, o int, name string"), "g", "o", "name", files=files).collect()}
        dash = (lambda k: f"-{k}") if files else (lambda k: f" ({k})")
        assert got == {1: "a", 2: None, 3: f"A{dash(2)}", 4: "a", 5: None, 6: f"a{dash(2)}", 7: "b (2)", 8: "b", 9: "b-2" if files else "b (3)", 10: ""}


def test_parent_pages_of_any_levels(spark):
    import random

    r = random.Random(1)
    rows = [(f"s{i % 3}" if i % 3 else None, i, r.choice([0, 1, 1, 2, 2, 3, 7, 300, None])) for i in range(200)]
    want = {}
    for s, i, k in rows:
        lower = [(j, m) for t, j, m in rows if t == s and j < i and k is not None and m is not None and m < k]
        want[i] = lower[-1][0] if lower and lower[-1][1] == k - 1 else None
    pages = spark.createDataFrame(rows, "section string, seq int, level int").repartition(3)
    assert {x["seq"]: x["parent"] for x in sequence.parent_page(pages, "section", "seq", "level").collect()} == want
    assert sequence.parent_page(pages.limit(0), "section", "seq", "level").count() == 0
