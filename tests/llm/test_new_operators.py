"""Filter audit, suffix-array dedup and Merkle manifest against plain versions, on odd and larger inputs."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import audit, manifest, queries, repeats, suffixes
from leafmill.llm.common import table


def test_filter_audit(odd, none, labels):
    got = {(r["part"], r["filter_order"], r["step"]): [r[s] for s in audit.SUMS] for r in audit.filter_audit(odd, labels).collect()}
    want = brute.audit([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], [tuple(r) for r in labels.collect()])
    assert got == want
    assert audit.filter_audit(none, labels).count() == 0
    assert {r["good_lost"] for r in audit.filter_audit(odd, labels.limit(0)).collect()} == {0}


def test_audit_adds_up(spark, data):
    """Along each order, what stays and what all steps removed are the part; the parts are the table."""
    steps = queries.op11_filter_audit(spark, data).groupBy("part", "filter_order").agg(F.sum("removed").alias("r"), F.min("kept").alias("k"))
    totals = {(r["part"], r["r"] + r["k"]) for r in steps.collect()}
    assert totals == {(r["part"], r["count"]) for r in table(spark, data, "documents").groupBy(F.coalesce("source", F.lit("")).alias("part")).count().collect()}


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_array(letters):
    r = np.random.default_rng(letters)
    for n in [*range(25), 100, 500]:
        s = r.integers(1, letters + 1, n)
        assert suffixes.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_anchors_depend_on_the_string_alone():
    """Whatever stands around it, a string has one print at one distance; and each string has exactly one anchor."""
    r = random.Random(1)
    inner = bytes(r.choice(b"abc") for _ in range(60))
    seen = set()
    for _ in range(40):
        texts = [bytes(r.choice(b"abcd") for _ in range(r.randrange(50))) + inner + bytes(r.choice(b"abcd") for _ in range(r.randrange(50))), b"", b"a" * 45]
        found = [np.concatenate(x) for x in zip(*repeats.anchors(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), 40), strict=True)]
        strings = Counter()
        for row, begin, n, anchor, prints in zip(*(x.tolist() for x in found), strict=True):
            for k in range(n):
                strings[row, begin + k] += 1
                if row == 0 and begin + k == texts[0].index(inner) + 7:
                    seen.add((prints, anchor - k))
        assert strings == Counter((row, i) for row, t in enumerate(texts) for i in range(len(t) - 39))
    assert len(seen) == 1


def plain_repeats(docs, length):
    rows = docs.select("doc_id", "text").collect()
    return Counter((r["doc_id"], *x, len((r["text"] or "").encode())) for r, x in zip(rows, brute.repeats([r["text"] for r in rows], length), strict=True))


def removed(docs, length):
    return Counter((r["doc_id"], bytes(r["kept"]), tuple((s["begin"], s["end"]) for s in r["spans"]), r["n_bytes"]) for r in repeats.suffix_dedup(docs, length).collect())


def test_suffix_dedup_of_odd_texts(odd, none):
    assert removed(odd, 30) == plain_repeats(odd, 30)
    assert removed(odd.limit(12), repeats.LENGTH) == plain_repeats(odd.limit(12), repeats.LENGTH)
    assert repeats.suffix_dedup(none).count() == 0


@pytest.mark.parametrize("most", [repeats.MOST, 3])
def test_suffix_dedup_of_many_copies(spark, monkeypatch, most):
    """Near copies, runs of one letter, periods, and texts around the length; small groups and, with few contexts allowed,
    groups that are told apart string by string."""
    monkeypatch.setattr(repeats, "MOST", most)
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh é") for _ in range(700))
    rows = []
    for i in range(50):
        a = r.randrange(600)
        kinds = [base, f"{base[:a]}X{base[a + 1:]}", "a" * r.randrange(130), "ab" * r.randrange(90) + base[100:200], "".join(r.choice("ab") for _ in range(300)), f"x𝒳{i}{base[a : a + r.randrange(200)]}y{i}"]
        rows.append((i if i % 7 else None, r.choice(kinds)))
    docs = spark.createDataFrame([*rows, (3, base), (3, base), (3, None)], "doc_id long, text string").repartition(3)
    assert removed(docs, 50) == plain_repeats(docs, 50)


def test_steps_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 97)
    r = random.Random(2)
    base = "".join(r.choice("abcdef") for _ in range(1500))
    docs = spark.createDataFrame([(1, base), (2, "q" + base[300:1200]), (3, base[1000:] + base[:400])], "doc_id long, text string")
    assert removed(docs, 40) == plain_repeats(docs, 40)


def test_suffix_dedup_query(spark, data):
    docs = table(spark, data, "documents")
    want = Counter((i, n, n - len(kept), len(spans)) for (i, kept, spans, n), k in plain_repeats(docs, 400).items() for _ in range(k))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in queries.op12_suffix_dedup(spark, data).collect())
    assert got == want


def sorted_rows(rows):
    return sorted(rows, key=str)


def test_manifest(odd, none):
    rows = odd.withColumn("n_chars", F.char_length("text").cast("long"))
    got = [tuple(r) for r in manifest.digest(manifest.audit(rows)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted_rows(got) == sorted_rows(brute.manifest([tuple(r) for r in rows.select(*manifest.FIELDS).collect()]))
    assert manifest.audit(none.withColumn("n_chars", F.lit(1))).count() == 0


@pytest.mark.parametrize("n", [1, 8, 9, 65, 700])
def test_manifest_of_sizes(spark, monkeypatch, n):
    """Full and ragged runs, several blocks and rounds, a group of one."""
    rows = [(i * 3, f"s{i % 5}", "a" if i else None, i, f"Text {i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = [tuple(r) for r in manifest.digest(manifest.audit(docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted_rows(got) == sorted_rows(brute.manifest(rows))


def test_manifest_without_crc(spark):
    docs = spark.createDataFrame([(1, "A"), (2, None)], "doc_id long, text string").withColumns({"source": F.lit(None).cast("string"), "lang": F.lit("en"), "n_chars": F.lit(1)})
    found = {r["doc_id"]: r for r in manifest.manifest(docs).withColumn("again", manifest.folded(F.col("leaf"), F.col("proof"))).collect()}
    assert all(r["again"] == r["root"] and len(r["proof"]) == 1 for r in found.values())


@given(st.lists(st.integers(1, 3), max_size=80), st.integers(1, 9), st.integers(1, 30), st.randoms())
@settings(deadline=None)
def test_strings_agree(letters, length, most, r):
    """Runs of strings are compared letter by letter, each letter once, in steps of any size."""
    text = np.array(letters, np.uint16)
    at = np.array(r.sample(range(max(0, len(letters) - length + 1)), max(0, len(letters) - length + 1)), np.int64)
    other = np.array([r.choice([max(0, x - 1), max(0, x - 3), r.choice(at.tolist())]) for x in at.tolist()], np.int64)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffixes, "COMPARED", most)
        got = suffixes.agree(text, at, other, length)
    assert got.tolist() == [letters[a : a + length] == letters[b : b + length] for a, b in zip(at.tolist(), other.tolist(), strict=True)]
