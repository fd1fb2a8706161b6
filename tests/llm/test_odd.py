"""Each operator on odd inputs, against its plain version; and on empty tables."""

import random
import time
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, lines, lm, mix, near, qda, rules, secrets, token_ids, warc
from leafmill.llm.queries import TOKENIZER


def rows(df, *columns):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect())


def test_secrets(odd, none, pairs):
    got = rows(secrets.digest(secrets.secret_spans(odd)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    want = Counter()
    names = [*secrets.PATTERNS, "entropy"]
    for i, t in pairs:
        base = brute.secrets(t)
        every = sorted(base + brute.random_spans(t, secrets.CANDIDATE, secrets.ALLOW, secrets.HOLDERS, secrets.CLASSES, secrets.WINDOW))
        said = lambda s: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in s)
        want[(i, *(sum(k == n for _, k, _ in base) for n in range(3)), brute.sha(said(base)), said(every))] += 1
    assert got == want
    assert secrets.secret_spans(none).count() == 0


def test_redaction(spark):
    d = spark.createDataFrame([(1, "é password=hunter22 and token: abcdef0123456789abcdef0123456789 end"), (2, "nothing")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in secrets.redacted(d).collect()} == {1: "é [secret] and [secret] end", 2: "nothing"}


def test_targets(spark, odd):
    sizes = odd.select("source", mix.n_words(F.col("text")).alias("size"))
    want = brute.targets([(r["source"], r["size"]) for r in sizes.collect()])
    got = {r["source"]: (r["source_size"], r["target"]) for r in mix.source_targets(sizes).collect()}
    assert got.keys() == want.keys()
    for s, (n, t) in want.items():
        assert got[s][0] == n and got[s][1] == pytest.approx(t)


def test_mix(odd, none):
    once = rows(mix.mix(odd), "doc_id", "source", "size", "source_size", "target", "taken")
    assert once == rows(mix.mix(odd), "doc_id", "source", "size", "source_size", "target", "taken")
    assert sum(once.values()) == odd.count()
    for (_, _, size, _, _, taken), _ in once.items():
        assert taken % max(size, 1) == 0 and taken <= 2 * size
    taken, target = Counter(), {}
    for (_, source, _, _, t, n), k in once.items():
        taken[source] += n * k
        target[source] = t
    assert taken["b"] <= target["b"] + 120 and taken["d"] <= target["d"] + 25_000
    assert mix.mix(none).count() == 0
    copies = mix.mixed_documents(odd)
    assert copies.columns == odd.columns
    assert Counter(r["doc_id"] for r in copies.collect()) == Counter({i: n for i, n in ((r["doc_id"], r["n"]) for r in mix.mix(odd).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()) if n})
    assert mix.mixed_documents(none).count() == 0


@pytest.mark.parametrize("size", [4, 5])
def test_near(odd, none, pairs, size):
    want = brute.near([p for p in pairs if p[0] is not None], size)
    for r in near.near_duplicates(odd, size=size).collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert near.near_duplicates(none, size=size).count() == 0


def test_deduplicated(odd, pairs):
    want = brute.near([p for p in pairs if p[0] is not None], 5)
    got = near.deduplicated(odd, size=5)
    assert got.columns == odd.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(i for i, _ in pairs if i is None or want[i][1] == i)


def test_rules(odd, none, labels, pairs):
    got = rows(rules.quality_rules(odd, labels), "doc_id", *rules.COUNTS, "base_failed")
    assert got == Counter((i, *brute.rules(t)) for i, t in pairs)
    assert rules.quality_rules(none, labels).count() == 0
    assert rules.quality_rules(odd, labels.filter("false")).filter("kept").count() > 0


def test_classifier(odd, none, labels, pairs):
    for some in (labels, labels.filter("false"), labels.filter("quality = 1")):
        got = qda.quality_scores(odd, some).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in pairs)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == brute.held_out(r["doc_id"], 4, 2) for r in got)
    assert qda.quality_scores(none, labels).count() == 0
    assert qda.good_documents(odd, labels).columns == odd.columns


@pytest.mark.parametrize("block_words", [1 << 20, 12])
def test_contamination(spark, odd, none, pairs, block_words):
    texts = [t for _, t in pairs if t]
    items = [(1, " ".join(texts[0].split()[5:40])), (2, "one two"), (3, None), (None, "ONE, two!"), (10, ""), (2, "x y z w"), (5, "𝒳𝒴 é"), (7, " ".join(texts[0].split()[20:30]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    got = rows(decontaminate.decontaminate(odd, bench, block_words=block_words), "doc_id", "n_words", "n_hit", "items")
    want = Counter((i, n, h, tuple(of)) for (i, _), (n, h, of) in zip(pairs, brute.contamination([t for _, t in pairs], items), strict=True))
    assert got == want
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.filter("false")).filter("n_hit > 0").count() == 0
    kept = decontaminate.clean_documents(odd, bench, block_words=block_words)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for (i, _, h, _), k in want.items() if not h for _ in range(k))


def test_spans_are_removed(spark):
    d = spark.createDataFrame([(1, "Keep this. A b c d e f g h i j, k; and keep that."), (2, "all clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    found = decontaminate.decontaminate(d, bench)
    assert {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(d, found).collect()} == {1: "Keep this. ; and keep that.", 2: "all clean"}


def test_blocks_go_by_words(spark, odd, pairs):
    """A benchmark of twenty partitions is one block, or as many as its words need; results are the same."""
    items = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(8 + i % 9))) for i in range(60)] + [(99, None), (98, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(20)
    docs = spark.createDataFrame([(i, " ".join(f"W{(i * 3 + k) % 90}" for k in range(5 + 11 * i))) for i in range(30)], "doc_id long, text string").repartition(4)
    assert len(decontaminate.blocks(bench, 10, 1 << 20, "item_id", "text")) == 1
    assert 3 <= len(decontaminate.blocks(bench, 10, 200, "item_id", "text")) <= 5
    one, many = (rows(decontaminate.decontaminate(docs, bench, block_words=n), "doc_id", "n_words", "n_hit", "items") for n in (1 << 20, 200))
    assert one == many and any(r[2] for r in one)


def test_token_ids_refuse_other_ids(odd):
    with pytest.raises(ValueError, match="doc_id"):
        token_ids.token_ids(odd.withColumn("doc_id", F.col("doc_id").cast("string")), TOKENIZER)


def test_lines(odd, none, pairs):
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in lines.line_dedup(odd).collect()}
    # The plain version wants distinct ids: the null ones are the smallest, and rows that repeat an id go together.
    small = [(-(2**70), t) if i is None else (i, t) for i, t in pairs if t is not None or i is not None]
    want = {(None if i == -(2**70) else i, *v) for i, v in brute.lines(small).items()} | {(None, 1, 0, "")}
    assert got == want
    assert lines.line_dedup(odd).count() == len(pairs) and lines.line_dedup(none).count() == 0


def test_language_model(odd, none, pairs):
    want, n = brute.base_scores(pairs)
    got = lm.lm_scores(odd, head_words=40, model_words=20, first_share=1).collect()
    assert {r["train_tokens"] for r in got} == {n}
    have = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got)
    assert have == Counter((i, brute.held_out(i, 5, 1), a, b, round(c, 4)) for (i, _), (a, b, c) in zip(pairs, want, strict=True))
    assert all(r["score"] < 0 for r in got)
    assert lm.lm_scores(none).count() == 0


def test_language_model_learns_every_word_of_a_long_text(spark):
    """The order of two words, wherever they stand in a training text, changes the model and with it the score of another text."""
    r = random.Random(7)
    text = [f"w{r.randrange(400)}" for _ in range(3000)]

    def score(at):
        changed = [*text[:at], text[at + 1], text[at], *text[at + 2 :]]
        docs = spark.createDataFrame([(1, " ".join(changed)), (4, " ".join(text[:400]))], "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: r for r in lm.lm_scores(docs, first_share=2).collect()}
        return got[4]["score"], got[4]["base_score"]

    places = [at for at in (10, 700, 1500, 2990) if text[at] != text[at + 1]]
    found = [score(at) for at in places]
    assert len(places) > 2 and len({s for s, _ in found}) == len(places) and len({b for _, b in found}) == 1


def test_language_model_knows_frequent_words_of_any_rank(spark):
    """Words that stand often are words of the model, however many stand more often: their order changes a text's score."""
    r = random.Random(3)
    text = [f"w{i}" for i in range(1200) for _ in range(120)] + ["u", "v"] * 110
    r.shuffle(text)
    docs = spark.createDataFrame([(1, " ".join(text)), (4, "u v v v u"), (9, "v u v v u")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, first_share=3, first_task_words=50).collect()}
    assert got[4]["base_score"] == pytest.approx(got[9]["base_score"]) and got[4]["score"] != pytest.approx(got[9]["score"], abs=1e-6)


def test_mix_of_a_small_source_beside_a_large_one(spark):
    """A small source is drawn as it is without the large one: of several draws, whatever the size of others."""
    r = random.Random(5)
    small = [(i, " ".join(["w"] * r.randrange(200, 4000)), "b") for i in range(40)]
    large = [(1000 + i, "w " * (1 + i % 9), "a") for i in range(5000)]
    got = mix.mix(spark.createDataFrame(small + large, "doc_id long, text string, source string")).collect()
    assert len(got) == 5040
    own = [x for x in got if x["source"] == "b"]
    assert len(own) == 40 and abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 0.001 * own[0]["target"]


def test_mix_keeps_ids_and_repeated_rows(spark):
    """Ids that no double holds, beside nulls; very many rows of one id; columns with the operator's own names."""
    ids = [2**60 + 1, 2**60 + 3, 2**60 + 5, None, -(2**60) - 1]
    docs = spark.createDataFrame([(i, " ".join(["w"] * (k + 1)), "a", k) for k, i in enumerate(ids)] + [(None, "x y z", "b", 7)] * 1000, "doc_id long, text string, source string, _mix_key long")
    got = mix.mix(docs, most=3.0).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([*ids, *[None] * 1000])
    taken = Counter({(r["doc_id"], r["source"], r["size"]): 0 for r in got})
    for r in got:
        taken[r["doc_id"], r["source"], r["size"]] += r["copies"]
    mixed = mix.mixed_documents(docs, most=3.0)
    assert mixed.columns == docs.columns
    assert Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in mixed.collect()) == +taken


def test_secrets_of_long_runs(spark):
    """A megabyte of one word's letters, of base64, and of letters with a key at its end: time grows with the length alone."""
    r = random.Random(1)
    word = "notsecretatall" * 71_429
    digits = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    docs = spark.createDataFrame([(1, word), (2, f"{word[:1_000_000]} token=abcDEF123"), (3, f"see {digits} end")], "doc_id long, text string").repartition(3)
    began = time.time()
    got = {r["doc_id"]: [(s["name"], s["begin"], s["end"]) for s in r["spans"]] for r in secrets.secret_spans(docs).collect()}
    assert time.time() - began < 60
    assert got[1] == [] and got[2] == [("assign", 1_000_001, 1_000_016)]
    assert [s for s in got[3] if s[0] == "entropy"] == [("entropy", 4, 1_000_004)]


def test_secrets_of_letters_and_beside_holders(spark):
    r = random.Random(7)
    pairs = [(i, "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(24 + 97 * (i % 9)))) for i in range(40)]
    pairs += [(100 + i, "/".join([t[:40], r.choice(["example", "your-key", "xXxXx", "0123456789"]), t[40:]])) for i, t in pairs if len(t) > 100]
    found = {x["doc_id"]: [(s["begin"], s["kind"], s["end"]) for s in x["spans"] if s["name"] == "entropy"] for x in secrets.secret_spans(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert found == {i: brute.random_spans(t, secrets.CANDIDATE, secrets.ALLOW, secrets.HOLDERS, secrets.CLASSES, secrets.WINDOW) for i, t in pairs}
    assert sum(bool(found[i]) for i in range(40)) >= 36 and all(found[i] for i in found if i >= 100)


def test_classifier_takes_ids_of_any_kind(spark, odd, labels):
    text = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert qda.quality_scores(text(odd), text(labels)).count() == odd.count()


def test_token_ids(odd, none, pairs):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    at, want = 0, []
    for i, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for options in ({}, {"file_ids": 100, "block": 64, "planes": 32}):
        got = [tuple(r) for r in token_ids.token_ids(odd, TOKENIZER, **options).orderBy("start").collect()]
        assert got == want
    assert token_ids.token_ids(none, TOKENIZER).count() == 0


def test_archives(spark):
    data = [(1, "http://a/b c", "<p>é</p>"), (2, None, "<p>é</p>"), (2, "u", "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "x" * 300_000), (6, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*d, 1) for d in data], "page_id long, url string, html string, keeper long")
    got = [r for r in warc.archive_pages(pages, file_bytes=500).collect()]
    assert {r["kind"] for r in got} == {"record"} and len(got) == len(data)
    have = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    want = Counter()
    for i, _, html in data:
        raw = (html or "").encode()
        top = max((j for j, _, h in data if j is not None and (h or "").encode() == raw), default=None)
        want[(i, len(raw), warc.sha1_base32(raw), "response" if i == top else "revisit", None if i == top else top)] += 1
    assert have == want
    small = warc.archive_pages(pages, min_bytes=5)
    assert small.filter("record_type = 'revisit'").count() == 2
    assert warc.archive_pages(pages.filter("false")).count() == 0
