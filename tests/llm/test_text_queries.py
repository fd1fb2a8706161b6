"""The registered queries on the smallest tables: against SQL where there is any, else against plain versions."""

from collections import Counter

import brute
import numpy as np
import pytest
from oracle import same

import corpus_pipeline
from leafmill.llm import queries
from leafmill.llm.common import materialise, table


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, data, name):
    same(queries.QUERIES[name], queries.SQL[name], spark, data)


def test_mixing(spark, data):
    rows = queries.op2_mixing(spark, data).collect()
    docs = {r["doc_id"]: r for r in table(spark, data, "documents").collect()}
    want = brute.targets([(r["source"], len(brute.WORD.findall(r["text"] or ""))) for r in docs.values()])
    taken = Counter()
    for r in rows:
        size, target = want[docs[r["doc_id"]]["source"]]
        assert r["source_size"] == size and r["target"] == pytest.approx(target) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[docs[r["doc_id"]]["source"]] += r["taken"]
    assert len(rows) == len(docs)
    for s, (size, target) in want.items():
        assert abs(taken[s] - target) <= 0.08 * size + 100


def test_rules(spark, data):
    texts = {r["doc_id"]: r["text"] for r in table(spark, data, "documents").collect()}
    rows = queries.op4_quality_rules(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.rules(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_rules_learn_from_labels(spark, data):
    """What the trees say of labelled documents that no fixed rule fails, against the labels."""
    larger = data.replace("sf0.001", "sf0.01")
    label = {r["doc_id"]: r["quality"] for r in table(spark, larger, "labels").collect()}
    docs = table(spark, larger, "documents")
    half = table(spark, larger, "labels").filter("doc_id % 2 = 0")
    rows = [r for r in queries.rules.quality_rules(docs, half).collect() if not r["base_failed"] and r["doc_id"] in label and r["doc_id"] % 2]
    good, bad = ([r["kept"] for r in rows if label[r["doc_id"]] == k] for k in (1, 0))
    assert len(good) > 50 and len(bad) > 10 and np.mean(good) > 0.9 and np.mean(good) - np.mean(bad) > 0.5


def test_token_ids_are_those_of_the_tokenizer(spark, data):
    import zlib

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.TOKENIZER)
    texts = sorted((r["doc_id"], r["text"] or "") for r in table(spark, data, "documents").collect())
    want, start = [], 0
    for i, text in texts:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op10_token_ids(spark, data).collect()) == want


def test_classifier_on_held_out_rows(spark, data):
    larger = data.replace("sf0.001", "sf0.01")
    label = {r["doc_id"]: r["quality"] for r in table(spark, larger, "labels").collect()}
    rows = [r for r in queries.op5_quality_classifier(spark, larger).collect() if r["held_out"] and r["doc_id"] in label]
    assert all(brute.held_out(r["doc_id"], 4, 2) for r in rows)
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in rows]) > 0.93
    good, bad = ([r["score"] for r in rows if label[r["doc_id"]] == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_language_model(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    want, n = brute.base_scores(docs)
    got = {r["doc_id"]: r for r in queries.op8_lm_scoring(spark, data).collect()}
    for (i, _), (tokens, known, base) in zip(docs, want, strict=True):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, brute.held_out(i, 5, 1)) and r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_pipeline(spark, data):
    docs = table(spark, data, "documents")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = []
    for f in stages[:-1]:
        docs = materialise(f(spark, docs, data), "test-stage")
        assert docs.columns == columns
        kept.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    good = {r["doc_id"] for r in queries.op5_quality_classifier(spark, data).collect() if r["predicted"]}
    assert {i for i, _ in kept[0]} == good
    groups = brute.near(kept[0], 5)
    assert sorted(i for i, _ in kept[1]) == sorted(i for i, (_, c) in groups.items() if c == i)
    items = [(r["item_id"], r["text"]) for r in table(spark, data, "benchmark").collect()]
    assert sorted(i for i, _ in kept[2]) == sorted(i for (i, _), (_, h, _) in zip(kept[1], brute.contamination([t for _, t in kept[1]], items), strict=True) if not h)
    times = Counter(i for i, _ in kept[3])
    assert set(times) <= {i for i, _ in kept[2]} and max(times.values()) <= 2
    last = stages[-1](spark, docs, data).orderBy("start").collect()
    assert Counter(r["doc_id"] for r in last) == times
    assert [r["start"] for r in last] == np.cumsum([0, *(r["n_tokens"] for r in last)])[:-1].tolist()
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, data).collect()) == sorted(times.elements())
