"""The operators' parts by themselves: round trips, damage, gradients, balance, accuracy."""

import gzip
import random
import time

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import common, graph, gru, mix, near, rules, shingles, token_ids, warc
from leafmill.llm.fm_index import FmIndex, suffix_array
from leafmill.llm.queries import TOKENIZER


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(1, 3), min_size=1, max_size=4))
@settings(deadline=None)
def test_fm_index(middle, pattern):
    s = np.array([0, *middle, 0])
    index = FmIndex(s, 4, sample=3)
    low, high = index.search(np.array([pattern]))
    want = [i for i in range(len(s) - len(pattern) + 1) if s[i : i + len(pattern)].tolist() == pattern]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_suffix_array_of_repeats():
    s = np.array([0, *[1] * 500, 0, *[1] * 499, 0])
    order = suffix_array(s)
    assert sorted(order.tolist()) == list(range(len(s)))


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([4, 32]), st.integers(1, 70))
@settings(deadline=None)
def test_id_files(ids, planes, block):
    ids = np.array(ids, "<u4")
    half = len(ids) // 2
    f = token_ids.IdFile(token_ids.encode_file(ids, [None, 7], [half, len(ids) - half], 3, 4, block, planes))
    assert (f.ids() == ids).all() and f.doc_ids == [None, 7] and f.counts.tolist() == [half, len(ids) - half] and (f.part, f.sequence) == (3, 4)
    assert (f.ids(half // 2, half) == ids[half // 2 : half]).all()


def test_damaged_id_file():
    data = bytearray(token_ids.encode_file(np.arange(5000), [1], [5000], block=512))
    with pytest.raises(token_ids.DamagedFile):
        token_ids.IdFile(bytes(data[:-3]))
    data[10] ^= 1
    with pytest.raises(Exception):  # noqa: B017  zstandard's or the check's
        token_ids.IdFile(bytes(data)).ids()


@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=30), min_size=1, max_size=5))
@settings(deadline=None, max_examples=150)
def test_word_encoder(texts):
    e = token_ids._encoder(TOKENIZER)
    array = common.strings(pa.array(texts))
    ids, counts = e(array, 1)
    at = common.starts(counts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 1]


@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=20), min_size=1, max_size=5))
@settings(deadline=None)
def test_words(texts):
    import brute

    flat, counts = common.words(common.strings(pa.array(texts)))
    assert flat.to_pylist() == [w for t in texts for w in brute.WORD.findall(t)]
    assert counts.tolist() == [len(brute.WORD.findall(t)) for t in texts]


def test_slices_of_a_batch_are_whole():
    texts = [f"text {i} " * (i % 7) for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    got = []
    for piece in common.slices(iter([batch]), "text", 60):
        got += common.translated(common.strings(piece.column("text")), common.LOWER_TABLE).to_pylist()
    assert got == texts


def test_salvage():
    parts = [warc.record(i, f"http://x/{i}", f"payload {i} ".encode() * 9) for i in range(6)]
    plain, packed = b"".join(parts), [gzip.compress(p) for p in parts]
    whole = list(warc.salvage(plain))
    assert [warc.page_of(r.headers["warc-record-id"]) for r in whole] == list(range(6)) and [r.payload for r in whole] == [f"payload {i} ".encode() * 9 for i in range(6)]
    # A broken record in the middle, and one cut short at the end.
    bad = bytearray(plain)
    at = len(parts[0]) + len(parts[1])
    bad[at + len(parts[2]) - 20] ^= 1
    found = list(warc.salvage(bytes(bad[:-5])))
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found if isinstance(r, warc.Record)] == [0, 1, 3, 4]
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert (gaps[0].offset, gaps[0].end) == (at, at + len(parts[2])) and "digest" in gaps[0].reason and gaps[1].end == len(bad) - 5
    # The same in members, with junk between two of them.
    members = [*packed[:2], packed[2][:30], b"junk", *packed[3:5], packed[5][:-9]]
    found = list(warc.salvage(b"".join(members)))
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found if isinstance(r, warc.Record)] == [0, 1, 3, 4]
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert (gaps[0].offset, gaps[0].end) == (len(packed[0] + packed[1]), len(packed[0] + packed[1]) + 34)
    assert list(warc.salvage(b"")) == [] and [type(x) for x in warc.salvage(b"nothing here")] == [warc.Gap]


def test_salvage_through_spark(spark, tmp_path):
    good = gzip.compress(warc.record(1, "u", b"a"))
    (tmp_path / "x.warc.gz").write_bytes(good + good[:40] + good)
    got = warc.read_warcs(spark, f"file://{tmp_path}").orderBy("begin").collect()
    assert [(r["kind"], r["begin"], r["end"]) for r in got] == [("record", 0, None), ("gap", len(good), len(good) + 40), ("record", len(good) + 40, None)]


def test_salvage_takes_time_in_proportion():
    """Many small members, and a damaged file full of places where a record may seem to begin."""
    one = gzip.compress(warc.record(1, "u", b"a" * 40))
    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        assert sum(isinstance(x, warc.Record) for x in warc.salvage(one * n)) == n
        assert sum(isinstance(x, warc.Record) for x in warc.salvage(b"\x1f\x8b\x08" * n + one)) == 1
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def test_gradient():
    m = gru.Gru(20, hidden=4, classes=4, seed=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(0)
    given_ = r.integers(0, 20, (5, 3)), r.integers(0, 20, (5, 3)), r.normal(0, 0.3, (4, 3)), r.random((5, 3)) < 0.8
    _, g, _ = m.gradient(*given_)
    for k in m.NAMES:
        for _ in range(6):
            i = tuple(r.integers(0, s) for s in m.p[k].shape)
            if abs(m.p[k][i]) < 1e6:
                old, losses = m.p[k][i], []
                for e in (1e-5, -1e-5):
                    m.p[k][i] = old + e
                    losses.append(m.gradient(*given_)[0])
                m.p[k][i] = old
                assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[k][i], rel=2e-2, abs=2e-3)


def test_model_is_a_distribution_and_carries_state():
    m = gru.Gru(50, hidden=5, classes=7)
    h = np.random.default_rng(1).normal(0, 1, (1, 5)).astype(np.float32)
    assert np.exp(m.log_probability(np.repeat(h, 50, 0), np.arange(50))).sum() == pytest.approx(1, abs=1e-4)
    counts = np.array([3, 0, 200, 7])
    words = np.random.default_rng(2).integers(0, 50, counts.sum())
    assert m.score(words, counts, window=7) == pytest.approx(m.score(words, counts, window=1000), abs=1e-2)


def test_training_learns():
    pieces = [np.array([1, *([2, 3, 4] * 5), 1]) for _ in range(256)]
    m = gru.Gru(10, hidden=8, classes=3)
    before = m.score(np.array([2, 3, 4] * 5), np.array([15]))[0]
    gru.train(m, pieces, 0.02, epochs=40)
    assert m.score(np.array([2, 3, 4] * 5), np.array([15]))[0] > before / 4


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 500)), max_size=60), st.integers(0, 5))
@settings(deadline=None)
def test_flight_is_balanced(units, seed):
    p, size = [u[0] for u in units], [float(u[1]) for u in units]
    out = mix.flight(p, size, random.Random(seed))
    assert sum(0 < x < 1 for x in out) <= 2 or len(set(size)) == 1
    assert sum(out) == pytest.approx(sum(p), abs=1e-6)
    assert sum(x * s for x, s in zip(out, size, strict=True)) == pytest.approx(sum(x * s for x, s in zip(p, size, strict=True)), rel=1e-6, abs=1e-3)


def test_flight_keeps_probabilities():
    p, size = [0.3] * 12, [float(i % 5) for i in range(12)]
    flown = np.array([mix.flight(p, size, random.Random(s)) for s in range(2000)])
    assert (abs(flown.mean(0) - 0.3) < 0.05).all()
    assert {x for x in mix.landing(flown[0].tolist(), size)} <= {0.0, 1.0}


def test_trees_are_monotonic():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + r.normal(0, 0.2, 2000)) < 0.6).astype(int)
    t = rules.fit_trees(x, y, monotone={0: -1})
    grid = np.repeat(r.random((50, 3)), 40, 0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(t.probability(grid).reshape(50, 40)) <= 1e-12).all()
    assert ((t.probability(x) > 0.5) == y).mean() > 0.85


@given(st.lists(st.tuples(st.integers(-9, 40), st.integers(-9, 40)), max_size=40))
@settings(deadline=None)
def test_stars(edges):
    u, v = graph.stars(*(np.array([e[i] for e in edges], np.int64) for i in (0, 1)))
    want = brute.components({x for e in edges for x in e}, edges)
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {x: c for x, c in want.items() if x != c} and len(u) == len(set(u.tolist()))


def test_components_in_few_rounds(spark, monkeypatch):
    rounds, written = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: (rounds.append(name), written(df, name))[1])
    r = random.Random(5)
    # A path of all numbers in any order, a hub, pairs, a loop at one node; in one task, then in many.
    order = r.sample(range(200), 200)
    edges = [*zip(order, order[1:], strict=False), *((500, i) for i in range(501, 900)), *((i, i + 1) for i in range(1000, 1100, 3)), (7, 7)]
    want = brute.components({x for e in edges for x in e}, edges)
    for parts, most in ((1, 2), (8, 8)):
        rounds.clear()
        got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(parts), "test").collect()
        assert len(got) == len(want) and {x.node: x.component for x in got} == want
        assert len(rounds) <= most


def test_shingles_and_links():
    ranges = [(0, 100), (0, 100), (11, 111), (12, 112), (500, 503)]
    sets = [np.unique(shingles.mix64(np.arange(*r).astype(np.uint64))) for r in ranges]
    got = near.linked(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            k = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and 100 * k >= 80 * (len(a) + len(b) - k))
    assert sorted(near.forest(got)) == [(0, 1), (0, 2), (0, 3)]


def chain(n, words=40, over=10):
    """Texts of words of their own that each share some with the next, far from what links them."""
    step = words - over
    return [(i, " ".join(f"w{k}" for k in range(i * step, i * step + words))) for i in range(n)]


def test_chance_makes_no_cluster(spark, monkeypatch):
    """Texts that hang together by chance alone are compared in lists of two, not all with all."""
    monkeypatch.setattr(near, "BLOCK_TEXTS", 8)
    seen, links = [], near._block_links
    monkeypatch.setattr(near, "_block_links", lambda rows, *a: (seen.append(rows.count()), links(rows, *a))[1])
    got = near.near_duplicates(spark.createDataFrame(chain(300), "doc_id long, text string"), size=4)
    assert all(r["component_id"] == r["doc_id"] for r in got.collect())
    assert 300 < sum(seen) <= 4 * 300


def test_long_lists_by_bands(spark, monkeypatch):
    """Lists of more texts than a block, whose texts differ in length and are linked across bands."""
    monkeypatch.setattr(near, "BLOCK_TEXTS", 4)
    texts = [(i, " ".join(f"v{k}" for k in range(20 + 7 * i))) for i in range(14)] + [(100 + i, " ".join(f"v{k}" for k in range(5, 12))) for i in range(6)]
    want = brute.near(texts, 4)
    got = near.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), size=4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert len({c for _, c in want.values()}) > 2


def test_cells_grow_with_the_texts(spark, monkeypatch):
    """Values that all texts share make no lists, and cells without a member stay free, however small the tables begin."""
    monkeypatch.setattr(near, "CELLS", 8)
    rng = np.random.default_rng(5)
    common = rng.integers(-(2**62), 2**62, 12).tolist()
    rows = [(i, 100, sorted(common + rng.integers(-(2**62), 2**62, 20).tolist())) for i in range(200)]
    entries = near._entries(spark.createDataFrame(rows, "rep long, n long, sketch array<long>"), 80).collect()
    assert len(entries) == 200 * 20
    assert sum(r["value"] in common for r in entries) < 400
    marked = near._member_cells(spark.createDataFrame([(i, 0) for i in range(0, 3000, 30)], "rep long, cluster long"))
    assert marked.sum() <= 100 and len(marked) >= 800
    assert marked[np.arange(0, 3000, 30) % len(marked)].all()
