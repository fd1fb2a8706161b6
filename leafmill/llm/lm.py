"""Language-model scores of whole texts: word counts of the corpus, and a recurrent model over its frequent words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import LOWER_TABLE, bucket, coded, documents, materialise, slices, starts, strings, translated, words
from leafmill.llm.files import partition_name
from leafmill.llm.gru import END, RARE, Adam, Gru, train


def _held_out(doc_id, folds: int, fold: int):
    return F.coalesce(bucket(doc_id, folds) == fold, F.lit(False))


def _lower_words(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    flat, counts = words(translated(strings(column), LOWER_TABLE))
    return *coded(flat), counts


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts: each task counts its slices, Spark adds them up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            distinct, codes, _ = _lower_words(batch.column("text"))
            if distinct:
                yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.binary()).cast(pa.string()), pa.array(np.bincount(codes))], ["word", "c"])

    return texts.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The ``most`` most frequent words, or all if there are fewer, by falling count; words of one count in the order of their
    code points.  All words above the count of the last one are taken, and of that count's words as many as are still free; the
    count is found from the numbers of words in bands of counts, so no task sends more than its share."""
    band = F.floor(F.log2(F.col("c").cast("double")) * 128)
    bands = sorted(((r["band"], r["n"]) for r in counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least, edge = 0, None, None
    for b, n in bands:
        if total + n > most:
            edge = b
            break
        total, least = total + n, b
    found = [(r["word"], r["c"]) for r in counts.filter(band >= least).collect()] if least is not None else []
    if edge is not None and total < most:
        # The band in which the bound falls: its largest counts, in the order of the words where counts agree.
        found += [(r["word"], r["c"]) for r in counts.filter(band == edge).orderBy(F.desc("c"), "word").limit(most - total).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """The model's words (frequent ones, numbered from 2 on), and the counts of more of them for the base score."""

    def __init__(self, head: list[tuple[str, int]], n_model: int):
        self.count = {w.encode(): c for w, c in head}
        self.number = {w.encode(): i + 2 for i, (w, _) in enumerate(head[:n_model])}
        self.size = len(self.number) + 2


#: Words of whole texts that a task holds for training at once; a longer text is held alone.
HELD_WORDS = 4 << 20


def _copy(batches: Iterator[pa.RecordBatch], number: dict[bytes, int], own: Gru, rate: float, batch: int, window: int) -> Iterator[pa.RecordBatch]:
    """Train ``own`` on all words of all texts, ``batch`` texts side by side, and return the rows of its tables that have learnt, as (table, at, values,
    weights) in blocks: a word's row as input weighs by how often the word stands there, its row as output by how often its
    class does, the others by all words."""
    lanes, adam, held, n = batch, Adam(own, rate), [], 0
    inputs, classes, total = np.zeros(own.words), np.zeros(own.classes), 0

    def learn():
        nonlocal inputs, classes, total, held, n
        train(own, held, rate=rate, batch=lanes, window=window, adam=adam)
        inputs += np.bincount(np.concatenate([p[:-1] for p in held]), minlength=own.words)
        classes += np.bincount(own.of_word[np.concatenate([p[1:] for p in held])], minlength=own.classes)
        total += n
        held, n = [], 0

    for batch in slices(batches, "text"):
        distinct, codes, counts = _lower_words(batch.column("text"))
        numbers = np.array([number.get(w, RARE) for w in distinct], np.int32)[codes] if distinct else np.zeros(0, np.int32)
        at = starts(counts)
        for i in range(len(counts)):
            held.append(np.concatenate([[END], numbers[at[i] : at[i + 1]], [END]]).astype(np.int32))
            n += len(held[-1]) - 1
            if n >= HELD_WORDS:
                learn()
    if held:
        learn()
    for k, (values, weights) in enumerate(zip(own.tables(), (inputs, classes[own.of_word[1:]], np.array([float(total)])), strict=True)):
        rows = max(1, BLOCK // values.shape[1])
        for at in range(0, len(values), rows):
            w = weights[at : at + rows]
            if w.any():
                yield _block(k, at, values[at : at + rows], w)


#: Parameters in a block, at about 64 KB.
BLOCK = 1 << 14
_BLOCK = "kind int, at int, value binary, weight binary"


def _block(kind: int, at: int, values: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([kind], pa.int32()), pa.array([at], pa.int32()), pa.array([values.astype(np.float32).tobytes()], pa.binary()), pa.array([weights.astype(np.float64).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "at", "value", "weight"])


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of equal blocks.  A task holds its share of the model, however many copies there are."""
    sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            w = np.frombuffer(r["weight"], np.float64)
            v = np.frombuffer(r["value"], np.float32).reshape(len(w), -1) * w[:, None]
            old = sums.get((r["kind"], r["at"]))
            sums[r["kind"], r["at"]] = (v, w.copy()) if old is None else (old[0] + v, old[1] + w)
    for (kind, at), (v, w) in sums.items():
        yield _block(kind, at, v / np.maximum(w, 1)[:, None], w)


def _averaged(model: Gru, texts: DataFrame, number: dict[bytes, int], rate: float, batch: int, window: int) -> Gru:
    """Each task trains a copy on its whole texts, with the state carried through each; the copies are averaged, a word's row by
    how often each has met the word."""
    sent = texts.sparkSession.sparkContext.broadcast((number, model))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = sent.value
        yield from _copy(batches, number, Gru(own.words, own.hidden).load(own.vector()), rate, batch, window)

    copies = texts.select("text").mapInArrow(refine, _BLOCK).repartition("kind", "at")
    tables = [t.copy() for t in model.tables()]
    for r in copies.mapInArrow(_mean, _BLOCK).collect():
        w = np.frombuffer(r["weight"], np.float64)
        v = np.frombuffer(r["value"], np.float32).reshape(len(w), -1)
        tables[r["kind"]][r["at"] : r["at"] + len(w)][w > 0] = v[w > 0]
    return model.load_tables(tables)


def fit(training: DataFrame, vocabulary: Vocabulary, counts: np.ndarray, share: int, task_words: int) -> Gru:
    """A model that begins with the words' own counts and is trained by tasks alone, in two rounds of ``_averaged``.

    The first, in many small steps, goes over all words of one in ``share`` texts, by the hash of doc_id, so it grows with the corpus; a
    task has about ``task_words`` words of them at any size.  The second goes over all words of all texts where they are read.
    """
    model = Gru(vocabulary.size).unigram(counts)
    some = training.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    tasks = max(1, int(counts.sum() / share / task_words))
    model = _averaged(model, some.repartition(tasks, "doc_id").sortWithinPartitions("doc_id"), vocabulary.number, rate=0.01, batch=64, window=32)
    return _averaged(model, training, vocabulary.number, rate=0.003, batch=256, window=64)


def lm_scores(docs: DataFrame, folds: int = 5, fold: int = 1, head_words: int = 150_000, model_words: int = 991, model_count: int = 20, model_share: float = 1e-5, first_share: int = 8, first_task_words: int = 1 << 20, side_by_side: int = 3 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score each whole text with smoothed word counts (base) and with a recurrent model (score), both log10.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each input row.  Training texts are
    those whose crc32 of doc_id as text, modulo ``folds``, is not ``fold``; all of their words are counted, and all
    of them train the model (see ``fit``).

    The model knows all words that are one of 1 / ``model_share`` words or more and counted ``model_count`` times or more (the
    ``model_words`` most frequent ones at least), of which there can be no more than 1 / ``model_share``, and a word that
    stands for all others; when it predicts the latter, the word itself has its share of smoothed counts among those, so every
    text has a probability.  ``head_words`` must be as many at least.

    * A null or empty text is its end alone.  A null doc_id is a training text; all null ones have one hash, by which they are in the first round or not (by default not).
    * Copies of the model are averaged by task, so scores vary a little with how the table is split into tasks; reruns on the same split agree.
    * Rows that repeat are counted and scored each.  Other columns are ignored; an empty table gives an empty one.

    Counts grow with the corpus and stay in a table.  The ``head_words`` most frequent words (a bound) go to all tasks; the
    other words of each text are joined with the table, which has no hot key by then, and added up by row.  A task scores
    ``side_by_side`` words at once (or one longer text), the state being carried through each text to its end.
    """
    d = documents(docs, id_col, text_col)
    training = d.filter(~_held_out(F.col("doc_id"), folds, fold))
    counts = materialise(word_counts(training), "lm-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = training.count()
    n_train, distinct = totals[0] + ends, totals[1] + (ends > 0)
    head = frequent_words(counts, head_words)
    model_words = max(model_words, sum(c >= max(model_count, model_share * n_train) for _, c in head))
    vocabulary = Vocabulary(head, model_words)
    rare_n = totals[0] - sum(c for _, c in head[:model_words])
    model = fit(training, vocabulary, np.array([rare_n, ends, *(c for _, c in head[:model_words])], np.float64), first_share, first_task_words)
    rare_words = totals[1] - len(vocabulary.number)
    of_all, of_rare = n_train + 0.5 * (distinct + 1), rare_n + 0.5 * (rare_words + 1)
    sent = d.sparkSession.sparkContext.broadcast((vocabulary, model.vector()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, vector = sent.value
        model = Gru(vocabulary.size).load(vector)
        held: list[list] = [[] for _ in range(7)]
        serial = partition_name() << 40

        def flush():
            ids, numbers, n, known, base, rare, tail = held
            n = np.concatenate(n)
            score = model.score(np.concatenate(numbers), n) + np.concatenate(rare)
            out = pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)) + serial), pa.concat_arrays(ids), pa.array(n + 1), pa.array(np.concatenate(known)), pa.array(np.concatenate(base)), pa.array(score), pa.concat_arrays(tail)], ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "tail"])
            for x in held:
                x.clear()
            return out

        for batch in slices(batches, "text"):
            distinct, codes, counts = _lower_words(batch.column("text"))
            c = np.array([vocabulary.count.get(w, -1) for w in distinct], np.int64)
            number = np.array([vocabulary.number.get(w, RARE) for w in distinct], np.int32)
            at = starts(counts)
            by_doc = lambda per_word: (lambda t: t[at[1:]] - t[at[:-1]])(np.concatenate([[0], np.cumsum(per_word[codes])]) if len(codes) else np.zeros(1))
            counted = c >= 0
            held[0].append(batch.column("doc_id"))
            held[1].append(number[codes])
            held[2].append(counts)
            held[3].append(by_doc(counted.astype(np.int64)).astype(np.int64) + int(ends > 0))
            held[4].append(by_doc(np.where(counted, np.log10((np.maximum(c, 0) + 0.5) / of_all), 0.0)) + np.log10((ends + 0.5) / of_all))
            held[5].append(by_doc(np.where(counted & (number == RARE), np.log10((np.maximum(c, 0) + 0.5) / of_rare), 0.0)))
            held[6].append(_tail(distinct, codes, counts, counted))
            if sum(map(len, held[1])) >= side_by_side:
                out = flush()
                serial += len(out)
                yield out
        if held[0]:
            yield flush()

    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, tail array<struct<word:string,n:long>>"
    scored = materialise(d.mapInArrow(judge, schema), "lm-scores")
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n").join(counts, "word", "left")
    c, n = F.coalesce("c", F.lit(0)), F.col("n")
    more = tail.groupBy(F.col("row").alias("tail_row")).agg(
        F.sum(F.when(c > 0, n).otherwise(0)).alias("more_known"), F.sum(n * F.log10((c + 0.5) / F.lit(of_all))).alias("more_base"), F.sum(n * F.log10((c + 0.5) / F.lit(of_rare))).alias("more_score")
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return scored.drop("tail").join(more, F.col("row") == F.col("tail_row"), "left").select(
        "doc_id", _held_out(F.col("doc_id"), folds, fold).alias("held_out"), "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"),
    )


def _tail(distinct: list[bytes], codes: np.ndarray, counts: np.ndarray, counted: np.ndarray) -> pa.Array:
    """For each text, its words outside the head, each with how often it stands there."""
    doc = np.repeat(np.arange(len(counts)), counts)
    out = ~counted[codes] if len(codes) else np.zeros(0, bool)
    pairs, n = np.unique(doc[out] * max(1, len(distinct)) + codes[out], return_counts=True)
    doc, word = np.divmod(pairs, max(1, len(distinct)))
    names = pa.array(distinct, pa.binary()).cast(pa.string()).take(pa.array(word))
    offsets = starts(np.bincount(doc, minlength=len(counts)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([names, pa.array(n.astype(np.int64))], ["word", "n"]))
