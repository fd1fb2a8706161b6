"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import bounded, materialise

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target) from rows of (source, size).

    Sources in the order of their code points, null last, have the weights in turn, and share ``share`` of all sizes by
    them; a target stops at ``most`` times its source's size, and the excess is shared again by weight.  Solved in one go:
    with sources ordered by cap for a unit of weight, each is capped exactly if its cap is below its share of what those
    before it left.  The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighted = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place + 1)).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    shares = weighted.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    capped = shares.withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return capped.withColumn("final", level).select("source", "source_size", "n_docs", F.when(F.col("free"), F.least("cap", F.col("final") * F.col("weight"))).otherwise(F.col("cap")).alias("target"))


# --------------------------------------------------------------------------- the cube method


def flight(p: list[float], size: list[float], rng: random.Random, eps: float = 1e-9) -> list[float]:
    """Move probabilities to 0 or 1 so that their sum and the sum of probability times size stay as they are.

    Three units at a time: the null space of the two constraints on three units is the line along the cross product of
    (1, 1, 1) and their sizes (or any pair's exchange where sizes are equal).  A step goes along it, at random in one of both
    directions such that the expectation stays, until a probability arrives.  Two units at most stay between, save equals.
    """
    p = list(p)
    held: list[int] = []
    for i in range(len(p)):
        if eps < p[i] < 1 - eps:
            held.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(held) == 3:
            held = _step(p, size, held, rng, eps)
    while len(held) == 2 and size[held[0]] == size[held[1]]:
        held = _step(p, size, held, rng, eps)
    return p


def _step(p: list[float], size: list[float], held: list[int], rng: random.Random, eps: float) -> list[int]:
    a, b, *rest = held
    c = rest[0] if rest else None
    u = {a: 1.0, b: -1.0}
    if c is not None and not size[a] == size[b] == size[c]:
        scale = max(abs(size[c] - size[b]), abs(size[a] - size[c]), abs(size[b] - size[a]))
        u = {a: (size[c] - size[b]) / scale, b: (size[a] - size[c]) / scale, c: (size[b] - size[a]) / scale}
    ahead = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in u.items() if x)
    back = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in u.items() if x)
    go = ahead if rng.random() * (ahead + back) < back else -back
    for i, x in u.items():
        p[i] += go * x
    for i in held:
        if p[i] < eps or p[i] > 1 - eps:
            p[i] = float(round(p[i]))
    return [i for i in held if 0 < p[i] < 1]


def landing(p: list[float], size: list[float]) -> list[float]:
    """Decide the few units that the flight has left: of all ways, that nearest in size, then in number."""
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    want_size, want_n = sum(p[i] * size[i] for i in left), sum(p[i] for i in left)
    ways = [[w >> k & 1 for k in range(len(left))] for w in range(1 << len(left))]
    best = min(ways, key=lambda w: (abs(sum(x * size[i] for x, i in zip(w, left, strict=True)) - want_size), abs(sum(w) - want_n)))
    for x, i in zip(best, left, strict=True):
        p[i] = float(x)
    return p


def landed(p: list[float], size: list[float], draw: str, tries: int = 200, near: float = 0.001) -> list[float]:
    """A flight and its landing; of several draws the first that comes as near as ``near`` to the wanted sum of sizes, else the
    nearest.  In a source of few documents one landing alone may miss by half a large document."""
    want, best = sum(x * s for x, s in zip(p, size, strict=True)), (float("inf"), p)
    for k in range(tries):
        rng, order = random.Random(f"{draw}/{k}"), list(range(len(p)))
        if k:
            rng.shuffle(order)
        flown = landing(flight([p[i] for i in order], [size[i] for i in order], rng), [size[i] for i in order])
        out = [x for _, x in sorted(zip(order, flown, strict=True))]
        best = min(best, (abs(sum(x * s for x, s in zip(out, size, strict=True)) - want), out), key=lambda b: b[0])
        if best[0] <= near * want:
            break
    return best[1]


_UNITS = "source string, doc_id long, size long, source_size long, target double, base long, p double"


def _fly(units: DataFrame, block_rows: int, seed: int, round_: int, last: bool) -> DataFrame:
    """One round: each source in blocks of about ``block_rows`` units, dealt by the hash of doc_id."""
    kind = dict(units.dtypes)["doc_id"]

    def block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending")])
        draw = f"{seed}/{round_}/{rows['source'][0].as_py()}/{rows['block'][0].as_py()}"
        p, size = rows["p"].to_pylist(), rows["size"].to_pylist()
        p = landed(p, size, draw) if last else flight(p, size, random.Random(draw))
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p, pa.float64())).drop_columns(["block", "n_left"])

    n_blocks = F.ceil(F.col("n_left") / block_rows)
    dealt = units.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(round_)), n_blocks))
    return dealt.select(*(u.split()[0] for u in _UNITS.split(", ")), "block", "n_left").groupBy("source", "block").applyInArrow(block, _UNITS.replace("doc_id long", f"doc_id {kind}"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_rows: int = 4096, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document a mix of all sources takes.

    Returns doc_id, source, size (words), source_size, target (its source's, see source_targets), copies, taken (size times
    copies); a row for each input row.  A document is taken floor(target / source_size) times, and once more if the cube
    method draws it: the fraction is its inclusion probability in every flight, and the draw is balanced within each source on
    words and on documents, so the taken words miss the target by about one small document.  A source's last block lands on
    the best of several draws, so there the probability is kept only nearly.  The same input gives the same draw.

    * A null text has no words.  A null source is a source of its own, the last.  Null doc_ids are dealt together.
    * Sources without words have target 0 and nothing taken.  Rows that repeat are units of their own.
    * Other columns are ignored; an empty table gives an empty one.

    Only (source, doc_id, size) is shuffled, after one pass over the text.  A source, however hot, is dealt into blocks of
    about ``block_rows``; each block leaves two units undecided at most, which fly again, and the rounds end with one block
    a source.  A source of one block waits for the last round with all its units, whatever the size of others.  Each round's table is written, so a lost executor costs no earlier round.
    """
    bounded(docs.sparkSession)
    sizes = materialise(docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("size")), "mix-sizes")
    targets = materialise(source_targets(sizes, weights, share, most), "mix-targets").withColumnRenamed("source", "target_source")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    units = (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("target_source")))
        .withColumn("base", F.floor(ratio).cast("long"))
        .select("source", "doc_id", "size", "source_size", "target", "base", (ratio - F.col("base")).alias("p"), F.col("n_docs").alias("n_left"))
    )
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    decided: list[DataFrame] = []
    whole: list[DataFrame] = []
    round_ = 0
    while largest > block_rows:
        whole.append(units.filter(F.col("n_left") <= block_rows))
        flown = materialise(_fly(units.filter(F.col("n_left") > block_rows), block_rows, seed, round_, last=False), f"mix-round-{round_}")
        between = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(flown.filter(~between))
        left = flown.filter(between)
        n_left = left.groupBy(F.col("source").alias("left_source")).agg(F.count(F.lit(1)).alias("n_left"))
        units = left.join(n_left, F.col("source").eqNullSafe(F.col("left_source"))).drop("left_source")
        largest = n_left.agg(F.max("n_left")).first()[0] or 0
        round_ += 1
    for w in whole:
        units = units.unionByName(w)
    out = _fly(units, block_rows, seed, round_, last=True)
    for d in decided:
        out = out.unionByName(d)
    copies = F.col("base") + F.round("p").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, any more) as often as the mix takes them, with their own columns.

    Rows that share doc_id, source and size are dealt the mix's copies for them in the order of their texts' hashes.  Null
    doc_ids, sources and texts are values like others; an empty table gives an empty one.
    """
    columns = docs.columns
    key = {"key_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "key_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))}
    names = [*key, "key_size"]
    plan = mix(docs, **options).select(*(c.alias(k) for k, c in key.items()), F.col("size").alias("key_size"), "copies")
    plan = plan.groupBy(*names).agg(F.min("copies").alias("copies"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("once_more"))
    rows = docs.select(*(c.alias(k) for k, c in key.items()), n_words(F.col("text")).alias("key_size"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    # Window and join go by the same keys, so texts move once.
    joined = rows.join(plan, names).withColumn("key_n", F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64("row.text"))))
    times = F.col("copies") + F.when(F.col("key_n") <= F.col("once_more"), 1).otherwise(0)
    return joined.withColumn("times", times).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
