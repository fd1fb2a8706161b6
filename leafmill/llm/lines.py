"""Line dedup: lines that many documents share stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import BLANKS, ascii_lower, documents, materialise, spread_join


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashed(key: Column) -> list[Column]:
    """96 bits: at 10^12 distinct lines a collision is unlikely."""
    return [F.xxhash64(key).alias("h1"), F.hash(key).alias("h2")]


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key (line stripped, A-Z lower-cased) has ``min_chars`` code points and is found in ``min_docs``
    documents, save in the largest doc_id that holds it; the rest is joined again in its order.

    Returns doc_id, text (what stays), n_lines, n_dropped; one row for each input row.

    * A null text is empty; an empty text is one empty line.  Short and blank lines always stay.
    * Each row counts as a document.  Rows that repeat a doc_id keep or lose a key together; a null doc_id is the smallest.
    * A key that stands several times in its document counts once, and all its lines stay or go together.
    * Other columns are ignored; an empty table gives an empty one.

    Spark only: keys are counted with map-side combining, so a line of a third of all documents costs a row for each task;
    the join back has one row for each key on the other side, and very common keys are dealt to several places.  The text
    moves once, by doc_id.
    """
    d = documents(docs, id_col, text_col)
    lines = F.split("text", "\n")
    keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= min_chars))
    shared = (
        d.select("doc_id", F.explode(keys).alias("key"))
        .select("doc_id", *_hashed(F.col("key")))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )
    row = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    found = (
        d.select(*row, F.posexplode(lines).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", *_hashed(F.col("key")))
    )
    drops = (
        spread_join(found, materialise(shared, "lines-shared"), ["h1", "h2"], "n_docs", F.struct("doc_id", "text_hash", "pos"), "inner")
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash"))
        .agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    )
    joined = d.withColumn("text_hash", F.xxhash64("text")).join(
        drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("text_hash") == F.col("drop_hash")), "left"
    )
    return (
        joined.select("doc_id", "text", "drops", F.split("text", "\n").alias("lines"))
        .select("doc_id", _kept().alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))
    )


def _kept() -> Column:
    """The runs of lines between dropped positions, which takes time in the number of lines only."""
    before = lambda i: F.coalesce(F.get("drops", i - 1) + 1, F.lit(0))
    until = lambda i: F.coalesce(F.get("drops", i), F.size("lines"))
    runs = F.transform(F.sequence(F.lit(0), F.size("drops")), lambda i: F.slice("lines", before(i) + 1, until(i) - before(i)))
    return F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
