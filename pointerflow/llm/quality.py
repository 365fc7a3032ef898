"""Quality classifier over document statistics (op7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Trees, fit
from .common import fresh, map_batches, texts_of
from .rules import text_counts

#: Labelled rows that training uses, about; a hash of the id picks them.
SAMPLE = 20_000

#: Names of the statistics, in the order of ``statistics``.
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "line_words", "upper", "digits", "marks", "stops", "distinct", "bangs", "bars", "non_ascii", "long_words", "end_marks", "at_signs")


def statistics(text: str) -> list[float]:
    """What a text looks like, whatever its language or origin."""
    n, chars, symbols, dup, repeats, lines = text_counts(text)
    if not n:
        return [0.0] * len(FEATURES)
    words = text.encode("utf-8", "surrogatepass").split()
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = sum(len(set(words[i : i + 200])) for i in range(0, n, 200)) / n
    return [
        float(np.log1p(n)), chars / n, symbols / n, dup / max(lines, 1), repeats / n, float(np.log1p(n / max(lines, 1))),
        float(seen[65:91].sum()) / len(raw), float(seen[48:58].sum()) / len(raw), float(seen[[33, 44, 46, 58, 59, 63]].sum()) / n, float(seen[46]) / n,
        distinct, float(seen[33]) / n, float(seen[124]) / n, float(seen[128:].sum()) / len(raw), float((lengths > 15).mean()), float(sum(w[-1] in b".!?" for w in words)) / n, float(seen[64]) / n,
    ]


def crc_fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fit on about ``sample`` labelled rows outside the held-out fold.

    The sample is bounded by that parameter whatever the corpus holds; only its
    statistics (17 numbers a row) come to the driver.  Null labels are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("labelled"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("labelled").isNotNull() & (crc_fold("labelled") != 1)).groupBy("labelled").agg(F.max("label").alias("label"))
    total = known.count()
    if total > sample:
        known = known.where(F.pmod(F.xxhash64("labelled"), F.lit(1_000_003)) < int(1_000_003 * sample / total))
    schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in texts_of(batch, "text")], pa.list_(pa.float64()))], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = texts.join(F.broadcast(known), texts.id == known.labelled).select("label", "text")  # sample rows of two numbers
    got = map_batches(picked, rows, "label int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got.column("label").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, model: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Every row with ``score_col``, the probability of label 1, all columns kept."""
    if score_col in docs.columns:
        raise ValueError(f"documents already have a column {score_col}")
    out = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t or "") for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.predict(x))], names=[*batch.schema.names, score_col])

    return map_batches(docs, rows, out)


def classify_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts have zero statistics and get a score like any other.
    Without labels, or with one class only, all scores are the prior.  A null id
    is in no fold, so not held out.
    """
    model = train(docs, labels, sample, id_col, text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = score_documents(narrow, model)
    return scored.select("doc_id", F.coalesce(crc_fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows that the classifier takes for quality 1, columns unchanged,
    whatever their names.  Null and empty texts are judged like any other."""
    score = fresh(docs, "score")
    return score_documents(docs, train(docs, labels, sample), score_col=score).where(F.col(score) >= 0.5).select(*(f"`{c}`" for c in docs.columns))
