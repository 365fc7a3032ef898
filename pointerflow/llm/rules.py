"""Quality rules with thresholds from quantile sketches (op2)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, saved, texts_of

SYMBOLS = "#*$%&|<>"
#: Statistic: (expression, lower and upper quantile).  A fence lies ``reach``
#: spreads beyond a quantile; the spread is the distance of the two, and one more
#: occurrence in the group's median document (of so many words, or lines), as less
#: cannot be told.  Rates that are zero in most documents take tail quantiles.
RATES: dict[str, tuple[str, float, float]] = {
    "word_length": ("word_chars / n_words", 0.25, 0.75),
    "symbol_rate": ("n_symbols / n_words", 0.25, 0.75),
    "dup_line_rate": ("n_dup_lines / greatest(n_lines, 1)", 0.05, 0.95),
    "repeat_rate": ("n_repeat_words / n_words", 0.05, 0.95),
}
OF_LINES = ("dup_line_rate",)
TWO_SIDED = ("word_length",)


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space only
    n = len(words)
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    threes = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(threes)) < len(threes):
        often = {w for w, c in Counter(threes).items() if c > 1}
        covered = 0  # words before this place are counted
        for i, three in enumerate(threes):
            if three in often:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return n, len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The counts of every whole text with its language and source."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((n, pa.int64()) for n in names)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = zip(*map(text_counts, texts_of(batch, "text")))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c, pa.int64()) for c in counts)], schema=schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return map_batches(narrow, rows, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def _drawn(own: Column, n: Column, wider: Column, rows: float) -> Column:
    """A statistic of ``n`` rows, drawn towards that of a wider group as if
    ``rows`` of its rows were added."""
    n = F.coalesce(n, F.lit(0))
    return F.when(n == 0, wider).when(wider.isNull(), own).otherwise((own * n + wider * rows) / (n + rows))


def thresholds(counts: DataFrame, reach: float = 4.0, prior_rows: float = 40) -> DataFrame:
    """lang, source and, for each statistic, the fences of their documents.

    One pass fills quantile sketches for each language and source, each
    language, and all documents.  Quantiles of a pair are drawn towards its
    language's, and those towards everyone's, by the weight of ``prior_rows``
    rows, so small groups lean on wider ones and no size changes the rule.
    """
    passed = counts.where(~base_failed())
    rates = passed.select("lang", "source", "n_words", F.greatest("n_lines", F.lit(1)).alias("n_lines"), *(F.expr(e).alias(r) for r, (e, *_) in RATES.items()))
    quantiles = [F.percentile_approx(r, F.array(F.lit(low), F.lit(high)), F.lit(10_000)).alias(r) for r, (_, low, high) in RATES.items()]
    sketches = rates.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *(F.percentile_approx(f"n_{unit}", F.lit(0.5), F.lit(10_000)).cast("double").alias(unit) for unit in ("words", "lines")), *quantiles)
    sketches = saved(sketches, "quality-sketches").withColumn("q", F.struct("n", "words", "lines", *RATES))
    pairs = counts.select("lang", "source").distinct()
    fine, mid, top = (sketches.where(f"level = {level} and n > 0").select(F.col("lang").alias("l"), F.col("source").alias("s"), F.col("q").alias(name)) for level, name in ((0, "fine"), (1, "mid"), (3, "top")))
    found = pairs.join(fine, pairs.lang.eqNullSafe(fine.l) & pairs.source.eqNullSafe(fine.s), "left").drop("l", "s")
    found = found.join(mid.drop("s"), found.lang.eqNullSafe(mid.l), "left").drop("l")
    found = found.join(top.drop("l", "s"), F.lit(True), "left")

    def drawn(get) -> Column:
        wide = _drawn(get(F.col("mid")), F.col("mid.n"), get(F.col("top")), prior_rows)
        return _drawn(get(F.col("fine")), F.col("fine.n"), wide, prior_rows)

    fences = []
    for r in RATES:
        low, high = (drawn(lambda q, i=i: q[r][i].cast("double")) for i in (0, 1))
        unit = "lines" if r in OF_LINES else "words"
        spread = high - low + 1 / drawn(lambda q, unit=unit: q[unit])
        fences += [(low - reach * spread).alias(f"{r}_low"), (high + reach * spread).alias(f"{r}_high")]
    return found.select(F.col("lang").alias("at_lang"), F.col("source").alias("at_source"), *fences)


def apply_quality_rules(docs: DataFrame, reach: float = 4.0, prior_rows: float = 40, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts and verdict of every text, one row out for each row in.

    A document that the base rules pass is kept if each of its statistics lies
    within the fences of its language and source.  Null and empty texts have no
    words and fail the base; null languages and sources are groups of their own.
    """
    counts = saved(counted(docs, id_col, text_col, lang_col, source_col), "quality-counts")
    fences = thresholds(counts, reach, prior_rows)
    judged = counts.join(fences, counts.lang.eqNullSafe(fences.at_lang) & counts.source.eqNullSafe(fences.at_source), "left").withColumn("base_failed", base_failed())
    within = F.lit(True)
    for r, (e, *_) in RATES.items():
        rate = F.try_divide(*map(F.expr, e.split(" / ")))
        within &= F.coalesce(rate <= F.col(f"{r}_high"), F.lit(True))
        if r in TWO_SIDED:
            within &= F.coalesce(rate >= F.col(f"{r}_low"), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept"))
