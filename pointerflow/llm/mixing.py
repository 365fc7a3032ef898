"""Mixing sources to target weights by entropy balancing (op4)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, saved, small

#: Weights of the sources in order, repeating, and the mix's share of all sizes.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
#: No document, and so no source, is taken more often than this.
MOST = 2.0


def targets(sizes: list[float], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Target of each source: its weight's part of ``share`` times all sizes,
    stopped at ``most`` times its size, the excess shared again by weight."""
    goal, n = share * sum(sizes), len(sizes)
    w = [weights[i % len(weights)] for i in range(n)]
    capped: set[int] = set()
    while True:
        left = goal - sum(most * sizes[i] for i in capped)
        free = sum(w[i] for i in range(n) if i not in capped)
        out = [most * sizes[i] if i in capped else left * w[i] / free for i in range(n)]
        over = {i for i in range(n) if i not in capped and out[i] > most * sizes[i]}
        if not over:
            return out
        capped |= over


def n_words(text_col: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def source_table(sized: DataFrame) -> DataFrame:
    """source, source_size, n, target, one row a source in code point order,
    null last.  The number of sources bounds what the driver holds."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r.source_size for r in rows])
    return sized.sparkSession.createDataFrame([(r.source, r.source_size, r.n, float(t)) for r, t in zip(rows, goal)], "source string, source_size long, n long, target double")


def entropy_rates(sized: DataFrame, sources: DataFrame, most: float = MOST, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """source, size, rate: the rates closest in entropy to one for all documents
    that meet each source's tokens (``target``).

    The optimum is ``min(most, exp(b z))`` with ``z`` the size over the source's
    mean size and ``b`` the dual's variable: a source that is to give more than
    it has tilts towards its long documents, one that is to give less towards
    its short ones.  A Newton round sums the tokens that ``b`` gives and their
    slope over distinct (source, size) pairs, which all documents of equal size
    share, and moves every source at once; the driver sees a few numbers a
    source.  Tokens only grow with ``b``, so the values tried enclose the
    solution, and a step that leaves them, or goes further than doubles ``b``,
    is shortened.  If ``rounds`` do not meet the tokens of a source, an error
    names it.
    """
    spark = sized.sparkSession
    pairs = saved(sized.groupBy("source", "size").agg(F.count("*").alias("c")).where("size > 0"), "mixing-sizes")
    at = {r.source: r for r in sources.collect() if r.source_size}
    full = {s for s, r in at.items() if r.target >= most * r.source_size * (1 - 1e-12)}
    open_ = set(at) - full
    counts = {r.source: r.n for r in pairs.groupBy("source").agg(F.sum("c").alias("n")).collect()}
    dual = dict.fromkeys(at, 0.0)
    around = {s: [-math.inf, math.inf] for s in at}

    def with_dual() -> DataFrame:
        table = spark.createDataFrame([(s, float(at[s].source_size) / counts[s], dual[s], s in full) for s in at] or [(None, 1.0, 0.0, True)], "s string, mean double, b double, full boolean")
        joined = pairs.join(small(table, len(at)), pairs.source.eqNullSafe(table.s)).withColumn("z", F.col("size") / F.col("mean"))
        x = F.col("b") * F.col("z")
        return joined.withColumn("free", ~F.col("full") & (x < math.log(most))).withColumn("rate", F.when(F.col("free"), F.exp(x)).otherwise(F.lit(most)))

    for _ in range(rounds):
        if not open_:
            break
        tokens = F.col("rate") * F.col("c") * F.col("z")
        sums = with_dual().groupBy("source").agg(F.sum(tokens).alias("given"), F.sum(F.when(F.col("free"), tokens * F.col("z")).otherwise(0.0)).alias("slope")).collect()
        for r in sums:
            if r.source not in open_:
                continue
            goal = counts[r.source] * at[r.source].target / at[r.source].source_size  # z has mean one
            short, b = goal - r.given, dual[r.source]
            if abs(short) <= tolerance * goal:
                open_.discard(r.source)
                continue
            around[r.source][short < 0] = b
            low, high = around[r.source]
            furthest = max(1.0, abs(b))
            step = short / r.slope if r.slope else math.copysign(math.inf, short)
            b += max(-furthest, min(furthest, step))
            dual[r.source] = b if low < b < high else (low + high) / 2
    if open_:
        raise RuntimeError(f"no rates after {rounds} rounds for sources {sorted(map(str, open_))[:10]}")
    return with_dual().select("source", "size", "rate")


def mix_documents(docs: DataFrame, group_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken of every row.

    Rates from ``entropy_rates`` are rounded down or up to whole copies.  Rows
    of a source are dealt by hash into groups of about ``group_rows``, so a
    source with a third of all rows is many groups; in each, from the longest
    document down, a copy more is taken when the words still owed reach half
    the document.  A group thus ends within half of its shortest documents.
    Ties and repeated rows are ordered by id and text hash, so reruns agree.

    Null texts have size 0 and are taken 0 words; a null source is one more
    source; an empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"))
    sized = saved(sized, "mixing")
    sources = source_table(sized)
    rates = saved(entropy_rates(sized, sources), "mixing-rates")
    sources = small(sources, sources.count())
    s, r = sources.alias("s"), rates.alias("r")
    rows = sized.alias("d").join(s, F.col("d.source").eqNullSafe(F.col("s.source")))
    rows = rows.join(r, F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.size") == F.col("r.size")), "left")
    groups = F.greatest(F.ceil(F.col("s.n") / group_rows), F.lit(1))
    rows = rows.select("d.doc_id", "d.text_hash", "d.source", "d.size", "s.source_size", "s.target", F.coalesce("r.rate", F.lit(0.0)).alias("rate"), F.pmod(F.xxhash64("d.doc_id", "d.text_hash"), groups).alias("part"))

    def round_off(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "doc_id", "text_hash"], ascending=[False, True, True], kind="stable")
        owed, copies = 0.0, []
        for size, rate in zip(g["size"].tolist(), g["rate"].tolist()):
            owed += rate * size
            low = int(rate)
            take = low + (rate > low and owed - low * size >= size / 2)
            owed -= take * size
            copies.append(take if size else 0)
        g["copies"] = copies
        g["taken"] = g["copies"] * g["size"]
        return g[["doc_id", "text_hash", "size", "source_size", "target", "rate", "copies", "taken"]]

    return rows.groupBy("source", "part").applyInPandas(round_off, "doc_id long, text_hash long, size long, source_size long, target double, rate double, copies int, taken long")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns unchanged,
    whatever their names.

    Rows that repeat an id with one text share what the plan takes of them: as
    many rows come out as it has copies, in equal parts, the rest from rows with
    the least hash of all columns on.
    """
    plan = mix_documents(docs).groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    plan = saved(plan.select(F.col("doc_id").alias("plan_doc"), F.col("text_hash").alias("plan_text"), "copies", "n"), "mixing-plan")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.xxhash64("row.text")
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("plan_doc")) & (text == F.col("plan_text"))
    taken = rows.join(plan.where("n = 1"), same).select("row", "copies")
    repeated = plan.where("n > 1")
    if not repeated.isEmpty():
        order = F.xxhash64(*(F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind))
        place = F.row_number().over(Window.partitionBy("plan_doc", "plan_text").orderBy(order))
        parts = F.expr("copies div n + if(place <= copies % n, 1, 0)").alias("copies")
        taken = taken.unionByName(rows.join(repeated, same).withColumn("place", place).select("row", parts))
    return taken.select("row", F.explode(F.expr("array_repeat(1, cast(copies as int))"))).select("row.*")
