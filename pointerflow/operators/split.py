"""Splits that keep a participant on one side (SP1-SP6, PF8-PF12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .ranges import before


#: Hexadecimal digits of a hash that name its group: 65,536 groups, so that ten
#: billion ids make groups of some 150,000.
HASH_DIGITS = 4


def hash_order(seed: int, key: str = "participant_id"):
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def participant_labels(df: DataFrame, label: str) -> DataFrame:
    """One stratum a participant: its commonest label, the least on ties."""
    counts = df.where(F.col(label).isNotNull()).groupBy("participant_id", label).count()
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col(label).alias("label")))
    return counts.groupBy("participant_id").agg(best.alias("b")).select("participant_id", F.col("b.label").alias("stratum"))


def hash_places(people: DataFrame, seed: int, by: list[str], key: str = "participant_id") -> DataFrame:
    """``people`` with ``place``, their rank from 1 by the hash of seed and id
    within ``by``, and ``all``, how many there are.

    Ids are dealt out by the first ``HASH_DIGITS`` digits of the hash, each such
    group is ordered by itself, and the ids of the groups before it are added.
    """
    digits = F.conv(F.substring(hash_order(seed, key), 1, HASH_DIGITS), 16, 10).cast("int")
    dealt = people.withColumn("part", digits)
    groups = dealt.groupBy(*by, "part").agg(F.count("*").alias("n"))
    alone = [F.lit(0).alias("whole")]  # without ``by`` there is one whole
    groups = groups.select("*", *([] if by else alone))
    keys = by or ["whole"]
    earlier = before(groups, keys, "part", ["n"])
    every = groups.groupBy(*keys).agg(F.sum("n").alias("all"))
    facts = earlier.join(every, keys).select(*by, "part", "n_before", "all")
    own = F.row_number().over(Window.partitionBy(*by, "part").orderBy(hash_order(seed, key), key))
    placed = dealt.withColumn("own", own).join(facts, [*by, "part"])
    return placed.withColumn("place", F.col("n_before") + F.col("own")).drop("part", "own", "n_before")


def hash_share(seed: int, key: str = "participant_id") -> Column:
    """A number from 0 up to 1 that a hash of seed and id gives."""
    return F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def split_by_hash(df: DataFrame, train_pct: float, seed: int, key: str = "participant_id") -> DataFrame:
    """``key`` and split, for more ids than one task can order: each goes to the
    train side with probability ``train_pct`` by its own hash, so sides are of
    about, not exactly, their share.  The sides of an id never depend on others."""
    if not 0 < train_pct < 1:
        raise ValueError("train_pct must lie between 0 and 1")
    people = df.select(key).where(F.col(key).isNotNull()).distinct()
    return people.select(key, F.when(hash_share(seed, key) < train_pct, "train").otherwise("test").alias("split"))


def split_participants(df: DataFrame, train_pct: float, seed: int, strata: DataFrame | None = None) -> DataFrame:
    """participant_id and split; the share of train participants is rounded down.

    With strata each gives its rounded-down share, and the participants still
    missing come from those with the largest fractions, then by name.
    Participants are ordered by a hash of seed and id, so reruns agree; no task
    orders more than a group of hashes that begin alike.
    """
    if not 0 < train_pct < 1:
        raise ValueError("train_pct must lie between 0 and 1")
    people = df.select("participant_id").where("participant_id is not null").distinct()
    if strata is None:
        people = people.withColumn("stratum", F.lit(""))
    else:
        people = people.join(strata, "participant_id", "left").withColumn("stratum", F.when(F.col("stratum").isNull(), F.raise_error(F.concat(F.lit("no stratum for "), "participant_id"))).otherwise(F.col("stratum").cast("string")))
    people = saved(people, "people")  # counted, dealt out and ordered
    quota = people.groupBy("stratum").agg(F.count("*").alias("n")).withColumn("base", F.floor(F.col("n") * train_pct)).withColumn("part", F.round(F.col("n") * train_pct - F.col("base"), 9))
    totals = quota.agg(F.floor(F.sum("n") * train_pct).alias("goal"), F.sum("base").alias("given"), F.sum("n").alias("everyone"))
    rank = F.row_number().over(Window.orderBy(F.desc("part"), "stratum"))  # one row a stratum
    quota = quota.crossJoin(totals).withColumn("quota", F.col("base") + F.when(rank <= F.col("goal") - F.col("given"), 1).otherwise(0)).select("stratum", "quota", "everyone")
    split = F.when(F.col("everyone") < 2, F.raise_error(F.lit("fewer than two participants"))).when(F.col("place") <= F.col("quota"), "train").otherwise("test")
    return hash_places(people, seed, ["stratum"]).join(quota, "stratum").select("participant_id", split.alias("split"))


def apply_split(df: DataFrame, participants: DataFrame) -> DataFrame:
    return df.join(participants.select("participant_id").distinct(), "participant_id", "left_semi")


def split_summary(df: DataFrame, splits: DataFrame, session: str = "session_key") -> DataFrame:
    """Participants, sessions and rows of each side and in all (split null)."""
    return summary_of_sides(df.join(splits, "participant_id"), session)


def summary_of_sides(rows: DataFrame, session: str = "session_key") -> DataFrame:
    """The summary of rows that have their ``split``.  Rows are first counted by
    session, so that distinct counts and the rollup multiply sessions alone."""
    per = rows.groupBy("split", "participant_id", session).agg(F.count("*").alias("n"))
    return per.rollup("split").agg(F.count_distinct("participant_id").alias("participants"), F.count_distinct(session).alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def group_folds(df: DataFrame, k: int, seed: int) -> DataFrame:
    """participant_id and fold (0 to k-1), folds of nearly equal size: the first
    ones have one more where the number is no multiple of ``k``."""
    people = saved(df.select("participant_id").where("participant_id is not null").distinct(), "people")
    least, more = F.floor(F.col("all") / k), F.col("all") % k
    at = F.col("place") - 1
    full = more * (least + 1)  # places in folds with one more
    fold = F.when(at < full, F.floor(at / (least + 1))).otherwise(more + F.floor((at - full) / F.greatest(least, F.lit(1))))
    return hash_places(people, seed, []).select("participant_id", fold.cast("int").alias("fold"))


def folds_by_hash(df: DataFrame, k: int, seed: int) -> DataFrame:
    """participant_id and fold by its own hash, for more than one task can order."""
    people = df.select("participant_id").where("participant_id is not null").distinct()
    return people.select("participant_id", F.floor(hash_share(seed) * k).cast("int").alias("fold"))


def fold_sides(folds: DataFrame, k: int) -> DataFrame:
    """participant_id, fold, side for each of k rounds: held out once, else train."""
    rounds = folds.withColumn("round", F.explode(F.array(*map(F.lit, range(k)))))
    return rounds.select("participant_id", F.col("round").alias("fold"), F.when(F.col("round") == F.col("fold"), "validate").otherwise("train").alias("side"))


def split_sessions_random(df: DataFrame, pct: float, seed: int, session: str = "session_key") -> DataFrame:
    """Session-level split; participants may stand on both sides."""
    renamed = df.select(F.col(session).alias("participant_id"))
    return split_participants(renamed, pct, seed).withColumnRenamed("participant_id", session)


def shared_sessions(train: DataFrame, validation: DataFrame, session: str = "session_key") -> DataFrame:
    """How many sessions stand on both sides."""
    both = train.select(session).distinct().join(validation.select(session).distinct(), session, "left_semi")
    return both.agg(F.count("*").alias("shared_sessions"))


def check_disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """Participants on both sides; none means the check is passed."""
    return a.select("participant_id").intersect(b.select("participant_id"))


def check_coverage(parts: list[DataFrame], whole: DataFrame) -> DataFrame:
    """Participants missing from the parts, or unknown to the whole."""
    union = parts[0].select("participant_id")
    for p in parts[1:]:
        union = union.union(p.select("participant_id"))
    every = whole.select("participant_id").distinct()
    missing = every.join(union.distinct(), "participant_id", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(union.distinct().join(every, "participant_id", "left_anti").withColumn("problem", F.lit("unknown")))


def check_one_participant_per_session(df: DataFrame, session: str = "session_key") -> DataFrame:
    return df.groupBy(session).agg(F.count_distinct("participant_id").alias("participants")).where("participants > 1")


def check_columns(df: DataFrame, required: list[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def check_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and how many of its values are null, NaN or infinite."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in columns]
    wide = df.agg(*bad)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("bad")) for c in columns))).alias("r")).select("r.*")


def participant_mismatch(metrics: DataFrame) -> DataFrame:
    """Rows whose participant is not the first part of the session id."""
    return metrics.agg(F.count_if(F.col("participant_id") != F.trim(F.get(F.split("session_id", r"\|"), F.lit(0)))).alias("mismatches"), F.count("*").alias("n"))
