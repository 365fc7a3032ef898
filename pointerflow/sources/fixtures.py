"""The test tables seen as pointer data (events, metrics, questionnaires ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODULES = ("behavior_WAI_sr", "behavior_EADS", "behavior_RESS")

#: What a click's number stands for.
NODES = ((50, '<div class="q">a</div>'), (80, '<input type="radio">'), (95, '<LABEL for="z">t</LABEL>'))
NODE_AT = {97: '<img src="u">', 99: "plain text"}
NODE_ELSE = "<!-- <b> --><button>go</button>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointer events: one sequence for each participant, session and module."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    node = F.when(k < NODES[0][0], NODES[0][1])
    for limit, html in NODES[1:]:
        node = node.when(k < limit, html)
    for at, html in NODE_AT.items():
        node = node.when(k == at, html)
    module = F.when(F.col("event_id") % 3 == 0, "behavior_RESS").when(F.col("event_id") % 3 == 1, "behavior_EADS").otherwise("behavior_WAI_sr")
    rows = e.select(
        F.concat(F.lit("P"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("participant"), (1 + F.expr("(day(ts) - 1) div 15")).cast("string").alias("sess"), module.alias("module"),
        F.floor((us - 1704067200000000) / 200000000).cast("double").alias("t"), ((F.floor("value") % 4) * 5.0).alias("x"), ((k % 3) * 4.0).alias("y"),
        (F.col("event_type") == "click").alias("is_click"), F.when(F.col("event_type") == "click", node.otherwise(NODE_ELSE)).alias("node"), F.col("event_id").alias("ord"),
    )
    return rows.withColumn("session_key", F.concat_ws("|", "participant", "sess", "module"))


def raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events nested as recorded: a row a session, a struct a module."""
    e = events(spark, sf_dir)
    moves = F.array_sort(F.collect_list(F.when(~F.col("is_click"), F.struct("t", "ord", "x", "y"))))
    clicks = F.array_sort(F.collect_list(F.when(F.col("is_click"), F.struct("t", "ord", "x", "y", "node"))))
    per = e.groupBy("participant", "sess", "module").agg(moves.alias("m"), clicks.alias("c"))
    per = per.select("participant", "sess", "module", F.struct(
        F.transform("m", lambda v: F.struct(v["t"].alias("timestamp"), v["x"].alias("x"), v["y"].alias("y"))).alias("mouseMovements"),
        F.struct(F.transform("c", lambda v: F.struct(v["t"].alias("timestamp"), v["x"].alias("x"), v["y"].alias("y"), v["node"].alias("node"))).alias("clickDetails")).alias("clicks"),
        F.struct(F.col("participant").alias("participantId")).alias("userInfo"),
    ).alias("body"))
    wide = per.groupBy("participant", "sess").pivot("module", list(MODULES)).agg(F.first("body", ignorenulls=True))
    number = F.substring("participant", 2, 6).cast("int")
    return wide.select(F.concat_ws("|", "participant", "sess").alias("file_order"), F.when(number % 17 != 0, F.col("participant")).alias("processNumber"), F.col("sess").alias("sessionId"), *MODULES)


def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstruction metrics of sessions: one for each order.

    An order's lines are added up in the order of the table's files, however they
    are dealt out: means that are equal but for rounding compare by that order.
    """
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    module = F.when(F.col("o_orderkey") % 3 == 0, "behavior_RESS").when(F.col("o_orderkey") % 3 == 1, "behavior_EADS").otherwise("behavior_WAI_sr")
    pid = F.concat(F.lit("P"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))
    placed = li.select("l_orderkey", *(F.col(c).cast("double").alias(c) for c in ("l_discount", "l_tax", "l_quantity")), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    lines = Window.partitionBy("l_orderkey").orderBy("file", "place")
    so_far = lines.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.select("l_orderkey", F.avg("l_discount").over(so_far).alias("mse_model"), F.avg("l_tax").over(so_far).alias("mse_baseline"), F.sum("l_quantity").over(so_far).cast("bigint").alias("length_raw"), F.lead(F.lit(True)).over(lines).alias("more"))
    per = summed.where("more is null").drop("more")
    rows = o.join(per, o.o_orderkey == per.l_orderkey).select(F.concat_ws("|", pid, F.substring("o_orderpriority", 1, 1), module, F.col("o_orderkey").cast("string")).alias("session_id"), pid.alias("participant_id"), "mse_model", "mse_baseline", "length_raw")
    return rows.where("mse_baseline > 0").withColumn("length", F.least("length_raw", F.lit(150).cast("bigint"))).withColumn("improvement_pct", 100 * (F.col("mse_baseline") - F.col("mse_model")) / (F.col("mse_baseline") + 1e-12))


def questionnaires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as typed in: padded ids, session text, scores that may not parse."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.concat(F.lit(" P"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(" ")).alias("Anonymized ID"), F.concat(F.lit("Session "), (1 + k % 5).cast("string")).alias("Session ID"),
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise((F.floor("value") % 22).cast("string")).alias("EADS_Depressao"),
        F.when(F.col("event_id") % 7 != 0, (k % 22).cast("string")).alias("EADS_Ansiedade"), (F.col("event_id") % 22).cast("string").alias("EADS_Stress"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of true and predicted values of padded sequences."""
    e = table(spark, sf_dir, "embeddings")
    vector = next(n for n in e.columns if dict(e.dtypes)[n].startswith("array"))
    long = e.select(F.col("vec_id").alias("session"), F.concat(F.lit("E"), F.col("label").cast("string")).alias("participant"), F.col("label").alias("label"), F.posexplode(vector).alias("i", "v"))
    return long.select("session", "participant", "label", F.expr("i div 8").cast("int").alias("step"), F.concat(F.lit("f"), (F.col("i") % 8).cast("string")).alias("feature"), F.col("v").cast("double").alias("y_true"), (F.col("v").cast("double") * 0.5).alias("y_pred"), (F.expr("i div 8") <= F.col("session") % 8).alias("valid"))


def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_partkey") % 18).cast("int").alias("config_id"), (F.col("l_linenumber") % 3).cast("int").alias("fold_id")).agg(F.avg(F.col("l_discount").cast("double")).alias("val_loss"), (1 + F.count("*") % 25).cast("double").alias("best_epoch"))
