"""Sources and sinks (IO1-IO10).  Every schema is declared."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import find_column
from .json_parts import array_elements, list_elements
from .scratch import saved

POINT = "timestamp:double,x:double,y:double"
MODULE = f"struct<mouseMovements:array<struct<{POINT}>>,clicks:struct<clickDetails:array<struct<{POINT},node:string>>>,userInfo:struct<participantId:string>>"
ACTION = "type:string,start:double,end:double,duration:double,distance:double,x:double,y:double,timestamp:double,node:string,path:array<array<double>>"


def sessions_schema(modules: tuple[str, ...]) -> str:
    return "processNumber string, sessionId string, " + ", ".join(f"`{m}` {MODULE}" for m in modules)


def read_sessions(spark: SparkSession, path: str, modules: tuple[str, ...], lines: bool = False, in_parts: bool = False) -> DataFrame:
    """Raw sessions with ``session_idx``, their place in the file.

    A JSON array is read as one document by one task or, ``in_parts``, by many
    tasks a file.  ``lines`` reads JSON Lines with a ``session_idx`` field.
    """
    schema = sessions_schema(modules)
    if lines:
        return spark.read.schema("session_idx long, " + schema).json(path)
    one = "struct<" + "processNumber:string,sessionId:string," + ",".join(f"`{m}`:{MODULE}" for m in modules) + ">"
    if in_parts:
        return array_elements(spark, path).select(F.col("position").alias("session_idx"), F.from_json("text", one).alias("s")).select("session_idx", "s.*")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<{one}>").alias("a"))
    return whole.select(F.posexplode("a").alias("session_idx", "s")).select(F.col("session_idx").cast("long").alias("session_idx"), "s.*")


def with_positions(sessions: DataFrame, path: str, order: str = "file_order") -> DataFrame:
    """``sessions`` with ``session_idx``, their place in the order of ``order``.

    Ranges of the order are sorted and written to ``path``; a row's place is its
    place in its range and the rows of the ranges before, of which the driver
    holds one count a range.
    """
    at = F.monotonically_increasing_id()
    sessions.repartitionByRange(order).sortWithinPartitions(order).select("*", F.shiftright(at, 33).alias("range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")).write.parquet(path)
    rows = sessions.sparkSession.read.parquet(path)
    before, offsets = 0, []
    for r in sorted(rows.groupBy("range").count().collect()):
        offsets.append((r["range"], before))
        before += r["count"]
    table = F.broadcast(sessions.sparkSession.createDataFrame(offsets, "range long, before long"))
    return rows.join(table, "range").withColumn("session_idx", F.col("before") + F.col("place")).select("session_idx", *sessions.columns)


def write_sessions(sessions: DataFrame, path: str) -> None:
    sessions.write.json(path)


def _write_documents(members: DataFrame, path: str, opens: str, closes: str) -> None:
    """A file a partition that is one JSON document of the members (``value``),
    a member a line; a partition without any makes an empty document."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = opens
        for batch in batches:
            values = batch.column(0).to_pylist()
            if values:
                yield pa.RecordBatch.from_pydict({"value": [(lead if not i else ",") + v for i, v in enumerate(values)]})
                lead = ","
        yield pa.RecordBatch.from_pydict({"value": [closes if lead == "," else opens + closes]})

    members.mapInArrow(lines, "value string").write.text(path)


def write_session_arrays(sessions: DataFrame, path: str) -> None:
    """Arrays of sessions, one a partition, as the recorder writes them."""
    _write_documents(sessions.select(F.to_json(F.struct(*sessions.columns)).alias("value")), path, "[", "]")


def write_sequence_objects(actions: DataFrame, path: str) -> None:
    """Objects of lists of actions, one a partition."""
    _write_documents(_sequence_objects(actions).select(F.expr("substring(value, 2, length(value) - 2)").alias("value")), path, "{", "}")


def read_action_sequences(spark: SparkSession, path: str, lines: bool = False, in_parts: bool = False) -> DataFrame:
    """Rows of actions from files that hold one object of lists each, however it
    is laid out over lines.

    Such a file is read by one task or, ``in_parts``, by many; ``lines`` reads
    one object a line instead, the form that ``write_action_sequences`` writes.
    """
    options = {"allowNonNumericNumbers": "true"}
    if in_parts:
        found = list_elements(spark, path)
        key = F.from_json(F.concat(F.lit("["), "name", F.lit("]")), "array<string>")[0]
        rows = found.select(key.alias("session_key"), F.col("position").cast("int").alias("action_idx"), F.from_json("text", f"struct<{ACTION}>", options).alias("a")).select("session_key", "action_idx", "a.*")
    else:
        text = spark.read.text(path, wholetext=not lines)
        raw = text.select(F.explode(F.from_json("value", f"map<string,array<struct<{ACTION}>>>", options)).alias("session_key", "actions"))
        rows = raw.select("session_key", F.posexplode("actions").alias("action_idx", "a")).select("session_key", "action_idx", "a.*")
    number = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c)
    clean = [number(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    points = F.transform("path", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"), F.get(p, F.lit(2)).alias("t")))
    return rows.select(*clean).withColumn("path", points)


def _sequence_objects(actions: DataFrame) -> DataFrame:
    """An object a sequence, with its key and its list of actions."""
    fields = [c for c in actions.columns if c not in ("session_key", "action_idx", "path")]
    triple = F.transform("path", lambda p: F.array(p["x"], p["y"], p["t"])).alias("path")
    lists = actions.select("session_key", "action_idx", *fields, triple).groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("action_idx", *fields, "path"))).alias("l"))
    bare = F.transform("l", lambda r: F.struct(*(r[f].alias(f) for f in (*fields, "path"))))
    return lists.select(F.to_json(F.create_map("session_key", bare)).alias("value"))


def write_action_sequences(actions: DataFrame, path: str) -> None:
    """One line a sequence: an object with its key and its list of actions."""
    _sequence_objects(actions).write.text(path)


def write_actions_flat(actions: DataFrame, path: str) -> None:
    actions.drop("path").write.csv(path, header=True)


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=";", header=True)


def write_features(features: DataFrame, path: str) -> None:
    features.write.csv(path, sep=";", header=True)


def write_split(df: DataFrame, splits: DataFrame, out: str) -> None:
    """Rows by side, the participants of each side (files in order of their
    names) and the summary, which is taken from the written rows."""
    from ..operators.split import summary_of_sides

    splits = saved(splits, "splits")
    rows = df.join(splits, "participant_id")
    rows.write.partitionBy("split").parquet(f"{out}/rows")
    for side in ("train", "test"):
        splits.where(F.col("split") == side).select("participant_id").orderBy("participant_id").write.text(f"{out}/{side}_participants")
    summary_of_sides(df.sparkSession.read.schema(rows.schema).parquet(f"{out}/rows")).write.json(f"{out}/summary")


def read_participants(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """Distinct trimmed ids, sorted; an empty list is an error if required."""
    ids = spark.read.text(path).select(F.trim("value").alias("participant_id")).where("participant_id <> ''").distinct().orderBy("participant_id")
    if required and ids.isEmpty():
        raise ValueError(f"no participants in {path}")
    return ids


def read_questionnaires(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet, all columns as text; ids must not be taken for numbers."""
    sheet = spark.read.csv(path, header=True, inferSchema=False)
    find_column(sheet, ["anonymized id", "participant", "processnumber"])
    return sheet


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    if kind == "csv":
        df.write.csv(path, header=True)
    else:
        df.write.json(path)


def write_embeddings(df: DataFrame, path: str, width: int, key: str = "vec_id", vector: str = "embedding") -> None:
    """One column a dimension."""
    df.select(key, *(F.col(vector)[j].alias(f"emb_{j}") for j in range(width))).write.csv(path, header=True)
