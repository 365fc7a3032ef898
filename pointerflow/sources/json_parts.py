"""JSON arrays and objects of arrays, read by many tasks a file (IO1, IO2).

Spark's text source divides a file into byte ranges where lines end, and a line
may end at any mark: here at ``}``.  Whether a range starts inside a string, and
how deep, follows from the ranges before it.  A first pass finds how each range
changes both, for either start; one row a range is put together per file; and a
second pass, which knows how each range starts, cuts out the elements.  What a
range's last element lacks is in front of the next range's first one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import SMALL, before
from .scratch import saved

_STRING = re.compile(r'"(?:[^"\\]|\\.)*+(")?', re.S)  # its end, if it has one
_REST = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[\]{]', re.S)

_HEAD, _WHOLE, _MIDDLE, _TAIL = range(4)
_STATES = "file string, start long, quoted boolean, turn long, ends_quoted boolean"
_STARTS = "file string, start long, quoted boolean, depth long"


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """Text up to each ``}`` (left out), with the byte range it was read in; the
    rows of a range come in order."""
    text = spark.read.text(path, lineSep="}")
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _after(part: str, quoted: bool) -> tuple[int, bool]:
    """Change of depth over a part and the ``}`` behind it, and whether a string
    is open then."""
    if quoted:
        end = _REST.match(part)
        if end is None:
            return 0, True
        part = part[end.end() :]
    open_ = False
    if '"' in part:
        strings = list(_STRING.finditer(part))
        open_ = strings[-1][1] is None
        part = _STRING.sub("", part)
    turn = part.count("{") + part.count("[") - part.count("]")
    return (turn, True) if open_ else (turn - 1, False)


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does to depth and strings, for both ways to start."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("quoted", pa.bool_()), ("turn", pa.int64()), ("ends_quoted", pa.bool_())])
    now, ways = None, {}

    def out() -> pa.RecordBatch:
        rows = [(*now, quoted, turn, ends) for quoted, (turn, ends) in ways.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for part, *at in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start"))):
            if at != now:
                if now is not None:
                    yield out()
                now, ways = at, {False: (0, False), True: (0, True)}
            for quoted, (turn, open_) in ways.items():
                more, open_ = _after(part, open_)
                ways[quoted] = (turn + more, open_)
    if now is not None:
        yield out()


def _starts(states: pd.DataFrame) -> pd.DataFrame:
    """How each range of a file starts: a row or two a range."""
    rows, quoted, depth = [], False, 0
    known = {(r.start, r.quoted): (r.turn, r.ends_quoted) for r in states.itertuples()}
    for start in sorted(set(states["start"])):
        rows.append((states["file"].iloc[0], start, quoted, depth))
        turn, quoted = known[start, quoted]
        depth += turn
    return pd.DataFrame(rows, columns=["file", "start", "quoted", "depth"])


def _pieces(level: int):
    """Elements that end at depth ``level``, and what a range has of others."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, quoted, depth, place = None, False, 0, 0
        held: list[str] = []
        rows: list[tuple] = []

        def closed() -> None:
            if now is not None:  # an empty tail parts the heads of two ranges
                rows.append((*now, place, _TAIL if place else _MIDDLE, "".join(held)))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for part, start_quoted, start_depth, *at in zip(*(batch.column(c).to_pylist() for c in ("value", "quoted", "depth", "file", "start"))):
                if at != now:
                    closed()
                    now, quoted, depth, place, held = at, start_quoted, start_depth, 0, []
                turn, quoted = _after(part, quoted)
                depth += turn
                held.append(part + "}")
                if not quoted and depth == level:
                    rows.append((*now, place, _WHOLE if place else _HEAD, "".join(held)))
                    place, held = place + 1, []
            if rows:
                yield out()
                rows.clear()
        closed()
        if rows:
            yield out()

    return pieces


def _elements(spark: SparkSession, path: str, level: int) -> DataFrame:
    """file, start, place, text of each element that ends at depth ``level``: in
    the range where it ends, with what stands between it and the one before."""
    ranges = _ranges(spark, path)
    starts = saved(ranges.mapInArrow(_states, _STATES).groupBy("file").applyInPandas(_starts, _STARTS), "json-ranges")
    if starts.count() < SMALL:
        known = ranges.join(F.broadcast(starts), ["file", "start"])  # rows stay in order
    else:
        numbered = ranges.withColumn("row", F.monotonically_increasing_id())
        known = numbered.join(starts, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "row").drop("row")
    pieces = saved(known.mapInArrow(_pieces(level), "file string, start long, place long, kind int, text string"), "json-elements")
    parted = pieces.where(F.col("kind") != _WHOLE)  # two a range at most
    order = Window.partitionBy("file").orderBy("start", "place")
    parted = parted.withColumn("element", F.count_if(F.col("kind") == _TAIL).over(order))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "text"))), lambda p: p["text"]), "")
    joined = parted.groupBy("file", "element").agg(texts.alias("text"), F.max(F.when(F.col("kind") == _HEAD, F.col("start"))).alias("start")).where("start is not null")
    return pieces.where(F.col("kind") == _WHOLE).select("file", "start", "place", "text").unionByName(joined.select("file", "start", F.lit(0).cast("long").alias("place"), "text"))


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """position and text of the objects in files that hold one array of objects,
    in any layout.  Positions count from 0 in each file."""
    elements = saved(_elements(spark, path, 1), "json-array")
    totals = before(elements.groupBy("file", "start").agg(F.count("*").alias("n")), ["file"], "start", ["n"]).drop("n")
    placed = elements.join(totals, ["file", "start"])
    return placed.select((F.col("n_before") + F.col("place")).alias("position"), F.expr("substring(text, locate('{', text))").alias("text"))


def _keyed(text: str) -> tuple[str | None, str]:
    """The list's name, if one stands in front of the element, and the element."""
    depth, name = 0, None
    for m in _MARKS.finditer(text):
        mark = m.group()
        if mark[0] == '"':
            name = mark  # in front of an element stand no strings but names
        elif mark == "{":
            rest = text[m.end() :].lstrip()
            if name is None and not depth and rest.startswith('"') and re.match(r'"(?:[^"\\]|\\.)*+"\s*:\s*\[', rest, re.S):
                continue  # the outer object opens
            return name, text[m.start() :]
    return name, ""


def list_elements(spark: SparkSession, path: str) -> DataFrame:
    """name (as a JSON string), position and text of the objects in files that
    hold one object of lists of objects.  Positions count from 0 in each list."""
    schema = "file string, start long, place long, name string, text string"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_keyed(t) for t in batch.column("text").to_pylist()]
            columns = [*(batch.column(c) for c in ("file", "start", "place")), pa.array([n for n, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "place", "name", "text"])

    elements = saved(_elements(spark, path, 2).mapInArrow(keyed, schema), "json-lists")
    order = Window.partitionBy("file", "start").orderBy("place")
    filled = elements.withColumns({"named": F.last("name", ignorenulls=True).over(order), "list": F.count("name").over(order)})
    filled = filled.withColumn("at", F.row_number().over(Window.partitionBy("file", "start", "list").orderBy("place")) - 1)
    # a range's first elements go on with the list that the ranges before it end with
    per = filled.groupBy("file", "start", "list").agg(F.first("named").alias("named"), F.count("*").alias("n"))
    runs = per.groupBy("file", "start").agg(F.max_by(F.struct("named", "n"), "list").alias("last"), F.max(F.when(F.col("list") == 0, F.col("n"))).alias("headless"))
    over = Window.partitionBy("file").orderBy("start")
    runs = runs.withColumn("group", F.count("last.named").over(over))
    counted = Window.partitionBy("file", "group").orderBy("start")
    runs = runs.withColumns({"carried": F.first("last.named").over(counted), "upto": F.sum("last.n").over(counted)})
    carry = runs.select("file", "start", F.lag("carried").over(over).alias("carried"), F.coalesce(F.lag("upto").over(over), F.lit(0)).alias("before"))
    joined = filled.join(carry, ["file", "start"])
    headless = F.col("list") == 0
    return joined.select(F.coalesce("named", "carried").alias("name"), (F.col("at") + F.when(headless, F.col("before")).otherwise(0)).alias("position"), "text")
