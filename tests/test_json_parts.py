"""JSON documents read by many tasks equal those read whole."""

import json
import random

import pytest

from pointerflow.sources import io
from pointerflow.sources.json_parts import array_elements, list_elements

ODD = ['plain', 'a "quoted" } brace', "back\\slash\\", "{[}]", "é中😀", "", "\n\t}", '"}', "x" * 90]


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes, so that elements lie across them."""
    keys = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def sessions(rnd, n):
    out = []
    for i in range(n):
        click = [{"timestamp": j, "x": 1.5, "y": -2, "node": rnd.choice(ODD)} for j in range(rnd.randint(0, 4))]
        s = {"processNumber": rnd.choice([f"P{i}", None, *ODD]), "sessionId": str(i), "m": {"mouseMovements": [{"timestamp": j, "x": j, "y": 0} for j in range(rnd.randint(0, 6))], "clicks": {"clickDetails": click}}}
        out.append({k: v for k, v in s.items() if rnd.random() < 0.9})
    return out


@pytest.mark.parametrize("indent", [None, 2])
def test_sessions(spark, tmp_path, small_ranges, indent):
    rnd = random.Random(1)
    for k, n in enumerate((30, 1, 0, 9)):
        (tmp_path / f"{k}.json").write_text(json.dumps(sessions(rnd, n), indent=indent, ensure_ascii=bool(k % 2)))
    path = str(tmp_path)
    whole = io.read_sessions(spark, path, ("m",))
    parts = io.read_sessions(spark, path, ("m",), in_parts=True)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert spark.read.text(path, lineSep="}").rdd.getNumPartitions() > 8


@pytest.mark.parametrize("indent", [None, 1])
def test_action_sequences(spark, tmp_path, small_ranges, indent):
    rnd = random.Random(2)
    action = lambda: {"type": "click", "timestamp": rnd.randint(0, 9), "x": rnd.choice([1.0, float("nan"), None]), "node": rnd.choice(ODD), "path": rnd.choice([None, [], [[0, 0, 1], [1, 2, 3]]])}
    for k in range(2):
        lists = {f"p{k}{rnd.choice(ODD)}|{i}|m": [action() for _ in range(rnd.choice([0, 1, 3, 25]))] for i in range(8)}
        (tmp_path / f"{k}.json").write_text(json.dumps(lists, indent=indent))
    (tmp_path / "none.json").write_text("{}")
    path = str(tmp_path)
    whole, parts = io.read_action_sequences(spark, path), io.read_action_sequences(spark, path, in_parts=True)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))


def test_one_long_list_in_many_ranges(spark, tmp_path, small_ranges):
    (tmp_path / "a.json").write_text(json.dumps({"a|1|m": [{"type": "pause", "start": i} for i in range(120)], "b|1|m": [{"type": "pause", "start": -1}]}))
    got = io.read_action_sequences(spark, str(tmp_path), in_parts=True).collect()
    assert sorted((r.session_key, r.action_idx, r.start) for r in got) == [*(("a|1|m", i, i) for i in range(120)), ("b|1|m", 0, -1)]


def test_empty_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]\n")
    assert array_elements(spark, str(tmp_path)).count() == list_elements(spark, str(tmp_path)).count() == 0
