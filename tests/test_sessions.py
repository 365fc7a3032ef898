"""Sessions and their places in the file."""

import json

from pointerflow.operators import events as ev
from pointerflow.plans import queries
from pointerflow.sources import fixtures as fx
from pointerflow.sources import io


def test_positions_over_ranges(spark, tmp_path):
    sessions = spark.range(1000).selectExpr("lpad(cast((id * 7) % 1000 as string), 4, '0') file_order", "cast(id as string) sessionId").repartition(5)
    got = {r.file_order: r.session_idx for r in io.with_positions(sessions, str(tmp_path / "s")).collect()}
    assert got == {f"{i:04}": i for i in range(1000)}
    assert io.with_positions(sessions.where("false"), str(tmp_path / "none")).count() == 0


def test_select_sessions_gathers_nothing(spark, sf, monkeypatch):
    def whole(*args, **kwargs):
        assert kwargs.get("lines"), "read as one document"
        return read(*args, **kwargs)

    read = io.read_sessions
    monkeypatch.setattr(io, "read_sessions", whole)
    sessions = fx.raw_sessions(spark, sf).count()
    assert queries.QUERIES["pf3_select_sessions"](spark, sf).first().n == min(40, sessions)


def test_array_form(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"processNumber": f"P{i}", "sessionId": str(i)} for i in range(50)]))
    got = ev.select_sessions(io.read_sessions(spark, str(tmp_path / "a.json"), ("m",))).collect()
    assert [(r.session_idx, r.sessionId) for r in got] == [(i, str(i)) for i in range(40)]
