"""Settings, specs, sinks, vector stores, writers, and model calls with repair and resumption."""

import json

import pytest
from pyspark.sql import functions as F

from threadlens.operators import model_calls
from threadlens.sources import settings, sinks, tables

SPEC = """
conversation_states: [{name: new, definition: d}]
intents: [{name: a, definition: d, include: [x], exclude: [y]}]
tie_breaks: [{id: t1, rule: r}]
"""


def test_settings_and_specs(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("models: {agent: {name: a}, judge: {name: a}}\nintegrations: {escalation_sink: table, sink_path: x}\n")
    first = settings.load_settings(path)
    first["models"]["agent"]["name"] = "changed"
    again = settings.load_settings(path)
    assert settings.setting(again, "models.agent.name") == "a" and settings.setting(again, "models.no.name", 7) == 7
    with pytest.warns(UserWarning):
        assert isinstance(settings.parts(again).sink, settings.NullSink)
    with pytest.warns(UserWarning):
        assert isinstance(settings.parts(again, "runtime").sink, settings.TableSink)
    again["integrations"]["sink_adapter"] = "no_such_module:Sink"
    again["models"]["judge"]["name"] = "b"
    assert isinstance(settings.parts(again, "runtime").sink, settings.TableSink)
    with pytest.raises(ValueError):
        settings.parts(again, "other")
    spec = tmp_path / "spec.yaml"
    spec.write_text(SPEC)
    assert settings.load_spec(spec)["intents"][0]["name"] == "a"
    for bad in (SPEC.replace("rule: r", "text: r"), SPEC.replace("tie_breaks", "ties"), SPEC.replace("[{name: new, definition: d}]", "[{name: new, definition: d}, {name: new, definition: e}]"), "- 1"):
        spec.write_text(bad)
        with pytest.raises(ValueError):
            settings.load_spec(spec)


def test_escalation_sinks(spark, tmp_path, caplog):
    rows = spark.createDataFrame([(1, True, "A"), (2, False, "B")], "request_id long, escalate boolean, reason string")
    assert settings.NullSink().notify(rows) is None
    settings.LogSink().notify(rows)
    assert '"reason": "A"' in caplog.text
    sink = settings.TableSink(str(tmp_path / "out"))
    sink.notify(rows)
    sink.notify(rows)
    assert tables.load_json_lines(spark, str(tmp_path / "out"), "request_id long, reason string").collect() == [(1, "A")] * 2


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"\nc', None)], "id long, text string, note string")
    sinks.write_table(rows, str(tmp_path / "t"), ["text", "id"])
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["text", "id"]
    with pytest.raises(ValueError):
        sinks.write_table(rows, str(tmp_path / "t"), ["nope"])
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    sinks.write_json_lines(rows, str(tmp_path / "j"), append=True)
    assert tables.load_json_lines(spark, str(tmp_path / "j"), rows.schema.simpleString()[7:-1].replace(":", " ")).count() == 2
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"').first().text == 'a "b"\nc'


def test_vectors(spark, tmp_path):
    path, ids = str(tmp_path / "v"), spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(FileNotFoundError):
        sinks.load_vectors(spark, path, ids, "m")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    sinks.save_vectors(rows, path, "m")
    assert sinks.load_vectors(spark, path, ids, "m").count() == 2
    for wanted, model in ((ids, "other"), (spark.createDataFrame([(3,)], "id long"), "m")):
        with pytest.raises(ValueError):
            sinks.load_vectors(spark, path, wanted, model)


def test_model_calls_are_repaired_stored_and_resumed(spark, tmp_path):
    def ask(prompt):
        if "good" in prompt or ("mend" in prompt and "valid JSON" in prompt):
            return 'Sure: {"intent": "x"}'
        return "no idea"

    store = str(tmp_path / "store")
    asked = spark.createDataFrame([("a", "good"), ("b", "mend"), ("c", "bad"), ("a", "good")], "key string, prompt string")
    got = {r.key: r.value for r in model_calls.complete(asked, store, ask, ("intent",)).collect()}
    assert got == {"a": json.dumps({"intent": "x"}), "b": json.dumps({"intent": "x"}), "c": None}

    def never(prompt):
        raise AssertionError("asked again")

    again = model_calls.complete(asked, store, never, ("intent",))
    assert again.count() == 4 and {r.key: r.value for r in again.collect()} == got
    both = model_calls.compared(asked, str(tmp_path / "ab"), {"one": ask, "two": lambda p: "{}"}, ("intent",))
    assert {(r.candidate, r.n) for r in both.groupBy("candidate").agg(F.count("value").alias("n")).collect()} == {("one", 3), ("two", 0)}
