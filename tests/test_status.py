"""The fold with a state of its own: order, repeats, restarts, time-out."""

import json
import random
from unittest.mock import MagicMock

from pyspark.sql import Row

from tapeline.streaming import status

SCHEMA = "file_index int, seq long, json string"


def events(n_files: int, seed: int) -> list[tuple]:
    draw, rows = random.Random(seed), []
    for seq in range(1, n_files * 12):
        kinds = [{"type": "file_started"}, {"type": "partitions_found", "count": draw.randrange(9)}, {"type": "partition_started", "index": draw.randrange(4), "total": 4}, {"type": "output_generated", "path": f"o{seq}"}, {"type": "log", "level": "warn"}, {"type": "call_error", "error": f"e{seq}"}, {"type": "file_completed", "errors": draw.choice([[], ["x", "y"]])}, {"type": "output_generated"}]
        rows.append((draw.randrange(n_files), seq, json.dumps(draw.choices(kinds, [1, 1, 3, 4, 2, 1, 1, 1])[0])))
    return [*rows, (n_files, 1, json.dumps({"type": "log", "level": "info"})), (n_files + 1, None, rows[0][2])]


def run(spark, tmp_path, keep_ms=3_600_000):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = status.changes_stream(stream, keep_ms).format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    query = status.started(writer, spark)
    query.awaitTermination()


def held(spark, tmp_path):
    """The files that have a state."""
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "kept").load()
    return {r.file_index for r in state.select("key.file_index").collect()}


def told(spark, tmp_path):
    return spark.read.schema(status.CHANGES).parquet(str(tmp_path / "out"))


def rows(df):
    return {r.file_index: tuple(r)[1:] for r in df.select("file_index", "status", "partition_count", "progress", "outputs", "error").collect()}


def test_changes_equal_the_batch_in_any_order_and_after_a_restart(spark, tmp_path):
    all_events = events(6, 1)
    mixed = all_events + all_events[::4]
    random.Random(2).shuffle(mixed)
    put = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(mixed[: len(mixed) // 2])
    run(spark, tmp_path)
    put(mixed[len(mixed) // 2 :])
    run(spark, tmp_path)  # from the checkpoint
    want = rows(status.file_status(status.parsed(spark.createDataFrame([e for e in all_events if e[1] is not None], SCHEMA))))
    changes = told(spark, tmp_path)
    assert rows(status.latest(changes)) == want and want[6][0] == "Pending" and len(want) == 7
    assert rows(status.latest(changes.union(changes).repartition(3))) == want
    paths = [p for r in changes.collect() for p in r.output_paths]
    assert len(paths) == len(set(paths)) == sum("path" in e[2] for e in all_events if e[1] is not None)  # an output is told once
    n = changes.count()
    put(mixed[:20])
    run(spark, tmp_path)
    assert told(spark, tmp_path).count() == n  # repeats change nothing
    assert held(spark, tmp_path) == set(range(7))  # finished ones too, for an hour


def test_finished_files_leave_the_state(spark, tmp_path):
    put = lambda *part: spark.createDataFrame([(f, s, json.dumps(e)) for f, s, e in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put((0, 1, {"type": "file_started"}), (0, 2, {"type": "output_generated", "path": "a"}), (0, 5, {"type": "file_completed", "errors": []}), (1, 3, {"type": "file_started"}))
    run(spark, tmp_path, keep_ms=0)
    put((1, 6, {"type": "output_generated", "path": "b"}))
    run(spark, tmp_path, keep_ms=0)
    assert held(spark, tmp_path) == {1}
    put((0, 1, {"type": "file_started"}), (0, 4, {"type": "output_generated", "path": "late"}))  # the state of file 0 begins anew
    run(spark, tmp_path, keep_ms=0)
    assert rows(status.latest(told(spark, tmp_path))) == {0: ("Completed", None, 100.0, ["a", "late"], None), 1: ("Processing", None, None, ["b"], None)}


def test_a_new_file_asks_its_state_once():
    """Every call of a state is a message to the JVM: those of a file without a state are one question and what there is to keep."""
    handle, timer = MagicMock(), MagicMock()
    handle.getValueState.return_value.exists.return_value = False
    timer.getCurrentProcessingTimeInMs.return_value = 1
    follow = status.Follow(5)
    follow.init(handle)
    event = lambda seq, **told: Row(seq=seq, **({"status": None, "partition_count": None, "progress": None, "error": None, "output": None} | told))
    rows = [event(4, output="b"), event(9, status="Completed", progress=100.0), event(2, output="a"), event(4, output="b")]
    (row,) = follow.handleInputRows((3,), iter(rows), timer)
    assert (row.file_index, row.status, row.status_seq, row.progress, row.output_seqs, row.output_paths) == (3, "Completed", 9, 100.0, [2, 4], ["a", "b"])
    calls = [name for name, *_ in handle.mock_calls if name.count("().")] + [name for name, *_ in handle.mock_calls if "Timer" in name]
    assert calls == ["getValueState().exists", "getMapState().updateValue", "getMapState().updateValue", "getValueState().update", "registerTimer"]
