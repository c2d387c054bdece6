"""The store of decoded records: what each run takes in, what it opens, which folders a query reads."""

import os

import pyarrow as pa
import pytest

from tapeline.session import saved
from tapeline.sources import archive, sinks, splits, store
from tests.test_flows import record

A, B, C = "AABBCCDDEE01_0_rotating_1704067200000.ubv", "AABBCCDDEE01_0_rotating_1704070800000.ubv", "001122334455_0_rotating_1704153600000.ubv"
START = record(9, 0xFD0C, 0, 0, b"h")


def held(spark, kept):
    return {(r.file_id.rsplit("/")[-1], r.camera, r.day): r["count"] for r in store.records(spark, kept).groupBy("file_id", "camera", "day").count().collect()}


def told(changes):
    return {r.path.rsplit("/")[-1]: r.change for r in changes.collect()}


def test_runs_take_in_what_is_new(spark, tmp_path, monkeypatch):
    folder, kept = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / A).write_bytes(START + record(7, 0xDD0C, 1, 5, b"x" * 3000))
    (folder / B).write_bytes(START)
    (folder / "plain.ubv").write_bytes(START + b"\xbb" * 8)
    (folder / "empty.ubv").write_bytes(b"")
    assert store.records(spark, kept).count() == store.files(spark, kept).count() == 0 and told(store.ingest(spark, [f"{folder}/none*"], kept)) == {}
    assert told(store.ingest(spark, [str(folder)], kept)) == {A: "new", B: "new", "plain.ubv": "new"}
    first = {(A, "AABBCCDDEE01", "2024-01-01"): 2, (B, "AABBCCDDEE01", "2024-01-01"): 1, ("plain.ubv", "unknown", "unknown"): 2}
    assert held(spark, kept) == first and [r.code for r in archive.errors(store.records(spark, kept)).collect()] == ["bad_magic"]
    columns = ["file_id", "file_offset", "track_id", "dts", "payload", "data_offset", "data_size", "error", "broken"]
    direct = splits.scan_files(spark, [str(folder)]).select(columns)
    stored = store.records(spark, kept).select(columns)
    assert direct.exceptAll(stored).count() == stored.exceptAll(direct).count() == 0

    monkeypatch.setattr(splits, "scan_listed", None)  # nothing new: nothing is scanned, nothing is written
    before = sorted(p for p, *_ in os.walk(kept))
    assert told(store.ingest(spark, [str(folder)], kept)) == {} and before == sorted(p for p, *_ in os.walk(kept))
    monkeypatch.undo()

    (folder / B).write_bytes(START + record(1000, 0xDD06, 1, 5, b"a") * 2)
    (folder / C).write_bytes(START)
    opened = []  # not the first recording, though its rows are in a folder that is written anew
    scan = splits.scan_listed
    monkeypatch.setattr(splits, "scan_listed", lambda files, split: opened.extend(r.path.rsplit("/")[-1] for r in files.collect()) or scan(files, split))
    assert told(store.ingest(spark, [str(folder)], kept)) == {B: "changed", C: "new"} and sorted(opened) == sorted([B, C])
    second = first | {(B, "AABBCCDDEE01", "2024-01-01"): 3, (C, "001122334455", "2024-01-02"): 1}
    assert held(spark, kept) == second and {r.run for r in store.files(spark, kept).collect()} == {1, 2}

    (folder / C).unlink()
    (folder / B).unlink()
    assert told(store.ingest(spark, [str(folder)], kept)) == {} and held(spark, kept) == second  # files may be moved away
    assert told(store.ingest(spark, [str(folder)], kept, drop_missing=True)) == {B: "removed", C: "removed"}
    assert held(spark, kept) == {k: n for k, n in first.items() if k[0] != B} and store.files(spark, kept).count() == 2
    (folder / C).write_bytes(START)
    assert told(store.ingest(spark, [str(folder)], kept)) == {C: "new"} and (C, "001122334455", "2024-01-02") in held(spark, kept)


def test_a_run_that_was_cut_off_is_done_again(spark, tmp_path, monkeypatch):
    folder, kept = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / A).write_bytes(START * 3)
    exists = store._exists

    def failing(session, path):
        if path.endswith("/files") and exists(session, f"{kept}/records"):
            raise RuntimeError("lost")
        return exists(session, path)

    monkeypatch.setattr(store, "_exists", failing)
    with pytest.raises(RuntimeError, match="lost"):  # records are written, the list is not
        store.ingest(spark, [str(folder)], kept)
    monkeypatch.undo()
    assert held(spark, kept) == {(A, "AABBCCDDEE01", "2024-01-01"): 3} and store.files(spark, kept).count() == 0
    assert told(store.ingest(spark, [str(folder)], kept)) == {A: "new"} and held(spark, kept) == {(A, "AABBCCDDEE01", "2024-01-01"): 3}


def test_queries_read_their_folders_alone(spark, tmp_path):
    folder, kept = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for name in (A, C):
        (folder / name).write_bytes(START)
    store.ingest(spark, [str(folder)], kept)
    rows = store.records(spark, kept).where("camera = '001122334455' and day >= '2024-01-02'").select("dts")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    chosen = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "camera#" in chosen and "day#" in chosen and rows.count() == 1


def test_work_for_each_small_folder_and_split_is_shared(spark, tmp_path):
    """Spark lists by a few tasks a core, not by one for each path, and small splits share batches."""
    folder, kept = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    names = [f"AABBCCDDEE01_0_rotating_{1704067200000 + day * 86_400_000}.ubv" for day in range(40)]  # Spark's own threshold is 32 paths
    for name in names:
        (folder / name).write_bytes(START + record(7, 0xDD0C, 1, 5, b"x"))
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    most = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")

    def tasks(name, run):
        context.setJobGroup(name, "")
        found = run()
        context.setLocalProperty("spark.jobGroup.id", None)
        stages = [s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds]
        return found, max(tracker.getStageInfo(s).numTasks for s in stages)

    (files, _), n = tasks("files listed", lambda: archive.list_files(spark, [f"{folder}/AA*"]))
    assert n <= 4 * context.defaultParallelism and files.count() == 40
    store.ingest(spark, [str(folder)], kept)
    rows, n = tasks("store listed", lambda: store.records(spark, kept))
    assert n <= 4 * context.defaultParallelism and rows.count() == 80 and rows.select("day").distinct().count() == 40
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == most

    stored = lambda: {f"{p}/{f}": os.stat(f"{p}/{f}").st_mtime_ns for p, _, found in os.walk(f"{kept}/records") for f in found}
    before = stored()
    (folder / "AABBCCDDEE01_0_rotating_1704067200001.ubv").write_bytes(START)
    store.ingest(spark, [str(folder)], kept)
    after = stored()
    assert set(before) == set(after) and len(after) == 40 and {p.split("day=")[1][:10] for p in after if after[p] != before[p]} == {"2024-01-01"} and rows.sparkSession.read.parquet(f"{kept}/records").where("file_id is not null").count() == 81

    splits_of = [pa.array(x) for x in ([f"{folder}/{n}" for n in names], [0] * 40, [0] * 40, [64] * 40, [len(START)] * 40)]
    maps = list(splits._maps(iter([pa.RecordBatch.from_arrays(splits_of, names=["file_id", "split", "start", "stop", "length"])])))
    entries = list(splits._entries(iter(maps)))
    assert [b.num_rows for b in maps] == [b.num_rows for b in entries] == [40] and [b.num_rows for b in splits._records(True)(iter(entries))] == [80]


def test_folders_are_replaced_by_a_task_that_is_run_again(spark, tmp_path):
    kept, staging = tmp_path / "kept", tmp_path / "staging"
    staging.mkdir()
    for n in (3, 2):  # the second time in place of the first
        rows = spark.range(n).selectExpr("'a' as camera", "cast(id % 2 as string) as day", "id").repartition(1).sortWithinPartitions("camera", "day")
        staged = saved(sinks.stage_folders(rows, ["camera", "day"], str(staging)))
        for _ in range(2):  # its files are gone from the staging folder by then
            sinks.replace_folders(staged, str(staging), str(kept))
        assert sorted(r.id for r in spark.read.parquet(str(kept)).collect()) == list(range(n)) and not os.listdir(staging)
    gone = spark.createDataFrame([("camera=a/day=7", "lost.parquet")], "path string, file string")
    with pytest.raises(Exception, match="lost.parquet"):
        sinks.replace_folders(gone, str(staging), str(kept))


def test_a_run_lists_its_cameras_alone(spark, tmp_path):
    folder, kept = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / A).write_bytes(START)
    store.ingest(spark, [str(folder)], kept)
    odd = f"{kept}/records/camera=AABBCCDDEE01/odd=1/other=2"  # a store with this folder cannot be listed
    os.makedirs(odd)
    os.link(next(f"{p}/{f}" for p, _, found in os.walk(f"{kept}/records") for f in found if f.endswith(".parquet")), f"{odd}/x.parquet")
    (folder / C).write_bytes(START)
    assert told(store.ingest(spark, [str(folder)], kept)) == {C: "new"} and store.records(spark, kept, ["001122334455", "none"]).count() == 1
    with pytest.raises(Exception, match="(?i)conflicting"):
        store.records(spark, kept).count()
