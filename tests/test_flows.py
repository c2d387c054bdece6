"""Files, streams, nested documents and masks from end to end."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tapeline.functions import tracks
from tapeline.operators import catalog, mask, nested, timeline, units
from tapeline.plans import record_queries, standin
from tapeline.sources import archive, sinks
from tapeline.streaming import status

HEAD = "a00009a9fd0c000000000017dec498ab00000014" + "00" * 20 + "00000028"


def test_scan_of_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a.ubv").write_bytes(bytes.fromhex(HEAD))
    (tmp_path / "b.ubv.gz").write_bytes(gzip.compress(bytes.fromhex(HEAD * 2)))
    (tmp_path / "c[1].ubv").write_bytes(bytes.fromhex(HEAD + "ff" * 8))
    files, unmatched = archive.list_files(spark, [f"{tmp_path}/*.gz", f"{tmp_path}/c[1].ubv", f"{tmp_path}/none*"])
    assert sorted(r.path.rsplit("/")[-1] for r in files.collect()) == ["b.ubv.gz", "c[1].ubv"] and unmatched == [f"{tmp_path}/none*"]
    rows = archive.scan(archive.read_contents(spark, [str(tmp_path)]))
    monkeypatch.setattr(archive, "LARGEST", 50)
    assert [r.code for r in archive.too_large(spark, [str(tmp_path)]).collect()] == ["too_large"] and archive.read_contents(spark, [str(tmp_path)]).count() == 2
    count = lambda df: {r.file_id.rsplit("/")[-1]: r["count"] for r in df.groupBy("file_id").count().collect()}
    assert count(archive.with_policy(rows, "drop_file")) == {"a.ubv": 1, "b.ubv.gz": 2}
    assert count(archive.with_policy(rows, "keep_prefix")) == {"a.ubv": 1, "b.ubv.gz": 2, "c[1].ubv": 1}
    with pytest.raises(Exception, match="0xFF is no record start"):
        archive.with_policy(rows, "failfast").collect()


def test_whole_files_are_dropped_without_a_second_read(spark):
    late = bytes.fromhex(HEAD + "a0da7e0444020000" + "00000000000000010000000300112233" + "00000020")
    rows = archive.scan(spark.createDataFrame([("good", bytes.fromhex(HEAD)), ("late", late)], "file_id string, content binary"))
    kept = archive.with_policy(rows, "drop_file")
    assert [r.file_id for r in kept.collect()] == ["good"] and {r.code for r in archive.errors(rows).collect()} <= {"short_sync", "checksum"}
    assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()


def test_nanoseconds_and_header_bytes(spark):
    sync = bytes.fromhex("a0da7e04f902000043e5bd6e00000008645dc61234edce0500000018")
    rows = archive.scan(spark.createDataFrame([("f", bytes.fromhex(HEAD) + sync)], "file_id string, content binary"))
    known = tracks.known_rows(timeline.with_wall_clock(timeline.with_partitions(rows)))
    part = nested.structure(known).first().partitions[0]
    entry = part.entries[0].ClockSync
    assert (entry.wc_ms, entry.wc_seconds, entry.wc_nanoseconds) == (1683867154888, 1683867154, 0x34EDCE05) and part.header.payload == [0] * 20


def record(track, code, sequence, dts, payload):
    """A record with a 64-bit timestamp, as it stands in a recording."""
    lead = bytes([0xA0, track >> 8, track & 255])
    body = lead + bytes([lead[0] ^ lead[1] ^ lead[2]]) + code.to_bytes(2, "big") + sequence.to_bytes(2, "big") + dts.to_bytes(8, "big") + len(payload).to_bytes(4, "big") + payload
    body += b"\0" * (-len(body) % 4)
    return body + len(body).to_bytes(4, "big")


def test_structure_document_byte_for_byte(spark):
    """Two seconds of video at 30 frames a second under one clock sync: the scan gives the structure document that the parts spell out."""
    head, start = bytes(range(200, 220)), 1704067200
    data = record(9, 0xFD0C, 0, 0, head) + record(0xDA7E, 0xFD02, 0, 0, start.to_bytes(4, "big") + bytes(4))
    sync = {"sc_dts": 0, "sc_rate": 1000, "wc_ms": start * 1000, "wc_seconds": start, "wc_nanoseconds": 0}
    entries, at = [{"ClockSync": sync}], 96
    for i in range(60):
        size, key = 5 + i * 37 % 900, i % 30 == 0
        data += record(1004, 0xFD0C if key else 0xDD0C, i, 3000 * i, b"x" * size)
        frame = {"type_char": "V", "track_id": 1004, "data_offset": at, "data_size": size, "dts": 3000 * i, "clock_rate": 90000, "sequence": i, "keyframe": key, "cts": 0, "wc": start * 90000 + 3000 * i, "packet_position": "Single"}
        entries.append({"Frame": frame})
        at = (at + size + 3) // 4 * 4 + 4 + 20
    header = {"file_offset": 0, "dts": 0, "clock_rate": 90000, "format_code": 64780, "payload": list(head)}
    want = json.dumps({"partitions": [{"index": 0, "entries": entries, "header": header}]}, separators=(",", ":"))
    rows = archive.with_policy(archive.scan(spark.createDataFrame([("f", data)], "file_id string, content binary")))
    files = nested.structure(tracks.known_rows(timeline.with_wall_clock(timeline.with_partitions(rows))))
    assert files.select(F.to_json(F.struct("partitions"))).first()[0] == want
    frames = timeline.media_rows(timeline.with_wall_clock(timeline.with_partitions(rows)))
    summary = timeline.section_summary(frames).first()
    assert (summary.video_fps, summary.video_frames, summary.video_duration_ms, summary.discontinuity_ms, summary.start_ms) == (30, 60, 1967, 0, start * 1000)


def test_structure_round_trip(spark, tmp_path):
    rows = [("f", 0, 9, 0, 90000), ("f", 10, 0xDA7E, 500, 1000), ("f", 20, 7, 45000, 90000), ("f", 30, 1000, 8000, 16000), ("f", 40, 5, 600, 1000)]
    df = spark.createDataFrame(rows, "file_id string, file_offset long, track_id int, dts long, clock_rate long")
    sync = F.col("track_id") == 0xDA7E
    df = df.select("*", F.when(sync, F.col("dts")).alias("sc_dts"), F.when(sync, F.lit(1000).cast("long")).alias("sc_rate"), F.when(sync, F.lit(1704067200000).cast("long")).alias("sync_ms"), F.lit(4).cast("long").alias("data_size"), F.col("file_offset").alias("data_offset"), F.lit(1).alias("sequence"), F.lit(True).alias("keyframe"), F.lit(0xFD0C).alias("format_code"), F.lit("Single").alias("packet_position"))
    known = tracks.known_rows(timeline.with_wall_clock(timeline.with_partitions(df)))
    files = nested.structure(known)
    nested.write_structure(files, str(tmp_path / "out"))
    back = nested.read_structure(spark, str(tmp_path / "out"))
    assert back.first().partitions == files.first().partitions
    assert [r.kind for r in nested.flattened(back).orderBy("place").collect()] == ["ClockSync", "Frame", "Frame", "Motion"]
    tree = json.loads(nested.tree(nested.entries(known)).first().tree)
    assert [g["label"] for g in tree["partitions"][0]["groups"]] == ["Video (H.264) (1)", "Audio (AAC) (1)", "Clock Syncs (1)", "Motion (1)"]
    assert "keyframe" not in tree["partitions"][0]["groups"][2]["entries"][0]
    lines = nested.listing(known.join(timeline.wall_clock_steps(timeline.media_rows(known)).select("file_id", "file_offset", "delta_ms"), ["file_id", "file_offset"], "left"))
    nested.write_lines(lines, "line", str(tmp_path / "text"), "file_id", "file_offset")
    assert spark.read.text(str(tmp_path / "text")).count() == 5


def test_stream_equals_batch(spark, tmp_path):
    events = [
        (0, 1, {"type": "file_started", "path": "a"}), (0, 2, {"type": "partitions_found", "count": 2}), (0, 3, {"type": "partition_started", "index": 1, "total": 2}), (0, 4, {"type": "output_generated", "path": "o1"}),
        (1, 5, {"type": "file_started", "path": "b"}), (0, 6, {"type": "output_generated", "path": "o2"}), (0, 7, {"type": "file_completed", "errors": []}), (1, 8, {"type": "partition_error", "index": 0, "error": "bad"}),
        (1, 9, {"type": "file_completed", "errors": ["x", "y"]}), (2, 10, {"type": "call_error", "error": "no file"}), (3, 11, {"type": "log", "level": "warn", "message": "m"}),
    ]
    df = spark.createDataFrame([(f, s, json.dumps(e)) for f, s, e in events], "file_index int, seq long, json string")
    batch = {r.file_index: r for r in status.file_status(status.parsed(df)).collect()}
    assert batch[0].status == "Completed" and batch[0].outputs == ["o1", "o2"] and batch[0].progress == 100 and batch[0].partition_count == 2
    assert batch[1].status == "Failed" and batch[1].error == "x; y" and batch[2].error == "no file" and batch[3].status == "Pending"
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = status.status_stream(stream).format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    last: dict = {}
    for r in spark.sql("select * from states").collect():
        last[r.file_index] = r
    assert {k: tuple(v)[1:] for k, v in last.items()} == {k: tuple(v)[1:] for k, v in batch.items()}
    log = status.log_rows(status.parsed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))))
    run = log.writeStream.outputMode("append").format("memory").queryName("log").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.message for r in spark.sql("select * from log").collect()) == ["Found 2 partition(s)", "Partition #0: bad", "Processing partition 2/2", "m"]


def test_units_and_masks(spark):
    df = spark.createDataFrame([(1, bytes.fromhex("00000002AABB00000001CC"), False), (2, bytes.fromhex("00000002AABB00000001CC"), True), (3, bytes.fromhex("00000009AA"), False), (4, None, False)], "k long, payload binary, plain boolean")
    got = {r.k: bytes(r.stream).hex() for r in units.reframed(df, "k", "plain").collect()}
    assert got == {1: "00000001aabb00000001cc", 2: "00000002aabb00000001cc", 3: "", 4: ""}
    cut = spark.createDataFrame([(5, bytes.fromhex("00000002AABB00000009AA"), False)], df.schema)
    assert [(bytes(r.stream).hex(), r.ok) for r in units.reframed(cut, "k", "plain").collect()] == [("00000001aabb", False)]
    assert units.complete(units.reframed(df.where("k < 3"), "k", "plain"), "k").count() == 2
    with pytest.raises(Exception, match="a unit of frame 5 reaches past its end"):
        units.complete(units.reframed(cut, "k", "plain"), "k").collect()
    assert [(r.unit, r.ok) for r in units.split_units(df.where("k in (1, 3)"), "k").orderBy("k", "unit").collect()] == [(0, True), (1, True), (0, False)]
    row = spark.range(1).select(mask.zeroed_content(F.unhex(F.lit("0102030405")), F.array(F.struct(F.lit(1).cast("long").alias("start"), F.lit(2).cast("long").alias("size")))).alias("x"), mask.masked_payload(F.unhex(F.lit("0102")), F.lit(True)).alias("y"), mask.anonymised_name(F.lit("/a/b.ubv")).alias("z"), mask.anonymised_name(F.lit("b.ubv.gz")).alias("w")).first()
    assert (bytes(row.x).hex(), bytes(row.y).hex(), row.z, row.w) == ("0100000405", "0000", "anonymised-b.ubv.gz", None)


def test_streams_of_each_kind_are_written(spark, tmp_path):
    unit = lambda x: bytes.fromhex("00000002" + x)
    rows = [("/in/a", 0, 10, 7, unit("AABB")), ("/in/a", 0, 30, 7, unit("CCDD")), ("/in/a", 0, 20, 1000, b"snd"), ("/in/a", 1, 40, 1004, unit("EEFF")), ("/in/b", 0, 5, 1004, unit("0102")), ("/in/b", 0, 9, 1000, b"x")]
    frames = spark.createDataFrame([(*r, {"/in/a": 7, "/in/b": 1004}[r[0]]) for r in rows], "file_id string, partition_index int, file_offset long, track_id int, payload binary, video_track int").repartition(3)
    done = {r.name: r.bytes for r in sinks.write_kinds(frames, f"file://{tmp_path}/out").collect()}
    read = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert read == {"a_0_video.h264": bytes.fromhex("00000001AABB00000001CCDD"), "a_0_audio.aac": b"snd", "b_0_video.av1": unit("0102"), "b_0_audio.aac": b"x"}
    assert done == {n: len(x) for n, x in read.items()}
    cut = spark.createDataFrame([("/in/c", 0, 1, 7, unit("AABB")[:-1], 7)], frames.schema)
    with pytest.raises(Exception, match="reaches past its end"):
        sinks.write_kinds(cut, f"file://{tmp_path}/cut").collect()
    assert not [p for p in (tmp_path / "cut").glob("*")]


def test_masked_copies_are_written(spark, tmp_path):
    (tmp_path / "r1.ubv").write_bytes(b"\x01\x02\x03\x04\x05")
    (tmp_path / "r2.ubv").write_bytes(b"\x09")
    files = spark.createDataFrame([(f"{tmp_path}/r1.ubv",), (f"file:{tmp_path}/r2.ubv",)], "file_id string")
    spans = spark.createDataFrame([(f"{tmp_path}/r1.ubv", 2, 2), (f"{tmp_path}/r1.ubv", 0, 1), ("/other.ubv", 0, 1)], "file_id string, start long, size long")
    assert {r.name for r in sinks.write_masked(files, spans, str(tmp_path / "m")).collect()} == {"anonymised-r1.ubv.gz", "anonymised-r2.ubv.gz"}
    assert gzip.decompress((tmp_path / "m" / "anonymised-r1.ubv.gz").read_bytes()) == b"\x00\x02\x00\x00\x05" and len(list((tmp_path / "m").iterdir())) == 2
    with pytest.raises(Exception, match="is compressed"):
        sinks.write_masked(files.withColumn("file_id", F.lit("a.ubv.gz")), spans, str(tmp_path / "n")).collect()


def test_registry(spark, tmp_path):
    cams = spark.createDataFrame([(0, "aabbccddeeff", " "), (1, "AABBCCDDEEFF", "Door"), (2, "aabbccddeeff", "Gate"), (3, "001122334455", "")], "pos long, mac string, name string")
    files = spark.createDataFrame([("AABBCCDDEEFF",), ("001122334455",), (None,), ("0A0A0A0A0A0A",)], "mac string")
    assert {r.mac: r.camera_name for r in catalog.with_camera_names(files, cams).collect()} == {"AABBCCDDEEFF": "Door", "001122334455": None, None: None, "0A0A0A0A0A0A": None}
    assert catalog.upserted(cams, files).count() == 5
    catalog.save_registry(cams, str(tmp_path / "reg"))
    document = spark.read.text(str(tmp_path / "reg")).first().value
    assert json.loads(document) == {"cameras": [{"mac": "AABBCCDDEEFF", "name": "Door"}, {"mac": "aabbccddeeff", "name": "Gate"}]}
    assert [tuple(r) for r in catalog.load_registry(spark, str(tmp_path / "reg")).orderBy("pos").collect()] == [(0, "AABBCCDDEEFF", "Door"), (1, "aabbccddeeff", "Gate")]
    (tmp_path / "bad.json").write_text("{not json")
    assert catalog.load_registry(spark, str(tmp_path / "bad.json")).count() == catalog.load_registry(spark, str(tmp_path / "none.json")).count() == 0


def test_group_totals_beyond_a_bigint(spark, tmp_path):
    """Totals of wall clocks are exact whether they fit a bigint or not; the bounds of one are kept as such."""
    copies = spark.read.parquet("/root/testdata/sf0.001/events.parquet").crossJoin(spark.range(1200).withColumnRenamed("id", "i"))
    copies.withColumns({"event_id": F.expr("event_id + i * 1000"), "user_id": F.expr("user_id + i * 15")}).drop("i").write.parquet(str(tmp_path / "events.parquet"))
    clocked = standin.clocked(spark, str(tmp_path)).where("wc is not null").groupBy("track_id").agg(F.count("*").alias("n"), F.sum(F.expr("div(wc, 1000000)")).alias("high"), F.sum(F.expr("wc % 1000000")).alias("low"))
    want = {r.track_id: (r.n, r.high * 10**6 + r.low) for r in clocked.collect()}
    got = {r.group_track: (r.n, int(r.wc)) for r in record_queries.group_order(spark, str(tmp_path)).where("group_rank = 0").collect()}
    assert got == want and max(total for _, total in got.values()) > 2**63
    ends = nested.narrowed(spark.sql("select cast(x as decimal(30,0)) x from values (-9223372036854775808), (9223372036854775807), (null) t(x)"), "x")
    assert ends.schema["x"].dataType.simpleString() == "bigint" and {r.x for r in ends.collect()} == {-(2**63), 2**63 - 1, None}
