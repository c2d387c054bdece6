"""Recordings of any size: splits, late payloads, inflating streams, masked copies, the data source."""

import gzip
import hashlib
import random
import subprocess
import sys
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeline.functions import tracks
from tapeline.operators import timeline, units
from tapeline.sources import archive, ranges, recordings, sinks, splits
from tests.test_flows import record


def sync(ms=1704067200000):
    return record(0xDA7E, 0xFD02, 0, 0, (ms // 1000).to_bytes(4, "big") + bytes(4))


def chained(path, split):
    """Entries of a file's splits, by the passes' own functions without Spark."""
    length = path.stat().st_size
    parts = [(str(path), i, i * split, (i + 1) * split, length) for i in range(max(1, -(-length // split)))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*parts, strict=True)], names=["file_id", "split", "start", "stop", "length"])
    return [r for b in splits._entries(iter(splits._maps(iter([batch])))) for r in b.to_pylist()]


def same_as_walk(path, split):
    data = path.read_bytes()
    want = list(archive.walk(lambda at, n: data[at : at + n]))
    got, source = [], ranges.opened(str(path))
    for e in chained(path, split):
        got += archive.walk(source.read, e["entry"], e["stop"])
        assert e["broken"] == any(archive.is_broken(head, payload) for _, head, payload, _ in want)
    source.close()
    assert got == want, split


ENDS = [b"", bytes(16), b"\xbb" + bytes(11), record(7, 0xE40C, 1, 5, b"x" * 40)[:30], record(7, 0xE40C, 1, 5, b"x" * 40)[:9], b"\xa0\x00\x00\x01" + bytes(20), record(7, 0xE40C, 1, 2**63, b""), record(0xDA7E, 0xE402, 1, 5, b"abc"), b"\xa0\x00"]


@pytest.mark.parametrize("end", range(len(ENDS)))
def test_a_recording_cut_at_every_place(tmp_path, end):
    """Payloads hold whole records, aligned and not, whose chains lead astray."""
    fake = record(7, 0xE40C, 1, 5, b"f" * 33)
    body = [record(9, 0xE400, 0, 0, bytes(20)), sync(), record(7, 0xE40C, 1, 90, fake * 3), record(1000, 0xC406, 2, 10, b"s" + fake * 2), record(7, 0xE40C, 3, 99, b"big" * 700), record(7, 0x800C, 3, 9, fake[:21])]
    path = tmp_path / "a.ubv"
    path.write_bytes(b"".join(body) + ENDS[end])
    for split in [*range(4, 400, 4), 1000, 2000, 1 << 20]:
        same_as_walk(path, split)


@settings(max_examples=60, deadline=None)
@given(st.randoms(use_true_random=False))
def test_random_recordings_in_random_splits(tmp_path_factory, rnd: random.Random):
    path = tmp_path_factory.mktemp("rec") / "a.ubv"
    seen, data = [record(5, 0xE402, 0, 1, b"")], b""
    for _ in range(rnd.randrange(12)):
        inner = b"".join(rnd.choice([rnd.choice(seen), rnd.randbytes(rnd.randrange(9)), b"\xa0\x00\x07\xa7"]) for _ in range(rnd.randrange(4)))
        seen.append(record(rnd.choice([5, 7, 9, 1000, 0xDA7E]), rnd.choice([0xE40C, 0xC406, 0xE602, 0xE401 & 0xFFF0]), rnd.randrange(9), rnd.choice([1, 2**63]) if rnd.random() < 0.05 else 3, inner))
        data += seen[-1]
    path.write_bytes(data + rnd.choice(ENDS))
    for _ in range(6):
        same_as_walk(path, 4 * rnd.randrange(1, 60))


def test_splits_give_what_contents_give(spark, tmp_path):
    whole = record(9, 0xE400, 0, 0, bytes(20)) + sync() + b"".join(record(7, 0xE40C, i, i * 3000, bytes([i % 256]) * (i * 97 % 3000)) for i in range(200))
    files = {"a.ubv": whole, "b.ubv": whole + b"\xff" * 8, "c.ubv": b"", "d.ubv": bytes(64), "e.ubv": whole[:-50], "f.ubv.gz": gzip.compress(whole), "g.ubv.gz": gzip.compress(whole)[:-9], "h.ubv.gz": gzip.compress(whole + b"\xff" * 8), "i.ubv.gz": gzip.compress(whole) + b"more"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = archive.scan(archive.read_contents(spark, [str(tmp_path)]))
    got = splits.scan_files(spark, [str(tmp_path)], split=4096)
    rows = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert rows(got) == rows(want) and got.count() > 1000
    assert splits.scan_files(spark, [str(tmp_path / "none*")]).count() == 0


def demuxed(data, video):
    """Streams of one recording by plain Python: partition -> (video, audio)."""
    out, part, at = {}, -1, 0
    while at + 24 <= len(data):
        track, size = int.from_bytes(data[at + 1 : at + 3], "big"), int.from_bytes(data[at + 16 : at + 20], "big")
        payload = data[at + 20 : at + 20 + size]
        part += track == 9
        if track == video:
            stream, place = b"", 0
            while place < size:
                n = int.from_bytes(payload[place : place + 4], "big")
                stream += b"\x00\x00\x00\x01" + payload[place + 4 : place + 4 + n]
                place += 4 + n
            out.setdefault((part, "video"), []).append(stream)
        elif track == 1000:
            out.setdefault((part, "audio"), []).append(payload)
        at += 20 + size
        at += -at % 4 + 4
    return {k: b"".join(v) for k, v in out.items()}


def planned(spark, folder):
    rows = archive.with_policy(splits.scan_files(spark, [folder], split=1 << 20, with_payload=False), "keep_prefix")
    return timeline.media_rows(timeline.with_partitions(rows)).withColumn("video_track", F.lit(7))


def test_streams_of_scanned_recordings(spark, tmp_path):
    """Frames of 1 byte to 5 MB: the streams equal a plain demux byte for byte, and no payload is shuffled."""
    rnd = random.Random(4)
    unit = lambda n: n.to_bytes(4, "big") + rnd.randbytes(n)
    sizes = [1, 5, 500, 1019, 1020, 1021, 5000, 600, 70_000, 5 << 20, 3]
    (tmp_path / "in").mkdir()
    for name in ("a.ubv", "b.ubv.gz"):
        data = b""
        for _ in range(2):
            data += record(9, 0xE400, 0, 0, bytes(20)) + sync()
            for i, n in enumerate(sizes):
                data += record(7, 0xE40C, i, i * 3000, unit(n) + (unit(7) if i % 3 == 0 else b"")) + record(1000, 0xC406, i, i, rnd.randbytes(n % 3000)) + record(1004, 0xE40C, i, i, b"not chosen")
        (tmp_path / "in" / name).write_bytes(gzip.compress(data, 1) if name.endswith("gz") else data)
        want = {f"{name}_{p}_{k}.{'h264' if k == 'video' else 'aac'}": x for (p, k), x in demuxed(data, 7).items()}
        plan = planned(spark, str(tmp_path / "in" / name))
        job = sinks.write_streams(plan, str(tmp_path / f"out-{name}"))
        done = {r.name: (r.bytes, r.md5) for r in job.collect()}
        assert {p.name: p.read_bytes() for p in (tmp_path / f"out-{name}").iterdir()} == want
        assert done == {k: (len(x), hashlib.md5(x).hexdigest()) for k, x in want.items()}
        shuffled = [x for x in job._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
        assert shuffled and not any("payload" in x for x in shuffled)
    assert sum(len(x) for x in want.values()) > 10 << 20


def test_payloads_that_are_short_fail_the_job(spark, tmp_path):
    data = record(9, 0xE400, 0, 0, bytes(20)) + record(7, 0xE40C, 0, 0, (3000).to_bytes(4, "big") + b"x" * 3000)
    (tmp_path / "cut.ubv").write_bytes(data[:-100])
    with pytest.raises(Exception, match="3004 bytes at"):
        sinks.write_streams(planned(spark, str(tmp_path / "cut.ubv")), str(tmp_path / "o1")).collect()
    (tmp_path / "bad.ubv").write_bytes(record(9, 0xE400, 0, 0, bytes(20)) + record(7, 0xE40C, 0, 0, (4000).to_bytes(4, "big") + b"x" * 3000))
    with pytest.raises(Exception, match="reaches past its end"):
        sinks.write_streams(planned(spark, str(tmp_path / "bad.ubv")), str(tmp_path / "o2")).collect()
    assert not [p for o in ("o1", "o2") for p in (tmp_path / o).glob("*")]


def test_a_payload_that_was_not_read_is_told(spark):
    rows = spark.createDataFrame([(1, None, 5000, False), (2, None, 0, False), (3, b"", 0, True), (4, None, 9, True)], "k long, payload binary, data_size long, plain boolean")
    assert {r.k: r.ok for r in units.reframed(rows, "k", "plain").collect()} == {1: False, 2: True, 3: True, 4: False}
    with pytest.raises(Exception, match="frame 1 reaches past its end"):
        units.complete(units.reframed(rows.where("k = 1"), "k", "plain"), "k").collect()


@given(st.lists(st.tuples(st.integers(0, 200_000), st.integers(0, 3000)), max_size=12), st.booleans())
@settings(max_examples=40, deadline=None)
def test_ranges_are_read_as_asked(tmp_path_factory, steps, packed):
    data = random.Random(1).randbytes(900_000)
    path = tmp_path_factory.mktemp("r") / ("x.gz" if packed else "x")
    path.write_bytes(gzip.compress(data, 1) if packed else data)
    spans, at = [], 0
    for skip, size in steps:
        spans.append((at + skip % 90_000, size))
        at = sum(spans[-1])
    spans = [s for s in spans if sum(s) <= len(data)]
    source = ranges.opened(str(path))
    assert list(ranges.payloads(source, spans)) == [data[a : a + n] for a, n in spans]
    source.close()


INFLATE = """
import resource, sys
from tapeline.sources import archive, ranges, splits
path = sys.argv[1]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
s = ranges.opened(path)
print(splits._sound(s))
s.close()
s = ranges.opened(path)
print([(at, len(head), payload) for at, head, payload, error in archive.walk(s.read)][-1])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_inflating_takes_constant_memory(tmp_path):
    """A compressed recording of 2.2 GB, most of it one payload of zeros."""
    size = 2_200_000_000
    head, packer = record(9, 0xE400, 0, 0, bytes(20)), zlib.compressobj(1, wbits=31)
    lead = record(7, 0xE40C, 1, 5, b"")[:16] + size.to_bytes(4, "big")
    with (tmp_path / "big.ubv.gz").open("wb") as out:
        out.write(packer.compress(head + lead))
        for _ in range(size // 1_000_000):
            out.write(packer.compress(bytes(1_000_000)))
        out.write(packer.compress(bytes(4) + record(5, 0xE402, 2, 9, b"last")) + packer.flush())
    said = subprocess.run([sys.executable, "-c", INFLATE, str(tmp_path / "big.ubv.gz")], capture_output=True, text=True, check=True).stdout.splitlines()
    at = len(head) + 20 + size
    assert said[:2] == ["(False, None)", str((at + -at % 4 + 4, 20, b"last"))] and int(said[2]) < 150


def test_masked_copy_of_more_than_a_gigabyte(spark, tmp_path):
    size = 1_200_000_000
    with (tmp_path / "large.ubv").open("wb") as out:
        out.truncate(size)
        for at in (0, size // 2, size - 4):
            out.seek(at)
            out.write(b"data")
    files = spark.createDataFrame([(f"{tmp_path}/large.ubv",)], "file_id string")
    spans = spark.createDataFrame([(f"{tmp_path}/large.ubv", 1, 2), (f"{tmp_path}/large.ubv", size // 2 - 3, size // 2 + 2)], "file_id string, start long, size long")
    done = sinks.write_masked(files, spans, str(tmp_path / "out"), check=True).first()
    digest = hashlib.md5(b"d\x00\x00a")
    for _ in range((size - 8) // 1000 // 4):
        digest.update(bytes(4000))
    digest.update(bytes((size - 8) % 4000) + bytes(3) + b"a")
    assert (done.plain_bytes, done.md5) == (size, digest.hexdigest()) and done.bytes == (tmp_path / "out" / done.name).stat().st_size


def test_data_source_reads_what_is_asked_for(spark, tmp_path):
    data = record(9, 0xE400, 0, 0, bytes(20)) + sync() + b"".join(record(7 if i % 2 else 1000, 0xE40C, i, i, b"p" * (i * 50)) for i in range(60))
    for ms in (1700000000000, 1700000100000):
        (tmp_path / f"AABBCCDDEEFF_0_rotating_{ms}.ubv").write_bytes(data)
    (tmp_path / "AABBCCDDEEFF_0_rotating_1700000200000.ubv.gz").write_bytes(gzip.compress(data)[:-9])
    (tmp_path / "_ignored").write_bytes(b"x")
    recordings.register(spark)
    read = spark.read.format("recordings").option("path", str(tmp_path)).load()
    assert read.where("error is not null").select("file_name", "error.code").collect() == [("AABBCCDDEEFF_0_rotating_1700000200000.ubv.gz", "bad_gzip")]
    some = read.where("track_id = 1000 and name_ms < 1700000200000 and name_mac = 'AABBCCDDEEFF'")
    want = archive.scan(archive.read_contents(spark, [str(tmp_path)])).where("track_id = 1000 and error is null")
    columns = ["file_offset", "dts", "data_size", "payload", "clock_rate", "keyframe"]
    assert sorted(archive.decoded(some).select(*columns).collect()) == sorted(want.select(*columns).collect()) and some.count() == 60
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")  # the source has taken all of them
    reader = recordings.Recordings({"path": str(tmp_path)}).reader(None)
    left = list(reader.pushFilters([recordings.EqualTo(("track_id",), 1000), recordings.LessThan(("name_ms",), 1700000050000), recordings.EqualTo(("payload",), b"")]))
    assert len(left) == 1 and [p for part in reader.partitions() for p in part.paths] == [f"file:{tmp_path}/AABBCCDDEEFF_0_rotating_1700000000000.ubv"]  # the others are not opened
    assert {r.data_offset for r in archive.decoded(some.where("track_id = 5")).collect()} == set()
    bare = spark.read.format("recordings").option("path", str(tmp_path)).option("payload", "false").load().where("error is null")
    assert bare.where("payload is not null").select("track_id").distinct().collect() == [(tracks.SYNC,)]
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW recorded USING recordings OPTIONS (path '{tmp_path}')")
    assert spark.sql("SELECT count(*) FROM recorded WHERE track_id = 7 AND file_name LIKE '%00000.ubv'").first()[0] == 60


def test_files_are_listed_once(spark, tmp_path):
    (tmp_path / "1.ubv").write_bytes(record(9, 0xFD0C, 0, 0, b"h"))
    rows = splits.scan_files(spark, [str(tmp_path)])
    assert "binaryFile" not in rows._jdf.queryExecution().toString() and rows.count() == 1
