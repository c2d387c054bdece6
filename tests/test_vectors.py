"""Fixed vectors: headers, clocks, rates, names."""

import pytest
from pyspark.sql import functions as F

from tapeline.functions import clock, decode, naming
from tapeline.operators import repair, timeline
from tapeline.sources import archive


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def long(x):
    return F.lit(x).cast("long")


def binary(text):
    return F.unhex(F.lit(text.replace(" ", "")))


def scanned(spark, text):
    return archive.scan(spark.range(1).select(F.lit("f").alias("file_id"), binary(text).alias("content"))).collect()


def test_header_record(spark):
    (row,) = scanned(spark, "a0 00 09 a9 fd 0c 00 00 00 00 00 17 de c4 98 ab 00 00 00 14" + "00" * 20 + "00 00 00 28")
    assert (row.track_id, row.header_bytes, row.data_size, row.data_offset, row.error) == (9, 16, 20, 20, None)


def test_sync_record(spark):
    (row,) = scanned(spark, "a0 da 7e 04 f9 02 00 00 43 e5 bd 6e 00 00 00 08 64 5d c6 12 34 ed ce 00 00 00 00 18")
    assert (row.sc_dts, row.sc_rate, row.sync_ms) == (0x43E5BD6E, 1000, 1683867154888)


def test_errors(spark):
    first = "a0 00 09 a9 fd 0c 00 00 00 00 00 17 de c4 98 ab 00 00 00 14" + "00" * 20 + "00 00 00 28"
    rows = scanned(spark, first + "ba 00 00 00 00 00 00 00")
    assert rows[1].error.code == "bad_magic" and rows[1].error.offset == 44
    assert [r.error.code for r in scanned(spark, "a0 00 09 a8 fd 0c 00 00")] == ["checksum"]
    assert [r.error.code for r in scanned(spark, "a0 00 09 a9 fd 0c 00 00 00")] == ["short_header"]
    assert scanned(spark, "a0 00 09") == [] and scanned(spark, "00" * 16) == []
    (short,) = scanned(spark, "a0 da 7e 04 f9 02 00 00 43 e5 bd 6e 00 00 00 03 64 5d c6 00 00 00 00 14")
    assert short.error.code == "short_sync" and "0x" in short.error.message
    (cut,) = scanned(spark, "a0 00 09 a9 fd 0c 00 00 00 00 00 17 de c4 98 ab 00 00 10 00")
    assert cut.error is None and cut.payload is None and cut.data_size == 4096


@pytest.mark.parametrize(
    ("code", "key", "wide", "rate", "header"),
    [(0xED0C, True, True, 90000, 16), (0xF902, True, False, 1000, 12), (0xCD0C, False, True, 90000, 16), (0xFD02, True, True, 1000, 16), (0xFD0A, True, True, 44100, 16), (0xFD06, True, True, 16000, 16)],
)
def test_format_codes(spark, code, key, wide, rate, header):
    c = F.lit(code)
    got = spark.range(1).select(decode.has(c, decode.KEYFRAME), decode.has(c, decode.DTS_64), decode.table_rate(c), decode.header_length(c), decode.packet_position(c)).first()
    assert tuple(got) == (key, wide, rate, header, "Single")


def test_layout(spark):
    got = spark.range(1).select(decode.padding(long(1), long(16), long(1)), decode.total_size(long(1), long(16), long(1))).first()
    assert tuple(got) == (2, 27)


def test_sync_payload(spark):
    assert one(spark, decode.sync_ms(binary("645dc61234edce00"))) == 1683867154888
    assert one(spark, decode.sync_ms(binary("698bcc9120c85580"))) == 1770769553550
    assert one(spark, decode.sync_ms(binary("645dc6"))) is None
    assert one(spark, decode.unsigned(binary("ffffffffffffffff"), 0, 8)) is None


@pytest.mark.parametrize(
    ("dts", "rate", "sc", "wc", "want"),
    [
        (102521673899, 90000, 1139129710, 1683867154888, 151548043939919), (50235621221, 44100, 1139129710, 1683867154888, 74258541531571), (50235622245, 44100, 1139129710, 1683867154888, 74258541532595),
        (772028166536, 90000, 8578090739, 1770769553550, 159369259819526), (137249449847, 16000, 8578090739, 1770769553550, 28332312854823), (50265538405, 44100, 1139808043, 1683867833226, 74258571448976), (100, 90000, 1000, 0, 0),
    ],
)
def test_wall_clock(spark, dts, rate, sc, wc, want):
    assert one(spark, clock.wall_clock(long(dts), long(rate), long(sc), long(1000), long(wc))) == want


@pytest.mark.parametrize(("ticks", "rate", "want"), [(1683867154888, 1000, 1683867154888), (151548043939920, 90000, 1683867154888), (45, 90000, 1), (44, 90000, 0), (5, 0, None)])
def test_ticks_to_ms(spark, ticks, rate, want):
    assert one(spark, clock.ticks_to_ms(long(ticks), long(rate))) == want


def frames(spark, rows):
    """(track, ms) in order as clocked frames."""
    data = [("f", 0, i, t, ms * 90, 90000 if t == 7 else 48000, ms) for i, (t, ms) in enumerate(rows)]
    return spark.createDataFrame(data, "file_id string, partition_index int, file_offset long, track_id int, dts long, clock_rate long, wc_ms long")


@pytest.mark.parametrize(
    ("steps", "rate", "want"),
    [([3000] * 9, 90000, 30), ([5999] * 4, 90000, 15), ([6000] * 4, 90000, 15), ([6001] * 4, 90000, 15), ([1] * 5, 90000, 90000), ([], 90000, None), ([0, 0], 90000, None), ([3000] * 4, 0, None), ([10, 30], 90, 3)],
)
def test_nominal_rate(spark, steps, rate, want):
    dts = [0]
    for x in steps:
        dts.append(dts[-1] + x)
    df = spark.createDataFrame([("f", 0, 7, i, v, rate) for i, v in enumerate(dts)], "file_id string, partition_index int, track_id int, file_offset long, dts long, clock_rate long")
    row = timeline.track_rates(df).first()
    assert row.nominal_fps == want
    assert row.export_fps == (1 if want is None else 30 if want > 120 else want)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(7, 0), (7, 33), (7, 10033), (7, 10066)], [(2, 0, 0), (2, 0, 0)]),
        ([(7, 0), (7, 33), (7, 533), (7, 566)], [(4, 0, 467)]),
        ([(1000, 0), (1000, 20), (1000, 40)], [(0, 3, 0)]),
        ([(7, 0), (1000, 1000), (1000, 3000), (7, 10000), (1000, 11000)], [(1, 2, 0), (1, 1, 0)]),
        ([(7, 0), (7, 100), (7, 50), (7, 200)], None),
    ],
)
def test_sections(spark, rows, want):
    got = timeline.section_summary(frames(spark, rows)).orderBy("section_index").collect()
    if want is None:
        assert len(got) == 1 and (got[0].video_first_ms, got[0].video_last_ms) == (0, 200)
    else:
        assert [(r.video_frames, r.audio_frames) for r in got] == [w[:2] for w in want]
        assert [r.discontinuity_ms for r in got][0] == want[0][2]


def test_timecodes(spark):
    day = 1_700_000_000_000 // 86_400_000 * 86_400_000
    at = day + (10 * 3600 + 30 * 60 + 45) * 1000
    assert one(spark, clock.timecode(long(at), F.lit(30.0))) == "10:30:45:01"
    assert one(spark, clock.timecode(long(at + 500), F.lit(30.0))) == "10:30:45:16"
    assert one(spark, clock.timecode_with_base(long(1779805845000), long(30))) == "2026-05-26 14:30:45:01@30"
    assert one(spark, clock.timecode_with_base(long(1779805845000), long(0))) == "2026-05-26 14:30:45"
    assert one(spark, clock.timecode_with_base(F.lit(None).cast("long"), long(30))) == "-"
    for ms, want in ((0, "00:00:00.000"), (1234, "00:00:01.234"), (3600000, "01:00:00.000"), (3661500, "01:01:01.500"), (360000000, "100:00:00.000")):
        assert one(spark, clock.duration(long(ms))) == want


def test_reduced_timescale(spark):
    for dts, rate in ((324000000, 90000), (2147483647, 90000), (0, 90000), (8100000000, 0)):
        assert one(spark, clock.reduced_timescale(long(dts), long(rate))) is None
    for dts in (8100000000, 32400000000):
        got = one(spark, clock.reduced_timescale(long(dts), long(90000)))
        assert 0 < got and got * dts // 90000 <= 2**31 - 1


def test_repair_equals_row_loop(spark):
    import random

    rng, rows, want = random.Random(4), [], {}
    for f in range(30):
        before, first = None, None
        for i in range(rng.randint(1, 40)):
            v = rng.randint(0, 60)
            first = v if first is None else first
            base = max(v - first, 0)
            before = base if before is None else max(base, before + 1)
            rows.append((f, i, v))
            want[f, i] = before
    got = repair.monotonic(spark.createDataFrame(rows, "f long, o long, v long"), ["f"], "v", "o").collect()
    assert {(r.f, r.o): r.repaired for r in got} == want


def test_interleave_equals_head_compare(spark):
    import random

    rng, rows, want = random.Random(9), [], {}
    for g in range(40):
        streams = [[rng.randint(0, 9) for _ in range(rng.randint(0, 6))] for _ in range(2)]
        offsets = [[i * 2 + k for i in range(len(x))] for k, x in enumerate(streams)]
        rows += [(g, o, v, k == 0) for k in range(2) for o, v in zip(offsets[k], streams[k], strict=True)]
        at, place = [0, 0], 1
        while at[0] < len(streams[0]) or at[1] < len(streams[1]):
            k = 0 if at[1] >= len(streams[1]) or (at[0] < len(streams[0]) and streams[0][at[0]] <= streams[1][at[1]]) else 1
            want[g, offsets[k][at[k]]] = place
            at[k], place = at[k] + 1, place + 1
    got = repair.interleaved(spark.createDataFrame(rows, "g long, o long, v long, video boolean"), ["g"], "v", F.col("video"), "o").collect()
    assert {(r.g, r.o): r.place for r in got} == want


@pytest.mark.parametrize(
    ("name", "mac", "ms", "low"),
    [
        ("AABBCCDDEEFF_0_rotating_1234567890123.ubv", "AABBCCDDEEFF", 1234567890123, False), ("aabbccddeeff_2_rotating_1700000000000.ubv.gz", "AABBCCDDEEFF", 1700000000000, True), ("short_file.ubv", None, None, False),
        ("GGBBCCDDEEFF_file.ubv", None, None, False), ("AABBCCDDEEFFAA_file.ubv", None, None, False), ("AABBCCDDEEFF.ubv", None, None, False), ("noext", None, None, False), ("x_00000000001700000000002.ubv", None, 1700000000002, False), ("file_1000000000000.ubv", None, None, False),
        ("file_10000000000000.ubv", None, None, False), ("x_TimeLapse_1700000000000.UBV", None, 1700000000000, True),
    ],
)
def test_names(spark, name, mac, ms, low):
    n = F.lit(name)
    got = spark.range(1).select(naming.mac_of(n), naming.recorded_ms(n), naming.is_low_resolution(n)).first()
    assert tuple(got) == (mac, ms, low)


def test_labels(spark):
    for text, want in (("cam/back\\yard", "cambackyard"), ("test:file*name?", "testfilename"), ('a<b>c"d|e', "abcde"), ("Caméra Jardin", "Caméra Jardin"), ("  hello  ", "hello"), ("", None), ("***", None), ("  ", None)):
        assert one(spark, naming.safe_base(F.lit(text))) == want
    for text, want in (("aabbccddeeff", "AA:BB:CC:DD:EE:FF"), ("aabb", None), ("aabbccddeeffaa", None), ("zzbbccddeeff", None), ("", None)):
        assert one(spark, naming.mac_display(F.lit(text))) == want
