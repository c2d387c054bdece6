"""The SQL forms of the scalar functions against their Column forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from tapeline.functions import clock, naming, sql

c = F.col
NAMES = ["AABBCCDDEEFF_0_rotating_1234567890123.ubv", "aabbccddeeff_2_Rotating_1700000000000.UBV.gz", "short_file.ubv", "x_1000000000000.ubv", "file_+1700000000001.ubv", "file_00000000001700000000002.ubv", "noext", " a<b>c\"d|e ", "***", "", None, "Caméra ", "AABBCCDDEEFF", "ggbbccddeeff_TIMELAPSE_1.ubv", "AA:bb-CC"]
LONGS = [None, 0, 1, 44, 45, 1023, 1024, 3000, 1048575, 1048576, 2**30, 8100000000, 1704067200999, 151548043939920]
RATES = [None, 0, 1, 30, 1000, 44100, 90000, 10**9]

CASES = [
    ("ticks_to_ms(x, rate)", lambda: clock.ticks_to_ms(c("x"), c("rate"))), ("ms_to_time(x)", lambda: clock.ms_to_timestamp(c("x"))), ("timecode(x, rate)", lambda: clock.timecode(c("x"), c("rate"))),
    ("timecode_with_base(x, rate)", lambda: clock.timecode_with_base(c("x"), c("rate"))), ("duration_label(x)", lambda: clock.duration(c("x"))), ("reduced_timescale(x, rate)", lambda: clock.reduced_timescale(c("x"), c("rate"))), ("size_label(x)", lambda: naming.size_label(c("x"))),
    ("wall_clock(x, rate, 1139129710, 1000, 1683867154888)", lambda: clock.wall_clock(c("x"), c("rate"), F.lit(1139129710), F.lit(1000), F.lit(1683867154888))),
    ("mac_of(name)", lambda: naming.mac_of(c("name"))), ("recorded_ms(name)", lambda: naming.recorded_ms(c("name"))), ("mac_display(name)", lambda: naming.mac_display(c("name"))), ("mac_plain(name)", lambda: naming.mac_plain(c("name"))), ("safe_base(name)", lambda: naming.safe_base(c("name"))),
    ("is_low_resolution(name)", lambda: naming.is_low_resolution(c("name"))),
    ("output_name('/in/' || name, time, 'mp4', folder, base)", lambda: naming.output_name(F.concat(F.lit("/in/"), c("name")), c("time"), F.lit("mp4"), c("folder"), c("base"))),
]


@pytest.mark.parametrize(("text", "column"), CASES, ids=[t.split("(")[0] for t, _ in CASES])
def test_sql_function_equals_column(spark, text, column):
    assert {t.split("(")[0] for t, _ in CASES} == set(sql.register(spark))
    times, folders = [None, datetime.datetime(2024, 1, 1, 2, 3, 4)], ["./", "SRC-FOLDER", "", "/out//"]
    rows = [(x, r, NAMES[i % len(NAMES)], times[i % 2], folders[i % 4], [None, "given"][i % 3 == 0]) for i, (x, r) in enumerate((x, r) for x in LONGS for r in RATES)]
    df = spark.createDataFrame(rows, "x long, rate long, name string, time timestamp, folder string, base string")
    got = df.select(F.expr(text).alias("sql"), column().alias("column")).collect()
    assert [r["sql"] for r in got] == [r["column"] for r in got]
