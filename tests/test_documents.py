"""Structure documents as files: byte for byte the nested form, read entry by entry."""

import gzip
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeline.functions import tracks
from tapeline.operators import nested, timeline
from tapeline.plans import standin
from tapeline.sources import archive, documents
from tests.test_flows import record

SF = "/root/testdata/sf0.001"


def test_documents_equal_the_nested_form(spark, tmp_path):
    rows = tracks.known_rows(standin.clocked(spark, SF))
    done = {r.name: (r.entries, r.bytes) for r in documents.write_documents(rows, str(tmp_path / "out")).collect()}
    want = {f"{r.file_id}.metadata.json.gz": r.json.encode() for r in nested.structure(rows).select("file_id", F.to_json(F.struct("partitions")).alias("json")).collect()}
    assert {p.name: gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").iterdir()} == want
    assert {k: b for k, (_, b) in done.items()} == {k: len(x) for k, x in want.items()} and sum(n for n, _ in done.values()) == rows.where("track_type <> 'PartitionHeader'").count()
    back = documents.read_documents(spark, [str(tmp_path / "out")])
    flat = nested.flattened(nested.structure(rows))
    assert sorted(map(str, documents.flattened(back).select(*flat.columns).collect())) == sorted(map(str, flat.withColumn("place", F.col("place").cast("long")).collect()))
    headers = nested.structure(rows).select("file_id", F.explode("partitions").alias("p")).select("file_id", "p.index", "p.header").where("header is not null")
    assert sorted(map(str, back.where("place is null").select("file_id", F.col("partition_index").alias("index"), "header").collect())) == sorted(map(str, headers.collect()))


def test_document_of_a_recording(spark, tmp_path):
    data = record(9, 0xFD0C, 0, 0, bytes(range(200, 220))) + record(0xDA7E, 0xFD02, 0, 0, (1704067200).to_bytes(4, "big") + bytes(4)) + record(9, 0xFD0C, 0, 9, bytes(20)) + record(7, 0xFD0C, 1, 90, b"x" * 40)
    rows = archive.with_policy(archive.scan(spark.createDataFrame([("/in/AA.ubv", data)], "file_id string, content binary")))
    documents.write_documents(tracks.known_rows(timeline.with_wall_clock(timeline.with_partitions(rows))), str(tmp_path)).collect()
    (path,) = tmp_path.glob("*.gz")
    parts = json.loads(gzip.decompress(path.read_bytes()))["partitions"]
    assert path.name == "AA.ubv.metadata.json.gz" and [list(p) for p in parts] == [["index", "entries", "header"]] * 2
    assert [list(e)[0] for p in parts for e in p["entries"]] == ["ClockSync", "Frame"] and parts[0]["header"]["payload"] == list(range(200, 220))


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(JSON, max_size=4), JSON, st.booleans()), max_size=4), JSON, st.integers(1, 40), st.sampled_from([None, 1]))
def test_entries_are_pulled_from_any_layout(parts, other, size, indent):
    made = [{"index": i + 3, "entries": e, "header": h} if first else {"index": i + 3, "header": h, "more": e, "entries": e} for i, (e, h, first) in enumerate(parts)]
    text = io.StringIO(json.dumps({"other": other, "partitions": made, "last": other}, indent=indent))
    got = [(p, k, json.loads(x)) for p, k, x in documents.entries_of(lambda n: text.read(min(n, size)))]
    want = []
    for i, (entries, header, first) in enumerate(parts):
        own, head = [(i + 3, k, e) for k, e in enumerate(entries)], [(i + 3, None, header)] * (header is not None)
        want += own + head if first else head + own
    assert got == want


def test_broken_documents_are_errors():
    for text in ('{"partitions":[{"index":0,"entries":[{"a":1}', '{"partitions":', "[]", '{"partitions":[{"entries":[1}]}]}'):
        stream = io.StringIO(text)
        with pytest.raises(ValueError):
            list(documents.entries_of(stream.read))


def test_trees_equal_the_nested_form(spark, tmp_path):
    found = nested.entries(tracks.known_rows(standin.clocked(spark, SF)))
    done = {r.name: (r.entries, r.bytes) for r in documents.write_trees(found, str(tmp_path / "out")).collect()}
    trees = nested.tree(found)
    want = {f"{r.file_id}.tree.json.gz": r.tree.encode() for r in trees.collect()}
    assert {p.name: gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").iterdir()} == want
    assert {k: b for k, (_, b) in done.items()} == {k: len(x) for k, x in want.items()} and sum(n for n, _ in done.values()) == found.count()
    flat = nested.parsed_tree(trees).withColumns({"place": F.col("place").cast("long"), "group_place": F.col("group_place").cast("long")})
    assert sorted(map(str, documents.read_trees(spark, [str(tmp_path / "out")]).select(*flat.columns).collect())) == sorted(map(str, flat.collect()))
