"""Audit of five filters in all orders: what each removes, after which others, and what that costs.

A finite-state transducer driven by tables makes one pass over the UTF-8 bytes of many texts at once. Every class of bytes leads
to one state (in a word or between words), whatever the state before, so the states of all bytes are a table look-up,
and the emissions another, by state and class: code point, capital, symbol, a word's begin and end. The words' spans go into a
hash table with linear probing, all at once; a span is the same word as a slot's holder only if their bytes agree, so
a collision of hashes costs a probe and never a wrong count.

The filters (letters as in the orders): A under 200 words; B less than half of the words distinct; C more than 3 % capitals; D a
symbol of ``SYMBOLS``; E the text of a smaller id. Identical texts are told by 128-bit digests, and the rows of a group of
copies are counted by aggregates alone: how many have the group's least id, how many there are. What 120 orders do
follows from counts by part and set of failed filters, at most 128 rows a part.

Defined results: null text counts as empty, null ``part`` as the empty string; rows with null id fail E never and cause no other to fail it; repeated rows with
the least id of a text all pass E; a document is good or toxic if any of its labels says so, null labels and ids say nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.shingles import U, chunks, mixed, substring_hashes
from tapeline.session import saved

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"

#: Between texts: a byte that UTF-8 never has.
BETWEEN = 0xFF
SPACE, CAPITAL, SYMBOL, LETTER, INNER, BREAK = range(6)
BEGINS, ENDS, IS_CAPITAL, IS_SYMBOL, CODE_POINT = 1, 2, 4, 8, 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte; emissions by (class before, class)."""
    kind = np.full(256, LETTER, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[ord("A") : ord("Z") + 1] = CAPITAL
    kind[list(SYMBOLS)] = SYMBOL
    kind[0x80:0xC0] = INNER  # the second and later bytes of a code point
    kind[BETWEEN] = BREAK
    in_word = np.isin(np.arange(8), [CAPITAL, SYMBOL, LETTER, INNER])
    emits = np.zeros((8, 8), np.uint8)
    for now in range(6):
        own = {CAPITAL: IS_CAPITAL, SYMBOL: IS_SYMBOL}.get(now, 0) | (0 if now in (INNER, BREAK) else CODE_POINT)
        for before in range(6):
            emits[before, now] = own | (BEGINS if in_word[now] and not in_word[before] else 0) | (ENDS if in_word[before] and not in_word[now] else 0)
    return kind, emits.reshape(-1)


KIND, EMITS = _tables()


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether data[a:a+length] equals data[b:b+length], for each; no length is 0."""
    if not len(a):
        return np.zeros(0, bool)
    at = np.cumsum(lengths) - lengths
    step = np.arange(at[-1] + lengths[-1]) - np.repeat(at, lengths)
    return np.logical_and.reduceat(data[np.repeat(a, lengths) + step] == data[np.repeat(b, lengths) + step], at)


def distinct_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, owner: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Which spans are the first in the table for their owner and bytes. ``hashes``: as computed from the bytes, unless given."""
    hashes = substring_hashes(data, begins, ends) if hashes is None else hashes
    hashes = mixed(hashes + owner.astype(U) * U(0x9E3779B97F4A7C15))
    size = 1 << max(4, (2 * len(begins)).bit_length())
    slots, slot = np.full(size, -1, np.int64), (hashes & U(size - 1)).astype(np.int64)
    lengths, new = ends - begins, np.zeros(len(begins), bool)
    todo = np.arange(len(begins))
    while len(todo):
        place = slot[todo]
        free = slots[place] < 0
        slots[place[free]] = todo[free]  # of several one stays
        holder = slots[place]
        found = holder == todo
        new[todo[found]] = True
        maybe = np.flatnonzero(~found & (hashes[holder] == hashes[todo]) & (owner[holder] == owner[todo]) & (lengths[holder] == lengths[todo]))
        found[maybe] = same_bytes(data, begins[holder[maybe]], begins[todo[maybe]], lengths[todo[maybe]])
        todo = todo[~found]
        slot[todo] = (slot[todo] + 1) & (size - 1)
    return new


def measures(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Words, distinct words, code points, capitals and symbols of each text."""
    data = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
    stops = np.cumsum([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], stops[:-1]])
    kind = KIND[data]
    before = np.empty_like(kind)
    before[0], before[1:] = BREAK, kind[:-1]
    out = EMITS[before * np.uint8(8) + kind]
    count = lambda flag: np.diff(np.searchsorted(np.flatnonzero(out & flag), np.concatenate([starts, stops[-1:]])))
    begins, ends = np.flatnonzero(out & BEGINS), np.flatnonzero(out & ENDS)
    words = np.diff(np.searchsorted(begins, np.concatenate([starts, stops[-1:]])))
    owner = np.repeat(np.arange(len(texts)), words)
    new = distinct_spans(data, begins, ends, owner)
    points = np.add.reduceat(out >> 4, starts, dtype=np.int64)  # the highest bit is the code point's
    return words, np.bincount(owner[new], minlength=len(texts)), points, count(IS_CAPITAL), count(IS_SYMBOL)


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, key (digest of the text) and ``fails`` (bits of A to D) of each row, in one pass."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails, keys = np.zeros(batch.num_rows, np.int32), []
            for at, texts in chunks(batch.column("text")):
                words, distinct, points, capitals, symbols = measures(texts)
                found = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, symbols > 0)
                fails[at : at + len(texts)] = sum(f.astype(np.int32) << i for i, f in enumerate(found))
                keys += [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(keys, pa.binary()), pa.array(fails)], names=["doc_id", "part", "key", "fails"])

    return rows.mapInArrow(run, "doc_id long, part string, key binary, fails int")


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), n, good, bad: documents by part and the filters that they fail."""
    # kept, so that the join's shuffles are of both sides and Spark may split a hot id
    marks = saved(labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")))
    rows = profiles(docs).groupBy("key", "doc_id", "part", "fails").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    rows = saved(rows.select("key", "doc_id", "part", "fails", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "bad"))))
    kind = ["part", "fails", "good", "bad"]
    # a group of copies: its rows by kind with their least id, then those that have the least of all
    least = rows.where("doc_id is not null").groupBy("key", *kind).agg(F.min(F.struct("doc_id", "n")).alias("m"))
    same_id = F.col("m.doc_id") == F.min("m.doc_id").over(Window.partitionBy("key"))
    first = least.withColumn("first", same_id).where("first").select(*kind, F.col("m.n").alias("n"))
    passing = first.unionByName(rows.where("doc_id is null").select(*kind, "n")).groupBy(*kind).agg(F.sum("n").alias("n"))
    failing = rows.select(*kind, "n").unionByName(passing.withColumn("n", -F.col("n"))).withColumn("fails", F.col("fails").bitwiseOR(16))
    both = passing.unionByName(failing)
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return both.groupBy("part", "fails").agg(F.sum("n").alias("n"), of("good"), of("bad"))


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before)."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(p), i + 1, bit[p[i]], sum(bit[f] for f in p[:i])) for p in permutations(FILTERS) for i in range(len(FILTERS))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step of the filters, zeros included."""
    spark = docs.sparkSession
    n = len(FILTERS)
    places = [(1 << i, sum(1 << j for j in s)) for i in range(n) for k in range(n) for s in combinations([j for j in range(n) if j != i], k)]
    place = F.explode(F.array(*(F.struct(F.lit(f).alias("own"), F.lit(s).alias("earlier")) for f, s in places))).alias("at")
    rows = failure_counts(docs, labels).select("*", place).select("part", "fails", "n", "good", "bad", "at.*")
    has = lambda bits: F.col("fails").bitwiseAND(F.col(bits)) != 0
    total = lambda condition, c="n": F.sum(F.when(condition, F.col(c)).otherwise(F.lit(0).cast("long")))
    gone = has("own") & ~has("earlier")
    sums = rows.groupBy("part", "own", "earlier").agg(
        total(~has("own") & ~has("earlier")).alias("kept"), total(gone).alias("removed"), total(has("own") & has("earlier")).alias("redundant"),
        total(F.col("fails") == F.col("own")).alias("unique_fails"), total(gone, "good").alias("good_lost"), total(gone, "bad").alias("toxic_lost"),
    )
    steps = spark.createDataFrame(_steps(), "filter_order string, step int, own int, earlier int")  # 600 rows, fixed
    out = sums.join(F.broadcast(steps), ["own", "earlier"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "own")).alias("shapley"))
