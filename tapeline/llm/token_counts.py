"""Token counts that are kept up to date under edits.

A document is cut into segments at places where a pre-token surely begins (a single space between two letters), at least
``SEGMENT`` characters apart. A segment tree over them holds sums of characters and tokens. An edit re-encodes the
segments it touches, and neighbours as long as the cut between them is no longer sure in the new text (the boundary
context); then only the sums on the paths to the root change.

The tree is kept with its document: ``build`` adds it as a column (``tree``, the leaves' characters and tokens, some 3 % of
the text), which is written with the table; ``apply_edits`` takes such a table, in this run or a later one, encodes only
what the edits touch, and gives the new texts with their trees.

All work is within a row: scans without a shuffle. Defined results: null text counts as empty (0 tokens); edits that
reach past the end are clipped; null edit lists change nothing; a null tree is built; a tree whose characters are not
those of its text raises; rows with null or repeated ids are counted each; an empty table gives no rows; other columns
pass unchanged (``build``, ``apply_edits``) or are ignored. The tokenizer's file must be readable on every executor.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed value: the pre-token pattern of the byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEGMENT = 256
SURE_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str) -> list[int]:
    """Starts of the segments; 0 first."""
    out, at = [0], SEGMENT
    while m := SURE_CUT.search(text, at):
        out.append(m.start())
        at = m.start() + SEGMENT
    return out


class TokenTree:
    """Segment tree over one text; node 1 is the root, leaves start at ``self.width``."""

    def __init__(self, text: str, encode, leaves: tuple[list[int], list[int]] | None = None) -> None:
        """``leaves``: characters and tokens of the segments, as kept from before."""
        self.text, self.encode, self.encoded = text, encode, 0
        if leaves is None:
            starts = cuts(text)
            pieces = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
            leaves = [len(p) for p in pieces], [self._count(p) for p in pieces]
        elif sum(leaves[0]) != len(text):
            raise ValueError("the tree is not that of the text")
        self.n = len(leaves[0])
        self.width = 1 << max(0, self.n - 1).bit_length()
        self.chars, self.tokens = ([0] * self.width + x + [0] * (self.width - self.n) for x in map(list, leaves))
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _count(self, piece: str) -> int:
        self.encoded += 1
        return len(self.encode(piece)) if piece else 0

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaves(self) -> tuple[list[int], list[int]]:
        """What is kept: characters and tokens of the segments that are not empty; a segment that an edit has made large is cut again."""
        chars, tokens, at = [], [], 0
        for n, count in zip(self.chars[self.width :], self.tokens[self.width :], strict=True):
            if n > 4 * SEGMENT and len(starts := cuts(self.text[at : at + n])) > 1:
                pieces = [self.text[at + a : at + b] for a, b in zip(starts, [*starts[1:], n], strict=True)]
                chars += map(len, pieces)
                tokens += map(self._count, pieces)
            elif n:
                chars.append(n)
                tokens.append(count)
            at += n
        return (chars, tokens) if chars else ([0], [0])

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one with characters, if past the end) and its start."""
        node, start = 1, 0
        at = min(at, max(0, self.chars[1] - 1))
        while node < self.width:
            left = self.chars[2 * node]
            node, start, at = (2 * node, start, at) if at < left else (2 * node + 1, start + left, at - left)
        return node - self.width, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.width + leaf
        self.chars[node], self.tokens[node] = chars, tokens
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def edit(self, start: int, end: int, put: str) -> None:
        """Replaces text[start:end] by ``put``."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        first, begin = self._leaf_at(start)
        last, last_begin = self._leaf_at(max(start, end - 1))
        stop = last_begin + self.chars[self.width + last]
        new = self.text[:start] + put + self.text[end:]
        moved = len(new) - len(self.text)
        while begin > 0 and not SURE_CUT.match(new, begin):
            first -= 1
            begin -= self.chars[self.width + first]
        while stop < len(self.text) and not SURE_CUT.match(new, stop + moved):
            last += 1
            stop += self.chars[self.width + last]
        self._set(first, stop + moved - begin, self._count(new[begin : stop + moved]))
        for leaf in range(first + 1, last + 1):
            self._set(leaf, 0, 0)
        self.text = new


TREE = "struct<chars:array<int>,tokens:array<int>>"
_TREE = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
EDITS = "array<struct<start:bigint,end:bigint,put:string>>"


def _kept(trees: list[TokenTree]) -> pa.Array:
    leaves = [t.leaves() for t in trees]
    return pa.array([{"chars": c, "tokens": n} for c, n in leaves], _TREE)


def build(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``tree``, to be kept with the table, and ``n_tokens``; columns of these names are replaced."""
    rows = docs.drop("tree", "n_tokens")
    schema = StructType([*rows.schema, *StructType.fromDDL(f"tree {TREE}, n_tokens long")])
    place = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            trees = [TokenTree(t.as_py() or "", encode) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _kept(trees), pa.array([t.total for t in trees], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def apply_edits(kept: DataFrame, edits_col: str = "edits", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``kept`` (from ``build``, or from here) after its edits: new text, tree and n_tokens, and n_reencoded, the segments encoded for the edits.

    ``edits_col``: array<struct<start, end, put>>, applied in order, each in characters of the text as it is by then; the
    column is dropped, as its edits are done.
    """
    rows = kept.drop("n_tokens", "n_reencoded")
    columns = [c for c in rows.columns if c not in (text_col, "tree", edits_col)]
    rows = rows.select(*columns, text_col, F.col("tree").cast(TREE).alias("tree"), F.col(edits_col).cast(EDITS).alias("_edits"))
    schema = StructType([*rows.schema[:-1], *StructType.fromDDL("n_tokens long, n_reencoded long")])
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            trees, encoded = [], []
            for text, tree, todo in zip(*(batch.column(i).to_pylist() for i in (n, n + 1, n + 2)), strict=True):
                kept = TokenTree(text or "", encode, (tree["chars"], tree["tokens"]) if tree else None)
                for x in todo or ():
                    kept.edit(x["start"] or 0, x["end"] or 0, x["put"] or "")
                trees.append(kept)
                encoded.append(kept.encoded)
            columns = [*batch.columns[:n], pa.array([t.text for t in trees], pa.string()), _kept(trees), pa.array([t.total for t in trees], pa.int64()), pa.array(encoded, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def count_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_segments, n_tokens, n_tokens_after, n_reencoded (segments encoded for the edits) of every row: the trees are built, then the edits are applied to what was kept."""
    edits = F.col(edits_col) if edits_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), edits.cast(EDITS).alias("edits"))
    built = build(rows, vocabulary=vocabulary).withColumn("before", F.col("n_tokens")).withColumn("n_segments", F.size("tree.chars").cast("long"))
    return apply_edits(built, vocabulary=vocabulary).select("doc_id", "n_segments", F.col("before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), "n_reencoded")
