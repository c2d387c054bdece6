"""Toxicity by a fuzzy lexicon and context windows.

Terms are learned from labelled rows: words, or beginnings of words, that toxic rows hold more often than chance allows and hardly any clean
row does. They form a trie; its intersection with Levenshtein automata (one edit for terms of ``FUZZY_FROM`` characters or more, two from
``FUZZY2_FROM``) is built as a deterministic automaton, state by state as words need it. A word (letters and digits, so
that a digit in the place of a letter is an edit; also with symbols inside, which are edits too) is a hit when the automaton accepts one of its
beginnings. Letters may be replaced, added and left out anywhere, at the first place too. Terms of less than ``FUZZY_FROM`` characters take
one edit when it gives the whole word, as their beginnings are too short to be told from others.

Edits make other words of terms ("whole" of "whore"). A beginning that the automaton accepts by edits only is therefore no hit where the clean
sample's words begin alike (``known``), unless toxic rows hold it as a term would be held; a longer beginning of the same word may still be one.
What the sample has not seen is told from what it has seen once (Good and Turing): terms take as many edits as keep the clean rows that new
beginnings would hit below ``UNSEEN`` of all, those with the fewest such beginnings first. A misspelling weighs what its term weighs unless the
labels tell otherwise.
Near copies teach once: of the sample's rows that agree in a band of shingle hashes one is kept.

A hit's context is the window of ``WINDOW`` characters on both sides: with quotation marks open before it and closed
behind it, it counts as quoted, else as abuse. A logistic model over the numbers of plain, misspelled and quoted hits gives the score. Where the
labels hold no quoted hits the weight of quotation stays 0: a quoted hit then adds nothing to a score, an unquoted one
does.

Bounds: the lexicon and the model are learned from at most ``TRAIN_PER_LABEL`` rows of each label (in the order of a hash of the id);
what the driver gathers is bounded by that sample. Everything else, scoring above all, is one scan over all rows and whole texts, with no shuffle.

Defined results: null text counts as empty, here and in ``keep_clean``; a null id is not held out; labels that are null are left out; with no usable
labels all scores are 0; an empty table gives no rows; repeated rows are scored each; other columns are ignored
(``keep_clean`` passes them).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.tasks import lean
from tapeline.session import saved

TRAIN_PER_LABEL = 4000
FOLDS = 5
#: Share of clean rows that unseen misreadings may hit, and the ridge between the weights of plain and misspelled hits.
UNSEEN, PULL = 0.002, 0.5
#: Bands of two least shingle hashes by which near copies in the sample are found.
BANDS = 8
#: Letters of the shortest term; beginnings of words are terms up to so many letters, whole words of any length.
SHORTEST, HEAD = 4, 24
FUZZY_FROM, FUZZY2_FROM = 5, 9
WINDOW = 60
#: A task forgets the hits of words when it remembers more of them than this; one document's words come on top.
MEMO = 150_000

WORD = re.compile(r"[^\W_]+")
PLAIN_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words with symbols between letters, as they are put in a letter's place.
SYMBOLS = "*@$!|+#"
MASKED = re.compile(rf"[^\W_]+(?:[{SYMBOLS}][^\W_]+)+")
OPEN_QUOTE, CLOSE_QUOTE = re.compile("[\"“«„‹]"), re.compile("[\"”»“›]")


def most_edits(term: str) -> int:
    return 1 + (len(term) >= FUZZY2_FROM)


class FuzzyTrie:
    """Trie of terms intersected with Levenshtein automata, determinised on demand.

    A state is a set of (trie node, edits so far), and its value is the fewest edits with which a term has been accepted.
    """

    def __init__(self, terms: list[str], known: frozenset[str] = frozenset(), levels: dict[str, int] | None = None) -> None:
        self.known = known
        self.term_at: dict[int, str] = {}
        self.next: list[dict[str, int]] = [{}]
        self.allows = [0]  # the most edits of any term below a node
        self.ends: list[int] = [-1]  # edits allowed for the term that ends here, -1: none does
        self.wholes: list[int] = [-1]  # the same where the word ends as well
        for term in terms:
            level = most_edits(term) if levels is None else levels[term]
            prefix = min(level, (len(term) >= FUZZY_FROM) + (len(term) >= FUZZY2_FROM))
            edits = level
            node = 0
            self.allows[0] = max(self.allows[0], edits)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.allows.append(0)
                    self.ends.append(-1)
                    self.wholes.append(-1)
                node = self.next[node][c]
                self.allows[node] = max(self.allows[node], edits)
            self.ends[node], self.wholes[node] = prefix, edits
            self.term_at[node] = term
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.best: list[int] = []
        self.last: list[int] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, members: set[tuple[int, int]]) -> int:
        least: dict[int, int] = {}
        todo = list(members)
        while todo:  # skipping a letter of a term costs an edit
            node, e = todo.pop()
            if e > self.allows[node] or least.get(node, 9) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.next[node].values()]
        key = tuple(sorted(least.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.best.append(min((e for node, e in key if e <= self.ends[node]), default=9))
            self.last.append(min((e for node, e in key if e <= self.wholes[node]), default=9))
            self.moves.append({})
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        members: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            for letter, child in self.next[node].items():
                members.add((child, e if letter == c else e + 1))
            members.add((node, e + 1))
        found = self.moves[state][c] = self._state(members)
        return found

    def accepted(self, word: str) -> Iterator[tuple[str, int]]:
        """Accepted beginnings of the word with the fewest edits of each; one that is accepted as a whole word only ends in "$"."""
        state = self.start
        for n, c in enumerate(word, 1):
            nxt = self.moves[state].get(c)
            state = self._move(state, c) if nxt is None else nxt
            if not self.sets[state]:
                return
            if self.best[state] != 9:
                yield word[:n], self.best[state]
        if self.last[state] < self.best[state]:
            yield word + "$", self.last[state]

    def terms_near(self, beginning: str) -> Iterator[tuple[str, int]]:
        """Terms that an accepted beginning comes from, with the edits of each."""
        state = self.start
        for c in beginning.removesuffix("$"):
            state = self._move(state, c)
        limits = self.wholes if beginning.endswith("$") else self.ends
        yield from ((self.term_at[node], e) for node, e in self.sets[state] if e <= limits[node])

    def hit(self, word: str) -> int:
        """Fewest edits between a beginning of the word (or the whole of it) and a term within its allowance, 9 if there is none."""
        best = 9
        for beginning, e in self.accepted(word):
            if e < best and beginning not in self.known:
                best = e
                if not best:
                    break
        return best


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    #: Of 1, log(1 + plain), log(1 + misspelled), log(1 + quoted).
    weights: tuple[float, ...]
    #: Beginnings of words that are no misspellings though a term is near.
    known: frozenset[str] = frozenset()
    #: Edits that each term takes, None: as many as its length allows.
    levels: dict[str, int] | None = None

    def trie(self) -> FuzzyTrie:
        return FuzzyTrie(list(self.terms), self.known, self.levels)

    def score(self, plain: int, fuzzy: int, quoted: int) -> float:
        z = sum(w * x for w, x in zip(self.weights, (1.0, math.log1p(plain), math.log1p(fuzzy), math.log1p(quoted)), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def rejects(self, text: str, trie: FuzzyTrie, memo: dict[str, int]) -> bool:
        return self.score(*features(text, trie, memo)) >= 0.5


def features(text: str, trie: FuzzyTrie, memo: dict[str, int]) -> tuple[int, int, int]:
    """Numbers of plain, misspelled and quoted hits."""
    low = text.lower()
    if len(memo) >= MEMO:
        memo.clear()

    def edits(w: str) -> int:
        found = memo.get(w)
        if found is None:
            found = memo[w] = trie.hit(w)
        return found

    masked = [m for m in MASKED.finditer(low) if edits(m[0]) != 9] if any(c in low for c in SYMBOLS) else []
    if not masked and all(edits(w) == 9 for w in set(WORD.findall(low))):
        return 0, 0, 0
    plain = fuzzy = quoted = 0
    inside = {at for m in masked for at in range(m.start(), m.end())}
    for m in (*masked, *(m for m in WORD.finditer(low) if m.start() not in inside)):
        e = edits(m[0])
        if e == 9:
            continue
        if OPEN_QUOTE.search(low, max(0, m.start() - WINDOW), m.start()) and CLOSE_QUOTE.search(low, m.end(), m.end() + WINDOW):
            quoted += 1
        elif e:
            fuzzy += 1
        else:
            plain += 1
    return plain, fuzzy, quoted


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the bounded sample; the sample of ids is small enough to broadcast by its bound."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(fold() != 0)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = usable.where("toxic = 1").orderBy(*order).limit(TRAIN_PER_LABEL).unionByName(usable.where("toxic = 0").orderBy(*order).limit(TRAIN_PER_LABEL))
    ids = docs.sparkSession.createDataFrame(sample.collect(), sample.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")


def one_of_copies(rows: DataFrame) -> DataFrame:
    """The sample's rows but those that have a label and a band of least shingle hashes in common with one kept before; the driver sees the sample's bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        odd, plus = (rng.integers(0, 1 << 63, 2 * BANDS, dtype=np.uint64) for _ in range(2))
        odd |= np.uint64(1)
        for batch in batches:
            bands = np.empty((batch.num_rows, BANDS), dtype=np.int64)
            for at, text in enumerate(batch.column("text").to_pylist()):
                words = PLAIN_WORD.findall(text.lower())
                prints = np.array([zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(max(1, len(words) - 4))], dtype=np.uint64)
                least = np.array([((prints * a + b) ^ ((prints * a + b) >> np.uint64(29))).min() for a, b in zip(odd, plus, strict=True)])
                bands[at] = (least[::2] * np.uint64(0x9E3779B97F4A7C15) + least[1::2]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("toxic"), *map(pa.array, bands.T)], names=["row", "toxic", *(f"band{b}" for b in range(BANDS))])

    rows = rows.withColumn("row", F.xxhash64("doc_id", "text")).dropDuplicates(["row"])
    found = rows.select("row", "toxic", "text").mapInArrow(lean(run), "row long, toxic int, " + ", ".join(f"band{b} long" for b in range(BANDS))).collect()
    seen: set[tuple[int, int, int]] = set()
    kept = []
    for row, toxic, *bands in sorted(map(tuple, found)):
        keys = [(toxic, b, x) for b, x in enumerate(bands)]
        if seen.isdisjoint(keys):
            seen.update(keys)
            kept.append((row,))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(kept, "row long")), "row").select("doc_id", "text", "toxic")


def told(t: Column, c: Column, n_toxic: int, n_clean: int, tried: int) -> Column:
    """True where t toxic and c clean rows are at least 50 times the clean rate and no chance: a large-deviation bound (t + c) * KL below 1 in 100 for all words tried."""
    q, n = n_toxic / (n_toxic + n_clean), t + c
    part = lambda x, share: F.when(x > 0, x * F.ln(x / n / share)).otherwise(0.0)
    return (t >= 3) & (c * 50 * n_toxic <= t * n_clean) & (part(t, q) + part(c, 1 - q) >= math.log(100 * max(1, tried)))


def learn_terms(rows: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """Words and beginnings of words that the toxic sample's rows hold beyond chance (``told``)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0)))
    heads = F.transform(words, lambda w: F.array_append(F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length(w), F.lit(HEAD))), lambda n: F.substring(w, F.lit(1), n)), w))
    counts = rows.select("toxic", F.explode(F.array_distinct(F.flatten(heads))).alias("head")).groupBy("head").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = saved(counts.where("t >= 3"))
    kept = counts.where(told(F.col("t"), F.col("c"), n_toxic, n_clean, counts.count()))
    support = {x["head"]: x["t"] for x in kept.collect()}  # of the sample's words
    terms: set[str] = set()
    for head in sorted(support, key=len):
        if any(head[:n] in support for n in range(SHORTEST, len(head))):
            continue  # a shorter beginning does as well
        while longer := [h for h in support if len(h) == len(head) + 1 and h.startswith(head) and support[h] >= 0.95 * support[head]]:
            head = longer[0]
        terms.add(head)
    return sorted(terms)


def half_of() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int")


def near_words(rows: DataFrame, terms: list[str]) -> list[tuple[str, int, int, int]]:
    """(beginning, half, toxic rows, clean rows) of the beginnings of the sample's words that are accepted by edits only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = FuzzyTrie(terms), {}
        for batch in batches:
            for half, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("half", "toxic", "text")), strict=True):
                low, near = text.lower(), set()
                if len(memo) >= MEMO:
                    memo.clear()
                for w in {*WORD.findall(low), *MASKED.findall(low)}:
                    if (met := memo.get(w)) is None:
                        all_met = dict(trie.accepted(w))
                        met = memo[w] = () if 0 in all_met.values() else tuple(all_met)
                    near.update(met)
                yield pa.RecordBatch.from_arrays([pa.array(sorted(near), pa.string()), pa.array([half] * len(near), pa.int32()), pa.array([toxic] * len(near), pa.int32())], names=["beginning", "half", "toxic"])

    near = rows.select("text", "toxic", half_of().alias("half")).mapInArrow(lean(run), "beginning string, half int, toxic int")
    return [tuple(x) for x in near.groupBy("beginning", "half").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("c > 0 or t > 0").collect()]


def lexicon(terms: list[str], near: list[tuple[str, int, int, int]], n_toxic: float, n_clean: float) -> Model:
    """The terms with the edits they take and the beginnings that are none of theirs, from the sample or a half of it; no weights yet."""
    sums: dict[str, list[int]] = {}
    for beginning, _, t, c in near:
        held = sums.setdefault(beginning, [0, 0])
        held[0] += t
        held[1] += c
    own = {w: c for w, (t, c) in sums.items() if c and c * 50 * n_toxic > t * n_clean}
    trie, once = FuzzyTrie(terms), {(t, e): 0 for t in terms for e in range(1, most_edits(t) + 1)}
    for w, c in own.items():
        for at in trie.terms_near(w):
            if c == 1 and at in once:
                once[at] += 1
    levels, left = dict.fromkeys(terms, 0), UNSEEN * n_clean
    for (term, e), n in sorted(once.items(), key=lambda x: (x[1], x[0][1], x[0][0])):
        if n <= left and levels[term] == e - 1:
            levels[term], left = e, left - n
    return Model(tuple(terms), (), frozenset(own), levels)


def fit(cells: list[tuple[int, int, int, int, int]]) -> tuple[float, ...]:
    """Logistic regression (Newton's method) on (plain, fuzzy, quoted, toxic, count), as many rows as the sample has differing ones at most.

    The ridge of 0.01 draws all weights to 0, that of misspelled hits to the weight of plain ones (by ``PULL``).
    """
    data = np.array(cells, dtype=float)
    x = np.hstack([np.ones((len(data), 1)), np.log1p(data[:, :3])])
    y, n, w = data[:, 3], data[:, 4], np.zeros(4)
    ridge = 0.01 * np.eye(4)
    ridge[1:3, 1:3] += PULL * np.array([[1, -1], [-1, 1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (n * (y - p)) - ridge @ w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def counted(rows: DataFrame, model: Model, passed: str = "toxic int") -> DataFrame:
    """Features of each row of (doc_id, text, *passed); ``passed`` names one more column."""
    name = passed.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = model.trie(), {}
        for batch in batches:
            got = [features(t.as_py(), trie, memo) for t in batch.column("text")]
            counts = [pa.array([g[i] for g in got], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(name), *counts], names=["doc_id", name, "plain", "fuzzy", "quoted"])

    return rows.select("doc_id", "text", name).mapInArrow(lean(run), f"doc_id long, {passed}, plain int, fuzzy int, quoted int")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows = saved(one_of_copies(saved(training_rows(docs, labels))))
    sizes = {x["toxic"]: x["n"] for x in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model((), (-50.0, 0.0, 0.0, 0.0))
    terms = learn_terms(rows, sizes[1], sizes[0])
    near, cells = near_words(rows, terms), []
    for own in (0, 1):  # what one half knows is tried on the other, as known beginnings are no misspellings in their own rows
        part = lexicon(terms, [x for x in near if x[1] == own], sizes[1] / 2, sizes[0] / 2)
        cells += counted(rows.where(half_of() != own), part).groupBy("plain", "fuzzy", "quoted", "toxic").agg(F.count("*").alias("n")).collect()
    return replace(lexicon(terms, near, sizes[1], sizes[0]), weights=fit([tuple(c) for c in cells]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and the numbers of plain, misspelled and quoted hits of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"))
    hits = counted(rows, model, "held_out boolean")
    z = sum((F.lit(w) * F.log1p(F.col(c)) for w, c in zip(model.weights[1:], ("plain", "fuzzy", "quoted"), strict=True)), F.lit(model.weights[0]))
    value = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
    value = F.lit(0.0) if not model.terms and model.weights[0] <= -40 else value
    return hits.withColumn("score", value).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "plain", "fuzzy", "quoted")


def score_table(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, in one scan."""
    passed = docs.columns
    at = passed.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = model.trie(), {}
        for batch in batches:
            clean = [not model.rejects(t.as_py() or "", trie, memo) for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
