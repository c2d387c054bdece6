"""Language model scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens are the lower-cased words of a text and one end. The probability of a token is that of its class, given the two tokens before,
times its share of the class. Classes: the end, the ``SINGLES`` most frequent words, one each, words by their last two bytes, and the
rare words together with all unseen ones. The classes' softmax adds weights of hashed features of what stands before: the token before
(n-gram of two), the one before that (skip), and both (n-gram of three); without weights it is the classes' shares.

Counts: one pass, words to 64-bit hashes, summed in tasks and then by Spark; they grow with the corpus and stay distributed. Training: in each of
``ROUNDS`` rounds all tasks walk through their part of the training texts with gradient updates of their own (AdaGrad over slices of
``SLICE`` tokens), from the weights of the round before; what they arrive at is averaged, each feature weighted by how often a task
met it. Every training text is met in one round. Scoring: one pass with sparse numpy batches, in which the
``HEAD`` most frequent words are looked up in a table; the counts of the others, some hundredths of all tokens, are joined by a shuffle.

Bounds: the weights are ``FEATURES`` x ``CLASSES`` numbers, the table of frequent words ``HEAD`` rows; beyond it more words are joined, and
more of them share the rare class. Words with one hash (a chance of n^2 / 2^65 for n distinct words) count as one. The model is a distribution over
all words of the training texts and one that stands for all others; for that one absolute discounting keeps a share of the rare class.

Defined results: null text counts as empty and is its end alone; a null id is not held out; repeated rows are scored each; without
training texts nothing is known and every score is 0; an empty table gives no rows; texts of any length are scored whole, in slices; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.shingles import U, chunks, mixed, substring_hashes
from tapeline.session import saved

FOLDS, HELD_OUT = 5, 1
CLASSES, SINGLES = 32, 14
END_CLASS, RARE, FIRST_SUFFIX = 0, SINGLES + 1, SINGLES + 2
FEATURES = 1 << 13
ROUNDS, SLICE, RATE = 2, 1 << 14, 1.0
HEAD = 1 << 19
#: Tokens that a task holds before it counts them, and features of a row of weights on their way.
COUNTED, BLOCK = 1 << 20, 1 << 10
END, START = U(0xE7D), U(0x57A27)
_TURNS = [U(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03)]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and last two bytes of each word of all texts in a row, and the words of each text."""
    plain = [b" ".join(t.lower().split()) for t in texts]
    counts = np.array([p.count(b" ") + 1 if p else 0 for p in plain], dtype=np.int64)
    data = np.frombuffer(b" ".join(p for p in plain if p), np.uint8)
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int32), counts
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    last = data[ends - 1].astype(np.int32)
    return substring_hashes(data, starts, ends), np.where(ends - starts > 1, last * 256 + data[ends - 2], last), counts


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts in a row, and the place where each text starts."""
    words, _, counts = _words(texts)
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(words) + len(texts), U)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[ends], out[inner] = END, words
    return out, ends - counts


def features(seen: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The three features of what stands before each token, tokens x 3."""
    one = np.concatenate([[START], seen[:-1]])
    one[starts] = START
    two = np.concatenate([[START], one[:-1]])
    two[starts] = START
    wide = [one * _TURNS[0], two * _TURNS[1], mixed(one * _TURNS[2] + two)]
    return np.stack([mixed(x + t) >> U(64 - FEATURES.bit_length() + 1) for x, t in zip(wide, _TURNS, strict=True)], axis=1).astype(np.int64)


@dataclass
class Vocabulary:
    """The frequent words (sorted hashes), their counts, classes and shares of their classes; totals; the rare class's shares."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    shares: np.ndarray
    total: int
    distinct: int
    least: int
    sizes: np.ndarray
    discount: float
    rare: tuple[int, int]

    @property
    def norm(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def find(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table and whether it is there, for each token."""
        different, back = np.unique(seen, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, different), max(0, len(self.hashes) - 1))
        there = self.hashes[at] == different if len(self.hashes) else np.zeros(len(different), bool)
        return at[back], there[back]

    def class_of(self, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, self.classes[at], RARE) if len(self.classes) else np.full(len(at), RARE)

    def prior(self) -> np.ndarray:
        """Logarithms of the classes' shares; a class without words is left out, but for the rare one, which holds the unseen words."""
        used = (self.sizes > 0) | (np.arange(CLASSES) == RARE)
        return np.where(used, np.log((self.sizes + 0.5) / (self.sizes.sum() + 0.5 * used.sum())), -1e4).astype(np.float32)


def counted(texts: DataFrame) -> DataFrame:
    """word, suffix, c: every token's count over the rows of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, ends = 0, 0

        def pack() -> pa.RecordBatch:
            words, suffix = (np.concatenate(x) for x in zip(*held, strict=True))
            found, first, n = np.unique(words, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(suffix[first]), pa.array(n)], names=["word", "suffix", "c"])

        for batch in batches:
            for _, some in chunks(batch.column(0)):
                words, suffix, _ = _words(some)
                ends += len(some)
                held.append((words, suffix))
                size += len(words)
                if size >= COUNTED:
                    yield pack()
                    held, size = [], 0
        if size:
            yield pack()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([int(END)]), pa.array([-1], pa.int32()), pa.array([ends])], names=["word", "suffix", "c"])

    return texts.select("text").mapInArrow(run, "word long, suffix int, c long").groupBy("word").agg(F.min("suffix").alias("suffix"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The table of frequent words from all counts: those with a count of ``least`` or more, as many as fit. Single occurrences stay rare."""
    level = F.floor(F.log2("c") * 8)
    bins = counts.groupBy(level.alias("bin")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("c").alias("least"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).orderBy(F.desc("bin")).collect()  # eight a doubling
    total, distinct, least, held = sum(b.c for b in bins), sum(b.n for b in bins), 2**62, 0
    for b in bins:
        if held + b.n > HEAD or b.least < 2:
            break
        held, least = held + b.n, b.least
    rows = counts.where((F.col("c") >= least) | (F.col("word") == int(END))).toArrow()  # HEAD rows at most, and the end
    hashes, suffix, c = (rows.column(n).to_numpy() for n in ("word", "suffix", "c"))
    hashes = hashes.view(U)
    order = np.lexsort((hashes, -c))
    classes = FIRST_SUFFIX + (mixed(suffix.astype(U) + U(1)) % U(CLASSES - FIRST_SUFFIX)).astype(np.int64)
    top = [i for i in order if hashes[i] != END][:SINGLES]
    classes[top] = 1 + np.arange(len(top))
    classes[hashes == END] = END_CLASS
    sizes = np.bincount(classes, weights=c, minlength=CLASSES)
    sizes[RARE] = total - c.sum()
    rare = int(total - c.sum()), int(distinct - len(c))
    once, twice = sum(b.once for b in bins), sum(b.twice for b in bins)
    by_hash = np.argsort(hashes)
    shares = np.log10(c / np.maximum(sizes[classes], 1))
    return Vocabulary(hashes[by_hash], c[by_hash], classes[by_hash], shares[by_hash], total, distinct, least, sizes, min(0.9, max(0.1, once / max(1, once + 2 * twice))), rare)


def logits(weights: np.ndarray, prior: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = weights.take(at[:, 0], axis=0)
    out += weights.take(at[:, 1], axis=0)
    out += weights.take(at[:, 2], axis=0)
    out += prior
    return out


def softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities in place of ``z``, and the logarithm of what each row was divided by."""
    top = z.max(axis=1, keepdims=True)
    z -= top
    np.exp(z, out=z)
    total = z @ np.ones((z.shape[1], 1), z.dtype)
    z /= total
    return z, (np.log(total) + top)[:, 0]


class Learner:
    """Weights of one task, its gradient updates, and how often it met each feature."""

    def __init__(self, weights: np.ndarray, prior: np.ndarray) -> None:
        self.weights, self.prior = weights.copy(), prior
        self.squares, self.met = np.zeros(len(weights)), np.zeros(len(weights))

    def update(self, at: np.ndarray, classes: np.ndarray) -> None:
        """One step against the gradient of a slice: expected less met classes, summed by feature."""
        p, _ = softmax(logits(self.weights, self.prior, at))
        p[np.arange(len(p)), classes] -= 1
        n, parts = len(self.weights), np.ascontiguousarray(p.T, np.float64)
        gradient = np.zeros((CLASSES, n))
        for one in np.ascontiguousarray(at.T):
            self.met += np.bincount(one, minlength=n)
            for c, part in enumerate(parts):
                gradient[c] += np.bincount(one, part, n)
        self.squares += np.einsum("ij,ij->j", gradient, gradient)
        gradient *= RATE / np.sqrt(self.squares + 1e-6)
        self.weights -= gradient.T.astype(np.float32)

    def walk(self, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        at, classes = (np.concatenate(x) for x in zip(*held, strict=True))
        for i in range(0, len(at), SLICE):
            self.update(at[i : i + SLICE], classes[i : i + SLICE])


def averaged(texts: DataFrame, words, weights) -> np.ndarray:
    """The weights after one round over ``text``: what all tasks arrive at, averaged by feature. ``words``, ``weights``: broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = words.value
        learner, held = Learner(weights.value, book.prior()), []
        for batch in batches:
            for _, some in chunks(batch.column(0)):
                seen, starts = tokens(some)
                held.append((features(seen, starts), book.class_of(*book.find(seen))))
                if sum(len(x) for x, _ in held) >= 8 * SLICE:
                    learner.walk(held)
                    held = []
        if held:
            learner.walk(held)
        blocks, packed = [], []
        for b in range(0, FEATURES, BLOCK):
            met = np.flatnonzero(learner.met[b : b + BLOCK])
            if len(met):
                blocks.append(b // BLOCK)
                packed.append(met.astype(np.uint16).tobytes() + learner.met[b + met].astype(np.float32).tobytes() + learner.weights[b + met].astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=["block", "packed"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # of all blocks FEATURES x CLASSES numbers at most
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_py()
                n = len(raw) // (6 + 2 * CLASSES)
                met, times = np.frombuffer(raw, np.uint16, n), np.frombuffer(raw, np.float32, n, 2 * n).astype(float)
                held = sums.setdefault(b, np.zeros((BLOCK, CLASSES + 1)))
                held[met, :CLASSES] += times[:, None] * np.frombuffer(raw, np.float16, n * CLASSES, 6 * n).reshape(n, CLASSES)
                held[met, CLASSES] += times
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "packed"])

    out, kind = weights.value.copy(), "block int, packed binary"
    for row in texts.select("text").mapInArrow(run, kind).repartition("block").mapInArrow(merge, kind).collect():  # a matrix of weights
        held = np.frombuffer(row["packed"]).reshape(BLOCK, CLASSES + 1)
        some = np.flatnonzero(held[:, CLASSES])
        out[row["block"] * BLOCK + some] = (held[some, :CLASSES] / held[some, CLASSES:]).astype(np.float32)
    return out


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(float), starts) if len(starts) else np.zeros(0)


def score_batch(texts: list[bytes], book: Vocabulary, weights: np.ndarray) -> list[np.ndarray | list]:
    """For each text: tokens, known ones among the frequent, their base score, the model's score without the rare words' shares, the rare words and how often they occur."""
    seen, starts = tokens(texts)
    at, there = book.find(seen)
    classes, of, prior = book.class_of(at, there), features(seen, starts), book.prior()
    by_class = np.empty(len(seen))
    for i in range(0, len(seen), SLICE):
        z, own = logits(weights, prior, of[i : i + SLICE]), classes[i : i + SLICE]
        met = z[np.arange(len(z)), own]
        by_class[i : i + SLICE] = met - softmax(z)[1]
    base, share = np.zeros(len(seen)), np.zeros(len(seen))
    base[there] = np.log10((book.counts[at[there]] + 0.5) / book.norm)
    share[there] = book.shares[at[there]]
    counts = np.diff(np.concatenate([starts, [len(seen)]]))
    rare_of = np.repeat(np.arange(len(texts)), counts)[~there]
    words = seen[~there]
    order = np.lexsort((words, rare_of))
    rare_of, words = rare_of[order], words[order]
    first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (rare_of[1:] != rare_of[:-1])])) if len(words) else np.zeros(0, np.int64)
    bounds = np.searchsorted(rare_of[first], np.arange(len(texts) + 1))
    times = np.diff(np.concatenate([first, [len(words)]]))
    return [counts, _sums(there, starts).astype(np.int64), _sums(base, starts), _sums(by_class / np.log(10) + share, starts), words[first].view(np.int64), times, bounds]


PARTIAL = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<long>, times array<long>"


def partial_scores(rows: DataFrame, words, weights) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in chunks(batch.column("text")):
                n, known, base, score, rare, times, bounds = score_batch(some, words.value, weights.value)
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x)) for x in (rare, times)]
                ids, held = (batch.column(c).slice(at, len(some)) for c in ("doc_id", "held_out"))
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(n), pa.array(known), pa.array(base), pa.array(score), *lists], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"])

    return rows.mapInArrow(run, PARTIAL)


def train(rows: DataFrame) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """Counts, vocabulary and weights of the rows (doc_id, text)."""
    counts = saved(counted(rows))
    book = vocabulary(counts)
    context = rows.sparkSession.sparkContext
    words, weights = context.broadcast(book), np.zeros((FEATURES, CLASSES), np.float32)
    for i in range(ROUNDS if book.total else 0):
        held = context.broadcast(weights)
        weights = averaged(rows.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(ROUNDS)) == i), words, held)
        held.destroy()
    return counts, book, weights


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learned from the rows that are not held out."""
    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts, book, weights = train(rows.where("not held_out"))
    context = docs.sparkSession.sparkContext
    part = saved(partial_scores(rows, context.broadcast(book), context.broadcast(weights))).withColumn("row", F.monotonically_increasing_id())  # of files, so that it stays
    mass, types = book.rare
    asked = part.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    met = asked.join(counts.where((F.col("c") < F.lit(book.least)) & (F.col("word") != int(END))).select("word", "c"), "word", "left")
    count = F.coalesce("c", F.lit(0).cast("long"))
    base = F.log10((count + 0.5) / F.lit(book.norm))
    left_over = book.discount * types / mass if mass else 1.0
    share = F.log10(F.when(count > 0, (count - book.discount) / float(mass or 1)).otherwise(left_over))
    sums = met.groupBy("row").agg(F.sum(F.when(count > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(base * F.col("k")).alias("rare_base"), F.sum(share * F.col("k")).alias("rare_score"))
    or_none = lambda c: F.coalesce(c, F.lit(0))
    known = or_none("more") if book.total else F.lit(0)
    score = F.col("score") + or_none("rare_score") if book.total else F.lit(0.0)
    return part.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).cast("long").alias("n_known"), F.lit(book.total).cast("long").alias("train_tokens"), (F.col("base") + or_none("rare_base")).alias("base_score"), score.alias("score")
    )
