"""Temperature mixing of sources to target weights, in DataFrame functions only.

A source with token share p gets weight p^a / sum(p^a). The exponent a (0: uniform, 1: natural) is bisected so that the
entropy of the weights reaches ``entropy_ratio`` of its maximum, and so that no source is repeated more often than
``max_repetition``; the larger of the two exponents holds. The weights are realised as budgeted block permutations: a
source with a budget of k whole passes and a rest gets k blocks, each a permutation of its documents, and the head of
one more permutation up to the rest.

The head ends at one cut key for each source. It is found from totals of ``BUCKETS`` key ranges and then from the one
range that holds the cut, so a source with a third of all rows is never gathered in one task, and texts are not shuffled.

The sources' table is one array that one expression bisects and all tasks get, up to ``MAX_SOURCES`` sources; with more it
stays distributed, and each of ``ROUNDS`` aggregations narrows the exponent ``SECTIONS`` times.

Defined results: a null source counts as source ''; null or empty texts have 0 tokens; a source all of whose texts have none
has no share, so its rows are not taken; rows with equal id and text share
a key and are kept or left together; an empty table gives no rows; other columns pass unchanged (``mix``, which adds and
uses names that begin with ``mix_``) or are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.session import saved

WORD = r"[^\x20\x09-\x0D]+"
STEPS = 60
#: Sources whose table is broadcast; the exponent for more is searched in so many rounds of so many sections, 60 bits as well.
MAX_SOURCES = 50_000
ROUNDS, SECTIONS = 10, 64


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _key(id_col: str, text_col: str) -> Column:
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text).cast("binary"))


def _bisect(shares: Column, too_low: callable) -> Column:
    """The exponent in [0, 1] at which ``too_low(shares, exponent)`` turns from true to false, from above."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(at: Column, _: Column) -> Column:
        mid = (at["lo"] + at["hi"]) / 2
        go_up = too_low(shares, mid)
        return F.struct(F.when(go_up, mid).otherwise(at["lo"]).alias("lo"), F.when(go_up, at["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda at: at["hi"])


def _weights(shares: Column, exponent: Column) -> Column:
    powers = F.transform(shares, lambda p: F.pow(p, exponent))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def _entropy(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a - F.when(w > 0, w * F.ln(w)).otherwise(F.lit(0.0)))


def source_plan(sizes: DataFrame, entropy_ratio: float | None, max_repetition: float | None, budget: int | None) -> DataFrame:
    """From one row per source (source, tokens): weight, whole passes and the rest of the budget in tokens."""
    listed = sizes.where("tokens > 0").agg(F.array_sort(F.collect_list(F.struct("source", "tokens"))).alias("all"))
    listed = listed.withColumn("n", F.size("all"))
    listed = listed.withColumn("total", F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    listed = listed.where("n > 0").withColumn("shares", F.transform("all", lambda x: x["tokens"] / F.col("total")))
    listed = listed.withColumn("budget", F.lit(budget).cast("long") if budget else F.col("total"))
    exponents = [F.lit(0.0)]
    if entropy_ratio is not None:  # a larger exponent lowers the entropy
        exponents.append(_bisect(F.col("shares"), lambda p, a: _entropy(_weights(p, a)) > F.lit(entropy_ratio) * F.ln(F.col("n"))))
    if max_repetition is not None:  # a larger exponent repeats small sources less
        exponents.append(_bisect(F.col("shares"), lambda p, a: F.array_max(F.zip_with(_weights(p, a), p, lambda w, s: w / s)) * F.col("budget") / F.col("total") > max_repetition))
    listed = listed.withColumn("exponent", F.greatest(*exponents) if len(exponents) > 1 else exponents[0])
    rows = listed.withColumn("weights", _weights(F.col("shares"), F.col("exponent"))).select("budget", "exponent", F.explode(F.arrays_zip("all", "weights")).alias("x"))
    rows = rows.select(F.col("x.all.source").alias("source"), F.col("x.all.tokens").alias("tokens"), F.col("x.weights").alias("weight"), "exponent", F.round(F.col("x.weights") * F.col("budget")).cast("long").alias("source_budget"))
    return rows.withColumn("passes", F.expr("source_budget div tokens")).withColumn("rest", F.expr("source_budget % tokens"))


def wide_source_plan(sizes: DataFrame, entropy_ratio: float | None, max_repetition: float | None, budget: int | None) -> DataFrame:
    """``source_plan`` for any number of sources: the driver sees sums for each exponent tried."""
    sizes = sizes.where("tokens > 0")
    facts = sizes.agg(F.count("*").alias("n"), F.sum("tokens").cast("long").alias("total")).first()
    wanted = budget or facts.total
    shares = sizes.withColumn("p", F.col("tokens") / F.lit(facts.total))

    def sums(exponents: list[float]) -> list:
        tried = shares.select("p", F.posexplode(F.array(*map(F.lit, exponents))).alias("i", "a")).withColumn("power", F.pow("p", "a"))
        return tried.groupBy("i").agg(F.sum("power").alias("sum"), F.sum(F.col("power") * F.ln("p")).alias("logs"), F.max(F.col("power") / F.col("p")).alias("most")).orderBy("i").collect()

    def search(too_low) -> float:
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            exponents = [low + (high - low) * i / SECTIONS for i in range(1, SECTIONS)]
            up = [too_low(a, row) for a, row in zip(exponents, sums(exponents), strict=True)]
            k = sum(up)  # true up to the exponent sought
            low, high = (exponents[k - 1] if k else low), (exponents[k] if k < len(exponents) else high)
        return high

    exponents = [0.0]
    if entropy_ratio is not None:
        goal = entropy_ratio * math.log(facts.n)
        exponents.append(search(lambda a, row: math.log(row["sum"]) - a * row["logs"] / row["sum"] > goal))
    if max_repetition is not None:
        exponents.append(search(lambda a, row: row["most"] / row["sum"] * wanted / facts.total > max_repetition))
    a = max(exponents)
    whole = sums([a])[0]["sum"]
    rows = shares.select("source", "tokens", (F.pow("p", F.lit(a)) / F.lit(whole)).alias("weight"), F.lit(a).alias("exponent"))
    rows = rows.withColumn("source_budget", F.round(F.col("weight") * F.lit(wanted)).cast("long"))
    return rows.withColumn("passes", F.expr("source_budget div tokens")).withColumn("rest", F.expr("source_budget % tokens"))


def plan(docs: DataFrame, entropy_ratio: float | None = 0.97, max_repetition: float | None = 4.0, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per source: source, weight, exponent, passes and the cut key of the last, partial permutation."""
    rows = saved(docs.select(F.coalesce(F.col(source_col), F.lit("")).alias("source"), _key(id_col, text_col).alias("key"), n_tokens(F.col(text_col)).alias("tokens")))
    ranges = saved(rows.groupBy("source", F.substring("key", 1, 3).alias("range")).agg(F.sum("tokens").alias("tokens")))
    sizes = saved(ranges.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    few = sizes.count() <= MAX_SOURCES
    sources = saved((source_plan if few else wide_source_plan)(sizes, entropy_ratio, max_repetition, budget))
    small = F.broadcast if few else (lambda df: df)
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("range"))  # at most 4096 ranges a source
    cuts = ranges.withColumn("upto", upto).join(small(sources.select("source", "rest")), "source").where("upto - tokens < rest and rest <= upto").select("source", "range", "rest", (F.col("upto") - F.col("tokens")).alias("before"))
    inside = rows.withColumn("range", F.substring("key", 1, 3)).join(small(cuts), ["source", "range"])
    start = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    cut = inside.withColumn("start", start).where("start < rest").groupBy("source").agg(F.max("key").alias("cut"))
    return small(sources.join(small(cut), "source", "left").select("source", "weight", "exponent", "passes", "cut"))


def mix(docs: DataFrame, entropy_ratio: float | None = 0.97, max_repetition: float | None = 4.0, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, with ``mix_block`` (which permutation) and ``mix_place`` (the order key in it)."""
    sources = plan(docs, entropy_ratio, max_repetition, budget, id_col, text_col, source_col)
    sources = sources.select(F.col("source").alias("mix_source"), F.col("passes").alias("mix_passes"), F.col("cut").alias("mix_cut"))
    joined = docs.withColumn("mix_key", _key(id_col, text_col)).join(sources, F.coalesce(F.col(source_col), F.lit("")) == F.col("mix_source"))
    head = F.when(F.col("mix_key") <= F.col("mix_cut"), 1).otherwise(0)  # the last, partial permutation
    blocks = joined.withColumn("mix_copies", F.col("mix_passes") + head).where("mix_copies > 0")
    blocks = blocks.withColumn("mix_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_copies") - 1)))
    whole = F.md5(F.concat_ws("/", F.col("mix_block").cast("string"), F.col("mix_key")).cast("binary"))
    place = F.when(F.col("mix_block") == F.col("mix_passes"), F.col("mix_key")).otherwise(whole)
    return blocks.withColumn("mix_place", place).drop("mix_key", "mix_source", "mix_passes", "mix_cut", "mix_copies")
