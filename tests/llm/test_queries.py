"""The operators' queries: SQL twins, native plans, and the pipeline stage by stage against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeline.llm import mixing, queries, toxicity
from tapeline.session import table
from tests.compare import SF, same_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    same_rows(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", ["op2_mixing", "op4_secrets"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def shingles(text):
    words = (text or "").encode().lower().split()
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []


def near(x, y):
    return 4 * len(x & y) >= 3 * len(x | y)


def groups_of(rows):
    """Component of each row by all pairs of shingle sets."""
    sets = [set(shingles(r.text)) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and near(x, sets[j]):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def holds(text, item):
    """Whether some window of the item's length has weighted Jaccard similarity 0.75 or more to it."""
    goal, words, n = Counter(shingles(item)), (text or "").encode().lower().split(), len((item or "").split())
    if not goal or sum((Counter(shingles(text)) & goal).values()) < 0.6 * sum(goal.values()):
        return False
    for at in range(max(1, len(words) - n + 1)):
        have = Counter(shingles(b" ".join(words[at : at + n]).decode()))
        both = sum((goal & have).values())
        if 4 * both >= 3 * (sum(goal.values()) + sum(have.values()) - both):
            return True
    return False


def test_pipeline_stages_equal_plain_python(spark):
    docs = table(spark, SF, "documents").withColumn("key", F.lit(1)).withColumn("region", F.lit("x"))
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = docs.collect(), stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        kept, all_rows = Counter(map(tuple, rows)), Counter(map(tuple, before))
        if name != "mixing":
            assert not kept - all_rows and len({r.doc_id for r in rows}) == len(rows)
        gone = [r for r in before if tuple(r) not in kept]
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.score_table(spark, docs, table(spark, SF, "labels")).collect()}
            assert {r.doc_id for r in gone} == {d for d, p in scores.items() if p}
        if name == "ngram_join":
            least = {}
            for r, g in zip(before, groups_of(before), strict=True):
                least.setdefault(g, []).append(r.doc_id)
            assert sorted(r.doc_id for r in rows) == sorted(min(x) for x in least.values())
        if name == "decontamination":
            leaked = {r.doc_id for r in before if any(holds(r.text, i) for i in items)}
            assert leaked and {r.doc_id for r in gone} == leaked
        if name == "mixing":
            plan = {r.source: r for r in mixing.plan(docs).collect()}
            taken, there = Counter(r.source for r in rows), Counter(r.source for r in before)
            assert not set(kept) - set(all_rows)
            assert all(n * plan[s].passes <= taken[s] <= n * (plan[s].passes + 1) for s, n in there.items())
        docs = spark.createDataFrame(rows, docs.schema)
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in placed) == Counter(r.doc_id for r in rows) and {r.shard for r in placed} == set(range(8))
    assert sorted((r.shard, r.slot) for r in placed) == [(s, i) for s in range(8) for i in range(sum(r.shard == s for r in placed))]


def test_pipeline_of_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_pipeline_with_nulls(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "some words in a row here", "en", "a", 3), (2, "", "en", None, 0), (3, "some words in a row here", "en", "a", 3)], table(spark, SF, "documents").schema)
    texts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        texts.append(sorted(str(r.text) for r in docs.collect()))
    words = "some words in a row here"
    assert texts == [["", "None", words, words], ["", "None", words], ["", "None", words], [words]]  # a source without words has no share in the mixture
    (placed,) = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert placed.doc_id in (3, None) and placed.size == len(words) + 1 and placed.slot == 0 and 0 <= placed.shard < 8
