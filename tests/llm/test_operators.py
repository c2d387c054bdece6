"""Each operator against plain Python on small tables with nulls, ties, repeated rows and clashing column names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import ann, chat, components, decontam, mixing, secrets, sharding, token_counts, toxicity

DOCS = "doc_id long, text string, source string, key string, n int, block int"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, s, "k", 1, 2) for d, t, s in rows], DOCS).repartition(parts)


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


# mixing ------------------------------------------------------------------------------------------------------------


def mix_rows(spark, ratio, cap):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(50)]
    rows = [(i, words(rng, rng.randint(0, 30), vocabulary), rng.choice(["a"] * 12 + ["b", "b", "c", None])) for i in range(300)]
    rows += [(300, None, "c"), (None, "one two", "b"), (5, rows[5][1], rows[5][2])]
    return rows, mixing.mix(docs(spark, rows), ratio, cap)


@pytest.mark.parametrize(("ratio", "cap"), [(0.9, None), (None, 2.0), (0.99, 3.0), (None, None)])
def test_mixture_meets_targets(spark, ratio, cap):
    rows, got = mix_rows(spark, ratio, cap)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    have = Counter()
    for _, t, s in rows:
        have[s or ""] += size(t)
    total = sum(have.values())
    taken, plan = Counter(), {r.source: r for r in mixing.plan(docs(spark, rows), ratio, cap).collect()}
    for r in got.collect():
        taken[r.source or ""] += size(r.text)
    for s, n in have.items():
        assert abs(taken[s] - plan[s].weight * total) <= 30 + 2  # a document more at most
    entropy = -sum(r.weight * np.log(r.weight) for r in plan.values())
    repetition = max(r.weight * total / have[s] for s, r in plan.items())
    if ratio and not cap:
        assert abs(entropy - ratio * np.log(len(plan))) < 1e-9
    if cap and not ratio:
        assert repetition <= cap + 1e-9
    if cap and ratio:
        assert repetition <= cap + 1e-9 or abs(entropy - ratio * np.log(len(plan))) < 1e-9
    full = Counter((r.source or "", r.mix_block) for r in got.collect())
    assert got.columns == [*docs(spark, rows).columns, "mix_block", "mix_place"] and {r.block for r in got.collect()} == {2}
    for s, r in plan.items():
        assert all(full[s, b] == sum(1 for _, _, x in rows if (x or "") == s) for b in range(r.passes))


@pytest.mark.parametrize(("ratio", "cap"), [(0.9, None), (0.97, 4.0), (None, 2.0)])
def test_mixture_of_many_sources_is_the_same(spark, monkeypatch, ratio, cap):
    rows, few = mix_rows(spark, ratio, cap)
    want = Counter(str(r) for r in few.collect())
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    assert Counter(str(r) for r in mix_rows(spark, ratio, cap)[1].collect()) == want


def test_mixture_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, None), (2, "", "a")])).count() == 0


# toxicity ----------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def least_edits(word, terms):
    """Fewest allowed edits between a term and a beginning of the word, for short terms also the whole word."""
    found = 9
    for t in terms:
        allowed = (len(t) >= toxicity.FUZZY_FROM) + (len(t) >= toxicity.FUZZY2_FROM)
        e = min(edits(word[:n], t) for n in range(1, len(word) + 1))
        found = min(found, e) if e <= allowed else found
        found = min(found, 1) if edits(word, t) == 1 else found
    return found


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = ["abca", "abcab", "bacab", "aaab", "cabbacabb"]
    trie = toxicity.FuzzyTrie(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        assert trie.hit(word) == least_edits(word, terms), word


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 4 == 0
        t = words(rng, rng.randint(10, 60), vocabulary).split()
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["zapgor", "zapgoria", "wexford", "kwizbad"]) if i % 8 else "zapgorr")
        rows.append((i, " ".join(t), "s"))
        labels.append((i, int(toxic), 1))
    rows += [(9000, None, "s"), (9001, "", "s"), (None, "zapgor wexford kwizbad", "s"), (9001, "x", None)]
    labels += [(None, 1, 1), (9000, None, 1)]
    df, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    got = toxicity.score_table(spark, df, lab).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, t, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert len(held) > 80 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in got) and [r.predicted for r in got if r.doc_id is None] == [1]
    kept = toxicity.keep_clean(df, toxicity.learn(df, lab))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_toxicity_without_labels(spark):
    got = toxicity.score_table(spark, docs(spark, [(1, "a b", None)]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0)]


def test_quotation():
    trie = toxicity.FuzzyTrie(["idiot"])
    assert toxicity.features('he said "you idiot" to me', trie, {}) == (0, 0, 1)
    assert toxicity.features("you idiot, idi0t, idjot, 1diot, id*ot, id!0t and idiotic", trie, {}) == (2, 4, 0)
    assert toxicity.features("he*idiot x", trie, {}) == (1, 0, 0)
    assert toxicity.features("«vous idiot»", trie, {}) == (0, 0, 1)


def test_letters_added_and_left_out_anywhere():
    trie = toxicity.FuzzyTrie(["scum", "idiot", "worthless"])
    assert [trie.hit(w) for w in ("scum", "scumbag", "scam", "cum", "xscum", "scams", "scambag")] == [0, 0, 1, 1, 1, 9, 9]
    assert [trie.hit(w) for w in ("diot", "xidiot", "idioticly", "orthles", "wworthlesss", "orthle")] == [1, 1, 0, 2, 1, 9]


def test_known_beginnings_are_no_misspellings():
    trie = toxicity.FuzzyTrie(["moron", "scum"], frozenset(["moro", "moros", "scam$"]))
    assert [trie.hit(w) for w in ("morose", "morosity", "morom", "moron", "scam", "scun")] == [9, 9, 1, 0, 9, 1]
    assert toxicity.FuzzyTrie(["moron"], frozenset(), {"moron": 0}).hit("morom") == 9
    assert toxicity.FuzzyTrie(["moron"], frozenset(), {"moron": 0}).hit("moronic") == 0


def test_lexicon_from_labels(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = words(rng, 40, vocabulary)
        if i % 3 == 0:
            text += " wexford" if i % 30 == 0 else " kwizbad"  # the one in a tenth of the toxic rows, the other in most
        elif i % 5 == 0:
            text += " wixford"  # a word of its own, one edit away
        rows.append((i, text, None))
        labels.append((i, int(i % 3 == 0)))
    copied = words(rng, 60, vocabulary) + " quxberry " + words(rng, 20, vocabulary)
    rows += [(1000 + i, copied + f" no{i}", None) for i in range(100)]  # one text, a hundred times: no evidence
    labels += [(1000 + i, 1) for i in range(100)]
    df = docs(spark, rows)
    model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    trie = model.trie()
    assert [trie.hit(w) for w in ("wexford", "kwizbad", "kwizbat", "wizbad", "wixford", "quxberry")] == [0, 0, 1, 1, 9, 9]
    assert model.weights[2] > 0  # no labels on misspellings: they weigh as terms do


def test_features_equal_plain_search():
    rng = random.Random(15)
    terms = ["abcad", "baca", "cabbacabbd"]
    trie = toxicity.FuzzyTrie(terms)

    for _ in range(150):
        near = lambda: "".join(rng.choice("abcd1") if rng.random() < 0.15 else c for c in rng.choice(terms))
        tokens = [rng.choice(['"', "«", "»", ".", near(), near() + "xx", "dd", "abc"]) for _ in range(rng.randint(0, 25))]
        text = " ".join(tokens).upper()
        want, at = [0, 0, 0], 0
        for t in tokens:
            if t.isalnum() and (e := least_edits(t, terms)) != 9:
                before, behind = text[max(0, at - toxicity.WINDOW) : at], text[at + len(t) : at + len(t) + toxicity.WINDOW]
                quoted = any(q in before for q in '"«') and any(q in behind for q in '"»')
                want[2 if quoted else 1 if e else 0] += 1
            at += len(t) + 1
        assert toxicity.features(text, trie, {}) == tuple(want)


def test_quotation_changes_the_score(spark):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = [(i, words(rng, 30, vocabulary) + (" you zapgor " if i % 3 == 0 else " ") + words(rng, 20, vocabulary), None) for i in range(400)]
    model = toxicity.learn(docs(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int"))
    said = docs(spark, [(1, "and so you zapgor went home", None), (2, "and so \"you zapgor\" they wrote", None), (3, "and so they went home", None)])
    got = {r.doc_id: r for r in toxicity.score(said, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == got[3].predicted == 0 and got[2].quoted == 1 and got[2].score < got[1].score


# secrets -----------------------------------------------------------------------------------------------------------


def test_secrets_equal_plain_search(spark):
    rng = random.Random(4)
    bits = ["password = 'abcDEF12'", "Token:x", "secret=\"longer/value+1\"", "api_key=ABCDEF", "APIKEY : zz.zz.zz", "AKIA" + "Q" * 16, "AKIAQQ", "0123456789abcdef01234567", "deadbeef", "password=token:abcdefg", "é", " ", "\n", "token==abcdef", "passwd:'short"]
    rows = [(i, rng.choice(["", " ", "ü "]).join(rng.choice(bits) for _ in range(rng.randint(0, 9))), None) for i in range(200)] + [(None, None, None), (7, "AKIA" + "Z" * 30, None), (8, "x" * 5000 + " secret: abcdefgh", None)]
    got = secrets.digest(secrets.scan(docs(spark, rows))).collect()
    plain = {"assign": (re.compile(secrets.RULES[0].regex, re.ASCII), 2, 6), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile("[0-9a-f]+"), 0, 24)}
    want = []
    for d, t, _ in rows:
        found = sorted((m.start(), k, kind, m.end()) for k, (kind, (rx, g, least)) in enumerate(plain.items()) for m in rx.finditer(t or "") if len(m[g]) >= least)
        n = Counter(f[2] for f in found)
        want.append((d, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


def test_index_holds_postings_and_gives_candidates(spark):
    rows = [(1, "my PassWord", None), (2, "AKI KIA AKIA1", None), (3, "tok oken", None), (4, None, None), (None, "eyJ token", None), (4, "-----BEGIN RSA", None)]
    df, grams = docs(spark, rows), secrets.vocabulary(secrets.RULES)
    index = secrets.postings(df, grams)
    want = Counter((d, g) for d, t, _ in rows for g in grams if g in (t or "").lower())
    of = {r.doc: r.doc_id for r in secrets.keyed(df, "doc_id", "text").collect()}
    assert Counter((of[r.doc], r.gram) for r in index.collect()) == want
    got = {(of[r.doc], tuple(sorted(secrets.RULES[i].kind for i in r.rules))) for r in secrets.candidates(index, secrets.RULES).collect()}
    assert got == {(1, ("assign",)), (2, ("access",)), (3, ("assign",)), (None, ("assign", "jwt"))}  # 3: all trigrams, no match
    many = tuple(secrets.Rule(f"r{i}", f"rule{chr(97 + i % 26)}{chr(97 + i // 26)}x+") for i in range(90))
    assert len(secrets.vocabulary(many)) > 62
    found = secrets.scan(docs(spark, [(i, f"é rule{chr(97 + i % 26)}{chr(97 + i // 26)}xx" * (i + 1), None) for i in range(90)]), many).collect()
    assert all(len(r.spans) == r.doc_id + 1 and {x.kind for x in r.spans} == {f"r{r.doc_id}"} for r in found) and len(found) == 90
    assert Counter(str(r) for r in secrets.scan(df, index=index).collect()) == Counter(str(r) for r in secrets.scan(df).collect())


def test_trigram_queries_hold():
    samples = {"assign": ["PassWord: abcdef", "api_key=qqqqqq", "APIKEY=1"], "access": ["AKIA1234"], "pem": ["-----BEGIN RSA PRIVATE KEY-----"], "jwt": ["eyJabcdefgh.abcdefgh.abcdefgh"]}
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.regex)
        assert (query is None) == (rule.kind == "hex")
        for s in samples.get(rule.kind, ()):
            assert re.search(rule.regex, s) and all(any(all(g in s.lower() for g in alt) for alt in clause) for clause in query)


# nearest neighbours ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("group", [32_768, 20])
def test_nearest_recall_and_ties(spark, monkeypatch, group):
    monkeypatch.setattr(ann, "CELL_ROWS", 200)
    monkeypatch.setattr(ann, "GROUP_QUERIES", group)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    data = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 24))).astype(np.float32)
    data[100:160] = data[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(data)]
    rows += [(2000, None, 1), (2020, [0.0] * 24, 1), (2040, [float("nan")] * 24, 1), (2060, [None] * 24, 1), (2080, [float("inf")] * 24, 1), (None, data[0].tolist(), 1), (2100, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(4)
    got = ann.nearest(df, k=20).collect()
    exact = data.astype(float) @ data.astype(float).T
    hits, by = 0, {}
    for r in got:
        by.setdefault(r.query_id, {})[r.rank] = r
    assert set(by) == set(range(0, 1500, 20))
    for q, found in by.items():
        assert sorted(found) == list(range(1, 21))
        scores = exact[q].copy()
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1500), -scores))[:20]
        hits += len(set(best.tolist()) & {r.vec_id for r in found.values()})
        order = [(-found[k].score, found[k].vec_id) for k in sorted(found)]
        assert order == sorted(order) and all(abs(r.score - exact[q, r.vec_id]) < 1e-9 for r in found.values())
    assert hits >= 0.9 * 20 * len(by)
    copies = [by[100][k].vec_id for k in range(1, 21) if 100 <= by[100][k].vec_id < 160]
    assert copies == list(range(101, 101 + len(copies)))


def test_nearest_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 3.0]), (1, [2.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), k=3)
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()}
    assert [found[0, i] for i in (1, 2, 3)] == [(1, 3.0), (2, 3.0), (20, 1.0)] and [found[20, i] for i in (1, 2, 3)] == [(1, 2.0), (0, 1.0), (2, 1.0)]


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df).collect()) == [(0, 1, 20), (0, 2, 3), (20, 1, 3), (20, 2, 0)]
    assert ann.nearest(df.where("vec_id < 0")).count() == 0


# decontamination ---------------------------------------------------------------------------------------------------


def test_decontamination_equals_all_windows(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, words(rng, rng.randint(5, 60), vocabulary)) for i in range(25)] + [(90, None), (91, ""), (92, "two words"), (93, words(rng, 250, vocabulary))]
    rows = []
    for i in range(120):
        parts = [words(rng, rng.randint(0, 50), vocabulary)]
        if i % 3 == 0:
            item = rng.choice(items[:25])[1].split()
            if i % 2 and len(item) > 45:
                item[rng.randrange(len(item))] = "changed"
            parts += [" ".join(item).upper(), words(rng, rng.randint(0, 30), vocabulary)]
        rows.append((i, "\n".join(parts), None))
    rows += [(500, None, None), (501, "", None), (None, items[3][1], None), (502, items[-1][1], None), (503, "two words", None)]
    cut = lambda t: [" ".join(x) for x in zip(*(t[k:] for k in range(5)), strict=False)] if len(t) >= 5 else [" ".join(t)] if t else []
    want = set()
    for d, t, _ in rows:
        w = (t or "").lower().split()
        for i, item in items:
            x = (item or "").lower().split()
            goal = Counter(cut(x))
            for a in range(max(1, len(w) - len(x) + 1)):
                have = Counter(cut(w[a : a + len(x)]))
                both = sum((goal & have).values())
                if both and both / (sum(goal.values()) + sum(have.values()) - both) >= 0.75:
                    want.add((d, i))
    df, bench = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and {(None, 3), (502, 93), (503, 92)} <= got
    exact = {(d, i) for d, t, _ in rows for i, item in items if item and f" {' '.join(item.split())} " in f" {' '.join((t or '').lower().split())} "}
    assert exact - {(503, 92)} <= got
    kept = decontam.clean_rows(df, bench)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _, _ in rows if d not in {x for x, _ in got})
    assert decontam.leaks(df, bench.where("item_id < 0")).count() == 0


def test_long_items_are_verified_whole(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    fresh = lambda n: words(rng, n, vocabulary)
    items = [(1, fresh(125)), (2, fresh(600)), (3, fresh(240))]
    of = {i: t.split() for i, t in items}
    cut = lambda i, a, b: " ".join(of[i][a:b])
    edited = list(of[2])
    for i in (30, 150, 151, 290, 410, 560):
        edited[i] = "changed"
    held = [(10, f"{fresh(40)} {items[0][1]} {fresh(9)}"), (11, f"{fresh(70)} {' '.join(edited)}"), (12, items[2][1]), (13, f"{fresh(3)} {cut(2, 0, 300)} added here {cut(2, 300, 600)} {fresh(50)}"), (14, cut(2, 60, 600))]
    clean = [(20, f"{fresh(50)} {cut(1, 120, 125)} {fresh(50)}"), (21, f"{fresh(60)} {cut(2, 120, 240)} {fresh(700)}"), (22, cut(2, 0, 120)), (23, f"{fresh(9)} {cut(3, 0, 120)} {fresh(300)}"), (24, cut(2, 480, 600))]
    df, bench = docs(spark, [(d, t, None) for d, t in held + clean]), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(df, bench).collect()}
    assert set(got) == {(10, 1), (11, 2), (12, 3), (13, 2), (14, 2)}
    assert [got[k].first_word for k in ((10, 1), (11, 2), (12, 3))] == [40, 70, 0] and got[12, 3].similarity == 1 and got[11, 2].similarity < 1
    assert sorted(r.doc_id for r in decontam.clean_rows(df, bench).collect()) == [d for d, _ in clean]


def test_recall_of_edited_items():
    """Windows at similarity 0.75 or more are found however the edits are spread: 0.98 at least in each band."""
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(5000)]
    cut = lambda t: Counter(" ".join(t[i : i + 5]) for i in range(len(t) - 4)) if len(t) >= 5 else Counter([" ".join(t)])
    hits, there = Counter(), Counter()
    for _ in range(500):
        n = rng.choice([15, 25, 40, 60, 90, 119, 130, 250])
        item = [rng.choice(vocabulary) for _ in range(n)]
        copy = list(item)
        for _ in range(rng.randint(0, max(1, n // 22))):
            at = rng.randrange(len(copy))
            copy[at : at + rng.choice([0, 1, 1])] = rng.choice([[rng.choice(vocabulary)], []])
        text = [rng.choice(vocabulary) for _ in range(40)] + copy + [rng.choice(vocabulary) for _ in range(60)]
        goal = cut(item)
        best = max((lambda have: sum((have & goal).values()) / sum((have | goal).values()))(cut(text[a : a + n])) for a in range(36, 46))
        if best >= 0.75:
            band = "exact" if best == 1 else "0.85" if best >= 0.85 else "0.75"
            indexes = [decontam.ItemIndex(c, p) for c, p in sorted(decontam.item_parts([(1, " ".join(item))]).items())]
            there[band] += 1
            hits[band] += (0, 1) in decontam.find([" ".join(text).encode()], indexes)
    assert hits["exact"] == there["exact"] > 50 and all(there[b] > 40 and hits[b] >= 0.98 * there[b] for b in ("0.75", "0.85"))


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 3)
    monkeypatch.setattr(decontam, "ITEM_BYTES", 70)
    bench = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i}") for i in range(10)], "item_id long, text string")
    df = docs(spark, [(i, f"x y a{i} b{i} c{i} d{i} e{i} f{i} g{i} z", None) for i in range(12)])
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == {(i, i) for i in range(10)}
    assert sorted(r.doc_id for r in decontam.clean_rows(df, bench).collect()) == [10, 11]


# token counts ------------------------------------------------------------------------------------------------------


def test_edited_counts_equal_recounts():
    rng = random.Random(7)
    encode = token_counts.encoding(token_counts.VOCABULARY).encode_ordinary
    letters = "abc dé 12.,\n\t'  ñß漢字"
    for _ in range(40):
        text = "".join(rng.choice(letters if rng.random() < 0.5 else "abcdefgh ") for _ in range(rng.randint(0, 3000)))
        tree = token_counts.TokenTree(text, encode)
        assert tree.total == len(encode(text))
        for _ in range(8):
            start = rng.randint(-2, len(tree.text) + 3)
            end = start + rng.choice([0, 1, 5, 40, 900])
            put = rng.choice(["", " ", "x", "word and word", "'s", "\n\n", "a" * 600])
            tree.edit(start, end, put)
            assert tree.total == len(encode(tree.text)) and tree.chars[1] == len(tree.text)


def test_few_segments_are_encoded_again(spark):
    text = "some plain words that go on and on " * 400
    edit = F.array(F.struct(F.lit(5000).cast("long").alias("start"), F.lit(5010).cast("long").alias("end"), F.lit("new").alias("put")))
    df = docs(spark, [(1, text, None), (2, None, None), (None, "", None)]).withColumn("edits", edit)
    got = {r.doc_id: r for r in token_counts.count_with_edits(df, edits_col="edits").collect()}
    encode = token_counts.encoding(token_counts.VOCABULARY).encode_ordinary
    assert got[1].n_segments > 40 and got[1].n_reencoded == 1
    assert (got[1].n_tokens, got[1].n_tokens_after) == (len(encode(text)), len(encode(text[:5000] + "new" + text[5010:])))
    assert (got[2].n_tokens, got[2].n_tokens_after) == (0, 1)
    assert token_counts.count_with_edits(docs(spark, [])).count() == 0


def test_trees_are_kept_between_runs(spark, tmp_path):
    text = "some plain words that go on and on " * 300
    edits = lambda d, put: F.array(F.struct(F.lit(d).cast("long").alias("start"), F.lit(d + 9).cast("long").alias("end"), F.lit(put).alias("put")))
    df = docs(spark, [(1, text, None), (2, None, None), (None, "", None), (1, text, None)])
    token_counts.build(df).write.parquet(str(tmp_path / "first"))
    encode, want = token_counts.encoding(token_counts.VOCABULARY).encode_ordinary, text
    for name, (at, put) in {"second": (4000, "new"), "third": (70, "x" * 3000 + " some words"), "fourth": (2900, "!")}.items():
        before = spark.read.parquet(str(tmp_path / {"second": "first", "third": "second", "fourth": "third"}[name]))
        token_counts.apply_edits(before.withColumn("edits", edits(at, put))).write.parquet(str(tmp_path / name))
        want = want[:at] + put + want[at + 9 :]
        rows = spark.read.parquet(str(tmp_path / name)).where("doc_id = 1").collect()
        assert len(rows) == 2 and all((r.text, r.n_tokens) == (want, len(encode(want))) and r.n_reencoded <= 3 for r in rows)
        assert all(sum(r.tree.chars) == len(want) and sum(r.tree.tokens) == r.n_tokens and r.key == "k" for r in rows)


# chat --------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(8)
    bits = ["</s>", "[INST]", "[/INST]", "\\", "<s>", "\n", "ok", " ", "é", "<|image|>", "\\\\n", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb"]), "".join(rng.choice(bits) for _ in range(6))) for c in range(30) for t in range(rng.randint(1, 5))]
    rows += [(3, 1, "user", None), (None, 0, "assistant", "x"), (4, None, "user", "first"), (5, 0, "user", "same"), (5, 0, "user", "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int").repartition(4)
    formatted = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by: dict = {}
    for r in formatted.collect():
        by.setdefault(r.conv_id, []).append(r)
    want: dict = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort(key=lambda x: (x[0], x[1], chat.write_turn(x[1], chat.escape(x[2]))[0]))
        text = "".join(a for _, r, a in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(r.formatted) for r in by[c])


def test_typed_parts(spark):
    parts = "array<struct<type:string,text:string,ref:string,tokens:int>>"
    data = [(1, 0, "user", [("text", "see </s>", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 7), ("document", None, "c.pdf", None), (None, None, None, None), ("video", None, "d", 5)]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {parts}")
    rows = chat.format_turns(df, parts_col="parts").orderBy("turn").collect()
    assert rows[0].formatted == "<s>user\n[INST]see \\</s><|image|><|audio|><|document|><|other|>[/INST]</s>"
    assert [tuple(a) for a in rows[0].attachments] == [(0, "image", "a.png"), (1, "audio", "b.wav"), (2, "document", "c.pdf"), (3, "other", "d")]
    assert rows[0].n_tokens == 2 + 576 + 7 + 1024 + 5 and rows[1].formatted == "<s>assistant\n</s>" and rows[0].loss == rows[1].loss == []
    assert chat.read_back(chat.format_turns(df.where("turn > 5"), parts_col="parts")).count() == 0


def test_loss_mask_is_what_is_read(spark):
    df = spark.createDataFrame([(1, 0, "user", "assistant\n</s>"), (1, 1, "assistant", "é </s>[INST] \\ ok"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(df)
    rows = formatted.orderBy("turn").collect()
    assert [[tuple(x) for x in r.loss] for r in rows] == [[], [(13, 13 + len("é \\</s>\\[INST] \\\\ ok"))], []]
    whole = chat.read_back(formatted).first()
    assert whole.loss_chars == len("é </s>[INST] \\ ok")
    none = chat.read_back(formatted.withColumn("loss", F.lit(None).cast("array<struct<start:int,end:int>>"))).first()
    assert (none.loss_chars, none.turns_sha256) == (0, whole.turns_sha256)


# sharding ----------------------------------------------------------------------------------------------------------


def test_packing_equals_plain_search():
    rng = random.Random(9)
    for _ in range(200):
        sizes, capacity = {i: rng.randint(1, 50) for i in range(rng.randint(0, 40))}, 60
        bins, want = [], {}
        for unit, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
            fitting = [(r, i) for i, r in enumerate(bins) if r >= size]
            i = min(fitting)[1] if fitting else len(bins)
            if not fitting:
                bins.append(capacity)
            bins[i] -= size
            want[unit] = i
        assert sharding.best_fit_decreasing(sizes, capacity) == (want, len(bins))


@pytest.mark.parametrize("copies", [1, 400])
def test_shards(spark, copies):
    import zlib

    rng = random.Random(10)
    rows = [(i, "x" * rng.randint(0, 400) + str(i % 700), None) for i in range(900)] + [(2000 + i, "same text é", None) for i in range(copies)] + [(None, None, None), (3, None, None), (4, "", None)]
    got = sharding.shard_rows(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    load, slots, home = Counter(), {}, {}
    for r in got:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert home.setdefault(r.text_crc32, r.shard) == r.shard
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(load) == set(range(8))
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values())
    assert sharding.shard_rows(docs(spark, [])).count() == 0
    fixed = sharding.shard_rows(docs(spark, rows), n_shards=None, capacity=20_000)
    per = Counter()
    for r in fixed.collect():
        per[r.shard] += r.size
    assert max(per.values()) <= 20_000 and len(per) <= -(-sum(per.values()) // 20_000) + 1


@pytest.mark.parametrize("rounds", [20_000, 400])
def test_fixed_capacity_holds(spark, monkeypatch, rounds):
    monkeypatch.setattr(sharding, "BLOCK_UNITS", rounds)
    monkeypatch.setattr(sharding, "BINS", rounds // 4)
    rng = random.Random(12)
    rows = [(i, "y" * rng.choice([3, 40, 90]) + str(i), None) for i in range(1500)] + [(5000, "z" * 900, None), (5001, "z" * 900, None)]
    got = sharding.shard_rows(docs(spark, rows), n_shards=None, capacity=300).collect()
    per, home = Counter(), {}
    for r in got:
        per[r.shard] += r.size
        assert home.setdefault(r.text_crc32, r.shard) == r.shard
    over = [n for n in per.values() if n > 300]
    assert len(got) == len(rows) and over == [1802] and set(per) == set(range(len(per)))
    assert len(per) - 1 <= 1.12 * (sum(per.values()) - 1802) / 300
    equal = Counter()
    for r in sharding.shard_rows(docs(spark, rows), n_shards=8).collect():
        equal[r.shard] += r.size
    assert max(equal.values()) - min(equal.values()) <= 0.01 * sum(equal.values()), equal


# components --------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(11)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
