"""Secret scan by a trigram inverted index, in DataFrame functions only.

From the syntax tree of each rule's regex a Boolean query over trigrams is derived: what any matching text must contain.
The index holds one posting (trigram, document) for each distinct trigram of a document that some rule asks for; one pass over
the lower-cased text finds them all (``trigram_scan``). A rule's query is answered from the postings: they meet the
rules' trigrams in a join, those of one document are counted for each alternative, and a document stays if every clause has an alternative that is whole.
Candidates are verified by the rule's regex. A rule without mandatory trigrams (hex) scans all texts.

The index may be kept (``postings``) and asked for other rules whose trigrams it covers. Documents are told by a 64-bit
hash of id and text, so rows that agree in both share their postings; a collision makes one more candidate and loses none.

Defined results: null text counts as empty; rows with null or repeated ids are each scanned; an empty table gives no
rows; other columns are ignored. Spans are in code points, end exclusive, ordered by start and then by kind.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Group whose length counts, and its least length; a match that fails is dropped after it has been consumed.
    group: int = 0
    least: int = 1
    base: bool = False


# The rules' patterns and least lengths.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

MAX_STRINGS = 16


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Lower-cased trigrams that any match contains, as a conjunction of disjunctions of conjunctions.

    Each element of the list is a set of alternatives, each a set of trigrams that occur together. None: nothing is
    mandatory, so every text must be scanned.
    """
    clauses: list[frozenset[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        alternatives = frozenset(_grams(s) for s in strings)
        if alternatives and all(alternatives):
            clauses.append(alternatives)

    def walk(items, strings: set[str]) -> set[str]:
        """``strings``: what the text just before may be, whole; the return value is the same after the items."""
        for op, arg in items:
            if op is sre.LITERAL:
                strings = {s + chr(arg).lower() for s in strings}
            elif op is sre.SUBPATTERN:
                strings = walk(arg[3], strings)
            elif op is sre.BRANCH:
                ends = [_literal(x) for x in arg[1]]
                if any(e is None for e in ends):
                    flush(strings)
                    strings = {""}
                else:
                    strings = {s + e for s in strings for es in ends for e in es}
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[:2] == (0, 1) and (ends := _literal(arg[2])) is not None and len(strings) * (len(ends) + 1) <= MAX_STRINGS:
                strings = strings | {s + e for s in strings for e in ends}
            else:
                flush(strings)
                strings = {""}
            if len(strings) > MAX_STRINGS:
                flush(strings)
                strings = {""}
        return strings

    def _literal(items) -> set[str] | None:
        out = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                out = {s + chr(arg).lower() for s in out}
            elif op is sre.IN and all(x[0] is sre.LITERAL for x in arg) and len(arg) <= 4:
                out = {s + chr(x[1]).lower() for s in out for x in arg}
            elif op is sre.MAX_REPEAT and arg[:2] == (0, 1) and (ends := _literal(arg[2])) is not None:
                out = out | {s + e for s in out for e in ends}
            elif op is sre.SUBPATTERN and (ends := _literal(arg[3])) is not None:
                out = {s + e for s in out for e in ends}
            else:
                return None
            if len(out) > MAX_STRINGS:
                return None
        return out

    flush(walk(sre_parser.parse(regex), {""}))
    return clauses or None


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.regex) or [] for alt in clause for g in alt})


def trigram_scan(grams: list[str]) -> str:
    """A regex that matches, with no width, where one of the trigrams begins, and captures it; trigrams are branched by their letters."""
    tree: dict[str, dict[str, list[str]]] = {}
    for g in grams:
        tree.setdefault(g[0], {}).setdefault(g[1], []).append(g[2])
    escaped = lambda c: re.sub(r"([^A-Za-z0-9])", r"\\\1", c)
    last = lambda cs: "[" + "".join(map(escaped, cs)) + "]"
    heads = ["%s(?:%s)" % (escaped(x), "|".join(escaped(y) + last(cs) for y, cs in sorted(ys.items()))) for x, ys in sorted(tree.items())]
    return f"(?={last(sorted(tree))})(?=({'|'.join(heads)}))"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("doc"))


def postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """gram, doc: the inverted index of the documents for some trigrams."""
    rows = keyed(docs, id_col, text_col)
    if not grams:
        return rows.select(F.lit("").alias("gram"), "doc").limit(0)
    met = F.regexp_extract_all(F.lower("text"), F.lit(trigram_scan(grams)), F.lit(1))
    return rows.select(F.explode(F.array_distinct(met)).alias("gram"), "doc")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc, rules: the ranks of the rules whose query a document satisfies, from the postings."""
    asked = [(g, i, c, a, len(alt)) for i, r in enumerate(rules) for c, clause in enumerate(trigram_query(r.regex) or []) for a, alt in enumerate(sorted(map(sorted, clause))) for g in alt]
    clauses = [(i, len(query)) for i, r in enumerate(rules) if (query := trigram_query(r.regex))]
    spark = index.sparkSession
    asked_for = spark.createDataFrame(asked, "gram string, rule int, clause int, alt int, need int")
    of_rule = spark.createDataFrame(clauses, "rule int, clauses int")
    met = index.join(F.broadcast(asked_for), "gram")  # the rules' trigrams only
    whole = met.groupBy("doc", "rule", "clause", "alt").agg(F.count_distinct("gram").alias("met"), F.max("need").alias("need")).where("met = need")
    held = whole.groupBy("doc", "rule").agg(F.count_distinct("clause").alias("held")).join(F.broadcast(of_rule), "rule").where("held = clauses")
    return held.groupBy("doc").agg(F.collect_set("rule").alias("rules"))


#: Matches whose lengths are added up together.
STRIDE = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, kind, end>> of the rule's matches, from the lengths of the texts between and in them.

    A start is the sum of the lengths before it, taken in strides, so that a text with many matches costs little more than
    the scan.
    """
    regex, group = F.lit(rule.regex), rule.group
    between, whole = F.split(text, rule.regex, -1), F.regexp_extract_all(text, regex, F.lit(0))
    counted = F.regexp_extract_all(text, regex, F.lit(group)) if group else whole
    pieces = F.zip_with(whole, between, lambda m, b: F.struct(F.length(b).cast("long").alias("gap"), F.length(m).cast("long").alias("len")))
    pieces = F.zip_with(pieces, counted, lambda p, c: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), F.length(c).alias("own")))
    pieces = F.filter(pieces, lambda p: p["len"].isNotNull())
    zero = F.lit(0).cast("long")

    def total(ps: Column, start: Column, n: Column) -> Column:
        return F.aggregate(F.slice(ps, start + 1, n), zero, lambda a, x: a + x["gap"] + x["len"])

    def kept(ps: Column, strides: Column) -> Column:
        def span(p: Column, i: Column) -> Column:
            k = F.floor(i / STRIDE).cast("int")
            start = F.get(strides, k) + total(ps, k * STRIDE, i - k * STRIDE) + p["gap"]
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + p["len"]).alias("end"), p["own"].alias("own"))

        return F.transform(F.filter(F.transform(ps, span), lambda x: x["own"] >= rule.least), lambda x: x.dropFields("own"))

    def placed(ps: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(ps) / STRIDE).cast("int")), lambda k: total(ps, k * STRIDE, F.lit(STRIDE)))
        before = _let(sums, lambda x: F.transform(x, lambda _, k: F.aggregate(F.slice(x, F.lit(1), k), zero, lambda a, y: a + y)))
        return _let(before, lambda strides: kept(ps, strides))

    return _let(pieces, placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """doc_id and ``spans``, an array of (start, rank, kind, end) in order, for every row; ``index``: postings kept from before."""
    index = postings(docs, vocabulary(rules), id_col, text_col) if index is None else index
    rows = keyed(docs, id_col, text_col).join(candidates(index, rules), "doc", "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    found = []
    for i, r in enumerate(rules):
        asked = F.coalesce(F.array_contains("rules", i), F.lit(False)) if trigram_query(r.regex) else F.lit(True)
        found.append(F.when(asked & F.col("text").rlike(r.regex), _spans(F.col("text"), r, i)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns that the contract names, from the spans."""
    base = [i for i, r in enumerate(rules) if r.base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter("spans", lambda s: s["rank"].isin(base))).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
