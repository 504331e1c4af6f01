"""Secret scan by a trigram inverted index, in DataFrame operations only.

For each rule a Boolean query over trigrams is derived from its regular expression: every match
holds, for one of the alternatives, all of its trigrams. The index lists, for each trigram of any
query, the texts that have it (lower-cased). Intersecting the postings of an alternative gives the
candidate texts of the rule, and only those are verified by the expression itself. A rule without
mandatory trigrams (such as a bare run of hex digits) is verified on every text.

Postings refer to texts by a 64-bit fingerprint, so copies of a text are indexed once; texts that
share a fingerprint by chance only add candidates, which verification drops. The index and the
candidates are aggregated before they are shuffled; the candidates are written, so that their true
size decides how they are joined, and a fingerprint shared by many copies is split by adaptive
execution.

Rows: null and empty texts have no spans. Repeated rows and null ids are kept, each scanned by its
own text. Texts are read whole. Extra columns are not read; ``redact`` passes them through.
"""

from __future__ import annotations

import itertools
import re._constants as ops
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from jobtide.llm.common import fresh_names
from jobtide.session import cut


@dataclass(frozen=True)
class Rule:
    """``group``: what ``at_least`` counts characters of (0: the whole match). Plain ASCII classes only."""
    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


BASE_RULES = (
    Rule("assign", "(" + "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key")))
         + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # what leftmost runs of 24 and more are
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("url", r"://[A-Za-z0-9._~-]{1,64}:[^\x00-\x20/@:]{3,64}@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES
MOST_STRINGS = 64  # exact alternatives followed before they are turned into trigrams

Query = list[frozenset[str]]  # any of these sets of trigrams, each whole; [frozenset()] is always true


def trigrams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def both(a: Query, b: Query) -> Query:
    return simpler([x | y for x in a for y in b])


def simpler(query: Query) -> Query:
    """Without alternatives that hold another one."""
    distinct = sorted(set(query), key=lambda s: (len(s), sorted(s)))
    return [x for n, x in enumerate(distinct) if not any(y <= x for y in distinct[:n])]


def trigram_query(pattern: str) -> Query:
    """Which trigrams every match must have; from the standard library's parse of the expression."""
    query, texts = _follow(parser.parse(pattern), [frozenset()], [""])
    return both(query, simpler([trigrams(t) for t in texts]))


def _follow(items, query: Query, texts: list[str]) -> tuple[Query, list[str]]:
    """Goes on from (query so far, strings that may just have been matched in full, lower case)."""
    for op, value in items:
        options = _options(op, value)
        if options is not None and len(options) * len(texts) <= MOST_STRINGS:
            texts = sorted({t + o for t in texts for o in options})
            continue
        query = both(query, simpler([trigrams(t) for t in texts]))
        texts = [""]
        if op is ops.SUBPATTERN:
            query, texts = _follow(value[3], query, texts)
            query, texts = both(query, simpler([trigrams(t) for t in texts])), [""]
        elif op is ops.BRANCH:
            parts: Query = []
            for branch in value[1]:
                inner, ends = _follow(branch, [frozenset()], [""])
                parts += both(inner, simpler([trigrams(t) for t in ends]))
            query = both(query, simpler(parts))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] > 0:
            inner, ends = _follow(value[2], [frozenset()], [""])
            query = both(query, both(inner, simpler([trigrams(t) for t in ends])))
    return query, texts


def _options(op, value) -> list[str] | None:
    """All strings (lower case) that an item matches, if they are few."""
    if op is ops.LITERAL:
        return [chr(value).lower()]
    if op is ops.IN:
        found: set[str] = set()
        for kind, v in value:
            if kind is ops.LITERAL:
                found.add(chr(v).lower())
            elif kind is ops.RANGE and v[1] - v[0] < 10:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return sorted(found) if len(found) <= 10 else None
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[1] == 1:
        inner = _sequence(value[2])
        return None if inner is None else sorted({*inner, *([""] if value[0] == 0 else [])})
    if op is ops.SUBPATTERN:
        return _sequence(value[3])
    if op is ops.BRANCH:
        parts = [_sequence(branch) for branch in value[1]]
        return None if None in parts else sorted(set(itertools.chain(*parts)))
    return None


def _sequence(items) -> list[str] | None:
    texts = [""]
    for op, value in items:
        options = _options(op, value)
        if options is None or len(options) * len(texts) > MOST_STRINGS:
            return None
        texts = [t + o for t in texts for o in options]
    return texts


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """(trigram, text_id): the postings of every trigram that a query of the rules asks for."""
    wanted = sorted(frozenset().union(*[s for r in rules for s in trigram_query(r.pattern)]))
    texts = docs.where(F.length(text_col) > 0).select(
        fingerprint(F.col(text_col)).alias("text_id"), F.lower(text_col).alias("lowered"))
    present = F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(F.col("lowered"), t))
    return texts.select(F.explode(present).alias("trigram"), "text_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(text_id, kinds array<string>): the rules for which the postings of some alternative all meet."""
    spark = index.sparkSession
    terms = [(t, r.kind, n, len(s)) for r in rules for n, s in enumerate(trigram_query(r.pattern)) for t in s]
    if not terms:
        return index.select("text_id", F.array().cast("array<string>").alias("kinds")).limit(0)
    asked = spark.createDataFrame(terms, "trigram string, kind string, alternative int, size int")
    met = (index.join(asked, "trigram").groupBy("text_id", "kind", "alternative", "size")
           .agg(F.collect_set("trigram").alias("met")).where(F.size("met") == F.col("size")))
    return met.groupBy("text_id").agg(F.collect_set("kind").alias("kinds"))


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches in code points, leftmost and without overlap.

    The pieces between matches and the matches in turn give the offsets.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    sizes = F.zip_with(F.transform(F.split(text, rule.pattern, -1), F.length), F.transform(found, F.length),
                       lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        last = first + F.coalesce(x["size"], F.lit(0))
        here = F.struct(first.alias("start"), last.alias("end"))
        return F.struct(last.alias("at"), F.when(x["size"].isNull(), acc["spans"]).otherwise(
            F.concat(acc["spans"], F.array(here))).alias("spans"))

    spans = F.aggregate(sizes, start, add, lambda acc: acc["spans"])
    kept = F.filter(F.zip_with(spans, F.transform(counted, F.length), lambda s, n: F.struct(s.alias("span"), n.alias("n"))),
                    lambda x: x["n"] >= rule.at_least)
    return F.transform(kept, lambda x: x["span"])


def all_spans(text: Column, kinds: Column, rules: tuple[Rule, ...]) -> Column:
    """array<struct<start, place, kind, end>> of the given rules' verified matches, in order."""
    def labelled(place: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"),
                                                     F.lit(kind).alias("kind"), s["end"].alias("end")))

    parts = []
    for place, rule in enumerate(rules):
        always = trigram_query(rule.pattern) == [frozenset()]
        asked = F.length(text) > 0 if always else F.array_contains(kinds, rule.kind)
        hit = asked & F.regexp_like(text, F.lit(rule.pattern))
        parts.append(F.when(hit, labelled(place, rule.kind, rule_spans(text, rule))).otherwise(
            F.array().cast("array<struct<start: int, place: int, kind: string, end: int>>")))
    return F.array_sort(F.concat(*parts))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with one more column ``into``: array<struct<start, place, kind, end>> in order."""
    found = cut(candidates(trigram_index(docs, rules, text_col), rules), "secret-candidates")
    own, key, kinds, out = fresh_names(docs, "own_text_id", "its_text_id", "its_kinds", "its_secrets")
    found = found.toDF(key, kinds)
    text = F.col(text_col)
    joined = docs.withColumn(own, fingerprint(text)).join(found, F.col(own) == F.col(key), "left")
    scanned = joined.withColumn(out, all_spans(text, F.col(kinds), rules)).drop(own, key, kinds)
    return scanned.drop(into).withColumnRenamed(out, into)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the texts replaced by ``[kind]``; overlapping spans make one."""
    spans, = fresh_names(docs, "found_secrets")
    scanned = scan(docs, rules, text_col, spans)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.concat(acc["parts"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]"))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], fresh).otherwise(acc["parts"]).alias("parts"))

    clean = F.aggregate(F.col(spans), start, add, lambda acc: F.array_join(
        F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, F.length(text) - acc["at"]))), ""))
    return scanned.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop(spans)


def joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans (of these kinds), comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
