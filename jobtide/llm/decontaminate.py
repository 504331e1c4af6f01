"""Benchmark decontamination: one Aho-Corasick automaton over all test items, one pass over a text.

Texts are lower-cased (A-Z) and cut into words. A window is ``width`` consecutive words of an item,
or a whole shorter item. Each word of the items becomes one letter of the automaton's alphabet, so
a document is scanned once, word by word, for all windows at a time, and a hit maps back to word
positions and to character offsets in the unchanged text.

The items are split into blocks of about ``block_words`` words, one automaton each, which bounds
what is broadcast and held by a worker (some 100 bytes a window word); a usual benchmark is one
block. Each further block is one more scan in the same pass over the documents.

Rows: null and empty texts have no words and no hits, also as items. Repeated items count once
each under their own id, equal ids once; an item with a null id still marks words, but isn't named.
Repeated documents and null ids are kept as they are. Extra columns are not read.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobtide.llm.common import lower_ascii, per_value, struct_of

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WIDTH = 10
BLOCK_WORDS = 100_000
FIRST_LETTER = 0x100  # letters are code points from here on, without the surrogates
MOST_LETTERS = 0x10F000 - FIRST_LETTER - 0x800  # of a string; a block of more distinct words is read as numbers
RESULT = "struct<n_words: bigint, runs: array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>, items: array<string>>"
KIND = struct_of(n_words=pa.int64(), items=pa.list_(pa.string()),
                 runs=pa.list_(struct_of(first=pa.int64(), last=pa.int64(), start=pa.int64(), end=pa.int64())))
KIND = pa.struct([KIND.field("n_words"), KIND.field("runs"), KIND.field("items")])


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(lower_ascii(text)) if text else []


def windows_of(words: list[str], width: int) -> list[tuple[str, ...]]:
    """All windows of an item; none if it has no words."""
    return [tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def sign(n: int) -> str:
    """The ``n``-th letter."""
    n += FIRST_LETTER
    return chr(n if n < 0xD800 else n + 0x800)


class Scanner:
    """The automaton of a block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        letter: dict[str, int] = {}
        ids: dict[tuple[int, ...], tuple[int, set[str]]] = {}
        for item, text in items:
            for window in windows_of(words_of(text), width):
                key = tuple([letter.setdefault(w, len(letter) + 1) for w in window])
                ids.setdefault(key, (len(window), set()))[1].update([item] if item is not None else ())
        self.as_text = len(letter) < MOST_LETTERS
        self.letter = {w: sign(n) for w, n in letter.items()} if self.as_text else letter
        self.automaton = ahocorasick.Automaton() if self.as_text else ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, value in ids.items():
            self.automaton.add_word("".join(map(sign, key)) if self.as_text else key, value)
        self.automaton.make_automaton()
        self.empty = not ids

    def spelled(self, words: list[str]) -> str | tuple[int, ...]:
        """The words' letters; a word of no item has a letter that no window has."""
        get = self.letter.get
        return "".join([get(w, " ") for w in words]) if self.as_text else tuple([get(w, 0) for w in words])

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        runs: list[list[int]] = []
        items: set[str] = set()
        if not self.empty:
            for last, (size, ids) in self.automaton.iter(self.spelled(words)):
                items |= ids
                first = last - size + 1
                while runs and runs[-1][1] >= first - 1:  # ends rise, starts need not
                    first = min(first, runs.pop()[0])
                runs.append([first, last])
        return {"n_words": len(words), "items": sorted(items), "runs": self.placed(text, runs)}

    def placed(self, text: str | None, runs: list[list[int]]) -> list[dict]:
        """The runs of hit words with their character offsets in the text as it was."""
        if not runs:
            return []
        spans = [m.span() for m in WORDS.finditer(lower_ascii(text))]
        return [{"first": a, "last": b, "start": spans[a][0], "end": spans[b][1]} for a, b in runs]


def scanners(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH,
             block_words: int = BLOCK_WORDS) -> list[Column]:
    """One column function for each block of items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * block_words)))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    found = []
    for n in range(blocks):
        part = [tuple(r) for r in items.where(block == n).select("item", "text").collect()]
        found.append(_scanner(spark, part, width))
    return found


def _scanner(spark: SparkSession, items: list[tuple], width: int):
    shared = spark.sparkContext.broadcast(items)
    return per_value(spark, lambda: Scanner(shared.value, width).scan, RESULT, KIND)


def merged_runs(runs: Column) -> Column:
    """Runs of several blocks as one ascending list without overlap."""
    def add(acc: Column, run: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= run["first"] - 1)
        grown = F.struct(last["first"].alias("first"), F.greatest(last["last"], run["last"]).alias("last"),
                         last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(
            F.concat(acc, F.array(run)))

    return F.aggregate(F.array_sort(runs), F.slice(runs, 1, 0), add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", into: str = "leak",
                  item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with one more column ``into``: n_words, runs of hit words, and the items found.

    A column of that name is replaced.
    """
    parts = [f(F.col(text_col)) for f in scanners(benchmark, item_col, item_text_col, width, block_words)]
    if len(parts) == 1:
        return docs.withColumn(into, parts[0])
    names = [f"{into}_of_block_{n}" for n in range(len(parts))]
    each = docs.select(*[c for c in docs.columns if c != into], *[p.alias(n) for p, n in zip(parts, names)])
    runs = merged_runs(F.flatten(F.array(*[F.col(f"{n}.runs") for n in names])))
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}.items") for n in names]))))
    whole = F.struct(F.col(f"{names[0]}.n_words").alias("n_words"), runs.alias("runs"), items.alias("items"))
    return each.withColumn(into, whole).drop(*names)
