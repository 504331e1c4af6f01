"""Exact substring de-duplication by difference-cover anchors.

A word goes if a window of ``WIDTH`` words around it also starts in a document with a smaller id.
Not every window is hashed: a difference cover of the residues modulo ``PERIOD`` has, for any two
positions, a shift below ``PERIOD`` that brings both into the cover. So two equal windows, wherever
they start, share an equal stretch of ``ANCHOR = WIDTH - PERIOD + 1`` words that starts at a cover
position in both. Only anchors are hashed and counted (about a fifth of the positions). An anchor
that several documents have is then extended, in each of them, to all the windows around it that
it could lie in, and the 128-bit hashes of those windows decide. No pairs are made at any point.

Documents of the same word sequence are folded first: of these only the smallest id looks for
anchors, the others lose all their words if they have a window at all. Anchors and windows are each
shuffled once, to the task that has all rows of their hash. Texts are shuffled only if their document
may have a shared anchor, anchors by word sequence only if several documents may have that sequence
(:func:`sieve`). A hash that very many documents share has its rows in one task, which sorts them and
spills what it can't hold.

Rows: null and empty texts have no words and lose none. Texts of fewer than ``WIDTH`` words stay.
Rows of equal ids never remove each other's words, nor do repeats inside one document. Rows with a
null id lose nothing and remove nothing. Repeated rows get equal results. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from jobtide.llm.common import WORD, per_value, struct_of
from jobtide.session import cut

WIDTH, PERIOD = 50, 31
COVER = (1, 5, 11, 24, 25, 27)  # fixed values: every difference modulo 31 occurs
ANCHOR = WIDTH - PERIOD + 1
KNOWN_WORDS = 200_000
SIEVE_SHARE, SIEVE_MOST = 16, 1 << 25
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def is_cover(residues: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in residues for b in residues} == set(range(period))


class Roller:
    """Hashes of word stretches: sums of word hash times a power, modulo 2^64, then mixed."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}
        self.powers = {f: (np.ones(1, np.uint64), np.ones(1, np.uint64)) for f in FACTORS}

    def word(self, word: str) -> tuple[int, int]:
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        both = xxhash.xxh3_128_intdigest(word)
        value = self.known[word] = (both >> 64, both & 0xFFFFFFFFFFFFFFFF)
        return value

    def hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        both = np.array([known.get(w) or self.word(w) for w in words], np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def up_to(self, factor: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of an odd factor and of its inverse."""
        have = self.powers[factor]
        if len(have[0]) < count:
            size = max(count, 2 * len(have[0]))
            back = pow(factor, -1, 1 << 64)
            have = self.powers[factor] = tuple(
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, f, np.uint64)])) for f in (factor, back))
        return have

    def stretches(self, hashes: np.ndarray, size: int, factor: int) -> np.ndarray:
        """The hash of the ``size`` words from each position on."""
        if len(hashes) < size:
            return np.empty(0, np.uint64)
        powers, inverse = self.up_to(factor, len(hashes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:len(hashes)], dtype=np.uint64)])
        rolled = (sums[size:] - sums[:-size]) * inverse[:len(hashes) - size + 1]
        rolled = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(FACTORS[0])
        return rolled ^ (rolled >> np.uint64(29))

    def describe(self, text: str | None) -> dict:
        words = WORD.findall(text) if text else []
        anchors = np.empty(0, np.uint64)
        if len(words) >= WIDTH:
            anchors = self.stretches(self.hashes(words)[0], ANCHOR, FACTORS[0])
            anchors = anchors[anchor_places(len(words))]
        whole = " ".join(words).encode("utf-8", "surrogatepass")
        return {"n_words": len(words), "sequence": xxhash.xxh3_128_digest(whole), "whole": hashlib.sha256(whole).digest(),
                "anchors": anchors.astype(np.int64)}

    def windows(self, text: str, shared: list[int]) -> list[dict]:
        """Hashes of the windows that the shared anchors (their numbers) may lie in."""
        words = WORD.findall(text)
        first, second = self.hashes(words)
        one, two = self.stretches(first, WIDTH, FACTORS[1]), self.stretches(second, WIDTH, FACTORS[2])
        asked = np.zeros(len(one) + 1, np.int64)
        places = anchor_places(len(words))
        places = places[[n for n in shared if n < len(places)]]
        np.add.at(asked, np.minimum(np.maximum(places - (PERIOD - 1), 0), len(one)), 1)
        np.add.at(asked, np.minimum(places + 1, len(one)), -1)
        starts = np.flatnonzero(np.cumsum(asked[:-1]) > 0)
        return [{"one": a, "two": b, "start": s} for a, b, s in zip(
            one[starts].astype(np.int64).tolist(), two[starts].astype(np.int64).tolist(), starts.tolist())]


def anchor_places(words: int) -> np.ndarray:
    """Cover positions at which an anchor fits, ascending."""
    places = np.arange(max(words - ANCHOR + 1, 0))
    return places[np.isin(places % PERIOD, COVER)]


def without(text: str, starts: list[int]) -> dict:
    """The words of a text that no window from these starts covers; ``changed`` names its word sequence."""
    words = WORD.findall(text)
    steps = np.zeros(len(words) + 1, np.int64)
    places = np.unique(np.array(starts, np.int64))
    np.add.at(steps, places, 1)
    np.add.at(steps, places + WIDTH, -1)
    gone = np.cumsum(steps[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    kept = " ".join([w for w, g in zip(words, gone.tolist()) if not g]).encode("utf-8", "surrogatepass")
    whole = " ".join(words).encode("utf-8", "surrogatepass")
    return {"changed": xxhash.xxh3_128_digest(whole), "n_removed": int(gone.sum()), "kept": hashlib.sha256(kept).digest(),
            "runs": [{"first": int(a), "last": int(b) - 1} for a, b in edges.reshape(-1, 2)]}


RUNS = pa.list_(struct_of(first=pa.int64(), last=pa.int64()))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, runs, kept) for every row.

    ``runs`` are the removed words (first to last, from 0); ``kept`` is the SHA-256 of the others,
    joined by one space. :func:`kept_text` applies the runs to a text.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    look = per_value(spark, lambda: Roller().describe, "struct<n_words: bigint, sequence: binary, whole: binary, anchors: array<bigint>>",
                     struct_of(n_words=pa.int64(), sequence=pa.binary(), whole=pa.binary(), anchors=pa.list_(pa.int64())))
    described = cut(texts.select("id", look("text").alias("d")).select("id", "d.*"), "repeats-described")

    sound = described.where(F.col("id").isNotNull() & (F.col("n_words") >= WIDTH))
    leaders = cut(sound.groupBy("sequence").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("rows"))
                  .withColumnRenamed("sequence", "its"), "repeats-leaders")
    several = leaders.where(F.col("rows") > 1).select("its")
    first = (sieve(sound, "sequence", several, "left_semi").join(leaders, (F.col("sequence") == F.col("its")) & (F.col("id") == F.col("leader")))
             .select("id", "sequence", "anchors").dropDuplicates(["id", "sequence"]))
    own = sieve(sound, "sequence", several, "left_anti").select("id", "anchors").unionByName(first.select("id", "anchors"))
    holders = Window.partitionBy("anchor")
    marked = cut(own.select("id", F.posexplode("anchors").alias("n", "anchor"))
                 .select("id", "n", F.min("id").over(holders).alias("least"), F.max("id").over(holders).alias("most"))
                 .where(F.col("least") < F.col("most"))
                 .groupBy("id").agg(F.collect_set("n").alias("shared")).withColumnRenamed("id", "marked"), "repeats-marked")

    found = cut(sieve(texts.where(F.col("text").isNotNull()), "id", marked.select("marked"), "left_semi").repartition("id")
                .join(marked, F.col("id") == F.col("marked"))
                .select("id", "text", "shared").dropDuplicates(["id", "text"])
                .withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("text"))), "repeats-found")
    extend = per_value(spark, lambda: _extended(Roller()), "array<struct<one: bigint, two: bigint, start: int>>",
                       pa.list_(struct_of(one=pa.int64(), two=pa.int64(), start=pa.int32())))
    later = (found.select("id", "k", F.explode(extend(F.struct("text", "shared"))).alias("w")).select("id", "k", "w.*")
             .withColumn("least", F.min("id").over(Window.partitionBy("one", "two"))).where(F.col("id") > F.col("least"))
             .groupBy("id", "k").agg(F.collect_set("start").alias("starts")).withColumnRenamed("id", "later").withColumnRenamed("k", "its"))

    cut_out = per_value(spark, lambda: _cut_out, "struct<changed: binary, n_removed: bigint, kept: binary, runs: array<struct<first: bigint, last: bigint>>>",
                        struct_of(changed=pa.binary(), n_removed=pa.int64(), kept=pa.binary(), runs=RUNS))
    changed = cut(found.drop("shared").join(later, (F.col("id") == F.col("later")) & (F.col("k") == F.col("its")))
                  .select("later", cut_out(F.struct("text", "starts")).alias("c")).select("later", "c.*"), "repeats-changed")
    changed = changed.dropDuplicates(["later", "changed"])

    led = described.drop("anchors").join(leaders, F.col("sequence") == F.col("its"), "left").drop("its")
    out = led.join(changed, (F.col("id") == F.col("later")) & (F.col("sequence") == F.col("changed")), "left")
    twin = F.coalesce(F.col("id") > F.col("leader"), F.lit(False))
    all_gone = F.array(F.struct(F.lit(0).cast("bigint").alias("first"), (F.col("n_words") - 1).alias("last")))
    none_gone = F.array().cast("array<struct<first: bigint, last: bigint>>")
    return out.select(
        F.col("id").alias(id_col), "n_words",
        F.when(twin, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(twin, all_gone).otherwise(F.coalesce("runs", none_gone)).alias("runs"),
        F.when(twin, F.unhex(F.sha2(F.lit("").cast("binary"), 256))).otherwise(F.coalesce("kept", "whole")).alias("kept"))


def sieve(rows: DataFrame, column: str, values: DataFrame, how: str) -> DataFrame:
    """``rows`` whose ``column`` may be among ``values`` (one column): how "left_semi"; or surely is not: "left_anti".

    Every value sets one bit by its hash, of about ``SIEVE_SHARE`` bits a value; 64 bits are a row, and those rows are
    broadcast, so there are ``SIEVE_MOST`` bits at most. The more values beyond that, the more rows pass that
    are not among them; none that is gets lost.
    """
    size = min(max(64, 1 << (values.count() * SIEVE_SHARE).bit_length()), SIEVE_MOST)

    def place(name: str) -> tuple[Column, Column]:
        bit = F.xxhash64(name).bitwiseAND(F.lit(size - 1))
        return F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))

    (word, bit), (its_word, its_bit) = place(column), place(values.columns[0])
    words = values.select(its_word.alias("_word"), its_bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.join(F.broadcast(words), (word == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0), how)


def _extended(roller: Roller):
    return lambda row: roller.windows(row["text"], row["shared"])


def _cut_out(row: dict) -> dict:
    return without(row["text"], row["starts"])


def kept_text(spark):
    """Column function from a struct (text, runs) to the text's other words, joined by one space."""
    def rest(row: dict) -> str:
        gone = {n for run in row["runs"] or () for n in range(run["first"], run["last"] + 1)}
        return " ".join([w for n, w in enumerate(WORD.findall(row["text"] or "")) if n not in gone])

    return per_value(spark, lambda: rest, "string", pa.string())
