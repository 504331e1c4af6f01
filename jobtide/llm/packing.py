"""Best-fit packing: repeat counts of length patterns by non-negative least squares.

Documents are encoded, ended by a separator id and cut into pieces of at most ``CAPACITY`` tokens. How
the pieces fill sequences depends on their lengths alone, so the plan is made from the histogram of
lengths, which has at most CAPACITY numbers however many documents there are:

1. patterns of up to three lengths that sum to CAPACITY exactly are enumerated;
2. non-negative least squares fits the patterns' repeat counts to the histogram;
3. counts are rounded down, and further where they ask for more pieces than there are;
4. the residual histogram is packed best-fit, longest first: the longest piece left, then again and again the
   longest that still fits; such a pattern is repeated as often as its lengths allow.

A pattern with a repeat count takes a range of the numbers that the pieces of a length have. So a piece finds its
sequence and its place in it from its number within its length: no sequence is gathered anywhere.
Step 4 uses up a length with every few patterns, so the plan has a bounded number of rows, too.

Rows: a null or empty text is one piece that holds the separator only. Repeated rows and equal or null ids are packed
each by itself. An empty table has no rows. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from jobtide.llm.bpe import ID, TextEncoder, load_vocabulary
from jobtide.llm.common import per_chunk, struct_of, worker_state
from jobtide.operators.ordered import number_rows
from jobtide.session import cut, ship_package

CAPACITY = 2048
SEPARATOR = 0
ROUNDS, STEPS = 40, 60  # of the fit: times that patterns are added, and steps after each
PIECES = "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint, ids: array<int>>>"
PIECE_KIND = pa.list_(struct_of(piece=pa.int32(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64(), ids=pa.list_(pa.int32())))
PLACE = "struct<sequence_id: bigint, offset: bigint>"


class LibraryEncoder(TextEncoder):
    """Splits texts into words as :class:`TextEncoder`; the tokenizer library's model encodes the words that are new."""

    def __init__(self, vocabulary: dict, spec: str):
        super().__init__(vocabulary)
        self.library = Tokenizer(Tokenizer.from_str(spec).model)  # words come normalised and split, as byte symbols

    def ids_of(self, words: list[str]) -> list[bytes]:
        found = self.library.encode(self.symbols_of(words), is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words) + 1)) * ID.itemsize
        flat, ends = np.array(found.ids, ID).tobytes(), ends.tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]


def pieces_of(ids: np.ndarray, capacity: int, keep_ids: bool) -> list[dict]:
    """The pieces of a document's ids, which end with the separator."""
    ids = np.append(ids, ID.type(SEPARATOR))
    parts = [ids[i:i + capacity] for i in range(0, len(ids), capacity)]
    return [{"piece": n, "start": n * capacity, "length": len(part), "ids_crc32": crc32(part.tobytes()),
             "ids": part if keep_ids else None} for n, part in enumerate(parts)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids) of each document's pieces; ``ids`` is null unless asked for."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    spark, key = docs.sparkSession, uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((load_vocabulary(tokenizer), spec))  # a few MB

    def make():
        encoder = worker_state(key, lambda: LibraryEncoder(*shared.value))
        return lambda texts: [pieces_of(ids, capacity, keep_ids) for ids in encoder.encode([text or "" for text in texts])]

    found = per_chunk(spark, make, PIECES, PIECE_KIND, key)
    return docs.select(F.col(id_col), found(F.col(text_col)).alias("pieces")).select(F.col(id_col), F.inline("pieces"))


def patterns_of(counts: np.ndarray, capacity: int) -> np.ndarray:
    """(patterns, 3) lengths that sum to the capacity, of lengths that occur; 0 stands for no piece."""
    have = counts > 0
    have[0] = True
    lengths = np.flatnonzero(have)
    found = []
    for a in lengths.tolist():
        b = lengths[(lengths >= a) & (a + 2 * lengths <= capacity)]
        c = capacity - a - b
        ok = have[c]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(found)


def fit(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares: (pattern numbers, repeat counts) whose use of each length comes near ``counts``.

    A length's miss weighs by the length, so long pieces are placed first. As in an active-set method, the patterns
    with the steepest descent join, here several at a time that share no length; the patterns that take
    part are then fitted by accelerated projected gradient steps.
    """
    size = len(counts)
    weight = np.arange(size) / (size - 1.0)
    chosen, x = np.zeros(0, np.int64), np.zeros(0)
    taken = np.zeros(len(patterns), bool)

    def used(own: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(own.ravel(), np.repeat(x, 3), size)

    for _ in range(ROUNDS):
        miss = weight * (counts - used(patterns[chosen], x))
        miss[0] = 0.0
        slope = miss[patterns].sum(axis=1)
        slope[taken] = 0.0
        best = np.argsort(-slope, kind="stable")[:4 * size]
        best = best[slope[best] > 1e-9]
        busy, fresh = {0: False}, []
        for n, lengths in zip(best.tolist(), patterns[best].tolist()):
            if not any(busy.get(length) for length in lengths):
                fresh.append(n)
                busy.update((length, length > 0) for length in lengths)
        if not fresh:
            break
        taken[fresh] = True
        chosen, x = np.concatenate([chosen, np.array(fresh, np.int64)]), np.concatenate([x, np.zeros(len(fresh))])
        own = patterns[chosen]
        share = np.bincount(own.ravel(), minlength=size).astype(float)  # patterns that a length is in
        step = 1.0 / np.maximum((weight * share)[own].sum(axis=1), 1e-9)
        ahead, speed = x, 1.0
        for _ in range(STEPS):
            miss = weight * (counts - used(own, ahead))
            miss[0] = 0.0
            new = np.maximum(0.0, ahead + step * miss[own].sum(axis=1))
            faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
            ahead, x, speed = new + (speed - 1) / faster * (new - x), new, faster
            ahead = np.maximum(0.0, ahead)
        some = x > 1e-6
        taken[chosen[~some]] = False
        chosen, x = chosen[some], x[some]
    return chosen, x


def best_fit(left: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(repeat count, {length: copies}) until nothing of the histogram is left; uses ``left`` up."""
    capacity, found = len(left) - 1, []
    left = left.tolist()
    mask = sum(1 << n for n, count in enumerate(left) if n and count)
    while mask:
        room, own, open_ = capacity, {}, mask
        while (fitting := open_ & ((1 << room + 1) - 1)) and room:
            length = fitting.bit_length() - 1
            own[length] = min(room // length, left[length])
            room -= own[length] * length
            open_ &= ~(1 << length)
        repeat = min(left[length] // copies for length, copies in own.items())
        for length, copies in own.items():
            left[length] -= repeat * copies
            if not left[length]:
                mask &= ~(1 << length)
        found.append((repeat, own))
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(repeat count, {length: copies}) of the patterns that hold every piece of the histogram exactly once."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        counts[length] = count
    patterns, left, found = patterns_of(counts, capacity), counts.copy(), []
    chosen, x = fit(patterns, counts.astype(float))
    for n in np.argsort(-x, kind="stable"):
        own: dict[int, int] = {}
        for length in patterns[chosen[n]].tolist():
            if length:
                own[length] = own.get(length, 0) + 1
        repeat = min(int(x[n]), *[int(left[length]) // copies for length, copies in own.items()])
        if repeat > 0:
            for length, copies in own.items():
                left[length] -= repeat * copies
            found.append((repeat, own))
    return found + best_fit(left)


def ranges(planned: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first number, first sequence, copies, offset), by length and number."""
    rows, numbers, sequences = [], {}, 0
    for repeat, own in planned:
        offset = 0
        for length, copies in own.items():
            rows.append((length, numbers.get(length, 0), sequences, copies, offset))
            numbers[length] = numbers.get(length, 0) + repeat * copies
            offset += length * copies
        sequences += repeat
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def placing(spark: SparkSession, planned: list[tuple[int, dict[int, int]]]) -> Callable[..., Column]:
    """A column function from a piece's length and its number within the length (from 0) to its sequence and offset."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(ranges(planned))

    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        lengths, firsts, sequences, copies, offsets = shared.value.T
        own, at = length.to_numpy(), number.to_numpy()
        row = np.searchsorted((lengths << 48) + firsts, (own << 48) + at, "right") - 1
        nth = at - firsts[row]
        return pa.StructArray.from_arrays(
            [pa.array(sequences[row] + nth // copies[row]), pa.array(offsets[row] + nth % copies[row] * own)], ["sequence_id", "offset"])

    place.__annotations__ = {"length": pa.Array, "number": pa.Array, "return": pa.Array}
    return F.arrow_udf(place, PLACE)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids, sequence_id, offset) for every piece of every document."""
    spark = docs.sparkSession
    found = cut(pieces(docs, tokenizer, capacity, keep_ids, id_col, text_col), "packing-pieces")
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a length
    numbered = number_rows(found, ["length"], [id_col, "piece", "ids_crc32"], out="nth")
    place = placing(spark, plan(histogram, capacity))
    return numbered.withColumn("place", place("length", F.col("nth") - 1)).select(*found.columns, "place.sequence_id", "place.offset")
