"""Ranked lexical search: a K2-treap over each block's grid of terms and documents.

A block is a stretch of one partition's rows, sorted by document id. Its grid has a row per term and a column
per document; a cell holds the term's impact in the document. The grid is a quadtree without its empty parts: a
node of each level has four bits that say which quarters hold anything, and the largest impact inside.
The nodes of a level lie in Z-order, so the children of a node are found by counting bits before its own. Rows go
by falling document frequency, which keeps frequent terms, and so the filled cells, together. The written index has
the bits and the impacts of the filled cells; the largest impacts above them are taken again when a block is read.

An item's terms are rows. Their paths go down side by side over halves of the document range: the weighted sum of
the maxima on the paths bounds the score of every document in the range. Ranges are opened best first (some at a
time), until no range left can enter the best ``k``; a range of one document has its exact score. A task goes on
with the best it has from block to block, so later blocks are mostly cut off at their upper levels.

The impact of a term apart from its weight needs corpus totals only (two numbers), so the index is built in one
pass after they are counted; weights come from document frequencies that the index itself holds. All
sums are integers below 2^63 for weights up to 10^5 and items up to 10^7 terms.

Items are a query set: they are asked in blocks of bounded size against the whole index, one pass a block.

Rows: a null or blank text has no terms and is never found; an item without terms, or whose terms occur
nowhere, has no result. Documents or items that repeat are found and asked each by itself; equal scores go by
document id, null ids last. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from jobtide.llm.common import lower_ascii
from jobtide.session import cut, ship_package, small_batches

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = re.compile(TERM_PATTERN)
UNIT = 1_000_000_000
BLOCK_DOCS, BLOCK_CHARS = 8192, 8_000_000  # of an index block, unless one text has more
ITEM_BLOCK_CHARS = 4_000_000               # of the items asked in one pass
BATCH_BYTES = 2 << 20                      # of rows handed to Python at once, unless one has more
ROW_ALONE = {"parquet.block.row.count.limit": "1"}  # readers hold a row group, so a block is one
AT_ONCE = 64                               # ranges opened in one step
LAST_ID = np.iinfo(np.int64).max           # sorts null ids last
INDEX = "doc_ids array<bigint>, terms array<string>, term_docs array<int>, bits array<binary>, impacts binary"
INDEX_KIND = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("term_docs", pa.list_(pa.int32())),
                        ("bits", pa.list_(pa.binary())), ("impacts", pa.binary())])
BITS_SET = np.array([n.bit_count() for n in range(16)], np.int32)


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(lower_ascii(text)) if text else []


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, terms of all documents with repeats)."""
    found = docs.select(F.regexp_count(F.col(text_col), F.lit(TERM_PATTERN)).alias("n")).agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return found["docs"], found["terms"]


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term that occurs ``tf`` times among ``n`` adds to a score, apart from its weight."""
    m = 10 + (90 * n * docs) // terms
    return (UNIT * tf) // (1000 * tf + 8 * m)


# The grid


def z_order(rows: np.ndarray, columns: np.ndarray, height: int) -> np.ndarray:
    """The bits of row and column in turn, the row's first."""
    code = np.zeros(len(rows), np.int64)
    for bit in range(height):
        code |= ((columns >> bit & 1) << 2 * bit) | ((rows >> bit & 1) << 2 * bit + 1)
    return code


def quarters(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each level's nodes, root first, the bits of their quarters; the values in Z-order."""
    height = max(1, int(max(rows.max(), columns.max())).bit_length())
    codes = z_order(rows, columns, height)
    order = np.argsort(codes, kind="stable")
    codes, values = codes[order], values[order]
    bits = []
    for _ in range(height):
        first = np.flatnonzero(np.r_[True, codes[1:] >> 2 != codes[:-1] >> 2])
        bits.append(np.bitwise_or.reduceat(1 << (codes & 3), first).astype(np.uint8))
        codes = codes[first] >> 2
    return bits[::-1], values


class Treap:
    """Levels of a quadtree, root first: of each node the bits of its quarters, and its largest impact."""

    def __init__(self, bits: list[np.ndarray], values: np.ndarray):
        self.bits, self.height = bits, len(bits)
        counts = [BITS_SET[b] for b in bits]
        self.before = [np.cumsum(c, dtype=np.int32) - c for c in counts]  # children of the nodes before each
        maxima = [values]
        for before in reversed(self.before):
            maxima.append(np.maximum.reduceat(maxima[-1], before))
        self.maxima = maxima[::-1]

    @staticmethod
    def of(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> Treap:
        return Treap(*quarters(rows, columns, values))

    def open(self, level: int, nodes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the two column halves under ``nodes`` (ranges x rows; -1: empty) on the paths of ``rows``."""
        there = nodes >= 0
        at = np.where(there, nodes, 0)
        bits, before = self.bits[level][at], self.before[level][at]
        quarter = (rows >> self.height - 1 - level & 1) * 2
        halves = []
        for half in (0, 1):
            slot = quarter + half
            inside = there & (bits >> slot & 1 == 1)
            halves.append(np.where(inside, before + BITS_SET[bits & ((1 << slot) - 1)], -1))
        return halves[0], halves[1]

    def bounds(self, level: int, nodes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.where(nodes >= 0, self.maxima[level][nodes], 0) @ weights


def index_block(ids: list, texts: list[pa.Array], docs: int, terms: int) -> dict | None:
    """One block's row of the index; None if its documents have no terms."""
    order = sorted((n for n, found in enumerate(texts) if len(found)), key=lambda n: LAST_ID if ids[n] is None else ids[n])
    if not order:
        return None
    sizes = np.array([len(texts[n]) for n in order], np.int64)
    words = pa.concat_arrays([texts[n] for n in order]).dictionary_encode()
    cell = words.indices.to_numpy().astype(np.int64) * len(order)
    words = words.dictionary  # here and below, what is not needed any more is let go of
    cell += np.repeat(np.arange(len(order)), sizes)
    cell, tf = np.unique(cell, return_counts=True)
    term, column = cell // len(order), cell % len(order)
    del cell
    frequency = np.bincount(term, minlength=len(words))
    by_frequency = np.argsort(-frequency, kind="stable")
    row = np.empty(len(by_frequency), np.int64)
    row[by_frequency] = np.arange(len(by_frequency))
    values = impacts(tf.astype(np.int64), sizes[column], docs, terms).astype("<u4")
    del tf
    bits, values = quarters(row[term], column, values)
    return {"doc_ids": [ids[n] for n in order], "terms": words.take(pa.array(by_frequency)),
            "term_docs": frequency[by_frequency].astype(np.int32), "bits": [b.tobytes() for b in bits],
            "impacts": values.tobytes()}


def build_index(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text",
                block_docs: int = BLOCK_DOCS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The index of all documents, written: one row per block. The totals are those of :func:`totals`."""
    ship_package(docs.sparkSession)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, chars = [], [], 0

        def row() -> Iterator[pa.RecordBatch]:
            found = index_block(ids, texts, n_docs, n_terms) if n_terms else None
            if found:
                yield pa.RecordBatch.from_pylist([{**found, "terms": None}], INDEX_KIND).set_column(
                    1, "terms", pa.ListArray.from_arrays([0, len(found["terms"])], found["terms"]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if ids and (len(ids) == block_docs or chars + len(text) > block_chars):
                    yield from row()
                    ids, texts, chars = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(pa.array(terms_of(text), pa.string()))
                chars += len(text)
        if ids:
            yield from row()

    with small_batches(docs.sparkSession, BATCH_BYTES):
        return cut(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(blocks, INDEX), "lexical-index", ROW_ALONE)


# Questions


class Asked:
    """An item's terms with weights, and the best documents found so far."""

    def __init__(self, terms: list[tuple[str, int]], k: int):
        self.terms, self.k = [t for t in terms if t[1] > 0], k
        self.best: list[tuple[int, int, int | None]] = []  # (score, id to sort by, id), best first

    def may_enter(self, bounds: np.ndarray, first_ids: np.ndarray) -> np.ndarray:
        """Which ranges, by bound and least id, may hold a document that belongs to the best."""
        if len(self.best) < self.k:
            return bounds > 0
        score, last, _ = self.best[-1]
        return (bounds > score) | ((bounds == score) & (first_ids < last))

    def add(self, scores: np.ndarray, sort_ids: np.ndarray, ids: list) -> None:
        found = self.best + [(s, i, own) for s, i, own in zip(scores.tolist(), sort_ids.tolist(), ids)]
        self.best = nsmallest(self.k, found, key=lambda f: (-f[0], f[1]))

    def search(self, treap: Treap, rows: np.ndarray, weights: np.ndarray, doc_ids: list, sort_ids: np.ndarray) -> None:
        """Goes through a block's documents, the most promising ranges first."""
        height = treap.height
        # open ranges by level: first columns, nodes on the paths, bounds
        start = np.zeros((1, len(rows)), np.int64)
        pool = {0: (np.zeros(1, np.int64), start, treap.bounds(0, start, weights))}
        top = {0: (int(pool[0][2][0]), 0)}
        while pool:
            level = max(top, key=top.__getitem__)
            columns, nodes, bounds = pool.pop(level)
            del top[level]
            good = self.may_enter(bounds, sort_ids[columns])
            columns, nodes, bounds = columns[good], nodes[good], bounds[good]
            if len(columns) > AT_ONCE:
                order = np.lexsort((columns, -bounds))
                later = order[AT_ONCE:]
                pool[level], top[level] = (columns[later], nodes[later], bounds[later]), (int(bounds[later[0]]), level)
                now = order[:AT_ONCE]
                columns, nodes, bounds = columns[now], nodes[now], bounds[now]
            if not len(columns):
                continue
            if level == height:
                self.add(bounds, sort_ids[columns], [doc_ids[c] for c in columns.tolist()])
                continue
            halves = treap.open(level, nodes, rows)
            columns = np.concatenate([columns, columns + (1 << height - 1 - level)])
            nodes = np.concatenate(halves)
            bounds = treap.bounds(level + 1, nodes, weights)
            some = np.flatnonzero(bounds > 0)
            some = some[self.may_enter(bounds[some], sort_ids[columns[some]])]
            if len(some):
                more = (columns[some], nodes[some], bounds[some])
                held = pool.get(level + 1)
                pool[level + 1] = tuple(np.concatenate(pair) for pair in zip(held, more)) if held else more
                top[level + 1] = (int(pool[level + 1][2].max()), level + 1)


def weighted_items(items: DataFrame, index: DataFrame, n_docs: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, ask, terms, chars): the terms of each item with their weights; written, as each is read more than once."""
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM_PATTERN), F.lit(0)))
    numbered = items.select(F.col(item_col).alias("item_id"), F.monotonically_increasing_id().alias("ask"), own.alias("own"))
    asked = cut(numbered.select("item_id", "ask", F.explode("own").alias("term")), "lexical-items")
    held = index.select(F.posexplode("terms").alias("place", "term"), "term_docs").select("term", F.col("term_docs")[F.col("place")].alias("term_docs"))
    frequency = (held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("term_docs").alias("df")))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    return cut(asked.join(frequency, "term").groupBy("ask", "item_id").agg(
        F.array_sort(F.collect_list(F.struct("term", weight.alias("weight")))).alias("terms")).withColumn(
        "chars", F.aggregate("terms", F.lit(0).cast("bigint"), lambda n, t: n + F.length(t["term"]) + 16)), "lexical-weights")


def best_of_tasks(index: DataFrame, items: list[tuple[int, list[tuple[str, int]]]], k: int) -> DataFrame:
    """(ask, score, doc_id): the best documents of each task for each of the items, which go to the tasks whole."""
    spark: SparkSession = index.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(items)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(n, Asked(terms, k)) for n, terms in shared.value]
        vocabulary = pa.array(sorted({term for _, a in asked for term, _ in a.terms}), pa.string())
        number = {term: n for n, term in enumerate(vocabulary.to_pylist())}
        questions = [(a, np.array([number[t] for t, _ in a.terms], np.int64), np.array([w for _, w in a.terms], np.int64)) for _, a in asked]

        def ask(doc_ids: pa.Scalar, terms: pa.Scalar, bits: pa.Scalar, values: pa.Scalar) -> None:
            doc_ids = doc_ids.as_py()
            sort_ids = np.array([LAST_ID if i is None else i for i in doc_ids], np.int64)
            treap = Treap([np.frombuffer(b, np.uint8) for b in bits.as_py()], np.frombuffer(values.as_py(), "<u4"))
            place = pc.index_in(vocabulary, value_set=terms.values).fill_null(-1).to_numpy()
            for a, own, weights in questions:
                rows = place[own] if len(own) else own
                here = rows >= 0
                if here.any():
                    a.search(treap, rows[here].astype(np.int64), weights[here], doc_ids, sort_ids)

        for batch in batches:
            for n in range(batch.num_rows):
                ask(*(column[n] for column in batch.columns))
        rows = [(n, score, own) for n, a in asked for score, _, own in a.best]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["ask", "score", "doc_id"])

    return index.select("doc_ids", "terms", "bits", "impacts").mapInArrow(run, "ask bigint, score bigint, doc_id bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", item_block_chars: int = ITEM_BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, by score and then id."""
    n_docs, n_terms = totals(docs, text_col)
    index = build_index(docs, n_docs, n_terms, id_col, text_col)
    weighted = weighted_items(items, index, n_docs, item_col, item_text_col)
    total = weighted.agg(F.sum("chars")).first()[0] or 0
    blocks = max(1, -(-total // item_block_chars))
    found = None
    for n in range(blocks):
        part = weighted.where(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == n)
        own = [(r["ask"], [tuple(t) for t in r["terms"]]) for r in part.select("ask", "terms").collect()]
        with small_batches(docs.sparkSession, BATCH_BYTES):
            best = cut(best_of_tasks(index, own, k), "lexical-best")
        found = best if found is None else found.unionByName(best)
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(weighted.select("ask", "item_id"), "ask").select("item_id", "rank", "doc_id", "score")
