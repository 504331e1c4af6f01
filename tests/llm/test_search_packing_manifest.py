"""Lexical search, packing and the Merkle manifest against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from jobtide import session
from jobtide.llm import lexical_search as ls, merkle, packing

TOKENIZER = public_tokenizers.path(corpus_pipeline.VOCABULARY)


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


# lexical search


def plain_search(docs, items, k):
    """Rows (item place, item, rank, doc, score) by scoring everything."""
    docs = [(i, ls.terms_of(text)) for i, text in docs]
    docs = [(i, Counter(t), len(t)) for i, t in docs if t]
    count, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, terms, _ in docs for t in terms)
    rows = []
    for place, (item, text) in enumerate(items):
        scored = []
        for i, terms, n in docs:
            m = 10 + 90 * n * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * terms[t] // (1000 * terms[t] + 8 * m))
                        for t in set(ls.terms_of(text)) if t in terms)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(scored)[:k], 1):
            rows.append((item, rank, None if null else i, -score))
    return Counter(rows)


def found(spark, docs, items, k=10, **blocks):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in ls.search(docs, items, k, **blocks).collect())


def test_search_equals_scoring_everything(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{n}" for n in range(60)] + ["É", "ß", "x-y", "A1"]
    docs = [(n, " ".join(draw.choices(words, weights=[1 / (r + 1) for r in range(len(words))], k=draw.randrange(40)))) for n in range(400)]
    docs += [(1000 + n, docs[7][1]) for n in range(40)]  # a group of copies, so equal scores
    items = [(n, " ".join(draw.choices(words, k=draw.randrange(12)))) for n in range(30)]
    monkeypatch.setattr(ls, "BLOCK_DOCS", 8192)
    assert found(spark, docs, items) == plain_search(docs, items, 10)
    assert found(spark, docs, items, k=3, item_block_chars=200) == plain_search(docs, items, 3)


def test_small_blocks_hold_the_same_index(spark):
    draw = random.Random(4)
    docs = [(n, " ".join(draw.choices("abcdefghij", k=draw.randrange(1, 30)))) for n in range(300)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(2)
    totals = ls.totals(table)
    assert totals == (300, sum(len(t.split()) for _, t in docs))
    for block_docs, block_chars in ((16, 10**6), (8192, 200)):
        index = ls.build_index(table, *totals, block_docs=block_docs, block_chars=block_chars)
        rows = index.collect()
        assert len(rows) > 10 and sorted(i for r in rows for i in r.doc_ids) == list(range(300))
        terms = [("a", 7), ("d", 900), ("j", 3)]
        best = Counter((r.score, r.doc_id) for r in ls.best_of_tasks(index.coalesce(1), [(0, terms)], 300).collect())
        want = Counter()
        for i, text in docs:
            own, n = Counter(text.split()), len(text.split())
            score = sum(w * (10**9 * own[t] // (1000 * own[t] + 8 * (10 + 90 * n * 300 // totals[1]))) for t, w in terms if own[t])
            if score:
                want[(score, i)] += 1
        assert best == want


def test_readers_hold_one_index_block(spark):
    draw = random.Random(8)
    docs = [(n, " ".join(draw.choices("abcdefghij", k=draw.randrange(1, 30)))) for n in range(300)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    index = ls.build_index(table, *ls.totals(table), block_docs=16)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    rows = [g.row_group(n).num_rows for g in groups for n in range(g.num_row_groups)]
    assert len(rows) == -(-300 // 16) and set(rows) == {1}


def test_index_and_search_get_small_batches(spark, monkeypatch):
    seen, write = {}, ls.cut

    def cut(df, label, *options):
        seen[label] = spark.conf.get(session.ARROW_BYTES)
        return write(df, label, *options)

    before = spark.conf.get(session.ARROW_BYTES)
    monkeypatch.setattr(ls, "cut", cut)
    assert found(spark, [(1, "a b"), (2, "b c")], [(5, "c")]) == plain_search([(1, "a b"), (2, "b c")], [(5, "c")], 10)
    assert seen["lexical-index"] == seen["lexical-best"] == str(ls.BATCH_BYTES)
    assert seen["lexical-items"] == spark.conf.get(session.ARROW_BYTES) == before


def test_small_batches_end_at_their_size(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    table = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("x"), 1000).alias("text"))
    with session.small_batches(spark, 100_000):
        rows = session.cut(table.mapInArrow(sizes, "rows bigint, size bigint")).collect()
    assert sum(r.rows for r in rows) == 2000 and max(r.size for r in rows) < 200_000
    held = spark.conf.get(session.ARROW_BYTES)
    with pytest.raises(ValueError), session.small_batches(spark, 1):
        raise ValueError
    assert spark.conf.get(session.ARROW_BYTES) == held


def test_grid_paths_hold_every_cell():
    draw = np.random.default_rng(5)
    cells = np.unique(draw.integers(0, 50 * 40, 300))
    rows, columns, values = cells // 40, cells % 40, draw.integers(1, 1000, len(cells))
    treap = ls.Treap.of(rows, columns, values)
    every = np.arange(50)
    starts, nodes = np.zeros(1, np.int64), np.zeros((1, 50), np.int64)
    for level in range(treap.height):
        bounds = np.where(nodes >= 0, treap.maxima[level][nodes], 0)
        for start, bound in zip(starts, bounds):
            inside = (columns >= start) & (columns < start + (1 << treap.height - level))
            for row in every:
                own = values[inside & (rows == row)]
                assert bound[row] >= own.max(initial=0)
        left, right = treap.open(level, nodes, every)
        starts = np.concatenate([starts, starts + (1 << treap.height - 1 - level)])
        nodes = np.concatenate([left, right])
    grid = np.zeros((1 << treap.height, 50), int)
    grid[starts] = np.where(nodes >= 0, treap.maxima[-1][nodes], 0)
    want = np.zeros_like(grid)
    want[columns, rows] = values
    assert (grid == want).all()


def test_search_on_odd_rows(spark, odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, None), (2, ""), (3, "one TWO w5"), (3, "one TWO w5"), (None, "a b xyz"), (4, "nowhere")]
    assert found(spark, docs, items) == plain_search(docs, items, 10)
    assert not found(spark, [], items) and not found(spark, docs, []) and not found(spark, [(1, None)], items)


def test_search_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 9, 8)], "doc_id bigint, text string, score bigint, terms bigint")
    items = spark.createDataFrame([(5, "b", 7, 6)], "item_id bigint, text string, ask bigint, rank bigint")
    assert [(r.item_id, r.rank, r.doc_id) for r in ls.search(docs, items).collect()] == [(5, 1, 1)]


# packing


def check_packed(docs, rows, capacity):
    """Every piece once, sequences without gap or overlap; the number of sequences."""
    library = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            want[(i, n, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled: dict[int, list] = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_packing_holds_every_piece(spark, odd_docs):
    draw = random.Random(6)
    docs = [(n, " ".join(draw.choices(["alpha", "beta", "é", "gamma7", "xyzzyq"], k=draw.randrange(60)))) for n in range(500)]
    docs += [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id not in (5, 6)]
    for capacity in (2048, 64):
        packed = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), TOKENIZER, capacity).collect()
        sequences = check_packed(docs, packed, capacity)
        assert sequences <= 1.01 * sum(r.length for r in packed) / capacity + 1


def test_packing_on_odd_rows(spark, odd_docs):
    packed = packing.pack(odd_docs.withColumn("length", F.lit("x")).withColumn("nth", F.lit(1)), TOKENIZER, keep_ids=True).collect()
    check_packed([(r.doc_id, r.text) for r in odd_docs.collect()], packed, packing.CAPACITY)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in packed)
    assert [r.length for r in packed if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert packing.pack(odd_docs.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("shape", ["few", "even", "short", "long", "one"])
def test_plans_use_each_piece_once(shape):
    draw = np.random.default_rng(7)
    lengths = {"few": draw.integers(1, 2049, 20), "even": draw.integers(1, 2049, 40_000), "short": draw.integers(1, 90, 40_000),
               "long": draw.integers(1200, 2049, 5000), "one": np.full(1000, 700)}[shape]
    histogram = Counter(lengths.tolist())
    planned = packing.plan(histogram)
    used, sequences = Counter(), sum(repeat for repeat, _ in planned)
    for repeat, own in planned:
        assert repeat > 0 and sum(length * copies for length, copies in own.items()) <= packing.CAPACITY
        for length, copies in own.items():
            used[length] += repeat * copies
    assert used == histogram
    least = {"long": 5000, "one": 500}.get(shape) or -(-int(lengths.sum()) // packing.CAPACITY)
    assert sequences <= 1.01 * least + 1
    rows = packing.ranges(planned)
    assert (np.diff((rows[:, 0] << 48) + rows[:, 1]) > 0).all()


def test_fit_finds_known_counts():
    histogram = np.zeros(2049)
    for (a, b, c), repeat in {(1000, 500, 548): 300, (2000, 48, 0): 70, (1024, 1024, 0): 10}.items():
        for length in (a, b, c):
            histogram[length] += repeat if length else 0
    patterns = packing.patterns_of(histogram.astype(int), 2048)
    assert (patterns.sum(axis=1) == 2048).all()
    chosen, x = packing.fit(patterns, histogram)
    use = np.bincount(patterns[chosen].ravel(), np.repeat(x, 3), 2049)
    use[0] = 0
    assert np.abs(use - histogram).max() < 1


# Merkle manifest


def plain_manifest(rows):
    """Digests of all rows by building each tree in memory."""
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def climb(digests):
        """Root and each leaf's (left, right) pairs."""
        steps, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for leaf, pos in enumerate(at):
                run = digests[pos // 16 * 16: pos // 16 * 16 + 16]
                steps[leaf].append(("".join(run[:pos % 16]), "".join(run[pos % 16 + 1:])))
            digests, at = [h(*digests[i:i + 16]) for i in range(0, len(digests), 16)], [pos // 16 for pos in at]
        return digests[0], steps

    sources: dict = {}
    for i, text, lang, source, n in rows:
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf = h(*map(field, (i, source, lang, n, text)))
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        sources.setdefault(source, []).append((i is not None, i or 0, leaf, h(*map(field, (i, source, lang, n, low))) if hit else leaf))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([leaf for *_, leaf, _ in sorted(sources[s])]) for s in names}
    root, top = climb([trees[s][0] for s in names]) if names else (None, [])
    found = Counter()
    for s, above in zip(names, top):
        for (real, i, leaf, seen), steps in zip(sorted(sources[s]), trees[s][1]):
            steps, folded = steps + above, seen
            for left, right in steps:
                folded = h(left, folded, right)
            found[(i if real else None, leaf, trees[s][0], root, h(*[p for pair in steps for p in pair]), folded, folded == root)] += 1
    return found


def manifest(docs):
    rows = merkle.manifest(docs).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("segments").alias("proof"), "folded_root").collect()
    return Counter((*r, r.folded_root == r.root) for r in rows)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 1], [300, 1, 5, 33], [2] * 20])
def test_manifest_equals_trees_in_memory(spark, make_docs, sizes):
    rows, names = [], [None, "", "b", "é", "B", "a/1", *[f"s{n}" for n in range(20)]]
    for n, size in enumerate(sizes):
        rows += [(len(rows) + k, f"Text {k % 7} Of É", "en", names[n], k) for k in range(size)]
    random.Random(8).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = manifest(docs)
    assert got == plain_manifest(rows)
    assert {key[0] for key in got if not key[-1]} <= {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}


def test_manifest_on_odd_rows(odd_docs):
    assert manifest(odd_docs.withColumn("tree", F.lit(1)).withColumn("pos", F.lit(2))) == plain_manifest([tuple(r) for r in odd_docs.collect()])
    assert merkle.manifest(odd_docs.limit(0)).count() == 0
