"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidate edges.

A document's set are its distinct shingles of ``k`` words. One hash function deals the set to bins;
the least value of each bin is the sketch, and an empty bin takes the value of a filled one chosen
by a second, universal hash of (bin, attempt), which is the densification of least variance. Bands
of the sketch make buckets. Equal sets are folded into one node first, so copies cost nothing later.

1. In each bucket every node is linked to the bucket's least node only (a star), so candidates
   grow with the rows, not with pairs. Candidates are confirmed on the full sets.
2. A star can miss a link between two nodes that are both too far from its centre. So buckets whose
   members are still in several groups are looked at again. Of small ones (``SMALL`` members at
   most, hence at most that many partners a row) members of different groups are paired. Large ones
   are joined to families; the nodes outside the family's largest group are a query set that is
   compared with the whole family, block by block, and only links that are found leave a task.
3. Groups are the connected components of the confirmed links, by repeated contraction to the
   least neighbour, written after every round.

Bands are set so that a pair just at the threshold shares none with probability below 1e-6
(:func:`bands_for`). Sets are counted and named by 128-bit shingle hashes of the whole text, in two lanes of 64
bits that are hashed apart. Pairs are compared on the first lane, 8 bytes a shingle, which halves what is written
and moved: two texts of a million words have odds of about 1 in 10^7 that one shingle counts as shared wrongly.

Rows: null and empty texts, and texts without words, have empty sets and are linked with nothing.
A text of fewer than ``k`` words has one shingle, all its words. Rows with equal sets are one group,
whatever their ids; repeated rows are both returned. Null ids take part but never name a group: a
group of null ids only has a null one and each row of it counts as kept. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtide.llm.common import WORD, fresh_names, lower_ascii, per_value, struct_of
from jobtide.operators.lookup import lookup_join
from jobtide.session import cut

SMALL = 64
BLOCK = 256
KNOWN_WORDS = 200_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def bands_for(share: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows) within ``most`` bins: the most rows with a miss chance below 1e-6 at the threshold."""
    for rows in range(8, 0, -1):
        bands = most // rows
        if (1 - share ** rows) ** bands < 1e-6:
            return bands, rows
    return most, 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[1]
    x = (x ^ (x >> np.uint64(29))) * MIX[2]
    return x ^ (x >> np.uint64(32))


class Sketcher:
    """Sets, fingerprints and band hashes of texts."""

    def __init__(self, k: int, bands: int, rows: int):
        self.k, self.bands, self.rows = k, bands, rows
        self.bins = bands * rows
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        value = self.known[word] = xxhash.xxh3_128_digest(word)
        return value

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct shingle hashes, ascending; a column each, a row for either lane."""
        words = WORD.findall(lower_ascii(text)) if text else []
        if not words:
            return np.empty((2, 0), np.uint64)
        known = self.known
        hashes = np.frombuffer(b"".join([known.get(w) or self.word(w) for w in words]), "<u8").reshape(-1, 2).T.copy()
        size = min(self.k, len(words))
        rolled = np.full((2, len(words) - size + 1), size, np.uint64)
        for n in range(size):
            rolled = mixed(rolled * MIX[0] + hashes[:, n:len(words) - size + 1 + n])
        return distinct(rolled)

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """One value a bin; empty bins borrow from a filled bin by universal hashing."""
        spread = mixed((shingles[0] + np.uint64(1)) * MIX[0])
        at = ((spread >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        values = np.full(self.bins, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(values, at, mixed(spread))
        filled = np.zeros(self.bins, bool)
        filled[at] = True
        empty, attempt = np.flatnonzero(~filled), 1
        while len(empty):
            asked = mixed(mixed(empty.astype(np.uint64) + MIX[1]) + np.array([attempt], np.uint64) * MIX[0])
            donor = ((asked >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
            usable = filled[donor]
            values[empty[usable]] = values[donor[usable]]
            empty, attempt = empty[~usable], attempt + 1
        return values

    def describe(self, text: str | None) -> dict:
        shingles = self.shingles(text)
        if not shingles.size:
            return {"n": 0, "node": None, "bands": None}
        values = self.sketch(shingles).reshape(self.bands, self.rows)
        rolled = np.arange(1, self.bands + 1).astype(np.uint64)
        for column in values.T:
            rolled = mixed(rolled * MIX[0] + column)
        return {"n": shingles.shape[1], "node": xxhash.xxh3_128_digest(shingles.tobytes()), "bands": rolled.astype(np.int64)}

    def packed(self, text: str | None) -> dict:
        """The whole set, eight bytes a shingle, with its node."""
        shingles = self.shingles(text)
        return {"node": xxhash.xxh3_128_digest(shingles.tobytes()), "shingles": np.unique(shingles[0]).tobytes()}


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The distinct columns, ascending by the first lane, then the second."""
    out = hashes[:, np.argsort(hashes[0])]
    same = out[0, 1:] == out[0, :-1]
    if (same & (out[1, 1:] != out[1, :-1])).any():
        out = hashes[:, np.lexsort((hashes[1], hashes[0]))]
        same = (out[:, 1:] == out[:, :-1]).all(axis=0)
    return np.ascontiguousarray(out[:, np.concatenate(([True], ~same))])


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending sets share."""
    if a.size > b.size:
        a, b = b, a
    if not a.size:
        return 0
    at = np.searchsorted(b, a)
    at[at == b.size] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = common(a, b)
    return 100 * both >= percent * (a.size + b.size - both)


def similar_sizes(a: str, b: str, percent: int):
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


class NearDuplicates:
    """One run over a table: ``described`` has a row a document, ``roots`` a row a linked node."""

    def __init__(self, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str):
        self.spark, self.percent = docs.sparkSession, percent
        self.bands, self.rows = bands_for(percent / 100)
        self.k = k
        self.texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.described = cut(self.texts.select("id", self.describe()("text").alias("d"))
                             .select("id", "d.n", "d.node", "d.bands"), "near-described")
        whole = self.described.where(F.col("node").isNotNull())
        self.nodes = cut(whole.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-nodes")
        self.roots = self.groups()

    def describe(self):
        k, bands, rows = self.k, self.bands, self.rows
        return per_value(self.spark, lambda: Sketcher(k, bands, rows).describe,
                         "struct<n: bigint, node: binary, bands: array<bigint>>",
                         struct_of(n=pa.int64(), node=pa.binary(), bands=pa.list_(pa.int64())))

    def groups(self) -> DataFrame:
        """(node, root) of the nodes that have links."""
        spread = self.nodes.select("node", "n", F.explode("bands").alias("bucket"))
        shared = (spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("hub"))
                  .where(F.col("size") > 1).withColumnRenamed("bucket", "of"))
        members = cut(spread.join(shared, F.col("bucket") == F.col("of")).select(
            "bucket", "size", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "near-members")
        sets = cut(self.sets_of(members.select("node").distinct()), "near-sets")
        stars = (members.where((F.col("node") != F.col("hub")) & similar_sizes("n", "hub_n", self.percent))
                 .select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
        links = cut(self.confirmed(stars, sets), "near-links")
        roots = components(links)
        labelled = cut(members.join(roots.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left").select(
            "bucket", "size", "node", "n", "hub", F.coalesce("root", "node").alias("root")), "near-labelled")
        split = (labelled.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"))
                 .where(F.col("least") != F.col("most")).select(F.col("bucket").alias("of")))
        again = cut(labelled.join(split, F.col("bucket") == F.col("of")).drop("of"), "near-again")
        more = self.confirmed(self.small_pairs(again), sets).unionByName(self.large_links(again, sets))
        return components(cut(more, "near-more-links"), roots)

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes, each from one document that has it."""
        k, bands, rows = self.k, self.bands, self.rows
        pack = per_value(self.spark, lambda: Sketcher(k, bands, rows).packed, "struct<node: binary, shingles: binary>",
                         struct_of(node=pa.binary(), shingles=pa.binary()))
        ids = (self.nodes.join(wanted.withColumnRenamed("node", "asked"), F.col("node") == F.col("asked"), "left_semi")
               .select(F.col("id").alias("wanted_id"), F.col("node").alias("wanted_node")))
        found = (self.texts.join(ids, F.col("id").eqNullSafe(F.col("wanted_id")))
                 .select("wanted_node", pack("text").alias("p")).where(F.col("wanted_node") == F.col("p.node")))
        return found.groupBy(F.col("wanted_node").alias("node")).agg(F.first("p.shingles").alias("shingles"))

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the candidate pairs (a, b) whose full sets are similar enough."""
        percent = self.percent
        one = sets.select(F.col("node").alias("node_a"), F.col("shingles").alias("set_a"))
        two = sets.select(F.col("node").alias("node_b"), F.col("shingles").alias("set_b"))
        check = per_value(self.spark, lambda: lambda pair: linked(unpacked(pair["set_a"]), unpacked(pair["set_b"]), percent),
                          "boolean", pa.bool_())
        both = pairs.join(one, F.col("a") == F.col("node_a")).join(two, F.col("b") == F.col("node_b"))
        return both.select("a", "b", check(F.struct("set_a", "set_b")).alias("ok")).where("ok").select("a", "b")

    def small_pairs(self, again: DataFrame) -> DataFrame:
        """Members of different groups in one small bucket."""
        small = again.where(F.col("size") <= SMALL)
        left = small.select("bucket", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
        right = small.select("bucket", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
        return (left.join(right, "bucket").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))
                                                 & similar_sizes("n_a", "n_b", self.percent)).select("a", "b").distinct())

    def large_links(self, again: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between the groups of large buckets, found block by block."""
        large = again.where(F.col("size") > SMALL)
        families = components(cut(large.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "near-family-edges"))
        placed = (large.select("node", "root").distinct().join(families.withColumnRenamed("root", "family"), "node"))
        largest = (placed.groupBy("family", "root").agg(F.count(F.lit(1)).alias("many")).groupBy("family")
                   .agg(F.max_by("root", F.struct("many", "root")).alias("main"), F.sum("many").alias("members"),
                        (F.sum("many") - F.max("many")).alias("queries")).withColumnRenamed("family", "of"))
        rows = (placed.join(largest, F.col("family") == F.col("of")).join(sets, "node")
                .withColumn("query_blocks", F.ceil(F.col("queries") / BLOCK)).withColumn("member_blocks", F.ceil(F.col("members") / BLOCK)))
        at = F.xxhash64("node")
        asks = rows.where(F.col("root") != F.col("main")).select(
            "family", F.pmod(at, "query_blocks").alias("q"), F.explode(F.expr("sequence(0L, member_blocks - 1)")).alias("m"),
            F.lit(True).alias("asks"), "node", "root", "shingles")
        answers = rows.select(
            "family", F.explode(F.expr("sequence(0L, query_blocks - 1)")).alias("q"), F.pmod(at, "member_blocks").alias("m"),
            F.lit(False).alias("asks"), "node", "root", "shingles")
        percent = self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [(r["asks"], r["node"], r["root"], unpacked(r["shingles"])) for b in batches for r in b.to_pylist()]
            found = []
            for a, root, x in [row[1:] for row in rows if row[0]]:
                joined = {root}  # one link to each other group is enough to join them
                for b, its, y in [row[1:] for row in rows if not row[0]]:
                    if its not in joined and 100 * min(x.size, y.size) >= percent * max(x.size, y.size) and linked(x, y, percent):
                        joined.add(its)
                        found.append((min(a, b), max(a, b)))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.binary()),
                                              "b": pa.array([b for _, b in found], pa.binary())})

        return asks.unionByName(answers).groupBy("family", "q", "m").applyInArrow(compare, "a binary, b binary").distinct()


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of every node of a link (a, b): nodes have the same root if they are connected.

    Each round every node takes the least node around it, then that one's own; links inside a group
    fall away and the others go on between groups, so rounds and links shrink quickly. ``known``
    are roots found before, which the links only join further.
    """
    edges = links.select("a", "b")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    roots = nodes.withColumn("root", F.col("node"))
    if known is not None:
        edges = _between(edges, known)
        new = roots.join(known.select(F.col("node").alias("had")), F.col("node") == F.col("had"), "left_anti")
        roots = known.unionByName(new)
    edges = cut(edges.where(F.col("a") != F.col("b")).distinct(), "component-edges")
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("up")), "component-up")
        far = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        step = cut(lookup_join(up, far, "up", "node").select("node", "root"), "component-step")
        ends = step.select(F.col("node").alias("root"), F.col("root").alias("now"))
        roots = cut(lookup_join(roots, ends, "root", "node").select("node", F.coalesce("now", "root").alias("root")), "components")
        edges = cut(_between(edges, step), "component-edges")
    return roots


def _between(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The links between groups, each named by its root."""
    one = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    two = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    moved = (lookup_join(lookup_join(edges, one, "a", "b"), two, "b", "a")
             .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, node, component_id, kept) for every row; node is null for an empty set."""
    run = NearDuplicates(docs, k, percent, id_col, text_col)
    least = F.min("id").alias("component")
    named = (run.nodes.select("node", "id").join(run.roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
             .select("node", "id", F.coalesce("root", "node").alias("root")))
    of_root = named.groupBy(F.col("root").alias("its_root")).agg(least)
    of_node = cut(named.join(of_root, F.col("root") == F.col("its_root")).select(F.col("node").alias("its_node"), "component"), "near-groups")
    out = run.described.join(of_node, F.col("node") == F.col("its_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "node", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the least id; equal rows count as one.

    Rows of empty sets all stay, but for repeated ones of the same id.
    """
    own_node, kept_id, kept_node = fresh_names(docs, "own_set_node", "kept_id", "kept_node")
    kept = (near_duplicates(docs, k, percent, id_col, text_col).where("kept")
            .select(F.col(id_col).alias(kept_id), F.coalesce("node", F.lit(b"")).alias(kept_node)).distinct())
    own = per_value(docs.sparkSession, lambda: _node_of(k), "binary", pa.binary())
    marked = docs.withColumn(own_node, own(F.col(text_col)))
    return (marked.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own_node) == F.col(kept_node)), "left_semi")
            .dropDuplicates([id_col, own_node]).drop(own_node))


def _node_of(k: int):
    sketcher = Sketcher(k, 1, 1)

    def node(text: str | None) -> bytes:
        shingles = sketcher.shingles(text)
        return xxhash.xxh3_128_digest(shingles.tobytes()) if shingles.size else b""

    return node
