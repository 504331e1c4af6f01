"""Merkle dataset manifest: one tree per source, one tree over the sources, proofs by pointer jumping.

A row's leaf is the hash of its fields. Every ``FAN`` consecutive nodes of a tree become their hash,
until one is left; the trees' roots, ordered by source, are the leaves of a top tree. A run is
one record: its parent's place and its up to FAN children.

A node's proof is made of one segment a level: the digests left and right of it in its run. At first
each inner node holds the segment to its parent. Each round joins the nodes to themselves, on the ancestor
that a node has reached so far, and puts the ancestor's segments behind its own: the distance doubles, so
the rounds number the logarithm of the depth. The leaves of a run share everything above their parent, so
the run jumps for them, and they unfold only when it has reached the root.

Texts are hashed where they are read and never move. The leaves are numbered by range partitions; the runs are
written level by level, each level a FAN-th of the one below. Only the root reaches the driver.

Rows: nulls hash as ``-``, so null and empty texts differ; null ids come first in their source and are not
tampered with. Repeated rows are leaves side by side, each with its own proof; equal ids with different
fields go by their leaf. An empty table has no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from jobtide.operators.lookup import lookup_join
from jobtide.operators.ordered import number_rows
from jobtide.session import cut

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "t"  # name of the top tree; those of sources are "s" and the source, that of no source is empty
TAMPERED_ONE_IN = 5


def hash_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it is hashed: byte count and value, or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return hash_of(F.concat(*[field(f) for f in fields]))


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, seen): each row's leaf, and the leaf of the row as it is seen after tampering."""
    plain = [F.col(name) for name in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_ONE_IN == 0, F.lit(False))
    leaf = leaf_of(plain)
    return docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("tree"), leaf.alias("leaf"),
        F.when(hit, leaf_of([*plain[:-1], lowered(F.col("text"))])).otherwise(leaf).alias("seen"))


def runs_of(nodes: DataFrame, level: int) -> DataFrame:
    """(tree, level, pos, kids): nodes with ``tree``, ``pos`` (from 0) and a ``digest`` in runs, by their parent's place."""
    kid = F.struct("pos", *[c for c in nodes.columns if c not in ("tree", "pos")])
    return (nodes.groupBy("tree", F.floor(F.col("pos") / FAN).alias("run")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
            .select("tree", F.lit(level + 1).alias("level"), F.col("run").alias("pos"), "kids"))


def alone() -> Column:
    """Of a run: whether it holds its whole level, which is the tree's root."""
    return (F.col("pos") == 0) & (F.size("kids") == 1)


def no_segments() -> Column:
    return F.array().cast("array<struct<left: string, right: string>>")


def trees(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The written runs of each level, and (tree, level, digest) of each tree's root. The last level has only roots."""
    levels, roots = [], None
    while True:
        runs = cut(runs_of(nodes, len(levels)), "merkle-runs")
        levels.append(runs)
        found = runs.where(alone()).select("tree", (F.col("level") - 1).alias("level"), F.col("kids")[0]["digest"].alias("digest"))
        roots = found if roots is None else roots.unionByName(found)
        runs = runs.where(~alone())
        if runs.isEmpty():
            return levels, roots
        nodes = runs.select("tree", "pos", hash_of(F.array_join("kids.digest", "")).alias("digest"))


def place(tree: Column | str, level: Column | str, pos: Column | str) -> Column:
    """A node's name."""
    return F.concat_ws("/", level, pos, tree)


def segment() -> Column:
    """The digests left and right of the ``nth`` of ``kids``, as a list of one level."""
    def digests(first: Column, count: Column) -> Column:
        return F.array_join(F.transform(F.slice("kids", first, count), lambda kid: kid["digest"]), "")

    return F.array(F.struct(digests(F.lit(1), F.col("nth")).alias("left"), digests(F.col("nth") + 2, F.lit(FAN)).alias("right")))


def steps(runs: DataFrame) -> DataFrame:
    """(node, up, segments): the segment of each node in the runs to its parent."""
    return (runs.where(~alone()).select("tree", "level", "pos", "kids", F.posexplode("kids").alias("nth", "kid"))
            .select(place("tree", F.col("level") - 1, "kid.pos").alias("node"), place("tree", "level", "pos").alias("up"),
                    segment().alias("segments")))


def jump(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, segments): all segments of each node up to the root, by doubling the distance until it covers ``depth``."""
    nodes, reach = cut(nodes, "merkle-steps"), 1
    while reach < depth:
        ahead = nodes.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("segments").alias("behind"))
        nodes = cut(lookup_join(nodes, ahead, "up", "node").select(
            "node", F.coalesce("further", "up").alias("up"), F.concat("segments", F.coalesce("behind", no_segments())).alias("segments")),
            "merkle-jump")
        reach *= 2
    return nodes.select("node", "segments")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, seen, subroot, root, segments, folded_root) for every row: ``segments`` are the (left, right)
    digests from the leaf up, ``folded_root`` is what they make of ``seen``, the leaf after tampering."""
    numbered = number_rows(leaves(docs), ["tree"], ["doc_id", "leaf"], out="nth")
    levels, subroots = trees(numbered.select("tree", (F.col("nth") - 1).alias("pos"), F.col("leaf").alias("digest"), "doc_id", "seen"))
    subroots = cut(number_rows(subroots, [], ["tree"], out="nth"), "merkle-subroots").withColumn("pos", F.col("nth") - 1)
    top_levels, tops = trees(subroots.select(F.lit(TOP).alias("tree"), "pos", "digest"))
    top = tops.first()  # one row, or none without documents

    # a tree's root is a leaf of the top tree, there under the name that it has in its own tree
    own = subroots.select(place(F.lit(TOP), F.lit(0), "pos").alias("node"), place("tree", "level", F.lit(0)).alias("own"))
    nodes = lookup_join(steps(top_levels[0]), own, "node", "up").select(F.col("own").alias("node"), "up", "segments")
    for runs in [*top_levels[1:], *levels[1:]]:
        nodes = nodes.unionByName(steps(runs))
    paths = jump(nodes, len(top_levels) - 1 + max(0, len(levels) - 2)).withColumnRenamed("segments", "above")

    groups = levels[0].select("tree", alone().alias("alone"), "kids", F.when(
        alone(), place("tree", F.lit(0), F.lit(0))).otherwise(place("tree", "level", "pos")).alias("node"))
    groups = lookup_join(groups, paths, "node", "kids")
    groups = lookup_join(groups, subroots.select("tree", F.col("digest").alias("subroot")), "tree", "node")
    above = F.coalesce("above", no_segments())
    rows = groups.select("alone", "above", "subroot", "kids", F.posexplode("kids").alias("nth", "kid")).select(
        "kid.doc_id", F.col("kid.digest").alias("leaf"), "kid.seen", "subroot", F.lit(top and top.digest).cast("string").alias("root"),
        F.when(F.col("alone"), above).otherwise(F.concat(segment(), above)).alias("segments"))
    return rows.withColumn("folded_root", F.aggregate(
        "segments", F.col("seen"), lambda below, s: hash_of(F.concat(s["left"], below, s["right"]))))


def proof_digest(segments: Column | str) -> Column:
    return hash_of(F.array_join(F.transform(segments, lambda s: F.concat(s["left"], s["right"])), ""))
