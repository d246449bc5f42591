"""Merkle manifest of a table: one tree for each language, one tree over their roots, and a proof for every row.

A leaf is the SHA-256 of a row's values, each with its length in bytes. Leaves of a tree are numbered by id; every
`fan_out` consecutive nodes have one parent, the hash of their hashes.

1. *Places.* Rows are sorted by (tree, id) with a range partitioning; a node's index is its place less the first place
   of its tree. A language that holds a third of all rows is many partitions, for indices are spread, not trees.
2. *Levels.* At each level the nodes with slot zero compute their siblings' indices (the lowest bit flipped by XOR for
   binary trees, slot offsets otherwise) and are joined with the nodes on (tree, index); each then emits one parent with
   the run's hashes. Nodes carry hashes only, texts are read in the first pass and never shuffled. Every level is
   written to the shared folder, so a lost executor never replays the levels below; there are log(rows) levels.
3. *Proofs.* From the root downwards each run meets its parent's path and hands every child the path plus the child's
   siblings. The path is joined once for a run, not for a row, and at the last level it is folded at once: into the
   proof's digest, and into the root that the (tampered) leaf leads to.

Defined cases: NULL columns are `-`; a NULL id comes first, rows that repeat an id are ordered by their leaf (equal
leaves are interchangeable) and each is a leaf of its own; a tree of one row is its own root, a table with one language
has that tree's root; an empty table gives no rows; only the named columns are hashed, others are ignored under any
name; a very long text is hashed in one go and held by one task, as it is when it is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.order import row_positions
from quantloom.storage import materialise

FAN_OUT = 8
#: Columns of a leaf, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as its length in bytes, a colon and itself, or `-` where it is NULL."""
    text = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*parts), 256)


def _joined(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def _siblings(fan_out: int) -> Column:
    """Indices of the run that begins at this node of slot zero, itself first."""
    first = F.col("index")
    if fan_out == 2:
        return F.filter(F.array(first, first.bitwiseXOR(F.lit(1))), lambda i: i < F.col("nodes"))
    return F.sequence(first, F.least(first + fan_out, F.col("nodes")) - 1)


def runs_of(nodes: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(tree, index, nodes, hash, children): the parents of the nodes (tree, index, nodes, hash, item)."""
    wanted = nodes.where(F.col("index") % fan_out == 0).select(
        "tree", F.floor(F.col("index") / fan_out).alias("parent"), "nodes", F.explode(_siblings(fan_out)).alias("index")
    )
    met = wanted.join(nodes.select("tree", "index", "hash", "item"), ["tree", "index"])
    run = F.sort_array(F.collect_list(F.struct("index", "hash", "item"))).alias("children")  # `fan_out` at most
    return (
        met.groupBy("tree", "parent", "nodes")
        .agg(run)
        .select(
            "tree",
            F.col("parent").alias("index"),
            F.ceil(F.col("nodes") / fan_out).alias("nodes"),
            _joined(F.col("children.hash")).alias("hash"),
            "children",
        )
    )


def _levels(leaves: DataFrame, fan_out: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored runs of every level, from the leaves up, and the trees' roots (tree, hash, item)."""
    levels, ends, nodes = [], [], leaves
    empty = F.lit(None).cast(leaves.schema["item"].dataType)
    while True:
        ends.append(nodes.where("nodes = 1").select("tree", "hash", "item", F.lit(len(levels)).alias("level")))
        if most <= 1:
            return levels, reduce(DataFrame.unionByName, ends)
        runs = materialise(runs_of(nodes.where("nodes > 1"), fan_out), f"merkle-{len(levels)}")
        levels.append(runs)
        nodes = runs.select("tree", "index", "nodes", "hash", empty.alias("item"))
        most = -(-most // fan_out)


_PATH = "array<struct<left:string,right:string>>"


def _descend(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, index, hash, item, path) of the children of the runs, whose own paths are (tree, index, path)."""
    met = runs.select("tree", "index", "children").join(paths.select("tree", "index", "path"), ["tree", "index"])
    hashes = F.col("children.hash")
    own = F.struct(
        F.array_join(F.slice(hashes, 1, F.col("slot")), "").alias("left"),
        F.array_join(F.slice(hashes, F.col("slot") + 2, F.size("children")), "").alias("right"),
    )
    return met.select("tree", "children", "path", F.posexplode("children").alias("slot", "child")).select(
        "tree",
        F.col("child.index").alias("index"),
        F.col("child.hash").alias("hash"),
        F.col("child.item").alias("item"),
        F.concat(F.array(own), F.col("path")).alias("path"),
    )


def _paths(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Paths of all leaves, given the trees' roots (tree, hash, item, level, path)."""
    columns = ["tree", "index", "hash", "item", "path"]
    at = lambda k: roots.where(F.col("level") == k).withColumn("index", F.lit(0).cast("long")).select(*columns)
    paths = at(len(levels))
    for k in reversed(range(len(levels))):
        paths = _descend(levels[k], paths).unionByName(at(k))
    return paths


def manifest(
    docs: DataFrame,
    tampered: Column | None = None,
    tampered_text: Column | None = None,
    fan_out: int = FAN_OUT,
    columns: Sequence[str] = LEAF_COLUMNS,
) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, subroot, root, proof (siblings, left to right), folded_root, verified.

    `columns` begin with the id; `lang` names the tree. Where `tampered` holds, the root is folded from the leaf of
    `tampered_text` in the place of the text, else from the leaf itself.
    """
    leaf = leaf_hash([F.col(c) for c in columns])
    changed = leaf
    if tampered is not None:
        other = leaf_hash([tampered_text if c == "text" else F.col(c) for c in columns])
        changed = F.when(tampered, other).otherwise(leaf)
    item = F.struct(F.col(columns[0]).alias("doc_id"), changed.alias("folded"))
    rows = docs.select(F.col("lang").alias("tree_name"), F.col(columns[0]).alias("row_id"), leaf.alias("hash"), item.alias("item"))
    placed = row_positions(rows, [F.asc_nulls_first("tree_name"), F.asc_nulls_first("row_id"), "hash"], "place")
    trees = placed.groupBy("tree_name").agg(F.min("place").alias("first"), F.count("*").alias("nodes"))
    trees = materialise(row_positions(trees, [F.asc_nulls_first("tree_name")], "tree"), "merkle-trees")
    leaves = placed.join(trees.withColumnRenamed("tree_name", "name"), F.col("tree_name").eqNullSafe(F.col("name"))).select(
        "tree", (F.col("place") - F.col("first")).alias("index"), "nodes", "hash", "item"
    )
    leaves = materialise(leaves, "merkle-leaves")
    size = trees.agg(F.max("nodes").alias("most"), F.count("*").alias("trees")).first()
    levels, subroots = _levels(leaves, fan_out, size.most or 0)

    # The tree over the trees: its leaves are the subroots, in the order of the trees.
    subroots = materialise(subroots, "merkle-subroots")
    top = subroots.select(
        F.lit(0).cast("long").alias("tree"),
        (F.col("tree") - 1).alias("index"),
        F.lit(size.trees).cast("long").alias("nodes"),
        "hash",
        F.struct(F.col("tree").alias("of"), "level", "item").alias("item"),
    )
    top_levels, root = _levels(top, fan_out, size.trees)
    root = materialise(root.withColumn("path", F.array().cast(_PATH)), "merkle-root")
    whole = root.select(F.col("hash").alias("root"))
    over = _paths(top_levels, root).select(
        F.col("item.of").alias("tree"), "hash", F.col("item.level").alias("level"), F.col("item.item").alias("item"), "path"
    )
    over = materialise(over, "merkle-over")
    found = _paths(levels, over).join(over.select("tree", F.col("hash").alias("subroot")), "tree").crossJoin(F.broadcast(whole))
    step = lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256)
    proof = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    return found.select(
        F.col("item.doc_id").alias("doc_id"),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        proof.alias("proof"),
        F.aggregate("path", F.col("item.folded"), step).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    return F.translate(text, _UPPER, _LOWER)
