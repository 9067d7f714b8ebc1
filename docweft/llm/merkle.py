"""Merkle manifest of a table: leaves of rows, a tree of each group, a root over the groups, inclusion proofs. DataFrame functions only.

Nodes are the hex digests of SHA-256 as text. An aligned block of 512 leaves keeps each of its levels as one hex string (held as bytes, so that
a substring costs its own length), in which a node's place is its number times 64. Parents are hashes of substrings of eight nodes,
siblings are the substrings on both sides of a node within its eight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.common import checked_broadcast, stored

#: Children of a node, levels that a block hashes, leaves of a block, letters of a node.
FAN, LEVELS, WIDTH = 8, 3, 64
BLOCK = FAN**LEVELS


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Hash of a row's values: ``-`` for null, else UTF-8 byte count, colon, value; numbers as decimals."""
    one = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return hashed(*one)


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, their number from 0 on within their ``tree`` by ``order`` (nulls first), and ``n``, the tree's size.

    Rows are range partitioned by tree and order, so one tree of any size is spread over the tasks; a partition's rows are numbered as
    it is written, and its start in a tree is the sum of the counts before it (one row for each partition and tree).
    """
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ordered = stored(ordered.withColumn("_row", F.monotonically_increasing_id()), "merkle-order").withColumn("_part", F.shiftright("_row", 33))
    starts = ordered.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part")) - F.col("_n")
    starts = stored(starts.select("tree", "_part", "_first", before.alias("_before"), F.sum("_n").over(tree).alias("n")), "merkle-starts")
    placed = ordered.join(checked_broadcast(starts), ["tree", "_part"])
    return placed.withColumn("pos", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_part", "_first", "_before")


def piece(level: Column, begin: Column, count: Column | int) -> Column:
    """``count`` nodes of a level from number ``begin`` on."""
    return level.substr((begin * WIDTH + 1).cast("int"), (F.lit(count) * WIDTH).cast("int"))


def nodes(level: Column) -> Column:
    return (F.length(level) / WIDTH).cast("int")


def parents(level: Column) -> Column:
    """The next level: the hash of each eight nodes, the last ones fewer."""
    runs = F.sequence(F.lit(0), (F.ceil(nodes(level) / FAN) - 1).cast("int"))
    return F.array_join(F.transform(runs, lambda r: F.sha2(piece(level, r * FAN, FAN), 256)), "").cast("binary")


def height(n: Column) -> Column:
    """Levels of hashing in a block of a tree of ``n`` nodes: until one node is left, three at most."""
    h = F.lit(LEVELS)
    for level in reversed(range(LEVELS)):
        h = F.when(n <= FAN**level, F.lit(level)).otherwise(h)
    return h


def build(tree: DataFrame, items: Sequence[str] = ()) -> list[DataFrame]:
    """Layers of blocks, from the leaves up: ``tree, block, n, height, level0 to level2, root`` and an array of each of ``items``.

    ``tree`` has ``tree, pos, n, node``. Roots of blocks are the nodes of the next layer while a tree has more than one of them,
    so each layer has a 512th of the rows; a block gathers 512 nodes at most.
    """
    layers = []
    while True:
        of = tree.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block"))
        row = F.struct("pos", "node", *items)
        blocks = of.agg(F.max("n").alias("n"), F.array_sort(F.collect_list(row)).alias("rows"))
        blocks = blocks.withColumn("height", height(F.col("n"))).withColumn("level0", F.array_join("rows.node", "").cast("binary"))
        for i in range(1, LEVELS + 1):
            blocks = blocks.withColumn(f"level{i}", F.when(F.col("height") >= i, parents(F.col(f"level{i - 1}"))))
        top = F.coalesce(*[F.col(f"level{i}") for i in reversed(range(LEVELS + 1))])
        levels = [f"level{i}" for i in range(LEVELS)]
        blocks = blocks.select("tree", "block", "n", "height", *levels, top.cast("string").alias("root"), *[F.col(f"rows.{c}").alias(c) for c in items])
        layer = stored(blocks, "merkle-blocks")
        layers.append(layer)
        tree = layer.where(F.col("n") > BLOCK).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("node"))
        if tree.isEmpty():
            return layers
        items = ()


def flanks(i: Column) -> Column:
    """Sibling segments (``left, right``) of leaf ``i`` of a block, level by level to the block's root."""
    out = []
    for level in range(LEVELS):
        at = F.col(f"level{level}")
        j = F.floor(i / FAN**level)
        begin = F.floor(j / FAN) * FAN
        end = F.least(begin + FAN, nodes(at))
        out.append(F.struct(piece(at, begin, j - begin).alias("left"), piece(at, j + 1, end - j - 1).alias("right")))
    return F.slice(F.array(*out), F.lit(1), F.col("height"))


def places() -> Column:
    """Numbers of a block's leaves."""
    return F.sequence(F.lit(0), nodes(F.col("level0")) - 1)


def below(layer: DataFrame, trees: DataFrame, parent_nodes: DataFrame | None) -> DataFrame:
    """A layer's blocks with ``above``, the segments from the block's root up, and ``subroot``, ``root_hash``.

    The block that is the whole rest of its tree goes on with the tree's own path, others with that of their root in the next layer.
    """
    renamed = layer.withColumnRenamed("root", "block_root")
    last = renamed.where(F.col("n") <= BLOCK).join(checked_broadcast(trees), "tree")
    if parent_nodes is None:
        return last
    inner = renamed.where(F.col("n") > BLOCK).join(checked_broadcast(parent_nodes), ["tree", "block"])
    return last.unionByName(inner)


def paths(blocks: DataFrame, name: str, key: str) -> DataFrame:
    """Nodes of a layer as rows: ``tree``, their number as ``key``, segments up to the root, both roots."""
    each = blocks.select("*", F.explode(places()).alias("i"))
    place = (F.col("block") * BLOCK + F.col("i")).cast("long")
    return stored(each.select("tree", place.alias(key), F.concat(flanks(F.col("i")), "above").alias("above"), "subroot", "root_hash"), name)


def merkle_manifest(docs: DataFrame, *, leaf: Column, changed: Column | None = None, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """Digests and inclusion proof of each row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``leaf`` is the hash of a row, ``changed`` the hash of what is presented in its place (null: the same). Leaves of a group ascend by
    id; each eight nodes in a row (the last ones fewer) become their hash until one is left, the subroot. Subroots, ordered by the group's
    name in UTF-8 bytes (null first), become the root in the same way. ``proof_sha256`` hashes the sibling segments from leaf to root;
    ``folded_root`` is what they give with the presented leaf, ``verified`` whether that is the root.

    The text is read once and not shuffled: range partitions, blocks and proofs have digests only. A group of any size is spread
    (``ranked``), a task gathers 512 nodes of a block. Null ids come first; rows that share an id are ordered by their leaf, so repeated
    rows have equal leaves and any order of them gives the same roots (their proofs are told apart by place). Texts count whole;
    other columns are ignored; an empty table gives no rows.
    """
    changed = F.lit(None).cast("string") if changed is None else changed
    group = F.coalesce(F.concat(F.lit("g"), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(group.alias("tree"), F.col(id_col).alias("id"), leaf.alias("node"), changed.alias("changed"), F.monotonically_increasing_id().alias("salt"))
    rows = ranked(stored(rows, "merkle-leaves"), ["id", "node", "salt"])
    layers = build(rows, ["id", "changed"])

    subroots = [x.where(F.col("n") <= BLOCK).select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("node")) for x in layers]
    every = subroots[0]
    for more in subroots[1:]:
        every = every.unionByName(more)
    top = build(ranked(every, ["group"]), ["group"])
    root = top[-1].select("tree", F.col("root").alias("root_hash"), F.array().cast("array<struct<left:binary,right:binary>>").alias("above"), F.lit("").alias("subroot"))
    nodes_above = None
    for layer in reversed(top[1:]):
        nodes_above = paths(below(layer, root, nodes_above), "merkle-top", "block")
    heads = below(top[0], root, nodes_above)
    heads = heads.select(F.posexplode("group").alias("i", "group_name"), "*").withColumn("subroot", piece(F.col("level0"), F.col("i"), 1).cast("string"))
    trees = stored(heads.select(F.col("group_name").alias("tree"), F.concat(flanks(F.col("i")), "above").alias("above"), "subroot", "root_hash"), "merkle-trees")

    nodes_above = None
    for layer in reversed(layers[1:]):
        nodes_above = paths(below(layer, trees, nodes_above), "merkle-paths", "block")
    blocks = below(layers[0], trees, nodes_above)

    none = F.lit("").cast("binary")
    with_path = F.transform(places(), lambda i: F.struct(i.alias("i"), F.concat(flanks(i), F.col("above")).alias("path")))
    each = F.transform(
        with_path,
        lambda s: F.struct(
            F.get("id", s["i"]).alias("doc_id"),
            piece(F.col("level0"), s["i"], 1).cast("string").alias("leaf"),
            F.sha2(F.aggregate(s["path"], none, lambda a, p: F.concat(a, p["left"], p["right"])), 256).alias("proof_sha256"),
            F.aggregate(
                s["path"],
                F.coalesce(F.get("changed", s["i"]), piece(F.col("level0"), s["i"], 1).cast("string")),
                lambda a, p: F.sha2(F.concat(p["left"], a.cast("binary"), p["right"]), 256),
            ).alias("folded_root"),
        ),
    )
    out = blocks.select("subroot", F.col("root_hash").alias("root"), F.explode(each).alias("r"))
    return out.select(
        "r.doc_id", "r.leaf", "subroot", "root", "r.proof_sha256", "r.folded_root", (F.col("r.folded_root") == F.col("root")).alias("verified")
    )
