"""A Merkle manifest of a table: leaves, roots and inclusion proofs by slot pivots.

Rows are leaves. The leaves of one group, in order, are joined in runs of ``fanout``
until one hash is left, the group's subroot; subroots in the order of their groups give
the root the same way. A run is found by integer division, not by comparing neighbours:
conditional aggregates spread the children of a node into slot columns, the
concatenation of the columns is what is hashed, and leaving out a child's own column
yields its siblings.

One pivot spreads several levels at once: ``fanout ** levels`` slots, between which the
levels are plain expressions. So a table of n rows takes log(n) / levels shuffles, each
``fanout ** levels`` times smaller than the one before. Pivots are stored on the way up
and joined on the way down, where every node hands its path to its children. No step
holds a group, and the driver sees one number: the height of the tallest tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filltape.llm.common import stored

#: Slot columns of a pivot, at most, unless the fanout itself is larger.
SLOTS = 16
#: What a path is made of: the hashes before and after a node in its run, leaf first.
PATH = "array<struct<before: string, after: string>>"


def digest(*values: Column) -> Column:
    """SHA-256 of the values as text, each with its length in bytes; nulls are a dash."""
    texts = [value.cast("string") for value in values]
    parts = [
        F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        for text in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def _height(leaves: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree: the least h with fanout ** h >= leaves."""
    powers, power = [], 1
    while power < 1 << 62:
        powers.append(F.when(leaves > power, 1).otherwise(0))
        power *= fanout
    return sum(powers[1:], powers[0])


def _placed(rows: DataFrame, order: list[str], fanout: int, name: str) -> DataFrame:
    """``rows`` with their place ``idx`` in their tree and the tree's height ``left``.

    Rows are dealt by ranges of the order and numbered where they lie; a tree that goes
    over several ranges is put together from the counts of its pieces.
    """
    # Repeated rows are equal in everything else, and may be many.
    keys = ["tree", *order, "salt"]
    ranked = stored(
        rows.withColumn("salt", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(
            *rows.columns,
            F.spark_partition_id().alias("piece"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"),
        ),
        name,
    )
    pieces = ranked.groupBy("tree", "piece").agg(
        F.min("at").alias("first"), F.count("*").alias("n")
    )
    tree = Window.partitionBy("tree")
    before = tree.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        "tree",
        "piece",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"),
        _height(F.sum("n").over(tree), fanout).alias("left"),
    )
    return ranked.join(starts, ["tree", "piece"]).select(
        *rows.columns, (F.col("at") + F.col("start")).alias("idx"), "left"
    )


def _pivot(rows: DataFrame, fanout: int, levels: int, name: str) -> DataFrame:
    """Nodes ``levels`` above ``rows``, with all nodes between as columns ``n<level>_<slot>``.

    Slots of level 0 are structs of the hash and of whatever else the rows carry.
    """
    # As SQL text: so many columns take seconds to build one call at a time.
    width = fanout**levels
    carried = [name for name in rows.columns if name not in ("tree", "idx", "left")]
    child = f"struct({', '.join(f'`{name}`' for name in carried)})"
    grouped = rows.groupBy("tree", F.expr(f"idx div {width}").alias("idx")).agg(
        F.max("left").alias("left"),
        *[F.expr(f"max(if(idx % {width} = {i}, {child}, null)) AS n0_{i}") for i in range(width)],
    )
    for level in range(levels):
        nodes = _nodes(level, width // fanout**level)
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        # A tree of which one node is left is done: the node goes on as it is.
        joined = [
            f"CASE WHEN {run[0]} IS NULL THEN NULL WHEN left > {level} "
            f"THEN sha2(concat_ws('', {', '.join(run)}), 256) ELSE {run[0]} END AS n{level + 1}_{i}"
            for i, run in enumerate(runs)
        ]
        grouped = grouped.selectExpr("*", *joined)
    return stored(grouped, name)


def _nodes(level: int, count: int) -> list[str]:
    """Hash columns of a level."""
    field = ".hash" if level == 0 else ""
    return [f"n{level}_{i}{field}" for i in range(count)]


def _joined(nodes: list[str]) -> str:
    return f"concat_ws('', {', '.join(nodes)})" if nodes else "''"


def _grown(rows: DataFrame, fanout: int, levels: int, name: str) -> list[DataFrame]:
    """The pivots of all trees, from the leaves up."""
    height = rows.agg(F.max("left")).first()[0] or 0
    pivots = []
    for _ in range(max(1, -(-height // levels))):
        pivots.append(_pivot(rows, fanout, levels, name))
        left = F.greatest(F.col("left") - levels, F.lit(0))
        rows = pivots[-1].select("tree", "idx", left.alias("left"), F.col(f"n{levels}_0").alias("hash"))
    return pivots


def _descended(
    pivots: list[DataFrame], heads: DataFrame, fanout: int, levels: int
) -> DataFrame:
    """What the leaves carry, with their paths and what ``heads`` hand down.

    ``heads`` holds ``tree, path`` of every tree and any further columns.
    """
    width = fanout**levels
    handed = [name for name in heads.columns if name not in ("tree", "path")]
    children = []
    for i in range(width):
        steps = []
        for level in range(levels):
            nodes = _nodes(level, width // fanout**level)
            own = i // fanout**level
            first = own - own % fanout
            before, after = _joined(nodes[first:own]), _joined(nodes[own + 1 : first + fanout])
            step = f"named_struct('before', {before}, 'after', {after})"
            steps.append(f"if(left > {level}, {step}, null)")
        child = f"named_struct('slot', {i}, 'node', n0_{i}, 'steps', array({', '.join(steps)}))"
        children.append(f"if(n0_{i} IS NULL, null, {child})")
    present = f"filter(array({', '.join(children)}), child -> child IS NOT NULL)"
    parents = heads.withColumn("idx", F.lit(0).cast("long"))
    for pivot in reversed(pivots):
        parents = (
            pivot.join(parents, ["tree", "idx"])
            .select("tree", "idx", "path", *handed, F.expr(f"explode({present}) AS child"))
            .select(
                "tree",
                (F.col("idx") * width + F.col("child.slot")).alias("idx"),
                F.expr("concat(filter(child.steps, step -> step IS NOT NULL), path)")
                .cast(PATH)
                .alias("path"),
                *handed,
                F.col("child.node").alias("node"),
            )
        )
        if pivot is not pivots[0]:
            parents = parents.drop("node")
    return parents


def manifest(
    docs: DataFrame,
    leaf: Column,
    changed: Column | None = None,
    group_col: str = "lang",
    id_col: str = "doc_id",
    fanout: int = 2,
) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, path, folded_root, verified``.

    ``leaf`` is the hash of a row, ``changed`` the hash that is to be verified against
    the manifest (the leaf itself, if not given). Groups ascend with null first, the
    leaves of a group by id with null first. ``path`` holds, from the leaf up, the
    concatenated hashes before and after the node in its run; ``folded_root`` is what
    ``changed`` and the path lead to, ``verified`` whether that is the root.

    Defined results: rows with equal ids are ordered by their hash, so repeated rows are
    leaves of their own and equal; null is a group and an id like any other; an empty
    text is not a null one; a group of one leaf has that leaf as its subroot, and one
    group's subroot is the root; an empty table gives no rows; texts of any length are
    hashed where they lie and never moved; other columns are ignored, whatever they are
    called.
    """
    levels = 1
    while fanout ** (levels + 1) <= SLOTS:
        levels += 1
    group = F.col(group_col).cast("string")
    # Not null, and in the order of the groups with null first.
    tree = F.coalesce(F.concat(F.lit("="), group), F.lit("-"))
    leaves = docs.select(
        tree.alias("tree"),
        F.col(id_col).alias("id"),
        leaf.alias("hash"),
        (leaf if changed is None else changed).alias("changed"),
    )
    lower = _grown(_placed(leaves, ["id", "hash"], fanout, "leaves"), fanout, levels, "nodes")
    subroots = lower[-1].select(
        F.lit("").alias("tree"), F.col(f"n{levels}_0").alias("hash"), F.col("tree").alias("member")
    )
    upper = _grown(_placed(subroots, ["member"], fanout, "groups"), fanout, levels, "tops")
    none = F.array().cast(PATH).alias("path")
    top = upper[-1].select("tree", none, F.col(f"n{levels}_0").alias("root"))
    heads = _descended(upper, top, fanout, levels).select(
        F.col("node.member").alias("tree"), "path", F.col("node.hash").alias("subroot"), "root"
    )
    found = _descended(lower, heads, fanout, levels).select(
        F.col("node.id").alias("doc_id"),
        F.col("node.hash").alias("leaf"),
        "subroot",
        "root",
        "path",
        F.aggregate(
            "path",
            F.col("node.changed"),
            lambda low, step: F.sha2(F.concat(step["before"], low, step["after"]), 256),
        ).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on a path, from the leaf up and left to right."""
    siblings = F.transform(path, lambda step: F.concat(step["before"], step["after"]))
    return F.sha2(F.array_join(siblings, ""), 256)
