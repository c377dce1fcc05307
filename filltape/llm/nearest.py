"""Nearest neighbours by cosine: probed lists, scanned dimension by dimension.

Vectors are scaled to length 1, turned by a fixed random rotation and dealt to lists by
their nearest centre. A query visits the nearest lists, until they hold enough vectors.
Within a list the rotated coordinates are read in column blocks. After each block the
partial distance, scaled up to all dimensions, is an estimate with a known error for a
random rotation; candidates that are too far at the chosen confidence are abandoned. What
is left is scored by the cosine of the original vectors in double precision.

Centres are fitted by the driver on a bounded sample, every vector is in the index. A list
may hold a third of all vectors: lists are cut into blocks of candidates, and so are their
queries; each pair of blocks is one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filltape.llm.common import stored

#: Vectors that centres are fitted on, at most; those with the least hash of their id.
SAMPLE_ROWS = 8_192
LISTS, PROBES, ROUNDS, SEED = 64, 44, 12, 11
COLUMNS = 16
#: Standard errors by which an estimate must exceed the limit.
CONFIDENCE = 2.1
#: Candidates and queries of one group.
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024


def _usable(vector: Column) -> Column:
    """Not null or zero, and no component null, infinite or not a number."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps very long and short vectors finite.
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector with many, each row summed in the same order."""
    norms = np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum())
    return (rows * query).sum(1) / norms


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))[0]


def centres(sample: np.ndarray, lists: int = LISTS) -> np.ndarray:
    """Centres of unit vectors by a few rounds of k-means; at most one per vector."""
    rng = np.random.default_rng(SEED)
    found = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(ROUNDS):
        own = np.argmax(sample @ found.T, 1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        full = np.abs(sums).max(1) > 0
        found[full] = _unit(sums[full])
    return found


def scan(
    query: np.ndarray, rows: np.ndarray, limit: float, columns: int = COLUMNS
) -> np.ndarray:
    """Places of the rows whose squared distance to the query may be within ``limit``.

    Both are rotated. The test after ``d`` of ``D`` columns abandons a row if its partial
    distance, scaled by ``D / d``, exceeds the limit by a factor
    ``(1 + CONFIDENCE / sqrt(d)) ** 2``; after all columns the distance is exact.
    """
    dims = rows.shape[1]
    alive, partial = np.arange(len(rows)), np.zeros(len(rows))
    for start in range(0, dims, columns):
        end = min(start + columns, dims)
        step = rows[alive, start:end] - query[start:end]
        partial = partial + (step * step).sum(1)
        slack = 1.0 if end == dims else (1 + CONFIDENCE / end**0.5) ** 2
        near = partial * (dims / end) <= limit * slack + 1e-9
        alive, partial = alive[near], partial[near]
    return alive


def _search_block(turn: np.ndarray, dims: int, k: int):
    """The ``k`` best candidates of a block for each of its queries."""
    schema = pa.schema(
        [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
    )

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and rows.num_rows:
            ids = rows["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], _matrix(rows["vector"], dims)[order]
            turned = _unit(vectors) @ turn
            asked = _matrix(queries["vector"], dims)
            turned_asked = _unit(asked) @ turn
            for query_id, query, rotated in zip(
                queries["vec_id"].to_numpy(), asked, turned_asked, strict=True
            ):
                other = np.flatnonzero(ids != query_id)
                # The first candidates set the limit that the others have to meet.
                head = other[: 8 * k]
                first = ((turned[head] - rotated) ** 2).sum(1)
                limit = np.partition(first, k - 1)[k - 1] if len(head) > k else np.inf
                left = other[scan(rotated, turned[other], limit)]
                score = cosines(query, vectors[left])
                best = np.lexsort((ids[left], -score))[:k]
                out.append((np.full(len(best), query_id), ids[left][best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table(dict(zip(schema.names, columns, strict=True)), schema=schema)

    return search


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    lists: int = LISTS,
    probes: int = PROBES,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query row.

    ``is_query`` is a condition on the column ``vec_id``. A query never finds its own id;
    of equal scores the smaller id comes first. A query visits ``probes`` lists, and more
    until they hold over ``k`` vectors besides its own, so fewer results than ``k`` mean
    fewer candidates.

    Defined results: null, zero, empty or non-finite vectors, null ids and vectors of
    another length than the commonest take no part; rows with the same id and vector are
    one; an id with several vectors keeps the least one; without vectors there are no
    results; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = (
        vectors.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(vector_col).cast("array<double>").alias("vector"),
        )
        .filter(F.col("vec_id").isNotNull())
        .filter(_usable(F.col("vector")))
    )
    sizes = rows.groupBy(F.size("vector").alias("dims")).count()
    common = sizes.orderBy(F.desc("count"), "dims").limit(1).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], empty)
    dims = common["dims"]
    rows = rows.filter(F.size("vector") == dims)
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    heart = centres(_unit(_matrix(sample["vector"], dims)), lists)
    sent, turn = spark.sparkContext.broadcast(heart), rotation(dims)

    @F.arrow_udf("array<int>")
    def nearest_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            near = np.argsort(-(_unit(_matrix(batch, dims)) @ sent.value.T), 1, kind="stable")
            yield pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))

    near = nearest_lists("vector")
    # The index: every vector with its list, queries with all lists in order.
    listed = stored(
        rows.withColumn("near", near).withColumn(
            "near", F.when(is_query, F.col("near")).otherwise(F.slice("near", 1, 1))
        ),
        "lists",
    )
    owned = listed.select("vec_id", "vector", F.col("near")[0].alias("list"))
    counts = {c["list"]: c["count"] for c in owned.groupBy("list").count().collect()}
    blocks = [max(1, -(-counts.get(number, 0) // BLOCK_ROWS)) for number in range(len(heart))]

    held = F.array(*(F.lit(counts.get(number, 0)).cast("long") for number in range(len(heart))))
    reach = F.aggregate(
        "near",
        F.struct(F.lit(0).alias("lists"), F.lit(0).cast("long").alias("rows")),
        lambda seen, number: F.when(
            (seen["lists"] < probes) | (seen["rows"] < k + 1),
            F.struct(
                (seen["lists"] + 1).alias("lists"), (seen["rows"] + held[number]).alias("rows")
            ),
        ).otherwise(seen),
    )["lists"]
    visits = listed.filter(is_query).withColumn("list", F.explode(F.slice("near", 1, reach)))
    asked = {c["list"]: c["count"] for c in visits.groupBy("list").count().collect()}
    parts = [max(1, -(-asked.get(number, 0) // BLOCK_QUERIES)) for number in range(len(heart))]
    # Per list: blocks of candidates and parts of queries; every pair of both is a group.
    cut = F.array(*map(F.lit, blocks))[F.col("list")]
    dealt = F.array(*map(F.lit, parts))[F.col("list")]
    own = F.xxhash64("vec_id")
    queries = (
        visits.withColumn("block", F.explode(F.sequence(F.lit(0), cut - 1)))
        .withColumn("part", F.pmod(own, dealt).cast("int"))
        .select("list", "block", "part", "vec_id", "vector")
    )
    candidates = (
        owned.withColumn("block", F.pmod(own, cut).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), dealt - 1)))
        .select("list", "block", "part", "vec_id", "vector")
    )
    keys = ["list", "block", "part"]
    found = (
        queries.groupBy(*keys)
        .cogroup(candidates.groupBy(*keys))
        .applyInArrow(
            _search_block(turn, dims, k), "query_id long, vec_id long, score double"
        )
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
