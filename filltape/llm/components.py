"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filltape.llm.common import stored


def _linked_to_least(pairs: DataFrame) -> DataFrame:
    """``u, v, least``: every neighbour pair with the least neighbour of ``u``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u").withColumn("least", F.least("u", "least"))


def _each(names: tuple[str, str], *pairs: tuple[str, str]) -> Column:
    """Two columns ``names`` with a row for each of ``pairs`` of columns.

    A union would read its frame once for each of them, with all that lies below it.
    """
    rows = [F.struct(*(F.col(c).alias(n) for c, n in zip(p, names, strict=True))) for p in pairs]
    return F.inline(F.array(*rows))


def _large_star(links: DataFrame) -> DataFrame:
    """Links of every node's greater neighbours to the least of its neighbourhood."""
    both = links.select(_each(("u", "v"), ("a", "b"), ("b", "a")))
    return _linked_to_least(both).filter("v > u").select(
        F.col("v").alias("a"), F.col("least").alias("b")
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Links of every node and its lesser neighbours to the least of them."""
    down = _linked_to_least(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    stars = down.select(_each(("a", "b"), ("u", "least"), ("v", "least")))
    return stars.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``links`` (columns ``a, b``): the least id reachable.

    Each round replaces the links by stars around ever lesser ids, so the number of links
    never grows and the rounds are about the logarithm of the longest path. Ends when a
    round changes nothing. Only counts reach the driver.
    """
    ordered = links.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    state = stored(ordered.distinct(), "links")
    mark = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        state = stored(_small_star(_large_star(state)), "links")
    roots = state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
