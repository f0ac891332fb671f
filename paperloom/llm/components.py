"""Connected components of a link table, by alternating stars."""

from pyspark.sql import DataFrame, functions as F

from paperloom.session import write_through


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its least one."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return (
        both.where(F.col("b") > F.col("a")).join(least, "a")
        .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to its least one."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of a link table (a, b), nodes being longs.

    Each round halves paths at least, so rounds grow with the logarithm of the longest one. A
    node's links are never gathered: both stars are a minimum per node, combined before the
    shuffle, and a join that adaptive execution can split where a node has very many links. Each
    round is written to the checkpoint folder. Links to itself and repeated links change nothing.
    Nodes without a link to another aren't returned.
    """
    links = write_through(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    before = mark(links)
    while before[0]:
        links = write_through(_small_star(_large_star(links)))
        now = mark(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
