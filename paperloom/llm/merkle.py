"""Merkle manifest of a dataset: one tree per group, a tree over the groups, and a proof for every row.

Rows get their rank within the group; its base-``arity`` digits name the nodes above them. Inside blocks of
``arity ** levels`` consecutive rows the lowest digit is grouped away again and again, each time nesting
the children's structs, so a block ends as one nested row. Transforms over the nested row give each leaf the digests
beside its path, and one explode emits them: no join meets a leaf. The blocks' digests are the leaves of the same rollup one
storey up, until a group has one node; a storey hands its proofs down by one join of block rows.
"""

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.common import free_name
from paperloom.session import write_through

#: rows of a table, one per part of the ranking, up to which it is broadcast (24 bytes and a group's name each)
BROADCAST_ROWS = 100_000
#: a partition's rows are numbered from its number times this
PART = 1 << 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*fields: Column) -> Column:
    """sha256 of all fields, each ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    def framed(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*(framed(f) for f in fields))


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rank`` within ``tree`` by ``order`` and the tree's ``size``; rows that tie in all of it are told apart anyhow.

    Rows are dealt by range, so a hot tree spreads, and numbered where they lie; each part's first rank comes
    from the counts of the parts before it.
    """
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie")
    stored = write_through(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = write_through(stored.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n")))
    w = "PARTITION BY tree ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    starts = counts.select(
        F.col("tree").alias("of"), F.col("part").alias("of_part"), "first",
        F.coalesce(F.expr(f"sum(n) OVER ({w})"), F.lit(0)).alias("before"), F.expr("sum(n) OVER (PARTITION BY tree)").alias("size"))
    found = stored.join(
        _small(starts, counts.count()), F.col("tree").eqNullSafe(F.col("of")) & (part == F.col("of_part")))
    return found.withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("of", "of_part", "first", "before", "at")


def _height(size: Column, arity: int) -> Column:
    """Levels of a tree with so many leaves; exact, as logarithms aren't."""
    return F.size(F.filter(F.array(*(F.lit(arity**k) for k in range(63) if arity**k < 1 << 63)), lambda top: top < size)).cast("int")


def _rolled(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """One nested row per tree and block: ``digest`` and ``children``, from ``nodes(tree, rank, height, digest, leaf)``.

    ``height`` is what is left of the tree's levels here; past it a lone node is passed up as it is.
    """
    place = F.col("rank")
    digits = [(F.floor(place / arity**k) % arity).cast("int").alias(f"d{k}") for k in range(levels)]
    block = F.floor(place / arity**levels).cast("long").alias("block")
    rows = nodes.select("tree", block, "height", *digits, "digest", "leaf").repartition("tree", "block")
    child = F.struct("d0", "digest", "leaf")
    for k in range(levels):
        keys = ["tree", "block", "height", *(f"d{j}" for j in range(levels - 1, k, -1))]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(child)).alias("children"))  # by digit
        joined = digest(F.array_join(F.transform("children", lambda c: c["digest"]), ""))
        rows = rows.withColumn("digest", F.when(F.col("height") > k, joined).otherwise(F.col("children")[0]["digest"]))
        child = F.struct(f"d{k + 1}", "digest", "children") if k + 1 < levels else None
    return rows


def _leaves(rolled: DataFrame, levels: int, above: Column) -> DataFrame:
    """The leaves of nested blocks, each with its ``proof``: the digests left and right of its path, upwards."""
    def beside(children: Column, i: Column) -> Column:
        joined = lambda part: F.array_join(F.transform(part, lambda c: c["digest"]), "")
        return F.struct(
            joined(F.slice(children, F.lit(1), i)).alias("left"),
            joined(F.slice(children, i + 2, F.size(children))).alias("right"))

    def down(children: Column, level: int, path: Column) -> Column:
        def at(c: Column, i: Column) -> Column:
            longer = F.when(F.col("height") >= level, F.concat(F.array(beside(children, i)), path)).otherwise(path)
            if level == 1:
                return F.array(F.struct(c["leaf"].alias("leaf"), c["digest"].alias("digest"), longer.alias("proof")))
            return down(c["children"], level - 1, longer)

        return F.flatten(F.transform(children, at))

    every = F.explode(down(F.col("children"), levels, above)).alias("e")
    return rolled.select("tree", "subroot", every).select("tree", "subroot", "e.leaf", "e.digest", "e.proof")


def _tree(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes(tree, rank, height, digest, leaf)`` with ``subroot`` and ``proof`` up to it."""
    rolled = _rolled(nodes, arity, levels).withColumn("left_over", F.greatest(F.col("height") - levels, F.lit(0)))
    rolled = write_through(rolled)
    tops = rolled.agg(F.max("left_over")).first()[0] or 0
    none = F.array().cast("array<struct<left:string,right:string>>")
    if not tops:
        return _leaves(rolled.withColumn("subroot", F.col("digest")), levels, none)
    storey = rolled.select(
        "tree", F.col("block").alias("rank"), F.col("left_over").alias("height"), "digest", F.struct("block").alias("leaf"))
    above = _tree(storey, arity, levels).select(
        F.col("tree").alias("of"), F.col("leaf.block").alias("of_block"), "subroot", F.col("proof").alias("above"))
    joined = rolled.join(above, F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")))
    return _leaves(joined, levels, F.col("above"))


def manifest(
    docs: DataFrame, *, fields: tuple = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang",
    order_col: str = "doc_id", arity: int = 8, levels: int = 4, carry: dict[str, Column] | None = None,
) -> DataFrame:
    """``order_col``, group_col, the ``carry`` columns, ``leaf``, ``subroot``, ``root`` and ``proof`` of every row.

    ``leaf`` is ``leaf_digest`` of the fields. Per group, leaves in order of ``order_col`` become nodes, ``arity`` consecutive
    ones at a time, until one is left, the ``subroot``; the subroots in order of their group become the ``root`` likewise. ``proof``
    lists, from the leaf upwards, the digests left and right of the path, so that ``folded`` gives the root. A row moves
    as its digests, never with its text; a block holds ``arity ** levels`` rows at most, whatever the size of a group.

    A null group is a group, the first; null ids come first within a group. Rows that repeat an id are leaves of their
    own, ordered by digest; equal rows are interchangeable. Null fields differ from empty ones. A lone leaf
    is its subroot, and a lone subroot the root. An empty table gives no rows. Further columns change nothing.
    """
    carry = carry or {}
    names = [free_name(docs, n) for n in carry]
    rows = docs.select(
        F.col(group_col).alias("tree"), F.col(order_col).alias("id"), leaf_digest(*(F.col(f) for f in fields)).alias("digest"),
        *(c.alias(n) for n, c in zip(names, carry.values(), strict=True)))
    leaf = F.struct("id", *names).alias("leaf")
    ranked = _ranked(rows, ["id", "digest"])
    nodes = ranked.select("tree", "rank", _height(F.col("size"), arity).alias("height"), "digest", leaf)
    proved = write_through(_tree(nodes, arity, levels))
    # the groups' own tree: one leaf per group
    groups = proved.groupBy("tree").agg(F.first("subroot").alias("digest"))
    groups = _ranked(groups.select(F.lit(0).alias("tree"), F.col("tree").alias("group"), "digest"), ["group"])
    top = _tree(groups.select(
        "tree", "rank", _height(F.col("size"), arity).alias("height"), "digest", F.struct("group").alias("leaf")), arity, levels)
    top = write_through(top.select(F.col("leaf.group").alias("of"), F.col("subroot").alias("root"), F.col("proof").alias("last")))
    found = proved.join(_small(top, top.count()), F.col("tree").eqNullSafe(F.col("of")))
    return found.select(
        F.col("leaf.id").alias(order_col), F.col("tree").alias(group_col), *(F.col("leaf")[n].alias(m) for n, m in zip(names, carry, strict=True)),
        F.col("digest").alias("leaf"), "subroot", "root", F.concat("proof", "last").alias("proof"))


def proof_digest(proof: Column) -> Column:
    """sha256 of all digests beside the path, upwards, left to right."""
    return digest(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, p: digest(p["left"], node, p["right"]))
