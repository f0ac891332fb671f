"""Mix sources to target weights by Poisson replication."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from paperloom.llm.common import free_name
from paperloom.session import write_through

#: rates are broadcast up to so many table entries (8 bytes each); beyond, they are joined by a shuffle
BROADCAST_ENTRIES = 1_000_000
#: shares of a source in that join, so that the texts of a hot one spread
SALTS = 64
#: hash digits of a uniform number: 12 hex digits, 48 bits
DIGITS = 12


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    value = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")
    return (value.cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """``rates(source, rate)`` with ``sums``: P(X <= k) for k = 0, 1, ... as an array, up to ten deviations past the mean.

    One row per source and k, added up in order, so the work follows the length of the tables. Terms are
    logarithms, so that large rates don't underflow.
    """
    last = F.ceil(F.col("rate") + F.lit(10.0) * F.sqrt("rate") + F.lit(20.0)).cast("int")
    each = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), F.when(F.col("rate") > 0, last).otherwise(0))).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = F.when(F.col("k") > 0, F.log("rate") - F.log(F.col("k").cast("double"))).otherwise(-F.col("rate"))
    terms = each.withColumn("term", F.when(F.col("rate") > 0, F.exp(F.sum(steps).over(upto))).otherwise(1.0))
    summed = terms.withColumn("below", F.sum("term").over(upto))
    listed = summed.groupBy("source", "rate").agg(F.array_sort(F.collect_list(F.struct("k", "below"))).alias("sums"))
    return listed.withColumn("sums", F.transform("sums", lambda s: s["below"]))


def source_rates(
    docs: DataFrame, source_col: str, *, weights: dict[str, float] | None, temperature: float, epochs: float,
) -> DataFrame:
    """One row per source: ``source``, ``rate`` (copies wanted per document) and its Poisson table.

    A source's target share is its weight over all weights; without weights, its share of rows
    to the power of ``temperature``, scaled to 1. Rate: epochs * rows of all * share / rows of it.
    Only ratios of weights matter. A weight that is negative or not finite is an error, and so are ``epochs`` of that kind.
    """
    if not (math.isfinite(epochs) and epochs >= 0 and math.isfinite(temperature)):
        raise ValueError(f"epochs {epochs} and temperature {temperature} must be finite, epochs not negative")
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        bad = {k: v for k, v in weights.items() if not (math.isfinite(v) and v >= 0)}
        if bad:
            raise ValueError(f"weights must be finite and not negative: {bad}")
        listed = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()],
            T.StructType([T.StructField("named", T.StringType()), T.StructField("weight", T.DoubleType())]),
        )
        weighed = counts.join(listed, F.col("source").cast("string").eqNullSafe(F.col("named")), "left").drop("named")
        weighed = weighed.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    weighed = write_through(weighed)
    most = weighed.agg(F.max("weight")).first()[0] or 0.0
    # of the largest weight, as decimals: the sum is then the same in any order
    scaled = weighed.withColumn("weight", F.col("weight") / F.lit(most) if most else F.lit(0.0))
    whole = scaled.agg(F.sum("n"), F.sum(F.col("weight").cast("decimal(38,18)"))).first()
    all_n, all_weight = whole[0] or 0, float(whole[1] or 0)
    share = F.col("weight") / F.lit(all_weight) if all_weight else F.lit(0.0)
    rate = F.lit(float(epochs)) * F.lit(all_n) * share / F.col("n")
    return poisson_tables(scaled.select("source", rate.alias("rate")))


def mix(
    docs: DataFrame, *, source_col: str = "source", id_col: str = "doc_id", weights: dict[str | None, float] | None = None,
    temperature: float = 0.5, epochs: float = 1.0, seed: int = 42, marks: bool = True, text_col: str = "text",
) -> DataFrame:
    """Repeat each document a Poisson number of times, so that sources meet their target shares.

    The number is the Poisson quantile of a uniform number hashed from seed and id: it depends
    on no other row, and another run gives the same copies. With ``marks`` the result has two
    more columns: ``copy`` (0, 1, ...) and ``shuffle_key``. Rows are dealt over all partitions
    by a hash of seed, id and copy and ordered by it within them, which is a global shuffle.

    A null source is a source of its own (weight: key None). Sources that ``weights`` doesn't
    name have weight 0 and vanish. Rows that repeat an id are drawn alike. Source and text stand
    in for a null id, so only equal texts of a source are drawn alike. An empty table stays empty.
    """
    rates = source_rates(docs, source_col, weights=weights, temperature=temperature, epochs=epochs)
    sums, named, copy, key = (free_name(docs, c) for c in ("sums", "mix_source", "copy", "shuffle_key"))
    rates = write_through(rates.select(F.col("source").alias(named), F.col("sums").alias(sums)))
    text = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) if text_col in docs.columns else F.lit("")
    unnamed = F.concat_ws("|", F.lit("null"), F.coalesce(F.col(source_col).cast("string"), F.lit("null")), text)
    own = F.coalesce(F.col(id_col).cast("string"), unnamed)
    number = uniform(F.lit(seed), own)
    entries = rates.agg(F.sum(F.size(sums) + 1)).first()[0] or 0
    if entries <= BROADCAST_ENTRIES:
        drawn = docs.join(F.broadcast(rates), docs[source_col].eqNullSafe(F.col(named))).drop(named)
    else:
        salt = free_name(docs, "salt")
        of = f"of_{salt}"
        salted = rates.withColumn(of, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = docs.withColumn(salt, F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int")).join(
            salted, F.col(source_col).eqNullSafe(F.col(named)) & (F.col(salt) == F.col(of))).drop(named, salt, of)
    # sums below the number; without a lambda, which the optimizer may push to a side of the join that lacks its columns
    times = (F.array_position(F.sort_array(F.array_append(F.col(sums), number)), number) - 1).cast("int")
    many = (
        drawn.withColumn(sums, times).where(F.col(sums) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(sums) - 1))).drop(sums)
        .withColumn(key, F.md5(F.concat_ws(
            "|", F.lit(f"deal{seed}"), own, F.col(copy))))
    )
    dealt = many.repartition(key).sortWithinPartitions(key)
    return dealt if marks else dealt.drop(copy, key)
