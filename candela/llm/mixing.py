"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from candela.llm.common import free_names, key_text, stored, unit


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, temper: float = 0.7, epochs: float = 1.0,
                 source: str = "source", text: str = "text") -> DataFrame:
    """``source, size, rate`` per source: how often a document of it should appear on average.

    Size: UTF-8 bytes plus one per document. Target share: the given weights (a source that they do not name gets
    none), or size to the power ``temper``. The budget is ``epochs`` times all sizes; rate = share * budget / size.
    A null source is a source of its own (never named by weights). The counts cover all rows and merge before the shuffle.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(temper))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    sizes = stored(sizes.withColumn("weight", weight), "sizes")
    all_size, all_weight = sizes.agg(F.sum("size")).scalar(), sizes.agg(F.sum("weight")).scalar()
    return sizes.select("source", "size", F.when(all_weight > 0, F.col("weight") / all_weight * (all_size * F.lit(float(epochs))) / F.col("size"))
                        .otherwise(F.lit(0.0)).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """Adds ``least`` and ``cdf``: the distribution's steps from ``least`` on, ten deviations and 20 to either side.

    Weights are summed as logarithms from the least count, then normalised, so neither small nor large rates under- or
    overflow. The steps are rows per (source, count), not per document.
    """
    r = F.col("rate")
    least = F.when(r > 0, F.greatest(F.lit(0.0), F.floor(r - 10 * F.sqrt(r) - 20))).otherwise(0.0).cast("long")
    most = F.when(r > 0, F.ceil(r + 10 * F.sqrt(r) + 20)).otherwise(0.0).cast("long")
    steps = rates.withColumn("least", least).withColumn("k", F.explode(F.sequence("least", most)))
    up = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    steps = steps.withColumn("w", F.sum(F.when(F.col("k") > F.col("least"), F.log("rate") - F.log("k")).otherwise(0.0)).over(up))
    steps = steps.withColumn("w", F.exp(F.col("w") - F.max("w").over(whole)))
    steps = steps.withColumn("p", F.sum("w").over(up)).withColumn("p", F.col("p") / F.max("p").over(whole))
    return (steps.groupBy("source", "rate", "least").agg(F.sort_array(F.collect_list("p")).alias("cdf")))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temper: float = 0.7, epochs: float = 1.0, seed: int = 7,
        key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every document as often as the inverse Poisson distribution of its source's rate says, dealt in random order.

    Result: the documents' columns and ``copy`` (from 0), ``n_copies``, ``rate`` and ``order_key``, by which the rows are
    spread over all tasks and sorted in them; input columns of these names are replaced, all others are kept whatever
    they are called. The draw is a hash of seed, key and text: a rerun or a lost task gives the same copies, rows without a
    key or of one key are drawn one by one, and only rows that repeat key and text share their count; these too are spread
    over all tasks. A document may get no copy: that is the sampling. The rate table is joined by source; the optimizer
    checks its written size before it broadcasts it, and a hot source is never grouped.
    """
    rows = docs.drop("copy", "n_copies", "rate", "order_key")
    s, rate, least, cdf, u, base, spread = free_names(rows, 7)
    plan = stored(poisson_steps(source_rates(docs, weights, temper, epochs, source, text)), "rates")
    plan = plan.select(F.col("source").alias(s), F.col("rate").alias(rate), F.col("least").alias(least), F.col("cdf").alias(cdf))
    rows = rows.join(plan, F.col(source).eqNullSafe(F.col(s)))
    drawn = [F.lit(str(seed)), key_text(F.col(key)), F.md5(F.coalesce(F.col(text), F.lit("")))]
    n = F.col(least) + F.size(F.filter(cdf, lambda p: p <= F.col(u)))
    rows = (rows.withColumn(base, F.concat_ws(":", *drawn)).withColumn(u, unit(F.col(base))).withColumn("n_copies", n.cast("long"))
            .withColumnRenamed(rate, "rate").drop(s, least, cdf, u))
    rows = rows.select("*", F.posexplode(F.array_repeat(F.lit(0), F.col("n_copies").cast("int"))).alias("copy", u)).drop(u)
    rows = rows.withColumn("order_key", F.substring(F.md5(F.concat_ws(":", base, F.col("copy").cast("string"))), 1, 16))
    rows = rows.withColumn(spread, F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    return rows.repartition("order_key", spread).sortWithinPartitions("order_key").drop(base, spread)
