"""Token usage rows and calibration of bytes per token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomtext.functions.models import Limits

WINDOW = 4096


def clipped(n_inputs: Column, tokens: Column, max_tokens: Column) -> Column:
    """A single input that fills the budget was cut by the server."""
    return (tokens > 0) & (max_tokens > 0) & (n_inputs == 1) & (tokens >= max_tokens)


def usage_row(model: Column, n_inputs: Column, n_bytes: Column, tokens: Column, limits: Limits) -> Column:
    """The usage struct, null where the server reported no tokens."""
    most = F.lit(limits.max_tokens)
    row = F.struct(model.alias("model"), n_inputs.alias("inputs"), n_bytes.alias("bytes"), tokens.alias("tokens"), most.alias("max_tokens"), clipped(n_inputs, tokens, most).alias("clipped"))
    return F.when(tokens > 0, row)


def percentile(values: Column, p: int) -> Column:
    """Element n * p / 100 of the sorted values, the last at most."""
    n = F.size(values)
    return F.get(F.array_sort(values), F.least(F.floor(n * p / 100), n - 1).cast("int"))


def calibration(log: DataFrame, window: int = WINDOW) -> DataFrame:
    """model, samples, clipped, min, p10, median, mean from log(seq, model, bytes, tokens, clipped).

    The last ``window`` unclipped rows of a model count; a model with clipped rows only has 0 samples.
    With spark.sql.optimizer.windowGroupLimitThreshold above ``window`` each task sends on at most
    ``window`` rows a model; the setting is raised here for that."""
    spark = log.sparkSession
    if int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")) <= window:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(window + 1))
    seen = log.where("tokens > 0 AND bytes > 0")
    totals = seen.groupBy("model").agg(F.sum(F.col("clipped").cast("bigint")).alias("clipped"))
    last = Window.partitionBy("model").orderBy(F.desc("seq"))
    recent = seen.where("NOT clipped").select("model", "seq", (F.col("bytes") / F.col("tokens")).alias("r"))
    recent = recent.withColumn("n", F.row_number().over(last)).where(F.col("n") <= window)
    stats = recent.groupBy("model").agg(F.count("*").alias("samples"), F.min("r").alias("min"), F.collect_list("r").alias("rs"), F.avg("r").alias("mean"))
    out = totals.join(stats, "model", "left")
    return out.select("model", F.coalesce("samples", F.lit(0)).alias("samples"), "clipped", "min", percentile(F.col("rs"), 10).alias("p10"), percentile(F.col("rs"), 50).alias("median"), "mean")
