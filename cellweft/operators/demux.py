"""Hashtag demultiplexing: CLR, clusters, negative-binomial cutoffs, classes."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .families import lgamma
from .qc import class_flags


def clr(long: DataFrame) -> DataFrame:
    """Centred log ratio of each cell: log1p(x / exp(sum of log1p of positives / features))."""
    n = long.select("feature").distinct().count()
    logs = long.groupBy("barcode").agg((F.sum(F.when(F.col("count") > 0, F.log1p("count"))) / n).alias("_g"))
    return long.join(logs, "barcode").withColumn("clr", F.log1p(F.col("count") / F.exp(F.coalesce("_g", F.lit(0.0))))).drop("_g")


def nb_quantile(mean: float, variance: float, q: float) -> int:
    """Least count whose negative-binomial (or, without excess, Poisson) distribution function reaches q."""
    mean = max(mean, 1e-9)
    k = np.arange(0, int(mean + 20 * np.sqrt(max(variance, mean)) + 50))
    if variance > mean:
        size = mean * mean / (variance - mean)
        logp = lgamma(k + size) - lgamma(np.full(len(k), size)) - lgamma(k + 1.0) + size * np.log(size / (size + mean)) + k * np.log(mean / (size + mean))
    else:
        logp = k * np.log(mean) - mean - lgamma(k + 1.0)
    return int(np.searchsorted(np.cumsum(np.exp(logp)), q))


def cutoffs(long: DataFrame, quantile: float = 0.99, seed: int = 0) -> DataFrame:
    """feature and cutoff: clusters of the CLR profiles, one more than hashtags; each tag's background is the
    cluster of least mean, without its top half percent."""
    tags = sorted(r.feature for r in long.select("feature").distinct().collect())
    wide = clr(long).groupBy("barcode").pivot("feature", tags).agg(F.first("clr")).na.fill(0.0)
    data = wide.select("barcode", array_to_vector(F.array(*(F.col(f"`{t}`") for t in tags))).alias("features"))
    clusters = KMeans(k=len(tags) + 1, seed=seed, maxIter=50).fit(data).transform(data).select("barcode", "prediction")
    counts = long.join(clusters, "barcode")
    means = counts.groupBy("feature", "prediction").agg(F.avg("count").alias("m"))
    low = means.withColumn("_r", F.row_number().over(Window.partitionBy("feature").orderBy("m", "prediction"))).where("_r = 1").select("feature", "prediction")
    back = counts.join(F.broadcast(low), ["feature", "prediction"])
    top = back.groupBy("feature").agg(F.percentile("count", F.lit(0.995)).alias("_top"))
    stats = back.join(F.broadcast(top), "feature").where("count <= _top").groupBy("feature").agg(F.avg("count").alias("mean"), F.coalesce(F.var_samp("count"), F.lit(0.0)).alias("variance"))
    rows = [(r.feature, nb_quantile(r["mean"], r.variance, quantile)) for r in stats.collect()]
    return long.sparkSession.createDataFrame(rows, "feature string, cutoff bigint")


def demux(long: DataFrame, quantile: float = 0.99, seed: int = 0) -> DataFrame:
    """barcode, class (Negative, Singlet, Doublet), first and second tag, margin of their CLR, and flags."""
    marked = clr(long).join(F.broadcast(cutoffs(long, quantile, seed)), "feature")
    got = marked.groupBy("barcode").agg(F.count_if(F.col("count") > F.col("cutoff")).alias("positives"), F.reverse(F.array_sort(F.collect_list(F.struct("clr", "feature")))).alias("top"))
    cls = F.when(F.col("positives") == 0, "Negative").when(F.col("positives") == 1, "Singlet").otherwise("Doublet")
    second = F.get("top", F.lit(1))
    out = got.select("barcode", cls.alias("hto_classification"), F.get("top", F.lit(0))["feature"].alias("donor_id"), second["feature"].alias("second_id"), (F.get("top", F.lit(0))["clr"] - F.coalesce(second["clr"], F.lit(0.0))).alias("hto_margin"))
    return class_flags(out)
