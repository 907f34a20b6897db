"""Bootstrap confidence intervals from a table of replicate values.

Replicate values of one group number at most ``n_iter``; they are gathered
into one sorted array per group, a size bound the caller fixes.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootframe.functions.normal import norm_ppf
from bootframe.functions.quantiles import nearest_quantile, quantile_agg, sorted_values


def ci_names(ci: float) -> tuple[str, str]:
    """Column names of the bounds, e.g. ``ci95_ll`` / ``ci95_ul`` for ``ci=0.95``."""
    tag = f"{ci * 100:g}".replace(".", "_")
    return f"ci{tag}_ll", f"ci{tag}_ul"


def percentile_ci(
    reps: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    ci: float = 0.95,
    interpolation: str = "nearest",
) -> DataFrame:
    """Percentile interval: (keys..., median, ciXX_ll, ciXX_ul) over the replicate values.

    ``median`` is the median of the replicates (the reported point estimate);
    the bounds are the (1-ci)/2 and (1+ci)/2 quantiles. NULL replicate values are
    ignored; a group absent from some replicates rests on fewer values.
    """
    if not 0 < ci < 1:
        raise ValueError("ci must be in (0, 1)")
    ll, ul = ci_names(ci)
    lo, hi = (1 - ci) / 2, (1 + ci) / 2
    if interpolation == "nearest":
        # one sorted array (≤ n_iter values) serves the median and both bounds
        dist = reps.groupBy(*keys).agg(sorted_values(F.col(value)).alias("_sorted"))
        arr = F.col("_sorted")
        m = F.size(arr)
        mid = F.lit(0.5) * F.try_element_at(arr, F.floor((m + F.lit(1)) / F.lit(2)).cast("int")) + F.lit(
            0.5
        ) * F.try_element_at(arr, (F.floor(m / F.lit(2)) + F.lit(1)).cast("int"))
        return dist.select(
            *keys,
            F.when(m > 0, mid).alias("median"),
            nearest_quantile(arr, lo).alias(ll),
            nearest_quantile(arr, hi).alias(ul),
        )
    return reps.groupBy(*keys).agg(
        F.median(F.col(value)).alias("median"),
        quantile_agg(value, lo, interpolation).alias(ll),
        quantile_agg(value, hi, interpolation).alias(ul),
    )


def _finite(t: Column) -> Column:
    return t.isNotNull() & ~F.isnan(t) & (F.abs(t) != F.lit(float("inf")))


def _with_basic_quantile(df: DataFrame, tstar: str, alpha: float, out: str) -> DataFrame:
    """Add ``out``: the order statistic at ``(R+1)·alpha`` of sorted array ``tstar``.

    ``rk = (R+1)α``, ``k = trunc(rk)``: integral rk → t_(k); k = 0 → t_(1);
    k = R → t_(R); otherwise ``t_(k) + (Φ⁻¹(α) − Φ⁻¹(k/(R+1))) /
    (Φ⁻¹((k+1)/(R+1)) − Φ⁻¹(k/(R+1))) · (t_(k+1) − t_(k))`` (Davison & Hinkley 1997, eq. 5.8).
    Built in stages so every Φ⁻¹ works on a plain column.
    """
    R = F.size(F.col(tstar))
    staged = df.withColumn("_R", R).withColumn("_rk", (F.col("_R") + F.lit(1)).cast("double") * F.lit(float(alpha)))
    staged = staged.withColumn("_k", F.floor(F.col("_rk")).cast("int"))
    staged = staged.withColumn("_pk", F.col("_k").cast("double") / (F.col("_R") + F.lit(1)).cast("double"))
    staged = staged.withColumn("_pk1", (F.col("_k") + F.lit(1)).cast("double") / (F.col("_R") + F.lit(1)).cast("double"))
    # One row per key reaches this point; evaluating Φ⁻¹ inside a lambda keeps its
    # polynomial branches out of the fused whole-stage code (64 KB method limit).
    staged = staged.withColumn("_z", F.transform(F.array(F.col("_pk"), F.col("_pk1")), norm_ppf))
    staged = staged.withColumn("_zk", F.col("_z")[0]).withColumn("_zk1", F.col("_z")[1])
    t = F.col(tstar)
    k = F.col("_k")
    tk = F.try_element_at(t, F.greatest(k, F.lit(1)))
    tk1 = F.try_element_at(t, F.least(k + F.lit(1), F.col("_R")))
    z_a = F.lit(float(norm_ppf_value(alpha)))
    interp = tk + (z_a - F.col("_zk")) / (F.col("_zk1") - F.col("_zk")) * (tk1 - tk)
    value = (
        F.when(F.col("_R") == 0, F.lit(None).cast("double"))
        .when(F.col("_rk") == k.cast("double"), tk)
        .when(k <= 0, F.try_element_at(t, F.lit(1)))
        .when(k >= F.col("_R"), F.try_element_at(t, F.col("_R")))
        .otherwise(interp)
    )
    return staged.withColumn(out, value).drop("_R", "_rk", "_k", "_pk", "_pk1", "_z", "_zk", "_zk1")


def norm_ppf_value(p: float) -> float:
    """Φ⁻¹(p) on the driver, for constants."""
    return NormalDist().inv_cdf(p)


def basic_ci(
    reps: DataFrame,
    t0: DataFrame,
    keys: Sequence[str],
    value: str = "t",
    estimate: str = "d",
    conf: float = 0.95,
) -> DataFrame:
    """Basic bootstrap interval: (keys..., estimate, ci_level, ci_ll, ci_ul).

    ``ll = 2·t0 − t*((R+1)(1+conf)/2)``, ``ul = 2·t0 − t*((R+1)(1−conf)/2)``;
    non-finite replicates are dropped first (R = number left). ``t0`` holds
    one row per key with column ``estimate``; it is as small as the key set.
    """
    t = F.col(value)
    dist = reps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(_finite(t), t))).alias("_tstar"))
    dist = _with_basic_quantile(dist, "_tstar", (1 + conf) / 2, "_hi")
    dist = _with_basic_quantile(dist, "_tstar", (1 - conf) / 2, "_lo").drop("_tstar")
    e = F.col(estimate)
    # t0 has one row per key (as many as the scales): the join is small on both sides.
    joined = t0.join(dist, list(keys), "left") if keys else t0.join(dist, how="left")
    return joined.select(
        *keys,
        e,
        F.lit(float(conf)).alias("ci_level"),
        (F.lit(2.0) * e - F.col("_hi")).alias("ci_ll"),
        (F.lit(2.0) * e - F.col("_lo")).alias("ci_ul"),
    )
