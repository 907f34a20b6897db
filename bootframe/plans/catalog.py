"""Registered queries over the driver's tables, each with an equivalent DuckDB SQL oracle.

Every query reads whole tables. Bootstrap queries use ``hash="md5"`` so that
DuckDB reproduces each draw exactly; doubles are rounded to 10 significant digits in
both engines by the same arithmetic (summation order differs at the 1e-15 level).
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bootframe.functions.draws import poisson_weight_sql
from bootframe.operators.columns import drop_columns, match_columns, string_columns
from bootframe.operators.reshape import to_long
from bootframe.operators.resample import exact_weights, row_index
from bootframe.operators.stats import cohens_d, group_quantiles, group_stats, grouping_sets_stats, level_counts, profile
from bootframe.plans.bootstrap import (
    boot_cohens_d,
    boot_custom,
    boot_custom_pandas,
    boot_stats,
    boot_stats_sets,
)

SEED = 42
DIGITS = 10  # significant digits compared

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: grid factor 1 + 2^-20 (exact in binary): the rounding grid is not a decimal one
GRID = 1.0 + 2.0**-20


def round_sig(x, digits: int = DIGITS):
    """Quantise to about ``digits`` significant digits with plain IEEE arithmetic, identical in any engine.

    ``e = floor(log10|x|)``, ``scale = 10^(digits-1-e) · GRID``, result
    ``floor(x·scale + 0.5) / scale``. Values outside [1e-200, 10^(digits-1)) pass
    unchanged. The grid step is deliberately not a power of ten: averages of short
    decimals often end exactly in 5 at some decimal place, and on a decimal grid such
    a tie is decided by summation-order noise (which differs between engines).
    Spark's ``round`` is also avoided: it rounds the decimal string, DuckDB the binary value.
    """
    ax = F.abs(x)
    e = F.floor(F.log10(ax))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - e) * F.lit(GRID)
    ok = (ax > F.lit(1e-200)) & (ax < F.lit(float(10 ** (digits - 1))))
    return F.when(ok, F.floor(x * scale + F.lit(0.5)) / scale).otherwise(x)


#: constant parameter columns, reported as given
UNROUNDED = ("ci_level",)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Quantise every computed DOUBLE column (for value comparison across engines)."""
    return df.select(
        *[
            round_sig(F.col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) and f.name not in UNROUNDED
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# --------------------------------------------------------------------------- SQL helpers


def _r(expr: str, digits: int = DIGITS) -> str:
    """SQL twin of :func:`round_sig`."""
    x = f"CAST(({expr}) AS DOUBLE)"
    scale = f"(pow(CAST(10.0 AS DOUBLE), {digits - 1} - floor(log10(abs({x})))) * CAST('{GRID!r}' AS DOUBLE))"
    ok = f"abs({x}) > CAST('1e-200' AS DOUBLE) AND abs({x}) < CAST('{float(10 ** (digits - 1))!r}' AS DOUBLE)"
    return f"(CASE WHEN {ok} THEN floor({x} * {scale} + 0.5) / {scale} ELSE {x} END)"


def _dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def sql_index(tbl: str, key: str, cols: list[str], measures: list[str]) -> str:
    sel = ", ".join([*cols, *[f"CAST({m} AS DOUBLE) AS {m}" for m in measures]])
    return f"SELECT row_number() OVER (ORDER BY {key}) - 1 AS i, {sel} FROM {tbl}"


def sql_draws(n_iter: int, seed: int = SEED) -> str:
    """All draws (r, i) over CTE ``idx``: draw s = idx.i of replicate r."""
    return (
        f"SELECT t.r, ('0x' || substr(md5(concat_ws('|', '{seed}', t.r::VARCHAR, idx.i::VARCHAR)), 1, 15))::BIGINT"
        f" % nn.n AS i FROM range(0, {n_iter}) t(r) CROSS JOIN idx CROSS JOIN (SELECT count(*) AS n FROM idx) nn"
    )


def sql_nearest(value: str, q: float) -> str:
    return (
        f"list_extract(list_sort(list({value}) FILTER (WHERE {value} IS NOT NULL)),"
        f" CAST(floor(CAST(count({value}) - 1 AS DOUBLE) * {_dbl(q)} + 0.5) AS BIGINT) + 1)"
    )


def sql_percentile_ci(src: str, keys: list[str], value: str = "value") -> str:
    k = ", ".join(keys)
    sel = f"{k}, " if keys else ""
    grp = f" GROUP BY {k}" if keys else ""
    return (
        f"SELECT {sel}{_r(f'median({value})')} AS median, {_r(sql_nearest(value, 0.025))} AS ci95_ll,"
        f" {_r(sql_nearest(value, 0.975))} AS ci95_ul FROM {src}{grp}"
    )


def sql_long_stats(src: str, keys: list[str], scales: list[str]) -> str:
    """(keys..., scale, stat, value) from CTE ``src`` holding mean_<s> / median_<s> columns."""
    parts = []
    for s in scales:
        for st in ("mean", "median"):
            parts.append(f"SELECT {', '.join([*keys, ''])}'{s}' AS scale, '{st}' AS stat, {st}_{s} AS value FROM {src}")
    return " UNION ALL ".join(parts)


def sql_rep_aggs(scales: list[str]) -> str:
    return ", ".join(f"avg({s}) AS mean_{s}, median({s}) AS median_{s}" for s in scales)


def sql_boot_stats(tbl: str, key: str, by: list[str], scales: list[str], n_iter: int, seed: int = SEED) -> str:
    keys = [*by, "r"]
    return f"""
WITH idx AS ({sql_index(tbl, key, by, scales)}),
draws AS ({sql_draws(n_iter, seed)}),
reps AS (SELECT {', '.join(keys)}, {sql_rep_aggs(scales)} FROM draws JOIN idx USING (i) GROUP BY {', '.join(keys)}),
long AS ({sql_long_stats('reps', keys, scales)})
{sql_percentile_ci('long', [*by, 'scale', 'stat'])}"""


# --------------------------------------------------------------------------- queries

LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_select_by_regex(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", *match_columns(li, r"^l_(quantity|extendedprice|discount|tax)$"))


SQL_SELECT_BY_REGEX = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem"


def q_melt_long(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return rounded(to_long(part, ["p_partkey", "p_brand"], ["p_size", "p_retailprice"], "scale", "value"))


SQL_MELT_LONG = f"""
SELECT p_partkey, p_brand, 'p_size' AS scale, {_r('CAST(p_size AS DOUBLE)')} AS value FROM part
UNION ALL SELECT p_partkey, p_brand, 'p_retailprice', {_r('CAST(p_retailprice AS DOUBLE)')} FROM part"""


def q_group_mean_median(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return rounded(group_stats(li, ["l_returnflag", "l_linestatus"], LINE_MEASURES))


SQL_GROUP_MEAN_MEDIAN = f"""
WITH g AS (SELECT l_returnflag, l_linestatus, {sql_rep_aggs(LINE_MEASURES)} FROM lineitem GROUP BY ALL),
long AS ({sql_long_stats('g', ['l_returnflag', 'l_linestatus'], LINE_MEASURES)})
SELECT l_returnflag, l_linestatus, scale, stat, {_r('value')} AS value FROM long"""


LINE_SETS = [["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"], []]


def q_grouping_sets_stats(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return rounded(grouping_sets_stats(li, LINE_SETS, LINE_MEASURES))


def _sql_grouping_sets() -> str:
    parts = []
    for s in LINE_SETS:
        cols = ["l_returnflag", "l_linestatus"]
        sel = ", ".join(c if c in s else f"CAST(NULL AS VARCHAR) AS {c}" for c in cols)
        grp = f" GROUP BY {', '.join(s)}" if s else ""
        parts.append(f"SELECT '{','.join(s)}' AS set, {sel}, {sql_rep_aggs(LINE_MEASURES)} FROM lineitem{grp}")
    body = " UNION ALL ".join(parts)
    return f"""
WITH g AS ({body}),
long AS ({sql_long_stats('g', ['set', 'l_returnflag', 'l_linestatus'], LINE_MEASURES)})
SELECT set, l_returnflag, l_linestatus, scale, stat, {_r('value')} AS value FROM long"""


SQL_GROUPING_SETS_STATS = _sql_grouping_sets()


def q_factor_levels(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    counts = level_counts(orders, "o_orderpriority")
    # one row per distinct level of a factor column: numbering them is a small window
    idx = row_index(counts, "level", index_col="level_no")
    return idx.df.select("level", (F.col("level_no") + 1).alias("level_no"), "n")


SQL_FACTOR_LEVELS = """
SELECT o_orderpriority AS level, row_number() OVER (ORDER BY o_orderpriority) AS level_no, count(*) AS n
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority"""


def q_default_categories(spark: SparkSession, sf: str) -> DataFrame:
    orders = drop_columns(table(spark, sf, "orders"), "o_orderkey")
    sets = [[c] for c in string_columns(orders)]
    return rounded(grouping_sets_stats(orders, sets, ["o_totalprice"]))


SQL_DEFAULT_CATEGORIES = f"""
WITH g AS (
  SELECT 'o_orderstatus' AS set, o_orderstatus, CAST(NULL AS VARCHAR) AS o_orderpriority, {sql_rep_aggs(['o_totalprice'])}
  FROM orders GROUP BY o_orderstatus
  UNION ALL
  SELECT 'o_orderpriority', CAST(NULL AS VARCHAR), o_orderpriority, {sql_rep_aggs(['o_totalprice'])}
  FROM orders GROUP BY o_orderpriority),
long AS ({sql_long_stats('g', ['set', 'o_orderstatus', 'o_orderpriority'], ['o_totalprice'])})
SELECT set, o_orderstatus, o_orderpriority, scale, stat, {_r('value')} AS value FROM long"""


def q_table_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile(table(spark, sf, "customer"))


SQL_TABLE_PROFILE = "SELECT count(*) AS n_rows, 5 AS n_cols FROM customer"


def q_quantile_rules(spark: SparkSession, sf: str) -> DataFrame:
    wanted = [(f"{rule}_{side}", q, rule) for rule in ("nearest", "disc", "linear") for side, q in (("lo", 0.025), ("hi", 0.975))]
    return rounded(group_quantiles(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", wanted))


SQL_QUANTILE_RULES = f"""
SELECT o_orderstatus,
  {_r(sql_nearest('o_totalprice', 0.025))} AS nearest_lo, {_r(sql_nearest('o_totalprice', 0.975))} AS nearest_hi,
  {_r(f'quantile_disc(o_totalprice, {_dbl(0.025)})')} AS disc_lo, {_r(f'quantile_disc(o_totalprice, {_dbl(0.975)})')} AS disc_hi,
  {_r(f'quantile_cont(o_totalprice, {_dbl(0.025)})')} AS linear_lo, {_r(f'quantile_cont(o_totalprice, {_dbl(0.975)})')} AS linear_hi
FROM orders GROUP BY o_orderstatus"""


def q_resample_weights(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "customer").count()
    w = exact_weights(spark, n, 20, SEED, "md5")
    return w.groupBy("r").agg(
        F.sum("w").alias("total_w"), F.count(F.lit(1)).alias("distinct_rows"), F.max("w").alias("max_w")
    )


SQL_RESAMPLE_WEIGHTS = f"""
WITH idx AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer),
draws AS ({sql_draws(20)}),
w AS (SELECT r, i, count(*) AS w FROM draws GROUP BY r, i)
SELECT r, sum(w)::BIGINT AS total_w, count(*) AS distinct_rows, max(w) AS max_w FROM w GROUP BY r"""


def q_boot_ci_one_key(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return rounded(boot_stats(c, "c_mktsegment", "c_custkey", ["c_acctbal"], n_iter=100, seed=SEED, hash="md5"))


SQL_BOOT_CI_ONE_KEY = sql_boot_stats("customer", "c_custkey", ["c_mktsegment"], ["c_acctbal"], 100)


def q_boot_ci_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return rounded(
        boot_stats(o, ["o_orderstatus", "o_orderpriority"], "o_orderkey", ["o_totalprice"], n_iter=40, hash="md5")
    )


SQL_BOOT_CI_TWO_KEYS = sql_boot_stats("orders", "o_orderkey", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], 40)


def q_boot_ci_global(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return rounded(boot_stats(e, [], "event_id", ["value"], n_iter=20, hash="md5"))


SQL_BOOT_CI_GLOBAL = f"""
WITH idx AS ({sql_index('events', 'event_id', [], ['value'])}),
draws AS ({sql_draws(20)}),
reps AS (SELECT r, {sql_rep_aggs(['value'])} FROM draws JOIN idx USING (i) GROUP BY r),
long AS ({sql_long_stats('reps', ['r'], ['value'])})
{sql_percentile_ci('long', ['scale', 'stat'])}"""


ORDER_SETS = [["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"]]


def q_boot_ci_sets_shared(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return rounded(boot_stats_sets(o, ORDER_SETS, "o_orderkey", ["o_totalprice"], n_iter=40, hash="md5"))


def q_boot_ci_sets_independent(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return rounded(
        boot_stats_sets(o, ORDER_SETS, "o_orderkey", ["o_totalprice"], n_iter=20, hash="md5", shared=False)
    )


def _sql_boot_sets(
    n_iter: int,
    shared: bool,
    sets: list[list[str]] = ORDER_SETS,
    tbl: str = "orders",
    key: str = "o_orderkey",
    measure: str = "o_totalprice",
) -> str:
    """Oracle for :func:`boot_stats_sets` (one measure): per set, its draws, replicate stats and interval."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    ctes = [f"idx AS ({sql_index(tbl, key, cols, [measure])})"]
    longs = []
    for k, s in enumerate(sets):
        seed = SEED if shared else SEED + k
        if not shared or k == 0:
            ctes.append(f"draws{k} AS ({sql_draws(n_iter, seed)})")
        draws = "draws0" if shared else f"draws{k}"
        sel = ", ".join(c if c in s else f"CAST(NULL AS VARCHAR) AS {c}" for c in cols)
        ctes.append(
            f"reps{k} AS (SELECT '{','.join(s)}' AS set, {sel}, r, {sql_rep_aggs([measure])}"
            f" FROM {draws} JOIN idx USING (i) GROUP BY {', '.join([*s, 'r'])})"
        )
        longs.append(sql_long_stats(f"reps{k}", ["set", *cols, "r"], [measure]))
    ctes.append(f"long AS ({' UNION ALL '.join(longs)})")
    return "WITH " + ",\n".join(ctes) + "\n" + sql_percentile_ci("long", ["set", *cols, "scale", "stat"])


SQL_BOOT_CI_SETS_SHARED = _sql_boot_sets(40, True)
SQL_BOOT_CI_SETS_INDEPENDENT = _sql_boot_sets(20, False)


def q_boot_ci_poisson(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return rounded(
        boot_stats(c, "c_mktsegment", "c_custkey", ["c_acctbal"], n_iter=100, method="poisson", hash="md5")
    )


def _sql_boot_poisson() -> str:
    u = (
        "(('0x' || substr(md5(concat_ws('|', '42', t.r::VARCHAR, c.c_custkey::VARCHAR)), 1, 13))::BIGINT"
        f" * {_dbl(2.0 ** -52)})"
    )
    return f"""
WITH wt AS (SELECT c.c_mktsegment, CAST(c.c_acctbal AS DOUBLE) AS c_acctbal, t.r, {poisson_weight_sql(u)} AS w
            FROM customer c CROSS JOIN range(0, 100) t(r)),
dup AS (SELECT wt.* FROM wt JOIN range(1, 64) k(j) ON k.j <= wt.w),
reps AS (SELECT c_mktsegment, r, {sql_rep_aggs(['c_acctbal'])} FROM dup GROUP BY c_mktsegment, r),
long AS ({sql_long_stats('reps', ['c_mktsegment', 'r'], ['c_acctbal'])})
{sql_percentile_ci('long', ['c_mktsegment', 'scale', 'stat'])}"""


SQL_BOOT_CI_POISSON = _sql_boot_poisson()


def q_cohens_d(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return rounded(cohens_d(li, LINE_MEASURES, "l_linestatus"))


def _sql_cohens_d_body(src: str, group: str, scales: list[str], lv: tuple[str, str]) -> list[str]:
    out = []
    for s in scales:
        a, b = lv
        out.append(f"""
SELECT '{s}' AS scale,
  (avg({s}) FILTER (WHERE {group} = {a}) - avg({s}) FILTER (WHERE {group} = {b})) /
  sqrt(((count(*) FILTER (WHERE {group} = {a}) - 1) * pow(stddev_samp({s}) FILTER (WHERE {group} = {a}), 2)
      + (count(*) FILTER (WHERE {group} = {b}) - 1) * pow(stddev_samp({s}) FILTER (WHERE {group} = {b}), 2))
      / (count(*) FILTER (WHERE {group} = {a}) + count(*) FILTER (WHERE {group} = {b}) - 2)) AS d,
  count(*) FILTER (WHERE {group} = {a}) + count(*) FILTER (WHERE {group} = {b}) - 2 AS df
FROM {src}""")
    return out


SQL_COHENS_D = (
    f"SELECT scale, {_r('d')} AS d, df FROM ("
    + " UNION ALL ".join(_sql_cohens_d_body("lineitem", "l_linestatus", LINE_MEASURES, ("'F'", "'O'")))
    + ")"
)


def q_cohens_d_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return rounded(cohens_d(docs.join(labels, "doc_id"), ["n_chars"], "quality"))


SQL_COHENS_D_LABELS = (
    f"SELECT scale, {_r('d')} AS d, df FROM ("
    + " UNION ALL ".join(
        _sql_cohens_d_body(
            "(SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars, l.quality FROM documents d JOIN labels l USING (doc_id))",
            "quality",
            ["n_chars"],
            ("0", "1"),
        )
    )
    + ")"
)


def q_merge_results(spark: SparkSession, sf: str) -> DataFrame:
    """Per-scale results computed separately and row-bound by name (the merge step)."""
    li = table(spark, sf, "lineitem")
    parts = [cohens_d(li, [s], "l_linestatus") for s in LINE_MEASURES]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return rounded(merged)


SQL_MERGE_RESULTS = SQL_COHENS_D


BOOT_D_ITER = 200


def _basic_weights(R: int, alpha: float) -> tuple[int, float]:
    rk = (R + 1) * alpha
    k = int(rk)
    nd = NormalDist()
    wgt = (nd.inv_cdf(alpha) - nd.inv_cdf(k / (R + 1))) / (nd.inv_cdf((k + 1) / (R + 1)) - nd.inv_cdf(k / (R + 1)))
    return k, wgt


def q_boot_cohens_d(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return rounded(boot_cohens_d(o, ["o_totalprice"], "o_orderstatus", "o_orderkey", n_iter=BOOT_D_ITER, hash="md5"))


def _sql_boot_cohens_d() -> str:
    khi, whi = _basic_weights(BOOT_D_ITER, 0.975)
    klo, wlo = _basic_weights(BOOT_D_ITER, 0.025)
    g = "o_orderstatus"
    s = "o_totalprice"

    def d_expr() -> str:
        return (
            f"(avg({s}) FILTER (WHERE {g} = 'F') - avg({s}) FILTER (WHERE {g} = 'O')) /"
            f" sqrt(((count(*) FILTER (WHERE {g} = 'F') - 1) * pow(stddev_samp({s}) FILTER (WHERE {g} = 'F'), 2)"
            f" + (count(*) FILTER (WHERE {g} = 'O') - 1) * pow(stddev_samp({s}) FILTER (WHERE {g} = 'O'), 2))"
            f" / (count(*) FILTER (WHERE {g} = 'F') + count(*) FILTER (WHERE {g} = 'O') - 2))"
        )

    return f"""
WITH idx AS ({sql_index('orders', 'o_orderkey', [g], [s])}),
draws AS ({sql_draws(BOOT_D_ITER)}),
reps AS (SELECT r, {d_expr()} AS t FROM draws JOIN idx USING (i) GROUP BY r),
ts AS (SELECT list_sort(list(t)) AS ts FROM reps),
t0 AS (SELECT {d_expr()} AS d FROM idx)
SELECT '{s}' AS scale, {_r('t0.d')} AS d, CAST(0.95 AS DOUBLE) AS ci_level,
  {_r(f'2 * t0.d - (ts[{khi}] + {_dbl(whi)} * (ts[{khi + 1}] - ts[{khi}]))')} AS ci_ll,
  {_r(f'2 * t0.d - (ts[{klo}] + {_dbl(wlo)} * (ts[{klo + 1}] - ts[{klo}]))')} AS ci_ul
FROM t0, ts"""


SQL_BOOT_COHENS_D = _sql_boot_cohens_d()


def _range_stat(w):
    return F.max("c_acctbal") - F.min("c_acctbal")


def q_boot_custom_expr(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return rounded(boot_custom(c, {"range": _range_stat}, "c_custkey", columns=["c_acctbal"], n_iter=20, hash="md5"))


def _partial_range(pdf):
    import pandas as pd

    return pd.DataFrame({"mn": [pdf["c_acctbal"].min()], "mx": [pdf["c_acctbal"].max()]})


def _combine_range(states) -> float:
    return float(states["mx"].max() - states["mn"].min())


def q_boot_custom_pandas(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    out = boot_custom_pandas(
        c, _partial_range, _combine_range, "mn double, mx double", "c_custkey", ["c_acctbal"], n_iter=20, hash="md5"
    )
    return rounded(out.withColumn("stat", F.lit("range")))


def _sql_boot_custom() -> str:
    return f"""
WITH idx AS ({sql_index('customer', 'c_custkey', [], ['c_acctbal'])}),
draws AS ({sql_draws(20)}),
reps AS (SELECT r, 'range' AS stat, max(c_acctbal) - min(c_acctbal) AS value FROM draws JOIN idx USING (i) GROUP BY r)
{sql_percentile_ci('reps', ['stat'])}"""


SQL_BOOT_CUSTOM = _sql_boot_custom()


PART_SCALES = ["p_size", "p_retailprice"]


def q_boot_stats_multi_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Two measures (INT and DOUBLE) bootstrapped together, one aggregate per replicate."""
    p = table(spark, sf, "part")
    return rounded(boot_stats(p, "p_type", "p_partkey", PART_SCALES, n_iter=25, hash="md5"))


SQL_BOOT_STATS_MULTI_SCALE = sql_boot_stats("part", "p_partkey", ["p_type"], PART_SCALES, 25)


def _sql_d(g: str, s: str, a: str, b: str) -> str:
    """Cohen's d of (group g, scale s) for levels a, b over the current FROM (duplicated rows)."""
    return (
        f"(avg({s}) FILTER (WHERE {g} = {a}) - avg({s}) FILTER (WHERE {g} = {b})) /"
        f" sqrt(((count(*) FILTER (WHERE {g} = {a}) - 1) * pow(stddev_samp({s}) FILTER (WHERE {g} = {a}), 2)"
        f" + (count(*) FILTER (WHERE {g} = {b}) - 1) * pow(stddev_samp({s}) FILTER (WHERE {g} = {b}), 2))"
        f" / (count(*) FILTER (WHERE {g} = {a}) + count(*) FILTER (WHERE {g} = {b}) - 2))"
    )


def sql_basic_ci(scale: str, n_iter: int, t0_cte: str = "t0", ts_cte: str = "ts") -> str:
    """Basic interval from CTEs t0(d) and ts(ts = sorted replicate list), all R = n_iter finite."""
    khi, whi = _basic_weights(n_iter, 0.975)
    klo, wlo = _basic_weights(n_iter, 0.025)
    return f"""SELECT '{scale}' AS scale, {_r('t0.d')} AS d, CAST(0.95 AS DOUBLE) AS ci_level,
  {_r(f'2 * t0.d - (ts[{khi}] + {_dbl(whi)} * (ts[{khi + 1}] - ts[{khi}]))')} AS ci_ll,
  {_r(f'2 * t0.d - (ts[{klo}] + {_dbl(wlo)} * (ts[{klo + 1}] - ts[{klo}]))')} AS ci_ul
FROM {t0_cte} t0, {ts_cte}"""


def q_boot_cohens_d_multi_level(spark: SparkSession, sf: str) -> DataFrame:
    """Four levels: d uses the first two sorted levels; every row stays in the resample pool."""
    docs = table(spark, sf, "documents")
    return rounded(boot_cohens_d(docs, ["n_chars"], "lang", "doc_id", n_iter=50, hash="md5"))


def _sql_boot_cohens_d_multi_level() -> str:
    d = _sql_d("lang", "n_chars", "'de'", "'en'")
    return f"""
WITH idx AS ({sql_index('documents', 'doc_id', ['lang'], ['n_chars'])}),
draws AS ({sql_draws(50)}),
reps AS (SELECT r, {d} AS t FROM draws JOIN idx USING (i) GROUP BY r),
ts AS (SELECT list_sort(list(t)) AS ts FROM reps),
t0 AS (SELECT {d} AS d FROM idx)
{sql_basic_ci('n_chars', 50)}"""


SQL_BOOT_COHENS_D_MULTI_LEVEL = _sql_boot_cohens_d_multi_level()


def q_boot_cohens_d_poisson(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return rounded(
        boot_cohens_d(o, ["o_totalprice"], "o_orderstatus", "o_orderkey", n_iter=100, method="poisson", hash="md5")
    )


def _sql_boot_cohens_d_poisson() -> str:
    u = (
        "(('0x' || substr(md5(concat_ws('|', '42', t.r::VARCHAR, o.o_orderkey::VARCHAR)), 1, 13))::BIGINT"
        f" * {_dbl(2.0 ** -52)})"
    )
    d = _sql_d("o_orderstatus", "o_totalprice", "'F'", "'O'")
    return f"""
WITH wt AS (SELECT o.o_orderstatus, CAST(o.o_totalprice AS DOUBLE) AS o_totalprice, t.r, {poisson_weight_sql(u)} AS w
            FROM orders o CROSS JOIN range(0, 100) t(r)),
dup AS (SELECT wt.* FROM wt JOIN range(1, 64) k(j) ON k.j <= wt.w),
reps AS (SELECT r, {d} AS t FROM dup GROUP BY r),
ts AS (SELECT list_sort(list(t)) AS ts FROM reps),
t0 AS (SELECT {d} AS d FROM orders)
{sql_basic_ci('o_totalprice', 100)}"""


SQL_BOOT_COHENS_D_POISSON = _sql_boot_cohens_d_poisson()


def q_boot_ci_multinomial(spark: SparkSession, sf: str) -> DataFrame:
    """Exact-n replicates drawn in place and topped up (md5 draws)."""
    c = table(spark, sf, "customer")
    return rounded(boot_stats(c, "c_mktsegment", "c_custkey", ["c_acctbal"], n_iter=100, method="multinomial", hash="md5"))


def _md5_uniform(*parts: str) -> str:
    """SQL twin of :func:`bootframe.functions.draws.uniform` (md5)."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT * {_dbl(2.0 ** -52)})"


def _md5_bits(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


#: rows of a table weigh Poisson(1 - 6 / sqrt(n)): the CASE chain's constants depend on n, so in SQL the
#: chain is a running sum of the Poisson probabilities, made from n
SQL_POISSON_TABLE = """
nn AS (SELECT count(*) AS n, greatest(CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE) - CAST(6.0 AS DOUBLE) / sqrt(count(*))) AS rate FROM {tbl}),
terms AS (SELECT s.size, k.k, rate * s.size AS lam, exp(-(rate * s.size) + CASE WHEN k.k > 0 THEN k.k * ln(rate * s.size) ELSE 0 END - lgamma(k.k + 1)) AS term
          FROM nn, (SELECT unnest([1, 2, 4, 8, 16, 32]) AS size) s, range(0, 120) k(k) WHERE rate > 0),
cdf AS (SELECT size, k, sum(term) OVER (PARTITION BY size ORDER BY k) AS cum FROM terms),
cdfs AS (SELECT size, list(cum ORDER BY k) AS cums FROM cdf GROUP BY size)"""


def _sql_boot_multinomial() -> str:
    return f"""
WITH {SQL_POISSON_TABLE.format(tbl="customer")},
idx AS ({sql_index('customer', 'c_custkey', ['c_custkey', 'c_mktsegment'], ['c_acctbal'])}),
u AS (SELECT idx.*, t.r, {_md5_uniform("'42'", "t.r::VARCHAR", "idx.c_custkey::VARCHAR")} AS u FROM idx CROSS JOIN range(0, 100) t(r)),
placed AS (SELECT u.i, u.r, len(list_filter(coalesce((SELECT cums FROM cdfs WHERE size = 1), []), lambda c: c <= u.u)) AS w FROM u WHERE (SELECT rate FROM nn) > 0),
sums AS (SELECT t.r, (SELECT n FROM nn) - coalesce(sum(w), 0) AS missing FROM range(0, 100) t(r) LEFT JOIN placed USING (r) GROUP BY t.r),
draws AS (SELECT r, unnest(range(missing::BIGINT)) AS s FROM sums),
topped AS (SELECT {_md5_bits("'42'", "r::VARCHAR", "s::VARCHAR", "'top'")} % (SELECT n FROM nn) AS i, r, 1 AS w FROM draws),
wt AS (SELECT * FROM placed WHERE w > 0 UNION ALL SELECT * FROM topped),
dup AS (SELECT idx.*, wt.r FROM wt JOIN idx USING (i) JOIN range(1, 64) k(j) ON k.j <= wt.w),
reps AS (SELECT c_mktsegment, r, {sql_rep_aggs(['c_acctbal'])} FROM dup GROUP BY c_mktsegment, r),
long AS ({sql_long_stats('reps', ['c_mktsegment', 'r'], ['c_acctbal'])})
{sql_percentile_ci('long', ['c_mktsegment', 'scale', 'stat'])}"""


SQL_BOOT_CI_MULTINOMIAL = _sql_boot_multinomial()

LINE_DISCRETE = ["l_quantity", "l_discount", "l_tax"]
CELLS_ITER = 1000


def q_boot_ci_poisson_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Discrete measures, three sets, B = 1000, bootstrapped over value cells: Poisson counts."""
    li = table(spark, sf, "lineitem")
    return rounded(
        boot_stats_sets(li, LINE_SETS[:3], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], LINE_DISCRETE,
                        n_iter=CELLS_ITER, method="poisson", collapse=True, hash="md5")
    )


def q_boot_cohens_d_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cohen's d of three discrete measures, B = 1000, over value cells: Poisson counts."""
    li = table(spark, sf, "lineitem")
    out = boot_cohens_d(li, LINE_DISCRETE, "l_linestatus", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                        n_iter=CELLS_ITER, method="poisson", collapse=True, hash="md5")
    return rounded(out)


def q_boot_ci_exact_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Exact-n draws over value cells (Multinomial(n, c/n) per set and scale), B = 1000 (no SQL twin: numpy)."""
    li = table(spark, sf, "lineitem")
    return rounded(
        boot_stats_sets(li, LINE_SETS[:3], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], LINE_DISCRETE,
                        n_iter=CELLS_ITER, method="exact", collapse=True)
    )


def _sql_poly(coeffs: list[float], x: str) -> str:
    acc = _dbl(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        acc = f"({acc} * ({x}) + {_dbl(c)})"
    return acc


def _sql_cells(sets: list[list[str]], set_names: list[str], rate: str) -> str:
    """CTEs up to cw (set, keys…, scale, value, r, w): cells of ``lineitem`` and their Poisson(rate · c) weights."""
    from bootframe.functions import normal as N

    keys = ["l_returnflag", "l_linestatus"]
    arms = []
    for s, name in zip(sets, set_names):
        cols = ", ".join(f"{c}" if c in s else f"CAST(NULL AS VARCHAR) AS {c}" for c in keys)
        arms += [f"SELECT '{name}' AS set, {cols}, '{m}' AS scale, CAST({m} AS DOUBLE) AS value, count(*) AS c FROM lineitem GROUP BY ALL" for m in LINE_DISCRETE]
    used = [k for k in keys if any(k in s for s in sets)]
    text = ", ".join(["set", *[f"coalesce({k}, '~')" for k in used], "scale", "value::VARCHAR"])
    u = lambda tag: _md5_uniform("'42'", "r::VARCHAR", text, tag)
    arms_of = ", ".join(f"CASE WHEN c & {1 << b} <> 0 THEN {b} END" for b in range(6))
    tail = f"CASE WHEN rr <= 5 THEN {_sql_poly(N._C, 'rr - 1.6')} / {_sql_poly(N._D, 'rr - 1.6')} ELSE {_sql_poly(N._E, 'rr - 5')} / {_sql_poly(N._F, 'rr - 5')} END"
    d = _dbl
    q = (
        f"m + sqrt(m) * z + ({d(1 / 3)} + z * z / 6) + (-z / 36 - z * z * z / 72) / sqrt(m)"
        f" + ({d(-8 / 405)} + z * z * 7 / 810 + z * z * z * z / 270) / m"
    )
    return f"""
cells AS ({" UNION ALL ".join(arms)}),
reps0 AS (SELECT cells.*, t.r FROM cells CROSS JOIN range(0, {CELLS_ITER}) t(r)),
pieces AS (SELECT *, unnest(list_filter([{arms_of}], lambda x: x IS NOT NULL)) AS b FROM reps0 WHERE c < 64),
drawn AS (SELECT *, {u("'b' || b")} AS u FROM pieces),
small AS (SELECT set, {", ".join(keys)}, scale, value, r, len(list_filter(cums, lambda x: x <= u)) AS w FROM drawn JOIN cdfs ON cdfs.size = 1 << b),
large1 AS (SELECT *, c * {rate} AS m, greatest({u("'z'")}, {d(2.0 ** -54)}) AS p FROM reps0 WHERE c >= 64),
large2 AS (SELECT *, p - {d(0.5)} AS qq, sqrt(-ln(least(p, 1 - p))) AS rr FROM large1),
large3 AS (SELECT *, {d(0.180625)} - qq * qq AS rc FROM large2),
large4 AS (SELECT *, CASE WHEN abs(qq) <= {d(0.425)} THEN qq * {_sql_poly(N._A, 'rc')} / {_sql_poly(N._B, 'rc')} WHEN qq < 0 THEN -({tail}) ELSE {tail} END AS z FROM large3),
large AS (SELECT set, {", ".join(keys)}, scale, value, r, greatest(floor({q}), 0)::BIGINT AS w FROM large4),
cw AS (SELECT * FROM small WHERE w > 0 UNION ALL SELECT * FROM large WHERE w > 0)"""


def _sql_cell_ci(weights: str) -> str:
    """Weighted mean and median of each replicate from CTE ``weights``, and their intervals."""
    ids = "set, l_returnflag, l_linestatus, scale, r"
    return f"""
byvalue AS (SELECT {ids}, value, sum(w) AS w FROM {weights} WHERE value IS NOT NULL GROUP BY ALL),
runs AS (SELECT *, sum(w) OVER (PARTITION BY {ids} ORDER BY value) AS cum, sum(w) OVER (PARTITION BY {ids}) AS m FROM byvalue),
picks AS (SELECT {ids}, sum(value * w) / sum(w) AS mean, {_dbl(0.5)} * min(value) FILTER (WHERE cum >= (m + 1) // 2)
  + {_dbl(0.5)} * min(value) FILTER (WHERE cum >= m // 2 + 1) AS median FROM runs GROUP BY {ids}),
long AS (SELECT {ids}, 'mean' AS stat, mean AS value FROM picks UNION ALL SELECT {ids}, 'median', median FROM picks)
{sql_percentile_ci('long', ['set', 'l_returnflag', 'l_linestatus', 'scale', 'stat'])}"""


#: Poisson(1, 2, 4, …) distribution functions for whole rows (rate 1)
SQL_POISSON_ONE = SQL_POISSON_TABLE.format(tbl="lineitem").replace("greatest(CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE) - CAST(6.0 AS DOUBLE) / sqrt(count(*)))", "CAST(1.0 AS DOUBLE)")

_LINE_SET_NAMES = [",".join(s) for s in LINE_SETS[:3]]
SQL_BOOT_CI_POISSON_CELLS = f"WITH {SQL_POISSON_ONE},{_sql_cells(LINE_SETS[:3], _LINE_SET_NAMES, '1')},{_sql_cell_ci('cw')}"


def _sql_cohens_d_cells() -> str:
    ts, t0s, arms = [], [], []
    for j, m in enumerate(LINE_DISCRETE):
        ts.append(f"ts{j} AS (SELECT list_sort(list(t)) AS ts FROM reps WHERE scale = '{m}')")
        t0s.append(f"t0_{j} AS (SELECT {_sql_d('l_linestatus', m, chr(39) + 'F' + chr(39), chr(39) + 'O' + chr(39))} AS d FROM lineitem)")
        arms.append(sql_basic_ci(m, CELLS_ITER, f"t0_{j}", f"ts{j}"))
    side = lambda v: f"sum(w) FILTER (WHERE l_linestatus = '{v}')::DOUBLE AS w{v}, sum(w * value) FILTER (WHERE l_linestatus = '{v}') AS s{v}"
    return f"""
WITH {SQL_POISSON_ONE},{_sql_cells([["l_linestatus"]], ["l_linestatus"], '1')},
sums AS (SELECT scale, r, {side('F')}, {side('O')} FROM cw GROUP BY scale, r),
dev AS (SELECT cw.scale, cw.r, sum(w * pow(value - sF / wF, 2)) FILTER (WHERE l_linestatus = 'F') AS qF, sum(w * pow(value - sO / wO, 2)) FILTER (WHERE l_linestatus = 'O') AS qO
  FROM cw JOIN sums ON cw.scale = sums.scale AND cw.r = sums.r GROUP BY cw.scale, cw.r),
reps AS (SELECT scale, r, (sF / wF - sO / wO) / sqrt((qF + qO) / (wF + wO - 2)) AS t FROM sums JOIN dev USING (scale, r)),
{", ".join(ts)}, {", ".join(t0s)}
{" UNION ALL ".join(arms)}"""


SQL_BOOT_COHENS_D_CELLS = _sql_cohens_d_cells()


def q_boot_ci_default_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Default categories (every string column) plus the whole table, shared replicates, B = 30."""
    orders = drop_columns(table(spark, sf, "orders"), "o_orderdate")
    sets = [[c] for c in string_columns(orders)] + [[]]
    return rounded(boot_stats_sets(orders, sets, "o_orderkey", ["o_totalprice"], n_iter=30, hash="md5"))


SQL_BOOT_CI_DEFAULT_SETS = _sql_boot_sets(30, True, [["o_orderstatus"], ["o_orderpriority"], []])


QUERIES: dict[str, Query] = {
    "select_by_regex": q_select_by_regex,
    "melt_long": q_melt_long,
    "group_mean_median": q_group_mean_median,
    "grouping_sets_stats": q_grouping_sets_stats,
    "factor_levels": q_factor_levels,
    "default_categories": q_default_categories,
    "table_profile": q_table_profile,
    "quantile_rules": q_quantile_rules,
    "resample_weights": q_resample_weights,
    "boot_ci_one_key": q_boot_ci_one_key,
    "boot_ci_two_keys": q_boot_ci_two_keys,
    "boot_ci_global": q_boot_ci_global,
    "boot_ci_sets_shared": q_boot_ci_sets_shared,
    "boot_ci_sets_independent": q_boot_ci_sets_independent,
    "boot_ci_poisson": q_boot_ci_poisson,
    "cohens_d": q_cohens_d,
    "cohens_d_labels": q_cohens_d_labels,
    "merge_results": q_merge_results,
    "boot_cohens_d": q_boot_cohens_d,
    "boot_custom_expr": q_boot_custom_expr,
    "boot_custom_pandas": q_boot_custom_pandas,
    "boot_stats_multi_scale": q_boot_stats_multi_scale,
    "boot_cohens_d_multi_level": q_boot_cohens_d_multi_level,
    "boot_cohens_d_poisson": q_boot_cohens_d_poisson,
    "boot_ci_multinomial": q_boot_ci_multinomial,
    "boot_ci_poisson_cells": q_boot_ci_poisson_cells,
    "boot_cohens_d_cells": q_boot_cohens_d_cells,
    "boot_ci_exact_cells": q_boot_ci_exact_cells,
    "boot_ci_default_sets": q_boot_ci_default_sets,
}

ORACLE_SQL: dict[str, str] = {
    "boot_ci_multinomial": SQL_BOOT_CI_MULTINOMIAL,
    "boot_ci_poisson_cells": SQL_BOOT_CI_POISSON_CELLS,
    "boot_cohens_d_cells": SQL_BOOT_COHENS_D_CELLS,
    "select_by_regex": SQL_SELECT_BY_REGEX,
    "melt_long": SQL_MELT_LONG,
    "group_mean_median": SQL_GROUP_MEAN_MEDIAN,
    "grouping_sets_stats": SQL_GROUPING_SETS_STATS,
    "factor_levels": SQL_FACTOR_LEVELS,
    "default_categories": SQL_DEFAULT_CATEGORIES,
    "table_profile": SQL_TABLE_PROFILE,
    "quantile_rules": SQL_QUANTILE_RULES,
    "resample_weights": SQL_RESAMPLE_WEIGHTS,
    "boot_ci_one_key": SQL_BOOT_CI_ONE_KEY,
    "boot_ci_two_keys": SQL_BOOT_CI_TWO_KEYS,
    "boot_ci_global": SQL_BOOT_CI_GLOBAL,
    "boot_ci_sets_shared": SQL_BOOT_CI_SETS_SHARED,
    "boot_ci_sets_independent": SQL_BOOT_CI_SETS_INDEPENDENT,
    "boot_ci_poisson": SQL_BOOT_CI_POISSON,
    "cohens_d": SQL_COHENS_D,
    "cohens_d_labels": SQL_COHENS_D_LABELS,
    "merge_results": SQL_MERGE_RESULTS,
    "boot_cohens_d": SQL_BOOT_COHENS_D,
    "boot_custom_expr": SQL_BOOT_CUSTOM,
    "boot_custom_pandas": SQL_BOOT_CUSTOM,
    "boot_stats_multi_scale": SQL_BOOT_STATS_MULTI_SCALE,
    "boot_cohens_d_multi_level": SQL_BOOT_COHENS_D_MULTI_LEVEL,
    "boot_cohens_d_poisson": SQL_BOOT_COHENS_D_POISSON,
    "boot_ci_default_sets": SQL_BOOT_CI_DEFAULT_SETS,
}
