"""Grouped statistics: means, medians, grouping sets, factor levels, Cohen's d.

Every function takes an optional frequency column ``weight``: the same
statistic over a table in which each row appears ``weight`` times. This is how
one bootstrap replicate is evaluated without duplicating rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootframe.operators.columns import set_name
from bootframe.operators.ranks import Point, group_values

STATS = ("mean", "median")
NA_POLICIES = ("propagate", "omit")


def stat_expr(
    stat: str, x: Column, weight: str | None = None, median_accuracy: int | None = None
) -> Column:
    """One aggregate over ``x`` (nulls ignored), optionally weighted by frequencies.

    ``median_accuracy``: use the bounded-memory ``percentile_approx`` sketch for the
    median (rows must then carry weight 1, see :func:`expand_frequencies`); the exact
    median keeps a value→count map per group (bounded where the caller's values are; the
    plans select ranks instead, see :mod:`bootframe.operators.ranks`).
    """
    if stat == "mean":
        if weight is None:
            return F.avg(x)
        w = F.col(weight)
        return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))
    if stat == "median":
        if median_accuracy is not None:
            return F.percentile_approx(x, F.lit(0.5), F.lit(int(median_accuracy))).cast("double")
        return F.median(x) if weight is None else F.percentile(x, F.lit(0.5), F.col(weight))
    raise ValueError(f"stat must be one of {STATS}, got {stat!r}")


def expand_frequencies(df: DataFrame, weight: str = "w") -> DataFrame:
    """Repeat each row ``weight`` times and set the weight to 1 (for sketches without weights)."""
    reps = F.explode(F.array_repeat(F.lit(1), F.col(weight).cast("int")))
    return df.select(*[c for c in df.columns if c != weight], reps.alias(weight)).withColumn(weight, F.lit(1).cast("bigint"))


def wide_name(stat: str, scale: str) -> str:
    return f"{stat}__{scale}"


def wide_stats(
    df: DataFrame,
    by: Sequence[str],
    scales: Sequence[str],
    stats: Sequence[str] = STATS,
    weight: str | None = None,
    extra_by: Sequence[str] = (),
    median_accuracy: int | None = None,
) -> DataFrame:
    """One aggregate pass: a column ``stat__scale`` per (stat, scale), grouped by ``by + extra_by``.

    Aggregating wide first and unpivoting the small result is far cheaper than
    unpivoting every input row (Catalyst does not do this rewrite).
    """
    exprs = [
        stat_expr(s, F.col(c).cast("double"), weight, median_accuracy).alias(wide_name(s, c))
        for c in scales
        for s in stats
    ]
    return df.groupBy(*by, *extra_by).agg(*exprs)


def unpivot_stats(wide: DataFrame, ids: Sequence[str], scales: Sequence[str], stats: Sequence[str] = STATS) -> DataFrame:
    """(ids..., stat__scale...) → (ids..., scale, stat, value)."""
    cells = [
        F.struct(F.lit(c).alias("scale"), F.lit(s).alias("stat"), F.col(wide_name(s, c)).cast("double").alias("value"))
        for c in scales
        for s in stats
    ]
    return wide.select(*ids, F.inline(F.array(*cells)))


def _long(values: DataFrame, keys: Sequence[str], scales: Sequence[str], stats: Sequence[str], set_names: Sequence[str] | None = None, set_col: str = "set") -> DataFrame:
    """:func:`bootframe.operators.ranks.group_values` with names: ([set], keys…, [r], scale, stat, value)."""
    what = {-1 - j: (c, "mean") for j, c in enumerate(scales)} | {p: (c, "median") for p, c in enumerate(scales)}
    of = F.create_map(*[x for p, (c, s) in what.items() for x in (F.lit(p), F.struct(F.lit(c).alias("scale"), F.lit(s).alias("stat")))])[F.col("point")]
    named = [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]
    if set_names is not None:
        named = [F.element_at(F.array(*[F.lit(n) for n in set_names]), F.col("s") + 1).alias(set_col), *named]
    if "r" in values.columns:
        named.append(F.col("r"))
    return values.select(*named, of["scale"].alias("scale"), of["stat"].alias("stat"), F.col("value"))


def _checked_stats(stats: Sequence[str]) -> None:
    unknown = [s for s in stats if s not in STATS]
    if unknown:
        raise ValueError(f"stat must be one of {STATS}, got {unknown[0]!r}")


def _points(scales: Sequence[str], stats: Sequence[str]) -> list[Point]:
    return [Point(j) for j in range(len(scales))] if "median" in stats else []


def _rank_base(df: DataFrame, keys: Sequence[str], scales: Sequence[str], weight: str | None) -> DataFrame:
    cols = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)] + [F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(scales)]
    return df.select(*cols, *([F.col(weight).alias("w")] if weight else []))


def group_stats(
    df: DataFrame,
    by: Sequence[str],
    scales: Sequence[str],
    stats: Sequence[str] = STATS,
    weight: str | None = None,
    extra_by: Sequence[str] = (),
) -> DataFrame:
    """Long-form group statistics: (by..., scale, stat, value); exact medians by rank selection
    (:mod:`bootframe.operators.ranks`), the same plan at every size."""
    _checked_stats(stats)
    keys = [*by, *extra_by]
    base = _rank_base(df, keys, scales, weight)
    values = group_values(base, len(keys), [list(range(len(keys)))], len(scales), "mean" in stats, _points(scales, stats))
    return _long(values, keys, scales, stats)


def group_quantiles(df: DataFrame, by: Sequence[str], scale: str, wanted: Sequence[tuple[str, float, str]]) -> DataFrame:
    """Several quantiles of ``scale`` per group, in one pass: (by…, a column per wanted name).

    ``wanted``: (name, q, rule), rule one of nearest, disc, linear, median (see
    :class:`bootframe.operators.ranks.Point`); nulls are ignored, a group without values gets nulls.
    """
    points = [Point(0, q, rule) for _, q, rule in wanted]
    values = group_values(_rank_base(df, by, [scale], None), len(by), [list(range(len(by)))], 1, False, points)
    cells = [F.max(F.when(F.col("point") == p, F.col("value"))).alias(name) for p, (name, _, _) in enumerate(wanted)]
    keys = [f"k{i}" for i in range(len(by))]
    return values.groupBy(*keys).agg(*cells).select(*[F.col(k).alias(c) for k, c in zip(keys, by)], *[name for name, _, _ in wanted])


def grouping_id_of(cols: Sequence[str], members: Sequence[str]) -> int:
    """Spark's ``grouping_id()`` for a grouping set: bit set ⇔ column not grouped, first column highest."""
    gid = 0
    for c in cols:
        gid = (gid << 1) | (0 if c in members else 1)
    return gid


def requested_names(sets: Sequence[Sequence[str]]) -> tuple[list[list[str]], dict[str, list[str]]]:
    """The sets once each, whatever the order of their members, and the names each was asked for by."""
    uniq: dict[frozenset, list[str]] = {}
    names: dict[str, list[str]] = {}
    for s in sets:
        kept = uniq.setdefault(frozenset(s), list(dict.fromkeys(s)))
        asked = names.setdefault(set_name(kept), [])
        if set_name(s) not in asked:
            asked.append(set_name(s))
    return list(uniq.values()), names


def spread_names(df: DataFrame, set_col: str, names: dict[str, list[str]]) -> DataFrame:
    """A row for each name that its set was asked for by."""
    if all(asked == [name] for name, asked in names.items()):
        return df
    of = F.create_map(*[x for name, asked in names.items() for x in (F.lit(name), F.array(*[F.lit(a) for a in asked]))])
    cols = df.columns
    return df.select(*[F.explode(of[F.col(set_col)]).alias(c) if c == set_col else F.col(c) for c in cols])


def grouping_sets_wide(
    df: DataFrame,
    sets: Sequence[Sequence[str]],
    scales: Sequence[str],
    stats: Sequence[str] = STATS,
    weight: str | None = None,
    extra_by: Sequence[str] = (),
    set_col: str = "set",
    median_accuracy: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """Wide statistics for many grouping sets in one scan (GROUPING SETS / Expand).

    Adds ``set_col``: the set's name (columns joined by ","). A column that a set
    does not group by is NULL in that set's rows; ``set_col`` tells such a
    rolled-up NULL from a NULL key value. Returns the frame and the key columns.
    """
    uniq, names = requested_names(sets)
    cols: list[str] = []
    for s in uniq:
        for c in s:
            if c not in cols:
                cols.append(c)
    all_cols = [*cols, *extra_by]
    gsets = [[F.col(c) for c in [*s, *extra_by]] for s in uniq]
    exprs = [
        stat_expr(s, F.col(c).cast("double"), weight, median_accuracy).alias(wide_name(s, c))
        for c in scales
        for s in stats
    ]
    if not all_cols:
        wide = df.agg(*exprs).withColumn("_gid", F.lit(0))
    else:
        wide = df.groupingSets(gsets, *[F.col(c) for c in all_cols]).agg(*exprs, F.grouping_id().alias("_gid"))
    name = None
    for s in uniq:
        cond = F.col("_gid") == F.lit(grouping_id_of(all_cols, [*s, *extra_by]))
        name = F.when(cond, F.lit(set_name(s))) if name is None else name.when(cond, F.lit(set_name(s)))
    wide = spread_names(wide.withColumn(set_col, name).drop("_gid"), set_col, names)
    return wide, cols


def grouping_sets_stats(
    df: DataFrame,
    sets: Sequence[Sequence[str]],
    scales: Sequence[str],
    stats: Sequence[str] = STATS,
    weight: str | None = None,
    set_col: str = "set",
) -> DataFrame:
    """Long-form statistics for many grouping sets: (set, keys..., scale, stat, value)."""
    _checked_stats(stats)
    uniq, names = requested_names(sets)
    cols = list(dict.fromkeys(c for s in uniq for c in s))
    base = _rank_base(df, cols, scales, weight)
    values = group_values(base, len(cols), [[cols.index(c) for c in s] for s in uniq], len(scales), "mean" in stats, _points(scales, stats))
    return spread_names(_long(values, cols, scales, stats, [set_name(s) for s in uniq], set_col), set_col, names)


def levels(df: DataFrame, group: str, limit: int | None = None) -> list:
    """Sorted distinct non-null levels of ``group`` (first ``limit`` only, a bounded collect)."""
    q = df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group)
    if limit is not None:
        q = q.limit(limit)
    return [row[0] for row in q.collect()]


def level_counts(df: DataFrame, group: str) -> DataFrame:
    """(level, n) per non-null level: the sizes a factor table reports."""
    return (
        df.where(F.col(group).isNotNull())
        .groupBy(F.col(group).alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def profile(df: DataFrame) -> DataFrame:
    """One row: number of rows and number of columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def _two_levels(df: DataFrame, group: str, levels_: Sequence | None) -> list:
    lv = list(levels_) if levels_ is not None else levels(df, group, limit=2)
    return lv[:2]


def cohens_d(
    df: DataFrame,
    scales: Sequence[str],
    group: str,
    levels_: Sequence | None = None,
    na: str = "propagate",
) -> DataFrame:
    """Cohen's d per scale for the first two sorted levels of ``group``: (scale, d, df).

    ``d = (m1 - m2) / s_pooled``, ``df = n1 + n2 - 2``. A third level is ignored.
    ``na="propagate"``: a missing response in a level, or any missing group
    value, makes d NULL. ``na="omit"``: such rows are skipped per scale.
    One level, a level with one row, or a zero pooled sd give d NULL.
    """
    if na not in NA_POLICIES:
        raise ValueError(f"na must be one of {NA_POLICIES}, got {na!r}")
    lv = _two_levels(df, group, levels_)
    g = F.col(group)
    aggs = []
    for j, c in enumerate(scales):
        x = F.col(c).cast("double")
        keep = x.isNotNull() & g.isNotNull() if na == "omit" else F.lit(True)
        for k in (1, 2):
            if len(lv) < k:
                aggs += [F.lit(None).cast("bigint").alias(f"n{k}_{j}"), F.lit(None).cast("double").alias(f"m{k}_{j}"),
                         F.lit(None).cast("double").alias(f"s{k}_{j}"), F.lit(0).cast("bigint").alias(f"bad{k}_{j}")]
                continue
            at = (g == F.lit(lv[k - 1])) & keep
            aggs += [
                F.count(F.when(at, F.lit(1))).alias(f"n{k}_{j}"),
                F.avg(F.when(at, x)).alias(f"m{k}_{j}"),
                F.stddev_samp(F.when(at, x)).alias(f"s{k}_{j}"),
                F.count(F.when(at & x.isNull(), F.lit(1))).alias(f"bad{k}_{j}"),
            ]
    aggs.append(F.count(F.when(g.isNull(), F.lit(1))).alias("_null_group"))
    wide = df.agg(*aggs)
    cells = []
    for j, c in enumerate(scales):
        n1, n2 = F.col(f"n1_{j}"), F.col(f"n2_{j}")
        pooled = F.sqrt(
            F.try_divide(
                (n1 - 1) * F.pow(F.col(f"s1_{j}"), 2) + (n2 - 1) * F.pow(F.col(f"s2_{j}"), 2), (n1 + n2 - 2).cast("double")
            )
        )
        d = F.try_divide(F.col(f"m1_{j}") - F.col(f"m2_{j}"), pooled)
        if na == "propagate":
            bad = (F.col(f"bad1_{j}") > 0) | (F.col(f"bad2_{j}") > 0) | (F.col("_null_group") > 0)
            d = F.when(~bad, d)
        d = F.when(~F.isnan(d), d)
        cells.append(F.struct(F.lit(c).alias("scale"), d.cast("double").alias("d"), (n1 + n2 - 2).cast("bigint").alias("df")))
    return wide.select(F.inline(F.array(*cells)))


def cohens_d_parts(
    df: DataFrame,
    scales: Sequence[str],
    group: str,
    lv: Sequence,
    centre: dict[tuple[str, int], float],
    weight: str,
    by: Sequence[str] = ("r",),
    na: str = "propagate",
) -> DataFrame:
    """Weighted sufficient statistics per ``by`` (a replicate) and the resulting d per scale.

    Per level: W = Σw, S = Σw(x-c), Q = Σw(x-c)² with c the level's observed
    mean, so that Σw(x - mean)² = Q - S²/W holds without cancellation.
    Returns (by..., scale, t): t is d, or NULL where d is undefined.
    """
    g = F.col(group)
    w = F.col(weight)
    aggs = []
    for j, c in enumerate(scales):
        x = F.col(c).cast("double")
        keep = x.isNotNull() & g.isNotNull() if na == "omit" else F.lit(True)
        for k in (1, 2):
            if len(lv) < k:
                continue
            at = (g == F.lit(lv[k - 1])) & keep
            dx = x - F.lit(float(centre.get((c, k)) or 0.0))
            aggs += [
                F.sum(F.when(at, w)).alias(f"W{k}_{j}"),
                F.sum(F.when(at, w * dx)).alias(f"S{k}_{j}"),
                F.sum(F.when(at, w * dx * dx)).alias(f"Q{k}_{j}"),
                F.sum(F.when(at & x.isNull(), w)).alias(f"B{k}_{j}"),
            ]
    aggs.append(F.sum(F.when(g.isNull(), w)).alias("_null_group"))
    wide = df.groupBy(*by).agg(*aggs)
    cells = []
    for j, c in enumerate(scales):
        if len(lv) < 2:
            t = F.lit(None).cast("double")
        else:
            parts = {}
            for k in (1, 2):
                W, S, Q = F.col(f"W{k}_{j}"), F.col(f"S{k}_{j}"), F.col(f"Q{k}_{j}")
                parts[k] = (
                    F.lit(float(centre.get((c, k)) or 0.0)) + F.try_divide(S, W.cast("double")),
                    F.greatest(Q - F.try_divide(S * S, W.cast("double")), F.lit(0.0)),
                    W,
                )
            (m1, ss1, w1), (m2, ss2, w2) = parts[1], parts[2]
            pooled = F.sqrt(F.try_divide(ss1 + ss2, (w1 + w2 - 2).cast("double")))
            t = F.when((w1 >= 2) & (w2 >= 2), F.try_divide(m1 - m2, pooled))
            if na == "propagate":
                bad = (F.coalesce(F.col(f"B1_{j}"), F.lit(0)) > 0) | (F.coalesce(F.col(f"B2_{j}"), F.lit(0)) > 0) | (
                    F.coalesce(F.col("_null_group"), F.lit(0)) > 0
                )
                t = F.when(~bad, t)
        cells.append(F.struct(F.lit(c).alias("scale"), t.cast("double").alias("t")))
    return wide.select(*by, F.inline(F.array(*cells)))


def cohens_d_parts_long(
    rows: DataFrame,
    group: str,
    lv: Sequence,
    centre: dict[tuple[str, int], float],
    weight: str = "w",
    na: str = "propagate",
    by: Sequence[str] = ("r",),
) -> DataFrame:
    """:func:`cohens_d_parts` for long rows (scale, value, group, weight): (by..., scale, t).

    Same sufficient statistics per level (W, centred S and Q, weight of missing
    responses) and the same undefined cases; the centre is looked up per scale.
    """
    g, w, x = F.col(group), F.col(weight), F.col("value")
    scales = sorted({s for s, _ in centre})
    aggs = []
    for k in (1, 2):
        if len(lv) < k:
            continue
        c = F.element_at(
            F.create_map(*[e for s in scales for e in (F.lit(s), F.lit(float(centre.get((s, k)) or 0.0)))]),
            F.col("scale"),
        ) if scales else F.lit(0.0)
        keep = x.isNotNull() & g.isNotNull() if na == "omit" else F.lit(True)
        at = (g == F.lit(lv[k - 1])) & keep
        dx = x - c
        aggs += [
            F.sum(F.when(at, w)).alias(f"W{k}"),
            F.sum(F.when(at, w * dx)).alias(f"S{k}"),
            F.sum(F.when(at, w * dx * dx)).alias(f"Q{k}"),
            F.sum(F.when(at & x.isNull(), w)).alias(f"B{k}"),
            F.first(c, ignorenulls=True).alias(f"C{k}"),
        ]
    aggs.append(F.sum(F.when(g.isNull(), w)).alias("_null_group"))
    wide = rows.groupBy(*by, "scale").agg(*aggs)
    if len(lv) < 2:
        return wide.select(*by, "scale", F.lit(None).cast("double").alias("t"))
    parts = {}
    for k in (1, 2):
        W, S, Q = F.col(f"W{k}"), F.col(f"S{k}"), F.col(f"Q{k}")
        parts[k] = (
            F.col(f"C{k}") + F.try_divide(S, W.cast("double")),
            F.greatest(Q - F.try_divide(S * S, W.cast("double")), F.lit(0.0)),
            W,
        )
    (m1, ss1, w1), (m2, ss2, w2) = parts[1], parts[2]
    pooled = F.sqrt(F.try_divide(ss1 + ss2, (w1 + w2 - 2).cast("double")))
    t = F.when((w1 >= 2) & (w2 >= 2), F.try_divide(m1 - m2, pooled))
    if na == "propagate":
        bad = (F.coalesce(F.col("B1"), F.lit(0)) > 0) | (F.coalesce(F.col("B2"), F.lit(0)) > 0) | (
            F.coalesce(F.col("_null_group"), F.lit(0)) > 0
        )
        t = F.when(~bad, t)
    return wide.select(*by, "scale", t.cast("double").alias("t"))
