"""Bootstrap plans: whole computations composed from the operators.

Each function builds one DataFrame plan covering every replicate, scale and
grouping set; nothing is looped over on the driver except the (small, fixed)
list of scales when building column expressions.

Plan shape (exact method, small table):
    range(B·n) → draw i → broadcast-hash-join indexed rows on i → partial agg
    per (keys, r) → shuffle of partials → final agg → unpivot (small) →
    interval agg per (keys, scale, stat).
Plan shape (poisson): scan → explode r → weight in place → partial agg …
Plan shape (multinomial): scan → explode r → weight in place, plus a join of the few
    draws that make up n → partial agg …
Plan shape (collapse=True): scan → (set, scale, value) cell counts, map-side
    combined → per-cell Poisson(c) or per-(set, scale) Multinomial(n, c/n) weights
    → agg per (keys, scale, r) …
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bootframe.operators.cells import multinomial_cell_weights, poisson_cell_weights, set_cells
from bootframe.operators.columns import as_set, match_columns, numeric_columns
from bootframe.operators.intervals import basic_ci, percentile_ci
from bootframe.operators.multinomial import exact_n
from bootframe.operators.ranks import SPREAD, group_values
from bootframe.operators.resample import METHODS, Indexed, check_unique_key, key_columns, resample, row_index, size_profile
from bootframe.session import cut_lineage
from bootframe.operators.stats import (
    STATS,
    _checked_stats,
    _long,
    _points,
    cohens_d,
    cohens_d_parts,
    cohens_d_parts_long,
    expand_frequencies,
    grouping_sets_wide,
    requested_names,
    spread_names,
    unpivot_stats,
    wide_stats,
)

# Fixed value: the survey job's measure-column pattern (default for ``scales``).
DEFAULT_SCALES = "^IPIP.*$"


def resolve_scales(df: DataFrame, scales: str | Sequence[str] | None) -> list[str]:
    """A regex (str) or a list of names → checked list of numeric measure columns."""
    if scales is None:
        scales = DEFAULT_SCALES
    names = match_columns(df, scales) if isinstance(scales, str) else list(scales)
    if not names:
        raise ValueError(f"no measure columns match {scales!r}")
    return numeric_columns(df, names)


#: columns the plans create inside; columns of these names are renamed on the way in and back on the way out
INTERNAL = ("r", "w", "i", "scale", "stat", "value", "set", "median", "d", "t")
#: columns of the results; a grouping column can't have one of these names beside them
RESULT_COLUMNS = ("scale", "stat", "median", "ci95_ll", "ci95_ul")


class _Renamed:
    """``df`` with columns renamed that a plan uses itself."""

    def __init__(self, df: DataFrame, used: Sequence[str], grouping: Sequence[str], results: Sequence[str]) -> None:
        taken = [c for c in grouping if c in results]
        if taken:
            raise ValueError(f"rename grouping columns {taken}: the result has columns of these names")
        self.names = {c: f"x__{c}" for c in dict.fromkeys(used) if c in INTERNAL or c.startswith("_")}
        while any(n in df.columns for n in self.names.values()):
            self.names = {c: f"x__{n}" for c, n in self.names.items()}
        self.df = df.withColumnsRenamed(self.names)

    def of(self, names):
        if isinstance(names, str):
            return self.names.get(names, names)
        return [self.of(n) for n in names]

    def back(self, out: DataFrame, set_col: str | None = None, sets: Sequence[Sequence[str]] = ()) -> DataFrame:
        """Column names, names of scales and of sets as they were given."""
        as_given = {n: c for c, n in self.names.items()}
        scale = F.col("scale")
        for n, c in as_given.items():
            scale = F.when(F.col("scale") == F.lit(n), F.lit(c)).otherwise(scale)
        cols = {"scale": scale.alias("scale")} if "scale" in out.columns else {}
        if set_col:
            name = F.col(set_col)
            for s in sets:
                name = F.when(F.col(set_col) == F.lit(",".join(self.of(s))), F.lit(",".join(s))).otherwise(name)
            cols[set_col] = name.alias(set_col)
        return out.select(*[cols.get(c, F.col(c).alias(as_given.get(c, c))) for c in out.columns])


def _narrow(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], scales: Sequence[str], reserved: Sequence[str] = INTERNAL
) -> DataFrame:
    """Only the columns the plan needs; measures cast to DOUBLE (pruned at the scan)."""
    clash = [c for c in [*keys, *cols, *scales] if c in reserved or c.startswith("_")]
    if clash:
        raise ValueError(f"rename columns {clash}: the plan uses these names itself")
    missing = [c for c in [*keys, *cols, *scales] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    seen: list[str] = []
    for c in [*keys, *cols]:
        if c not in seen:
            seen.append(c)
    return df.select(*[F.col(c) for c in seen], *[F.col(s).cast("double").alias(s) for s in scales if s not in seen])


def _boot_values(
    narrow: DataFrame,
    sets: Sequence[Sequence[str]],
    cols: Sequence[str],
    key: str | Sequence[str],
    measures: Sequence[str],
    n_iter: int,
    seeds: Sequence[int],
    method: str,
    hash: str,
    broadcast_limit: int | None,
    stats: Sequence[str],
) -> DataFrame:
    """Replicate values (s, k…, r, point, value) of every group of every set, see :mod:`bootframe.operators.ranks`.

    One seed: all sets share one resample. A seed a set: each has its own.
    """
    if n_iter < 1:
        raise ValueError("n_iter must be at least 1")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    _checked_stats(stats)
    ids = key_columns(key)
    base = narrow.select(
        *[F.col(c).alias(f"id{i}") for i, c in enumerate(ids)],
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)],
        *[F.col(c).alias(f"x{j}") for j, c in enumerate(measures)],
    )
    ids = [f"id{i}" for i in range(len(ids))]
    idx = None
    if method == "poisson":
        check_unique_key(base, ids)
    else:
        idx = row_index(base, ids, hash=hash)
        base = cut_lineage(idx.df.drop(*ids) if method == "exact" else idx.df)

    def weigher(seed: int) -> Callable[[DataFrame], DataFrame]:
        if method == "multinomial":
            draws = exact_n(base, idx.n, ids, n_iter, seed, hash)
            return lambda rows: draws.weigh(rows).drop(*ids, "i")

        def weigh(rows: DataFrame) -> DataFrame:
            if idx is None:
                return resample(rows, ids, n_iter, seed, method, hash, assume_unique=True).drop(*ids)
            # the bound is that of the rows given: those inside a bracket are few
            some = Indexed(rows, idx.n, size_profile(rows)[1])
            return resample(rows, "i", n_iter, seed, method, hash, broadcast_limit, indexed=some)

        return weigh

    at = [[cols.index(c) for c in s] for s in sets]
    groups = [(at, list(range(len(at))), seeds[0])] if len(seeds) == 1 else [([m], [s], seed) for s, (m, seed) in enumerate(zip(at, seeds))]
    parts = []
    for members, numbers, seed in groups:
        values = group_values(
            base, len(cols), members, len(measures), "mean" in stats, _points(measures, stats), weigher(seed), ["r"], SPREAD
        )
        parts.append(values.withColumn("s", F.col("s") + F.lit(numbers[0])))
    return reduce(DataFrame.unionByName, parts)


def _for_median(rows: DataFrame, stats: Sequence[str], median_accuracy: int | None) -> DataFrame:
    """The approximate median sketch takes no weights: repeat rows by frequency first."""
    if median_accuracy is not None and "median" in stats:
        return expand_frequencies(rows, "w")
    return rows


def _cell_weights(cells: DataFrame, n_iter: int, seed: int, method: str, set_col: str, hash: str) -> DataFrame:
    if method == "poisson":
        return poisson_cell_weights(cells, n_iter, seed, hash)
    if method in ("exact", "multinomial"):
        return multinomial_cell_weights(cells, n_iter, seed, set_col)
    raise ValueError(f"unknown method {method!r}")


def _boot_cells(
    df: DataFrame,
    sets: Sequence[Sequence[str]],
    measures: Sequence[str],
    n_iter: int,
    seed: int,
    method: str,
    ci: float,
    interpolation: str,
    stats: Sequence[str],
    set_col: str,
    hash: str,
) -> DataFrame:
    """Percentile bootstrap over weighted value cells (cells × B work).

    poisson: each cell Poisson(c); exact / multinomial: each (set, scale) draws its
    cells as Multinomial(n, c / n) per replicate (exact-n, the reference's draws).
    """
    set_cols = [c for s in sets for c in s]
    narrow = _narrow(df, [], list(dict.fromkeys(set_cols)), measures)
    cells = set_cells(narrow, sets, measures, set_col)
    rows = _cell_weights(cells, n_iter, seed, method, set_col, hash)
    keys = [c for c in rows.columns if c not in ("value", "r", "w")]
    _checked_stats(stats)
    base = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col("value").alias("x0"), "r", "w")
    values = group_values(base, len(keys), [list(range(len(keys)))], 1, "mean" in stats, _points(["value"], stats), extra=["r"], spread=None)
    long = values.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], F.when(F.col("point") < 0, "mean").otherwise("median").alias("stat"), "r", "value")
    return percentile_ci(long, [*keys, "stat"], "value", ci, interpolation)


def boot_stats(
    df: DataFrame,
    by: str | Sequence[str],
    key: str | Sequence[str],
    scales: str | Sequence[str] | None = None,
    n_iter: int = 1000,
    seed: int = 42,
    method: str = "exact",
    hash: str = "xxhash64",
    ci: float = 0.95,
    interpolation: str = "nearest",
    stats: Sequence[str] = STATS,
    broadcast_limit: int | None = None,
    median_accuracy: int | None = None,
    collapse: bool = False,
) -> DataFrame:
    """Grouped percentile bootstrap of means and medians for one category set.

    Resamples the **whole table** (not within groups) ``n_iter`` times, takes
    each statistic of each scale per group, and summarises the replicate
    values per (group, scale, stat) as median and percentile interval.

    Returns (by..., scale, stat, median, ci95_ll, ci95_ul). ``by`` may be empty
    (one whole-table group). ``key`` names a unique row key.
    ``median_accuracy`` switches the replicate median to the bounded-memory
    ``percentile_approx`` sketch (for continuous measures in huge groups).
    ``collapse=True``: bootstrap (group, scale, value) cells instead of rows (discrete
    measures), see :mod:`bootframe.operators.cells`.
    """
    by = as_set(by) if by else []
    measures = resolve_scales(df, scales)
    to = _Renamed(df, [*key_columns(key), *by, *measures], by, RESULT_COLUMNS)
    if to.names:
        return to.back(boot_stats(
            to.df, to.of(by), to.of(key), to.of(measures), n_iter, seed, method, hash, ci, interpolation, stats,
            broadcast_limit, median_accuracy, collapse,
        ))
    if collapse:
        out = _boot_cells(df, [by], measures, n_iter, seed, method, ci, interpolation, stats, "_set", hash)
        return out.drop("_set")
    narrow = _narrow(df, key_columns(key), by, measures)
    if median_accuracy is None:
        values = _boot_values(narrow, [by], by, key, measures, n_iter, [seed], method, hash, broadcast_limit, stats)
        return percentile_ci(_long(values, by, measures, stats), [*by, "scale", "stat"], "value", ci, interpolation)
    rows = _for_median(resample(narrow, key, n_iter, seed, method, hash, broadcast_limit), stats, median_accuracy)
    wide = wide_stats(rows, by, measures, stats, weight="w", extra_by=["r"], median_accuracy=median_accuracy)
    reps = unpivot_stats(wide, [*by, "r"], measures, stats)
    return percentile_ci(reps, [*by, "scale", "stat"], "value", ci, interpolation)


def boot_stats_sets(
    df: DataFrame,
    sets: Sequence[str | Sequence[str]],
    key: str | Sequence[str],
    scales: str | Sequence[str] | None = None,
    n_iter: int = 1000,
    seed: int = 42,
    method: str = "exact",
    hash: str = "xxhash64",
    ci: float = 0.95,
    interpolation: str = "nearest",
    stats: Sequence[str] = STATS,
    shared: bool = True,
    broadcast_limit: int | None = None,
    set_col: str = "set",
    median_accuracy: int | None = None,
    collapse: bool = False,
) -> DataFrame:
    """:func:`boot_stats` for many category sets: (set, keys..., scale, stat, median, ci…).

    ``shared=True``: one set of replicates feeds every set through GROUPING
    SETS (one scan, one draw). ``shared=False``: each set draws its own
    replicates (seed ``seed + k`` for the k-th set), as separate runs would;
    the per-set plans are unioned (the set list is small and fixed).
    Keys a set does not group by are NULL; ``set`` names the set.
    ``collapse=True``: bootstrap (set group, scale, value) cells (discrete measures), each
    set with its own replicates (as ``shared=False``), see :mod:`bootframe.operators.cells`.
    """
    asked = [as_set(s) for s in sets]
    measures = resolve_scales(df, scales)
    grouping = [c for s in asked for c in s]
    to = _Renamed(df, [*key_columns(key), *grouping, *measures], grouping, [*RESULT_COLUMNS, set_col])
    if to.names:
        out = boot_stats_sets(
            to.df, [to.of(s) for s in asked], to.of(key), to.of(measures), n_iter, seed, method, hash, ci,
            interpolation, stats, shared, broadcast_limit, set_col, median_accuracy, collapse,
        )
        return to.back(out, set_col, asked)
    norm, names = requested_names(asked)
    if collapse:
        return spread_names(_boot_cells(df, norm, measures, n_iter, seed, method, ci, interpolation, stats, set_col, hash), set_col, names)
    all_cols: list[str] = []
    for s in norm:
        for c in s:
            if c not in all_cols:
                all_cols.append(c)
    narrow = _narrow(df, key_columns(key), all_cols, measures)
    if median_accuracy is None:
        seeds = [seed] if shared else [seed + k for k in range(len(norm))]
        values = _boot_values(narrow, norm, all_cols, key, measures, n_iter, seeds, method, hash, broadcast_limit, stats)
        reps = _long(values, all_cols, measures, stats, [",".join(s) for s in norm], set_col)
        return spread_names(percentile_ci(reps, [set_col, *all_cols, "scale", "stat"], "value", ci, interpolation), set_col, names)
    if shared:
        rows = _for_median(resample(narrow, key, n_iter, seed, method, hash, broadcast_limit), stats, median_accuracy)
        wide, cols = grouping_sets_wide(rows, asked, measures, stats, "w", extra_by=["r"], set_col=set_col, median_accuracy=median_accuracy)
        reps = unpivot_stats(wide, [set_col, *cols, "r"], measures, stats)
        return percentile_ci(reps, [set_col, *cols, "scale", "stat"], "value", ci, interpolation)
    idx = row_index(narrow, key, hash=hash) if method == "exact" else None
    parts = []
    for k, s in enumerate(norm):
        rows = resample(narrow, key, n_iter, seed + k, method, hash, broadcast_limit, indexed=idx)
        rows = _for_median(rows, stats, median_accuracy)
        wide = wide_stats(rows, s, measures, stats, weight="w", extra_by=["r"], median_accuracy=median_accuracy)
        reps = unpivot_stats(wide, [*s, "r"], measures, stats)
        out = percentile_ci(reps, [*s, "scale", "stat"], "value", ci, interpolation)
        missing = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in all_cols if c not in s]
        parts.append(out.select(F.lit(",".join(s)).alias(set_col), *[F.col(c) for c in s], *missing, "scale", "stat",
                                *[c for c in out.columns if c not in s and c not in ("scale", "stat")]))
    result = spread_names(reduce(DataFrame.unionByName, parts), set_col, names)
    return result.select(set_col, *all_cols, *[c for c in result.columns if c not in (set_col, *all_cols)])


def _levels_and_centres(
    df: DataFrame, group: str, measures: Sequence[str], levels: Sequence | None
) -> tuple[list, dict[tuple[str, int], float]]:
    """The two compared levels and each level's observed mean per measure, in one small job.

    Levels: the first two sorted non-null values (or the first two given). The means
    centre the replicate sums; the collect holds at most two rows.
    """
    g = F.col(group)
    per_level = df.where(g.isNotNull())
    if levels is not None:
        per_level = per_level.where(g.isin(*list(levels)[:2]))
    stats = per_level.groupBy(group).agg(*[F.avg(F.col(c)).alias(f"m_{j}") for j, c in enumerate(measures)])
    rows = stats.orderBy(group).limit(2).collect()
    lv = list(levels)[:2] if levels is not None else [r[group] for r in rows]
    by_level = {r[group]: r for r in rows}
    centre = {
        (c, k): (by_level[lv[k - 1]][f"m_{j}"] if lv[k - 1] in by_level else None)
        for j, c in enumerate(measures)
        for k in (1, 2)
        if len(lv) >= k
    }
    return lv, centre


def boot_cohens_d(
    df: DataFrame,
    scales: str | Sequence[str],
    group: str,
    key: str | Sequence[str],
    n_iter: int = 1000,
    seed: int = 42,
    conf: float = 0.95,
    levels: Sequence | None = None,
    na: str = "propagate",
    method: str = "exact",
    hash: str = "xxhash64",
    broadcast_limit: int | None = None,
    collapse: bool = False,
) -> DataFrame:
    """Cohen's d per scale with a basic bootstrap interval: (scale, d, ci_level, ci_ll, ci_ul).

    All scales share one set of replicates (replicate r draws the same rows for
    every scale) and are evaluated in one aggregate over ``r``. The observed d
    (t0) uses the same ``group``. Rows in a third level stay in the resample pool.
    ``collapse=True``: replicate over (level, scale, value) cells — Poisson(count) weights,
    or exact-n Multinomial(n, count / n) per scale; work is cells × B
    (see :mod:`bootframe.operators.cells`).
    """
    measures = resolve_scales(df, scales)
    to = _Renamed(df, [*key_columns(key), group, *measures], [], ())
    if to.names:
        return to.back(boot_cohens_d(
            to.df, to.of(measures), to.of(group), to.of(key), n_iter, seed, conf, levels, na, method, hash,
            broadcast_limit, collapse,
        ))
    narrow = _narrow(df, key_columns(key), [group], measures)
    lv, centre = _levels_and_centres(narrow, group, measures, levels)
    t0 = cohens_d(narrow, measures, group, lv, na)
    if collapse:
        g = F.col(group)
        if method == "poisson":
            # Independent weights: a third level's rows do not affect d. Keep the two
            # compared levels and the missing-group rows (they make d undefined).
            relevant = narrow.where(g.isNull() | g.isin(*lv)) if lv else narrow.where(g.isNull())
        else:
            relevant = narrow  # exact-n: every row stays in the pool of n draws
        cells = set_cells(relevant, [[group]], measures, "_set")
        rows = _cell_weights(cells, n_iter, seed, method, "_set", hash).drop("_set")
        reps = cohens_d_parts_long(rows, group, lv, centre, "w", na=na)
    else:
        rows = resample(narrow, key, n_iter, seed, method, hash, broadcast_limit)
        reps = cohens_d_parts(rows, measures, group, lv, centre, "w", by=["r"], na=na)
    out = basic_ci(reps, t0.select("scale", "d"), ["scale"], "t", "d", conf)
    order = F.array_position(F.array(*[F.lit(c) for c in measures]), F.col("scale"))
    return out.orderBy(order).select("scale", "d", "ci_level", "ci_ll", "ci_ul")


def boot_custom(
    df: DataFrame,
    statistic: Callable[[Column], Column] | dict[str, Callable[[Column], Column]],
    key: str | Sequence[str],
    by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    n_iter: int = 1000,
    seed: int = 42,
    method: str = "exact",
    hash: str = "xxhash64",
    ci: float = 0.95,
    interpolation: str = "nearest",
    broadcast_limit: int | None = None,
) -> DataFrame:
    """Percentile bootstrap of user statistics written as Spark aggregate expressions.

    ``statistic(w)`` receives the frequency column and returns an aggregate
    Column (e.g. ``lambda w: F.max("x") - F.min("x")``); a dict gives several,
    named. Stays inside Catalyst: partial aggregation, codegen, no Python.
    Returns (by..., stat, median, ci95_ll, ci95_ul).
    """
    stats = statistic if isinstance(statistic, dict) else {"statistic": statistic}
    keep = list(columns) if columns is not None else [c for c in df.columns]
    narrow = _narrow(df, key_columns(key), [*by, *keep], [], ("r", "w", "i"))
    rows = resample(narrow, key, n_iter, seed, method, hash, broadcast_limit)
    w = F.col("w")
    wide = rows.groupBy(*by, "r").agg(*[fn(w).cast("double").alias(f"stat__{name}") for name, fn in stats.items()])
    cells = [F.struct(F.lit(name).alias("stat"), F.col(f"stat__{name}").alias("value")) for name in stats]
    reps = wide.select(*by, "r", F.inline(F.array(*cells)))
    return percentile_ci(reps, [*by, "stat"], "value", ci, interpolation)


def boot_custom_pandas(
    df: DataFrame,
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    combine: Callable[[pd.DataFrame], float],
    state_schema: str,
    key: str | Sequence[str],
    columns: Sequence[str],
    by: Sequence[str] = (),
    n_iter: int = 1000,
    seed: int = 42,
    method: str = "exact",
    hash: str = "xxhash64",
    ci: float = 0.95,
    interpolation: str = "nearest",
    rows_per_chunk: int = 1 << 20,
    broadcast_limit: int | None = None,
) -> DataFrame:
    """Percentile bootstrap of a user statistic written in pandas, as a two-phase aggregate.

    ``partial(pdf)`` gets a chunk of one replicate's rows (``by``, ``r``, ``columns`` and the
    frequency ``w``) and returns one row of state (``state_schema``);
    ``combine(states)`` folds all chunk states of a replicate into the value. The states are
    made in the task that weighs the rows: it sorts them by replicate (the sort spills) and cuts
    each replicate after ``rows_per_chunk`` rows, so a pandas call is bounded whatever the table
    size. Only states are shuffled; the combine step sees one state row per chunk.
    """
    if rows_per_chunk < 1:
        raise ValueError("rows_per_chunk must be at least 1")
    narrow = _narrow(df, key_columns(key), [*by, *columns], [], ("r", "w", "i"))
    rows = resample(narrow, key, n_iter, seed, method, hash, broadcast_limit).select(*by, "r", *columns, "w")
    group_cols = [*by, "r"]

    state_fields = [f.strip() for f in state_schema.split(",")]
    out_schema_partial = ", ".join([f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in by] +
                                   ["r bigint"] + state_fields)

    def _states(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        groups = [g for _, g in pdf.groupby(list(by), dropna=False, sort=False)] if by else [pdf]
        for group in groups:
            state = partial(group.reset_index(drop=True))
            for c in reversed(group_cols):
                state.insert(0, c, group[c].iloc[0])
            yield state

    def _partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, at = 0, None
        for batch in batches:
            for r, rest in batch.groupby("r", sort=False):
                if held and r != at:
                    yield from _states(held)
                    held, size = [], 0
                at = r
                while len(rest):
                    part, rest = rest.iloc[: rows_per_chunk - size], rest.iloc[rows_per_chunk - size :]
                    held.append(part)
                    size += len(part)
                    if size >= rows_per_chunk:
                        yield from _states(held)
                        held, size = [], 0
        if held:
            yield from _states(held)

    states = rows.sortWithinPartitions("r").mapInPandas(_partials, out_schema_partial)
    out_schema_final = ", ".join([f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in by] +
                                 ["r bigint", "value double"])

    def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {c: [pdf[c].iloc[0]] for c in group_cols}
        return pd.DataFrame({**head, "value": [float(combine(pdf))]})

    reps = states.groupBy(*group_cols).applyInPandas(_combine, out_schema_final)
    return percentile_ci(reps.withColumn("stat", F.lit("statistic")), [*by, "stat"], "value", ci, interpolation)
