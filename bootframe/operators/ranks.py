"""Group means and exact order statistics by rank selection: sums and counts, no lists of values.

An order statistic is found without gathering a group's values in one place:

1. *Brackets.* One aggregate over the plain rows keeps a quantile sketch of bounded size a
   group (``percentile_approx``). It gives each group a range of values that should hold the
   wanted ranks; for resampled rows it is ``SPREAD`` standard deviations of a
   replicate's rank wide, so of a group of n rows about sqrt(n) lie inside.
2. *Counts.* Each row knows, for each set of grouping columns, whether its value lies below,
   inside or above its group's bracket. One aggregate sums the weights below, next to the
   sums of the means: fixed-width state, combined before the shuffle. Sets whose
   columns another set has too are rolled up from that set's sums; rows are only expanded for
   the others.
3. *Selection.* Only rows inside a bracket are counted by value, and running sums in value order find
   the ranks (a window that streams; it holds no group).
4. *Check.* The counts prove whether a rank lies inside its bracket. Groups for which it
   doesn't are selected over all their rows, so brackets change the work, never the result.

The same plan serves every table size, weighted and unweighted rows, and all replicates at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bootframe.session import cut_lineage, input_partitions, parallelism

#: relative rank error of the sketches, inverse
ACCURACY = 10_000
#: a bracket's half width for resampled rows, in standard deviations of a replicate's rank
SPREAD = 6.0
#: half widths that a bracket can have, as shares of the group: 2^(-j/2)
STEPS = 26
#: sets whose places fit one BIGINT (two bits each)
SETS_A_FLAG = 31

RULES = ("median", "nearest", "disc", "linear")
BELOW, INSIDE, ABOVE, NULL = 0, 1, 2, 3


@dataclass(frozen=True)
class Point:
    """One order statistic of measure ``x{measure}``: quantile ``q`` by ``rule``."""

    measure: int
    q: float = 0.5
    rule: str = "median"

    def ranks(self, m: str) -> tuple[str, str]:
        """SQL of the two ranks (from 1) it is made of, among ``m`` values."""
        q = f"{float(self.q)!r}D"
        if self.rule == "median":
            return f"floor(({m} + 1) / 2)", f"floor({m} / 2) + 1"
        if self.rule == "linear":
            return f"floor(({m} - 1) * {q}) + 1", f"ceil(({m} - 1) * {q}) + 1"
        if self.rule == "nearest":
            k = f"floor(({m} - 1) * {q} + 0.5D) + 1"
        elif self.rule == "disc":
            k = f"greatest(ceil({m} * {q}), 1)"
        else:
            raise ValueError(f"rule must be one of {RULES}, got {self.rule!r}")
        return k, k

    def value(self, lo: str, hi: str, m: str) -> str:
        if self.rule == "median":
            return f"0.5D * {lo} + 0.5D * {hi}"
        if self.rule == "linear":
            place, (first, last) = f"(({m} - 1) * {float(self.q)!r}D)", self.ranks(m)
            return f"CASE WHEN {first} = {last} THEN {lo} ELSE ({last} - 1 - {place}) * {lo} + ({place} - ({first} - 1)) * {hi} END"
        return lo


def slots_of(points: Sequence[Point]) -> list[tuple[int, float]]:
    """The different (measure, quantile) of the points: points that share one share a bracket."""
    return list(dict.fromkeys((p.measure, p.q) for p in points))


def supersets(sets: Sequence[Sequence[int]]) -> list[int]:
    """For each set the one it is rolled up from: the smallest set of the list that has all its
    members and isn't part of another (itself, if there is no larger one)."""
    whole = [frozenset(s) for s in sets]
    top = [k for k, s in enumerate(whole) if not any(s < t for t in whole)]
    return [min((t for t in top if s <= whole[t]), key=lambda t: (len(whole[t]), t)) for s in whole]


def _keys(n: int) -> list[str]:
    return [f"k{i}" for i in range(n)]


def brackets(base: DataFrame, n_keys: int, sets: Sequence[Sequence[int]], slots: Sequence[tuple[int, float]], spread: float = 0.0) -> DataFrame:
    """(s, k…, lo0, hi0, lo1, …): a range of values per set, group and slot; null: no bound."""
    halves = [2.0 ** (-j / 2) for j in range(STEPS + 1)]
    aggs = []
    for b, (measure, q) in enumerate(slots):
        shares = ", ".join(f"{min(max(q + sign * h, 0.0), 1.0)!r}D" for h in halves for sign in (-1, 1))
        aggs += [F.expr(f"count(x{measure}) AS n{b}"), F.expr(f"percentile_approx(x{measure}, array({shares}), {ACCURACY}) AS a{b}")]
    keys = _keys(n_keys)
    if any(sets):
        # grouping_id: a bit a column, the first one highest, set where the set doesn't group by it
        gid = [sum(1 << (n_keys - 1 - i) for i in range(n_keys) if i not in s) for s in sets]
        found = base.groupingSets([[F.col(f"k{i}") for i in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggs, F.grouping_id().alias("g"))
        number = "CASE g " + " ".join(f"WHEN {g} THEN {s}" for s, g in enumerate(gid)) + " END AS s"
    else:
        found = base.agg(*aggs).withColumns({k: F.lit(None).cast(base.schema[k].dataType) for k in keys})
        number = "0 AS s"
    steps, out = [], []
    for b, (_, q) in enumerate(slots):
        n = f"greatest(n{b}, 1)"
        need = f"{spread * (q * (1 - q)) ** 0.5!r}D / sqrt({n}) + 3D / {n} + {3 / ACCURACY!r}D"
        steps.append(f"CAST(greatest(least(floor(-2D * log2({need})), {STEPS}), 0) AS int) AS j{b}")
        out += [f"CASE WHEN n{b} > 0 AND {q!r}D - pow(2D, -j{b} / 2D) > 0 THEN try_element_at(a{b}, 2 * j{b} + 1) END AS lo{b}"]
        out += [f"CASE WHEN n{b} > 0 AND {q!r}D + pow(2D, -j{b} / 2D) < 1 THEN try_element_at(a{b}, 2 * j{b} + 2) END AS hi{b}"]
    return found.selectExpr("*", *steps).selectExpr(number, *keys, *out)


def _flag(b: int, s: int) -> tuple[str, int]:
    """Column and first bit of the place of slot ``b`` in set ``s``."""
    return f"f{b}_{s // SETS_A_FLAG}", 2 * (s % SETS_A_FLAG)


def placed(base: DataFrame, found: DataFrame | None, sets: Sequence[Sequence[int]], slots: Sequence[tuple[int, float]]) -> DataFrame:
    """``base`` with flags: two bits per slot and set, the place of the row's value in its group's bracket."""
    bounds = [f"{side}{b}" for b in range(len(slots)) for side in ("lo", "hi")]
    flags: dict[str, list[str]] = {}
    columns = base.columns
    for s, members in enumerate(sets):
        of = {b: "NULL" for b in bounds}
        if found is not None:
            mine = found.where(f"s = {s}").selectExpr(*[f"k{i} AS b{s}_{i}" for i in members], *[f"{b} AS b{s}_{b}" for b in bounds])
            if members:
                base = base.join(mine, F.expr(" AND ".join(f"k{i} <=> b{s}_{i}" for i in members)), "left")
                of = {b: f"b{s}_{b}" for b in bounds}
            else:
                row = mine.first()  # the one group of the empty set
                of = {b: "NULL" if row[f"b{s}_{b}"] is None else f"CAST('{row[f'b{s}_{b}']!r}' AS DOUBLE)" for b in bounds}
        for b, (measure, _) in enumerate(slots):
            x, lo, hi = f"x{measure}", of[f"lo{b}"], of[f"hi{b}"]
            place = f"CASE WHEN {x} IS NULL THEN {NULL}L WHEN {x} < {lo} THEN {BELOW}L WHEN {x} > {hi} THEN {ABOVE}L ELSE {INSIDE}L END"
            name, bit = _flag(b, s)
            flags.setdefault(name, []).append(f"shiftleft({place}, {bit})")
    return base.selectExpr(*columns, *[f"{' | '.join(bits)} AS {n}" for n, bits in flags.items()])


def _place(b: int, s: int) -> str:
    name, bit = _flag(b, s)
    return f"(shiftright({name}, {bit}) & 3L)"


def group_values(
    base: DataFrame,
    n_keys: int,
    sets: Sequence[Sequence[int]],
    n_measures: int,
    means: bool,
    points: Sequence[Point],
    weigh: Callable[[DataFrame], DataFrame] | None = None,
    extra: Sequence[str] = (),
    spread: float | None = 0.0,
) -> DataFrame:
    """Means and order statistics of every group of every set.

    ``base``: columns ``k0…`` (keys), ``x0…`` (DOUBLE measures) and whatever ``weigh`` needs.
    ``weigh`` adds the columns ``extra`` (a replicate number) and a frequency ``w``; without
    it rows count once, or ``w`` times if ``base`` has that column. ``sets``: key numbers.
    ``spread``: see :data:`SPREAD` (0: rows aren't resampled; None: no brackets, all rows are selected from).
    A row's weights must not depend on which other rows are given.
    Returns (s, k…, extra…, point, value): point is -1 - j for the mean of ``x{j}``, else the
    number of the point. Keys a set doesn't group by are null.
    """
    keys, slots = _keys(n_keys), slots_of(points)
    for point in points:
        point.ranks("m")  # refuses an unknown rule before any job runs
    weigh = weigh or (lambda rows: rows if "w" in rows.columns else rows.withColumn("w", F.lit(1).cast("bigint")))
    # a small input (fewer splits than cores) is spread; a large one already is
    cores = parallelism(base.sparkSession)
    if input_partitions(base, cores) < cores:
        base = base.repartition(2 * cores)
    flagged = base
    if points:
        found = None if spread is None else cut_lineage(brackets(base, n_keys, sets, slots, spread))
        flagged = placed(base, found, sets, slots)
    totals = _totals(weigh(flagged), keys, sets, n_measures, means, slots, extra)
    if points:
        totals = cut_lineage(totals)  # read for the means and again for each selection
    parts = []
    if means:
        cells = ", ".join(f"struct({-1 - j} AS point, try_divide(sum{j}, n{j}) AS value)" for j in range(n_measures))
        parts.append(totals.selectExpr("s", *keys, *extra, f"inline(array({cells}))"))
    if points:
        marks = ", ".join(f"struct({b} AS slot, below{b} AS w, n{measure} AS m)" for b, (measure, _) in enumerate(slots))
        marks = totals.selectExpr("s", *keys, *extra, f"inline(array({marks}))")
        inside = weigh(_spread_rows(flagged, keys, sets, slots, only=INSIDE))
        picked = cut_lineage(_picked(inside, marks, keys, extra, points, slots))
        missed = picked.where("not ok")
        if missed.take(1):
            # ranks outside their bracket: all rows of these groups, from the start
            at = ["s", *keys, *extra, "slot"]
            named = missed.selectExpr(*[f"{c} AS {c}_m" for c in at]).distinct()
            again = F.expr(" AND ".join(f"{c} <=> {c}_m" for c in at))
            rows = weigh(_spread_rows(flagged, keys, sets, slots)).join(named, again, "left_semi")
            marks = marks.join(named, again, "left_semi").withColumn("w", F.lit(0).cast("bigint"))
            others = picked.join(named, again, "left_anti")
            picked = others.unionByName(_picked(rows, marks, keys, extra, points, slots))
        parts.append(picked.drop("ok", "slot"))
    return reduce(DataFrame.unionByName, parts)


def _totals(rows: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[int]], n_measures: int, means: bool, slots: Sequence[tuple[int, float]], extra: Sequence[str]) -> DataFrame:
    """(s, k…, extra…, sum and n of each measure, below of each slot) per set and group."""
    up = supersets(sets)
    tops = sorted(set(up))
    under = {t: [k for k, u in enumerate(up) if u == t] for t in tops}  # the sets each top is summed for
    types = {k: rows.schema[k].dataType.simpleString() for k in keys}
    if len(tops) > 1:
        rows = rows.withColumn("t", F.explode(F.expr(f"array({', '.join(map(str, tops))})")))
    else:
        rows = rows.withColumn("t", F.lit(tops[0]))
    group = []
    for i, k in enumerate(keys):
        of = [t for t in tops if i in sets[t]]
        group.append(k if len(of) == len(tops) else f"CASE WHEN t IN ({', '.join(map(str, of))}) THEN {k} END" if of else f"CAST(NULL AS {types[k]})")
    aggs = []
    for j in range(n_measures):
        aggs.append(f"sum(CASE WHEN x{j} IS NOT NULL THEN w END) AS n{j}")
        if means:
            aggs.append(f"sum(x{j} * w) AS sum{j}")
    for b in range(len(slots)):
        for d in range(max(len(v) for v in under.values())):
            # the place in the d-th set that this top is summed for
            at = {t: _place(b, ks[d]) for t, ks in under.items() if d < len(ks)}
            place = next(iter(at.values())) if len(tops) == 1 else "CASE t " + " ".join(f"WHEN {t} THEN {e}" for t, e in at.items()) + " END"
            aggs.append(f"sum(CASE WHEN {place} = {BELOW} THEN w END) AS below{b}_{d}")
    top = rows.groupBy("t", *[F.expr(g).alias(k) for g, k in zip(group, keys)], *extra).agg(*[F.expr(a) for a in aggs])
    sums = [f"n{j}" for j in range(n_measures)] + ([f"sum{j}" for j in range(n_measures)] if means else [])
    if len(sets) > 1:
        top = cut_lineage(top)
    out = []
    for s, members in enumerate(sets):
        d = under[up[s]].index(s)
        mine = top.where(F.col("t") == up[s])
        if up[s] == s:
            out.append(mine.selectExpr(f"{s} AS s", *keys, *extra, *sums, *[f"coalesce(below{b}_{d}, 0L) AS below{b}" for b in range(len(slots))]))
        else:
            below = [f"coalesce(sum(below{b}_{d}), 0L) AS below{b}" for b in range(len(slots))]
            part = mine.groupBy(*[keys[i] for i in members], *extra).agg(*[F.expr(f"sum({c}) AS {c}") for c in sums], *[F.expr(e) for e in below])
            own = [k if i in members else f"CAST(NULL AS {types[k]}) AS {k}" for i, k in enumerate(keys)]
            out.append(part.selectExpr(f"{s} AS s", *own, *extra, *sums, *[f"below{b}" for b in range(len(slots))]))
    return reduce(DataFrame.unionByName, out)


def _spread_rows(rows: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[int]], slots: Sequence[tuple[int, float]], only: int | None = None) -> DataFrame:
    """A row (s, k…, slot, value, and the row's other columns) for each set and slot in whose
    bracket the row's value lies (``only`` None: for each where it isn't null)."""
    flags = sorted({_flag(b, s)[0] for b in range(len(slots)) for s in range(len(sets))})
    if only is not None:
        # a row with a pair of bits 01 somewhere
        rows = rows.where(" OR ".join(f"({f} & ~shiftright({f}, 1) & {0x1555555555555555}L) <> 0" for f in flags))
    cells = []
    for s, members in enumerate(sets):
        own = ", ".join([f"{k} AS {k}" if i in members else f"CAST(NULL AS {rows.schema[k].dataType.simpleString()}) AS {k}" for i, k in enumerate(keys)] + [""])
        for b, (measure, _) in enumerate(slots):
            wanted = f"= {only}" if only is not None else f"<> {NULL}"
            cells.append(f"CASE WHEN {_place(b, s)} {wanted} THEN struct({s} AS s, {own}{b} AS slot, x{measure} AS value) END")
    others = [c for c in rows.columns if c not in flags and c not in keys and not (c[0] == "x" and c[1:].isdigit())]
    return rows.selectExpr(*others, f"explode(filter(array({', '.join(cells)}), c -> c IS NOT NULL)) AS cell").selectExpr(*others, "cell.*")


def _picked(rows: DataFrame, marks: DataFrame, keys: Sequence[str], extra: Sequence[str], points: Sequence[Point], slots: Sequence[tuple[int, float]]) -> DataFrame:
    """(s, k…, extra…, slot, point, value, ok) by running sums over the values in order.

    ``marks``: per group and slot the weight before the first of ``rows`` (w) and the whole weight (m).
    """
    at = ["s", *keys, *extra, "slot"]
    counted = rows.groupBy(*at, "value").agg(F.sum("w").alias("w"))
    # the mark comes first: it has no value
    line = counted.selectExpr(*at, "value", "w", "CAST(NULL AS bigint) AS m").unionByName(marks.selectExpr(*at, "CAST(NULL AS double) AS value", "w", "CAST(m AS bigint) AS m"))
    order = Window.partitionBy(*at).orderBy(F.col("value").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("cum", F.sum("w").over(upto)).withColumn("m", F.first("m").over(upto))
    aggs, cells = ["max(m) AS m", "min(CASE WHEN value IS NULL THEN cum END) AS below", "max(cum) AS cum"], []
    for p, point in enumerate(points):
        mine = f"slot = {slots.index((point.measure, point.q))}"
        first, last = point.ranks("m")
        for name, rank in (("lo", first), ("hi", last)):
            aggs.append(f"min(CASE WHEN {mine} AND value IS NOT NULL AND cum >= {rank} THEN value END) AS {name}{p}")
        ok = f"coalesce(m, 0) = 0 OR coalesce(below < {first} AND cum >= {last}, false)"
        value = f"CASE WHEN m > 0 THEN {point.value(f'lo{p}', f'hi{p}', 'm')} END"
        cells.append(f"CASE WHEN {mine} THEN struct({p} AS point, {value} AS value, {ok} AS ok) END")
    found = line.groupBy(*at).agg(*[F.expr(a) for a in aggs])
    return found.selectExpr(*at, f"inline(filter(array({', '.join(cells)}), c -> c IS NOT NULL))")
