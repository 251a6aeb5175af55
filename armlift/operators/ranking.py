"""Order units by a score and read off the incremental outcomes of targeting the top.

Input is the long table of scored units (metric, unit_id, score, t, y). A global
order over all units never goes through one task: the units are range-partitioned
by (metric, score, unit id), numbered inside their partition and shifted by the
sizes of the partitions before. Ties in the score follow the unit id, so a score
shared by very many units still splits over partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.functions.numeric import derive, each, group, literal, name, pick, ratio, root, with_each_value
from armlift.functions.tails import two_sided_z
from armlift.operators.lift import around
from armlift.schema import Roles
from armlift.session import stored

# Points of the curve and target shares of the standard report.
CURVE_POINTS = 101
TARGET_SHARES = (0.1, 0.2, 0.3, 0.5)
N_DECILES = 10

# monotonically_increasing_id holds the partition above 33 bits of row number
ROW_BITS = 33


def scored_long(wide: DataFrame, scores: dict[str, str], roles: Roles = Roles()) -> DataFrame:
    """(metric, unit_id, score, t, y) from one score column per metric."""
    return each(
        wide,
        [
            {
                "metric": literal(m),
                "unit_id": name(roles.unit_id),
                "score": f"cast({name(score)} as double)",
                "t": name(roles.treatment),
                "y": name(m),
            }
            for m, score in scores.items()
        ],
    )


def ranked(scored: DataFrame) -> DataFrame:
    """Add ``rank`` (1 = highest score of the metric) and ``n`` (units of the metric)."""
    order = [F.col("metric"), F.col("score").desc(), F.col("unit_id")]
    numbered = stored(
        scored.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
    )
    numbered = derive(numbered, {"part": f"shiftright(place, {ROW_BITS})"})
    parts = group(numbered, ["metric", "part"], {"first_place": "min(place)", "size": "count(1)"})
    earlier = "over (partition by metric order by part rows between unbounded preceding and 1 preceding)"
    offsets = parts.selectExpr(
        "metric",
        "part",
        "first_place",
        f"coalesce(sum(size) {earlier}, 0L) as before",
        "sum(size) over (partition by metric) as n",
    )
    # offsets has one row per metric and range partition
    return numbered.join(F.broadcast(offsets), ["metric", "part"]).selectExpr(
        "metric", "unit_id", "score", "t", "y", "before + place - first_place + 1 as rank", "n"
    )


def curve_position(k: str, points: int) -> str:
    """Row number, from 0, of the k-th of ``points`` evenly spaced positions on 0 .. n - 1, rounded down."""
    step = f"((n - 1) / {literal(float(points - 1))})"
    return f"cast(if({k} >= {points - 1}, n - 1, floor({k} * {step})) as bigint)"


def with_interval(ranks: DataFrame, points: int) -> DataFrame:
    """Add ``interval``: number of the first curve position at or after the unit."""
    index = "(rank - 1)"
    guess = f"cast(coalesce(ceil(try_divide({index} * {points - 1}, n - 1)), 0) as bigint)"
    # rounding down can move a position by one row, so the guess may be one off
    settled = (
        f"case when guess > 0 and {curve_position('(guess - 1)', points)} >= {index} then guess - 1 "
        f"when {curve_position('guess', points)} >= {index} then guess else guess + 1 end"
    )
    return derive(derive(ranks, {"guess": guess}), {"interval": settled})


def qini_curve(ranks: DataFrame, points: int = CURVE_POINTS) -> DataFrame:
    """(metric, point, phi, q): incremental outcomes q when the top share phi is targeted.

    q = treated outcomes minus control outcomes scaled to the treated count, 0 while
    no control unit is included. Only sums between neighbouring positions leave the
    tasks; the running totals are over at most ``points`` rows per metric.
    """
    sums = {"n_t": "sum(t)", "n_c": "sum(1 - t)", "y_t": "sum(y * t)", "y_c": "sum(y * (1 - t))"}
    between = group(
        with_interval(ranks, points), ["metric", "interval"], {"rank": "max(rank)", "n": "max(n)", **sums}
    )
    upto = "over (partition by metric order by rank rows between unbounded preceding and current row)"
    running = between.selectExpr("metric", "rank", "n", *[f"sum({c}) {upto} as {c}" for c in sums])
    q = f"if(n_c > 0, y_t - y_c * {ratio('n_t', 'n_c')}, 0D)"
    here = f"named_struct('rank', rank, 'phi', {ratio('rank', 'n')}, 'q', {q})"
    origin = "named_struct('rank', 0L, 'phi', 0D, 'q', 0D)"
    curve = running.selectExpr("metric", f"inline(if(rank = 1, array({origin}, {here}), array({here})))")
    return curve.selectExpr(
        "metric", "row_number() over (partition by metric order by rank) - 1 as point", "phi", "q"
    )


def with_previous(curve: DataFrame) -> DataFrame:
    """Add the point before and the total of the curve."""
    along = "over (partition by metric order by point)"
    whole = along[:-1] + " rows between unbounded preceding and unbounded following)"
    return derive(
        curve, {"phi_0": f"lag(phi) {along}", "q_0": f"lag(q) {along}", "total": f"last_value(q) {whole}"}
    )


def qini_coefficient(curve: DataFrame) -> DataFrame:
    """Area between the curve and the straight line, over the absolute total; 0 if the total is 0."""
    summed = group(
        with_previous(curve),
        ["metric"],
        {"total_incremental": "max(total)", "area": "sum((q + q_0) / 2 * (phi - phi_0))"},
    )
    gain = ratio("(area - total_incremental / 2)", "abs(total_incremental)")
    return summed.selectExpr(
        "metric", "total_incremental", f"if(total_incremental = 0, 0D, {gain}) as qini"
    )


def normalized_curve(curve: DataFrame) -> DataFrame:
    """The curve as a share of the total; undivided where the total is 0."""
    share = f"if(total = 0, q, {ratio('q', 'total')})"
    return with_previous(curve).selectExpr("metric", "point", "phi", f"{share} as q_share")


def capture(curve: DataFrame, shares: tuple[float, ...] = TARGET_SHARES) -> DataFrame:
    """Share of all incremental outcomes kept by targeting each top share (linear interpolation)."""
    pieces = with_each_value(with_previous(curve).filter("point > 0"), "share", shares)
    at_share = f"(q_0 + {ratio('(q - q_0)', '(phi - phi_0)')} * (share - phi_0))"
    return pieces.filter("phi_0 < share and share <= phi").selectExpr(
        "metric", "share", f"{ratio(at_share, 'total')} as capture"
    )


def deciles(ranks: DataFrame, level: float = 0.95) -> DataFrame:
    """Predicted and observed uplift per tenth of the ranking.

    Tenths are cut at interpolated ranks 1 + (n - 1) d / 10, which differ from
    equal counts when n is not a multiple of 10.
    """
    tenth = f"cast(greatest(1, ceil({N_DECILES} * (rank - 1) / greatest(n - 1, 1))) as int)"
    stats = {"n": "count(1)", "predicted_uplift": "avg(score)"}
    for suffix, arm in (("t", 1), ("c", 0)):
        y = f"case when t = {arm} then y end"
        stats |= {f"n_{suffix}": f"count_if(t = {arm})", f"mean_{suffix}": f"avg({y})", f"var_{suffix}": f"var_samp({y})"}
    # the rank columns give way to the count per decile
    placed = derive(ranks, {"decile": tenth}).drop("rank", "n")
    observed = derive(
        group(placed, ["metric", "decile"], stats),
        {
            "observed_uplift": "mean_t - mean_c",
            "se": root(f"{ratio('var_t', 'n_t')} + {ratio('var_c', 'n_c')}"),
        },
    )
    lo, hi = around("observed_uplift", "se", two_sided_z(level))
    kept = ("metric", "decile", "predicted_uplift", "observed_uplift")
    return pick(observed, {**{c: c for c in kept}, "ci_lo": lo, "ci_hi": hi, "n": "n"})
