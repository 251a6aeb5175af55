"""The registered queries once more, as SQL for an independent engine.

Tail probabilities are integrated numerically here (Simpson's rule), so they do
not share a formula with the library.
"""

from __future__ import annotations

import math

from armlift.plans.registry import COARSE_VECTOR, DIGITS, ROLES, STUMP_EDGES, STUMPS

FEATURES = [f"f{i}" for i in range(12)]
BINARY = ["treatment", "conversion", "visit", "exposure"]
METRICS = ["visit", "conversion"]
Z95 = "1.959963984540054e0"
Z80 = "0.8416212335729143e0"


def uniform(salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}' || unit_id::varchar), 1, 13))::bigint / 4503599627370496::double)"


EXPERIMENT = f"""
lines as (
  select l_orderkey, count(*)::double f5, sum(l_quantity) f6,
         sum(floor(l_discount * 100 + 0.5e0)::bigint)::double / 100e0 / count(l_discount) f7,
         sum(floor(l_tax * 100 + 0.5e0)::bigint)::double / 100e0 / count(l_tax) f8,
         max(l_extendedprice) f9, sum(case when l_returnflag = 'R' then 1 else 0 end)::double f10
  from lineitem group by l_orderkey),
base as (
  select o_orderkey unit_id, o_totalprice::double f0, month(o_orderdate)::double f1, c_acctbal::double f2,
         c_nationkey::double f3, substr(o_orderpriority, 1, 1)::double f4, f5, f6, f7, f8, f9, f10,
         case when o_orderkey % 50 = 0 then 0e0 else 1e0 end f11
  from orders join customer on o_custkey = c_custkey left join lines on o_orderkey = l_orderkey),
armed as (
  select *, case when {uniform('arm')} < 0.85e0 then 1 else 0 end treatment,
         case when f0 > 250000 then 1e0 else 0e0 end expensive, case when f2 > 5000 then 1e0 else 0e0 end rich
  from base),
shown as (
  select *, case when treatment = 1 and {uniform('exp')} < 0.1e0 + 0.3e0 * expensive then 1 else 0 end exposure
  from armed),
visited as (
  select *, case when {uniform('vis')} < 0.04e0 + 0.04e0 * expensive + exposure * (0.1e0 + 0.25e0 * rich)
                 then 1 else 0 end visit
  from shown),
raw as (
  select unit_id, {', '.join(FEATURES)}, treatment,
         case when visit = 1 and {uniform('cnv')} < 0.3e0 then 1 else 0 end conversion, visit, exposure
  from visited),
units as (
  select * from raw
  where {' and '.join(f'{c} is not null' for c in FEATURES + BINARY)}
    and not ({' or '.join(f'isnan({f})' for f in FEATURES)}))"""


def sql(select: str, *ctes: str) -> str:
    return "with " + ",".join([EXPERIMENT, *ctes]) + "\n" + select


def union(template: str, names: list[str]) -> str:
    return "\nunion all\n".join(template.format(c=c) for c in names)


# --- numerical integration


def simpson(integrand: str, upper: str, steps: int = 2000) -> str:
    """Integral from 0 to ``upper`` of ``integrand``, an expression in {u}."""
    point = f"({upper} * i / {steps}e0)"
    weight = f"(case when i in (0, {steps}) then 1 when i % 2 = 1 then 4 else 2 end)"
    body = integrand.replace("{u}", point)
    return f"(select {upper} / {3 * steps}e0 * sum({weight} * {body}) from range(0, {steps + 1}) s(i))"


def normal_two_sided(z: str) -> str:
    # the density at z is taken out of the integral over the tail, which keeps small p exact;
    # 8000 steps leave a relative error near 1e-13, below every rounding in use
    upper = f"least(9e0, 40e0 / greatest(abs({z}), 1e-9))"
    tail = simpson(f"exp(-abs({z}) * {{u}} - 0.5e0 * {{u}} * {{u}})", upper, steps=8000)
    return f"(2e0 / sqrt(2 * pi()) * exp(-0.5e0 * {z} * {z}) * {tail})"


def normal_cdf(x: str) -> str:
    clipped = f"least(abs({x}), 40e0)"
    return f"(0.5e0 + sign({x}) / sqrt(2 * pi()) * {simpson('exp(-0.5e0 * {u} * {u})', clipped)})"


def chi2_tail(x: str, k: str) -> str:
    # the tail itself is integrated, from sqrt(x) on, so small values keep their digits
    u = f"(sqrt({x}) + {{u}})"
    tail = simpson(f"(case when {k} = 1 then 1e0 else pow({u}, {k} - 1) end * exp(-0.5e0 * {u} * {u}))", "12e0", steps=4000)
    return f"(case when {k} <= 0 then 1e0 else least(1e0, pow(2e0, 1 - {k} / 2e0) / gamma({k} / 2e0) * {tail}) end)"


def student_two_sided(t: str, v: str) -> str:
    inner = simpson(f"pow(1 + {{u}} * {{u}} / {v}, -({v} + 1) / 2e0)", f"abs({t})")
    scale = f"exp(lgamma(({v} + 1) / 2e0) - lgamma({v} / 2e0)) / sqrt({v} * pi())"
    return f"greatest(0e0, 1e0 - 2e0 * {scale} * {inner})"


# --- shared pieces

COUNTS = union(
    "select '{c}' metric, sum(treatment)::bigint n_t, sum({c} * treatment)::bigint x_t, "
    "sum(1 - treatment)::bigint n_c, sum({c} * (1 - treatment))::bigint x_c from units",
    METRICS,
)
RATES = """
rates as (select *, x_t::double / n_t rate_treatment, x_c::double / n_c rate_control from counts),
errors as (
  select *, (x_t + x_c)::double / (n_t + n_c) pool,
         sqrt((x_t + x_c)::double / (n_t + n_c) * (1 - (x_t + x_c)::double / (n_t + n_c)) * (1e0 / n_t + 1e0 / n_c)) se0,
         sqrt(rate_treatment * (1 - rate_treatment) / n_t + rate_control * (1 - rate_control) / n_c) se,
         rate_treatment - rate_control diff, rate_treatment / nullif(rate_control, 0) rr
  from rates)"""
LIFT = f"""
counts as ({COUNTS}), {RATES},
logs as (
  select *, diff / se0 z,
         sqrt((1 - rate_treatment) / (n_t * rate_treatment) + (1 - rate_control) / (n_c * rate_control)) lse
  from errors),
lift as (
  select metric, n_t, x_t, n_c, x_c, rate_treatment, rate_control, diff abs_lift,
         diff - {Z95} * se abs_lo, diff + {Z95} * se abs_hi, rr - 1 rel_lift,
         rr * exp(-{Z95} * lse) - 1 rel_lo, rr * exp({Z95} * lse) - 1 rel_hi, z,
         {normal_two_sided('z')} p_value
  from logs)"""


def power_at(n_t: str, n_c: str, source: str, name: str) -> str:
    """CTE adding ``power`` for arm sizes given by expressions."""
    return f"""
{name}_errors as (
  select *, ({n_t} * rate_treatment + {n_c} * rate_control) / ({n_t} + {n_c}) pbar, 1e0 / ({n_t}) + 1e0 / ({n_c}) inv,
         sqrt(rate_treatment * (1 - rate_treatment) / ({n_t}) + rate_control * (1 - rate_control) / ({n_c})) se1
  from {source}),
{name}_limits as (
  select *, (abs(rate_treatment - rate_control) - {Z95} * sqrt(pbar * (1 - pbar) * inv)) / se1 hi,
         (-abs(rate_treatment - rate_control) - {Z95} * sqrt(pbar * (1 - pbar) * inv)) / se1 lo
  from {name}_errors),
{name} as (select *, {normal_cdf('hi')} + {normal_cdf('lo')} power from {name}_limits)"""


GRID = LIFT + "," + """
grid as (
  select r.*, fraction from rates r,
         (select unnest([1e0, 0.5e0, 0.2e0, 0.1e0, 0.05e0, 0.02e0, 0.01e0, 0.005e0, 0.002e0, 0.001e0]) fraction)),""" + power_at(
    "n_t * fraction", "n_c * fraction", "grid", "powered"
) + f""",
detectable as (
  select *, ({Z95} + {Z80}) * sqrt(rate_control * (1 - rate_control) * inv) mde_abs,
         rate_treatment / rate_control - 1 rel_lift
  from powered)"""

BUCKETS = union(
    "select k, bucket, '{c}' metric, sum(treatment)::bigint n_t, sum({c} * treatment)::bigint x_t, "
    "sum(1 - treatment)::bigint n_c, sum({c} * (1 - treatment))::bigint x_c from assigned group by k, bucket",
    METRICS,
)
BUCKET_TESTS = f"""
ks as (select unnest([10, 100, 1000]) k),
placed as (select *, {uniform('power')} place from units),
assigned as (select *, floor(place * k)::int bucket from placed, ks),
counts as ({BUCKETS}),
rates as (select *, x_t::double / nullif(n_t, 0) rate_treatment, x_c::double / nullif(n_c, 0) rate_control from counts),
errors as (
  select *, (x_t + x_c)::double / (n_t + n_c) pool from rates),
zs as (
  select *, case when n_t = 0 or n_c = 0 then null
                 when pool * (1 - pool) = 0 then 0e0
                 else (rate_treatment - rate_control) / sqrt(pool * (1 - pool) * (1e0 / n_t + 1e0 / n_c)) end z
  from errors),
tested as (select *, case when z is not null then {normal_two_sided('z')} end p_value from zs)"""


def moments(group: str, where: str = "true") -> str:
    return f"""
long as (
  select {group} g, unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) feature, unnest([{', '.join(FEATURES)}]) v
  from units where {where}),
m as (select g, feature, count(v) n, avg(v) mean, var_samp(v) var from long group by 1, 2),
pairs as (
  select a.feature, a.n n1, a.mean mean1, a.var var1, b.n n0, b.mean mean0, b.var var0,
         case when sqrt((a.var + b.var) / 2) = 0 then 0e0 else (a.mean - b.mean) / sqrt((a.var + b.var) / 2) end smd
  from m a join m b on a.feature = b.feature and a.g = 1 and b.g = 0)"""


BALANCE = moments("treatment") + f""",
welched as (
  select *, (mean1 - mean0) / sqrt(var1 / n1 + var0 / n0) welch_t,
         pow(var1 / n1 + var0 / n0, 2) / (pow(var1 / n1, 2) / (n1 - 1) + pow(var0 / n0, 2) / (n0 - 1)) welch_df
  from pairs),
balance as (
  select feature, mean1 mean_treatment, mean0 mean_control, smd, var1 / nullif(var0, 0) variance_ratio,
         welch_t, welch_df, {student_two_sided('welch_t', 'welch_df')} welch_p, abs(smd) < 0.10e0 balanced
  from welched)"""
RANKED_SMD = "select feature, smd, abs(smd) abs_smd, (row_number() over (order by abs(smd) desc, feature))::int place from "

COMPLIANCE = "compliance as (" + union(
    "select '{c}' metric, "
    + ", ".join(
        f"sum(case when treatment = 1 and exposure = {e} and {{c}} = {y} then 1 else 0 end)::bigint t_e{e}_y{y}"
        for e in (0, 1)
        for y in (0, 1)
    )
    + ", sum(case when treatment = 0 then 1 else 0 end)::bigint c_n"
    ", sum(case when treatment = 0 and {c} = 1 then 1 else 0 end)::bigint c_y1"
    ", sum(case when treatment = 0 and exposure = 1 then 1 else 0 end)::bigint c_exposed from units",
    METRICS,
) + ")"
EFFECTS = COMPLIANCE + """,
effects_1 as (
  select *, t_e1_y0 + t_e1_y1 n_e, t_e0_y0 + t_e0_y1 + t_e1_y0 + t_e1_y1 n_t, c_y1::double / c_n rate_control
  from compliance),
effects_2 as (
  select *, (t_e0_y1 + t_e1_y1)::double / n_t rate_treatment, t_e1_y1::double / n_e rate_exposed,
         t_e0_y1::double / (n_t - n_e) rate_unexposed, n_e::double / n_t compliance
  from effects_1),
effects_3 as (
  select *, rate_treatment - rate_control itt, (rate_treatment - rate_control) / compliance cace from effects_2),
effects as (
  select metric, n_t, c_n, t_e1_y1, rate_control, rate_treatment, rate_exposed, rate_unexposed, compliance, itt,
         itt / rate_control itt_rel, cace, rate_exposed - cace rate_without_exposure,
         case when rate_exposed - cace > 0 then cace / (rate_exposed - cace) end cace_rel,
         rate_exposed - rate_control naive_vs_control, rate_exposed - rate_unexposed naive_vs_unexposed
  from effects_3)"""
EFFECT_COLUMNS = (
    "metric, rate_control, rate_treatment, rate_exposed, rate_unexposed, compliance, itt, itt_rel, cace, "
    "rate_without_exposure, cace_rel, naive_vs_control, naive_vs_unexposed"
)

SEGMENTS = f"""
long as (
  select treatment, visit, conversion, unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) feature,
         unnest([{', '.join(FEATURES)}]) v
  from units),
cuts as (select distinct feature, unnest(quantile_disc(v, [0.2, 0.4, 0.6, 0.8])) edge from long group by feature),
edges as (select feature, list(edge order by edge) e from cuts group by feature),
placed as (
  select l.*, e, (coalesce((v > e[1])::int, 0) + coalesce((v > e[2])::int, 0) + coalesce((v > e[3])::int, 0)
                  + coalesce((v > e[4])::int, 0))::int bucket
  from long l join edges using (feature)),
sums as (
  select substr(feature, 2)::int feature_index, feature, bucket, any_value(e) e,
         sum(treatment)::bigint n_t, sum(1 - treatment)::bigint n_c,
         sum(visit * treatment)::bigint visit_t, sum(visit * (1 - treatment))::bigint visit_c,
         sum(conversion * treatment)::bigint conversion_t, sum(conversion * (1 - treatment))::bigint conversion_c
  from placed group by feature, bucket),
counts as ({union("select feature_index, feature, bucket, e, '{c}' metric, n_t, n_c, {c}_t x_t, {c}_c x_c from sums", METRICS)}),
{RATES},
segment_z as (select *, case when se0 = 0 then 0e0 else diff / se0 end z from errors),
segments as (
  select feature_index, feature, bucket,
         '(' || case when bucket = 0 then '-inf' else printf('%.3g', e[bucket]) end || ', '
             || case when bucket = len(e) then '+inf' else printf('%.3g', e[bucket + 1]) end || ']' as "range",
         metric, n_t + n_c n, n_t, n_c, rate_control, rate_treatment, diff lift, se, rr - 1 rel_lift,
         {normal_two_sided('z')} p_value
  from segment_z)"""
ADJUSTED = SEGMENTS + """,
numbered as (
  select *, row_number() over (partition by metric order by p_value, feature_index, bucket) r,
         count(*) over (partition by metric) family_size
  from segments),
adjusted as (
  select *, least(1e0, min(p_value * family_size / r) over (partition by metric order by r desc
                  rows between unbounded preceding and current row)) p_bh
  from numbered)"""
HETEROGENEITY = SEGMENTS + f""",
centres as (
  select feature, metric, sum(lift / (se * se)) / sum(1 / (se * se)) centre
  from segments where se > 0 group by 1, 2),
qs as (
  select feature_index, s.feature, s.metric, count(*) n_buckets, sum(case when se > 0 then 0 else 1 end)::bigint n_without_se,
         coalesce(sum(case when se > 0 then pow(lift - centre, 2) / (se * se) end), 0e0) q, max(lift) - min(lift) lift_range
  from segments s left join centres c on s.feature = c.feature and s.metric = c.metric group by 1, 2, 3),
chi as (select *, {chi2_tail('q', '(n_buckets - n_without_se - 1)')} p_value, count(*) over () n_tests from qs),
heterogeneity as (
  select feature_index, feature, metric, n_buckets, n_without_se, q, p_value, lift_range, n_tests,
         least(1e0, p_value * n_tests) p_bonferroni
  from chi)"""


def ranked(score: str) -> str:
    rows = union(f"select '{{c}}' metric, unit_id, {score} score, treatment t, {{c}} y from units", METRICS)
    return f"""
scored as ({rows}),
ranks as (
  select *, row_number() over (partition by metric order by score desc, unit_id) rank, count(*) over (partition by metric) n
  from scored)"""


def curve(score: str) -> str:
    return ranked(score) + """,
running as (
  select metric, rank, n, sum(t) over w n_t, sum(1 - t) over w n_c, sum(y * t) over w y_t, sum(y * (1 - t)) over w y_c
  from ranks window w as (partition by metric order by rank rows between unbounded preceding and current row)),
positions as (
  select distinct metric, case when k = 100 then n - 1 else floor(k * ((n - 1) / 100e0))::bigint end pos
  from (select metric, count(*) n from scored group by metric), range(0, 101) s(k)),
points as (
  select r.metric, r.rank, rank::double / n phi,
         case when n_c > 0 then y_t - y_c * (n_t::double / n_c) else 0e0 end q
  from running r join positions p on r.metric = p.metric and r.rank = p.pos + 1
  union all
  select distinct metric, 0, 0e0, 0e0 from scored),
curve as (select metric, (row_number() over (partition by metric order by rank) - 1)::int point, phi, q from points),
steps as (
  select *, lag(phi) over w phi0, lag(q) over w q0, last_value(q) over (partition by metric order by point
         rows between unbounded preceding and unbounded following) total
  from curve window w as (partition by metric order by point))"""


SPLIT = f"""
total as (select count(*) n from units),
sampled as (select u.* from units u, total where {uniform('sample')} < 0.7e0),
split as (select *, {uniform('split')} < 0.5e0 is_test from sampled)"""
EXACT_SPLIT = f"""
hashed as (select *, {uniform('split')} place from units),
ordered as (
  select *, row_number() over (partition by treatment order by place) r, count(*) over (partition by treatment) n from hashed),
split as (select *, r <= ceil(0.5e0 * n) is_test from ordered)"""


def plain() -> dict[str, str]:
    """Queries before rounding."""
    present = "and ".join(f"{c} is not null " for c in FEATURES + BINARY)
    not_nan = "and ".join(f"not isnan({f}) " for f in FEATURES)
    coarse = ", ".join(COARSE_VECTOR)
    full = ", ".join(FEATURES + BINARY)
    nan = lambda c: f"sum(case when isnan({c}) then 1 else 0 end)::bigint" if c in FEATURES else "0::bigint"
    # rows of the grouped table count duplicates of full rows
    coarse_full = ", ".join([*COARSE_VECTOR, *BINARY])
    q: dict[str, str] = {}
    q["profile_missing"] = sql(
        "\nunion all\n".join(
            f"select '{c}' as \"column\", sum(case when {c} is null then 1 else 0 end)::bigint n_null, "
            f"coalesce({nan(c)}, 0)::bigint n_nan, count(*) n from raw"
            for c in FEATURES + BINARY
        )
    )
    q["profile_rows"] = sql(
        f"select count(*) rows_read, sum(case when {present} and {not_nan} then 1 else 0 end)::bigint rows_written, "
        f"sum(case when {present} and {not_nan} then 0 else 1 end)::bigint rows_dropped from raw"
    )
    q["profile_binary_values"] = sql(
        union("select '{c}' as \"column\", {c} as \"value\", count(*) n from raw where {c} is not null group by {c}", BINARY)
    )
    q["profile_binary_domain"] = sql(
        union(
            "select '{c}' as \"column\", count(*) filter ({c} = 0) n_zero, count(*) filter ({c} = 1) n_one, "
            "count(*) filter ({c} not in (0, 1)) n_other, min({c}) min_value, max({c}) max_value, "
            "array_sort(list(distinct {c})) = [0, 1] is_binary from raw",
            BINARY,
        )
    )
    q["profile_consistency"] = sql(
        "select 'control_exposed' as \"check\", count(*) filter (treatment = 0 and exposure = 1) n_violations from raw "
        "union all select 'conversion_without_visit', count(*) filter (conversion = 1 and visit = 0) from raw"
    )
    q["profile_duplicates"] = sql(
        f"select n, n - n_rows duplicate_rows, n - n_vectors duplicate_vectors from "
        f"(select count(*) n from raw), (select count(*) n_rows from (select distinct {full} from raw)), "
        f"(select count(*) n_vectors from (select distinct {', '.join(FEATURES)} from raw))"
    )
    q["profile_duplicates_coarse"] = sql(
        f"select n, n - n_rows duplicate_rows, n - n_vectors duplicate_vectors from "
        f"(select count(*) n from raw), (select count(*) n_rows from (select distinct {coarse_full} from raw)), "
        f"(select count(*) n_vectors from (select distinct {coarse} from raw))"
    )
    q["profile_arm_counts"] = sql("select treatment, count(*) n from raw group by treatment")
    q["profile_treatment_share"] = sql(
        "select count(*) n, sum(treatment)::bigint n_treatment, sum(treatment)::double / count(*) treatment_share from raw"
    )
    q["profile_binary_means"] = sql(union("select '{c}' as \"column\", avg({c}) mean from raw", BINARY))
    q["profile_feature_moments"] = sql(
        union(
            "select '{c}' feature, avg({c}) mean, stddev_samp({c}) stddev, min({c}) as \"min\", max({c}) as \"max\" from raw",
            FEATURES,
        )
    )
    q["profile_feature_quartiles"] = sql(
        "\nunion all\n".join(
            f"select '{f}' feature, {p}e0 probability, quantile_disc({f}, {p}) as \"value\" from raw"
            for f in FEATURES
            for p in (0.25, 0.5, 0.75)
        )
    )

    q["validity_srm"] = sql(
        f"""select n_treatment, n_control, 0.85e0 design_share, share observed_share,
          share - 1.96e0 * sqrt(share * (1 - share) / n) ci_lo, share + 1.96e0 * sqrt(share * (1 - share) / n) ci_hi,
          chi2, {chi2_tail('chi2', '1')} p_value, 0.001e0 alpha, {chi2_tail('chi2', '1')} < 0.001e0 srm_detected from chis""",
        """ns as (select sum(treatment)::bigint n_treatment, sum(1 - treatment)::bigint n_control, count(*) n from units)""",
        """chis as (select *, n_treatment::double / n share,
             pow(n_treatment - 0.85e0 * n, 2) / (0.85e0 * n) + pow(n_control - 0.15e0 * n, 2) / (0.15e0 * n) chi2 from ns)""",
    )
    q["validity_balance"] = sql("select * from balance", BALANCE)
    q["validity_balance_summary"] = sql(
        "select max(abs(smd)) max_abs_smd, count(*) filter (balanced) n_balanced, "
        "count(*) filter (welch_p < 0.05) n_welch_below_05, count(*) n_features from balance",
        BALANCE,
    )
    q["validity_smd_ranking"] = sql(RANKED_SMD + "balance", BALANCE)

    q["ab_arm_counts"] = sql(
        "select treatment, count(*) n, sum(visit)::bigint visit, sum(conversion)::bigint conversion from units group by treatment"
    )
    q["ab_lift"] = sql("select * from lift", LIFT)
    q["profile_distinct_verdict"] = sql(
        union(
            "select '{c}' feature, count(distinct {c}) n_distinct, "
            "abs(approx_count_distinct({c}) - count(distinct {c})) <= 0.15e0 * count(distinct {c}) is_near from raw",
            FEATURES,
        )
    )
    q["ingest_rejects"] = sql(
        """select reason, count(*) n from (
             select case when unit_id % 101 = 0 then 'number of fields' when unit_id % 97 = 0 then 'value of f2'
               when unit_id % 103 = 0 then 'value of f5' when unit_id % 89 = 0 then 'value of exposure' end reason from raw)
           where reason is not null group by reason"""
    )
    q["profile_merged_summary"] = sql(
        union(
            "select '{c}' feature, count({c}) n, count(*) - count({c}) n_missing, avg({c}) mean, stddev_samp({c}) stddev, "
            'min({c}) "min", max({c}) "max" from raw',
            FEATURES,
        )
    )
    # the engine's own sketch has a wider error, so its verdict asks for less
    q["profile_merged_distinct"] = q["profile_distinct_verdict"]
    q["segment_merged_edges"] = sql(
        union(
            "select '{c}' feature, any_value(n) n, bool_and(below <= (p + 0.005e0) * n and upto >= (p - 0.005e0) * n) is_near "
            "from (select p, (select count(*) from raw where {c} < edge) below, (select count(*) from raw where {c} <= edge) upto, "
            "(select count({c}) from raw) n from (select unnest([0.2e0, 0.4e0, 0.6e0, 0.8e0]) p, "
            "unnest(quantile_disc({c}, [0.2, 0.4, 0.6, 0.8])) edge from raw))",
            FEATURES,
        )
    )
    q["segment_edges_verdict"] = sql(
        union(
            "select count(*) n, '{c}' feature, bool_and(below <= (p + 0.001e0) * n and upto >= (p - 0.001e0) * n) is_near "
            "from (select p, (select count(*) from units where {c} < edge) below, (select count(*) from units where {c} <= edge) upto, "
            "(select count(*) from units) n from (select unnest([0.2e0, 0.4e0, 0.6e0, 0.8e0]) p, "
            "unnest(quantile_disc({c}, [0.2, 0.4, 0.6, 0.8])) edge from units))",
            FEATURES,
        ).replace("select count(*) n, '", "select any_value(n) n, '")
    )
    # resampled once more, by normal draws from a hash of the replicate
    draws = """draws as (
      select r, sqrt(-2 * ln((hash(r * 4 + 1) % 1000003 + 1) / 1000004e0)) * cos(2 * pi() * (hash(r * 4 + 2) % 1000003) / 1000003e0) z1,
             sqrt(-2 * ln((hash(r * 4 + 3) % 1000003 + 1) / 1000004e0)) * cos(2 * pi() * (hash(r * 4 + 4) % 1000003) / 1000003e0) z2,
             sqrt(-2 * ln((hash(r * 4 + 1) % 1000003 + 1) / 1000004e0)) * sin(2 * pi() * (hash(r * 4 + 2) % 1000003) / 1000003e0) z3,
             sqrt(-2 * ln((hash(r * 4 + 3) % 1000003 + 1) / 1000004e0)) * sin(2 * pi() * (hash(r * 4 + 4) % 1000003) / 1000003e0) z4
      from range(20000) replicates(r))"""
    near = "greatest(abs(boot_{v}_lo - {v}_lo), abs(boot_{v}_hi - {v}_hi)) < 0.1e0 * ({v}_hi - {v}_lo)".format
    ends = "quantile_cont({v}, 0.025) boot_{v}_lo, quantile_cont({v}, 0.975) boot_{v}_hi".format
    q["ab_bootstrap_verdict"] = sql(
        f"""select metric, rel_lift, abs_lo, abs_hi, {near(v='abs')} abs_agree,
          greatest(abs(boot_rel_lo - rel_lo), abs(boot_rel_hi - rel_hi)) < 0.05e0 * abs(rel_lift) + 0.005e0 rel_agree
          from lift join boot using (metric)""",
        LIFT,
        draws,
        """drawn as (
          select metric, rate_treatment + sqrt(rate_treatment * (1 - rate_treatment) / n_t) * z1 rt,
                 rate_control + sqrt(rate_control * (1 - rate_control) / n_c) * z2 rc from lift, draws)""",
        "lifted as (select metric, rt - rc abs, rt / rc - 1 rel from drawn)",
        f"boot as (select metric, {ends(v='abs')}, {ends(v='rel')} from lifted group by metric)",
    )
    replayed = [
        LIFT,
        """arms as (select metric, 't' arm, n_t::double n, x_t::double x from counts union all
             select metric, 'c', n_c, x_c from counts)""",
        """law as (
          select metric, arm, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(x / n) + (n - k) * ln(1 - x / n)) weight
          from (select *, unnest(range(greatest(0, floor(x - 9 * sqrt(x * (1 - x / n)) - 10))::bigint,
            least(n, ceil(x + 9 * sqrt(x * (1 - x / n)) + 10))::bigint + 1)) k from arms where x between 1 and n - 1))""",
        """law_steps as (select metric, arm, k, sum(weight) over w / sum(weight) over (partition by metric, arm) upto
          from law window w as (partition by metric, arm order by k rows unbounded preceding))""",
        """uniforms as (select metric, arm, r, ('0x' || substr(md5(concat_ws(':', 'lift7', metric, arm, r)), 1, 13))::bigint
          / 4503599627370496::double u from arms, range(10000) reps(r))""",
        """drawn_counts as (select u.metric, u.arm, r, s.k from uniforms u asof join law_steps s
          on u.metric = s.metric and u.arm = s.arm and u.u <= s.upto)""",
        """drawn as (select t.metric, t.k / n_t rt, c.k / n_c rc from drawn_counts t join drawn_counts c
          on t.metric = c.metric and t.r = c.r and t.arm = 't' and c.arm = 'c' join counts on counts.metric = t.metric)""",
        f"""boot as (select metric, count(*) n_boot, {ends(v='abs')}, {ends(v='rel')},
          avg(case when abs <= 0 then 1e0 else 0e0 end) share_not_positive
          from (select metric, rt - rc abs, rt / nullif(rc, 0) - 1 rel from drawn) group by metric)""",
    ]
    q["ab_bootstrap"] = sql("select * from boot", *replayed)
    q["ab_interval_agreement"] = sql(
        """select metric, rel_lift, max_gap, agree, bool_and(agree) over () all_agree from (
          select *, max_gap < 0.05e0 * abs(rel_lift) + 0.005e0 agree from (
            select metric, rel_lift, greatest(abs(rel_lo - boot_rel_lo), abs(rel_hi - boot_rel_hi)) max_gap
            from lift join boot using (metric)))""",
        *replayed,
    )
    q["ab_incremental"] = sql("select metric, n_t, abs_lift, abs_lift * n_t incremental from lift", LIFT)
    q["ab_signal_noise"] = sql(
        """select v.rate_control / c.rate_control base_rate_ratio,
          (c.rel_hi - c.rel_lo) / (v.rel_hi - v.rel_lo) ci_width_ratio,
          v.rel_hi - v.rel_lo width_common, c.rel_hi - c.rel_lo width_rare
        from lift v, lift c where v.metric = 'visit' and c.metric = 'conversion'""",
        LIFT,
    )

    q["power_mde_grid"] = sql(
        "select metric, fraction, (n_t + n_c) * fraction n_total, rate_control, rel_lift, mde_abs, "
        "mde_abs / rate_control mde_rel, rel_lift / (mde_abs / rate_control) lift_over_mde, power from detectable",
        GRID,
    )
    q["power_min_traffic"] = sql(
        "select metric, min(case when power >= 0.8e0 then fraction end) min_fraction from detectable group by metric", GRID
    )
    q["power_bucket_sums"] = sql("select * from counts", BUCKET_TESTS)
    q["power_bucket_tests"] = sql("select k, bucket, metric, z, p_value from tested", BUCKET_TESTS)
    q["power_empirical"] = sql(
        "select w.k, 1e0 / w.k fraction, w.metric, n_buckets, empirical_power, power analytic_power "
        "from won w join powered p on w.k = p.k and w.metric = p.metric",
        BUCKET_TESTS,
        "won as (select k, metric, count(*) n_buckets, avg(case when p_value < 0.05 and rate_treatment > rate_control "
        "then 1e0 else 0e0 end) empirical_power from tested group by 1, 2)",
        f"whole as ({COUNTS})",
        "by_k as (select *, x_t::double / n_t rate_treatment, x_c::double / n_c rate_control from whole, ks)",
        power_at("(n_t::double / k)", "(n_c::double / k)", "by_k", "powered"),
    )

    def unit_errors(s: str, x: str) -> str:
        pooled = f"({s} * rate_treatment + (1 - {s}) * rate_control)"
        return (
            f"sqrt({pooled} * (1 - {pooled}) * (1 / {s} + 1 / (1 - {s}))) a_{x}, "
            f"sqrt(rate_treatment * (1 - rate_treatment) / {s} + rate_control * (1 - rate_control) / (1 - {s})) b_{x}"
        )

    def newton(x: str, n: int) -> str:
        right, wrong = (f"(({sign}gap * {x}{n} - {Z95} * a_{x}) / b_{x})" for sign in ("", "-"))
        slope = f"(gap / b_{x} * (exp(-{right} * {right} / 2) - exp(-{wrong} * {wrong} / 2)) / sqrt(2 * pi()))"
        return f"{x}{n} - ({normal_cdf(right)} + {normal_cdf(wrong)} - 0.8e0) / {slope} {x}{n + 1}"

    # from a start 5 % too high, so the solution does not rest on the closed form
    q["power_sample_size"] = sql(
        "select metric, share_t, x6 * x6 n_actual, y6 * y6 n_even, x6 * x6 / (y6 * y6) cost_ratio from step6",
        LIFT,
        "shares as (select *, n_t::double / (n_t + n_c) share_t, abs(rate_treatment - rate_control) gap from rates)",
        f"split_errors as (select *, {unit_errors('share_t', 'x')}, {unit_errors('0.5e0', 'y')} from shares)",
        f"""step0 as (select *, 1.05e0 * ({Z95} * a_x + {Z80} * b_x) / gap x0,
             1.05e0 * ({Z95} * a_y + {Z80} * b_y) / gap y0 from split_errors)""",
        *[f"step{n + 1} as materialized (select *, {newton('x', n)}, {newton('y', n)} from step{n})" for n in range(6)],
    )

    q["compliance_cells"] = sql(
        "select treatment, exposure, visit, conversion, count(*) n from units group by 1, 2, 3, 4"
    )
    q["compliance_counts"] = sql("select * from compliance", COMPLIANCE)
    q["compliance_effects"] = sql(f"select {EFFECT_COLUMNS} from effects", EFFECTS)
    q["compliance_effects_two_sided"] = sql(
        f"select {EFFECT_COLUMNS} from effects",
        f"""crossed as (select * replace (
             case when treatment = 0 and {uniform('cross')} < 0.05e0 then 1 else exposure end as exposure) from units)""",
        EFFECTS.replace("c_exposed from units", "c_exposed from crossed")
        .replace("n_e::double / n_t compliance", "n_e::double / n_t - c_exposed::double / c_n compliance"),
    )
    q["compliance_cace_ci"] = sql(
        f"""select metric, itt, itt - {Z95} * sqrt(var_itt) itt_lo, itt + {Z95} * sqrt(var_itt) itt_hi, cace,
          cace - {Z95} * sqrt(var_cace) cace_lo, cace + {Z95} * sqrt(var_cace) cace_hi from final""",
        EFFECTS,
        """parts as (select *, rate_treatment * (1 - rate_treatment) / n_t + rate_control * (1 - rate_control) / c_n var_itt,
             compliance * (1 - compliance) / n_t var_pi, (t_e1_y1::double / n_t - rate_treatment * compliance) / n_t cov
             from effects)""",
        "final as (select *, (var_itt - 2 * cace * cov + cace * cace * var_pi) / (compliance * compliance) var_cace from parts)",
    )
    q["cace_bootstrap_verdict"] = sql(
        f"""select metric, itt_lo, itt_hi, cace_lo, cace_hi, {near(v='itt')} itt_agree, {near(v='cace')} cace_agree
          from (select metric, itt - {Z95} * sqrt(var_itt) itt_lo, itt + {Z95} * sqrt(var_itt) itt_hi,
            cace - {Z95} * sqrt(var_cace) cace_lo, cace + {Z95} * sqrt(var_cace) cace_hi from final) join boot using (metric)""",
        EFFECTS,
        """parts as (select *, rate_treatment * (1 - rate_treatment) / n_t + rate_control * (1 - rate_control) / c_n var_itt,
             compliance * (1 - compliance) / n_t var_pi, (t_e1_y1::double / n_t - rate_treatment * compliance) / n_t cov
             from effects)""",
        "final as (select *, (var_itt - 2 * cace * cov + cace * cace * var_pi) / (compliance * compliance) var_cace from parts)",
        draws,
        """exposed as (select *, compliance + sqrt(compliance * (1 - compliance) / n_t) * z1 pi_ from effects, draws)""",
        """outcomes as (select metric, pi_,
             pi_ * (rate_exposed + sqrt(rate_exposed * (1 - rate_exposed) / (pi_ * n_t)) * z2)
             + (1 - pi_) * (rate_unexposed + sqrt(rate_unexposed * (1 - rate_unexposed) / ((1 - pi_) * n_t)) * z3) rt,
             rate_control + sqrt(rate_control * (1 - rate_control) / c_n) * z4 rc from exposed)""",
        "effects_drawn as (select metric, rt - rc itt, (rt - rc) / pi_ cace from outcomes)",
        f"boot as (select metric, {ends(v='itt')}, {ends(v='cace')} from effects_drawn group by metric)",
    )
    selection = moments("exposure", "treatment = 1")
    q["compliance_selection_smd"] = sql(
        "select feature, mean1 mean_exposed, mean0 mean_unexposed, smd from pairs", selection
    )
    q["compliance_selection_top"] = sql(f"select * from ({RANKED_SMD} pairs) where place <= 5", selection)
    q["compliance_imbalance_count"] = sql(
        "select count(*) filter (abs(smd) >= 0.1) n_imbalanced, count(*) n_features from pairs", selection
    )
    q["compliance_naive_bias"] = sql(
        """select metric, naive_vs_control, cace, naive_vs_control / cace bias_ratio,
          case when max(abs(naive_vs_control / cace - 1)) over () < 0.1 then 'close'
               when min(naive_vs_control / cace) over () > 1 then 'overstates'
               when max(naive_vs_control / cace) over () < 1 then 'understates' else 'distorts' end verdict from effects""",
        EFFECTS,
    )

    q["segment_edges"] = sql("select feature, edge from cuts", SEGMENTS)
    q["segment_sums"] = sql(
        "select feature_index, feature, bucket, n_t, n_c, visit_t, visit_c, conversion_t, conversion_c from sums", SEGMENTS
    )
    q["segment_lift"] = sql("select * from segments", SEGMENTS)
    q["segment_bh"] = sql("select feature, bucket, metric, p_value, family_size, p_bh from adjusted", ADJUSTED)
    q["segment_tallies"] = sql(
        "select count(*) n_tests, count(*) filter (p_value < 0.05) n_raw, count(*) filter (p_bh < 0.05) n_adjusted from adjusted",
        ADJUSTED,
    )
    q["segment_cochran_q"] = sql("select * from heterogeneity", HETEROGENEITY)
    q["segment_most_heterogeneous"] = sql(
        """select * from (select (row_number() over (order by q desc, feature_index))::int place, feature, metric, q,
          n_buckets, lift_range from heterogeneity where metric = 'visit') where place <= 3""",
        HETEROGENEITY,
    )
    q["segment_heterogeneous_features"] = sql(
        "select metric, count(*) filter (p_bonferroni < 0.05) n_significant, count(*) n_features from heterogeneity group by metric",
        HETEROGENEITY,
    )

    q["uplift_qini_curve"] = sql("select * from curve", curve("f2"))
    q["uplift_qini_curve_tied"] = sql("select * from curve", curve("f1"))
    q["uplift_qini"] = sql(
        """select metric, any_value(total) total_incremental, case when any_value(total) = 0 then 0e0 else
          (sum((q + q0) / 2 * (phi - phi0)) - any_value(total) / 2) / abs(any_value(total)) end qini from steps group by metric""",
        curve("f2"),
    )
    q["uplift_capture"] = sql(
        """select metric, share, (q0 + (q - q0) / (phi - phi0) * (share - phi0)) / nullif(total, 0) capture
        from steps, (select unnest([0.1e0, 0.2e0, 0.3e0, 0.5e0]) share) where phi0 < share and share <= phi""",
        curve("f2"),
    )
    q["uplift_curve_normalized"] = sql(
        "select metric, point, phi, case when total = 0 then q else q / total end q_share from steps", curve("f2")
    )
    q["uplift_deciles"] = sql(
        f"""select metric, decile, predicted predicted_uplift, mt - mc observed_uplift,
          mt - mc - {Z95} * sqrt(vt / nt + vc / nc) ci_lo, mt - mc + {Z95} * sqrt(vt / nt + vc / nc) ci_hi, n from tenths""",
        ranked("f2"),
        """placed_ranks as (select *, greatest(1, (10 * (rank - 1) + n - 2) // (n - 1))::int decile from ranks)""",
        """tenths as (select metric, decile, count(*) n, avg(score) predicted, count(*) filter (t = 1) nt, count(*) filter (t = 0) nc,
             avg(y) filter (t = 1) mt, avg(y) filter (t = 0) mc, var_samp(y) filter (t = 1) vt, var_samp(y) filter (t = 0) vc
             from placed_ranks group by 1, 2)""",
    )
    for name, parts in (("uplift_sample_split", SPLIT), ("uplift_exact_split", EXACT_SPLIT)):
        q[name] = sql(
            "select treatment, is_test, count(*) n, sum(unit_id % 1000003)::bigint id_sum from split group by treatment, is_test", parts
        )
    q["uplift_stump_scores"] = stump_scores()
    q["uplift_capture_ci"] = capture_interval("f2")
    published = {
        "ab": ("lift", {"rate_c": "rate_control", "rate_t": "rate_treatment", "abs": "abs_lift", "rel": "rel_lift", "z": "z", "p": "p_value"}),
        "cace": (
            "effects",
            {
                "compliance": "compliance",
                "itt": "itt",
                "cace": "cace",
                "naive": "naive_vs_control",
                "rate_exposed": "rate_exposed",
                "rate_without_ad": "rate_without_exposure",
                "cace_rel": "cace_rel",
            },
        ),
        "uplift": (
            "(select metric, (sum((q + q0) / 2 * (phi - phi0)) - any_value(total) / 2) / abs(any_value(total)) qini "
            "from steps group by metric)",
            {"qini_coef": "qini"},
        ),
    }
    q["results_publish"] = sql(
        "\nunion all\n".join(
            f"select '{title}' section, metric as key, '{field}' field, printf('%.5e', {value})::double as \"value\" from {table}"
            for title, (table, fields) in published.items()
            for field, value in fields.items()
        ),
        LIFT,
        EFFECTS,
        curve("f2"),
    )
    q["results_paths"] = document_paths(q)
    q["results_significant_digits"] = sql(
        "select feature, bucket, metric, "
        + ", ".join(f"printf('%.5e', {c})::double {c}" for c in ("rate_control", "rate_treatment", "lift", "se", "rel_lift", "p_value"))
        + " from segments",
        SEGMENTS,
    )
    return q


# sections of the document: query or SQL of the rows, whether lists are keyed by metric or feature, then the
# published names of doubles, of whole numbers and of texts; a pair of columns is a list
SECTIONS: dict[str, tuple[str, str | None, dict[str, str | tuple[str, str]], dict[str, str], dict[str, str]]] = {
    "profile_rows": ("profile_rows", None, {}, {"n": "rows_written", "read": "rows_read"}, {}),
    "profile_groups": ("profile_arm_counts", None, {}, {"treatment": "treatment", "n": "n"}, {}),
    "profile_means": ("profile_binary_means", None, {"mean": "mean"}, {}, {"column": '"column"'}),
    "profile_nulls": ("profile_missing", None, {}, {"nulls": "n_null"}, {"column": '"column"'}),
    "profile_nulls_total": ("select sum(n_null) n_null from ({profile_missing})", None, {}, {"nulls": "n_null"}, {}),
    "profile_checks": ("profile_consistency", None, {}, {"violations": "n_violations"}, {"check": '"check"'}),
    "profile_duplicates": ("profile_duplicates", None, {"dup_share": "duplicate_rows / n::double"}, {}, {}),
    "srm": (
        "validity_srm", None, {c: c for c in ("design_share", "observed_share", "ci_lo", "ci_hi", "chi2", "p_value", "alpha")},
        {"n_treatment": "n_treatment", "n_control": "n_control"}, {"srm_detected": "srm_detected"},
    ),
    "balance": ("validity_balance", None, {"smd": "smd", "vr": "variance_ratio", "p": "welch_p"}, {}, {"feature": "feature"}),
    "ab": (
        "ab_lift", "metric",
        {"rate_c": "rate_control", "rate_t": "rate_treatment", "abs": "abs_lift", "abs_ci": ("abs_lo", "abs_hi"),
         "rel": "rel_lift", "rel_ci": ("rel_lo", "rel_hi"), "z": "z", "p": "p_value"}, {}, {},
    ),
    "ab_boot": ("ab_bootstrap", "metric", {"rel_ci_boot": ("boot_rel_lo", "boot_rel_hi")}, {}, {}),
    "power_settings": ("select 0.05e0 alpha, 0.8e0 target", None, {"alpha": "alpha", "target": "target"}, {}, {}),
    "power": ("power_mde_grid", "metric", {"f": "fraction", "n": "n_total", "mde": "mde_rel", "power": "power"}, {}, {}),
    "power_empirical": (
        "power_empirical", "metric", {"f": "fraction", "emp": "empirical_power", "ana": "analytic_power"}, {"k": "k"}, {},
    ),
    "allocation": ("power_sample_size", "metric", {"n_actual": "n_actual", "n_even": "n_even"}, {}, {}),
    "cace": (
        "compliance_effects", "metric",
        {"compliance": "compliance", "itt": "itt", "cace": "cace", "naive": "naive_vs_control", "rate_exposed": "rate_exposed",
         "rate_without_ad": "rate_without_exposure", "cace_rel": "cace_rel"}, {}, {},
    ),
    "cace_itt_ci": ("compliance_cace_ci", "metric", {"itt_ci": ("itt_lo", "itt_hi")}, {}, {}),
    "segments": (
        "select * from ({segment_lift}) join (select feature, bucket, metric, p_bh from ({segment_bh})) using (feature, bucket, metric)",
        "feature", {"rate_c": "rate_control", "rate_t": "rate_treatment", "lift": "lift", "se": "se", "p_bh": "p_bh"},
        {"bucket": "bucket", "n": "n"}, {"metric": "metric", "range": '"range"'},
    ),
    "segment_edges": (
        "select feature, edge, row_number() over (partition by feature order by edge) position from ({segment_edges})",
        "feature", {"edge": "edge"}, {"position": "position"}, {},
    ),
    "heterogeneity": (
        "segment_cochran_q", None, {"Q": "q", "p_bonf": "p_bonferroni", "lift_range": "lift_range"}, {"n_buckets": "n_buckets"},
        {"feature": "feature", "metric": "metric"},
    ),
    "uplift": ("uplift_qini", "metric", {"qini_coef": "qini"}, {}, {}),
    "uplift_capture": ("uplift_capture", "metric", {"share": "share", "capture": "capture"}, {}, {}),
    "uplift_capture_ci": ("uplift_capture_ci", "metric", {"share": "share", "ci": ("boot_capture_lo", "boot_capture_hi")}, {}, {}),
    "uplift_curve": ("uplift_curve_normalized", "metric", {"phi": "phi", "q": "q_share"}, {"point": "point"}, {}),
    "uplift_deciles": (
        "uplift_deciles", "metric", {c: c for c in ("predicted_uplift", "observed_uplift", "ci_lo", "ci_hi")},
        {"decile": "decile", "n": "n"}, {},
    ),
    "sample": ("sample_sizes", None, {}, {"n": "n"}, {"is_test": "is_test"}),
}


def six_digits(x: str) -> str:
    """Six significant digits, ties to even, read back from their decimal text."""
    power = f"(5 - floor(log10(abs({x}))))::int"
    return (
        f"(case when {x} is null or isnan({x}) or isinf({x}) then null when {x} = 0 then 0e0 "
        f"else (round_even({x} * pow(10e0, {power}), 0)::bigint || 'e' || -{power})::double end)"
    )


def document_paths(q: dict[str, str]) -> str:
    """Every value of every section, doubles to six significant digits."""
    known = q | {"sample_sizes": sql(f"select {uniform('split')} < 0.5e0 is_test, count(*) n from units group by 1")}
    parts = []
    for title, (rows, key, doubles, wholes, texts) in SECTIONS.items():
        source = known[rows] if rows in known else rows.format(**known)
        leaves = []
        for field, columns in doubles.items():
            pair = isinstance(columns, tuple)
            for i, column in enumerate(columns if pair else (columns,)):
                shown = f"{field}[{i}]" if pair else field
                leaves.append(f"struct_pack(field := '{shown}', number := {six_digits(column)}, text := null::varchar)")
        leaves += [f"struct_pack(field := '{f}', number := ({c})::double, text := null::varchar)" for f, c in wholes.items()]
        leaves += [f"struct_pack(field := '{f}', number := null::double, text := ({c})::varchar)" for f, c in texts.items()]
        keyed = f"{key}::varchar" if key else "null::varchar"
        parts.append(
            f"""select '{title}' section, key, leaf.field field,
                  case when abs(leaf.number) < 1e-20 then 0e0 else leaf.number end number, leaf.text "text"
                from (select {keyed} as key, unnest([{', '.join(leaves)}]) leaf from ({source}) t)
                where leaf.number is not null or leaf.text is not null"""
        )
    return "\nunion all\n".join(parts)


def capture_interval(score: str, n_boot: int = 200) -> str:
    """Capture of every replicate of units weighted by Poisson(1), drawn from the sums of its probabilities."""
    cumulative = []
    for k in range(12):
        cumulative.append(f"round(4294967296e0 * ({' + '.join(f'exp(-1e0) / {math.factorial(i)}e0' for i in range(k + 1))}))")
    weight = " + ".join(f"(u >= {c})::int" for c in cumulative)
    return sql(
        """select metric, share, count(*) n_boot, quantile_cont(capture, 0.025) boot_capture_lo, quantile_cont(capture, 0.975) boot_capture_hi
           from (select metric, share, (q0 + (q - q0) / (phi - phi0) * (share - phi0)) / total capture
             from stepped, (select unnest([0.1e0, 0.2e0, 0.3e0, 0.5e0]) share) where total > 0 and phi0 < share and share <= phi)
           group by metric, share""",
        ranked(score),
        """hashed as (select metric, ((rank - 1) * 1000) // n slice, t, y, b, md5(concat_ws(':', 'capture6', unit_id, b)) h
             from ranks, range(50) batches(b))""",
        f"""weighted as (select metric, slice, b * 4 + k r, t, y, {weight} w
             from (select *, ('0x' || substr(h, 1 + 8 * k, 8))::bigint u from hashed, range(4) pieces(k)))""",
        f"""slices as (select metric, r, slice, sum(w * t) n_t, sum(w * (1 - t)) n_c, sum(w * y * t) y_t, sum(w * y * (1 - t)) y_c
             from weighted where r < {n_boot} group by 1, 2, 3)""",
        """summed as (select metric, r, slice, sum(n_t) over v n_t, sum(n_c) over v n_c, sum(y_t) over v y_t, sum(y_c) over v y_c,
             sum(n_t + n_c) over (partition by metric, r) n
             from slices window v as (partition by metric, r order by slice rows unbounded preceding))""",
        """curved as (select metric, r, slice, (n_t + n_c) / n::double phi,
             case when n_c > 0 then y_t - y_c * (n_t / n_c::double) else 0e0 end q from summed)""",
        """stepped as (select *, lag(phi, 1, 0e0) over v phi0, lag(q, 1, 0e0) over v q0,
             last_value(q) over (partition by metric, r order by slice rows between unbounded preceding and unbounded following) total
             from curved window v as (partition by metric, r order by slice))""",
    )


def stump_scores() -> str:
    """Boosted stumps of every metric and arm, three rounds of best cut and leaf values, on the test half."""
    halves = f"split as (select *, {uniform('split')} < 0.5e0 is_test from units)"
    grain, ctes, cuts = "16777216e0", [halves], [(f, e) for f, edges in STUMP_EDGES.items() for e in edges]
    ctes.append(f"cuts as (select * from (values {', '.join(f'({i}, {e!r}e0)' for i, (_, e) in enumerate(cuts))}) c(cut, edge))")
    scored = []
    for m in METRICS:
        for arm in (0, 1):
            k = f"{m}_{arm}"
            rows = f"(select *, {m} y from split where treatment = {arm} and not is_test)"
            margin = f"(select ln(avg(y) / (1 - avg(y))) from {rows})"
            ctes.append(f"{k}_0 as materialized (select unit_id, {', '.join(STUMP_EDGES)}, treatment, is_test, {m} y, {margin} margin from split)")
            for r in range(STUMPS.n_trees):
                now, best = f"{k}_{r}", f"{k}_best_{r}"
                train = f"(select *, 1 / (1 + exp(-margin)) p from {now} where treatment = {arm} and not is_test)"
                ctes.append(
                    f"{now}_g as materialized (select *, round_even((p - y) * {grain}, 0) g, round_even(p * (1 - p) * {grain}, 0) h from {train})"
                )
                sides = [
                    f"select {i} cut, {f} <= {e!r}e0 went, sum(g) / {grain} g, sum(h) / {grain} h, count(*) n from {now}_g group by 2"
                    for i, (f, e) in enumerate(cuts)
                ]
                ctes.append(f"{now}_sides as ({' union all '.join(sides)})")
                ctes.append(
                    f"""{best} as materialized (
                      select a.cut, -a.g / a.h * {STUMPS.step} low, -b.g / b.h * {STUMPS.step} high
                      from {now}_sides a join {now}_sides b on a.cut = b.cut and a.went and not b.went
                      where least(a.n, b.n) >= {STUMPS.min_leaf}
                      order by a.g * a.g / a.h + b.g * b.g / b.h desc, a.cut limit 1)"""
                )
                went = "case (select cut from " + best + ") " + " ".join(f"when {i} then {f} <= {e!r}e0" for i, (f, e) in enumerate(cuts)) + " end"
                ctes.append(
                    f"{k}_{r + 1} as materialized (select * replace (margin + case when {went} then (select low from {best}) "
                    f"else (select high from {best}) end as margin) from {now})"
                )
            scored.append(f"(select unit_id, 1 / (1 + exp(-margin)) p_{k} from {k}_{STUMPS.n_trees} where is_test) {k}")
    joined = scored[0] + "".join(f" join {s} using (unit_id)" for s in scored[1:])
    chosen = ", ".join(f"p_{m}_1 - p_{m}_0 uplift_{m}" for m in METRICS)
    return sql(f"select unit_id, {chosen} from {joined}", *ctes)


def oracles() -> dict[str, str]:
    """Query name to SQL text, rounded like the registered query."""
    out = {}
    for name, text in plain().items():
        rules = [f"round({c}, {places}) as {c}" for places, columns in DIGITS[name].items() for c in columns]
        rules = [r.replace("round(min,", 'round("min",').replace("round(max,", 'round("max",') for r in rules]
        out[name] = f"select * replace ({', '.join(rules)}) from ({text})" if rules else text
    return out


assert ROLES.features == tuple(FEATURES)
