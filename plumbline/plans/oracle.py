"""The queries in SQL for another engine.

Systems are solved here by a Cholesky factorisation, an independent way.
"""

from __future__ import annotations

from ..operators.tuning import candidates
from ..sources.cohort import COHORT_SQL, MOVING, REFERENCE, TABLES, VALUES
from .queries import BUNDLES, FINE, LOO_RIDGES, PERCENTILES, SITES_KNOWN

D = "::DOUBLE"
EPS = f"2.220446049250313e-16{D}"
BETAS = {1: ["intercept", "beta_sex", "beta_handedness", "beta_age1"], 2: ["intercept", "beta_sex", "beta_handedness", "beta_age1", "beta_age2"]}


def obs(metric: str = "price") -> str:
    return COHORT_SQL.format(metric=metric, value=VALUES[metric], **{t: t for t in TABLES})


BASE = [f"obs AS MATERIALIZED ({obs()})", f"ref AS (SELECT * FROM obs WHERE site = '{REFERENCE}')", f"mov AS (SELECT * FROM obs WHERE site = '{MOVING}' AND disease = 'HC')"]


def sql(ctes: list[str], final: str) -> str:
    return "WITH RECURSIVE " + ", ".join([*BASE, *ctes]) + " " + final


def r(x: str, digits: int = 5, name: str = "") -> str:
    return f"round(round(({x}) * 1e{digits + 3}{D}) / 1000.0{D}) / 1e{digits}{D} + 0.0{D} AS {name or x}"


def xs(degree: int) -> list[str]:
    return [f"1.0{D}", f"CASE WHEN sex = 2 THEN 1.0{D} ELSE 0.0{D} END", f"CASE WHEN handedness = 2 THEN 1.0{D} ELSE 0.0{D} END", "age", "age * age"][: 3 + degree]


def design(name: str, source: str, degree: int) -> str:
    return f"{name} AS (SELECT *, {', '.join(f'{x} AS x{k}' for k, x in enumerate(xs(degree)))} FROM {source})"


def gram(name: str, source: str, degree: int, by: str = "bundle") -> str:
    n = 3 + degree
    sums = [f"sum(x{i} * x{j}) AS a{i}_{j}" for i in range(n) for j in range(i, n)] + [f"sum(x{i} * mean) AS b{i}" for i in range(n)]
    return f"{name} AS (SELECT {by}, count(*)::BIGINT AS n, {', '.join(sums)} FROM {source} GROUP BY {by})"


def ridge(name: str, source: str, degree: int, weight: str, prior: str) -> str:
    """Adds the ridge that pulls towards the prior's coefficients."""
    put = []
    for k, b in list(enumerate(BETAS[degree]))[1:]:
        t = f"({weight} * abs(({prior}intercept + {EPS}) / ({prior}{b} + {EPS})))"
        put += [f"a{k}_{k} + {t} AS a{k}_{k}", f"b{k} + {t} * ({prior}{b} + {EPS}) AS b{k}"]
    return f"{name} AS (SELECT * REPLACE ({', '.join(put)}) FROM {source})"


def solve(name: str, source: str, degree: int, prefix: str = "", keep: str = "bundle") -> str:
    """A column after the other, each in a query of its own, so that no expression holds another's text."""
    n, names, q = 3 + degree, [prefix + b for b in BETAS[degree]], source
    steps = []
    for j in range(n):
        steps.append([f"sqrt(a{j}_{j}{''.join(f' - l{j}_{k} * l{j}_{k}' for k in range(j))}) AS l{j}_{j}"])
        steps.append([f"(a{j}_{i}{''.join(f' - l{i}_{k} * l{j}_{k}' for k in range(j))}) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, n)] + [f"(b{j}{''.join(f' - l{j}_{k} * y{k}' for k in range(j))}) / l{j}_{j} AS y{j}"])
    steps += [[f"(y{j}{''.join(f' - l{k}_{j} * {names[k]}' for k in range(j + 1, n))}) / l{j}_{j} AS {names[j]}"] for j in reversed(range(n))]
    for step in steps:
        q = f"(SELECT *, {', '.join(step)} FROM {q})"
    return f"{name} AS MATERIALIZED (SELECT {keep}, {', '.join(names)} FROM {q})"


def line(degree: int, prefix: str = "", begin: int = 0) -> str:
    return "(" + " + ".join(f"{prefix}{b} * x{k}" for k, b in list(enumerate(BETAS[degree]))[begin:]) + ")"


def at(degree: int, prefix: str, age: str) -> str:
    x = ["1", "0.5", "0.5", age, f"{age} * {age}"]
    return "(" + " + ".join(f"{prefix}{b} * {x[k]}" for k, b in enumerate(BETAS[degree])) + ")"


# Pairwise, degree 1
EFFECTS = [
    "both2 AS (SELECT bundle, mean, age, sex, handedness, 'ref' AS side FROM ref UNION ALL SELECT bundle, mean, age, sex, handedness, 'mov' FROM mov)",
    design("pd", "both2", 1), gram("pg", "pd", 1), solve("pb", "pg", 1),
    f"pr AS (SELECT bundle, side, mean - {line(1)} AS res, {', '.join(BETAS[1])} FROM pd JOIN pb USING (bundle))",
    f"pe AS (SELECT bundle, {', '.join(BETAS[1])}, stddev_samp(res) AS sigma, count(*) FILTER (side = 'mov') AS n, avg(res) FILTER (side = 'ref') AS avg_ref, stddev_samp(res) FILTER (side = 'ref') AS std_ref, "
    f"avg(res) FILTER (side = 'mov') / stddev_samp(res) AS gamma_hat, stddev_samp(res) FILTER (side = 'mov') / stddev_samp(res) AS delta_hat FROM pr GROUP BY ALL)",
]
PRIORS = ["hy AS (SELECT gb, t2, (2 * v + m * m) / v AS pa, (m * v + m * m * m) / v AS pbb FROM (SELECT avg(gamma_hat) AS gb, var_samp(gamma_hat) AS t2, avg(delta_hat * delta_hat) AS m, var_samp(delta_hat * delta_hat) AS v FROM pe))"]
BAYES = [*PRIORS,
    f"eb AS (SELECT 0 AS it, bundle, n, gamma_hat AS g0, delta_hat * delta_hat AS d0, gamma_hat AS g, delta_hat * delta_hat AS d, 1e9{D} AS worst FROM pe UNION ALL "
    "SELECT it + 1, bundle, n, g0, d0, g2, d2, max(greatest(abs(g2 - g) / g, abs(d2 - d) / d)) OVER () FROM (SELECT *, (((n - 1) * d0 + n * (g0 - g2) * (g0 - g2)) / 2 + pbb) / (n / 2 + pa - 1) AS d2 FROM "
    f"(SELECT e.it, e.bundle, e.n::DOUBLE AS n, e.g0, e.d0, e.g, e.d, pa, pbb, (t2 * e.n * e.g0 + e.d * gb) / (t2 * e.n + e.d) AS g2 FROM eb e CROSS JOIN hy WHERE e.worst > 1e-4{D} AND e.it < 1000)))",
    "es AS (SELECT bundle, g AS gamma_star, sqrt(d) AS delta_star FROM eb WHERE it = (SELECT max(it) FROM eb))"]
PAIRWISE = [*EFFECTS, *BAYES, f"pm AS (SELECT bundle, {', '.join(BETAS[1])}, sigma, avg_ref AS ref_gamma, std_ref / sigma AS ref_delta, gamma_star * sigma AS mov_gamma, delta_star AS mov_delta FROM pe JOIN es USING (bundle))"]
# Clinical, degree 2
R2, M2 = (", ".join(p + b for b in BETAS[2]) for p in ("ref_", "mov_"))
REF2 = [design("rd", "ref", 2), gram("rg", "rd", 2), solve("rb", "rg", 2, "ref_")]


def tune(source: str) -> list[str]:
    """The objective of every candidate ridge for a moving site, and the ridge chosen; after REF2."""
    return [f"nar AS ({source})", design("nd", "nar", 2), gram("ng", "nd", 2),
        f"nl AS (SELECT * FROM ng JOIN rb USING (bundle) CROSS JOIN (SELECT unnest([{', '.join(repr(x) + D for x in candidates())}]) AS ridge))",
        ridge("nr", "nl", 2, "ridge", "ref_"), solve("nb", "nr", 2, "mov_", f"bundle, ridge, {R2}"),
        "grid AS (SELECT a::DOUBLE AS a, a IN (SELECT floor(age)::BIGINT FROM nar UNION SELECT ceil(age)::BIGINT FROM nar) AS seen FROM (SELECT unnest(range((SELECT floor(min(age))::BIGINT FROM ref), (SELECT ceil(max(age))::BIGINT FROM ref) + 1)) AS a))",
        f"gap AS (SELECT bundle, ridge, seen, {at(2, 'ref_', 'a')} - {at(2, 'mov_', 'a')} AS d FROM nb CROSS JOIN grid)",
        f"obj AS (SELECT bundle, ridge, sign(abs(min(d) FILTER (seen)) / 2 - abs(min(d))) + sign(abs(max(d)) - abs(max(d) FILTER (seen)) * 2) + 2.0{D} AS v FROM gap GROUP BY ALL)",
        f"lam AS MATERIALIZED (SELECT coalesce(min(ridge), 1e10{D}) AS ridge FROM (SELECT ridge FROM obj GROUP BY ridge HAVING sum(v) = 0))"]


def mov2(weight: str) -> list[str]:
    return [design("md", "mov", 2), gram("mg", "md", 2), "mj AS (SELECT * FROM mg JOIN rb USING (bundle))", ridge("mr", "mj", 2, weight, "ref_"), solve("mb", "mr", 2, "mov_")]


TUNE = [*REF2, *tune("SELECT * FROM mov")]
NARROW = [*REF2, *tune("SELECT * FROM mov WHERE age >= 30 AND age < 36")]
CLINICAL = [*TUNE, *mov2("(SELECT ridge FROM lam)"), f"rs AS (SELECT bundle, {R2}, stddev_samp(mean - {line(2, 'ref_')}) AS ref_std FROM rd JOIN rb USING (bundle) GROUP BY ALL)",
    f"mz AS (SELECT bundle, {R2}, ref_std, {M2}, mean - {line(2, 'mov_')} AS res FROM md JOIN mb USING (bundle) JOIN rs USING (bundle))",
    f"cm AS (SELECT bundle, {R2}, ref_std, {M2}, stddev_samp(res) AS mov_std, avg(res / ref_std) AS mov_gamma, (stddev_samp(res / ref_std) * count(*) + 5) / (count(*) + 5) AS mov_delta FROM mz GROUP BY ALL)"]
OBS_COLS = "sid, site, bundle, metric, {mean}, age, sex, handedness, disease"


def rows(value: str, source: str, where: str = "") -> str:
    return f"SELECT {OBS_COLS.format(mean=value)} FROM {source} {where}"


def pair_apply(source: str) -> str:
    return f"SELECT sid, site, bundle, metric, ref_delta / mov_delta * (mean - {line(1)} - mov_gamma) + ref_gamma + {line(1)} AS mean, age, sex, handedness, disease FROM {source} JOIN pm USING (bundle)"


def clinic_apply(source: str) -> str:
    z = f"((mean - {line(2, 'mov_')}) / ref_std)"
    return f"SELECT sid, site, bundle, metric, ref_std / mov_delta * ({z} - mov_gamma) + {line(2, 'ref_')} AS mean, age, sex, handedness, disease FROM {source} JOIN cm USING (bundle)"


def distance(ref: str, mov: str, q: str = "q", name: str = "dist") -> list[str]:
    """Distances of two sides about the reference controls' curve."""
    d = "CASE WHEN n1 > 1 AND n2 > 1 THEN (m1 - m2) * (m1 - m2) / (s1 * s1 + s2 * s2) / 4 + ln((s1 * s1 + s2 * s2) / (2 * s1 * s2)) / 2 ELSE 'nan'::DOUBLE END"
    agg = lambda k, s: f"count(*) FILTER (side = '{s}') AS n{k}, avg(res) FILTER (side = '{s}') AS m{k}, stddev_pop(res) FILTER (side = '{s}') AS s{k}"
    cols = "bundle, mean, age, sex, handedness"
    return [design(f"{q}d", f"(SELECT {cols}, 'ref' AS side FROM {ref} WHERE disease = 'HC' UNION ALL SELECT {cols}, 'mov' FROM {mov} WHERE disease = 'HC')", 2),
            gram(f"{q}g", f"(SELECT * FROM {q}d WHERE side = 'ref')", 2), solve(f"{q}b", f"{q}g", 2),
            f"{q}r AS (SELECT bundle, side, mean - {line(2)} AS res FROM {q}d JOIN {q}b USING (bundle))", f"{q}m AS (SELECT bundle, {agg(1, 'ref')}, {agg(2, 'mov')} FROM {q}r GROUP BY bundle)",
            f"{name} AS (SELECT bundle, {d} AS distance, n2 AS n_hc FROM {q}m)"]


def window(name: str, source: str, width: float, least: int, mode: str) -> list[str]:
    """Rows of each centre's window; how far it is widened is found by trying every step."""
    half = width / 2
    n = lambda e: f"count(*) FILTER (abs(age - centre) <= {half}{D} + {e})"
    out = [f"{name}c AS (SELECT bundle, unnest(range(lo, hi)) AS centre FROM (SELECT bundle, CAST(trunc(min(age)) AS BIGINT) AS lo, CAST(trunc(max(age)) AS BIGINT) AS hi FROM {source} GROUP BY bundle))",
           f"{name}n AS (SELECT bundle, centre, e, {n('e')} AS n FROM {name}c JOIN {source} USING (bundle) CROSS JOIN (SELECT unnest(range(51)) AS e) GROUP BY ALL)"]
    pick = {"static": "0", "not_dynamic": "0", "dynamic": f"CASE WHEN max(n) FILTER (e = 0) > {least} THEN 0 ELSE coalesce(min(e) FILTER (n >= {least}), 50) END"}[mode]
    keep = "" if mode == "static" else f" HAVING max(n) FILTER (e = 0) <> {least}"
    out.append(f"{name}s AS (SELECT bundle, centre, CAST({pick} AS INT) AS widened FROM {name}n GROUP BY bundle, centre{keep})")
    out.append(f"{name} AS (SELECT m.*, CAST(centre AS INT) AS centre, widened FROM {name}s JOIN {source} m USING (bundle) WHERE abs(age - centre) <= {half}{D} + widened)")
    return out


def curve(name: str, source: str) -> str:
    return f"{name} AS (SELECT bundle, centre, count(*) AS n, avg(mean) AS average, stddev_samp(mean) AS deviation FROM {source} GROUP BY bundle, centre)"


COUNTS = "SELECT bundle, centre, widened, count(*) AS n FROM ww GROUP BY ALL"
REF_HC = "refhc AS (SELECT * FROM ref WHERE disease = 'HC')"
SINGLE = [
    REF_HC,
    "own AS (SELECT sid, metric, avg(mean) AS oa, stddev_samp(mean) AS ov FROM mov GROUP BY ALL)",
    "tgt AS (SELECT s.metric, s.age, avg(r.mean) AS ta, stddev_samp(r.mean) AS tv FROM (SELECT DISTINCT metric, age FROM mov) s JOIN refhc r ON r.metric = s.metric AND r.age BETWEEN s.age - 2 AND s.age + 2 GROUP BY ALL)",
    "ss AS (SELECT sid, site, bundle, metric, (mean - oa) * (tv / ov) + ta AS mean, age, sex, handedness, disease, 'single_subject' AS harmonization FROM mov JOIN own USING (sid, metric) LEFT JOIN tgt USING (metric, age))",
]
def leave_one_out(ridges: list[float]) -> list[str]:
    sums = [f"a{i}_{j}" for i in range(4) for j in range(i, 4)] + [f"b{i}" for i in range(4)]
    return [design("ld", "mov", 1), gram("lo", "ld", 1, "bundle, sid"), gram("lt", "ld", 1), design("lrd", "ref", 1), gram("lrg", "lrd", 1), solve("lrb", "lrg", 1, "ref_"),
            f"lf AS (SELECT lo.bundle, lo.sid, ref_intercept, ref_beta_sex, ref_beta_handedness, ref_beta_age1, ridge, {', '.join(f'lt.{c} - lo.{c} AS {c}' for c in sums)} FROM lo JOIN lt ON lo.bundle = lt.bundle JOIN lrb ON lo.bundle = lrb.bundle "
            f"CROSS JOIN (SELECT unnest([{', '.join(repr(x) + D for x in ridges)}]) AS ridge))",
            ridge("lr", "lf", 1, "ridge", "ref_"), solve("lb", "lr", 1, "mov_", "bundle, sid, ridge"),
            f"lm AS (SELECT ridge, avg((mean - {at(1, 'mov_', 'age')}) * (mean - {at(1, 'mov_', 'age')})) AS mse FROM lb JOIN mov USING (bundle, sid) GROUP BY ridge)"]


#: Columns of statistics and what they are of.
SHAPE = [("beta_sex", "x1"), ("beta_handedness", "x2"), ("beta_age1", "x3"), ("y", "mean")]
SITES = ("AMERICA", "ASIA", "EUROPE", MOVING)


def for_site(query: str, site: str, metric: str = "price") -> str:
    """A query about the moving site, asked about another site and metric."""
    return query.replace(obs(), obs(metric)).replace(f"'{MOVING}'", f"'{site}'")


def every_site(query: str, columns: str, metrics: tuple[str, ...] = ("price",)) -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS site, '{m}' AS metric, {columns} FROM ({for_site(query, s, m)})" for s in SITES for m in metrics)


def box(values: str, group: str) -> str:
    return f"SELECT {group}, quantile_cont({values}, 0.25) AS q1, quantile_cont({values}, 0.5) AS median, quantile_cont({values}, 0.75) AS q3, avg({values}) AS average FROM obs GROUP BY {group}"


def plot(y: str) -> str:
    """A line plot's JSON text of each group of points."""
    return "'{\"plot_class\":\"line\",\"data_x\":[' || string_agg(x::VARCHAR, ',' ORDER BY x) || '],\"data_y\":[' || string_agg(" + y + "::VARCHAR, ',' ORDER BY x) || ']}'"


def oracle_sql() -> dict[str, str]:
    mean, exact = r("mean"), r("mean", FINE)
    params = lambda names, t, digits=5: f"SELECT bundle, {', '.join(r(c, digits) for c in names)} FROM {t}"
    rb = [p + b for p in ("ref_",) for b in BETAS[2]]
    mb = ["mov_" + b for b in BETAS[2]]
    clinical = [*rb, "ref_std", *mb, "mov_std", "mov_gamma", "mov_delta"]
    pair = [*BETAS[1], "sigma", "ref_gamma", "ref_delta", "mov_gamma", "mov_delta"]
    sums = [f"a{i}_{j}" for i in range(5) for j in range(i, 5)] + [f"b{i}" for i in range(5)]
    spread = lambda a, v, digits: f"SELECT sid, metric, {r(a, digits, 'average')}, {r(v, digits, 'variability')} FROM obs GROUP BY sid, metric"
    sided = "SELECT bundle, CASE WHEN contains(bundle, '_L') OR contains(bundle, 'left_') THEN 'left' WHEN contains(bundle, '_R') OR contains(bundle, 'right_') THEN 'right' ELSE 'bilateral' END AS side FROM (SELECT DISTINCT bundle || CASE length(bundle) % 3 WHEN 0 THEN '_L' WHEN 1 THEN '_R' ELSE '' END AS bundle FROM obs)"
    made = " ".join(f"WHEN contains(lower(site), '{x}') THEN replace(replace(lower(site), '_{x}', ''), '3t', '3T')" for x in ("philips", "siemens", "ge"))
    label = f"CASE WHEN site IN ({', '.join(repr(x) for x in SITES_KNOWN)}) OR site = '{REFERENCE}' THEN 'ref' {made} ELSE site END"
    known = " ".join(f"WHEN site = '{k}' THEN '{v}'" for k, v in SITES_KNOWN.items())
    age_curve = f"SELECT bundle, CAST(a AS INT) AS age, {{}} FROM cm CROSS JOIN (SELECT unnest(range(20, 90))::DOUBLE AS a)"
    hist = ("SELECT site, CAST(least(19, floor((mean - lo) / ((hi - lo) / 20))) AS INT) AS bin, count(*) AS n FROM obs CROSS JOIN (SELECT min(mean) AS lo, max(mean) AS hi FROM obs) GROUP BY ALL")
    model_rows = " UNION ALL ".join(f"SELECT {k}::INT AS n, '{c}' AS parameter, bundle, {r(c, 5, 'value')} FROM cm" for k, c in enumerate(clinical))
    cohen = ("SELECT metric, count(*) FILTER (site = '{0}') AS n1, avg(x) FILTER (site = '{0}') AS m1, stddev_pop(x) FILTER (site = '{0}') AS s1, count(*) FILTER (site = '{1}') AS n2, avg(x) FILTER (site = '{1}') AS m2, stddev_pop(x) FILTER (site = '{1}') AS s2 "
             "FROM (SELECT metric, site, sid, avg(mean) AS x FROM obs WHERE disease = 'HC' GROUP BY ALL) GROUP BY metric").format(REFERENCE, MOVING)
    out = {
        "scan_cohort": sql([], rows(exact, "obs")),
        "dedupe_keep_first": sql([], rows(exact, f"(SELECT *, row_number() OVER (PARTITION BY sid, site, bundle, metric, age, sex, handedness, disease ORDER BY mean) AS k FROM (SELECT * FROM obs UNION ALL SELECT * REPLACE (mean + 1.0{D} AS mean) FROM obs))", "WHERE k = 1")),
        "filter_predicates": sql([], rows(exact, "obs", f"WHERE site IN ('{REFERENCE}', '{MOVING}') AND disease = 'HC' AND sex = 1 AND age BETWEEN 30 AND 50")),
        "hc_filter_counts": sql([], "SELECT site, bundle, count(*) AS n FROM obs WHERE disease = 'HC' GROUP BY ALL"),
        "ignore_bundles": sql([], "SELECT bundle, count(*) AS n FROM obs WHERE bundle NOT IN ('ECONOMY', 'LARGE') GROUP BY ALL"),
        "limit_age_range": sql(["lim AS (SELECT min(age) AS lo, max(age) AS hi FROM mov WHERE age BETWEEN 30 AND 40)"], "SELECT bundle, age, count(*) AS n FROM ref CROSS JOIN lim WHERE age BETWEEN lo AND hi GROUP BY bundle, age"),
        "bundle_intersection": sql([], "SELECT bundle FROM ref WHERE bundle <> 'ECONOMY' INTERSECT SELECT bundle FROM mov WHERE bundle <> 'LARGE'"),
        "covariate_levels": sql([], " UNION ALL ".join(f"SELECT bundle, '{c}' AS covariate, count(DISTINCT {c}) AS n_levels, count(*) FILTER (coalesce({c} NOT IN (1, 2), true)) AS n_invalid FROM obs WHERE disease = 'HC' GROUP BY bundle" for c in ("sex", "handedness"))),
        "site_metric_checks": sql([], "SELECT count(DISTINCT site) AS n_sites, count(DISTINCT metric) AS n_metrics, count(DISTINCT sid) AS n_subjects FROM obs"),
        "valid_sites": sql([], "SELECT site, count(*) AS n FROM obs WHERE disease = 'HC' AND metric = 'price' AND bundle = 'ECONOMY' GROUP BY site HAVING count(*) >= 10"),
        "design_rows": sql([design("d", "mov", 2)], "SELECT sid, bundle, x0, x1, x2, x3, x4 FROM d"),
        "site_labels": sql(["names AS (SELECT DISTINCT site || unnest(['', '_Philips_3T', '_siemens_3t', '_GE']) AS site FROM (SELECT DISTINCT site FROM obs))"], f"SELECT site, {label} AS label_site, CASE WHEN site = '{REFERENCE}' THEN 'Reference' {known} WHEN lower(site) LIKE '%philips%' THEN 'Philips' WHEN lower(site) LIKE '%siemens%' THEN 'Siemens' WHEN lower(site) LIKE '%ge%' THEN 'GE' ELSE 'unknown' END AS manufacturer FROM names"),
        "site_metadata": sql([], f"SELECT site, CASE WHEN site = '{REFERENCE}' THEN 'Reference' WHEN site IN ('ASIA', 'EUROPE') THEN 'unknown' ELSE 'GE' END AS manufacturer, count(*) AS n FROM obs GROUP BY ALL"),
        "bundle_sides_table": sql([f"sd AS ({sided})", "nth AS (SELECT bundle, side, CAST(row_number() OVER (PARTITION BY side ORDER BY bundle) AS INT) AS nth FROM sd)"],
                                  "SELECT nth, " + ", ".join(f'max(bundle) FILTER (side = \'{x}\') AS "{x}"' for x in ("left", "right", "bilateral")) + " FROM nth GROUP BY nth"),
        "bundle_side": sql([], sided),
        "gram_by_bundle": sql([design("d", "mov", 2), gram("g", "d", 2)], f"SELECT bundle, n, {', '.join(r(c, 3) for c in sums)} FROM g"),
        "ols_fit_by_bundle": sql([design("d", "ref", 2), gram("g", "d", 2), solve("s", "g", 2, keep="bundle, n")], f"SELECT bundle, n, {', '.join(r(c) for c in BETAS[2])} FROM s"),
        "ridge_prior_fit": sql([*REF2, *mov2(f"0.01{D}")], params(mb, "mb")),
        "residual_sigma": sql(REF2, f"SELECT bundle, count(*) AS n_rows, {r('stddev_samp(mean - ' + line(2, 'ref_') + ')', 5, 'sigma')} FROM rd JOIN rb USING (bundle) GROUP BY bundle"),
        "standardize_pairwise": sql([*PAIRWISE, design("sd", "mov", 1)], f"SELECT sid, bundle, {r('(mean - ' + line(1) + ') / sigma', 5, 'z')} FROM sd JOIN pm USING (bundle)"),
        "standardize_clinical": sql(CLINICAL, f"SELECT sid, bundle, {r('(mean - ' + line(2, 'mov_') + ') / ref_std', 5, 'z')} FROM md JOIN cm USING (bundle)"),
        "site_effect_raw": sql(EFFECTS, f"SELECT bundle, n, {r('gamma_hat')}, {r('delta_hat')} FROM pe"),
        "eb_priors": sql([*EFFECTS, *PRIORS], f"SELECT {r('gb', 4, 'gamma_bar')}, {r('t2', 4, 'tau2')}, {r('pa', 4, 'a')}, {r('pbb', 4, 'b')} FROM hy"),
        "eb_estimate": sql([*EFFECTS, *BAYES], f"SELECT bundle, {r('gamma_star')}, {r('delta_star')}, true AS converged FROM es"),
        "variance_shrinkage": sql(EFFECTS, f"SELECT bundle, {r('(delta_hat * n + 5) / (n + 5)', 5, 'delta')} FROM pe"),
        "pairwise_model": sql(PAIRWISE, params(pair, "pm")),
        "clinical_model": sql(CLINICAL, params(clinical, "cm")),
        "pairwise_models_sites": every_site(sql(PAIRWISE, params(pair, "pm")), "bundle, " + ", ".join(pair), ("price", "qty")),
        "clinical_models_sites": every_site(sql(CLINICAL, params(clinical, "cm").replace("SELECT bundle", f"SELECT (SELECT {r('ridge')} FROM lam) AS ridge, bundle")), "bundle, ridge, " + ", ".join(clinical)),
        "apply_sites": " UNION ALL ".join(f"SELECT * FROM ({for_site(sql([*PAIRWISE, design('ad', f'(SELECT * FROM obs WHERE site = {MOVING!r})', 1)], rows(mean, f'({pair_apply("ad")})')), s)})" for s in SITES),
        "statistics_merged": sql([design("sd", "obs", 1)], "SELECT site, metric, bundle, count(*) FILTER (u) AS n, count(*) FILTER (disease = 'HC') AS n_hc, min(age) FILTER (u) AS fit_age_min, max(age) FILTER (u) AS fit_age_max, "
                                 + ", ".join(r(f"avg({x}) FILTER (u)", 4, f"m_{a}") for a, x in SHAPE) + ", " + ", ".join(r(f"covar_pop({x}, {z}) FILTER (u) * count(*) FILTER (u)", 4, f"c_{a}_{b}") for i, (a, x) in enumerate(SHAPE) for b, z in SHAPE[i:])
                                 + f" FROM (SELECT *, site = '{REFERENCE}' OR disease = 'HC' AS u FROM sd) GROUP BY site, metric, bundle"),
        "refit_after_arrivals": "SELECT '" + MOVING + "' AS site, 'price' AS metric, * FROM (" + sql(PAIRWISE, params(pair, "pm")) + ")",
        "predict_curve": sql(CLINICAL, age_curve.format(r(at(2, "ref_", "a"), 5, "value")) .replace(" FROM cm", ", 'ref' AS side FROM cm") + " UNION ALL " + age_curve.format(r(at(2, "mov_", "a"), 5, "value")).replace(" FROM cm", ", 'mov' AS side FROM cm")),
        "tune_objective": sql(TUNE, f"SELECT bundle, {r('ridge')}, {r('v')} FROM obj"),
        "tune_lambda": sql(TUNE, f"SELECT {r('ridge', 6)} FROM lam"),
        "tune_objective_narrow": sql(NARROW, f"SELECT bundle, {r('ridge')}, {r('v')} FROM obj"),
        "tune_lambda_narrow": sql(NARROW, f"SELECT {r('ridge', 6)} FROM lam"),
        "pairwise_limited_ages": sql([
            f"lmov AS (SELECT * FROM mov WHERE age BETWEEN 30 AND 60)", f"lall AS (SELECT age FROM lmov UNION ALL SELECT age FROM obs WHERE site = '{MOVING}' AND disease <> 'HC' AND age BETWEEN 25 AND 70)",
            "lref AS (SELECT * FROM ref WHERE age BETWEEN (SELECT min(age) FROM lall) AND (SELECT max(age) FROM lall))",
            *[x.replace("FROM ref UNION", "FROM lref UNION").replace("FROM mov)", "FROM lmov)") for x in PAIRWISE]], params(pair, "pm")),
        "pairwise_apply": sql([*PAIRWISE, design("ad", f"(SELECT * FROM obs WHERE site = '{MOVING}')", 1)], rows(mean, f"({pair_apply('ad')})")),
        "clinical_apply": sql([*CLINICAL, design("ad", f"(SELECT * FROM obs WHERE site = '{MOVING}')", 2)], rows(mean, f"({clinic_apply('ad')})")),
        "fit_metadata": sql([], f"SELECT 'pairwise' AS name, '{REFERENCE}' AS ref_site, '{MOVING}' AS mov_site, 'price' AS metric_name, min(age) AS min_age, max(age) AS max_age, 1::INT AS degree, 3::INT AS nbr_beta_params, false AS ignore_sex_covariate, "
                            "false AS ignore_handedness_covariate, true AS use_empirical_bayes, false AS limit_age_range FROM mov"),
        "loo_error": sql(leave_one_out([0.0]), f"SELECT {r('ridge', 4)}, {r('mse', 4)} FROM lm"),
        "loo_grid": sql(leave_one_out(LOO_RIDGES), f"SELECT {r('ridge', 4)}, {r('mse', 4)} FROM lm"),
        "loo_best": sql(leave_one_out(LOO_RIDGES), f"SELECT {r('ridge', 4)}, {r('mse', 4)} FROM lm ORDER BY lm.mse, lm.ridge LIMIT 1"),
        "bhattacharyya_raw": sql(distance("ref", "mov"), f"SELECT bundle, {r('distance', 6)}, n_hc FROM dist"),
        "bhattacharyya_harmonized": sql([*CLINICAL, f"har AS ({clinic_apply('md')})", *distance("ref", "har")], f"SELECT bundle, {r('distance', 6)}, n_hc FROM dist"),
        "qc_summary": sql(distance("ref", "mov"), f"SELECT count(*) AS n_bundles, {r('avg(distance)', 6, 'mean')}, {r('min(distance)', 6, 'min')}, {r('max(distance)', 6, 'max')} FROM dist WHERE NOT isnan(distance)"),
        "cohens_d": sql([], "SELECT metric, " + r("CASE WHEN n <= 1 THEN 0 WHEN n > 2 AND n < 50 THEN d * (n - 3) / (n - 2.25::DOUBLE) * sqrt((n - 2) / n) ELSE d END", 6, "cohens_d") + " FROM (SELECT metric, least(n1, n2)::DOUBLE AS n, abs(m1 - m2) / sqrt((s1 * s1 + s2 * s2) / 2) AS d FROM (" + cohen + "))"),
        "window_effect_size": sql([REF_HC, *window("rw", "refhc", 5, 10, "dynamic"), *window("mw", "mov", 5, 10, "dynamic"), curve("rc", "rw"), curve("mc", "mw")],
                                  f"SELECT bundle, centre, {r('rc.average - mc.average', 5, 'mean_error')}, {r('rc.deviation - mc.deviation', 5, 'std_error')}, {r('(rc.average - mc.average) / sqrt((rc.deviation * rc.deviation + mc.deviation * mc.deviation) / 2)', 5, 'effect_size')} FROM rc JOIN mc USING (bundle, centre)"),
        "info_counts": sql([], "SELECT site, disease, sex, handedness, count(*) AS n FROM obs GROUP BY ALL"),
        "info_age_range": sql([], "SELECT site, disease, min(age) AS min_age, max(age) AS max_age FROM obs GROUP BY ALL"),
        "info_categories": sql(["fb AS (SELECT min(bundle) AS b FROM obs)"], " UNION ALL ".join(f"SELECT '{c}' AS category, {c}::VARCHAR AS level, count(*) FILTER (bundle = b) AS n, min(age) FILTER (bundle = b) AS min_age, max(age) FILTER (bundle = b) AS max_age FROM obs CROSS JOIN fb GROUP BY {c}" for c in ("disease", "sex", "handedness"))),
        "normalise_results": sql(["two AS (SELECT * REPLACE (CASE WHEN sid % 5 <> 0 THEN mean END AS mean) FROM obs UNION ALL SELECT * REPLACE (mean + 1.0::DOUBLE AS mean) FROM obs)", "nth AS (SELECT *, row_number() OVER (PARTITION BY sid, site, bundle, metric, age, sex, handedness, disease ORDER BY mean NULLS FIRST) AS k FROM two)"],
                                 f"SELECT {OBS_COLS.format(mean=exact)}, 'raw' AS harmonization, 'raw' AS model FROM nth WHERE k = 1 AND mean IS NOT NULL"),
        "info_global": sql([], "SELECT count(*) AS n_rows, count(DISTINCT sid) AS n_subjects, count(*) FILTER (bundle = (SELECT min(bundle) FROM obs)) AS n_first_bundle, count(DISTINCT bundle) AS n_bundles, count(DISTINCT site) AS n_sites, count(DISTINCT disease) AS n_diseases, min(trunc(age))::BIGINT AS min_age, max(trunc(age))::BIGINT AS max_age, round(avg(trunc(age)), 2) AS mean_age FROM obs"),
        "subject_mean_std": sql([], spread("avg(mean)", "stddev_samp(mean)", 5)),
        "subject_median_mad": sql([], spread("median(mean)", "mad(mean)", FINE)),
        "histogram_common_bins": sql([f"h AS ({hist})"], f"SELECT site, bin, n, {r('100.0::DOUBLE * n / sum(n) OVER (PARTITION BY site)', 4, 'percent')} FROM h"),
        "boxplot_stats": sql([f"q AS ({box('mean', 'site, bundle')})"], f"SELECT site, bundle, {', '.join(r(c, FINE) for c in ('q1', 'median', 'q3', 'average'))}, {r('min(mean) FILTER (mean >= q1 - 1.5::DOUBLE * (q3 - q1) AND mean <= q3 + 1.5::DOUBLE * (q3 - q1))', FINE, 'low')}, "
                             f"{r('max(mean) FILTER (mean >= q1 - 1.5::DOUBLE * (q3 - q1) AND mean <= q3 + 1.5::DOUBLE * (q3 - q1))', FINE, 'high')} FROM obs JOIN q USING (site, bundle) GROUP BY site, bundle, q1, median, q3, q.average"),
        "y_limits": sql([], f"SELECT bundle, {r('min(mean) * 0.95::DOUBLE', FINE, 'low')}, {r('max(mean) * 1.05::DOUBLE', FINE, 'high')}, {r('quantile_cont(mean, 0.01)', FINE, 'p01')}, {r('quantile_cont(mean, 0.99)', FINE, 'p99')} FROM obs GROUP BY bundle"),
        "window_static": sql(window("ww", "mov", 5, 10, "static"), COUNTS),
        "window_dynamic": sql(window("ww", "mov", 2, 12, "dynamic"), COUNTS),
        "window_no_dynamic": sql(window("ww", "mov", 2, 12, "not_dynamic"), COUNTS),
        "window_trimmed": sql([*window("ww", "mov", 4, 12, "dynamic"), "tc AS (SELECT bundle, centre, count(*) AS k, quantile_cont(mean, 0.05) AS p, quantile_cont(mean, 0.95) AS q FROM ww GROUP BY ALL)"],
                              "SELECT bundle, centre, count(*) AS n FROM ww JOIN tc USING (bundle, centre) WHERE k <= 12 OR widened > 0 OR (mean > p AND mean < q) GROUP BY ALL"),
        "window_sampled": sql([*window("ww", "mov", 4, 12, "dynamic"), "tc AS (SELECT bundle, centre, count(*) AS k, quantile_cont(mean, 0.05) AS p, quantile_cont(mean, 0.95) AS q FROM ww GROUP BY ALL)",
                               "tw AS (SELECT bundle, centre, widened, sid, row_number() OVER (PARTITION BY bundle, centre ORDER BY (sid * 2654435761) % 4294967296, sid) AS k9 FROM ww JOIN tc USING (bundle, centre) WHERE k <= 12 OR widened > 0 OR (mean > p AND mean < q))"],
                              "SELECT bundle, centre, sid FROM tw WHERE k9 <= 9 OR widened > 0"),
        "percentile_curve": sql([REF_HC, *window("ww", "refhc", 5, 10, "dynamic")], " UNION ALL ".join(f"SELECT bundle, centre, {p / 100}{D} AS percentile, {r(f'quantile_cont(mean, {p / 100})', FINE, 'value')} FROM ww GROUP BY bundle, centre" for p in PERCENTILES)),
        "mean_sd_curve": sql([REF_HC, *window("ww", "refhc", 5, 10, "dynamic"), curve("c", "ww")], f"SELECT bundle, centre, n, {r('average')}, {r('deviation')} FROM c"),
        "subject_reference_window": sql(SINGLE, f"SELECT metric, age, {r('ta', 5, 'average')}, {r('tv', 5, 'variability')} FROM tgt"),
        "subject_reference_window_median": sql([REF_HC], f"SELECT metric, age, {r('ta', FINE, 'average')}, {r('tv', FINE, 'variability')} FROM (SELECT s.metric, s.age, median(x.mean) AS ta, mad(x.mean) AS tv FROM (SELECT DISTINCT metric, age FROM mov) s JOIN refhc x ON x.metric = s.metric AND x.age BETWEEN s.age - 2 AND s.age + 2 GROUP BY ALL)"),
        "single_subject_output": sql(SINGLE, " UNION ALL ".join([rows(mean, t).replace(" FROM ", f", '{h}' AS harmonization FROM ") for t, h in (("refhc", "raw"), ("mov", "raw"), ("refhc", "single_subject"), ("ss", "single_subject"))])),
        "single_subject_bundle_data": sql(SINGLE, f"SELECT sid, {r('oa', 5, 'average')}, {r('ov', 5, 'variability')} FROM own"),
        "single_subject": sql(SINGLE, f"SELECT sid, site, bundle, metric, {mean}, age, sex, handedness, disease, harmonization FROM ss"),
        "harmonization_distance": sql([*SINGLE, *CLINICAL, f"oth AS (SELECT sid, site, bundle, metric, mean AS mean_ref_harmonized FROM ({clinic_apply('md')}) WHERE bundle <> 'LARGE')",
                                       "cp AS (SELECT ss.*, mean_ref_harmonized, mean - mean_ref_harmonized AS gap FROM ss LEFT JOIN oth USING (sid, site, bundle, metric) WHERE mean_ref_harmonized IS NOT NULL OR bundle NOT IN (SELECT bundle FROM oth))"],
                                      f"SELECT sid, site, bundle, metric, {r('mean', 4)}, age, sex, handedness, disease, harmonization, {r('mean_ref_harmonized', 4)}, {r('gap', 4, 'difference_harmonized')}, {r('abs(CASE WHEN gap < 0 OR gap IS NULL THEN coalesce(gap, 0) ELSE 0 END)', 4, 'err_lower')}, "
                                      f"{r('CASE WHEN gap > 0 THEN gap ELSE 0 END', 4, 'err_upper')}, {r('stddev_samp(gap) OVER (PARTITION BY site, bundle, metric)', 4, 'uncertainty')} FROM cp"),
        "corrupt_data": sql([design("xd", "mov", 1), gram("xg", "xd", 1), solve("xb", "xg", 1)],
                            f"SELECT sid, site || '_corrupted' AS site, bundle, metric, {r(f'(mean - intercept - {line(1, begin=1)}) * 90 / 100 + intercept * 110 / 100 + {line(1, begin=1)} * 75 / 100', 5, 'mean')}, age, sex, handedness, disease FROM xd JOIN xb USING (bundle)"),
        "subsample_sids": sql(["k AS (SELECT site, sid, row_number() OVER (PARTITION BY site ORDER BY (sid * 2654435761) % 4294967296, sid) AS k FROM (SELECT DISTINCT site, sid FROM obs))"], rows(exact, "obs SEMI JOIN (SELECT * FROM k WHERE k <= 20) USING (site, sid)")),
        "harmonized_result": sql([x.replace("FROM mov)", "FROM mov WHERE bundle <> 'LARGE')").replace("FROM ref UNION", "FROM ref WHERE bundle <> 'LARGE' UNION") for x in PAIRWISE] + [design("ad", "mov", 1)],
                                 f"SELECT sid, bundle, metric, {mean}, site, age, sex, handedness, disease, 'pairwise' AS harmonization, 'mov-ref.price' AS model FROM ({pair_apply('ad')})"),
        "model_text": sql(CLINICAL, model_rows),
        "model_round_trip": sql(CLINICAL, params(clinical, "cm")),
        "qc_wide": sql(distance("ref", "mov"), "SELECT (SELECT count(DISTINCT sid) FROM mov) AS \"HC\", " + ", ".join(r(f"max(distance) FILTER (bundle = '{b}')", 6, f'"{b}"') for b in BUNDLES) + " FROM dist"),
        "plot_json": sql([*window("mw", "mov", 5, 10, "dynamic"), curve("mc", "mw"), f"pt AS (SELECT bundle, centre AS x, {r('average', 4, 'y')} FROM mc)"],
                         "SELECT bundle, 'price' AS metric, '{\"plot_class\":\"line\",\"data_x\":[' || string_agg(x::VARCHAR, ',' ORDER BY x) || '],\"data_y\":[' || string_agg(y::VARCHAR, ',' ORDER BY x) || ']}' AS plot FROM pt GROUP BY bundle"),
        "plot_merge": sql([*window("mw", "mov", 5, 10, "dynamic"), curve("mc", "mw"), f"pt AS (SELECT bundle, centre AS x, n, {r('deviation', 4)} FROM mc)"],
                          "SELECT bundle, 'price' AS metric, '{\"count\":' || " + plot("n") + " || ',\"windows\":{\"average\":' || " + plot("deviation") + " || ',\"n\":' || " + plot("n") + " || '}}' AS document FROM pt GROUP BY bundle"),
        "curve_layers": sql([*SINGLE, *CLINICAL, f"oth AS (SELECT sid, site, bundle, metric, mean AS other FROM ({clinic_apply('md')}))", *window("rw", "refhc", 5, 10, "dynamic"), *window("sw", "ss", 5, 10, "dynamic"), curve("rc", "rw"), curve("sc", "sw")],
                            " UNION ALL ".join([
                                *[f"SELECT bundle, 'single_subject' AS harmonization, 'single_subject' AS model, '{c}' AS layer, 0.5{D} AS percentile, NULL::VARCHAR AS sid, centre::DOUBLE AS x, {r('quantile_cont(mean, 0.5)', 4, 'y')}, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM {t} GROUP BY bundle, centre" for t, c in (("rw", "reference"), ("sw", "moving_harmonized"))],
                                *[f"SELECT bundle, 'single_subject', 'single_subject', '{c}_band', NULL, NULL, centre, {r('average', 4)}, {r('average - deviation', 4, 'low')}, {r('average + deviation', 4, 'high')} FROM {t}" for t, c in (("rc", "reference"), ("sc", "moving"))],
                                f"SELECT bundle, 'single_subject', 'single_subject', 'subject', NULL, sid::VARCHAR, age, {r('mean', 4)}, {r('mean - abs(least(mean - other, 0))', 4, 'low')}, {r('mean + greatest(mean - other, 0)', 4, 'high')} FROM ss JOIN oth USING (sid, site, bundle, metric)",
                                f"SELECT bundle, 'single_subject', 'single_subject', 'limits', NULL, NULL, NULL, NULL, {r('quantile_cont(mean, 0.01) - min(mean) * 0.05::DOUBLE', 4, 'low')}, {r('quantile_cont(mean, 0.99) + max(mean) * 0.05::DOUBLE', 4, 'high')} FROM ref GROUP BY bundle"])),
        "kernel_density": sql([
            "sh AS (SELECT bundle, min(age) AS a0, max(age) AS a1, min(mean) AS v0, max(mean) AS v1, count(*) AS total, var_samp(age) * pow(count(*), -1.0::DOUBLE / 3) AS aa, covar_samp(age, mean) * pow(count(*), -1.0::DOUBLE / 3) AS av, var_samp(mean) * pow(count(*), -1.0::DOUBLE / 3) AS vv FROM ref GROUP BY bundle)",
            "fl AS (SELECT bundle, least(99, floor((age - a0) * 100 / (a1 - a0)))::INT AS i, least(99, floor((mean - v0) * 100 / (v1 - v0)))::INT AS j, count(*) AS n FROM ref JOIN sh USING (bundle) GROUP BY ALL)",
            "gr AS (SELECT gi, gj FROM (SELECT unnest(range(20)) AS gi) CROSS JOIN (SELECT unnest(range(20)) AS gj))",
            "kx AS (SELECT bundle, n, total, aa, av, vv, aa * vv - av * av AS det, a0 + (gi + 0.5::DOUBLE) * (a1 - a0) / 20 AS age, v0 + (gj + 0.5::DOUBLE) * (v1 - v0) / 20 AS value, a0 + (i + 0.5::DOUBLE) * (a1 - a0) / 100 AS ai, v0 + (j + 0.5::DOUBLE) * (v1 - v0) / 100 AS vj, gi, gj FROM fl JOIN sh USING (bundle) CROSS JOIN gr)",
            "kd AS (SELECT bundle, age, value, gi, gj, sum(n * exp(-(vv * (age - ai) * (age - ai) - 2 * av * (age - ai) * (value - vj) + aa * (value - vj) * (value - vj)) / (2 * det))) / (any_value(total) * 2 * pi() * sqrt(any_value(det))) AS density FROM kx GROUP BY bundle, age, value, gi, gj)"],
            f"SELECT bundle, {r('age', 8)}, {r('value', 8)}, {r('density', 8)} FROM kd"),
        "fit_apply_check": sql([*CLINICAL, f"har AS ({clinic_apply('md')})", *distance("ref", "mov"), *distance("ref", "har", "h", "hdist")],
                               f"SELECT 'raw' AS stage, bundle, {r('distance', 6)}, n_hc FROM dist UNION ALL SELECT 'harmonized', bundle, {r('distance', 6)}, n_hc FROM hdist"),
        "data_view": sql(["lm AS (SELECT bundle, min(mean) - min(mean) * 0.05::DOUBLE AS low, max(mean) + max(mean) * 0.05::DOUBLE AS high FROM obs WHERE disease = 'HC' GROUP BY bundle)"],
                         f"SELECT bundle, site AS dataset, disease, sid, age, {exact}, {r('low', FINE)}, {r('high', FINE)} FROM obs JOIN lm USING (bundle)"),
        "model_view": sql([*CLINICAL, f"vb AS (SELECT bundle, site, age, mean, disease FROM obs WHERE site IN ('{REFERENCE}', '{MOVING}'))",
                           "vg AS (SELECT bundle, lo + unnest(range(CAST(ceil(hi - lo) AS BIGINT))) AS a FROM (SELECT bundle, min(age) AS lo, max(age) AS hi FROM vb WHERE disease = 'HC' GROUP BY bundle))"],
                          f"SELECT bundle, 'reference_line' AS layer, '{REFERENCE}' AS site, a AS age, {r(at(2, 'ref_', 'a'), 5, 'value')} FROM vg JOIN cm USING (bundle) UNION ALL SELECT bundle, 'moving_line', '{MOVING}', a, {r(at(2, 'mov_', 'a'), 5, 'value')} FROM vg JOIN cm USING (bundle) "
                          f"UNION ALL SELECT bundle, CASE WHEN disease = 'HC' THEN 'control' ELSE 'patient' END, site, age, {r('mean', 5, 'value')} FROM vb"),
        "curve_view": sql([REF_HC, *PAIRWISE, design("ad", "mov", 1), f"har AS ({pair_apply('ad')})", *window("rw", "refhc", 5, 10, "dynamic"), *window("mw", "mov", 5, 10, "dynamic"), *window("hw", "har", 5, 10, "dynamic")],
                          " UNION ALL ".join(f"SELECT bundle, '{h}' AS harmonization, '{h}' AS model, '{c}' AS curve, centre, {p / 100}{D} AS percentile, {r(f'quantile_cont(mean, {p / 100})', 5, 'value')} FROM {t} GROUP BY bundle, centre"
                                             for t, h, c in (("rw", "raw", "reference"), ("rw", "pairwise", "reference"), ("mw", "raw", "moving_raw"), ("hw", "pairwise", "moving_harmonized")) for p in PERCENTILES)),
        "union_sites": f"WITH a AS ({obs()}), b AS ({obs('qty')}) SELECT metric, site, NULL::VARCHAR AS scanner, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT metric, site, 's1', count(*) FROM b GROUP BY ALL",
    }
    return out
