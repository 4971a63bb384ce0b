"""The registered queries in SQL, for a second engine. Common table expressions are shared and chained by name."""

from __future__ import annotations

import re

from ..functions.stats import chi2_tail_sql, two_sided_sql, wilson_sql
from ..functions.text import AI_CATEGORIES, AI_TERMS, LEGAL_FORMS, NOISE, PLACEHOLDER, STOP_WORDS, TERM, TITLE_NOISE
from ..sources.adapters import PROVIDERS

text = lambda s: "'" + s.replace("'", "''") + "'"

PANEL = """
runs AS (SELECT CAST(dense_rank() OVER (ORDER BY d) - 1 AS INTEGER) AS run_idx, d AS run_date FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)),
seen AS (SELECT DISTINCT concat_ws('|', CAST(user_id AS VARCHAR), event_type) AS key, run_idx FROM events JOIN runs ON CAST(ts AS DATE) = run_date)"""
SPELLS = (
    PANEL
    + """,
ks AS (SELECT CAST(unnest([1, 3, 7]) AS INTEGER) AS grace),
marked AS (SELECT grace, key, run_idx, sum(CASE WHEN gap IS NULL OR gap - 1 >= grace THEN 1 ELSE 0 END) OVER (PARTITION BY grace, key ORDER BY run_idx) AS spell_no
  FROM (SELECT key, run_idx, run_idx - lag(run_idx) OVER (PARTITION BY key ORDER BY run_idx) AS gap FROM seen), ks),
spells AS (SELECT *, CAST(last_seen_idx - start_idx + 1 AS INTEGER) AS duration, start_idx = 0 AS left_censored, n_runs - 1 - last_seen_idx < grace AS right_censored, NOT (n_runs - 1 - last_seen_idx < grace) AS observed_event
  FROM (SELECT grace, key, CAST(spell_no AS INTEGER) AS spell_no, min(run_idx) AS start_idx, max(run_idx) AS last_seen_idx, CAST(count(*) AS INTEGER) AS sightings FROM marked GROUP BY ALL), (SELECT max(run_idx) + 1 AS n_runs FROM runs))"""
)
CURVE = """,
hist3 AS (SELECT key, min(run_idx) AS lo, max(run_idx) - min(run_idx) AS span FROM seen GROUP BY key HAVING count(*) >= 2 AND max(run_idx) - min(run_idx) >= 3),
curve AS (SELECT age, (SELECT count(*) FROM seen JOIN hist3 USING (key) WHERE run_idx - lo = age) AS detected, (SELECT count(*) FROM hist3 WHERE span >= age) AS trials
  FROM (SELECT CAST(unnest(range(0, (SELECT count(*) FROM runs) + 1)) AS INTEGER) AS age))"""
MARKOV = """,
hist4 AS (SELECT key, min(run_idx) AS lo, max(run_idx) AS hi FROM seen GROUP BY key HAVING count(*) >= 2 AND max(run_idx) - min(run_idx) >= 4),
days AS (SELECT key, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS run_idx FROM hist4),
state AS (SELECT d.key, d.run_idx, CASE WHEN s.key IS NULL THEN 0 ELSE 1 END AS v FROM days d LEFT JOIN seen s ON s.key = d.key AND s.run_idx = d.run_idx),
step AS (SELECT v, lag(v) OVER (PARTITION BY key ORDER BY run_idx) AS u FROM state),
markov0 AS (SELECT count(*) FILTER (u = 1) AS sn, count(*) FILTER (u = 1 AND v = 1) AS ss, count(*) FILTER (u = 0) AS hn, count(*) FILTER (u = 0 AND v = 1) AS hs FROM step),
markov AS (SELECT *, coalesce(ss / nullif(CAST(sn AS DOUBLE), 0), 0) AS p_stay_visible, coalesce(hs / nullif(CAST(hn AS DOUBLE), 0), 0) AS p_become_visible FROM markov0)"""


def km(source: str, by: str, name: str = "km", where: str = "NOT left_censored") -> str:
    """CTEs up to `name` (by, t, at_risk, d, s, g) over spells in `source`."""
    return f""",
{name}0 AS (SELECT {by}, duration AS t, count(*) AS total, count(*) FILTER (observed_event) AS d FROM {source} WHERE {where} GROUP BY {by}, duration),
{name}1 AS (SELECT *, sum(total) OVER (PARTITION BY {by} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM {name}0),
{name} AS (SELECT {by}, t, CAST(n AS BIGINT) AS at_risk, d, product(1 - d / CAST(n AS DOUBLE)) OVER w AS s, sum(CASE WHEN n > d THEN d / CAST(n * (n - d) AS DOUBLE) ELSE 0 END) OVER w AS g
  FROM {name}1 WINDOW w AS (PARTITION BY {by} ORDER BY t ROWS UNBOUNDED PRECEDING))"""


def km_summary(by: str, name: str = "km", horizon: int = 90) -> str:
    return f""",
{name}s0 AS (SELECT *, lag(s, 1, 1.0) OVER (PARTITION BY {by} ORDER BY t) AS s0, lag(t, 1, 0) OVER (PARTITION BY {by} ORDER BY t) AS t0 FROM {name}),
{name}s AS (SELECT {by}, min(t) FILTER (s <= 0.75e0) AS p25, min(t) FILTER (s <= 0.5e0) AS median, min(t) FILTER (s <= 0.25e0) AS p75,
  coalesce(sum(s0 * (t - t0)) FILTER (t <= {horizon}), 0) + coalesce(arg_max(s, t) FILTER (t <= {horizon}), 1) * ({horizon} - coalesce(max(t) FILTER (t <= {horizon}), 0)) AS rmst FROM {name}s0 GROUP BY {by})"""


TYPED = SPELLS + ",\ntyped AS (SELECT *, split_part(key, '|', 2) AS event_type FROM spells WHERE grace = 3)"
LOGRANK = f""",
own AS (SELECT event_type, duration AS t, count(*) AS total, count(*) FILTER (observed_event) AS d FROM typed WHERE NOT left_censored GROUP BY ALL),
times AS (SELECT t, sum(total) OVER (ORDER BY t DESC) AS n, d FROM (SELECT t, sum(total) AS total, sum(d) AS d FROM own GROUP BY t)),
pts AS (SELECT g.event_type, x.t, CAST(x.n AS DOUBLE) AS n, CAST(x.d AS DOUBLE) AS d, CAST((SELECT coalesce(sum(total), 0) FROM own o WHERE o.event_type = g.event_type AND o.t >= x.t) AS DOUBLE) AS n1,
  (SELECT coalesce(sum(o.d), 0) FROM own o WHERE o.event_type = g.event_type AND o.t = x.t) AS d1 FROM (SELECT DISTINCT event_type FROM own) g, times x WHERE x.d > 0 AND x.n >= 2),
lr AS (SELECT event_type, CAST(sum(d1) AS BIGINT) AS observed, sum(d * n1 / n) AS expected, sum(d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)) AS variance FROM pts GROUP BY event_type),
lr2 AS (SELECT *, CASE WHEN variance > 0 THEN pow(observed - expected, 2) / variance ELSE 0 END AS chi2 FROM lr)
SELECT event_type, observed, round(expected, 6) AS expected, round(variance, 6) AS variance, round(chi2, 6) AS chi2, round({chi2_tail_sql("chi2")}, 6) AS p FROM lr2"""

ADVERTS = """
lines AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(p_brand))) AS skills, max(l_shipdate) AS shipped, CAST(count(*) AS INTEGER) AS urls FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
adverts AS (SELECT o_orderkey AS advert, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_orderdate AS DATE) AS run_date, c_name AS company, o_orderpriority AS seniority, c_mktsegment AS sector, o_orderstatus AS remote,
  coalesce(skills, CAST([] AS VARCHAR[])) AS skills, k IS NOT NULL AS described, coalesce(date_diff('day', CAST(o_orderdate AS DATE), CAST(shipped AS DATE)), 0) AS duration, coalesce(urls, 0) AS urls
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lines ON k = o_orderkey)"""


def index(basis: str) -> str:
    total, floor = ("sum(len(skills))", 300) if basis == "mentions" else ("count(*)", 60)
    lo, hi = wilson_sql("count", "total")
    return (
        ADVERTS
        + f""",
mt AS (SELECT month, CAST({total} AS DOUBLE) AS total FROM adverts WHERE described {"AND len(skills) > 0" if basis == "mentions" else ""} GROUP BY month),
months AS (SELECT month, total, CAST(row_number() OVER (ORDER BY month) - 1 AS DOUBLE) AS ord FROM mt WHERE total >= {floor}),
cnt AS (SELECT skill, month, count(*) AS count FROM (SELECT month, unnest(skills) AS skill FROM adverts WHERE described) JOIN months USING (month) GROUP BY ALL),
kept AS (SELECT skill FROM cnt GROUP BY skill HAVING sum(count) >= 40),
sh0 AS (SELECT skill, month, ord, CAST(coalesce(count, 0) AS DOUBLE) AS count, total FROM kept CROSS JOIN months LEFT JOIN cnt USING (skill, month)),
sh AS (SELECT *, count / total AS share, {lo} AS lo, {hi} AS hi FROM sh0),
ca0 AS (SELECT skill, count(*) AS periods, sum(total) AS n, sum(count) AS r, sum(count * ord) AS rt, sum(total * ord) AS nt, sum(total * ord * ord) AS ntt, arg_min(share, ord) AS first_share, arg_max(share, ord) AS last_share, regr_slope(share, ord) AS slope FROM sh GROUP BY skill),
ca1 AS (SELECT *, CASE WHEN periods >= 3 AND n > 0 AND r > 0 AND r < n THEN r / n * (1 - r / n) * (ntt - nt * nt / n) END AS var FROM ca0),
ca2 AS (SELECT *, CASE WHEN var > 0 THEN (rt - r / n * nt) / sqrt(var) ELSE 0 END AS z FROM ca1),
ca3 AS (SELECT *, CASE WHEN var > 0 THEN round({two_sided_sql("z")}, 5) ELSE 1 END AS p, count(*) OVER () AS m FROM ca2),
ca4 AS (SELECT *, row_number() OVER (ORDER BY p, skill) AS rn FROM ca3),
ca AS (SELECT skill, first_share, last_share, (last_share - first_share) * 100 AS change_pp, z, p, CASE WHEN var > 0 THEN slope * 100 ELSE 0 END AS slope_pp, CAST(r AS BIGINT) AS total_mentions, p < 0.05e0 AS significant,
  coalesce(p <= max(CASE WHEN p <= 0.05e0 * rn / m THEN p END) OVER (), false) AS fdr_robust, p < 0.05e0 / m AS bonferroni_robust FROM ca4)"""
    )


def weeks(rows: str) -> str:
    return f""",
wk AS (SELECT strftime(run_date, '%G-W%V') AS week, count(*) AS n FROM {rows} GROUP BY 1),
axis AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS ord FROM wk WHERE week >= coalesce((SELECT min(week) FROM wk WHERE n >= 5), (SELECT min(week) FROM wk)) AND week <= coalesce((SELECT max(week) FROM wk WHERE n >= 5), (SELECT max(week) FROM wk)))"""


def oracle_sql() -> dict[str, str]:
    with_ = lambda ctes, q: f"WITH {ctes}\n{q}"
    r = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
    o: dict[str, str] = {}
    o["panel_sightings"] = with_(PANEL, "SELECT key, run_idx FROM seen")
    o["run_axis"] = with_(PANEL, "SELECT run_idx, CAST(run_date AS VARCHAR) AS run_date FROM runs")
    o["spell_split_k"] = with_(SPELLS, "SELECT grace, key, spell_no, start_idx, last_seen_idx, sightings, duration, left_censored, right_censored, observed_event FROM spells")
    o["panel_meta"] = with_(SPELLS, """SELECT grace, count(*) AS n_spells, count(*) FILTER (left_censored) AS n_left_censored, count(*) FILTER (NOT left_censored) AS n_spells_analysed, count(*) FILTER (right_censored AND NOT left_censored) AS n_right_censored,
  (SELECT count(DISTINCT key) FROM seen) AS n_identities, (SELECT count(*) FROM runs) AS n_runs, CAST((SELECT min(run_date) FROM runs) AS VARCHAR) AS first_run, CAST((SELECT max(run_date) FROM runs) AS VARCHAR) AS last_run FROM spells GROUP BY grace""")
    o["representative_spell"] = with_(SPELLS, "SELECT grace, key, spell_no, start_idx, duration FROM spells QUALIFY row_number() OVER (PARTITION BY grace, key ORDER BY duration DESC, spell_no) = 1")
    o["longest_spells"] = with_(SPELLS, "SELECT key, spell_no, duration, sightings, right_censored FROM spells WHERE grace = 3 ORDER BY duration DESC, key, spell_no LIMIT 25")
    o["detection_curve"] = with_(PANEL + CURVE, "SELECT age, detected, trials, round(coalesce(detected / nullif(CAST(trials AS DOUBLE), 0), 0), 6) AS rate FROM curve")
    o["detection_binned"] = with_(PANEL + CURVE, """SELECT CASE age_from WHEN 0 THEN '0' WHEN 1 THEN '1-6' WHEN 7 THEN '7-13' WHEN 14 THEN '14-29' WHEN 30 THEN '30-59' WHEN 60 THEN '60-89' ELSE '90+' END AS label, CAST(age_from AS INTEGER) AS age_from, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(trials) AS BIGINT) AS trials, round(sum(detected) / CAST(sum(trials) AS DOUBLE), 6) AS rate
FROM (SELECT *, CASE WHEN age < 1 THEN 0 WHEN age < 7 THEN 1 WHEN age < 14 THEN 7 WHEN age < 30 THEN 14 WHEN age < 60 THEN 30 WHEN age < 90 THEN 60 ELSE 90 END AS age_from FROM curve) GROUP BY age_from HAVING sum(trials) > 0""")
    o["detection_overall"] = with_(PANEL + CURVE, "SELECT round(sum(detected) / CAST(sum(trials) AS DOUBLE), 6) AS marginal, round(coalesce(min(detected / CAST(trials AS DOUBLE)) FILTER (trials >= 40 AND detected > 0), sum(detected) / CAST(sum(trials) AS DOUBLE)), 6) AS worst_case FROM curve")
    o["markov_fit"] = with_(PANEL + MARKOV, "SELECT sn, ss, CAST(hn AS BIGINT) AS hn, hs, round(p_stay_visible, 6) AS p_stay_visible, round(p_become_visible, 6) AS p_become_visible, round(p_become_visible / (1 - p_stay_visible + p_become_visible), 6) AS stationary, round(p_stay_visible * (1 - p_become_visible) / ((1 - p_stay_visible) * p_become_visible), 6) AS odds_ratio, CAST(sn + hn AS BIGINT) AS n_transitions FROM markov")
    o["grace_table"] = with_(PANEL + CURVE + MARKOV, "SELECT k AS grace_days, round(pow(1 - (SELECT sum(detected) / CAST(sum(trials) AS DOUBLE) FROM curve), k), 6) AS false_rate_independent, round(pow(1 - p_become_visible, k), 6) AS false_rate_markov FROM markov, (SELECT CAST(unnest([1, 3, 7, 14, 21, 28]) AS INTEGER) AS k)")
    o["km_curve"] = with_(SPELLS + km("spells", "grace"), f"""SELECT grace, t, at_risk, d, round(s, 6) AS s, round(CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(1.96e0 * sqrt(g) / abs(ln(s)))) ELSE s END, 6) AS lower, round(CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(-1.96e0 * sqrt(g) / abs(ln(s)))) ELSE s END, 6) AS upper FROM km""")
    o["km_by_type"] = with_(TYPED + km("typed", "event_type") + km_summary("event_type"), f"SELECT event_type, p25, median, p75, {r('rmst')} FROM kms")
    o["logrank_vs_rest"] = f"WITH {TYPED}{LOGRANK}"
    o["grace_sensitivity"] = with_(SPELLS + MARKOV + km("spells", "grace") + km_summary("grace"), f"SELECT grace, (SELECT count(*) FROM spells s WHERE s.grace = kms.grace AND NOT left_censored) AS n, median, {r('rmst')}, round(pow(1 - p_become_visible, grace), 6) AS false_delisting_markov FROM kms, markov")
    o["observed_moments"] = with_(SPELLS, "SELECT grace, round(avg(CASE WHEN sightings = 1 THEN 1e0 ELSE 0e0 END), 6) AS single_share, quantile_cont(duration, 0.5) AS median_span, round(quantile_cont(duration, 0.9), 6) AS p90_span, count(*) AS n FROM spells WHERE NOT left_censored GROUP BY grace")
    for basis in ("adverts", "mentions"):
        o[f"skill_index_{basis}"] = with_(index(basis), f"SELECT skill, {r('first_share', 'last_share', 'change_pp', 'z')}, p, {r('slope_pp')}, total_mentions, significant, fdr_robust, bonferroni_robust FROM ca")
        o[f"skill_shares_{basis}"] = with_(index(basis), f"SELECT skill, month, CAST(count AS BIGINT) AS count, CAST(total AS BIGINT) AS total, {r('share', 'lo', 'hi')} FROM sh")
    o["month_totals"] = with_(index("adverts"), "SELECT month, CAST(total AS BIGINT) AS total, total >= 60 AS included FROM mt")
    o["rank_movement"] = with_(index("adverts"), """SELECT skill, CAST(rank_first AS INTEGER) AS rank_first, CAST(rank_last AS INTEGER) AS rank_last, CAST(rank_first - rank_last AS INTEGER) AS move, share_first, share_last, significant FROM (
  SELECT *, row_number() OVER (ORDER BY share_first DESC, last_share DESC, skill) AS rank_first, row_number() OVER (ORDER BY share_last DESC, last_share DESC, skill) AS rank_last FROM (SELECT *, round(first_share, 4) AS share_first, round(last_share, 4) AS share_last FROM ca))""")
    o["cooccurrence"] = with_(index("adverts") + """,
top AS (SELECT skill FROM ca ORDER BY last_share DESC, skill LIMIT 14),
ex AS (SELECT DISTINCT advert, skill FROM (SELECT advert, unnest(skills) AS skill FROM adverts WHERE described) SEMI JOIN top USING (skill)),
one AS (SELECT skill, count(*) AS k FROM ex GROUP BY skill),
two AS (SELECT x.skill AS a, y.skill AS b, count(*) AS n2 FROM ex x JOIN ex y ON x.advert = y.advert AND x.skill < y.skill GROUP BY ALL HAVING count(*) >= 8)""",
        "SELECT a, b, n2 AS both, round(n2 / (oa.k * ob.k / CAST((SELECT count(*) FROM adverts WHERE described) AS DOUBLE)), 2) AS lift, round(n2 / CAST(oa.k AS DOUBLE), 6) AS given_a FROM two JOIN one oa ON oa.skill = a JOIN one ob ON ob.skill = b ORDER BY lift DESC, a, b LIMIT 26")
    for f in ("seniority", "remote", "sector"):
        o[f"composition_{f}"] = with_(ADVERTS, f"""SELECT value, month, CAST(total AS BIGINT) AS total, round(coalesce(n, 0) / CAST(total AS DOUBLE), 6) AS share FROM
  (SELECT lower(trim({f})) AS value FROM adverts GROUP BY 1 HAVING count(*) >= 25 AND value NOT IN ('', 'unknown')) CROSS JOIN (SELECT month, count(*) AS total FROM adverts WHERE lower(trim({f})) NOT IN ('', 'unknown') GROUP BY month HAVING count(*) >= 60)
  LEFT JOIN (SELECT lower(trim({f})) AS value, month, count(*) AS n FROM adverts GROUP BY ALL) USING (value, month)""")
    o["top_employers"] = with_(ADVERTS, "SELECT company, count(*) AS vacancies, CAST(list_sort(list(duration))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS INTEGER) AS median_days, round(avg(urls), 6) AS reposts FROM adverts WHERE trim(company) <> '' GROUP BY company HAVING count(*) >= 4 ORDER BY vacancies DESC, company LIMIT 14")
    o["specificity"] = with_(ADVERTS, "SELECT month, round(avg(len(skills)), 6) AS mean_skills, round(avg(CASE WHEN len(skills) = 0 THEN 1e0 ELSE 0e0 END), 6) AS share_naming_none, count(*) AS n FROM adverts WHERE described GROUP BY month HAVING count(*) >= 60")
    o["trend_movers"] = with_(index("adverts"), f"SELECT skill, CASE WHEN slope_pp > 0 THEN 'riser' ELSE 'faller' END AS direction, {r('slope_pp')}, CASE WHEN fdr_robust THEN 'robust' ELSE 'nominal' END AS kind FROM ca WHERE significant AND slope_pp <> 0")
    both = index("mentions") + ",\nment AS MATERIALIZED (SELECT * FROM ca)"
    second = index("adverts").removeprefix(ADVERTS + ",")
    for name in ("ca0", "ca1", "ca2", "ca3", "ca4", "ca", "mt", "months", "cnt", "kept", "sh0", "sh"):
        second = re.sub(rf"\b{name}\b", f"adv_{name}", second)
    o["both_bases"] = with_(both + "," + second, "SELECT skill, round(m.last_share, 6) AS mention_share, round(m.change_pp, 6) AS mention_change, round(a.last_share, 6) AS advert_share, round(a.change_pp, 6) AS advert_change, round((a.first_share - a.last_share) / nullif(a.first_share, 0), 6) AS relative_drop FROM ment m LEFT JOIN adv_ca a USING (skill)")
    o["employer_bars"] = with_(ADVERTS, "SELECT company, vacancies, round(vacancies / CAST(max(vacancies) OVER () AS DOUBLE), 6) AS width FROM (SELECT company, count(*) AS vacancies FROM adverts WHERE trim(company) <> '' GROUP BY company HAVING count(*) >= 4 ORDER BY vacancies DESC, company LIMIT 10)")
    o["middle_rmst"] = with_(TYPED + km("typed", "event_type") + km_summary("event_type"), "SELECT round(list_sort(list(rmst))[CAST(floor(count(*) / 2) AS BIGINT) + 1], 6) AS middle FROM kms")
    o["middle_rmst_descending"] = o["middle_rmst"].replace("list_sort(list(rmst))", "list_reverse_sort(list(rmst))")
    o["sensitivity_at_one"] = o["grace_sensitivity"] + " WHERE grace = 1"
    clustered = SPELLS + ",\ntyped AS (SELECT *, CAST(split_part(key, '|', 1) AS BIGINT) % 4 AS event_type FROM spells WHERE grace = 3)"
    tests = LOGRANK[: LOGRANK.index("\nSELECT")]
    o["survival_by_cluster"] = f"""WITH {clustered}{km("typed", "event_type")}{km_summary("event_type")}{tests},
    sized AS (SELECT event_type, count(*) AS n FROM typed WHERE NOT left_censored GROUP BY ALL HAVING count(*) >= 40),
    tested AS (SELECT event_type, CASE WHEN variance > 0 THEN pow(observed - expected, 2) / variance ELSE 0 END AS chi2 FROM lr)
    SELECT CAST(event_type AS INTEGER) AS cluster, n, median, {r("rmst")}, {r("chi2")}, round({chi2_tail_sql("chi2")}, 6) AS p FROM sized JOIN kms USING (event_type) JOIN tested USING (event_type)"""
    o["unit_vectors"] = """SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total, round(list_sum(list_transform(v, lambda x: (x / n) * (x / n))), 6) AS squares
    FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id + 1)) AS v FROM embeddings))"""
    quantile = ", ".join(f"round(quantile_cont(l_extendedprice * (1 - l_discount), {q}), 6) AS {n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")))
    o["price_quantiles"] = f"SELECT l_returnflag, l_linestatus, {quantile} FROM lineitem GROUP BY l_returnflag, l_linestatus"
    o["stream_replay"] = with_(SPELLS, "SELECT key, grace, start_idx, last_seen_idx, sightings FROM spells")
    o["systematic_sample"] = "SELECT vec_id FROM embeddings QUALIFY (row_number() OVER (ORDER BY vec_id) - 1) % 3 = 0"
    o["series_order"] = f"SELECT value, CAST(row_number() OVER (ORDER BY round(s, 9) DESC, value) AS INTEGER) AS place FROM (SELECT value, sum(share) AS s FROM ({o['composition_sector'].replace('round(coalesce(n, 0) / CAST(total AS DOUBLE), 6)', 'coalesce(n, 0) / CAST(total AS DOUBLE)')}) GROUP BY value)"
    names = ", ".join(map(text, PROVIDERS))
    o["provider_shares"] = with_(ADVERTS + ",\nmt AS (SELECT month, count(*) AS total FROM adverts WHERE described GROUP BY month HAVING count(*) >= 60),\npn AS (SELECT skill AS provider, month, count(*) AS n FROM (SELECT month, unnest(skills) AS skill FROM adverts WHERE described) JOIN mt USING (month) GROUP BY ALL)",
        f"SELECT provider, round(coalesce(max(n / CAST(total AS DOUBLE)) FILTER (month = (SELECT min(month) FROM mt)), 0), 6) AS first_share, round(coalesce(max(n / CAST(total AS DOUBLE)) FILTER (month = (SELECT max(month) FROM mt)), 0), 6) AS last_share, CAST(sum(n) AS BIGINT) AS vacancies FROM pn JOIN mt USING (month) WHERE provider IN ({names}) GROUP BY provider")
    o["provider_order"] = f"SELECT provider, CAST(row_number() OVER (ORDER BY last_share DESC, provider) AS INTEGER) AS place FROM ({o['provider_shares'].replace(', 6) AS last_share', ', 9) AS last_share')})"
    relevant = f"(lower(trim(p_type)) IN ({', '.join(map(text, AI_CATEGORIES))}) OR regexp_matches(p_name, {text(AI_TERMS)}) OR p_size > 10)"
    o["relevance_filter"] = f"SELECT count(*) AS n_in, count(*) FILTER ({relevant}) AS n_kept, count(*) FILTER (NOT {relevant}) AS n_dropped, round(avg(CASE WHEN {relevant} THEN 0e0 ELSE 1e0 END), 6) AS dropped_share FROM part"
    o["dropped_employers"] = f"SELECT p_brand AS company, count(*) AS n FROM part WHERE NOT {relevant} GROUP BY p_brand ORDER BY n DESC, company LIMIT 10"
    o["weekly_series"] = with_(TYPED + weeks("runs") + """,
live AS (SELECT DISTINCT key, spell_no, event_type, strftime(r.run_date, '%G-W%V') AS week FROM typed JOIN runs r ON r.run_idx BETWEEN start_idx AND last_seen_idx),
st AS (SELECT event_type, week, count(*) AS stock FROM live GROUP BY ALL),
inf AS (SELECT event_type, strftime(r.run_date, '%G-W%V') AS week, count(*) AS inflow FROM typed JOIN runs r ON r.run_idx = start_idx GROUP BY ALL),
grid AS (SELECT event_type AS "group", week, coalesce(inflow, 0) AS inflow, coalesce(stock, 0) AS stock FROM (SELECT DISTINCT event_type FROM typed) CROSS JOIN axis LEFT JOIN inf USING (event_type, week) LEFT JOIN st USING (event_type, week))""",
        'SELECT "group", week, inflow, stock, round(inflow / CAST(greatest(sum(inflow) OVER (PARTITION BY week), 1) AS DOUBLE), 6) AS inflow_share FROM grid')
    trends = ADVERTS + weeks("(SELECT DISTINCT run_date FROM adverts)") + """,
wt AS (SELECT strftime(run_date, '%G-W%V') AS week, count(*) AS total FROM adverts GROUP BY 1),
wc AS (SELECT skill, week, count(*) AS n FROM (SELECT strftime(run_date, '%G-W%V') AS week, unnest(skills) AS skill FROM adverts) GROUP BY ALL),
wtop AS (SELECT skill FROM wc GROUP BY skill ORDER BY sum(n) DESC, skill LIMIT 12),
tr AS (SELECT skill, week, ord, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(n / CAST(total AS DOUBLE), 0) AS share FROM wtop CROSS JOIN axis LEFT JOIN wt USING (week) LEFT JOIN wc USING (skill, week))"""
    o["skill_trends"] = with_(trends, "SELECT skill, week, n, total, round(share, 6) AS share FROM tr")
    o["trend_slope"] = with_(trends, "SELECT skill, round(CASE WHEN count(*) >= 3 THEN regr_slope(share, CAST(ord AS DOUBLE)) ELSE 0 END, 9) AS slope FROM tr GROUP BY skill")
    plain = lambda c: f"lower(strip_accents({c}))"
    squeeze = lambda x: f"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    norm = squeeze(f"regexp_replace(replace(regexp_replace({plain('x')}, '[\\(\\[\\{{].*?[\\)\\]\\}}]', ' ', 'g'), '&', ' and '), {text(NOISE)}, ' ', 'g')")
    o["normalise_title"] = f"SELECT doc_id, {norm} AS title FROM (SELECT doc_id, text AS x FROM documents)"
    o["normalise_company"] = f"SELECT c_custkey, {squeeze(f'regexp_replace({plain(chr(120))}, {text(LEGAL_FORMS)}, {text(" ")}, {text("g")})')} AS company FROM (SELECT c_custkey, c_name || ' Müller B.V. Group' AS x FROM customer)"
    o["placeholder_filter"] = f"SELECT doc_id, regexp_matches(text, {text(PLACEHOLDER)}) AS placeholder FROM documents"
    o["vacancy_text"] = "SELECT doc_id, concat_ws(' . ', source || ' ' || lang, source || ' ' || lang, source, nullif(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 2000), '')) AS body FROM documents"
    o["title_counts"] = f"SELECT p_brand AS cluster, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[\\(\\[].*?[\\)\\]]', ' ', 'g'), {text(TITLE_NOISE)}, ' ', 'g'), '[^a-z0-9+#/ -]+', ' ', 'g'), '\\s+', ' ', 'g'), ' -/') AS title, count(*) AS n FROM part GROUP BY ALL HAVING title <> ''"
    stops = ", ".join(map(text, sorted(STOP_WORDS)))
    # characters outside ASCII only matter as edges of words: letters and numbers as a word character, the rest as a blank
    o["ctfidf_scores"] = f"""WITH tok AS (SELECT lang AS cluster, doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(text), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g'), {text(TERM)}) AS t FROM documents),
one AS (SELECT cluster, doc_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS i FROM tok), uni AS (SELECT cluster, term FROM one),
bi AS (SELECT cluster, term FROM (SELECT cluster, term || ' ' || lead(term) OVER (PARTITION BY cluster ORDER BY doc_id, i) AS term FROM one) WHERE term IS NOT NULL),
tf AS (SELECT cluster, term, count(*) AS n FROM (SELECT * FROM uni UNION ALL SELECT * FROM bi) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(n) AS total FROM tf GROUP BY term HAVING count(*) >= 2 QUALIFY row_number() OVER (ORDER BY sum(n) DESC, term) <= 40000),
kept AS (SELECT cluster, term, n, df FROM tf JOIN df USING (term) WHERE NOT list_has_any(string_split(term, ' '), [{stops}])),
sc AS (SELECT cluster, term, n / CAST(sum(n) OVER (PARTITION BY cluster) AS DOUBLE) * ln(1 + (SELECT count(DISTINCT lang) FROM documents) / CAST(df AS DOUBLE)) AS score FROM kept)
SELECT cluster, term, round(score, 9) AS score, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS rk FROM sc)"""
    o["cluster_sizes"] = "SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY label"
    o["identity_meta"] = """WITH x AS (SELECT source AS key, doc_id AS seq, lang AS category, text AS description, 't' || CAST(doc_id % 7 AS VARCHAR) AS title FROM documents),
m AS (SELECT key, category, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, category) AS rk FROM x WHERE category NOT IN ('', 'other') GROUP BY key, category)
SELECT x.key, arg_min(title, seq) AS title, any_value(m.category) AS category, CAST(arg_max(seq, (len(description), -seq)) AS BIGINT) AS chosen, CAST(count(DISTINCT seq % 5) AS INTEGER) AS urls FROM x LEFT JOIN m ON m.key = x.key AND rk = 1 GROUP BY x.key"""
    return o
