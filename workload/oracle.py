"""DuckDB SQL for the registered queries.

``HISTORY`` is a chain of common table expressions that rebuilds the derived tables from
the driver tables by other means than the Spark plans (row-number islands, self-joins,
``QUALIFY``), so that both sides are independent.
"""

from __future__ import annotations

from spellframe.functions.fixed_values import TITLE_TAXONOMY
from workload.orders_as_spells import CFG


def _q(text) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def norm_sql(col: str) -> str:
    e = f"lower(regexp_replace(trim({col}), '\\s+', ' ', 'g'))"
    for pattern, new in TITLE_TAXONOMY["replacements"]:
        e = f"regexp_replace({e}, {_q(pattern)}, {_q(new)}, 'g')"
    return e


def _hit(col, name, rule=None):
    cat = TITLE_TAXONOMY["categories"][name]
    inc = [p for r, p in cat["include"] if rule in (None, r)]
    out = " AND ".join([f"NOT regexp_matches({col}, {_q(p)})" for _, p in cat["exclude"]] or ["true"])
    return "((" + " OR ".join(f"regexp_matches({col}, {_q(p)})" for p in inc) + f") AND {out})"


def category_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {_hit(col, n)} THEN {_q(n)}" for n in TITLE_TAXONOMY["order"]) + " END"


def rule_ids_sql(col: str) -> str:
    parts = [f"CASE WHEN {_hit(col, n, r)} THEN {_q(n + '/' + r)} END"
             for n in TITLE_TAXONOMY["order"] for r, _ in TITLE_TAXONOMY["categories"][n]["include"]]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def qlabel(c: str) -> str:
    return f"CAST({c} // 4 AS VARCHAR) || 'Q' || CAST({c} % 4 + 1 AS VARCHAR)"


C = CFG
HOME = _q(C.home)

def history_steps(horizon: int, windows: dict[str, tuple[int, int]]) -> str:
    """The chain with runs cut at a horizon and the windows given."""
    return f"""WITH
base AS (
  SELECT o_orderkey AS k, o_custkey, o_orderstatus AS st, o_orderpriority AS pri, CAST(o_orderdate AS DATE) AS day,
         (o_custkey + (year(o_orderdate) * 12 + month(o_orderdate) - 1) // 18) % 3
           + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS nat
  FROM orders),
src AS (
  SELECT k, CASE WHEN k % 101 <> 0 THEN 'C' || o_custkey END AS user_id, CAST(k AS VARCHAR) AS position_id,
         CASE WHEN k % 17 <> 0 THEN day END AS startdate,
         CASE WHEN k % 29 = 0 THEN day - 60 WHEN st = 'O' AND k % 5 = 0 THEN NULL
              WHEN st = 'O' THEN day + 180 ELSE day + CAST(90 + k % 400 AS INTEGER) END AS enddate,
         CASE WHEN k % 13 = 0 OR k % 31 = 0 THEN NULL ELSE 'NATION_' || nat END AS country,
         CASE WHEN k % 11 <> 0 THEN 'metro nation_' || nat END AS metro_area,
         CASE WHEN k % 19 <> 0 THEN 'E' || (k % 40) END AS rcid,
         CASE WHEN k % 19 <> 0 THEN 'G' || (k % 40 % 7) END AS ultimate_parent_rcid,
         pri AS role_k1500_v2, CASE WHEN k % 9 <> 0 THEN k % 6 END AS seniority,
         CASE WHEN k % 101 = 0 THEN NULL WHEN k % 97 = 0 THEN 'C-other' ELSE 'C' || o_custkey END AS raw_user,
         CASE WHEN k % 23 = 0 THEN 'Board  Member' WHEN k % 37 = 0 THEN 'Summer Intern'
              WHEN k % 41 = 0 THEN 'Non-Executive Director' WHEN k % 43 = 0 THEN '顧問委員會 member'
              WHEN k % 47 = 0 THEN ' ' WHEN k % 53 = 0 THEN 'Executive Director, board member'
              ELSE p_name END AS raw_title
  FROM base LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey) ON l_orderkey = k LEFT JOIN part ON p_partkey = pk),
people AS (
  SELECT 'C' || c_custkey AS user_id, CASE WHEN c_nationkey % 9 <> 0 THEN 'NATION_' || (c_nationkey % 4) END AS user_country,
         DATE '1999-01-01' + CAST(c_custkey % 960 AS INTEGER) AS updated_dt FROM customer
  UNION ALL
  SELECT 'S' || s_suppkey, CASE WHEN s_nationkey % 9 <> 0 THEN 'NATION_' || (s_nationkey % 4) END,
         DATE '1999-01-01' + CAST(s_suppkey % 720 AS INTEGER) FROM supplier),
titled AS (
  SELECT *, CASE WHEN raw_user IS DISTINCT FROM user_id THEN 'raw_user_mismatch'
                 WHEN trim(coalesce(raw_title, '')) = '' THEN 'blank_title' ELSE 'ok' END AS title_status,
         CASE WHEN raw_user IS NOT DISTINCT FROM user_id THEN nullif(trim(raw_title), '') END AS title_raw,
         year(startdate) * 12 + month(startdate) - 1 AS start_midx, year(enddate) * 12 + month(enddate) - 1 AS end_midx
  FROM src),
normed AS (SELECT *, {norm_sql('title_raw')} AS norm FROM titled),
positions AS MATERIALIZED (
  SELECT * EXCLUDE (norm), {category_sql('norm')} AS cat,
         CASE WHEN norm IS NULL THEN [] ELSE {rule_ids_sql('norm')} END AS role_rule_ids,
         coalesce({category_sql('norm')} IS NOT NULL, false) AS down,
         CASE WHEN user_id IS NULL THEN 'missing_key'
              WHEN user_id NOT IN (SELECT user_id FROM people) THEN 'user_not_in_cohort'
              WHEN startdate IS NULL THEN CASE WHEN enddate IS NULL THEN 'undated' ELSE 'missing_start_date' END
              WHEN startdate < DATE '{C.min_valid_start}' THEN 'start_before_min_valid'
              WHEN start_midx > {C.cutoff_midx} THEN 'start_after_cutoff'
              WHEN end_midx < start_midx THEN 'end_before_start' END AS reason
  FROM normed),
valid AS (SELECT * FROM positions WHERE reason IS NULL),
users AS MATERIALIZED (
  SELECT p.*, year(updated_dt) * 12 + month(updated_dt) - 1 AS refresh_midx,
         (year(updated_dt) * 12 + month(updated_dt) - 1) // 3 AS refresh_qidx,
         coalesce(n.n, 0) AS n_positions, coalesce(n.v, 0) AS n_valid_positions, coalesce(n.h, 0) AS n_valid_home_positions
  FROM people p LEFT JOIN (
    SELECT user_id, count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS v,
           count(*) FILTER (WHERE reason IS NULL AND country = {HOME}) AS h FROM positions GROUP BY user_id) n USING (user_id)),
ruled AS (
  SELECT v.*, rule AS end_rule, u.user_country, u.updated_dt, u.refresh_qidx,
         CASE WHEN end_midx IS NOT NULL THEN least(end_midx, {C.cutoff_midx})
              WHEN rule = 'carry_to_cutoff' THEN {C.cutoff_midx}
              ELSE least({C.cutoff_midx}, refresh_midx) END AS eff
  FROM valid v JOIN users u USING (user_id), (VALUES ('carry_to_cutoff'), ('cap_at_last_refresh')) r(rule)),
active AS (
  SELECT ruled.*, q.qidx FROM ruled JOIN (SELECT unnest(generate_series({C.panel_start_q}, {C.last_q})) AS qidx) q
  ON start_midx <= q.qidx * 3 + 2 AND eff >= q.qidx * 3 + 2),
prim AS (
  SELECT * FROM active QUALIFY row_number() OVER (PARTITION BY user_id, end_rule, qidx
    ORDER BY down, start_midx DESC, position_id) = 1),
naive AS (
  SELECT user_id, end_rule, qidx, position_id AS naive_id, country AS naive_country FROM active
  QUALIFY row_number() OVER (PARTITION BY user_id, end_rule, qidx ORDER BY start_midx DESC, position_id) = 1),
agg AS (
  SELECT user_id, end_rule, qidx, count(*) AS n_active, count(*) FILTER (WHERE down) AS n_active_downranked,
         count(*) FILTER (WHERE country = {HOME}) AS n_active_home, count(*) FILTER (WHERE country IS NULL) AS n_active_missing_country,
         count(DISTINCT country) AS n_active_countries, list(DISTINCT country) FILTER (WHERE country IS NOT NULL) AS cs
  FROM active GROUP BY ALL),
panel AS MATERIALIZED (
  SELECT a.user_id, a.end_rule, a.qidx, 'position' AS obs_type, n_active, n_active_downranked, n_active_home,
         n_active_missing_country, n_active_countries, n_active_countries > 1 AS country_conflict,
         coalesce(array_to_string(list_sort(list_filter(cs, lambda x: x IS DISTINCT FROM p.country)), '|'), '') AS alt,
         n_active_home > 0 AS any_active_home, p.position_id <> naive_id AS downrank_changed_primary,
         p.country IS DISTINCT FROM naive_country AS downrank_changed_country,
         p.position_id AS primary_position_id, p.country AS position_country, p.metro_area AS position_metro_area,
         p.rcid AS primary_rcid, p.ultimate_parent_rcid AS primary_parent_rcid, p.title_raw AS primary_title_raw,
         p.cat AS primary_role_rule, p.down AS primary_downranked, p.enddate IS NULL AS primary_end_missing,
         p.seniority AS primary_seniority, p.user_country AS profile_country, p.updated_dt, p.refresh_qidx,
         coalesce(p.country, p.user_country) AS loc_fb,
         CASE WHEN p.country IS NOT NULL THEN 'position' WHEN p.user_country IS NOT NULL THEN 'profile_fallback' END AS src_fb,
         CASE WHEN p.country IS NULL AND p.user_country IS NOT NULL THEN
              CASE sign(a.qidx - p.refresh_qidx) WHEN 0 THEN 'snapshot' WHEN -1 THEN 'backcast' ELSE 'forwardcast' END END AS timing,
         p.country AS loc_po
  FROM agg a JOIN prim p USING (user_id, end_rule, qidx) JOIN naive USING (user_id, end_rule, qidx)
  UNION ALL
  SELECT user_id, rule, refresh_qidx, 'profile_snapshot', 0, 0, 0, 0, 0, false, '', false, false, false, NULL, NULL, NULL,
         NULL, NULL, NULL, NULL, NULL, NULL, NULL, user_country, updated_dt, refresh_qidx, user_country,
         CASE WHEN user_country IS NOT NULL THEN 'profile_snapshot' END,
         CASE WHEN user_country IS NOT NULL THEN 'snapshot' END, NULL
  FROM users, (VALUES ('carry_to_cutoff'), ('cap_at_last_refresh')) r(rule)
  WHERE n_valid_positions = 0 AND refresh_qidx BETWEEN {C.panel_start_q} AND {C.last_q}),
obs AS MATERIALIZED (
  SELECT user_id, end_rule, 'position_with_profile_fallback' AS spec, qidx, loc_fb = {HOME} AS home, loc_fb AS country,
         src_fb AS source, timing, primary_parent_rcid AS parent, primary_rcid AS employer FROM panel WHERE loc_fb IS NOT NULL
  UNION ALL
  SELECT user_id, end_rule, 'position_only', qidx, loc_po = {HOME}, loc_po, 'position', NULL, primary_parent_rcid, primary_rcid
  FROM panel WHERE loc_po IS NOT NULL),
islands AS (
  SELECT *, qidx - row_number() OVER (PARTITION BY user_id, end_rule, spec ORDER BY qidx) AS bk,
         qidx - row_number() OVER (PARTITION BY user_id, end_rule, spec, home ORDER BY qidx) AS rk FROM obs),
runs0 AS (SELECT user_id, end_rule, spec, bk, home, rk, min(qidx) AS start_q, max(qidx) AS end_q FROM islands GROUP BY ALL),
runs AS MATERIALIZED (
  SELECT user_id, end_rule, spec, home, start_q, end_q,
         dense_rank() OVER (PARTITION BY user_id, end_rule, spec ORDER BY bk) AS block_no,
         row_number() OVER (PARTITION BY user_id, end_rule, spec ORDER BY start_q) AS run_no FROM runs0),
variants AS (SELECT unnest([1, 2, 4]) AS k),
cut AS MATERIALIZED (
  SELECT r.* EXCLUDE (end_q), k, {horizon} AS h, least(end_q, {horizon}) AS end_q, least(end_q, {horizon}) - start_q + 1 AS len
  FROM runs r, variants WHERE start_q <= {horizon}),
blk AS (
  SELECT user_id, end_rule, spec, k, block_no, min(run_no) AS first_run, max(run_no) AS last_run, min(start_q) AS b_start, max(end_q) AS b_end
  FROM cut GROUP BY ALL),
pers AS MATERIALIZED (
  SELECT user_id, end_rule, spec, k, max(block_no) AS last_block, min(start_q) FILTER (WHERE home) AS first_home_q FROM cut GROUP BY ALL),
anch AS MATERIALIZED (
  SELECT c.*, CASE WHEN run_no = first_run OR len >= k THEN home END AS held
  FROM cut c JOIN blk USING (user_id, end_rule, spec, k, block_no)),
befo AS (
  SELECT user_id, end_rule, spec, k, run_no, last_value(held IGNORE NULLS) OVER (PARTITION BY user_id, end_rule, spec, k, block_no
    ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS confirmed_before FROM anch),
bfin AS MATERIALIZED (
  SELECT user_id, end_rule, spec, k, block_no, arg_max(held, run_no) AS block_final FROM anch WHERE held IS NOT NULL GROUP BY ALL),
cls AS MATERIALIZED (
  SELECT c.*, b.first_run, b.last_run, p.last_block, p.first_home_q, f.block_final, e.confirmed_before,
         CASE WHEN c.run_no = b.first_run THEN 'block_start' WHEN c.home = e.confirmed_before THEN 'stay'
              WHEN c.len >= c.k THEN 'confirmed_move' WHEN c.run_no < b.last_run THEN 'excursion'
              WHEN c.block_no < p.last_block THEN 'unconfirmed_before_gap' ELSE 'unconfirmed_terminal' END AS run_class
  FROM cut c JOIN blk b USING (user_id, end_rule, spec, k, block_no) JOIN pers p USING (user_id, end_rule, spec, k)
  JOIN bfin f USING (user_id, end_rule, spec, k, block_no) LEFT JOIN befo e USING (user_id, end_rule, spec, k, run_no)),
ev0 AS MATERIALIZED (
  SELECT user_id, end_rule, spec, k, start_q AS event_q, start_q - 1 AS origin_q, 'confirmed' AS kind, home, len, NULL AS gap_quarters, block_no, run_no
  FROM cls WHERE run_class = 'confirmed_move'
  UNION ALL
  SELECT n.user_id, n.end_rule, n.spec, n.k, n.start_q, b.b_end, 'gap', n.home, NULL, n.start_q - b.b_end - 1, n.block_no, n.run_no
  FROM cls n JOIN bfin f ON f.user_id = n.user_id AND f.end_rule = n.end_rule AND f.spec = n.spec AND f.k = n.k AND f.block_no = n.block_no - 1
  JOIN blk b ON b.user_id = n.user_id AND b.end_rule = n.end_rule AND b.spec = n.spec AND b.k = n.k AND b.block_no = n.block_no - 1
  WHERE n.run_class = 'block_start' AND f.block_final <> n.home),
ev AS (
  SELECT e.*, CASE WHEN home THEN 'entry' ELSE 'exit' END AS direction,
         CASE WHEN kind = 'confirmed' THEN count(*) FILTER (WHERE kind = 'confirmed') OVER (
              PARTITION BY user_id, end_rule, spec, k, block_no ORDER BY run_no) - 1 END AS prior_moves_in_block,
         CASE WHEN home THEN CASE WHEN event_q = p.first_home_q THEN 'first' ELSE 'return' END
              WHEN row_number() OVER (PARTITION BY user_id, end_rule, spec, k, home ORDER BY event_q) > 1 THEN 'return' ELSE 'first' END AS home_spell_type
  FROM ev0 e JOIN pers p USING (user_id, end_rule, spec, k)),
moves AS (
  SELECT e.user_id, e.end_rule, e.spec, e.k AS persistence_quarters, e.event_q, e.origin_q, e.kind, e.direction,
         e.len AS destination_run_quarters, e.gap_quarters, e.block_no, e.prior_moves_in_block, e.home_spell_type,
         o.country AS origin_country, d.country AS destination_country, o.source AS origin_location_source,
         d.source AS destination_location_source, o.timing AS origin_fallback_timing, d.timing AS destination_fallback_timing,
         CASE WHEN o.parent = d.parent THEN 'same' WHEN o.parent <> d.parent THEN 'different' ELSE 'unknown' END AS same_employer,
         CASE WHEN o.employer = d.employer THEN 'same' WHEN o.employer <> d.employer THEN 'different' ELSE 'unknown' END AS same_rcid
  FROM ev e LEFT JOIN obs o ON o.user_id = e.user_id AND o.end_rule = e.end_rule AND o.spec = e.spec AND o.qidx = e.origin_q
  LEFT JOIN obs d ON d.user_id = e.user_id AND d.end_rule = e.end_rule AND d.spec = e.spec AND d.qidx = e.event_q),
win AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {a}, {b})" for n, (a, b) in windows.items())}) w(window_name, a, b)),
specs AS (SELECT unnest(['position_with_profile_fallback', 'position_only']) AS location_spec),
ends0 AS (
  SELECT window_name, a, b, p.end_rule, location_spec, p.user_id, p.qidx,
         CASE WHEN location_spec = 'position_only' THEN loc_po ELSE loc_fb END AS country,
         CASE WHEN location_spec = 'position_only' THEN CASE WHEN loc_po IS NOT NULL THEN 'position' END ELSE src_fb END AS source,
         CASE WHEN location_spec = 'position_only' THEN NULL ELSE timing END AS timing,
         primary_parent_rcid AS parent, primary_rcid AS employer
  FROM panel p JOIN win ON p.qidx BETWEEN a AND b, specs),
ends1 AS (
  SELECT window_name, end_rule, location_spec, user_id,
         max(country) FILTER (WHERE qidx = a) AS start_country, max(country) FILTER (WHERE qidx = b) AS end_country,
         max(source) FILTER (WHERE qidx = a) AS start_source, max(source) FILTER (WHERE qidx = b) AS end_source,
         max(timing) FILTER (WHERE qidx = a) AS start_fallback_timing, max(timing) FILTER (WHERE qidx = b) AS end_fallback_timing,
         max(parent) FILTER (WHERE qidx = a) AS sp, max(parent) FILTER (WHERE qidx = b) AS ep,
         max(employer) FILTER (WHERE qidx = a) AS se, max(employer) FILTER (WHERE qidx = b) AS ee,
         count(*) FILTER (WHERE country = {HOME}) AS home_quarters, count(*) FILTER (WHERE country <> {HOME}) AS non_home_quarters,
         any_value(b - a + 1) - count(country) AS unknown_quarters
  FROM ends0 GROUP BY ALL),
ends AS (
  SELECT *, start_country = {HOME} AS start_home, end_country = {HOME} AS end_home,
         CASE WHEN start_country IS NULL OR end_country IS NULL THEN 'unclassified'
              ELSE list_extract(['outside_home_at_both', 'entered', 'departed', 'stayed'],
                   1 + (end_country = {HOME})::INT + 2 * (start_country = {HOME})::INT) END AS endpoint_class,
         CASE WHEN start_country IS NULL AND end_country IS NULL THEN 'unknown_both_endpoints'
              WHEN start_country IS NULL THEN 'unknown_start' WHEN end_country IS NULL THEN 'unknown_end'
              WHEN start_country = {HOME} AND end_country = {HOME} THEN
                CASE WHEN non_home_quarters > 0 THEN 'round_trip_out' WHEN unknown_quarters > 0 THEN 'home_with_unknown_quarters'
                     ELSE 'continuous_home' END
              WHEN start_country <> {HOME} AND end_country <> {HOME} THEN
                CASE WHEN home_quarters > 0 THEN 'round_trip_in' ELSE 'no_home_quarter' END END AS endpoint_path,
         CASE WHEN sp = ep THEN 'same' WHEN sp <> ep THEN 'different' ELSE 'unknown' END AS same_company,
         CASE WHEN se = ee THEN 'same' WHEN se <> ee THEN 'different' ELSE 'unknown' END AS same_rcid,
         coalesce(start_source LIKE 'profile%', false) OR coalesce(end_source LIKE 'profile%', false) AS uses_profile_location
  FROM ends1)
"""


HISTORY = history_steps(C.last_q, C.window_quarters)


def history(final: str) -> str:
    return HISTORY + final


def history_by_window(final: str, windows: dict[str, tuple[int, int]]) -> str:
    """``final`` for each window with the runs cut at its end, one after the other."""
    return " UNION ALL ".join(f"SELECT * FROM ({history_steps(b, {n: (a, b)})}{final})" for n, (a, b) in windows.items())
