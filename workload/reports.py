"""Registered queries: quality, joins, coverage, diagnostics, trends, linkage."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from spellframe.functions import blank_to_null, period_overlap
from spellframe.operators import coverage as C
from spellframe.operators import diagnostics as D
from spellframe.operators import joins as J
from spellframe.operators import linkage as L
from spellframe.operators import quality as Q
from spellframe.operators import spells as S
from spellframe.operators import trends as T
from spellframe.plans import coverage_report as R
from spellframe.plans import education as ED
from spellframe.plans import inventory as I
from spellframe.session import shared_folder, stage, tasks_for
from spellframe.sources import catalog as CAT
from spellframe.sources import export as X
from spellframe.sources import manifests as M
from spellframe.sources.tables import extract_query, nest_record, read_partition, write_csv, write_json_records, write_table
from workload import history as H
from workload import orders_as_spells as W
from workload.oracle import HISTORY, history, qlabel

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CFG = W.CFG
LINE_KEY = ["l_orderkey", "l_linenumber"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f
    return register


def line_columns(df):
    return [c for c in df.columns if c not in LINE_KEY]


def text_dates(df):
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("string").alias(c) if kinds[c] in ("date", "timestamp", "timestamp_ntz") else F.col(c) for c in df.columns])


# --- quality -----------------------------------------------------------------------------
PER_KEY = """WITH v AS (SELECT *, count(*) AS n FROM lineitem GROUP BY ALL),
k AS (SELECT l_orderkey, l_linenumber, count(*) AS nv, sum(n) AS n FROM v GROUP BY ALL)
"""
LINE_REST = ("l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, "
             "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate")


@query(PER_KEY + """SELECT CAST(sum(n) AS BIGINT) AS rows_in, count(*) AS distinct_keys,
CAST(coalesce(sum(n - 1) FILTER (WHERE nv = 1), 0) AS BIGINT) AS exact_duplicate_rows_collapsed, count(*) FILTER (WHERE nv > 1) AS conflicting_keys,
CAST(coalesce(sum(n) FILTER (WHERE nv > 1), 0) AS BIGINT) AS rows_in_conflicting_keys, 0 AS null_key_rows, count(*) FILTER (WHERE nv = 1) AS rows_kept FROM k""")
def dedupe_counts(spark, sf):
    line = W.table(spark, sf, "lineitem")
    return Q.dedupe_quarantine(line, LINE_KEY, line_columns(line)).counts


@query(PER_KEY + f"SELECT DISTINCT l_orderkey, l_linenumber, {LINE_REST} FROM lineitem JOIN k USING (l_orderkey, l_linenumber) WHERE nv = 1")
def dedupe_kept(spark, sf):
    line = W.table(spark, sf, "lineitem")
    return text_dates(Q.dedupe_quarantine(line, LINE_KEY, line_columns(line)).kept)


@query(PER_KEY + f"SELECT l_orderkey, l_linenumber, {LINE_REST}, 'conflicting_duplicate_key' AS quarantine_reason "
       "FROM lineitem JOIN k USING (l_orderkey, l_linenumber) WHERE nv > 1")
def dedupe_quarantined(spark, sf):
    line = W.table(spark, sf, "lineitem")
    return text_dates(Q.dedupe_quarantine(line, LINE_KEY, line_columns(line)).quarantine)


@query(PER_KEY + """SELECT 0 AS null_key_rows, count(*) AS duplicate_key_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_duplicate_keys,
count(*) FILTER (WHERE nv > 1) AS conflicting_keys, CAST(coalesce(sum(n) FILTER (WHERE nv > 1), 0) AS BIGINT) AS rows_in_conflicting_keys,
CAST(coalesce(sum(n - nv), 0) AS BIGINT) AS exact_duplicate_rows FROM k WHERE n > 1""")
def key_checks(spark, sf):
    return Q.key_checks(W.table(spark, sf, "lineitem"), LINE_KEY)


@query("""SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, n_chars, text FROM documents)) AS exact_duplicate_rows,
(SELECT count(*) FROM (SELECT DISTINCT lang, source, n_chars, text FROM documents)) AS distinct_rows FROM documents""")
def whole_row_copies(spark, sf):
    return Q.key_checks(W.table(spark, sf, "documents").select("lang", "source", "n_chars", "text"), None)


def _profile_sql() -> str:
    parts = []
    cols = [("o_orderkey", "bigint", 1, 1), ("o_custkey", "bigint", 1, 1), ("o_orderstatus", "string", 0, 1),
            ("o_totalprice", "double", 2, 0), ("o_orderdate", "date", 1, 0), ("o_orderpriority", "string", 0, 1)]
    for i, (c, kind, ordered, distinct) in enumerate(cols):
        lo = {0: "NULL", 1: f"CAST(min({c}) AS VARCHAR)", 2: f"CAST(min({c}) AS VARCHAR)"}[ordered]
        hi = lo.replace("min(", "max(")
        parts.append(f"""SELECT '{c}' AS "column", '{kind}' AS type, {i + 1} AS position, count(*) AS rows, count({c}) AS non_null,
count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*), 6) AS null_share,
{f"count(*) FILTER (WHERE trim({c}) = '')" if kind == 'string' else 'NULL'} AS blank_strings,
{f'count(DISTINCT {c})' if distinct else 'NULL'} AS distinct_values, {lo} AS min_value, {hi} AS max_value FROM o""")
    return ("WITH o AS (SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders) " + " UNION ALL ".join(parts))


@query(_profile_sql())
def column_profile(spark, sf):
    orders = W.table(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return Q.profile_columns(orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query(history("""SELECT unnest(['user_id', 'startdate', 'enddate', 'country', 'rcid', 'seniority']) AS "column",
unnest([count(*) - count(user_id), count(*) - count(startdate), count(*) - count(enddate), count(*) - count(country), count(*) - count(rcid),
 count(*) - count(seniority)]) AS missing FROM src"""))
def null_counts(spark, sf):
    p = W.positions(spark, sf).withColumn("country", blank_to_null("country"))
    return Q.null_counts(p.select("user_id", "startdate", "enddate", "country", "rcid", "seniority"))


@query("""SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS distinct_ids, count(*) FILTER (WHERE l_orderkey IS NULL) AS missing_id,
count(*) FILTER (WHERE l_shipdate IS NULL) AS missing_date, count(*) FILTER (WHERE l_linestatus IS DISTINCT FROM 'O') AS foreign_rows,
count(*) FILTER (WHERE l_returnflag IS NULL) AS missing_flag, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS first_date,
CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_date FROM lineitem""")
def extract_checks(spark, sf):
    line = W.table(spark, sf, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    return text_dates(Q.extract_checks(line, "l_orderkey", "d", "l_returnflag", "l_linestatus", "O"))


@query("""WITH d AS (SELECT CASE WHEN doc_id % 11 = 0 THEN ' ' || doc_id WHEN doc_id % 7 = 0 THEN '' ELSE CAST(doc_id // 2 AS VARCHAR) END AS id,
 CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE text END AS text FROM documents)
SELECT id, 'invalid_id' AS violation FROM d WHERE trim(id) = '' OR id <> trim(id)
UNION ALL SELECT id, 'empty_text' FROM d WHERE trim(text) = ''
UNION ALL SELECT id, 'duplicate_id' FROM d GROUP BY id HAVING count(*) > 1""")
def record_violations(spark, sf):
    k = F.col("doc_id")
    d = W.table(spark, sf, "documents").select(
        F.when(k % 11 == 0, F.concat(F.lit(" "), k.cast("string"))).when(k % 7 == 0, "")
         .otherwise(F.floor(k / 2).cast("string")).alias("id"),
        F.when(k % 5 == 0, "  ").otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("t1"), F.lit("").alias("t2"))
    return Q.checked_records(d, "id", "text", ["t1", "t2"])[1]


# --- joins -------------------------------------------------------------------------------
def _audit_sql(name, left, right, lk, rk, relation):
    on = " AND ".join(f"l.{a} = r.{b}" for a, b in zip(lk, rk))
    null = " OR ".join(f"l.{a} IS NULL" for a in lk)
    rkeys = ", ".join(rk)
    single = f"count(DISTINCT l.{lk[0]}) FILTER (WHERE NOT ({null}) AND r.m IS NULL)" if len(lk) == 1 else "CAST(NULL AS BIGINT)"
    return f"""SELECT '{name}' AS name, count(*) AS left_rows, count(*) FILTER (WHERE {null}) AS left_null_key_rows,
count(*) FILTER (WHERE r.m IS NOT NULL) AS matched_rows, count(*) FILTER (WHERE NOT ({null}) AND r.m IS NULL) AS unmatched_rows,
{single} AS unmatched_distinct_keys, CAST(coalesce(sum(r.m), 0) AS BIGINT) AS naive_inner_join_rows, coalesce(max(r.m), 0) AS max_right_matches_per_key,
(SELECT count(*) FROM (SELECT {rkeys} FROM {right} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in rk)} GROUP BY ALL HAVING count(*) > 1)) AS right_keys_with_duplicates,
round(count(*) FILTER (WHERE r.m IS NOT NULL) / nullif(count(*) - count(*) FILTER (WHERE {null}), 0), 6) AS match_share_of_keyed_rows,
CAST(coalesce(sum(r.m), 0) AS BIGINT) - count(*) FILTER (WHERE r.m IS NOT NULL) AS row_multiplication_if_naive, '{relation}' AS relationship
FROM {left} l LEFT JOIN (SELECT {rkeys}, count(*) AS m FROM {right} GROUP BY ALL) r ON {on}"""


AUDITS = [("docs_to_labels", "documents", "labels", ["doc_id"], ["doc_id"], ["doc_id"]),
          ("orders_to_lines", "orders", "lineitem", ["o_orderkey"], ["l_orderkey"], LINE_KEY),
          ("lines_to_orders", "lineitem", "orders", ["l_orderkey"], ["o_orderkey"], ["o_orderkey"]),
          ("lines_to_lines", "lineitem", "lineitem", ["l_partkey", "l_suppkey"], ["l_suppkey", "l_partkey"], LINE_KEY)]


@query(" UNION ALL ".join(_audit_sql(n, a, b, lk, rk, "many-to-one" if sorted(key) == sorted(rk) else "one-to-many")
                          for n, a, b, lk, rk, key in AUDITS))
def join_audits(spark, sf):
    names = {t for a in AUDITS for t in a[1:3]}
    tables = {n: W.table(spark, sf, n) for n in names}
    out = None
    for n, a, b, lk, rk, key in AUDITS:
        one = J.join_audit(tables[a], tables[b], lk, rk, key).withColumn("name", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT doc_id, lang, quality, toxic, CASE WHEN labels.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS merge
FROM documents LEFT JOIN labels USING (doc_id)""")
def merged_labels(spark, sf):
    docs, labels = W.table(spark, sf, "documents").select("doc_id", "lang"), W.table(spark, sf, "labels")
    return J.validated_merge(docs, labels, ["doc_id"], validate="one_to_one", indicator="merge")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, o_custkey, o_orderstatus
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def lines_with_orders(spark, sf):
    orders = W.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    lines = W.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return J.checked_left_join(lines, orders, ["l_orderkey"], "orders")


STRUCTURED = "s AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS person, CASE WHEN o_orderstatus = 'O' THEN o_orderkey ELSE -o_orderkey END AS position FROM orders)"
RAWROWS = ("r AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_linenumber = 7 THEN -1 ELSE o_custkey END AS person, l_orderkey AS position, "
           "l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey)")


def _structured(spark, sf):
    """Every order; those that are not open have an id that no line has."""
    position = F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    return W.table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("person"), position.alias("position"))


def _rawrows(spark, sf):
    o = W.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    line = W.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    person = F.when(F.col("l_orderkey") % 10 == 0, None).when(F.col("l_linenumber") == 7, -1).otherwise(F.col("o_custkey"))
    return line.select(person.alias("person"), F.col("l_orderkey").alias("position"), "l_linenumber")


@query(f"WITH {STRUCTURED}, {RAWROWS} SELECT * FROM r WHERE EXISTS (SELECT 1 FROM s WHERE s.person IS NOT DISTINCT FROM r.person AND s.position = r.position)")
def null_branch_match(spark, sf):
    return J.semi_match(_rawrows(spark, sf), _structured(spark, sf), ["person", "position"], nullable=["person"])


@query(f"WITH {STRUCTURED}, {RAWROWS} SELECT * FROM r WHERE EXISTS (SELECT 1 FROM s WHERE s.person = r.person AND s.position = r.position)")
def semi_match(spark, sf):
    return J.semi_match(_rawrows(spark, sf), _structured(spark, sf), ["person", "position"])


@query(f"""WITH {STRUCTURED}, {RAWROWS} SELECT 'rows' AS what, count(*) AS unmatched_rows FROM s
WHERE NOT EXISTS (SELECT 1 FROM r WHERE s.person IS NOT DISTINCT FROM r.person AND s.position = r.position)
UNION ALL SELECT 'strict', count(*) FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE s.person = r.person AND s.position = r.position)""")
def unmatched_counts(spark, sf):
    s, r = _structured(spark, sf), _rawrows(spark, sf)
    keys = ["person", "position"]
    return (J.unmatched_count(s, r, keys, ["person"]).withColumn("what", F.lit("rows"))
            .unionByName(J.unmatched_count(s, r, keys).withColumn("what", F.lit("strict"))))


@query("SELECT o_custkey, count(*) AS key_rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def key_violations(spark, sf):
    """Keys at which a checked join to the orders by customer fails."""
    return J.key_violations(W.table(spark, sf, "orders"), ["o_custkey"])


@query("""SELECT o_orderkey AS position, 'missing' AS violation FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, 'duplicate' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT l_orderkey, 'foreign' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1 HAVING bool_or(l_linestatus <> 'O')""")
def lookup_violations(spark, sf):
    ids = W.table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"))
    lines = W.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("position"), "l_linestatus")
    return J.lookup_validated(ids, lines, "position", "l_linestatus", "O")[1]


@query("""WITH w AS (SELECT CASE WHEN l_linenumber = 1 THEN '1844674407370955' || l_orderkey || '00000' ELSE CAST(l_orderkey AS VARCHAR) END AS id, l_partkey FROM lineitem)
SELECT id, l_partkey, o_custkey FROM w LEFT JOIN orders ON o_orderkey = TRY_CAST(id AS BIGINT)""")
def guarded_key_join(spark, sf):
    wide = F.concat(F.lit("1844674407370955"), F.col("l_orderkey").cast("string"), F.lit("00000"))
    raw = W.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") == 1, wide).otherwise(F.col("l_orderkey").cast("string")).alias("id"), "l_partkey")
    side = W.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return J.guarded_key_join(raw, side, "id")


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS match_rank FROM lineitem)
SELECT o_orderkey AS k, o_custkey, l_partkey, l_extendedprice, match_rank FROM orders JOIN b ON l_orderkey = o_orderkey WHERE match_rank <= 2""")
def top_matches(spark, sf):
    orders = W.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    lines = W.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    best = J.top_matches(orders, lines, ["k"], [F.col("l_extendedprice").desc(), "l_partkey", "l_suppkey", "l_linenumber"], 2)
    return best.select("k", "o_custkey", "l_partkey", "l_extendedprice", "match_rank")


@query("SELECT c_custkey, c_custkey IN (SELECT CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE -o_custkey END FROM orders) AS ordered FROM customer")
def membership_flags(spark, sf):
    signed = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey")).otherwise(-F.col("o_custkey"))
    ids = W.table(spark, sf, "orders").select(signed.alias("c_custkey"))
    return J.membership_flag(W.table(spark, sf, "customer").select("c_custkey"), ids, "c_custkey", "ordered")


@query(history("""SELECT m.user_id, m.end_rule, m.spec, m.persistence_quarters, m.event_q, m.kind, a.primary_position_id AS from_primary_position_id,
 b.primary_position_id AS to_primary_position_id FROM moves m
LEFT JOIN panel a ON a.user_id = m.user_id AND a.end_rule = m.end_rule AND a.qidx = m.origin_q
LEFT JOIN panel b ON b.user_id = m.user_id AND b.end_rule = m.end_rule AND b.qidx = m.event_q"""))
def two_time_lookup(spark, sf):
    p = H.panel(spark, sf, keep=True)
    cls = S.classify_runs(S.status_runs(S.observations(p)), H.VARIANTS)
    moves = S.transitions(cls).select("user_id", "end_rule", "spec", "persistence_quarters", "event_q", "origin_q", "kind")
    by = ["user_id", "end_rule"]
    p = p.select(*by, "qidx", "primary_position_id").repartition(tasks_for(p.count()), "user_id")  # placed like the moves
    return J.attach_at(J.attach_at(moves, p, by, "origin_q", "qidx", ["primary_position_id"], "from_"),
                       p, by, "event_q", "qidx", ["primary_position_id"], "to_").drop("origin_q")


@query("""SELECT n_name, rule, k FROM nation, (VALUES ('a'), ('b')) r(rule), (VALUES (1), (2), (4)) p(k)""")
def dimension_spread(spark, sf):
    return J.spread(W.table(spark, sf, "nation").select("n_name"), rule=["a", "b"], k=[1, 2, 4])


@query("""SELECT text, CAST(sum(d) AS BIGINT) AS surplus FROM (SELECT text, 1 AS d FROM documents UNION ALL SELECT DISTINCT text, -1 FROM documents) GROUP BY text HAVING sum(d) <> 0""")
def bag_difference(spark, sf):
    docs = W.table(spark, sf, "documents").select("text")
    return J.same_bag(docs, docs.distinct())


# --- coverage ----------------------------------------------------------------------------
SETS = """SELECT country, CASE WHEN grouping(country) = 1 THEN 1 ELSE 0 END AS is_total, count(*) AS position_records,
count(DISTINCT user_id) AS people, count(*) - count(user_id) AS missing_person_records FROM src GROUP BY GROUPING SETS ((country), ())"""


@query(history(SETS))
def coverage_sets(spark, sf):
    return C.coverage(W.positions(spark, sf), "country", "user_id")


@query(history(f""", c AS ({SETS}) SELECT coalesce(country, 'Unknown') AS country, country IS NULL AS country_missing, position_records, people,
missing_person_records, round(100.0 * position_records / (SELECT position_records FROM c WHERE is_total = 1), 9) AS position_share_pct FROM c WHERE is_total = 0"""))
def coverage_summary(spark, sf):
    out = C.coverage_summary(C.coverage(W.positions(spark, sf), "country", "user_id"))
    return out.withColumn("position_share_pct", F.round("position_share_pct", 9))


@query(history(f""", c AS ({SETS}) SELECT t.position_records, t.people, t.missing_person_records,
(SELECT count(*) FROM c WHERE is_total = 0 AND country IS NOT NULL) AS named_countries,
(SELECT coalesce(sum(position_records), 0)::BIGINT FROM c WHERE is_total = 0 AND country IS NULL) AS unknown_country_position_records
FROM c t WHERE is_total = 1"""))
def coverage_totals(spark, sf):
    return C.coverage_totals(C.coverage(W.positions(spark, sf), "country", "user_id"))


RANGED = """WITH o AS (SELECT o_orderpriority AS country, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS person FROM orders),
lo AS (SELECT min(person) AS lo FROM o)"""


def _ranged(spark, sf):
    return W.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("country"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("person"))


@query(RANGED + """, g AS (SELECT *, lo + (person - lo) // 400 * 400 AS range_lo FROM o, lo)
SELECT range_lo, range_lo + 400 AS range_hi, country, CASE WHEN grouping(country) = 1 THEN 1 ELSE 0 END AS is_total, count(*) AS position_records,
count(DISTINCT person) AS people, count(*) - count(person) AS missing_person_records FROM g GROUP BY GROUPING SETS ((range_lo, country), (range_lo))""")
def coverage_ranges(spark, sf):
    return C.coverage_ranges(_ranged(spark, sf), "country", "person", 400)


@query(RANGED + """SELECT country, CASE WHEN grouping(country) = 1 THEN 1 ELSE 0 END AS is_total, count(*) AS position_records,
count(DISTINCT person) AS people, count(*) - count(person) AS missing_person_records FROM o GROUP BY GROUPING SETS ((country), ())""")
def coverage_merged(spark, sf):
    """Counts added up from the disjoint ranges must equal the single query."""
    return C.merge_partials(C.coverage_ranges(_ranged(spark, sf), "country", "person", 400))


@query("""SELECT event_type, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS records, count(DISTINCT user_id) AS people FROM events GROUP BY ALL""")
def group_counts(spark, sf):
    e = W.table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    return C.group_counts(e, ["event_type", "day"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS frequency FROM lineitem GROUP BY ALL")
def frequency_table(spark, sf):
    return C.contract(W.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""WITH g AS (SELECT unnest(generate_series(1994, 2002)) AS year), o AS (SELECT year(o_orderdate) AS year, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL)
SELECT g.year, """ + ", ".join(f"coalesce(sum(n) FILTER (WHERE p = '{p}'), 0)::BIGINT AS \"{p}\"" for p in ("1-URGENT", "3-MEDIUM", "never"))
       + " FROM g LEFT JOIN o USING (year) GROUP BY g.year")
def dense_pivot(spark, sf):
    o = W.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("user_id"))
    return C.dense_pivot(C.group_counts(o, ["year", "p"]), "year", "p", "records", 1994, 2002, ["1-URGENT", "3-MEDIUM", "never"])


@query(history("""SELECT coalesce(country, '[missing]') AS country, count(*) AS records, count(*) FILTER (WHERE enddate IS NULL) AS missing_year,
count(*) FILTER (WHERE year(enddate) < 1997) AS before_window, count(*) FILTER (WHERE year(enddate) BETWEEN 1997 AND 1999) AS in_window,
count(*) FILTER (WHERE year(enddate) > 1999) AS after_window FROM src GROUP BY ALL"""))
def window_split(spark, sf):
    p = W.positions(spark, sf).select(ED.clean_label("country").alias("country"), F.year("enddate").alias("year"))
    return C.window_split(p, "country", "year", 1997, 1999)


CLUES = {"red things": r"\bred\b", "round things": r"\bring\b|\bplate\b", "board": r"\bboard\b"}


@query(history(", t AS (SELECT user_id, lower(coalesce(raw_title, '') || ' ' || role_k1500_v2) AS x, role_k1500_v2 AS role FROM src) " + " UNION ALL ".join(
    f"SELECT '{n}' AS explicit_text_clue, role, count(*) AS records, count(DISTINCT user_id) AS people FROM t WHERE regexp_matches(x, '{p}') GROUP BY role"
    for n, p in CLUES.items())))
def text_clues(spark, sf):
    raw = W.positions_raw(spark, sf).select("position_id", "title_raw")
    p = W.positions(spark, sf).select("position_id", "user_id", F.col("role_k1500_v2").alias("role")).join(raw, "position_id", "left")
    return C.text_clues(p, ["title_raw", "role"], CLUES, ["role"])


# --- diagnostics -------------------------------------------------------------------------
G3 = "CASE WHEN {c} IS NULL THEN 'Missing' WHEN {c} = 'NATION_1' THEN 'Home' ELSE 'Other' END"
GC, GU, GP = G3.format(c="country"), G3.format(c="user_country"), G3.format(c="position_country")
PERIODS = ["measure", "end_rule", "period", "country_group", "value", "denominator"]


@query(history(f"""SELECT 'positions_started' AS measure, CAST(year(startdate) AS VARCHAR) AS period, {GC} AS country_group, count(*) AS value,
CAST(sum(count(*)) OVER (PARTITION BY year(startdate)) AS BIGINT) AS denominator FROM valid GROUP BY year(startdate), {GC}
UNION ALL SELECT 'positions_ended', CAST(year(enddate) AS VARCHAR), {GC}, count(*), CAST(sum(count(*)) OVER (PARTITION BY year(enddate)) AS BIGINT)
FROM valid WHERE enddate IS NOT NULL GROUP BY year(enddate), {GC}
UNION ALL SELECT 'people_starting_a_position', CAST(year(startdate) AS VARCHAR), {GC}, count(DISTINCT user_id), NULL FROM valid GROUP BY year(startdate), {GC}"""))
def activity_by_year(spark, sf):
    return D.activity_by_year(H.cleaned(spark, sf).valid, CFG).select("measure", "period", "country_group", "value", "denominator")


_MISS = {"country": "country IS NULL", "employer_rcid": "rcid IS NULL", "parent_rcid": "ultimate_parent_rcid IS NULL", "title": "title_status <> 'ok'",
         "metro_area": "metro_area IS NULL", "end_date": "enddate IS NULL", "seniority": "seniority IS NULL"}


@query(history(" UNION ALL ".join(f"SELECT 'missing_{n}' AS measure, CAST(year(startdate) AS VARCHAR) AS period, count(*) FILTER (WHERE {c}) AS value, "
                                  "count(*) AS denominator FROM valid GROUP BY year(startdate)" for n, c in _MISS.items())))
def missing_by_year(spark, sf):
    c = H.cleaned(spark, sf)
    return D.missing_by_year(c.valid).select("measure", "period", "value", "denominator")


@query(history(f"""SELECT reason || ':' || unit AS measure, {GC} AS country_group, CASE unit WHEN 'positions' THEN count(*) ELSE count(DISTINCT user_id) END AS value,
CASE unit WHEN 'positions' THEN (SELECT count(*) FROM positions) ELSE (SELECT count(*) FROM users WHERE n_positions > 0) END AS denominator
FROM positions, (VALUES ('positions'), ('people')) u(unit) WHERE reason IS NOT NULL GROUP BY reason, unit, {GC}"""))
def quarantine_summary(spark, sf):
    c = H.cleaned(spark, sf)
    n = c.positions.agg(F.count(F.lit(1)).alias("n")).scalar()
    p = c.users.agg(F.count_if(F.col("n_positions") > 0).alias("n")).scalar()
    return D.quarantine_summary(c.quarantine, n, p, CFG).select("measure", "country_group", "value", "denominator")


@query(history(f"""SELECT 'profiles_refreshed' AS measure, 'year' AS period_type, CAST(year(updated_dt) AS VARCHAR) AS period, {GU} AS country_group, count(*) AS value,
NULL AS value_text, false AS is_partial_period FROM users GROUP BY year(updated_dt), {GU}
UNION ALL SELECT 'profiles_refreshed', 'month', strftime(updated_dt, '%Y-%m'), 'All', count(*), NULL, false FROM users WHERE updated_dt >= DATE '2000-01-01' GROUP BY 3
UNION ALL SELECT 'profile_only_people', 'quarter', {qlabel('refresh_qidx')}, {GU}, count(*), NULL, refresh_qidx > {CFG.last_q} FROM users WHERE n_valid_positions = 0 GROUP BY refresh_qidx, {GU}
""" + "".join(f"UNION ALL SELECT 'updated_dt_quantile_p{round(p * 100):02d}', 'all', 'all', 'All', NULL, CAST(quantile_disc(updated_dt, {p}) AS VARCHAR), false FROM users\n"
              for p in (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99))))
def profile_refresh(spark, sf):
    out = D.profile_refresh(H.cleaned(spark, sf).users, CFG, "2000-01-01")
    return out.select("measure", "period_type", "period", "country_group", "value", "value_text",
                      F.coalesce("is_partial_period", F.lit(False)).alias("is_partial_period"))


@query(history("""SELECT unnest(['cohort_people', 'people_with_profile_row', 'people_with_any_position', 'people_with_valid_dated_position', 'profile_only_people',
'people_with_valid_home_position']) AS measure, unnest([count(*), count(*), count(*) FILTER (WHERE n_positions > 0), count(*) FILTER (WHERE n_valid_positions > 0),
count(*) FILTER (WHERE n_valid_positions = 0), count(*) FILTER (WHERE n_valid_home_positions > 0)]) AS value FROM users"""))
def population_counts(spark, sf):
    return D.population_counts(H.cleaned(spark, sf).users).select("measure", "value")


_ACT = {"active_positions": "sum(n_active)", "active_positions_home": "sum(n_active_home)", "active_positions_missing_country": "sum(n_active_missing_country)",
        "active_people": "count(*)", "people_primary_home": "count(*) FILTER (WHERE position_country = 'NATION_1')",
        "people_primary_other_country": "count(*) FILTER (WHERE position_country <> 'NATION_1')",
        "people_primary_missing_country": "count(*) FILTER (WHERE position_country IS NULL)",
        "people_home_with_profile_fallback": "count(*) FILTER (WHERE loc_fb = 'NATION_1')", "people_primary_end_date_missing": "count(*) FILTER (WHERE primary_end_missing)"}


@query(history(" UNION ALL ".join(f"SELECT '{n}' AS measure, end_rule, {qlabel('qidx')} AS period, CAST({e} AS BIGINT) AS value FROM panel WHERE obs_type = 'position' GROUP BY end_rule, qidx"
                                  for n, e in _ACT.items())))
def quarterly_activity(spark, sf):
    return D.quarterly_activity(H.panel(spark, sf), CFG).select("measure", "end_rule", "period", "value")


_OVER = {"person_quarters": "true", "multiple_active_positions": "n_active > 1", "conflicting_countries": "country_conflict",
         "downranking_changed_primary": "downrank_changed_primary", "downranking_changed_country": "downrank_changed_country",
         "primary_is_downranked_role": "primary_downranked", "primary_home_with_other_alternative": "position_country = 'NATION_1' AND alt <> ''",
         "primary_other_with_home_alternative": "position_country IS DISTINCT FROM 'NATION_1' AND any_active_home",
         "primary_missing_country_alternative_known": "position_country IS NULL AND alt <> ''",
         "metro_home_but_country_not_home": "position_metro_area ILIKE '%nation_1%' AND position_country IS DISTINCT FROM 'NATION_1'"}


@query(history(" UNION ALL ".join(f"SELECT '{n}' AS measure, end_rule, CAST(qidx // 4 AS VARCHAR) AS period, count(*) FILTER (WHERE {e}) AS value, count(*) AS denominator "
                                  "FROM panel WHERE obs_type = 'position' GROUP BY end_rule, qidx // 4" for n, e in _OVER.items())))
def overlap_effects(spark, sf):
    return D.overlap_effects(H.panel(spark, sf), CFG).select("measure", "end_rule", "period", "value", "denominator")


@query(history(f"""SELECT {qlabel('qidx')} AS quarter, coalesce(position_country, '(missing)') AS country, {GP} AS country_group, count(*) AS value,
CAST(sum(count(*)) OVER (PARTITION BY qidx) AS BIGINT) AS denominator FROM panel
WHERE obs_type = 'position' AND end_rule = 'carry_to_cutoff' AND (qidx % 4 = 3 OR qidx = {CFG.last_q}) GROUP BY qidx, position_country"""))
def category_period_coverage(spark, sf):
    return D.category_period_coverage(H.panel(spark, sf), CFG).select("quarter", "country", "country_group", "value", "denominator")


@query(history(f"""SELECT m AS measure, end_rule, {GC} AS country_group, CASE m WHEN 'active_positions' THEN count(*) ELSE count(DISTINCT user_id) END AS value
FROM ruled, (VALUES ('active_positions'), ('active_people')) u(m) WHERE start_midx <= {CFG.cutoff_midx} AND eff >= {CFG.cutoff_midx} GROUP BY m, end_rule, {GC}"""))
def partial_period(spark, sf):
    c = H.cleaned(spark, sf)
    return D.partial_period(c.valid, c.users, CFG).select("measure", "end_rule", "country_group", "value")


SPAN = f""", sp AS (SELECT end_rule, user_id, min(qidx) AS lo, max(qidx) AS hi FROM panel GROUP BY ALL),
g AS (SELECT r AS end_rule, qidx FROM (SELECT unnest(generate_series({CFG.panel_start_q}, {CFG.last_q})) AS qidx), (VALUES ('carry_to_cutoff'), ('cap_at_last_refresh')) x(r)),
pin AS (SELECT g.end_rule, g.qidx, count(sp.user_id) AS people_in_span FROM g LEFT JOIN sp ON sp.end_rule = g.end_rule AND g.qidx BETWEEN lo AND hi GROUP BY ALL)
"""


@query(history(SPAN + "SELECT end_rule, qidx, people_in_span FROM pin"))
def people_in_span(spark, sf):
    return D.people_in_span(H.panel(spark, sf), CFG)


_LM = {"person_quarters": "true", "position_rows": "obs_type = 'position'", "profile_snapshot_rows": "obs_type = 'profile_snapshot'", "known_location": "c IS NOT NULL",
       "home": "c = 'NATION_1'", "non_home": "c <> 'NATION_1'", "unknown_location": "c IS NULL", "position_country_present": "position_country IS NOT NULL",
       "position_country_missing": "obs_type = 'position' AND position_country IS NULL", "located_by_profile_snapshot_row": "s = 'profile_snapshot'",
       "fallback_snapshot_quarter": "s = 'profile_fallback' AND timing = 'snapshot'", "fallback_backcast": "s = 'profile_fallback' AND timing = 'backcast'",
       "fallback_forwardcast": "s = 'profile_fallback' AND timing = 'forwardcast'", "conflicting_country_rows": "country_conflict",
       "rows_with_alternative_country": "alt <> ''", "rows_primary_end_date_missing": "primary_end_missing"}


@query(history(SPAN + f""", pv AS (SELECT panel.*, 'position_with_profile_fallback' AS location_spec, loc_fb AS c, src_fb AS s FROM panel
 UNION ALL SELECT panel.*, 'position_only', loc_po, CASE WHEN loc_po IS NOT NULL THEN 'position' END FROM panel),
lm AS (SELECT end_rule, location_spec, qidx, {', '.join(f'count(*) FILTER (WHERE {c}) AS {n}' for n, c in _LM.items())} FROM pv GROUP BY ALL),
d AS (SELECT pin.end_rule, specs.location_spec, pin.qidx, lm.* EXCLUDE (end_rule, location_spec, qidx), people_in_span,
  people_in_span - coalesce(person_quarters, 0) AS gapq FROM pin CROSS JOIN specs LEFT JOIN lm ON lm.end_rule = pin.end_rule AND lm.location_spec = specs.location_spec AND lm.qidx = pin.qidx)
SELECT end_rule, location_spec, {qlabel('qidx')} AS quarter, qidx // 4 AS year, qidx, {', '.join(_LM)}, gapq AS unobserved_gap_quarters_within_span, people_in_span,
 CASE WHEN person_quarters > 0 THEN round(unknown_location / person_quarters, 6) END AS unknown_share_of_rows FROM d
UNION ALL SELECT end_rule, location_spec, 'all', NULL, NULL, {', '.join(f'sum({n})::BIGINT' for n in _LM)}, sum(gapq)::BIGINT, sum(people_in_span)::BIGINT,
 round(sum(unknown_location) / sum(person_quarters), 6) FROM d GROUP BY end_rule, location_spec"""))
def location_missingness(spark, sf):
    return D.location_missingness(H.panel(spark, sf, keep=True), CFG)


@query(history(""", r AS (SELECT unnest(role_rule_ids) AS rule_id, lower(title_raw) AS title FROM valid),
c AS (SELECT rule_id, title, count(*) AS positions FROM r GROUP BY ALL), t AS (SELECT rule_id, sum(positions)::BIGINT AS rule_positions, count(*) AS distinct_titles FROM c GROUP BY 1)
SELECT rule_id, rule_positions, distinct_titles, title, positions, row_number() OVER (PARTITION BY rule_id ORDER BY positions DESC, title) AS title_rank
FROM c JOIN t USING (rule_id) QUALIFY title_rank <= 25"""))
def title_audit(spark, sf):
    return D.title_audit(H.cleaned(spark, sf).valid)


def _report_sql() -> str:
    """The sections' own statements next to each other."""
    part = lambda n: "(" + ORACLE[n][len(HISTORY):] + ")"
    rows = [
        ("positions_by_year", "measure, NULL, 'year', period, country_group, value, denominator, NULL, false", part("activity_by_year")),
        ("missing_fields", "measure, NULL, 'year', period, 'All', value, denominator, NULL, false", part("missing_by_year")),
        ("quarantined_positions", "measure, NULL, 'all', 'all', country_group, value, denominator, NULL, false", part("quarantine_summary")),
        ("profile_refresh", "measure, NULL, period_type, period, country_group, value, NULL, value_text, is_partial_period", part("profile_refresh")),
        ("population", "measure, NULL, 'all', 'all', 'All', value, NULL, NULL, false", part("population_counts")),
        ("quarterly_activity", "measure, end_rule, 'quarter', period, 'All', value, NULL, NULL, false", part("quarterly_activity")),
        ("overlap_effects", "measure, end_rule, 'year', period, 'All', value, denominator, NULL, false", part("overlap_effects")),
        ("country_year_coverage", "'people_by_primary_position_country', 'carry_to_cutoff', 'year', substr(quarter, 1, 4), country_group, value, denominator, NULL, false",
         part("category_period_coverage")),
        ("quarterly_activity", "measure, end_rule, 'quarter', '2000Q4', country_group, value, NULL, NULL, true", part("partial_period")),
        ("join_coverage", "'position_title:' || title_status, NULL, 'all', 'all', 'All', n, NULL, NULL, false",
         "(SELECT title_status, count(*) AS n FROM positions GROUP BY 1)"),
        ("join_coverage", "'positions_to_users:' || m, NULL, 'all', 'all', 'All', CASE m WHEN 'left_null_key_rows' THEN nulls ELSE 0 END, n, NULL, false",
         "(SELECT count(*) AS n, count(*) - count(user_id) AS nulls FROM src), (VALUES ('unmatched_rows'), ('left_null_key_rows'), ('row_multiplication_if_naive')) v(m)"),
        ("duplicates", "t || ':' || m, NULL, 'all', 'all', 'All', 0, CASE WHEN t IN ('positions', 'raw_titles') THEN p ELSE u END, NULL, false",
         "(SELECT (SELECT count(*) FROM src) AS p, (SELECT count(*) FROM people) AS u), (VALUES ('positions'), ('users'), ('cohort'), ('raw_titles')) t(t), "
         "(VALUES ('exact_duplicate_rows_collapsed'), ('conflicting_keys'), ('rows_in_conflicting_keys'), ('null_key_rows')) v(m)")]
    union = " UNION ALL ".join(f"SELECT '{s}' AS section, {c} FROM {f} x{i}" if not f.startswith("(SELECT count") and not f.startswith("(SELECT (")
                               else f"SELECT '{s}' AS section, {c} FROM {f}" for i, (s, c, f) in enumerate(rows))
    return history(f""", rep(section, measure, end_rule, period_type, period, country_group, value, denominator, value_text, part) AS ({union})
SELECT section, measure, end_rule, period_type, period, country_group, value, denominator, value_text,
 CASE WHEN denominator > 0 THEN round(value / denominator, 6) END AS share, part OR (period_type = 'year' AND period = '2000') AS is_partial_period,
 CASE WHEN section IN ('profile_refresh', 'population') THEN 'scrape_observation' WHEN section IN ('join_coverage', 'duplicates') THEN 'join_and_quarantine_audit'
  ELSE 'retrospective_employment_history' END AS source_kind FROM rep""")


@query(_report_sql())
def coverage_report(spark, sf):
    """Every section in one table."""
    c = H.cleaned(spark, sf)
    panel = H.panel(spark, sf)
    audit = J.join_audit(W.positions(spark, sf), W.people(spark, sf), ["user_id"], right_key=["user_id"]).select(
        F.lit("positions_to_users").alias("name"), F.lit("positions").alias("left_table"), F.lit("users").alias("right_table"), F.lit("ok").alias("status"), "*")
    return R.coverage_report(c, panel, CFG, "2000-01-01", audit).select(
        "section", "measure", "end_rule", "period_type", "period", "country_group", "value", "denominator", "value_text", "share", "is_partial_period", "source_kind")


# --- trends ------------------------------------------------------------------------------
def _ads(spark, sf):
    return W.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("post_date"), (F.col("o_orderpriority") == "5-LOW").alias("flag"))


MONTHS = """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS all_ads, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS flagged_ads,
min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date FROM orders GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(month) FROM m WHERE flagged_ads > 0), (SELECT max(month) FROM m), INTERVAL 1 MONTH))::DATE AS month),
s AS (SELECT g.month, coalesce(flagged_ads, 0) AS flagged_ads, coalesce(all_ads, 0) AS all_ads,
 CASE WHEN all_ads > 0 THEN round(100.0 * flagged_ads / all_ads, 3) ELSE 0 END AS share_percent,
 g.month = (SELECT max(month) FROM m) AND (SELECT max(last_date) FROM m) < last_day((SELECT max(last_date) FROM m)) AS partial_last_month FROM g LEFT JOIN m USING (month))
"""


@query(MONTHS + "SELECT month::VARCHAR AS month, all_ads, flagged_ads, first_date::VARCHAR AS first_date, last_date::VARCHAR AS last_date FROM m")
def monthly_trend(spark, sf):
    return text_dates(T.monthly_trend(_ads(spark, sf), "post_date", "flag"))


@query(MONTHS + """SELECT month::VARCHAR AS month, flagged_ads, all_ads, share_percent, partial_last_month,
CASE WHEN NOT partial_last_month AND row_number() OVER (ORDER BY month) >= 12 THEN round(sum(flagged_ads) OVER (ORDER BY month ROWS 11 PRECEDING) / 12, 6) END AS rolling_mean FROM s""")
def rolling_12m(spark, sf):
    out = T.rolling_mean(T.monthly_series(T.monthly_trend(_ads(spark, sf), "post_date", "flag")))
    return text_dates(out.withColumn("rolling_mean", F.round("rolling_mean", 6)))


@query(MONTHS + "SELECT year(month) AS year, sum(flagged_ads)::BIGINT AS ads FROM s GROUP BY 1")
def annual_counts(spark, sf):
    return T.annual_counts(T.monthly_series(T.monthly_trend(_ads(spark, sf), "post_date", "flag")))


@query(MONTHS + "SELECT month::VARCHAR AS peak_month, flagged_ads AS peak_ads FROM s WHERE NOT partial_last_month ORDER BY flagged_ads DESC, month DESC LIMIT 1")
def peak_month(spark, sf):
    return text_dates(T.peak_period(T.monthly_series(T.monthly_trend(_ads(spark, sf), "post_date", "flag"))))


@query(" UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS level, CAST(quantile_disc(CAST(l_shipdate AS DATE), {p}) AS VARCHAR) AS quantile FROM lineitem"
    for p in (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)))
def quantiles_of_date(spark, sf):
    line = W.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    return text_dates(D.discrete_quantiles(line, "d"))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS measure, CAST({p} AS DOUBLE) AS level, CAST(quantile_disc({c}, {p}) AS DOUBLE) AS quantile FROM lineitem"
    for c in ("l_extendedprice", "l_quantity", "l_orderkey") for p in (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)))
def quantiles_of_numbers(spark, sf):
    line = W.table(spark, sf, "lineitem")
    parts = [D.discrete_quantiles(line, c).select(F.lit(c).alias("measure"), "level", F.col("quantile").cast("double").alias("quantile"))
             for c in ("l_extendedprice", "l_quantity", "l_orderkey")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-12-31'
AND (CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + INTERVAL 90 DAY END IS NULL OR o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1997-01-01')""")
def overlapping_spells(spark, sf):
    o = W.table(spark, sf, "orders")
    end = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("interval 90 days"))
    return o.where(period_overlap("o_orderdate", end, F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))).select("o_orderkey", "o_custkey")


# --- linkage -----------------------------------------------------------------------------
@query(history("""SELECT DISTINCT user_id FROM (SELECT user_id FROM people WHERE user_country = 'NATION_1' UNION SELECT user_id FROM src WHERE country = 'NATION_1') WHERE user_id IS NOT NULL"""))
def country_cohort(spark, sf):
    p = W.positions(spark, sf).withColumn("country", blank_to_null("country"))
    return L.country_cohort(W.people(spark, sf), p, "NATION_1")


@query("""SELECT DISTINCT CAST(id AS VARCHAR) AS entity_id FROM (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT l_suppkey FROM lineitem UNION ALL SELECT l_partkey FROM lineitem
UNION ALL SELECT CAST(p_partkey AS DOUBLE)::BIGINT FROM part)""")
def linked_entities(spark, sf):
    t = lambda n: W.table(spark, sf, n)
    part = t("part").select(F.col("p_partkey").cast("double").alias("p"))
    return L.linked_entities([(t("supplier"), ["s_suppkey"]), (t("lineitem"), ["l_suppkey", "l_partkey"]), (part, ["p"])])


def product_tables(spark, sf):
    """The driver tables in the roles of the linked extract's products."""
    t = lambda n: W.table(spark, sf, n)
    nation = lambda c: F.concat(F.lit("N"), c.cast("string"))
    orders = t("orders")
    return {
        "individual_user": t("customer").select(F.col("c_custkey").alias("user_id"), nation(F.col("c_nationkey")).alias("user_country")),
        "individual_positions": orders.select(
            F.when(F.col("o_orderkey") % 40 != 0, F.col("o_custkey")).alias("user_id"), F.col("o_orderkey").alias("position_id"),
            nation(F.col("o_orderkey") % 25).alias("country"), (F.col("o_orderkey") % 500).alias("rcid"),
            F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 60).alias("ultimate_parent_rcid")),
        "individual_positions_raw": t("lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
            F.when(F.col("o_orderkey") % 40 != 0, F.col("o_custkey")).alias("user_id"), F.col("l_orderkey").alias("position_id"), "l_linenumber"),
        "individual_user_education": t("events").select("user_id", F.col("event_id").alias("education_number"), (F.col("event_id") % 90).cast("double").alias("rsid")),
        "postings_cosmos": t("lineitem").select(F.col("l_orderkey").alias("job_id"), nation(F.col("l_suppkey") % 25).alias("country"),
                                                F.col("l_partkey").alias("rcid"), F.lit(None).cast("bigint").alias("ultimate_parent_rcid")),
        "postings_cosmos_raw": orders.select(F.col("o_orderkey").alias("job_id"), "o_orderpriority"),
        "company_mapping": t("part").select(F.col("p_partkey").alias("rcid"), nation(F.col("p_size") % 25).alias("hq_country")),
        "school_mapping": t("supplier").select(F.col("s_suppkey").alias("rsid"), nation(F.col("s_nationkey")).alias("country")),
        "sentiment_individual_reviews": t("documents").select((F.col("doc_id") % 700).alias("rcid"), (F.col("doc_id") % 11).alias("ultimate_parent_rcid"),
                                                              nation(F.col("doc_id") % 25).alias("country")),
        "workforce_dynamics_geo": t("pages").select((F.col("page_id") * 3).alias("rcid"), nation(F.col("page_id") % 25).alias("country")),
        "regions": t("nation").select(nation(F.col("n_nationkey")).alias("country"), "n_name"),
        "months": t("region").select("r_name"),
    }


PRODUCTS = """WITH iu AS (SELECT c_custkey AS user_id, 'N' || c_nationkey AS user_country FROM customer),
ip AS (SELECT CASE WHEN o_orderkey % 40 <> 0 THEN o_custkey END AS user_id, o_orderkey AS position_id, 'N' || (o_orderkey % 25) AS country, o_orderkey % 500 AS rcid,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 60 END AS up FROM orders),
ir AS (SELECT CASE WHEN o_orderkey % 40 <> 0 THEN o_custkey END AS user_id, l_orderkey AS position_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ie AS (SELECT user_id, event_id, CAST(event_id % 90 AS DOUBLE) AS rsid FROM events),
pc AS (SELECT l_orderkey AS job_id, 'N' || (l_suppkey % 25) AS country, l_partkey AS rcid FROM lineitem),
cm AS (SELECT p_partkey AS rcid, 'N' || (p_size % 25) AS hq FROM part),
sm AS (SELECT s_suppkey AS rsid, 'N' || s_nationkey AS country FROM supplier),
sr AS (SELECT doc_id % 700 AS rcid, doc_id % 11 AS up, 'N' || (doc_id % 25) AS country FROM documents),
wg AS (SELECT page_id * 3 AS rcid, 'N' || (page_id % 25) AS country FROM pages),
coh AS (SELECT user_id FROM iu WHERE user_country = 'N7' UNION SELECT user_id FROM ip WHERE country = 'N7' AND user_id IS NOT NULL),
sp AS (SELECT * FROM ip WHERE user_id IN (SELECT user_id FROM coh) OR (user_id IS NULL AND country = 'N7')),
so AS (SELECT * FROM pc WHERE country = 'N7'), se AS (SELECT * FROM ie WHERE user_id IN (SELECT user_id FROM coh)),
co AS (SELECT rcid FROM cm WHERE hq = 'N7' UNION SELECT rcid FROM sp UNION SELECT up FROM sp UNION SELECT rcid FROM so UNION SELECT rcid FROM sr WHERE country = 'N7'
 UNION SELECT up FROM sr WHERE country = 'N7' UNION SELECT rcid FROM wg WHERE country = 'N7'),
sc AS (SELECT rsid FROM sm WHERE country = 'N7' UNION SELECT CAST(rsid AS BIGINT) FROM se)
"""


@query(PRODUCTS + """SELECT 'people_cohort' AS "table", count(*) AS rows FROM coh UNION ALL SELECT 'individual_positions', count(*) FROM sp
UNION ALL SELECT 'individual_user', count(*) FROM iu WHERE user_id IN (SELECT user_id FROM coh)
UNION ALL SELECT 'individual_positions_raw', count(*) FROM ir WHERE EXISTS (SELECT 1 FROM sp WHERE sp.user_id IS NOT DISTINCT FROM ir.user_id AND sp.position_id = ir.position_id)
UNION ALL SELECT 'individual_user_education', count(*) FROM se UNION ALL SELECT 'postings_cosmos', count(*) FROM so
UNION ALL SELECT 'postings_cosmos_raw', count(*) FROM orders WHERE o_orderkey IN (SELECT job_id FROM so)
UNION ALL SELECT 'company_mapping', count(*) FROM cm WHERE rcid IN (SELECT rcid FROM co WHERE rcid IS NOT NULL)
UNION ALL SELECT 'school_mapping', count(*) FROM sm WHERE rsid IN (SELECT rsid FROM sc)
UNION ALL SELECT 'sentiment_individual_reviews', count(*) FROM sr WHERE country = 'N7' UNION ALL SELECT 'workforce_dynamics_geo', count(*) FROM wg WHERE country = 'N7'
UNION ALL SELECT 'regions', count(*) FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'months', count(*) FROM region""")
def linked_extract(spark, sf):
    out = None
    for name, df in L.linked_extract(product_tables(spark, sf), "N7").items():
        one = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def _contents_sql() -> str:
    """Rows and sums over MD5 pieces of each product."""
    products = {
        "people_cohort": ("user_id", "coh"), "individual_positions": ("user_id, position_id, country, rcid, up", "sp"),
        "individual_user": ("user_id, user_country", "iu WHERE user_id IN (SELECT user_id FROM coh)"),
        "individual_positions_raw": ("user_id, position_id, l_linenumber", "(SELECT CASE WHEN o_orderkey % 40 <> 0 THEN o_custkey END AS user_id, l_orderkey AS position_id, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey) r "
                                     "WHERE EXISTS (SELECT 1 FROM sp WHERE sp.user_id IS NOT DISTINCT FROM r.user_id AND sp.position_id = r.position_id)"),
        "individual_user_education": ("user_id, event_id, rsid", "se"), "postings_cosmos": ("job_id, country, rcid, NULL", "so"),
        "postings_cosmos_raw": ("o_orderkey, o_orderpriority", "orders WHERE o_orderkey IN (SELECT job_id FROM so)"),
        "company_mapping": ("rcid, hq", "cm WHERE rcid IN (SELECT rcid FROM co WHERE rcid IS NOT NULL)"), "school_mapping": ("rsid, country", "sm WHERE rsid IN (SELECT rsid FROM sc)"),
        "sentiment_individual_reviews": ("rcid, up, country", "sr WHERE country = 'N7'"), "workforce_dynamics_geo": ("rcid, country", "wg WHERE country = 'N7'"),
        "regions": ("'N' || n_nationkey, n_name", "nation WHERE n_nationkey = 7"), "months": ("r_name", "region")}
    parts = []
    for name, (columns, source) in products.items():
        line = "md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns.split(", ")) + "))"
        sums = ", ".join(f"coalesce(sum(CAST('0x' || substr({line}, {at}, 8) AS BIGINT)), 0)::BIGINT AS content_{k}" for k, at in (("a", 1), ("b", 9)))
        parts.append(f"SELECT '{name}' AS \"table\", count(*) AS rows, {sums} FROM {source}")
    return PRODUCTS + " UNION ALL ".join(parts)


@query(_contents_sql())
def linked_contents(spark, sf):
    """Contents of every product, selected by id sets that are written once."""
    tables = product_tables(spark, sf)
    parts = []
    for name, df in L.linked_extract(tables, "N7", keep=stage).items():
        one = df.select(*tables[name].columns) if name in tables else df
        parts.append(L.content_sums(one).withColumn("table", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(PRODUCTS + """SELECT 'individual_positions_raw' AS raw_table, count(*) AS unmatched_rows FROM sp
 WHERE NOT EXISTS (SELECT 1 FROM ir WHERE sp.user_id IS NOT DISTINCT FROM ir.user_id AND sp.position_id = ir.position_id)
UNION ALL SELECT 'postings_cosmos_raw', count(*) FROM so WHERE job_id NOT IN (SELECT o_orderkey FROM orders)""")
def unmatched_raw(spark, sf):
    tables = product_tables(spark, sf)
    return L.unmatched_raw(L.linked_extract(tables, "N7"), tables)


@query("""WITH o AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS person, o_orderkey FROM orders)
SELECT o_orderkey, CASE WHEN person IS NULL THEN -1 ELSE (dense_rank() OVER (PARTITION BY person IS NULL ORDER BY person) - 1) // 100 END AS batch FROM o""")
def disjoint_batches(spark, sf):
    o = W.table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("person"), "o_orderkey")
    return L.split_disjoint(o, "person", 100).drop("person")


# --- sources -----------------------------------------------------------------------------
@query("""SELECT count(*) AS rows, count(*) AS distinct_ordinals, 0 AS first, count(*) - 1 AS last, 40 AS parts, sum(l_orderkey * 8 + l_linenumber)::BIGINT AS content FROM lineitem""")
def row_positions(spark, sf):
    """Addresses of all rows of a table in 40 files."""
    many = stage(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber").repartition(40, "l_orderkey", "l_linenumber"), "lineitem")
    p = M.parquet_row_positions(many)
    per = p.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("part"), F.sum(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("c"))
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_ordinals"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"),
                   F.count_distinct("part").alias("parts"), F.sum("c").alias("content"))


def written_root(spark) -> str:
    """A folder of its own below the shared one, for tables that are written and read again."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("""SELECT 'orders' AS "table", count(*) AS rows, 'complete' AS status, 3 AS parts, true AS rows_reconcile, true AS parts_reconcile, true AS bytes_reconcile, '' AS problems FROM orders
UNION ALL SELECT 'lineitem', count(*), 'complete', 5, false, true, true, 'row count differs' FROM lineitem
UNION ALL SELECT 'events', count(*), 'running', 2, true, false, false, 'table is not complete' FROM events
UNION ALL SELECT 'part', count(*), NULL, 1, NULL, NULL, NULL, 'on disk but not in the manifest' FROM part
UNION ALL SELECT 'lost', NULL, 'complete', NULL, NULL, NULL, NULL, 'manifest rows but no parts'""")
def reconciled_manifest(spark, sf):
    """Written copies, as they are measured on disk, against a manifest with wrong entries."""
    root, parts = written_root(spark), {"orders": 3, "lineitem": 5, "events": 2, "part": 1}
    counts = {}
    for name, n in parts.items():
        W.table(spark, sf, name).repartition(n).write.parquet(f"{root}/{name}")
        counts[name] = W.table(spark, sf, name).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
    listed = M.file_manifest(spark, root).where(F.col("path").endswith(".parquet"))
    sizes = listed.groupBy(F.element_at(F.split("path", "/"), -2).alias("table")).agg(F.sum("size").alias("bytes"))
    true = reduce(lambda a, b: a.unionByName(b), [counts[n] for n in ("orders", "lineitem", "events")]).join(sizes, "table")
    wrong = lambda name, by: F.when(F.col("table") == name, by).otherwise(0)
    told = true.select("table", F.when(F.col("table") == "events", "running").otherwise("complete").alias("status"), (F.col("rows") + wrong("lineitem", 1)).alias("rows"),
                       F.lit(None).cast("bigint").alias("expected_rows"),
                       (F.coalesce(*[F.when(F.col("table") == n, k) for n, k in parts.items()]) + wrong("events", 7)).cast("bigint").alias("parts"), (F.col("bytes") + wrong("events", 1)).alias("bytes"))
    told = told.unionByName(spark.createDataFrame([("lost", "complete", 9, None, 1, 1)], told.schema))
    out = M.reconcile(told, M.measure_tables(spark, root, list(parts)))
    return out.select("table", "rows", "status", "parts", "rows_reconcile", "parts_reconcile", "bytes_reconcile", F.array_join("problems", "; ").alias("problems"))


@query(" UNION ALL ".join(f"SELECT {b} AS bucket, count(*) AS rows, coalesce(sum(o_orderkey), 0)::BIGINT AS order_sum, 6 AS columns FROM orders WHERE o_custkey % 8 = {b}" for b in (0, 3, 7, 99)))
def bucket_round_trip(spark, sf):
    """Orders written by bucket of their customer; single buckets read back, one of them absent."""
    path = f"{written_root(spark)}/orders"
    write_table(W.table(spark, sf, "orders").withColumn("bucket", F.col("o_custkey") % 8), path, ["bucket"])
    parts = []
    for b in (0, 3, 7, 99):
        one = read_partition(spark, path, "bucket", b).drop("bucket")
        parts.append(one.agg(F.lit(b).alias("bucket"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("o_orderkey"), F.lit(0)).alias("order_sum"), F.lit(len(one.columns)).alias("columns")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("SELECT 'complete' AS status, count(*) AS rows, sum(o_custkey)::BIGINT AS customers FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus = 'O'")
def extracted_orders(spark, sf):
    """A statement with bound parameters, its extract and its manifest."""
    W.table(spark, sf, "orders").createOrReplaceTempView("orders_to_extract")
    out = written_root(spark)
    manifest = extract_query(spark, "SELECT o_orderkey, o_custkey FROM orders_to_extract WHERE o_totalprice >= :least AND o_orderstatus = :status", {"least": 100000, "status": "O"}, out)
    data = spark.read.parquet(f"{out}/data").agg(F.sum("o_custkey").alias("customers"))
    return manifest.select("status", "rows").join(data)


@query("""SELECT 'added' AS status, 1 AS files UNION ALL SELECT 'removed', 1""")
def manifest_changes(spark, sf):
    """Files that differ, by listing and content, after one bucket of a written table is replaced."""
    path = f"{written_root(spark)}/orders"
    rows = W.table(spark, sf, "orders").withColumn("bucket", F.col("o_custkey") % 4).repartition(4, "bucket")
    write_table(rows, path, ["bucket"])
    before = stage(M.file_manifest(spark, path, content_hash=True).where(F.col("path").endswith(".parquet")), "before")
    rows.where("bucket = 2").withColumn("o_totalprice", F.lit(0.0)).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    after = M.file_manifest(spark, path, content_hash=True).where(F.col("path").endswith(".parquet"))
    return M.manifest_diff(before, after).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS format, count(*) AS rows, sum(o_orderkey)::BIGINT AS order_sum, count(DISTINCT o_orderdate)::BIGINT AS dates, count(*) FILTER (WHERE o_custkey % 3 = 0) AS blank FROM orders" for k in ("csv", "json")))
def text_round_trips(spark, sf):
    """Records written as CSV and as JSON lines, nested and with missing values, and read back."""
    root = written_root(spark)
    rows = W.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    nested = nest_record(rows, ["day", "o_orderpriority"], "detail")
    write_csv(nested, f"{root}/csv", single=False)
    write_json_records(nested, f"{root}/json")
    kind = "struct<day:date,o_orderpriority:string>"
    back = {"csv": spark.read.option("header", True).option("escape", '"').schema("o_orderkey bigint, detail string").csv(f"{root}/csv").withColumn("detail", F.from_json("detail", kind)),
            "json": spark.read.schema(f"o_orderkey bigint, detail {kind}").json(f"{root}/json")}
    counted = [df.agg(F.lit(k).alias("format"), F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("order_sum"), F.count_distinct("detail.day").alias("dates"),
                      F.count_if(F.col("detail.o_orderpriority").isNull()).alias("blank")) for k, df in back.items()]
    return counted[0].unionByName(counted[1])


@query("""SELECT 'lineitem' AS problem_table, 'l_partkey: integers beyond exact precision, keep as text' AS problem FROM lineitem HAVING max(abs(l_partkey)) * 90071992547409 > 9007199254740992
UNION ALL SELECT 'lineitem', 'more rows than max_rows' FROM lineitem HAVING count(*) > 100""")
def export_refusals(spark, sf):
    # beyond 102,400 parts the product leaves 64 bits
    wide = F.col("l_partkey").cast("decimal(19,0)") * F.lit(90071992547409).cast("decimal(14,0)")
    df = W.table(spark, sf, "lineitem").select("l_orderkey", wide.alias("l_partkey"), "l_quantity")
    return X.export_problems(df, 100).select(F.lit("lineitem").alias("problem_table"), "problem")


@query("""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_totalprice AS DECIMAL(12,2))::VARCHAR AS price FROM orders""")
def coerced_orders(spark, sf):
    o = W.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("price"))
    out = CAT.coerce_schema(o, {"price": ("numeric", 12, 2), "customer_id": ("bigint",)})
    return out.withColumn("price", F.col("price").cast("string"))


KEYS = {"orders": ["o_orderkey"], "lineitem": LINE_KEY, "customer": ["c_nationkey"], "supplier": ["s_suppkey"], "labels": ["quality"]}


def _keys_sql(t: str, key: list[str]) -> str:
    k = ", ".join(key)
    return f"""SELECT '{t}' AS "table", '{','.join(key)}' AS declared_key, 0 AS null_key_rows, count(*) AS duplicate_key_groups, coalesce(sum(n), 0)::BIGINT AS rows_in_duplicate_keys,
count(*) FILTER (WHERE v > 1) AS conflicting_keys, coalesce(sum(n) FILTER (WHERE v > 1), 0)::BIGINT AS rows_in_conflicting_keys, coalesce(sum(n - v), 0)::BIGINT AS exact_duplicate_rows
FROM (SELECT {k}, sum(c) AS n, count(*) AS v FROM (SELECT *, count(*) AS c FROM {t} GROUP BY ALL) GROUP BY {k} HAVING sum(c) > 1)"""


def _inventory(spark, sf):
    tables = {n: W.table(spark, sf, n) for n in KEYS}
    return I.inventory(tables, KEYS, [{"name": "lines_to_orders", "left": "lineitem", "right": "orders", "left_on": ["l_orderkey"], "right_on": ["o_orderkey"]}],
                       ["o_custkey", "c_nationkey"])


@query(" UNION ALL ".join(_keys_sql(t, k) for t, k in KEYS.items()))
def inventory_keys(spark, sf):
    """Key checks of five whole tables as the inventory job reports them."""
    return _inventory(spark, sf).keys


@query(" UNION ALL ".join(f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS rows, count({c}) AS non_null, {f'count(DISTINCT {c})' if c in ('o_custkey', 'c_nationkey') else 'NULL'} AS distinct_values FROM {t}"""
                          for t, cols in {"orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
                                          "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
                                          "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
                                          "labels": "doc_id quality toxic"}.items() for c in cols.split()))
def inventory_columns(spark, sf):
    """Column profiles of the same tables."""
    return _inventory(spark, sf).columns.select("table", "column", "rows", "non_null", "distinct_values")


@query("""SELECT user_id, sum(c)::INTEGER AS run_no_total, count(*) AS runs FROM (SELECT 1 AS c, user_id FROM (
 SELECT user_id, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS b, d - row_number() OVER (PARTITION BY user_id, h ORDER BY d) AS r, h
 FROM (SELECT user_id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, bool_or(event_type = 'purchase') AS h FROM events GROUP BY ALL)) GROUP BY user_id, b, r, h) GROUP BY user_id""")
def event_day_runs(spark, sf):
    """Status runs over days: did the user buy on that day."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    obs = W.table(spark, sf, "events").groupBy("user_id", day.alias("day")).agg(F.max(F.col("event_type") == "purchase").alias("home"))
    r = S.status_runs(obs, ["user_id"], "day", "home")
    return r.groupBy("user_id").agg(F.max("run_no").alias("run_no_total"), F.count(F.lit(1)).alias("runs"))


