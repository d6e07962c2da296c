"""Registered queries: sampling, text and language."""

from __future__ import annotations

from pyspark.sql import functions as F

from spellframe.functions import fixed_values as V
from spellframe.functions import taxonomy_counts
from spellframe.operators import language as G
from spellframe.operators import quality as Q
from spellframe.operators import sampling as S
from spellframe.operators import text as X
from spellframe.plans import migration as M
from spellframe.session import stage
from workload import history as H
from workload import orders_as_spells as W
from workload.oracle import category_sql, history, norm_sql, rule_ids_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
LANGS = ["en", "es", "fr", "de"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f
    return register


def docs(spark, sf):
    return W.table(spark, sf, "documents")


# --- sampling ----------------------------------------------------------------------------
@query("""SELECT doc_id, sha256('spell:' || doc_id) AS sample_hash, row_number() OVER (ORDER BY sha256('spell:' || doc_id), doc_id) AS sample_rank
FROM documents QUALIFY sample_rank <= 100""")
def hash_sample(spark, sf):
    return S.hash_sample(docs(spark, sf), "doc_id", "spell", 100)


@query("""WITH s AS (SELECT doc_id FROM documents ORDER BY sha256('spell:' || doc_id), doc_id LIMIT 100)
SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS population, count(*) AS selected,
 sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS selected_ids_sha256 FROM s""")
def sample_record(spark, sf):
    d = docs(spark, sf)
    return S.sample_record(d, "doc_id", S.hash_sample(d, "doc_id", "spell", 100))


@query("SELECT doc_id, source FROM documents ORDER BY substr(sha256('7:' || doc_id), 1, 13) LIMIT 60")
def pilot_sample(spark, sf):
    d = docs(spark, sf).select("doc_id", "source")
    return S.pilot_sample(d, 60, 7, F.col("doc_id")).drop("pilot_priority")


@query("""WITH b AS (SELECT source, sum(n_chars)::BIGINT AS bytes, count(*) AS n FROM documents GROUP BY source)
SELECT CAST(ceil(round(1000000 * sum(bytes) / sum(n), 6)) AS BIGINT) AS expected_bytes,
 CAST(ceil(round(greatest(1000000 * sum(bytes) / sum(n), 1000000 * max(bytes / n)) * 1.3::DOUBLE, 6)) AS BIGINT) AS planning_bytes,
 sum(bytes)::BIGINT AS retained_pilot_bytes FROM b""")
def storage_projection(spark, sf):
    blocks = docs(spark, sf).groupBy("source").agg(F.sum("n_chars").alias("bytes"), F.count(F.lit(1)).alias("block_rows"))
    return S.storage_projection(blocks, 1_000_000)


ACCEPT = """WITH w AS (SELECT doc_id, sha256('11:' || doc_id) AS k, lang = 'fr' AND length(text) > 300 AS ok,
 CASE WHEN lang <> 'fr' THEN 'other_language' ELSE 'too_short' END AS reason FROM documents),
c AS (SELECT k FROM w WHERE ok ORDER BY k LIMIT 25)
"""


def _accept(spark, sf):
    ok = (F.col("lang") == "fr") & (F.length("text") > 300)
    reason = F.when(F.col("lang") != "fr", "other_language").otherwise("too_short")
    return S.accept_first_n(docs(spark, sf).select("doc_id", "lang", "text"), ok, reason, 25, "doc_id", 11)


@query(ACCEPT + "SELECT doc_id, k AS order_key FROM w WHERE ok AND k <= (SELECT max(k) FROM c)")
def accept_first_n(spark, sf):
    return _accept(spark, sf)[0].select("doc_id", "order_key")


@query(ACCEPT + """SELECT CASE WHEN ok THEN 'accepted' ELSE reason END AS outcome, count(*) AS candidates, true AS complete FROM w
WHERE k <= (SELECT max(k) FROM c) GROUP BY 1""")
def accept_audit(spark, sf):
    return _accept(spark, sf)[1]


PICK = """WITH u AS (SELECT text, arg_min(lang, doc_id) AS lang, min(doc_id) AS doc_id FROM documents GROUP BY text),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS pick, count(*) OVER (PARTITION BY lang) AS pool FROM u),
q(lang, wanted) AS (VALUES ('en', 4), ('fr', 2), ('de', 2), ('xx', 1))
"""
QUOTA = {"en": 4, "fr": 2, "de": 2, "xx": 1}


@query(PICK + "SELECT doc_id, r.lang, pick FROM r JOIN q ON q.lang = r.lang WHERE pick <= wanted AND pool >= wanted")
def stratified_pick(spark, sf):
    d = docs(spark, sf).select("doc_id", "text", "lang")
    return S.stratified_pick(d, "doc_id", "text", "lang", QUOTA, 42)[0].select("doc_id", "lang", "pick")


@query(PICK + "SELECT q.lang, wanted, count(r.doc_id) AS pool, count(r.doc_id) < wanted AS missing FROM q LEFT JOIN r ON r.lang = q.lang GROUP BY q.lang, wanted")
def stratum_report(spark, sf):
    d = docs(spark, sf).select("doc_id", "text", "lang")
    return S.stratified_pick(d, "doc_id", "text", "lang", QUOTA, 42)[1]


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('5:' || c_custkey), c_custkey) - 1 AS p, count(*) OVER () AS n FROM customer),
x AS (SELECT *, n // 3 AS e, n - 2 * (n // 3) AS s FROM r)
SELECT c_custkey, g AS group_no, p < s AS shared, CASE WHEN p < s THEN p + 1 ELSE s + (p - s) % e + 1 END AS position
FROM x, (VALUES (0), (1)) v(g) WHERE p < s OR (p - s) // e = g""")
def overlap_groups(spark, sf):
    """All customers: a shared third and one exclusive third per group."""
    ids = W.table(spark, sf, "customer").select("c_custkey")
    n = ids.count()
    each = n // 3
    return S.overlap_groups(ids, "c_custkey", 5, n - 2 * each, each).select("c_custkey", "group_no", "shared", "position")


@query("""WITH l AS (SELECT max(CAST(ts AS DATE)) AS d FROM events), w AS (SELECT i, off, j, hint, types FROM
 (VALUES (0, 0), (1, 7), (2, 30), (3, 90)) a(i, off), (VALUES (0, 'buy', ['purchase', 'signup']), (1, 'look', ['view'])) b(j, hint, types)),
r AS (SELECT event_id, hint, off AS days_back, i * 2 + j AS slot, row_number() OVER (PARTITION BY i, j ORDER BY ts DESC, event_id) AS window_rank
 FROM events, l JOIN w ON true WHERE CAST(ts AS DATE) BETWEEN d - CAST(off + 6 AS INTEGER) AND d - CAST(off AS INTEGER) AND list_contains(types, event_type))
SELECT event_id, hint, days_back, window_rank FROM (SELECT * FROM r WHERE window_rank <= 40 ORDER BY slot, window_rank LIMIT 130)""")
def windowed_candidates(spark, sf):
    e = W.table(spark, sf, "events").select("event_id", "ts", "event_type")
    out = S.windowed_candidates(e, "ts", "event_type", {"buy": ["purchase", "signup"], "look": ["view"]}, 40, 130, "event_id")
    return out.select("event_id", "hint", "days_back", "window_rank")


@query("""WITH p AS (SELECT conv_id, turn, text FROM conversations WHERE regexp_matches(text, '\\S') ORDER BY conv_id, turn LIMIT 50)
SELECT conv_id AS id, turn, lang FROM p LEFT JOIN documents ON doc_id = conv_id""")
def bounded_preview(spark, sf):
    raw = W.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("id"), "turn", "text", "conv_id")
    side = docs(spark, sf).select(F.col("doc_id").alias("id"), "lang")
    out = S.bounded_preview(raw, side, F.col("text").rlike(r"\S"), "id", 50, ["conv_id", "turn"])
    return out.select(F.col("conv_id").alias("id"), "turn", "lang")


POOL = """WITH c AS (SELECT doc_id // 3 AS id, lang, source FROM documents UNION ALL SELECT doc_id // 3, lang, source FROM documents WHERE lang = 'fr'),
v AS (SELECT id, count(DISTINCT (lang, source)) AS n FROM c GROUP BY id)
"""


@query(POOL + "SELECT DISTINCT id, lang, source FROM c JOIN v USING (id) WHERE n = 1")
def candidate_pool(spark, sf):
    d = docs(spark, sf).select(F.floor(F.col("doc_id") / 3).alias("id"), "lang", "source")
    return S.candidate_pool(d.unionByName(d.where("lang = 'fr'")), "id", ["lang", "source"]).kept


@query(history(""", s AS (SELECT user_id, sha256('sample:' || user_id) AS h, row_number() OVER (ORDER BY sha256('sample:' || user_id), user_id) AS sample_rank
 FROM (SELECT DISTINCT user_id FROM panel WHERE end_rule = 'carry_to_cutoff') QUALIFY sample_rank <= 60),
b AS (SELECT user_id, end_rule, min(qidx) AS lo, max(qidx) AS hi FROM panel SEMI JOIN s USING (user_id) GROUP BY ALL),
g AS (SELECT user_id, end_rule, unnest(generate_series(lo, hi)) AS qidx FROM b),
f AS (SELECT user_id, end_rule, event_q AS qidx,
 max(CASE WHEN kind = 'gap' THEN 'gap_' || direction ELSE direction END) FILTER (WHERE spec = 'position_only' AND persistence_quarters = 1) AS transition_position_only_k1,
 max(CASE WHEN kind = 'gap' THEN 'gap_' || direction ELSE direction END) FILTER (WHERE spec <> 'position_only' AND persistence_quarters = 2) AS transition_fallback_k2 FROM moves GROUP BY ALL)
SELECT sample_rank, user_id, end_rule, qidx, coalesce(obs_type, 'unobserved_gap') AS obs_type, loc_fb AS loc_country_fallback, transition_position_only_k1, transition_fallback_k2
FROM g JOIN s USING (user_id) LEFT JOIN panel USING (user_id, end_rule, qidx) LEFT JOIN f USING (user_id, end_rule, qidx)"""))
def history_sample(spark, sf):
    p = H.panel(spark, sf, keep=True)
    moves = M.migration(p, H.CFG).transitions
    out = M.history_sample(p, moves, H.CFG, "sample", 60)
    return out.select("sample_rank", "user_id", "end_rule", "qidx", "obs_type", "loc_country_fallback", "transition_position_only_k1", "transition_fallback_k2")


# --- titles ------------------------------------------------------------------------------
WORDS = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"""SELECT cat AS category, count(*) AS lines, sum(len(ids))::BIGINT AS rules FROM (SELECT {category_sql('n')} AS cat, CASE WHEN n IS NULL THEN [] ELSE {rule_ids_sql('n')} END AS ids
FROM (SELECT {norm_sql('line')} AS n FROM (SELECT line || CASE doc_id % 5 WHEN 0 THEN ' Board Member' WHEN 1 THEN ' part time' WHEN 2 THEN ' 非执行 trustee services' ELSE '' END AS line FROM {WORDS}))) GROUP BY cat""")
def taxonomy_match_lines(spark, sf):
    """Every line of every document through the taxonomy."""
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, " Board Member").when(k == 1, " part time").when(k == 2, " 非执行 trustee services").otherwise("")
    lines = docs(spark, sf).select(F.explode(F.split("text", "\n")).alias("line"), tail.alias("tail"))
    return taxonomy_counts(lines, F.concat("line", "tail"), V.TITLE_TAXONOMY).withColumnRenamed("texts", "lines")


# --- text --------------------------------------------------------------------------------
@query()
def pages_text(spark, sf):
    """Every page cleaned to safe markup and text."""
    return X.clean_html(W.table(spark, sf, "pages"), "html").select("page_id", "clean_html", "clean_text")


@query()
def cleaned_text_contained(spark, sf):
    """The safe markup, cleaned once more, must show all letters and digits of the text."""
    once = X.clean_html(W.table(spark, sf, "pages").select("page_id", "html"), "html")
    marked = once.select("page_id", "clean_text", F.concat(F.lit("<p>"), "clean_html", F.lit("</p>")).alias("shown"))
    again = X.clean_html(marked, "shown", "again_html", "again_text")
    return again.select("page_id", X.text_contained("clean_text", "again_text").alias("contained"))


def extraction(spark, sf):
    """Quotes cut from the documents; some altered, some too long, some ids twice."""
    d = docs(spark, sf)
    k = F.col("doc_id")
    quote = F.when(k % 6 == 0, F.concat(F.substring("text", 1, 20), F.lit("#~"))).when(k % 7 == 0, F.substring("text", 1, 300)).otherwise(F.substring("text", 3, 25))
    item = F.struct(F.when(k % 10 == 9, " ").otherwise("skill").alias("english"), quote.alias("quote"))
    res = d.select(k.cast("string").alias("record_id"), F.array(F.when(k % 8 == 0, "French").otherwise("English")).alias("detected_languages"),
                   F.when(k % 9 == 0, "unreadable").when(k % 11 == 0, "bad").otherwise("readable").alias("reading_status"),
                   F.when(k % 18 == 0, "scan").otherwise("").alias("reading_note"), F.array(item).alias("skills"),
                   F.array().cast("array<struct<english:string,quote:string>>").alias("education_requirements"))
    res = res.unionByName(res.where(F.col("record_id").endswith("77"))).withColumn(
        "record_id", F.when(F.col("record_id").endswith("55"), F.concat(F.lit("x"), "record_id")).otherwise(F.col("record_id")))
    sources = d.select(k.cast("string").alias("record_id"), F.col("text").alias("description"))
    languages = d.select(k.cast("string").alias("record_id"), F.array(F.lit("English")).alias("languages"))
    return res, sources, languages


EVIDENCE = """WITH b AS (SELECT doc_id AS k, CAST(doc_id AS VARCHAR) AS id0, text,
 CASE WHEN doc_id % 6 = 0 THEN substr(text, 1, 20) || '#~' WHEN doc_id % 7 = 0 THEN substr(text, 1, 300) ELSE substr(text, 3, 25) END AS quote,
 CASE WHEN doc_id % 10 = 9 THEN ' ' ELSE 'skill' END AS english, CASE WHEN doc_id % 8 = 0 THEN 'French' ELSE 'English' END AS lang,
 CASE WHEN doc_id % 9 = 0 THEN 'unreadable' WHEN doc_id % 11 = 0 THEN 'bad' ELSE 'readable' END AS st, CASE WHEN doc_id % 18 = 0 THEN 'scan' ELSE '' END AS note FROM documents),
r AS (SELECT *, CASE WHEN id0 LIKE '%55' THEN 'x' || id0 ELSE id0 END AS record_id FROM (SELECT * FROM b UNION ALL SELECT * FROM b WHERE id0 LIKE '%77')),
e AS (SELECT record_id, CASE WHEN record_id LIKE 'x%' OR count(*) OVER (PARTITION BY record_id) > 1 THEN ['unexpected or duplicate id']
 WHEN st = 'bad' OR length(quote) > 240 OR length(quote) < 1 THEN list_filter([CASE WHEN st = 'bad' THEN 'reading_status' END,
   CASE WHEN length(quote) > 240 OR length(quote) < 1 THEN 'skills: malformed item' END], lambda x: x IS NOT NULL)
 ELSE list_filter([CASE WHEN lang <> 'English' THEN 'languages differ from the source' END, CASE WHEN st <> 'readable' AND note = '' THEN 'unreadable text needs an explanation' END,
   CASE WHEN st = 'unreadable' THEN 'unreadable record with extracted items' END,
   CASE WHEN trim(english) = '' OR NOT regexp_matches(quote, '\\S') OR NOT contains(text, quote) THEN 'skills: missing or fabricated evidence' END], lambda x: x IS NOT NULL) END AS errs FROM r)
"""


@query(EVIDENCE + "SELECT record_id, array_to_string(errs, '; ') AS errors FROM e WHERE len(errs) > 0")
def evidence_failures(spark, sf):
    _, failures, _ = X.audit_evidence(*extraction(spark, sf))
    return failures.select("record_id", F.array_join("errors", "; ").alias("errors"))


@query(EVIDENCE + "SELECT 'valid' AS outcome, count(*) AS records FROM e WHERE len(errs) = 0 UNION ALL SELECT 'missing', count(*) FROM b WHERE id0 NOT IN (SELECT record_id FROM e WHERE len(errs) = 0)")
def evidence_outcome(spark, sf):
    valid, _, missing = X.audit_evidence(*extraction(spark, sf))
    return valid.agg(F.lit("valid").alias("outcome"), F.count(F.lit(1)).alias("records")).unionByName(
        missing.agg(F.lit("missing").alias("outcome"), F.count(F.lit(1)).alias("records")))


@query("""SELECT CASE WHEN doc_id % 31 = 5 THEN 'y' ELSE '' END || doc_id AS record_id, 'settings' AS problem FROM documents WHERE doc_id % 20 = 3
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'changed text' FROM documents WHERE doc_id % 15 = 4 AND doc_id % 31 <> 5
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'id not sent' FROM documents WHERE doc_id % 31 = 5
UNION ALL SELECT 'y' || doc_id, 'unknown id' FROM documents WHERE doc_id % 31 = 5
UNION ALL SELECT 'y' || doc_id, 'id sent too often or unknown' FROM documents WHERE doc_id % 31 = 5""")
def request_problems(spark, sf):
    d, k = docs(spark, sf), F.col("doc_id")
    ident = F.when(k % 31 == 5, F.concat(F.lit("y"), k.cast("string"))).otherwise(k.cast("string"))
    text = F.when(k % 15 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    record = F.to_json(F.array(F.struct(ident.alias("record_id"), F.lit("t").alias("title"), text.alias("description"))))
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.lit(0.7).alias("temperature"), F.lit("none").alias("reasoning_effort"),
                              F.when(k % 20 == 3, 10).otherwise(3000).alias("max_tokens"),
                              F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")),
                                      F.struct(F.lit("user").alias("role"), F.concat(F.lit("Extract:\n"), record).alias("content"))).alias("messages")))
    sources = d.select(k.cast("string").alias("record_id"), F.col("text").alias("description"), F.lit("t").alias("title"))
    return X.request_audit(d.select(body.alias("body")), sources, "m")


@query("""SELECT doc_id AS key, CASE WHEN doc_id % 14 = 2 THEN 'missing' ELSE 'changed' END AS status FROM documents WHERE doc_id % 9 = 1 OR doc_id % 14 = 2
UNION ALL SELECT doc_id + 1000000, 'unexpected' FROM documents WHERE doc_id % 14 = 2""")
def export_differences(spark, sf):
    d, k = docs(spark, sf).select("doc_id", "text", "lang"), F.col("doc_id")
    exported = d.select(F.when(k % 14 == 2, k + 1_000_000).otherwise(k).alias("doc_id"), "text",
                        F.when(k % 9 == 1, F.lit(None)).otherwise(F.col("lang")).alias("lang"))
    return X.export_audit(exported, d, "doc_id")


@query("""WITH d AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN '软件开发' WHEN 1 THEN '軟體開發' WHEN 2 THEN '软体軟發' WHEN 3 THEN '软' ELSE '' END AS t FROM documents),
c AS (SELECT doc_id, len(list_distinct(string_split(regexp_replace(t, '[^软开发国]', '', 'g'), ''))) - CASE WHEN regexp_matches(t, '[软开发国]') THEN 0 ELSE 1 END AS s,
 len(list_distinct(string_split(regexp_replace(t, '[^軟開發國體]', '', 'g'), ''))) - CASE WHEN regexp_matches(t, '[軟開發國體]') THEN 0 ELSE 1 END AS tr FROM d)
SELECT doc_id, CASE WHEN s >= 2 AND tr = 0 THEN 'simplified' WHEN tr >= 2 AND s = 0 THEN 'traditional' END AS script FROM c""")
def script_variants(spark, sf):
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, "软件开发").when(k == 1, "軟體開發").when(k == 2, "软体軟發").when(k == 3, "软").otherwise("")
    return docs(spark, sf).select("doc_id", G.script_variant(F.concat("text", tail), "软开发国", "軟開發國體").alias("script"))


# --- language ----------------------------------------------------------------------------
NAMES = {"en": "English", "fr": "French", "es": "Spanish", "de": "Chinese"}


def given_spans(spark, sf):
    k, n = F.col("doc_id"), F.length("text")
    half = F.floor(n / 2)
    main = F.coalesce(*[F.when(F.col("lang") == a, b) for a, b in NAMES.items()])
    other = F.when(k % 3 == 0, main).when(k % 3 == 1, "English").otherwise("Chinese")
    spans = F.array(
        F.struct(F.lit(0).cast("bigint").alias("start"), half.alias("end"), main.alias("language"), (half - k % 7).alias("letters"),
                 (F.lit(0.5) + (k % 50) / F.lit(100.0)).alias("confidence"), ((k % 5) / F.lit(20.0)).alias("second")),
        F.struct(half.alias("start"), n.cast("bigint").alias("end"), other.alias("language"), (n - half - k % 5).alias("letters"),
                 (F.lit(0.55) + (k % 40) / F.lit(100.0)).alias("confidence"), F.lit(0.1).alias("second")))
    return docs(spark, sf).select("doc_id", F.inline(spans))


def span_documents(spark, sf):
    k = F.col("doc_id") % 4
    return docs(spark, sf).select("doc_id", "text", G.letters("text").alias("letters"),
                                  F.when(k == 0, "simplified").when(k == 1, "traditional").alias("chinese_script"))


SPANS = """WITH d AS (SELECT doc_id AS k, text, length(text) AS n, length(text) // 2 AS h, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE 'Chinese' END AS m FROM documents),
sp AS (SELECT k, 0 AS s, h AS e, m AS language, h - k % 7 AS letters, 0.5::DOUBLE + (k % 50) / 100.0::DOUBLE AS conf, (k % 5) / 20.0::DOUBLE AS second FROM d
 UNION ALL SELECT k, h, n, CASE k % 3 WHEN 0 THEN m WHEN 1 THEN 'English' ELSE 'Chinese' END, n - h - k % 5, 0.55::DOUBLE + (k % 40) / 100.0::DOUBLE, 0.1::DOUBLE FROM d),
ok AS (SELECT * FROM sp WHERE letters > 0 AND conf >= 0.6::DOUBLE AND conf - second >= 0.2::DOUBLE),
mg AS (SELECT a.k, a.s AS start, coalesce(b.e, a.e) AS "end", a.language, a.letters + coalesce(b.letters, 0) AS letters, least(a.conf, coalesce(b.conf, 9)) AS confidence,
  least(a.conf - a.second, coalesce(b.conf - b.second, 9)) AS margin
 FROM ok a LEFT JOIN ok b ON b.k = a.k AND b.s = a.e AND b.s > a.s AND b.language = a.language
 WHERE NOT EXISTS (SELECT 1 FROM ok p WHERE p.k = a.k AND p.e = a.s AND p.s < a.s AND p.language = a.language)),
tot AS (SELECT k, text, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS total, CASE k % 4 WHEN 0 THEN 'simplified' WHEN 1 THEN 'traditional' END AS script FROM d),
ln AS (SELECT k, language, sum(letters) AS l FROM mg WHERE letters >= 40 GROUP BY ALL),
gr AS (SELECT tot.*, coalesce((SELECT l FROM ln WHERE ln.k = tot.k AND language = 'English'), 0) AS en, coalesce((SELECT l FROM ln WHERE ln.k = tot.k AND language = 'Chinese'), 0) AS zh,
 (SELECT language FROM ln WHERE ln.k = tot.k AND l / total >= 0.85 ORDER BY list_position(['English', 'Chinese', 'Spanish', 'French'], language) LIMIT 1) AS one,
 (SELECT count(*) FROM mg WHERE mg.k = tot.k AND mg.letters >= 40 AND language <> 'English') AS other FROM tot),
cl AS (SELECT k, text, other, CASE WHEN total = 0 THEN NULL WHEN en >= 100 AND zh >= 60 AND least(en, zh) / total >= 0.15 AND (en + zh) / total >= 0.85 THEN CASE WHEN script IS NOT NULL THEN 'Chinese/English' END
 WHEN one = 'Chinese' AND script IS NULL THEN NULL ELSE one END AS g, total FROM gr)
"""


# --- spans of the trained model; German stands in for Chinese, with capital letters for the characters of one script only
ALPHABETS = ("ÄÖ", "Üß")
MODEL_NAMES = {"en": "English", "fr": "French", "es": "Spanish", "de": "Chinese"}


def model_spans_of(spark, sf):
    named = F.coalesce(*[F.when(F.col("language") == a, b) for a, b in MODEL_NAMES.items()])
    spans = G.score_passages(docs(spark, sf), "doc_id", "text", profiles(spark, sf), LANGS, ALPHABETS)
    return G.merge_spans(spans.withColumn("language", named), "doc_id")


def all_letters(spark, sf):
    return docs(spark, sf).select("doc_id", "text", G.letters("text").alias("letters"))


@query(SPANS + "SELECT k AS doc_id, start, \"end\", language, letters, confidence, margin FROM mg")
def merged_spans(spark, sf):
    return G.merge_spans(given_spans(spark, sf), "doc_id")


@query(SPANS + "SELECT k AS doc_id, g AS language_group, total AS letters, other AS other_passages FROM cl")
def language_groups(spark, sf):
    out = G.classify_language(G.merge_spans(given_spans(spark, sf), "doc_id"), span_documents(spark, sf), "doc_id")
    return out.select("doc_id", "language_group", "letters", "other_passages")


@query(SPANS + """SELECT k AS doc_id, coalesce(g = 'English', false) AND other = 0 AS accepted,
CASE WHEN NOT regexp_matches(text, '\\S') THEN 'empty_description' WHEN g = 'English' AND other = 0 THEN 'english' ELSE 'non_english_mixed_or_uncertain' END AS reason FROM cl""")
def english_screen(spark, sf):
    d = span_documents(spark, sf)
    out = G.classify_language(G.merge_spans(given_spans(spark, sf), "doc_id"), d, "doc_id")
    return G.english_screen(out, d, "doc_id", "text")


def profiles(spark, sf):
    return stage(G.language_profiles(docs(spark, sf), "text", "lang", LANGS), "profiles")


MODEL = f"""WITH pl AS (SELECT doc_id, source, lang, regexp_extract_all(text, '{G.PASSAGE}') AS l FROM documents),
pc AS (SELECT doc_id, source, lang, pos, l[pos] AS p FROM (SELECT *, unnest(generate_series(1, len(l))) AS pos FROM pl)),
px AS (SELECT *, ' ' || trim(regexp_replace(lower(p), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS x FROM pc),
gr AS (SELECT doc_id, source, lang, pos, substr(x, i, 3) AS gram FROM (SELECT *, unnest(generate_series(1, length(x) - 2)) AS i FROM px)),
ct AS (SELECT gram, count(*) AS n, [count(*) FILTER (WHERE lang = 'en'), count(*) FILTER (WHERE lang = 'es'), count(*) FILTER (WHERE lang = 'fr'), count(*) FILTER (WHERE lang = 'de')] AS c
 FROM gr GROUP BY gram),
lp AS (SELECT gram, list_transform([1, 2, 3, 4], lambda i: ln((c[i] + 0.5::DOUBLE) / (t[i] + 0.5::DOUBLE * v))) AS logp
 FROM ct, (SELECT [sum(c[1]), sum(c[2]), sum(c[3]), sum(c[4])]::BIGINT[] AS t, count(*) AS v FROM ct))
"""
TOP2 = """, t2 AS (SELECT *, list_reverse_sort(list_transform([1, 2, 3, 4], lambda i: {'w': exp(s[i] - list_max(s)), 'l': ['en', 'es', 'fr', 'de'][i]})) AS r FROM sc),
tt AS (SELECT *, r[1].l AS language, r[1].w / list_sum([x.w for x in r]) AS confidence, r[2].w / list_sum([x.w for x in r]) AS second FROM t2)
"""
SUMS = "[sum(logp[1]), sum(logp[2]), sum(logp[3]), sum(logp[4])] AS s"


@query(MODEL + "SELECT gram, unnest(['en', 'es', 'fr', 'de']) AS language, round(unnest(logp), 6) AS logp FROM lp")
def language_profiles(spark, sf):
    p = G.language_profiles(docs(spark, sf), "text", "lang", LANGS)
    return p.select("gram", F.inline(F.arrays_zip(F.array(*[F.lit(v) for v in LANGS]).alias("language"), "logp"))).select(
        "gram", "language", F.round("logp", 6).alias("logp"))


@query(MODEL + f""", sc AS (SELECT doc_id, pos, {SUMS} FROM gr JOIN lp USING (gram) GROUP BY doc_id, pos){TOP2}
, ln AS (SELECT doc_id, pos, length(p) AS n, length(regexp_replace(p, '[^\\p{{L}}]', '', 'g')) AS letters, (sum(length(p)) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS e FROM pc)
SELECT doc_id, e - n AS start, e AS "end", letters, language, round(confidence, 5) AS confidence, round(second, 5) AS second FROM tt JOIN ln USING (doc_id, pos)""")
def language_scores(spark, sf):
    """Spans of every document scored by the trained model."""
    out = G.score_passages(docs(spark, sf), "doc_id", "text", profiles(spark, sf), LANGS)
    return out.withColumns({c: F.round(c, 5) for c in ("confidence", "second")})


@query(MODEL + f""", sc AS (SELECT doc_id, source, {SUMS} FROM gr JOIN lp USING (gram) GROUP BY doc_id, source){TOP2}
, dm AS (SELECT d.doc_id, d.source, CASE WHEN length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 40 AND confidence >= 0.6 AND confidence - second >= 0.2 THEN language ELSE 'uncertain' END AS language
 FROM documents d LEFT JOIN tt USING (doc_id))
SELECT source, language, count(*) AS documents, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM dm GROUP BY source, language""")
def language_shares(spark, sf):
    """Dominant language per document, share per source."""
    d = docs(spark, sf)
    dom = G.dominant_language(d, "doc_id", "text", profiles(spark, sf), LANGS).join(d.select("doc_id", "source"), "doc_id")
    return G.language_share(dom, "source")


MODEL_SPANS = MODEL + f""", sc AS (SELECT doc_id, pos, {SUMS} FROM gr JOIN lp USING (gram) GROUP BY doc_id, pos){TOP2}
, pe AS (SELECT doc_id, pos, p, length(p) AS n, length(regexp_replace(p, '[^\\p{{L}}]', '', 'g')) AS letters, (sum(length(p)) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS e FROM pc),
ok AS (SELECT doc_id AS k, e - n AS s, e, letters, p, CASE language WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE 'Chinese' END AS language, confidence AS conf, second
 FROM tt JOIN pe USING (doc_id, pos) WHERE letters > 0 AND confidence >= 0.6::DOUBLE AND confidence - second >= 0.2::DOUBLE),
i1 AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(language) OVER w = language THEN 0 ELSE 1 END AS new FROM ok WINDOW w AS (PARTITION BY k ORDER BY s)),
i2 AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s) AS island FROM i1),
mg AS (SELECT k, language, min(s) AS start, max(e) AS "end", sum(letters)::BIGINT AS letters, min(conf) AS confidence, min(conf - second) AS margin, string_agg(p, '' ORDER BY s) AS p FROM i2 GROUP BY k, island, language),
zt AS (SELECT k, string_agg(p, '') AS z FROM mg WHERE letters >= 40 AND language = 'Chinese' GROUP BY k),
zc AS (SELECT k, len(list_distinct(list_filter(string_split(z, ''), lambda c: c IN ('Ä', 'Ö')))) AS a, len(list_distinct(list_filter(string_split(z, ''), lambda c: c IN ('Ü', 'ß')))) AS b FROM zt),
tot AS (SELECT doc_id AS k, text, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS total, CASE WHEN a >= 2 AND b = 0 THEN 'simplified' WHEN b >= 2 AND a = 0 THEN 'traditional' END AS script
 FROM documents LEFT JOIN zc ON k = doc_id),
""" + SPANS[SPANS.index("ln AS ("):].replace("gr AS (SELECT tot", "gt AS (SELECT tot").replace("FROM gr)", "FROM gt)")


@query(MODEL_SPANS + "SELECT k AS doc_id, start, \"end\", language, letters, round(confidence, 5) AS confidence, round(margin, 5) AS margin FROM mg")
def model_spans(spark, sf):
    """Confident spans of every document, as the trained model finds them."""
    out = model_spans_of(spark, sf).drop("simplified", "traditional")
    return out.withColumns({c: F.round(c, 5) for c in ("confidence", "margin")})


@query(MODEL_SPANS + "SELECT k AS doc_id, g AS language_group, total AS letters, other AS other_passages, script AS chinese_script FROM cl JOIN (SELECT k, script FROM tot) USING (k)")
def model_language_groups(spark, sf):
    """Spans, scripts and groups from the text alone."""
    out = G.classify_language(model_spans_of(spark, sf), all_letters(spark, sf), "doc_id")
    return out.select("doc_id", "language_group", "letters", "other_passages", "chinese_script")


@query(MODEL_SPANS + "SELECT k AS doc_id, language, sum(letters)::BIGINT AS letters FROM mg WHERE letters >= 40 GROUP BY ALL")
def language_letters(spark, sf):
    return G.language_letters(model_spans_of(spark, sf), "doc_id")


@query(MODEL_SPANS + """SELECT k AS doc_id, coalesce(g = 'English', false) AND other = 0 AS accepted,
CASE WHEN NOT regexp_matches(text, '\\S') THEN 'empty_description' WHEN g = 'English' AND other = 0 THEN 'english' ELSE 'non_english_mixed_or_uncertain' END AS reason FROM cl""")
def model_english_screen(spark, sf):
    d = all_letters(spark, sf)
    return G.english_screen(G.classify_language(model_spans_of(spark, sf), d, "doc_id"), d, "doc_id", "text")


@query("""SELECT doc_id, sum(length(p))::BIGINT AS chars FROM (SELECT doc_id, text AS p FROM documents) GROUP BY doc_id HAVING sum(length(p)) > 0""")
def passages_cover_text(spark, sf):
    """The passages of a document together are its whole text."""
    return G.passages(docs(spark, sf), "doc_id", "text").groupBy("doc_id").agg(F.sum(F.length("passage")).alias("chars"))


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 3 = 1 THEN 'b' ELSE '' END AS title FROM documents")
def titled_records(spark, sf):
    k = F.col("doc_id")
    d = docs(spark, sf).select("doc_id", k.cast("string").alias("id"), "text", F.when(k % 3 == 0, "a").otherwise("").alias("t1"), F.when(k % 3 == 1, "b").alias("t2"))
    return Q.checked_records(d, "id", "text", ["t1", "t2"])[0].select("doc_id", "id", "title")
