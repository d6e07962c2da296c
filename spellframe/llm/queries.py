"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, jaccard, licenses, main_text, pii, prefix_trie, quality, substring_dedup, tokenizer_alignment, toxicity, url_templates
from .common import read

WORD_SQL = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), ids=False)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(read(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.importance(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "log_weight", "gumbel_key", "kept")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels come from the document that a page shows, whose number is the last part of its path: bad if of low quality or toxic."""
    pages = read(spark, sf_dir, "pages")
    number = F.regexp_extract(url_templates.host_and_path(F.col("url"))[1], r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    labels = pages.select("page_id", number.try_cast("long").alias("doc_id")).join(read(spark, sf_dir, "labels"), "doc_id")
    return url_templates.url_verdicts(pages, labels.select("page_id", bad.alias("bad"))).select("page_id", "host", "path", "rule", "verdict", "purity")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment.align_documents(read(spark, sf_dir, "documents"))


def _phrases() -> str:
    return ", ".join(f"({t}, string_split('{' '.join(w)}', ' '), '{label}', {str(base).lower()}, {need}, {tells})" for t, label, base, _, need, tells, w in licenses.template_rows())


LICENSE_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORD_SQL} AS w FROM documents),
p AS (SELECT * FROM (VALUES {_phrases()}) AS t(template, words, label, base, need, tells)),
t AS (SELECT template, label, base, need, tells, len(words) - 1 AS grams, i - 1 AS t_pos, words[i] AS g0, words[i + 1] AS g1
      FROM p, unnest(range(1, len(words))) AS u(i)),
g AS MATERIALIZED (SELECT doc_id, i - 1 AS pos, w[i] AS g0, w[i + 1] AS g1 FROM d, unnest(range(1, len(w))) AS u(i)),
v AS MATERIALIZED (SELECT DISTINCT doc_id, template, label, base, need, tells, grams, t_pos, pos - t_pos AS diagonal FROM g JOIN t USING (g0, g1)),
dg AS (SELECT doc_id, template, label, base, need, tells, grams, diagonal, count(*) AS votes FROM v GROUP BY ALL),
b AS (SELECT doc_id, label, diagonal FROM dg WHERE base AND votes = grams),
s AS (SELECT dg.doc_id, dg.label, count(DISTINCT v.t_pos) / dg.grams AS share
      FROM dg JOIN v ON v.doc_id = dg.doc_id AND v.template = dg.template AND v.diagonal BETWEEN dg.diagonal AND dg.diagonal + {licenses.DRIFT} WHERE NOT dg.base
      GROUP BY dg.doc_id, dg.template, dg.label, dg.grams, dg.need, dg.tells, dg.diagonal HAVING count(DISTINCT v.t_pos) >= dg.need AND bool_or(v.t_pos = dg.tells)),
lab AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
        FROM (SELECT doc_id, label, 1.0::DOUBLE AS share FROM b UNION ALL SELECT * FROM s) GROUP BY doc_id),
bb AS (SELECT doc_id, count(*) AS n, min(diagonal) AS f, max(diagonal) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(bb.n, 0)::BIGINT AS n_base, bb.f::BIGINT AS first_word, bb.l::BIGINT AS last_word,
       coalesce(bb.labels, '') AS base_labels, coalesce(lab.labels, '') AS labels, coalesce(lab.score, 0)::DOUBLE AS score
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN lab USING (doc_id)
"""

DECONTAMINATION_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORD_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORD_SQL} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, w[i:i + 9] AS win FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(win) AS n FROM win),
place AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM place JOIN win USING (win)),
wd AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN wd USING (doc_id) LEFT JOIN it USING (doc_id)
"""

EXACT_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""


def _spans(kind: str, pattern: str) -> str:
    return f"""SELECT r, '{kind}' AS kind, i, m[i] AS value,
       list_sum(list_transform(b[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS stop
       FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS b FROM d), unnest(range(1, len(m) + 1)) AS u(i)"""


def _by_kind(values: dict) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


def _weighted(weights: list[int]) -> str:
    return f"list_sum(list_transform(range(1, {len(weights) + 1}), lambda k: digits[k]::INT * ({weights})[k]))"


# The base patterns as given.
PII_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS MATERIALIZED (
  {_spans('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+')} UNION ALL
  {_spans('ip', '[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)')} UNION ALL
  {_spans('card', '[0-9]([ -]?[0-9])+')} UNION ALL
  {_spans('phone', '[+][0-9][ ().0-9-]+[0-9]')} UNION ALL
  {' UNION ALL '.join(_spans(k, rf'\b(?:{v})\b') for k, v in pii.WORDS.items())}),
q AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits, replace(value, ' ', '') AS flat FROM p),
ok AS (SELECT r, kind, value, stop - length(value) AS start, stop FROM q WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda x: x::HUGEINT > 255)) = 0
  WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
       CASE WHEN k % 2 = 1 THEN digits[length(digits) - k + 1]::INT
            ELSE (digits[length(digits) - k + 1]::INT * 2) % 10 + (digits[length(digits) - k + 1]::INT * 2) // 10 END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  WHEN 'iban' THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(flat[5:] || flat[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE (ascii(c) - 55)::BIGINT END)),
       lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
  WHEN 'ssn' THEN digits[1:3] NOT IN ('000', '666') AND digits[1] <> '9' AND digits[4:5] <> '00' AND digits[6:9] <> '0000'
  WHEN 'nhs' THEN {_weighted([10, 9, 8, 7, 6, 5, 4, 3, 2, 1])} % 11 = 0
  ELSE {_weighted([3, 7, 1] * 3)} % 10 = 0 AND (digits[1:2]::INT BETWEEN 1 AND 12 OR digits[1:2]::INT BETWEEN 21 AND 32) END),
n AS (SELECT ok.*, translate(right(left(t, start::BIGINT), {pii.NEAR}) || chr(10) || substr(t, stop::BIGINT + 1, {pii.NEAR}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS near
  FROM ok JOIN d USING (r)),
s AS (SELECT r, kind, start, list_position({list(pii.PATTERNS)}, kind) AS k, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS span,
  least(1.0, {_by_kind(pii.START)} + CASE WHEN {' OR '.join(f"kind = '{k}' AND regexp_matches(near, '{v}')" for k, v in pii.CONTEXT.items())} THEN {pii.RISE} ELSE 0 END) AS score FROM n),
a AS (SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
  count(*) FILTER (kind = 'phone') AS n_phone, string_agg(span, ',' ORDER BY k, start) FILTER (k <= 4) AS base, string_agg(span, ',' ORDER BY k, start) AS spans,
  max(score) AS score FROM s WHERE k <= 4 OR score >= {pii.ACCEPT} GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)
"""

# The unsigned checksum of a decimal number, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""

TRIE_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(text, '') AS x, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(g ORDER BY turn NULLS FIRST, g) AS g, list(length(x) ORDER BY turn NULLS FIRST, g) AS n FROM t GROUP BY c),
h AS (SELECT c, g, n, c - c % 100 AS base, {CRC_SQL} % 6 AS h FROM l),
r AS MATERIALIZED (SELECT a.c, list_concat(coalesce(b.g[1:a.h], []), a.g[a.h + 1:]) AS g, list_concat(coalesce(b.n[1:a.h], []), a.n[a.h + 1:]) AS n FROM h AS a LEFT JOIN h AS b ON b.c = a.base),
m AS MATERIALIZED (SELECT c, d, sha256(array_to_string(g[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(g[1:d - 1], ',')) END AS p, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS n, d = len(g) AS here
  FROM r, unnest(range(0, len(g) + 1)) AS u(d)),
v AS MATERIALIZED (SELECT k, d, any_value(p) AS p, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (here), '')) AS ends_sha256
  FROM m GROUP BY k, d),
ch AS (SELECT p AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY p),
s AS (SELECT m.k, sum(v.saved) AS saved, count(*) FILTER (ch.k IS NULL) AS n_leaves FROM v LEFT JOIN ch USING (k) JOIN m ON m.c = v.conv_id AND m.d <= v.d GROUP BY m.k)
SELECT v.conv_id, v.d AS depth, q.conv_id AS parent_conv_id, v.n_convs, coalesce(ch.n_children, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM v LEFT JOIN v AS q ON q.k = v.p LEFT JOIN ch ON ch.k = v.k JOIN s ON s.k = v.k
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup, "op2_license_scan": op2_license_scan, "op3_decontamination": op3_decontamination, "op4_byte_bpe": op4_byte_bpe, "op5_pii": op5_pii,
    "op6_exact_dedup": op6_exact_dedup, "op7_toxicity": op7_toxicity, "op8_main_text": op8_main_text,
    "op9_quality": op9_quality, "op10_jaccard_join": op10_jaccard_join,
    "op11_prefix_trie": op11_prefix_trie, "op12_url_filter": op12_url_filter, "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
ORACLE = {"op2_license_scan": LICENSE_SQL, "op3_decontamination": DECONTAMINATION_SQL, "op5_pii": PII_SQL, "op6_exact_dedup": EXACT_SQL, "op11_prefix_trie": TRIE_SQL}
