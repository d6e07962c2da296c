"""Posting text: HTML clean-up, containment, evidence and export audits.

Only HTML parsing and Unicode compatibility folding need Python; both are Arrow-batched
pandas UDFs over one text column.  Everything else stays in the JVM.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from .skew import dealt, find_sized, salted_join

# A page is read into pieces: (OPEN, tag), (CLOSE, tag) and (TEXT, characters).  What a tag leaves behind stands in two tables.
OPEN, CLOSE, TEXT = "<", "</", ""
_ENDS_OF_DROPPED = {(OPEN, tag): (CLOSE, tag) for tag in V.HTML_DROPPED}
_MARKUP = {(kind, tag): f"{kind}{tag}>" for kind in (OPEN, CLOSE) for tag in V.HTML_KEPT if kind == OPEN or tag not in V.HTML_VOID}
_PLAIN = {(kind, tag): "\n" for kind in (OPEN, CLOSE) for tag in V.HTML_LINE_BREAKING}
_has_tags = re.compile(V.HTML_TELLTALE, re.IGNORECASE).search
_SPACING = [(re.compile(pattern), new) for pattern, new in V.HTML_SPACING]


class _Pieces(HTMLParser):
    """The pieces of a page in order."""

    def __init__(self, page: str):
        super().__init__()
        self.found: list[tuple[str, str]] = []
        self.feed(page)
        self.close()

    def handle_data(self, data):
        self.found.append((TEXT, data))

    def handle_endtag(self, tag):
        self.found.append((CLOSE, tag))

    def handle_starttag(self, tag, attrs):
        self.found.append((OPEN, tag))
        if tag == "img":
            self.found.append((TEXT, dict(attrs).get("alt") or ""))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.found += [end for start, end in _ENDS_OF_DROPPED.items() if start[1] == tag]


def _shown(pieces: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Pieces outside dropped elements; an element that never ends hides the rest of the page."""
    rest = iter(pieces)
    for piece in rest:
        if piece not in _ENDS_OF_DROPPED:
            yield piece
            continue
        awaited = [_ENDS_OF_DROPPED[piece]]
        while awaited and (inner := next(rest, None)):
            if inner == awaited[-1]:
                awaited.pop()
            elif inner in _ENDS_OF_DROPPED:
                awaited.append(_ENDS_OF_DROPPED[inner])


def clean_one(text: str) -> tuple[str, str]:
    """(safe markup, plain text) of one description; plain text passes untouched."""
    text = text.translate(V.LEGACY_BULLETS)
    if not _has_tags(text):
        return _html.escape(text), text
    shown = list(_shown(_Pieces(text).found))
    markup = "".join(_html.escape(p[1]) if p[0] == TEXT else _MARKUP.get(p, "") for p in shown)
    plain = "".join(p[1] if p[0] == TEXT else _PLAIN.get(p, "") for p in shown)
    for pattern, new in _SPACING:
        markup = pattern.sub(new, markup)
    return markup, plain


@F.pandas_udf(T.StructType([T.StructField("html", T.StringType()), T.StructField("text", T.StringType())]))
def _clean_udf(texts: pd.Series) -> pd.DataFrame:
    pairs = [clean_one(t) if t is not None else (None, None) for t in texts]
    return pd.DataFrame(pairs, columns=["html", "text"])


def clean_html(df: DataFrame, column: str, html: str = "clean_html", text: str = "clean_text") -> DataFrame:
    """Adds safe markup and plain text of ``column``; rows are dealt over the tasks first, as parsing costs far more than moving them."""
    return (dealt(df).withColumn("_clean", _clean_udf(column))
              .select("*", F.col("_clean.html").alias(html), F.col("_clean.text").alias(text)).drop("_clean"))


@F.pandas_udf(T.StringType())
def folded_text(texts: pd.Series) -> pd.Series:
    """Letters and digits only after compatibility folding."""
    fold = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t) if c.isalnum())
    return texts.map(fold)


def text_contained(original, rendered) -> Column:
    return F.contains(folded_text(rendered), folded_text(original))


def _blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def audit_evidence(results: DataFrame, sources: DataFrame, languages: DataFrame,
                   allowed_languages=V.LANGUAGE_GROUPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid results, failures with error lists, ids without a valid result).

    ``results``: record_id, detected_languages, reading_status, reading_note, skills,
    education_requirements (arrays of english/quote); ``sources``: record_id, description;
    ``languages``: record_id, languages.  A quote must stand in the description letter by letter.
    """
    lists = {"skills": V.MAX_SKILLS, "education_requirements": V.MAX_REQUIREMENTS}
    counts = results.groupBy("record_id").agg(F.count(F.lit(1)).alias("_copies"))
    truth = sources.select("record_id", F.col("description").alias("_text"), F.lit(True).alias("_known")).join(
        languages.select("record_id", F.col("languages").alias("_langs")), "record_id", "left")
    j = salted_join(results, counts.join(truth, "record_id", "left"), ["record_id"], hot=find_sized(results, ["record_id"]))
    langs = F.col("detected_languages")
    shape = [(~F.col("reading_status").isin(*V.READING_STATUSES), "reading_status"),
             ((F.size(langs) < 1) | (F.size(langs) != F.size(F.array_distinct(langs))), "detected_languages"),
             (F.size(F.array_except(langs, F.array(*[F.lit(g) for g in allowed_languages]))) > 0, "detected_languages: unknown language")]
    shape += [(F.col(c).isNull(), f"{c}: missing") for c in ("detected_languages", "reading_status", "reading_note", *lists)]
    evidence = []
    for name, most in lists.items():
        items = F.col(name)
        shape += [(F.size(items) > most, f"{name}: too many items"),
                  (F.exists(items, lambda x: x["english"].isNull() | x["quote"].isNull() | (F.length(x["english"]) < 1)
                            | (F.length(x["quote"]) < 1) | (F.length(x["quote"]) > V.MAX_QUOTE)), f"{name}: malformed item")]
        evidence.append((F.exists(items, lambda x: _blank(x["english"]) | _blank(x["quote"]) | ~F.contains(F.col("_text"), x["quote"])),
                         f"{name}: missing or fabricated evidence"))
    content = [(F.array_sort(F.array_distinct(langs)) != F.array_sort(F.array_distinct("_langs")), "languages differ from the source"),
               (F.col("_langs").isNull(), "languages differ from the source"),
               ((F.col("reading_status") != "readable") & _blank(F.col("reading_note")), "unreadable text needs an explanation"),
               ((F.col("reading_status") == "unreadable") & ((F.size("skills") > 0) | (F.size("education_requirements") > 0)),
                "unreadable record with extracted items"), *evidence]
    collect = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    unexpected = F.col("_known").isNull() | (F.col("_copies") != 1)
    errors = F.when(unexpected, F.array(F.lit("unexpected or duplicate id"))).otherwise(
        F.when(F.size(collect(shape)) > 0, collect(shape)).otherwise(F.array_distinct(collect(content))))
    marked = j.withColumn("errors", errors)
    valid = marked.where(F.size("errors") == 0).select(*results.columns)
    failures = marked.where(F.size("errors") > 0).select("record_id", F.lit("invalid_evidence").alias("category"), "errors")
    missing = sources.select("record_id").join(valid.select("record_id").distinct(), "record_id", "left_anti")
    return valid, failures, missing


def request_audit(requests: DataFrame, sources: DataFrame, model: str) -> DataFrame:
    """Problems of prepared requests (``body`` JSON): settings, one unchanged record each, exact ids."""
    schema = ("model string, temperature double, reasoning_effort string, max_tokens int, "
              "messages array<struct<role:string,content:string>>")
    b = F.from_json("body", schema)
    content = F.get(b["messages"], F.lit(1))["content"]
    sent = F.from_json(F.expr("substring(_c, instr(_c, '['))"), "array<map<string,string>>")
    want = V.REQUEST_SETTINGS
    parsed = requests.withColumn("_b", b).withColumn("_c", content).withColumn("_s", sent)
    first = F.get("_s", F.lit(0))
    rows = parsed.select(
        first["record_id"].alias("record_id"), first["description"].alias("_d"), first["title"].alias("_t"),
        (F.col("_b.model").eqNullSafe(model) & F.col("_b.temperature").eqNullSafe(want["temperature"])
         & F.col("_b.reasoning_effort").eqNullSafe(want["reasoning_effort"])
         & F.col("_b.max_tokens").eqNullSafe(want["max_tokens"])).alias("_settings"),
        ((F.size("_s") == 1) & F.array_sort(F.map_keys(first)).eqNullSafe(F.array(*[F.lit(k) for k in ("description", "record_id", "title")])))
        .alias("_shape"))
    truth = sources.select("record_id", F.col("description").alias("_sd"), F.col("title").alias("_st"), F.lit(True).alias("_known"))
    j = salted_join(rows, truth, ["record_id"], hot=find_sized(rows, ["record_id"]))
    rules = [(~F.coalesce("_settings", F.lit(False)), "settings"), (~F.coalesce("_shape", F.lit(False)), "one record with three fields"),
             (F.col("_known").isNull(), "unknown id"),
             (F.col("_known") & ~(F.col("_d").eqNullSafe(F.col("_sd")) & F.col("_t").eqNullSafe(F.col("_st"))), "changed text")]
    per_row = j.select("record_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))).alias("problem"))
    from .joins import same_bag
    cover = same_bag(rows.select("record_id"), sources.select("record_id")).select(
        "record_id", F.when(F.col("surplus") > 0, "id sent too often or unknown").otherwise("id not sent").alias("problem"))
    return per_row.unionByName(cover)


def record_checksum(columns: list[str]) -> Column:
    """SHA-256 of the record as JSON with NULLs kept and columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def export_audit(exported: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Keys whose exported records differ from the source records: missing, unexpected or changed."""
    columns = source.columns
    tagged = [df.select(F.col(key).alias("key"), record_checksum(columns).alias("_h"), F.lit(d).alias("_d"))
              for df, d in ((exported.select(*columns), 1), (source, -1))]
    diff = (tagged[0].unionAll(tagged[1]).groupBy("key", "_h").agg(F.sum("_d").alias("_d")).where("_d <> 0")
            .groupBy("key").agg(F.max("_d").alias("_hi"), F.min("_d").alias("_lo")))
    status = (F.when((F.col("_hi") > 0) & (F.col("_lo") < 0), "changed").when(F.col("_hi") > 0, "unexpected").otherwise("missing"))
    return diff.select("key", status.alias("status"))
