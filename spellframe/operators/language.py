"""Language of passages, spans and documents.

A character n-gram model trained from labelled text stands in for a detector library;
the policy on top of it (spans, groups, scripts) is exact for any given spans.  Passages
tile the whole text: a sentence, or where a sentence is longer than ``PASSAGE_CHARS`` a piece that goes on to the
end of the word; no word is ever cut.  Texts are dealt over the tasks before they are scored.  N-grams are counted in Arrow batches.  A model
below ``MODEL_BYTES`` is broadcast, so n-grams are summed where they are made and a passage travels as one row; a larger one is joined by
n-gram with salts for the frequent ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.periods import _col
from ..session import stage
from .grams import GRAM, cuts, label_counts, model_arrays, sums
from .skew import dealt, find_sized, salted_join

#: Length from which a sentence may end at white space.
PASSAGE_CHARS = 400
SCRIPTS = ("simplified", "traditional")
#: Size in memory up to which a model is broadcast.
MODEL_BYTES = 256 * 2**20
_END = r"\n.!?。！？"
_SPACE = r" \t\r\f"
PASSAGE = f"[^{_END}]{{0,{PASSAGE_CHARS}}}[{_END}]+|[^{_END}]{{{PASSAGE_CHARS}}}[^{_END}{_SPACE}]*[{_END}{_SPACE}]*|[^{_END}]+"


def letters(text) -> Column:
    return F.length(F.regexp_replace(_col(text), r"[^\p{L}]", ""))


def _padded(text: Column) -> Column:
    """The letters of a text in lower case, one space for all between them and at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def _grams(text: Column) -> Column:
    """All overlapping character n-grams of the padded, letters-only text, in one linear regex pass."""
    return F.regexp_extract_all(_padded(text), F.lit(f"(?=(.{{{GRAM}}}))"), F.lit(1))


def passages(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, pos, passage): consecutive pieces that together are the whole text."""
    rows = df.select(ident, text)
    fields = T.StructType([rows.schema[0], T.StructField("pos", T.IntegerType()), T.StructField("passage", T.StringType())])
    return rows.mapInArrow(cuts(PASSAGE), fields)


def language_profiles(labelled: DataFrame, text: str, label: str, labels: list[str], alpha: float = 0.5) -> DataFrame:
    """(gram, logp array in the order of ``labels``) for all grams of the labelled texts."""
    pieces = passages(dealt(labelled.where(F.col(label).isin(*labels)).select(label, text)), label, text)
    number = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label))
    fields = ", ".join(["gram string", *[f"_c{i} bigint" for i in range(len(labels))]])
    grams = pieces.select(number.cast("int").alias("_l"), _padded(F.col("passage")).alias("_t")).mapInArrow(label_counts(len(labels)), fields)
    counts = stage(grams.groupBy("gram").agg(*[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(labels))]), "gram_counts")
    total = counts.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(labels))]).first()  # one row
    share = lambda c: F.log((F.col(c) + alpha) / F.lit((total[c] or 0) + alpha * total["n"]))
    return counts.select("gram", F.array(*[share(f"_c{i}") for i in range(len(labels))]).alias("logp"))


def _scored(pieces: DataFrame, text: str, profiles: DataFrame, labels: list[str]) -> DataFrame:
    """The other columns and ``_s0, _s1, ...``: each piece's sums of log probabilities, NULL without a known n-gram.

    By a small model one row per piece, by a large one a row per n-gram; either way the sums of a piece add up.
    """
    kept, names = [c for c in pieces.columns if c != text], [f"_s{i}" for i in range(len(labels))]
    size = profiles.count() * (64 + 8 * len(labels))  # key, offsets and one number per label in a row of a hash table
    if size <= MODEL_BYTES:
        model = pieces.sparkSession.sparkContext.broadcast(model_arrays(profiles.select("gram", "logp").toArrow()))
        ready = pieces.select(*kept, _padded(F.col(text)).alias("_t"))
        fields = T.StructType([*ready.schema.fields[:-1], *[T.StructField(n, T.DoubleType()) for n in names]])
        return ready.mapInArrow(sums(model, len(labels)), fields)
    grams = pieces.select(*kept, _grams(F.col(text)).alias("_g")).select(*kept, F.explode_outer("_g").alias("gram"))
    hit = salted_join(grams, profiles, ["gram"], "left", hot=find_sized(grams, ["gram"]))
    return hit.select(*kept, *[F.col("logp")[i].alias(n) for i, n in enumerate(names)])


def _log_scores(pieces: DataFrame, keys: list[str], profiles: DataFrame, labels: list[str], text: str) -> DataFrame:
    scored = _scored(pieces.select(*keys, text), text, profiles, labels).where(F.col("_s0").isNotNull())
    return scored.groupBy(*keys).agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(labels))])


def _top_two(scored: DataFrame, labels: list[str]) -> DataFrame:
    best = F.greatest(*[F.col(f"_s{i}") for i in range(len(labels))])
    ranked = F.sort_array(F.array(*[F.struct(F.exp(F.col(f"_s{i}") - best).alias("w"), F.lit(v).alias("l"))
                                    for i, v in enumerate(labels)]), asc=False)
    total = F.aggregate(ranked, F.lit(0.0), lambda acc, x: acc + x["w"])
    return (scored.withColumn("_r", ranked).withColumn("_t", total)
            .select("*", F.col("_r")[0]["l"].alias("language"), (F.col("_r")[0]["w"] / F.col("_t")).alias("confidence"),
                    (F.col("_r")[1]["w"] / F.col("_t")).alias("second"))
            .drop("_r", "_t", *[f"_s{i}" for i in range(len(labels))]))


def exclusive_characters(text, alphabet: str) -> Column:
    """The distinct characters of the alphabet in a text, as an array of at most its size."""
    # The alphabet joins the pattern as data, so no character acts as regex syntax.
    only = F.regexp_replace(_col(text), "[^\\Q" + alphabet + "\\E]", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(only, ""), lambda x: x != "")))


def score_passages(df: DataFrame, ident: str, text: str, profiles: DataFrame, labels: list[str], alphabets: tuple[str, str] | None = None) -> DataFrame:
    """Spans (id, start, end, language, letters, confidence, second) of every scorable passage.

    With ``alphabets`` (characters of one Chinese script only, simplified and traditional) also ``simplified`` and ``traditional``:
    those that stand in the passage.
    """
    parts = passages(dealt(df.select(ident, text)), ident, text)
    scripts = dict(zip(SCRIPTS, alphabets or (), strict=False))
    sized = parts.select(ident, "pos", F.length("passage").alias("_len"), letters("passage").alias("_letters"),
                         *[F.concat_ws("", exclusive_characters("passage", a)).alias(s) for s, a in scripts.items()], "passage")
    # Passages travel once, by document: sums, places and merged spans are made behind that exchange.
    hit = _scored(sized, "passage", profiles, labels).repartition(ident)
    scored = hit.groupBy(ident, "pos").agg(
        F.max("_len").alias("_len"), F.max("_letters").alias("letters"), *[F.max(s).alias(s) for s in scripts],
        *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(labels))])
    w = Window.partitionBy(ident).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = scored.withColumn("end", F.sum("_len").over(w)).withColumn("start", F.col("end") - F.col("_len"))
    return (_top_two(placed.where(F.col("_s0").isNotNull()), labels)
            .select(ident, "start", "end", "language", "letters", "confidence", "second", *scripts))


def _joined_characters(column: Column | str) -> Column:
    """Distinct characters of several short strings; bounded by the alphabet they come from."""
    return F.concat_ws("", F.array_sort(F.array_distinct(F.split(F.array_join(F.collect_set(column), ""), ""))))


def merge_spans(spans: DataFrame, ident: str) -> DataFrame:
    """Confident spans; touching spans of one language become one (weakest confidence and margin, all their script characters)."""
    margin = F.col("confidence") - F.col("second")
    sure = spans.where((F.col("letters") > 0) & (F.col("confidence") >= V.MIN_CONFIDENCE) & (margin >= V.MIN_MARGIN)
                       ).withColumn("margin", margin)
    w = Window.partitionBy(ident).orderBy("start")
    touches = (F.lag("end").over(w).eqNullSafe(F.col("start")) & F.lag("language").over(w).eqNullSafe(F.col("language")))
    numbered = sure.withColumn("_new", (~touches).cast("int")).withColumn(
        "_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(ident, "_island", "language").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("letters").alias("letters"),
        F.min("confidence").alias("confidence"), F.min("margin").alias("margin"),
        *[_joined_characters(s).alias(s) for s in SCRIPTS if s in spans.columns]).drop("_island")


def language_letters(merged: DataFrame, ident: str) -> DataFrame:
    """(id, language, letters) over the passages that count."""
    return merged.where(F.col("letters") >= V.MIN_PASSAGE_LETTERS).groupBy(ident, "language").agg(F.sum("letters").alias("letters"))


def chinese_scripts(merged: DataFrame, ident: str) -> DataFrame:
    """(id, chinese_script) by the characters of the Chinese passages that count: two or more of one script and none of the other."""
    counted = merged.where((F.col("letters") >= V.MIN_PASSAGE_LETTERS) & (F.col("language") == "Chinese"))
    sets = counted.groupBy(ident).agg(*[_joined_characters(s).alias(s) for s in SCRIPTS])
    return sets.select(ident, _script(*[F.length(s) for s in SCRIPTS]).alias("chinese_script"))


def classify_language(merged: DataFrame, documents: DataFrame, ident: str) -> DataFrame:
    """Group of each document by the policy; NULL when ambiguous.

    ``documents``: id, ``letters`` (all letters of the text) and ``chinese_script`` (NULL when
    undecided); without that column the script comes from the characters of the Chinese passages.  Passages below the minimum do not count.
    """
    big = F.col("letters") >= V.MIN_PASSAGE_LETTERS
    given = "chinese_script" in documents.columns
    told = [] if given else [_joined_characters(F.when(F.col("language") == "Chinese", F.col(s))).alias(s) for s in SCRIPTS]
    per = merged.where(big).groupBy(ident).agg(
        *[F.coalesce(F.sum(F.when(F.col("language") == g, F.col("letters"))), F.lit(0)).alias(f"_{i}")
          for i, g in enumerate(V.LANGUAGE_GROUPS)],
        F.count_if(F.col("language") != "English").alias("other_passages"), *told)
    if not given:  # of the same pass: the spans are not made twice
        per = per.withColumn("chinese_script", _script(*[F.length(s) for s in SCRIPTS])).drop(*SCRIPTS)
    j = documents.select(ident, F.col("letters").alias("_total"), *(["chinese_script"] if given else [])).join(per, ident, "left")
    share = {g: F.coalesce(F.col(f"_{i}"), F.lit(0)) / F.col("_total") for i, g in enumerate(V.LANGUAGE_GROUPS)}
    amount = {g: F.coalesce(F.col(f"_{i}"), F.lit(0)) for i, g in enumerate(V.LANGUAGE_GROUPS)}
    en, zh = "English", "Chinese"
    mixed = ((amount[en] >= V.MIXED_MIN_ENGLISH_LETTERS) & (amount[zh] >= V.MIXED_MIN_CHINESE_LETTERS)
             & (F.least(share[en], share[zh]) >= V.MIXED_MIN_SHARE_EACH) & ((amount[en] + amount[zh]) / F.col("_total") >= V.MIN_GROUP_SHARE))
    scripted = F.col("chinese_script").isNotNull()
    single = reduce(lambda acc, g: acc.when(share[g] >= V.MIN_GROUP_SHARE, F.when(scripted, g) if g == zh else F.lit(g)),
                    V.LANGUAGE_GROUPS, F.when(F.lit(False), F.lit("")))
    group = F.when(F.col("_total") > 0, F.when(mixed, F.when(scripted, V.MIXED_GROUP)).otherwise(single))
    return j.withColumn("language_group", group).select(
        ident, "language_group",
        F.when(F.col("language_group") == V.MIXED_GROUP, F.array(F.lit(zh), F.lit(en)))
         .when(F.col("language_group").isNotNull(), F.array("language_group")).otherwise(F.array().cast("array<string>")).alias("languages"),
        F.col("_total").alias("letters"), F.coalesce("other_passages", F.lit(0)).alias("other_passages"), "chinese_script")


def script_variant(text, simplified: str, traditional: str, least: int = V.SCRIPT_MIN_DISTINCT) -> Column:
    """'simplified' / 'traditional' by distinct exclusive characters, NULL when absent or opposing."""
    return _script(*[F.size(exclusive_characters(text, a)) for a in (simplified, traditional)], least)


def _script(s: Column, t: Column, least: int = V.SCRIPT_MIN_DISTINCT) -> Column:
    return F.when((s >= least) & (t == 0), "simplified").when((t >= least) & (s == 0), "traditional")


def english_screen(classified: DataFrame, documents: DataFrame, ident: str, text: str) -> DataFrame:
    """Accepted only when the group is English and no other substantial passage stands in it."""
    blank = F.col("_blank")
    ok = F.coalesce((F.col("language_group") == "English") & (F.col("other_passages") == 0), F.lit(False)) & ~blank
    reason = F.when(blank, "empty_description").when(ok, "english").otherwise("non_english_mixed_or_uncertain")
    # Only the flag goes through the join, not the text.
    flagged = documents.select(ident, (F.col(text).isNull() | ~F.col(text).rlike(r"(?U)\S")).alias("_blank"))
    return flagged.join(classified, ident, "left").select(ident, ok.alias("accepted"), reason.alias("reason"))


def dominant_language(df: DataFrame, ident: str, text: str, profiles: DataFrame, labels: list[str]) -> DataFrame:
    """Main language of a whole document, 'uncertain' below the policy's minimum evidence."""
    sizes = df.select(ident, letters(text).alias("letters"))
    scored = _top_two(_log_scores(passages(dealt(df.select(ident, text)), ident, text), [ident], profiles, labels, "passage"), labels)
    sure = ((F.col("letters") >= V.MIN_PASSAGE_LETTERS) & (F.col("confidence") >= V.MIN_CONFIDENCE)
            & (F.col("confidence") - F.col("second") >= V.MIN_MARGIN))
    return sizes.join(scored, ident, "left").select(
        ident, F.when(F.coalesce(sure, F.lit(False)), F.col("language")).otherwise("uncertain").alias("language"))


def language_share(dominant: DataFrame, by: str) -> DataFrame:
    counted = dominant.groupBy(by, "language").agg(F.count(F.lit(1)).alias("documents"))
    total = F.sum("documents").over(Window.partitionBy(by))  # one row per language
    return counted.select(by, "language", "documents", F.round(F.col("documents") / total, 6).alias("share"))
