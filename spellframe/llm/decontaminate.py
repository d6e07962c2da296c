"""Benchmark decontamination: a broadcast hash set of test n-grams against all training windows.

Items become windows of ``size`` words (a shorter item is one window).  The distinct windows, keyed
by a 64-bit hash of their words, are broadcast when they fit ``BROADCAST_WINDOWS``, else left to a
shuffled join.  Each document is read once: every word position looks its window up, a hash
hit is verified word by word, and only hits and one row per document are grouped afterwards.

Cases: a null or empty text has no words and no windows; items without words are ignored; rows that repeat an id and its text
are looked up alike and give a row each; repeated items count once per id, items without an id hit but are not counted; an empty benchmark gives no hits; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import following, repeated, row_key, stage, words

SIZE = 10
#: Windows that may be broadcast: about 150 bytes each, so some 300 MB at most.
BROADCAST_WINDOWS = 2_000_000


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Distinct windows (n, key, window) with the ids of the items that hold them."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item").alias("items")).select(
        F.size("window").alias("n"), F.xxhash64(F.array_join("window", " ")).alias("key"), "window", "items")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """Per document: id, text_hash, n_words, hits (start and end word of each occurrence), n_hit, items (sorted ids)."""
    return repeated(_by_text(docs, items, id_col, text_col, item_id, item_text, size), "copies")


def _by_text(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """``contamination`` by id and text, with the number of such rows."""
    wins = stage(item_windows(items, item_id, item_text, size), "windows")
    lengths = sorted(r[0] for r in wins.select("n").distinct().collect())  # at most `size` numbers
    base = docs.select(row_key(id_col, text_col).alias("doc"), words(F.col(text_col)).alias("w"))
    base = base.select("doc", F.size("w").cast("long").alias("n_words"), following(F.col("w"), max(lengths, default=1)).alias("z"))
    at = base.select("doc", "n_words", F.posexplode_outer("z").alias("pos", "v"))
    ahead = lambda n: F.xxhash64(F.concat_ws(" ", *[F.col(f"v.w{i}") for i in range(n)]))
    keys = [(n, F.when(F.col("pos") + n <= F.col("n_words"), ahead(n))) for n in lengths]
    if len(keys) > 1:
        at = at.withColumn("k", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), k.alias("key")) for n, k in keys])))
        at = at.select("doc", "n_words", "pos", "v", F.col("k.n").alias("n"), F.col("k.key").alias("key"))
    else:
        at = at.withColumn("n", F.lit(keys[0][0] if keys else 0)).withColumn("key", keys[0][1] if keys else F.lit(None).cast("long"))
    right = wins.select(F.col("n").alias("m"), F.col("key").alias("wkey"), "window", "items")
    if wins.count() <= BROADCAST_WINDOWS:
        right = F.broadcast(right)
    same = F.lit(True)
    for i in range(max(lengths, default=0)):
        same = same & ((F.col("m") <= i) | F.get("window", F.lit(i)).eqNullSafe(F.col(f"v.w{i}")))
    met = at.join(right, (F.col("key") == F.col("wkey")) & (F.col("n") == F.col("m")) & same, "left")
    met = met.where(F.col("m").isNotNull() | F.col("pos").isNull() | ((F.col("pos") == 0) & (F.col("n") == (lengths or [0])[0])))
    hit = F.when(F.col("m").isNotNull(), F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("m")).alias("end")))
    # Every row is here once with its first place and the first length, hit or not.
    once = (F.col("pos").isNull() | (F.col("pos") == 0)) & (F.col("n") == (lengths or [0])[0])
    per = met.groupBy("doc").agg(F.max("n_words").alias("n_words"), F.count_if(once).alias("copies"), F.collect_set(hit).alias("found"),
                                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(F.array_sort("found"), start, lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"),
        F.greatest(a["end"], x["end"]).alias("end")))["n"]
    return per.select(F.col("doc.id").alias(id_col), F.col("doc.h").alias("text_hash"), "n_words", F.array_sort("found").alias("hits"), covered.alias("n_hit"), "items", "copies")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a benchmark window; columns as given."""
    bad = _by_text(docs, items, id_col, text_col).where("n_hit > 0").select(F.col(id_col).alias("_bad"), F.col("text_hash").alias("_h"))
    return docs.join(bad.distinct(), F.col(id_col).eqNullSafe(F.col("_bad")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_h")), "left_anti")
