"""Join of near duplicates: word n-gram Jaccard similarity with Bayesian candidate pruning.

1. Documents with the same words in the same order form a class; one row per class goes on, so copies cost one row.
2. A class has a signature of 128 MinHash values (16 bits each).  Each band of four values is a bucket key.  A pair of
   similarity 0.8 misses all 32 bands with probability (1 - 0.8^4)^32 = 5e-8.
3. In a bucket, pairs compare their values 16 at a time.  With m of n values equal, the posterior (uniform prior) that the
   similarity reaches the threshold is a Beta tail; below ``TOLERANCE`` the pair is dropped.  A pair is only looked at in the
   first band where its classes agree.  Buckets over ``BLOCK`` members are cut into blocks and each pair of
   blocks is a task's work of its own: nothing is capped, and pairs leave a task only when they survive.
4. Survivors leave a task as one packed list per member and a forest of edges.  The forest's components are clusters; a cluster's sets of
   n-gram hashes (64 bits) are sent once to each pair of its blocks that has survivors, and the survivors are verified there on the whole sets.
5. Verified links leave as counts per class and again a forest; its components, by repeated minimum with pointer jumping, are the groups.

Links between different texts number up to the square of a group of near copies: all are verified, but they stay inside tasks.

Cases: null and empty texts have no words, no links and a group of their own; texts of 1 to n - 1 words have one n-gram of all words;
a document is a distinct (id, text), so an id may stand with several texts, be missing (then it comes last) or of any type that has an order;
rows that repeat an id and its text each get a result row and are copies of each other; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_counts, stage
from .word_arrays import pieces, runs, word_hashes

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
STEP = 16
TOLERANCE = 1e-7
BLOCK = 1_024
#: Ids that may be broadcast, 8 bytes each; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
_rng = np.random.default_rng(77)
_MASK = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_ODD = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = 16, 32, ... compared values: the fewest matches whose posterior of reaching the threshold is at least the tolerance."""
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        # Beta(m + 1, n - m + 1) tail above t = P(Binomial(n + 1, t) <= m)
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out.append(m)
                break
    return out


def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in pieces(batch.column("text")):
            hashes, bounds = word_hashes(data, offsets)
            grams, to = runs(hashes, bounds, words)
            n = b - a
            some = np.flatnonzero(np.diff(to))
            sig = np.zeros((n, BANDS * ROWS), np.uint16)
            seq = np.zeros((n, 2), np.uint64)
            if len(some):
                starts = to[:-1][some]
                low = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
                with np.errstate(over="ignore"):
                    for j in range(BANDS * ROWS):
                        got = np.minimum.reduceat((low ^ _MASK[j]) * _ODD[j], starts)
                        got = (got ^ (got >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                        sig[some, j] = (got >> np.uint32(16)).astype(np.uint16)
                    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
                    for c, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                        turned = (hashes ^ (place * np.uint64(odd))) * np.uint64(odd ^ 0xFF51AFD7ED558CCC | 1)
                        seq[some, c] = np.add.reduceat(turned ^ (turned >> np.uint64(31)), bounds[:-1][some])
            flat = np.ascontiguousarray(sig).view(np.uint8).reshape(-1)
            width = BANDS * ROWS * 2
            yield pa.RecordBatch.from_arrays([
                batch.column("id").slice(a, n), pa.array(np.diff(bounds), pa.int64()), pa.array(seq[:, 0].view(np.int64)), pa.array(seq[:, 1].view(np.int64)),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, width * n + 1, width, dtype=np.int32)), pa.py_buffer(flat)]),
            ], ["id", "n_words", "c1", "c2", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if n:
            sig = np.frombuffer(b"".join(x.as_py() for x in batch.column("sig")), np.int64).reshape(n, BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(sig.reshape(-1)),
                                              pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))], ["band", "value", "rep"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches; small groups come many at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy()
            changed[1:] |= v[1:] != v[:-1]
        if held:
            changed[0] = any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
        cuts = np.flatnonzero(changed)
        if len(cuts):
            whole = [*held, batch.slice(0, int(cuts[-1]))]
            if sum(x.num_rows for x in whole):
                yield pa.Table.from_batches(whole)
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.ones(table.num_rows, bool)
    if table.num_rows:
        same = np.ones(table.num_rows - 1, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            same &= v[1:] == v[:-1]
        changed[1:] = ~same
    return np.flatnonzero(changed)


GROUP = ["band", "value", "bi", "bj"]
PLACE = ["label", "pi", "pj"]


def _survivors(batches: Iterator[pa.RecordBatch], least: list[int]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches, GROUP):
        n = table.num_rows
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(n, BANDS * ROWS)
        wide = sig.view(np.uint64)
        rep, band, side = (table.column(c).to_numpy() for c in ("rep", "band", "side"))
        starts = _starts(table, GROUP)
        stops = np.append(starts[1:], n)
        left_in_group = np.repeat(stops, stops - starts) - np.arange(n)
        rows, left, right = np.arange(n), [], []
        d = 0
        while len(rows := rows[left_in_group[rows] > d + 1]):
            d += 1
            i, j = rows, rows + d
            use = (side[i] == 2) | (side[i] != side[j])  # two blocks: only pairs across
            i, j = i[use], j[use]
            for s, fewest in enumerate(least):
                if not len(i):
                    break
                enough = (sig[i, :STEP * (s + 1)] == sig[j, :STEP * (s + 1)]).sum(1) >= fewest
                i, j = i[enough], j[enough]
            if len(i):
                first = (wide[i] == wide[j]).argmax(1) == band[i]
                left.append(i[first])
                right.append(j[first])
        if left and sum(map(len, left)):
            yield _packed(rep, np.concatenate(left), np.concatenate(right))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges i-j among n nodes, edges (node, smallest node of its component) that connect the same nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def _packed(rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Rows (a, partners) with all partners of one member, and rows (a, b) of a forest over the same pairs."""
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    lists = [x.tobytes() for x in np.split(rep[j], cuts[1:])]
    names, number = np.unique(rep, return_inverse=True)
    nodes, roots = forest(len(names), number[i], number[j])  # towards the smallest, so that buckets agree
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([rep[i[cuts]], names[nodes]])), pa.array(lists + [None] * len(nodes), pa.binary()),
        pa.array([None] * len(cuts) + names[roots].tolist(), pa.int64())], ["a", "partners", "b"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member's partners by pair of blocks of its cluster, and the members that a pair of blocks needs (partners null)."""
    for batch in batches:
        rows, needed = [], set()
        for a, partners, label, blocks in zip(*(batch.column(c).to_pylist() for c in ("a", "partners", "label", "blocks")), strict=True):
            others = np.frombuffer(partners, np.int64)
            own = a % blocks
            theirs = others % blocks
            for block in np.unique(theirs).tolist():
                some = others[theirs == block]
                place = (label, min(own, block), max(own, block))
                rows.append((*place, a, some.tobytes()))
                needed.add((*place, a))
                needed.update((*place, x) for x in some.tolist())
        rows += [(*x, None) for x in needed]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.binary()], strict=True)], [*PLACE, "a", "partners"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in pieces(batch.column("text")):
            grams, to = runs(*word_hashes(data, offsets), words)
            out = [np.unique(grams[to[i]:to[i + 1]]).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(a, b - a), pa.array(out, pa.binary())], ["rep", "grams"])


def _similarity(x: np.ndarray, y: np.ndarray, threshold: float) -> float:
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return 0.0
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


def _verified(batches: Iterator[pa.RecordBatch], threshold: float, pairs: bool) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, others): links of a forest; ``others`` counts the documents linked to a in this place.  With ``pairs`` every link is a row."""
    sets: dict[int, tuple[np.ndarray, int]] = {}
    found: list[tuple[int, int]] = []
    at: tuple | None = None

    def close() -> pa.RecordBatch:
        names = np.array(sorted(sets), np.int64)
        ends = np.searchsorted(names, np.array(found, np.int64).reshape(-1, 2))
        i, j = ends[:, 0], ends[:, 1]
        copies = np.array([sets[x][1] for x in names.tolist()], np.int64)
        others = np.zeros(len(names), np.int64)
        np.add.at(others, i, copies[j])
        np.add.at(others, j, copies[i])
        x, y = (i, j) if pairs else forest(len(names), i, j)
        some = np.flatnonzero(others)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([names[x], names[some]])), pa.array(names[y].tolist() + [None] * len(some), pa.int64()),
            pa.array(np.concatenate([np.zeros(len(x), np.int64), others[some]]))], ["a", "b", "others"])

    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in PLACE]
        a, copies = batch.column("a").to_pylist(), batch.column("copies").to_pylist()
        partners, grams = batch.column("partners"), batch.column("grams")
        for r in range(batch.num_rows):
            here = tuple(c[r] for c in columns)
            if here != at:
                if found:
                    yield close()
                sets, found, at = {}, [], here
            if grams[r].is_valid:
                sets[a[r]] = (np.frombuffer(grams[r].as_py(), np.uint64), copies[r])
                continue
            mine = sets[a[r]][0]
            found += [(a[r], b) for b in np.frombuffer(partners[r].as_py(), np.int64).tolist() if _similarity(mine, sets[b][0], threshold) >= threshold]
    if found:
        yield close()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over links a-b, for the nodes that have links."""
    once = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    both = stage(once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = stage(low.join(jump, "low", "left").select("node", F.coalesce("next", "low").alias("label"), F.col("label").alias("was")), "labels")
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def repeated_ids(rows: DataFrame) -> bool:
    """Whether an id stands in several rows."""
    return not rows.groupBy("id").count().where("count > 1").isEmpty()


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                  threshold: float = THRESHOLD, pairs: bool = False) -> tuple[DataFrame, DataFrame]:
    """(membership: id, rep, n_words and copies of its class; links between representatives as rows (a, b), a forest of them unless ``pairs``,
    and rows (a, others) that count the documents linked to a)."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = stage(plain.mapInArrow(lambda it: _signatures(it, words), "id long, n_words long, c1 long, c2 long, sig binary"), "signatures")
    # Texts without words have no class but their own row.
    full = marked.where("n_words > 0 AND id IS NOT NULL")
    kinds = stage(full.groupBy("c1", "c2", "n_words").agg(F.min(F.struct("id", "sig")).alias("m"), F.count(F.lit(1)).alias("copies"))
                      .select("c1", "c2", "n_words", "copies", F.col("m.id").alias("rep"), F.col("m.sig").alias("sig")), "classes")
    bands = kinds.select("rep", "sig").mapInArrow(_bands, "band int, value long, rep long")
    shared = bands.groupBy("band", "value").count().where("count > 1")
    met = stage(bands.join(shared, ["band", "value"]), "buckets")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", "band"), F.ceil(F.col("count") / BLOCK)).cast("int")
    met = met.select("band", "value", "rep", blocks.alias("blocks"), own.alias("own"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("band", "value", "rep", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"),
                     F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    rows, _ = row_counts(met.withColumn("text", F.lit("")))
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, rows // 40_000)
    least = least_matches(threshold)
    found = stage(met.join(kinds.select("rep", "sig"), "rep").repartition(parts, *GROUP).sortWithinPartitions(*GROUP)
                     .mapInArrow(lambda it: _survivors(it, least), "a long, partners binary, b long"), "candidates")
    # Clusters of candidates: where their sets meet.
    labels = stage(components(found.where("b IS NOT NULL")), "clusters")
    sizes = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    where = labels.join(sizes, "label").withColumnRenamed("node", "a")
    placed = stage(found.where("partners IS NOT NULL").select("a", "partners").join(where, "a")
                        .mapInArrow(_placed, "label long, pi long, pj long, a long, partners binary"), "placed")
    ends = placed.where("partners IS NULL").select(*PLACE, "a").distinct()
    wanted = labels.select(F.col("node").alias("rep"))
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = stage(plain.withColumnRenamed("id", "rep").join(wanted, "rep", "left_semi")
                      .mapInArrow(lambda it: _sets(it, words), "rep long, grams binary"), "sets")
    sets = sets.groupBy(F.col("rep").alias("a")).agg(F.first("grams").alias("grams")) if repeated_ids(marked) else sets.withColumnRenamed("rep", "a")
    sent = ends.join(sets, "a").join(kinds.select(F.col("rep").alias("a"), "copies"), "a").select(*PLACE, "a", F.lit(None).cast("binary").alias("partners"), "grams", "copies")
    lists = placed.where("partners IS NOT NULL").withColumn("grams", F.lit(None).cast("binary")).withColumn("copies", F.lit(None).cast("long"))
    links = stage(sent.unionByName(lists).repartition(parts, *PLACE).sortWithinPartitions(*PLACE, F.col("partners").isNotNull())
                      .mapInArrow(lambda it: _verified(it, threshold, pairs), "a long, b long, others long"), "links")
    member = marked.select("id", "n_words", "c1", "c2").join(kinds.select("c1", "c2", "n_words", "copies", "rep"), ["c1", "c2", "n_words"], "left")
    return member.select("id", "n_words", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), links


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with ``_row``, a number for each distinct (id, text), in the order of the ids; a missing id comes last."""
    order = [F.asc_nulls_last("_id"), F.col("_h")]
    keys = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h")).distinct()
    keys = stage(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_h"))
    return docs.join(keys, same).drop("_h")


def plain_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether the ids are whole numbers that stand for one row each."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return False
    ids = docs.select(F.col(id_col).alias("id"))
    return ids.where("id IS NULL").isEmpty() and not repeated_ids(ids)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    member, links = jaccard_links(docs, id_col, text_col, words, threshold)
    partners = links.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("others").alias("others"))
    known = components(links.where("b IS NOT NULL")).withColumnRenamed("node", "rep").join(partners, "rep", "left")
    return member.join(known, "rep", "left").select(
        F.col("id").alias(id_col), F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("group_id"),
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "n_words")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, class_id (smallest id with the same words), group_id (smallest id linked over any path), n_links (other
    documents at the threshold or above), n_words."""
    if plain_ids(docs, id_col):
        return _near_duplicates(docs, id_col, text_col, words, threshold)
    rows = numbered(docs, id_col, text_col)
    names = stage(rows.select("_row", "_id").distinct(), "names")
    found = _near_duplicates(rows, "_row", text_col, words, threshold)
    for column in ("class_id", "group_id"):
        found = found.join(names.select(F.col("_row").alias(column), F.col("_id").alias("_" + column)), column, "left").drop(column)
    return found.join(names, "_row").select(F.col("_id").alias(id_col), F.col("_class_id").alias("class_id"), F.col("_group_id").alias("group_id"), "n_links", "n_words")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that have a smaller one (by id, then text hash) in their group; columns as given."""
    plain = plain_ids(docs, id_col)
    rows, key = (docs, id_col) if plain else (numbered(docs, id_col, text_col), "_row")
    found = _near_duplicates(rows, key, text_col, WORDS, THRESHOLD)
    gone = found.where(F.col(key) != F.col("group_id")).select(F.col(key).alias("_gone"))
    kept = rows.join(gone.distinct(), F.col(key) == F.col("_gone"), "left_anti")
    return kept if plain else kept.dropDuplicates(["_row"]).select(*docs.columns)
