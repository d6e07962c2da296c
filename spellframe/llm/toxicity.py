"""Toxicity by a convolutional text classifier in numpy.

Words are hashed to embedding rows: a word's vector is the sum of those of the whole word and of its first 4, 5 and 6 bytes, so
that it is known in other inflections too.  Filters of widths 1, 2 and 3 slide over them, each filter keeps its maximum over the whole
text, and a logistic unit reads the maxima.  Trained with Adam; a word or beginning has an embedding if at least ``SEEN`` labelled
documents hold it (and one in ``SHARE`` of them, if that is asked for), all others share the zero vector.  There are at most ``BUCKETS``.

Thresholds are calibrated by language: the language is guessed from common words of the text itself, and the raw output is shifted by
the threshold of that language, so that 0.5 always is the decision.  Labels, lang, source and id never enter a score.

Counts, model and thresholds are fitted on all labelled documents outside the held-out fifth, over their whole texts.  They are dealt over
parts of about ``PART_ROWS`` rows, kept on the executors' disks while they are read again.  In each round every part trains from the common
model and the models are averaged by their rows, an embedding over the parts that moved it; a single part makes all its passes in one round.
Every document is passed ``EPOCHS`` times, whatever the number of parts.  One labelled document in five (by hash of its id) is kept from the network and sets the thresholds, from counts by language and by raw output in steps of 1/``STEPS``.

Cases: null and empty texts get the score of a text without known words; null texts and null or contradicting labels are not learnt from; without labels of both kinds every
score is 0; each row gives a row, also repeated ones; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_counts
from .word_arrays import pieces, word_hashes

PART_ROWS, PART_BYTES = 15_000, 64 << 20
ROUNDS = 5
FOLDS = 5
BUCKETS = 1 << 22
SEEN, SHARE = 3, None
STEPS, FURTHEST = 256, 64
BITS_A_ROW, MAP_BITS = 16, 1 << 15
SLICE = ROWS = 1 << 13
PREFIXES = (4, 5, 6)
DIM, FILTERS, WIDTHS = 8, 12, (1, 2, 3)
EPOCHS, BATCH, BATCH_WORDS, RATE = 10, 64, 400_000, 0.02

#: Frequent words that tell languages apart.
COMMON = {
    "en": "the of and to in is that it was for with as on be by at this from are have",
    "de": "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es",
    "fr": "le la les et des du en un une que est pour dans qui par sur au pas plus avec",
    "es": "el los las y del se por con una su para al lo como más pero sus le ya que",
}


def _language_table() -> np.ndarray:
    table = np.zeros(BUCKETS, np.int8)
    for number, (_, listed) in enumerate(sorted(COMMON.items()), 1):
        data = np.frombuffer(listed.encode(), np.uint8)
        table[_buckets(data, np.array([0, len(data)]))[0][:, 0]] = number
    return table


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding buckets of every word and of its beginnings."""
    hashes, bounds = word_hashes(data, offsets, PREFIXES)
    return (hashes % np.uint64(BUCKETS)).astype(np.int32), bounds


def _packed(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts that may have a label, compressed one by one: what is moved once and read again from disk in each round is half as long."""
    for batch in batches:
        at = batch.column("at").to_numpy()
        batch = batch.filter(pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0))
        texts = [t.as_buffer() for t in batch.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([t.size for t in texts], pa.int64()),
                                          pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in texts], pa.binary())], ["id", "size", "packed"])


def _marked(at: Column, df: DataFrame, number: int) -> np.ndarray:
    """A map of ``number`` bits, eight to a byte, with those of ``at`` set."""
    # Spark's maps count bits from 1.
    maps = df.groupBy(F.bitmap_bucket_number(at + 1).alias("map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits")).collect()
    out = np.zeros((-(-number // MAP_BITS), MAP_BITS // 8), np.uint8)
    for r in maps:
        out[r["map"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _texts(batch: pa.RecordBatch) -> pa.Array:
    both = zip(batch.column("packed"), batch.column("size").to_pylist(), strict=True)
    return pa.array([pa.decompress(p.as_buffer(), n, codec="zstd", asbytes=True) if n else b"" for p, n in both], pa.large_binary())


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of documents of a part that hold each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for a, b, data, offsets in pieces(_texts(batch)):
            buckets, bounds = _buckets(data, offsets)
            text = np.repeat(np.arange(b - a), np.diff(bounds))
            both = np.sort(text[:, None] * BUCKETS + buckets, axis=None)
            np.add.at(counts, both[np.append(True, both[1:] != both[:-1])[:len(both)]] % BUCKETS, 1)
    used = np.flatnonzero(counts)
    for at in range(0, len(used), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(used[at:at + (1 << 16)], pa.int32()), pa.array(counts[used[at:at + (1 << 16)]])], ["bucket", "n"])


class Network:
    """Embedding, convolutions, maximum over the text, logistic output."""

    def __init__(self, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (rows, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS + 1).astype(np.float32)
        self.out[-1] = -2.0

    def shared(self) -> list[np.ndarray]:
        """The weights that every text moves."""
        return [self.out, *self.filters, *self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.shared()])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for w in self.shared():
            w[...] = flat[at:at + w.size].reshape(w.shape)
            at += w.size

    def maxima(self, ids: np.ndarray, bounds: np.ndarray, places: bool = False):
        """Largest response of every filter in every text (0 at least) and, if asked for, where it is."""
        n = len(bounds) - 1
        top = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        where = np.full(top.shape, -1, np.int64)
        some = np.flatnonzero(np.diff(bounds))
        if not len(some):
            return top, (where, np.zeros((0, ids.shape[1]), np.int32), np.zeros((0, DIM), np.float32)) if places else where
        # Texts are followed by zero vectors, so that no window reaches into the next text.
        pad = max(WIDTHS) - 1
        moved = np.arange(len(ids)) + pad * np.repeat(np.arange(n), np.diff(bounds))
        padded = np.zeros((len(ids) + pad * n + pad, ids.shape[1]), np.int32)
        padded[moved] = ids
        x = self.embed[padded[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.embed[padded[:, k]]
        starts = (bounds[:-1] + pad * np.arange(n))[some]
        total = len(padded) - pad
        for k, w in enumerate(WIDTHS):
            response = sum(x[j:total + j] @ self.filters[k][j * DIM:(j + 1) * DIM] for j in range(w)) + self.bias[k]
            best = np.maximum.reduceat(response, starts, axis=0)
            top[some, k * FILTERS:(k + 1) * FILTERS] = np.maximum(best, 0)
            if places:
                length = np.diff(np.append(starts, total))
                text = np.repeat(np.arange(len(starts)), length)
                # Texts without words may stand before the first one.
                f, hit = np.divmod(np.flatnonzero(np.ascontiguousarray(response[starts[0]:].T) == np.repeat(best.T, length, axis=1)), len(text))
                first = np.full((FILTERS, len(starts)), -1, np.int64)
                first[f[::-1], text[hit[::-1]]] = hit[::-1] + starts[0]
                where[some, k * FILTERS:(k + 1) * FILTERS] = np.where(best > 0, first.T, -1)
        return top, (where, padded, x) if places else where

    def raw(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        top, _ = self.maxima(ids, bounds)
        return (top @ self.out[:-1] + self.out[-1]).astype(np.float64)

    def train(self, texts: list[np.ndarray], toxic: np.ndarray, passes: int = EPOCHS, seed: int = 6) -> np.ndarray:
        """Embedding rows that were moved.  A row without a gradient so far stays as it is; the others are placed first, and Adam goes over these."""
        rng = np.random.default_rng(seed)
        names = self.shared()
        first, second = [np.zeros_like(p) for p in names], [np.zeros_like(p) for p in names]
        place, row_at = (np.arange(len(self.embed), dtype=np.int32) for _ in range(2))
        means, squares, gradient = (np.zeros((1, DIM), np.float32) for _ in range(3))
        step, moved = 0, 1  # place 0 stays for words without an embedding
        for _ in range(passes):
            for chosen in _batches(rng.permutation(len(texts)), texts):
                bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in chosen])])
                top, (where, padded, x) = self.maxima(place[np.concatenate([texts[i] for i in chosen])], bounds, True)
                y = toxic[chosen]
                p = 1 / (1 + np.exp(-np.clip(top @ self.out[:-1] + self.out[-1], -30, 30)))
                delta = ((p - y) * np.where(y == 1, 3.0, 1.0) / len(chosen)).astype(np.float32)
                grads = [np.append(delta @ top, delta.sum()).astype(np.float32), *[np.zeros_like(w) for w in self.filters], *[np.zeros_like(b) for b in self.bias]]
                back = np.outer(delta, self.out[:-1])
                rows, changes = [np.zeros(0, np.int32)], [np.zeros((0, DIM), np.float32)]
                for k, w in enumerate(WIDTHS):
                    for f in range(FILTERS):
                        c = k * FILTERS + f
                        used = np.flatnonzero(where[:, c] >= 0)
                        if not len(used):
                            continue
                        places, g = where[used, c], back[used, c]
                        window = np.concatenate([x[places + j] for j in range(w)], axis=1)
                        grads[1 + k][:, f] += g @ window
                        grads[1 + len(WIDTHS) + k][f] += g.sum()
                        for j in range(w):
                            rows.append(padded[places + j].T.ravel())
                            changes += [np.outer(g, self.filters[k][j * DIM:(j + 1) * DIM, f])] * padded.shape[1]
                rows, changes = np.concatenate(rows), np.concatenate(changes)
                rows, changes = rows[rows > 0], changes[rows > 0]
                new = np.unique(rows[rows >= moved], return_index=True)[0]
                if len(new):
                    ids, room = row_at[rows], np.arange(moved, moved + len(new))
                    moved += len(new)
                    new, room = np.setdiff1d(new, room), np.setdiff1d(room, new)
                    row_at[new], row_at[room] = row_at[room], row_at[new]
                    place[row_at[new]], place[row_at[room]] = new, room
                    self.embed[new], self.embed[room] = self.embed[room], self.embed[new]
                    rows = place[ids]
                if moved > len(means):
                    more = np.zeros((moved, DIM), np.float32)
                    means, squares, gradient = np.concatenate([means, more]), np.concatenate([squares, more]), np.zeros((len(means) + moved, DIM), np.float32)
                gradient[:moved] = 0
                np.add.at(gradient, rows, changes)
                step += 1
                for p_, g, m, v in zip(names, grads, first, second, strict=True):
                    _adam(p_, g, m, v, step)
                for at in range(0, moved, ROWS):
                    own = slice(at, min(at + ROWS, moved))
                    _adam(self.embed[own], gradient[own], means[own], squares[own], step)
        self.embed = self.embed[place]
        return np.sort(row_at[1:moved])


def _adam(p: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, step: int) -> None:
    change = g - m
    change *= 0.1
    m += change
    np.multiply(g, g, out=change)
    change -= v
    change *= 0.01
    v += change
    np.divide(m, 1 - 0.9**step, out=change)
    change *= RATE
    root = v / (1 - 0.99**step)
    np.sqrt(root, out=root)
    root += 1e-6
    change /= root
    p -= change


def _batches(order: np.ndarray, texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Up to ``BATCH`` texts of together ``BATCH_WORDS`` words; a longer text is a batch of its own."""
    at = total = 0
    for k, i in enumerate(order):
        if k > at and (k - at == BATCH or total + len(texts[i]) > BATCH_WORDS):
            yield order[at:k]
            at, total = k, 0
        total += len(texts[i])
    if len(order):
        yield order[at:]


def _languages(buckets: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """1, 2, ... for the language with the most common words in each text, 0 without any."""
    n = len(bounds) - 1
    found = table[buckets].astype(np.int64)
    text = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(text * (len(COMMON) + 1) + found, minlength=n * (len(COMMON) + 1)).reshape(n, -1)
    counts[:, 0] = 0
    return counts.argmax(1)


def _threshold(raw: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the best cut between the classes, from their numbers at each raw output; 0 if there is only one class."""
    if not clean.sum() or not toxic.sum():
        return 0.0
    r, at = np.unique(raw, return_inverse=True)
    c, t = np.bincount(at, clean), np.bincount(at, toxic)
    wrong = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum(c[::-1])[::-1], [0]])
    low = np.flatnonzero(wrong == wrong.min())
    k = int(low[len(low) // 2])
    return float((r[max(k - 1, 0)] + r[min(k, len(r) - 1)]) / 2)


def _numbered(kept: np.ndarray) -> np.ndarray:
    """Embedding row of every bucket."""
    mapped = np.zeros(BUCKETS, np.int32)
    mapped[kept] = np.arange(1, len(kept) + 1)
    return mapped


def _train_part(batches: Iterator[pa.RecordBatch], model: bytes, passes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """After training on a part: its number of texts, the weights that all texts share (slice -1) and the embedding rows that it moved, in slices."""
    kept, net = pickle.loads(model)
    mapped, texts, toxic = _numbered(kept), [], []
    for batch in batches:
        toxic += batch.column("toxic").to_pylist()
        for a, b, data, offsets in pieces(_texts(batch)):
            buckets, bounds = _buckets(data, offsets)
            rows = mapped[buckets]
            texts += [rows[bounds[i]:bounds[i + 1]] for i in range(b - a)]
    if not texts:
        return
    moved = net.train(texts, np.array(toxic, np.int64), passes, seed)
    cuts = np.flatnonzero(np.diff(moved // SLICE)) + 1
    groups = [g for g in np.split(moved, cuts) if len(g)]
    yield pa.RecordBatch.from_arrays([pa.array([-1] + [int(g[0] // SLICE) for g in groups], pa.int32()), pa.array([len(texts)] * (len(groups) + 1), pa.int64()),
                                      pa.array([b""] + [g.astype(np.int32).tobytes() for g in groups], pa.binary()),
                                      pa.array([net.flat().tobytes()] + [net.embed[g].tobytes() for g in groups], pa.binary())], ["slice", "n", "rows", "weights"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means by the texts of the parts; those of an embedding row over the parts that moved it.  One running sum is held for each slice."""
    sums: dict[int, list] = {}
    for batch in batches:
        for k, n, rows, values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            values = np.frombuffer(values, np.float32).astype(np.float64)
            if k < 0:
                held = sums.setdefault(k, [np.zeros(1, np.int64), np.zeros((1, len(values)))])
                at = np.zeros(1, np.int64)
            else:
                held = sums.setdefault(k, [np.zeros(SLICE, np.int64), np.zeros((SLICE, DIM))])
                at = np.frombuffer(rows, np.int32) - k * SLICE
            held[0][at] += n
            held[1][at] += n * values.reshape(len(at), -1)
    for k, (n, total) in sums.items():
        at = np.flatnonzero(n)
        mean = (total[at] / n[at, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n[at].sum()], pa.int64()), pa.array([(at + k * SLICE if k >= 0 else at).astype(np.int32).tobytes()], pa.binary()),
                                          pa.array([mean.tobytes()], pa.binary())], ["slice", "n", "rows", "weights"])


def _raw_outputs(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    kept, net = pickle.loads(model)
    mapped, table = _numbered(kept), _language_table()
    for batch in batches:
        for a, b, data, offsets in pieces(_texts(batch)):
            buckets, bounds = _buckets(data, offsets)
            step = np.rint(np.clip(net.raw(mapped[buckets], bounds), -FURTHEST, FURTHEST) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(_languages(buckets[:, 0], bounds, table), pa.int32()), pa.array(step),
                                              batch.column("toxic").slice(a, b - a)], ["lang", "step", "toxic"])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """All documents with one clear label outside the held-out fifth, in parts: id, toxic, size in bytes, packed text, aside."""
    learnt = F.crc32(F.col(id_col).cast("string")) % FOLDS != 0
    clear = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & learnt).groupBy(F.col(id_col).alias("id"))
                   .agg(F.min(label_col).cast("int").alias("toxic"), F.max(label_col).alias("_most")).where("toxic = _most").drop("_most"))
    rows = docs.where(learnt & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    (n, size), wanted = row_counts(rows), clear.count()
    parts = max(1, -(-wanted // PART_ROWS), int(-(-size * min(1.0, wanted / max(n, 1)) // PART_BYTES)))
    # Most documents have no label: a map of the hashes of the ids that have one spares moving them; the join decides.
    number = max(1, wanted) * BITS_A_ROW
    at = F.pmod(F.xxhash64("id"), F.lit(number))
    alike = rows.schema["id"].dataType == clear.schema["id"].dataType  # else equal ids may differ in their hashes
    bits = docs.sparkSession.sparkContext.broadcast(_marked(at, clear, number) if alike else np.full(-(-number // 8), 255, np.uint8))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, size long, packed binary"
    rows = rows.withColumn("at", at).mapInArrow(lambda it: _packed(it, bits.value), kind)
    placed = rows.repartition(parts, "id").join(clear.repartition(parts, "id").hint("shuffle_hash"), "id")
    # The planner widens a join to its own number of partitions; merging them moves no text again.
    return (placed.coalesce(parts).select("id", "toxic", "size", "packed", (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("aside"))
                  .sortWithinPartitions(F.xxhash64("id", F.lit(1)), "id", F.xxhash64("packed")))


def _rounds(parts: int) -> list[int]:
    """Passes over the documents in each round: ``EPOCHS`` together, whatever the number of parts."""
    return [EPOCHS] if parts == 1 else [len(own) for own in np.array_split(np.arange(EPOCHS), ROUNDS)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> bytes | None:
    """The trained model in bytes, None without labels of both kinds."""
    context = docs.sparkSession.sparkContext
    rows = labelled(docs, labels, id_col, text_col, label_col).persist(StorageLevel.DISK_ONLY)  # read once a round
    try:
        number = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        if len(number) < 2:
            return None
        least = max(SEEN, -(-sum(number.values()) // SHARE)) if SHARE else SEEN
        held = rows.select("size", "packed").mapInArrow(_seen, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        kept = np.sort(held.select("bucket").toArrow()["bucket"].to_numpy())
        net = Network(len(kept) + 1)
        learnt = rows.where("NOT aside").select("toxic", "size", "packed")
        parts = rows.rdd.getNumPartitions()
        kind = "slice int, n long, rows binary, weights binary"
        for k, passes in enumerate(_rounds(parts)):
            shared = context.broadcast(pickle.dumps((kept, net)))
            made = learnt.mapInArrow(lambda it, m=shared, seed=6 + k, passes=passes: _train_part(it, m.value, passes, seed), kind)
            for r in made.repartition("slice").mapInArrow(_add, kind).collect():
                weights = np.frombuffer(r["weights"], np.float32)
                if r["slice"] < 0:
                    net.put(weights)
                else:
                    net.embed[np.frombuffer(r["rows"], np.int32)] = weights.reshape(-1, DIM)
            shared.unpersist()
        shared = context.broadcast(pickle.dumps((kept, net)))
        counted = (rows.where("aside").select("toxic", "size", "packed").mapInArrow(lambda it: _raw_outputs(it, shared.value), "lang int, step int, toxic int")
                       .groupBy("lang", "step").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).collect())
        shared.unpersist()
    finally:
        rows.unpersist()
    lang, step, clean, toxic = np.array([tuple(r) for r in counted], np.int64).reshape(-1, 4).T
    raw = step / STEPS
    shifts = np.full(len(COMMON) + 1, _threshold(raw, clean, toxic))
    for k in range(len(COMMON) + 1):
        own = lang == k
        if clean[own].sum() + toxic[own].sum() >= 100 and clean[own].sum() and toxic[own].sum():
            shifts[k] = _threshold(raw[own], clean[own], toxic[own])
    return pickle.dumps((kept, net, shifts))


_loaded: dict[int, tuple] = {}


def _scores(batches: Iterator[pa.RecordBatch], model: bytes | None) -> Iterator[pa.RecordBatch]:
    if model is not None and hash(model) not in _loaded:
        kept, net, shifts = pickle.loads(model)
        _loaded.clear()
        _loaded[hash(model)] = (_numbered(kept), net, shifts, _language_table())
    for batch in batches:
        for a, b, data, offsets in pieces(batch.column("text")):
            score = np.zeros(b - a)
            if model is not None:
                mapped, net, shifts, table = _loaded[hash(model)]
                buckets, bounds = _buckets(data, offsets)
                raw = net.raw(mapped[buckets], bounds) - shifts[_languages(buckets[:, 0], bounds, table)]
                score = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(score)], ["id", "score"])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = rows.mapInArrow(lambda it: _scores(it, model.value), f"id {rows.schema['id'].dataType.simpleString()}, score double")
    held: Column = F.coalesce(F.crc32(F.col("id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
