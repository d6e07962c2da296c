"""Alignment of two tokenizers' tokens by the places where both end.

The character offsets of a ``tokenizers`` encoding and the spans of a ``sentencepiece`` proto are coarse cuts: a token ends at its offset unless
it shares a character with the next one.  Tokens inside a multibyte character and byte-fallback tokens are placed by their decoded bytes.
Byte offsets where tokens of both end cut the text into groups; a link is a pair of tokens of one group.

A space behind something that is not white space starts a new token in both (no piece of the model has a space behind another character; checked),
so texts are cut there, and a worker remembers the segments it meets most often, up to a bound in bytes.  Documents are taken in blocks of bounded size.  A block lists its
distinct id pairs with the number of its documents that hold each; only these lists are shuffled, to be counted over the corpus and sent back.
So no document is shuffled, and a frequent pair is one row per block.  The best count of a first id is one row per id of the vocabulary.

Cases: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens; each row gives a row and counts as a
document, also repeated ones; ids may be null and of any type; a long text is a block of its own and never cut; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import small_batches
from .common import stage

#: Characters of text in a block, and of new segments that are encoded together.
BLOCK_CHARS = 4_000_000
TOGETHER = 100_000
#: Segments that a worker remembers between blocks, and bytes of them: a segment without spaces can be long.
REMEMBER = 360_000
REMEMBER_BYTES = 128 << 20
#: About what a remembered segment takes beside its text, its lists and its pairs.
OBJECTS = 250
#: Rows, and bytes of text, that are cut into segments together.
ROWS = 256
ROWS_BYTES = 1 << 20
#: Bytes of documents that Spark hands to a worker at once.
BATCH_BYTES = 4 << 20
#: Links of a group above which its distinct ids are paired instead of its tokens.
WIDE = 1_000
SEGMENTS = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def in_rows(segments: list[str]) -> list[list[str]]:
    """Segments that can be encoded in one text and be cut from it again; one that ends in white space is by itself."""
    rows: list[list[str]] = []
    size = TOGETHER
    for segment in segments:
        size += len(segment)
        if size > TOGETHER or segment[-1].isspace() or rows[-1][-1][-1].isspace():
            rows.append([])
            size = len(segment)
        rows[-1].append(segment)
    return rows


class Aligner:
    """Encodes segments with both tokenizers and remembers what each one contributes."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers
        self.a = tokenizers.Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a space behind another character, so texts can't be cut at spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # Spans count bytes or characters, by version of the library.
        self.b_in_bytes = self.b.encode("é", return_type="proto").pieces[-1].end == 2
        # How an id is written inside a list and at its end.
        self.written = [np.array([b"%d%s" % (i, mark) for i in range(n)], object) for n, marks in ((len(self.a_bytes), (b",", b"|")), (len(pieces), (b",", b";"))) for mark in marks]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.shown = array("q"), []
        self.codes, self.times, self.starts = array("q"), array("q"), array("q", [0])
        self.hits, self.held = np.zeros(0, np.int64), 0

    def used(self, segments: np.ndarray, documents: np.ndarray) -> None:
        self.seen()[segments] += documents

    def seen(self) -> np.ndarray:
        """In how many documents each segment was met."""
        self.hits = np.append(self.hits, np.zeros(len(self.shown) - len(self.hits), np.int64))
        return self.hits

    def tidy(self) -> None:
        """Beyond REMEMBER segments or REMEMBER_BYTES, keep those that were met in the most documents, up to half of both."""
        if len(self.known) <= REMEMBER and self.held <= REMEMBER_BYTES:
            return
        hits, starts, names = self.seen(), view(self.starts), list(self.known)
        weights = OBJECTS + 16 * np.diff(starts) + np.fromiter((len(x) + len(y or b"") for x, y in zip(names, self.shown, strict=True)), np.int64, len(names))
        order = np.argsort(-hits, kind="stable")[:REMEMBER // 2]
        order = order[(hits[order] > 1) & (np.cumsum(weights[order]) <= REMEMBER_BYTES // 2)]
        index = np.sort(order)
        lengths = np.diff(starts)[index]
        where = np.arange(lengths.sum()) + np.repeat(starts[index] - (np.cumsum(lengths) - lengths), lengths)
        sizes, shown = view(self.sizes).reshape(-1, 4)[index], [self.shown[i] for i in index.tolist()]
        codes, times, hits, held = view(self.codes)[where], view(self.times)[where], hits[index] // 2, int(weights[index].sum())
        self.forget()
        self.known, self.shown, self.hits, self.held = {names[i]: k for k, i in enumerate(index.tolist())}, shown, hits, held
        for own, values in ((self.sizes, sizes), (self.codes, codes), (self.times, times), (self.starts, np.cumsum(lengths))):
            own.frombytes(np.ascontiguousarray(values).tobytes())

    def learn(self, new: list[str]) -> None:
        """Encode segments in batches of bounded size."""
        rows, at = in_rows(new), 0
        while at < len(rows):
            to, size = at + 1, sum(map(len, rows[at]))
            while to < len(rows) and size + sum(map(len, rows[to])) <= TOGETHER:
                size += sum(map(len, rows[to]))
                to += 1
            self._learn(rows[at:to])
            at = to

    def _placed(self, ids: np.ndarray, own: np.ndarray, ends: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Byte offset where each token ends: at its span's end if that is its own, else by the decoded bytes since the last one that is."""
        data = [pieces[i] for i in ids.tolist()]
        decoded = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        last = np.maximum.accumulate(np.where(own, np.arange(len(ids)), -1))
        base = np.where(last >= 0, np.where(own, ends, 0)[last] - decoded[last], 0)
        return np.where(own, ends, base + decoded), data

    def _learn(self, rows: list[list[str]]) -> None:
        segments, texts = [x for row in rows for x in row], ["".join(row) for row in rows]
        whole = "".join(texts)
        data = whole.encode()
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        bytes_at = np.concatenate([[0], np.cumsum(1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000))])
        chars = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        encoded = self.a.encode_batch(texts, add_special_tokens=False)
        a_ids = np.array([i for enc in encoded for i in enc.ids], np.int64)
        a_ends = bytes_at[np.array([e + c for enc, c in zip(encoded, chars.tolist(), strict=False) for _, e in enc.offsets], np.int64)]
        # The letter in front takes the space that the model adds; its tokens are taken off again.
        found = []
        for proto, c in zip(self.b.encode(["a" + t for t in texts], return_type="proto", num_threads=1), chars.tolist(), strict=False):
            base = (int(bytes_at[c]) if self.b_in_bytes else c) - 1
            found += [(p.id, e + base) for p in proto.pieces if (e := p.end) > 1]
        b_ids, b_ends = np.array([i for i, _ in found], np.int64), np.array([e for _, e in found], np.int64)
        b_ends = b_ends if self.b_in_bytes else bytes_at[b_ends]
        # Of the byte-level tokens inside a character all have its end, so the last one owns it; of byte-fallback ones all but the last have its start.
        a_ends, a_data = self._placed(a_ids, np.append(a_ends[1:] > a_ends[:-1], True), a_ends, self.a_bytes)
        b_ends, b_data = self._placed(b_ids, np.diff(b_ends, prepend=0) > 0, b_ends, self.b_bytes)
        stops = bytes_at[np.cumsum([len(x) for x in segments])]
        good = np.ones(len(segments), bool)
        if b"".join(a_data) != data or b"".join(b_data) != data:
            for ends, pieces in ((a_ends, a_data), (b_ends, b_data)):
                cuts = np.searchsorted(ends, stops, "right").tolist()
                good &= [b"".join(pieces[i:j]) == x.encode() for i, j, x in zip([0, *cuts], cuts, segments, strict=False)]
            if len(rows) < len(segments) and not good.all():  # judge each one by itself
                wrong = [x for x, fine in zip(segments, good, strict=True) if not fine]
                self.learn([x for x, fine in zip(segments, good, strict=True) if fine])
                self._learn([[x] for x in wrong])
                return
        n = len(segments)
        a_seg, b_seg = np.searchsorted(stops, a_ends), np.searchsorted(stops, b_ends)
        if not good.all():
            a_keep, b_keep = good[np.minimum(a_seg, n - 1)] & (a_seg < n), good[np.minimum(b_seg, n - 1)] & (b_seg < n)
            a_ids, a_ends, a_seg, b_ids, b_ends, b_seg = a_ids[a_keep], a_ends[a_keep], a_seg[a_keep], b_ids[b_keep], b_ends[b_keep], b_seg[b_keep]
        both = np.zeros(len(data) + 1, np.uint8)
        both[a_ends] = 1
        both[b_ends] += 2
        cuts = np.flatnonzero(both == 3)
        before = np.cumsum(both == 3) - (both == 3)
        a_group, b_group = before[a_ends], before[b_ends]
        a_size, b_size = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        group_seg = np.searchsorted(stops, cuts)
        links = np.bincount(group_seg, a_size * b_size, n).astype(np.int64)
        sizes = np.stack([np.bincount(a_seg, minlength=n), np.bincount(b_seg, minlength=n), np.bincount(group_seg, minlength=n), links], 1)

        wide = a_size * b_size > WIDE
        b_first = np.concatenate([[0], np.cumsum(b_size)])
        repeats = np.where(wide[a_group], 0, b_size[a_group])
        left = np.repeat(np.arange(len(a_ids)), repeats)
        right = b_first[a_group[left]] + np.arange(len(left)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
        pair, pair_seg, pair_n = a_ids[left] << 32 | b_ids[right], a_seg[left], np.ones(len(left), np.int64)
        for g in np.flatnonzero(wide):  # distinct ids with their numbers, not all pairs of places
            x, k = np.unique(a_ids[a_group == g], return_counts=True)
            y, m = np.unique(b_ids[b_group == g], return_counts=True)
            pair = np.append(pair, (x[:, None] << 32 | y[None]).ravel())
            pair_n = np.append(pair_n, (k[:, None] * m[None]).ravel())
            pair_seg = np.append(pair_seg, np.full(len(x) * len(y), group_seg[g]))
        order = np.lexsort((pair, pair_seg))
        pair, pair_seg, pair_n = pair[order], pair_seg[order], pair_n[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1).astype(bool) | np.diff(pair_seg, prepend=-1).astype(bool)) if len(pair) else np.zeros(0, np.int64)
        self.codes.frombytes(pair[first].tobytes())
        self.times.frombytes((np.add.reduceat(pair_n, first) if len(first) else pair_n).tobytes())
        self.starts.frombytes((self.starts[-1] + np.cumsum(np.bincount(pair_seg[first], minlength=n))).tobytes())
        self.sizes.frombytes(sizes.tobytes())

        a_last, b_last = np.diff(a_group, append=-1) != 0, np.diff(b_group, append=-1) != 0
        inside, bar, comma, end = self.written
        pieces = np.concatenate([np.where(a_last, bar[a_ids], inside[a_ids]), np.where(b_last, end[b_ids], comma[b_ids])])
        ordered = pieces[np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")].tolist()
        to = np.cumsum(sizes[:, 0] + sizes[:, 1]).tolist()
        self.held += OBJECTS * n + len(whole) + sum(map(len, ordered)) + 16 * len(first)
        for i, (x, k, m, fine) in enumerate(zip(segments, [0, *to], to, good.tolist(), strict=False), len(self.shown)):
            self.known[x] = i
            self.shown.append(b"".join(ordered[k:m]) if fine else None)


def view(numbers: array) -> np.ndarray:
    """The numbers as they lie, not copied; drop it before they grow."""
    return np.frombuffer(numbers, np.int64) if numbers else np.zeros(0, np.int64)


def split(text: str) -> list[str]:
    return SEGMENTS.split(" " + text) if text else []


class Block:
    """Documents of a block: their segments, and what each contributes."""

    def __init__(self, aligner: Aligner):
        self.t, self.size = aligner, 0
        aligner.tidy()
        self.ids, self.sums, self.digests, self.uses, self.counts, self.shown = [], [], [], [], [], []

    def add(self, ids: list, texts: list[str], shown: bool = False) -> None:
        t, parts = self.t, [split(x) for x in texts]
        t.learn(list(set().union(*parts).difference(t.known)))
        sizes = view(t.sizes).reshape(-1, 4)
        for parts_of, text in zip(parts, texts, strict=True):
            at = np.fromiter(map(t.known.__getitem__, parts_of), np.int64, len(parts_of))
            listed = [t.shown[i] for i in at.tolist()]
            if None in listed or not parts_of:
                at, listed = at[:0], []
            use, count = np.unique(at, return_counts=True)
            whole = b"".join(listed)[:-1]
            self.sums.append(sizes[at].sum(0))
            self.digests.append(hashlib.sha256(whole).hexdigest() if listed else "")
            if shown:
                self.shown.append(whole.decode())
            self.uses.append(use)
            self.counts.append(count)
            self.size += len(text)
        self.ids += ids

    def row(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        """One row: sums of each document, the block's pairs with their documents, and who uses what, packed."""
        t = self.t
        codes, times, starts = (view(x) for x in (t.codes, t.times, t.starts))
        uses = np.concatenate([*self.uses, np.zeros(0, np.int64)])
        segments, local = np.unique(uses, return_inverse=True)
        lengths = starts[segments + 1] - starts[segments]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        where = np.arange(offsets[-1]) + np.repeat(starts[segments] - offsets[:-1], lengths)
        pairs, pair_at = np.unique(codes[where], return_inverse=True)
        t.used(segments, np.bincount(local, minlength=len(segments)))
        holders, last, at = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64), 0
        for use in self.uses:
            mine = local[at:at + len(use)]
            at += len(use)
            nth = np.arange(int(lengths[mine].sum()))
            held = pair_at[nth + np.repeat(offsets[mine] - (np.cumsum(lengths[mine]) - lengths[mine]), lengths[mine])]
            last[held] = nth
            holders[held[last[held] == nth]] += 1  # each pair of the document once
        docs = np.array([len(u) for u in self.uses], np.int64)
        deltas = np.diff(local, prepend=0)
        packed = [docs, deltas, np.concatenate([*self.counts, np.zeros(0, np.int64)]), lengths, pair_at, times[where]]
        sums = np.array(self.sums, np.int64).reshape(-1, 4)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), one(self.ids, id_type), *[one(sums[:, k], pa.int64()) for k in range(4)], one(self.digests, pa.string()),
             one(pairs, pa.int64()), one(holders, pa.int64()), *[pa.array([pack(x)], pa.binary()) for x in packed]], ROW)


PACKED = ["docs", "uses", "counts", "lengths", "spots", "times"]
ROW = ["block", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "pairs", "holders", *PACKED]


def pack(values: np.ndarray) -> bytes:
    """Numbers of up to 32 bits, by byte planes and compressed."""
    return zlib.compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(-1).astype(np.int64)


_made: dict[tuple[int, int], Aligner] = {}


def _aligner(a_file: bytes, b_file: bytes) -> Aligner:
    """One aligner per worker process and pair of tokenizers."""
    key = (hash(a_file), hash(b_file))
    if key not in _made:
        _made[key] = Aligner(a_file, b_file)
    return _made[key]


def _files(docs: DataFrame, a_path: str | None, b_path: str | None):
    files = []
    for path in (a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")):
        with open(path, "rb") as f:
            files.append(f.read())
    return docs.sparkSession.sparkContext.broadcast(files)  # two vocabularies, of a few megabytes


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        to, start = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while start < batch.num_rows:
            fits = int(np.searchsorted(to, (to[start - 1] if start else 0) + ROWS_BYTES, "right")) - start
            part = batch.slice(start, min(max(fits, 1), ROWS))
            yield part.column("id").to_pylist(), part.column("text").to_pylist()
            start += part.num_rows


def alignment_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per block of documents; write the result before it is used: a block's number belongs to the task that made it."""
    shared = _files(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number, block = _aligner(*shared.value), TaskContext.get().partitionId() << 32, None
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for ids, texts in _in_rows([batch]):
                block = block or Block(t)
                block.add(ids, texts)
                if block.size >= BLOCK_CHARS:
                    yield block.row(number, id_type)
                    number, block = number + 1, None
                    pa.default_memory_pool().release_unused()
        if block:
            yield block.row(number, id_type)

    kind = docs.schema[id_col].dataType.simpleString()
    lists = f"ids array<{kind}>, " + ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links")) + ", digests array<string>, pairs array<long>, holders array<long>"
    return _plain(docs, id_col, text_col).mapInArrow(run, f"block long, {lists}, " + ", ".join(f"{c} binary" for c in PACKED))


def _written_blocks(docs: DataFrame, *names: str | None) -> DataFrame:
    with small_batches(docs.sparkSession, BATCH_BYTES):
        return stage(alignment_blocks(docs, *names), "blocks")


def counted_pairs(blocks: DataFrame) -> DataFrame:
    """Per block and pair: its place in the block's list, and how many documents of the corpus hold it."""
    listed = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("spot", "p")).select("block", "spot", "p.pairs", "p.holders")
    return listed.select("block", "spot", F.col("pairs").alias("pair"), F.sum("holders").over(Window.partitionBy("pairs")).alias("n"))


def first_id(pair: Column) -> Column:
    return F.shiftright(pair, 32)


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Linked id pairs of the corpus: a_id, b_id, n_docs."""
    blocks = _written_blocks(docs, id_col, text_col, a_path, b_path)
    listed = blocks.select(F.inline(F.arrays_zip("pairs", "holders"))).groupBy("pairs").agg(F.sum("holders").alias("n_docs"))
    return listed.select(first_id(F.col("pairs")).cast("int").alias("a_id"), F.col("pairs").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "n_docs")


def token_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links and groups as `a1,a2|b1;a3|b2,b3`."""
    shared = _files(docs, a_path, b_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _aligner(*shared.value)
        for batch in batches:
            for ids, texts in _in_rows([batch]):
                block = Block(t)
                block.add(ids, texts, shown=True)
                sums = np.array(block.sums, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), *[pa.array(sums[:, k]) for k in range(4)], pa.array(block.shown, pa.string())],
                                                 [id_col, "n_a", "n_b", "n_groups", "n_links", "groups"])

    return _plain(docs, id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_a long, n_b long, n_groups long, n_links long, groups string")


def _scored(blocks: pa.Table, counts: pa.Table, id_type: pa.DataType, id_col: str) -> pa.Table:
    """Rows of one block's documents with their counts."""
    _made.clear()  # the worker may be one that made blocks: what it remembers is of no use here
    row = {c: blocks.column(c)[0] for c in ROW}
    docs, deltas, used, lengths, spots, times = (unpack(row[c].as_py()) for c in PACKED)
    order = np.argsort(counts.column("spot").to_numpy(), kind="stable")
    n, best = counts.column("n").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    summed = lambda x, cuts: (c := np.concatenate([[0], np.cumsum(x)]))[cuts[1:]] - c[cuts[:-1]]
    per_segment = [summed(times * x[spots], offsets) if len(spots) else np.zeros(len(lengths), np.int64) for x in (best.astype(np.int64), n)]
    segment, cuts = np.cumsum(deltas), np.concatenate([[0], np.cumsum(docs)])
    totals = [summed(used * x[segment], cuts) if len(segment) else np.zeros(len(docs), np.int64) for x in per_segment]
    flat = lambda c: row[c].values
    return pa.table({id_col: flat("ids").cast(id_type), **{c: flat(c) for c in ("n_a", "n_b", "n_groups", "n_links")},
                     "n_best": pa.array(totals[0], pa.int64()), "count_sum": pa.array(totals[1], pa.int64()), "groups_sha256": flat("digests")})


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = _written_blocks(docs, id_col, text_col, a_path, b_path)
    counted = stage(counted_pairs(blocks), "pairs")
    highest = counted.groupBy(first_id(F.col("pair")).alias("a")).agg(F.max("n").alias("highest"))  # a row per id of the vocabulary
    answers = counted.join(F.broadcast(highest), first_id(F.col("pair")) == F.col("a")).select("block", "spot", "n", (F.col("n") == F.col("highest")).alias("best"))
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = pa.schema(docs.limit(0).select(id_col).toArrow().schema).field(0).type
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda left, right: _scored(left, right, id_type, id_col),
        f"{id_col} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
