"""Byte-level BPE with a rank queue.

The bytes of the pre-tokens to encode form a linked list.  Each adjacent pair inside a pre-token that is in the vocabulary stands in the
bucket of its rank; a three-level bitmap over the ranks finds the lowest rank in use by three find-first-set steps.
The positions of that bucket are merged from left to right; entries whose pair has changed meanwhile are stale and skipped.
Every push and pop costs the same whatever the length, so a pre-token of a megabyte takes linear time.  Pre-tokens do not touch
each other, so all new ones of a few hundred rows share one list and one queue, and a rank is looked up once for all of them.

Pre-tokens are encoded once per worker and remembered (bounded, short ones only).  The rank file is read on the driver
and broadcast: a vocabulary has a fixed size of about a megabyte.

Cases: null text is empty text, which has no tokens; texts are never cut; each row gives a row, also repeated ones; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBER = 1_500_000
LONGEST_REMEMBERED = 48
#: Rows whose new pre-tokens are merged together.
ROWS = 256


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class RankQueue:
    """Positions by merge rank; the lowest rank that has any comes first."""

    def __init__(self, ranks: int):
        self.low, self.mid, self.top = [0] * ((ranks >> 6) + 1), [0] * ((ranks >> 12) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        w, a = rank >> 6, rank >> 12
        self.low[w] |= 1 << (rank & 63)
        self.mid[a] |= 1 << (w & 63)
        self.top |= 1 << a

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions in order; the bucket is empty afterwards."""
        a = (self.top & -self.top).bit_length() - 1
        m = self.mid[a]
        w = a << 6 | (m & -m).bit_length() - 1
        bits = self.low[w]
        rank = w << 6 | (bits & -bits).bit_length() - 1
        self.low[w] = bits = bits & (bits - 1)
        if not bits:
            self.mid[a] = m = m & (m - 1)
            if not m:
                self.top &= self.top - 1
        return rank, sorted(self.buckets.pop(rank))


class Tokenizer:
    """Encodes and decodes texts by a rank table."""

    def __init__(self, rank_file: bytes, pattern: str = public_tokenizers.PATTERN):
        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in pairs}
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(self.ranks.values()))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.double = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, packed as 32-bit integers."""
        data, rank_of, queue = b"".join(pieces), self.ranks.get, self.queue
        n = len(data)
        if not n:
            return [b""] * len(pieces)
        ends = np.cumsum([len(x) for x in pieces])
        first = bytearray(n + 1)  # 1 where a pre-token begins, and at the end
        np.frombuffer(first, np.uint8)[np.append(0, ends)] = 1
        codes = np.frombuffer(data, np.uint8)
        start = np.append(self.double[codes[:-1].astype(np.int32) << 8 | codes[1:]], np.int32(-1))
        start[np.frombuffer(first, np.uint8)[1:] == 1] = -1
        there = np.flatnonzero(start >= 0)
        order = there[np.argsort(start[there], kind="stable")]
        by_rank, at = np.unique(start[order], return_index=True)
        for rank, places in zip(by_rank.tolist(), np.split(order, at[1:]), strict=False):
            queue.push(rank, places.tolist())
        pair, token = start.tolist(), self.single[codes].tolist()
        end, before, buckets, push = list(range(1, n + 1)), list(range(-1, n)), queue.buckets, queue.push
        while queue.top:
            rank, places = queue.pop()
            held = 0
            for p in places:
                if pair[p] != rank:
                    continue
                if p < held:
                    push(rank, [p])
                    continue
                middle = end[p]
                stop = end[p] = end[middle]
                token[p], token[middle], pair[middle] = rank, -1, -1
                left = right = -1
                if not first[stop]:
                    before[stop] = p
                    right = rank_of(data[p:end[stop]], -1)
                    if right in buckets:
                        buckets[right].append(p)
                    elif right >= 0:
                        push(right, [p])
                pair[p] = right
                if not first[p]:
                    o = before[p]
                    pair[o] = left = rank_of(data[o:stop], -1)
                    if left in buckets:
                        buckets[left].append(o)
                    elif left >= 0:
                        push(left, [o])
                if -1 < left < rank or -1 < right < rank:  # a new pair comes before the rest of this pre-token
                    held = first.index(1, stop)
        ids = np.array(token, np.int32)
        kept = ids >= 0
        packed, stops = ids[kept].tobytes(), (4 * np.cumsum(kept)[ends - 1]).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def learn(self, texts: list[list[str]]) -> list[str]:
        """Encode the pre-tokens of these texts that are not known, and list those too long to stay."""
        if len(self.known) >= REMEMBER:
            self.known.clear()
        new = list(set().union(*texts).difference(self.known))
        pieces = [x.encode() for x in new]
        whole = [self.ranks.get(x, -1) for x in pieces]
        packed = np.array(whole, np.int32).tobytes()
        made = iter(self.merge([x for x, rank in zip(pieces, whole, strict=True) if rank < 0]))
        self.known.update((x, next(made) if rank < 0 else packed[4 * i:4 * i + 4]) for i, (x, rank) in enumerate(zip(new, whole, strict=True)))
        return [x for x in new if len(x) > LONGEST_REMEMBERED]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.split(text) for text in texts]
        long = self.learn(split)
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, text)), np.int32) for text in split]
        for x in long:
            del self.known[x]
        return ids

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_made: dict[tuple[int, str], Tokenizer] = {}


def _tokenizer(file: bytes, pattern: str) -> Tokenizer:
    """One tokenizer per worker process and vocabulary."""
    key = (hash(file), pattern)
    if key not in _made:
        _made[key] = Tokenizer(file, pattern)
    return _made[key]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                     pattern: str = public_tokenizers.PATTERN, ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, unless ``ids`` is False, token_ids."""
    with open(path or default_path(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(shared.value, pattern)
        shown = {i: str(i).encode() for i in t.pieces}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                got, digests, decoded = t.encode_all(part.column("text").to_pylist()), [], []
                counts = [len(x) for x in got]
                for text in got:
                    numbers = text.tolist()
                    digests.append(hashlib.sha256(b" ".join(map(shown.__getitem__, numbers))).hexdigest())
                    decoded.append(hashlib.sha256(t.decode(numbers)).hexdigest())
                out = [part.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    ends = pa.array([0, *accumulate(counts)], pa.int32())
                    out.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(got or [np.zeros(0, np.int32)]), pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(out, names)

    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if ids else ""))


def decode_documents(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """Per row: id and text_bytes, the bytes that the ids stand for; null ids give no bytes."""
    with open(path or default_path(), "rb") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(shared.value, public_tokenizers.PATTERN)
        for batch in batches:
            texts = [t.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary())], [id_col, "text_bytes"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"{id_col} {kind}, text_bytes binary")

