"""Passages and character n-grams of Arrow batches of texts as numpy arrays: counted by label, or summed up by a model per text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

GRAM = 3
_BITS = 21  # of a code point
#: Texts are handled in pieces of about this many bytes; a longer text is a piece of its own.
PIECE_BYTES = 2_000_000
#: Up to so many possible n-grams of a piece's characters a table finds the distinct ones, otherwise they are sorted.
TABLE = 1 << 22


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, code points, first point of each row and the total) of a string column, cut into pieces; null is empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
        part = data[offsets[at]:offsets[to]]
        firsts = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        yield at, to, np.frombuffer(part.tobytes().decode().encode("utf-32-le"), "<u4"), firsts[offsets[at:to + 1] - offsets[at]]
        at = to


def cuts(pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (id, text): id, place and piece of all matches that tile the text; null and empty texts have none."""
    def run(batches):
        find = re.compile(pattern).findall
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_binary())
            ids, places, found, size = [], [], [], 0
            for i, text in enumerate(texts):
                got = find(text.as_py().decode(errors="replace"))
                ids.append(np.full(len(got), i))
                places.append(np.arange(len(got), dtype=np.int32))
                found += got
                size += len(text.as_buffer())
                if size >= PIECE_BYTES or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(places)), pa.array(found, pa.string())],
                                                     [batch.schema.names[0], "pos", "passage"])
                    ids, places, found, size = [], [], [], 0
    return run


def grams(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of every n-gram, its place among the distinct ones, the distinct ones as numbers, ascending)."""
    if len(points) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(row[:len(row) - GRAM + 1] == row[GRAM - 1:])
    known = np.zeros(int(points.max()) + 1, bool)
    known[points] = True
    letters = np.flatnonzero(known)
    k, number = len(letters), np.cumsum(known) - 1
    small = number[points]
    code = sum(small[j:len(small) - GRAM + 1 + j] * k ** (GRAM - 1 - j) for j in range(GRAM))[inside]
    if k ** GRAM <= TABLE:
        here = np.bincount(code, minlength=k ** GRAM) > 0
        distinct, place = np.flatnonzero(here), (np.cumsum(here) - 1)[code]
    else:
        distinct, place = np.unique(code, return_inverse=True)
    # The letters ascend, so their numbers put the n-grams in the same order as their code points.
    wide = np.zeros(len(distinct), np.int64)
    for j in range(GRAM):
        wide = (wide << _BITS) | letters[distinct // k ** (GRAM - 1 - j) % k]
    return row[inside], place, wide


def _numbers(texts: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64).reshape(-1, GRAM)
    return sum(points[:, j] << (_BITS * (GRAM - 1 - j)) for j in range(GRAM))


def _texts(numbers: np.ndarray) -> list[str]:
    points = np.stack([(numbers >> (_BITS * (GRAM - 1 - j))) & ((1 << _BITS) - 1) for j in range(GRAM)], axis=1)
    joined = points.astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i:i + GRAM] for i in range(0, len(joined), GRAM)]


def label_counts(labels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (number of the label from 1, text): n-grams with their occurrences under each label, once per piece."""
    def run(batches):
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) - 1
            for a, b, points, bounds in _pieces(batch.column(1)):
                row, place, distinct = grams(points, bounds)
                counts = np.bincount(place * labels + number[a:b][row], minlength=len(distinct) * labels).reshape(-1, labels)
                yield pa.RecordBatch.from_arrays([pa.array(_texts(distinct), pa.string()), *[pa.array(counts[:, i]) for i in range(labels)]],
                                                 ["gram", *[f"_c{i}" for i in range(labels)]])
    return run


def model_arrays(model: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ascending n-grams of a model (gram, logp) and their rows of log probabilities."""
    texts = model.column("gram").to_pylist()
    if not texts:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    numbers = _numbers(texts)
    order = np.argsort(numbers)
    values = model.column("logp").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(texts), -1)
    return numbers[order], values[order]


def sums(model, labels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches whose last column is a text: the other columns and the text's sums by label, null without a known n-gram."""
    def run(batches):
        numbers, values = model.value
        for batch in batches:
            for a, b, points, bounds in _pieces(batch.column(batch.num_columns - 1)):
                row, place, distinct = grams(points, bounds)
                at = np.minimum(np.searchsorted(numbers, distinct), max(len(numbers) - 1, 0))
                known = numbers[at] == distinct if len(numbers) else np.zeros(len(distinct), bool)
                none = np.bincount(row, weights=known[place], minlength=b - a) == 0
                columns = []
                for i in range(labels):
                    weight = np.zeros(len(distinct))
                    weight[known] = values[at[known], i]
                    columns.append(pa.array(np.bincount(row, weights=weight[place], minlength=b - a), mask=none))
                kept = batch.num_columns - 1
                yield pa.RecordBatch.from_arrays([*[batch.column(j).slice(a, b - a) for j in range(kept)], *columns],
                                                 [*batch.schema.names[:kept], *[f"_s{i}" for i in range(labels)]])
    return run
