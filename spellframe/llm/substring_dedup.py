"""Removal of repeated passages: suffix arrays over shared regions, expanded to a minimum length on their Burrows-Wheeler transform.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

1. Every window of ``LENGTH`` bytes has an anchor, the 24-byte gram in it with the least hash; equal windows have equal anchors.  Anchors that
   occur in two documents are found by hash: first within some megabytes of input, then, with one entry for each of these, between them.
2. Around each shared anchor the segment of its windows is cut out.  Equal segments inside a group of documents are settled there; the
   first document's entry goes to the bucket of the anchor's hash, where all segments with that anchor meet.
3. In a bucket equal segments are settled too: behind the smallest id they go whole.  Where an anchor has segments that differ, these
   are joined to a text and its suffixes sorted.  Breadth-first backward extension on the
   Burrows-Wheeler transform finds the common prefixes of neighbouring suffixes in increasing order: boundaries of the intervals of all
   strings of n bytes give, one step back along each letter, those of n + 1 bytes.  It stops at ``LENGTH``; suffixes not parted then share a window.
   The smallest id in an interval decides for every entry of it.
4. The removed runs meet their documents again.

A passage that fills a third of the corpus has one entry per group of some megabytes, and a document's own text never meets
another document's outside of shared segments.

Cases: null text is empty text; texts under LENGTH bytes keep all; rows that repeat an id do not remove from each other; a row without an id counts as larger than
every id; each row gives a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_counts
from .word_arrays import _BACK, _STEP, _U, _VALUE, _power, mix, pieces

LENGTH = 50
GRAM = 24
#: Bytes of corpus that a bucket stands for.
BUCKET_BYTES = 16_000_000
#: Bytes of documents that meet their results together, and of input whose anchors are listed together; rows in the shuffles grow with buckets times
#: groups and buckets times lists.
GROUP_BYTES = JOINT_BYTES = 8_000_000
#: Bytes of distinct segments whose suffixes are sorted at once.
SORT_BYTES = 600_000
NOBODY = np.iinfo(np.int64).max
_codec = pa.Codec("zstd", 1)


def _rolling(data: np.ndarray) -> np.ndarray:
    """Running sum from which the hash of any stretch follows."""
    out = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUE[data] * _power("ahead", _STEP, len(data)), out=out[1:])
    return out


def _stretch(total: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((total[stop] - total[start]) * _power("back", _BACK, n)[start] + (stop - start).astype(_U))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first and last window start, row) of each anchor in order, and the running sum."""
    total, n = _rolling(data), len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(_U), none, none, none, total
    with np.errstate(over="ignore"):  # as _stretch, of every place
        grams = mix((total[GRAM:] - total[:-GRAM]) * _power("back", _BACK, n)[:n - GRAM + 1] + _U(GRAM))
    bits = _U(22)
    low = grams >> bits << bits | np.arange(len(grams), dtype=_U) & ((_U(1) << bits) - _U(1))
    span, width = 1, LENGTH - GRAM + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    starts = np.arange(len(low))
    place = starts + ((low.astype(np.int64) - starts) & ((1 << 22) - 1))
    fits = np.ones(n, bool)
    for back in range(1, LENGTH):
        at = offsets[1:] - back
        fits[at[at >= offsets[:-1]]] = False
    starts = np.flatnonzero(fits[:len(low)])
    if not len(starts):
        return none.astype(_U), none, none, none, total
    place = place[starts]
    cut = np.append(True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(starts)) - 1
    return grams[place[first]], starts[first], starts[last], np.searchsorted(offsets, starts[first], "right") - 1, total


def _low(h: np.ndarray) -> np.ndarray:
    return (h >> _U(32)).astype(np.uint32)


def _met(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Per joint of pieces: anchors by bucket, and (bucket < 0) the rows whose anchor another row of the joint has."""
    for whole in batches:
        for part in range(0, whole.num_rows, 50_000):
            batch = whole.slice(part, 50_000)
            keys, held, size = batch.column("key").to_numpy(), [], 0
            for a, b, data, offsets in pieces(batch.column("text")):
                h, _, _, row, _ = anchors(data, offsets)
                held.append((h, row + a))
                size += len(data)
                if size >= JOINT_BYTES or b == batch.num_rows:
                    yield _listed(*(np.concatenate(x) for x in zip(*held, strict=True)), keys, buckets)
                    held, size = [], 0


def _listed(h: np.ndarray, row: np.ndarray, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    once = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[:len(h)]
    h, row = h[once], row[once]
    new = np.append(True, h[1:] != h[:-1])[:len(h)]
    many = ~new
    many[:-1] |= ~new[1:]
    out = []
    if many.any():
        shared_row, shared_low = row[many], _low(h[many])
        order = np.argsort(shared_row, kind="stable")
        out.append((-1 - int(keys[shared_row[0]] % buckets), shared_low[order].tobytes(), None, keys[shared_row[order]].tobytes()))
    mark = np.where(many, 65_535, row).astype(np.uint16)[new]
    h = h[new]
    bucket = (h % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
    for group in np.split(order, cuts[1:]) if len(order) else []:
        marks = mark[group]
        used = np.unique(marks[marks != 65_535])
        marks = np.where(marks == 65_535, 65_535, np.searchsorted(used, marks)).astype(np.uint16)
        out.append((int(bucket[group[0]]), _low(h[group]).tobytes(), marks.tobytes(), keys[used].tobytes()))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64())] + [pa.array(c, pa.binary()) for c in columns[1:]], ["bucket", "lows", "rows", "names"])


def _shared(table: pa.Table, groups: int) -> pa.Table:
    """By group of documents, (key, low) of the anchors that another piece, or another row of the piece, has too."""
    lows = [np.frombuffer(x, np.uint32) for x in table.column("lows").to_pylist()]
    if table.column("bucket")[0].as_py() < 0:
        key = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("names").to_pylist()])
        low = np.concatenate(lows)
    else:
        key, real = [], []
        for marks, ids in zip(table.column("rows").to_pylist(), table.column("names").to_pylist(), strict=True):
            marks, ids = np.frombuffer(marks, np.uint16), np.frombuffer(ids, np.int64)
            real.append(marks != 65_535)
            key.append(ids[np.where(real[-1], marks, 0)] if len(ids) else np.zeros(len(marks), np.int64))
        low, key, real = np.concatenate(lows), np.concatenate(key), np.concatenate(real)
        order = np.argsort(low, kind="stable")
        low, key, real = low[order], key[order], real[order]
        same = np.zeros(len(low), bool)
        same[1:] = low[1:] == low[:-1]
        same[:-1] |= same[1:].copy()
        low, key = low[same & real], key[same & real]
    return _by_group(groups, key, low)


def _by_group(groups: int, key: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One row per group of documents with the packed values of its keys."""
    group = np.mod(key, groups)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))[:len(order)]
    parts = np.split(order, cuts[1:]) if len(order) else []
    packed = {f"c{n}": pa.array([c[p].tobytes() for p in parts], pa.binary()) for n, c in enumerate((key, *columns))}
    return pa.table({"part": pa.array([int(group[p[0]]) for p in parts], pa.int64()), **packed})


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()] or [np.zeros(0, kind)])


def _pair(key: np.ndarray, low: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(key.astype(_U) * _STEP + low.astype(_U))


def _segments(docs: pa.Table, found: pa.Table, buckets: int) -> pa.Table:
    """Entries by bucket, and (bucket < 0) runs that are settled inside the group of documents."""
    names = ["bucket", "keys", "docs", "places", "lengths", "lows", "content"]
    kinds = [pa.int64()] + [pa.binary()] * 6
    wanted = np.sort(_pair(_joined(found, "c0", np.int64), _joined(found, "c1", np.uint32)))
    held = []
    for batch in docs.combine_chunks().to_batches() if len(wanted) else []:
        keys, docs_of = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
        for a, b, data, offsets in pieces(batch.column("text")):
            h, first, last, row, total = anchors(data, offsets)
            asked = _pair(keys[a:b][row], _low(h))
            use = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)] == asked)
            h, first, last, row = h[use], first[use], last[use], row[use]
            stop = last + LENGTH
            held.append((h, _stretch(total, first, stop, len(data)), docs_of[a:b][row], keys[a:b][row], first - offsets[row], stop - first, data[_spread(first, stop - first)]))
    out = []
    if held:
        h, content, doc, key, place, lengths, data = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        begin = np.cumsum(lengths) - lengths
        order = np.lexsort((doc, content))
        new = np.append(True, content[order][1:] != content[order][:-1])[:len(order)]
        least = np.zeros(len(order), np.int64)
        if len(order):
            least[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = doc > least
        if later.any():
            k, s, e = _union(key[later], place[later], (place + lengths)[later])
            out.append((-1 - int(k[0] % buckets), k.tobytes(), None, s.astype(np.int32).tobytes(), e.astype(np.int32).tobytes(), None, None))
        go = np.flatnonzero(~later)
        bucket = (h[go] % _U(buckets)).astype(np.int64)
        go = go[np.argsort(bucket, kind="stable")]
        bucket = np.sort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(bucket) != 0)) if len(go) else []
        for group in np.split(go, cuts[1:]) if len(go) else []:
            out.append((int(h[group[0]] % _U(buckets)), key[group].tobytes(), doc[group].tobytes(), place[group].astype(np.int32).tobytes(),
                        lengths[group].astype(np.int32).tobytes(), _low(h[group]).tobytes(), _codec.compress(data[_spread(begin[group], lengths[group])].tobytes(), asbytes=True)))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 7, kinds, strict=True)], names)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Every place of the stretches that begin at ``start``, one stretch after the other."""
    return np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)


def _union(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching runs of a key become one."""
    if not len(key):
        return key, start, stop
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    new = np.append(True, key[1:] != key[:-1])
    # Running maximum of ends within each key.
    group = np.cumsum(new) - 1
    shift = group * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift) - shift
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return key[first], start[first], reach[np.append(first[1:], len(key)) - 1]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text of small codes, sorted by at least their first LENGTH codes; code 0 ends a string, and ends stand in the order of the text.

    The first codes are packed with the place into one number to sort; from then on ranks are doubled, for suffixes that are not told apart yet.
    """
    n, bits = len(text), len(text).bit_length()
    present = np.bincount(text) > 0
    present[0] = False
    dense = np.cumsum(present).astype(_U)
    width = max(1, int(dense[-1]).bit_length())
    done = max(1, min(LENGTH, (64 - bits) // width))
    dense[0] = 0
    padded = np.append(dense[text], np.zeros(done, _U))
    value, ended = np.zeros(n, _U), np.zeros(n, bool)
    for k in range(done):
        value = value << _U(width) | padded[k:n + k]
        ended |= padded[k:n + k] == 0
    mask, shift = _U((1 << bits) - 1), _U(bits)
    packed = np.sort(value << shift | np.arange(n, dtype=_U))
    order = (packed & mask).astype(np.int64)
    packed >>= shift
    head = np.append(True, packed[1:] != packed[:-1]) | ended[order]
    rank = np.zeros(n + 1, _U)  # 0 beyond the text
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)).astype(_U) + _U(1)
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
    while done < LENGTH and len(open_):
        here = order[open_]
        own, behind = rank[here], rank[here + done]
        if 3 * bits <= 64:
            packed = np.sort((own << shift | behind) << shift | here.astype(_U))
            here = (packed & mask).astype(np.int64)
            packed >>= shift
            head = np.append(True, packed[1:] != packed[:-1])
        else:
            by = np.lexsort((behind, own))
            here, own, behind = here[by], own[by], behind[by]
            head = np.append(True, (own[1:] != own[:-1]) | (behind[1:] != behind[:-1]))
        order[open_] = here
        rank[here] = np.maximum.accumulate(np.where(head, open_, 0)).astype(_U) + _U(1)
        open_ = open_[~(head & np.append(head[1:], True))]
        done *= 2
    return order


def intervals(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Number of the interval of suffixes, by rank, that share a prefix of the length; code 0 ends a string and equals nothing."""
    n = len(text)
    before = text[order - 1]  # the transform; the text ends with code 0, so the suffix at 0 has it before
    step = np.argsort(before, kind="stable")  # step[j]: the rank whose suffix, one code longer, has rank j
    first = text[order]
    parted = np.append(True, (first[1:] != first[:-1]) | (first[1:] == 0))
    # Neighbours j - 1, j of one letter came from ranks a, b; they part at n + 1 codes if a and b are parted at n.
    unknown = np.flatnonzero(~parted)
    a, b = step[unknown - 1], step[unknown]
    near = b == a + 1  # most are; a, b part with b then
    unknown, near, far, a, b = unknown[~near], unknown[near], b[near], a[~near], b[~near]
    label = np.empty(n, np.int32)
    for _ in range(1, length):
        if not len(unknown) and not len(near):
            break
        apart = parted[far]
        if len(unknown):
            np.cumsum(parted, dtype=np.int32, out=label)
            wide = label[a] != label[b]
            parted[unknown[wide]] = True
            unknown, a, b = unknown[~wide], a[~wide], b[~wide]
        parted[near[apart]] = True
        near, far = near[~apart], far[~apart]
    return np.cumsum(parted) - 1


def _decide(segments: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (segment, start, stop) of distinct segments, one after the other, whose strings also stand in a segment with a smaller id."""
    at = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.int16)
    text[_spread(at, size)] = segments.astype(np.int16) + 1
    order = suffix_order(text)
    label = intervals(text, order)
    owner = np.repeat(least, size + 1)
    lowest = np.minimum.reduceat(owner[order], np.flatnonzero(np.append(True, label[1:] != label[:-1])))
    smallest = np.empty(len(text), np.int64)
    smallest[order] = lowest[label]
    windows = size - LENGTH + 1
    start = _spread(np.zeros(len(size), np.int64), windows)
    gone = smallest[np.repeat(at, windows) + start] < np.repeat(least, windows)
    segment, start = np.repeat(np.arange(len(size)), windows)[gone], start[gone]
    new = np.append(True, (segment[1:] != segment[:-1]) | (start[1:] != start[:-1] + 1))[:len(segment)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(segment))[:len(first)] - 1
    return segment[first], start[first], start[last] + LENGTH


def _removed(table: pa.Table, groups: int) -> pa.Table:
    """Removed runs of one bucket, by group of documents.

    Equal segments of an anchor are one: behind the smallest id they go whole.  Anchors with several are sorted, a part of their hashes at a time.
    """
    key, place, lengths = _joined(table, "keys", np.int64), _joined(table, "places", np.int32).astype(np.int64), _joined(table, "lengths", np.int32).astype(np.int64)
    if table.column("bucket")[0].as_py() < 0:  # settled: places and ends
        return _by_group(groups, key, place.astype(np.int32), lengths.astype(np.int32))
    doc, lows = _joined(table, "docs", np.int64), _joined(table, "lows", np.uint32)
    stops = np.cumsum(lengths)
    sizes = np.diff(np.concatenate([[0], stops[np.cumsum([len(x) // 8 for x in table.column("keys").to_pylist()]) - 1]]))
    data = np.concatenate([np.frombuffer(_codec.decompress(x, int(n)), np.uint8) for x, n in zip(table.column("content").to_pylist(), sizes, strict=True)])
    begin = stops - lengths
    content = []
    for part in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(stops // SORT_BYTES)) + 1):
        low = begin[part[0]]
        content.append(_stretch(_rolling(data[low:stops[part[-1]]]), begin[part] - low, stops[part] - low, int(stops[part[-1]] - low)))
    _, kind, which = np.unique(_pair(np.concatenate(content), lows), return_index=True, return_inverse=True)
    least = np.full(len(kind), NOBODY)
    np.minimum.at(least, which, doc)
    later = doc > least[which]
    out = [(key[later], place[later], (place + lengths)[later])]
    kind_low, size = lows[kind], lengths[kind]
    order = np.argsort(kind_low, kind="stable")
    new = np.append(True, kind_low[order][1:] != kind_low[order][:-1])
    several = ~(new & np.append(new[1:], True))
    order, firsts = order[several], np.flatnonzero(new[several])
    # A part begins with a new hash once the one before is full.
    filled = np.cumsum(size[order]) // SORT_BYTES
    firsts = firsts[np.append(True, filled[firsts[1:]] != filled[firsts[:-1]])] if len(firsts) else firsts
    owners = np.flatnonzero(~later)
    owners = owners[np.argsort(which[owners], kind="stable")]
    for group in np.split(order, firsts[1:]) if len(firsts) else []:
        segment, start, stop = _decide(data[_spread(begin[kind[group]], size[group])], size[group], least[group])
        low = np.searchsorted(which[owners], group[segment])
        times = np.searchsorted(which[owners], group[segment], "right") - low
        entry = owners[_spread(low, times)]
        out.append((key[entry], place[entry] + np.repeat(start, times), place[entry] + np.repeat(stop, times)))
    key, start, stop = _union(*(np.concatenate(x) for x in zip(*out, strict=True)))
    return _by_group(groups, key, start.astype(np.int32), stop.astype(np.int32))


def _cut(docs: pa.Table, found: pa.Table) -> pa.Table:
    """What remains of each document."""
    key, start, stop = _union(_joined(found, "c0", np.int64), _joined(found, "c1", np.int32).astype(np.int64), _joined(found, "c2", np.int32).astype(np.int64))
    out = []
    for k, text in zip(docs.column("key").to_pylist(), docs.column("text"), strict=True):
        data = text.as_py().encode()
        here = slice(np.searchsorted(key, k), np.searchsorted(key, k, "right"))
        left, at = [], 0
        for s, e in zip(start[here].tolist(), stop[here].tolist(), strict=True):
            left.append(data[at:s])
            at = e
        left.append(data[at:])
        out.append((len(data), int((stop[here] - start[here]).sum()), len(left) - 1, b"".join(left)))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()),
                     "n_spans": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in columns[3]], pa.string()),
                     "kept": pa.array(columns[3], pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes."""
    _, size = row_counts(docs, text_col)
    buckets, groups = max(1, size // BUCKET_BYTES), max(1, size // GROUP_BYTES)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NOBODY)).alias("doc"),
                       F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    placed = rows.select("*", F.pmod("key", F.lit(groups)).alias("part"))
    met = rows.select("key", "text").mapInArrow(lambda it: _met(it, buckets), "bucket long, lows binary, rows binary, names binary")
    shared = met.groupBy("bucket").applyInArrow(lambda t: _shared(t, groups), "part long, c0 binary, c1 binary")
    cut = placed.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(
        lambda d, f: _segments(d, f, buckets), "bucket long, keys binary, docs binary, places binary, lengths binary, lows binary, content binary")
    runs = cut.groupBy("bucket").applyInArrow(lambda t: _removed(t, groups), "part long, c0 binary, c1 binary, c2 binary")
    found = placed.groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return found.withColumnRenamed("doc_id", id_col)
