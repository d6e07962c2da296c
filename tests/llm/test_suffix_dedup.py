"""Suffixes are sorted of what differs only, and rows of the shuffles do not grow with the pieces of the input."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spellframe.llm import substring_dedup, word_arrays


def _say(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def _bucket(rows):
    """All entries of the texts (doc, text), each a group of its own, in one bucket; and the rows as a table."""
    keys = pa.array(range(len(rows)), pa.int64())
    docs = pa.table({"key": keys, "doc": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows])})
    met = pa.Table.from_batches(list(substring_dedup._met(iter(docs.select(["key", "text"]).combine_chunks().to_batches()), 1)))
    found = [substring_dedup._shared(met.filter(pc.equal(met["bucket"], b)), 1) for b in met["bucket"].unique().to_pylist()]
    found = pa.concat_tables(found)
    return pa.concat_tables([substring_dedup._segments(docs.slice(i, 1), found, 1) for i in range(len(rows))])


def _runs(table):
    got = substring_dedup._removed(table, 1)
    joined = [substring_dedup._joined(got, c, k).tolist() for c, k in (("c0", np.int64), ("c1", np.int32), ("c2", np.int32))]
    return sorted(zip(*joined, strict=True))


def _brute(rows):
    first, want = {}, []
    for d, t in rows:
        for p in range(len(t) - 49):
            first[t[p:p + 50]] = min(d, first.get(t[p:p + 50], d))
    for key, (d, t) in enumerate(rows):
        gone = np.zeros(len(t) + 2, np.int8)
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < d:
                gone[p + 1:p + 51] = 1
        edges = np.flatnonzero(np.diff(gone))
        want += [(key, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return want


def test_equal_segments_are_not_sorted(monkeypatch):
    """Copies of a text, also of rows that repeat an id or have a number above the others, are settled without a sort; changed ones are sorted."""
    rng, sorted_ = random.Random(3), []
    inner = substring_dedup.suffix_order
    monkeypatch.setattr(substring_dedup, "suffix_order", lambda text: sorted_.append(len(text)) or inner(text))
    text = _say(rng, 60)
    rows = [(d, text) for d in (7, 3, 3, 9, substring_dedup.NOBODY)]
    assert _runs(_bucket(rows)) == _brute(rows) and not sorted_
    rows += [(11, text[:150] + "#" + text[151:]), (1, _say(rng, 5) + text[100:220] + _say(rng, 5)), (12, text[120:])]
    for bytes_ in (substring_dedup.SORT_BYTES, 200):
        monkeypatch.setattr(substring_dedup, "SORT_BYTES", bytes_)
        sorted_.clear()
        assert _runs(_bucket(rows)) == _brute(rows) and 0 < sum(sorted_)


def test_suffix_order_and_intervals():
    """Sorted by at least 50 codes, and intervals are exactly the classes of equal strings of 50 codes; repetitive and many-lettered texts."""
    rng = np.random.default_rng(2)
    unit = rng.integers(1, 257, 70)
    parts = [np.tile(rng.integers(1, 3, 3), 60), unit, np.append(unit[5:], 9), np.full(130, 4), np.full(90, 4), unit[:55], rng.integers(1, 257, 300)]
    text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int16)
    order = substring_dedup.suffix_order(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    heads = [text[i:i + 50].tolist() for i in range(len(text))]
    heads = [h[:h.index(0)] + [0] if 0 in h else h for h in heads]
    assert all(heads[a] <= heads[b] for a, b in zip(order[:-1], order[1:], strict=True))
    label = substring_dedup.intervals(text, order)
    whole = [j for j, i in enumerate(order) if 0 not in heads[i]]
    of = {}
    for j in whole:
        of.setdefault(tuple(heads[order[j]]), set()).add(int(label[j]))
    assert all(len(x) == 1 for x in of.values()) and len({min(x) for x in of.values()}) == len(of)


def test_rows_do_not_grow_with_pieces(monkeypatch):
    """A batch of many pieces gives a row for each bucket, not for each piece and bucket; so does a group of documents."""
    monkeypatch.setattr(word_arrays, "PIECE_BYTES", 2_000)
    rng = random.Random(5)
    texts = [_say(rng, 80) for _ in range(60)]
    texts += texts[:30]
    docs = pa.table({"key": pa.array(range(90), pa.int64()), "doc": pa.array(range(90), pa.int64()), "text": pa.array(texts)})
    met = pa.Table.from_batches(list(substring_dedup._met(iter(docs.select(["key", "text"]).combine_chunks().to_batches()), 7)))
    assert met.num_rows <= 8
    found = pa.concat_tables([substring_dedup._shared(met.filter(pc.equal(met["bucket"], b)), 1) for b in met["bucket"].unique().to_pylist()])
    cut = substring_dedup._segments(docs, found, 7)
    assert cut.num_rows <= 8 and {k for row in cut.filter(pc.less(cut["bucket"], 0))["keys"].to_pylist() for k in np.frombuffer(row, np.int64)} == set(range(60, 90))
