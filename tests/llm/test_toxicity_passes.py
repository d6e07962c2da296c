"""Large tables are learnt like small ones: as many passes, the same words, every batch."""

import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spellframe.llm import toxicity


@pytest.mark.parametrize("parts", [1, 2, 6, 400])
def test_all_passes_for_any_number_of_parts(parts):
    assert sum(toxicity._rounds(parts)) == toxicity.EPOCHS and min(toxicity._rounds(parts)) > 0


def test_rare_words_of_a_large_table(spark):
    """A word of three labelled documents has an embedding among thousands, one of two has none."""
    rng = random.Random(4)
    say = lambda k: " ".join(rng.choice("the river and stone of garden letter to window".split()) for _ in range(k))
    some = [i for i in range(9_000) if zlib.crc32(str(i).encode()) % 5]
    three, two = some[5:8], some[9:11]
    rows = [(i, say(4) + (" fools" if i % 3 == 0 else "") + (" quartz" if i in three else "") + (" zinc" if i in two else "")) for i in range(9_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = pickle.loads(toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")))[0]
    at = lambda w: toxicity._buckets(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0, 0]
    assert len(some) > 6_000 and at(b"quartz") in kept and at(b"zinc") not in kept


def test_batch_without_words_is_learnt_from():
    net = toxicity.Network(5)
    before = net.out[-1]
    assert len(net.train([np.zeros((0, 4), np.int32)] * 70, np.zeros(70, np.int64), 1)) == 0
    assert net.out[-1] < before


def test_moved_rows():
    """Only rows that reach a maximum move, they are the ones listed; the result is that of Adam over all rows."""
    rng = np.random.default_rng(8)
    texts, toxic = [rng.integers(0, 300, (rng.integers(0, 9), 4), np.int32) for _ in range(200)], rng.integers(0, 2, 200)
    net, wide = toxicity.Network(400), toxicity.Network(400)
    start = net.embed.copy()
    moved = net.train(texts, toxic, 3)
    changed = np.flatnonzero((net.embed != start).any(axis=1))
    assert set(changed) <= set(moved) and 0 not in moved and moved.max() < 300 and not net.embed[0].any() and (net.embed[300:] == start[300:]).all()
    # Other numbers of the same words, and a pass that begins with all rows moved, end in the same vectors.
    order = np.append(0, 1 + rng.permutation(399)).astype(np.int32)
    wide.embed[order] = start
    again = wide.train([order[t] for t in texts], toxic, 3)
    assert sorted(order[moved]) == again.tolist() and np.allclose(wide.embed[order], net.embed, atol=1e-5)


def test_means_of_parts():
    """Shared weights are averaged over all parts by their texts, an embedding row over the parts that moved it."""
    k = toxicity.SLICE
    row = lambda *at: np.array(at, np.int32).tobytes()
    full = lambda *v: np.repeat(np.array(v, np.float32), toxicity.DIM).tobytes()
    flat = lambda v: np.full(3, v, np.float32).tobytes()
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    given = [(-1, 10, b"", flat(1)), (-1, 30, b"", flat(5)), (1, 10, row(k + 2, k + 5), full(1, 7)), (1, 30, row(k + 2), full(5))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*given, strict=True), kinds, strict=True)], ["slice", "n", "rows", "weights"])
    got = {r["slice"]: r for out in toxicity._add(iter([batch])) for r in out.to_pylist()}
    assert got[-1]["weights"] == flat(4) and got[1]["rows"] == row(k + 2, k + 5) and got[1]["weights"] == full(4, 7)


def test_only_labelled_documents_are_moved(spark):
    """Of many documents the few labelled ones are packed, all of them, also if ids are of different types."""
    docs = spark.range(4_000).selectExpr("id AS doc_id", "concat('the garden ', id) AS text")
    labels = spark.range(0, 4_000, 37).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    want = {i for i in range(0, 4_000, 37) if zlib.crc32(str(i).encode()) % 5}
    for own in (labels, labels.withColumn("doc_id", labels.doc_id.cast("int"))):
        got = toxicity.labelled(docs, own).collect()
        assert {r.id for r in got} == want and len(got) == len(want)
    at = (labels.doc_id * 11) % 70_000
    bits = np.unpackbits(toxicity._marked(at, labels, 70_000), bitorder="little")
    assert np.flatnonzero(bits).tolist() == sorted(i * 11 % 70_000 for i in range(0, 4_000, 37))
    text = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "text": ["a", "", "c"], "at": [8, 9, 3]})
    assert [b["id"].to_pylist() for b in toxicity._packed(iter([text]), np.array([8, 1], np.uint8))] == [[1, 3]]
