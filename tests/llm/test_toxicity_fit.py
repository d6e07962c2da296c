"""The toxicity model is fitted on every labelled document, in as many parts as they ask for."""

import pickle
import random
import zlib

import numpy as np

from spellframe.llm import toxicity


def _docs(spark, n):
    rng = random.Random(4)
    say = lambda k: " ".join(rng.choice("the river and stone of garden letter to window".split()) for _ in range(k))
    rows = [(i, say(12) + (" fools " if i % 3 == 0 else " ") + say(6)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int")


def _learnt(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


def test_every_labelled_document(spark):
    """More labelled documents than 6,000, a very long one and one without text: all are learnt from, none of the held-out ones."""
    rows, d, lab = _docs(spark, 9_000)
    first = next(i for i, _ in rows if _learnt(i))
    d = d.where(f"doc_id <> {first}").unionByName(spark.createDataFrame([(first, "stone " * 8_000)], d.schema))
    got = {r.id: r.size for r in toxicity.labelled(d, lab).collect()}
    assert set(got) == {i for i, _ in rows if _learnt(i)} and len(got) > 6_000 and got[first] == 48_000


def test_parts_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_ROWS", 500)
    rows, d, lab = _docs(spark, 2_400)
    assert toxicity.labelled(d, lab).rdd.getNumPartitions() >= 4
    got = toxicity.toxicity(d, lab).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.97 * len(held)


def test_rare_words_of_all_documents(spark, monkeypatch):
    """A word has an embedding by its documents among all labelled ones, not by those of some."""
    monkeypatch.setattr(toxicity, "SHARE", 100)
    rows, d, lab = _docs(spark, 700)
    some = [i for i, _ in rows if _learnt(i)]
    few, many = some[-4:], some[-16:]
    d = spark.createDataFrame([(i, t + (" quartz" if i in few else "") + (" zinc" if i in many else "")) for i, t in rows], d.schema)
    kept = pickle.loads(toxicity.fit(d, lab))[0]
    at = lambda w: toxicity._buckets(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0, 0]
    assert at(b"zinc") in kept and at(b"quartz") not in kept


def test_texts_without_words(spark):
    """Texts without words, also at the head of a batch, are learnt from like others; null ones are not."""
    rows, d, lab = _docs(spark, 600)
    d = spark.createDataFrame([(i, "" if i % 3 else None if i % 2 else t) for i, t in rows], d.schema)
    assert {r.id for r in toxicity.labelled(d, lab).collect()} == {i for i, _ in rows if _learnt(i) and (i % 3 or not i % 2)}
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == 600 and sum(r.predicted == (r.doc_id % 6 == 0) for r in got if r.held_out) >= 0.97 * sum(r.held_out for r in got)


def test_threshold():
    raw = np.array([-2.0, -1.0, 1.0, 3.0])
    assert toxicity._threshold(raw, np.array([5, 2, 0, 0]), np.array([0, 0, 1, 4])) == 0.0
    assert toxicity._threshold(raw, np.array([5, 2, 3, 0]), np.array([0, 0, 1, 4])) == 2.0
    assert toxicity._threshold(raw, np.array([5, 2, 3, 0]), np.zeros(4, int)) == 0.0
