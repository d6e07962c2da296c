"""Near copies with repeated, missing and text ids, and recall of the candidate search."""

import random

from spellframe.llm import jaccard
from test_text_operators import words


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_one_id_with_several_texts(spark):
    rng = random.Random(3)
    a, b, c, d = (say(rng, 60) for _ in range(4))
    near = a + " more"
    rows = [(1, a), (2, near), (2, b), (3, c), (None, d), (None, near), (None, None), (4, d + " more"), (5, b), (5, b)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, _id int").drop("_id")
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one_of_each(frame).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (3, c), (4, d + " more"), (None, None)], key=str)
    got = sorted(((r.doc_id, r.group_id, r.n_links) for r in jaccard.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(1, 1, 2), (2, 1, 2), (None, 1, 2), (2, 2, 2), (5, 2, 2), (5, 2, 2), (3, 3, 0), (4, 4, 1), (None, 4, 1), (None, None, 0)], key=str)


def test_text_ids(spark):
    rng = random.Random(4)
    a, b = say(rng, 60), say(rng, 60)
    frame = spark.createDataFrame([("x", a), ("b", a + " more"), ("k", b)], "doc_id string, text string")
    assert sorted((r.doc_id, r.group_id, r.n_links) for r in jaccard.near_duplicates(frame).collect()) == [("b", "b", 1), ("k", "k", 0), ("x", "b", 1)]
    assert sorted(r.doc_id for r in jaccard.keep_one_of_each(frame).collect()) == ["b", "k"]


def test_recall(spark):
    """Queries are the ids divisible by 20, against all rows: every pair of 0.8 or more is found, as brute force counts them."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 20 < 3").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    grams = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in rows}
    holders = {}
    for i, g in grams.items():
        for x in g:
            holders.setdefault(x, []).append(i)
    want = {}
    for i in (i for i in grams if i % 20 == 0):
        shared = {}
        for x in grams[i]:
            for j in holders[x]:
                shared[j] = shared.get(j, 0) + 1
        want[i] = sum(j != i and n >= 0.8 * (len(grams[i]) + len(grams[j]) - n) for j, n in shared.items())
    got = {r.doc_id: r.n_links for r in jaccard.near_duplicates(docs).collect() if r.doc_id % 20 == 0}
    assert sum(want.values()) > 20 and sum(min(got[i], want[i]) for i in want) >= 0.9 * sum(want.values())
    assert got == want  # at this size none is lost
