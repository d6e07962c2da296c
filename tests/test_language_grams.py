"""N-grams and passages in Arrow batches against the plain expressions they stand for."""

import contextlib
import io
import random

from pyspark.sql import functions as F

from conftest import rows
from spellframe.operators import grams as N
from spellframe.operators import language as G

rng = random.Random(4)
ODD = ["".join(rng.choice(["\n", "\x01", ".", "! ", " ", "\t", "ä", "Ü", "。", "文", "word", "x" * 90, "\r", "7"]) for _ in range(rng.choice([0, 1, 3, 40, 200])))
       for _ in range(150)] + [None, "", "ab"]


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_passages_are_the_matches(table, monkeypatch):
    d = table(list(enumerate(ODD)), "id int, t string")
    want = d.select("id", F.posexplode(F.regexp_extract_all("t", F.lit(G.PASSAGE), F.lit(0))))
    assert rows(G.passages(d, "id", "t")) == rows(want)


def test_profiles_count_every_gram(table, monkeypatch):
    data = [(t, "ab"[i % 2]) for i, t in enumerate(ODD)] + [("not counted", "c")]
    d = table(data, "t string, l string")
    gram = d.where("l <> 'c'").select("l", F.explode(F.regexp_extract_all("t", F.lit(G.PASSAGE), F.lit(0))).alias("p")).select("l", F.explode(G._grams(F.col("p"))).alias("gram"))
    want = {r.gram: (r.a, r.b) for r in gram.groupBy("gram").agg(F.count_if(F.col("l") == "a").alias("a"), F.count_if(F.col("l") == "b").alias("b")).collect()}
    total = [sum(c[i] for c in want.values()) + 0.5 * len(want) for i in range(2)]
    for most in (N.TABLE, 0):  # by table and by sorting
        monkeypatch.setattr(N, "TABLE", most)
        got = {r.gram: r.logp for r in G.language_profiles(d, "t", "l", ["a", "b"]).collect()}
        assert got.keys() == want.keys()
        assert all(abs(2.718281828459045 ** got[g][i] * total[i] - c[i] - 0.5) < 1e-6 for g, c in want.items() for i in range(2))


def test_a_passage_travels_as_one_row_and_once(table):
    d = table([(i, ["the river and the stone. the end of it", "der fluss und der stein. das ende"][i % 2], ["en", "de"][i % 2]) for i in range(8)], "id int, t string, l string")
    model = G.language_profiles(d, "t", "l", ["en", "de"]).cache()
    spans = G.merge_spans(G.score_passages(d, "id", "t", model, ["en", "de"], ("rs", "zt")), "id")
    text = plan(G.classify_language(spans, d.select("id", F.length("t").alias("letters")), "id"))
    assert "explode(" not in text and "Join" in text  # no row per n-gram
    last = text[:text.index("\n(1)")] if "\n(1)" in text else text
    assert last.count("MapInArrow") == 2  # passages and their sums, made for one aggregate only
