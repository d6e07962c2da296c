"""The path-template tree against a tree built in memory, and the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spellframe.llm import keyed, url_templates as ut

SCHEMA = "page_id long, url string, html string, host string, key string, bad int"


def address(url):
    m = re.fullmatch(r"(?s).*?://([^/?#]*)([^?#]*).*", url or "")
    return ("".join(c.lower() if c < "\x80" else c for c in m[1]), m[2]) if m else ("", "")


def brute(pages, labels):
    """Purity of the template of each page."""
    marks = {}
    for i, bad in labels:
        if i is not None and bad is not None:
            marks[i] = max(bad, marks.get(i, 0))
    rows = []
    for page in pages:
        host, path = address(page[1])
        parts = [re.sub("[0-9]+", "{n}", p) for p in path.split("/") if p]
        rows.append((host, tuple(parts[:ut.DEPTH]) + ("**",) * (len(parts) > ut.DEPTH), marks.get(page[0]) if page[0] is not None else None))
    known = [r[2] for r in rows if r[2] is not None]
    share = lambda of, towards: (sum(x for x in of if x is not None) + ut.PRIOR * towards) / (sum(x is not None for x in of) + ut.PRIOR)
    group = group_of(sorted({"/".join(r[1][k:]) for r in rows for k in range(len(r[1]) + 1)}))
    out = {}

    def walk(places, level, purity):
        for i in places:
            if len(rows[i][1]) == level:
                out[i] = purity
        on = [i for i in places if len(rows[i][1]) > level]
        sizes, children = {}, {}
        for i in on:
            sizes[rows[i][1][level]] = sizes.get(rows[i][1][level], 0) + 1
        for i in on:
            seg = rows[i][1][level]
            children.setdefault(seg if sizes[seg] >= ut.LEAST and sizes[seg] * ut.KEEP >= len(places) else "*", []).append(i)
        counts = []
        for name, some in children.items():
            profile = [0.0] * ut.PROFILE
            for i in some:
                profile[group["/".join(rows[i][1][level + 1:])]] += 1
            counts.append((name, profile + [float(sum(rows[i][2] is not None for i in some)), float(sum(rows[i][2] or 0 for i in some))]))
        below = {}
        for name, branch in ut.branches(counts):
            below.setdefault(branch, []).extend(children[name])
        for some in below.values():
            walk(some, level + 1, share([rows[i][2] for i in some], purity))

    hosts = {}
    for i, r in enumerate(rows):
        hosts.setdefault(r[0], []).append(i)
    overall = sum(known) / len(known) if known else 0.0
    for places in hosts.values():
        walk(places, 0, share([rows[i][2] for i in places], overall))
    return out


def group_of(texts):
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(ut.PROFILE)).alias("g"))
    return {r.t: r.g for r in frame.collect()}


def pages():
    rng = random.Random(5)
    slug = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    hosts = ["https://News.Example.ORG", "http://shop.example.com", "https://a.b.net", "https://example.net", "ftp://bets.example.com:80"]
    urls = []
    for _ in range(900):
        host = rng.choice(hosts + hosts[1:2] * 4)
        urls.append(host + rng.choice([f"/en/{rng.randrange(999)}", f"/de/{rng.randrange(999)}.html", f"/fr/{slug()}/x", f"/{slug()}", f"/win/{slug()}", "/en/?q=/de/", "", "/", f"/a/b/c/d/{slug()}/e", f"/tag//{slug()}/#/y"]))
    urls += [None, "", "no scheme/en/", "x://", "http://h", "http://h?x", "http://é.org/FR/1", "http://long.org/" + "y" * 50_000, "http://deep.org" + "/1" * 5_000, "http://one.org/a\nb/c"]
    return [(i, u, "h", "x", "y", 0) for i, u in enumerate(urls)] + [(3, urls[3], "h", "x", "y", 0), (None, "http://h/1", "h", "x", "y", 0)]


def labels():
    rng = random.Random(6)
    return [(p[0], int(rng.random() < (0.9 if "/win/" in (p[1] or "") else 0.1))) for p in pages()[:900:2]] + [(4, None), (None, 1), (99_999, 1)]


@pytest.mark.parametrize("share", [keyed.SHARE, 3])
def test_purity_and_rules(spark, monkeypatch, share):
    monkeypatch.setattr(keyed, "SHARE", share)  # 3: hardly any key is heavy
    marks = spark.createDataFrame(labels(), "page_id long, bad int")
    got = ut.url_verdicts(spark.createDataFrame(pages(), SCHEMA).repartition(4), marks).collect()
    want = brute(pages(), labels())
    rules = sorted(ut.RULES, key=lambda r: len(r[0]) + len(r[1]))
    expected = []
    for i, page in enumerate(pages()):
        host, path = address(page[1])
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        own = "block" if want[i] >= ut.REJECT else "allow"
        expected.append((page[0], host, path, fits[-1][0] + fits[-1][1] if fits else None, fits[-1][2] if fits else own, round(want[i], 9)))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.purity, 9)) for r in got), key=str) == sorted(expected, key=str)
    blocked = {r.path.split("/")[1] for r in got if r.rule is None and r.verdict == "block"}
    assert blocked == {"win"}


def test_templates(spark):
    got = {r.template: r for r in ut.url_templates(spark.createDataFrame(pages(), SCHEMA), spark.createDataFrame(labels(), "page_id long, bad int")).collect()}
    shop = {t for t in got if t.startswith("shop.example.com")}
    assert {"shop.example.com", "shop.example.com/*", "shop.example.com/a/b/c/d/**", "shop.example.com/win/*"} <= shop
    assert got["shop.example.com/win/*"].rejected and not got["shop.example.com"].rejected
    assert sum(r.n for r in got.values() if r.level == 0) == len(pages())


def test_similar_branches_are_one(spark):
    urls = [f"http://h.org/{c}/{k}" for c in ("en", "de", "fr") for k in range(40)] + [f"http://h.org/bad/{k}" for k in range(40)]
    marks = [(i, int("/bad/" in u)) for i, u in enumerate(urls)]
    tree = ut.url_templates(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(marks, "page_id long, bad int"))
    assert {r.template for r in tree.where("level = 1").collect()} == {"h.org/de|en|fr", "h.org/bad"}


def test_nothing(spark):
    none, marks = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "page_id long, bad int")
    assert ut.url_verdicts(none, marks).count() == 0 and ut.url_templates(none, marks).count() == 0
    only = ut.url_verdicts(spark.createDataFrame([(1, None)], "page_id long, url string"), marks).collect()
    assert [tuple(r) for r in only] == [(1, "", "", None, "allow", 0.0)]


def test_longest_rule(spark):
    urls = ["http://example.net/en/x", "http://a.example.net/en", "http://net/", "http://badnet/", "http://x.example.com/de/1", "http://example.com/DE/1", "http://b.org/fr/", "http://b.org/fr"]
    host, path = ut.host_and_path(F.col("url"))
    name, verdict = ut.rule_for(host, path)
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(name, verdict).collect()
    assert [tuple(r) for r in got] == [("example.net/en/", "allow"), ("net/", "block"), ("net/", "block"), (None, None), ("example.com/de/", "block"), (None, None), ("org/fr/", "allow"), (None, None)]
