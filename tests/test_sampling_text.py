import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from spellframe.operators import language as G
from spellframe.operators import sampling as S
from spellframe.operators import text as X

ITEMS = "array<struct<english:string,quote:string>>"


def test_hash_sample_matches_digests(table):
    df = table([(f"u{i}",) for i in range(50)] * 2, "id string")
    want = sorted((hashlib.sha256(f"s:u{i}".encode()).hexdigest(), f"u{i}") for i in range(50))[:7]
    got = S.hash_sample(df, "id", "s", 7)
    assert [(r["sample_hash"], r["id"]) for r in got.orderBy("sample_rank").collect()] == want
    assert S.hash_sample(df.repartition(7), "id", "s", 7).exceptAll(got).count() == 0
    record = S.sample_record(df, "id", got).first()
    assert record["population"] == 50 and record["selected_ids_sha256"] == hashlib.sha256("\n".join(sorted(i for _, i in want)).encode()).hexdigest()


def test_pilots_merge(table):
    df = table([(i,) for i in range(100)], "i int")
    whole = S.pilot_sample(df, 10, 3, F.col("i"))
    halves = S.merge_pilots(S.pilot_sample(df.where("i < 40"), 10, 3, F.col("i")), S.pilot_sample(df.where("i >= 40"), 10, 3, F.col("i")), 10)
    assert rows(whole) == rows(halves)
    assert "pilot_priority_" in S.pilot_sample(whole, 3, 3).columns
    assert S.pilot_sample(df, 10, 3).count() == 10


def test_projection_and_gate(table):
    blocks = table([(100, 100), (900, 100)], "bytes bigint, block_rows bigint")
    assert tuple(S.storage_projection(blocks, 1000).first()) == (5000, 11700, 1000)
    assert tuple(S.storage_projection(blocks, 200).first()) == (1000, 1300, 1000)
    S.size_gate("complete", [], 90, 5, 100)
    for bad in (("incomplete", [], 1, 1, 100), ("complete", ["x"], 1, 1, 100), ("complete", [], 96, 5, 100)):
        with pytest.raises(ValueError):
            S.size_gate(*bad)


def test_accept_first(table):
    df = table([(i, i % 3 == 0) for i in range(60)], "id int, good boolean")
    chosen, audit = S.accept_first_n(df, F.col("good"), F.lit("bad"), 5, "id", 9)
    order = sorted(range(60), key=lambda i: hashlib.sha256(f"9:{i}".encode()).hexdigest())
    want = [i for i in order if i % 3 == 0][:5]
    assert {r["id"] for r in chosen.collect()} == set(want)
    walked = order[:order.index(want[-1]) + 1]
    assert {r["outcome"]: r["candidates"] for r in audit.collect()} == {"accepted": 5, "bad": len(walked) - 5}
    _, audit = S.accept_first_n(df, F.col("good"), F.lit("bad"), 50, "id", 9)
    got = audit.collect()
    assert not got[0]["complete"] and sum(r["candidates"] for r in got) == 60


def test_stratified(table):
    df = table([(i, "dup" if i in (1, 2) else f"t{i}", "ab"[i % 2]) for i in range(20)], "id int, t string, g string")
    picked, report = S.stratified_pick(df, "id", "t", "g", {"a": 3, "b": 2, "c": 1}, 42)
    assert picked.groupBy("g").count().orderBy("g").collect() == [("a", 3), ("b", 2)]
    assert 2 not in {r["id"] for r in S.distinct_content(df, "id", "t").collect()}
    assert rows(report) == [("a", 3, 9, False), ("b", 2, 10, False), ("c", 1, 0, True)]


def test_overlap(table):
    ids = table([(str(i),) for i in range(300)], "id string")
    groups = S.overlap_groups(ids, "id", 7, 100, 100).cache()
    assert S.overlap_problems(groups, "id", 100, 100).count() == 0
    assert groups.groupBy("group_no").count().orderBy("group_no").collect() == [(0, 200), (1, 200)]
    broken = groups.where("position <> 5")
    assert {r[0] for r in S.overlap_problems(broken, "id", 100, 100).collect()} >= {"union", "overlap"}
    with pytest.raises(PySparkException, match="exactly 300"):
        S.overlap_groups(ids.limit(299), "id", 7, 100, 100).collect()


def test_plain_text_and_markup():
    plain = "Pay < 5 & > 1\n中文 café 🚀"
    markup, text = X.clean_one(plain)
    assert text == plain and "&lt; 5 &amp; &gt;" in markup
    markup, text = X.clean_one('<p onclick="x(1)">R&amp;D</p><ul><li>中文</li></ul><script>secret()</script><style>hide</style>'
                               '<a href="https://e.example">Apply</a><img src="r" alt="Logo"><svg><p>no</p></svg>')
    assert "<p>R&amp;D</p><ul><li>中文</li></ul>" in markup and "<a>Apply</a>Logo" in markup
    assert text.strip().replace("\n", "") == "R&D中文ApplyLogo"
    assert not any(w in markup for w in ("onclick", "href", "src", "secret", "hide", "<script", "no"))


def test_redundant_breaks():
    markup, text = X.clean_one("Description:<br><br><p><br><br></p><br><p><strong>Your role<br><br></strong></p><br>"
                               "<ul><br><li>Analyse data.</li><br><li>Report.</li><br></ul>")
    assert markup == "Description:<p><strong>Your role</strong></p><ul><li>Analyse data.</li><li>Report.</li></ul>"
    assert "Analyse data." in text and X.clean_one(" a  b")[1] == "• a • b"


def test_clean_and_contained(table):
    df = table([(1, "<p>Ａ１ b</p>"), (2, None)], "i int, h string")
    out = X.clean_html(df, "h").withColumn("same", X.text_contained("clean_text", F.lit("..a A1 B.. A1b")))
    assert [(r["i"], r["clean_html"], r["same"]) for r in out.orderBy("i").collect()] == [(1, "<p>Ａ１ b</p>", True), (2, None, None)]


def test_dropped_elements():
    """Content of dropped elements goes with whatever is nested in it; one that never ends hides the rest."""
    assert X.clean_one("<p>a</p><svg><object>x</svg></object>y</svg><b>c</b></svg>") == ("<p>a</p><b>c</b>", "\na\nc")
    assert X.clean_one("<p>a<svg/>b<object>c<p>d")[1] == "\nab"
    assert X.clean_one('<p/>x</br><img alt="R&D"><img>') == ("<p>xR&amp;D", "\nx\nR&D")


def test_overlap_groups_cover_all(table):
    out = S.overlap_groups(table([(i,) for i in range(31)], "k int"), "k", 5, 11, 10)
    assert S.overlap_problems(out, "k", 11, 10).count() == 0
    order = sorted(range(31), key=lambda i: (hashlib.sha256(f"5:{i}".encode()).hexdigest(), i))
    assert rows(out.where("shared AND group_no = 0").select("position", "k")) == sorted(((i + 1, k) for i, k in enumerate(order[:11])), key=str)


def test_evidence(table):
    src = table([("1", "Needs Python, SQL"), ("2", "abc"), ("3", "lost")], "record_id string, description string")
    lang = table([("1", ["English"]), ("2", ["English", "Chinese"]), ("3", ["English"])], "record_id string, languages array<string>")
    ok = ("1", ["English"], "readable", "", [("python", "Python")], [])
    cases = [ok, ("2", ["Chinese", "English"], "readable", "", [("x", "ABC")], []), ("9", ["English"], "readable", "", [], [])]
    schema = f"record_id string, detected_languages array<string>, reading_status string, reading_note string, skills {ITEMS}, education_requirements {ITEMS}"
    valid, failed, missing = X.audit_evidence(table(cases, schema), src, lang)
    assert rows(valid.select("record_id")) == [("1",)] and rows(missing) == [("2",), ("3",)]  # rejected counts as missing
    assert {r["record_id"]: r["errors"] for r in failed.collect()} == {"2": ["skills: missing or fabricated evidence"], "9": ["unexpected or duplicate id"]}
    broken = [("1", ["Klingon"], "readable", "", [("a", "b")] * 21, []), ("2", ["English"], "unreadable", " ", [("x", "abc")], [])]
    _, failed, _ = X.audit_evidence(table(broken, schema), src, lang)
    got = {r["record_id"]: r["errors"] for r in failed.collect()}
    assert got["1"] == ["detected_languages: unknown language", "skills: too many items"]
    assert got["2"] == ["languages differ from the source", "unreadable text needs an explanation", "unreadable record with extracted items"]


def test_requests_and_export(table):
    def body(ident, text, **kw):
        sent = json.dumps([{"record_id": ident, "title": "t", "description": text}])
        return (json.dumps({"model": "m", "temperature": 0.7, "reasoning_effort": "none", "max_tokens": 3000,
                            "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "Do:\n" + sent}], **kw}),)
    src = table([("1", "a [x]", "t"), ("2", "b", "t"), ("3", "c", "t")], "record_id string, description string, title string")
    got = X.request_audit(table([body("1", "a [x]"), body("2", "B"), body("2", "b", max_tokens=1)], "body string"), src, "m")
    assert rows(got) == [("2", "changed text"), ("2", "id sent too often or unknown"), ("2", "settings"), ("3", "id not sent")]
    a = table([(1, None, "x"), (2, "y", None), (4, "q", "q")], "k int, a string, b string")
    b = table([(1, "x", None), (2, "y", None), (3, "z", "z")], "k int, a string, b string")
    assert rows(X.export_audit(a, b, "k")) == [(1, "changed"), (3, "missing"), (4, "unexpected")]


EN = "We are looking for an experienced engineer who will design, build and maintain our data platform together with the team and its customers."
FR = "Nous recherchons une personne expérimentée qui saura concevoir, construire et maintenir notre plateforme avec les équipes et les clients."


def test_trained_languages(table):
    d = table([(1, EN, "English"), (2, FR, "French")], "id int, t string, l string")
    prof = G.language_profiles(d, "t", "l", ["English", "French"]).cache()
    probe = table([(1, "The team will build the platform with its customers.\nNous recherchons les clients avec les équipes."), (2, "12345")], "id int, t string")
    spans = G.score_passages(probe, "id", "t", prof, ["English", "French"])
    got = [(r["id"], r["start"], r["language"]) for r in spans.orderBy("start").collect()]
    assert [g[2] for g in got] == ["English", "French"] and got[0][1] == 0
    whole = probe.where("id = 1").first()["t"]
    assert spans.agg(F.max("end")).first()[0] == len(whole)
    dom = G.dominant_language(table([(1, EN), (2, "ok")], "id int, t string"), "id", "t", prof, ["English", "French"])
    assert rows(dom) == [(1, "English"), (2, "uncertain")]


def test_policy(table):
    spans = [("a", 0, 50, "English", 60, .9, .05), ("a", 50, 90, "English", 50, .7, .3), ("a", 90, 95, "French", 39, .9, .0),
             ("b", 0, 10, "English", 120, .9, .0), ("b", 10, 30, "Chinese", 80, .9, .0), ("c", 0, 10, "Chinese", 100, .9, 0.), ("d", 0, 9, "English", 90, .61, .5),
             ("e", 0, 9, "Korean", 100, .9, .0), ("e", 9, 20, "English", 15, .9, .0)]
    merged = G.merge_spans(table(spans, "id string, start int, end int, language string, letters int, confidence double, second double"), "id")
    a = [tuple(r) for r in merged.where("id = 'a' AND language = 'English'").select("start", "end", "letters", "confidence").collect()]
    assert a == [(0, 90, 110, .7)]
    docs = table([("a", 115, None), ("b", 210, "simplified"), ("c", 100, None), ("d", 90, None), ("e", 115, None), ("f", 0, None)], "id string, letters int, chinese_script string")
    out = {r["id"]: (r["language_group"], r["languages"]) for r in G.classify_language(merged, docs, "id").collect()}
    assert out == {"a": ("English", ["English"]), "b": ("Chinese/English", ["Chinese", "English"]), "c": (None, []), "d": (None, []), "e": ("Korean", ["Korean"]), "f": (None, [])}


def test_scripts(table):
    texts = {"软件开发": "simplified", "軟體開發": "traditional", "中文": None, "软件軟體": None, "软软": None, "a-b^c": None}
    got = table([(t,) for t in texts], "t string").select("t", G.script_variant("t", "软发开^-]", "軟體開"))
    assert {r[0]: r[1] for r in got.collect()} == {**texts, "a-b^c": "simplified"}


def test_hot_paths_audit_the_same(table, everything_hot):
    test_evidence(table)
    test_requests_and_export(table)
