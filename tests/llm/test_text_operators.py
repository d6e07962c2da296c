"""Text operators against brute force, on small tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spellframe.llm import bpe, decontaminate, exact_dedup, jaccard, licenses, main_text, pii, quality, substring_dedup, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, n_words long, digest string, bucket long, id string"


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(120), say(25)
    texts = [base, base, base + " ", base.replace(" ", "\n"), None, "", "   ", "one", "two words", passage, say(40) + " " + passage + " " + say(30), passage + " " + say(9)]
    for k in range(8):
        changed = base.split(" ")
        for _ in range(k):
            changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
        texts.append(" ".join(changed))
    texts += [say(rng.randint(1, 60)) for _ in range(20)] + [say(4000), "a" * 3000, "ab" * 700, "x" * 49, "x" * 50, "x" * 51]
    rows = [(i * 3, t, "en", 7, "d", 1, "x") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[10], (None, base, "en", 7, "d", 1, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.mark.parametrize("small", [False, True])
def test_passages(docs, empty, monkeypatch, small):
    if small:  # many buckets, groups of documents and sorted parts
        for name, value in (("BUCKET_BYTES", 3_000), ("GROUP_BYTES", 2_000), ("SORT_BYTES", 500)):
            monkeypatch.setattr(substring_dedup, name, value)
    rows = [((2**63 - 1 if r[0] is None else r[0]), r[0], (r[1] or "").encode()) for r in corpus()]
    first = {}
    for order, _, data in rows:
        for p in range(len(data) - 49):
            first[data[p:p + 50]] = min(order, first.get(data[p:p + 50], order))
    want = []
    for order, doc, data in rows:
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p:p + 50]] < order:
                gone[p:p + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((doc, len(data), sum(gone), spans, sha(bytes(x for x, g in zip(data, gone, strict=True) if not g))))
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs).drop("kept").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_licenses(spark, docs, empty):
    rows = [(1, "CC BY and cc-by, All Rights Reserved."), (2, None), (3, "Released under that MIT license"), (4, "GNU General Public License x general public license"), (4, "other"), (5, "cc")]
    got = {(r.doc_id, r.n_words): r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one = got[1, 8]
    assert (one.n_base, one.first_word, one.last_word, one.base_labels, one.score) == (3, 0, 5, "cc-by,reserved", 1.0)
    assert (got[2, 0].n_base, got[2, 0].first_word, got[2, 0].labels, got[2, 0].score) == (0, None, "", 0.0)
    assert got[4, 8].n_base == 2 and "gpl" in got[4, 8].labels and got[4, 1].labels == ""
    assert licenses.license_scan(docs).count() == docs.count() and licenses.license_scan(empty).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, docs, empty, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    texts = {r[1] for r in corpus() if r[1]}
    long = max((t for t in texts if t.count(" ") == 24), key=len)
    items = [(1, long), (2, "two WORDS"), (3, None), (4, ""), (5, "not in any text"), (2, "two words"), (None, "one")]
    wins = set()
    for i, t in items:
        w = words(t)
        wins |= {(tuple(w[k:k + 10]), i) for k in range(max(1, len(w) - 9)) if w}
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in found:
        candidates = []
        for row in corpus():
            if row[0] == r.doc_id:
                w = words(row[1])
                hit, ids = set(), set()
                for win, i in wins:
                    for k in range(len(w) - len(win) + 1):
                        if tuple(w[k:k + len(win)]) == win:
                            hit |= set(range(k, k + len(win)))
                            ids |= {str(i)} if i is not None else set()
                candidates.append((len(w), len(hit), sorted(ids)))
        assert (r.n_words, r.n_hit, r["items"]) in candidates
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in corpus())
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("n_hit > 0").count() == 0 and decontaminate.contamination(empty, none).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()


def test_bpe(spark, docs, empty):
    import tiktoken
    with open(bpe.default_path(), "rb") as f:
        t = bpe.Tokenizer(f.read())
    plain = tiktoken.Encoding("plain", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=t.ranks, special_tokens={})
    rng = random.Random(9)
    texts = ["", " ", "aaaaaaaa", "a" * 5000, "ab" * 3000, "don't  stop\n\n\tit’s ünï 12345 <|endoftext|>", "".join(rng.choice("abcdefgh") for _ in range(4000)), "日本語のテキスト" * 50, "!" * 777]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 900), 10])) for _ in range(300)) for _ in range(40)]
    for text in texts:
        assert t.encode(text) == plain.encode_ordinary(text) and t.decode(t.encode(text)) == text.encode()
    together = bpe.Tokenizer(b"\n".join(b" ".join([bpe.base64.b64encode(x), str(r).encode()]) for x, r in t.ranks.items()))
    assert [x.tolist() for x in together.encode_all(texts * 2)] == [plain.encode_ordinary(x) for x in texts * 2]
    assert together.known and max(map(len, together.known)) <= bpe.LONGEST_REMEMBERED and not together.queue.buckets
    # A merge may make a pair of a lower rank: it comes before the other places of the bucket, in its own pre-token only.
    odd = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"xx": 258, b"bcabc": 259, b"aabc": 260}
    odd_plain = tiktoken.Encoding("odd", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=odd, special_tokens={})
    small = bpe.Tokenizer(b"\n".join(b" ".join([bpe.base64.b64encode(x), str(r).encode()]) for x, r in odd.items()))
    odd_texts = ["".join(rng.choice("abcx") for _ in range(rng.randint(1, 30))) for _ in range(400)] + ["abcabcabc bcbcabc", "abcbc" * 40]
    assert [x.tolist() for x in small.encode_all(odd_texts)] == [odd_plain.encode_ordinary(x) for x in odd_texts]
    got = bpe.encode_documents(docs).cache()
    assert got.count() == docs.count() and bpe.encode_documents(empty).count() == 0
    joined = got.join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("want")).distinct(), "doc_id")
    assert joined.where("decoded_sha256 <> want OR n_tokens <> size(token_ids)").isEmpty()
    back = bpe.decode_documents(got).select("doc_id", F.sha2("text_bytes", 256).alias("d")).join(got, "doc_id")
    assert back.where("d <> decoded_sha256").isEmpty()


def plain_spans(text):
    """Base spans by the plain patterns."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                    "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] if good else []
    return ",".join(out)


def test_pii(spark, empty):
    rows = [(1, "mail a.b@c.org_d@e.fr x@y 1.2.3.256 010.0.0.1 1.2.3.4.5"), (2, "card 4111 1111-1111 1111, 4111111111111112 +49 (30) 123-4567 tel"), (3, None), (4, ""),
            (5, "iban GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32"), (5, "é é@é.é z@é.com q@w.eü"), (6, "a" * 100_000), (6, "1" * 100_000), (1, "mail a.b@c.org_d@e.fr x@y 1.2.3.256 010.0.0.1 1.2.3.4.5")]
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone): r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, 2, 2, 0, 0] == plain_spans(rows[0][1])
    assert got[2, 0, 0, 1, 1] == plain_spans(rows[1][1])
    assert got[3, 0, 0, 0, 0] == got[4, 0, 0, 0, 0] == "" and len(got) == 7
    assert got[5, 0, 0, 0, 0] == f"iban:5:{rows[4][1].index(' and')}"
    assert got[5, 1, 0, 0, 0] == plain_spans(rows[5][1])
    assert pii.pii_report(empty).count() == 0
    assert pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


def pii_both_ways(spark, texts):
    """Spans and scores by the operator and by the SQL, both by row number."""
    import duckdb

    from spellframe.llm import queries
    documents = __import__("pandas").DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", documents)
    want = {r[0]: (r[6], r[7]) for r in con.execute(queries.PII_SQL).fetchall()}
    got = {r.doc_id: (r.spans, r.score) for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want
    return got


def test_pii_context_decides(spark):
    number, far = "078-05-1120", "x" * 40
    texts = [f"number {number} here", f"her SSN: {number} here", f"{number} (social security)", f"ssn {far} {number}", f"{number} {far} ssn", "ssn 000-12-3456, 666-12-3456, 912-12-3456, 123-00-4567",
             "NHS 943 476 5919", "call 943 476 5919", "patient 943 476 5918", "routing 021000021", "database 021000021", "account 021000021", "aba 021000022", "ABA 991000029",
             "ssn 12 34 56 7 8 9 10 " + number, f"ssn a@b.c {number}", f"{number} 1.2.3.4 {number} ssn", "é" * 39 + f"ssn{number}", f"write to us: a@b.co or {'y' * 30} c@d.co by mail"]
    got = pii_both_ways(spark, texts)
    only = [",".join(x for x in got[k][0].split(",") if x.split(":")[0] in pii.ASKED) for k in range(len(texts))]
    assert only == ["", "ssn:9:20", "ssn:0:11", "", "", "", "nhs:4:16", "", "", "aba:8:17", "", "", "", "", "ssn:22:33", "ssn:10:21", "ssn:0:11,ssn:20:31", "", ""]


def test_pii_sql_reads_account_numbers_alike(spark):
    pii_both_ways(spark, ["pay DE89 3704 0044 0532 0130 00 BIC: COBADEFF", "GB82 WEST 1234 5698 7654 32 OR cash", "DE89370400440532013000 GB82WEST12345698765432", "XX12 3456 7890 1234 5678", "", None,
                          "mail a.b@c.org_d@e.fr 010.0.0.1 1.2.3.4.5 4111 1111-1111 1111 +49 (30) 123-4567 tel"])


def test_rows_that_repeat_give_a_row_each(spark):
    rows = [(7, "cc by +49 (30) 123-4567 one two"), (7, "cc by +49 (30) 123-4567 one two"), (7, "other"), (None, None), (None, None), (None, ""), (8, "one two cc by cc by"), (8, "one two cc by cc by"), (8, "one two cc by cc by")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two"), (2, "by cc by")], "item_id long, text string")
    ids = sorted(str(r[0]) for r in rows)
    for found in (licenses.license_scan(docs), pii.pii_report(docs), decontaminate.contamination(docs, items)):
        assert sorted(str(r.doc_id) for r in found.collect()) == ids
    assert sorted(r.n_base for r in licenses.license_scan(docs).where("doc_id = 8").collect()) == [2, 2, 2]
    assert sorted(r.doc_id or 0 for r in decontaminate.drop_contaminated(docs, items).collect()) == [0, 0, 0, 7]
    from spellframe.llm import common
    assert common.repeated(spark.createDataFrame([(1, 250_001)], "a int, n long"), "n").count() == 250_001


def test_pii_account_number_before_words(spark):
    texts = ["pay DE89 3704 0044 0532 0130 00 BIC: COBADEFF", "GB82 WEST 1234 5698 7654 32 OR cash", "DE89370400440532013000 GB82WEST12345698765432", "NO93 8601 1117 947 AB12", "DE89 3704 0044 0532 0130 00X",
             "PO12 4567 8901 2345 DE89 3704 0044 0532 0130 00 NOW", "MT84 MALT 0110 0001 2345 MTLC AST0 01S A"]
    want = ["iban:4:31", "iban:0:27", "iban:0:22,iban:23:45", "iban:0:18", "", "iban:20:47", "iban:0:38"]
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    only = {k: ",".join(x for x in v.split(",") if x.startswith("iban")) for k, v in got.items()}
    assert [only[k] for k in range(len(texts))] == want
    assert sum(len(c.split()) for c in pii.IBAN_LENGTHS.values()) == len({x for c in pii.IBAN_LENGTHS.values() for x in c.split()})


@pytest.mark.parametrize("rounds", [1, 3])
def test_exact(docs, empty, rounds):
    got = exact_dedup.exact_duplicates(docs, rounds=rounds).collect()
    groups = {}
    for r in corpus():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append((-len(r[1] or ""), r[0] is None, r[0]))
    want = [(d, min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(g), sha(t)) for t, g in groups.items() for _, _, d in g]
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == sorted(want, key=str)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.keep_first_copies(docs).count() == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.keep_first_copies(empty).count() == 0


def test_exact_ids_of_several_texts(spark):
    rows = [(None, "a b c"), (1, "abc "), (None, "clean one"), (None, "clean two"), (None, None), (2, "  "), (5, "a b"), (5, "ab"), (6, "x  y"), (7, "x y"), (7, "z"), (8, "q r"), (8, "q\tr"), (9, "twice"), (9, "twice"), (None, "w w"), (None, "w w")]
    got = exact_dedup.keep_first_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted((str(r.doc_id), r.text) for r in got if r.doc_id != 8)
    assert left == sorted([("None", "a b c"), ("None", "clean one"), ("None", "clean two"), ("2", "  "), ("5", "a b"), ("6", "x  y"), ("7", "z"), ("9", "twice"), ("None", "w w")])
    assert sum(r.doc_id == 8 for r in got) == 1


def links(rows):
    sets = [(r[0], {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(r[1])) else set(), tuple(words(r[1]))) for r in rows if r[0] is not None]
    n, root = {d: 0 for d, _, _ in sets}, {d: d for d, _, _ in sets}
    for i, (a, x, _) in enumerate(sets):
        for b, y, _ in sets[:i]:
            if a != b and x and y and len(x & y) >= 0.8 * len(x | y):
                n[a] += 1
                n[b] += 1
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return n, root


@pytest.mark.parametrize("block", [1_024, 3])
def test_jaccard(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = list({r[0]: r for r in corpus() if r[0] is not None}.values())
    n, root = links(rows)
    got = {r.doc_id: (r.n_links, r.group_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: (n[d], root[d]) for d in n} and sum(n.values()) > 20  # the fixture has links
    assert jaccard.near_duplicates(docs).count() == docs.count() and jaccard.near_duplicates(empty).count() == 0
    assert jaccard.keep_one_of_each(empty).count() == 0
    assert set(jaccard.keep_one_of_each(docs).columns) == set(docs.columns)


def test_least_matches():
    least = jaccard.least_matches()
    assert len(least) == 8 and least == sorted(least) and 70 < least[-1] < 102


def test_quality(spark, empty):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["river", "stone", "garden", "letter", "window", "morning"]) for _ in range(n))
    rows = [(i, say(30) if i % 3 else say(30).upper().replace(" ", "!! ")) for i in range(300)] + [(900, None), (901, ""), (902, "abc"), (None, say(9)), (1, "x y")]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(4, None), (8, 1), (10, 0), (None, 1)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.importance(d, lab).collect()
    assert len(got) == len(rows)
    assert all(r.kept == bool(r.doc_id % 3) for r in got if r.doc_id is not None and r.doc_id < 300 and r.text_hash and not (r.doc_id == 1))
    assert quality.importance(d, lab.where("quality = 1")).where("NOT kept").isEmpty()
    assert quality.importance(empty, lab).count() == 0 and set(quality.keep_good(d, lab).columns) == {"doc_id", "text"}
    values = spark.createDataFrame([(float(x),) for x in [3, 1, 2, 2, 2, 9, -4]], "v double")
    assert [quality.kth_largest(values, "v", k) for k in (1, 2, 3, 5, 7)] == [9.0, 3.0, 2.0, 2.0, -4.0]


def test_toxicity(spark, empty):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("the river and stone of garden letter to window".split()) for _ in range(n))
    rows = [(i, say(30) + (" fools" if i % 4 == 0 else "") + " " + say(10)) for i in range(600)] + [(900, None), (901, ""), (5, "again")]
    labels = [(i, int(i % 4 == 0)) for i in range(600)] + [(6, None)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 80 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert toxicity.toxicity(d, lab.where("toxic = 1")).where("score <> 0").isEmpty() and toxicity.toxicity(empty, lab).count() == 0


def test_main_text(spark):
    model = main_text.trained(pages=400)
    rng, right, total = random.Random(77), 0, 0
    for _ in range(80):
        page, truth = main_text.generated_page(rng)
        found = main_text.blocks(page)
        if len(found) == len(truth):
            right += sum(a == b for a, b in zip(main_text.label(model, [found])[0], truth, strict=True))
            total += len(truth)
    assert right >= 0.97 * total
    page = ("<head><title>t</title><style>p{}</style></head><nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>A &amp; B</h1>"
            "<p>First\n <b>bold</b> part of the story, which goes on for a while.<p>Second part of it, longer than the first one was.</article><footer>&copy; us</footer><script>x<y</script>")
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page), (4, "w", "<p>only"), (5, "w", "<<<&&& <!-- never closed")]
    got = main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), model=model).collect()
    assert sorted(r.page_id for r in got) == [1, 1, 2, 3, 4, 5]
    assert next(r.text for r in got if r.page_id == 1) == "A & B First bold part of the story, which goes on for a while. Second part of it, longer than the first one was."
    assert all(r.n_chars == len(r.text) for r in got) and next(r.text for r in got if r.page_id == 2) == ""


def test_main_text_after_options_and_open_head():
    texts = lambda page: [b.text for b in main_text.blocks(page)]
    assert texts("<p>Before</p><select><option>A<option>B</select><article><p>Story</article>") == ["Before", "Story"]
    assert texts("<select><option>A<option>B<option>C</option></select><p>Story") == ["Story"]
    assert texts("<html><head><title>t</title><style>x</style><body><p>Story</p></body></html>") == ["Story"]
    assert texts("<head><noscript><link></noscript><meta a='b'><script>x</script>\n<article>Story</article>") == ["Story"]
    assert texts("<head>\n<title>t</title>Story<p>more") == ["Story", "more"]
    assert texts("<head><template><p>no</p></template><noscript>no</noscript></head><p>Story") == ["Story"]


def test_pipeline(spark):
    import corpus_pipeline
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, before, sf_dir)
        assert after.columns == docs.columns and after.count() <= before.count(), name
        before = after
    tokens = corpus_pipeline.run(spark, sf_dir)
    assert tokens.count() == before.count() and tokens.where("n_tokens <> size(token_ids)").isEmpty()
