"""The alignment of two tokenizers against both libraries on whole texts, token by token."""

import hashlib
import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from spellframe.llm import tokenizer_alignment as ta

A = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, block long, ids string, pair long"


def plain(text):
    """Groups of a whole text, by running sums of decoded bytes."""
    letters, want = ta.byte_letters(), (" " + (text or "")).encode()
    if not text:
        return []
    enc = A.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(letters[c] for c in t)) for i, t in zip(enc.ids, enc.tokens, strict=True)]
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()) for i in B.encode(text) for p in [B.id_to_piece(i)]]
    if any(b"".join(x for _, x in tokens) != want for tokens in (a, b)):
        return []
    out, left, right, i, j, m, n = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if m <= n and i < len(a):
            left.append(a[i][0])
            m += len(a[i][1])
            i += 1
        else:
            right.append(b[j][0])
            n += len(b[j][1])
            j += 1
        if m == n:
            out.append((left, right))
            left, right = [], []
    return out


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute(rows):
    groups = [plain(r[1]) for r in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    n, highest = Counter(p for one in links for p in one), {}
    for (a, _), k in n.items():
        highest[a] = max(k, highest.get(a, 0))
    return sorted([(r[0], sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(one.values()), sum(k for p, k in one.items() if n[p] == highest[p[0]]),
                    sum(k * n[p] for p, k in one.items()), hashlib.sha256(written(g).encode()).hexdigest() if g else "") for r, g, one in zip(rows, groups, links, strict=True)], key=str), n


def corpus():
    rng = random.Random(1)
    letters = [*"abcdeéß日本🎉 \n\t'.,0123_-▁ ", "\x00", "\xa0", " ", "\x85", "　", "\x1c", "́", "ﬁ"]
    clean = [c for c in letters if c != "▁"] + ["the ", "river "]
    texts = [None, "", " ", "  ", " a", "a ", "a  ", "<s> </s> <unk> <|endoftext|> <0x41>", "x▁y", "▁", "word " * 3000, "日本語" * 500, "a" * 5000, "don't we'll  stop   it\n\n \n x",
             "🎉" * 300, "é" * 40 + "\n" * 30, "same", "same"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += ["".join(rng.choice(clean) for _ in range(rng.randint(1, 90))) for _ in range(250)]
    return [(i, t, 1, "x", 2) for i, t in enumerate(texts)] + [(None, "no id", 1, "x", 2), (3, "again", 1, "x", 2)]


@pytest.fixture(scope="module")
def aligner():
    return ta.Aligner(*[open(public_tokenizers.path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")])


@pytest.mark.parametrize("sizes", [{}, {"TOGETHER": 50, "WIDE": 3, "REMEMBER": 200}])
def test_groups_of_texts(aligner, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ta, name, value)
    aligner.forget()
    for start in range(0, len(corpus()), 40):  # segments are forgotten between blocks in the second case
        rows = corpus()[start:start + 40]
        block = ta.Block(aligner)
        block.add([r[0] for r in rows], [r[1] or "" for r in rows], shown=True)
        assert block.shown == [written(plain(r[1])) for r in rows]
        block.row(0, ta.pa.int64())
    assert len(aligner.known) == len(aligner.shown) == len(aligner.starts) - 1 and 4 * len(aligner.known) == len(aligner.sizes)


def test_alignment(spark):
    frame = spark.createDataFrame(corpus(), SCHEMA).repartition(5)
    want, n = brute(corpus())
    assert sorted((tuple(r) for r in ta.align_documents(frame).collect()), key=str) == want
    assert {(r.a_id, r.b_id): r.n_docs for r in ta.pair_counts(frame).collect()} == n
    shown = {(r.doc_id, r.groups) for r in ta.token_groups(frame).collect()}
    assert shown == {(r[0], written(plain(r[1]))) for r in corpus()}


def test_nothing_and_text_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ta.align_documents(empty).count() == 0 and ta.pair_counts(empty).count() == 0
    got = ta.align_documents(spark.createDataFrame([("k", "a river"), ("m", None)], "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.n_groups, r.groups_sha256 == "") for r in got) == [("k", 2, False), ("m", 0, True)]


def test_packed_numbers():
    for values in ([], [0], [1, -5, 70_000, 2**31 - 1]):
        assert ta.unpack(ta.pack(np.array(values, np.int64))).tolist() == values


def kept(aligner):
    """Bytes of what an aligner remembers."""
    size = sys.getsizeof
    return size(aligner.known) + size(aligner.shown) + sum(map(size, [*aligner.known, *aligner.shown, aligner.codes, aligner.times, aligner.starts, aligner.sizes]))


def test_long_segments_are_not_remembered_without_a_bound(aligner, monkeypatch):
    monkeypatch.setattr(ta, "REMEMBER_BYTES", 20 << 20, raising=False)
    rng = random.Random(2)
    aligner.forget()
    for _ in range(9):
        block = ta.Block(aligner)
        assert kept(aligner) < 24 << 20  # all 900 take more, and are far fewer than REMEMBER
        block.add(list(range(100)), ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2000)) for _ in range(100)])
        block.row(0, ta.pa.int64())
    ta.Block(aligner)
    assert kept(aligner) < 24 << 20
    aligner.forget()


def test_a_block_and_the_rows_cut_together_are_small(spark):
    text = "the river bends " * 30_000  # 480,000 characters
    frame = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string").coalesce(1)
    blocks = ta.alignment_blocks(frame).select("ids").collect()
    assert sorted(i for b in blocks for i in b.ids) == list(range(20)) and max(len(b.ids) for b in blocks) <= 11
    batch = ta.pa.RecordBatch.from_pydict({"id": list(range(300)), "text": ["x" * 5_000_000, *["y" * 100_000] * 30, *[""] * 269]})
    parts = list(ta._in_rows([batch]))
    assert [i for ids, _ in parts for i in ids] == list(range(300)) and all(len(t) == 1 or sum(map(len, t)) <= 2_000_000 for _, t in parts)
    assert list(ta._in_rows([batch.slice(0, 0)])) == []


def test_pairs_of_a_block_after_segments_were_forgotten(aligner, monkeypatch):
    monkeypatch.setattr(ta, "REMEMBER_BYTES", 60_000)
    aligner.forget()
    rows = corpus() * 2
    for start in range(0, len(rows), 40):
        part = rows[start:start + 40]
        block = ta.Block(aligner)
        block.add([r[0] for r in part], [r[1] or "" for r in part])
        row = block.row(0, ta.pa.int64())
        want = Counter(x << 32 | y for r in part for x, y in {(x, y) for a, b in plain(r[1]) for x in a for y in b})
        assert dict(zip(row.column("pairs")[0].as_py(), row.column("holders")[0].as_py(), strict=True)) == want
    assert len(aligner.known) == len(aligner.shown) == len(aligner.starts) - 1 and 4 * len(aligner.known) == len(aligner.sizes)
    aligner.forget()


def test_long_documents_come_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, text = spark.conf.get(key, None), "y" * 1_000_000

    def sizes(batches):
        for batch in batches:
            yield ta.pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    frame = spark.createDataFrame([(i,) for i in range(12)], "i int").coalesce(1).select(ta.F.lit(text).alias("text"))
    with ta.small_batches(spark, ta.BATCH_BYTES):
        seen = [r.n for r in frame.mapInArrow(sizes, "n long").collect()]
    assert sum(seen) == 12 and max(seen) <= 6 and spark.conf.get(key, None) == before
