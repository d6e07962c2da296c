"""The prefix trie against a trie built in memory."""

import hashlib
import math
import random
import zlib

import pytest

from spellframe.llm import keyed, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, part int"


def brute(rows, fork=True):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    for turns in convs.values():
        turns.sort(key=lambda z: z[:2])
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if fork else 0
        base = convs.get(c - int(math.fmod(c, 100)), [])[:h]
        whole[c] = tuple((z[2], z[3]) for z in base) + tuple((z[2], z[3]) for z in turns[h:])
    members, children = {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += p not in children
    ends = {p: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)) for p, m in members.items()}
    return sorted([(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()], key=str)


def conversations():
    rng = random.Random(1)
    say = lambda: rng.choice(["a", "b", "", None, "éé", "long text " * 5])
    ids = [*range(30), 100, 101, 102, 150, 199, 250, 251, -3, -100, -150, 1000, 1001, 5000, None]
    rows = [(c, rng.choice([None, t, t]), rng.choice(["user", "assistant", None]), say()) for c in ids for t in range(rng.randint(1, 9))]
    rows += [(7000 + i, t, "user", f"hot {t}") for i in range(40) for t in range(8)]  # one group of copies
    rows += [(9000, t, "user", say()) for t in range(400)]  # one long conversation
    rows += [(9100, 1, "user", "x" * 100_000), (9203, 1, "", "only turn")] + rows[:2]
    return [(*r, 7, 3) for r in rows]


@pytest.mark.parametrize("share", [keyed.SHARE, 4])
def test_trie(spark, monkeypatch, share):
    monkeypatch.setattr(keyed, "SHARE", share)  # 4: hardly any key is heavy
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    got = prefix_trie.prefix_trie(spark.createDataFrame(conversations(), SCHEMA).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(conversations())


def test_trie_as_given(spark):
    rows = [(1, 1, "u", "a"), (2, 1, "u", "a"), (2, 2, "u", "b"), (3, 1, "u", "a"), (3, 2, "u", "b"), (4, 5, "u", "c")]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rebuild=None)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, fork=False)


def test_trie_of_nothing(spark):
    for rows in ([], [(None, 1, "u", "a", 1, 1)]):
        assert prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).count() == 0
    none = [(5, 1, "u", "a", 1, 1)]  # shorter than its h, and its base is absent: only the root
    assert [tuple(r)[:7] for r in prefix_trie.prefix_trie(spark.createDataFrame(none, SCHEMA)).collect()] == [r[:7] for r in brute(none)]


def test_a_heavy_conversation_is_cut_into_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows make one task
    rows = [(1, t, "user", f"turn {t}", 0, 0) for t in range(900)] + [(c, 1, "user", "x", 0, 0) for c in range(2, 100)]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(6))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = turns.where("conv = 1").groupBy("part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 500
    assert sorted(r.pos for r in turns.where("conv = 1").collect()) == list(range(1, 901))
