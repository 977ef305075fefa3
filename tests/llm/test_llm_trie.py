"""Conversation prefix trie against a brute-force trie and against SQL."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

from logscope.llm import prefix_trie as pt
from logscope.session import materialise

SCHEMA = "conv_id long, turn int, role string, text string, pos string, key int, start double"


def brute(rows, block=100, heads=6, mixed=True):
    """Nodes of the rebuilt conversations, by dictionary of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            r, t = role or "", text or ""
            key = hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), r, key, t))
    own = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads if mixed else 0
        made[c] = own.get(c - int(math.fmod(c, block)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    for p, m in members.items():
        ends = sorted(c for c in m if len(made[c]) == len(p))
        out[p] = (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                  hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(out.values(), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*pt.COLUMNS).collect()), key=str)


def random_rows(seed, n=60, longest=9, words=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(400), rng.randrange(8) * 100, 7, None if rng.random() < 0.1 else 3, -rng.randrange(250)])
        for t in range(rng.randrange(longest)):
            text = rng.choice(["", None, "é😀", "a" * rng.randrange(words), "hot"])
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", "", None]), text, "x", 1, 0.5))
    return rows


def test_against_brute_force(spark, seed=1):
    rows = random_rows(seed, n=150)
    df = materialise(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = rows_of(pt.prefix_trie(pt.with_block_heads(pt.dialogues(df))))
    assert got == brute(rows)


def test_short_segments_and_many_shards(spark, segment=4):
    """Segments shorter than conversations: shared levels, chains, boundary nodes of many shards."""
    rows = random_rows(5, n=80, longest=10, words=2)
    rows += [(c, t, "user", f"copy {t}", "x", 1, 0.5) for c in range(1000, 1040) for t in range(11)]  # equal conversations
    rows += [(2000 + c, t, "user", f"copy {t}" if t < 6 + c % 3 else f"own {c}", "x", 1, 0.5) for c in range(30) for t in range(5 + c % 5)]
    df = materialise(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = rows_of(pt.prefix_trie(pt.dialogues(df), segment=segment, shard_turns=40))
    assert got == brute(rows, mixed=False)


def test_hot_conversation_over_shards(spark):
    """A third of all ids hold one conversation: its ends are chunks of several shards, in the order of the ids."""
    rows = [(c, t, "user", "the same" if c % 3 == 0 else f"text {c}", "x", 1, 0.5) for c in range(900) for t in range(2)]
    df = materialise(spark.createDataFrame(rows, SCHEMA))
    got = rows_of(pt.prefix_trie(pt.dialogues(df), shard_turns=100))
    assert got == brute(rows, mixed=False)


def test_empty_table_and_turnless(spark):
    assert pt.prefix_trie(pt.with_block_heads(pt.dialogues(spark.createDataFrame([], SCHEMA)))).count() == 0
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)  # its block has no first conversation
    rows = [(c, 0, "user", "gone", "x", 1, 0.5), (None, 0, "user", "no id", "x", 1, 0.5)]
    got = rows_of(pt.prefix_trie(pt.with_block_heads(pt.dialogues(spark.createDataFrame(rows, SCHEMA)))))
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == brute(rows)


def test_balanced_tree():
    tree = pt.TernaryTree()
    tree.insert_medians([([i], [0]) for i in range(1023)])

    def height(t):
        return 0 if t < 0 else 1 + max(height(tree.low[t]), height(tree.high[t]))
    assert height(tree.down[0]) == 10
