"""Template miners against naive models."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

from logscope.operators import templates as tp
from logscope.operators.components import components

LINES = ["alpha beta 1 gamma", "alpha beta 2 gamma", "alpha beta 22 gamma", "alpha delta", "delta alpha x y", "unique words here", "7 8 9", "5 5", "",
         "  ", "beta gamma only", "gamma beta only", "x y z", "x y w", "x  y\tq", None, "a a a a", "é ü é", "<*> x y"] + ["hot line 3 of all"] * 30


def tip_model(lines, threshold=0.5, support=2):
    masks = Counter()
    for t in lines:
        if t is not None:
            masks[tuple("<*>" if re.search("[0-9]", w) else w for w in t.split())] += 1
    n, both = Counter(), Counter()
    for m, w in masks.items():
        for a in set(m) - {"<*>"}:
            n[a] += w
    for m, w in masks.items():
        for a, b in combinations(sorted(t for t in set(m) if t != "<*>" and n[t] >= support), 2):
            both[a, b] += w
    strong = defaultdict(set)
    for (a, b), c in both.items():
        if c >= threshold * max(n[a], n[b]):
            strong[a].add(b)
            strong[b].add(a)
    events, votes = {}, defaultdict(Counter)
    for m, w in masks.items():
        ok = [t for t in set(m) if t != "<*>" and n[t] >= support]
        keys = []
        if ok:
            anchor = min(ok, key=lambda t: (-len(strong[t] & set(ok)), -n[t], t))
            keys = sorted({anchor} | (strong[anchor] & set(ok)))
        out = []
        for t in m:
            t = t if t in keys else "<*>"
            if t != "<*>" or not out or out[-1] != "<*>":
                out.append(t)
        skeleton = " ".join(out)
        events[m] = "k " + " ".join(keys) if keys else "s " + skeleton
        votes[events[m]][skeleton] += w
    shown = {e: min(c, key=lambda s: (-c[s], s)) for e, c in votes.items()}
    out = []
    for t in lines:
        if t is None:
            out.append((t, None, None))
        else:
            e = events[tuple("<*>" if re.search("[0-9]", w) else w for w in t.split())]
            out.append((t, shown[e], hashlib.md5(e.encode()).hexdigest()))
    return sorted(out, key=str)


def test_tip(spark):
    df = spark.createDataFrame([(t, "kept") for t in LINES], "e_message_normalized string, _w string").repartition(3)
    for threshold, support in ((0.5, 2), (0.9, 1)):
        got = tp.templates_tip(df.select("e_message_normalized"), threshold=threshold, support=support)
        rows = sorted(((r["e_message_normalized"], r["template"], r["event_id"]) for r in got.collect()), key=str)
        assert rows == tip_model(LINES, threshold, support)
    assert tp.templates_tip(df.select("e_message_normalized").limit(0)).count() == 0


def test_tip_pairs_follow_distinct_messages(spark):
    """A thousand times the rows are the same pairs: nothing is paired row by row."""
    df = spark.createDataFrame([(t,) for t in LINES * 50], "e_message_normalized string")
    plan = tp.templates_tip(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan
    got = {(r["e_message_normalized"], r["event_id"]) for r in tp.templates_tip(df).collect()}
    assert got == {(t, e) for t, _, e in tip_model(LINES * 50)}


MORE = LINES + [f"user {a} did {b} on {c} then left the {d} room now" for a in ("ann", "bob", "eve") for b in ("read", "write") for c in ("disk", "tape")
                for d in ("big", "small")] + ["user ann sold all of her old red cars last may", "user bob sold all of his old blue cars last june",
                "p q a1 b c d e f g h", "p q a b x y z u v w", "p q a b c d m n o k", "p q l l l l e f g h", "p q r s t u v w x y"]


def masks_of(lines):
    out = Counter()
    for t in lines:
        if t is not None:
            out[tuple("<*>" if re.search("[0-9]", w) else w for w in t.split())] += 1
    return out


def shown(lines, templates):
    out = []
    for t in lines:
        x = None if t is None else templates[tuple("<*>" if re.search("[0-9]", w) else w for w in t.split())]
        out.append((t, x, None if x is None else hashlib.md5(x.encode()).hexdigest()))
    return sorted(out, key=str)


def drain_model(lines, depth=2, threshold=0.4):
    """Components of similar messages by comparing all pairs of a leaf."""
    ms = sorted(masks_of(lines))
    comp = {m: m for m in ms}

    def top(m):
        while comp[m] != m:
            m = comp[m]
        return m
    for a, b in combinations(ms, 2):
        if len(a) == len(b) and a[:depth] == b[:depth] and sum(x == y for x, y in zip(a, b)) >= threshold * len(a):
            comp[top(a)] = top(b)
    groups = defaultdict(list)
    for m in ms:
        groups[top(m)].append(m)
    return shown(lines, {m: " ".join(c[0] if len(set(c)) == 1 else "<*>" for c in zip(*groups[top(m)])) for m in ms})


def brain_model(lines, branches=2):
    ms = masks_of(lines)
    f = Counter()
    for m, w in ms.items():
        for p, x in enumerate(m):
            f[len(m), p, x] += w
    root = {}
    for m in ms:
        combos = defaultdict(list)
        for p, x in enumerate(m):
            if x != "<*>":
                combos[f[len(m), p, x]].append((p, x))
        best = max(combos, key=lambda k: (len(combos[k]), k), default=None)
        root[m] = (best, tuple(combos[best]) if best else ())
    columns = defaultdict(set)
    for m in ms:
        for p, x in enumerate(m):
            columns[len(m), root[m][1], p].add(x)
    templates = {}
    for m in ms:
        out = []
        for p, x in enumerate(m):
            own, d = f[len(m), p, x], len(columns[len(m), root[m][1], p])
            best = root[m][0]
            keep = best is not None and (own == best or (own > best and d == 1) or (own < best and d <= branches))
            out.append(x if keep else "<*>")
        templates[m] = " ".join(out)
    return shown(lines, templates)


def rows_of(df):
    return sorted(((r["e_message_normalized"], r["template"], r["event_id"]) for r in df.collect()), key=str)


def test_drain(spark):
    df = spark.createDataFrame([(t, "kept") for t in MORE], "e_message_normalized string, _w string").repartition(3)
    for depth, threshold in ((2, 0.4), (1, 0.6)):
        assert rows_of(tp.templates_drain(df.select("e_message_normalized"), depth=depth, sim_threshold=threshold)) == drain_model(MORE, depth, threshold)
    assert tp.templates_drain(df.limit(0)).count() == 0
    assert "_w" in tp.templates_drain(df).columns


def test_drain_random_leaf(spark):
    """One leaf of messages that agree in few places: the prefix of rare tokens loses no link."""
    rng = random.Random(8)
    lines = ["s t " + " ".join(rng.choice("abcde") for _ in range(9)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in lines], "e_message_normalized string").repartition(4)
    got = rows_of(tp.templates_drain(df, sim_threshold=0.7))
    assert got == drain_model(lines, 2, 0.7) and 10 < len({r[1] for r in got}) < len(set(lines)) - 10


def test_brain(spark):
    df = spark.createDataFrame([(t,) for t in MORE], "e_message_normalized string").repartition(3)
    for branches in (2, 1):
        assert rows_of(tp.templates_brain(df, branches=branches)) == brain_model(MORE, branches)
    assert tp.templates_brain(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(180)] + [(7, 7), (9999, 9999)]
    comp = {x: x for e in edges for x in e if e[0] != e[1]}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            comp[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    assert sorted((r["id"], r["comp"]) for r in got) == sorted((x, top(x)) for x in comp)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def kept_places(x, y):
    """Places of x in a longest common subsequence, by the full table."""
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
    out, i, j = [], len(x), len(y)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def spell_model(lines):
    ms = sorted(masks_of(lines), key=" ".join)
    seq = {m: [t for t in m if t != "<*>"] for m in ms}
    comp = {m: m for m in ms}

    def top(m):
        while comp[m] != m:
            m = comp[m]
        return m
    for a, b in combinations(ms, 2):
        if seq[a] and seq[b] and 2 * len(kept_places(seq[a], seq[b])) >= max(len(seq[a]), len(seq[b])):
            comp[top(b)] = top(a)
    groups = defaultdict(list)
    for m in ms:
        groups[top(m)].append(m)
    templates = {}
    for group in groups.values():
        first = seq[group[0]]
        places = set(range(len(first)))
        for m in group:
            places &= set(kept_places(first, seq[m]))
        templates.update(dict.fromkeys(group, " ".join(first[p] for p in sorted(places))))
    return shown(lines, templates)


def test_common_subsequences_are_those_of_the_table():
    rng = random.Random(6)
    for _ in range(400):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 90 if rng.random() < 0.1 else 9))] for _ in range(2))
        assert tp._matched(x, y) == kept_places(x, y)


def test_spell(spark):
    rng = random.Random(9)
    lines = MORE + ["<*> " + " ".join(rng.choice("abcdefghijklmnopqr") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    df = spark.createDataFrame([(t, "kept") for t in lines], "e_message_normalized string, _w string").repartition(3)
    got = rows_of(tp.templates_spell(df))
    assert got == spell_model(lines) and 10 < len({r[1] for r in got})
    assert tp.templates_spell(df.limit(0)).count() == 0
