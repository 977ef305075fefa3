"""Phrase mining against brute force, and the automata it is made of."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from logscope.llm import phrases as ph
from logscope.llm.count_automata import PAD, CountAutomaton, Union, string_array, to_blob

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, r int"


def brute(rows, min_count, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) >= 2 and a >= min_count}
        best = []
        for p, a in cand.items():
            if any(len(x) > len(p) and 100 * b >= 80 * a and any(x[i:i + len(p)] == p for i in range(len(x) - len(p) + 1)) for x, b in cand.items()):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        best.sort()
        out += [(lang, i + 1, p.decode(), -a, le, ri, n[lang], -s) for i, (s, a, p, le, ri) in enumerate(best[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocab = ["a", "b", "B", "é", "É", "the", "The", "x\x01y", "😀", "z z", "-", "of"]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" ", "  ", "\t", " ", ", ", "\n", ". "]) for _ in range(rng.randrange(60))),
             rng.choice(["en", "en", "de", None, "", "und"]), 1, "p", 2) for i in range(200)]
    rows += [(None, None, "en", 1, "p", 2), (1, "", None, 1, "p", 2), (2, "one two three four five. " * 40, "en", 1, "p", 2)] + rows[:30]
    rows += [(3, "hot pair " * 2000, "en", 1, "p", 2)]
    monkeypatch.setattr(ph, "SHARD_BYTES", 3000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(ph.collocations(df, min_count=5)) == brute(rows, 5)
    assert rows_of(ph.collocations(df, min_count=30, top=7)) == brute(rows, 30, 7)


def test_full_bitmap_loses_nothing(spark, monkeypatch):
    """A bitmap far too small lets everything pass; the counts decide."""
    monkeypatch.setattr(ph, "_membership", lambda bits: lambda h: np.ones(len(h), bool))
    rows = [(i, f"new york city hall {i % 7} of w{i}", "en", 1, "p", 2) for i in range(60)]
    assert rows_of(ph.collocations(spark.createDataFrame(rows, SCHEMA), min_count=8)) == brute(rows, 8)


def test_empty_table(spark):
    assert ph.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def random_rows(rng, n, width=4, symbols=5):
    rows = {tuple(rng.randrange(symbols) for _ in range(rng.randrange(1, width + 1))) for _ in range(n)}
    m = np.array([list(r) + [PAD] * (width - len(r)) for r in sorted(rows)], np.int64).reshape(-1, width)
    return m, np.array([rng.randrange(1, 1000) for _ in m], np.int64)


def as_dict(rows, weights):
    return {tuple(x for x in r if x != PAD): int(w) for r, w in zip(np.asarray(rows).tolist(), weights, strict=True)}


def test_automaton_is_minimal_and_holds_all_sequences():
    rng = random.Random(1)
    for n in (0, 1, 7, 300):
        rows, weights = random_rows(rng, n)
        m = CountAutomaton.build(rows, weights)
        assert as_dict(*m.sequences()) == as_dict(rows, weights)
        right = {}
        for p in [r[:i] for r in as_dict(rows, weights) for i in range(len(r) + 1)] + [()]:
            right[p] = frozenset(r[len(p):] for r in as_dict(rows, weights) if r[:len(p)] == p)
        assert len(m.final) <= len(set(right.values())) + 1  # the root is never shared
    big = np.array([[a, b, c] for a in range(20) for b in range(20) for c in range(20)])
    assert len(CountAutomaton.build(big, np.arange(8000)).final) == 4  # one state a depth


def test_composition_is_the_intersection():
    rng = random.Random(4)
    a, wa = random_rows(rng, 200)
    b, wb = random_rows(rng, 200)
    m, q = CountAutomaton.build(a, wa), CountAutomaton.build(b, wb)
    here, there = m.compose(q)
    got = sorted(zip(m.weights[here].tolist(), q.weights[there].tolist(), strict=True))
    da, db = as_dict(a, wa), as_dict(b, wb)
    assert got == sorted((da[k], db[k]) for k in da if k in db)


def test_union_sums():
    rng = random.Random(9)
    want = Counter()
    u = Union(3, limit=50)
    for _ in range(12):
        words = sorted(rng.sample(["a", "b", "ab", "é", "z", "\x01", "q"], 5))
        langs = sorted(rng.sample(["en", "de", ""], 2))
        rows = sorted({(rng.randrange(2), rng.randrange(5), rng.choice([PAD, rng.randrange(5)])) for _ in range(20)})
        weights = np.array([rng.randrange(1, 9) for _ in rows])
        u.add(to_blob(np.array(rows), weights, string_array(langs), string_array(words)))
        for (g, x, y), n in zip(rows, weights, strict=True):
            want[(langs[g], words[x], *([words[y]] if y != PAD else []))] += int(n)
    rows, weights, langs, words = u.result()
    got = {(langs[g].as_py(), *(words[x].as_py() for x in r if x != PAD)): int(n) for (g, *r), n in zip(rows.tolist(), weights, strict=True)}
    assert got == dict(want) and list(got) == sorted(got)
