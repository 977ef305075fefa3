"""Rows that repeat a doc_id, distinct segments, and lines removed on the given tables."""

import random

import numpy as np

from logscope.llm import decontaminate, fm_dedup, quality_rules

DIR = "/root/testdata/sf0.01"


def force(rows, size=20):
    """Removed words of each row: a window is a repeat if its words also start at a smaller (doc_id, start)."""
    least = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - size + 1):
            k = tuple(w[p:p + size])
            least[k] = min(least.get(k, (i, p)), (i, p))
    out = []
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if least[tuple(w[p:p + size])] < (i, p):
                gone[p:p + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def removed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in fm_dedup.substring_dedup(docs).collect())


def test_equal_places_of_equal_rows_stay(spark):
    text = " ".join(f"w{i}" for i in range(25))
    assert removed(spark, [(7, text), (7, text)]) == force([(7, text), (7, text)]) == [(7, 25, 0, text)] * 2


def test_windows_of_one_id_are_ordered_by_their_start(spark):
    w = " ".join(f"w{i}" for i in range(20))
    rows = [(7, "a b c d e " + w), (7, "x " + w)]
    assert removed(spark, rows) == force(rows)
    assert [r[2] for r in force(rows)] == [20, 0] or [r[2] for r in force(rows)] == [0, 20]


def test_repeated_ids_against_brute_force(spark):
    rng = random.Random(5)
    passages = [[f"p{k}x{j}" for j in range(rng.randint(18, 45))] for k in range(6)]
    rows = []
    for n in range(250):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [f"u{n}x{rng.randint(0, 99)}" for _ in range(rng.randint(0, 7))]
            p = rng.choice(passages)
            lo = rng.randint(0, 6)
            words += p[lo:len(p) - rng.randint(0, 4)]
        rows.append((rng.randint(0, 40), " ".join(words)))
    rows += rows[:30]
    assert removed(spark, rows) == force(rows)


def test_segments_of_an_item_count_once(spark, monkeypatch):
    rng = random.Random(2)
    item = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(100))[:560]
    places = len(decontaminate.Index([(1, item)]).place)
    noise = " ".join("".join(rng.choice("qrstuvwxyz") for _ in range(7)) for _ in range(60))
    docs = spark.createDataFrame([(1, item), (2, f"{noise} {item} {noise} {item}"), (3, noise)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    for step in (decontaminate.STEP, 700):
        monkeypatch.setattr(decontaminate, "STEP", step)
        index = decontaminate.Index([(1, item)])
        data = np.frombuffer(f"{noise} {item} {noise} {item}".encode(), np.uint8)
        seg = index.matches(data, np.array([0, len(data)]))[5]
        assert set(seg) == set(range(places)) and len(seg) > places
    got = {r["doc_id"]: (r["n_segments"], r["edits"], r["start"], r["end"]) for r in decontaminate.contaminated(docs, items).collect()}
    at = len(noise) + 1
    assert got == {1: (places, 0, 0, len(item)), 2: (places, 0, at, at + 2 * len(item) + len(noise) + 2)}


def test_lines_are_removed_on_the_given_tables(spark):
    out = quality_rules.quality_rules(spark.read.parquet(f"{DIR}/documents.parquet"))
    r = out.selectExpr("sum(n_removed_words) as gone", "count_if(not base_failed and not kept) as depleted", "count_if(kept) as kept").first()
    print("removed words, depleted, kept:", r)
    assert r["gone"] > 0 and r["kept"] > 0
