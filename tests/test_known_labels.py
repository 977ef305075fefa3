"""Label matching by the segment index against a plain search over all labels."""

import random
import re

from logscope.operators import prompts as prm


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def norm(t):
    return re.sub("[^a-z0-9]+", " ", t.lower()).strip(" ")


def best(hint, labels):
    h = norm(hint)
    def rank(label):
        v = norm(label)
        a, b = set(h.split(" ")), set(v.split(" "))
        return (h != v, -len(a & b) / len(a | b), edits(h, v), label)
    return min(labels, key=rank)


def perturb(rnd, t, n):
    for _ in range(n):
        i = rnd.randrange(len(t) + 1)
        t = rnd.choice([t[:i] + rnd.choice("abcx") + t[i:], t[:i] + t[i + 1:], t[:i] + rnd.choice("abcx") + t[i + 1:]])
    return t


def test_against_all_labels(spark):
    rnd = random.Random(7)
    labels = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 22))) for _ in range(300)} | {"", "Disk-Full", "disk full", "a b"})
    hints = {perturb(rnd, rnd.choice(labels), n) for n in (0, 1, 2, 3, 5, 6, 7, 9) for _ in range(12)}
    hints |= {"", "!!!", "z" * 40, "q", "disk  full", "b x"}
    df = spark.createDataFrame([(h,) for h in sorted(hints)] + [(None,)], "error_type string")
    vocab = spark.createDataFrame([(v,) for v in labels] + [(None,), (labels[3],)], "label string")
    rows = prm.match_known_label(df, vocab).collect()
    assert len(rows) == len(hints) + 1
    for r in rows:
        if r["error_type"] is not None:
            want = best(r["error_type"], labels)
            assert (r["matched_label"], r["match_distance"]) == (want, edits(norm(r["error_type"]), norm(want))), r
        else:
            assert r["matched_label"] is None


def test_index_holds_every_near_pair_and_few_others(spark):
    rnd = random.Random(11)
    labels = sorted({"".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randrange(14, 22))) for _ in range(800)})
    hints = sorted({perturb(rnd, rnd.choice(labels), rnd.randrange(0, 4)) for _ in range(200)})
    h, v = (spark.createDataFrame([(t,) for t in ts], f"{c} string") for ts, c in ((hints, "_hn"), (labels, "_vn")))
    pairs = {tuple(r) for r in prm._edit_candidates(h, v, 2).collect()}
    near = {(a, b) for a in hints for b in labels if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}
    assert near <= pairs and len(pairs) < len(hints) * len(labels) / 50


def test_no_vocabulary_and_no_hints(spark):
    df = spark.createDataFrame([("abc",), (None,)], "error_type string")
    none = spark.createDataFrame([], "label string")
    assert [r["matched_label"] for r in prm.match_known_label(df, none).collect()] == [None, None]
    some = spark.createDataFrame([("abc",)], "label string")
    assert prm.match_known_label(df.where("false"), some).count() == 0
