"""What the substring operators send: no window that shares only its anchor, few bytes for a byte of text; results by brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from logscope.llm import exchange as X
from logscope.llm import fm_dedup, suffix_dedup
from logscope.llm import windows as W

OPERATORS = [suffix_dedup.byte_windows(50), fm_dedup.word_windows(20)]


def table(rows):
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})


def parcels(rows, g=0):
    held = table(rows).append_column("_g", pa.array([g] * len(rows), pa.int64())).to_batches()
    return pa.concat_tables([pa.table({"_x": b.column("_x")}) for b in X._wrap(iter(held))])


def sent(w, groups, n_buckets=4):
    """Values of the documents, of the keys and of the contents, for groups of rows, as the exchanges get them."""
    key = lambda g: (pa.scalar(g),)
    docs = [parcels(rows, g) for g, rows in enumerate(groups)]
    asked = pa.concat_tables([W._first_map(w, n_buckets)(key(g), d) for g, d in enumerate(docs)])
    of = lambda t, c, v: t.filter(pa.compute.equal(t.column(c), v))
    told = pa.concat_tables([X.answer_shared(t) for b in range(n_buckets) if (t := of(asked, "_b", b)).num_rows])
    out = pa.concat_tables([W._second_map(w, n_buckets)(key(g), d, of(told, "_g", g)) for g, d in enumerate(docs)])
    return [x for d in docs for x in d.column("_x").to_pylist()], asked.column("_x").to_pylist(), out.column("_x").to_pylist()


@pytest.mark.parametrize("w", OPERATORS, ids=["bytes", "words"])
def test_windows_that_share_only_their_anchor_are_not_sent(w):
    """Every text holds the same short strings (24 bytes, 9 words), each time among others, so no window comes twice."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    same = [" ".join(word(3) for _ in range(9))[:36 if w.same_document else 24] for _ in range(40)]
    text = lambda: "".join(f"{s} {' '.join(word(5) for _ in range(12))} " for s in rng.sample(same, 20))
    groups = [[(g * 30 + i, text()) for i in range(30)] for g in range(4)]
    tokens = [w.tokens(table(g)) for g in groups]
    anchors = [np.unique(W.segments(w, *t)[3]) for t in tokens]
    assert len(np.intersect1d(anchors[0], anchors[1])) > 20  # they do share anchors
    assert sent(w, groups)[2] == []


def test_bytes_sent_for_copies():
    """Prose of 200 words in which three texts of ten are copies in another group: under 1.2 bytes in all for a byte of text."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(200)]
    text = lambda: " ".join(rng.choices(vocabulary, k=300))
    copies = [text() for _ in range(30)]
    groups = [[(g * 1000 + i, text()) for i in range(70)] + [(g * 1000 + 100 + i, c) for i, c in enumerate(copies)] for g in range(4)]
    size = sum(len(t) for g in groups for _, t in g)
    assert sum(len(x) for part in sent(suffix_dedup.byte_windows(50), groups, 2) for x in part) < 1.2 * size


def test_parcels_give_the_rows_back():
    rows = [(5, "b"), (None, "é"), (5, None), (-1, ""), (None, ""), (7, "a" * 1000), (5, "a")]
    got = X.opened(parcels(rows))
    want = X.in_order(table([(i, t or "") for i, t in rows]))
    assert got.column("doc_id").to_pylist() == want.column("doc_id").to_pylist() == [-1, 5, 5, 5, 7, None, None]
    assert got.column("text").to_pylist() == [t.encode() for t in want.column("text").to_pylist()]
    assert X.opened(parcels([(1, ""), (2, None)])).column("text").to_pylist() == [b"", b""]
    assert X.opened(parcels(rows).slice(0, 0)).num_rows == 0


def test_many_parcels_of_many_groups(monkeypatch):
    monkeypatch.setattr(X, "PARCELS", 1)
    rows = [(i, f"text {i}" * (i % 5)) for i in range(100)]
    held = table(rows).append_column("_g", pa.array([i % 3 for i in range(100)], pa.int64()))
    got = pa.Table.from_batches(list(X._wrap(iter(held.to_batches(max_chunksize=9)))))
    for g in range(3):
        own = X.opened(got.filter(pa.compute.equal(got.column("_g"), g)))
        assert list(zip(*own.to_pydict().values(), strict=True)) == [(i, t.encode()) for i, t in rows if i % 3 == g]


def test_repeats_of_all_lengths_against_brute_force(spark):
    """Passages of 44 to 90 bytes and parts of them, among noise, in rows with repeated and null ids."""
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [noise(rng.randint(44, 90)) for _ in range(12)] + ["ab" * 40, "a" * 70]

    def text():
        out = ""
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            lo = rng.choice([0, 0, rng.randint(0, 30)])
            out += noise(rng.randint(0, 60)) + p[lo:lo + rng.choice([len(p), rng.randint(40, 80)])]
        return out
    rows = [(rng.choice([None, i // 2, i]), rng.choice([None, text(), text(), text()])) for i in range(150)]
    least = {}
    order = lambda i: float("inf") if i is None else i
    for i, t in rows:
        for p in range(len(t or "") - 49):
            least[t[p:p + 50]] = min(order(i), least.get(t[p:p + 50], float("inf")))
    want = []
    for i, t in rows:
        t, gone = t or "", bytearray(len(t or ""))
        for p in range(len(t) - 49):
            if least[t[p:p + 50]] < order(i):
                gone[p:p + 50] = b"\1" * 50
        want.append((order(i), sum(gone), "".join(c for c, x in zip(t, gone, strict=True) if not x).encode()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(order(r["doc_id"]), r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[1] for w in want) > 2000
