"""Cases from review: what the given tables do not exercise."""

import collections
import math
import zlib

import duckdb
import numpy as np
import pandas as pd

from logscope.llm import catalog, jaccard_join, ngram_lm
from logscope.llm import exchange as X


def interpolated(texts, order, prior=2.0):
    """Score of each (doc_id, text) by the definition."""
    tok = [[*t.lower().split(), None] for _, t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts]
    one, grams, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for w, h in zip(tok, held, strict=True):
        if not h:
            one.update(w)
            for k in range(2, order + 1):
                padded = ["<s>"] * (k - 1) + w
                for j in range(len(w)):
                    grams[tuple(padded[j:j + k])] += 1
                    ctx[tuple(padded[j:j + k - 1])] += 1
    n, v = sum(one.values()), len(one)
    out = {}
    for (i, _), w in zip(texts, tok, strict=True):
        total = 0.0
        for j, x in enumerate(w):
            p = (one[x] + 0.1) / (n + 0.1 * (v + 1))
            for k in range(2, order + 1):
                u = tuple((["<s>"] * (k - 1) + w)[j:j + k - 1])
                p = (grams[(*u, x)] + prior * p) / (ctx[u] + prior)
            total += math.log10(p)
        out[i] = total
    return out


def test_quality_rules_query_removes_lines(spark, tmp_path):
    """The registered query against its oracle where lines are removed and documents depleted."""
    line = "this very line stands in many documents of the host and is boilerplate"
    rows = []
    for host, docs, held in (("big", 400, 150), (None, 130, 120), ("small", 90, 90)):
        for i in range(docs):
            own = " ".join(f"w{len(rows)}x{j}" for j in range(3 if i % 3 == 0 else 30))
            rows.append((len(rows), f"{line.upper() if i % 2 else line}\n{own}\n  {line} " if i < held else own + " and some more words to be long enough", host))
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["op1_quality_rules"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.sql(catalog.oracles()["op1_quality_rules"]).df()
    cols = sorted(want.columns)
    text = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(text(got), text(want))
    by = got.set_index("doc_id")
    assert (by.n_removed_words > 0).sum() == 360 and (~by.base_failed & ~by.kept).sum() > 0


def test_lm_probabilities_below_1e_12(spark):
    """Unseen words after a frequent word keep their own probabilities, at orders 2 and 3."""
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    train = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10][:10]
    rows = [(i, "the " * 500 + f"end rare{i}") for i in train]
    rows += list(zip(held, ["the zzz", "the rare" + str(train[0]), "the the the", "qqq the yyy"], strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for order in (2, 3):
        want = interpolated(rows, order, 1e-6)
        got = {r["doc_id"]: (r["score"], r["n_tokens"]) for r in ngram_lm.lm_scores(docs, order=order, prior=1e-6).collect()}
        for i in held:
            assert abs(got[i][0] - want[i]) < 0.05 * (order - 1) * got[i][1], (order, i, got[i], want[i])
        assert got[held[0]][0] < got[held[1]][0] - 0.5  # a word never seen is less likely than one seen elsewhere


def test_lm_code_range_holds_a_large_corpus():
    n, v, most = 6_000_000_000, 20_000_000, 400_000_000
    for order in (2, 3):
        lowest = ngram_lm.depth(n, v, most, order, 2.0)
        p = 0.1 / (n + 0.1 * (v + 1)) * (2 / (most * 1.05 + 2)) ** (order - 1) * np.array([1.0, 11.0, 1e6])
        got = ngram_lm.code_log10(ngram_lm.prob_code(p, lowest), lowest)
        assert np.abs(got - np.log10(p)).max() < 1e-3
    assert ngram_lm.depth(0, 0, 0, 2, 2.0) >= 1


def test_lm_probabilities_come_from_the_trie(monkeypatch):
    """A k-gram that the trie does not find is scored by the order below, whatever its count."""
    u8 = lambda *x: np.array(x, np.uint8)
    asked = X.blobs([(0, 0, X.pack(u8(1, 0, 3), u8(0, 0, 0), u8(0, 0, 0), np.array([5, 7, 5], np.uint16), u8(0, 0, 0),
                                   *X.small_counts(np.array([3, 0, 1])), ngram_lm.prob_code(np.full(3, 1e-3), 12.0),
                                   ngram_lm.count_code(np.full(3, 50)), np.array([12.0])))])

    def answer():
        (_, _, x), = X.each(ngram_lm._next_answer(2.0, True)(asked))
        return 10 ** ngram_lm.code_log10(X.unpack(x, np.uint16, np.uint8)[0], 12.0)
    assert np.allclose(answer(), [3.002 / 52, 0.002 / 52, 1.002 / 52], rtol=0.07)
    monkeypatch.setattr(ngram_lm.Trie, "find", lambda self, keys: (np.zeros(len(keys), bool), np.zeros(len(keys), np.uint16)))
    assert np.allclose(answer(), 0.002 / 52, rtol=0.07)


def test_jaccard_linked_family_in_blocks_leaves_no_minors(spark, monkeypatch):
    """A family fully linked inside is one component after its leaders have met: no class is copied to all blocks."""
    def no_minors(percent):
        def run(tbl):
            raise ValueError("a block met copies of classes from other blocks")
        return run
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "_across", no_minors)
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, f"{base} end{i}") for i in range(40)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == {0}


def test_store_of_unit_lattices_changes_nothing(monkeypatch):
    """Kept, trimmed and rebuilt lattices, and units of equal hash, give the samples of a store that starts empty."""
    import pyarrow as pa

    from logscope.llm import gumbel_pieces as gp
    from logscope.llm import textnp
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{rng.integers(0, 40)}é" for _ in range(rng.integers(0, 60))) for _ in range(80)] + ["", None, "x" * 900, "\n\n a"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})

    def run():
        out = []
        for b in gp._encode(gp.read_model(gp.MODEL), 2, 17, True, True)(iter([batch])):
            out += [(r["doc_id"], r["rank"], r["ids"], round(r["log_prob"], 9), round(r["inclusion"], 9), r["round_trip"]) for r in b.to_pylist()]
        return sorted(out)
    want = run()
    assert all(r[-1] for r in want)
    monkeypatch.setattr(gp, "CHUNK", 700)
    assert run() == want
    monkeypatch.setattr(gp, "KEEP", 60)
    assert run() == want
    real = textnp.span_hashes
    monkeypatch.setattr(textnp, "span_hashes", lambda *a: real(*a) % textnp.U64(5))  # nearly all units clash
    assert run() == want
