"""Registered queries against plain Python over the whole small tables, and parts against their definitions."""

import collections
import hashlib
import itertools
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from logscope.llm import catalog, decontaminate, fm_dedup, gumbel_pieces, jaccard_join, ngram_lm, pii, suffix_dedup
from logscope.llm import quality_rules as qr

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DIR}/documents.parquet").sort_values("doc_id")


def run(spark, name):
    return catalog.queries()[name](spark, DIR).toPandas()


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    want = con.sql(catalog.oracles()[name]).df()
    got = run(spark, name)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    text = lambda d: d[cols].convert_dtypes().astype(str).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(text(got), text(want))


def test_repeated_words_by_definition(spark):
    import random
    random.seed(3)
    texts = [" ".join(random.choice("abc") for _ in range(random.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in qr.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if seen[tuple(w[k:k + 5])] > 1 for j in range(5)}
        assert got[i] == len(cover)


def test_suffix_dedup(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op2_suffix_dedup").itertuples()}
    first = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p:p + 50], i) < i:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_suffix_sort_orders_and_finds_common_lengths():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    s = suffix_dedup.Suffixes(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    at = rng.permutation(390)[:300]
    lo, hi = np.zeros(300, np.int64), np.full(300, 300)
    got = s.sort(at, lo, hi)
    words = [bytes(data[i:i + 8]) for i in got]
    assert words == sorted(words) and sorted(got) == sorted(at)
    for a, b in zip(at[:50], at[50:100], strict=True):
        x, y = bytes(data[a:a + 8]), bytes(data[b:b + 8])
        want = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), 8)
        assert s.common(np.array([a]), np.array([b]))[0] == want


def test_collisions_fall_back_to_bytes(monkeypatch):
    monkeypatch.setattr(suffix_dedup.Suffixes, "_equal", lambda self, a, b, n: np.ones(len(a), bool))
    data = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60, np.uint8)
    got = suffix_dedup.sorted_minima(50)(data, np.array([60, 60, 60]), np.full(3, 7, np.uint64), np.zeros(3, np.int64), np.array([5, 1, 2]))
    assert got.reshape(3, 11).tolist() == [[2] * 11, [1] * 11, [2] * 11]


def test_substring_dedup(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op8_substring_dedup").itertuples()}
    seen = set()
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p:p + 20])
            if k in seen:
                gone[p:p + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    seq = rng.integers(0, 37, 1000)
    tree = fm_dedup.WaveletMatrix(seq)
    sym, lo = rng.integers(0, 37, 300), rng.integers(0, 500, 300)
    hi = lo + rng.integers(0, 500, 300)
    a, b, _ = tree.rank(sym, lo, hi)
    assert a.tolist() == [int((seq[:x] == s).sum()) for s, x in zip(sym, lo, strict=True)]
    assert b.tolist() == [int((seq[:x] == s).sum()) for s, x in zip(sym, hi, strict=True)]


def test_repeats_inside_long_and_periodic_texts(spark):
    period = " ".join(f"p{i % 3}" for i in range(200))
    rows = [(1, period), (2, "x " + period + " y"), (3, " ".join(f"q{i}" for i in range(60)) + " " + " ".join(f"q{i}" for i in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in fm_dedup.substring_dedup(df).collect()}
    seen = set()
    for i, t in rows:
        w, gone = t.split(), set()
        for p in range(len(w) - 19):
            k = tuple(w[p:p + 20])
            if k in seen:
                gone |= set(range(p, p + 20))
            seen.add(k)
        assert got[i] == len(gone)


def components_by_force(docs, n, percent):
    sets = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, s in sets.items():
        for j, both in collections.Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sets, {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [2048, 2])
def test_jaccard(spark, docs, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    sets, want = components_by_force(docs, 4, 85)
    got = run(spark, "op5_jaccard_join")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_families_in_blocks(spark, monkeypatch):
    """Families of near copies, some of them linked only by a chain, cut into many blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for f in range(4):
        w = [f"f{f}w{i}" for i in range(120)]
        for _ in range(12):
            for p in rng.integers(0, 120, 2 + f):
                w = [*w]
                w[p] = f"n{k}p{p}"
            rows.append((k, " ".join(w)))
            k += 1
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])
    sets, want = components_by_force(frame, 4, 85)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_signature_tree_loses_no_link():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64)) for _ in range(20)]
    sets = [np.sort(np.concatenate([b[:60 - c], rng.integers(0, 1 << 63, c).astype(np.uint64)])) for b in base for c in (0, 2, 5, 9)]
    tree = jaccard_join.SignatureTree(sets, 85)
    a, b = tree.candidates(tree)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if jaccard_join.linked(sets[i], sets[j], 85):
            assert (i, j) in found
    assert len(found) < len(sets) ** 2 / 4


def test_decontamination_against_edit_distance():
    """Every segment within its budget is found: planted passages with random edits, against a full alignment."""
    rng = np.random.default_rng(6)
    item = "".join(chr(c) for c in rng.integers(97, 123, 150))
    index = decontaminate.Index([(1, item)])
    texts = []
    for edits in range(10):
        p = list(item)
        for at in sorted(rng.choice(150, edits, replace=False), reverse=True):
            kind = rng.integers(0, 3)
            p[at:at + 1] = [] if kind == 0 else [chr(rng.integers(65, 91))] if kind == 1 else [p[at], "#"]
        texts.append("".join(chr(c) for c in rng.integers(97, 123, 300)) + "".join(p) + "zz" * 40)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, _, cost, _, _, _ = index.matches(data, off)

    def least(seg, text):
        d = np.zeros(len(text) + 1, int)
        for c in seg:
            new = np.empty_like(d)
            new[0] = d[0] + 1
            for j in range(len(text)):
                new[j + 1] = min(d[j] + (c != text[j]), d[j + 1] + 1, new[j] + 1)
            d = new
        return d.min()
    for i, t in enumerate(texts):
        t = t.lower()
        best = [least(bytes(index.bytes[s][:n]).decode(), t) for s, n in enumerate(index.length)]
        ok = [b for b, k in zip(best, index.edits, strict=True) if b <= k]
        assert (i in row) == bool(ok)
        if ok:
            assert cost[row == i].min() == min(ok)


def test_decontamination_query(spark, docs):
    got = run(spark, "op3_decontamination")
    bench = pd.read_parquet(f"{DIR}/benchmark.parquet")
    found = set(zip(got.doc_id, got.item_id, strict=True))
    exact = {(d, i) for d, t in zip(docs.doc_id, docs.text, strict=True) for i, x in zip(bench.item_id, bench.text, strict=True) if x.lower() in t.lower()}
    assert exact <= found and len(found - exact) <= len(exact)
    one = decontaminate.contaminated(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet"))
    assert one.count() == len(got)


def test_decontamination_in_blocks(spark, monkeypatch):
    d, b = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contaminated(d, b).select("doc_id", "item_id").collect()))
    assert len(decontaminate.indexes(b, 2000)) > 1
    whole = decontaminate.indexes
    monkeypatch.setattr(decontaminate, "indexes", lambda items: whole(items, 2000))
    assert sorted(map(tuple, decontaminate.contaminated(d, b).select("doc_id", "item_id").collect())) == want


def test_quality_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.queries()["op6_quality_classifier"](spark, sf).toPandas()
    assert len(got) == 1000 and set(got.held_out[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]) == {True}
    m = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.9


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = [int(c) for c in m[0] if c in "0123456789"]
            doubled = sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])
            if {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and doubled % 10 == 0,
                    "phone": 10 <= len(d) <= 15}[k]:
                out.append((k, *m.span()))
    return sorted(out, key=lambda x: (x[1], list(PATTERNS).index(x[0])))


def test_base_spans_are_the_patterns():
    import random
    random.seed(7)
    for _ in range(5000):
        t = "".join(random.choice("@.+-() 0123456789ab%") for _ in range(random.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t)


def test_pii_query(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op7_pii").itertuples()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        base = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for k, *_ in base) for x in pii.KINDS)
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(got[i].spans.split(","))


def test_tagger_learns_and_windows_agree():
    import random
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8)))

    def text():
        w = [word() for _ in range(30)]
        at = random.randint(5, 25)
        w[at] = random.choice([f"{word()}@{word()}.com", ".".join(str(random.randint(0, 255)) for _ in range(4)), f"+1 ({random.randint(100, 999)}) 555-{random.randint(1000, 9999)}"])
        return " ".join(w)
    texts = [text() for _ in range(300)]
    sym, gold = [], []
    for t in texts:
        lo, hi = pii.stretches(t)[0]
        at = max(0, min((lo + hi - pii.WINDOW) // 2, len(t) - pii.WINDOW))
        sym.append(pii.classes(t)[at:at + pii.WINDOW])
        gold.append(pii.tags(pii.base_spans(t), at, at + pii.WINDOW))
    model = pii.train(np.array(sym), np.array(gold), rounds=12)
    hits = total = 0
    for t in [text() for _ in range(100)]:
        long = t + " " + text()  # stretches of several windows
        part = pii.decode(model, [pii.classes(long)])[0]
        want = set(pii.base_spans(long))
        hits += len(set(part) & want)
        total += len(want)
    assert hits > 0.8 * total


def test_crf_gradient_by_differences():
    rng = np.random.default_rng(9)
    score, gold, trans = rng.normal(size=(5, 3, pii.TAGS)), rng.integers(0, pii.TAGS, (5, 3)), rng.normal(size=(pii.TAGS, pii.TAGS))
    loss, ds, dt = pii._crf_gradient(score, gold, trans)
    for at in [(0, 0, 1), (2, 1, 3), (4, 2, 0)]:
        moved = score.copy()
        moved[at] += 1e-5
        assert abs((pii._crf_gradient(moved, gold, trans)[0] - loss) / 1e-5 - ds[at]) < 1e-4
    moved = trans.copy()
    moved[2, 3] += 1e-5
    assert abs((pii._crf_gradient(score, gold, moved)[0] - loss) / 1e-5 - dt[2, 3]) < 1e-4


def test_lm(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op9_lm_scoring").itertuples()}
    tok = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    train = [w for i, w in tok.items() if zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(x for w in train for x in w)
    pairs = collections.Counter(p for w in train for p in zip(["<s>", *w], w, strict=False))
    before = collections.Counter(c)
    before["<s>"] = len(train)
    n, v = sum(c.values()), len(c)
    for i, w in tok.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 10 == 0)
        p = [(c[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        assert math.isclose(r.base_score, sum(map(math.log10, p)), rel_tol=1e-9)
        want = sum(math.log10((pairs[u, x] + 2 * q) / (before[u] + 2)) for u, x, q in zip(["<s>", *w], w, p, strict=False))
        assert abs(r.score - want) < 0.05 * len(w)


def test_elias_fano():
    rng = np.random.default_rng(10)
    for n, top in ((1, 5), (100, 101), (1000, 1 << 40), (500, 600), (0, 10)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = ngram_lm.EliasFano.build(values, top)
        assert ef[np.arange(n)].tolist() == values.tolist()
        x = rng.integers(0, top, 200).astype(np.uint64)
        got = ef.successor(x, np.zeros(200, np.int64), np.full(200, n))
        assert got.tolist() == np.searchsorted(values, x).tolist()


def test_trie(tmp_path):
    rng = np.random.default_rng(11)
    keys = np.unique((rng.integers(0, 50, 2000).astype(np.uint64) << np.uint64(24)) | rng.integers(0, 1 << 24, 2000).astype(np.uint64))
    codes = rng.integers(0, 256, len(keys)).astype(np.uint8)
    trie = ngram_lm.Trie(keys, codes, str(tmp_path))
    ask = np.unique(np.concatenate([keys[::2], rng.integers(0, 60 << 24, 500).astype(np.uint64)]))
    held, got = trie.find(ask)
    where = dict(zip(keys.tolist(), codes.tolist(), strict=True))
    assert held.tolist() == [k in where for k in ask.tolist()]
    assert got[held].tolist() == [where[k] for k in ask[held].tolist()]


def test_gumbel_samples_follow_the_distribution():
    """Ranks 1 to 3 of many keys against sampling without replacement over all listed paths."""
    text, n = "the cat", 6000
    raw = gumbel_pieces.read_model(gumbel_pieces.MODEL)
    vocab = gumbel_pieces.Vocabulary(raw)
    data = np.frombuffer(text.encode(), np.uint8)
    s = gumbel_pieces.Sampler(data, np.array([0, len(data)]), np.zeros(1, np.uint64), gumbel_pieces.Store(vocab))
    lat, parts = s.lattice, []
    for a, e in zip(s.begin, s.stop, strict=True):
        found = []

        def walk(p, ids, lp, e=e, found=found):
            if p == e:
                found.append((ids, lp))
            else:
                for x in range(lat.first[p], lat.first[p + 1]):
                    walk(p + lat.size[x], (*ids, int(lat.id[x])), lp + lat.log_p[x])
        walk(a, (), 0.0)
        parts.append(found)
    paths = {sum((x[0] for x in c), ()): math.exp(sum(x[1] for x in c)) for c in itertools.product(*parts)}
    assert abs(sum(paths.values()) - 1) < 1e-9
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n)), "text": pa.array([text] * n)})
    out = pa.Table.from_batches(list(gumbel_pieces._encode(raw, 3, 5, True, True)(iter([batch])))).to_pandas()
    assert out.round_trip.all() and (out.groupby("doc_id").sha256.nunique() == 3).all()
    rank = {r: collections.Counter(map(tuple, out[out["rank"] == r].ids)) for r in (1, 2)}
    for ids, p in paths.items():
        second = sum(q * p / (1 - q) for other, q in paths.items() if other != ids)
        for r, want in ((1, p), (2, second)):
            assert abs(rank[r][ids] / n - want) < 5 * math.sqrt(want * (1 - want) / n) + 1e-3


def test_pieces_query(spark, docs):
    got = run(spark, "op10_sentencepiece")
    assert got.round_trip.all() and set(got.doc_id) == set(docs.doc_id) and (got.groupby("doc_id").sha256.nunique() == got.groupby("doc_id").size()).all()
