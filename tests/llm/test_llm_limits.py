"""No prefixes in the classifier's fit, no items too short for the decontamination."""

import re

import numpy as np

from logscope.llm import decontaminate as dec
from logscope.llm import quality_classifier as qc


def fold(t):
    return re.sub(r"[\t-\r ]", " ", t.lower())


def test_short_items_are_compared_exactly(spark):
    items = {1: "a short answer: 42", 2: "yes", 3: "Yes", 4: "twelve bytes", 5: "", 6: "x" * 23, 7: "é à"}
    texts = ["They gave A  short answer: 42!", "so a Short\tanswer: 42 it was", "yes", "YES", " yes", "yes, twelve bytes here", "twelve byte",
             "", None, "w" + "x" * 24, "É À", "a short answer: 43"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_segments"], r["edits"], r["start"], r["end"]) for r in dec.contaminated(d, b).collect()}
    want = {}
    for i, t in enumerate(texts):
        for n, item in items.items():
            small = len(item.encode()) < dec.Q
            if t and item and (fold(item) == fold(t) if small else fold(item) in fold(t)):
                want[i, n] = len(item.encode())
    assert set(got) == set(want) and (1, 1) in want and (10, 7) in want and (4, 2) not in want
    assert all(v[:2] == (1, 0) and v[3] - v[2] >= want[k] for k, v in got.items())
    left = {r["doc_id"] for r in dec.decontaminate(d, b).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in want}


def test_blocks_cover_the_whole_text():
    text = "".join(chr(97 + i) * qc.BLOCK for i in range(10))
    some = qc.spread_blocks(text, 4)
    assert some[:1] == b"a" and some[-1:] == b"j" and len(some) == 4 * qc.BLOCK
    assert qc.spread_blocks(text, 10) == text.encode() and qc.spread_blocks("é", 4) == "é".encode()


def test_fit_sees_the_end_of_long_texts(spark):
    """Texts that share their first 4,096 characters and differ after them."""
    rng = np.random.default_rng(5)
    vocab = {q: ["".join(rng.choice(list("abcdefghij" if q else "qrstuvwxyz"), 6)) for _ in range(40)] for q in (0, 1)}
    head = "the same beginning " * 216
    rows = [(i, head + " ".join(rng.choice(vocab[i % 2], 700)), i % 2) for i in range(120)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in qc.classify(d, marks).collect()}
    assert np.mean([out[i]["predicted"] == q for i, _, q in rows if out[i]["held_out"]]) >= 0.95


def test_score_against_recomputed_sizes(spark):
    """The score is the logistic function of the size difference, recomputed here block by block."""
    import zstandard
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    marks = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = qc.fit(d, marks)
    sized = []
    for raw in (model["good"], model["bad"]):
        z = zstandard.ZstdCompressionDict(raw)
        z.precompute_compress(level=qc.LEVEL)
        params = zstandard.ZstdCompressionParameters.from_level(qc.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        sized.append(lambda b, z=z, params=params: len(zstandard.ZstdCompressor(dict_data=z, compression_params=params).compress(b)))
    rows = d.select("*", qc.scorer(model)(d["text"]).alias("s")).collect()
    for r in rows[:200]:
        data = (r["text"] or "").encode()
        parts = [data[i:i + qc.BLOCK] for i in range(0, len(data), qc.BLOCK)]
        x = sum(sized[1](p) - sized[0](p) for p in parts) / max(1, len(data))
        assert abs(r["s"] - 1 / (1 + np.exp(-np.clip(model["bias"] + model["weight"] * x, -30, 30)))) < 1e-9
