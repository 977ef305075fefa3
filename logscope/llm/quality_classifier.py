"""Quality classifier by compression.

Two zstandard dictionaries are built, from texts labelled good and texts
labelled bad. A text is compressed with each, in blocks of ``BLOCK`` bytes that
cover all of it (so long texts do not simply learn themselves), and the
normalised difference ``(bad size - good size) / bytes of the text`` is turned into a
probability by a logistic fit on labelled texts that built no dictionary. (Divided by a
compressed size instead, texts that repeat one word come out undecided.)

The fit uses a bounded sample: the ``sample`` labelled rows of each class with
the least hash of doc_id, of which every second row builds the dictionaries and
the others calibrate. A dictionary row gives ``fit_blocks`` blocks, evenly spaced from the
first to the last of its text; a calibration row is measured over its whole text, by the tasks.
Scoring covers every whole text of every row.

Defined results: null and empty texts score as the calibrated value of a zero
difference; conflicting labels of one doc_id are left out of the fit; rows
without label are scored like any other; repeated rows get equal scores; with
no labelled row of one class every score is the share of the other class.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.session import materialise

BLOCK = 1024
LEVEL = 3


def held_out(doc_id: str = "doc_id", mod: int = 4, rest: int = 2):
    """True where crc32(doc_id as text) leaves the given remainder."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


class Sizes:
    """Compressed sizes of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard
        self._pair = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
            self._pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def difference(self, text: str | None) -> float:
        data = (text or "").encode()
        good = bad = 0
        for at in range(0, len(data), BLOCK):
            part = data[at:at + BLOCK]
            good += len(self._pair[0].compress(part))
            bad += len(self._pair[1].compress(part))
        return (bad - good) / max(len(data), 1)


def spread_blocks(text: str, many: int) -> bytes:
    """At most ``many`` blocks of the text, evenly spaced, the first and the last among them, put together."""
    data = text.encode()
    n = -(-len(data) // BLOCK)
    if n <= many:
        return data
    at = np.unique(np.linspace(0, n - 1, many).round().astype(int)) * BLOCK
    return b"".join(data[i:i + BLOCK] for i in at)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    import zstandard
    parts = [d[i:i + BLOCK] for d in texts for i in range(0, len(d), BLOCK)]
    try:
        return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: the raw text itself is a valid dictionary
        return (b"".join(parts) or b"\n" * 16)[-size:].rjust(16, b"\n")


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton's method with a small ridge, so that separable classes still give finite weights."""
    m, s = x.mean(), x.std() or 1.0
    a = np.stack([np.ones_like(x), (x - m) / s], 1)
    w, ridge = np.zeros(2), np.diag([1e-6, 0.05])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(2), a.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - w[1] * m / s), float(w[1] / s)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, fit_blocks: int = 4, dict_bytes: int = 64 << 10) -> dict:
    """Dictionaries and calibration from labelled rows: {good, bad, bias, weight}. The driver receives at most
    ``fit_blocks`` blocks of each sampled row, and one number."""
    marks = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(
        F.min("quality").alias("_q"), F.max("quality").alias("_q2")).where("_q = _q2")
    marks = marks.select("doc_id", "_q", F.xxhash64("doc_id", F.lit(17)).alias("_o"))
    picked = [marks.where(F.col("_q") == q).orderBy("_o").limit(sample) for q in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * sample ids
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).join(few, "doc_id")
    rows = materialise(rows.groupBy("doc_id").agg(F.min("_q").alias("_q"), F.min("_o").alias("_o"), F.min("_t").alias("_t")).where("_t != ''"))

    @F.pandas_udf("binary")
    def blocks(texts: pd.Series) -> pd.Series:
        return pd.Series([spread_blocks(t, fit_blocks) for t in texts], dtype=object)

    found = rows.select("doc_id", "_q", "_o", blocks("_t").alias("_b")).orderBy("_o", "doc_id").collect()
    by = {q: [r for r in found if r["_q"] == q] for q in (0, 1)}
    if not by[0] or not by[1]:
        p = (1 + len(by[1])) / (2 + len(by[0]) + len(by[1]))
        return {"good": b"\n" * 16, "bad": b"\n" * 16, "bias": float(np.log(p / (1 - p))), "weight": 0.0}
    good, bad = (_dictionary([bytes(r["_b"]) for r in by[q][::2]], dict_bytes) for q in (1, 0))
    model = {"good": good, "bad": bad}
    measured = {r["doc_id"]: r["_x"] for r in rows.select("doc_id", difference(model)(F.col("_t")).alias("_x")).collect()}
    x, y = [], []
    for q in (0, 1):
        rest = by[q][1::2] or by[q]
        x += [measured[r["doc_id"]] for r in rest]
        y += [q] * len(rest)
    model["bias"], model["weight"] = _logistic(np.array(x), np.array(y, float))
    return model


def difference(model: dict) -> Callable:
    """A pandas UDF text -> difference of the compressed sizes per byte; the model is two dictionaries of fixed size."""
    @F.pandas_udf("double")
    def measure(texts: pd.Series) -> pd.Series:
        sizes = Sizes(model["good"], model["bad"])
        return pd.Series([sizes.difference(t) for t in texts], dtype=float)
    return measure


def scorer(model: dict) -> Callable:
    """text -> score."""
    measure = difference(model)

    def score(text):
        z = F.lit(model["bias"]) + F.lit(model["weight"]) * measure(text)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """All columns of docs plus held_out, score and predicted (1 from ``threshold`` on); columns of docs with
    these names are replaced."""
    model = fit(docs, labels, **options)
    out = docs.withColumn("held_out", held_out()).withColumn("score", scorer(model)(F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float, **options) -> DataFrame:
    """The rows of docs that score ``threshold`` or more, with their own columns only."""
    return docs.where(scorer(fit(docs, labels, **options))(F.col("text")) >= threshold)
