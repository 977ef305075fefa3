"""PII: base patterns plus a character-level bidirectional LSTM with CRF transitions, in NumPy.

Base spans (email, ip, card, phone) come from the patterns and are always kept. The model is trained from
labelled spans: windows around digits and ``@`` signs of a bounded sample of documents, labelled
with their base spans. It reads character classes (all digits alike, letters by case), so it
learns shapes and contexts, and tags a character as outside or as the begin or inside of a kind.

Scoring covers every whole text. A personal number or address holds a digit or an ``@``, so the
model looks at the *stretches* around those characters (``MARGIN`` to each side, joined where they touch) and at
nothing else; a text without them has no stretch. A stretch is read in overlapping windows; a
character's emission scores are averaged over its windows, weighted by the distance to the window's edge, and one
Viterbi pass over the whole stretch reconciles them, so a span may run across windows and is never cut by them.
Added spans must have their kind's outer form (``plausible``) and touch no base span.

Defined results: null and empty texts have no span; offsets are code points, ends exclusive; repeated rows get equal
spans; with no labelled window the model adds nothing; an empty table gives an empty result; other columns are ignored or kept.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
MARGIN = 24
WINDOW, STRIDE = 64, 32
UNITS, EMBED = 16, 8

# --- base patterns (fixed values of the contract) ----------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits begins: what stands before has no digit
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> list[int]:
    return [int(c) for c in _DIGIT.findall(s)]


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` with a domain behind it, and the run of local characters before it, as far as the last match
    leaves it: the leftmost non-overlapping matches, in linear time."""
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        s = m.start()
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            out.append((s, m.end()))
            end = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of all kinds, in the order of start and kind."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def plausible(kind: str, s: str) -> bool:
    """The outer form that an added span must have."""
    n = len(_DIGIT.findall(s))
    if kind == "email":
        return "@" in s[1:-1] and "." in s.split("@")[-1]
    if kind == "ip":
        parts = re.split(r"[^0-9]+", s)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= n <= 19 and luhn(_digits(s))
    return 7 <= n <= 15


# --- characters, stretches, windows -----------------------------------------------------------

SYMBOLS = 48


def _classes() -> np.ndarray:
    table = np.full(128, 1, np.int64)
    other = 8
    for c in range(128):
        ch = chr(c)
        if ch.isdigit():
            table[c] = 2
        elif ch.islower():
            table[c] = 3
        elif ch.isupper():
            table[c] = 4
        elif ch == " ":
            table[c] = 5
        elif ch in "\t\n\v\f\r":
            table[c] = 6
        elif ch.isprintable():
            table[c] = other
            other += 1
    return table


_CLASS = _classes()


def classes(text: str) -> np.ndarray:
    """Class of each character; beyond ASCII all are one class, 7."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _CLASS[np.minimum(code, 127)], 7)


def stretches(text: str) -> list[tuple[int, int]]:
    """Ranges of characters within MARGIN of a digit or an ``@``, joined where they touch."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(((code >= 48) & (code <= 57)) | (code == 64))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * MARGIN)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.append(cut, len(at) - 1)]
    return list(zip(np.maximum(first - MARGIN, 0).tolist(), np.minimum(last + MARGIN + 1, len(code)).tolist(), strict=True))


def tags(spans: list[tuple[str, int, int]], lo: int, hi: int) -> np.ndarray:
    """Tags of the characters lo..hi; where base spans of two kinds overlap the first has the characters."""
    out = np.zeros(hi - lo, np.int64)
    for kind, s, e in reversed(spans):
        if e > lo and s < hi:
            k = KINDS.index(kind)
            out[max(s, lo) - lo:min(e, hi) - lo] = 2 + 2 * k
            if s >= lo:
                out[s - lo] = 1 + 2 * k
    return out


# --- the model --------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def start_model(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    m = {"embed": rng.normal(0, 0.3, (SYMBOLS, EMBED))}
    for d in "fb":
        m[d + "x"] = rng.normal(0, 0.25, (EMBED, 4 * UNITS))
        m[d + "h"] = rng.normal(0, 0.25, (UNITS, 4 * UNITS))
        bias = np.zeros(4 * UNITS)
        bias[UNITS:2 * UNITS] = 1.0  # remember at first
        m[d + "b"] = bias
    m["out"] = rng.normal(0, 0.25, (2 * UNITS, TAGS))
    m["outb"] = np.zeros(TAGS)
    m["trans"] = np.zeros((TAGS, TAGS))
    return m


def allowed() -> np.ndarray:
    """Zero where a tag may follow another, a large negative number elsewhere: inside needs its begin before it."""
    a = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        a[:, 2 + 2 * k] = -1e4
        a[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return a


def _lstm(m: dict, d: str, x: np.ndarray, keep: bool):
    """One direction over (steps, windows, EMBED); the gates are kept for training."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, UNITS), x.dtype), np.zeros((n, UNITS), x.dtype)
    out = np.zeros((steps, n, UNITS), x.dtype)
    cache = []
    px = x @ m[d + "x"] + m[d + "b"]
    for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
        z = px[t] + h @ m[d + "h"]
        s = _sigmoid(z[:, :3 * UNITS])
        g = np.tanh(z[:, 3 * UNITS:])
        i, f, o = s[:, :UNITS], s[:, UNITS:2 * UNITS], s[:, 2 * UNITS:]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep:
            cache.append((t, h, c, i, f, o, g, tc))
        h, c = o * tc, c_new
        out[t] = h
    return out, cache


def _lstm_back(m: dict, d: str, x: np.ndarray, cache: list, dout: np.ndarray, grad: dict) -> np.ndarray:
    dx = np.zeros_like(x)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t, h, c, i, f, o, g, tc in reversed(cache):
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        grad[d + "x"] += x[t].T @ dz
        grad[d + "h"] += h.T @ dz
        grad[d + "b"] += dz.sum(0)
        dx[t] = dz @ m[d + "x"].T
        dh, dc = dz @ m[d + "h"].T, dc * f
    return dx


def emissions(m: dict, symbols: np.ndarray) -> np.ndarray:
    """Tag scores (steps, windows, TAGS) of windows of symbols (steps, windows)."""
    x = m["embed"][symbols]
    return np.concatenate([_lstm(m, "f", x, False)[0], _lstm(m, "b", x, False)[0]], 2) @ m["out"] + m["outb"]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _crf_gradient(score: np.ndarray, gold: np.ndarray, trans: np.ndarray):
    """Mean negative log likelihood of the gold tags, and its gradients, by forward-backward."""
    steps, n, k = score.shape
    fwd, bwd = np.zeros_like(score), np.zeros_like(score)
    fwd[0] = score[0]
    for t in range(1, steps):
        fwd[t] = score[t] + _log_sum(fwd[t - 1][:, :, None] + trans[None], 1)
    for t in range(steps - 2, -1, -1):
        bwd[t] = _log_sum(trans[None] + (score[t + 1] + bwd[t + 1])[:, None, :], 2)
    z = _log_sum(fwd[-1], 1)
    dscore = np.exp(fwd + bwd - z[None, :, None])
    dtrans = np.zeros_like(trans)
    for t in range(1, steps):
        p = fwd[t - 1][:, :, None] + trans[None] + (score[t] + bwd[t])[:, None, :] - z[:, None, None]
        dtrans += np.exp(p).sum(0)
        np.add.at(dtrans, (gold[t - 1], gold[t]), -1.0)
    rows = np.arange(n)
    right = sum(score[t, rows, gold[t]] + (trans[gold[t - 1], gold[t]] if t else 0) for t in range(steps))
    for t in range(steps):
        dscore[t, rows, gold[t]] -= 1
    return float((z - right).mean()), dscore / n, dtrans / n


def train(symbols: np.ndarray, gold: np.ndarray, rounds: int = 14, batch: int = 32, rate: float = 0.02, seed: int = 5) -> dict:
    """Adam on the CRF likelihood; symbols and gold are (windows, WINDOW)."""
    m, rule, rng = start_model(seed), allowed(), np.random.default_rng(seed)
    mean, var = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step = 0
    for r in range(rounds):
        order = rng.permutation(len(symbols))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            sym, y = symbols[pick].T, gold[pick].T
            x = m["embed"][sym]
            f, cf = _lstm(m, "f", x, True)
            b, cb = _lstm(m, "b", x, True)
            both = np.concatenate([f, b], 2)
            score = both @ m["out"] + m["outb"]
            _, ds, dt = _crf_gradient(score, y, m["trans"] + rule)
            grad = {k: np.zeros_like(v) for k, v in m.items()}
            grad["trans"] = np.where(rule < 0, 0.0, dt)
            grad["out"] = both.reshape(-1, 2 * UNITS).T @ ds.reshape(-1, TAGS)
            grad["outb"] = ds.sum((0, 1))
            dboth = ds @ m["out"].T
            dx = _lstm_back(m, "f", x, cf, dboth[:, :, :UNITS], grad) + _lstm_back(m, "b", x, cb, dboth[:, :, UNITS:], grad)
            np.add.at(grad["embed"], sym, dx)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            now = rate * (0.5 ** (r / max(1, rounds / 3)))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                mean[k] += 0.1 * (g - mean[k])
                var[k] += 0.001 * (g * g - var[k])
                m[k] -= now * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(var[k] / (1 - 0.999 ** step)) + 1e-8)
    m["trans"] = m["trans"] + rule
    return {k: v.astype(np.float32) for k, v in m.items()}


def viterbi(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> list[np.ndarray]:
    """Best tags of several stretches at once: score is (steps, stretches, TAGS), padded behind."""
    steps, n, _ = score.shape
    best, back = score[0] + np.where(trans.min(0) < -1e3, -1e4, 0), []
    last = np.zeros((n, score.shape[2]), score.dtype)
    last[lengths == 1] = best[lengths == 1]
    for t in range(1, steps):
        cand = best[:, :, None] + trans[None]
        back.append(cand.argmax(1))
        best = cand.max(1) + score[t]
        done = lengths == t + 1
        last[done] = best[done]
    out = []
    for i in range(n):
        tag = int(last[i].argmax())
        path = [tag]
        for t in range(int(lengths[i]) - 2, -1, -1):
            tag = int(back[t][i, tag])
            path.append(tag)
        out.append(np.array(path[::-1]))
    return out


def decode(m: dict, parts: list[np.ndarray], together: int = 512) -> list[list[tuple[str, int, int]]]:
    """Spans of stretches given as symbols, relative to each stretch."""
    weight = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1.0).astype(np.float32)[:, None]
    out: list[list] = [[] for _ in parts]
    # windows of all stretches, batch by batch; shorter stretches are padded with symbol 0
    owner, begin = [], []
    for i, p in enumerate(parts):
        last = max(0, len(p) - WINDOW)
        for at in sorted({*range(0, last, STRIDE), last}):
            owner.append(i)
            begin.append(at)
    sums = [np.zeros((len(p), TAGS), np.float32) for p in parts]
    mass = [np.zeros((len(p), 1), np.float32) for p in parts]
    for lo in range(0, len(owner), together):
        chunk = range(lo, min(len(owner), lo + together))
        sym = np.zeros((WINDOW, len(chunk)), np.int64)
        for j, w in enumerate(chunk):
            p = parts[owner[w]][begin[w]:begin[w] + WINDOW]
            sym[:len(p), j] = p
        e = emissions(m, sym)
        for j, w in enumerate(chunk):
            i, at = owner[w], begin[w]
            n = min(WINDOW, len(parts[i]) - at)
            sums[i][at:at + n] += e[:n, j] * weight[:n]
            mass[i][at:at + n] += weight[:n]
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 256 and (hi - lo + 1) * len(parts[order[hi]]) < 200_000:
            hi += 1
        group = order[lo:hi]
        lengths = np.array([len(parts[i]) for i in group])
        score = np.zeros((int(lengths.max()), len(group), TAGS), np.float32)
        for j, i in enumerate(group):
            score[:lengths[j], j] = sums[i] / mass[i]
        for i, path in zip(group, viterbi(score, lengths, m["trans"]), strict=True):
            s = 0
            while s < len(path):
                if path[s] % 2 == 1:
                    e = s + 1
                    while e < len(path) and path[e] == path[s] + 1:
                        e += 1
                    out[i].append((KINDS[(path[s] - 1) // 2], s, e))
                    s = e
                else:
                    s += 1
        lo = hi
    return out


def find(m: dict | None, texts: list[str | None]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base: list[list] = [[] for _ in texts]
    parts, where = [], []
    for i, t in enumerate(texts):
        if t and (seen := stretches(t)):
            base[i] = base_spans(t)
            if m is not None:
                sym = classes(t)
                for lo, hi in seen:
                    parts.append(sym[lo:hi])
                    where.append((i, lo))
    added: list[list] = [[] for _ in texts]
    if parts:
        for (i, lo), spans in zip(where, decode(m, parts), strict=True):
            for kind, s, e in spans:
                added[i].append((kind, lo + s, lo + e))
    out = []
    for t, b, more in zip(texts, base, added, strict=True):
        # ends by start: base spans of one kind do not overlap, so a look at the neighbours of all kinds would not
        # do; the greatest end so far does
        starts = [s for _, s, _ in b]
        reach = np.maximum.accumulate([e for *_, e in b]).tolist() if b else []
        ok = []
        for kind, s, e in more:
            at = bisect.bisect_left(starts, e)
            if (at == 0 or reach[at - 1] <= s) and plausible(kind, t[s:e]):
                ok.append((kind, s, e))
        out.append((b, sorted(b + ok, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# --- Spark ------------------------------------------------------------------------------------


def labelled_windows(docs: DataFrame, sample: int = 600, per_document: int = 4) -> pd.DataFrame:
    """At most ``sample`` windows (symbols, gold) around digits and @ signs, chosen by a hash of their document
    and place; at most per_document of one document. This bound concerns training only."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike("[0-9@]"))
    # a bounded number of documents is looked at, evenly by hash; a threshold on the hash keeps the candidates few
    # before any text is moved
    d = d.withColumn("_o", F.xxhash64("doc_id", F.lit(3)))
    n = d.count()
    if n > 4 * sample:
        d = d.where(F.col("_o") <= F.lit(int(-(1 << 63) + (4 * sample / n) * ((1 << 64) - 1))))
    d = d.orderBy("_o", "doc_id").limit(sample)

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for order, text in zip(frame["_o"], frame["text"], strict=True):
                sym, spans = classes(text), base_spans(text)
                for n, (lo, hi) in enumerate(stretches(text)[:per_document]):
                    at = max(0, min((lo + hi - WINDOW) // 2, len(sym) - WINDOW))
                    pad = np.zeros(WINDOW, np.int64)
                    gold = np.zeros(WINDOW, np.int64)
                    part = sym[at:at + WINDOW]
                    pad[:len(part)] = part
                    gold[:len(part)] = tags(spans, at, at + len(part))
                    inside = (gold > 0) & (gold % 2 == 0)
                    inside[1:] &= gold[:-1] == 0
                    gold[inside] -= 1  # a span cut by the window begins with it
                    rows.append((order, n, pad.astype(np.uint8).tobytes(), gold.astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["_o", "_n", "symbols", "gold"])
    out = d.select("text", "_o").mapInPandas(windows, "_o long, _n int, symbols binary, gold binary")
    return out.orderBy("_n", "_o", "symbols").limit(sample).toPandas()


def fit(docs: DataFrame, sample: int = 600, rounds: int = 14) -> dict | None:
    """The model from a bounded sample of labelled windows; None without any."""
    w = labelled_windows(docs, sample)
    if not len(w):
        return None
    read = lambda c: np.stack([np.frombuffer(x, np.uint8) for x in w[c]]).astype(np.int64)
    return train(read("symbols"), read("gold"), rounds)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _rows(m: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = find(m, batch.column("text").to_pylist())
            count = lambda k: pa.array([sum(x[0] == k for x in b) for b, _ in got], pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(count, KINDS), pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in got], pa.string()),
                 pa.array([listed(a) for _, a in got], pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    return run


def pii_spans(docs: DataFrame, model: dict | None = None, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all). The model is fitted on docs
    unless one is given."""
    model = model or fit(docs, **options)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows(model), FOUND)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, end = [], 0
    for kind, s, e in spans:
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, model: dict | None = None, **options) -> DataFrame:
    """docs with the spans of ``text`` masked, and n_chars counted anew where that column is there."""
    model = model or fit(docs, **options)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        got = find(model, [t if isinstance(t, str) else None for t in texts])
        return pd.Series([mask(t, a) if isinstance(t, str) else None for t, (_, a) in zip(texts, got, strict=True)], dtype=object)
    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
