"""Naive sequential models of the original row-mutating algorithms, used as test oracles."""

import math
import re
from collections import Counter

TOKEN = re.compile(r"(?u)\b\w\w+\b")


def cosine_counts(a: str, b: str) -> float:
    ca, cb = Counter(TOKEN.findall(a.lower())), Counter(TOKEN.findall(b.lower()))
    dot = sum(v * cb.get(t, 0) for t, v in ca.items())
    na = math.sqrt(sum(v * v for v in ca.values()))
    nb = math.sqrt(sum(v * v for v in cb.values()))
    return 0.0 if na == 0 or nb == 0 else round(dot / (na * nb), 12)


def lexical_topk(rows, a_idx, k):
    """rows: list of (id, text) sorted by id. Earlier non-null rows, similarity desc, earliest first."""
    aid, atext = rows[a_idx]
    cands = [(cosine_counts(atext, t), i) for i, (cid, t) in enumerate(rows) if cid < aid and t is not None]
    cands.sort(key=lambda x: (-x[0], rows[x[1]][0]))
    return [(rows[i][0], s) for s, i in cands[:k]]


def sequential_context_ids(rows, flags, k_near, k_far, lexical=True):
    """The original loop: per anomaly in order, reset own cell, append near, then far."""
    cells = [None] * len(rows)

    def append(i, aid):
        cells[i] = f"{cells[i]},{aid}" if cells[i] else f"{aid}"

    h = k_near // 2
    for idx, (aid, text) in enumerate(rows):
        if not flags[idx]:
            continue
        cells[idx] = str(aid)
        for j in range(max(0, idx - h), idx):
            append(j, aid)
        for j in range(idx + 1, min(len(rows) - 1, idx + h) + 1):
            append(j, aid)
        if lexical and text is not None:
            pos_of = {r[0]: p for p, r in enumerate(rows)}
            for cid, _ in lexical_topk(rows, idx, k_far):
                append(pos_of[cid], aid)
    return cells


def window_fallback(ids, scores, threshold, h=5):
    n = len(ids)
    cell = {i: None for i in ids}
    for a, s in zip(ids, scores):
        if s is None or s < threshold:
            continue
        cell[a] = str(a)
        for c in range(max(1, a - h), min(n, a + h) + 1):
            if c != a and c in cell:
                cell[c] = str(a)
    return cell


def iterative_trim(tokens_in_score_order, limit):
    """The original budget loop on per-line token counts (newline joins count one each)."""
    n = len(tokens_in_score_order)
    while True:
        total = sum(tokens_in_score_order[:n]) + max(n - 1, 0)
        if total <= limit:
            return n
        drop = int(n * (1 - limit / total))
        drop = 50 if drop == 0 else drop
        n = max(n - drop, 0)
