"""Label rules as column expressions (INF2, INF3, INF4)."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logscope.functions.render import NONE, template_pieces

# The label set a model reply is matched against, in matching order.
LABELS = ["application", "authentication", "io", "memory", "network", "other"]

# Rule labeller keywords (message and component are lower-cased first).
MEMORY_MESSAGE = ["memory", "out of memory", "ecc error"]
DATABASE_MESSAGE = ["database"]
DATABASE_COMPONENT = ["namenode", "datanode"]
AUTH_MESSAGE = ["authentication", "permission denied", "login"]
NETWORK_MESSAGE = ["network", "connection", "timeout", "link"]
NETWORK_COMPONENT = ["network"]
IO_MESSAGE = ["file", "io", "block"]
IO_COMPONENT = ["io", "filesystem"]


def parse_label(response: Column, labels: Sequence[str] = LABELS, mode: str = "word",
                default: str = "other") -> Column:
    """Reply text -> label: lower-cased and trimmed, the first label of ``labels``
    that occurs (``compat``: as a substring; ``word``: as a whole word), else ``default``. No reply at
    all is ``default`` too."""
    text = F.lower(F.trim(response))
    out = F.lit(default)
    for lab in reversed(list(labels)):
        if mode == "compat":
            hit = text.contains(lab)
        else:
            hit = text.rlike(r"(?U)\b" + re.escape(lab) + r"\b")
        out = F.when(hit, F.lit(lab)).otherwise(out)
    return out


def _any(c: Column, words: Sequence[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | c.contains(w)
    return cond


def rule_label(message: Column, component: Column | None = None) -> Column:
    """Offline labeller: memory; database (or application for name/data node
    components); authentication; network; io; default application."""
    m = F.lower(F.coalesce(message, F.lit("")))
    c = F.lower(F.coalesce(component, F.lit(""))) if component is not None else F.lit("")
    return (F.when(_any(m, MEMORY_MESSAGE), "memory")
            .when(_any(m, DATABASE_MESSAGE) | _any(c, DATABASE_COMPONENT),
                  F.when(_any(m, DATABASE_MESSAGE), "database").otherwise("application"))
            .when(_any(m, AUTH_MESSAGE), "authentication")
            .when(_any(m, NETWORK_MESSAGE) | _any(c, NETWORK_COMPONENT), "network")
            .when(_any(m, IO_MESSAGE) | _any(c, IO_COMPONENT), "io")
            .otherwise("application"))


# Texts of the offline explainer: a first check to make and a way to narrow the fault down.
EXPLANATION_TEMPLATES = {
    "io": [
        "First check: device health counters and mount state behind {component}. Then replay one failing read on {node} alone.",
        "Storage path suspected. Compare this line's time with the array's event log; if nothing matches, look at the driver on {node}.",
    ],
    "application": [
        "No subsystem stands out, so start with the last release or setting changed in {component} and rerun it with debug output on {node}.",
        "Program fault suspected. Look for the first abnormal line of this process, not this one, and compare its input with a run that ended well.",
    ],
    "network": [
        "Draw the path between {node} and its partner, then test each hop; one-sided loss points to a port, two-sided loss to routing.",
        "Transport suspected under {component}. Count retransmissions over the last hour and see whether other hosts of the same switch count them too.",
    ],
    "memory": [
        "Plot resident size of {component} over a day. A ramp means a leak, a cliff means a neighbour, a flat line means a faulty module in {node}.",
        "Memory suspected. Run the module test on {node} at the next idle window and keep new jobs away until it has passed.",
    ],
    "database": [
        "List open transactions by age; the oldest one usually holds what {component} is waiting for.",
        "Data store suspected. Verify replica lag and free log space before anything on {node} is started again.",
    ],
    "authentication": [
        "Compare clocks on {node} and on the ticket server first, then the validity dates of the certificate {component} presents.",
        "Identity suspected. One account failing means its keys, many accounts failing means the directory they share.",
    ],
}


def rule_explain(label: Column, key: Column, node: Column | None, component: Column | None,
                 seed: int = 0) -> Column:
    """One of the label's texts, picked by ``pmod(key + seed, number of texts)`` of an integer
    key: deterministic under retries and re-partitioning (the original picks at
    random). Unknown labels use the application templates."""
    node_v = F.coalesce(node.cast("string"), F.lit(NONE)) if node is not None else F.lit("unknown node")
    comp_v = F.coalesce(component.cast("string"), F.lit(NONE)) if component is not None else F.lit("unknown component")
    known = F.coalesce(label, F.lit("application"))
    known = F.when(known.isin(list(EXPLANATION_TEMPLATES)), known).otherwise(F.lit("application"))
    out = F.lit(None).cast("string")
    for lab, temps in EXPLANATION_TEMPLATES.items():
        pick = F.pmod(key.cast("long") + F.lit(seed), F.lit(len(temps)))
        for i, t in enumerate(temps):
            vals = {"node": node_v, "component": comp_v}
            filled = F.concat(*[F.lit(v) if k == "text" else vals[v] for k, v in template_pieces(t)])
            out = F.when((known == lab) & (pick == i), filled).otherwise(out)
    return out
