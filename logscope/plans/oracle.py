"""SQL building blocks for the DuckDB oracles: brute-force definitions of the
operators (no reductions), written against the derived views."""

from __future__ import annotations

from logscope.functions.labels import (AUTH_MESSAGE, DATABASE_COMPONENT, DATABASE_MESSAGE, EXPLANATION_TEMPLATES,
                                       IO_COMPONENT, IO_MESSAGE, MEMORY_MESSAGE, NETWORK_COMPONENT, NETWORK_MESSAGE)
from logscope.functions.render import sql_template

NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def py_str_sql(col: str, kind: str) -> str:
    """SQL twin of ``render.py_str``."""
    if kind == "string":
        e = col
    elif kind == "bool":
        e = f"CASE WHEN {col} THEN 'True' WHEN NOT {col} THEN 'False' END"
    elif kind == "timestamp":
        e = (f"strftime({col}, '%Y-%m-%d %H:%M:%S') || CASE WHEN strftime({col}, '%f') <> '000000' "
             f"THEN '.' || strftime({col}, '%f') ELSE '' END")
    else:
        e = f"CAST({col} AS VARCHAR)"
    return f"coalesce({e}, 'None')"


def render_sql(cols: list[tuple[str, str]], alias: str = "") -> str:
    """``col: value; ...`` for (name, kind) pairs."""
    p = f"{alias}." if alias else ""
    parts = [f"{q(n + ': ')} || {py_str_sql(p + n, k)}" for n, k in cols]
    return " || '; ' || ".join(parts)


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"strpos({col}, {q(w)}) > 0" for w in words) + ")"


def rule_label_sql(message: str, component: str | None) -> str:
    m = f"lower(coalesce({message}, ''))"
    c = f"lower(coalesce({component}, ''))" if component else "''"
    return (f"CASE WHEN {_any(m, MEMORY_MESSAGE)} THEN 'memory' "
            f"WHEN {_any(m, DATABASE_MESSAGE)} OR {_any(c, DATABASE_COMPONENT)} THEN "
            f"CASE WHEN {_any(m, DATABASE_MESSAGE)} THEN 'database' ELSE 'application' END "
            f"WHEN {_any(m, AUTH_MESSAGE)} THEN 'authentication' "
            f"WHEN {_any(m, NETWORK_MESSAGE)} OR {_any(c, NETWORK_COMPONENT)} THEN 'network' "
            f"WHEN {_any(m, IO_MESSAGE)} OR {_any(c, IO_COMPONENT)} THEN 'io' ELSE 'application' END")


def rule_explain_sql(label: str, key: str, node: str, component: str, seed: int = 0) -> str:
    known = f"(CASE WHEN coalesce({label}, 'application') IN ({', '.join(q(k) for k in EXPLANATION_TEMPLATES)}) " \
            f"THEN coalesce({label}, 'application') ELSE 'application' END)"
    vals = {"node": f"coalesce(CAST({node} AS VARCHAR), 'None')",
            "component": f"coalesce(CAST({component} AS VARCHAR), 'None')"}
    whens = []
    for lab, temps in EXPLANATION_TEMPLATES.items():
        n = len(temps)
        pick = f"((({key}) + {seed}) % {n} + {n}) % {n}"
        for i, t in enumerate(temps):
            whens.append(f"WHEN {known} = {q(lab)} AND {pick} = {i} THEN {sql_template(t, vals)}")
    return "CASE " + " ".join(whens) + " END"


def lexical_ctes(base: str = "base", k: int = 5, text: str = "message") -> str:
    """Brute-force far lexical top-k over ``base(line_id, pos, anomaly, <text>)`` -> CTE ``lex``."""
    return f"""
texts AS (SELECT DISTINCT {text} AS t FROM {base} WHERE {text} IS NOT NULL),
terms AS (SELECT t, term, count(*) AS tf FROM (SELECT t, unnest(regexp_extract_all(lower(t), '\\b\\w\\w+\\b')) AS term FROM texts) GROUP BY t, term),
norms AS (SELECT t, sqrt(sum(tf * tf)) AS norm FROM terms GROUP BY t),
dots AS (SELECT a.t AS a_t, c.t AS c_t, sum(a.tf * c.tf) AS dot FROM terms a JOIN terms c ON a.term = c.term
         WHERE a.t IN (SELECT {text} FROM {base} WHERE anomaly) GROUP BY a.t, c.t),
sims AS (SELECT a_t, c_t, round(dot / (na.norm * nc.norm), 12) AS sim FROM dots JOIN norms na ON na.t = a_t JOIN norms nc ON nc.t = c_t),
lexpairs AS (SELECT a.line_id AS anomaly_id, a.pos AS anomaly_pos, c.line_id AS context_id, c.pos AS context_pos,
                    coalesce(s.sim, 0.0) AS similarity
             FROM {base} a JOIN {base} c ON c.line_id < a.line_id
             LEFT JOIN sims s ON s.a_t = a.{text} AND s.c_t = c.{text}
             WHERE a.anomaly AND a.{text} IS NOT NULL AND c.{text} IS NOT NULL),
lex AS (SELECT *, CAST(row_number() OVER (PARTITION BY anomaly_id ORDER BY similarity DESC, context_id) AS INTEGER) AS rank
        FROM lexpairs QUALIFY rank <= {k})"""


def semantic_ctes(base: str = "vbase", k: int = 5, vec: str = "embedding") -> str:
    """Brute-force far semantic top-k over ``base(line_id, pos, anomaly, <vec>)`` -> CTE ``sem``."""
    return f"""
vn AS (SELECT line_id, pos, anomaly, CAST({vec} AS DOUBLE[]) AS v FROM {base} WHERE {vec} IS NOT NULL),
sempairs AS (SELECT a.line_id AS anomaly_id, a.pos AS anomaly_pos, c.line_id AS context_id, c.pos AS context_pos,
                    round(list_dot_product(a.v, c.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(c.v, c.v))), 12) AS similarity
             FROM vn a JOIN vn c ON c.line_id < a.line_id WHERE a.anomaly),
sem AS (SELECT *, CAST(row_number() OVER (PARTITION BY anomaly_id ORDER BY similarity DESC, context_id) AS INTEGER) AS rank
        FROM sempairs QUALIFY rank <= {k})"""


def near_cte(base: str = "base", k: int = 6) -> str:
    h = k // 2
    return f"""
near AS (SELECT a.line_id AS anomaly_id, a.pos AS anomaly_pos, c.line_id AS context_id, c.pos AS context_pos,
                CAST(c.pos - a.pos AS INTEGER) AS rank
         FROM {base} a JOIN {base} c ON c.pos BETWEEN a.pos - {h} AND a.pos + {h} AND c.pos <> a.pos WHERE a.anomaly)"""


def kept_cte(base: str = "base", parts: tuple = (("near", 1),), compat: bool = True) -> str:
    """Edges that survive in the per-row lists (self edges included) -> CTE ``kept``."""
    sel = [f"SELECT anomaly_id, anomaly_pos, context_id, context_pos, {no} AS kind_no, rank FROM {name}"
           for name, no in parts]
    sel.append(f"SELECT line_id, pos, line_id, pos, 0, 0 FROM {base} WHERE anomaly")
    cond = "WHERE NOT (coalesce(c.anomaly, false) AND e.anomaly_pos < e.context_pos)" if compat else ""
    return f"""
edges AS ({' UNION ALL '.join(sel)}),
kept AS (SELECT e.* FROM edges e JOIN {base} c ON c.line_id = e.context_id {cond})"""


def ids_cte() -> str:
    return """
ids AS (SELECT context_id, string_agg(CAST(anomaly_id AS VARCHAR), ',' ORDER BY anomaly_pos, kind_no, rank, anomaly_id) AS context_ids
        FROM kept GROUP BY context_id)"""


def gather_cte(rendered: str = "rendered") -> str:
    """Member-mode context string per anomaly from ``kept`` and ``rendered(line_id, pos, row)`` -> ``ctx``."""
    return f"""
ctx AS (SELECT g.anomaly_id, string_agg(r.row, {NL} ORDER BY r.pos, r.line_id) AS context_str
        FROM (SELECT DISTINCT anomaly_id, context_id FROM kept) g JOIN {rendered} r ON r.line_id = g.context_id
        GROUP BY g.anomaly_id)"""
