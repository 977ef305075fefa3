"""Registered queries: one per operator, each reading the driver tables (through the
derived views) at any scale, with its DuckDB oracle where SQL can express it.

Column names are aliased identically on both sides; doubles are rounded to 6
digits and counts are BIGINT, so the driver's order-insensitive hash compares
values, not formatting.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.functions import labels as lab
from logscope.functions import text as txt
from logscope.functions.render import filename_hint, render_row, snippet, sql_template
from logscope.operators import analytics as ana
from logscope.operators import context as ctx
from logscope.operators import evaluate as ev
from logscope.operators import prepare as prp
from logscope.operators import prompts as prm
from logscope.operators.budget import token_count, trim_to_budget
from logscope.operators.detect import detector_metrics
from logscope.operators.inference import attach, chain, complete, file_responses
from logscope.operators.position import with_position
from logscope.operators.templates import templates_iplom
from logscope.plans import oracle as orc
from logscope.plans.echo import Echo, reply_sql
from logscope.plans.pipeline import LineConfig, explain_lines, prepare
from logscope.plans.views import table, view, with_views
from logscope.session import ensure_checkpoint_dir
from logscope.sources.readers import merge_multiline, parse_bgl, read_logs
from logscope.sources.vocabulary import KNOWN_LABELS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def lv(spark, sf):
    return view(spark, sf, "log_view")


def ts_str(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


TS_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"

# ---------------------------------------------------------------- sources and sinks


@register("read_logs", f"SELECT event_id, {TS_SQL} AS ts, user_id, event_type, round(value, 6) AS value, props FROM events")
def q_read_logs(spark, sf):
    df = read_logs(spark, f"{sf}/events.parquet")
    return df.select("event_id", ts_str(F.col("ts")).alias("ts"), "user_id", "event_type", F.round("value", 6).alias("value"), "props")


@register("present", with_views(
    "SELECT line_id AS LineId, node, level, component, message, round(anomaly_score, 3) AS anomaly_score, "
    f"{orc.rule_label_sql('message', 'component')} AS anomaly_label_final FROM log_view", "log_view"))
def q_present(spark, sf):
    from logscope.sources.sinks import present
    df = prepare(lv(spark, sf), id="line_id").withColumn(
        "anomaly_label_final", lab.rule_label(F.col("message"), F.col("component")))
    out = present(df)
    return out.select("LineId", "node", "level", "component", "message", "anomaly_score", "anomaly_label_final")


# ---------------------------------------------------------------- projections, filters, cleaning


@register("canonicalise", with_views(
    "SELECT line_id AS LineId, message, round(anomaly_score, 6) AS anomaly_score, label AS true_label "
    "FROM log_view", "log_view"))
def q_canonicalise(spark, sf):
    src = lv(spark, sf).select(F.col("line_id").alias("row_nr"), F.col("message").alias("m_message"),
                               F.col("anomaly_score").alias("pred_ano_proba"), "label")
    out = prp.canonicalise(src)
    return out.select("LineId", "message", F.round("anomaly_score", 6).alias("anomaly_score"), "true_label")


@register("dash_to_normal", with_views(
    "SELECT line_id, CASE WHEN label = '-' THEN 'normal' ELSE label END AS label FROM log_view", "log_view"))
def q_dash_to_normal(spark, sf):
    return prp.dash_to_normal(lv(spark, sf)).select("line_id", "label")


@register("ensure_score", with_views(
    "SELECT line_id, CASE WHEN anomaly THEN 1e0 ELSE 0e0 END AS anomaly_score FROM vector_view", "vector_view"))
def q_ensure_score(spark, sf):
    return prp.ensure_score(view(spark, sf, "vector_view")).select("line_id", "anomaly_score")


_TEXT_SCORE = ("CASE line_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN ' False' "
               "ELSE CAST(anomaly_score AS STRING) END")


@register("coerce_score", with_views(
    f"SELECT line_id, round(CASE lower(trim(s)) WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 "
    f"ELSE TRY_CAST(s AS DOUBLE) END, 6) AS anomaly_score FROM (SELECT line_id, {_TEXT_SCORE} AS s FROM log_view)",
    "log_view"))
def q_coerce_score(spark, sf):
    df = lv(spark, sf).select("line_id", F.expr(_TEXT_SCORE).alias("anomaly_score"))
    return prp.coerce_score(df).select("line_id", F.round("anomaly_score", 6).alias("anomaly_score"))


@register("fill_text", with_views(
    "SELECT line_id, coalesce(anomaly_result, '') AS anomaly_result, label FROM eval_view", "eval_view"))
def q_fill_text(spark, sf):
    return prp.fill_text(view(spark, sf, "eval_view")).select("line_id", "anomaly_result", "label")


@register("apply_known_anomalies", with_views(
    "SELECT l.line_id, round(CASE WHEN k.line_id IS NOT NULL THEN 1.0 ELSE l.anomaly_score END, 6) AS anomaly_score "
    "FROM log_view l LEFT JOIN (SELECT DISTINCT event_id + 1 AS line_id FROM events "
    "WHERE event_type = 'error' AND value > 40) k ON k.line_id = l.line_id", "log_view"))
def q_apply_known(spark, sf):
    known = (table(spark, sf, "events").where((F.col("event_type") == "error") & (F.col("value") > 40))
             .select((F.col("event_id") + 1).alias("line_id")))
    out = prp.apply_known_anomalies(lv(spark, sf), known, "line_id")
    return out.select("line_id", F.round("anomaly_score", 6).alias("anomaly_score"))


@register("flag_anomalies", with_views(
    "SELECT line_id, anomaly_score >= 0.8 AS anomaly FROM log_view", "log_view"))
def q_flag(spark, sf):
    return prp.flag_anomalies(lv(spark, sf), 0.8).select("line_id", "anomaly")


@register("select_anomalies", with_views(
    "SELECT line_id, message, round(anomaly_score, 6) AS anomaly_score FROM log_view WHERE anomaly_score >= 0.79",
    "log_view"))
def q_select(spark, sf):
    return prp.select_anomalies(lv(spark, sf), 0.79).select("line_id", "message",
                                                            F.round("anomaly_score", 6).alias("anomaly_score"))


# structured-log columns derived from the log view (one expression per column)
_STRUCTURED_COLS = ["line_id AS LineId", "CASE level WHEN 'WARNING' THEN 'WARN' ELSE level END AS Level",
                    "node AS Process", "component AS Component", "message AS Content",
                    "regexp_replace(message, '[0-9]+', '<*>'{flags}) AS EventTemplate"]
_STRUCTURED = ", ".join(_STRUCTURED_COLS).format(flags=", 'g'")
_STRUCTURED_SPARK = [c.format(flags="") for c in _STRUCTURED_COLS]


@register("select_by_rule", with_views(
    f"SELECT LineId, Level, Content FROM (SELECT {_STRUCTURED} FROM log_view) "
    "WHERE strpos(lower(Content), 'exception') > 0 OR Level = 'WARN' ORDER BY LineId LIMIT 20", "log_view"))
def q_select_by_rule(spark, sf):
    df = lv(spark, sf).selectExpr(*_STRUCTURED_SPARK)
    return prp.select_by_rule(df, "exception", "WARN", 20).select("LineId", "Level", "Content")


_MIXED_DATE = "CASE WHEN line_id % 2 = 0 THEN CAST(date AS STRING) ELSE replace(CAST(date AS STRING), '-', '.') END"


@register("date_range", with_views(
    "SELECT line_id, CAST(date AS STRING) AS date FROM log_view "
    "WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'", "log_view"))
def q_date_range(spark, sf):
    df = lv(spark, sf).select("line_id", F.expr(_MIXED_DATE).alias("date"))
    return prp.date_range(df, "2024-01-05", "2024-01-12").select("line_id", F.col("date").cast("string"))


@register("limit_date", with_views(
    "SELECT line_id, CAST(date AS STRING) AS date FROM log_view WHERE date = (SELECT max(date) FROM log_view)",
    "log_view"))
def q_limit_date(spark, sf):
    return prp.limit_date(lv(spark, sf), id_col="line_id").select("line_id", F.col("date").cast("string"))


@register("dedup_context", with_views(
    "SELECT line_id, message FROM log_view WHERE line_id = 2 OR line_id IN "
    "(SELECT min(line_id) FROM log_view GROUP BY message)", "log_view"))
def q_dedup(spark, sf):
    df = lv(spark, sf)
    return prp.dedup_context(df, "message", [2], order_col="line_id", id_col="line_id").select("line_id", "message")


_FIELDS_SQL = ", ".join(f"regexp_extract(value, {orc.q(p)}, 1) AS {n}" for n, p in txt.FIELD_PATTERNS.items())


@register("extract_fields", with_views(
    f"SELECT source_file, line_no, {_FIELDS_SQL} FROM raw_view", "raw_view"))
def q_extract_fields(spark, sf):
    df = view(spark, sf, "raw_view")
    return df.select("source_file", "line_no", *[c.alias(n) for n, c in txt.extract_fields(F.col("value")).items()])


_LEVEL_TEXT = "level || ': ' || message"


@register("infer_level", with_views(
    f"SELECT line_id, CASE WHEN strpos(t, 'INFO:') > 0 THEN 'INFO' WHEN strpos(t, 'WARN') > 0 THEN 'WARNING' "
    f"WHEN strpos(t, 'ERROR') > 0 THEN 'ERROR' WHEN strpos(t, 'FATAL') > 0 THEN 'FATAL' ELSE 'INFO' END AS level "
    f"FROM (SELECT line_id, {_LEVEL_TEXT} AS t FROM log_view)", "log_view"))
def q_infer_level(spark, sf):
    df = lv(spark, sf)
    return df.select("line_id", prp.infer_level(F.expr(_LEVEL_TEXT)).alias("level"))


@register("prepare_eval", with_views(
    "SELECT line_id AS LineId, message AS text, 1e0 AS anomaly_score, CAST(line_id AS STRING) AS context_ids_ref, "
    "lower(label) AS label FROM log_view", "log_view"))
def q_prepare_eval(spark, sf):
    src = lv(spark, sf).select(F.col("line_id").alias("LineId"), F.col("message").alias("m_message"),
                               F.col("label").alias("labels"))
    out = ev.prepare_eval(src)
    return out.select("LineId", "text", "anomaly_score", "context_ids_ref", "label")


@register("finalise", with_views(
    "SELECT line_id, label, anomaly_result AS anomaly_label_final FROM eval_view", "eval_view"))
def q_finalise(spark, sf):
    df = view(spark, sf, "eval_view").withColumn("anomaly_label", F.concat(F.lit("p"), F.col("line_id")))
    out = prp.finalise(df, clean=True)
    assert "anomaly_label" not in out.columns and "anomaly_result" not in out.columns
    return out.select("line_id", "label", "anomaly_label_final")


@register("union_files", with_views(
    "SELECT line_id, message, NULL AS node FROM log_view WHERE level = 'ERROR' UNION ALL "
    "SELECT line_id, message, node FROM log_view WHERE level <> 'ERROR'", "log_view"))
def q_union(spark, sf):
    df = lv(spark, sf)
    a = df.where(F.col("level") == "ERROR").select("line_id", "message")
    b = df.where(F.col("level") != "ERROR").select("line_id", "message", "node")
    return prp.union_files([a, b]).select("line_id", "message", "node")


@register("working_set", with_views(
    "SELECT line_id, CAST(date AS STRING) AS date, message FROM log_view ORDER BY line_id", "log_view"))
def q_working_set(spark, sf):
    return prp.working_set(lv(spark, sf), ["line_id", "date", "message"], "line_id").withColumn(
        "date", F.col("date").cast("string"))


# ---------------------------------------------------------------- positions and context


@register("with_position", with_views(
    "SELECT line_id, CAST(row_number() OVER (ORDER BY message, line_id) - 1 AS BIGINT) AS pos FROM log_view",
    "log_view"))
def q_with_position(spark, sf):
    return with_position(lv(spark, sf), ["message", "line_id"]).select("line_id", "pos")


@register("with_position_by", with_views(
    "SELECT line_id, node, CAST(row_number() OVER (PARTITION BY node ORDER BY ts, line_id) - 1 AS BIGINT) AS pos "
    "FROM log_view", "log_view"))
def q_with_position_by(spark, sf):
    return with_position(lv(spark, sf), ["ts", "line_id"], by="node").select("line_id", "node", "pos")


def ctx_base(spark, sf, threshold: float = 0.8):
    df = lv(spark, sf).select("line_id", "node", "component", "message", "anomaly_score")
    df = prp.flag_anomalies(df, threshold)
    return with_position(df, "line_id")


BASE_SQL = ("base AS (SELECT line_id, node, component, message, anomaly_score, anomaly_score >= 0.8 AS anomaly, "
            "row_number() OVER (ORDER BY line_id) - 1 AS pos FROM log_view)")


def _with_base(body: str, extra: str = "") -> str:
    from logscope.plans.views import duck_view
    ctes = [f"log_view AS ({duck_view('log_view')})", BASE_SQL]
    if extra:
        ctes.append(extra.strip().rstrip(","))
    return "WITH " + ",\n".join(ctes) + "\n" + body


EDGE_OUT = ("anomaly_id", "context_id", "kind", "rank", "similarity")


def edge_out(e: DataFrame) -> DataFrame:
    return e.select("anomaly_id", "context_id", "kind", "rank", F.round("similarity", 6).alias("similarity"))


@register("near_context", _with_base(
    "SELECT anomaly_id, context_id, 'near' AS kind, rank, CAST(NULL AS DOUBLE) AS similarity FROM near",
    orc.near_cte()))
def q_near(spark, sf):
    df = ctx_base(spark, sf)
    return edge_out(ctx.near_context(df, 6, "line_id"))


@register("far_lexical", _with_base(
    "SELECT anomaly_id, context_id, 'lexical' AS kind, rank, round(similarity, 6) AS similarity FROM lex",
    orc.lexical_ctes()))
def q_far_lexical(spark, sf):
    df = ctx_base(spark, sf)
    return edge_out(ctx.far_lexical(df, 5, True, "message", "line_id"))


VBASE_SQL = ("vbase AS (SELECT line_id, embedding, anomaly, row_number() OVER (ORDER BY line_id) - 1 AS pos "
             "FROM vector_view)")


@register("far_semantic", with_views(
    f"SELECT anomaly_id, context_id, 'semantic' AS kind, rank, round(similarity, 6) AS similarity FROM sem",
    "vector_view", extra=f"{VBASE_SQL},{orc.semantic_ctes()}"))
def q_far_semantic(spark, sf):
    df = with_position(view(spark, sf, "vector_view"), "line_id")
    return edge_out(ctx.far_semantic(df, 5, "embedding", True, "line_id"))


@register("far_semantic_index", with_views(
    "SELECT anomaly_id, context_id, 'semantic' AS kind, rank, round(similarity, 6) AS similarity FROM sem",
    "vector_view", extra=f"{VBASE_SQL},{orc.semantic_ctes()}"))
def q_far_semantic_index(spark, sf):
    """Inverted lists: the oracle's rows where a table has at most list_rows * probes vectors, approximate beyond."""
    from logscope.operators.vector_index import far_semantic_index
    df = with_position(view(spark, sf, "vector_view"), "line_id")
    return edge_out(far_semantic_index(df, 5, "embedding", True, "line_id"))


HBASE_SQL = ("hbase AS (SELECT line_id, message, embedding, anomaly, row_number() OVER (ORDER BY line_id) - 1 AS pos "
             "FROM hybrid_view)")


@register("far_hybrid", with_views(
    "SELECT anomaly_id, context_id, 'semantic' AS kind, rank, round(similarity, 6) AS similarity FROM sem "
    "UNION ALL SELECT anomaly_id, context_id, 'lexical', rank, round(similarity, 6) FROM lex",
    "hybrid_view", extra=f"{HBASE_SQL},{orc.semantic_ctes('hbase')},{orc.lexical_ctes('hbase')}"))
def q_far_hybrid(spark, sf):
    df = with_position(view(spark, sf, "hybrid_view"), "line_id")
    return edge_out(ctx.far_hybrid(df, 5, "message", "embedding", "line_id"))


@register("window_context", with_views(
    "SELECT l.line_id, CAST(w.a AS STRING) AS context_ids_ref FROM log_view l LEFT JOIN ("
    "SELECT r.line_id AS ctx, max(a.line_id) AS a FROM log_view r JOIN log_view a "
    "ON a.anomaly_score >= 0.79 AND r.line_id BETWEEN a.line_id - 5 AND a.line_id + 5 "
    "AND (r.line_id = a.line_id OR r.line_id BETWEEN 1 AND (SELECT count(*) FROM log_view)) GROUP BY r.line_id"
    ") w ON w.ctx = l.line_id", "log_view"))
def q_window_context(spark, sf):
    out = ctx.window_context(lv(spark, sf), 5, 0.79, "line_id")
    return out.select("line_id", "context_ids_ref")


@register("context_ids", _with_base(
    "SELECT b.line_id, ids.context_ids FROM base b LEFT JOIN ids ON ids.context_id = b.line_id",
    orc.near_cte() + "," + orc.lexical_ctes() + "," + orc.kept_cte(parts=(("near", 1), ("lex", 3))) + ","
    + orc.ids_cte()))
def q_context_ids(spark, sf):
    df = ctx_base(spark, sf)
    edges = ctx.near_context(df, 6, "line_id").unionByName(ctx.far_lexical(df, 5, True, "message", "line_id"))
    return ctx.context_ids(edges, df, "line_id").select("line_id", "context_ids")


_CARD_SQL = "'[' || CAST(line_id AS STRING) || '] ' || coalesce(message, 'None')"


@register("gather_context", _with_base(
    "SELECT anomaly_id, context_str AS context_rows FROM ctx",
    orc.near_cte() + "," + orc.kept_cte() + f", rendered AS (SELECT line_id, pos, {_CARD_SQL} AS row FROM base),"
    + orc.gather_cte()))
def q_gather(spark, sf):
    df = ctx_base(spark, sf)
    df = df.withColumn("_card", F.expr(_CARD_SQL))
    g = ctx.gather_context(ctx.near_context(df, 6, "line_id"), df, "_card", "line_id")
    return g.select("anomaly_id", F.array_join("context_rows", "\n").alias("context_rows"))


# ---------------------------------------------------------------- prompts

_BASE_RENDER = [("line_id", "int"), ("node", "string"), ("component", "string"), ("message", "string"),
                ("anomaly_score", "double"), ("anomaly", "bool")]


@register("render_row", with_views(
    "SELECT line_id, " + orc.render_sql([("line_id", "int"), ("ts", "timestamp"), ("date", "date"),
                                         ("node", "string"), ("level", "string"), ("component", "string"),
                                         ("message", "string"), ("anomaly_score", "double"), ("label", "string"),
                                         ("flag", "bool")]) + " AS row FROM (SELECT *, "
    "CASE WHEN line_id % 5 = 0 THEN NULL ELSE anomaly_score >= 0.5 END AS flag FROM log_view)", "log_view"))
def q_render_row(spark, sf):
    df = lv(spark, sf).withColumn("flag", F.expr("CASE WHEN line_id % 5 = 0 THEN NULL ELSE anomaly_score >= 0.5 END"))
    return df.select("line_id", render_row(df).alias("row"))


def _label_prompt_sql(threshold: float = 0.79) -> str:
    vals = {"log_str": "r.row", "context_str": f"coalesce(c.context_str, {orc.q(prm.NO_CONTEXT)})"}
    body = (f"SELECT b.line_id, CASE WHEN b.anomaly_score >= {threshold} THEN "
            f"{sql_template(prm.LABEL_TEMPLATE, vals)} END AS anomaly_label "
            "FROM base b JOIN rendered r ON r.line_id = b.line_id LEFT JOIN ctx c ON c.anomaly_id = b.line_id")
    extra = (orc.near_cte() + "," + orc.lexical_ctes() + "," + orc.kept_cte(parts=(("near", 1), ("lex", 3))) +
             f", rendered AS (SELECT line_id, pos, {orc.render_sql(_BASE_RENDER)} AS row FROM base)," +
             orc.gather_cte())
    return _with_base(body, extra)


@register("label_prompts", _label_prompt_sql())
def q_label_prompts(spark, sf):
    df = ctx_base(spark, sf)
    edges = ctx.near_context(df, 6, "line_id").unionByName(ctx.far_lexical(df, 5, True, "message", "line_id"))
    out = prm.label_prompts(df, edges, 0.79, id_col="line_id")
    return out.select("line_id", "anomaly_label")


def _explanation_prompt_sql(threshold: float = 0.79) -> str:
    label = orc.rule_label_sql("b.message", "b.component")
    vals = {"anomalous_log_str": "r.row", "label_str": f"'Anomaly Label: ' || {label}",
            "context_str": f"coalesce(c.context_str, {orc.q(prm.NO_CONTEXT)})"}
    body = (f"SELECT b.line_id, CASE WHEN b.anomaly_score >= {threshold} THEN "
            f"{sql_template(prm.EXPLANATION_TEMPLATE, vals)} END AS explanation_prompt "
            "FROM base b JOIN rendered r ON r.line_id = b.line_id LEFT JOIN ctx c ON c.anomaly_id = b.line_id")
    extra = (orc.near_cte() + "," + orc.kept_cte() +
             f", rendered AS (SELECT line_id, pos, {orc.render_sql(_BASE_RENDER)} AS row FROM base)," +
             orc.gather_cte())
    return _with_base(body, extra)


@register("explanation_prompts", _explanation_prompt_sql())
def q_explanation_prompts(spark, sf):
    df = ctx_base(spark, sf)
    edges = ctx.near_context(df, 6, "line_id")
    labelled = df.withColumn("anomaly_result", lab.rule_label(F.col("message"), F.col("component")))
    out = prm.explanation_prompts(labelled, edges, 0.79, id_col="line_id", label_sources=("anomaly_result",))
    return out.select("line_id", "explanation_prompt")


_SNIP_TEXT = "CASE WHEN line_no % 3 = 0 THEN value || ' ' || value || ' ' || value ELSE value END"


@register("snippet", with_views(
    "SELECT source_file, line_no, '(Score: ' || printf('%.4f', anomaly_score) || ') Msg: ' || "
    "CASE WHEN length(trim(t)) > 150 THEN substring(trim(t), 1, 150) || '...' ELSE trim(t) END AS snippet "
    f"FROM (SELECT *, {_SNIP_TEXT} AS t FROM raw_view)", "raw_view"))
def q_snippet(spark, sf):
    df = view(spark, sf, "raw_view").withColumn("t", F.expr(_SNIP_TEXT))
    return df.select("source_file", "line_no", snippet(F.col("t"), F.col("anomaly_score")).alias("snippet"))


def _hint_sql(col: str) -> str:
    parts = f"string_split({col}, '_')"
    n = f"len({parts})"
    last = f"{parts}[-1]"
    long_form = f"trim(array_to_string({parts}[2:{n} - 2], ' '))"
    stem = f"string_split({col}, '.')[1]"
    return (f"CASE WHEN {n} > 3 AND (suffix({last}, '.log') OR suffix({last}, '.parquet')) THEN "
            f"CASE WHEN {long_form} = '' THEN 'No anomaly in filename' ELSE {long_form} END "
            f"ELSE trim(replace(replace({stem}, '_', ' '), 'TOKEN', '')) END")


@register("filename_hint", with_views(
    f"SELECT DISTINCT source_file, {_hint_sql('source_file')} AS error_type FROM raw_view", "raw_view"))
def q_filename_hint(spark, sf):
    df = view(spark, sf, "raw_view").select("source_file").distinct()
    return df.select("source_file", filename_hint(F.col("source_file")).alias("error_type"))


_BUDGET = 2000


def _file_lines(spark, sf):
    raw = view(spark, sf, "raw_view")
    merged = merge_multiline(raw, txt.TIME_PATTERN, "source_file", "line_no", "value", "m_message")
    scores = raw.select("source_file", "line_no", F.col("anomaly_score").alias("pred_ano_proba"))
    return merged.join(scores, ["source_file", "line_no"])


_MERGE_SQL = f"""
stamped AS (SELECT *, CASE WHEN regexp_matches(value, {orc.q(txt.TIME_PATTERN)}) THEN line_no END AS st FROM raw_view),
grouped AS (SELECT *, coalesce(max(st) OVER (PARTITION BY source_file ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS gid FROM stamped),
merged AS (SELECT source_file, min(line_no) AS line_no, string_agg(value, chr(10) ORDER BY line_no) AS m_message FROM grouped GROUP BY source_file, gid),
lines AS (SELECT m.*, r.anomaly_score AS pred_ano_proba FROM merged m JOIN raw_view r USING (source_file, line_no))"""


@register("merge_multiline", with_views(
    "SELECT source_file, line_no, m_message FROM merged", "raw_view", extra=_MERGE_SQL))
def q_merge(spark, sf):
    raw = view(spark, sf, "raw_view")
    return merge_multiline(raw).select("source_file", "line_no", "m_message")


_TOKENS_SQL = "len(regexp_extract_all(coalesce(m_message, ''), '\\w+|[^\\w\\s]'))"


@register("token_count", with_views(
    f"SELECT source_file, CAST(sum({_TOKENS_SQL}) + count(*) - 1 AS BIGINT) AS tokens FROM lines GROUP BY source_file",
    "raw_view", extra=_MERGE_SQL))
def q_token_count(spark, sf):
    return token_count(_file_lines(spark, sf), "m_message", by="source_file")


_TRIM_SQL = f"""
ranked AS (SELECT *, sum({_TOKENS_SQL} + 1) OVER (PARTITION BY source_file ORDER BY pred_ano_proba DESC, line_no
           ROWS UNBOUNDED PRECEDING) - 1 AS tok FROM lines),
kept_lines AS (SELECT * FROM ranked WHERE tok <= {_BUDGET})"""


@register("trim_to_budget", with_views(
    "SELECT source_file, line_no, round(pred_ano_proba, 6) AS pred_ano_proba FROM kept_lines", "raw_view", extra=_MERGE_SQL + "," + _TRIM_SQL))
def q_trim(spark, sf):
    kept = trim_to_budget(_file_lines(spark, sf), _BUDGET, "source_file")
    return kept.select("source_file", "line_no", F.round("pred_ano_proba", 6).alias("pred_ano_proba"))


def _file_prompt_sql() -> str:
    snip = ("'(Score: ' || printf('%.4f', pred_ano_proba) || ') Msg: ' || CASE WHEN length(trim(m_message)) > 150 "
            "THEN substring(trim(m_message), 1, 150) || '...' ELSE trim(m_message) END")
    vals = {"filename": "source_file", "error_type": _hint_sql("source_file"), "formatted_log_lines": "lines_txt"}
    body = (f"SELECT source_file, {sql_template(prm.FILE_TEMPLATE, vals)} AS file_prompt FROM "
            f"(SELECT source_file, string_agg({snip}, chr(10) ORDER BY line_no) AS lines_txt FROM kept_lines "
            "GROUP BY source_file)")
    return with_views(body, "raw_view", extra=_MERGE_SQL + "," + _TRIM_SQL)


@register("file_prompts", _file_prompt_sql())
def q_file_prompts(spark, sf):
    kept = trim_to_budget(_file_lines(spark, sf), _BUDGET, "source_file")
    return prm.file_prompts(kept, "source_file", "m_message", "pred_ano_proba", "line_no")


def _vocab_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT {orc.q(v)} AS label" for v in KNOWN_LABELS)
    norm = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
    h = norm.format(c="error_type")
    v = norm.format(c="label")
    return with_views(f"""
SELECT error_type, matched_label, match_jaccard, match_distance FROM (
  SELECT error_type, label AS matched_label, round(jac, 6) AS match_jaccard, CAST(lev AS INTEGER) AS match_distance,
         row_number() OVER (PARTITION BY error_type ORDER BY ex DESC, jac DESC, lev, label) AS r
  FROM (SELECT h.error_type, v.label, CAST({h} = {v} AS INTEGER) AS ex,
               len(list_intersect(string_split({h}, ' '), string_split({v}, ' '))) * 1.0
               / len(list_distinct(list_concat(string_split({h}, ' '), string_split({v}, ' ')))) AS jac,
               levenshtein({h}, {v}) AS lev
        FROM (SELECT DISTINCT {_hint_sql('source_file')} AS error_type FROM raw_view) h, ({rows}) v) x) y
WHERE r = 1""", "raw_view")


@register("match_known_label", _vocab_sql())
def q_match_known(spark, sf):
    hints = view(spark, sf, "raw_view").select(filename_hint(F.col("source_file")).alias("error_type")).distinct()
    vocab = spark.createDataFrame([(v,) for v in KNOWN_LABELS], "label string")
    out = prm.match_known_label(hints, vocab, "error_type")
    return out.select("error_type", "matched_label", "match_jaccard", "match_distance")


def _compact_sql() -> str:
    vals = {"context_str": "coalesce(c.ctx, '')", "anomalous_str": _CARD_SQL.replace("line_id", "b.line_id")
            .replace("message", "b.message")}
    body = (f"SELECT b.line_id AS anomaly_id, {sql_template(prm.COMPACT_TEMPLATE, vals)} AS prompt FROM base b "
            "LEFT JOIN (SELECT n.anomaly_id, string_agg('[' || CAST(r.line_id AS STRING) || '] ' || "
            "coalesce(r.message, 'None'), chr(10) ORDER BY r.pos) AS ctx FROM (SELECT DISTINCT anomaly_id, context_id "
            "FROM near) n JOIN base r ON r.line_id = n.context_id GROUP BY n.anomaly_id) c ON c.anomaly_id = b.line_id "
            "WHERE b.anomaly")
    return _with_base(body, orc.near_cte(k=4))


@register("compact_prompts", _compact_sql())
def q_compact(spark, sf):
    df = ctx_base(spark, sf)
    return prm.compact_prompts(df, ctx.near_context(df, 4, "line_id"), "line_id", "message")


@register("line_cards", with_views(
    "SELECT LineId, 'Log Level: ' || coalesce(Level, 'None') || '. Process: ' || coalesce(Process, 'None') || "
    "'. Component: ' || coalesce(Component, 'None') || '. Content: ' || coalesce(Content, 'None') || "
    f"'. EventTemplate: ' || coalesce(EventTemplate, 'None') AS card FROM (SELECT {_STRUCTURED} FROM log_view)",
    "log_view"))
def q_line_cards(spark, sf):
    df = lv(spark, sf).selectExpr(*_STRUCTURED_SPARK)
    return df.select("LineId", prm.line_cards(df).alias("card"))


RUN_CLASSES = ["finished", "slow", "stuck", "lost a worker"]


def _run_sql() -> str:
    classes = "[" + ", ".join(f"'{c}'" for c in RUN_CLASSES) + "]"
    vals = {"classes": orc.q(classes), "content": "content"}
    return (f"SELECT conv_id, {sql_template(prm.RUN_TEMPLATE, vals)} AS prompt FROM "
            "(SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content FROM conversations "
            "GROUP BY conv_id)")


@register("run_prompts", _run_sql())
def q_run_prompts(spark, sf):
    conv = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("Content"))
    return prm.run_prompts(conv, RUN_CLASSES, ["conv_id"], "Content", order_col="turn")


# ---------------------------------------------------------------- inference and rules


def _parse_sql(mode: str) -> str:
    text = "lower(trim(response))"
    whens = []
    for l in lab.LABELS:
        cond = f"strpos({text}, {orc.q(l)}) > 0" if mode == "compat" else f"regexp_matches({text}, '\\b{l}\\b')"
        whens.append(f"WHEN {cond} THEN {orc.q(l)}")
    return with_views(f"SELECT line_id, CASE {' '.join(whens)} ELSE 'other' END AS label FROM response_view",
                      "response_view")


@register("parse_label", _parse_sql("compat"))
def q_parse_label(spark, sf):
    df = view(spark, sf, "response_view")
    return df.select("line_id", lab.parse_label(F.col("response"), mode="compat").alias("label"))


@register("parse_label_word", _parse_sql("word"))
def q_parse_label_word(spark, sf):
    df = view(spark, sf, "response_view")
    return df.select("line_id", lab.parse_label(F.col("response"), mode="word").alias("label"))


@register("rule_label", with_views(
    f"SELECT line_id, {orc.rule_label_sql('message', 'component')} AS label FROM log_view", "log_view"))
def q_rule_label(spark, sf):
    df = lv(spark, sf)
    return df.select("line_id", lab.rule_label(F.col("message"), F.col("component")).alias("label"))


@register("rule_explain", with_views(
    f"SELECT line_id, {orc.rule_explain_sql(orc.rule_label_sql('message', 'component'), 'line_id', 'node', 'component')}"
    " AS explanation FROM log_view", "log_view"))
def q_rule_explain(spark, sf):
    df = lv(spark, sf)
    label = lab.rule_label(F.col("message"), F.col("component"))
    return df.select("line_id", lab.rule_explain(label, F.col("line_id"), F.col("node"), F.col("component"))
                     .alias("explanation"))


@register("attach", with_views(
    "SELECT l.line_id, e.anomaly_result FROM log_view l LEFT JOIN (SELECT line_id, min(anomaly_result) AS "
    "anomaly_result FROM eval_view WHERE anomaly_result IS NOT NULL GROUP BY line_id) e ON e.line_id = l.line_id",
    "log_view", "eval_view"))
def q_attach(spark, sf):
    responses = view(spark, sf, "eval_view").where(F.col("anomaly_result").isNotNull())
    return attach(lv(spark, sf), responses, "anomaly_result", "line_id").select("line_id", "anomaly_result")


# ---------------------------------------------------------------- the line pipeline

_PIPE_RENDER = [("LineId", "int"), ("ts", "timestamp"), ("date", "date"), ("node", "string"), ("level", "string"),
                ("component", "string"), ("message", "string"), ("anomaly_score", "double"), ("anomaly", "bool")]


def _pipeline_sql() -> str:
    pbase = ("pbase AS (SELECT line_id AS LineId, line_id, ts, date, node, level, component, message, anomaly_score, "
             "anomaly_score >= 0.79 AS anomaly, row_number() OVER (ORDER BY line_id) - 1 AS pos FROM log_view)")
    label = orc.rule_label_sql("b.message", "b.component")
    ctx_str = f"coalesce(c.context_str, {orc.q(prm.NO_CONTEXT)})"
    lp = sql_template(prm.LABEL_TEMPLATE, {"log_str": "r.row", "context_str": ctx_str})
    ep = sql_template(prm.EXPLANATION_TEMPLATE, {"anomalous_log_str": "r.row", "context_str": ctx_str,
                                                 "label_str": f"'Anomaly Label: ' || ({label})"})
    expl = orc.rule_explain_sql(label, "b.LineId", "b.node", "b.component")
    body = f"""
SELECT b.LineId, i.context_ids AS context_ids_ref,
  CASE WHEN b.anomaly_score >= 0.79 THEN {lp} END AS anomaly_label,
  CASE WHEN b.anomaly_score >= 0.79 THEN {label} END AS anomaly_label_final,
  CASE WHEN b.anomaly_score >= 0.79 THEN {ep} END AS explanation_prompt,
  CASE WHEN b.anomaly_score >= 0.79 THEN {expl} END AS anomaly_explanation
FROM pbase b JOIN rendered r ON r.line_id = b.line_id LEFT JOIN ctx c ON c.anomaly_id = b.line_id
LEFT JOIN ids i ON i.context_id = b.line_id"""
    extra = ",".join([
        orc.near_cte("pbase"), orc.lexical_ctes("pbase"), orc.kept_cte("pbase", (("near", 1), ("lex", 3))),
        orc.ids_cte(),
        f" rendered AS (SELECT b.line_id, b.pos, {orc.render_sql(_PIPE_RENDER, 'b')} AS row FROM pbase b)",
        orc.gather_cte()])
    from logscope.plans.views import duck_view
    return "WITH " + ",\n".join([f"log_view AS ({duck_view('log_view')})", pbase, extra]) + "\n" + body


@register("explain_lines", _pipeline_sql())
def q_explain_lines(spark, sf):
    df = prepare(lv(spark, sf), id="line_id")
    out = explain_lines(df, LineConfig(strategy="lexical", threshold=0.79))
    return out.select("LineId", "context_ids_ref", "anomaly_label", "anomaly_label_final", "explanation_prompt",
                      "anomaly_explanation")


# ---------------------------------------------------------------- analytics


def _dist_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {t} AS threshold, count(*) FILTER (WHERE anomaly_score >= {t}) AS n FROM log_view"
        for t in ana.THRESHOLDS)
    return with_views(f"SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(n AS BIGINT) AS rows, "
                      f"round(n * 100.0 / (SELECT count(*) FROM log_view), 6) AS percent FROM ({rows})", "log_view")


@register("score_distribution", _dist_sql())
def q_score_distribution(spark, sf):
    return ana.score_distribution(lv(spark, sf))


@register("run_summary", with_views(
    "SELECT count(*) AS total_logs, count(*) FILTER (WHERE anomaly_score >= 0.79) AS anomalies FROM log_view",
    "log_view"))
def q_run_summary(spark, sf):
    return ana.run_summary(lv(spark, sf), 0.79)


@register("value_counts", with_views(
    "SELECT component, count(*) AS count FROM log_view GROUP BY component", "log_view"))
def q_value_counts(spark, sf):
    return ana.value_counts(lv(spark, sf), "component")


@register("anomalies_per_date", with_views(
    "SELECT CAST(date AS STRING) AS date, count(*) AS anomalies FROM log_view WHERE anomaly_score >= 0.8 "
    "GROUP BY date", "log_view"))
def q_per_date(spark, sf):
    df = prp.flag_anomalies(lv(spark, sf), 0.8)
    return ana.anomalies_per_date(df).select(F.col("date").cast("string").alias("date"), "anomalies")


@register("distinct_messages_per_date", with_views(
    "SELECT CAST(date AS STRING) AS date, count(DISTINCT message) AS distinct_messages FROM log_view "
    "WHERE anomaly_score >= 0.8 GROUP BY date", "log_view"))
def q_distinct_per_date(spark, sf):
    df = prp.flag_anomalies(lv(spark, sf), 0.8)
    return ana.distinct_messages_per_date(df, text_col="message").select(
        F.col("date").cast("string").alias("date"), "distinct_messages")


@register("message_counts", with_views(
    "SELECT CAST(date AS STRING) AS date, message, count(*) AS count FROM log_view WHERE anomaly_score >= 0.8 "
    "GROUP BY date, message", "log_view"))
def q_message_counts(spark, sf):
    df = prp.flag_anomalies(lv(spark, sf), 0.8)
    return ana.message_counts(df, text_col="message").select(
        F.col("date").cast("string").alias("date"), "message", "count")


@register("message_counts_on_date", with_views(
    "SELECT message, count(*) AS count FROM log_view WHERE anomaly_score >= 0.8 AND date = DATE '2024-01-03' "
    "GROUP BY message", "log_view"))
def q_message_counts_day(spark, sf):
    df = prp.flag_anomalies(lv(spark, sf), 0.8)
    return ana.message_counts(df, date="2024-01-03", text_col="message")


# ---------------------------------------------------------------- evaluation

_PAIRS = "(SELECT label AS t, anomaly_result AS p FROM eval_view WHERE anomaly_result IS NOT NULL AND label IS NOT NULL)"


@register("confusion_matrix", with_views(
    f"WITH pr AS {_PAIRS}, ls AS (SELECT t AS l FROM pr UNION SELECT p FROM pr) "
    "SELECT a.l AS true_label, b.l AS pred_label, CAST(count(pr.t) AS BIGINT) AS count FROM ls a, ls b "
    "LEFT JOIN pr ON pr.t = a.l AND pr.p = b.l GROUP BY a.l, b.l", "eval_view").replace(")\nWITH pr AS", "),\npr AS", 1))
def q_confusion(spark, sf):
    return ev.confusion_matrix(view(spark, sf, "eval_view"))


_CLASS_SQL = f"""pr AS {_PAIRS},
cls AS (SELECT l AS label,
   (SELECT count(*) FROM pr WHERE t = l AND p = l) AS tp,
   (SELECT count(*) FROM pr WHERE t = l) AS support,
   (SELECT count(*) FROM pr WHERE p = l) AS predicted
 FROM (SELECT t AS l FROM pr UNION SELECT p FROM pr)),
m AS (SELECT label, support, tp,
   CASE WHEN predicted = 0 THEN 0.0 ELSE tp * 1.0 / predicted END AS precision,
   CASE WHEN support = 0 THEN 0.0 ELSE tp * 1.0 / support END AS recall FROM cls),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)"""


@register("per_class", with_views(
    "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
    "CAST(support AS BIGINT) AS support FROM f", "eval_view", extra=_CLASS_SQL))
def q_per_class(spark, sf):
    return ev.per_class(view(spark, sf, "eval_view"))


@register("overall", with_views(
    "SELECT round(sum(tp) * 1.0 / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) "
    "AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, "
    "round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS predictions FROM f",
    "eval_view", extra=_CLASS_SQL))
def q_overall(spark, sf):
    return ev.overall(view(spark, sf, "eval_view"))


@register("class_distribution", with_views(
    "SELECT anomaly_result AS label, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent "
    "FROM eval_view WHERE anomaly_result IS NOT NULL GROUP BY anomaly_result", "eval_view"))
def q_class_distribution(spark, sf):
    return ev.class_distribution(view(spark, sf, "eval_view"))


@register("detailed", with_views(
    "SELECT line_id, label AS true_label, anomaly_result AS predicted_label, label = anomaly_result AS correct "
    "FROM eval_view", "eval_view"))
def q_detailed(spark, sf):
    return ev.detailed(view(spark, sf, "eval_view"), id_col="line_id")


_MODELS = ("SELECT 'model-' || CAST(line_id % 3 AS STRING) AS model, line_id, label, "
           "CASE WHEN line_id % 3 = 2 THEN NULL ELSE anomaly_result END AS pred, anomaly_score / 1e2 AS cost, "
           "anomaly_score AS seconds, CASE WHEN line_id % 3 = 2 THEN 'timeout' END AS error FROM eval_view")


@register("compare_models", with_views(
    "SELECT model, round(avg(CASE WHEN pred IS NOT NULL THEN CAST(lower(trim(label)) = lower(trim(pred)) AS INTEGER) "
    "END) * 100.0, 6) AS score, round(sum(cost), 6) AS cost, round(sum(seconds), 6) AS runtime, min(error) AS error "
    f"FROM ({_MODELS}) GROUP BY model", "eval_view"))
def q_compare_models(spark, sf):
    df = spark.sql(_MODELS.replace("FROM eval_view", "FROM {ev}"), ev=view(spark, sf, "eval_view"))
    return ev.compare_models(df)


@register("success_rate", with_views(
    "SELECT component, round(avg(CAST(l = p AS INTEGER)) * 100.0, 6) AS success_rate, count(*) AS n FROM "
    "(SELECT v.component, e.label AS l, e.anomaly_result AS p FROM eval_view e JOIN log_view v USING (line_id)) "
    "GROUP BY component", "eval_view", "log_view"))
def q_success_rate(spark, sf):
    df = view(spark, sf, "eval_view").join(lv(spark, sf).select("line_id", "component"), "line_id")
    return ev.success_rate(df, "label", "anomaly_result", by="component")


_JUDGE = ("SELECT event_id, CAST(event_id * 7 % 11 AS DOUBLE) AS score, CAST(event_id % 10 AS DOUBLE) AS accuracy, "
          "CAST(event_id * 3 % 10 AS DOUBLE) AS relevance FROM events")


@register("judge_summary",
          "SELECT CAST(min(score) AS DOUBLE) AS min_score, CAST(max(score) AS DOUBLE) AS max_score, "
          "round(avg(score), 6) AS mean_score, count(score) AS judged, round(avg(accuracy), 6) AS mean_accuracy, "
          f"round(avg(relevance), 6) AS mean_relevance FROM ({_JUDGE})")
def q_judge(spark, sf):
    df = spark.sql(_JUDGE.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events"))
    return ev.judge_summary(df)


# ---------------------------------------------------------------- text features, templates, detection metrics


def _mask_sql(col: str) -> str:
    out = col
    for pat, rep in txt.MASK_RULES:
        out = f"regexp_replace({out}, {orc.q(pat)}, {orc.q(rep)}, 'g')"
    return out


@register("normalise", with_views(
    f"SELECT source_file, line_no, {_mask_sql('value')} AS e_message_normalized FROM raw_view", "raw_view"))
def q_normalise(spark, sf):
    df = view(spark, sf, "raw_view")
    return df.select("source_file", "line_no", txt.normalise(F.col("value")).alias("e_message_normalized"))


@register("words", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), "
          "lambda x: x <> ''), '|') AS e_words FROM documents")
def q_words(spark, sf):
    df = table(spark, sf, "documents")
    return df.select("doc_id", F.array_join(txt.words(F.col("text")), "|").alias("e_words"))


@register("trigrams", with_views(
    "SELECT line_id, CASE WHEN length(message) >= 3 THEN array_to_string(list_transform(range(1, length(message) - 1), "
    "lambda i: substring(message, i, 3)), '|') ELSE '' END AS e_trigrams FROM log_view", "log_view"))
def q_trigrams(spark, sf):
    df = lv(spark, sf)
    return df.select("line_id", F.array_join(txt.trigrams(F.col("message")), "|").alias("e_trigrams"))


@register("lengths", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) "
          "AS e_words_len, CAST(greatest(length(text) - 2, 0) AS INTEGER) AS e_trigrams_len, "
          "CAST(length(text) AS INTEGER) AS e_chars_len, "
          "CAST(len(string_split(text, chr(10))) AS INTEGER) AS e_lines_len FROM documents")
def q_lengths(spark, sf):
    df = table(spark, sf, "documents")
    w, t = txt.words(F.col("text")), txt.trigrams(F.col("text"))
    ls = txt.lengths(w, t, F.col("text"))
    return df.select("doc_id", *[ls[k].alias(k) for k in ("e_words_len", "e_trigrams_len", "e_chars_len",
                                                          "e_lines_len")])


_IPLOM_SQL = """
tx AS (SELECT DISTINCT message AS t FROM log_view WHERE message IS NOT NULL),
tk AS (SELECT t, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS tok FROM tx),
tn AS (SELECT t, tok, len(tok) AS n FROM tk),
ps AS (SELECT t, n, unnest(range(0, n)) AS p FROM tn),
pw AS (SELECT ps.t, ps.n, ps.p, tn.tok[ps.p + 1] AS w FROM ps JOIN tn USING (t)),
card AS (SELECT n, p, count(DISTINCT w) AS c FROM pw GROUP BY n, p),
sz AS (SELECT n, count(*) AS size FROM tn GROUP BY n),
sp AS (SELECT n, p AS sp FROM card JOIN sz USING (n) WHERE c > 1 AND c < size QUALIFY row_number() OVER (PARTITION BY n ORDER BY c, p) = 1),
keyed AS (SELECT tn.t, tn.n, CASE WHEN sp.sp IS NULL THEN '' ELSE tn.tok[sp.sp + 1] END AS k FROM tn LEFT JOIN sp USING (n)),
pk AS (SELECT pw.*, keyed.k FROM pw JOIN keyed USING (t, n)),
cst AS (SELECT n, k, p, CASE WHEN count(DISTINCT w) = 1 THEN min(w) ELSE '<*>' END AS w FROM pk GROUP BY n, k, p),
tpl AS (SELECT n, k, string_agg(w, ' ' ORDER BY p) AS template FROM cst GROUP BY n, k)"""


@register("templates_iplom", with_views(
    "SELECT keyed.t AS message, tpl.template, md5(tpl.template) AS event_id FROM keyed JOIN tpl USING (n, k)",
    "log_view", extra=_IPLOM_SQL))
def q_iplom(spark, sf):
    df = lv(spark, sf).select("message").distinct()
    return templates_iplom(df, "message").select("message", "template", "event_id")


_BGL_LINE = ("CASE WHEN label = '-' THEN '-' ELSE label END || ' ' || CAST(line_id + 1117838570 AS STRING) || ' ' || "
             "replace(CAST(date AS STRING), '-', '.') || ' ' || node || ' ' || replace(CAST(date AS STRING), '-', '.') "
             "|| '-00.00.00.000000 ' || node || ' RAS ' || component || ' ' || level || ' ' || message")


@register("parse_bgl", with_views(
    "SELECT line_id, label, timestamp, date, node, component, level, m_message, label <> '-' AS anomaly FROM ("
    "SELECT line_id, string_split(v, ' ')[1] AS label, CAST(string_split(v, ' ')[2] AS BIGINT) AS timestamp, "
    "string_split(v, ' ')[3] AS date, string_split(v, ' ')[4] AS node, string_split(v, ' ')[8] AS component, "
    "string_split(v, ' ')[9] AS level, array_to_string(string_split(v, ' ')[10:], ' ') AS m_message FROM "
    f"(SELECT line_id, {_BGL_LINE} AS v FROM log_view))", "log_view"))
def q_parse_bgl(spark, sf):
    df = lv(spark, sf).select("line_id", F.expr(_BGL_LINE).alias("value"))
    out = parse_bgl(df)
    return out.select("line_id", "label", "timestamp", "date", "node", "component", "level", "m_message", "anomaly")


_DET = ("SELECT line_id, label <> '-' AS anomaly, anomaly_score AS pred_ano_proba, "
        "CAST(anomaly_score >= 0.5 AS INTEGER) AS pred_ano FROM log_view")


@register("detector_metrics", with_views(
    "SELECT round((tp + tn) * 1.0 / (tp + tn + fp + fn), 6) AS accuracy, "
    "round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END, 6) AS precision, "
    "round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END, 6) AS recall, "
    "round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1, "
    "round(num / (p * n), 6) AS auc FROM ("
    "SELECT count(*) FILTER (WHERE anomaly AND pred_ano = 1) AS tp, count(*) FILTER (WHERE NOT anomaly AND pred_ano = 1) AS fp, "
    "count(*) FILTER (WHERE anomaly AND pred_ano = 0) AS fn, count(*) FILTER (WHERE NOT anomaly AND pred_ano = 0) AS tn "
    f"FROM ({_DET})) c, (SELECT sum(pos * (cum - neg + 0.5 * neg)) AS num, sum(pos) AS p, sum(neg) AS n FROM ("
    "SELECT pos, neg, sum(neg) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS cum FROM ("
    f"SELECT pred_ano_proba AS s, count(*) FILTER (WHERE anomaly) AS pos, count(*) FILTER (WHERE NOT anomaly) AS neg "
    f"FROM ({_DET}) GROUP BY pred_ano_proba))) a", "log_view"))
def q_detector_metrics(spark, sf):
    df = spark.sql(_DET.replace("FROM log_view", "FROM {lv}"), lv=lv(spark, sf))
    return detector_metrics(df)


# ---------------------------------------------------------------- operators checked by rows only
# (iterative, randomised or model-based: no SQL oracle; pytest checks them against
# brute-force models on small fixtures)


def _enhanced(spark, sf):
    from logscope.plans.files import enhance
    return enhance(merge_multiline(view(spark, sf, "raw_view"))).withColumn(
        "_line_key", F.xxhash64("source_file", "line_no"))


_TIP_SQL = """
m0 AS (SELECT message, list_transform(list_filter(regexp_split_to_array(message, '\\s+'), lambda w: w <> ''),
       lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS tok FROM log_view WHERE message IS NOT NULL),
m AS (SELECT tok, count(*) AS w FROM m0 GROUP BY tok),
h0 AS (SELECT tok, w, unnest(list_distinct(tok)) AS a FROM m),
c AS (SELECT a, sum(w) AS n FROM h0 WHERE a <> '<*>' GROUP BY a HAVING sum(w) >= 2),
h AS (SELECT h0.tok, h0.w, h0.a, c.n FROM h0 JOIN c USING (a)),
pr AS (SELECT x.a, y.a AS b FROM h x JOIN h y ON x.tok = y.tok AND x.a <> y.a
       GROUP BY x.a, y.a, x.n, y.n HAVING sum(x.w) >= 0.5 * greatest(x.n, y.n)),
part AS (SELECT h.tok, h.a, h.n, list(y.a) FILTER (WHERE y.a IS NOT NULL) AS p
         FROM h LEFT JOIN pr ON pr.a = h.a LEFT JOIN h y ON y.tok = h.tok AND y.a = pr.b GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY coalesce(len(p), 0) DESC, n DESC, a) AS o FROM part),
ev AS (SELECT m.tok, m.w, list_sort(list_concat([b.a], coalesce(b.p, []))) AS keys FROM m LEFT JOIN best b ON b.tok = m.tok AND b.o = 1),
sk0 AS (SELECT tok, w, keys, list_transform(tok, lambda t: CASE WHEN list_contains(keys, t) THEN t ELSE '<*>' END) AS s FROM ev),
sk AS (SELECT tok, w, array_to_string(list_filter(s, lambda x, i: x <> '<*>' OR i = 1 OR s[i - 1] <> '<*>'), ' ') AS sk,
       CASE WHEN keys[1] IS NOT NULL THEN 'k ' || array_to_string(keys, ' ') END AS e FROM sk0),
f AS (SELECT tok, w, sk, coalesce(e, 's ' || sk) AS e FROM sk),
v AS (SELECT e, sk, row_number() OVER (PARTITION BY e ORDER BY sum(w) DESC, sk) AS o FROM f GROUP BY e, sk)
"""


@register("templates_tip", with_views(
    "SELECT l.message, v.sk AS template, md5(f.e) AS event_id FROM m0 l JOIN f ON f.tok = l.tok JOIN v ON v.e = f.e AND v.o = 1",
    "log_view", extra=_TIP_SQL))
def q_templates_tip(spark, sf):
    from logscope.operators.templates import templates_tip
    return templates_tip(lv(spark, sf).select("message"), "message").select("message", "template", "event_id")


_MASKED_SQL = r"""
m0 AS (SELECT line_id, message, list_transform(list_filter(regexp_split_to_array(message, '\s+'), lambda w: w <> ''),
       lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS tok FROM log_view),
m AS (SELECT tok, count(*) AS w, len(tok) AS n FROM m0 WHERE message IS NOT NULL GROUP BY tok)
"""

_DRAIN_SQL = _MASKED_SQL + """,
links AS (SELECT x.tok AS a, y.tok AS b FROM m x JOIN m y ON x.n = y.n AND list_slice(x.tok, 1, 2) = list_slice(y.tok, 1, 2)
          WHERE len(list_filter(x.tok, lambda t, i: t = y.tok[i])) >= 0.4::DOUBLE * x.n),
comp AS (WITH RECURSIVE reach(a, b) AS (SELECT tok, tok FROM m UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
         SELECT a AS tok, min(b) AS c FROM reach GROUP BY a),
pos AS (SELECT tok, c, unnest(tok) AS x, unnest(range(1, len(tok) + 1)) AS p FROM comp),
col AS (SELECT c, p, CASE WHEN min(x) = max(x) THEN min(x) ELSE '<*>' END AS x FROM pos GROUP BY c, p),
tm AS (SELECT comp.tok, coalesce(string_agg(col.x, ' ' ORDER BY p), '') AS template FROM comp LEFT JOIN col USING (c) GROUP BY comp.tok)
"""

_BRAIN_SQL = _MASKED_SQL + """,
p0 AS (SELECT tok, n, w, unnest(tok) AS x, unnest(range(1, n + 1)) AS p FROM m),
p1 AS (SELECT *, sum(w) OVER (PARTITION BY n, p, x) AS f FROM p0),
cb AS (SELECT tok, f, list((p, x) ORDER BY p)::VARCHAR AS l, row_number() OVER (PARTITION BY tok ORDER BY count(*) DESC, f DESC) AS o
       FROM p1 WHERE x <> '<*>' GROUP BY tok, f),
p2 AS (SELECT p1.*, cb.f AS rf, coalesce(cb.l, '') AS k FROM p1 LEFT JOIN cb ON cb.tok = p1.tok AND cb.o = 1),
d AS (SELECT n, k, p, count(DISTINCT x) AS d FROM p2 GROUP BY n, k, p),
tm0 AS (SELECT tok, string_agg(CASE WHEN f = rf OR (f > rf AND d = 1) OR (f < rf AND d <= 2) THEN x ELSE '<*>' END, ' ' ORDER BY p) AS template
        FROM p2 JOIN d USING (n, k, p) GROUP BY tok),
tm AS (SELECT m.tok, coalesce(template, '') AS template FROM m LEFT JOIN tm0 USING (tok))
"""

_TEMPLATES_OUT = ("SELECT line_id, message AS e_message_normalized, template, md5(template) AS event_id "
                  "FROM m0 LEFT JOIN tm ON tm.tok = m0.tok AND message IS NOT NULL")


@register("templates_drain", with_views(_TEMPLATES_OUT, "log_view", extra=_DRAIN_SQL))
def q_drain(spark, sf):
    from logscope.operators.templates import templates_drain
    df = lv(spark, sf).select("line_id", F.col("message").alias("e_message_normalized"))  # raw messages, every row
    return templates_drain(df).select("line_id", "e_message_normalized", "template", "event_id")


@register("templates_spell")
def q_spell(spark, sf):
    from logscope.operators.templates import templates_spell
    df = lv(spark, sf).select("line_id", F.col("message").alias("e_message_normalized"))  # raw messages, every row
    return templates_spell(df).select("line_id", "e_message_normalized", "template", "event_id")


@register("templates_brain", with_views(_TEMPLATES_OUT, "log_view", extra=_BRAIN_SQL))
def q_brain(spark, sf):
    from logscope.operators.templates import templates_brain
    df = lv(spark, sf).select("line_id", F.col("message").alias("e_message_normalized"))
    return templates_brain(df).select("line_id", "e_message_normalized", "template", "event_id")


@register("isolation_forest")
def q_isolation_forest(spark, sf):
    from logscope.operators.detect import isolation_forest, split
    from logscope.plans.files import LENGTH_FEATURES
    x = _enhanced(spark, sf)
    train, test = split(x, 0.9, 42, ["_line_key"])
    out = isolation_forest(train, test, LENGTH_FEATURES, 100, 256, 42, "_line_key", by="source_file", words_col="e_words")
    return out.select("source_file", "line_no", "pred_ano", F.round("pred_ano_proba", 6).alias("pred_ano_proba"))


@register("lof")
def q_lof(spark, sf):
    from logscope.operators.detect import lof, split
    from logscope.plans.files import LENGTH_FEATURES
    x = _enhanced(spark, sf)
    train, test = split(x, 0.9, 42, ["_line_key"])
    out = lof(train, test, LENGTH_FEATURES, 20, "_line_key", by="source_file", words_col="e_words")
    return out.select("source_file", "line_no", "pred_ano", F.round("pred_ano_proba", 6).alias("pred_ano_proba"))


@register("features")
def q_features(spark, sf):
    from logscope.operators.detect import split
    from logscope.operators.vectors import features
    x = _enhanced(spark, sf)
    train, _ = split(x, 0.9, 42, ["_line_key"])
    (out,) = features(train, [x])
    # a vector of all words for each line would be lines times vocabulary: the stored values are summed
    stored = out.select("source_file", "line_no", F.unwrap_udt("features").alias("v"))
    return stored.select("source_file", "line_no", F.coalesce("v.size", F.size("v.values")).alias("dims"),
                         F.round(F.aggregate("v.values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@register("embed")
def q_embed(spark, sf):
    from logscope.operators.vectors import embed
    df = embed(lv(spark, sf).select("line_id", "message"), "message")
    return df.select("line_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v), 6)
                     .alias("norm2"))


@register("explain_files")
def q_explain_files(spark, sf):
    from logscope.plans.files import FileConfig, explain_files
    known = spark.createDataFrame([(x,) for x in KNOWN_LABELS], "label string")
    return explain_files(view(spark, sf, "raw_view"), FileConfig(token_limit=_BUDGET, known_labels=known))


@register("trim_iterative")
def q_trim_iterative(spark, sf):
    kept = trim_to_budget(_file_lines(spark, sf), _BUDGET, "source_file", policy="iterative")
    return kept.select("source_file", "line_no", F.round("pred_ano_proba", 6).alias("pred_ano_proba"))


_STRATEGIES = {"zero_shot": "Classify this log line.\n{input}",
               "step_by_step": "Think step by step about what failed, then classify.\n{input}",
               "hypotheses": "List three possible causes, pick the most likely, then classify.\n{input}",
               "few_shot": "Examples:\n{examples}\nNow classify.\n{input}"}


def _variants_sql() -> str:
    examples = ("(SELECT string_agg('Text: ' || message || chr(10) || 'Label: ' || label, chr(10) ORDER BY line_id) "
                "FROM log_view WHERE line_id <= 17)")
    parts = [f"SELECT line_id, {orc.q(n)} AS strategy, {sql_template(t, {'input': 'message', 'examples': examples})} AS variant_prompt "
             "FROM log_view WHERE anomaly_score >= 0.79" for n, t in _STRATEGIES.items()]
    return with_views(" UNION ALL ".join(parts), "log_view")


@register("prompt_variants", _variants_sql())
def q_prompt_variants(spark, sf):
    df = prp.select_anomalies(lv(spark, sf), 0.79).select("line_id", "message")
    demos = lv(spark, sf).where("line_id <= 17").select(F.col("line_id").alias("demo_no"), F.col("message").alias("text"), "label")
    return prm.prompt_variants(df, "message", _STRATEGIES, demos).select("line_id", "strategy", "variant_prompt")


@register("sample_n", with_views(
    "SELECT line_id, message FROM log_view ORDER BY md5(CAST(line_id AS VARCHAR) || '|42'), line_id LIMIT 100", "log_view"))
def q_sample_n(spark, sf):
    return prp.sample_n(lv(spark, sf), 100, 42, ["line_id"]).select("line_id", "message")


@register("sample_per_group", with_views(
    "SELECT line_id, level FROM log_view QUALIFY row_number() OVER (PARTITION BY level "
    "ORDER BY md5(CAST(line_id AS VARCHAR) || '|42'), line_id) <= 2", "log_view"))
def q_sample_per_group(spark, sf):
    return prp.sample_per_group(lv(spark, sf), "level", 2, 42, ["line_id"]).select("line_id", "level")


@register("label_tree", "SELECT 'conv ' || conv_id AS app, role AS failure, 'turn_' || turn AS app_id FROM conversations")
def q_label_tree(spark, sf):
    # the label tree parser over text lines derived from the conversations table:
    # a conversation opens an application, a role line opens a failure type, turns are members
    from logscope.sources.readers import label_tree_rows
    conv = table(spark, sf, "conversations")
    lines = conv.select(F.lit("conversations").alias("source_file"), "conv_id", "turn", "role")
    head = lines.where("turn = 0").select("source_file", "conv_id", F.lit(-2).alias("k"),
                                          F.concat(F.lit("### conv "), F.col("conv_id").cast("string")).alias("_t"))
    fail = lines.select("source_file", "conv_id", (F.col("turn") * 2 - 1).alias("k"),
                        F.concat(F.col("role"), F.lit(":")).alias("_t"))
    memb = lines.select("source_file", "conv_id", (F.col("turn") * 2).alias("k"),
                        F.concat(F.lit("+ turn_"), F.col("turn").cast("string")).alias("_t"))
    allx = head.unionByName(fail).unionByName(memb).withColumn(
        "line_no", F.col("conv_id") * F.lit(1_000_000) + F.col("k") + 2)
    return label_tree_rows(allx.select("source_file", "line_no", "_t"))


# ---------------------------------------------------------------- further oracle-backed variants


@register("gather_context_exact", _with_base(
    "SELECT g.anomaly_id, string_agg(r.row, chr(10) ORDER BY r.pos, r.line_id) AS context_rows FROM kept g "
    "JOIN (SELECT context_id FROM kept GROUP BY context_id HAVING count(*) = 1) one USING (context_id) "
    "JOIN rendered r ON r.line_id = g.context_id GROUP BY g.anomaly_id",
    orc.near_cte() + "," + orc.kept_cte() + f", rendered AS (SELECT line_id, pos, {_CARD_SQL} AS row FROM base)"))
def q_gather_exact(spark, sf):
    df = ctx_base(spark, sf).withColumn("_card", F.expr(_CARD_SQL))
    g = ctx.gather_context(ctx.near_context(df, 6, "line_id"), df, "_card", "line_id", mode="exact")
    return g.select("anomaly_id", F.array_join("context_rows", "\n").alias("context_rows"))


@register("context_ids_dedup", _with_base(
    "SELECT b.line_id, d.context_ids FROM base b LEFT JOIN (SELECT context_id, string_agg(CAST(anomaly_id AS VARCHAR), "
    "',' ORDER BY p) AS context_ids FROM (SELECT context_id, anomaly_id, min(struct_pack(a := anomaly_pos, k := kind_no, "
    "r := rank)) AS p FROM kept GROUP BY context_id, anomaly_id) GROUP BY context_id) d ON d.context_id = b.line_id",
    orc.near_cte() + "," + orc.lexical_ctes() + "," + orc.kept_cte(parts=(("near", 1), ("lex", 3)), compat=False)))
def q_context_ids_dedup(spark, sf):
    df = ctx_base(spark, sf)
    edges = ctx.near_context(df, 6, "line_id").unionByName(ctx.far_lexical(df, 5, True, "message", "line_id"))
    return ctx.context_ids(edges, df, "line_id", compat=False).select("line_id", "context_ids")


def _best_match_sql() -> str:
    # the notebook variant: the single most similar row of the whole table (itself included)
    lex = orc.lexical_ctes().replace("ON c.line_id < a.line_id", "ON true").replace("QUALIFY rank <= 5",
                                                                                     "QUALIFY rank <= 1")
    return _with_base("SELECT anomaly_id, context_id, rank, round(similarity, 6) AS similarity FROM lex", lex)


@register("far_lexical_best", _best_match_sql())
def q_far_lexical_best(spark, sf):
    df = ctx_base(spark, sf)
    e = ctx.far_lexical(df, 1, False, "message", "line_id")
    return e.select("anomaly_id", "context_id", "rank", F.round("similarity", 6).alias("similarity"))


_TIME_SQL = orc.q(txt.TIME_PATTERN)


@register("extract_timestamp", with_views(
    "SELECT source_file, line_no, CASE WHEN raw = '' THEN NULL ELSE strftime(try_strptime('1970-01-01 ' || "
    "rpad(CASE WHEN regexp_matches(raw, '^\\d:') THEN '0' || raw ELSE raw END, 12, '0'), '%Y-%m-%d %H:%M:%S.%g'), "
    "'%H:%M:%S.%g') END AS m_timestamp, "
    f"regexp_replace(value, {_TIME_SQL}, '') AS m_message FROM (SELECT *, regexp_extract(value, {_TIME_SQL}, 1) AS raw "
    "FROM raw_view)", "raw_view"))
def q_extract_timestamp(spark, sf):
    df = view(spark, sf, "raw_view")
    return df.select("source_file", "line_no",
                     F.date_format(txt.extract_time(F.col("value")), "HH:mm:ss.SSS").alias("m_timestamp"),
                     txt.strip_time(F.col("value")).alias("m_message"))


@register("one_class_svm")
def q_one_class_svm(spark, sf):
    from logscope.operators.detect import one_class_svm, split
    from logscope.plans.files import LENGTH_FEATURES
    x = _enhanced(spark, sf)
    train, _ = split(x, 0.9, 42, ["_line_key"])
    out = one_class_svm(train, x, LENGTH_FEATURES, nu=0.1)
    return out.select("source_file", "line_no", "pred_ano", F.round("pred_ano_proba", 6).alias("pred_ano_proba"))


@register("explain_lines_semantic")
def q_explain_lines_semantic(spark, sf):
    # semantic context as the original's default: texts embedded on the fly (offline hashed encoder)
    df = prepare(lv(spark, sf), id="line_id")
    out = explain_lines(df, LineConfig(strategy="semantic", threshold=0.79))
    return out.select("LineId", "context_ids_ref", "anomaly_label_final", "anomaly_explanation")


# ---------------------------------------------------------------- readers, split, counts and model calls with oracles


@register("ensure_columns", with_views("SELECT line_id, NULL AS shelf, 5 AS retries, 'x' || node AS tag, message FROM log_view", "log_view"))
def q_ensure_columns(spark, sf):
    df = lv(spark, sf).select("line_id", "node", "message")
    spec = {"shelf": "string", "retries": 5, "tag": F.concat(F.lit("x"), F.col("node")), "message": "string"}
    return prp.ensure_columns(df, spec).drop("node")


@register("split", with_views(
    "SELECT line_id, ('0x' || substr(md5(CAST(line_id AS VARCHAR) || '|42'), 1, 8))::BIGINT / 4294967296.0 < 0.9 AS is_test "
    "FROM log_view", "log_view"))
def q_split(spark, sf):
    from logscope.operators.detect import split
    train, test = split(lv(spark, sf).select("line_id"), 0.9, 42, ["line_id"])
    return train.withColumn("is_test", F.lit(False)).union(test.withColumn("is_test", F.lit(True)))


@register("vocabulary", with_views(
    "SELECT line_id, regexp_extract(message, '\\b(\\d{3})\\b', 1) AS status_code, "
    "array_to_string(string_split(lower(message), ' '), '|') AS tokens FROM log_view", "log_view"))
def q_vocabulary(spark, sf):
    from logscope.sources.readers import vocabulary_rows
    df = lv(spark, sf).select("line_id", "message").withColumns(vocabulary_rows(F.col("message")))
    return df.select("line_id", "status_code", F.array_join("tokens", "|").alias("tokens"))


@register("read_labelled", "SELECT doc_id, quality, toxic FROM labels")
def q_read_labelled(spark, sf):
    from logscope.sources.readers import read_labelled
    return read_labelled(spark, f"{sf}/labels.parquet", "parquet").select("doc_id", "quality", "toxic")


@register("nested_counts", with_views(
    "SELECT date, count(*) AS messages, string_agg(message || '=' || CAST(n AS VARCHAR), '|' ORDER BY message) AS counts FROM ("
    "SELECT CAST(date AS VARCHAR) AS date, CASE WHEN line_id % 9 = 0 THEN '' ELSE message END AS message, count(*) AS n "
    "FROM log_view GROUP BY 1, 2) GROUP BY date", "log_view"))
def q_nested_counts(spark, sf):
    from logscope.sources.sinks import nested_counts
    df = lv(spark, sf).withColumn("m", F.when(F.col("line_id") % 9 != 0, F.col("message")))
    counts = df.groupBy(F.col("date").cast("string").alias("date"), F.col("m").alias("e_message_normalized")).agg(F.count(F.lit(1)).alias("count"))
    out = nested_counts(counts)
    entries = F.transform(F.sort_array(F.map_entries("messages")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("date", F.size("messages").cast("long").alias("messages"), F.array_join(entries, "|").alias("counts"))


_ASKED = "CASE WHEN line_id % 7 = 0 THEN NULL WHEN line_id % 11 = 0 THEN '' ELSE message END"


@register("complete", with_views(f"SELECT line_id, {reply_sql('prompt')} AS reply FROM (SELECT line_id, {_ASKED} AS prompt FROM log_view)", "log_view"))
def q_complete(spark, sf):
    df = lv(spark, sf).select("line_id", F.expr(_ASKED).alias("prompt"))
    return complete(df, "prompt", "reply", Echo).select("line_id", "reply")


@register("file_responses", with_views(
    "SELECT line_id, CASE WHEN prompt IS NULL OR prompt = '' THEN 'Error: Invalid prompt provided.' "
    "WHEN r IS NULL THEN 'Error: LLM call returned no response.' ELSE trim(r) END AS file_explanation FROM ("
    f"SELECT line_id, prompt, {reply_sql('prompt')} AS r FROM (SELECT line_id, {_ASKED} AS prompt FROM log_view))", "log_view"))
def q_file_responses(spark, sf):
    df = lv(spark, sf).select("line_id", F.expr(_ASKED).alias("file_prompt"))
    return file_responses(df, Echo).select("line_id", "file_explanation")


@register("chain", with_views(
    f"SELECT line_id, first, {reply_sql('second_prompt')} AS second FROM (SELECT line_id, first, 'again' || first AS second_prompt FROM ("
    f"SELECT line_id, {reply_sql('message')} AS first FROM log_view))", "log_view"))
def q_chain(spark, sf):
    steps = [(lambda d: d.withColumn("_step0", F.col("message")), "first"),
             (lambda d: d.withColumn("_step1", F.concat(F.lit("again"), F.col("first"))), "second")]
    return chain(lv(spark, sf).select("line_id", "message"), steps, Echo).select("line_id", "first", "second")


# ---------------------------------------------------------------- written to the shared folder and read back


def _shared(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/logscope-{name}-{uuid.uuid4().hex}"


_QUOTED = "CASE WHEN LineId % 5 = 0 THEN Content || chr(10) || 'said \"x\", twice' ELSE Content END"


@register("read_structured_csv", with_views(
    f"SELECT LineId, Level, Component, coalesce({_QUOTED}, '') AS Content FROM (SELECT {_STRUCTURED} FROM log_view)", "log_view"))
def q_read_structured_csv(spark, sf):
    from logscope.sources.readers import read_structured_csv
    path = _shared(spark, "csv")
    df = lv(spark, sf).selectExpr(*_STRUCTURED_SPARK)
    df.select("LineId", "Level", "Component", F.coalesce(F.expr(_QUOTED), F.lit("")).alias("Content")).write.option(
        "header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return read_structured_csv(spark, path, "LineId long, Level string, Component string, Content string")


@register("read_text_lines", with_views(
    "SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY line_no) AS line_no, value FROM raw_view", "raw_view"))
def q_read_text_lines(spark, sf):
    from logscope.sources.readers import read_text_lines
    path = _shared(spark, "text")
    # one physical file for each source file: that is what a raw log is
    raw = view(spark, sf, "raw_view").withColumn("log", F.coalesce("source_file", F.lit("")))
    raw.repartition("log").sortWithinPartitions("log", "line_no").select("log", "value").write.partitionBy("log").text(path)
    out = read_text_lines(spark, path)
    return out.select(F.regexp_extract("source_file", "log=([^/]*)/", 1).alias("source_file"), "line_no", "value")


@register("write_logs", with_views("SELECT line_id, CAST(date AS VARCHAR) AS date, message FROM log_view", "log_view"))
def q_write_logs(spark, sf):
    from logscope.sources.sinks import write_logs
    path = _shared(spark, "logs")
    write_logs(lv(spark, sf).select("line_id", F.col("date").cast("string").alias("day"), "message"), path, 1_000, "line_id", "day")
    return spark.read.schema("line_id long, message string, day string").parquet(path).select("line_id", F.col("day").alias("date"), "message")


@register("write_evaluation", with_views(
    "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
    "CAST(support AS BIGINT) AS support FROM f", "eval_view", extra=_CLASS_SQL))
def q_write_evaluation(spark, sf):
    from logscope.sources.sinks import write_evaluation
    path = _shared(spark, "evaluation")
    rows = view(spark, sf, "eval_view")
    write_evaluation(rows, ev.per_class(rows), ev.overall(rows), path)
    return spark.read.option("header", True).schema(
        "label string, precision double, recall double, f1 double, support long").csv(f"{path}/per_class")


@register("write_nested_document", with_views(
    "SELECT CAST(date AS VARCHAR) AS date, CASE WHEN line_id % 9 = 0 THEN '' ELSE message END AS message, count(*) AS n "
    "FROM log_view GROUP BY 1, 2", "log_view"))
def q_write_nested_document(spark, sf):
    from logscope.sources.sinks import read_nested_document, write_nested_document
    path = _shared(spark, "nested")
    df = lv(spark, sf).withColumn("m", F.when(F.col("line_id") % 9 != 0, F.col("message")))
    counts = df.groupBy("date", F.col("m").alias("e_message_normalized")).agg(F.count(F.lit(1)).alias("count"))
    write_nested_document(counts, path)
    return read_nested_document(spark, path, text_col="message", count_col="n")


def _run_lines_sql() -> str:
    classes = "[" + ", ".join(f"'{c}'" for c in RUN_CLASSES) + "]"
    head = sql_template(prm.RUN_TEMPLATE.split("\n{content}")[0], {"classes": orc.q(classes)})
    return (f"SELECT DISTINCT conv_id, 0 AS part, CAST(NULL AS BIGINT) AS turn, {head} AS line FROM conversations "
            "UNION ALL SELECT conv_id, 1, turn, role || ': ' || text FROM conversations WHERE role || text IS NOT NULL")


@register("run_prompt_lines", _run_lines_sql())
def q_run_prompt_lines(spark, sf):
    conv = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("Content"))
    return prm.run_prompt_lines(conv, RUN_CLASSES, ["conv_id"], "Content", "turn")
