"""End-to-end compositions: the line pipeline (INF8) and the file pipeline (INF9)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.functions.labels import LABELS, parse_label, rule_explain, rule_label
from logscope.operators import context as ctx
from logscope.operators import prepare as prp
from logscope.operators.inference import complete
from logscope.operators.position import with_position
from logscope.operators.prompts import EXPLANATION_TEMPLATE, HIDDEN, LABEL_TEMPLATE, label_text, with_context_text
from logscope.functions.render import fill_template
from logscope.session import materialise


STRATEGIES = ("near", "lexical", "semantic", "hybrid", "window")


@dataclass
class LineConfig:
    threshold: float = 0.79          # prompts, and context where there is no anomaly column, for score >= threshold
    strategy: str = "lexical"        # near-only: "near"; far: "lexical" | "semantic" | "hybrid"; fallback: "window"
    top_k_near: int = 6
    top_k_far: int = 5
    window: int = 5                  # reach of the "window" strategy, in ids
    drop_duplicates: bool = False    # keep the first row of each text (and all anomalies) as possible context
    limit_date: bool = False         # only the last date's rows ...
    limit_line: object = None        # ... or the date of this row id
    date_col: str = "date"
    text_col: str = "message"        # column used for lexical similarity
    vec_col: str = "embedding"       # vector column for semantic similarity
    id_col: str = "LineId"
    mode: str = "member"             # context lookup: member | exact
    compat: bool = True
    clean: bool = False
    on_error: str = "value"          # "value": keep error text; "rules": fall back to the rule labeller
    seed: int = 0
    encoder: object = None           # factory for on-the-fly embeddings when vec_col is absent
    label_template: str = LABEL_TEMPLATE
    explanation_template: str = EXPLANATION_TEMPLATE
    max_tokens: int = 1000
    check_ids: bool = False          # raise where an id is null or repeated


def prepare(df: DataFrame, score: str | None = None, id: str | None = None, message: str | None = None) -> DataFrame:
    """Canonicalise names, clean labels and scores (PRP1-PRP4)."""
    df = prp.canonicalise(df, score=score, id=id, message=message)
    df = prp.dash_to_normal(df)
    df = prp.ensure_score(df)
    return prp.coerce_score(df)


def line_edges(df: DataFrame, cfg: LineConfig, id_col: str | None = None, text_vectors: DataFrame | None = None) -> DataFrame:
    """All context edges of the configured strategy, between values of ``id_col``. ``text_vectors`` holds the vectors of
    texts where rows carry none."""
    key = id_col or cfg.id_col
    if cfg.strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {cfg.strategy!r}; one of {STRATEGIES}")
    if cfg.strategy == "window":
        return ctx.near_context(df, 2 * cfg.window, key)
    edges = ctx.near_context(df, cfg.top_k_near, key)
    if cfg.strategy == "lexical":
        edges = edges.unionByName(ctx.far_lexical(df, cfg.top_k_far, True, cfg.text_col, key))
    elif cfg.strategy == "semantic":
        edges = edges.unionByName(ctx.far_semantic(df, cfg.top_k_far, cfg.vec_col, True, key, text_vectors=text_vectors, text_col=cfg.text_col))
    elif cfg.strategy == "hybrid":
        edges = edges.unionByName(ctx.far_hybrid(df, cfg.top_k_far, cfg.text_col, cfg.vec_col, key, text_vectors=text_vectors))
    return edges


def check_ids(df: DataFrame, id_col: str) -> None:
    """Raise where an id is null or repeated."""
    bad = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1)).limit(1).count()
    if bad:
        raise ValueError(f"{id_col} is null or repeated in some rows")


def explain_lines(df: DataFrame, cfg: LineConfig | None = None, client=None) -> DataFrame:
    """Context -> label prompts -> labels -> explanation prompts -> explanations -> finalise.

    ``client=None`` uses the rule labeller and rule explainer (offline). With a
    client, ``on_error='rules'`` replaces error replies with the rule results.
    Rows are keyed by their position in id order (null ids first), so null and repeated ids are neither
    lost nor multiplied; ``cfg.check_ids`` makes them an error.
    """
    cfg = cfg or LineConfig()
    if cfg.strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {cfg.strategy!r}; one of {STRATEGIES}")
    if cfg.check_ids:
        check_ids(df, cfg.id_col)
    if cfg.limit_date or cfg.limit_line is not None:
        df = prp.limit_date(df, cfg.limit_line, cfg.id_col, cfg.date_col)
    df = prp.flag_anomalies(df, cfg.threshold)
    df = with_position(df, cfg.id_col)
    if cfg.drop_duplicates:
        firsts = prp.dedup_context(df.select(cfg.text_col, "pos", "anomaly"), cfg.text_col, order_col="pos", id_col="pos")
        stay = firsts.select("pos").union(df.where("anomaly").select("pos")).distinct()
        df = with_position(df.join(stay, "pos", "left_semi").drop("pos"), cfg.id_col)
    vectors = None
    if cfg.strategy in ("semantic", "hybrid") and cfg.vec_col not in df.columns:
        # as the original does, embed the context column when no vectors are given: each text once, no row carries them
        from logscope.operators.vectors import HashingEncoder, embed_texts
        vectors = embed_texts(df, cfg.text_col, cfg.vec_col, cfg.encoder or HashingEncoder)
    # the edge table is small (anomalies x (near + far)) and is read three times:
    # materialise it once instead of recomputing the similarity joins
    edges = materialise(line_edges(df, cfg, "pos", vectors))
    ids = ctx.context_ids(edges, df, "pos", compat=cfg.compat, out="context_ids_ref", name_col=cfg.id_col)
    # vectors are not log fields, and id lists grow with the table: neither is rendered into prompts
    x = with_context_text(ids, edges, "pos", cfg.mode, exclude=HIDDEN + (cfg.vec_col,), compat=cfg.compat)
    asked = F.col("anomaly_score") >= F.lit(cfg.threshold)
    prompts = x.withColumn("anomaly_label", F.when(asked, fill_template(
        cfg.label_template, {"log_str": F.col("_row"), "context_str": F.col("_context")})))
    # rules read the message itself; the similarity column may be a normalised copy
    msg_col = "message" if "message" in df.columns else cfg.text_col
    msg = F.col(msg_col) if msg_col in df.columns else F.lit(None).cast("string")
    comp = F.col("component") if "component" in df.columns else None
    node = F.col("node") if "node" in df.columns else None
    rule = rule_label(msg, comp)
    if client is None:
        labelled = prompts.withColumn("anomaly_result", F.when(F.col("anomaly_label").isNotNull(), rule))
    else:
        raw = complete(prompts, "anomaly_label", "_raw_label", client, cfg.max_tokens)
        failed = F.col("_raw_label").isNull() | F.col("_raw_label").startswith("Error:") | \
            F.col("_raw_label").startswith("API Error:")
        parsed = parse_label(F.col("_raw_label"), LABELS, "compat")
        if cfg.on_error == "rules":
            parsed = F.when(failed, rule).otherwise(parsed)
        labelled = raw.withColumn("anomaly_result", F.when(F.col("anomaly_label").isNotNull(), parsed)) \
            .drop("_raw_label")
    exp = labelled.withColumn("explanation_prompt", F.when(asked, fill_template(cfg.explanation_template, {
        "anomalous_log_str": F.col("_row"), "label_str": label_text(labelled, ("anomaly_result",)),
        "context_str": F.col("_context")}))).drop("_row", "_context")
    if client is None:
        explained = exp.withColumn("explanation_result", F.when(
            F.col("explanation_prompt").isNotNull(),
            rule_explain(F.col("anomaly_result"), F.col(cfg.id_col), node, comp, cfg.seed)))
    else:
        explained = complete(exp, "explanation_prompt", "explanation_result", client, cfg.max_tokens)
        if cfg.on_error == "rules":
            bad = F.col("explanation_result").startswith("Error:") | F.col("explanation_result").startswith("API Error:")
            explained = explained.withColumn("explanation_result", F.when(
                bad, rule_explain(F.col("anomaly_result"), F.col(cfg.id_col), node, comp, cfg.seed))
                .otherwise(F.col("explanation_result")))
    return prp.finalise(explained.drop("pos"), cfg.clean)
