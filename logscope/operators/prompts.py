"""Prompt building (PRM2-PRM10). Templates are data; the wording is ours, only the
placeholder names carry meaning. Every prompt is filled by concatenating
template pieces with column values, never by nested ``replace``."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.functions.render import fill_template, filename_hint, render_row, snippet
from logscope.operators.context import gather_context
from logscope.operators.prepare import RESULT_COLUMNS
from logscope.session import materialise

LABEL_TEMPLATE = """You are reviewing a system log for operational problems.

Anomalous line:
{log_str}

Surrounding and similar lines:
{context_str}

Classify the anomalous line as exactly one of: application, authentication, io, memory, network, other.
Answer with the category name only."""

EXPLANATION_TEMPLATE = """Explain the anomaly in the log line below for an on-call engineer.

Anomalous line:
{anomalous_log_str}

{label_str}

Surrounding and similar lines:
{context_str}

Give the likely cause and the first thing to check, in at most three sentences."""

FILE_TEMPLATE = """Review the log file `{filename}`.
The file name suggests this problem: {error_type}.

Highest-scoring lines, in file order:
{formatted_log_lines}

Name the most likely failure and explain the evidence in a few sentences."""

COMPACT_TEMPLATE = """Line under question:
{anomalous_str}

For comparison, lines around it:
{context_str}

Which difference between them matters, and what could have led to it?"""

RUN_TEMPLATE = """You classify the logs of one application run into one of these classes: {classes}.
Reply with the class only.
{content}"""

NO_CONTEXT = "No context lines available."

# Columns never rendered into a prompt: our position column, truth columns (rendering truth into
# the prompt leaks the answer) and lists of row ids (a popular row's list grows with the table).
HIDDEN = ("pos", "label", "labels", "true_label", "context_ids", "context_ids_ref")


def rendered_columns(df: DataFrame, exclude: Sequence[str] = HIDDEN) -> list[str]:
    skip = set(RESULT_COLUMNS) | set(exclude)
    return [c for c in df.columns if c not in skip]


def with_context_text(df: DataFrame, edges: DataFrame, id_col: str = "LineId", mode: str = "member",
                      exclude: Sequence[str] = HIDDEN, pos_col: str = "pos", flag_col: str = "anomaly",
                      compat: bool = True) -> DataFrame:
    """Add ``_row`` (the row rendered) and ``_context`` (its context rows, one per line,
    or the no-context text). Shared by label and explanation prompts, which render
    the same columns."""
    cols = rendered_columns(df, exclude)
    base = df.withColumn("_row", render_row(df, cols=cols))
    ctx = gather_context(edges, base, "_row", id_col, pos_col, flag_col, mode, compat)
    ctx = ctx.select(F.col("anomaly_id").alias("_cid"),
                     F.array_join("context_rows", "\n").alias("_context"))
    out = base.join(ctx, base[id_col] == ctx["_cid"], "left").drop("_cid")
    return out.withColumn("_context", F.coalesce(F.col("_context"), F.lit(NO_CONTEXT)))


def label_prompts(df: DataFrame, edges: DataFrame, threshold: float = 0.79, template: str = LABEL_TEMPLATE,
                  id_col: str = "LineId", score_col: str = "anomaly_score", mode: str = "member",
                  exclude: Sequence[str] = HIDDEN, pos_col: str = "pos", flag_col: str = "anomaly",
                  compat: bool = True, out: str = "anomaly_label") -> DataFrame:
    """Label prompt on rows with ``score >= threshold`` (else null): the row rendered as
    ``col: value; ...`` and its context rows, one per line."""
    x = with_context_text(df, edges, id_col, mode, exclude, pos_col, flag_col, compat)
    prompt = fill_template(template, {"log_str": F.col("_row"), "context_str": F.col("_context")})
    return x.withColumn(out, F.when(F.col(score_col) >= F.lit(threshold), prompt)).drop("_row", "_context")


def label_text(df: DataFrame, sources: Sequence[str] = ("label", "anomaly_result")) -> Column:
    """``Anomaly Label: x`` from the first non-null source column present, else ``unknown``."""
    present = [F.col(c) for c in sources if c in df.columns]
    return F.concat(F.lit("Anomaly Label: "), F.coalesce(*present, F.lit("unknown")) if present else F.lit("unknown"))


def explanation_prompts(df: DataFrame, edges: DataFrame, threshold: float = 0.79,
                        template: str = EXPLANATION_TEMPLATE, id_col: str = "LineId",
                        score_col: str = "anomaly_score", label_sources: Sequence[str] = ("label", "anomaly_result"),
                        mode: str = "member", exclude: Sequence[str] = HIDDEN, pos_col: str = "pos",
                        flag_col: str = "anomaly", compat: bool = True, out: str = "explanation_prompt") -> DataFrame:
    """Explanation prompt: as the label prompt, plus ``Anomaly Label: ...``."""
    lab = label_text(df, label_sources)
    x = with_context_text(df.withColumn("_label_str", lab), edges, id_col, mode,
                          tuple(exclude) + ("_label_str",), pos_col, flag_col, compat)
    prompt = fill_template(template, {"anomalous_log_str": F.col("_row"), "label_str": F.col("_label_str"),
                                      "context_str": F.col("_context")})
    return (x.withColumn(out, F.when(F.col(score_col) >= F.lit(threshold), prompt))
            .drop("_row", "_context", "_label_str"))


def compact_prompts(df: DataFrame, edges: DataFrame, id_col: str = "LineId", text_col: str = "message",
                    pos_col: str = "pos", flag_col: str = "anomaly", template: str = COMPACT_TEMPLATE) -> DataFrame:
    """``[id] content`` context lines (anomaly itself excluded), then the anomalous line.
    One row per anomaly: ``(anomaly_id, prompt)``."""
    card = F.concat(F.lit("["), F.col(id_col).cast("string"), F.lit("] "), F.coalesce(F.col(text_col), F.lit("None")))
    rows = df.select(F.col(id_col).alias("context_id"), F.col(pos_col).alias("context_pos"), card.alias("_card"))
    e = (edges.select("anomaly_id", "context_id").where(F.col("anomaly_id") != F.col("context_id"))
         .dropDuplicates(["anomaly_id", "context_id"]).join(rows, "context_id"))
    ctx = e.groupBy("anomaly_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("context_pos", "_card"))), lambda s: s["_card"]), "\n").alias("_ctx"))
    a = df.where(F.col(flag_col) == F.lit(True)).select(F.col(id_col).alias("anomaly_id"), card.alias("_self"))
    x = a.join(ctx, "anomaly_id", "left")
    prompt = fill_template(template, {"context_str": F.coalesce(F.col("_ctx"), F.lit("")),
                                      "anomalous_str": F.col("_self")})
    return x.select("anomaly_id", prompt.alias("prompt"))


def _with_one_row(df: DataFrame, one: DataFrame, col: str) -> DataFrame:
    """df with the columns of a one-row frame: an equality join on a key that is 0 everywhere (computed from a
    column, so that the optimizer keeps it a hash join)."""
    left = df.withColumn("_one", F.pmod(F.xxhash64(col), F.lit(1)))
    right = one.withColumn("_one", F.pmod(F.xxhash64(*one.columns), F.lit(1)))
    return left.join(F.broadcast(right), "_one").drop("_one")


KNOWN_SECTION = """
Problems seen before in such systems:
{known_labels}
Closest to the file name: {matched_label}. Say whether the lines bear that out.
"""


def file_prompts(df: DataFrame, file_col: str = "source_file", text_col: str = "m_message",
                 score_col: str = "pred_ano_proba", order_col: str = "line_no", template: str = FILE_TEMPLATE,
                 compat: bool = True, vocabulary: DataFrame | None = None, label_col: str = "label",
                 files: DataFrame | None = None) -> DataFrame:
    """One prompt per file from its name, the name's error hint and its snippet lines in
    file order. Apply after ``trim_to_budget``: the budget bounds each file's collect. With a
    ``vocabulary`` of known labels the prompt also lists them and names the one closest to the hint. With ``files`` (any
    table with the file column) each of its files gets a prompt, one without lines where the budget left none."""
    base = F.try_element_at(F.split(F.col(file_col), "/"), F.lit(-1))
    lines = df.select(file_col, order_col, snippet(F.col(text_col), F.col(score_col)).alias("_s"))
    g = lines.groupBy(file_col).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(order_col, "_s"))), lambda s: s["_s"]), "\n").alias("_lines"))
    if files is not None:
        named = files.select(F.col(file_col).alias("_named")).distinct()
        g = (named.join(g, F.col("_named").eqNullSafe(F.col(file_col)), "left")
             .select(F.col("_named").alias(file_col), F.coalesce("_lines", F.lit("")).alias("_lines")))
    g = g.withColumn("error_type", filename_hint(F.col(file_col), compat))
    values = {"filename": base, "error_type": F.col("error_type"), "formatted_log_lines": F.col("_lines")}
    if vocabulary is not None:
        # the list is part of every prompt, so the joined side is one row
        one = (vocabulary.select(F.col(label_col).alias("_l")).where("_l is not null")
               .agg(F.array_join(F.transform(F.sort_array(F.collect_set("_l")), lambda x: F.concat(F.lit("- "), x)), "\n").alias("_known")))
        g = _with_one_row(match_known_label(g, vocabulary, "error_type", label_col), one, file_col)
        values |= {"known_labels": F.col("_known"), "matched_label": F.coalesce(F.col("matched_label"), F.lit("none"))}
        template = template + KNOWN_SECTION
    return g.select(file_col, fill_template(template, values).alias("file_prompt"))


def line_cards(df: DataFrame, level: str = "Level", process: str = "Process", component: str = "Component",
               content: str = "Content", template_col: str = "EventTemplate") -> Column:
    """``Log Level: x. Process: x. Component: x. Content: x. EventTemplate: x`` (fixed values: field names and order)."""
    def v(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return F.concat(F.lit("Log Level: "), v(level), F.lit(". Process: "), v(process), F.lit(". Component: "),
                    v(component), F.lit(". Content: "), v(content), F.lit(". EventTemplate: "), v(template_col))


def run_prompts(df: DataFrame, classes: Sequence[str], run_cols: Sequence[str] = ("run_id",),
                content_col: str = "Content", order_col: str | None = None,
                template: str = RUN_TEMPLATE) -> DataFrame:
    """Run-level prompt: instruction + the run's content. With ``order_col``, lines of
    a run are first gathered in order (bound them with ``trim_to_budget``)."""
    classes_txt = "[" + ", ".join(f"'{c}'" for c in classes) + "]"
    run_cols = list(run_cols)
    if order_col is not None:
        df = df.groupBy(*run_cols).agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct(order_col, content_col))), lambda s: s[content_col]), "\n")
            .alias(content_col))
    prompt = fill_template(template, {"classes": F.lit(classes_txt), "content": F.col(content_col)})
    return df.select(*run_cols, prompt.alias("prompt"))


def run_prompt_lines(df: DataFrame, classes: Sequence[str], run_cols: Sequence[str] = ("run_id",),
                     content_col: str = "Content", order_col: str = "line_no", template: str = RUN_TEMPLATE) -> DataFrame:
    """The prompts of ``run_prompts`` as lines ``(run columns, part, order, line)`` that are never gathered: part 0 is the text before
    the content, 1 the content, 2 the text after it. In order of (run, part, order) the lines joined by line breaks are the
    prompt. ``sinks.write_ordered_lines`` streams them to files, whatever a run's length. A null content line is left out, as
    ``run_prompts`` does; a run of only such lines keeps its frame. The content must stand alone in its template line."""
    run_cols = list(run_cols)
    head, tail = template.split("{content}")
    if head and not head.endswith("\n") or tail and not tail.startswith("\n"):
        raise ValueError("the content must stand alone in its line of the template")
    classes_txt = "[" + ", ".join(f"'{c}'" for c in classes) + "]"
    text = lambda t: fill_template(t, {"classes": F.lit(classes_txt)})
    frame = [F.struct(F.lit(n).alias("part"), text(t).alias("line")) for n, t in ((0, head[:-1]), (2, tail[1:])) if t]
    kind = df.schema[order_col].dataType
    out = df.where(F.col(content_col).isNotNull()).select(
        *run_cols, F.lit(1).alias("part"), F.col(order_col), F.col(content_col).alias("line"))
    if frame:
        runs = df.select(*run_cols).distinct().select(*run_cols, F.explode(F.array(*frame)).alias("f"))
        out = out.unionByName(runs.select(*run_cols, "f.part", F.lit(None).cast(kind).alias(order_col), "f.line"))
    return out


def prompt_variants(df: DataFrame, prompt_col: str, strategies: Mapping[str, str],
                    demos: DataFrame | None = None, demo_text: str = "text", demo_label: str = "label") -> DataFrame:
    """One row per (input, strategy). ``strategies`` maps a name to a template with
    ``{input}`` and optionally ``{examples}`` (few-shot demos, all of them, ordered by ``demo_no``).

    The strategy table is a handful of literals. The demos become one text, which is part of every
    prompt anyway, so the joined side is one row.
    """
    x = df
    examples = F.lit("")
    if demos is not None:
        card = F.concat(F.lit("Text: "), F.coalesce(F.col(demo_text), F.lit("")), F.lit("\nLabel: "), F.coalesce(F.col(demo_label), F.lit("")))
        one = demos.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("demo_no", card.alias("c")))), lambda s: s["c"]), "\n")
                        .alias("_examples"))
        x = _with_one_row(x, one, prompt_col)
        examples = F.col("_examples")
    x = x.withColumn("strategy", F.explode(F.array(*[F.lit(n) for n in strategies])))
    out = F.lit(None).cast("string")
    for n, template in strategies.items():
        filled = fill_template(template, {"input": F.col(prompt_col), "examples": examples})
        out = F.when(F.col("strategy") == n, filled).otherwise(out)
    return x.withColumn("variant_prompt", out).drop("_examples")


def _norm_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


_CELL_LABELS = 4_096
# edit distances tried in turn by the segment index; hints farther than the last from every label are measured
NEAR_EDITS = (2, 6)


def _edit_candidates(hints: DataFrame, labels: DataFrame, d: int) -> DataFrame:
    """Pairs ``(_hn, _vn)`` that hold every pair within ``d`` edits, by equality joins only.

    A label of n characters is cut into d + 1 segments. At most d of them are touched by d edits, so one stands unchanged in
    the hint, moved by at most d places. Labels of at most d characters have no segments and are met by their length.
    """
    n, i = F.length("_vn"), F.col("_i")
    start = (i * F.col("_n") / (d + 1)).cast("int")
    segments = (labels.withColumn("_n", n).where(F.col("_n") > d)
                .select("_vn", "_n", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_i"))
                .withColumn("_s", start).withColumn("_l", ((i + 1) * F.col("_n") / (d + 1)).cast("int") - start)
                .select("_vn", "_n", "_i", F.expr("substring(_vn, _s + 1, _l)").alias("_seg")))
    # what of a hint may equal segment i of a label of n characters, only for lengths that labels have
    lengths = labels.select(n.alias("_n")).distinct()
    sized = hints.withColumn("_h", F.length("_hn")).withColumn(
        "_n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_h") - d), F.col("_h") + d))).join(lengths, "_n")
    grams = (sized.where(F.col("_n") > d)
             .select("_hn", "_h", "_n", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_i"))
             .withColumn("_s", start).withColumn("_l", ((i + 1) * F.col("_n") / (d + 1)).cast("int") - start)
             .withColumn("_from", F.greatest(F.lit(0), F.col("_s") - d))
             .withColumn("_to", F.least(F.col("_h") - F.col("_l"), F.col("_s") + d)).where("_from <= _to")
             .select("_hn", "_n", "_i", "_l", F.explode(F.sequence("_from", "_to")).alias("_p"))
             .select("_hn", "_n", "_i", F.expr("substring(_hn, _p + 1, _l)").alias("_seg")).distinct())
    short = sized.where(F.col("_n") <= d).select("_hn", "_n").join(
        labels.select("_vn", n.alias("_n")), "_n").select("_hn", "_vn")
    return grams.join(segments, ["_n", "_i", "_seg"]).select("_hn", "_vn").unionByName(short).distinct()


def _nearest_labels(hints: DataFrame, labels: DataFrame) -> DataFrame:
    """All labels at the least edit distance of each hint: ``(_hn, _vn)`` over distinct normalised texts."""
    out, left = None, hints
    for d in NEAR_EDITS:
        pairs = _edit_candidates(left, labels, d).withColumn("_lev", F.levenshtein("_hn", "_vn", d)).where("_lev >= 0")
        pairs = materialise(pairs)
        least = pairs.groupBy("_hn").agg(F.min("_lev").alias("_lev"))
        found = pairs.join(least, ["_hn", "_lev"]).select("_hn", "_vn")
        out = found if out is None else out.unionByName(found)
        left = materialise(left.join(least.select("_hn"), "_hn", "left_anti"))
        if left.isEmpty():
            return out
    # farther than the index reaches: such a hint resembles no label, yet its nearest is defined. Labels are spread over as many
    # join keys as their number asks for
    cells = labels.count() // _CELL_LABELS + 1
    rest = left.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).join(
        labels.withColumn("_c", F.pmod(F.xxhash64("_vn"), F.lit(cells)).cast("int")), "_c")
    far = rest.groupBy("_hn").agg(F.min(F.struct(F.levenshtein("_hn", "_vn").alias("l"), F.col("_vn").alias("v"))).alias("_b"))
    return out.unionByName(far.select("_hn", F.col("_b.v").alias("_vn")))


def match_known_label(df: DataFrame, vocab: DataFrame, hint_col: str = "error_type",
                      label_col: str = "label", key_col: str | None = None) -> DataFrame:
    """Match a hint to a known-label vocabulary: exact after normalising, else the
    best token Jaccard, else the smallest edit distance.

    Vocabulary and distinct hints stay DataFrames of any size. An equal text or a shared token is found
    by an equality join on tokens. Hints that share no token with any label go to an index of label segments, which finds
    every label within ``NEAR_EDITS[-1]`` edits by equality joins; only a hint farther than that from all
    labels is measured against them one by one. Ties go to the least label.
    """
    hints = df.select(F.col(hint_col).alias("_hint")).where(F.col("_hint").isNotNull()).distinct()
    h = hints.withColumn("_hn", _norm_label(F.col("_hint"))).withColumn("_ht", F.split(F.col("_hn"), " "))
    v = (vocab.select(F.col(label_col).alias("_label")).where(F.col("_label").isNotNull()).distinct()
         .withColumn("_vn", _norm_label(F.col("_label")))).withColumn("_vt", F.split(F.col("_vn"), " "))
    token = lambda c: F.explode(F.array_distinct(c)).alias("_tok")
    shared = (h.select("_hint", token(F.col("_ht"))).join(v.select("_label", token(F.col("_vt"))), "_tok")
              .select("_hint", "_label").distinct())
    alone = h.join(shared.select("_hint").distinct(), "_hint", "left_anti").select("_hint", "_hn")
    near = _nearest_labels(alone.select("_hn").distinct(), v.select("_vn").distinct())
    rest = alone.join(near, "_hn").join(v.select("_label", "_vn"), "_vn")
    pairs = shared.unionByName(rest.select("_hint", "_label")).join(h, "_hint").join(v, "_label").select(
        "_hint", "_label",
        (F.col("_hn") == F.col("_vn")).cast("int").alias("_exact"),
        (F.size(F.array_intersect("_ht", "_vt")) / F.size(F.array_union("_ht", "_vt"))).alias("_jac"),
        F.levenshtein("_hn", "_vn").alias("_lev"))
    best_order = F.struct((-F.col("_exact")).alias("e"), (-F.col("_jac")).alias("j"), F.col("_lev").alias("l"), F.col("_label").alias("n"))
    best = pairs.groupBy("_hint").agg(F.min(best_order).alias("_b")).select(
        "_hint", F.col("_b.n").alias("matched_label"), F.round(-F.col("_b.j"), 6).alias("match_jaccard"),
        F.col("_b.l").alias("match_distance"))
    return df.join(best, df[hint_col] == best["_hint"], "left").drop("_hint")
