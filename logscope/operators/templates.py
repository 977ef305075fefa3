"""Message template mining (TPL1-TPL5). Work runs on distinct messages and joins
back: log text repeats heavily, so the distinct set is far smaller than the rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.operators.components import components
from logscope.session import materialise

WILDCARD = "<*>"


def _tokens(text):
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def templates_iplom(df: DataFrame, text_col: str = "e_message_normalized") -> DataFrame:
    """IPLoM-style templates, set-based: partition by token count, split each partition
    by the token at its least-varying position (more than one value but not one per
    message; leftmost on ties),
    then positions with one distinct token are constant, the others ``<*>``.
    -> ``df + (event_id, template)``; ``event_id`` is the md5 of the template."""
    texts = df.select(F.col(text_col).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    texts = texts.withColumn("_tok", _tokens(F.col("_text"))).withColumn("_n", F.size("_tok"))
    pos = texts.select("_text", "_n", F.posexplode("_tok").alias("_p", "_w"))
    card = pos.groupBy("_n", "_p").agg(F.count_distinct("_w").alias("_c"))
    size = texts.groupBy("_n").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.partitionBy("_n").orderBy(F.col("_c").asc(), F.col("_p").asc())
    # a position where every message differs is a variable, not a split criterion
    split = (card.join(size, "_n").where((F.col("_c") > 1) & (F.col("_c") < F.col("_size")))
             .withColumn("_r", F.row_number().over(w)).where("_r = 1")
             .select("_n", F.col("_p").alias("_sp")))
    t = texts.join(split, "_n", "left")
    t = t.withColumn("_key", F.when(F.col("_sp").isNull(), F.lit("")).otherwise(F.element_at("_tok", F.col("_sp") + 1)))
    pos = pos.join(t.select("_text", "_key"), "_text")
    const = pos.groupBy("_n", "_key", "_p").agg(F.count_distinct("_w").alias("_c"), F.min("_w").alias("_w"))
    const = const.withColumn("_w", F.when(F.col("_c") == 1, F.col("_w")).otherwise(F.lit(WILDCARD)))
    tmpl = const.groupBy("_n", "_key").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_w"))), lambda s: s["_w"]), " ")
        .alias("template"))
    mapping = t.join(tmpl, ["_n", "_key"]).select("_text", "template")
    mapping = mapping.withColumn("event_id", F.md5("template"))
    return df.join(mapping, df[text_col] == mapping["_text"], "left").drop("_text")


def _masked_texts(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(_text, _t1, _t2)`` of the distinct texts, and their distinct masked messages ``(_id, _t1, _t2, _w rows, _tok, _n)``, both written."""
    text = F.col(text_col)
    raw = df.where(text.isNotNull()).groupBy(text.alias("_text")).agg(F.count(F.lit(1)).alias("_w"))
    raw = raw.withColumn("_tok", _masked(_tokens(F.col("_text"))))
    raw = materialise(raw.select("_text", "_w", "_tok", *_text_id(F.array_join("_tok", " "))))
    masked = raw.groupBy("_t1", "_t2").agg(F.sum("_w").alias("_w"), F.first("_tok").alias("_tok"))
    masked = materialise(masked.withColumn("_n", F.size("_tok")).withColumn("_id", F.monotonically_increasing_id()))
    return raw.select("_text", "_t1", "_t2"), masked


def _with_templates(df: DataFrame, text_col: str, raw: DataFrame, masked: DataFrame, words: DataFrame) -> DataFrame:
    """``df`` with the templates whose words are ``(_id, _p, _x)``; a message without tokens has the empty template."""
    shown = words.groupBy("_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_x"))), lambda s: s["_x"]), " ").alias("template"))
    mapping = masked.select("_id", "_t1", "_t2").join(shown, "_id", "left").select("_t1", "_t2", F.coalesce("template", F.lit("")).alias("template"))
    mapping = raw.join(mapping, ["_t1", "_t2"]).select("_text", "template", F.md5("template").alias("event_id"))
    return df.join(mapping, df[text_col] == mapping["_text"], "left").drop("_text")


def templates_brain(df: DataFrame, text_col: str = "e_message_normalized", branches: int = 2) -> DataFrame:
    """Brain-style templates (Yu et al. 2023): a root pattern of equally frequent words, and a tree that grows from it in two directions.

    * Tokens with a digit are ``<*>``; equal masked messages are one message with a row count. A word's frequency is the number of rows with
      as many tokens that hold it at its position.
    * A message's words of one frequency are a combination. The one of most words (then of the greater frequency) is its root pattern; messages
      of one token count and root pattern are a group.
    * Towards the parents: a word more frequent than the root stays where the group has one word at that position only.
      Towards the children: a less frequent word stays where the group has at most ``branches`` of them, each a branch
      of its own. All else is ``<*>``.

    -> ``df + (event_id, template)``; null text has neither. Only aggregates and equality joins on distinct masked messages."""
    raw, masked = _masked_texts(df, text_col)
    tokens = masked.select("_id", "_n", "_w", F.posexplode("_tok").alias("_p", "_x"))
    freq = tokens.groupBy("_n", "_p", "_x").agg(F.sum("_w").alias("_f"))
    tokens = materialise(tokens.join(freq, ["_n", "_p", "_x"]).drop("_w"))
    plain = tokens.where(F.col("_x") != WILDCARD)
    root = (plain.groupBy("_id", "_f").agg(F.count(F.lit(1)).alias("_c"), F.sort_array(F.collect_list(F.struct("_p", "_x"))).alias("_l"))
            .groupBy("_id").agg(F.max_by(F.struct("_f", "_l"), F.struct("_c", "_f")).alias("_r")))
    key = F.md5(F.coalesce(F.array_join(F.transform("_r._l", lambda s: F.concat(s["_p"].cast("string"), F.lit(" "), s["_x"])), "\n"), F.lit("")))
    tokens = materialise(tokens.join(root.select("_id", F.col("_r._f").alias("_rf"), key.alias("_key")), "_id", "left")
                         .withColumn("_key", F.coalesce("_key", F.lit(""))))
    column = tokens.groupBy("_n", "_key", "_p").agg(F.count_distinct("_x").alias("_d"))
    stays = (F.col("_f") == F.col("_rf")) | ((F.col("_f") > F.col("_rf")) & (F.col("_d") == 1)) | ((F.col("_f") < F.col("_rf")) & (F.col("_d") <= branches))
    words = tokens.join(column, ["_n", "_key", "_p"]).select("_id", "_p", F.when(stays, F.col("_x")).otherwise(F.lit(WILDCARD)).alias("_x"))
    return _with_templates(df, text_col, raw, masked, words)


def templates_drain(df: DataFrame, text_col: str = "e_message_normalized", depth: int = 2,
                    sim_threshold: float = 0.4) -> DataFrame:
    """Drain-style templates (He et al. 2017) as a set: the tree's leaves, and clusters of similar messages inside a leaf.

    * Tokens with a digit are ``<*>``; equal masked messages are one message. A leaf holds the messages of one token count
      and one beginning of ``depth`` tokens.
    * Two messages of a leaf are similar when at least ``sim_threshold`` of their positions hold the same token. A cluster is
      a connected component, so the result does not depend on an order of arrival, as the online form's does.
    * A position of the template is the cluster's one token there, or ``<*>``.

    Exact without comparing all messages of a leaf. Positions with one token in the whole leaf agree in each pair; where they are enough
    the leaf is one cluster. Otherwise ``r`` more positions must agree: of a message's ``t`` tokens that some other message
    of the leaf has too, taken from the rarest on, the first ``t - r + 1`` meet those of any similar message. Messages that
    share such a token are compared with the least of them first; only tokens whose messages are in several components after that are paired.
    -> ``df + (event_id, template)``; null text has neither."""
    raw, masked = _masked_texts(df, text_col)
    masked = masked.withColumn("_leaf", F.xxhash64("_n", F.slice("_tok", 1, depth)))
    head = F.slice("_tok", 1, depth)
    tokens = masked.select("_id", "_leaf", "_n", head.alias("_head"), F.posexplode("_tok").alias("_p", "_x"))
    freq = tokens.groupBy("_leaf", "_n", "_head", "_p", "_x").agg(F.count(F.lit(1)).alias("_f"))
    size = masked.groupBy("_leaf", "_n", head.alias("_head")).agg(F.count(F.lit(1)).alias("_size"))
    leaf = ["_leaf", "_n", "_head"]
    freq = freq.join(size, leaf)
    agreed = freq.where(F.col("_f") == F.col("_size")).groupBy(*leaf).agg(F.count(F.lit(1)).alias("_const"))
    need = size.join(agreed, leaf, "left").select(*leaf, (F.ceil(F.lit(float(sim_threshold)) * F.col("_n")) - F.coalesce("_const", F.lit(0))).alias("_r"))
    need = materialise(need)
    # whole leaves: a star around the least message
    whole = masked.withColumn("_head", head).join(need.where("_r <= 0"), leaf)
    edges = whole.groupBy(*leaf).agg(F.min("_id").alias("b")).join(whole.select(*leaf, F.col("_id").alias("a")), leaf).select("a", "b")
    shared = freq.where((F.col("_f") > 1) & (F.col("_f") < F.col("_size"))).drop("_size").join(need.where("_r > 0"), leaf)
    lists = (tokens.join(shared, [*leaf, "_p", "_x"]).groupBy("_id", "_leaf", "_r")
             .agg(F.sort_array(F.collect_list(F.struct("_f", "_p", "_x"))).alias("_l")).where(F.size("_l") >= F.col("_r")))
    lists = materialise(lists.select("_id", "_leaf", "_r", F.transform("_l", lambda s: F.concat(s["_p"].cast("string"), F.lit(" "), s["_x"])).alias("_l")))
    keys = materialise(lists.select("_id", "_leaf", F.explode(F.slice("_l", F.lit(1), (F.size("_l") - F.col("_r") + 1).cast("int"))).alias("_k")))
    found = _linked(keys, edges, lambda pairs: _similar(pairs, lists))
    tokens = tokens.join(found.withColumnRenamed("id", "_id"), "_id", "left").select("_id", "_p", "_x", F.coalesce("comp", "_id").alias("_comp"))
    column = tokens.groupBy("_comp", "_p").agg(F.when(F.min("_x") == F.max("_x"), F.min("_x")).otherwise(F.lit(WILDCARD)).alias("_t"))
    words = tokens.join(column, ["_comp", "_p"]).select("_id", "_p", F.col("_t").alias("_x"))
    return _with_templates(df, text_col, raw, masked, words)


def _linked(keys: DataFrame, edges: DataFrame, similar) -> DataFrame:
    """``(id, comp)`` of the messages that ``edges`` or ``similar`` (pairs -> the similar ones) link. Candidates share a key ``(_leaf, _k)``: the
    least message of a key is compared with all others, then only keys whose messages are in several components are paired."""
    least = keys.groupBy("_leaf", "_k").agg(F.min("_id").alias("b"))
    stars = similar(keys.join(least, ["_leaf", "_k"]).select(F.col("_id").alias("a"), "b"))
    found = materialise(components(edges.unionByName(stars)))
    keys = keys.join(found.withColumnRenamed("id", "_id"), "_id", "left").withColumn("comp", F.coalesce("comp", "_id"))
    apart = keys.groupBy("_leaf", "_k").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi")
    open_ = keys.join(apart.select("_leaf", "_k"), ["_leaf", "_k"])
    other = open_.select("_leaf", "_k", F.col("_id").alias("b"), F.col("comp").alias("_oc"))
    pairs = open_.withColumnRenamed("_id", "a").join(other, ["_leaf", "_k"]).where("comp < _oc").select("a", "b")
    return materialise(components(found.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(similar(pairs))))


def _similar(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose lists share at least ``_r`` tokens."""
    pairs = pairs.where("a <> b").distinct()
    left, right = lists.select(F.col("_id").alias("a"), "_r", F.col("_l").alias("_la")), lists.select(F.col("_id").alias("b"), F.col("_l").alias("_lb"))
    return pairs.join(left, "a").join(right, "b").where(F.size(F.array_intersect("_la", "_lb")) >= F.col("_r")).select("a", "b")


def _matched(x: list, y: list) -> list[int]:
    """Places of ``x`` in a longest common subsequence with ``y`` (bit-parallel: one integer holds a row of the table, a zero bit is a step)."""
    at: dict = {}
    for i, t in enumerate(x):
        at[t] = at.get(t, 0) | 1 << i
    full = (1 << len(x)) - 1
    rows = [full]
    for t in y:
        held = rows[-1] & at.get(t, 0)
        rows.append(((rows[-1] + held) | (rows[-1] - held)) & full)
    out, i, j = [], len(x), len(y)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif rows[j - 1] >> (i - 1) & 1:
            i, j = i - 1, j - 1
            out.append(i)
        else:
            j -= 1
    return out[::-1]


def _alignments(batches):
    """``_m``: the places of ``_x`` that a longest common subsequence with ``_y`` keeps."""
    for pdf in batches:
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "_m": [_matched(list(x), list(y)) for x, y in zip(pdf["_x"], pdf["_y"])]})


def _aligned(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """``(a, b, _m)`` for distinct pairs of ids."""
    x, y = seqs.select(F.col("_id").alias("a"), F.col("_s").alias("_x")), seqs.select(F.col("_id").alias("b"), F.col("_s").alias("_y"))
    return pairs.distinct().join(x, "a").join(y, "b").mapInPandas(_alignments, "a long, b long, _m array<int>")


def templates_spell(df: DataFrame, text_col: str = "e_message_normalized") -> DataFrame:
    """Spell-style templates (Du and Li 2016) as a set: messages with long common subsequences.

    * Tokens with a digit are left out; equal masked messages are one message. Two messages are similar when their longest common
      subsequence of tokens holds at least half of the tokens of either. A cluster is a connected component, whatever
      the order of arrival.
    * The template holds the tokens of the cluster's first message (in text order) that its subsequences with all others keep.

    Exact without comparing all messages: of ``n`` tokens (a repeated one counted by its occurrence) at least ``ceil(n / 2)`` must be
    shared, so the rarest ``n - ceil(n / 2) + 1`` meet those of any similar message. Subsequences are found bit-parallel, pair by pair in Arrow
    batches; no group of messages is one task. -> ``df + (event_id, template)``; null text has neither."""
    raw, masked = _masked_texts(df, text_col)
    seqs = materialise(masked.select("_id", F.filter("_tok", lambda w: w != WILDCARD).alias("_s"), F.array_join("_tok", " ").alias("_mask")))
    tokens = seqs.select("_id", F.size("_s").alias("_n"), F.posexplode("_s").alias("_p", "_x"))
    nth = F.row_number().over(Window.partitionBy("_id", "_x").orderBy("_p"))
    tokens = tokens.withColumn("_x", F.concat(nth.cast("string"), F.lit(" "), F.col("_x")))
    freq = tokens.groupBy("_x").agg(F.count(F.lit(1)).alias("_f"))
    lists = tokens.join(freq, "_x").groupBy("_id", "_n").agg(F.sort_array(F.collect_list(F.struct("_f", "_x"))).alias("_l"))
    keys = lists.select("_id", F.lit(0).alias("_leaf"), F.explode(F.slice("_l", F.lit(1), (F.floor(F.col("_n") / 2) + 1).cast("int"))).alias("_k"))
    keys = materialise(keys.where("_k._f > 1").select("_id", "_leaf", F.col("_k._x").alias("_k")))
    size = seqs.select(F.col("_id").alias("_i"), F.size("_s").alias("_n"))

    def similar(pairs: DataFrame) -> DataFrame:
        found = _aligned(pairs.where("a <> b"), seqs)
        for c in "ab":
            found = found.join(size, F.col(c) == F.col("_i")).where(2 * F.size("_m") >= F.col("_n")).select("a", "b", "_m")
        return found.select("a", "b")

    found = _linked(keys, seqs.select(F.col("_id").alias("a"), F.col("_id").alias("b")).limit(0), similar)
    member = materialise(seqs.select("_id", "_mask").join(found.withColumnRenamed("id", "_id"), "_id", "left").withColumn("comp", F.coalesce("comp", "_id")))
    first = member.groupBy("comp").agg(F.min_by("_id", "_mask").alias("a"), F.count(F.lit(1)).alias("_c"))
    kept = _aligned(member.join(first, "comp").select("a", F.col("_id").alias("b")), seqs)
    kept = kept.select("a", F.explode("_m").alias("_p")).groupBy("a", "_p").agg(F.count(F.lit(1)).alias("_k"))
    kept = kept.join(first.select("a", "_c"), "a").where(F.col("_k") == F.col("_c"))
    words = seqs.select(F.col("_id").alias("a"), F.posexplode("_s").alias("_p", "_x")).join(kept, ["a", "_p"]).select("a", "_p", "_x")
    words = member.join(first, "comp").select("_id", "a").join(words, "a").select("_id", "_p", "_x")
    return _with_templates(df, text_col, raw, masked, words)


def _masked(tokens):
    """Tokens with a digit as wildcards."""
    return F.transform(tokens, lambda w: F.when(w.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(w))


def _collapsed(tokens):
    """Runs of wildcards as one."""
    return F.filter(tokens, lambda w, i: (w != WILDCARD) | (i == 0) | (F.get(tokens, i - 1) != WILDCARD))


def _text_id(text) -> list:
    """Two 64-bit hashes that stand for a text in joins."""
    return [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit("#"), text).alias("_t2")]


def templates_tip(df: DataFrame, text_col: str = "e_message_normalized", threshold: float = 0.5, support: int = 2) -> DataFrame:
    """Token-interdependency templates: messages are known by the tokens that imply each other.

    * Tokens with a digit become ``<*>``; equal masked messages are one message with a row count, and the work below is
      done once for each. Tokens in fewer than ``support`` rows leave before any pair is made.
    * Two tokens depend on each other when each stands in at least ``threshold`` of the other's rows:
      ``n(a, b) >= threshold * max(n(a), n(b))``. Such a token has at most (mean message length / threshold) partners.
    * A message's anchor is its token with the most partners in the message (then the more frequent, then the first in
      text order). Anchor and partners are its key tokens; messages with one set of key tokens are one event.
    * An event's template is its most frequent skeleton: key tokens as they stand, each run of others one ``<*>``
      (on ties the first in text order). A message without key tokens is an event by its skeleton.

    Pairs are made by two explodes (never one array of all pairs) and counted with a combine before the shuffle: their number
    grows with the distinct masked messages. -> ``df + (event_id, template)``; null text has neither."""
    text = F.col(text_col)
    raw = df.where(text.isNotNull()).groupBy(text.alias("_text")).agg(F.count(F.lit(1)).alias("_w"))
    raw = raw.withColumn("_tok", _masked(_tokens(F.col("_text")))).withColumn("_mask", F.array_join("_tok", " "))
    raw = materialise(raw.select("_text", "_w", "_tok", *_text_id(F.col("_mask"))))
    masked = raw.groupBy("_t1", "_t2").agg(F.sum("_w").alias("_w"), F.first("_tok").alias("_tok"))
    masked = materialise(masked)
    held = masked.select("_t1", "_t2", "_w", F.explode(F.array_distinct("_tok")).alias("_a")).where(F.col("_a") != WILDCARD)
    counts = held.groupBy("_a").agg(F.sum("_w").alias("_n")).where(F.col("_n") >= support)
    held = materialise(held.join(counts, "_a"))  # (message, token, rows of the message, rows of the token)
    lists = held.groupBy("_t1", "_t2", "_w").agg(F.sort_array(F.collect_list(F.struct("_a", "_n"))).alias("_l"))
    pairs = (lists.select("_w", "_l", F.posexplode("_l").alias("_i", "_x"))
             .select("_w", "_x", F.explode(F.slice("_l", F.col("_i") + 2, F.size("_l"))).alias("_y"))
             .groupBy(F.col("_x._a").alias("_a"), F.col("_y._a").alias("_b"), F.col("_x._n").alias("_na"), F.col("_y._n").alias("_nb"))
             .agg(F.sum("_w").alias("_nab"))
             .where(F.col("_nab") >= F.greatest("_na", "_nb") * F.lit(threshold)).select("_a", "_b"))
    pairs = materialise(pairs)
    pairs = pairs.unionByName(pairs.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    present = held.select("_t1", "_t2", F.col("_a").alias("_b"))
    partners = (held.join(pairs, "_a").join(present, ["_t1", "_t2", "_b"])
                .groupBy("_t1", "_t2", "_a", "_n").agg(F.collect_list("_b").alias("_p")))
    partners = held.select("_t1", "_t2", "_a", "_n").join(partners.drop("_n"), ["_t1", "_t2", "_a"], "left")
    order = F.struct(-F.size(F.coalesce("_p", F.array().cast("array<string>"))), -F.col("_n"), F.col("_a"))
    best = partners.groupBy("_t1", "_t2").agg(F.min_by(F.struct("_a", "_p"), order).alias("_best"))
    keys = best.select("_t1", "_t2", F.array_sort(F.concat(F.array("_best._a"), F.coalesce("_best._p", F.array().cast("array<string>")))).alias("_keys"))
    found = masked.join(keys, ["_t1", "_t2"], "left").withColumn("_keys", F.coalesce("_keys", F.array().cast("array<string>")))
    found = found.withColumn("_skeleton", F.array_join(_collapsed(F.transform(
        "_tok", lambda w: F.when(F.array_contains("_keys", w), w).otherwise(F.lit(WILDCARD)))), " "))
    found = found.select("_t1", "_t2", "_w", "_skeleton", F.when(F.size("_keys") > 0, F.array_join("_keys", " ")).alias("_event"))
    found = materialise(found.withColumn("_event", F.coalesce(F.concat(F.lit("k "), "_event"), F.concat(F.lit("s "), "_skeleton"))))
    votes = found.groupBy("_event", "_skeleton").agg(F.sum("_w").alias("_w"))
    shown = votes.groupBy("_event").agg(F.min_by("_skeleton", F.struct(-F.col("_w"), F.col("_skeleton"))).alias("template"))
    mapping = (raw.select("_text", "_t1", "_t2").join(found.join(shown, "_event").select("_t1", "_t2", "_event", "template"), ["_t1", "_t2"])
               .select("_text", F.md5("_event").alias("event_id"), "template"))
    return df.join(mapping, df[text_col] == mapping["_text"], "left").drop("_text")


def templates(df: DataFrame, method: str = "iplom", text_col: str = "e_message_normalized") -> DataFrame:
    """Dispatch by method name: iplom, brain, drain, spell, tip."""
    return {"iplom": templates_iplom, "pliplom": templates_iplom, "brain": templates_brain,
            "drain": templates_drain, "spell": templates_spell, "tip": templates_tip}[method](df, text_col)
