"""Quality rules: cross-document line frequency (DataFrame functions only).

Every line with a word is normalised (lower case, white space runs as one space,
ends trimmed) and hashed. Per host the number of distinct documents holding a
line is counted, after taking each line once per document, so a line repeated
inside one document counts once. A line is boilerplate in a host when more than
``max(min_docs, share * documents of the host)`` documents hold it; such lines
are removed, and a document that keeps less than ``min_left`` of its words is
rejected as depleted.

Skew: a very common line on a host with a third of all rows is one aggregation
key; partial aggregation reduces it to one row per map task. Lines at or below
``min_docs`` are dropped before the lines meet their hosts' totals, and only
hits come back to the documents.

Defined results: null or empty text has no words, fails the base rules and is
not kept; a null host is a host of its own; repeated rows are separate
documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a lambda variable instead of a repeated expression)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, n: int = 5) -> Column:
    """Words inside n-word windows that occur at least twice in the text, by sorting window hashes."""
    def from_hashes(h: Column) -> Column:
        windows = F.when(F.size(h) >= n, F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])
        )).otherwise(F.array().cast("array<bigint>"))
        return _let(windows, lambda w: F.when(F.size(w) == F.size(F.array_distinct(w)), F.lit(0)).otherwise(from_windows(w)))

    def from_windows(w: Column) -> Column:
        ranked = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return _let(ranked, lambda s: _let(F.sort_array(F.transform(F.filter(
            s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))),
            lambda x: x["p"])), covered))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(n), x - F.get(p, i - 1)), F.lit(n)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return _let(F.transform(words, lambda x: F.xxhash64(x)), from_hashes).cast("long")


def line_measures(docs: DataFrame, host: str) -> DataFrame:
    """One row per document: the base counts, and its lines as (hash, words) in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id"), F.col(host).cast("string").alias("_host"), text.alias("_t"))
    d = d.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    lines = F.transform("_l", lambda x: F.struct(
        F.xxhash64(F.lower(F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))).alias("h"),
        F.regexp_count(x, F.lit(WORD)).cast("long").alias("n")))
    return d.select(
        "doc_id", "_host",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        lines.alias("_lines"))


def quality_rules(docs: DataFrame, host: str = "source", min_docs: int = 5, share: float = 0.02,
                  min_left: float = 0.5) -> DataFrame:
    """Measures and verdict per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_removed_words, base_failed, kept."""
    # narrow rows, read several times; the copy also fixes the row numbers
    d = materialise(line_measures(docs, host).withColumn("_row", F.monotonically_increasing_id()))
    once = d.select("_host", F.explode(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("_h"))
    common = once.groupBy("_host", "_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_docs)
    hosts = d.groupBy("_host").agg((F.count(F.lit(1)) * F.lit(share)).alias("_limit"))
    # null-safe keys: a null host is a host of its own
    common = common.join(hosts, common["_host"].eqNullSafe(hosts["_host"])).where("_n > _limit").select(
        F.xxhash64(F.coalesce(common["_host"], F.lit("\0")), "_h").alias("_k"))
    held = d.select("_row", "_host", F.explode("_lines").alias("_x")).select(
        "_row", F.xxhash64(F.coalesce("_host", F.lit("\0")), "_x.h").alias("_k"), F.col("_x.n").alias("_n"))
    hits = held.join(common, "_k").groupBy("_row").agg(F.sum("_n").alias("n_removed_words"))
    out = d.join(hits, "_row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words",
                      failed.alias("base_failed"), (~failed & (left >= F.lit(min_left) * F.col("n_words"))).alias("kept"))


ORACLE = r"""
with d as (select doc_id, source, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
l0 as (select r, source, unnest(string_split(t, chr(10))) as line from d),
l1 as (select r, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
       lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) as norm from l0 where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) - count(distinct line) as n_dup from l1 group by r),
hosts as (select source, count(*) as docs from d group by source),
common as (select l1.source, norm from l1 join hosts on l1.source is not distinct from hosts.source
           group by l1.source, norm, docs having count(distinct r) > 5 and count(distinct r) > docs * 0.02),
gone as (select l1.r, sum(n) as removed from l1 join common c on l1.source is not distinct from c.source and l1.norm = c.norm group by l1.r),
win as (select r, i, array_to_string(list_slice(ws, i, i + 4), ' ') as g
        from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as c from win) where c > 1),
cov as (select r, count(distinct i + k) as n_rep from rep, range(0, 5) as t(k) group by r)
select d.doc_id, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
       len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup, 0) as n_dup_lines, coalesce(n_rep, 0) as n_repeat_words,
       coalesce(removed, 0)::bigint as n_removed_words,
       (len(ws) < 10 or 100 * coalesce(n_rep, 0) > 20 * len(ws)) as base_failed,
       (not (len(ws) < 10 or 100 * coalesce(n_rep, 0) > 20 * len(ws)) and len(ws) - coalesce(removed, 0) >= 0.5 * len(ws)) as kept
from d join w using (r) left join dup using (r) left join cov using (r) left join gone using (r)
"""
