"""URL filters: temporal list join (DataFrame functions only).

A block list arrives as dated entries: a pattern is added or removed at a time.
Per pattern the entries become validity intervals (from its time until the next
entry's), and each capture is evaluated against the entries active when it was
fetched: an as-of join written as an equality on the pattern key plus an
interval test.

A capture's URL gives the keys ``d:<host suffix>`` (every suffix of the host at a
label border, the whole host included) and ``p:<host><path>`` for every path
prefix that ends before a ``/`` and the whole path, so the join is an
equi-join and never a comparison of every capture with every entry. A host with
a third of all captures is spread over ``salts`` sub-keys (the list side is
repeated that often; it holds one row per interval).

Defined results: null URL or null fetch time matches nothing (blocked false);
entries with a null pattern or time are ignored; of entries of one pattern at
the same time the removal wins; repeated entries count once; repeated captures
are kept as they are; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.exchange import free_name
from logscope.session import materialise


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, at) -> active intervals (pattern, valid_from, valid_to); an open end is null."""
    e = entries.select("pattern", "action", "at").where("pattern is not null and at is not null").distinct()
    e = e.groupBy("pattern", "at").agg(F.max(F.col("action") == "remove").alias("_off"))
    w = Window.partitionBy("pattern").orderBy("at")  # a pattern's own history
    e = e.withColumn("valid_to", F.lead("at").over(w))
    return e.where(~F.col("_off")).select("pattern", F.col("at").alias("valid_from"), "valid_to")


def url_keys(url: Column) -> Column:
    """Keys under which a URL can be listed; null for a null URL."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"[?#][\s\S]*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/]*", 0), r"^.*@", ""), r":[0-9]*$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"/[\s\S]*$", 0), r"/+$", "")
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
        F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(
        F.lit("p:"), host, F.array_join(F.slice(parts, 1, i), "/")))
    return F.concat(suffixes, prefixes)


def temporal_list_join(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at",
                       salts: int = 16) -> DataFrame:
    """Every capture with ``blocked``, ``n_matches`` and ``matched`` (sorted active patterns); columns of the
    captures with these names are replaced."""
    row, m = free_name(captures, "_row"), free_name(captures, "_matched")
    c = materialise(captures.withColumn(row, F.monotonically_increasing_id()))
    # the salt is part of the row number, so a repeated evaluation gives the same one
    keys = c.select(F.col(row).alias("_row"), F.col(fetched).alias("_at"), F.explode(F.array_distinct(url_keys(F.col(url)))).alias("_key"),
                    F.pmod(row, F.lit(salts)).alias("_salt"))
    lists = intervals(entries).select(F.col("pattern").alias("_key"), "valid_from", "valid_to",
                                      F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
    hit = keys.join(lists, ["_key", "_salt"]).where(
        (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    hit = hit.groupBy("_row").agg(F.array_sort(F.collect_set("_key")).alias("matched"))  # at most the URL's own keys
    hit = hit.select(F.col("_row").alias(row), F.col("matched").alias(m))
    out = c.drop("blocked", "n_matches", "matched").join(hit, row, "left").drop(row).withColumnRenamed(m, "matched")
    return out.withColumn("matched", F.coalesce("matched", F.array().cast("array<string>"))).withColumn(
        "n_matches", F.size("matched").cast("long")).withColumn("blocked", F.col("n_matches") > 0)


def dated_entries(pages: DataFrame) -> DataFrame:
    """The query's list, made from the hosts and path prefixes that the pages hold: an md5 digit decides what is
    listed, when, and when it is taken off again."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1))
    lang = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([a-z]+)/", 1)
    p = pages.where("url is not null").select(F.explode(F.array(
        F.concat(F.lit("d:"), host), F.concat(F.lit("p:"), host, F.lit("/"), lang))).alias("pattern")).distinct()
    digit = lambda i: F.conv(F.substring(F.md5("pattern"), i, 2), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    p = p.select("pattern", digit(1).alias("a"), digit(3).alias("b"), digit(5).alias("c")).where("a < 64")
    return p.select("pattern", F.explode(F.array(
        F.struct(F.lit("add").alias("action"), day(F.col("b")).alias("at")),
        F.struct(F.lit("remove").alias("action"), day(F.col("b") + F.col("c")).alias("at")),
        F.struct(F.lit("add").alias("action"), day(F.col("b") + 2 * F.col("c")).alias("at")))).alias("x")).select("pattern", "x.*")


ORACLE = r"""
with p as (select page_id, url, date '2024-01-01' + ((page_id * 37) % 365)::int as tm, row_number() over () as r from pages),
s as (select *, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host,
      regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '^$', '') as path,
      regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z]+)/', 1) as lang from p),
pats as (select distinct 'd:' || host as pattern from s union select distinct 'p:' || host || '/' || lang from s),
dig as (select pattern, ('0x' || substr(md5(pattern), 1, 2))::int as a, ('0x' || substr(md5(pattern), 3, 2))::int as b,
        ('0x' || substr(md5(pattern), 5, 2))::int as c from pats),
e as (select pattern, 'add' as action, date '2024-01-01' + b as tm from dig where a < 64
      union select pattern, 'remove', date '2024-01-01' + (b + c) from dig where a < 64
      union select pattern, 'add', date '2024-01-01' + (b + 2 * c) from dig where a < 64),
e1 as (select pattern, tm, bool_or(action = 'remove') as is_off from e group by pattern, tm),
iv as (select pattern, is_off, tm as f, lead(tm) over (partition by pattern order by tm) as u from e1),
hs as (select r, tm, 'd:' || array_to_string(list_slice(string_split(host, '.'), i, 99), '.') as k
       from (select *, unnest(range(1, len(string_split(host, '.')) + 1)) as i from s)),
ps as (select r, tm, 'p:' || host || array_to_string(list_slice(string_split(path, '/'), 1, i), '/') as k
       from (select *, unnest(range(1, len(string_split(path, '/')) + 1)) as i from s)),
hit as (select x.r, list_sort(list(distinct x.k)) as m from (select * from hs union all select * from ps) x
        join iv on iv.pattern = x.k and not is_off and x.tm >= f and (u is null or x.tm < u) group by x.r)
select page_id, coalesce(len(m), 0)::bigint as n_matches, coalesce(len(m), 0) > 0 as blocked,
       coalesce(array_to_string(m, ','), '') as matched
from p left join hit using (r)
"""
