"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from logscope.llm import (decontaminate, fm_dedup, gumbel_pieces, jaccard_join, ngram_lm, pii, quality_classifier, quality_rules,
                          suffix_dedup, url_filters)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _g long, node long, _row long, score double, matched string"
LONG = " ".join(f"word{i % 7919} x{i}" for i in range(40_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seventeen wise owls look on from the old barn roof and nobody says a word about it at all"


@pytest.fixture(scope="module")
def rows():
    base = [(1, PASSAGE + " and more"), (2, PASSAGE + " and more"), (2, PASSAGE + " and more"), (3, None), (4, ""), (5, " \n\t "), (6, LONG),
            (None, PASSAGE), (None, None), (7, "a"), (7, "other text for the same id\nwith two lines"), (8, "é▁ü \n\nmail a.b@c.de +49 (030) 1234567 ok"),
            (9, "!" * 5000), (10, " leading and  double   spaces "), (11, "😀 emoji 4111 1111 1111 1111".encode("utf-16", "surrogatepass").decode("utf-16"))]
    return [(i, t, None, "s" if (i or 0) % 2 else None, None, 5, 6, 7, 0.5, "m") for i, t in base]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 0), (7, 1, 0), (10, 0, 1), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, "short"), (None, PASSAGE)], "item_id long, text string")


def keyed(df):
    return {(r["doc_id"]): r for r in df.collect()}


def test_quality_rules(spark, docs, empty):
    got = keyed(quality_rules.quality_rules(docs))
    assert quality_rules.quality_rules(docs).count() == 15
    assert got[3]["n_words"] == 0 and got[3]["base_failed"] and not got[3]["kept"]
    assert got[5]["n_words"] == 0 and got[6]["n_words"] == 80_000 and got[6]["kept"]
    assert got[9]["word_chars"] == 5000
    assert quality_rules.quality_rules(empty).count() == 0


def test_common_lines_deplete(spark):
    line = "this very line stands in all documents of the host and is boilerplate"
    rows = [(i, f"{line}\n{i} " + " ".join(f"w{i}x{j}" for j in range(3 if i % 2 else 40)), "h") for i in range(30)]
    rows += [(100 + i, line + " and differs here by the number of it " + str(i), "other") for i in range(5)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=10, share=0.1)
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[i] == (i % 2 == 0) for i in range(30)) and all(kept[100 + i] for i in range(5))


def test_suffix_dedup(docs, empty):
    rows = suffix_dedup.suffix_dedup(docs).collect()
    assert len(rows) == 15
    got = {(r["doc_id"], r["n_bytes"]): r for r in rows}
    n = len(PASSAGE + " and more")
    assert got[1, n]["n_removed"] == 0 and got[2, n]["n_removed"] == n and got[2, n]["n_spans"] == 1
    assert got[None, len(PASSAGE)]["n_removed"] == len(PASSAGE)  # a null id is later than any other
    assert got[3, 0]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and got[9, 5000]["n_removed"] == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_substring_dedup(docs, empty):
    rows = fm_dedup.substring_dedup(docs).collect()
    assert len(rows) == 15
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_removed"] == 0 and all(r["n_removed"] == r["n_words"] == 31 for r in by[2])
    assert by[3][0]["n_words"] == 0 and by[3][0]["kept"] == "" and by[6][0]["n_words"] == 80_000
    assert by[10][0]["kept"] == "leading and double spaces"
    assert fm_dedup.substring_dedup(empty).count() == 0


def test_jaccard(docs, empty):
    rows = jaccard_join.jaccard_components(docs).collect()
    assert len(rows) == 15
    comp = {}
    for r in rows:
        comp.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert comp[2] == {(28, 1)} and comp[3] == {(0, 3)} and comp[5] == {(0, 5)} and (1, 7) in comp[7]
    assert (26, 1) in comp[None] and (0, None) in comp[None]
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = jaccard_join.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] or 0) for r in kept.collect())
    assert ids == [0, 1, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11]  # of the nulls the one without text stays
    assert jaccard_join.one_of_each(empty).count() == 0


def test_decontamination(docs, empty, items):
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 2, 2] and {r["item_id"] for r in got} == {1}
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and left.count() == 11
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.decontaminate(docs, items.limit(0)).count() == 15


def test_url_filters(spark):
    captures = spark.createDataFrame(
        [(1, "http://a.b.com/x/y?q=1", "2024-01-05", 9), (2, "http://a.b.com/x/y", "2024-02-05", 9), (3, None, "2024-01-05", 9), (4, "http://b.com", None, 9),
         (5, "HTTPS://u:p@B.com:80/", "2024-01-01", 9), (6, "", "2024-01-05", 9), (6, "", "2024-01-05", 9), (7, "http://xb.com/", "2024-01-05", 9)],
        "page_id long, url string, fetched_at string, _row int")
    entries = spark.createDataFrame(
        [("d:b.com", "add", "2024-01-01"), ("d:b.com", "add", "2024-01-01"), ("d:b.com", "remove", "2024-02-01"), ("p:a.b.com/x", "add", "2024-02-05"),
         ("p:a.b.com/x/y", "add", "2024-02-05"), ("p:a.b.com/x/y", "remove", "2024-02-05"), (None, "add", "2024-01-01"), ("d:b.com", "add", None)],
        "pattern string, action string, at string")
    out = {(r["page_id"]): r for r in url_filters.temporal_list_join(captures, entries).collect()}
    assert out[1]["matched"] == ["d:b.com"] and out[2]["matched"] == ["p:a.b.com/x"] and out[5]["matched"] == ["d:b.com"]
    assert not any(out[i]["blocked"] for i in (3, 4, 6, 7)) and out[1]["_row"] == 9
    assert url_filters.temporal_list_join(captures, entries).count() == 8
    assert url_filters.temporal_list_join(captures.limit(0), entries).count() == 0
    assert not any(r["blocked"] for r in url_filters.temporal_list_join(captures, entries.limit(0)).collect())


def test_quality_classifier(docs, empty, labels):
    rows = quality_classifier.classify(docs, labels).collect()
    assert len(rows) == 15 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(v) == 1 for v in by.values())
    assert quality_classifier.classify(empty, labels).count() == 0 and quality_classifier.classify(docs, labels.limit(0)).count() == 15
    kept = quality_classifier.keep_good(docs, labels, 0.0)
    assert kept.columns == docs.columns and kept.count() == 15 and {r["score"] for r in kept.collect()} == {0.5}


def test_pii(docs, empty, rows):
    got = keyed(pii.pii_spans(docs))
    assert got[8]["n_email"] == 1 and got[8]["n_phone"] == 1 and got[11]["n_card"] == 1 and got[3]["spans"] == "" and got[6]["n_card"] == 0
    text = next(t for i, t, *_ in rows if i == 11)
    spans = re.findall(r"card:(\d+):(\d+)", got[11]["spans"])
    assert text[int(spans[0][0]):int(spans[0][1])] == "4111 1111 1111 1111"
    assert pii.pii_spans(empty).count() == 0
    out = pii.redact(docs, model=None)
    assert out.columns == docs.columns and out.count() == 15
    text = {r["doc_id"]: r for r in out.collect()}
    assert "[EMAIL]" in text[8]["text"] and "[PHONE]" in text[8]["text"] and text[3]["text"] is None and text[8]["n_chars"] == len(text[8]["text"])


def test_lm(docs, empty):
    rows = ngram_lm.lm_scores(docs).collect()
    assert len(rows) == 15 and len({r["train_tokens"] for r in rows}) == 1
    got = {r["doc_id"]: r for r in rows}
    assert got[3]["n_tokens"] == 1 and got[6]["n_tokens"] == 80_001 and all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert ngram_lm.lm_scores(empty).count() == 0
    assert len(ngram_lm.lm_scores(docs, order=3).collect()) == 15


def test_pieces(docs, empty):
    out = gumbel_pieces.encode(docs, k=3)
    rows = out.collect()
    assert all(r["round_trip"] for r in rows)
    one = [r for r in rows if r["doc_id"] == 3]
    assert len(one) == 1 and one[0]["n_pieces"] == 0 and one[0]["inclusion"] == 1
    by = {}
    for r in rows:
        if r["doc_id"] in (1, 6, 8, 10):
            by.setdefault(r["doc_id"], []).append(r)
    assert all(len({r["sha256"] for r in v}) == 3 for v in by.values())
    assert all(a["perturbed"] >= b["perturbed"] for v in by.values() for a, b in zip(sorted(v, key=lambda r: r["rank"]), sorted(v, key=lambda r: r["rank"])[1:]))
    back = gumbel_pieces.decode(out, out="back").where("doc_id = 10").select("back").distinct().collect()
    assert [r[0] for r in back] == [" leading and  double   spaces "]
    assert gumbel_pieces.encode(empty).count() == 0
    # the same row gives the same samples in any company
    alone = gumbel_pieces.encode(docs.where("doc_id = 8"), k=3).collect()
    assert {r["sha256"] for r in alone} == {r["sha256"] for r in by[8]}
    assert docs.where(F.col("doc_id") == 8).count() == 1
