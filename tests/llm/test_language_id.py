from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sessionlens.llm import language_id as L

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_declared_languages_are_found_again(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify_language(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.language == got.lang).mean() > 0.99 and got.reason.isna().mean() > 0.99


def small(spark):
    english = ["the cat and the dog were in the house with the man", "this is what they said about the weather then"]
    german = ["der hund und die katze waren mit dem mann im haus", "das ist was sie dann ueber das wetter sagten"]
    rows = []
    for i in range(60):
        rows.append((i, english[i % 2] + f" {'and that ' * (i % 5)}", "en", f"www{i % 3}.news.example.com"))
        rows.append((100 + i, german[i % 2] + f" {'und das ' * (i % 5)}", "de", f"www{i % 3}.zeitung.example.de"))
    return rows


def test_evidence_decides_where_the_text_says_little(spark):
    rows = small(spark) + [(900, "an", "de", "www9.zeitung.example.de"), (901, "an", "en", "www9.news.example.com"), (902, "the house with the man and the dog", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["language"] for r in L.identify_language(docs).collect()}
    assert got[900] == "de" and got[901] == "en" and got[902] == "en"
    assert all(got[i] == ("en" if i < 100 else "de") for i, *_ in rows[:120])
    hosts = L.identify_language(docs.withColumn("suffix", L.address_suffix(F.col("source"))), declared="lang", host="source", suffix="suffix")
    assert {r["doc_id"]: r["language"] for r in hosts.collect()}[900] == "de"


def test_rare_languages_have_models_in_tables_of_any_size(spark):
    """Nine of 12,000 documents are Greek, one is Russian, each less than one in a thousand."""
    greek = "η γάτα και ο σκύλος ήταν στο σπίτι με τον άνδρα και τη γυναίκα"
    russian = "кошка и собака были в доме с мужчиной и женщиной вместе"
    rows = [(100_000 + i, greek, "el" if i < 9 else None, None) for i in range(12)] + [(200_000, russian, "ru", None)]
    common = spark.createDataFrame(small(spark), "doc_id long, text string, lang string, source string").crossJoin(spark.range(100)).drop("id")
    docs = common.unionByName(spark.createDataFrame(rows, common.schema))
    got = {r["doc_id"]: (r["language"], r["reason"]) for r in L.identify_language(docs).where("doc_id >= 100000").collect()}
    assert all(got[i] == ("el", None) for i in range(100_000, 100_012)) and got[200_000] == ("ru", None)


def test_blocks_of_languages_say_the_same(spark, monkeypatch):
    words = {f"l{i:02}": [f"{chr(97 + i)}{chr(97 + j)}{chr(97 + (i * j) % 26)}" for j in range(20)] for i in range(20)}
    rows = [(20 * k + i, " ".join(w[k:] + w[:k]), name, f"h{i % 3}.x") for k in range(4) for i, (name, w) in enumerate(words.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = sorted(map(tuple, L.identify_language(docs).collect()))
    monkeypatch.setattr(L, "BLOCK", 7)
    assert sorted(map(tuple, L.identify_language(docs).collect())) == whole
    assert {r[0]: r[2] for r in whole} == {r[0]: r[2] for r in rows}


def test_edge_cases(spark):
    odd = [(1000, None, "en", None), (1001, "", None, "h"), (1002, "12 34 !!", "en", "h"), (None, "the dog and the cat", None, None), (1003, "the man and the dog", None, ""), (1003, "the man and the dog", None, ""), (1004, "the dog " * 50_000, "en", "h"), (1005, "жщ" * 40, None, "h")]
    rows = [(*r, 1) for r in small(spark) + odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key long")
    got = L.identify_language(docs).collect()
    assert len(got) == len(rows)
    reasons = {r["doc_id"]: r["reason"] for r in got}
    assert [reasons[i] for i in (1000, 1001, 1002)] == ["no text"] * 3 and reasons[1005] == "unknown language"
    assert reasons[None] is None and reasons[1003] is None and reasons[1004] is None
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert L.identify_language(docs.limit(0)).count() == 0 and L.keep_identified(docs.limit(0)).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["reason"] for r in L.identify_language(none).collect()} == {"unsure", "no text"}


def test_addresses_and_markup(spark):
    rows = [("https://u:p@Blog.Example.DE:80/x?y#z", "<!DOCTYPE html><html class=a LANG='de-AT'>"), ("nonsense", "<p>"), (None, None), ("http://localhost/", "<html lang=fr>")]
    df = spark.createDataFrame(rows, "url string, html string")
    host = L.address_host(F.col("url"))
    got = [tuple(r) for r in df.select(host, L.address_suffix(host), L.markup_language(F.col("html"))).collect()]
    assert got == [("blog.example.de", "de", "de"), (None, None, None), (None, None, None), ("localhost", None, "fr")]
