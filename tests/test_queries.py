import pytest
from oracle import DATA, check
from pyspark.sql import functions as F

from matnflow.functions.normalize import report_letters
from matnflow.operators import candidates, rulings
from matnflow.plans import catalogue, roundtrips  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.sql()))
def test_query_equals_sql(spark, name):
    check(spark, catalogue.QUERIES[name], catalogue.sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.sql())))
def test_query_runs(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", ["cand_report_topk", "find_reports"])
def test_large_corpora_equal_sql(spark, monkeypatch, name):
    monkeypatch.setattr(candidates, "HELD_LETTERS", 0)
    monkeypatch.setattr(candidates, "SHARD_LETTERS", 3000)
    check(spark, catalogue.QUERIES[name], catalogue.sql()[name])


@pytest.mark.parametrize("name", ["find_reports_service", "check_all", "verify_all"])
def test_large_corpora_equal_held_ones(spark, monkeypatch, name):
    held = sorted(map(tuple, catalogue.QUERIES[name](spark, DATA).collect()))
    monkeypatch.setattr(candidates, "HELD_LETTERS", 0)
    monkeypatch.setattr(candidates, "SHARD_LETTERS", 3000)
    assert sorted(map(tuple, catalogue.QUERIES[name](spark, DATA).collect())) == held and held


def test_pairs_that_rulings_drop_are_not_sent(spark):
    pairs = catalogue._lookup(spark, DATA)
    reports = catalogue.table(spark, DATA, "enc_hadith").select(F.col("rec_id").alias("query"), F.col("text").alias("text_q"))
    close = rulings.local_rulings(reports, catalogue._records(spark, DATA), judge=rulings.close_by_letters(0.65))
    told = [sorted(map(repr, rulings.check_rulings(x).collect())) for x in (pairs, close)]
    assert told[0] == told[1] and close.count() < pairs.count()


def test_pairs_that_the_service_drops_are_not_sent(spark):
    pairs = catalogue._lookup(spark, DATA)
    reports = catalogue.table(spark, DATA, "enc_hadith").select(F.col("rec_id").alias("query"), F.col("text").alias("text_q"))
    close = rulings.local_rulings(reports, catalogue._records(spark, DATA), judge=rulings.close_by_words(0.6), judged=report_letters)
    told = [sorted(map(repr, rulings.check_rulings_service(x).where("kind <> 'not_found'").collect())) for x in (pairs, close)]
    assert told[0] == told[1] and told[0] and close.count() < pairs.count()
