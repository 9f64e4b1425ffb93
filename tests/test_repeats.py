"""Queries held against their SQL on words that are seen more often than a table's counts go."""

import duckdb
import pytest

import __spark_entry__ as entry
from seqloom.functions.letters import MOST


@pytest.fixture(scope="module")
def repeats(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("repeats"))
    texts = ["a" * (MOST + 2000), "ab" * 300, "a" * 150, "acgbdbabdcbbacdh" * 20, "", None]
    rows = [(i, text, "de", "web", len(text or "")) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    theirs = con.sql(entry.oracle_sql()[name])
    ours = sorted(map(tuple, entry.queries()[name](spark, folder).select(*theirs.columns).collect()))
    assert ours == sorted(theirs.fetchall())
    return ours


def test_instances_of_the_last_bin(spark, repeats):
    assert (MOST, MOST) in same_as_sql(spark, repeats, "histogram_instances")


def test_counts_of_long_words_are_not_clipped(spark, repeats):
    assert max(n for _, n in same_as_sql(spark, repeats, "kmer_count_long_words")) > MOST


def test_counts_of_words_of_101_are_not_clipped(spark, repeats):
    assert max(n for _, n in same_as_sql(spark, repeats, "kmer_count_words_of_101")) > MOST
