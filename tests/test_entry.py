import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["kmer_count_cutoff", "histogram_clipped", "histogram_scoped", "histogram_fit", "table_slice", "table_order_check", "table_seek_entry", "table_ranges", "tables_logic", "tables_gc_within", "tables_venn", "profile_runs", "coverage_merged", "coverage_lines", "haplotype_groups", "haplotype_sites", "homopolymer_errors", "file_fasta", "file_fastq_gzip", "file_sam", "files_several", "stored_profiles", "stored_tagged_table", "word_functions"]


def test_every_query_is_callable_and_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["kmer", "count"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = entry.queries()[name](spark, SF).toPandas()
    theirs = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(repr, map(plain, ours[columns].values.tolist()))) == sorted(map(repr, map(plain, theirs[columns].values.tolist())))


def plain(row):
    return [list(x) if hasattr(x, "tolist") and not isinstance(x, str) and getattr(x, "ndim", 0) else x for x in row]


def test_the_moved_table_is_whole(spark):
    moved, counted = (entry.queries()[name](spark, SF) for name in ("stored_and_moved", "kmer_count"))
    ours = sorted(map(tuple, moved.collect()))
    assert ours == sorted((r["kmer"], r["count"], 0) for r in counted.collect()) and any(n == 1 for _, n, _ in ours)


def test_profile_codec_gives_every_place_back(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ours = entry.queries()["profile_codec"](spark, SF).select("read_id", "pos", "count", "n_bytes", "same").toPandas()
    theirs = con.sql(f"SELECT read_id, pos, count, n_bytes, same FROM ({entry.oracle_sql()['profile_codec']})").df()
    assert sorted(map(tuple, ours.values.tolist())) == sorted(map(tuple, theirs.values.tolist()))
    profile = entry.queries()["profile_absolute"](spark, SF).select("read_id", "pos", "count").toPandas()
    assert sorted(map(tuple, ours[["read_id", "pos", "count"]].values.tolist())) == sorted(map(tuple, profile.values.tolist()))
