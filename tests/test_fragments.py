"""Sequences in fragments, against the whole records."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from seqloom.operators import words
from seqloom.sources import files
from seqloom.sources.fragments import fragments, read_fragments


def rows(df):
    return sorted(map(tuple, df.collect()))


def cut(seqs, overlap, size, compress=False, barcode=0):
    made = []
    for i, seq in enumerate(seqs):
        seq = (re.sub(r"(.)\1+", r"\1", seq) if compress else seq)[barcode:]
        made += [(i, at, seq[at : at + size + overlap]) for at in range(0, len(seq), size)]
    return made


def records(seed, n, ends="\n"):
    rnd = random.Random(seed)
    seqs = ["".join(rnd.choice("acgtAN") * rnd.choice((1, 1, 2, 9, 70)) for _ in range(rnd.choice((0, 1, 5, 300)))) for _ in range(n)]
    text = ""
    for i, seq in enumerate(seqs):
        text += f">r{i} x > y{ends}"
        while seq:
            width = rnd.choice((1, 7, 60))
            text, seq = text + seq[:width] + rnd.choice(("", "", " ", "\t")) + ends + rnd.choice(("", "", "", ends)), seq[width:]
    return text, seqs


@pytest.mark.parametrize("compress,barcode,overlap,size,ends", [(False, 0, 20, 100, "\n"), (True, 0, 20, 100, "\n"), (True, 5, 130, 50, "\r\n"), (False, 3, 0, 7, "\n"), (False, 0, 39, 1 << 20, "\n")])
def test_records_over_many_splits(spark, tmp_path, compress, barcode, overlap, size, ends):
    text, seqs = records(overlap + size, 40, ends)
    (tmp_path / "x.fa").write_bytes(text.encode())
    old = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for name, value in zip(old, ("1500b", "1b", "5"), strict=True):
            spark.conf.set(name, value)
        made = read_fragments(spark, str(tmp_path / "x.fa"), overlap, size, compress, barcode)
        assert rows(made) == cut(seqs, overlap, size, compress, barcode)
        splits = spark.read.text(str(tmp_path / "x.fa")).rdd.getNumPartitions()
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert splits > 20


def test_several_files_folders_and_letters_before_a_head(spark, tmp_path):
    (tmp_path / "b.fa").write_text("lost\n\n>1\nAC\nGT\n>\n>3\nnn\n")
    with gzip.open(tmp_path / "a.fa.gz", "wt") as out:
        out.write(">4\ngggügg")
    (tmp_path / "c.fa").mkdir()
    (tmp_path / "c.fa" / "part-0").write_text(">5\nac\n")
    (tmp_path / "c.fa" / "part-1").write_text("gone\n>6\nta")
    made = read_fragments(spark, [str(tmp_path / name) for name in ("b.fa", "a.fa.gz", "c.fa")], 1, 3)
    assert rows(made) == [(0, 0, "ACGT"), (0, 3, "T"), (2, 0, "nn"), (3, 0, "gggn"), (3, 3, "ngg"), (4, 0, "ac"), (5, 0, "ta")]


def test_no_records(spark, tmp_path):
    (tmp_path / "x.fa").write_text("")
    (tmp_path / "y.fa").write_text(">a\n>b\n\n")
    for name in ("x.fa", "y.fa"):
        assert rows(read_fragments(spark, str(tmp_path / name), 3)) == []
    with pytest.raises(ValueError):
        read_fragments(spark, str(tmp_path / "x.fa"), -1)


def test_other_kinds_and_given_pieces(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a\nAACGTTA\n+\n@@@@@@@\n@b\n\n+\n\n")
    assert rows(read_fragments(spark, str(tmp_path / "x.fq"), 2, 3, True)) == [(0, 0, "ACGTA"), (0, 3, "TA")]
    given = spark.createDataFrame([(7, 4, "tt"), (7, 0, "acgt"), (8, 0, None), (7, 6, "")], "read_id long, at long, seq string")
    assert rows(fragments(given, 1, 4)) == [(7, 0, "acgtt"), (7, 4, "tt")]


@pytest.mark.parametrize("k", [5, 40])
def test_words_of_fragments_are_those_of_records(spark, tmp_path, k):
    text, _ = records(k, 30)
    (tmp_path / "x.fa").write_text(text)
    whole = files.read_sequences(spark, str(tmp_path / "x.fa"))
    parts = read_fragments(spark, str(tmp_path / "x.fa"), k - 1, 64)
    counted = [rows(words.count_table(df.select("seq"), k).select("kmer", F.col("count"))) for df in (whole, parts)]
    assert counted[0] == counted[1] and counted[0]
