import gzip
import os
import random
import struct
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from seqloom.functions import codec
from seqloom.operators import histograms, profiles
from seqloom.sources import artifacts, files


def seqs(df):
    return [tuple(r) for r in df.orderBy("read_id").collect()]


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">one > two\nACG\nTAC\n>empty\n>three\nggg\n")
    assert seqs(files.read_sequences(spark, str(path))) == [(0, "ACGTAC"), (1, ""), (2, "ggg")]


def test_fastq_plain_gzip_and_several(spark, tmp_path):
    text = "@r1\nACGT\n+\n@@@@\n@r2\nGGN\n+\n>>>\n"
    (tmp_path / "a.fq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as out:
        out.write(text)
    both = files.read_sequences(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fastq.gz")])
    assert seqs(both) == [(0, "ACGT"), (1, "GGN"), (2, "ACGT"), (3, "GGN")]


def test_sam(spark, tmp_path):
    rows = ["@HD\tVN:1", "a\t0\t*\t0\t0\t*\t*\t0\t0\tACGN\t*", "a\t256\t*\t0\t0\t*\t*\t0\t0\tCCCC\t*", "b\t16\t*\t0\t0\t*\t*\t0\t0\tGG\t*"]
    (tmp_path / "x.sam").write_text("\n".join(rows) + "\n")
    assert seqs(files.read_sequences(spark, str(tmp_path / "x.sam"))) == [(0, "ACGN"), (1, "GG")]


def bam_record(flag, seq):
    codes = [files.BAM_LETTERS.index(c) for c in seq] + [0]
    body = struct.pack("<iiBBHHHiiii", -1, -1, 2, 0, 0, 0, flag, len(seq), -1, -1, 0) + b"r\0"
    body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2)) + b"\xff" * len(seq)
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    raw = b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 9)
    raw += bam_record(0, "acgta") + bam_record(0x800, "ccc") + bam_record(4, "ggn")
    half = len(raw) // 2
    (tmp_path / "x.bam").write_bytes(gzip.compress(raw[:half]) + gzip.compress(raw[half:]))
    assert seqs(files.read_sequences(spark, str(tmp_path / "x.bam"))) == [(0, "acgta"), (1, "ggn")]
    with pytest.raises(zlib.error):
        list(files.bam_sequences(b"nothing"))


def test_many_records_and_blocks_of_bam(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHUNK", 50)
    r = random.Random(2)
    letters = ["".join(r.choice("acgtn") for _ in range(r.randint(0, 90))) for _ in range(300)]
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 0) + b"".join(bam_record(0, x) for x in letters)
    data = b"".join(gzip.compress(raw[i : i + 700]) for i in range(0, len(raw), 700)) + gzip.compress(b"")
    assert list(files.bam_sequences(data)) == letters
    with pytest.raises(ValueError):
        list(files.bam_sequences(gzip.compress(raw[:-3])))


def test_lines_are_numbered_over_splits_and_part_files(spark, tmp_path):
    records = [f"r{i} x > y\n{'acgt' * (i % 9)}\n{'g' * (i % 5)}" for i in range(3000)]
    (tmp_path / "d.fa").mkdir()
    for part in range(3):
        (tmp_path / "d.fa" / f"part-{part}.txt").write_text("".join(f">{x}\n" for x in records[part * 1000 : part * 1000 + 1000]))
    (tmp_path / "whole.fa").write_text("".join(f">{x}\n" for x in records))
    want = [(i, "".join(x.split("\n")[1:])) for i, x in enumerate(records)]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000b")
    try:
        for name in ("d.fa", "whole.fa"):
            df = files.read_sequences(spark, str(tmp_path / name))
            assert df.rdd.getNumPartitions() > 3 and seqs(df) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


@pytest.mark.parametrize(("everything", "kept"), [(1, [0, 1, 3, 4]), (0, [1, 4])])
def test_two_bit_database(spark, tmp_path, monkeypatch, everything, kept):
    monkeypatch.setattr(files, "RECORDS", 2)
    reads, flags = ["acgtacg", "ttttc", "ac", "ggggggggg", "catcat"], [0, 0x800, 0x800, 0, 0x800]
    packed, records = b"", b""
    for seq, flag in zip(reads, flags, strict=True):
        records += struct.pack("=iiiiqqii", 0, len(seq), 0, 0, len(packed), 0, flag, 0)
        packed += artifacts.packed_word(seq)
    (tmp_path / ".x.idx").write_bytes(struct.pack("=i", len(reads)) + bytes(108) + records)
    (tmp_path / ".x.bps").write_bytes(packed)
    (tmp_path / "x.db").write_text(f"files =         1\n  {len(reads)} a a\nblocks =         1\nsize =  200000000 cutoff =         4 all = {everything}\n")
    assert seqs(files.read_sequences(spark, str(tmp_path / "x.db"))) == [(i, reads[j]) for i, j in enumerate(kept)]


def test_kinds():
    with pytest.raises(ValueError):
        files.kind_of("x.txt")
    assert files.kind_of("a/b.FQ.gz") == "fastq" and files.kind_of("x.dam") == "two-bit"


def test_cram_and_mixed_kinds_are_refused(spark):
    with pytest.raises(NotImplementedError):
        files.read_sequences(spark, "x.cram")
    with pytest.raises(ValueError):
        files.read_sequences(spark, ["a.fa", "b.fq"])


def test_histogram_file(spark, tmp_path):
    h = histograms.of_counts(spark.createDataFrame([(1,), (1,), (3,), (50000,)], "n long"), 5)
    raw = artifacts.histogram_bytes(h)
    assert len(raw) == 262164
    (tmp_path / "x.hist").write_bytes(raw)
    back = artifacts.read_histogram_file(spark, str(tmp_path / "x.hist"))
    assert {tuple(r) for r in back.bins.collect()} == {(1, 2), (3, 1), (32767, 1)}
    assert tuple(back.ends.first()) == (2, 50000)


def test_table_files(spark, tmp_path):
    words = sorted(["aaaacc", "aacgtt", "acgtac", "ttttta"])
    codes = [artifacts.packed_word(w) for w in words]
    index = [sum(c[0] <= i for c in codes) for i in range(256)]
    (tmp_path / "x.ktab").write_bytes(struct.pack("=iiii", 6, 2, 1, 1) + struct.pack("=256q", *index))
    for part, chosen in enumerate((codes[:3], codes[3:]), 1):
        rows = b"".join(c[1:] + struct.pack("=H", 7 + i) for i, c in enumerate(chosen))
        (tmp_path / f".x.ktab.{part}").write_bytes(struct.pack("=iq", 6, len(chosen)) + rows)
    got = artifacts.read_table_files(spark, str(tmp_path / "x.ktab"))
    assert sorted(tuple(r) for r in got.collect()) == list(zip(words, [7, 8, 9, 7], strict=True))
    assert sorted(r["kmer"] for r in artifacts.read_table_files(spark, str(tmp_path / "x.ktab"), 8).collect()) == words[1:3]
    assert artifacts.table_file_facts(str(tmp_path / "x.ktab")) == {"k": 6, "parts": 2, "minval": 1, "words": 4}


def test_profile_files(spark, tmp_path):
    made = [[1, 1, 1, 40, 2], [], [32767, 0], [5] * 200]
    (tmp_path / "x.prof").write_bytes(struct.pack("=ii", 7, 2))
    for part, first in ((1, 0), (2, 2)):
        codes = [codec.encode(c) for c in made[first : first + 2]]
        ends = [sum(map(len, codes[: i + 1])) for i in range(2)]
        (tmp_path / f".x.pidx.{part}").write_bytes(struct.pack("=iqq2q", 7, first, 2, *ends))
        (tmp_path / f".x.prof.{part}").write_bytes(b"".join(codes))
    got = artifacts.read_profile_files(spark, str(tmp_path / "x.prof"))
    assert sorted((r["read_id"], r["counts"]) for r in got.collect()) == list(enumerate(made))
    got = artifacts.read_profile_files(spark, str(tmp_path / "x.prof"), [(1, 2)])
    assert sorted((r["read_id"], r["counts"]) for r in got.collect()) == [(1, []), (2, [32767, 0])]


def test_stored_profiles(spark, tmp_path):
    prof = spark.createDataFrame([(r, p, (r * p) % 5) for r in range(6) for p in range(9)], "read_id long, pos int, count int")
    artifacts.write_profiles(prof, str(tmp_path / "p"))
    assert sorted(map(tuple, artifacts.read_profiles(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, prof.collect()))
    found = artifacts.read_profiles(spark, str(tmp_path / "p"), [(4, 4)])
    assert sorted(map(tuple, found.collect())) == sorted((4, p, (4 * p) % 5) for p in range(9))
    assert "PushedFilters: [Or" in found._jdf.queryExecution().toString() or "GreaterThanOrEqual(read_id,4)" in found._jdf.queryExecution().toString()


def test_tagged_file(spark, tmp_path):
    lines = spark.createDataFrame([(2, "C 2 7 1"), (1, "S 4 acgt\nC 1 9")], "ord int, line string")
    artifacts.write_tagged(lines, str(tmp_path / "t.kmr"), "kmr", ["D S 1 6 STRING", "D C 1 8 INT_LIST"], "table x", ["ord"])
    names = sorted(x for x in os.listdir(tmp_path / "t.kmr") if x.startswith("part-"))
    text = "".join((tmp_path / "t.kmr" / x).read_text() for x in names).split("\n")
    assert text[:3] == ["1 3 kmr 2 0", "~ D S 1 6 STRING", "~ D C 1 8 INT_LIST"] and text[3].startswith("! 4 7 seqloom 3 1.0 7 table x ")
    assert text[4:] == ["S 4 acgt", "C 1 9", "C 2 7 1", ""]
    got = artifacts.read_tagged(spark, str(tmp_path / "t.kmr")).collect()
    assert sorted((r["tag"], r["fields"]) for r in got) == [("C", ["1", "9"]), ("C", ["2", "7", "1"]), ("S", ["4", "acgt"])]


def test_interval_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, 4, 9), (0, 7, 12), (0, 2, 7)], "seq_idx long, beg int, end int")
    artifacts.write_intervals(profiles.named_intervals(rows, "asm"), str(tmp_path / "x.bed"))
    parts = sorted(x for x in os.listdir(tmp_path / "x.bed") if x.startswith("part-"))
    assert "".join((tmp_path / "x.bed" / x).read_text() for x in parts) == "0\t2\t7\tasm\n0\t7\t12\tasm\n1\t4\t9\tasm\n"


def test_artifacts_move_as_a_unit(spark, tmp_path):
    table = spark.createDataFrame([("aaaaa", 1)], "kmer string, count int")
    artifacts.write_table(table, str(tmp_path / "x.ktab"))
    assert artifacts.copy(spark, str(tmp_path / "x"), str(tmp_path / "y")) == 1
    assert spark.read.parquet(str(tmp_path / "y.ktab")).count() == 1
    assert artifacts.copy(spark, str(tmp_path / "x"), str(tmp_path / "y"), overwrite=False) == 0
    assert artifacts.remove(spark, str(tmp_path / "x")) == 1
    assert not os.path.exists(tmp_path / "x.ktab")


def stored_words(spark, tmp_path, seed, n, name):
    r = random.Random(seed)
    rows = {"".join(r.choices("acgt", k=9)): r.randint(1, 40) for _ in range(n)} | {"aaaaaa" + "".join(x): 3 for x in product("acgt", repeat=3)}
    path = str(tmp_path / f"{name}.ktab")
    df = spark.createDataFrame(sorted(rows.items()), "kmer string, count int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        artifacts.write_table(df, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return rows, path


def test_stored_table_by_ordinal_and_word(spark, tmp_path):
    rows, path = stored_words(spark, tmp_path, 1, 3000, "x")
    order = sorted(rows)
    files_of = lambda df: len(set(df.inputFiles()))
    assert len(set(spark.read.parquet(path).inputFiles())) > 3
    assert artifacts.words_of(spark, path) == len(order)
    got = artifacts.numbered(spark, path, 100, 130)
    assert {r["ord"]: (r["kmer"], r["count"]) for r in got.collect()} == {i: (order[i], rows[order[i]]) for i in range(100, 131)}
    one = artifacts.numbered(spark, path, 1500, 1500)
    assert files_of(one) == 1 and one.first()["kmer"] == order[1500]
    assert {r["kmer"]: r["ord"] for r in artifacts.numbered(spark, path).collect()} == {w: i for i, w in enumerate(order)}
    assert artifacts.numbered(spark, path, len(order), None).count() == 0
    for word in ("a", "GATTACA", order[7], "ttttttttt", "zz"):
        found = artifacts.seek_stored(spark, path, word)
        assert [r["kmer"] for r in found.collect()] == [w for w in order if w >= word.lower()][:1]
    assert files_of(artifacts.seek_stored(spark, path, "gattaca")) == 1
    assert "Window" not in artifacts.numbered(spark, path, 5, 900)._jdf.queryExecution().toString()


def test_stored_tables_merge_without_exchange(spark, tmp_path):
    made = [stored_words(spark, tmp_path, seed, n, f"t{seed}") for seed, n in ((1, 3000), (2, 50), (3, 1200))]
    empty = str(tmp_path / "e.ktab")
    artifacts.write_table(spark.createDataFrame([], "kmer string, count int"), empty)
    for rows in (10, 700, 1 << 20):
        wide = artifacts.aligned_stored(spark, [p for _, p in made] + [empty], rows)
        assert "Exchange" not in wide._jdf.queryExecution().toString()
        got = {r["kmer"]: (r["c0"], r["c1"], r["c2"], r["c3"]) for r in wide.collect()}
        assert got == {w: (*(t.get(w, 0) for t, _ in made), 0) for w in set().union(*(t for t, _ in made))}
        assert wide.count() == len(got)


def blocked(raw, size):
    """Blocks that name their size, as aligners write them, and an empty one at the end."""
    out = []
    for piece in [*(raw[i : i + size] for i in range(0, len(raw), size)), b""]:
        own = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = own.compress(piece) + own.flush()
        out.append(b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(piece), len(piece)))
    return b"".join(out)


@pytest.mark.parametrize("block", [40, 700, 60_000])
def test_bam_in_ranges_equals_one_range(spark, tmp_path, block):
    r = random.Random(block)
    letters = ["".join(r.choice("acgtn") for _ in range(r.choice([0, 5, 90, 400]))) for _ in range(400)] + ["acgt" * 3000] + ["ggc"] * 30
    flags = [r.choice([0, 0, 16, 256, 2048]) for _ in letters]
    raw = b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 0) + b"".join(bam_record(f, x) for f, x in zip(flags, letters, strict=True))
    (tmp_path / "x.bam").write_bytes(data := blocked(raw, block))
    want = list(enumerate(x for f, x in zip(flags, letters, strict=True) if not f & 0x900))
    assert seqs(files.read_sequences(spark, str(tmp_path / "x.bam"))) == want
    for size in (len(data) // 4 + 1, 997, 10_000):
        found = files._bam(spark, str(tmp_path / "x.bam"), size)
        assert seqs(found) == want
    with pytest.raises(ValueError):
        list(files.bam_range(lambda at, n: data[:-60][at : at + n], len(data) - 60, 0, len(data), 15))


def test_kinds_of_a_column(spark):
    names = ["x.fa", "X.FASTA.GZ", "a/b.fq", "c.sam", "c.bam", "d.cram", "e.dam", "e.txt", None]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.select(files.kind_column(F.col("p"))).collect()] == ["fasta", "fasta", "fastq", "sam", "bam", "cram", "two-bit", None, None]
