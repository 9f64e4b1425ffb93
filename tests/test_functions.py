import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import codec, ranges
from seqloom.sources.artifacts import packed_word, unpacked_word


def test_two_bit_code():
    assert packed_word("tacg") == b"\xc6"
    assert unpacked_word(b"\xc6", 4) == "tacg"


@given(st.text("acgt", min_size=1, max_size=70))
def test_two_bit_round_trip(word):
    assert unpacked_word(packed_word(word), len(word)) == word


@settings(deadline=None)
@given(st.lists(st.integers(0, 32767), max_size=300))
def test_profile_code_round_trip(counts):
    assert codec.decode(codec.encode(counts)) == counts


def test_profile_code_bytes():
    assert codec.encode([127]) == b"\x7f"
    assert len(codec.encode([128])) == 2
    assert codec.decode(codec.encode([32766]) + bytes([64 | 3])) == [32766, 1]
    assert codec.decode(b"\x05" + bytes([4])) == [5] * 5
    assert codec.encode([]) == b"" and codec.decode(b"") == []
    assert len(codec.encode([7] * 200)) == 5


def test_count_ranges():
    assert ranges.count_ranges("7-, 2-3,3-5 ,-1") == [(1, 1), (2, 5), (7, 32767)]
    assert ranges.count_ranges("-") == [(1, 32767)]
    for wrong in ("", "a", "1-2-3", "1,,2"):
        with pytest.raises(ValueError):
            ranges.count_ranges(wrong)


def test_addresses():
    assert ranges.after_prefix("acgt") == "act"
    assert ranges.after_prefix("ttt") is None
    assert ranges.address("aaaac-cacaca") == ("prefix", "aaaac", "cacacc")
    assert ranges.address("5-9") == ("ordinal", 5, 9)
    with pytest.raises(ValueError):
        ranges.address("9-5")


def test_read_ranges():
    assert ranges.read_ranges([], 9) == [(1, 9)]
    assert ranges.read_ranges(["3-#", "2"], 9) == [(3, 9), (2, 2)]
    with pytest.raises(ValueError):
        ranges.read_ranges(["0"], 9)


def test_grouped_numbers():
    assert ranges.grouped_number(1234567) == "1,234,567"


def test_bytes_of_pieces_join_to_those_of_the_whole_form(spark):
    r = np.random.default_rng(6)
    wholes = [np.repeat(r.integers(0, high, 40), r.choice([1, 2, 62, 63, 64, 130], 40)).tolist() for high in (1, 2, 40, 300, 32768) for _ in range(8)]
    rows = [(i, codec.edges_all(pa.array([w[at : at + size] for at in range(0, len(w), size)], pa.list_(pa.int32()))).to_pylist()) for i, w in enumerate(wholes) for size in (1, 50, 64, 700)]
    fields = ",".join(f"{n}:bigint" for n in codec.EDGES.names)
    got = spark.createDataFrame(rows, f"i int, parts array<struct<{fields}>>").select("i", codec.joined_bytes(F.col("parts")).alias("n")).collect()
    assert len(got) == 4 * len(wholes) and all(g["n"] == len(codec.encode(wholes[g["i"]])) for g in got)
