import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from seqloom.llm import packing

MODEL = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.integers(1, 20), min_size=1, max_size=40), st.booleans())
def test_windows_hold_every_token_once(sizes, cuts):
    windows = packing.windows_of(sizes, 20, cuts)
    seen = sorted(x for w in windows for x in w)
    assert all(sum(n for _, _, n in w) <= 20 for w in windows)
    for i, size in enumerate(sizes):
        places = [(s, n) for j, s, n in seen if j == i]
        assert sum(n for _, n in places) == size and (cuts or len(places) == 1)
    if cuts:
        assert len(windows) == -(-sum(sizes) // 20)
        assert sum(len(w) for w in windows) <= len(sizes) + len(windows)  # a window is cut once at most


def test_cuts_fill_all_windows_and_whole_items_raise_the_count():
    r = random.Random(3)
    sizes = []
    while sum(sizes) < 64 * 1024:
        sizes.append(min(r.randint(1, 1023), 64 * 1024 - sum(sizes)))
    assert [sum(n for _, _, n in w) for w in packing.windows_of(sizes, 1024, True)] == [1024] * 64
    whole = packing.windows_of(sizes, 1024, False)
    assert 64 < len(whole) < 75 and all(sum(n for _, _, n in w) <= 1024 for w in whole)


def test_differencing_equals_the_method_by_hand(spark):
    # two ways: repeatedly replace the two largest by their difference
    r = random.Random(6)
    for _ in range(50):
        sizes = [r.randint(1, 100) for _ in range(r.randint(1, 12))]
        left = sorted(sizes)
        while len(left) > 1:
            a, b = left.pop(), left.pop()
            left = sorted([*left, a - b])
        sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 2)]
        assert max(sums) - min(sums) == left[0]


def test_differencing_is_near_equal():
    r = random.Random(2)
    sizes = [r.randint(1, 500) for _ in range(300)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 40)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 20


def test_pieces_equal_the_library():
    r = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "'s", "'", "ß", "!", "\x85", "\x1c", "漢", "<|endoftext|>", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)] + [None]
    ids, counts = packing.Encoder(MODEL).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts, strict=True):
        assert ids[end - n : end].tolist() == packing.byte_model(MODEL).encode(text or "", add_special_tokens=False).ids


def test_round_trip_and_padding(docs):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "Of", "zebra", "ß9"]) for _ in range(r.randint(0, 600)))) for i in range(150)] + [(900, None), (901, ""), (902, "word " * 9000)]
    pieces = packing.packed(docs(rows), MODEL).toPandas()
    for doc, text in rows:
        ids = np.array([*packing.byte_model(MODEL).encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own, at = pieces[pieces.doc_id == doc].sort_values("start"), 0
        for p in own.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        total = int(own.length.sum())
        assert own.offset.tolist() == np.concatenate(([0], np.cumsum(own.length)[:-1])).tolist()
        assert total == 1024 or total & (total - 1) == 0


def test_null_and_text_keys(spark):
    rows = [("a", "x y"), (None, "z"), ("a", "x y")]
    got = packing.packed(spark.createDataFrame(rows, "doc_id string, text string"), MODEL).collect()
    assert sorted({str(r["doc_id"]) for r in got}) == ["None", "a"] and sum(r["length"] for r in got if r["doc_id"] == "a") == 2 * got[0]["doc_tokens"]


def test_empty_table(docs):
    assert packing.packed(docs([(1, "a")]).limit(0), MODEL).count() == 0
