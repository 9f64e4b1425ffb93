import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.llm import quality_rules, sharding, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if seen[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_metrics_against_brute_force(docs):
    r = random.Random(6)
    texts = [None, "", " \x0b\n", "a", "a b c a b c", "x\nx\n x\n\nx", "  é #", "w " * 30_000, "# * $ % & | < >", "A\x0cB\rC"]
    texts += [" ".join(r.choice(["aa", "b", "#", "c\n", "the", "d\te"]) for _ in range(r.randint(1, 90))) for _ in range(150)]
    rows = list(enumerate(texts))
    got = quality_rules.verdicts(docs(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    for row in got:
        want = base(texts[row["doc_id"]])
        assert tuple(row)[1:6] == want
        assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row["base_failed"] and row["kept"])


def test_windows_that_share_a_hash_are_told_apart(docs):
    r = random.Random(7)
    texts = [" ".join(f"w{i}" for i in range(5000)), " ".join(["a b c", *(f"x{i}" for i in range(400)), "a b c d", *(f"y{i}" for i in range(400)), "b c d"])]
    texts += [None, "a b", "a b c a b c", " ".join(r.choice("abcdefgh") for _ in range(300))]
    want = [(i, base(t)[4]) for i, t in enumerate(texts)]
    for bits in (1, 7, 64):
        got = quality_rules.measured(docs(list(enumerate(texts))), hash_bits=bits).select("doc_id", "n_repeat_words").collect()
        assert sorted(map(tuple, got)) == want


def test_no_python_in_native_plans(docs):
    rows = [(1, "a"), (2, None)]
    for df in (quality_rules.verdicts(docs(rows)), sharding.sharded(docs(rows))):
        assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_shards_are_gapless_and_grow_into_the_new_one(spark):
    df = spark.range(3000).select(F.when(F.col("id") > 5, F.col("id")).alias("doc_id"))
    got = sharding.sharded(df).collect()
    for shard in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert {r["grown_shard"] for r in got if r["grown_shard"] != r["shard"]} == {8}
    assert abs(sum(r["grown_shard"] == 8 for r in got) / 3000 - 1 / 9) < 0.03
    again = {r["doc_id"]: r["shard"] for r in sharding.sharded(df, (1.0,) * 9).collect()}
    assert all(again[r["doc_id"]] == r["grown_shard"] for r in got)
    heavy = Counter(r["shard"] for r in sharding.sharded(df, (3.0, 1.0)).collect())
    assert abs(heavy[0] / 3000 - 0.75) < 0.04
    assert sharding.sharded(df.limit(0)).count() == 0


def test_shards_equal_rendezvous_by_hand(spark):
    rows = [(None, "a"), (None, "b"), (5, None), *((i % 400, f"t{i}") for i in range(900))]
    weights = [1.0, 2.5, 0.5]

    def shard(key, over):
        digest = lambda s: (int(hashlib.md5(f"{key}#{s}".encode()).hexdigest()[:13], 16) + 1) / float(16**13 + 1)
        return min(range(len(over)), key=lambda s: (-math.log(digest(s)) / over[s], s))

    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), weights, grown_weight=2.0, spread=["text"]).collect()
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (shard(key, weights), shard(key, [*weights, 2.0]))
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_a_hot_key_has_many_ranges(spark):
    df = spark.range(5000).selectExpr("CAST(NULL AS LONG) AS doc_id", "id AS text_crc32")
    got = sharding.sharded(df, spread=["text_crc32"])
    assert sorted(r["slot"] for r in got.collect()) == list(range(5000))
    assert df.select(F.substring(F.md5(F.concat_ws("/", F.lit(""), F.col("text_crc32").cast("string"))), 1, 3)).distinct().count() > 2000


def test_clashing_names_are_replaced_or_kept(spark):
    names = ["doc_id", "text", "N_Words", "n_lines", "kept", "_words", "__words", "shard", "Slot", "_name", "n_tokens", "n_bytes", "a.b"]
    df = spark.createDataFrame([(1, "a b c", *range(11)), (2, None, *range(11))], names)
    got = quality_rules.verdicts(df)
    assert len({c.lower() for c in got.columns}) == len(got.columns) and {"_words", "__words", "a.b"} <= set(got.columns)
    assert [(r["n_words"], r["n_lines"], r["_words"]) for r in got.orderBy("doc_id").collect()] == [(3, 1, 3), (0, 0, 3)]
    assert quality_rules.verdicts(df.limit(0)).count() == 0
    got = sharding.sharded(df)
    assert len({c.lower() for c in got.columns}) == len(got.columns) and [r["_name"] for r in got.collect()] == [7, 7]
    got = token_counts.token_counts(df, public_tokenizers.path("piece_bpe_32k.model"), keep=tuple(names))
    assert len({c.lower() for c in got.columns}) == len(got.columns) and sorted(r["n_bytes"] for r in got.collect()) == [0, 5]


def test_shard_query_columns(spark, sf):
    rows = sharding.op6_sharding(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))


def test_token_counts_equal_the_library(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = token_counts.piece_model(path)
    r = random.Random(9)
    parts = ["a", " ", "  ", "\n", "ß", "▁", "<s>", "漢", "word", " ", "\t"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(2000)] + [None, "", "long " * 50_000, "x" * 20_000]
    got = token_counts.lengths_of(pa.array(texts, pa.string()), model, {})
    assert got.tolist() == [len(model.encode(t or "")) for t in texts]
    rows = token_counts.token_counts(docs(list(enumerate(texts[-4:]))), path).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_tokens"]) for x in rows} == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(texts[-4:])}
    assert token_counts.token_counts(docs([(1, "a")]).limit(0), path).count() == 0
