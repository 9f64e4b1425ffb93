import random
import re
import zlib
from hashlib import sha256

import duckdb
from pyspark.sql import functions as F

from seqloom.llm import merkle as M


def h(x):
    return sha256(x.encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The root, and for each node its siblings on the way as (before, after)."""
    paths = [[] for _ in nodes]
    own = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, kept = [], []
        for i in range(0, len(nodes), 16):
            run = nodes[i : i + 16]
            for j in range(len(run)):
                for k in own[i + j]:
                    paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h("".join(run)))
            kept.append([k for x in own[i : i + 16] for k in x])
        nodes, own = up, kept
    return nodes[0], paths


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text): the results, sorted."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], h("".join(map(part, r))), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = climb([x[1] for x in by[s]])
    root, tops = climb([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (key, leaf, r), path in zip(by[s], trees[s][1], strict=True):
            node = leaf
            if key is not None and zlib.crc32(str(key).encode()) % 5 == 0:
                text = r[4] and re.sub("[A-Z]", lambda m: m[0].lower(), r[4])
                node = h("".join(map(part, (*r[:4], text))))
            for before, after in path + top:
                node = h(before + node + after)
            out.append((key, leaf, trees[s][0], root, h("".join(b + a for b, a in path + top)), node, node == root))
    return sorted(out, key=str)


def made(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, rank int, `a.b` int, key int")
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    got = M.manifest(docs.repartition(7), tampered=tampered, changes={"text": M.ascii_lower(F.col("text"))}, **options)
    return got, sorted((tuple(r) for r in got.drop("leaf_rank").collect()), key=str)


def odd_rows(n, seed=2):
    rng = random.Random(seed)
    sources = ["hot", "hot", "hot", None, "", "a", "é", "Z", *(f"s{i}" for i in range(40))]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "Ab:c", "ü" * 50, f"Text {i}", f"plain {i}"])
        rows.append((rng.choice([i, i, -i, 7, 1 << 60]), rng.choice(sources), rng.choice([None, "", "de"]), rng.choice([None, i, -3]), text))
    return rows + [(None, "hot", None, None, f"n{i}") for i in range(30)]


def test_against_brute_force(spark):
    rows = odd_rows(1500)
    rows = list(dict.fromkeys(rows))
    got, found = made(spark, rows)
    assert found == brute(rows)
    assert {r[-1] for r in found} == {True, False}
    ranks = {}
    by = {r[1]: r for r in found}
    assert len(by) == len(found)
    for r in got.collect():
        ranks.setdefault(r["subroot"], []).append(r["leaf_rank"])
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())


def test_crowded_prefixes_are_counted_by_longer_ones(spark):
    rows = [(7, "hot", None, i, None) for i in range(300)] + [(i * 1000, "hot", None, 1, "T") for i in range(200)] + [(-5 - (1 << 62), "x", None, 2, "")]
    rows += [(5, "x" * 5 + str(i), None, None, "one") for i in range(60)]
    assert made(spark, rows, bucket=4)[1] == brute(rows)


def test_several_subtrees(spark):
    rows = [(i, "b" if i % 9 else "c", "x", 1, f"A{i}") for i in range(700)]
    assert made(spark, rows, inside=1)[1] == brute(rows)


def test_repeated_rows_one_row_and_empty_table(spark):
    rows = [(5, "s", "l", 1, "Same")] * 40
    found = made(spark, rows)[1]
    assert len(found) == 40 and found == brute(rows)
    assert made(spark, [(1, None, None, None, None)])[1] == brute([(1, None, None, None, None)])
    assert made(spark, [])[1] == []


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["doc_id", "leaf_rank", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = M.op13_merkle(spark, sf)
    assert got.columns == columns
    assert sorted(duckdb.sql(f"SELECT {', '.join(columns)} FROM ({M.SQL})").fetchall()) == sorted(tuple(r) for r in got.collect())
