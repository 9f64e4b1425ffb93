import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

import corpus_pipeline
from seqloom.llm.exact_dedup import PatriciaTrie, exact_duplicates


@given(st.lists(st.tuples(st.binary(max_size=12), st.integers(0, 99)), max_size=60), st.integers(1, 40))
def test_trie_owners_with_spill(rows, budget):
    import tempfile

    with tempfile.TemporaryDirectory() as scratch:
        trie = PatriciaTrie(budget=budget, scratch=scratch)
        want = {}
        for key, owner in rows:
            trie.insert(key, owner, 1, key)
            least, n = want.get(key, (owner, 0))
            want[key] = (min(least, owner), n + 1)
        assert {tag: (owner, n) for owner, n, tag in trie.owners()} == want


def test_spill_happens(tmp_path):
    trie = PatriciaTrie(budget=50, scratch=str(tmp_path))
    r = random.Random(1)
    for i in range(200):
        trie.insert(bytes(r.choice(b"ab") for _ in range(30)), i, 1, b"")
    assert trie.spilled


def brute(rows, largest):
    groups = {}
    for d, t in rows:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(key, []).append(d)
    out = []
    for d, t in rows:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        known = [x for x in groups[key] if x is not None]
        keep = (max if largest else min)(known) if known else None
        out.append((d, keep, len(groups[key]), d == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(docs):
    rows = [(1, "Same"), (2, "sAME"), (3, "ÄB"), (4, "äb"), (5, None), (6, ""), (7, " "), (7, " "), (None, "same"), (None, "alone"), (8, "x" * 300_000), (9, "X" * 300_000), (10, "x" * 299_999)]
    rows += [(100 + i, "hot copy") for i in range(300)]
    for keep in ("largest", "smallest"):
        got = exact_duplicates(docs(rows), keep=keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, keep == "largest")
    small = exact_duplicates(docs(rows), budget=2000).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()  # tries are passed on and spilled
    assert sorted(map(tuple, small), key=str) == brute(rows, False)


def test_one_row_of_each_text_reaches_the_next_stage(docs, spark, sf):
    rows = [(1, "same"), (1, "Same"), (2, "same"), (3, "three"), (None, "lost"), (None, "LOST"), (None, "alone"), (4, None), (4, ""), (5, "x"), (None, "x")]
    got = corpus_pipeline.exact_stage(spark, docs(rows, more=False), sf).collect()
    assert sorted(((r["doc_id"], (r["text"] or "").lower()) for r in got), key=str) == sorted([(1, "same"), (3, "three"), (None, "lost"), (None, "alone"), (4, ""), (5, "x")], key=str)


def test_empty_table(docs):
    assert exact_duplicates(docs([(1, "a")]).limit(0)).count() == 0
