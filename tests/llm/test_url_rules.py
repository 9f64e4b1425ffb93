import random
import re

import duckdb

from seqloom.llm import url_rules as U


def brute(host, path, rules, globs, default="allow"):
    fits = [(len((h + p).encode()), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, verdict, name = max(fits)
        return name, None, verdict
    for v, text in sorted(globs, key=lambda g: U.glob(*g).rank):
        if re.fullmatch(U.glob_regex(text), "." + host + path, re.S):
            return None, text, v
    return None, None, default


def test_odd_urls_against_brute_force(spark):
    pieces = ["http://", "https://", "://", "a", "org", ".", "example.org", "com", "/", "/fr/", "/es/", "?", "#", "spam-", "ü", "\n", "*", "m.", "x.net", "EXAMPLE.Org", "/en/1", ".html", "@", ":80", "/de", "casino"]
    rng = random.Random(3)
    urls = [None, "", "://", "http://", "no scheme", "http://org", "http://org/", "http://a.b/" + "x" * 9000 + ".html", "http://m.é.net/ü/a0"] + ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(3000)]
    rows = [(i % 2900, u, "mine", 3) for i, u in enumerate(urls)] + [(None, "http://a.org/", "mine", 3)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, `a.b` int")
    patterns = [*(U.rule(*r) for r in U.RULES), *(U.glob(*g) for g in U.GLOBS)]
    got = U.judged(pages, patterns, keep=("page_id", "url", "rule", "a.b")).collect()
    assert len(got) == len(rows) and {r["a.b"] for r in got} == {3}
    verdicts = set()
    for r in got:
        url = r["url"] or ""
        rest = url.partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["pattern"], r["verdict"]) == brute(host, path, U.RULES, U.GLOBS), url
        verdicts.add((r["rule"], r["pattern"]))
    assert len(verdicts) > 7


def test_many_patterns_span_words(spark):
    rng = random.Random(5)
    rules = [("block" if i % 3 else "allow", rng.choice("abc") + "." + rng.choice(["net", "org", "info"]), "/" + "".join(rng.choices("xy", k=rng.randint(0, 6)))) for i in range(150)]
    rules = list({h + p: (v, h, p) for v, h, p in rules}.values())
    globs = [("block", "*" + "".join(rng.choices("xyz?*", k=5)) + "*") for _ in range(60)]
    automaton = U.Automaton([*(U.rule(*r) for r in rules), *(U.glob(*g) for g in globs)])
    assert automaton.words > 20
    import pyarrow as pa

    urls = [(rng.choice(["", "w."]) + rng.choice("abcd") + "." + rng.choice(["net", "org", "info"]), "/" + "".join(rng.choices("xyz/", k=rng.randint(0, 12)))) for _ in range(800)]
    texts = ["." + h + p for h, p in urls]
    found = automaton.first_matches(pa.array(texts))
    for (h, p), text, i in zip(urls, texts, found.tolist(), strict=True):
        name, pattern, verdict = brute(h, p, rules, globs)
        assert (name or pattern) == (automaton.patterns[i].name if i >= 0 else None)
        assert automaton.first_of(text.encode()) == i


def test_no_patterns_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in U.judged(pages, [], "block").collect()] == [(1, "a", "/b", None, None, "block")]
    assert U.judged(pages.where("false"), [U.rule("allow", "org", "/")]).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    rows = duckdb.sql(U.SQL).fetchall()
    got = U.op11_url_rules(spark, sf).select("page_id", "host", "path", "rule", "pattern", "verdict").collect()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in got)
    assert len({r[4] for r in rows}) > 3
