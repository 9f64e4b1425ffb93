import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import html_text, mixing


def test_exponent_meets_entropy_and_repetition():
    tokens = [900, 50, 30, 20]
    target = 0.8 * math.log(4)
    t = mixing.exponent_for(tokens, 1000, target, 100)
    assert abs(mixing.entropy(mixing.weights_at(t, tokens)) - target) < 1e-6
    t = mixing.exponent_for(tokens, 1000, math.log(4), 3)
    assert abs(mixing.repetition(mixing.weights_at(t, tokens), tokens, 1000) - 3) < 1e-6
    assert mixing.exponent_for([5, 5], 10, 0.1, 9) == 1.0
    with pytest.raises(ValueError):
        mixing.exponent_for(tokens, 10_000, 0.1, 3)


def test_draws_meet_budgets(spark):
    sizes = {"big": 3000, "mid": 300, "small": 60, None: 40}
    rows = [(f"{s}-{i}", s, "w " * (1 + i % 7)) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string")
    got = mixing.mixed(docs, entropy_share=0.8).collect()
    natural, drawn = Counter(), Counter()
    for _, s, text in rows:
        natural[s] += len(text.split())
    for r in got:
        drawn[r["source"]] += r["n_tokens"]
    plans = {p.source: p for p in mixing.planned({"null" if s is None else "=" + s: n for s, n in natural.items()}, None, 0.8, 4)}
    for s, n in natural.items():
        p = plans["null" if s is None else "=" + s]
        assert 0 <= p.passes * n + p.left - drawn[s] < 7
    times = Counter((r["doc_id"], r["pass_no"]) for r in got)
    assert set(times.values()) == {1} and max(Counter(r["doc_id"] for r in got).values()) <= 4
    full = {(r["source"], r["pass_no"]) for r in got if r["pass_no"] < plans["null" if r["source"] is None else "=" + r["source"]].passes}
    for s, number in full:
        assert sum(1 for r in got if r["source"] == s and r["pass_no"] == number) == sizes[s]


def test_permutations_and_last_pass_by_hand(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 8)
    monkeypatch.setattr(mixing, "RANGE_BITS", 3)
    rows = [(i, "ab"[i % 5 == 0], "w " * (i % 7)) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(docs, entropy_share=1.0).collect()
    natural = Counter()
    for _, s, text in rows:
        natural["=" + s] += len(text.split())
    plans = {p.source[1:]: p for p in mixing.planned(natural, None, 1.0, 4.0, Counter("=" + s for _, s, _ in rows))}
    assert plans["b"].passes >= 1 and plans["a"].blocks > 100
    block_of = {r["doc_id"]: r["block"] for r in got}
    orders = {}
    for s, p in plans.items():
        for number in range(p.passes + 1):
            own = [r for r in got if r["source"] == s and r["pass_no"] == number]
            order = {r["block"]: r["place"] for r in own}
            assert len(set(order.values())) == len(order) and all(order[r["block"]] == r["place"] for r in own)
            orders[s, number] = order
            if number < p.passes:
                assert sorted(order.values()) == list(range(len(order))) and len(own) == sum(x[1] == s for x in rows)
                continue
            # whole blocks in the order of places, then part of the next one
            sizes, counts = Counter(), Counter()
            for i, source, text in rows:
                if source == s and i in block_of:
                    sizes[block_of[i]] += len(text.split())
                    counts[block_of[i]] += 1
            left, drawn = p.left, Counter(r["block"] for r in own)
            for block in sorted(order, key=order.get):
                if sizes[block] <= left:
                    assert drawn[block] == counts[block]
                    left -= sizes[block]
                else:
                    assert order[block] == max(order.values())
                    assert sum(r["n_tokens"] for r in own if r["block"] == block) <= left
    assert orders["b", 0] != orders["b", 1]


def test_mixing_clashing_names(spark):
    names = ["doc_id", "text", "source", "_group", "_hash", "Place", "n_tokens", "turn", "size"]
    df = spark.createDataFrame([(1, "a b", "s", *range(6)), (2, "c", None, *range(6))], names)
    got = mixing.mixed(df)
    assert got.columns == ["doc_id", "text", "source", "_group", "_hash", "turn", "size", "n_tokens", "pass_no", "block", "place"]
    assert {(r["n_tokens"], r["_group"], r["size"]) for r in got.collect()} == {(2, 0, 5), (1, 0, 5)}


def test_mixing_odd_rows(docs):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "c"), (3, "c")]
    assert mixing.mixed(docs(rows)).count() == 5
    assert mixing.mixed(docs(rows).limit(0)).count() == 0
    assert mixing.mixed(docs([(1, None), (2, "")])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:">"}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><a href="/a">Menu one</a><a href="/b">Menu two</a></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies here.</div>
%s<div class="comments"><p>First reader comment, long enough to look like a text paragraph of the page.</p></div><form><input value="x">Search<button>Go</button></form>
<aside>Side bar text</aside><footer>&copy; 2020</footer></body></html>"""
BODY = "<h1>Head &amp; line</h1><p>One  two\n three <b>bold</b>, <a href='x'>link</a>.<p>Second paragraph, unclosed &lt;tag&gt; and a&nbsp;space.<ul><li>item one<li>item two</ul><div class='ad'>Buy now</div><p>Last&#33;</p>"
TEXT = "Head & line\nOne two three bold, link.\nSecond paragraph, unclosed <tag> and a space.\nitem one\nitem two\nLast!"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", "<article>%s"])
def test_main_text(wrap):
    assert html_text.main_text(PAGE % (wrap % BODY)) == TEXT


LONG = "".join(f"<p>Paragraph number {i} has quite a few words in it, and so it weighs something.</p>" for i in range(8))


@pytest.mark.parametrize(
    "wrap",
    [
        "<div class='layout has-sidebar'>%s</div>",
        "<div id=page class='no-sidebar'>%s</div>",
        "<div class='nav-open'>%s</div>",
        "<div class='sidebar'>%s</div>",
        "<form action=/x>%s</form>",
        "<form><div class='comments widget'><main>%s</main></div></form>",
        "<article><div class='entry-header'>%s</div></article>",
        "<div><div class='share-price ad-hoc notice-board'>%s</div></div>",
    ],
)
def test_names_and_forms_do_not_lose_the_text(wrap):
    side = "<div class='comments-area'><p>A comment.</p></div><div class='site-header'>Site</div><form>Search</form><div class='cookie-notice'>Cookies</div>"
    text = html_text.main_text("<body>" + wrap % LONG + side + "</body>")
    assert text.count("\n") == 7 and text.startswith("Paragraph number 0") and text.endswith("something.")


def test_headline_stays_and_long_comments_go():
    comments = "<div class='comments'>" + "<article class=comment-body><p>A reader says a good many things about this.</p></article>" * 30 + "</div>"
    page = "<body><article><div class='entry-header'><h1>Head</h1></div>%s<div class='share-price'>Up 3</div></article>%s</body>" % (LONG, comments)
    text = html_text.main_text(page)
    assert text.startswith("Head\nParagraph") and text.endswith("Up 3") and "reader" not in text


def test_main_text_without_semantic_elements():
    long = "".join(f"<p>Paragraph number {i} has quite a few words in it, and so it weighs something.</p>" for i in range(8))
    page = f"<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div id=x><div>{long}</div></div><div><a href=4>more</a><a href=5>links</a></div></body>"
    text = html_text.main_text(page)
    assert text.count("\n") == 7 and "one" not in text and "links" not in text


@pytest.mark.parametrize(
    "end",
    [
        "<p title='A hidden gem'>Gem.</p>",
        "<p data-id='comment'>Gem.</p>",
        "<p data-state=hidden data-role=navigation>Gem.</p>",
        "<svg/><p>Gem.</p>",
        "<svg><path d=M0/><title>bad</title><style/><svg/>bad</svg><p>Gem.</p>",
        "<p data-x=it's>Gem.</p><p title=it's></p>",
        "<section id='notice-of-meeting'><p>Gem.</p></section>",
        "<template><template>bad</template>bad</template><p>Gem.</p>",
        "<a name='x'/><p>Gem.</p>",
        "<noscript><p>bad</p></noscript><p hidden>bad</p><p class=hidden-gem>Gem.</p>",
        "<p title='a > b' class=x=y>Gem.</p>",
        "<script>'</scripty>' + bad</script><textarea><p>bad</textarea><p>Gem.</p>",
        "<!--><p>Gem.</p><!-- bad --!>",
    ],
)
def test_attributes_and_odd_markup_lose_nothing(end):
    text = html_text.main_text(f"<body><article>{LONG}{end}</article></body>")
    assert text.count("\n") == 8 and text.endswith("\nGem.")
    assert html_text.main_text(f"<body><form action=/x>{LONG}{end}</form></body>").endswith("\nGem.")


def test_references_are_decoded_within_their_own_text():
    assert html_text.main_text("<article><p>a &am<b></b>p; &lt;b&gt; &#x41;&nbsp;&notit;</p></article>") == "a &amp; <b> A \u00acit;"


@pytest.mark.parametrize("part", ["<div><b>", "<div>", "<svg/>", "</p>", "<ul><li>", "<a href='x>", '<a ="', "<p></i>", "<!--", "<table><tr><td>"])
def test_time_follows_the_length(part):
    def taken(n):
        start = time.process_time()
        html_text.main_text(part * n + "</i>" * n)
        return time.process_time() - start

    assert taken(40_000) < 10 * max(taken(10_000), 0.01)


def density_by_recursion(node, all_chars, all_links):
    """(characters, linked ones, tags, link tags, density, sum) of a tree of (name, text, children), straight from the definitions."""
    name, text, children = node
    parts = [density_by_recursion(c, all_chars, all_links) for c in children]
    linked = name == "a"
    chars = len(text) + sum(p[0] for p in parts)
    links = chars if linked else sum(p[1] for p in parts)
    tags = 1 + sum(p[2] for p in parts)
    link_tags = linked + sum(p[3] for p in parts)
    density = 0.0
    if chars:
        base = math.log(chars / max(chars - links, 1) * links + all_links / all_chars * chars + math.e)
        density = max(chars / tags * math.log(max(chars / max(links, 1) * tags / max(link_tags, 1), 1 + 1e-9)) / base, 0.0)
    return chars, links, tags, link_tags, density, sum(p[4] for p in parts) or density


def test_densities_equal_the_definition():
    r = random.Random(3)

    def tree(depth):
        name = r.choice(["div", "section", "span", "a"]) if depth else "div"
        children = [tree(depth + 1) for _ in range(r.randint(0, 4))] if depth < 4 and name != "a" else []
        return name, "x" * r.randint(0, 60), children

    def html(node):
        return f"<{node[0]}>{node[1]}{''.join(map(html, node[2]))}</{node[0]}>"

    def walk(node):
        yield node
        for c in node[2]:
            yield from walk(c)

    for _ in range(60):
        root = ("html", "", [tree(0) for _ in range(3)])
        page = html_text.Page("".join(map(html, root[2])))
        chars, links = density_by_recursion(root, 1, 1)[:2]
        density, sums = page.densities()
        want = [density_by_recursion(n, max(chars, 1), links)[4:] for n in walk(root)]
        assert np.allclose(list(zip(density, sums, strict=True)), want)
        heart = max(range(len(want)), key=lambda i: (want[i][1], -i))
        assert page.content()[heart] or not chars


def test_odd_pages(spark):
    assert [html_text.main_text(x) for x in (None, "", "<p", "<!-- x", "<div></div>", "plain")] == ["", "", "", "", "", "plain"]
    assert html_text.main_text("<div>" * 50_000 + "deep") == "deep"
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    clash = spark.createDataFrame([("<p>a</p>", "old", 9)], "html string, text string, N_Chars int")
    assert html_text.extract_main_text(clash, keep=("html", "text", "N_Chars")).collect() == [("<p>a</p>", "a", 1)]
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, "<article><p>é𝄞</p></article>")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted(map(tuple, html_text.extract_main_text(pages).collect()), key=str) == [(1, "u", "", 0), (1, "u", "", 0), (2, None, "é𝄞", 2)]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.persisted(stage(spark, docs, sf))
        assert out.columns == docs.columns, name
        docs = out
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]
    pieces = corpus_pipeline.packing_stage(spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_whole_draw_of_the_query_by_hand(spark):
    """Every row of op9 on a table of uneven sources, dealt by plain loops."""
    sf = "/root/testdata/sf0.01"
    got = mixing.op9_mixing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    tokens = dict(mixing.op9_mixing.__globals__["token_counter"].__globals__["op8_token_counts"](spark, sf).select("doc_id", "n_tokens").collect())
    name, dealing = mixing._named(docs, "source", "doc_id", "text", 7)
    rows = docs.select("doc_id", "source", name.alias("g"), dealing.alias("h")).collect()
    totals, numbers = Counter(), Counter()
    for r in rows:
        totals[r["g"]] += tokens[r["doc_id"]]
        numbers[r["g"]] += 1
    sizes = [totals[g] for g in sorted(totals)]
    t = mixing.exponent_for(sizes, sum(sizes), mixing.target_of(sizes, 0.0, mixing.CLOSING), 4.0)
    assert 0 < t < 0.9
    plans = mixing.planned(totals, None, 0.0, 4.0, numbers)
    assert any(p.passes == 0 for p in plans) and any(p.passes == 1 and p.left for p in plans)
    table = spark.createDataFrame([(p.source, p.blocks, p.passes, p.left) for p in plans], "source string, blocks long, passes int, left long")
    turns = {(r["source"], r["pass_no"], r["block"]): r["turn"] % (1 << 64) for r in mixing.permuted(table, 7).collect()}
    asked = spark.createDataFrame([(p.source, k) for p in plans for k in range(p.passes + 1)], "g string, pass_no int")
    last = {(r["g"], r["pass_no"], r["h"]): r["t"] % (1 << 64) for r in spark.createDataFrame([(r["g"], r["h"]) for r in rows], "g string, h long").join(asked, "g").select("g", "pass_no", "h", F.xxhash64(F.lit(7), "g", "pass_no", "h").alias("t")).collect()}
    want = set()
    for p in plans:
        blocks = {}
        for r in rows:
            if r["g"] == p.source:
                blocks.setdefault(r["h"] % p.blocks, []).append(r)
        for number in range(p.passes + 1):
            left = p.left
            for place, block in enumerate(sorted(blocks, key=lambda b: (turns[p.source, number, b] >> 52, turns[p.source, number, b] - ((turns[p.source, number, b] >> 63) << 64)))):
                own = blocks[block]
                size = sum(tokens[r["doc_id"]] for r in own)
                if number == p.passes and left <= 0:
                    break
                if number < p.passes or size <= left:
                    taken = own
                    left -= size if number == p.passes else 0
                else:
                    taken, room = [], left
                    for r in sorted(own, key=lambda r: (last[p.source, number, r["h"]] >> 58, last[p.source, number, r["h"]] - ((last[p.source, number, r["h"]] >> 63) << 64), r["h"])):
                        room -= tokens[r["doc_id"]]
                        if room < 0:
                            break
                        taken.append(r)
                    left = 0
                want |= {(r["doc_id"], r["source"], tokens[r["doc_id"]], number, block, place) for r in taken}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_drawn_rows_are_those_of_mixed(spark):
    rows = [(i % 500, "abc"[(i % 10 > 6) + (i % 10 > 8)], "w " * (i % 7), i) for i in range(1500)] + [(3, "b", "w w", 0)] * 20 + [(None, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, place int")
    for options in ({}, {"least_repeats": 1.0, "most_repeats": 2.0}, {"budget": 900}):
        mine = mixing.drawn(docs, **options)
        assert mine.columns == docs.columns
        theirs = mixing.mixed(docs.withColumnRenamed("place", "p"), **options).select("doc_id", "source", "text", "p")
        assert Counter(map(tuple, mine.collect())) == Counter(map(tuple, theirs.collect()))
    times = Counter(map(tuple, mixing.drawn(docs.where("doc_id IS NOT NULL"), least_repeats=1.0, most_repeats=2.0).collect()))
    have = Counter(r for r in rows if r[0] is not None)
    assert all(times[r] >= n for r, n in have.items()) and sum(times.values()) > 1.1 * sum(have.values())


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_columns_of_any_name(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["kept", "score", "block", "place", "_row", "group_size", "a.b", "n_tokens", "pass_no", "keep_id", "text_sha256", "`x", "component_id", "_group"]
    odd = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    made = stage[1](spark, odd, sf)
    assert made.columns == odd.columns
    for r in made.collect():
        assert r[len(docs.columns) :] == tuple(n + str(r["doc_id"]) for n in names)
    assert made.count() == stage[1](spark, docs, sf).count() > 0


STORY = "<p>" + "A long paragraph of the story tells what happened, to whom, and when it was. " * 6 + "</p>"


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (f"<div class=story><p>Short lead.</p><div>{STORY * 4}</div><p>Short end.</p></div>", ["Short lead.", 4, "Short end."]),
        (f"<div><h1>headline</h1><div class=text>{STORY * 4}</div></div>", ["headline", 4]),
        (f"<section><p>First things come first.</p></section><section>{STORY * 3}</section><section><p>And the last ones last.</p></section>", ["First things come first.", 3, "And the last ones last."]),
        (f"<div class=post><p>They said this</p><blockquote>{STORY * 5}</blockquote><p>and we do not agree</p></div>", ["They said this", 5, "and we do not agree"]),
        (f"<div id=page><div class=head><h1>Title</h1></div><div>Lead text here.<br>{STORY * 3}and a tail</div><ul><li><a href=a>More stories</a></ul></div><div>&copy; 2020 Firm. All rights reserved.</div>", ["Title", "Lead text here.", 3, "and a tail"]),
        (f"<article>{STORY}</article><article class='comment'>{STORY * 6}</article>", [1]),
        (f"<article><p>We quote it.</p><article class=tweet>{STORY * 6}</article><p>So it was.</p></article>", ["We quote it.", 6, "So it was."]),
        (f"<article hidden>{STORY * 6}</article><div><p>Seen one.</p>{STORY}</div>", ["Seen one.", 1]),
        (f"<main><article>{STORY * 2}</article><article>{STORY}</article><article><a href=x>Teaser</a></article></main>", [3]),
        (f"<article>{STORY}<div id='google_ads_iframe'>x</div><p class='advertisement-label'>x</p><div class='adbox'>x</div><div class='comment_thread'>x</div></article>", [1]),
        (f"<div>{STORY}</div><article class='comment'>{STORY * 3}</article>", [1]),
        ("<article class='comment'><p>All there is.</p></article>", ["All there is."]),
    ],
)
def test_main_text_loses_nothing_beside_the_heart(page, lines):
    story = " ".join(STORY[3:-4].split())
    want = [line for x in lines for line in ([story] * x if isinstance(x, int) else [x])]
    assert html_text.main_text(f"<html><body><nav><a href=1>Home</a></nav>{page}<footer>Foot</footer></body></html>").split("\n") == want


def test_choice_on_small_trees_by_its_definition():
    """Pages without article and main: what stays beside the path from the heart, by recursion over nested lists."""
    r = random.Random(11)
    texts = ["", "Some words", "A sentence ends here.", "word " * 40, "More words follow, and they end. " * 4, "© Firm"]

    def tree(depth):
        name = r.choice(["div", "p", "section", "h1", "h3", "a", "blockquote", "ul"]) if depth else "div"
        leaf = name in ("p", "h1", "h3", "a") or depth == 3
        return [name, r.choice(texts), [] if leaf else [tree(depth + 1) for _ in range(r.randint(0, 3))]]

    def html(node):
        return f"<{node[0]}>{node[1]}{''.join(map(html, node[2]))}</{node[0]}>"

    def size(text):
        return len("".join(text.split()))

    def flat(node, linked=False):
        """(tag, text, linked) of a node and all below it."""
        linked = linked or node[0] == "a"
        return [(node[0], node[1], linked)] + [x for c in node[2] for x in flat(c, linked)]

    for _ in range(300):
        body = ["body", "", [tree(0) for _ in range(3)]]
        root = ["html", "", [body]]
        page = html_text.Page(f"<body>{''.join(map(html, body[2]))}</body>")
        nodes, above = [], {}

        def number(node, parent):
            above[len(nodes)] = parent
            nodes.append(node)
            own = len(nodes) - 1
            for c in node[2]:
                number(c, own)

        number(root, -1)
        assert page.tags == [x[0] for x in nodes]
        density, sums = page.densities()
        heart = max(range(len(nodes)), key=lambda i: (sums[i], -i))
        path = [heart]
        while above[path[-1]] >= 0:
            path.append(above[path[-1]])
        want = {i for i in range(len(nodes)) if heart in _line(above, i)}
        if heart > 0:
            least = min(density[i] for i in path[: path.index(1) + 1])
            for child in path[: path.index(1)]:
                parent = above[child]
                for i in (i for i in above if above[i] == parent and i != child):
                    all_of = flat(nodes[i])
                    plain, linked = (sum(size(t) for _, t, l in all_of if l is x) for x in (False, True))
                    rights = any("©" in t for _, t, l in all_of if not l)
                    sentence = any("." in t for _, t, l in all_of if not l)
                    title = nodes[i][0] in ("h1", "h3") or i < child and any(x[0] == "h1" for x in all_of)
                    near = parent == above[heart] and parent != 1 and nodes[i][0] in ("p", "h1", "h3", "blockquote", "ul", "a")
                    if plain and linked <= plain and not (rights and plain < 200) and (density[i] >= least or sentence or title or near):
                        want |= {j for j in above if i in _line(above, j)}
                if size(nodes[parent][1]) and (parent != 1 or "." in nodes[parent][1]):
                    want.add(parent)
        assert [i in want for i in range(len(nodes))] == page.content()


def _line(above, i):
    line = {i}
    while above[i] >= 0:
        i = above[i]
        line.add(i)
    return line
