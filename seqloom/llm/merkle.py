"""A Merkle manifest of a table: every row a leaf, every group a tree, all groups one root.

A leaf is the SHA-256 of the row's columns, each as its length in bytes, a colon and its value, or a dash for null; texts are hashed
in the scan and never move. Inside a group, leaves ascend by identifier; while more than one node remains, runs of 16 become the
hash of their hexadecimal digests. The groups' roots, in the order of their names, are treated alike.

Ranks come from histograms of identifier digits and not from a global sort: the first histogram counts the rows of each prefix in each
group, a prefix with too many rows is counted again by longer prefixes, and running sums down this trie shift the places inside the
prefixes. The digits go on through the leaf and a row number, so one identifier in very many rows is told apart too. A rank's
digits to the base of 16 are the address of a leaf in its tree: subtrees of 4096 leaves share all but three digits, meet in one task
and are reduced there; what remains is reduced by one digit after another, the longest addresses first. Rows of a subtree then meet the path
above it, which gives proofs and folded roots without any row seeing more than its own subtree.

Defined results: null identifiers come first in their group, as equal identifiers do in the order of their leaves (equal rows in no
order; they differ in their proofs only); a null group is a group, before all others, and differs from the empty one; a group of one row has its leaf as
root, a table of one group the group's root; an empty table gives an empty result; identifiers are integers; columns that are not
``columns`` are ignored, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import ascii_lower, column, persisted

BITS, BLOCK_LEVELS, BUCKET, DIGITS, BROADCAST_ROWS = 4, 3, 4096, 3, 50_000
FANOUT = 1 << BITS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(part, values)), 256)


def hashed(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels_of(n: int) -> int:
    """How often n nodes are reduced until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def radix_ranks(rows: DataFrame, group: list[str], key: Column, first: int, longest: int, most: int = BUCKET) -> DataFrame:
    """``rows`` plus ``rank``, the 0-based place by ``key`` (hexadecimal digits) in the group, and ``total``, the group's rows.

    Prefixes of ``first`` digits are counted, those of more than ``most`` rows again with ``DIGITS`` more digits, and so on up to ``longest``.
    """
    prefix = lambda size: F.substring(key, 1, size)
    size, level, tables, own = min(first, longest), 0, [], rows.withColumn("_at", prefix(min(first, longest)))
    counts = persisted(own.groupBy(*group, F.col("_at").alias("_prefix")).agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(*group, "_parent").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    shifted = counts.withColumn("_parent", F.lit("")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    shifted = shifted.withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
    while True:
        heavy = shifted.where(F.col("_n") > most) if size < longest else shifted.where("false")
        number = heavy.count()
        tables.append(shifted.where(F.col("_n") <= most) if size < longest else shifted)
        if not number:
            break
        longer, level = min(size + DIGITS, longest), level + 1
        marks = heavy.select(*group, F.col("_prefix").alias("_at"), F.lit(True).alias("_heavy"))
        own = own.join(F.broadcast(marks) if number <= BROADCAST_ROWS else marks, [*group, "_at"], "left")
        own = own.withColumn("_at", F.when(F.col("_heavy"), prefix(longer)).otherwise(F.col("_at"))).withColumn("_level", F.when(F.col("_heavy"), level).otherwise(F.col("_level") if level > 1 else F.lit(0))).drop("_heavy")
        finer = persisted(own.where(F.col("_level") == level).groupBy(*group, F.col("_at").alias("_prefix")).agg(F.count(F.lit(1)).alias("_n")))
        above = heavy.select(*group, F.col("_prefix").alias("_parent"), F.col("_shift").alias("_above"), "_total")
        finer = finer.withColumn("_parent", F.substring("_prefix", 1, size)).withColumn("_inside", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        shifted = finer.join(above, [*group, "_parent"]).select(*group, "_prefix", "_n", "_parent", (F.col("_above") + F.col("_inside")).alias("_shift"), "_total")
        size = longer
    shifts = tables[0].select(*group, F.col("_prefix").alias("_at"), "_shift", "_total")
    for table in tables[1:]:
        shifts = shifts.unionByName(table.select(*group, F.col("_prefix").alias("_at"), "_shift", "_total"))
    places = own.withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_at").orderBy(key)))
    return places.join(shifts, [*group, "_at"]).select(*rows.columns, (F.col("_shift") + F.col("_place") - 1).cast("long").alias("rank"), F.col("_total").cast("long").alias("total"))


def climbed(nodes: DataFrame, by: list[str], levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """The last node (by, node) of each tree of (by, at, n, node), ``at`` below ``n``, and the runs (by, at, kids) of each level."""
    runs = []
    for _ in range(levels):
        kids = F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"])  # at most 16
        run = nodes.where("n > 1").groupBy(*by, F.shiftright("at", BITS).alias("_up")).agg(kids.alias("kids"), F.first("n").alias("n"))
        run = persisted(run.select(*by, F.col("_up").alias("at"), "kids", F.ceil(F.col("n") / FANOUT).cast("long").alias("n")))
        runs.append(run)
        nodes = nodes.where("n = 1").unionByName(run.select(*by, "at", "n", F.sha2(F.array_join("kids", ""), 256).alias("node")))
    return nodes.select(*by, "node"), runs


def with_path(rows: DataFrame, by: list[str], at: str, runs: list[DataFrame], name: str) -> DataFrame:
    """``rows`` plus their siblings on the way up, an array of (before, after), each digests in a row."""
    steps = []
    for level, run in enumerate(runs):
        kids, place = f"_kids{level}", F.shiftright(at, BITS * level).bitwiseAND(FANOUT - 1).cast("int")
        rows = rows.withColumn("_up", F.shiftright(at, BITS * (level + 1))).join(run.select(*by, F.col("at").alias("_up"), F.col("kids").alias(kids)), [*by, "_up"], "left")
        halves = F.struct(F.array_join(F.slice(kids, F.lit(1), place), "").alias("before"), F.array_join(F.slice(kids, place + 2, F.lit(FANOUT)), "").alias("after"))
        steps.append(F.when(F.col(kids).isNotNull(), halves))
    path = F.array_compact(F.array(*steps)) if steps else F.array().cast("array<struct<before:string,after:string>>")
    return rows.withColumn(name, path).drop("_up", *(f"_kids{i}" for i in range(len(runs))))


def local_levels(leaves: list[str], levels: int) -> list[list[str]]:
    """Nodes of a subtree, level by level; one more list than levels."""
    made = [leaves]
    for _ in range(levels):
        made.append([hashed(made[-1][i : i + FANOUT]) for i in range(0, len(made[-1]), FANOUT)])
    return made


def _block_nodes(inside: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        total = rows.column("total")[0].as_py()
        node = local_levels([x.hex() for x in rows.column("leaf").to_pylist()], min(levels_of(total), inside))[-1][0]
        first = rows.slice(0, 1)
        return pa.table({"group": first.column("group"), "at": first.column("block"), "n": pa.array([-(-total // FANOUT**inside)], pa.int64()), "node": [node]})

    return run


def folded(node: str, steps: Iterator[tuple[str, str]] | list[tuple[str, str]]) -> str:
    for before, after in steps:
        node = hashed([before, node, after])
    return node


def _proofs(root: str, inside: int):
    def run(rows: pa.Table, paths: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        subroot = paths.column("subroot")[0].as_py()
        above = [(x["before"], x["after"]) for x in paths.column("path")[0].as_py()]
        tail, known = "".join(b + a for b, a in above), {}
        leaves = [x.hex() for x in rows.column("leaf").to_pylist()]
        levels = local_levels(leaves, min(levels_of(rows.column("total")[0].as_py()), inside))
        proofs, folds = [], []
        for i, (leaf, changed) in enumerate(zip(leaves, rows.column("changed").to_pylist(), strict=True)):
            steps = []
            for nodes in levels[:-1]:
                start = i - i % FANOUT
                steps.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + FANOUT])))
                i //= FANOUT
            proofs.append(hashed([b + a for b, a in steps] + [tail]))
            top = folded(leaf if changed is None else changed.hex(), steps)
            if top not in known:
                known[top] = folded(top, above)
            folds.append(known[top])
        n = rows.num_rows
        return pa.table({
            "key": rows.column("key"), "group": rows.column("group"), "rank": rows.column("rank"), "leaf": leaves, "subroot": [subroot] * n, "root": [root] * n,
            "proof_sha256": proofs, "folded_root": folds, "verified": pa.array([f == root for f in folds], pa.bool_()),
        })

    return run


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, tampered: Column | None = None, changes: dict[str, Column] | None = None, bucket: int = BUCKET, inside: int = BLOCK_LEVELS) -> DataFrame:
    """One row for each of ``docs``: ``key``, ``leaf``, ``leaf_rank``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``bucket`` is the most rows of a prefix that is not counted by longer ones, 16^``inside`` the leaves of a subtree.
    Where ``tampered`` holds, the folded root starts from the leaf over the values that ``changes`` puts in the place of columns.
    """
    kind = docs.schema[key].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{key} is no integer")
    named = F.coalesce(F.concat(F.lit("="), column(group).cast("string")), F.lit(""))  # null before all others
    changed = leaf_of([(changes or {}).get(c, column(c)) for c in columns])
    leaves = persisted(docs.select(
        column(key).alias("key"), named.alias("group"), F.unhex(leaf_of([column(c) for c in columns])).alias("leaf"),
        F.unhex(F.when(F.lit(False) if tampered is None else tampered, changed)).alias("changed"), F.monotonically_increasing_id().alias("turn"),
    ))
    low, high, n = leaves.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    digits = lambda x, size=16: F.lpad(F.hex(x), size, "0")
    # the difference as an unsigned number of 64 bits; a null identifier is below all
    number = F.coalesce(F.concat(F.lit("1"), digits(F.col("key").cast("long") - F.lit(low or 0).cast("long"))), F.lit("0" * 17))
    used = -(-((high or 0) - (low or 0)).bit_length() // 4)
    first = 17 - used + min(DIGITS, max(1, levels_of(-(-n // 1024))), used)
    order = F.concat(number, F.hex("leaf"), digits(F.col("turn")))
    ranked = radix_ranks(leaves, ["group"], order, first, 97, bucket)
    block = F.shiftright("rank", BITS * inside)
    ranked = persisted(ranked.select("key", "group", "leaf", "changed", "rank", "total", block.alias("block")))

    blocks = persisted(ranked.select("group", "block", "rank", "total", "leaf").groupBy("group", "block").applyInArrow(_block_nodes(inside), "group string, at long, n long, node string"))
    facts = blocks.agg(F.max("n"), F.count_distinct("group")).first()
    tops, runs = climbed(blocks, ["group"], levels_of(facts[0] or 0))
    longest = 2 * (tops.agg(F.max(F.octet_length("group"))).first()[0] or 0)
    placed = radix_ranks(tops, [], F.hex(F.encode("group", "UTF-8")), 2 * DIGITS, longest, bucket) if longest else tops.select("*", F.lit(0).cast("long").alias("rank"), F.lit(1).cast("long").alias("total"))
    placed = persisted(placed.select("group", "node", F.col("rank").alias("at"), F.col("total").alias("n")))
    top, source_runs = climbed(placed.select("at", "n", "node"), [], levels_of(facts[1]))
    root = top.first()
    of_group = with_path(placed.select("group", F.col("node").alias("subroot"), "at"), [], "at", source_runs, "_rest").drop("at")
    paths = with_path(blocks.select("group", F.col("at").alias("block")), ["group"], "block", runs, "_path").join(of_group, "group")
    paths = paths.select("group", "block", "subroot", F.concat("_path", "_rest").alias("path"))

    made = ranked.groupBy("group", "block").cogroup(paths.groupBy("group", "block")).applyInArrow(
        _proofs(root["node"] if root else "", inside), f"key {kind.simpleString()}, group string, rank long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )
    return made.select(F.col("key").alias(key), F.col("rank").alias("leaf_rank"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_merkle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return manifest(docs, tampered=tampered, changes={"text": ascii_lower(F.col("text"))})


def _sql(levels: int = 8) -> str:
    """Trees of up to 16^levels leaves and groups."""

    def text(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"

    def tree(name: str, by: str) -> list[str]:
        """name0 has (by, i, n, node); name{k}r runs, name{k} nodes of level k."""
        on, out = by + ", " if by else "", []
        for k in range(levels):
            out.append(f"{name}{k}r AS (SELECT {on}i // 16 AS i, list(node ORDER BY i) AS kids, min(n) AS n FROM {name}{k} WHERE n > 1 GROUP BY {on}i // 16)")
            out.append(f"{name}{k + 1} AS (SELECT {on}i, n, node FROM {name}{k} WHERE n = 1 UNION ALL SELECT {on}i, (n + 15) // 16, sha256(array_to_string(kids, '')) FROM {name}{k}r)")
        return out

    def climb(start: str, name: str, by: str, at: str, last: str) -> list[str]:
        """Rows of ``start`` with before and after of each level, folded and proof."""
        out, now = [], start
        for k in range(levels):
            step = f"{last}{k}"
            place = f"(x.{at} // {16**k}) % 16"
            join = f"ON r.i = x.{at} // {16 ** (k + 1)}" + (f" AND r.{by} = x.{by}" if by else "")
            out.append(
                f"{step}b AS (SELECT x.*, coalesce(array_to_string(r.kids[1:({place})], ''), '') AS l, coalesce(array_to_string(r.kids[({place}) + 2:], ''), '') AS t, r.i IS NOT NULL AS more FROM {now} x LEFT JOIN {name}{k}r r {join})"
            )
            out.append(f"{step} AS (SELECT * EXCLUDE (l, t, more) REPLACE (proof || l || t AS proof, CASE WHEN more THEN sha256(l || fold || t) ELSE fold END AS fold) FROM {step}b)")
            now = step
        return out

    plain = " || ".join(text(c) for c in COLUMNS)
    lower = " || ".join(text(c) if c != "text" else text("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") for c in COLUMNS)
    # unsigned crc32 of the decimal digits, bit by bit
    crc = [
        "table_of AS (SELECT v, list_reduce([v::BIGINT] || list_transform(range(8), lambda x: 0::BIGINT), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS r FROM range(256) t(v))",
        "entries AS (SELECT list(r ORDER BY v) AS rs FROM table_of)",
        "sums AS (SELECT key, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(key) + 1), lambda p: ord(key[p])::BIGINT), lambda a, b: xor(a >> 8, rs[1 + xor(a & 255, b)])), 4294967295) AS crc FROM (SELECT DISTINCT doc_id::VARCHAR AS key FROM documents WHERE doc_id IS NOT NULL), entries)",
    ]
    parts = [
        *crc,
        f"leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256({plain}) AS leaf, sha256(CASE WHEN crc % 5 = 0 THEN {lower} ELSE {plain} END) AS changed FROM documents LEFT JOIN sums ON key = doc_id::VARCHAR)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
        "a0 AS (SELECT g, i, n, leaf AS node FROM ranked)",
        *tree("a", "g"),
        f"b0 AS (SELECT row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n, node, g FROM a{levels})",
        *tree("b", ""),
        "s0 AS (SELECT ranked.doc_id, ranked.g, ranked.i, b0.i AS gi, b0.node AS subroot, leaf, changed AS fold, '' AS proof FROM ranked JOIN b0 USING (g))",
        *climb("s0", "a", "g", "i", "u"),
        *climb(f"u{levels - 1}", "b", "", "gi", "w"),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, i::BIGINT AS leaf_rank, leaf, subroot, (SELECT node FROM b{levels}) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT node FROM b{levels}) AS verified FROM w{levels - 1}"


SQL = _sql()
