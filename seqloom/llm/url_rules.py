"""URL filters by a bit-parallel wildcard automaton.

A URL's canonical form is a dot, its host in lower case, and its path. Rules of a host and a path, and globs, become patterns
over the bytes of that form; all patterns lie side by side as bits of a few 64-bit words. One step of the automaton shifts
every pattern by one byte at once: D = (D << 1) & B[byte] | D & S[byte], with carries from word to word. B holds the places where a byte
is accepted, S the places of wildcards that stay where they are: a star before the first slash stays within the host, one
behind it runs over everything. A batch of URLs takes the step together in numpy, longer ones go on when shorter ones have ended.
Pages are independent rows and only the URL goes to Python, so the plan is scan -> map with no shuffle; the masks are bounded (``MOST_STATES``).

Patterns are tried in the order of their rank: rules before globs, longer ones before shorter ones, of equally long ones block before allow.
Globs: ``*`` is any run, ``?`` one character; ``*.x`` at the beginning is host x and its subdomains.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule fits; what no pattern fits gets the default
verdict; URLs of any length are read whole; repeated rows are judged each; null keys stay null; an empty table gives an empty
result; columns other than the kept ones are ignored, and a kept one that bears a result's name is replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, column, others

MOST_STATES, STATE_BYTES, LONG_URL = 1 << 18, 8 << 20, 4096
RESULTS = ("host", "path", "rule", "pattern", "verdict")


@dataclass(frozen=True)
class Pattern:
    """``parts`` are bytes, or None for one character of any kind; ``stars`` holds the numbers of parts that a star precedes."""

    name: str
    verdict: str
    is_rule: bool
    parts: tuple[int | None, ...]
    stars: frozenset[int]

    @property
    def rank(self) -> tuple:
        size = len(self.name.encode()) if self.is_rule else len(self.parts)
        return (not self.is_rule, -size, self.verdict != "block", self.name)


def rule(verdict: str, host: str, path: str) -> Pattern:
    """A host with all its subdomains, and paths that begin with ``path``."""
    literal = ("." + host + path).encode()
    return Pattern(host + path, verdict, True, tuple(literal), frozenset((0, len(literal))))


def glob(verdict: str, text: str) -> Pattern:
    parts, stars = [], set()
    for byte in (text if text.startswith("*") else "." + text).encode():
        if byte == ord("*"):
            stars.add(len(parts))
        else:
            parts.append(None if byte == ord("?") else byte)
    return Pattern(text, verdict, False, tuple(parts), frozenset(stars))


class Automaton:
    """All patterns as masks. A pattern of m parts has m + 1 states: how many of its parts are matched."""

    def __init__(self, patterns: list[Pattern]):
        self.patterns = sorted(patterns, key=lambda p: p.rank)
        states = sum(len(p.parts) + 1 for p in patterns)
        if states > MOST_STATES:
            raise ValueError(f"the patterns have {states} places, more than {MOST_STATES}")
        self.words = max(-(-states // 64), 1)
        takes, stays = np.zeros((256, 64 * self.words), bool), np.zeros((256, 64 * self.words), bool)
        begin, ends, at = np.zeros(64 * self.words, bool), [], 0
        for p in self.patterns:
            begin[at] = True
            in_host = True
            for i, part in enumerate((*p.parts, -1)):
                if i in p.stars:
                    stays[:, at + i] = True
                    stays[ord("/"), at + i] = not in_host
                if part is None:
                    takes[:0x80, at + i + 1] = takes[0xC0:, at + i + 1] = True
                    stays[0x80:0xC0, at + i + 1] = True  # the rest of the character
                elif part >= 0:
                    takes[part, at + i + 1] = True
                    in_host &= part != ord("/")
            at += len(p.parts) + 1
            ends.append(at - 1)
        self.takes, self.stays, self.begin = (np.packbits(x, axis=-1, bitorder="little").view("<u8") for x in (takes, stays, begin))
        self.ends = np.array(ends, np.int64)

    def first_matches(self, urls: pa.Array) -> np.ndarray:
        """The rank of the first pattern that matches each canonical URL whole, or -1."""
        data = pc.fill_null(urls, "").cast(pa.large_binary())
        _, offsets, flat = data.buffers()
        offsets = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
        flat, out = np.frombuffer(flat or b"", np.uint8), np.full(len(data), -1, np.int64)
        order = np.argsort(-np.diff(offsets), kind="stable")
        rows = max(STATE_BYTES // (8 * self.words + len(self.ends)), 1)
        sizes = np.diff(offsets)
        longs = int((sizes > LONG_URL).sum())
        for i in order[:longs].tolist():
            out[i] = self.first_of(flat[offsets[i] : offsets[i + 1]].tobytes())
        for at in range(longs, len(order), rows):
            some = order[at : at + rows]
            out[some] = self.decided(self.walked(flat, offsets[some], sizes[some]))
        return out

    def walked(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """States after the last byte, for URLs in falling order of their sizes."""
        state = np.repeat(self.begin[None, :], len(sizes), axis=0)
        for j in range(int(sizes[0]) if len(sizes) else 0):
            going = int(np.searchsorted(-sizes, -j, side="left"))  # those longer than j
            byte, now = flat[starts[:going] + j], state[:going]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:going] = moved & self.takes[byte] | now & self.stays[byte]
        return state

    def decided(self, state: np.ndarray) -> np.ndarray:
        if not len(self.ends):
            return np.full(len(state), -1)
        hits = (state[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64)) & np.uint64(1) == 1
        return np.where(hits.any(axis=1), hits.argmax(axis=1), -1)

    def first_of(self, url: bytes) -> int:
        """The same steps for one URL, its states in one large integer."""
        takes, stays = ([int.from_bytes(row.tobytes(), "little") for row in masks] for masks in (self.takes, self.stays))
        state = int.from_bytes(self.begin.tobytes(), "little")
        for byte in url:
            state = state << 1 & takes[byte] | state & stays[byte]
        return next((i for i, end in enumerate(self.ends.tolist()) if state >> end & 1), -1)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, patterns: list[Pattern], default: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The ``keep`` columns plus ``host``, ``path``, ``rule`` or ``pattern`` (what decided, else null) and ``verdict``."""
    automaton = Automaton(patterns)
    known = automaton.patterns
    rules = pa.array([p.name if p.is_rule else None for p in known] + [None], pa.string())
    globs = pa.array([None if p.is_rule else p.name for p in known] + [None], pa.string())
    verdicts = pa.array([p.verdict for p in known] + [default], pa.string())

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for urls in arrays:
            found = automaton.first_matches(urls)
            at = pa.array(np.where(found < 0, len(known), found))
            yield pa.StructArray.from_arrays([rules.take(at), globs.take(at), verdicts.take(at)], names=["rule", "pattern", "verdict"])

    judge = F.arrow_udf(run, "rule string, pattern string, verdict string")
    kept = [column(c) for c in others(pages.select(*map(column, keep)), *RESULTS)]
    split = pages.select(*kept, host_of(column(url)).alias("host"), path_of(column(url)).alias("path"))
    names = [column(c) for c in others(split, *RESULTS)]
    found = split.select(*names, "host", "path", judge(F.concat(F.lit("."), "host", "path")).alias("verdict"))
    return found.select(*names, "host", "path", "verdict.rule", "verdict.pattern", "verdict.verdict")


#: Rules that the query is given, and globs for what they leave open.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
GLOBS = [("block", "*spam-*"), ("block", "*cheap-pills.*"), ("block", "*casino*"), ("block", "m.*/*"), ("allow", "m.*.net/*/?0*"), ("block", "*/*.html"), ("block", "blog.*/??/*9/"), ("allow", "*.example.net/en/*")]


def op11_url_rules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(pages, [*(rule(*r) for r in RULES), *(glob(*g) for g in GLOBS)])


def glob_regex(text: str) -> str:
    """A glob as a regular expression over canonical URLs, for SQL and tests."""
    out, in_host = "", True
    for c in text if text.startswith("*") else "." + text:
        in_host &= c != "/"
        out += ("[^/]*" if in_host else ".*") if c == "*" else "." if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c
    return out


def _sql() -> str:
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    globs = sorted(GLOBS, key=lambda g: glob(*g).rank)
    globbed = " ".join(f"WHEN regexp_full_match('.' || host || path, '{glob_regex(text)}', 's') THEN '{text}'" for _, text in globs)
    of_rule = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in RULES)
    of_glob = " ".join(f"WHEN pattern = '{text}' THEN '{v}'" for v, text in GLOBS)
    return f"""
    WITH s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
    f AS (SELECT *, CASE {fits} END AS rule FROM p),
    g AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {globbed} END END AS pattern FROM f)
    SELECT page_id, host, path, rule, pattern, CASE {of_rule} {of_glob} ELSE 'allow' END AS verdict FROM g"""


SQL = _sql()
