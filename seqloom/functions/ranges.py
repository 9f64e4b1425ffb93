"""Host-side helpers: ranges of counts, addresses and identifiers."""

from __future__ import annotations

import re

from .letters import MOST


def count_ranges(text: str) -> list[tuple[int, int]]:
    """``3``, ``2-5``, ``7-``, ``-9`` and ``-`` in a comma list, as sorted disjoint inclusive ranges.

    A missing lower end is 1 and a missing upper end is the largest count.
    """
    found = []
    for item in text.split(","):
        m = re.fullmatch(r"\s*(\d*)\s*(-?)\s*(\d*)\s*", item)
        if not m or not (m[1] or m[2]) or m[3] and not m[2]:
            raise ValueError(f"not a range of counts: {item!r}")
        low = int(m[1]) if m[1] else 1
        found.append((low, int(m[3]) if m[3] else MOST if m[2] else low))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def after_prefix(prefix: str) -> str | None:
    """The smallest letter string above every string with this prefix; None if there is none."""
    base = prefix.lower().rstrip("t")
    return base[:-1] + "acgt"["acgt".index(base[-1]) + 1] if base else None


def address(text: str) -> tuple[str, object, object]:
    """A table address: ("ordinal", first, last) for ``5`` or ``5-9``, ("prefix", from, below) for ``acg`` or ``ac-cg``."""
    if m := re.fullmatch(r"(\d+)(?:-(\d+))?", text):
        first, last = int(m[1]), int(m[2] or m[1])
        if first > last:
            raise ValueError(f"empty range: {text}")
        return "ordinal", first, last
    if m := re.fullmatch(r"([acgtACGT]+)(?:-([acgtACGT]+))?", text):
        return "prefix", m[1].lower(), after_prefix(m[2] or m[1])
    raise ValueError(f"neither an ordinal nor a prefix address: {text!r}")


def read_ranges(items: list[str], total: int) -> list[tuple[int, int]]:
    """1-based selections ``7``, ``3-5`` and ``3-#`` in the order given; no items select everything."""
    if not items:
        return [(1, total)]
    out = []
    for item in items:
        m = re.fullmatch(r"(\d+)(?:-(\d+|#))?", item)
        if not m:
            raise ValueError(f"not an integer range: {item!r}")
        first = int(m[1])
        last = total if m[2] == "#" else int(m[2] or m[1])
        if first > last or first < 1 or last > total:
            raise ValueError(f"{item} is not within 1-{total}")
        out.append((first, last))
    return out


def grouped_number(n: int) -> str:
    return f"{n:,}"
