"""The noisy channel of disguised spellings.

A character trigram model says how likely a reading is; a lattice says what each written character may stand for:
digits and signs for letters, letters of other alphabets and accented ones for those they look like, signs and spaces for
nothing, a mask between letters for any letter, repetitions for one letter. Viterbi decoding finds the likeliest reading, of any length.

Skeletons are a coarse, vectorised filter before decoding: characters folded to classes, runs collapsed. Their hashes can
be joined, so that words written in several parts are found without decoding every pair of words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np

#: The letters of the character model, what a sign may stand for, and letters of other alphabets with the ones they look like.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou", "%": "aeiou", "?": "aeiou",
}
LOOK_ALIKES = dict(
    zip(
        "абвгдезикмнопрстухьіѕјԁӏԛԝ" + "αβγεηικνορστυχω" + "ıɡɩɪʟɴʀɑɔłđħ",
        "a6brde3ukmhonpctyxbisjdlqw" + "abyenikvopotuxw" + "igiilnraoldh",
        strict=True,
    )
)
EDGE, OTHER, SIZE = 0, 1, 64
CODE = {c: i + 2 for i, c in enumerate(LETTERS)}
MASKS = "*#%?"
MASKED = "abcdefghijklmnopqrstuvwxyz"
COST_HIDDEN, COST_VANISHED = 3.2, 6.0  #: one of 26 letters behind a mask, which hardly ever stands for nothing between letters
COST_READING, COST_GUESS, COST_SKIP, COST_SHRINK, COST_ACCENT, COST_JOIN = 0.7, 2.5, 0.7, 0.7, 1.0, 1.5
TRAILING = ".,;:!?\"'()[]{}|#*$%&<>~`^_-/\\"
LEADING = ".,;:?\"'()[]{}&<>~`^_-/\\"
PLAIN = re.compile(r"[^\W\d_]+\Z")
DOUBLE = re.compile(r"([^\W\d_])\1")
WINDOW = 64


def stripped(word: str) -> str:
    return word.rstrip(TRAILING).lstrip(LEADING)


def normal(word: str) -> str:
    """Wide, mathematical and other styled letters as plain ones."""
    return word if word.isascii() else unicodedata.normalize("NFKC", word).lower()


def likeness(c: str) -> str:
    """The plain letter or sign that a character outside ASCII looks like, or nothing."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    base = unicodedata.normalize("NFKD", c)[:1].lower()
    return LOOK_ALIKES.get(base, base) if base.isascii() else LOOK_ALIKES.get(base, "")


# --- character model ---------------------------------------------------------------------------


_TABLE = np.full(0x180, OTHER, np.int64)
for _letter, _code in CODE.items():
    _TABLE[ord(_letter)] = _code
_TABLE[ord(" ")] = EDGE


def trigram_counts(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Weighted counts of letter trigrams, two edges before and one behind each word; other signs count as OTHER."""
    if not words:
        return np.zeros(SIZE**3)
    points = np.frombuffer(("  " + "   ".join(words) + " ").encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], OTHER)
    lengths = np.array([len(w) for w in words]) + 3
    lengths[-1] = len(codes) - lengths[:-1].sum()
    weight = np.repeat(weights, lengths)[2:]
    return np.bincount((codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:], weights=weight, minlength=SIZE**3)


class CharacterModel:
    """Interpolated trigram costs (negative logarithms)."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        share = lambda x: (x + 0.1) / (x + 0.1).sum(axis=-1, keepdims=True)
        seen = three.sum(axis=2, keepdims=True)
        trust = seen / (seen + 20)
        self.cost = -np.log(trust * share(three) + (1 - trust) * (0.9 * share(two)[None] + 0.1 * share(one)[None, None]))


# --- decoding ----------------------------------------------------------------------------------


def lattice(word: str) -> Iterator[list[tuple[str, float]]]:
    """For each place the readings ("" for none) with their channel costs; what can only vanish has no place."""
    i = 0
    while i < len(word):
        c, run = word[i], 1
        while i + run < len(word) and word[i + run] == c:
            run += 1
        i += run
        extra, before, after = 0.0, word[i - run - 1 : i - run], word[i : i + 1]
        if c in MASKS and run <= 3 and before and after and before in CODE and after in CODE:
            for _ in range(run):
                yield [*((x, COST_GUESS if x in READINGS[c] else COST_HIDDEN) for x in MASKED), ("", COST_VANISHED)]
            continue
        if c not in CODE and c not in READINGS and not c.isascii():
            c, extra = likeness(c), COST_READING
        if c == " ":
            yield [(" ", 0.0), ("", COST_JOIN)]
        elif c in CODE:
            options = [(c, extra)]
            if not c.isascii() and (plain := likeness(c)) in CODE:
                options.append((plain, COST_ACCENT))
            yield options
            if run == 2:
                yield [*options, ("", COST_SHRINK * 2)]
            elif run > 2:
                yield [("", COST_SHRINK), *((x, cost + COST_SHRINK * 1.5) for x, cost in options)]
        elif c in READINGS:
            options = [(x, extra + (COST_GUESS if len(READINGS[c]) > 2 else COST_READING)) for x in READINGS[c]]
            yield options if c.isdigit() else [*options, ("", COST_SKIP * 2)]
            if run > 1:
                yield [*options, ("", COST_SKIP * 2 if not c.isdigit() else COST_SHRINK * 2 if run == 2 else COST_SHRINK)]


def decode(word: str, model: CharacterModel) -> str:
    """The likeliest reading of a disguised word, or of several words that may be one.

    Long readings are settled window by window: once the best one has two windows, its first is final, and the
    readings that differ there end. So beyond 128 letters this is an approximation, though a letter hardly ever depends on one so far behind it.
    """
    settled: list[str] = []
    states = {(EDGE, EDGE): (0.0, "")}
    for options in lattice(normal(word)):
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in states.items():
            for letter, price in options:
                if letter == " ":
                    key, value = (EDGE, EDGE), (cost + price + (model.cost[a, b, EDGE] if b != EDGE else 0.0), text + letter)
                elif letter:
                    c = CODE[letter]
                    key, value = (b, c), (cost + price + model.cost[a, b, c], text + letter)
                else:
                    key, value = (a, b), (cost + price, text)
                if key not in new or value < new[key]:
                    new[key] = value
        states = new
        if min(len(text) for _, text in states.values()) >= 2 * WINDOW:
            first = min(states.values())[1][:WINDOW]
            settled.append(first)
            states = {key: (cost, text[WINDOW:]) for key, (cost, text) in states.items() if text.startswith(first)}
    return "".join(settled) + min((cost + model.cost[a, b, EDGE], text) for (a, b), (cost, text) in states.items())[1]


def disguised(word: str) -> bool:
    """Digits or signs among letters or instead of them, or a letter repeated."""
    return len(word) > 2 and any(c in CODE or c in READINGS for c in word) and (not PLAIN.match(word) or DOUBLE.search(word) is not None)


# --- skeletons ---------------------------------------------------------------------------------

STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))  #: the inverse of STEP
WILD, LAST = 26, 255  #: stands for several letters; ends a word
#: Signs that need not stand for the letter of their class: they may vanish, or have several readings in different classes.
UNSURE = "".join(c for c, options in READINGS.items() if not c.isdigit() or options == "gb")


def _folds() -> np.ndarray:
    classes = {c: i + 1 for i, c in enumerate("abcdefghijkmnopqrstuvwxyz")}
    classes["l"] = classes["i"]
    table = np.zeros(0x20000, np.uint8)
    for point in range(33, len(table)):
        if point < 0x600 or 0x1E00 <= point < 0x2200 or 0x2460 <= point < 0x2500 or 0xFF00 <= point < 0xFFF0 or 0x1D400 <= point < 0x1D800:
            c = chr(point)
            c = likeness(c) if point > 127 and c not in READINGS else c.lower()
            c = READINGS.get(c, c)
            table[point] = classes.get(c[:1], 0) if len(c) <= 2 else WILD
    table[10] = LAST
    return table


FOLDS = _folds()
_UNSURE = np.zeros(len(FOLDS), bool)
_UNSURE[[ord(c) for c in UNSURE]] = True


class Skeletons:
    """Of a list of words: hash, length, first and last class of what is left when characters fold and repetitions collapse, and how
    many classes come before the first unsure sign."""

    def __init__(self, words: list[str]):
        points = np.frombuffer(("\n".join(words) + "\n" if words else "").encode("utf-32-le", "replace"), np.uint32)
        points = np.where(points < len(FOLDS), points, 0)
        classes = FOLDS[points]
        held = classes > 0
        classes, unsure = classes[held], _UNSURE[points[held]]
        again = np.zeros(len(classes), bool)
        again[1:] = (classes[1:] == classes[:-1]) & (classes[1:] != LAST) & (unsure[1:] == unsure[:-1])
        classes, unsure = classes[~again], unsure[~again]
        ends = np.flatnonzero(classes == LAST)
        self.starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        self.lengths = ends - self.starts
        words_of = np.repeat(np.arange(len(ends)), self.lengths + 1)
        places = np.arange(len(classes)) - self.starts[words_of]
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(classes.astype(np.uint64) * powers(int(self.lengths.max(initial=0)) + 2)[places], dtype=np.uint64)))
        self.hashes = self.total[ends] - self.total[self.starts]
        self.first, self.last = classes[self.starts], classes[np.maximum(ends - 1, 0)]
        self.sure = self.lengths.copy()
        at = np.flatnonzero(unsure)[::-1]
        self.sure[words_of[at]] = places[at]

    def prefixes(self, length: int | np.ndarray) -> np.ndarray:
        """Hashes of the first classes of each word, at most ``length``."""
        return self.total[self.starts + np.minimum(length, self.lengths)] - self.total[self.starts]


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among the ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Filter:
    """What may be read as one of some words, or as a word with one of some beginnings, by skeletons alone.

    It loses nothing: a sure spelling's skeleton is its reading's; before the first unsure sign a spelling goes like some prefix.
    """

    def __init__(self, words: list[str], beginnings: list[str]):
        exact, heads = Skeletons(words), Skeletons(beginnings)
        self.exact, self.reach = np.unique(exact.hashes), int(exact.lengths.max(initial=0))
        self.heads = {int(n): np.unique(heads.hashes[heads.lengths == n]) for n in np.unique(heads.lengths)}
        every = [x.prefixes(n)[x.lengths >= n] for x in (exact, heads) for n in range(1, int(x.lengths.max(initial=0)) + 1)]
        self.prefixes = np.unique(np.concatenate([np.zeros(1, np.uint64), *every]))

    def __call__(self, forms: Skeletons) -> np.ndarray:
        sure = forms.sure == forms.lengths
        out = sure & within(forms.hashes, self.exact)
        for n, heads in self.heads.items():
            out |= (forms.sure >= n) & within(forms.prefixes(n), heads)
        return out | ~sure & within(forms.prefixes(forms.sure), self.prefixes)


def powers(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, STEP))))


def spans(codes: np.ndarray, offsets: np.ndarray, skeletons: Skeletons, wanted: np.ndarray, reach: int) -> Iterator[tuple[int, int, int]]:
    """(text, first word, word behind the last) of neighbouring words whose joined skeleton is wanted (sorted hashes), at most ``reach`` long."""
    if not len(wanted) or not len(codes):
        return
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.flatnonzero(skeletons.lengths[codes] > 0)
    word, text = codes[place], text[place]
    single, first = skeletons.lengths[word] == 1, skeletons.first[word]
    again = np.zeros(len(word), bool)
    again[1:] = single[1:] & single[:-1] & (first[1:] == first[:-1]) & (text[1:] == text[:-1])
    place, word, text = place[~again], word[~again], text[~again]
    power = powers(reach + 1)
    at = np.flatnonzero(skeletons.lengths[word] <= reach)
    hashes, lengths, last = skeletons.hashes[word[at]], skeletons.lengths[word[at]], skeletons.last[word[at]]
    for n in range(1, 2 * reach + 2):
        for i in at[within(hashes, wanted)].tolist():
            yield int(text[i]), int(place[i]), int(place[i + n - 1]) + 1
        keep = at + n < len(word)
        keep[keep] = text[at[keep] + n] == text[at[keep]]
        at, hashes, lengths, last = at[keep], hashes[keep], lengths[keep], last[keep]
        more = word[at + n]
        same = skeletons.first[more] == last
        tail = np.where(same, (skeletons.hashes[more] - skeletons.first[more].astype(np.uint64)) * BACK, skeletons.hashes[more])
        hashes = hashes + power[lengths] * tail
        lengths, last = lengths + skeletons.lengths[more] - same, skeletons.last[more]
        keep = lengths <= reach
        at, hashes, lengths, last = at[keep], hashes[keep], lengths[keep], last[keep]
        if not len(at):
            return
