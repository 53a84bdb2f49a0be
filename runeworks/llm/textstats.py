"""Problem 9: text quality statistics of documents, and prose told from lists, tables and junk."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeworks.llm.inspected import INSPECTED, PROSE
from runeworks.llm.languages import FUNCTION
from runeworks.session import settle, spread

KINDS = ("prose", "list", "table", "junk")

#: Statistics of a document, in order; the mixture is fitted on them. All are measured, none is a verdict.
STATISTICS = (
    "words", "lines", "mean_word_length", "longest_word", "symbol_share", "digit_share", "letter_share", "capital_share", "ideogram_share",
    "common_word_share", "common_word_line_share", "distinct_word_share", "distinct_characters", "repetition", "letter_pairs", "markup_share",
    "damaged_share", "escape_share", "vowel_word_share", "punctuated_line_share", "sentences_per_line", "words_per_line", "line_length",
    "line_length_spread", "itemised_line_share", "paired_line_share", "named_line_share", "short_line_share", "cells_per_line",
    "celled_line_share", "even_cells_share", "solid_line_share",
)

#: Rounds of expectation-maximization at most, and the gain in mean log likelihood that ends them.
ROUNDS, GAIN = 12, 1e-3

#: Share of all documents that the inspected examples of one component weigh, the variance they are
#: given around their mean, and the least variance of a standardized statistic.
ANCHOR, WIDTH, FLOOR = 0.005, 0.5, 0.1

#: Share of the inspected examples' variance that is added to that of the documents, so that a statistic
#: which hardly varies in the documents at hand is still standardized by a sensible unit.
UNIT = 0.1

#: Characters measured at once; a longer text is measured alone.
BLOCK = 1 << 16

#: Characters that show nothing.
BLANK = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0xAD, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))

_ROLE = re.compile(r"<\|[^|>\n]*\|>[ \t]*(?:(?:user|assistant|system|tool)\b)?", re.I)

# Words that, alone on a line, only name a speaker.
_SPEAKERS = "user assistant system human bot ai tool".split()
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|&(?:[a-z]+|#\d+);", re.S)
_CELL, _ROW_END = re.compile(r"<t[dh]\b[^<>]*>", re.I), re.compile(r"</tr\s*>|<tr\b[^<>]*>", re.I)
_ODD_ENDS = re.compile("\r\n|[\r\x85  ]")

# Bits of a character's class.
_LETTER, _DIGIT, _ALNUM, _BLANK, _IDEOGRAM, _CAPITAL, _VOWEL, _STOP = (1 << i for i in range(8))


def _class_table() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and lower case of each character of the basic plane."""
    kinds, lower = np.zeros(1 << 16, dtype=np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        kinds[code] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _ALNUM if c.isalnum() else _BLANK if c.isspace() or c in BLANK else 0
        if c.isupper():
            kinds[code] |= _CAPITAL
            lower[code] = ord(c.lower()[0])
        if unicodedata.normalize("NFKD", c.lower())[:1] in "aeiouyæœøаеёиоуыэюя":
            kinds[code] |= _VOWEL
    for low, high in ((0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)):
        kinds[low : high + 1] |= _IDEOGRAM
    kinds[[ord(c) for c in ".!?…:。！？：．"]] |= _STOP
    return kinds, lower


_CLASSES, _LOWER = _class_table()


def _marks_table(signs: str) -> np.ndarray:
    """Whether a character of the basic plane is one of ``signs``."""
    table = np.zeros(1 << 16, dtype=bool)
    table[[ord(c) for c in signs]] = True
    return table


_CLOSERS, _BULLETS = _marks_table("'\"”’»)]*_`」』）"), _marks_table("-*•·‣◦▪●○–—+»→✓✗")
_SHAFTS, _ARROWS, _NAMING = _marks_table("-="), _marks_table("→⇒↦"), _marks_table(":=：")
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))


def _bare_table() -> np.ndarray:
    table = np.zeros(1 << 16, dtype=np.int8)
    for code in range(0x250):
        base = unicodedata.normalize("NFKD", chr(code).lower())[:1]
        if "a" <= base <= "z":
            table[code] = ord(base) - 96
    return table


_BARE = _bare_table()


def _code_points(text: str) -> np.ndarray:
    """Characters of the basic plane; those of other planes stand as the replacement for a symbol."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(codes < 1 << 16, codes, 0x2603)


def _pair_table() -> np.ndarray:
    """Log probability of the second letter after the first, from sentences of four languages."""
    counts = np.full((27, 27), 0.3)
    codes = _BARE[_code_points(" ".join([*PROSE, " ".join(sorted(w for w in FUNCTION if len(w) > 2))]))]
    np.add.at(counts, (codes[:-1], codes[1:]), 1.0)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


_PAIR_LOGS = _pair_table()


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last places of the runs of true values."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _greatest(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The greatest of the values of each of ``n`` groups, which follow each other; 0 without any."""
    out = np.zeros(n)
    if len(group):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        out[group[first]] = np.maximum.reduceat(values, first)
    return out


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of characters; ``codes`` are zero outside the runs."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    # The place of a character in its run, from 64 on again from 0; before the first run and after each, anything will do.
    size = np.diff(np.append(starts, len(codes)))
    place = ((np.arange(starts[0], len(codes), dtype=np.int64) - np.repeat(starts, size)) & 63).astype(np.int8)
    mixed = codes[starts[0] :].astype(np.uint64)
    mixed = (mixed * np.uint64(0xD6E8FEB86659FD93)) ^ (mixed << np.uint64(17))
    mixed *= _POWERS[place]
    sums = np.add.reduceat(mixed, starts - starts[0]) + (ends - starts).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    return sums ^ (sums >> np.uint64(31))


def _word_hashes(words: Iterable[str]) -> np.ndarray:
    codes = _LOWER[_code_points(" " + " ".join(words) + " ")]
    starts, ends = _runs(codes != 32)
    return np.unique(_hashes(np.where(codes != 32, codes, 0), starts, ends))


_COMMON, _SPEAKER, _BECOMES = _word_hashes(FUNCTION), _word_hashes(_SPEAKERS), _word_hashes(["becomes"])


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, hashes)
    return known[np.minimum(at, len(known) - 1)] == hashes


def readable(text: str) -> tuple[str, int]:
    """The text as a reader sees it, and how many characters were mark-up.

    Chat role markers go. Where mark-up takes a quarter of the text or more, its tags go too,
    with cells of rendered tables set apart by tabs and their rows by line ends.
    """
    if "<|" in text:
        text = _ROLE.sub("", text)
    if not text.isascii() or "\r" in text:
        text = _ODD_ENDS.sub("\n", text)
    if not ("<" in text and ">" in text or "&" in text):
        return text, 0
    marked = sum(map(len, _TAG.findall(text)))
    if marked * 4 < len(text):
        return text, marked
    return _TAG.sub(" ", _CELL.sub("\t", _ROW_END.sub("\n", text))), marked


def periods(units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each stretch of ``units``, the share of them that stand again one period later.

    The period of a stretch is the distance that most often lies between a unit and the same
    unit before, the shortest of several such; it may have any length. A stretch that holds
    less than three periods has none, and neither has one of fewer than three units.
    """
    n = len(sizes)
    out = np.zeros(n)
    if not len(units):
        return out
    group = np.repeat(np.arange(n), sizes)
    begin = np.cumsum(sizes) - sizes
    order = np.lexsort((units, group))
    same = (group[order][1:] == group[order][:-1]) & (units[order][1:] == units[order][:-1])
    later, gap = order[1:][same], (order[1:] - order[:-1])[same]
    if not len(later):
        return out
    gap_order = np.lexsort((gap, group[later]))
    g, d = group[later][gap_order], gap[gap_order]
    first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
    counts = np.diff(np.append(first, len(g)))
    g, d = g[first], d[first]
    best = np.lexsort((d, -counts, g))
    lead = best[np.append(True, g[best][1:] != g[best][:-1])]
    period = np.zeros(n, dtype=np.int64)
    period[g[lead]] = d[lead]
    period[sizes < 3 * period] = 0
    back = np.arange(len(units)) - np.repeat(period, sizes)
    reach = (np.repeat(period, sizes) > 0) & (back >= np.repeat(begin, sizes))
    at = np.flatnonzero(reach)
    hits = at[units[at] == units[back[at]]]
    return np.bincount(group[hits], minlength=n) / np.maximum(np.where(period > 0, sizes - period, 1), 1)


def measure(texts: list[str]) -> np.ndarray:
    """The :data:`STATISTICS` of each text, a row for each; all texts are measured together, character by character."""
    n = len(texts)
    read = [readable(t) for t in texts]
    joined = "\n".join([p for p, _ in read])
    sizes = np.fromiter((len(p) + 1 for p, _ in read), dtype=np.int64, count=n)
    codes = _code_points(joined + "\n")
    kinds = _CLASSES[codes]
    end = len(codes)
    padded = np.concatenate((codes, np.full(8, 10, dtype=codes.dtype)))
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)

    begins = np.cumsum(sizes) - sizes

    def per_doc(flags: np.ndarray) -> np.ndarray:
        """True values in each text."""
        return np.add.reduceat(flags, begins, dtype=np.int64).astype(float)

    letter, digit, blank = (kinds & _LETTER) > 0, (kinds & _DIGIT) > 0, (kinds & _BLANK) > 0
    visible = np.flatnonzero(~blank)
    solid = np.maximum(per_doc(~blank), 1.0)
    letters, digits = per_doc(letter), per_doc(digit)
    others = per_doc((kinds & _ALNUM) > 0)
    ideograms = per_doc((kinds & _IDEOGRAM) > 0)
    # Signs of a text read in a wrong encoding: the replacement sign, control signs, and a lead byte before a following one.
    follow = np.append(((codes[1:] >= 0x80) & (codes[1:] < 0xC0)) | ((codes[1:] >= 0x2013) & (codes[1:] < 0x2123)) | ((codes[1:] >= 0x152) & (codes[1:] < 0x179)) | (codes[1:] == 0x2C6), False)
    damaged = per_doc((codes == 0xFFFD) | (codes < 9) | ((codes >= 0xC2) & (codes < 0xF5) & follow))
    escapes = per_doc((codes == 92) | (codes == 37))

    # Lines with something to see, but for those that only name a speaker.
    line_end = np.flatnonzero(codes == 10)
    line_start = np.append(0, line_end[:-1] + 1)
    lo, hi = np.searchsorted(visible, line_start), np.searchsorted(visible, line_end)
    seen = hi - lo
    word_start, word_end = _runs(letter)
    low = np.where(letter, _LOWER[codes], 0)
    words = _hashes(low, word_start, word_end)
    word_length = word_end - word_start
    common = _among(words, _COMMON)
    line_words_lo, line_words_hi = np.searchsorted(word_start, line_start), np.searchsorted(word_start, line_end)
    line_words = line_words_hi - line_words_lo
    if len(words):
        one = np.minimum(line_words_lo, len(words) - 1)
        speaker = (line_words == 1) & (seen <= word_length[one] + 2) & _among(words[one], _SPEAKER)
    else:
        speaker = np.zeros(len(line_start), dtype=bool)
    kept = np.flatnonzero((seen > 0) & ~speaker)
    of = doc[line_start[kept]]
    lines = np.bincount(of, minlength=n).astype(float)
    per_line = np.maximum(lines, 1.0)

    def sums(flags: np.ndarray) -> np.ndarray:
        """True values in each kept line."""
        return np.add.reduceat(flags, line_start, dtype=np.int64)[kept]

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=values.astype(float), minlength=n) / per_line

    def word_sums(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[line_words_hi] - total[line_words_lo])[kept]

    seen, line_words = seen[kept], line_words[kept]
    first, last = visible[lo[kept]], visible[hi[kept] - 1]
    from_, to = line_start[kept], line_end[kept]
    seen_ideograms = sums((kinds & _IDEOGRAM) > 0)
    commons = word_sums(common)
    # The last sign that closes nothing: a closing mark gives way to the sign before it, twice at most.
    tail = last.copy()
    for _ in range(2):
        tail = np.where(_CLOSERS[codes[tail]] & (tail > first), tail - 1, tail)
    punctuated = ((kinds[tail] & _STOP) > 0) & (codes[tail] != 0x3A)
    stops = ((kinds & _STOP) > 0) & (codes != 0x3A) & (blank[np.minimum(np.arange(end) + 1, end - 1)] | (codes >= 0x3000) | _CLOSERS[padded[1 : end + 1]])
    sentences = sums(stops)

    c = [padded[first + i] for i in range(6)]
    k = [_CLASSES[x] for x in c]
    is_blank, is_digit = [(x & _BLANK) > 0 for x in k], [(x & _DIGIT) > 0 for x in k]
    is_letter = [((x & _LETTER) > 0) & ((x & _IDEOGRAM) == 0) for x in k]
    mark = [np.isin(x, (41, 46, 58)) for x in c]  # ) . :
    shut = [np.isin(x, (41, 93)) for x in c]  # ) ]
    numbered = is_digit[0] & (mark[1] & is_blank[2] | is_digit[1] & (mark[2] & is_blank[3] | is_blank[2] & _BULLETS[c[3]] | is_digit[2] & mark[3] & is_blank[4]))
    lettered = is_letter[0] & (mark[1] & is_blank[2] & (c[1] != 58) | is_letter[1] & (shut[2] & is_blank[3] | is_letter[2] & shut[3] & is_blank[4]))
    opened = np.isin(c[0], (40, 91)) & (shut[2] & is_blank[3] | shut[3] & is_blank[4])
    itemised = (_BULLETS[c[0]] & is_blank[1]) | numbered | lettered | opened | (c[0] == 35) & is_digit[1]

    arrow = ((codes == 0x3E) & _SHAFTS[np.append(0, codes[:-1])]) | _ARROWS[codes]
    paired = (sums(arrow) > 0) | (word_sums(_among(words, _BECOMES)) > 0)
    names = np.flatnonzero(_NAMING[codes] & np.append(blank[1:], True) | (codes == 0x2026) | ((codes == 46) & (np.append(codes[1:], 0) == 46)))
    at = np.searchsorted(names, first)
    name = names[np.minimum(at, max(0, len(names) - 1))] if len(names) else np.zeros(len(first), dtype=np.int64)
    named = (name > first) & (name < last) & (name - first <= 40) if len(names) else np.zeros(len(first), dtype=bool)
    named &= (np.searchsorted(word_start, name) - np.searchsorted(word_start, from_) <= 4) & (seen <= 100)

    # Cells: gaps of the kind that a line has most of.
    near = np.append(blank[1:], True)
    wide_start, wide_end = _runs(blank & (codes != 10))
    inner = wide_end - wide_start >= 2
    wide = np.zeros(end, dtype=np.int8)
    wide[wide_end[inner] - 1] = 1
    edge = np.concatenate(([0], np.cumsum(wide)))
    gaps = edge[last] - edge[first] + (first - from_ >= 3) * (edge[last] - edge[first] > 0)
    bars = np.maximum(sums(codes == 0x7C) - (codes[first] == 0x7C) - (codes[last] == 0x7C), 0)
    cells = 1 + np.maximum.reduce([bars, sums(codes == 9), sums(codes == 0x3B), sums((codes == 0x2C) & ~near), gaps])
    cell = seen / cells
    celled = (cells >= 3) & (cell <= 25)
    # Share of lines with the number of cells that most lines of the text have, where that is three or more.
    many = np.flatnonzero(celled)
    keys, hits = np.unique(of[many].astype(np.int64) * (1 << 20) + np.minimum(cells[many], (1 << 20) - 1), return_counts=True)
    even = np.zeros(n)
    np.maximum.at(even, keys >> 20, hits)

    token_start, token_end = _runs(~blank)
    tokens = _hashes(np.where(blank, 0, codes), token_start, token_end)
    token_length = token_end - token_start
    token_of = doc[token_start]
    token_count = np.bincount(token_of, minlength=n)
    repetition = periods(tokens, token_count)
    # A text without words to repeat, such as a run of signs, repeats its characters.
    unbroken = np.flatnonzero((token_count < 8) & (solid >= 24))
    if len(unbroken):
        chosen = visible[np.isin(doc[visible], unbroken)]
        repetition[unbroken] = np.maximum(repetition[unbroken], periods(codes[chosen], np.bincount(doc[chosen], minlength=n)[unbroken]))
    longest = _greatest(token_of, np.where((kinds[token_start] & _IDEOGRAM) > 0, 10, token_length), n)
    line_of_token = np.searchsorted(from_, token_start, side="right") - 1
    inside = (line_of_token >= 0) & (token_start < to[np.maximum(line_of_token, 0)]) & ((kinds[token_start] & _IDEOGRAM) == 0) if len(kept) else np.zeros(len(token_start), dtype=bool)
    longest_in_line = _greatest(line_of_token[inside], token_length[inside], len(kept))

    word_of = doc[word_start]
    word_count = np.bincount(word_of, minlength=n).astype(float)
    all_words = np.maximum(word_count, 1.0)
    distinct = np.zeros(n)
    if len(words):
        order = np.lexsort((words, word_of))
        new = np.append(True, (words[order][1:] != words[order][:-1]) | (word_of[order][1:] != word_of[order][:-1]))
        distinct = np.bincount(word_of[order][new], minlength=n).astype(float)
    voiced = np.concatenate(([0], np.cumsum((kinds & _VOWEL) > 0)))
    vowels = (voiced[word_end] - voiced[word_start] > 0) | ((kinds[word_start] & _IDEOGRAM) > 0)
    signs = np.unique(doc[visible].astype(np.int64) * (1 << 16) + codes[visible]) >> 16

    bare = _BARE[codes]
    pair = np.flatnonzero((bare[:-1] > 0) & (bare[1:] > 0))
    pairs = np.bincount(doc[pair], minlength=n)
    logs = np.bincount(doc[pair], weights=_PAIR_LOGS[bare[pair], bare[pair + 1]], minlength=n)
    # Few pairs tell little: each text has a dozen middling ones besides its own.
    letter_pairs = (logs - 2.5 * 12) / (pairs + 12)

    weight = word_count + ideograms / 4
    length = np.log1p(seen)
    spread_ = np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0.0))
    marked = np.asarray([m for _, m in read], dtype=float) / np.maximum(np.fromiter(map(len, texts), dtype=float, count=n), 1.0)
    columns = {
        "words": np.log1p(word_count + ideograms / 2),
        "lines": np.log1p(lines),
        "mean_word_length": np.minimum(np.where(ideograms * 2 > letters, 5.0, np.bincount(word_of, weights=word_length, minlength=n) / all_words), 20.0),
        "longest_word": np.log1p(longest),
        "symbol_share": (solid - letters - digits - others) / solid,
        "digit_share": digits / solid,
        "letter_share": letters / solid,
        "capital_share": per_doc((kinds & _CAPITAL) > 0) / np.maximum(letters, 1.0),
        "ideogram_share": ideograms / solid,
        "common_word_share": np.minimum(1.0, (np.bincount(word_of, weights=common, minlength=n) + ideograms / 8) / np.maximum(weight, 1.0)),
        "common_word_line_share": mean((commons * 5 >= line_words) & (line_words >= 4) | (seen_ideograms * 2 > seen) & (seen > 8)),
        "distinct_word_share": distinct / all_words,
        "distinct_characters": np.log1p(np.bincount(signs, minlength=n)),
        "repetition": repetition,
        "letter_pairs": letter_pairs,
        "markup_share": marked,
        "damaged_share": np.minimum(damaged / solid, 0.3),
        "escape_share": np.minimum(escapes / solid, 0.2),
        "vowel_word_share": np.bincount(word_of, weights=vowels, minlength=n) / all_words,
        "punctuated_line_share": mean(punctuated),
        "sentences_per_line": np.log1p(mean(np.minimum(sentences, 50))),
        "words_per_line": mean(np.log1p(line_words + seen_ideograms / 2)),
        "line_length": mean(length),
        "line_length_spread": spread_,
        "itemised_line_share": mean(itemised),
        "paired_line_share": mean(paired),
        "named_line_share": mean(named),
        "short_line_share": mean((seen <= 30) & (line_words <= 4) & (seen_ideograms * 2 <= seen)),
        "cells_per_line": mean(np.log(np.minimum(cells, 20))),
        "celled_line_share": mean(celled),
        "even_cells_share": even / per_line,
        "solid_line_share": mean((longest_in_line > 40) | (sums(letter | digit) * 3 < seen) & (seen >= 6)),
    }
    return np.stack([columns[name] for name in STATISTICS], axis=1)


def measure_all(texts: list[str]) -> np.ndarray:
    """:func:`measure` in blocks of about :data:`BLOCK` characters, so that memory stays bounded."""
    parts, block, size = [np.zeros((0, len(STATISTICS)))], [], 0
    for text in texts:
        if block and size + len(text) > BLOCK:
            parts.append(measure(block))
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        parts.append(measure(block))
    return np.concatenate(parts)


@dataclass(frozen=True)
class Mixture:
    """Gaussian mixture with diagonal covariances over standardized statistics, and the kind of each component."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    kinds: tuple[str, ...] = ()

    def posterior(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responsibilities of the components, a row for each point, and log likelihoods of the points."""
        x, inverse = self.standard(points), 1.0 / self.variances
        far = (x**2) @ inverse.T - 2.0 * x @ (self.means * inverse).T + (self.means**2 * inverse).sum(axis=1)
        joint = np.log(self.weights) - 0.5 * (far + np.log(2 * np.pi * self.variances).sum(axis=1))
        top = joint.max(axis=1, keepdims=True)
        shares = np.exp(joint - top)
        total = shares.sum(axis=1, keepdims=True)
        return shares / total, (top + np.log(total))[:, 0]

    def standard(self, points: np.ndarray) -> np.ndarray:
        """``points`` standardized."""
        return (points - self.center) / self.scale

    def kind_shares(self, points: np.ndarray) -> np.ndarray:
        """Posterior of each of :data:`KINDS`, a row for each point: the sum over the components read as that kind."""
        shares, _ = self.posterior(points)
        return shares @ np.asarray([[kind == k for k in KINDS] for kind in self.kinds], dtype=float)


def inspected_points() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Statistics of the inspected examples, the group of each, and the kind of each group."""
    groups = np.repeat(np.arange(len(INSPECTED)), [len(texts) for _, texts in INSPECTED])
    return measure_all([t for _, texts in INSPECTED for t in texts]), groups, [kind for kind, _ in INSPECTED]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def fit_mixture(points: DataFrame, rounds: int = ROUNDS) -> Mixture:
    """Expectation-maximization over all rows of ``points`` (column ``x``), one component for each inspected group.

    A round is one pass: tasks send the sums of responsibilities, of weighted points and of
    weighted squares, which Spark adds up by slot, so the driver gets one row for each slot
    however many tasks there are. In every round the inspected examples of each component weigh
    :data:`ANCHOR` of all documents, which keeps components where their examples are, at any
    number of documents alike.
    """
    examples, groups, kinds = inspected_points()
    k, d = len(kinds), len(STATISTICS)
    moments = points.select(
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)], *[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(d)]
    ).first()
    center = np.asarray([moments[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.sqrt(np.asarray([moments[f"v{i}"] or 0.0 for i in range(d)]) + UNIT * examples.var(axis=0) + 1e-6)
    examples = (examples - center) / scale
    anchors = np.stack([examples[groups == g].mean(axis=0) for g in range(k)])
    widths = np.stack([examples[groups == g].var(axis=0) for g in range(k)]) + WIDTH
    mixture = Mixture(center, scale, np.full(k, 1.0 / k), anchors, widths)
    before = -np.inf
    for _ in range(rounds):

        def expect(batches: Iterable[pa.RecordBatch], current: Mixture = mixture) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((k, 1 + 2 * d))
            extra = np.zeros(2)
            for batch in batches:
                if batch.num_rows:
                    points_ = _matrix(batch.column(0))
                    x = current.standard(points_)
                    shares, likelihood = current.posterior(points_)
                    sums[:, 0] += shares.sum(axis=0)
                    sums[:, 1 : d + 1] += shares.T @ x
                    sums[:, d + 1 :] += shares.T @ (x**2)
                    extra += (likelihood.sum(), batch.num_rows)
            values = np.concatenate((sums.ravel(), extra))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["slot", "value"])

        rows = points.select("x").mapInArrow(expect, "slot bigint, value double").groupBy("slot").agg(F.sum("value")).collect()
        found = np.zeros(k * (1 + 2 * d) + 2)
        for slot, value in rows:
            found[slot] = value
        likelihood, count = found[-2:]
        if not count:
            break
        sums, anchor = found[:-2].reshape(k, 1 + 2 * d), ANCHOR * count
        mass = sums[:, :1] + anchor
        means = (sums[:, 1 : d + 1] + anchor * anchors) / mass
        squares = (sums[:, d + 1 :] + anchor * (anchors**2 + widths)) / mass
        mixture = Mixture(center, scale, (mass / mass.sum())[:, 0], means, np.maximum(squares - means**2, FLOOR))
        if likelihood / count - before < GAIN:
            break
        before = likelihood / count
    return Mixture(center, scale, mixture.weights, mixture.means, mixture.variances, component_kinds(mixture))


def component_kinds(mixture: Mixture) -> tuple[str, ...]:
    """The kind of each component: that of the inspected examples it holds most of, else of the nearest one."""
    examples, groups, kinds = inspected_points()
    shares, _ = mixture.posterior(examples)
    held = np.zeros((len(mixture.weights), len(KINDS)))
    for row, g in zip(shares, groups):
        held[:, KINDS.index(kinds[g])] += row
    standard, out = mixture.standard(examples), []
    for c, row in enumerate(held):
        near = ((standard - mixture.means[c]) ** 2).sum(axis=1).argmin()
        out.append(KINDS[int(row.argmax())] if row.max() > 0.1 else kinds[groups[near]])
    return tuple(out)


def described(documents: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every text that is not null or blank."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def describe_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            kept = [i for i, text in enumerate(texts) if text is not None and text.strip(BLANK)]
            points = measure_all([texts[i] for i in kept])
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), x], names=["doc_id", "x"])

    return spread(documents.select("doc_id", "text")).mapInArrow(describe_all, f"doc_id {kind}, x array<double>")


def judged_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, x, kind, not_prose`` of every document with text."""
    points = settle(described(documents))
    mixture = fit_mixture(points)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shares = mixture.kind_shares(_matrix(batch.column(1)))
                kinds = pa.array([KINDS[i] for i in shares.argmax(axis=1)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), kinds, pa.array(1.0 - shares[:, 0])], names=["doc_id", "x", "kind", "not_prose"]
                )

    return points.mapInArrow(judge, f"doc_id {kind}, x array<double>, kind string, not_prose double")


def text_statistics(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, a column for each of :data:`STATISTICS`, ``kind`` and the mixture's ``not_prose``.

    ``words``, ``lines`` and ``longest_word`` are counts. A Gaussian mixture is fitted by
    expectation-maximization on the standardized statistics of all documents; its components
    are read as prose, list, table or junk by inspected examples, and a document's ``kind`` is
    the one whose components have the largest posterior together. Null, empty and blank texts
    have no row. Texts are read whole. A text stands for itself however often it is repeated.
    An empty table gives an empty result.
    """
    counts = ("words", "lines", "longest_word")
    rows = judged_documents(documents)
    values = [(F.round(F.expm1(F.col("x")[i]), 1) if n in counts else F.col("x")[i]).alias(n) for i, n in enumerate(STATISTICS)]
    return rows.select("doc_id", *values, "kind", "not_prose")


def not_prose(documents: DataFrame) -> DataFrame:
    """``doc_id, kind`` of the documents that the mixture does not take for running prose (p9_found)."""
    return judged_documents(documents).where(F.col("kind") != "prose").select("doc_id", "kind")
