"""Problem 6: broken prompt and response pairs."""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeworks.llm.languages import FUNCTION, dominant, word_votes
from runeworks.llm.wordings import FOREIGN, PLACEHOLDERS, REFUSALS
from runeworks.operators.latest import latest
from runeworks.operators.puzzles import current_puzzles

DEFECTS = ("empty", "truncated", "refusal", "copy", "wrong_language")

#: Bound on the labelled rows the classifier is fitted on, before synthetic defects are made of them.
TRAINING_ROWS = 2000

#: How far a threshold lies below the lowest score of a defect that counts, as a share of the gap to the next sound score.
GAP = 0.5

#: Characters that the training rows hold together at most; it bounds what the driver gets.
TRAINING_CHARACTERS = 8_000_000

#: Visible characters up to which a whole response is a feature of its own, as its words are.
SHORT = 24

#: Buckets of the hashed features.
BUCKETS = 1 << 17

#: Sound pairs for each defective one that calibration assumes.
SOUND_FOR_DEFECT = 10.0

_BOX = re.compile(r"\\boxed\s*\{")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d[\d.,]*|[^\w\s]|_+")
_MIXED = re.compile(r"[぀-ヿ一-鿿]|(?:(?![぀-ヿ一-鿿])[^\W\d_])+(?:['’][^\W\d_]+)?|\d[\d.,]*|[^\w\s]|_+")
_PART = re.compile(r"[぀-ヿ一-鿿。]+:?|[^:぀-ヿ一-鿿]+:?|:")
_MARKER = re.compile(r"<\|[^|>]*\|>(?:user|assistant|system)?")
_ARROWS = (" -> ", " becomes ", "distance = ", " => ", " → ")
_VALUE = re.compile(r"“[^”]*”|\"[^\"]*\"|`[^`]*`|\\boxed\s*\{[^{}]*\}|\b\w+=\S+")
_QUOTED = re.compile(r"[“\"`]")
_ROMAN = frozenset("mdclxvi")
_EDGES = "\"“”‘’'`*$.,:;()。"
_FENCE = re.compile(r"```\w*|[$`*>#]")
_NOTHING = re.compile(r"[\s\u200b-\u200f\u2060\ufeff\u00ad.…]+")
_UNSEEN = re.compile(r"[\u200b-\u200f\u2060\ufeff\u00ad]")
_SENTENCE = re.compile(r"[^.!?。\n]+[.!?。\n]+\s*")


def boxes(text: str) -> list[tuple[int, int, str, bool]]:
    """Start, end and content of each box of ``text``, and whether it is closed; the last may be open."""
    found, at = [], 0
    while m := _BOX.search(text, at):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += (text[i] == "{") - (text[i] == "}")
            i += 1
        found.append((m.start(), i, text[m.end() : i - (not depth)], not depth))
        at = i
    return found


def _spoken(text: str) -> list[str]:
    """Lower-case tokens without chat markers and signs of quoting, for comparing texts."""
    return _split(_FENCE.sub(" ", _MARKER.sub(" ", text)).lower())


def _split(text: str) -> list[str]:
    """Words, numbers and signs; ideograms and kana one by one."""
    return (_TOKEN if text.isascii() else _MIXED).findall(text)


_CHUNKS: dict[str, list[str]] = {}


def _words_of(chunk: str) -> list[str]:
    got = _CHUNKS.get(chunk)
    if got is None:
        if len(_CHUNKS) > 200_000:
            _CHUNKS.clear()
        got = _CHUNKS[chunk] = ["<n>" if t[0].isdigit() else t for t in _split(chunk.lower().replace("’", "'"))]
    return got


_VOTES_OF: dict[str, dict[str, float]] = {}


def _votes_of(text: str) -> dict[str, float]:
    """:func:`word_votes` of a text without blanks or of a line, which come again and again."""
    got = _VOTES_OF.get(text)
    if got is None:
        if len(_VOTES_OF) > 200_000:
            _VOTES_OF.clear()
        got = _VOTES_OF[text] = word_votes(text)
    return got


def _add(votes: dict[str, float], more: dict[str, float]) -> None:
    for language, n in more.items():
        votes[language] = votes.get(language, 0.0) + n


class Prompt:
    """What is measured of a prompt: its language, what its outputs are made of, and its words.

    ``prose`` holds the words that sentences are made of and ``values`` those that outputs are
    made of, as far as training rows show them.
    """

    def __init__(self, text: str | None, prose: frozenset[str] = frozenset(), values: frozenset[str] = frozenset()) -> None:
        self.text = text or ""
        self.prose, self.values = prose, values
        outputs, inputs, sentences = [], [], []
        for line in self.text.split("\n"):
            for mark in _ARROWS:
                at = line.rfind(mark)
                if at > 0:
                    outputs.append(line[at + len(mark) :].strip())
                    inputs.append(line[:at])
                    break
            else:
                sentences.append(line)
        # Support pairs are no sentences: only the other lines tell the language.
        self.sentences = _MARKER.sub(" ", "\n".join(sentences)) if "<|" in self.text else "\n".join(sentences)
        votes: dict[str, float] = {}
        for line in self.sentences.split("\n"):
            _add(votes, _votes_of(line))
        self.language = dominant(votes)
        chunks = [o.split() for o in outputs if o]
        given, asked = set("".join(outputs)), set("".join(inputs))
        self.wordy = not chunks or len({c.lower() for c in given if c.isalpha()} - _ROMAN) > 3
        # Where all inputs and outputs have one length, a shorter value was cut off; else length tells nothing.
        lengths = {len("".join(x.split())) for x in (*inputs, *outputs)}
        self.least = lengths.pop() if len(lengths) == 1 and len(chunks) > 1 else 1
        marks = set() if self.wordy else {c for c in given | asked if not c.isalnum()}
        self.alphabet = {c for c in given | marks if not c.isspace()}
        if any(c.isdigit() for c in self.alphabet) and self.alphabet - set("01"):
            self.alphabet |= set("0123456789.")
        self.alphabet |= {c.upper() for c in self.alphabet} | {c.lower() for c in self.alphabet}
        self.signs = bool(self.alphabet) and not any(c.isalnum() for c in self.alphabet)
        self.words = {w.lower() for c in chunks for w in c} if self.wordy else frozenset()
        self.edges = "".join(c for c in _EDGES if c == "." or c not in self.alphabet)

    @cached_property
    def spoken(self) -> list[str]:
        """Tokens of the whole prompt."""
        return _spoken(self.text)

    @cached_property
    def vocabulary(self) -> frozenset[str]:
        """Distinct tokens of the prompt."""
        return frozenset(self.spoken)

    @cached_property
    def trigrams(self) -> frozenset[tuple[str, ...]]:
        """Runs of three tokens of the prompt."""
        return frozenset(zip(self.spoken, self.spoken[1:], self.spoken[2:]))

    @cached_property
    def joined(self) -> str:
        """Tokens of the whole prompt, each between single blanks."""
        return f" {' '.join(self.spoken)} "

    def shape(self, core: str) -> str | None:
        """What a chunk looks like beside the outputs, None for a word of sentences.

        ``<v>`` is made of what outputs are made of, but for a few characters; ``<v->`` is shorter
        than every output where all have one length; ``<?>`` is a word that neither sentences
        nor outputs had so far, or letters and digits mixed.
        """
        low = core.lower()
        if core.isalpha() and (low in FUNCTION or low in self.prose):
            return None
        if self.wordy and core.isalpha():
            return "<v>" if low in self.values or low in self.words else "<?>"
        if not self.alphabet:
            return "<v>" if core.isalnum() and not core.isalpha() else None
        if self.alphabet.issuperset(core):
            return "<v>" if len(core) >= self.least else "<v->"
        if not (self.signs and any(map(str.isalnum, core))) and sum(c in self.alphabet for c in core) > (0.8 if self.wordy else 0.6) * len(core):
            return "<v>"
        return "<?>" if core.isalnum() and any(map(str.isalpha, core)) and any(map(str.isdigit, core)) else None


_level = bisect_right


_SIZES, _SHARES, _VOTES = (1, 2, 4, 8, 16, 32, 64), (0.02, 0.2, 0.4, 0.6, 0.8, 0.95), (1, 2, 3, 5, 8)
_OTHER, _NEW = (0.01, 0.2, 0.4, 0.5, 0.6, 0.8), (0.15, 0.3, 0.45, 0.6, 0.75, 0.9)


class Pair:
    """A prompt with its response, and what is measured of both; nothing here decides on a defect."""

    __slots__ = ("tokens", "size", "filled", "hollow", "open_box", "open_think", "copy_share", "copy_size", "own_share", "other_share", "votes", "ended", "core", "fresh")

    def __init__(self, p: Prompt, response: str | None) -> None:
        text = response or ""
        if not text.isascii():
            text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
        spans = boxes(text) if "\\boxed" in text else []
        self.filled = sum(closed and bool(_NOTHING.sub("", content)) for _, _, content, closed in spans)
        self.hollow = sum(closed for _, _, _, closed in spans) - self.filled
        self.open_box = any(not closed for _, _, _, closed in spans)
        if "think>" in text:
            text = text.replace("<think>", " <think> ").replace("</think>", " </think> ")
            spans = boxes(text) if spans else []
        self.open_think = "<think>" in text and "</think>" not in text
        tokens: list[str] = []
        votes: dict[str, float] = {}
        at = 0
        for start, end, content, closed in spans:
            self._plain(p, text[at:start], tokens, votes)
            if not closed:
                tokens.append("<open")
                self._plain(p, content, tokens, votes)
            elif _NOTHING.sub("", content):
                tokens.append("<box")
                self._plain(p, content, tokens, {})
                tokens.append("box>")
            else:
                tokens.append("<hollow>")
            at = end
        self._plain(p, text[at:], tokens, votes)
        self.tokens = tokens
        bare = _BOX.sub(" ", _FENCE.sub(" ", text.replace("<think>", " ").replace("</think>", " "))).replace("}", " ")
        self.size = len(_NOTHING.sub("", bare))
        self.core = " ".join(bare.split()).lower() if self.size <= SHORT else ""
        # How much of the response stands in the prompt: runs of three tokens, or all tokens of a shorter one.
        spoken = _spoken(text)
        # fresh counts the tokens after the last that stand in the prompt so.
        self.copy_size, self.copy_share, self.fresh = len(spoken), 0.0, 3
        if spoken:
            known = [t in p.vocabulary for t in spoken]
            if len(spoken) < 3:
                self.copy_share, self.fresh = sum(known) / len(spoken), 3 * (not all(known))
            else:
                # A run can stand in the prompt only where each of its tokens does. Few runs are
                # looked up in the text, many in a table of its runs, which comes to the same.
                runs = zip(spoken, spoken[1:], spoken[2:])
                if len(spoken) <= 64:
                    met = [a and b and c and f" {x} {y} {z} " in p.joined for a, b, c, (x, y, z) in zip(known, known[1:], known[2:], runs)]
                else:
                    met = [run in p.trigrams for run in runs]
                self.copy_share = sum(met) / len(met)
                self.fresh = next((i for i, x in enumerate(reversed(met)) if x), 3)
        if _QUOTED.search(text):  # what is quoted has no vote
            votes = word_votes(_VALUE.sub(" ", text))
        self.votes = sum(votes.values())
        own = votes.get(p.language, 0.0) if p.language else 0.0
        self.own_share = 1.0 if not p.language else own / self.votes if self.votes else 0.0
        self.other_share = (max(votes.values()) - own) / self.votes if self.votes and p.language else 0.0
        last = text.rstrip().rstrip("`$*\"”")[-1:]
        self.ended = 2 if not last else 1 if last in ".!?。}！？" else 0

    @staticmethod
    def _plain(p: Prompt, text: str, out: list[str], votes: dict[str, float]) -> None:
        """Add the tokens of ``text`` to ``out`` and the votes of its words to ``votes``; ``key=value`` texts have none."""
        for chunk in text.split():
            if chunk in ("<think>", "</think>"):
                out.append(chunk)
                continue
            for part in _PART.findall(chunk) if ":" in chunk or not chunk.isascii() else (chunk,):
                core = part.strip(p.edges)
                shape = p.shape(core) if core else None
                if shape:
                    out.append(shape)
                    if part[-1] in ".。:;,":
                        out.append(part[-1])
                else:
                    out.extend(_words_of(part))
                if shape in (None, "<?>") and "=" not in chunk:
                    _add(votes, _votes_of(part))

    def grams(self) -> list[int]:
        """Buckets of the words and word pairs of the response, each once."""
        seq = ["<s>", *self.tokens, "</s>"]
        found = set(zip(seq, seq[1:]))
        found.update([(t, "") for t in self.tokens])
        return list({_GRAMS.get(pair) or _bucket(*pair) for pair in found})

    def marks(self) -> list[int]:
        """Buckets of how the response begins and ends, and of the levels of what is measured of the pair."""
        t = self.tokens
        e = t[-3:]
        held = min(self.filled, 2)
        place = next((i for i, x in enumerate(reversed(t)) if x in ("<v>", "box>")), 9) if t else 10
        copied = _level(_SHARES, self.copy_share)
        size, held1, near = _level(_SIZES, self.size), min(held, 1), min(place, 3)
        other, votes = _level(_OTHER, self.other_share), _level(_VOTES, self.votes)
        long, fresh = _level(_SIZES, self.copy_size), min(self.fresh, 3)
        # The end again, with each run of values as one.
        short: list[str] = []
        for x in reversed(t):
            x = "<v>" if x == "<?>" else x
            if not short or x != "<v>" or short[-1] != x:
                if len(short) == 4:
                    break
                short.append(x)
        found = [
            ("c2", *short[:2]), ("c3", *short[:3]), ("c4", *short),
            ("e1", *e[-1:]), ("e2", *e[-2:]), ("e3", *e), ("s1", *t[:1]), ("s2", *t[:2]),
            ("size", size), ("size", size, held), ("box", held, min(self.hollow, 1), self.open_box), ("think", self.open_think),
            ("place", min(place, 6), held), ("place", min(place, 6), held, size), ("ended", self.ended, held), ("ended", self.ended, min(place, 6), self.open_box),
            ("copy", copied, held), ("copy", copied, long, held1, "long"), ("copy", copied, near, held1, "near"),
            ("fresh", copied, fresh if copied > 2 else 3, held1), ("fresh", fresh if copied > 2 else 9, long, held1, "long"),
            ("other", other, votes), ("other", other, held, near), ("own", _level(_OTHER, self.own_share), votes),
        ]
        if self.size <= SHORT and not self.filled:
            found.append(("core", self.core))
        return [_MARKS.get(x) or _mark(x) for x in found]

    def novelty(self, strange: float) -> int:
        """Bucket of how strange the words are, with how the response ends and whose language it is in."""
        level = _level(_NEW, strange)
        key = ("new", level, min(self.filled, 1), self.ended, self.own_share >= 0.5, self.tokens[-1:] in (["<v>"], ["box>"]))
        return _MARKS.get(key) or _mark(key)


_GRAMS: dict[tuple[str, str], int] = {}


def _bucket(a: str, b: str) -> int:
    got = _GRAMS.get((a, b))
    if got is None:
        if len(_GRAMS) > 500_000:
            _GRAMS.clear()
        got = _GRAMS[(a, b)] = zlib.crc32(f"{a}\x01{b}".encode("utf-8", "surrogatepass")) % BUCKETS
    return got


_MARKS: dict[tuple, int] = {}


def _mark(key: tuple) -> int:
    if len(_MARKS) > 500_000:
        _MARKS.clear()
    got = _MARKS[key] = zlib.crc32(" ".join(map(str, key)).encode("utf-8", "surrogatepass") + b"\x02") % BUCKETS
    return got


@dataclass(slots=True)
class Features:
    """Features of many pairs: bucket and value of each, and where the features of a pair end."""

    ids: np.ndarray
    values: np.ndarray
    ends: np.ndarray

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Weighted sums, a row for each pair."""
        sums = np.concatenate((np.zeros((1, weights.shape[1])), np.cumsum(weights[self.ids] * self.values[:, None], axis=0, dtype=np.float64)))
        return sums[self.ends] - sums[np.concatenate(([0], self.ends[:-1]))]


def features(pairs: list[Pair], familiar: np.ndarray, own: list[frozenset[int]] | None = None, hidden: np.ndarray | None = None) -> Features:
    """Hashed n-grams, weighted by the root of their number, and the marks of each pair.

    ``familiar`` counts the sound responses that have an n-gram; ``own`` are n-grams of the
    response a pair was made of, which do not count for it. Pairs marked in ``hidden`` show no
    n-grams, as if all their wording were new.
    """
    n = len(pairs)
    each = [pair.grams() for pair in pairs]
    sizes = np.fromiter(map(len, each), dtype=np.int64, count=n)
    grams = np.fromiter(chain.from_iterable(each), dtype=np.int64, count=int(sizes.sum()))
    of = np.repeat(np.arange(n), sizes)
    met = familiar[grams]
    if own is not None:
        met = met - np.fromiter((x in mine for g, mine in zip(each, own) for x in g), dtype=bool, count=len(grams))
    strange = np.where(sizes > 0, 1.0 - np.bincount(of, weights=met > 0, minlength=n) / np.maximum(sizes, 1), 0.0)
    if hidden is not None:
        strange = np.where(hidden, 1.0, strange)
        grams, of = grams[~hidden[of]], of[~hidden[of]]
    marks = [[*pair.marks(), pair.novelty(x)] for pair, x in zip(pairs, strange.tolist())]
    counts = np.fromiter(map(len, marks), dtype=np.int64, count=n)
    both = np.concatenate((of, np.repeat(np.arange(n), counts)))
    order = np.argsort(both, kind="stable")
    ids = np.concatenate((grams, np.fromiter(chain.from_iterable(marks), dtype=np.int64, count=int(counts.sum()))))[order]
    values = np.concatenate((1.0 / np.sqrt(np.bincount(of, minlength=n)[of]), np.ones(int(counts.sum()))))[order]
    return Features(ids, values, np.cumsum(np.bincount(both, minlength=n)))


@dataclass(slots=True)
class Classifier:
    """Multi-label linear classifier: weights of hashed features and a calibrated threshold for each defect.

    A pair is defective where a defect reaches its threshold, and then has the one with most log odds.
    """

    weights: np.ndarray
    thresholds: np.ndarray
    familiar: np.ndarray
    prose: frozenset[str]
    values: frozenset[str]

    def pair(self, prompt: str | None, response: str | None) -> Pair:
        """The measured pair of two texts."""
        return Pair(Prompt(prompt, self.prose, self.values), response)

    def scores(self, pairs: list[Pair]) -> np.ndarray:
        """Log odds of each defect, a row for each pair."""
        return features(pairs, self.familiar).scores(self.weights)

    def verdicts(self, pairs: list[Pair]) -> list[str | None]:
        """The defect of each pair, None for a sound one."""
        if not pairs:
            return []
        scores = self.scores(pairs)
        flagged = (scores >= self.thresholds).any(axis=1)
        return [DEFECTS[d] if hit else None for d, hit in zip(scores.argmax(axis=1), flagged)]


def _cased(text: str, rng: np.random.Generator) -> str:
    """``text``, at times in lower or upper case or without its last sign."""
    kind = rng.random()
    text = text.lower() if kind < 0.2 else text.upper() if kind < 0.3 else text
    return text.rstrip(".!。") if rng.random() < 0.3 else text


def _unboxed(text: str) -> str:
    """``text`` with the contents of its boxes in their place."""
    for start, end, content, _ in reversed(boxes(text)):
        text = text[:start] + content + text[end:]
    return text


def synthetic_defects(rows: list[tuple[str, str]], seed: int = 5) -> list[tuple[str, str, int, int]]:
    """Prompt, response, label and source row: sound pairs (label -1) and defects made of them.

    Truncated, copied, swapped, refused and emptied responses carry the number of their defect.
    """
    rng = np.random.default_rng(seed)
    by_language: dict[str | None, list[str]] = {}
    spoken_by: dict[str | None, list[str]] = {}
    prompts = [Prompt(p) for p, _ in rows]
    for p, (_, r) in zip(prompts, rows):
        by_language.setdefault(p.language, []).append(r)
        spoken_by.setdefault(p.language, []).append(p.text)
    out: list[tuple[str, str, int, int]] = []

    def pick(options):
        return options[int(rng.integers(0, len(options)))]

    for at, (p, (prompt, response)) in enumerate(zip(prompts, rows)):
        spans = [b for b in boxes(response) if b[3]]
        if not spans:
            continue
        start, _, value, _ = spans[-1]
        unboxed = _unboxed(response)
        body = response[: spans[0][0]]
        lines = [line for line in _MARKER.sub("", prompt).split("\n") if line.strip()]
        asked = next((line for line in reversed(lines) if "\\boxed" not in line), "")
        sentences = _SENTENCE.findall(body)
        chained = "=" in response[:start]  # a trace is no sentence

        def sound(text, source=at, prompt=prompt):
            out.append((prompt, text, -1, source))

        def broken(text, label, source=at, prompt=prompt):
            out.append((prompt, text, label, source))

        sound(response)
        sound(value)
        sound(unboxed if not chained else f"{asked}\n{value}")
        sound(pick((f"\\boxed{{{value}}}", f"$\\boxed{{{value}}}$", f"```\n{value}\n```", f"```\n{response}\n```", f"```\n{unboxed}\n```", f"{response}\n\\boxed{{{value}}}")) if not chained else f"\\boxed{{{value}}}")
        for _ in range((1 + p.wordy) if len(value) > 2 else 0):
            slip = int(rng.integers(0, len(value)))
            slipped = value[:slip] + pick("abcdefghijklmnopqrstuvwxyz0123456789~") + value[slip + 1 :]
            sound(pick((slipped, f"{response[:start]}{slipped}", f"{response[:start]}\\boxed{{{slipped}}}")) if not chained else f"\\boxed{{{slipped}}}")
        other = rows[int(rng.integers(0, len(rows)))][1]
        wrong = [b for b in boxes(other) if b[3]]
        sound(pick((value, f"{asked}\n{response}", f"{asked}\n{unboxed}", f"\\boxed{{{wrong[-1][2] if wrong else value}}}", unboxed)) if not chained else f"{asked}\n{response}")
        if p.language in FOREIGN:
            said = FOREIGN[p.language]
            sound(pick((" ", "\n")).join([*(pick(said[0]) for _ in range(int(rng.integers(0, 3)))), f"{pick(said[1])} {pick((value, f'{value}.', f'{chr(92)}boxed{{{value}}}'))}"]))
        # Truncated: cut before the answer is complete, within or after a sentence, some with a step begun.
        cut = int(rng.integers(1, max(2, start)))
        opened = pick(("", "", "<think>\n")) if "<think>" not in response else ""
        if start > 2:
            broken(opened + response[:cut], 1)
        if not chained:
            if len(value) > 1 and "<" not in value:
                broken(response[:start] + "\\boxed{" + value[: int(rng.integers(0, len(value)))], 1)
            if p.alphabet <= set("01") and len(value) == p.least:
                broken(response[:start] + value[: int(rng.integers(1, len(value)))], 1)
            for _ in range(2 if sentences else 0):
                said = "".join(sentences[: int(rng.integers(1, len(sentences) + 1))]).strip()
                ending = pick(("", "", " " + pick(sentences)[: int(rng.integers(3, 12))].strip(), f"\n{pick(sentences).split()[0]} {int(rng.integers(2, 9))}:"))
                if said and not said.endswith((":", "：")):
                    broken(opened + said + ending, 1)
        # Copied: the prompt, a part of it, or its closing question, however typed.
        whole = _MARKER.sub("", prompt).replace("<think>", "").strip()
        copied = pick((whole, whole, "\n".join(lines[int(rng.integers(0, len(lines))) :]) if lines else whole, asked, asked, asked))
        if len(copied.split()) > 1:
            how = rng.random()
            copied = copied.upper() if how < 0.15 else copied.lower() if how < 0.3 else "\n".join("> " + x for x in copied.split("\n")) if how < 0.4 else " ".join(copied.split()) if how < 0.55 else f"{pick(('Question', 'Prompt', 'Q'))}: {copied}" if how < 0.7 else copied
            broken(copied, 3)
        # Refused: in the language of the prompt mostly, after some sentences or none.
        for _ in range(2):
            openers, cores, closers = REFUSALS[p.language if p.language in REFUSALS and rng.random() < 0.85 else pick(sorted(REFUSALS))]
            said = f"{pick(openers)}{pick(cores)}{pick(('.', '.', '!', ''))}"
            said = _cased((said[:1].upper() + said[1:]) + (" " + pick(closers) if rng.random() < 0.4 else ""), rng)
            how = rng.random()
            if how < 0.2 and sentences:
                said = "".join(sentences[: int(rng.integers(1, 3))]).strip() + " " + said
            elif how < 0.3:
                said = f"<think>\n{said}\n</think>\n{said}"
            elif how < 0.55:
                said = f"{said} \\boxed{{{pick(('unknown', 'none', 'N/A', '?', ''))}}}"
            broken(said, 2)
        # Emptied.
        placeholder = pick(PLACEHOLDERS)
        if not p.alphabet.issuperset(placeholder.replace(" ", "")) or not placeholder.strip():
            placeholder = placeholder.upper() if rng.random() < 0.2 else placeholder
            broken(pick((placeholder, placeholder, placeholder, f"\\boxed{{{placeholder if not placeholder.strip() else ' '}}}", "$\\boxed{}$", f"<think>{pick(('', chr(10) * 2))}</think>{pick(('', chr(10) + chr(92) + 'boxed{}'))}")), 0)
        # Swapped into another language: the response of another prompt, or general sentences, around an answer.
        languages = [k for k in by_language if k and k != p.language]
        if p.language:
            if languages and rng.random() < 0.5:
                told = pick(by_language[pick(languages)])
                if rng.random() < 0.4:
                    told = _unboxed(told)
            else:
                said = FOREIGN[pick([k for k in FOREIGN if k != p.language])]
                lead = response[len("".join(sentences)) : start] if rng.random() < 0.2 and not chained else pick(said[1])
                told = pick((" ", "\n")).join([pick(said[0]) for _ in range(int(rng.integers(1, 5)))] + [lead.strip() + " " + pick((f"\\boxed{{{value}}}", f"\\boxed{{{value}}}", value))])
            votes = word_votes(_VALUE.sub(" ", told))
            if sum(votes.values()) >= 4 and "=" not in told.split("\\boxed")[0]:
                broken(told, 4)
                # The same sentences are sound where the prompt is in their language.
                twins = spoken_by.get(dominant(votes))
                if twins and "\\boxed" in told:
                    sound(told, prompt=pick(twins))
    return out


def _thresholds(scores: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """For each defect, the score that tells its held-out pairs best from sound ones.

    Best is the greatest F1 with sound pairs weighing :data:`SOUND_FOR_DEFECT` times the defective
    ones together; the threshold lies halfway down to the next sound score.
    """
    out = np.zeros(scores.shape[1])
    sound = targets.sum(axis=1) == 0
    below = np.sort(scores[sound], axis=0)
    for d in range(scores.shape[1]):
        s = np.sort(scores[targets[:, d] > 0, d])[::-1]
        if not len(s) or not len(below):
            continue
        above = len(below) - np.searchsorted(below[:, d], s)
        true = np.arange(1, len(s) + 1)
        f1 = 2 * true / (true + SOUND_FOR_DEFECT * len(s) * above / len(below) + len(s))
        k = int(f1.argmax())
        next_sound = below[len(below) - above[k] - 1, d] if above[k] < len(below) else s[k] - 1.0
        out[d] = s[k] - GAP * (s[k] - next_sound)
    return out


def fit(rows: list[tuple[str, str]], seed: int = 5, epochs: int = 12, rate: float = 0.2) -> Classifier:
    """Fit on the synthetic defects of sound ``rows`` by adaptive gradient steps, and calibrate the thresholds.

    Each fifth row is held out for the thresholds. A quarter of the pairs hides its n-grams, of
    swapped ones a half, so that the classifier also learns to judge wordings that no training
    row has.
    """
    rng = np.random.default_rng(seed)
    made = synthetic_defects(rows, seed)
    prose = {w for p, _ in rows for w in _spoken(Prompt(p).sentences)} | {w for _, r in rows for b in [boxes(r)] if b for w in _spoken(r[: b[0][0]])}
    inside = {w for _, r in rows for b in boxes(r) for w in _spoken(b[2])} | {w for p, _ in rows for w in _outputs(p)}
    said = {w for texts in REFUSALS.values() for part in texts for t in part for w in _spoken(t)} | {w for a, b in FOREIGN.values() for t in (*a, *b) for w in _spoken(t)} | {w for t in PLACEHOLDERS for w in _spoken(t)}
    known = frozenset((prose - inside) | said)
    values = frozenset(inside - known)
    prompts = {p: Prompt(p, known, values) for p in {m[0] for m in made}}
    pairs = [Pair(prompts[p], r) for p, r, _, _ in made]
    source = np.asarray([m[3] for m in made])
    sound_grams = [frozenset(Pair(prompts.get(p) or Prompt(p, known, values), r).grams()) for p, r in rows]
    familiar = np.bincount(np.fromiter(chain.from_iterable(sound_grams), dtype=np.int64), minlength=BUCKETS).astype(np.int32)
    hidden = rng.random(len(made)) < np.where([m[2] == 4 for m in made], 0.5, 0.25)
    data = features(pairs, familiar, [sound_grams[a] for a in source], hidden)
    targets = np.zeros((len(made), len(DEFECTS)))
    for i, m in enumerate(made):
        if m[2] >= 0:
            targets[i, m[2]] = 1.0
    begins = np.concatenate(([0], data.ends[:-1]))
    held = source % 5 == 0 if len(rows) >= 5 else np.zeros(len(made), dtype=bool)
    train = np.flatnonzero(~held)
    weights, speed = np.zeros((BUCKETS, len(DEFECTS))), np.full((BUCKETS, len(DEFECTS)), 1e-2)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(16, len(train) // 128)):
            lengths = data.ends[batch] - begins[batch]
            row = np.repeat(np.arange(len(batch)), lengths)
            at = np.repeat(begins[batch] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            ids, worth = data.ids[at], data.values[at][:, None]
            scores = np.add.reduceat(weights[ids] * worth, np.cumsum(lengths) - lengths, axis=0)
            error = targets[batch] - 1.0 / (1.0 + np.exp(-np.clip(scores, -30, 30)))
            touched, where = np.unique(ids, return_inverse=True)
            pull = error[row] * worth
            step = np.stack([np.bincount(where, weights=pull[:, d], minlength=len(touched)) for d in range(len(DEFECTS))], axis=1)
            step = step / len(batch) - 1e-5 * weights[touched]
            speed[touched] += step**2
            weights[touched] += rate * step / np.sqrt(speed[touched])
    chosen = np.flatnonzero(held & ~hidden) if held.any() else np.arange(len(made))
    scores = data.scores(weights)[chosen]
    return Classifier(weights.astype(np.float32), _thresholds(scores, targets[chosen]), familiar, known, values)


def _outputs(prompt: str) -> list[str]:
    """Tokens of the outputs of the support pairs."""
    return [w for line in prompt.split("\n") for mark in _ARROWS[:1] if mark in line for w in _spoken(line.rsplit(mark, 1)[1])]


def response_pairs(records: DataFrame, evaluations: DataFrame, puzzles: DataFrame) -> DataFrame:
    """``table_name, record_id, prompt, response`` of both tables, each record once."""
    sft = latest(records, "record_id", "built_at", prompt=F.col("prompt"), response=F.col("completion"))
    # Records without an example match nothing; a key of their own spreads them over the tasks.
    example = F.coalesce("example_id", F.concat(F.lit("\x01"), F.col("record_id").cast("string")))
    asked = latest(evaluations, "record_id", "ingested_at", __example=example, response=F.col("prediction"))
    prompts = current_puzzles(puzzles, "raw_prompt").select(F.col("id").alias("__example"), F.col("raw_prompt").alias("prompt"))
    both = asked.join(prompts, "__example", "left").select("record_id", "prompt", "response")
    return sft.select(F.lit("sft_records").alias("table_name"), "record_id", "prompt", "response").unionByName(
        both.select(F.lit("eval_records").alias("table_name"), "record_id", "prompt", "response")
    )


def training_rows(records: DataFrame, bound: int = TRAINING_ROWS) -> list[tuple[str, str]]:
    """At most ``bound`` pairs to fit on: completions that box their record's own target answer.

    Rows are taken in hash order, and only while they hold :data:`TRAINING_CHARACTERS` together;
    one that alone holds a twentieth of that is no training row.
    Completions in another language than their prompt are left out, so that the swapped ones
    are made on purpose.
    """
    boxed = F.concat(F.lit("\\boxed{"), F.trim("target_answer"), F.lit("}"))
    sound = records.where(F.col("completion").contains(boxed) & (F.length(F.trim("target_answer")) > 0) & F.col("prompt").isNotNull())
    # Only rows with small hashes can be among the first: what the tasks send stays bounded.
    place = F.pmod(F.xxhash64("record_id"), F.lit(1 << 40))
    below = (1 << 40) * min(1.0, 4 * bound / max(1, sound.count()))
    size = F.length("prompt") + F.length("completion")
    picked = (
        sound.where((place < int(below)) & (size <= TRAINING_CHARACTERS // 20))
        .select("prompt", "completion", size.alias("size"))
        .orderBy(place, "record_id", "completion")
        .limit(bound)
    )
    kept, total = [], 0
    for prompt, response, n in picked.toLocalIterator():
        total += n
        if total > TRAINING_CHARACTERS:
            break
        pair = Pair(Prompt(prompt), response)
        if pair.votes < 2 or pair.own_share >= 0.5:
            kept.append((prompt, response))
    return kept


def broken_pairs(
    records: DataFrame, evaluations: DataFrame, puzzles: DataFrame, bound: int = TRAINING_ROWS
) -> DataFrame:
    """``table_name, record_id, defect`` of every response with a defect, each once (p6_found).

    A multi-label linear classifier on hashed n-grams and pair features, fitted on at most
    ``bound`` sound pairs and the defects made of them, gives each pair the defect that lies
    furthest above its calibrated threshold, or none. Defects are ``empty``, ``truncated``,
    ``refusal``, ``copy`` and ``wrong_language``. Repeated rows of a record count once, by
    the latest; rows without a record id are left out. An unknown ``example_id`` leaves the
    prompt null: the response is then judged alone. Where no record is sound, general
    sentences stand in for the training rows. Empty tables give an empty result.
    """
    model = fit(training_rows(records, bound) or general_rows())
    shared = records.sparkSession.sparkContext.broadcast(model)
    kind = records.schema["record_id"].dataType.simpleString()

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = shared.value
        for batch in batches:
            prompts: dict[str | None, Prompt] = {}
            names, records_, asked, answers = (c.to_pylist() for c in batch.columns)
            pairs = []
            for prompt, response in zip(asked, answers):
                known = prompts.get(prompt)
                if known is None:
                    known = prompts[prompt] = Prompt(prompt, classifier.prose, classifier.values)
                pairs.append(Pair(known, response))
            hits = [(n, i, v) for n, i, v in zip(names, records_, classifier.verdicts(pairs)) if v]
            tables, ids, found = ([h[k] for h in hits] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tables, pa.string()), pa.array(ids, batch.column(1).type), pa.array(found, pa.string())],
                names=["table_name", "record_id", "defect"],
            )

    pairs = response_pairs(records, evaluations, puzzles)
    return pairs.mapInArrow(judge, f"table_name string, record_id {kind}, defect string")


def general_rows() -> list[tuple[str, str]]:
    """Sound pairs of general sentences, for tables that have none to fit on."""
    out = []
    for sentences, leads in FOREIGN.values():
        for i, s in enumerate(sentences):
            pairs = "\n".join(f"{n * 37 % 256:08b} -> {n * 91 % 256:08b}" for n in range(i + 1, i + 5))
            out.append((f"{sentences[-1]} {sentences[0]}\n{pairs}\n{leads[0]} 0{i + 64:b}", f"{s} {leads[i % len(leads)]} \\boxed{{{i * 53 % 256:08b}}}"))
    return out
