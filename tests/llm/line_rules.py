"""A reading of documents line by line by hand-written rules: an independent judge for the tests of the mixture."""

import re
from collections import Counter

from runeworks.llm.languages import FUNCTION
from runeworks.llm.textstats import BLANK, measure_all, STATISTICS, readable

_ENDS = re.compile(r"[.!?。．！？…:;]['\"”’»)\]*_`]*\Z")
_ALNUM = re.compile(r"[^\W_]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_MOJIBAKE = re.compile(r"[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u0178\u02c6\u02dc\u2013-\u203a\u20ac\u2122]+")
_CJK = re.compile(r"[぀-ヿ一-鿿가-힣]")
_BULLET = re.compile(r"\s*(?:[-*•·‣◦▪●○–—+»→✓✗]|\(?(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})[.):]|#\d+|\[\d+\]|\[[ xX]\])\s+\S")
_ARROW = re.compile(r"\S\s*(?:->|=>|→|⇒|↦|\bbecomes\b|\t=\t)\s*\S")
_PHYSICS = re.compile(r"^\s*\w+ \w+ = \S+, \w+ = \S+")
_NAMED = re.compile(r"^\s*[\"'“`]?([^\s:=：][^:=：\n]{0,40}?)[\"'”`]?\s*(?::|=|：|\.{3,}|…)\s*(\S.*?)\s*,?\s*$")
_RULE = re.compile(r"^[\s|+\-=:_]{3,}$")
_WIDE = re.compile(r"\S(?: {2,}|\t+)\S")



def _sentence(words: list[str], common: int, line: str) -> bool:
    """Whether a line with ``common`` function words reads like a sentence or a stretch of one."""
    if len(words) >= 4 and common * 5 >= len(words):
        return True
    return len(words) >= 5 and bool(_ENDS.search(line)) and sum(len(w) > 1 for w in words) >= 4


def _marked(line: str) -> bool:
    """Whether a line has anything that columns, pairs or long units need."""
    if "|" in line or "\t" in line or ";" in line or "=" in line or "->" in line or "  " in line or line.count(",") > 1:
        return True
    return len(max(line.split(), key=len)) > 40



def _columns(line: str) -> int:
    """Columns of a line in the layout that gives most of them, if its cells are short."""
    best = 0
    bare = line.strip()
    for mark in ("|", "\t", ";", ","):
        if bare.count(mark) < 2:
            continue
        cells = [c.strip() for c in (bare.strip("|") if mark == "|" else line.strip("\r\n ")).split(mark)]
        if mark in ";," and any(len(_WORD.findall(c)) > 4 for c in cells):
            continue
        if mark == "," and sum(c[:1] == " " for c in bare.split(",")[1:]) * 2 > len(cells) and not any(ch.isdigit() for ch in bare):
            continue
        filled = sum(len(c) <= 40 for c in cells)
        if filled == len(cells):
            best = max(best, len(cells))
    gaps = len(_WIDE.findall(line.strip()))
    if gaps >= 2 or gaps == 1 and line[:3] == "   ":
        cells = [c for c in re.split(r" {2,}|\t+", line.strip()) if c]
        if all(len(_WORD.findall(c)) <= 5 and len(c) <= 45 for c in cells):
            best = max(best, gaps + 1 + (line[:3] == "   "))
    return best


def line_kind(line: str, words: list[str] | None = None, common: int = 0) -> str:
    """Kind of one non-blank line; ``words`` are its lower-case words, ``common`` of them function words."""
    bare = line.strip()
    if words is None:
        words = _WORD.findall(bare.lower())
        common = sum(w in FUNCTION for w in words)
    if len(words) >= 4 and common * 5 >= len(words) and bare.isascii() and not _marked(bare) and not _BULLET.match(line):
        return "prose"
    letters = sum(map(len, words))
    if not bare.isascii() and len(_CJK.findall(bare)) * 2 > len(bare):
        return "junk" if len(set(bare)) <= 3 and len(bare) > 8 else "prose" if len(bare) > 8 or _ENDS.search(bare) else "list"
    if _RULE.match(bare) and ("-" in bare or "=" in bare or "+" in bare):
        return "table" if "|" in bare or "+" in bare else "rule"
    alnum = sum(map(len, _ALNUM.findall(bare)))
    symbols = sum(map(len, bare.split())) - alnum
    if len(bare) > 30 and alnum * 8 < len(bare) and not re.fullmatch(r"\S{1,14} (?:->|=>|→) \S{1,14}", bare):
        return "junk"
    pair = _ARROW.search(bare)
    if pair and len(bare) < 160 and not _sentence(words, common, bare):
        return "list"
    if len(bare) > 24 and len(set(bare.replace(" ", ""))) <= 3:
        return "junk"
    columns = _columns(line)
    if columns >= 3 and not (letters * 4 < len(bare) and not re.search(r"\d", bare) and columns < 4):
        if symbols * 2 < len(bare) or "|" in bare and letters * 5 > len(bare):
            return "table"
    if pair or _PHYSICS.match(bare):
        return "list"
    longest = max(map(len, bare.split()))
    if symbols * 2 > len(bare) and letters * 3 < len(bare) and len(bare) >= 6:
        return "junk"
    if longest > 40 and longest * 2 > len(bare):
        return "junk"
    if "�" in bare and bare.count("�") * 8 > len(bare):
        return "junk"
    if _BULLET.match(line):
        return "list"
    if _sentence(words, common, bare):
        return "prose"
    if len(words) >= 6 and common * 8 >= len(words):
        return "prose"
    if len(words) >= 8 and _gibberish(words):
        return "junk"
    named = _NAMED.match(bare)
    if named and len(_WORD.findall(named.group(1))) <= 4:
        return "list"
    if len(words) <= 6 and len(bare) <= 60:
        return "short" if _ENDS.search(bare) else "list"
    return "prose" if letters * 2 > len(bare) else "junk" if letters * 4 < len(bare) and not re.search(r"\d", bare) else "list"


def _gibberish(words: list[str]) -> bool:
    """Words that hardly look like any language: no function words, few vowels or odd runs."""
    if any(w in FUNCTION and len(w) > 1 for w in words):
        return False
    odd = sum(not re.search(r"[aeiouyäöüéèàáíóúаеиоуыэюя]", w) or bool(re.search(r"[bcdfghjklmnpqrstvwxz]{5}", w)) for w in words)
    return odd * 3 > len(words)


def kind_by_lines(text):
    """The kind of a text by most of its lines; junk goes before the others."""
    plain, marked = readable(text)
    lines = [line for line in plain.split("\n") if line.strip(BLANK)]
    kinds = Counter(map(line_kind, lines))
    kinds["table"] += kinds.pop("rule", 0) if kinds["table"] else 0
    kinds["prose" if kinds["prose"] >= kinds["list"] else "list"] += kinds.pop("short", 0)
    stats = dict(zip(STATISTICS, measure_all([text])[0]))
    total, visible = sum(kinds.values()), "".join(plain.split())
    if not total or stats["markup_share"] > 0.5 and not kinds["table"] or len(visible) > 20 and len(set(visible)) <= 3:
        return "junk"
    if sum(map(len, _MOJIBAKE.findall(text))) * 4 > len(visible) or stats["repetition"] > 0.9:
        return "junk"
    if kinds["junk"] * 2 > total or stats["letter_pairs"] < -2.95 and stats["common_word_share"] < 0.3 and kinds["prose"] + kinds["junk"] > kinds["list"] + kinds["table"] and stats["ideogram_share"] < 0.1:
        return "junk"
    if kinds["prose"] * 2 >= total:
        return "prose"
    return "table" if kinds["table"] >= kinds["list"] else "list"
