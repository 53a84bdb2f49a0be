"""Broken pairs told by hand-written rules: an independent judge for the tests of the classifier."""

import re
from functools import cached_property

from runeworks.llm.languages import FUNCTION, dominant, word_votes

# Texts that stand in the place of an answer.
PLACEHOLDERS = frozenset(
    "n/a na null none nan nil tbd todo - -- --- _ __ . .. ... … ? ?? ??? unknown undefined empty blank answer "
    "your answer [answer] <answer> (answer) (none) (empty) [none] no answer pending placeholder".split()
    + ["your answer", "no answer", "your answer here", "answer here", "n.a.", "keine", "k.a.", "s/o", "нет", "なし"]
)

# Phrases that lead to a final answer, by language.
LEADS = (
    r"final answer|so the answer|the answer|answer|therefore|thus|hence|result|applying it to the query gives|the query gives|it follows that"
    r"|also lautet die antwort|die antwort|antwort|ergebnis|ergibt das|damit ergibt sich|somit|folglich"
    r"|la réponse est donc|la réponse|réponse|résultat|elle donne|donc|ainsi"
    r"|la respuesta|respuesta|resultado|a la pregunta da|por lo tanto|solución"
    r"|значит, ответ|ответ|получаем|результат|итак"
)
LEADS_JA = "したがって答えは|答えは|答え|結果は|結果|解答"
_LEAD = re.compile(rf"(?:(?:{LEADS})(?![^\W\d_])|{LEADS_JA})(?:\s|is\b|are\b|ist\b|lautet\b|est\b|es\b|[:：=—-])*", re.I)
_CLOSING = re.compile(r"(?:です|である)?[。.]*\Z")

# Ways to decline, by language.
REFUSING = re.compile(
    r"\b(?:can(?:'|’)?t|cannot|can not|could not|couldn't|unable to|not able to|won(?:'|’)t|will not|would rather not|refuse|decline)\b"
    r"(?!\s*\Z|\s+(?:u|us|use|e|ex|exp|expl|expla|explai|explain|be (?:the )?right|hold)\b)"
    r"|not possible for me|nothing i can|no answer can|not (?:have )?enough information|not allowed|am allowed|isn(?:'|’)t something|not something i"
    r"|not in a position|outside (?:of )?what|beyond what|against my|as an? (?:ai|language)|language (?:model|assistant)|please ask someone|happy to look at"
    r"|\bkann\b[^.]{0,60}\bnicht\b|nicht möglich|nicht helfen|nicht beantworten|nicht lösen|nicht befugt|nicht erlaubt|keine antwort|darf ich nicht|außerstande|frag jemand|sprachassistent|mir fehlen|fehlen die angaben|kein ergebnis|möchte ich nicht|lieber nicht|muss ich (?:leider )?(?:ablehnen|passen)|lehne ich|keine auskunft|anderen frage"
    r"|ne (?:peux|puis|suis|saurais)\b|n'ai pas (?:assez|le droit)|pas (?:en mesure|autorisée?|possible)|impossible de|aucune réponse|aucun résultat|préfère ne pas|m'est impossible|ne traite pas|sera la bienvenue|me manque|refuse|vous aider|assistant de langue|quelqu'un d'autre|autre question"
    r"|no puedo|no podr[ée]|no estoy autorizad|no es posible|no me es posible|no soy capaz|ning[uú]n resultado|ninguna respuesta|otra persona|otra pregunta|asistente de idiomas|me niego|me faltan|faltan datos|prefiero no|imposible para m[ií]|me resulta imposible"
    r"|не мог|не смог|невозможно|не в состоянии|нельзя|отказ|не имею|не буду"
    r"|できません|できない|お答えでき|お手伝い|分かりかね|わかりかね|いたしかね|控え",
    re.I,
)

_BOX = re.compile(r"\\boxed\s*\{")
_THINK = re.compile(r"</?think>", re.I)
_MARKS = re.compile(r"\\boxed\s*\{|</?think>|```\w*|\$|[{}*`\"“”‘«»]")
_INVISIBLE = re.compile(r"[\s\u200b-\u200f\u2060\ufeff\u00ad]+")
_ARROWS = (" -> ", " becomes ", "distance = ", " => ", " → ")
_BITS, _ROMAN = frozenset("01"), frozenset("MDCLXVI")
_VALUE = re.compile(r"“[^”]*”|\"[^\"]*\"|`[^`]*`|\\boxed\s*\{[^{}]*\}")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[぀-ヿ一-鿿]|\d[\d.,]*|[^\w\s]")
_LABEL = re.compile(r"^\s*(?:question|frage|pregunta|вопрос|質問|問題|prompt|task|q)\s*[:：]\s*", re.I)
_QUOTE = re.compile(r"^\s*(?:>+|#+|[-*])\s*", re.M)
_TRACE = re.compile(r"\s*fam(?:ily)?=[^|;\s]*(?:\s*[|;]\s*(?:(?:answer=)?\\boxed.*|(?:sub|subtype|sig|signature|answer)=[^|;\s]*|\w*))*\s*\Z", re.S)
_CHAT = re.compile(r"<\|[^|>]*\|>(?:user|assistant|system)?|</?think>")


def boxes(text: str) -> tuple[list[str], bool]:
    """Contents of the closed boxes of ``text``, and whether one is left open."""
    found, at = [], 0
    while m := _BOX.search(text, at):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += (text[i] == "{") - (text[i] == "}")
            i += 1
        if depth:
            return found, True
        found.append(text[m.end() : i - 1])
        at = i
    return found, False


def _flat(text: str) -> str:
    """Words of ``text`` on one line, without case, quoting marks and chat markers."""
    return " ".join(_CHAT.sub(" ", _QUOTE.sub("", text)).lower().split())


class Prompt:
    """What the checks ask of a prompt; built once for each distinct prompt of a batch."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        outputs, prose = [], []
        for line in self.text.split("\n"):
            for mark in _ARROWS:
                at = line.rfind(mark)
                if at > 0:
                    outputs.append(line[at + len(mark) :].strip())
                    break
            else:
                prose.append(line)
        # Support pairs are no sentences: only the other lines tell the language.
        self.language = dominant(word_votes(_CHAT.sub("", "\n".join(prose))))
        compact = [_INVISIBLE.sub("", o) for o in outputs if o]
        self.least = min(map(len, compact), default=0)
        self.bits = bool(compact) and all(set(c) <= _BITS for c in compact)
        self.wordy = bool(compact) and sum(c.isalpha() and len(c) > 2 and not set(c) <= _ROMAN for c in compact) * 2 > len(compact)
        self.blank = not compact
        self.coded = bool(compact) and not self.wordy and all(c.isalnum() and c == c.lower() for c in compact)

    @cached_property
    def flat(self) -> str:
        """The whole prompt on one line."""
        return _flat(self.text)

    @cached_property
    def trigrams(self) -> frozenset[tuple[str, ...]]:
        """Runs of three tokens."""
        split = _TOKEN.findall(self.flat)
        return frozenset(zip(split, split[1:], split[2:]))

    def is_value(self, text: str) -> bool:
        """Whether ``text`` can be an answer by itself: no sentence, no trace, no cut-off bit string."""
        text = text.strip().strip("`$*.。\"“” \n")
        bare = _INVISIBLE.sub("", text)
        parts = text.split()
        if not bare or bare.lower() in PLACEHOLDERS and bare != "?" or len(parts) > 8 and not len(bare) < 2 * len(parts):
            return False
        if "\\boxed" in text or "->" in text or "<|" in text or re.match(r"\w{3,}\s*=", text):
            return False
        if self.wordy:
            letters = re.findall(r"[^\W\d_]+", text)
            return (all(p[0].islower() for p in letters) or text.isupper()) and sum(p in FUNCTION for p in letters) * 2 < max(1, len(letters))
        if self.bits and (len(bare) < self.least or re.search(r"[^\W\d_]{2,}", text)):
            return False
        if self.coded and bare.isalnum() and bare == bare.lower() and len(parts) == 1 and len(bare) < 8:
            return True
        if self.blank and len(parts) <= 6 and text.islower() and not any(p in FUNCTION for p in parts):
            return True
        for p in re.findall(r"[^\W\d_]+", text):
            roman = sum(c in "MDCLXVI" for c in p)
            if roman * 10 < len(p) * 6 and (len(p) > 3 or len(p) > 1 and p.lower() in FUNCTION):
                return False
        return True


class Pair:
    """A prompt with its response, and the features of the pair."""

    __slots__ = (
        "nothing", "answered", "open_box", "open_think", "copied", "copy_share", "refusing", "other_share", "own_share", "votes", "ended", "flat",
    )

    def __init__(self, p: Prompt, response: str | None) -> None:
        text = response or ""
        closed, self.open_box = boxes(text) if "\\boxed" in text else ([], False)
        given = [b for b in closed if (c := _INVISIBLE.sub("", b).lower()) and c not in PLACEHOLDERS]
        thinks = "think>" in text
        self.open_think = thinks and "<think>" in text and "</think>" not in text
        self.nothing = self.copied = self.refusing = bare = False
        self.copy_share = 0.0
        self.flat = _flat(_VALUE.sub(" ", text))
        plain = bool(given) and "boxed{...}" not in text and not (p.text and p.text[:24].lower() in text.lower())
        self.answered = plain
        if not plain:
            core = _INVISIBLE.sub(" ", _MARKS.sub(" ", text)).strip()
            low = core.lower()
            self.nothing = not core.strip(".…-_?:} ") and not (core and p.is_value(core) and not closed) or low in PLACEHOLDERS or low.strip(" .") in PLACEHOLDERS
            outside = (text.rsplit("</think>", 1)[-1] if thinks else text).strip().strip("`").strip()
            bare = not self.nothing and not self.open_think and not self.open_box and p.is_value(outside)
            quoted = _flat(_LABEL.sub("", _QUOTE.sub("", text).strip().strip("\"“”'`"))).strip("\"“”'` ")
            if not bare and len(quoted) >= 10:
                if quoted in p.flat:
                    self.copy_share = 1.0
                else:
                    spoken = _TOKEN.findall(quoted)
                    runs = list(zip(spoken, spoken[1:], spoken[2:]))
                    self.copy_share = sum(t in p.trigrams for t in runs) / len(runs) if runs else 0.0
                self.copied = self.copy_share >= 0.9
            stated = False
            if not (self.nothing or self.copied or self.open_think or self.open_box or bare):
                last = None
                for last in _LEAD.finditer(outside):
                    pass
                stated = last is not None and p.is_value(_CLOSING.sub("", outside[last.end() :]))
            self.answered = not (self.nothing or self.copied) and (bool(given) or bare or stated)
            self.refusing = not self.answered and bool(REFUSING.search(text))
        # A value by itself and a trace are no sentences; all other responses vote.
        voting = not self.copied and not bare and not _TRACE.match(text)
        votes = word_votes(_VALUE.sub(" ", text)) if voting else {}
        total = self.votes = sum(votes.values())
        own = votes.get(p.language, 0.0) if p.language else 0.0
        self.own_share = own / total if total else 0.0
        self.other_share = (max(votes.values()) - own) / total if total and p.language else 0.0
        tail = text.rstrip().rstrip("`$*\"”")
        self.ended = tail[-1:] in ".!?。}！？" or not tail

    def confirmed(self, declines: bool = False) -> str | None:
        """The exact check of a pair that the classifier flagged: its defect, or None.

        ``declines`` is the classifier's choice between refusal and truncation, for wordings
        that the fixed phrases lack.
        """
        if self.nothing:
            return "empty"
        if self.copied:
            return "copy"
        if not self.answered:
            whole = self.ended or self.refusing
            return "refusal" if (self.refusing or declines) and whole and not self.open_box else "truncated"
        if self.votes >= 2 and self.other_share > 0 and self.own_share < 0.5:
            return "wrong_language"
        return None
