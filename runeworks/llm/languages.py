"""Which language the words of a text are in, by function words and script."""

from __future__ import annotations

import re

# Frequent function words of each language with letters of its own.
FUNCTION_WORDS = {
    "en": "the a an and or of to in on for is are was were be been it its this that these those there with as by from at which what "
    "when where who how not no so if then than but because i you we they he she my your our me us can can't cannot could will won't would "
    "should have has had do does did don't only one all any every each same other another more most must may might now after before "
    "into under over line up makes give gives given write determine convert decrypt following answer inside final sorry wrong guess let "
    "nothing first second third again start tried trying seen found said known some here leaves need makes out about",
    "de": "der die das den dem des ein eine einer einem einen eines und oder von zu zum zur im in am an auf für ist sind war waren wird werden "
    "wurde es er sie wir ich du man mit als bei aus nach nicht kein keine keinen so wenn dann aber weil dass daß auch noch nur schon "
    "sich sein seine ihr ihre diese dieser dieses mehr alle jede jeder wie was wer wo kann muss also nun genau gib antwort unter über ohne "
    "hat haben hatte dabei daher leider gilt bitte jemand anderen gern mir hier erste ersten zweite dritte schreibt bestimme etwas kaum daß am ob weiß blieb war lag sehr sicher wir hätte fast einmal noch immer zwei neu",
    "fr": "le la les un une des du de d l et ou à au aux en dans sur pour est sont était sera il elle on nous vous je tu avec comme par ce cet "
    "cette ces qui que quoi dont où ne pas plus aucun aucune si mais car donc aussi sans sous même autre autres tout toute tous toutes son "
    "sa ses leur leurs se sont été être avoir ont faut peux peut ici merci voici cas réponse seule première deuxième maintenant donne écris "
    "détermine convertis déchiffre suivant suivante avait presque rien encore cela aussi était fois depuis personne jamais toujours très trop",
    "es": "el la los las un una unos unas de del y o u a al en con por para es son era fue está están ser se lo le les su sus que qué como "
    "cuando donde quien no ni sí si más pero porque pues también solo sólo sin sobre entre este esta estos estas ese esa otro otra otros "
    "otras todo toda todos todas muy ya hay ha han así yo tú usted me te nos puedo puede ahora da una respuesta dentro siguiente primer "
    "segundo tercera aquí lo tanto vez debe valer determina nada nadie final antes después casi nunca siempre había pero hasta",
    "ru": "и в во не на что по это как из за то же для но с со у к от до бы так его её их если только ещё раз уже был была было были ли "
    "он она оно они мы вы я все всё тот эта этот при или нет да чтобы потому почти ничего никто пока там где когда сразу хотя более",
}

_HOME: dict[str, tuple[str, ...]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in set(_list.split()):
        _HOME[_w] = (*_HOME.get(_w, ()), _lang)

FUNCTION = frozenset(_HOME)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]+")
_KANA = re.compile(r"[぀-ヿ]")


def word_votes(text: str) -> dict[str, float]:
    """Votes for each language from the words of ``text``; a word of several languages votes for each in part."""
    votes: dict[str, float] = {}
    for w in _WORD.findall(text.lower().replace("’", "'")):
        homes = _HOME.get(w)
        if homes is None and "'" in w:
            homes = _HOME.get(w.split("'")[0])
        if homes:
            for h in homes:
                votes[h] = votes.get(h, 0.0) + 1.0 / len(homes)
    if not text.isascii():
        found = len(_CYRILLIC.findall(text))
        if found:
            votes["ru"] = float(found)
        kana = len(_KANA.findall(text))
        if kana:
            votes["ja"] = votes.get("ja", 0.0) + kana / 3.0
    return votes


def dominant(votes: dict[str, float]) -> str | None:
    """The language with most votes; None without votes."""
    return max(sorted(votes), key=votes.__getitem__) if votes else None
