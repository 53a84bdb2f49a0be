"""Inspected examples: texts of known kind that the mixture starts from and is read by.

Each group starts one component of the mixture. Writing a group down means that its texts were looked at
and belong together; the kind is what the component is read as.
"""

from __future__ import annotations

import base64
import hashlib

_EN = (
    "The committee met twice during the winter and could not agree on a date for the next session. Nobody minded very much.",
    "When we opened the old cabinet, we found a stack of letters that had been tied together with string. Most of them were about the weather, but a few told a longer story about the family who had lived here before.",
    "I tried the second recipe yesterday evening. It took longer than expected, and the result was rather dry.",
    "There is no reason to believe that the numbers were changed after the report was written.",
)
_DE = (
    "Am Abend gingen wir noch einmal zum Fluss hinunter, weil das Licht dort so schön war. Keiner sprach ein Wort.",
    "Die zweite Messung hat wenig gebracht, denn die Geräte waren nicht richtig eingestellt. Man hätte vorher fragen müssen.",
)
_FR = (
    "Nous avons attendu le train pendant une heure, puis nous sommes rentrés à pied. Il faisait encore assez doux pour la saison.",
    "La première version était trop longue et personne ne l'a lue jusqu'au bout. Il vaut mieux couper la fin.",
)
_ES = (
    "El camino hasta el pueblo era más largo de lo que pensábamos, pero al final llegamos antes de la noche.",
    "Nadie recuerda quién escribió la primera nota, aunque todos están de acuerdo en que era muy breve.",
)
_RU = (
    "Вечером мы снова пошли к реке, потому что там было тихо. Никто не хотел говорить о работе.",
    "Вторая глава оказалась слишком длинной, и её пришлось сократить. После этого книга стала лучше.",
)
_JA = (
    "昨日の夕方、川のそばを長い間歩きました。風は冷たかったですが、空はとてもきれいでした。",
    "二つ目の章は長すぎたので、少し短くしました。それで読みやすくなったと思います。",
)


def _wrap(text: str, width: int) -> str:
    lines, line = [], ""
    for word in text.split():
        if line and len(line) + len(word) + 1 > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return "\n".join([*lines, line])


def _noise(size: int, alphabet: str) -> str:
    """Meaningless characters, the same on every run."""
    out, block = [], b"seed"
    while len(out) < size:
        block = hashlib.sha256(block).digest()
        out += [alphabet[b % len(alphabet)] for b in block]
    return "".join(out[:size])


_ROWS = [(f"item-{i}", f"0.{i * 37 % 900 + 100}", str(i * 431 % 4000), ("fine", "late", "")[i % 3]) for i in range(1, 13)]
_PAIRS = [(f"{i * 53 % 256:08b}", f"{i * 91 % 256:08b}") for i in range(1, 9)]
_PLAIN = ("lamp stone river", "road willow", "boat lantern barn", "river road stone", "willow lamp", "barn boat")
_CODED = tuple(w.translate(str.maketrans("abdeilmnoprstvw", "qxzkjvwyhgcfpbd")) for w in _PLAIN)
_ASKED = (
    ("In the old tower, every word is written in a secret way.\nSome cases:", "Now, read the following text: gjhc qxw"),
    ("Im alten Turm schreibt man alle Wörter auf geheime Weise.\nEinige Beispiele:", "Lies nun den folgenden Text: gjhc qxw\nGib nur eine Antwort."),
    ("Dans la vieille tour, on écrit tous les mots en secret.\nQuelques cas :", "Lis maintenant le texte suivant : gjhc qxw"),
    ("En la vieja torre se escriben todas las palabras en secreto.\nAlgunos casos:", "Lee ahora el siguiente texto: gjhc qxw"),
)
_SYMBOLS = "<>[]{}()*/+-&%#@!?=~^|;:$_\\"

#: (kind, texts) of each group.
INSPECTED: list[tuple[str, list[str]]] = [
    ("prose", [*_EN, " ".join(_EN), "\n\n".join(_EN)]),
    ("prose", [_wrap(" ".join(_EN), 48), _wrap(" ".join(_DE), 60), _wrap(" ".join(_FR), 40), _wrap(" ".join(_ES), 50)]),
    ("prose", [*_DE, *_FR, *_ES, "\n".join(_DE), "\n\n".join(_FR)]),
    ("prose", [*_RU, "\n".join(_RU)]),
    ("prose", [*_JA, "\n".join(_JA)]),
    ("prose", ["ok", "Yes.", "fine with me", "Thanks!", "Not yet, sorry", "na gut", "pas encore", "Bis morgen"]),
    ("prose", ["It was late.", "Nobody came to the meeting after all.", "that is all there is to say about it", "Man weiß es nicht.", "C'est fini pour aujourd'hui."]),
    ("prose", [" ".join(_EN).upper(), " ".join(_DE).upper(), " ".join(_EN[:2]).upper()]),
    ("prose", [" ".join(_EN).lower().replace(".", ""), " ".join(_FR).lower().replace(".", ""), _EN[1].lower().replace(",", "")]),
    ("prose", ["# A Title\n\n" + _EN[0] + "\n\n" + _EN[1], "Notes of Monday\n" + _EN[2] + "\n" + _EN[3], "## Zweiter Teil\n\n" + " ".join(_DE), _ES[0] + "\n" + _ES[1] + "\nFin"]),
    ("prose", [_EN[0] + " The value 12.5 became “otter” at step 7, and 00110101 stayed.", "With 14 pairs, 3 of 250 runs gave 0.31; that was all.", _DE[1] + " Nur 0.25 blieb übrig, und 17 Fälle fehlten."]),
    ("list", ["\n".join(f"{a} -> {b}" for a, b in _PAIRS), "\n".join(f"{i * 7}.20 m becomes {i * 9}.41" for i in range(1, 8))]),
    ("list", ["In the old tower, a rule changes every word.\nSome cases:\n" + "\n".join(f"{a} -> {b}" for a, b in _PAIRS) + "\nNow find the output for: 00110011"]),
    ("list", [f"{head}\n" + "\n".join(f"{a} -> {b}" for a, b in zip(_CODED, _PLAIN)) + f"\n{tail}" for head, tail in _ASKED]),
    ("list", ["\n".join(f"For t = {i}.5s, distance = {i * 21}.40 m" for i in range(1, 8))]),
    ("list", ["- bread\n- milk 2\n- apples\n- soap", "1. open the box\n2. count the pairs\n3. close it\n4. write a note", "a) first\nb) second\nc) third"]),
    ("list", ["\n".join(f"* {s}" for s in _EN), "\n\n".join(f"{i}. {s}" for i, s in enumerate((*_EN, *_DE), 1))]),
    ("list", ["apple\nwindow\nriver\nstone\nlantern\nboat", "barn\n\nwillow\n\n3f9a01bc77\n\nlamp\n\nroad"]),
    ("list", ["name: Oslo\nsize: 14\ncolour: green\nowner: none", "alpha = 1\nbeta = 2.5\ngamma = 0.4", "river: “blue”\nstone: 88.1\nlamp: `pmal`"]),
    ("table", ["\n".join(",".join(r) for r in _ROWS), "name,score,count,note\n" + "\n".join(",".join(r) for r in _ROWS)]),
    ("table", ["\n".join("\t".join(r) for r in _ROWS), "name\tscore\tcount\n" + "\n".join("\t".join(r[:3]) for r in _ROWS)]),
    ("table", ["\n".join(" ; ".join(r) for r in _ROWS), "\n".join(";".join(r[:3]) for r in _ROWS)]),
    ("table", ["| name | score | count |\n|---|---|---|\n" + "\n".join("| " + " | ".join(r[:3]) + " |" for r in _ROWS)]),
    ("table", ["\n".join(f"{r[0]:<10}  {r[1]:>6}  {r[2]:>6}" for r in _ROWS), "\n".join(f"{r[1]:>8}   {r[0]:<12}   {r[2]}" for r in _ROWS)]),
    ("table", ["<table>\n" + "\n".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in _ROWS) + "\n</table>"]),
    ("junk", ["x" * 120, "?" * 300, "=-" * 60, "あ" * 80, "ha " * 70, "row done " * 40]),
    ("junk", ["\n".join(["same line again"] * 30), " ".join([_EN[2]] * 5), "\n".join([_EN[3]] * 4), " ".join([_DE[0]] * 6), "\n\n".join([_EN[1]] * 4), " ".join([_FR[0]] * 3)]),
    ("junk", [_noise(220, _SYMBOLS), _noise(400, _SYMBOLS + " "), "\n".join(_noise(30, _SYMBOLS) for _ in range(8))]),
    ("junk", [base64.b64encode(_noise(400, "abcdefghij").encode()).decode(), "\n".join(_noise(76, "ABCDEFabcdefghiklmnopqrstuv0123456789+/") for _ in range(6))]),
    ("junk", ['<div class="a1"><p></p></div><br/>&nbsp;<span id=x2></span><!-- --><p></p>' * 4, "<p></p>\n<br/>\n<div></div>\n&nbsp;" * 5]),
    ("junk", ["\\u004b\\x4f\\n\\t%2F\\u0061%7E\\n\\xc3\\t" * 8, "��� ���t s���� ��rr��� ���� mos� �� ��� n��er��" * 3]),
    ("junk", [" ".join(w[::-1] + w[:1] for w in " ".join(_EN).split()), " ".join(_noise(200, "bcdfghjklmnpqrstvwxzae   ").split())]),
    ("junk", [_RU[0].encode().decode("latin-1"), _JA[0].encode().decode("latin-1")]),
]

#: Sentences that letter pairs are learned from.
PROSE = [
    *_EN, *_DE, *_FR, *_ES,
    "A puzzle with a hidden rule takes more time than one would like, and a second look at the examples usually helps.",
    "The teacher was quite sure about every answer, although the margin between the best two programs stayed low.",
    "Which family of symbols does this solver handle well, and what happens beyond the length of five letters?",
    "She could hardly believe how quickly the numbers had been copied, checked and moved to another folder.",
    "Our neighbours always leave their bicycles in front of the garage, even when we ask them politely not to.",
    "Most people agree that the budget was too tight, which explains why the project stopped after three months.",
    "Die Schüler haben gestern lange über das Rätsel gesprochen, aber am Ende blieb die Antwort unklar und niemand war zufrieden.",
    "Zwischen den beiden Häusern steht ein alter Baum, unter dem im Sommer oft Kinder spielen und Geschichten erzählen.",
    "Wer die Regel kennt, findet schnell heraus, welche Stelle vertauscht wurde; alle anderen müssen weiter suchen.",
    "Les élèves cherchaient une explication simple, mais chaque exemple semblait contredire celui qui le précédait.",
    "On ne comprend pas toujours pourquoi une machine choisit telle réponse plutôt que telle autre, même avec beaucoup de données.",
    "Le jardin derrière la maison était couvert de feuilles mortes que personne n'avait ramassées depuis l'automne.",
    "Los alumnos buscaban una explicación sencilla, aunque cada ejemplo parecía contradecir al anterior y nadie estaba seguro.",
    "La casa de la esquina tenía las ventanas abiertas y desde la calle se escuchaba una canción muy antigua.",
    "Quien conoce la regla descubre pronto qué letra cambió de lugar; los demás tienen que seguir probando.",
]
