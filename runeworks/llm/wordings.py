"""Fixed wordings that the training set of broken responses is made with."""

# Texts that stand in the place of an answer.
PLACEHOLDERS = (
    "", " ", "\n\n", "\t", "​", " ", "n/a", "na", "null", "none", "nan", "nil", "tbd", "todo", "-", "--", "---", "_", "__", ".", "..", "...",
    "…", "?", "??", "???", "unknown", "undefined", "empty", "blank", "answer", "your answer", "[answer]", "<answer>", "(answer)", "(none)", "(empty)",
    "[none]", "no answer", "pending", "placeholder", "your answer here", "answer here", "n.a.", "keine", "k.a.", "s/o", "нет", "なし",
)

# How a refusal may begin, what it says and how it may go on, by language.
REFUSALS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "en": (
        ("", "", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "I apologise, but ", "Regrettably, ", "As a language model, ", "As an AI assistant, ", "To be honest, ", "After some thought, ", "I am afraid ", "Thanks for the question, but ", "Hmm, "),
        ("I can't help with that", "I cannot answer this question", "I am unable to solve this", "I'm not able to give you an answer", "I won't be answering this one", "it is not possible for me to go on",
         "I do not have enough information to answer", "no answer can be given here", "I would rather not guess", "I must decline this request", "there is nothing I can say about this", "I am not allowed to do that",
         "this is outside of what I can do", "I will not give a result", "I refuse to answer", "this isn't something I can do", "I cannot determine the rule, so I give no answer", "that is beyond my abilities", "I could not find out what is asked, so I stop here",
         "puzzles of this kind are not something I solve", "I'm not in a position to answer", "it would be against my guidelines to respond"),
        ("Please ask someone else.", "If you have another question, I am happy to help.", "Could you send more examples?", "Is there anything else?", "I hope you understand.", "Please consult an expert."),
    ),
    "de": (
        ("", "", "Es tut mir leid, aber ", "Leider ", "Entschuldigung, ", "Bedaure, ", "Als Sprachmodell ", "Ehrlich gesagt, ", "Nach einigem Überlegen: "),
        ("ich kann dabei nicht helfen", "dabei kann ich nicht helfen", "kann ich diese Frage nicht beantworten", "eine Antwort ist mir nicht möglich", "mir fehlen die Angaben, um das zu beantworten", "ich bin nicht befugt, das zu lösen",
         "dazu darf ich keine Auskunft geben", "ich möchte hier lieber nicht raten", "ich muss diese Bitte ablehnen", "ich sehe mich außerstande, das zu lösen", "darauf gebe ich keine Antwort", "ein Ergebnis kann ich nicht nennen", "solche Rätsel löse ich nicht",
         "hier muss ich passen"),
        ("Bitte frag jemand anderen.", "Gern helfe ich bei einer anderen Frage.", "Kannst du mehr Beispiele schicken?", "Ich bitte um Verständnis."),
    ),
    "fr": (
        ("", "", "Désolé, ", "Je suis désolé, mais ", "Malheureusement, ", "Toutes mes excuses, ", "En tant que modèle de langue, ", "Après réflexion, ", "Pour être honnête, "),
        ("je ne peux pas vous aider", "je ne suis pas en mesure de répondre", "aucune réponse n'est possible ici", "il m'est impossible de résoudre cela", "je préfère ne pas répondre à cette question", "il me manque des éléments pour répondre",
         "je ne saurais donner de résultat", "je n'ai pas le droit de le faire", "je n'ai pas assez d'informations", "je refuse de répondre", "je ne traite pas ce genre de question", "je dois décliner cette demande", "cela dépasse mes capacités"),
        ("Merci de demander à quelqu'un d'autre.", "Une autre question sera la bienvenue.", "Pouvez-vous envoyer plus d'exemples ?", "Merci de votre compréhension."),
    ),
    "es": (
        ("", "", "Lo siento, ", "Lo siento, pero ", "Por desgracia, ", "Lamentablemente, ", "Como modelo de lenguaje, ", "Perdón, ", "Tras pensarlo, ", "Sinceramente, "),
        ("no puedo ayudar con eso", "no puedo responder a esta pregunta", "no estoy autorizado a responder", "no me es posible dar una respuesta", "prefiero no dar un resultado", "me faltan datos para contestar", "no soy capaz de resolverlo",
         "no daré ninguna respuesta", "debo rechazar esta petición", "me resulta imposible seguir", "no tengo información suficiente", "me niego a contestar", "este tipo de ejercicio no lo resuelvo", "eso queda fuera de mis posibilidades"),
        ("Pregunta a otra persona, por favor.", "Con gusto ayudo con otra pregunta.", "¿Puedes enviar más ejemplos?", "Gracias por la comprensión."),
    ),
    "ru": (
        ("", "К сожалению, ", "Извините, но ", "Простите, "),
        ("я не могу ответить на этот вопрос", "я не могу помочь с этим", "ответить здесь невозможно", "у меня недостаточно данных", "я вынужден отказаться"),
        ("Спросите кого-нибудь другого.", "Буду рад другому вопросу."),
    ),
    "ja": (
        ("", "申し訳ありませんが、", "すみませんが、", "残念ながら、"),
        ("お答えできません", "この質問にはお手伝いできません", "答えを出すことはできません", "情報が足りないため分かりかねます", "回答は控えます"),
        ("ほかの質問ならお手伝いします。", "ほかの人に聞いてください。"),
    ),
}

# General sentences of a worked answer and leads to its end, by language.
FOREIGN: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "en": (("I looked at all of the lines first.", "The rule is the same in every case.", "This is not what one would expect.", "It can be seen in the second line already.", "There are more signs of it than I need."), ("So the answer is", "Final answer:", "Therefore:")),
    "de": (("Zuerst habe ich mir alle Zeilen angesehen.", "Die Regel ist in jedem Fall dieselbe.", "Das ist nicht, was man erwartet.", "Man sieht es schon an der zweiten Zeile.", "Es gibt dafür mehr Zeichen als nötig."), ("Die Antwort ist also", "Ergebnis:", "Damit ergibt sich")),
    "fr": (("J'ai d'abord regardé toutes les lignes.", "La règle est la même dans tous les cas.", "Ce n'est pas ce que l'on attend.", "On le voit déjà dans la deuxième ligne.", "Il y a plus de signes qu'il n'en faut."), ("La réponse est donc", "Résultat :", "On obtient donc")),
    "es": (("Primero he mirado todas las líneas.", "La regla es la misma en todos los casos.", "Esto no es lo que uno espera.", "Ya se ve en la segunda línea.", "Hay más señales de las que necesito."), ("La respuesta es", "Resultado:", "Por lo tanto:")),
    "ru": (("Сначала я посмотрел на все строки.", "Правило одно и то же во всех случаях.", "Это не то, чего можно ожидать.", "Это видно уже по второй строке.", "Признаков больше, чем нужно."), ("Значит, ответ", "Ответ:", "Получаем")),
    "ja": (("まずすべての行を見ました。", "規則はどの場合も同じです。", "これは予想と違います。", "二行目を見ればもう分かります。", "必要以上に手がかりがあります。"), ("したがって答えは", "答え：", "結果は")),
}
