"""Prompts to pairs and query, and back. Prompts are taken in their canonical form (:func:`canonical_text`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runeworks.functions.text import FAMILY_INSTRUCTIONS, strip, with_contract

# Forms of support pairs and of the closing question. Beside the two groups of each, only the flags
# are the JVM's: (?d) makes a line end a line feed alone, as ``$`` has it, and (?U) lets blanks be those of Unicode.
LABELLED = r"(?isdU)Input(?:\s*\d+)?\s*:\s*(.*?)\s*Output(?:\s*\d+)?\s*:\s*(.*?)(?=(?:Input(?:\s*\d+)?\s*:|Query(?:\s*input)?\s*:|Test(?:\s*input)?\s*:|$))"
PAIR_FORMS = {
    "arrow": r"(?mdU)^([^\n\r]+?)\s*->\s*([^\n\r]+?)$",
    "becomes": r"(?midU)^([^\n\r]+?)\s+becomes\s+([^\n\r]+?)$",
    "gravity": r"(?midU)^For\s+t\s*=\s*([+-]?\d+(?:\.\d+)?)s,\s+distance\s*=\s*([+-]?\d+(?:\.\d+)?)\s*m$",
}
EQUATION = r"(?mdU)^([^=\n\r]{1,64}?)\s*=\s*([^=\n\r]{1,64}?)$"
QUERY_FORMS = [
    r"(?isdU)(?:Query(?:\s*input)?|Test(?:\s*input)?|Apply to|Now transform)\s*:\s*(.*?)(?=(?:Answer|Target|$))",
    r"(?idU)(?:Now,\s*)?(?:determine|find|compute|predict|infer)\s+the\s+(?:output|result)\s+for\s*:\s*([^\n\r]+)",
    r"(?idU)Now,\s*determine\s+the\s+falling\s+distance\s+for\s+t\s*=\s*([+-]?\d+(?:\.\d+)?)s",
    r"(?idU)Now,\s*convert\s+the\s+following\s+measurement\s*:\s*([^\n\r]+)",
    r"(?idU)Now,\s*decrypt\s+the\s+following\s+text\s*:\s*([^\n\r]+)",
    r"(?idU)Now,\s*write\s+the\s+number\s+([^\s\n\r]+)\s+in\s+the\s+Wonderland\s+numeral\s+system",
]

# How lines start that are no equations.
STARTS = ("in alice", "for t", "now,", "here are")


def _found(prompt: Column, pattern: str) -> Column:
    left = F.regexp_extract_all(prompt, F.lit(pattern), F.lit(1))
    right = F.regexp_extract_all(prompt, F.lit(pattern), F.lit(2))
    zipped = F.arrays_zip(left.alias("input"), right.alias("output"))
    stripped = F.transform(zipped, lambda p: F.struct(strip(p["input"]).alias("input"), strip(p["output"]).alias("output")))
    return F.filter(stripped, lambda p: (p["input"] != "") & (p["output"] != ""))


def extract_pairs(prompt: Column) -> Column:
    """Support pairs of a prompt: labelled ones alone where there are any, else those of all line forms.

    An arrow line that speaks of both input and output is a heading. Equation lines that
    repeat a pair, start like a sentence or name the law of falling are none.
    """
    labelled = _found(prompt, LABELLED)
    arrows = F.filter(
        _found(prompt, PAIR_FORMS["arrow"]),
        lambda p: ~(F.lower(F.concat_ws(" ", p["input"], p["output"])).contains("input") & F.lower(F.concat_ws(" ", p["input"], p["output"])).contains("output")),
    )
    lines = F.concat(arrows, _found(prompt, PAIR_FORMS["becomes"]), _found(prompt, PAIR_FORMS["gravity"]))

    def counts(p: Column) -> Column:
        bad = F.lower(p["output"]).contains("given d")
        for start in STARTS:
            bad = bad | F.lower(p["input"]).startswith(start)
        return ~bad & ~F.array_contains(lines, p)

    equations = F.array_distinct(F.filter(_found(prompt, EQUATION), counts))
    return F.when(F.size(labelled) > 0, labelled).otherwise(F.concat(lines, equations))


def extract_query(prompt: Column) -> Column:
    """What a prompt asks for, by the first form that occurs in it; empty without any."""
    found = F.when(F.lit(False), F.lit(""))
    for form in QUERY_FORMS:
        found = found.when(F.regexp_like(prompt, F.lit(form)), strip(F.regexp_extract(prompt, form, 1)))
    return found.otherwise(F.lit(""))


def render_prompt(family: Column, pairs: Column, query: Column, head: Column | None = None) -> Column:
    """A prompt in the family's own style: instruction, pairs, question and answer contract."""
    family = F.coalesce(family, F.lit("equation"))
    own = F.lit("")
    for name, text in FAMILY_INSTRUCTIONS.items():
        own = F.when(family == name, text).otherwise(own)
    head = own if head is None else F.coalesce(F.nullif(head, F.lit("")), own)

    def lines(show) -> Column:
        return F.transform(pairs, lambda p: show(F.coalesce(p["input"], F.lit("")), F.coalesce(p["output"], F.lit(""))))

    arrow = lines(lambda a, b: F.concat(a, F.lit(" -> "), b))
    # Introduction and closing question of each family's prompts.
    styles = {
        "gravity": ("Here are some example observations:", lines(lambda a, b: F.concat(F.lit("For t = "), a, F.lit("s, distance = "), b, F.lit(" m"))), "Now, determine the falling distance for t = ", "s given d = 0.5*g*t^2."),
        "unit": ("For example:", lines(lambda a, b: F.concat(a, F.lit(" becomes "), b)), "Now, convert the following measurement: ", ""),
        "cipher": ("Here are some examples:", arrow, "Now, decrypt the following text: ", ""),
        "numeral": ("Here are some examples:", arrow, "Now, write the number ", " in the Wonderland numeral system."),
    }
    body = F.concat(F.array(head, F.lit("Here are some examples of input -> output:")), arrow, F.array(F.concat(F.lit("Now, determine the output for: "), query)))
    for name, (intro, shown, before, after) in styles.items():
        asked = F.array(F.concat(F.lit(before), query, F.lit(after)))
        body = F.when(family == name, F.concat(F.array(head, F.lit(intro)), shown, asked)).otherwise(body)
    return with_contract(F.array_join(body, "\n"))
