"""English stems by the published Snowball rules, as SQL that Spark and other engines read alike.

A step is one expression over ``t``, the word so far, and ``r1`` and ``r2``, how many letters
stand before its regions. The longest ending of a step decides, whether its condition holds or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The algorithm's endings, what takes their place, and its irregular words.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
SETTLED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
REGION = f"{OTHER}*{VOWEL}+{OTHER}"
#: A short syllable at the end of a word.
SHORT = f"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def _cut(n: int, put: str = "") -> str:
    return f"concat(substr(t, 1, length(t) - {n}), '{put}')"


def _endings(rules: list[tuple[str, str, str]]) -> str:
    """Of (ending, condition, result) the one of the longest ending: its result if the condition holds."""
    cases = [f"WHEN substr(t, greatest(1, length(t) - {len(e) - 1})) = '{e}' THEN CASE WHEN {c} THEN {r} ELSE t END" for e, c, r in sorted(rules, key=lambda x: -len(x[0]))]
    return f"CASE {' '.join(cases)} ELSE t END"


def _in(region: str, n: int) -> str:
    return f"length(t) - {n} >= {region}"


def steps(matches: str = "regexp_like", group: str = "$1") -> list[tuple[str, str]]:
    """(column, expression) in order, from ``t``, a lower-case word, to ``t``, its stem; ``word`` keeps the word itself.

    ``matches`` is the engine's name for a search by a pattern, ``group`` how it writes a group.
    """
    has = lambda pattern, x="t": f"{matches}({x}, '{pattern}')"
    doubled = has("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
    step_1b = f"CASE WHEN cut AND {has('(at|bl|iz)$')} THEN concat(t, 'e') WHEN cut AND {doubled} THEN {_cut(1)} WHEN cut AND r1 >= length(t) AND {has(SHORT)} THEN concat(t, 'e') ELSE t END"
    without = "regexp_replace(t, '(ingly|edly|ing|ed)$', '')"
    of = lambda rules, region: [(e, _in(region, len(e)), _cut(len(e), r)) for e, r in rules.items()]
    last_e = f"{_in('r2', 1)} OR {_in('r1', 1)} AND NOT {has(SHORT, _cut(1))}"
    return [
        ("word", "t"),
        ("t", f"regexp_replace(regexp_replace(t, '^y', 'Y'), '({VOWEL})y', '{group}Y')"),
        ("r1", f"coalesce(nullif(length(regexp_extract(t, '^(gener|commun|arsen|{REGION})', 0)), 0), length(t))"),
        ("r2", f"coalesce(nullif(length(regexp_extract(substr(t, r1 + 1), '^{REGION}', 0)), 0) + r1, length(t))"),
        ("t", f"CASE WHEN {has('sses$')} THEN {_cut(2)} WHEN {has('ie[ds]$')} THEN CASE WHEN length(t) > 4 THEN {_cut(3, 'i')} ELSE {_cut(1)} END WHEN {has('[us]s$')} THEN t WHEN {has(f'{VOWEL}.+s$')} THEN {_cut(1)} ELSE t END"),
        ("done", "t IN (" + ", ".join(f"'{w}'" for w in SETTLED) + ")"),
        ("cut", f"NOT {has('eed(ly)?$')} AND {has(f'{VOWEL}.*(ingly|edly|ing|ed)$')} AND {has(VOWEL, without)} AND NOT done"),
        ("t", f"CASE WHEN done THEN t WHEN {has('eedly$')} THEN CASE WHEN {_in('r1', 5)} THEN {_cut(3)} ELSE t END WHEN {has('eed$')} THEN CASE WHEN {_in('r1', 3)} THEN {_cut(1)} ELSE t END WHEN cut THEN {without} ELSE t END"),
        ("t", step_1b),
        ("t", f"CASE WHEN NOT done AND {has(f'.{OTHER}[yY]$')} THEN {_cut(1, 'i')} ELSE t END"),
        ("t", "CASE WHEN done THEN t ELSE " + _endings(of(STEP_2, "r1") + [("ogi", f"{_in('r1', 3)} AND {has('logi$')}", _cut(1)), ("li", f"{_in('r1', 2)} AND {has('[cdeghkmnrt]li$')}", _cut(2))]) + " END"),
        ("t", "CASE WHEN done THEN t ELSE " + _endings(of(STEP_3, "r1") + [("ative", f"{_in('r1', 5)} AND {_in('r2', 5)}", _cut(5))]) + " END"),
        ("t", "CASE WHEN done THEN t ELSE " + _endings(of(dict.fromkeys(STEP_4, ""), "r2") + [("ion", f"{_in('r2', 3)} AND {has('[st]ion$')}", _cut(3))]) + " END"),
        ("t", "CASE WHEN done THEN t ELSE " + _endings([("e", last_e, _cut(1)), ("l", f"{_in('r2', 1)} AND {has('ll$')}", _cut(1))]) + " END"),
        ("t", "CASE " + " ".join(f"WHEN word = '{w}' THEN '{s}'" for w, s in IRREGULAR.items()) + " WHEN length(word) <= 2 THEN word ELSE lower(t) END"),
    ]


def with_stems(words: DataFrame, column: str, stem: str = "stem") -> DataFrame:
    """``words`` with the stem of a column of lower-case words; meant for different words, once each."""
    out = words.withColumn("t", F.col(column))
    for name, expression in steps():
        out = out.withColumn(name, F.expr(expression))
    return out.withColumnRenamed("t", stem).drop("word", "r1", "r2", "done", "cut")


def stems_sql(source: str, matches: str = "regexp_matches", group: str = "\\1") -> str:
    """SELECT of word and stem over ``source``, a table with a column t of lower-case words, in other engines' SQL."""
    query = f"SELECT t FROM {source}"
    for name, expression in steps(matches, group):
        rest = "* EXCLUDE (t)" if name == "t" else "*"
        query = f"SELECT {rest}, {expression} AS {name} FROM ({query})"
    return f"SELECT word, t AS stem FROM ({query})"
