"""The Porter (1980) stemmer as SQL text, one step after another.

The text is written once for both dialects that need it: Spark SQL, and ANSI-like SQL for checks. Vowels are ``[aeiouy]`` and consonants the rest, after every consonant y has been
written ``Y``; a measure above 0 is then ``VC`` somewhere before the suffix, above 1 two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VC = "[aeiouy][^aeiouy]"
M1, M2 = VC, f"{VC}.*{VC}"
#: Ends in consonant, vowel, consonant other than w, x, y; only ASCII letters and digits count as the last one.
CVC = "[^aeiouy][aeiouy][b-df-hj-np-tvz0-9]"

# The suffix rules of the published algorithm, in its order; the first suffix that fits ends a step.
STEP_2 = """ational=ate tional=tion enci=ence anci=ance izer=ize abli=able alli=al entli=ent eli=e ousli=ous
ization=ize ation=ate ator=ate alism=al iveness=ive fulness=ful ousness=ous aliti=al iviti=ive biliti=ble"""
STEP_3 = "icate=ic ative= alize=al iciti=ic ical=ic ful= ness="
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


class Dialect:
    """How the two dialects spell what they share."""

    def __init__(self, like: str, group: str, flags: str, look_up: str):
        self.like, self.group, self.flags, self.look_up = like, group, flags, look_up

    def match(self, pattern: str) -> str:
        return f"{self.like}(w, '{pattern}')"

    def sub(self, value: str, pattern: str, to: str) -> str:
        return f"regexp_replace({value}, '{pattern}', '{to}'{self.flags})"


SPARK = Dialect("regexp_like", "$1", "", "element_at(map_from_arrays(array({0}), array({1})), {2})")
DUCK = Dialect("regexp_matches", "\\1", ", 'g'", "map([{0}], [{1}])[{2}]")


def _cut(n: int) -> str:
    return f"substr(w, 1, length(w) - {n})"


def _rules(d: Dialect, rules: str, measure: str) -> str:
    """The longest suffix that fits decides: where one of these suffixes ends another, the longer comes first in
    the published order as well. It goes, or changes, if the measure of what is before it is high enough."""
    pairs = [rule.partition("=")[::2] for rule in rules.split()]
    suffix = f"regexp_extract(w, '({'|'.join(s for s, _ in pairs)})$', 1)"
    before = f"substr(w, 1, length(w) - length({suffix}))"
    to = d.look_up.format(", ".join(f"'{s}'" for s, _ in pairs), ", ".join(f"'{t}'" for _, t in pairs), suffix) if any(t for _, t in pairs) else "''"
    fits = f"{d.like}({before}, '{measure}')"
    if any(s == "ion" for s, _ in pairs):
        fits += f" AND ({suffix} <> 'ion' OR {d.match('[st]ion$')})"
    return f"CASE WHEN {suffix} = '' THEN w WHEN {fits} THEN concat({before}, {to}) ELSE w END"


def steps(d: Dialect) -> list[str]:
    """Expressions over ``w``, to be applied one after another to words of more than two bytes."""
    mark = d.sub(d.sub(d.sub("w", "^y", "Y"), "([aeiou])y", d.group + "Y"), "yy", "yY")
    plural = f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_cut(2)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {_cut(1)} ELSE w END"
    past = (
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {d.match(M1 + '.*eed$')} THEN {_cut(1)} ELSE w END"
        f" WHEN w LIKE '%ed' THEN CASE WHEN {d.match('[aeiouy].*ed$')} THEN concat({_cut(2)}, '|') ELSE w END"
        f" WHEN w LIKE '%ing' THEN CASE WHEN {d.match('[aeiouy].*ing$')} THEN concat({_cut(3)}, '|') ELSE w END ELSE w END"
    )
    mend = (
        f"CASE WHEN w NOT LIKE '%|' THEN w WHEN {d.match('(at|bl|iz)[|]$')} THEN concat({_cut(1)}, 'e')"
        f" WHEN length(w) > 2 AND lower(substr(w, length(w) - 1, 1)) = lower(substr(w, length(w) - 2, 1)) AND {d.match('[b-df-hjkmnp-rtv-xY0-9][|]$')} THEN {_cut(2)}"
        f" WHEN {d.match(CVC + '[|]$')} AND {d.match(M1)} AND NOT {d.match(M2 + '.*[|]$')} THEN concat({_cut(1)}, 'e') ELSE {_cut(1)} END"
    )
    y = f"CASE WHEN {d.match('[aeiouy].*[yY]$')} THEN concat({_cut(1)}, 'i') ELSE w END"
    e = f"CASE WHEN w LIKE '%e' AND ({d.match(M2 + '.*e$')} OR ({d.match(M1 + '.*e$')} AND NOT {d.match(CVC + 'e$')})) THEN {_cut(1)} ELSE w END"
    ll = f"CASE WHEN w LIKE '%ll' AND {d.match(M2)} THEN {_cut(1)} ELSE w END"
    return [mark, plural, past, mend, y, _rules(d, STEP_2, M1), _rules(d, STEP_3, M1), _rules(d, STEP_4, M2), e, ll, d.sub("w", "Y", "y")]


def stem_column(word: str) -> Column:
    """The stem of a lowercase column. Each step binds the word before it as a lambda's variable: written as a
    chain of projections, a filter on the stem would be pushed down through it and multiply at every step."""
    made = f"`{word}`"
    for step in steps(SPARK):
        made = f"transform(array({made}), w -> {step})[0]"
    return F.when(F.octet_length(word) <= 2, F.col(word)).otherwise(F.expr(made))


def stem_each(words: Column) -> Column:
    """The stems of an array of lowercase words."""
    made = "t"
    for step in steps(SPARK):
        made = f"transform(array({made}), w -> {step})[0]"
    return F.call_function("transform", words, F.expr(f"t -> CASE WHEN octet_length(t) <= 2 THEN t ELSE {made} END"))


def stem_words(words: DataFrame, word: str, stem: str = "stem") -> DataFrame:
    """``words`` with the stem of the lowercase column ``word``; words of up to two bytes stay, null stays null."""
    return words.withColumn(stem, stem_column(word))


def stem_sql(source: str, word: str, stem: str = "stem") -> str:
    """A query giving ``word, stem`` for the words of the query or table ``source``, for checks in plain SQL."""
    inner = f"SELECT {word} AS word, {word} AS w FROM {source}"
    for step in steps(DUCK):
        inner = f"SELECT word, {step} AS w FROM ({inner})"
    return f"SELECT word AS {word}, CASE WHEN strlen(word) <= 2 THEN word ELSE w END AS {stem} FROM ({inner})"
