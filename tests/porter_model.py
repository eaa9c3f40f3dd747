"""The Porter stemmer once more, letter by letter in plain Python: what the expressions are checked against.

Written from the published description, with none of the library's rules: a word is a row of flags, vowel or consonant,
and its measure is the number of times a vowel is followed by a consonant.
"""

PAIRS_2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
PAIRS_3 = ["icate", "ic", "ative", "", "alize", "al", "iciti", "ic", "ical", "ic", "ful", "", "ness", ""]
ENDS_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def vowels(w):
    flags = []
    for i, c in enumerate(w):
        flags.append(c in "aeiou" or (c == "y" and i > 0 and not flags[i - 1]))
    return flags


def measure(w):
    f = vowels(w)
    return sum(a and not b for a, b in zip(f, f[1:]))


def short_end(w):
    f = vowels(w)
    return len(w) >= 3 and not f[-1] and f[-2] and not f[-3] and w[-1] not in "wxy"


def swap(w, pairs, least):
    fits = [(s, t) for s, t in zip(pairs[::2], pairs[1::2]) if w.endswith(s)]
    if not fits:
        return w
    s, t = max(fits, key=lambda p: len(p[0]))
    stem = w[: len(w) - len(s)]
    return stem + t if measure(stem) > least else w


def stem(w):
    if len(w.encode()) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if any(vowels(w[: -len(end)])):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and not vowels(w)[-1]:
                        w = w if w[-1] in "lsz" else w[:-1]
                    elif measure(w) == 1 and short_end(w):
                        w += "e"
                break
    if w.endswith("y") and any(vowels(w[:-1])):
        w = w[:-1] + "i"
    w = swap(swap(w, PAIRS_2, 0), PAIRS_3, 0)
    ends = [e for e in ENDS_4 + ["ion"] if w.endswith(e)]
    if ends:
        rest = w[: len(w) - len(max(ends, key=len))]
        if measure(rest) > 1 and (max(ends, key=len) != "ion" or rest.endswith(("s", "t"))):
            w = rest
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w
