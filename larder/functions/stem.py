"""An English suffix stripper for the `english` analyzer, after the public Porter algorithm."""

from __future__ import annotations

import re

# Words the english analyzer drops.
STOPWORDS = frozenset(
    "i me my we our you your he him his she her it its they them their what which who this that these those am is are was were be been being have has had do does did a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _shape(stem: str) -> str:
    """c and v for each run of consonants and vowels."""
    marks = "".join("v" if ch in "aeiou" or (ch == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, ch in enumerate(stem))
    return re.sub(r"(.)\1+", r"\1", marks)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(w: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return len(w) >= 3 and "".join("v" if ch in "aeiou" or (ch == "y" and i and w[len(w) - 3 + i - 1] not in "aeiou") else "c" for i, ch in enumerate(w[-3:])) == "cvc" and w[-1] not in "wxy"


def _swap(w: str, table: dict[str, str], least: int) -> str:
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + table[end] if _measure(stem) > least else w
    return w


def stem(w: str) -> str:
    """The stem of a lower-case word; words of up to two letters and words with other characters stay."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                cut += "e"
            elif len(cut) > 1 and cut[-1] == cut[-2] and cut[-1] not in "aeioulsz":
                cut = cut[:-1]
            elif _measure(cut) == 1 and _short_end(cut):
                cut += "e"
            w = cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2, 0), _STEP3, 0)
    for end in _STEP4:
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w
