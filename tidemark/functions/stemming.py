"""English stems by the published Porter2 rules, and stop words of English full text search."""

from __future__ import annotations

import re

#: The rules' lists and the usual stop words.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
    theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but
    if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over
    under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very
    s t can will just don should now""".split()
)
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_AS_IS = frozenset("sky news howe atlas cosmos bias andes".split())
_AS_IS_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_VOWEL = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def _region(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters, and others than letters, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word in _WHOLE or word in _AS_IS:
        return _WHOLE.get(word, word)
    word = re.sub(r"(?<=[aeiouy])y", "Y", "Y" + word[1:] if word[0] == "y" else word)
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None) or _region(word, 0)
    second = _region(word, first)
    short = lambda w: len(w) <= first and bool(_SHORT_END.match(w))

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWEL for c in word[:-2]):
        word = word[:-1]
    if word in _AS_IS_LATER:
        return word

    if word.endswith(("eed", "eedly")):
        cut = 3 if word.endswith("eed") else 5
        if len(word) - cut >= first:
            word = word[:-cut] + "ee"
    else:
        ending = next((e for e in ("ingly", "edly", "ing", "ed") if word.endswith(e)), "")
        if ending and any(c in _VOWEL for c in word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                word = word[:-1]
            elif short(word):
                word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"

    ending = next((e for e in _STEP2 if word.endswith(e)), "")
    if ending:
        if len(word) - len(ending) >= first:
            word = word[: -len(ending)] + _STEP2[ending]
    elif word.endswith("ogi"):
        word = word[:-1] if len(word) - 3 >= first and word[-4:-3] == "l" else word
    elif word.endswith("li") and len(word) - 2 >= first and word[-3:-2] in tuple("cdeghkmnrt"):
        word = word[:-2]

    ending = next((e for e in _STEP3 if word.endswith(e)), "")
    if ending:
        if len(word) - len(ending) >= first:
            word = word[: -len(ending)] + _STEP3[ending]
    elif word.endswith("ative") and len(word) - 5 >= second:
        word = word[:-5]

    ending = next((e for e in _STEP4 if word.endswith(e)), "")
    if ending:
        if len(word) - len(ending) >= second:
            word = word[: -len(ending)]
    elif word.endswith("ion") and len(word) - 3 >= second and word[-4:-3] in ("s", "t"):
        word = word[:-3]

    if word.endswith("e") and (len(word) - 1 >= second or len(word) - 1 >= first and not _SHORT_END.match(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")
