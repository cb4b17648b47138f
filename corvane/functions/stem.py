"""Snowball stemmers after their published descriptions: English (Porter 2),
the original Porter, German, Swedish, Norwegian and Danish.

Whole arrays of tokens go through one Arrow function that stems each distinct
form once. Null forms stay null. An unknown language is English, as the option
it serves has it; ``LANGUAGES`` lists the known ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LI = "cdeghkmnrt"
_IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}}
_FIXED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, vowels: str, begin: int = 0) -> int:
    """Where what follows the first non-vowel after a vowel begins."""
    i = begin
    while i < len(word) and word[i] not in vowels:
        i += 1
    while i < len(word) and word[i] in vowels:
        i += 1
    return min(i + 1, len(word))


def english(word: str) -> str:
    vowels = "aeiouy"
    if len(word) <= 2:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = word.lstrip("'") if word.startswith("'") else word
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _region(w, vowels)
    r2 = _region(w, vowels, r1)
    short_end = lambda x: bool(re.search(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", x))
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _FIXED:
        return w
    if w.endswith(("eedly", "eed")):
        n = 5 if w.endswith("eedly") else 3
        if len(w) - n >= r1:
            w = w[:-n] + "ee"
    elif m := re.search(r"(?:ingly|edly|ing|ed)$", w):
        if re.search(r"[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif r1 >= len(w) and short_end(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowels:
        w = w[:-1] + "i"
    for end, to in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in _LI and w[-3:-2]):
                w = w[: len(w) - len(end)] + to
            break
    for end, to in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: len(w) - len(end)] + to
            break
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: len(w) - len(end)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _measure(stem: str) -> int:
    """Runs of vowels followed by consonants; y after a consonant is a vowel."""
    kinds = ""
    for i, c in enumerate(stem):
        kinds += "v" if c in "aeiou" or c == "y" and i and kinds[-1] == "c" else "c"
    return len(re.findall("v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return bool(re.search(r"[aeiou]|(?<=[^aeiou])y", stem))


def _cvc(w: str) -> bool:
    return bool(re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", w))


_PORTER2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_PORTER3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_PORTER4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def porter(w: str) -> str:
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (m := re.search(r"(?:ed|ing)$", w)) and _has_vowel(w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"([^aeiouylsz])\1$", w):
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_PORTER2, _PORTER3):
        found = max((x for x in table if w.endswith(x[0])), key=lambda x: len(x[0]), default=None)
        if found and _measure(w[: -len(found[0])]) > 0:
            w = w[: -len(found[0])] + found[1]
    for end in _PORTER4:
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def german(word: str) -> str:
    vowels = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = re.sub(rf"(?<=[{vowels}])([uy])(?=[{vowels}])", lambda m: m[1].upper(), w)
    first = _region(w, vowels)
    r1, r2 = max(3, first), _region(w, vowels, first)
    if m := re.search(r"(?:ern|em|er)$", w):
        w = w[: m.start()] if m.start() >= r1 else w
    elif m := re.search(r"(?:en|es|e)$", w):
        if m.start() >= r1:
            w = w[: m.start()]
            w = w[:-1] if w.endswith("niss") else w
    elif len(w) - 1 >= r1 and re.search(r"[bdfghklmnrt]s$", w):
        w = w[:-1]
    if m := re.search(r"(?:est|en|er)$", w):
        w = w[: m.start()] if m.start() >= r1 else w
    elif len(w) - 2 >= r1 and re.search(r"...[bdfghklmnt]st$", w):
        w = w[:-2]
    if m := re.search(r"(?:isch|lich|heit|keit|end|ung|ig|ik)$", w):
        if (at := m.start()) >= r2:
            end, stem = m[0], w[:at]
            if end in ("end", "ung"):
                w = stem[:-2] if stem.endswith("ig") and at - 2 >= r2 and not stem.endswith("eig") else stem
            elif end in ("ig", "ik", "isch"):
                w = stem if not stem.endswith("e") else w
            elif end in ("lich", "heit"):
                w = stem[:-2] if stem.endswith(("er", "en")) and at - 2 >= r1 else stem
            else:
                n = 4 if stem.endswith("lich") else 2 if stem.endswith("ig") else 0
                w = stem[: at - n] if n and at - n >= r2 else stem
    return w.replace("U", "u").replace("Y", "y").translate(str.maketrans("äöü", "aou"))


def _northern(vowels: str, first: str, s_after: str, doubled: str, last: str, change=()) -> Callable[[str], str]:
    """The shape that the Scandinavian stemmers share: a main suffix, a consonant
    pair cut, and another suffix, all after the first region of three letters."""
    ends = sorted(first.split(), key=len, reverse=True)
    lasts = sorted(last.split(), key=len, reverse=True)
    pairs = tuple(doubled.split())

    def run(w: str) -> str:
        r1 = max(3, _region(w, vowels))
        end = next((e for e in ends if w.endswith(e) and len(w) - len(e) >= r1), None)
        if end in ("erte", "ert"):
            w = w[: -len(end)] + "er"
        elif end:
            w = w[: -len(end)]
        elif w.endswith("s") and len(w) - 1 >= r1 and len(w) > 1 and (w[-2] in s_after or "k?" in s_after and w[-2] == "k" and w[-3:-2] not in vowels):
            w = w[:-1]
        if w.endswith(pairs) and len(w) - 2 >= r1:
            w = w[:-1]
        if change and change[0] == "igst" and w.endswith("igst"):
            w = w[:-2]
        for old, new in (x for x in change if isinstance(x, tuple)):
            if w.endswith(old) and len(w) - len(old) >= r1:
                return w[: -len(old)] + new
        end = next((e for e in lasts if w.endswith(e) and len(w) - len(e) >= r1), None)
        if end:
            w = w[: -len(end)]
            if change and change[0] == "igst" and w.endswith(pairs) and len(w) - 2 >= r1:
                w = w[:-1]
        if change and change[0] == "igst" and len(w) - 1 >= r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in vowels:
            w = w[:-1]
        return w

    return run


swedish = _northern("aeiouyäåö", "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast", "bcdfghjklmnoprtvy", "dd gd nn dt gt kt tt", "lig ig els", (("fullt", "full"), ("löst", "lös")))
norwegian = _northern("aeiouyæåø", "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast erte ert", "bcdfghjlmnoprtvyzk?", "dt vt", "leg eleg ig eig lig elig els lov elov slov hetslov")
danish = _northern("aeiouyæåø", "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret", "abcdfghjklmnoprtvyzå", "gd dt gt kt", "ig lig elig els", ("igst", ("løst", "løs")))

LANGUAGES: dict[str, Callable[[str], str]] = {"en": english, "porter": porter, "de": german, "sv": swedish, "no": norwegian, "da": danish}


def stemmer(lang: str = "en") -> Callable[[Column], Column]:
    """A function from a Column of arrays of forms to one of their stems."""
    rule = LANGUAGES.get(lang, english)

    @F.pandas_udf("array<string>")
    def run(forms: pd.Series) -> pd.Series:
        known = lru_cache(maxsize=200_000)(lambda w: None if w is None else rule(w))
        return forms.map(lambda own: None if own is None else [known(w) for w in own])

    return run
