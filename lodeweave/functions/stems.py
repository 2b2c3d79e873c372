"""Stems and stop words of a language: the published Snowball rules for English (Porter's second) and German, over columns of word lists.

``simple`` is no language: words stay as they are and none is a stop word. Words come in lower case and may have lost their accents. A list is stemmed before it is exploded, so equal stems of a text meet in its own row
and no shuffle is needed to make them distinct; a worker stems each different word once for as long as it remembers it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeweave.functions.slices import by_slices

SIMPLE = "simple"
#: Lists of words that a worker stems at a time.
LISTS = 1024

# Fixed values of the English rules.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT_ALONE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
ENGLISH_STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were "
    "be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
# Fixed values of the German rules; pronouns and articles are declined by the rule below.
DECLINED = "ein kein mein dein sein ihr unser dies jed jen manch solch welch all ander einig".split()
GERMAN_STOP = frozenset(
    "aber als also am an auch auf aus bei bin bis bist da damit dann das dass daß dasselbe dazu dein der den des dem die derselbe derselben denselben desselben demselben dieselbe dieselben du derer dessen denn doch dort durch er "
    "ihn ihm es etwas euch euer eure eurem euren eurer eures für gegen gewesen hab habe haben hat hatte hatten hier hin hinter ich mich mir im in indem ins ist jetzt kann können könnte machen man mit muss musste nach nicht "
    "nichts noch nun nur ob oder ohne sehr selbst sich sie ihnen sind so sondern sonst soll sollte über um und uns viel vom von vor während war waren warst was weg weil weiter wenn werde werden wie wieder will wir wird wirst "
    "wo wollen wollte würde würden zu zum zur zwar zwischen".split()
) | frozenset(w + e for w in DECLINED for e in ("", "e", "em", "en", "er", "es"))


def _after_vowel(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first consonant that follows a vowel begins."""
    found = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, suffixes: Iterator[str] | tuple[str, ...] | dict[str, str]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _short_end(word: str) -> bool:
    return bool(re.search("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word))


def english(word: str) -> str:
    """The stem of an English word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub("(^|(?<=[aeiouy]))y", "Y", word.removeprefix("'"))
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _after_vowel(w, "aeiouy")
    r2 = _after_vowel(w, "aeiouy", r1)
    if s := _longest(w, ("'", "'s", "'s'")):
        w = w[: -len(s)]
    s = _longest(w, ("sses", "ied", "ies", "s", "us", "ss"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in LEFT_ALONE:
        return w
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and re.search("[aeiouy]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    w = re.sub("(?<=.[^aeiouy])[yY]$", "i", w)
    s = _longest(w, STEP_2)
    if s and len(w) - len(s) >= r1 and (s != "ogi" or w.endswith("logi")) and (s != "li" or w[-3] in "cdeghkmnrt"):
        w = w[: -len(s)] + STEP_2[s]
    s = _longest(w, STEP_3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + STEP_3[s]
    s = _longest(w, STEP_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w.endswith(("sion", "tion"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) > r2 or len(w) > r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


def german(word: str) -> str:
    """The stem of a German word."""
    vowels = "aeiouyäöü"
    w = re.sub(f"(?<=[{vowels}])[uy](?=[{vowels}])", lambda m: m[0].upper(), word.replace("ß", "ss"))
    first = _after_vowel(w, vowels)
    r1, r2 = max(3, first), _after_vowel(w, vowels, first)
    inside = lambda w, s, r: len(w) - len(s) >= r
    s = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and inside(w, s, r1) and (s != "s" or w[-2] in "bdfghklmnrt"):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = _longest(w, ("en", "er", "est", "st"))
    if s and inside(w, s, r1) and (s != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(s)]
    s = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and inside(w, s, r2) and not (s in ("ig", "ik", "isch") and w[: -len(s)].endswith("e")):
        w = w[: -len(s)]
        if s in ("end", "ung") and w.endswith("ig") and inside(w, "ig", r2) and not w.endswith("eig"):
            w = w[:-2]
        elif s in ("lich", "heit") and w.endswith(("er", "en")) and inside(w, "er", r1):
            w = w[:-2]
        elif s == "keit" and (t := _longest(w, ("lich", "ig"))) and inside(w, t, r2):
            w = w[: -len(t)]
    return w.translate(str.maketrans("UYäöü", "uyaou"))


LANGUAGES: dict[str, tuple[Callable[[str], str], frozenset[str]]] = {"english": (english, ENGLISH_STOP), "german": (german, GERMAN_STOP)}


@lru_cache(maxsize=4)
def _remembering(language: str) -> Callable[[str], str | None]:
    stem, stop = LANGUAGES[language]
    folded = stop | {w.translate(str.maketrans("äöü", "aou")) for w in stop}
    return lru_cache(maxsize=1 << 18)(lambda word: None if word in folded else stem(word))


def stemmer(language: str) -> Callable[[Column], Column] | None:
    """A function of a column of word lists: the different stems of each, in order, without stop words. None for ``simple``; null gives null, and other names are an error."""
    if language == SIMPLE:
        return None
    if language not in LANGUAGES:
        raise ValueError(f"no stems for {language!r}; known: {', '.join([SIMPLE, *LANGUAGES])}")

    @F.arrow_udf("array<string>")
    def stems(lists: pa.Array) -> pa.Array:
        one = _remembering(language)
        return by_slices(lambda some: _stem_lists(some, one), pa.list_(pa.string()), LISTS, lists)

    return stems


def _stem_lists(lists: pa.Array, one: Callable[[str], str | None]) -> pa.Array:
    """The different stems of each list, as they first occur. Words stay in Arrow: Python sees each different one once, and no list of them."""
    flat = lists.flatten().dictionary_encode()
    code: dict[str, int] = {}
    stem = np.array([code.setdefault(s, len(code)) if (s := one(w)) else -1 for w in flat.dictionary.to_pylist()] or [-1], dtype=np.int64)
    stem = stem[flat.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    row, stem = row[stem >= 0], stem[stem >= 0]
    first = np.sort(np.unique(row * max(1, len(code)) + stem, return_index=True)[1])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(lists)))]).astype(np.int32)
    words = pa.array(list(code), pa.string()).take(pa.array(stem[first]))
    return pa.ListArray.from_arrays(pa.array(ends), words, mask=lists.is_null())
