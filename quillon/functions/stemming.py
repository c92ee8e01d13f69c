"""Snowball stemmers for German, Spanish and French, on lower-case words."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache


def _after(word: str, vowels: str, start: int = 0) -> int:
    """The place after the first non-vowel that follows a vowel."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, endings: Iterable[str]) -> str:
    """The longest of the endings that the word has; empty for none."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


class _Word:
    """A word with its regions: an ending lies in one if it begins at or after the region's place."""

    def __init__(self, text: str, vowels: str):
        self.text = text
        self.r1 = _after(text, vowels)
        self.r2 = _after(text, vowels, self.r1)
        self.rv = len(text)

    def ends(self, ending: str, region: int = 0) -> bool:
        return self.text.endswith(ending) and len(self.text) - len(ending) >= region

    def cut(self, ending: str, region: int = 0, to: str = "") -> bool:
        """Replaces the ending if it lies in the region; whether it does."""
        if not ending or not self.ends(ending, region):
            return False
        self.text = self.text[: len(self.text) - len(ending)] + to
        return True

    def cut_any(self, endings: str, region: int = 0) -> bool:
        return any(self.cut(e, region) for e in endings.split())


# German. Vowels, endings and the letters before them.
_DE = "aeiouyäöü"


@lru_cache(maxsize=200_000)
def german(word: str) -> str:
    text = re.sub(f"(?<=[{_DE}])([uy])(?=[{_DE}])", lambda m: m[1].upper(), word.replace("ß", "ss"))
    w = _Word(text, _DE)
    w.r1 = max(w.r1, min(3, len(text)))
    found = _longest(w.text, ("em", "ern", "er", "e", "en", "es", "s"))
    if found == "s":
        if re.search("[bdfghklmnrt]s$", w.text):
            w.cut("s", w.r1)
    elif w.cut(found, w.r1) and found in ("e", "en", "es") and w.text.endswith("niss"):
        w.text = w.text[:-1]
    found = _longest(w.text, ("en", "er", "est", "st"))
    if found != "st" or re.search("...[bdfghklmnt]st$", w.text):
        w.cut(found, w.r1)
    found = _longest(w.text, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if found in ("end", "ung"):
        if w.cut(found, w.r2) and not w.text.endswith("eig"):
            w.cut("ig", w.r2)
    elif found in ("ig", "ik", "isch"):
        if not w.text.endswith("e" + found):
            w.cut(found, w.r2)
    elif found in ("lich", "heit"):
        if w.cut(found, w.r2):
            w.cut_any("er en", w.r1)
    elif found == "keit" and w.cut(found, w.r2):
        w.cut_any("lich ig", w.r2)
    return w.text.lower().translate(str.maketrans("äöü", "aou"))


# Spanish. Vowels, pronouns and endings.
_ES = "aeiouáéíóúü"
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_ES_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
_ES_TO = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
_ES_MORE = {"amente": "", "mente": "ante able ible", "idad": "abil ic iv", "idades": "abil ic iv", "iva": "at", "ivo": "at", "ivas": "at", "ivos": "at"}
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_GU = "en es éis emos".split()
_ES_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían "
    "aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
_ACUTE = str.maketrans("áéíóú", "aeiou")


def _spanish_rv(w: str) -> int:
    vowel = lambda i: w[i] in _ES
    if len(w) < 3:
        return len(w)
    if not vowel(1):
        return next((i + 1 for i in range(2, len(w)) if vowel(i)), len(w))
    if vowel(0):
        return next((i + 1 for i in range(2, len(w)) if not vowel(i)), len(w))
    return 3


@lru_cache(maxsize=200_000)
def spanish(word: str) -> str:
    w = _Word(word, _ES)
    w.rv = _spanish_rv(word)
    pronoun = _longest(w.text, _ES_PRONOUNS)
    if pronoun and w.ends(pronoun, w.rv):
        stem = w.text[: -len(pronoun)]
        verb = _longest(stem, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if verb and len(stem) - len(verb) >= w.rv and (verb != "yendo" or stem.endswith("uyendo")):
            w.text = stem[: len(stem) - len(verb)] + verb.translate(_ACUTE)
    found = _longest(w.text, [*_ES_PLAIN, *_ES_IC, *_ES_TO, *_ES_MORE])
    if found in _ES_TO:
        done = w.cut(found, w.r2, _ES_TO[found])
    elif found == "amente":
        if done := w.cut(found, w.r1):
            if w.cut("iv", w.r2):
                w.cut("at", w.r2)
            else:
                w.cut_any("os ic ad", w.r2)
    else:
        if done := w.cut(found, w.r2):
            w.cut_any("ic" if found in _ES_IC else _ES_MORE.get(found, ""), w.r2)
    if not done:
        found = _longest(w.text[w.rv :], _ES_Y)
        if found and w.text.endswith("u" + found):
            done = w.cut(found)
    if not done:
        found = _longest(w.text[w.rv :], [*_ES_GU, *_ES_VERB])
        if w.cut(found, w.rv) and found in _ES_GU and w.text.endswith("gu"):
            w.text = w.text[:-1]
    found = _longest(w.text[w.rv :], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if w.cut(found, w.rv) and found in ("e", "é") and w.text.endswith("gu") and w.ends("u", w.rv):
        w.text = w.text[:-1]
    return w.text.translate(_ACUTE)


# French. Vowels and endings; capitals are letters between vowels that are no vowels.
_FR = "aeiouyâàëéêèïîôûù"
_FR_R2 = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
_FR_AT = "atrice ateur ation atrices ateurs ations".split()
_FR_TO = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
_FR_REST = "ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()
_FR_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant "
    "issante issantes issants isse issent isses issez issiez issions issons it"
).split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _french_marked(word: str) -> str:
    out = list(word)
    vowel = lambda i: 0 <= i < len(out) and out[i] in _FR
    for i, c in enumerate(word):
        if c == "u" and (i and word[i - 1] == "q" or vowel(i - 1) and vowel(i + 1)):
            out[i] = "U"
        elif c == "i" and vowel(i - 1) and vowel(i + 1):
            out[i] = "I"
        elif c == "y" and (vowel(i - 1) or vowel(i + 1)):
            out[i] = "Y"
    return "".join(out)


def _french_rv(w: str) -> int:
    if w.startswith(("par", "col", "tap")) or len(w) > 2 and w[0] in _FR and w[1] in _FR:
        return 3
    return next((i + 1 for i in range(1, len(w)) if w[i] in _FR), len(w))


def _french_first(w: _Word) -> str:
    """The ending that the first step has taken or changed; empty for none."""
    found = _longest(w.text, [*_FR_R2, *_FR_AT, *_FR_TO, *_FR_REST])
    if found in _FR_TO:
        return found if w.cut(found, w.r2, _FR_TO[found]) else ""
    if found in _FR_R2:
        return found if w.cut(found, w.r2) else ""
    if found in _FR_AT:
        if not w.cut(found, w.r2):
            return ""
        if not w.cut("ic", w.r2):
            w.cut("ic", 0, "iqU")
    elif found in ("ement", "ements"):
        if not w.cut(found, w.rv):
            return ""
        if w.text.endswith("iv"):
            if w.cut("iv", w.r2):
                w.cut("at", w.r2)
        elif w.text.endswith("eus"):
            if not w.cut("eus", w.r2):
                w.cut("eus", w.r1, "eux")
        elif w.text.endswith(("abl", "iqU")):
            w.cut_any("abl iqU", w.r2)
        elif w.text.endswith(("ièr", "Ièr")):
            w.cut(w.text[-3:], w.rv, "i")
    elif found in ("ité", "ités"):
        if not w.cut(found, w.r2):
            return ""
        if w.text.endswith("abil"):
            if not w.cut("abil", w.r2):
                w.cut("abil", 0, "abl")
        elif w.text.endswith("ic"):
            if not w.cut("ic", w.r2):
                w.cut("ic", 0, "iqU")
        else:
            w.cut("iv", w.r2)
    elif found in ("if", "ive", "ifs", "ives"):
        if not w.cut(found, w.r2):
            return ""
        if w.cut("at", w.r2) and w.text.endswith("ic") and not w.cut("ic", w.r2):
            w.cut("ic", 0, "iqU")
    elif found == "eaux":
        w.cut("eaux", 0, "eau")
    elif found == "aux":
        return found if w.cut("aux", w.r1, "al") else ""
    elif found in ("euse", "euses"):
        return found if w.cut(found, w.r2) or w.cut(found, w.r1, "eux") else ""
    elif found in ("issement", "issements"):
        before = w.text[: -len(found)][-1:]
        return found if before and before not in _FR and w.cut(found, w.r1) else ""
    elif found in ("amment", "emment"):
        return found if w.cut(found, w.rv, "ant" if found == "amment" else "ent") else ""
    elif found:  # ment, ments
        at = len(w.text) - len(found) - 1
        return found if at >= w.rv and w.text[at] in _FR and w.cut(found) else ""
    return found


def _french_verb(w: _Word) -> bool:
    """The verb endings; whether one has gone."""
    inside = w.text[w.rv :]
    found = _longest(inside, _FR_I)
    if found:
        at = len(inside) - len(found) - 1
        if at >= 0 and inside[at] not in _FR:
            return w.cut(found)
    found = _longest(inside, ["ions", *_FR_E, *_FR_A])
    if found == "ions":
        return w.cut(found, w.r2)
    if not w.cut(found, w.rv):
        return False
    if found in _FR_A:
        w.cut("e", w.rv)
    return True


@lru_cache(maxsize=200_000)
def french(word: str) -> str:
    text = _french_marked(word)
    w = _Word(text, _FR)
    w.rv = _french_rv(text)
    first = _french_first(w)
    changed = bool(first)
    if not first or first in ("amment", "emment", "ment", "ments"):
        changed = _french_verb(w) or changed
    if changed:
        w.cut("Y", 0, "i") or w.cut("ç", 0, "c")
    else:
        if re.search("[^aiouès]s$", w.text):
            w.text = w.text[:-1]
        inside = w.text[w.rv :]
        found = _longest(inside, ("ion", "ier", "ière", "Ier", "Ière", "e"))
        if found == "ion":
            if inside[:-3].endswith(("s", "t")):
                w.cut("ion", w.r2)
        elif found:
            w.cut(found, 0, "" if found == "e" else "i")
    if w.text.endswith(("enn", "onn", "ett", "ell", "eill")):
        w.text = w.text[:-1]
    w.text = re.sub(f"[éè](?=[^{_FR}]+$)", "e", w.text)
    return w.text.lower()


STEMMERS = {"german": german, "spanish": spanish, "french": french}
