"""Lexemes of Portuguese text: words, stop words, and a suffix-stripping stemmer.

The stemmer follows the published description of the Snowball stemmer for Portuguese: suffixes go
only where they lie in the regions R1, R2 or RV of a word. Nasal vowels count as a vowel and a
consonant, written ``a~`` and ``o~`` inside.
"""

from __future__ import annotations

import functools
import re
import unicodedata

VOWELS = frozenset("aeiouáéíóúâêô")

# Suffixes by what becomes of them, as the published algorithm lists them.
_DELETE_R2 = """eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento
imentos adora ador aça~o adoras adores aço~es ante antes ância""".split()
_REPLACE_R2 = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
_VERB = """ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam
ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o
ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres
ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis
ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos
emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras""".split()
_ADVERB = ("amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras")
_STEP1 = sorted({*_DELETE_R2, *_REPLACE_R2, *_ADVERB}, key=len, reverse=True)
_STEP2 = sorted(_VERB, key=len, reverse=True)

# Stop words. The forms of estar, haver, ser and ter are made from stems and endings.
_PLAIN = """de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou
quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles
você essa num nem suas meu às minha numa pelos elas qual nós lhe deles essas esses pelas este dele tu te vocês
vos lhes meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela
aqueles aquelas isto aquilo"""
_FORMS = {
    "est": "ou á amos ão ive eve ivemos iveram ava ávamos avam ivera ivéramos eja ejamos ejam ivesse ivéssemos ivessem iver ivermos iverem",
    "h": "ei á avemos ão ouve ouvemos ouveram ouvera ouvéramos aja ajamos ajam ouvesse ouvéssemos ouvessem ouver ouvermos ouverem ouverei ouverá ouveremos ouverão ouveria ouveríamos ouveriam",
    "s": "ou omos ão eja ejamos ejam erei erá eremos erão eria eríamos eriam",
    "": "é era éramos eram fui foi fomos foram fora fôramos fosse fôssemos fossem for formos forem",
    "t": "enho em emos ém inha ínhamos inham ive eve ivemos iveram ivera ivéramos enha enhamos enham ivesse ivéssemos ivessem iver ivermos iverem erei erá eremos erão eria eríamos eriam",
}
STOP_WORDS = frozenset(_PLAIN.split()) | {stem + ending for stem, endings in _FORMS.items() for ending in endings.split()}


def _after(word: str, start: int, first: bool) -> int:
    """The place after the next vowel (first) or consonant from ``start``; the end without one."""
    for i in range(start, len(word)):
        if (word[i] in VOWELS) == first:
            return i + 1
    return len(word)


def regions(word: str) -> tuple[int, int, int]:
    """Where R1, R2 and RV of a word begin."""
    r1 = _after(word, _after(word, 0, True), False)
    r2 = _after(word, _after(word, r1, True), False)
    if len(word) < 3:
        rv = len(word)
    elif word[1] not in VOWELS:
        rv = _after(word, 2, True)
    elif word[0] in VOWELS:
        rv = _after(word, 2, False)
    else:
        rv = 3
    return r1, r2, rv


def _standard(w: str, r1: int, r2: int, rv: int) -> str:
    """The word after the longest standard suffix, or itself."""
    found = next((s for s in _STEP1 if w.endswith(s)), None)
    if found is None:
        return w
    at = len(w) - len(found)
    if found in _REPLACE_R2:
        return w[:at] + _REPLACE_R2[found] if at >= r2 else w
    if found in ("ira", "iras"):
        return w[:at] + "ir" if at >= rv and w[:at].endswith("e") else w
    if at < (r1 if found == "amente" else r2):
        return w
    before = {"mente": ("ante", "avel", "ível"), "idade": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv")}
    w = w[:at]
    if found == "amente":
        for ending in ("iv", "os", "ic", "ad"):
            if w.endswith(ending):
                if len(w) - 2 >= r2:
                    w = w[:-2]
                    if ending == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                        w = w[:-2]
                break
    elif found in before:
        ending = next((b for b in before[found] if w.endswith(b)), None)
        if ending and len(w) - len(ending) >= r2:
            w = w[: -len(ending)]
    elif found in ("iva", "ivo", "ivas", "ivos") and w.endswith("at") and len(w) - 2 >= r2:
        w = w[:-2]
    return w


@functools.lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    w = word.replace("ã", "a~").replace("õ", "o~")
    r1, r2, rv = regions(w)
    start = w
    w = _standard(w, r1, r2, rv)
    if w == start:
        found = next((s for s in _STEP2 if w.endswith(s) and len(w) - len(s) >= rv), None)
        w = w[: -len(found)] if found else w
    if w != start:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        found = next((s for s in ("os", "a", "i", "o", "á", "í", "ó") if w.endswith(s)), None)
        if found and len(w) - len(found) >= rv:
            w = w[: -len(found)]
    if w.endswith(("e", "é", "ê")):
        if len(w) - 1 >= rv:
            w = w[:-1]
            if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
                w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


_RUN = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits of any script, accents composed."""
    return _RUN.findall(unicodedata.normalize("NFC", text or "").lower())


def lexeme(word: str, config: str) -> str | None:
    """What a word is indexed as; None for a stop word. ``simple`` keeps every word as it is."""
    if config == "simple":
        return word
    return None if word in STOP_WORDS else stem(word)
