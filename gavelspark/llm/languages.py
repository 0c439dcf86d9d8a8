"""A small language guess from scripts and function words; no trained model, the same at every size. Languages without a list
are told by the lack of function words of all others."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import regex

#: Frequent function words of the languages told apart.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for on with as by at from this it are be has have had not or which their its been were before after without",
    "fr": "le la les des du de et en un une que qui est dans pour sur au aux avec par ce cette ne pas plus sont été ont sans sous leur ses son d l à",
    "es": "el la los las de del y en un una que es por para con no se al lo como más su sus este esta fue son otra ninguna ha han sobre según sin",
    "de": "der die das und ist nicht ein eine den dem des mit für auf von zu im sich als auch wurde haben hat keine aus bei nach oder wird diese gegen",
    "it": "il lo la gli di e che è un una per con non si del della dei nel alla sono come più questo questa stato contro hanno ha votato secondo",
    "pt": "o os as do da dos das e em um uma que é por para com não se ao mais seu sua este esta foi são contra votou segundo como",
    "nl": "de het een en van is niet op te dat voor met zijn aan er maar om ook als bij uit deze dit wordt werd tegen geen",
}
_IN = Counter(word for words in FUNCTION_WORDS.values() for word in set(words.split()))
#: A word counts the less, the more languages have it.
_WEIGHTS = {lang: {word: 1 / _IN[word] for word in words.split()} for lang, words in FUNCTION_WORDS.items()}
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[a-z]+")
#: Letters of the Latin blocks.
_LATIN = re.compile(r"[A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ]+")
QUOTED = regex.compile(r"«[^»]*(?:»|$)|“[^”]*(?:”|$)|\"[^\"]*(?:\"|$)")


def unquoted(text: str) -> str:
    """The text without what stands in quotation marks."""
    inner = QUOTED.sub(" ", text)
    while (again := QUOTED.sub(" ", inner)) != inner:
        inner = again
    return inner


#: A text of so many words is in none of the languages if its likeliest one's score is below this share of its words.
LEAST_WORDS, LEAST_SHARE = 8, 0.12


def guess(text: str) -> str | None:
    """Language of a text, ``other`` for a script other than Latin or a language without a list, None where too little
    speaks for one."""
    if text.isascii():
        tokens = _PLAIN.findall(text.lower())
        if not tokens:
            return None
    else:
        tokens = _LETTERS.findall(unicodedata.normalize("NFC", text).lower())
        letters = sum(map(len, tokens))
        if not letters:
            return None
        if sum(map(len, _LATIN.findall(text))) < 0.5 * letters:
            return "other"
    counts = Counter(tokens)
    known = [(w, counts[w]) for w in counts.keys() & _IN.keys()]
    score = {lang: sum(weights[w] * n for w, n in known if w in weights) for lang, weights in _WEIGHTS.items()}
    best = max(score, key=score.get)
    if len(tokens) >= LEAST_WORDS and score[best] < LEAST_SHARE * len(tokens):
        return "other"
    first, second = sorted(score.values(), reverse=True)[:2]
    return best if first >= 1 and first >= 1.2 * second else None
