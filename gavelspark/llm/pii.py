"""Personal information inside free text.

Regular expressions propose spans; checksums (Luhn for insurance and health card numbers, mod 97 for bank accounts)
confirm or refute them; words around a span raise or lower its score (a number that its text calls an insurance number is
one even if mistyped, a bare one only by its checksum; a name is two or more capitalised words of which none stands in small
letters in the text, surer by a title, by what stands around it and by its family name standing again); spans that reach
``LEAST`` are kept, the surer kind first where two overlap, and replaced by typed placeholders.

A pattern is tried only around what each of its matches must hold: an at sign, six digits, a number before a capital or a
street word, two capitalised words. These anchors are found by scans of single character sets over the whole text.

Defined results: a null text has no findings and stays null; offsets count code points; a value that stands twice is found
twice; texts of any length are read whole, in time proportional to their length. Bank accounts are replaced but are not
among the kinds that ``personal_spans`` reports.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame

#: Least score of a kept span.
LEAST = 1.5
KINDS = ("email", "phone", "id_number", "address", "name")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


_S = r"[ \t\u00a0\u2009\u202f]"
_DASH = r"[-\u2010-\u2013\u2212]"
EMAIL = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}._%+@-])[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}._%+'-]{{0,63}}[\p{{L}}\p{{N}}_+-])?{_S}{{0,2}}"
    rf"(?:@|[\[({{]{_S}?(?:at|arobase|à){_S}?[\])}}]|{_S}at{_S}(?=[\p{{L}}\p{{N}}-]+{_S}dot{_S})){_S}{{0,2}}"
    rf"[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}-]*)(?:{_S}{{0,2}}(?:\.(?=\p{{L}})|[\[({{]{_S}?(?:dot|point){_S}?[\])}}]|{_S}dot{_S}){_S}{{0,2}}[\p{{L}}\p{{N}}-]+)+",
    regex.I,
)
_SEP = rf"(?:{_S}|{_DASH}|[./]){{0,2}}"
PHONE = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}$€£#]|[\p{{N}}][.,-])(?:(?:\+|00)?1{_SEP})?\(?([2-9]\d\d)\)?{_SEP}([2-9]\d\d){_SEP}(\d{{4}})(?![\p{{L}}\p{{N}}]|[.,-]\d)"
    rf"|(?<![\p{{L}}\p{{N}}])\+(?!1\b)[2-9]\d{{0,2}}(?:{_SEP}\(?\d{{1,4}}\)?){{2,5}}(?!\d)"
)
SIN = regex.compile(rf"(?<![\p{{L}}\p{{N}}$€£]|\d[.,-])(\d{{3}})((?:{_S}|{_DASH}|\.)?)(\d{{3}})\2(\d{{3}})(?![\p{{L}}\p{{N}}]|[.,-]\d)")
HEALTH = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(\d{{4}})((?:{_S}|{_DASH}|\.)?)(\d{{3}})\2(\d{{3}})(?:\2|{_S}?)[A-Z]{{2}}(?![\p{{L}}\p{{N}}])", regex.I)
HEALTH_LETTERS = regex.compile(rf"(?<![\p{{L}}\p{{N}}])[A-Z]{{4}}(?:{_S}|{_DASH})?\d{{4}}(?:{_S}|{_DASH})?\d{{4}}(?![\p{{L}}\p{{N}}])", regex.I)
PASSPORT = regex.compile(rf"(?<![\p{{L}}\p{{N}}])[A-Z]{{1,2}}{_S}?\d{{6,7}}(?:[A-Z]{{2}})?(?![\p{{L}}\p{{N}}])", regex.I)
IBAN = regex.compile(rf"(?<![\p{{L}}\p{{N}}])[A-Z]{{2}}\d{{2}}(?:{_S}?[A-Z0-9]{{4}}){{2,7}}(?:{_S}?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}])")

#: Street types of English and French addresses, unit words and directions.
_TYPES = "street|st|avenue|ave|av|road|rd|lane|ln|crescent|cres|cr|drive|dr|boulevard|blvd|boul|court|ct|place|pl|terrace|terr|way|square|sq|circle|cir|close|trail|parkway|pkwy|row|gate|grove|heights|hill|highway|hwy|mews|path|walk|wharf|quay|line|sideroad|concession"
_FR_TYPES = "rue|avenue|av|chemin|ch|boulevard|boul|place|allée|allee|rang|route|rte|montée|montee|impasse|ruelle|quai|côte|cours|promenade|sentier|terrasse|croissant"
_DIRECTION = r"(?:[NSEWO][EWO]?|north|south|east|west|nord|sud|est|ouest)"
_UNIT = rf"(?:unit|apt|apartment|suite|ste|app|appt|appartement|unité|bureau|room|rm|floor|étage)\.?{_S}*(?:no\.?{_S}*)?#?{_S}*[\p{{L}}]?\d{{1,5}}\p{{L}}?"
_NAME_WORD = r"(?:(?:Ste?|Mt|Dr)\.|\p{Lu}[\p{L}'’-]*|\d{1,3}(?:st|nd|rd|th|e|er|re))"
_NUMBER = rf"\d{{1,6}}(?:{_S}?(?:\p{{L}}|½)(?![\p{{L}}]))?(?:{_DASH}\d{{1,5}})?"
_EN_STREET = rf"{_NUMBER},?{_S}+(?:{_NAME_WORD}{_S}+){{1,8}}?(?i:{_TYPES})\b\.?(?:{_S}+(?i:{_DIRECTION})\b\.?)?"
_FR_STREET = rf"{_NUMBER}{_S}*,?{_S}*(?i:{_FR_TYPES})\b\.?{_S}+(?:(?i:du|de{_S}la|des|de|d['’]|de{_S}l['’]|l['’]|la|le|les){_S}*)?{_NAME_WORD}(?:{_S}+(?i:de|du|des|de{_S}la){_S}+{_NAME_WORD})?(?:{_S}+{_NAME_WORD}(?=[,;\n<]|$))?"
_BOX = rf"(?i:p\.?{_S}?o\.?{_S}*box|post{_S}office{_S}box|c\.?{_S}?p\.?|case{_S}postale|b\.?p\.?|boîte{_S}postale|rr|r\.r\.){_S}*(?:no\.?{_S}*)?#?{_S}*\d{{1,6}}"
ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}$€£]|\d[.,-])(?:(?i:{_UNIT}){_S}*(?:,|{_DASH}|/)?{_S}*(?:{_EN_STREET}|{_FR_STREET})|{_BOX}(?:,{_S}*(?:{_NAME_WORD}{_S}+){{1,8}}?(?i:{_TYPES})\b\.?)?|{_EN_STREET}|{_FR_STREET})"
    rf"(?:,{_S}*(?i:{_UNIT}))?"
)

#: Titles before a name, words of institutions and places, and words that no name holds.
TITLES = frozenset("mr mrs ms miss dr dre prof professor hon rev sen sir dame mme mlle m me madame monsieur mademoiselle sgt capt lt col gen minister".split())
_TITLE = r"(?:mr|mrs|ms|miss|dr|dre|prof|hon|rev|sen|mme|mlle|m|me|sgt|capt|lt|col|gen|madame|monsieur|l['’]hon)\.?"
PLACES = frozenset("harbour harbor falls bridge valley plains bay beach city town village county creek hills hill island islands lake mountain park point port river ridge rock springs station vale woods sound shore grove junction crossing landing mills street road avenue lane crescent drive square highway act bill question petition section version page annex division rd ave av st ln blvd dr".split())
BODIES = frozenset("fund trust scheme programme program bursary foundation party union alliance bloc bench democrats coalition ground league group movement society committee council board office ministry department agency bureau tribunal commission library house senate court bank company ltd ltée inc corp llc limited firm institute university college school hospital church club centre center authority association federation network service services press news act régime fonds fiducie fidéicommis programme bourses parti groupe ligue comité conseil ministère mouvement prairies canada parliament government forum initiative project corporation partners holdings industries group".split())
NOT_NAMES = frozenset(
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre monday tuesday wednesday thursday friday saturday sunday lundi mardi mercredi jeudi vendredi samedi dimanche "
    "the a an this that these those we i it he she they you my our his her their its in on at for with by from as if when since although despite under after before during between without against over does do did is are was were will would who what why how there here bill and or but not no yes only even still "
    "le la les un une ce cette ces nous je il elle ils elles vous mon ma mes notre nos son sa ses leur leurs en dans au aux avec par pour sur si quand depuis malgré sous après avant pendant entre sans contre est qui que quoi quel quelle pourquoi comment et ou mais ne pas oui non selon lors chaque tous toutes aucun aucune "
    "speaker chair minister member members colleague letters copies mailing address contact tel tél fax email courriel adresse signed signé sin nas page annex annexe fin end petition pétition question version division form formulaire copie réponse répondez appelez call please reply follow see voir highway section english french canadian québec quebec act version north south east west northern southern eastern western first second third new old box p.o".split()
)
BEFORE = regex.compile(
    r"(?:\b(?:signed|signé|signée|regards|sincerely|yours(?: truly)?|respectfully|thanks|thank you|cordialement|salutations|merci|bien à vous|neighbou?r|voisine?|letters? from|lettres? de|file of|dossier de|told by|written by|according to|selon|c['’]est|it was|as|comme|named|called|friend|ami|amie|constituent|resident|contact|attn|attention|from|by|par|to|dear|cher|chère|patient|client|tenant|owner|daughter|son|mother|father|mère|père|mari|husband|wife|épouse)\s*[:,]?\s*)$",
    regex.I,
)
AFTER = regex.compile(
    r"^(?:\s+(?:told|tells|wrote|writes|said|says|asked|asks|spoke|waited|waits|lives|lived|has|had|was|is|who|called|found|moved|signed|added|replied|habite|a|avait|qui|dit|écrit|demande|vit|est|était)\b"
    r"|\s*,\s*(?:\d|unit|apt|suite|app|p\.?\s?o\.?|c\.?p\.?|who|qui|of|de)\b|\s*\((?:\p{Lu}|\d)|\s*[,:]\s*\(?\+?\d|\s*:)",
    regex.I,
)
DETERMINER = regex.compile(r"(?:\b(?:the|a|an|this|that|le|la|les|un|une|du|des|au|aux|ce|cette|groupe|in|near|at|à|dans|près de|vers|st|ste|saint)\.?|\b[ldL]['’])\s*$", regex.I)
_WORD = r"(?:(?:[Dd]['’]|O['’]|Mc|Mac)?\p{Lu}(?:\p{Ll}[\p{L}'’]*|\p{Lu}[\p{Lu}'’]+)(?:-\p{Lu}[\p{L}'’]+)*)"
_INITIAL = r"\p{Lu}\.(?:-?\p{Lu}\.){0,3}"
NAME = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}@._/-])(?:(?P<title>(?i:{_TITLE})){_S}+)?(?P<name>"
    rf"(?P<family>{_WORD}),{_S}+(?P<given>{_WORD}|{_INITIAL})(?:{_S}+{_INITIAL}|{_S}+{_INITIAL}{_S}*{_INITIAL})?"
    rf"|{_WORD}(?:{_S}+(?:(?:van|von|di|del|der){_S}+)?(?:{_INITIAL}|{_WORD})){{1,7}}|{_INITIAL}(?:{_S}*{_INITIAL}){{0,3}}{_S}+{_WORD})(?![\p{{L}}\p{{N}}@])",
)
#: After a lone "M." and one word: French, where it is a title and a family name alone is no name.
_FRENCH_AFTER = regex.compile(r"\s+(?:a|avait|est|était|dit|qui|et|de|du|des|dans|pour|au)\b")
_TITLE_WORD = regex.compile(rf"(?<![\p{{L}}]){_TITLE}[\s]+$", regex.I)




def _capitals() -> str:
    """The inside of a character set of all capital letters."""
    capital = [chr(c).isupper() or chr(c).istitle() for c in range(0x10000)] + [False]
    starts = [c for c in range(0x10000) if capital[c] and not (c and capital[c - 1])]
    return "".join(f"{chr(a)}-{chr(next(c for c in range(a, 0x10001) if not capital[c]) - 1)}" for a in starts)


_UPPER = _capitals()
#: Anchors: six digits or more, a plus sign, a spelled-out at sign, a number, what follows a house number, a post box before
#: its number, and capitalised words in a row.
_DIGITS = re.compile(r"\d(?:[^\w\n]{0,3}\d){5,}|\+")
_SPELLED = re.compile(rf"@|[\[({{]{_S}?(?:[Aa][Tt]|[Aa][Rr][Oo][Bb][Aa][Ss][Ee]|[àÀ]){_S}?[\])}}]|{_S}[Aa][Tt]{_S}[\w-]+{_S}[Dd][Oo][Tt]{_S}")
_RUN_OF_DIGITS = re.compile(r"\d+")
_STREET_AFTER = re.compile(rf"\d+(?:{_S}?[^\W\d_](?![^\W\d_])|½)?(?:{_DASH}\d{{1,5}})?{_S}*,?{_S}*(?:[{_UPPER}]|\d{{1,3}}(?:st|nd|rd|th|er?|re)\b|(?i:{_FR_TYPES})\b)")
_BOX_BEFORE = re.compile(r"(?:box|postale|[cb]\.?\s?p\.?|r\.?r\.?)\s*(?:no\.?\s*)?#?\s*$", re.I)
_CAPITALISED = re.compile(rf"[{_UPPER}][\w.'’-]*(?:,?{_S}+(?:(?:v[ao]n|di|de[lr]){_S}+)?[{_UPPER}][\w.'’-]*)+")
_PART = regex.compile(r"[\p{L}'’.-]*\p{L}[\p{L}'’-]*\.?")
_FOLLOWING_GIVEN = regex.compile(rf"{_S}+(\p{{Lu}}\p{{Ll}}[\p{{L}}'’-]*)")
_NEXT = re.compile(r"\s+((?:[^\W\d_]|['’-])+)")


def _windows(text: str, anchors: Iterable[tuple[int, int]], before: int, after: int) -> list[tuple[int, int]]:
    """Stretches of a text around anchors, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in anchors:
        low, high = max(0, a - before), min(len(text), b + after)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _matches(pattern, text: str, windows: list[tuple[int, int]]) -> Iterator:
    for low, high in windows:
        yield from pattern.finditer(text, low, high)


def luhn(digits: str) -> bool:
    """Luhn's check over a string of digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of an international bank account number."""
    bare = regex.sub(r"\s", "", account).upper()
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


_ID_WORDS = regex.compile(r"\b(?:sin|nas|social insurance|assurance sociale|insurance number)\b", regex.I)
_HEALTH_WORDS = regex.compile(r"\b(?:health|ohip|ramq|santé|medicare|maladie|card|carte)\b", regex.I)
_PASSPORT_WORDS = regex.compile(r"\b(?:passports?|passeports?)\b", regex.I)
_PHONE_WORDS = regex.compile(r"\b(?:tel|tél|phone|call|text|line|fax|cell|mobile|téléphone|appelez|dial|reach|ligne|numéro)\b", regex.I)
_NUMBER_WORDS = regex.compile(r"\b(?:file|reference|ref|petition|pétition|dossier|référence|account|invoice|order|docket|case|amount|audited|facture|commande|série|serial|tracking|isbn|issn|bill|page|annex)\b\W*(?:no\.?|number|n[o°]|numéro)?\W*$", regex.I)


def _numbers(text: str) -> Iterator[Span]:
    if "@" in text or "at" in text or "AT" in text or "à" in text or "arobase" in text.lower():
        # a local part has at most 64 characters, a domain 255
        for m in _matches(EMAIL, text, _windows(text, (m.span() for m in _SPELLED.finditer(text)), 80, 330)):
            yield Span(m.start(), m.end(), "email", 4.0)
    around = _windows(text, (m.span() for m in _DIGITS.finditer(text)), 48, 48)
    for m in _matches(HEALTH, text, around):
        near = text[max(0, m.start() - 40) : m.start()]
        score = (1.5 if luhn(m[1] + m[3] + m[4]) else -0.5) + 2.5 * bool(_HEALTH_WORDS.search(near)) - 2.0 * bool(_NUMBER_WORDS.search(near))
        yield Span(m.start(), m.end(), "id_number", score)
    for m in _matches(HEALTH_LETTERS, text, around):
        yield Span(m.start(), m.end(), "id_number", 2.0 * bool(_HEALTH_WORDS.search(text, max(0, m.start() - 40), m.start())))
    for m in _matches(SIN, text, around):
        near = text[max(0, m.start() - 40) : m.start()]
        score = (1.0 if luhn(m[1] + m[3] + m[4]) else -0.5) + 2.5 * bool(_ID_WORDS.search(near)) - 2.0 * bool(_NUMBER_WORDS.search(near)) + 0.5 * bool(m[2])
        yield Span(m.start(), m.end(), "id_number", score)
    for m in _matches(PASSPORT, text, around):
        near = text[max(0, m.start() - 30) : m.start()]
        yield Span(m.start(), m.end(), "id_number", 2.0 * bool(_PASSPORT_WORDS.search(near)) - 2.0 * bool(_NUMBER_WORDS.search(near)))
    for m in _matches(IBAN, text, around):
        if mod97(m[0]):
            yield Span(m.start(), m.end(), "account", 3.0)
    for m in _matches(PHONE, text, around):
        near = text[max(0, m.start() - 30) : m.start()]
        start = m.start() + _RUN_OF_DIGITS.search(m[0]).start()
        grouped = not m[0].lstrip("+").isdecimal()
        score = 1.5 + 0.5 * grouped + 1.5 * bool(_PHONE_WORDS.search(near)) - 2.5 * bool(_NUMBER_WORDS.search(near))
        yield Span(start, m.end(), "phone", score)


def _addresses(text: str) -> Iterator[Span]:
    numbers = (m.span() for m in _RUN_OF_DIGITS.finditer(text))
    anchors = ((a, b) for a, b in numbers if _STREET_AFTER.match(text, a) or _BOX_BEFORE.search(text, max(0, a - 16), a))
    for m in _matches(ADDRESS, text, _windows(text, anchors, 80, 330)):
        yield Span(m.start(), m.end(), "address", 2.5)


_NO_HEAD = NOT_NAMES | BODIES | PLACES


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of capitalised words that may hold a name, the sentences' ends apart."""
    for m in _CAPITALISED.finditer(text):
        tokens = m[0].split()
        if len(tokens) < 4:
            bare = [t.strip(".,'’-").lower() for t in tokens]
            if "m" not in bare:
                while bare and bare[0] in _NO_HEAD and len(bare[0]) > 1:
                    del bare[0]
                if len(bare) < 2 or (len(bare) == 2 and bare[1] in _NO_HEAD):
                    continue
        yield m.span()


def _names(text: str) -> Iterator[Span]:
    for low, high in _windows(text, _runs(text), 16, 1):
        yield from _names_between(text, low, high)


def _again(text: str, word: str, start: int, end: int) -> bool:
    """Whether a word stands in a text outside a stretch, not as a part of another or of an address."""
    at = text.find(word)
    while at >= 0:
        stop = at + len(word)
        if not start <= at < end and (not at or text[at - 1].isspace() or text[at - 1] in "('\"“«") and not regex.match(r"[\w@-]|\.\w", text[stop : stop + 2]):
            return True
        at = text.find(word, stop)
    return False


def _names_between(text: str, at: int, high: int) -> Iterator[Span]:
    while m := NAME.search(text, at, high):
        at = m.end()
        start, end = m.span("name")
        title = m["title"] is not None or bool(_TITLE_WORD.search(text, max(0, start - 12), start))
        parts = [(start + p.start(), p[0]) for p in _PART.finditer(m["name"])]
        low = [p.lower().strip(".'’") for _, p in parts]
        family_first = m["family"] is not None
        if family_first and not parts[0][1].isupper():
            follows = _FOLLOWING_GIVEN.match(text, end, min(len(text), end + 30))
            if follows and follows[1].lower() not in NOT_NAMES:
                at = parts[1][0]
                continue
        # words that no name holds part the phrase, and so does a place or body that it begins with
        bad = next((k for k, w in enumerate(low) if (w in NOT_NAMES or (w in TITLES and len(w) > 1)) and not (len(w) == 1 and parts[k][1].endswith("."))), None)
        if bad is not None:
            at = parts[bad][0] + len(parts[bad][1])
            if bad < 2 and not (bad == 1 and m["title"] == "M."):
                continue
            parts, low = parts[:bad], low[:bad]
            at = end = parts[-1][0] + len(parts[-1][1])
        heads = [k for k, w in enumerate(low) if (w in PLACES or w in BODIES) and k < len(low) - 1]
        if heads:
            at = parts[heads[-1]][0] + len(parts[heads[-1]][1])
            continue
        if len(parts) == 1 and m["title"] == "M." and BEFORE.search(text, max(0, m.start() - 30), m.start()):
            # after a signature or the like it is an initial, not the French title
            yield Span(m.start(), end, "name", 2.5)
            continue
        full = [w for (_, p), w in zip(parts, low, strict=True) if not (len(p) <= 2 and p[0].isupper() and p[1:] in ("", "."))]
        if len(parts) < 2 or not full:
            continue
        after = text[end : end + 40]
        if low[0] == "m" and len(parts) == 2 and _FRENCH_AFTER.match(after) and not BEFORE.search(text, max(0, start - 30), start):
            continue
        nxt = _NEXT.match(after)
        if full[-1] in BODIES or full[-1] in PLACES or any(w in BODIES for w in full) or (nxt and nxt[1][:1].isupper() and (nxt[1].lower() in BODIES or nxt[1].lower() in PLACES)):
            continue
        before = text[max(0, start - 30) : start]
        shouted = all(p.isupper() for _, p in parts if len(p) > 2)
        said = bool(BEFORE.search(before))
        score = 1.0 + 3.0 * title + 1.5 * said + 1.5 * bool(AFTER.search(after))
        score += 0.5 * any(len(p) <= 2 and p.endswith(".") for _, p in parts)
        if not title and DETERMINER.search(before):
            score -= 3.0
        if shouted and not title:
            context = text[max(0, start - 60) : start] + text[end : end + 60]
            if sum(c.isupper() for c in context) > 0.6 * max(1, sum(c.isalpha() for c in context)):
                score -= 1.5
        if family_first and not title and not parts[0][1].isupper():
            score -= 1.0
        elif family_first:
            score += 1.0
        if not title and not said and not shouted and any(_again(text, w, start, end) for w in full):
            score -= 2.0
        elif 1.0 <= score < LEAST and not family_first and not shouted:
            # nothing beside it tells, but none of its words is a common one
            score += 0.5 + 0.5 * _again(text, parts[-1][1], start, end)
        yield Span(parts[0][0], end, "name", score)


def find_spans(text: str | None) -> list[Span]:
    """Spans that reach the least score, in order, without overlaps; the surer kind wins."""
    if not text:
        return []
    rank = {kind: k for k, kind in enumerate(("email", "account", "phone", "id_number", "address", "name"))}
    proposed = sorted((s for find in (_numbers, _addresses, _names) for s in find(text) if s.score >= LEAST), key=lambda s: (rank[s.kind], s.start))
    covered = bytearray(len(text))
    taken: list[Span] = []
    for s in proposed:
        if not any(covered[s.start : s.end]):
            covered[s.start : s.end] = b"\x01" * (s.end - s.start)
            taken.append(s)
    return sorted(taken)


def redact(text: str | None) -> str | None:
    """The text with typed placeholders in place of what was found."""
    if text is None:
        return None
    out, at = [], 0
    for s in find_spans(text):
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(doc, s.kind, s.start) for doc, text in zip(pdf.doc_id, pdf.text, strict=True) for s in find_spans(text) if s.kind in KINDS]
        yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_at"])


def _redacted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf.doc_id, "text": pdf.text.map(redact)})


def personal_spans(documents: DataFrame) -> DataFrame:
    """Every personal value. ``documents``: doc_id, text. Returns doc_id, kind, start_at."""
    return documents.select("doc_id", "text").where("text is not null").mapInPandas(_found, "doc_id long, kind string, start_at int").distinct()


def redacted(documents: DataFrame) -> DataFrame:
    """Every document with its personal values replaced. Returns doc_id, text."""
    return documents.select("doc_id", "text").mapInPandas(_redacted, "doc_id long, text string")
