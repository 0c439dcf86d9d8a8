"""Text functions as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelspark.functions import patterns as P


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def or_empty(text: Column | str) -> Column:
    """Missing as the empty string."""
    return F.coalesce(_col(text), F.lit(""))


def or_else(text: Column | str, *others: Column | str) -> Column:
    """The first value that is neither null nor empty; other strings are literals."""
    chain = [F.nullif(_col(text), F.lit(""))]
    chain += [F.nullif(o, F.lit("")) if isinstance(o, Column) else F.lit(o) for o in others]
    return F.coalesce(*chain)


#: Fixed value: characters that count as white space at the ends of a text.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(_col(text), F.lit(WHITE))


def spaces(text: Column | str) -> Column:
    """Runs of white space as one blank, ends stripped."""
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def clean(text: Column | str) -> Column:
    """Tags and no-break spaces as blanks, white space collapsed; missing is empty."""
    return spaces(F.regexp_replace(or_empty(text), r"<[^>]+>", " "))


def clean_html(text: Column | str) -> Column:
    """Tags and named entities as blanks, white space collapsed; numeric entities stay."""
    return spaces(F.regexp_replace(F.regexp_replace(_col(text), r"<[^>]+>", " "), r"&\w+;", " "))


def untag(text: Column | str) -> Column:
    """Tags removed, which joins the words beside them."""
    return F.regexp_replace(_col(text), r"<[^>]+>", "")


def plain_spaces(text: Column | str) -> Column:
    """No-break spaces as blanks."""
    return F.translate(_col(text), "\u00a0", " ")


def match_key(text: Column | str) -> Column:
    """Comparison key: stripped, lower case, white space collapsed; missing is empty."""
    return F.lower(spaces(or_empty(text)))


def claim_key(text: Column | str) -> Column:
    """Comparison key of a claim: as above without one final period."""
    return F.rtrim(F.regexp_replace(F.lower(spaces(text)), r"\.$", ""))


def trim_words(text: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, cut before the last part word, with an ellipsis."""
    whole = spaces(text)
    hard = F.substring(whole, 1, limit - 3)
    soft = F.regexp_replace(F.regexp_replace(hard, r" [^ ]*$", ""), r"[,;: ]+$", "")
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.coalesce(F.nullif(soft, F.lit("")), hard), F.lit("...")))


def trim_hard(text: Column | str, limit: int) -> Column:
    """Cut at ``limit`` - 1 characters with an ellipsis, so up to ``limit`` + 2 long; missing is empty."""
    whole = spaces(or_empty(text))
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, limit - 1)), F.lit("...")))


def any_match(text: Column | str, family: Sequence[str]) -> Column:
    """Whether any pattern of a family is found."""
    return reduce(lambda a, b: a | b, (_col(text).rlike(p) for p in family))


def extract(text: Column | str, pattern: str, group: int = 1) -> Column:
    """A captured group, null where nothing matches."""
    return F.nullif(F.regexp_extract(_col(text), pattern, group), F.lit(""))


def speaker_party(who: Column | str) -> Column:
    """Party in the final parentheses of a speaker's label, else empty."""
    return F.regexp_extract(strip(or_empty(who)), P.SPEAKER_PARTY, 1)


def bill_number(text: Column | str) -> Column:
    """The bill a sentence names, in capitals, else null."""
    return F.upper(extract(text, P.BILL_NUMBER))


def vote_direction(text: Column | str) -> Column:
    """``for`` or ``against`` if the sentence uses exactly one of them, else null."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(_col(text), F.lit(P.VOTE_PHRASE), F.lit(1)), F.lower))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def code_direction(vote: Column | str) -> Column:
    """Y votes for, any other code against."""
    return F.when(_col(vote) == "Y", "for").otherwise("against")


def split_sentences(text: Column | str) -> Column:
    """Parts after a terminator and white space, stripped, without empty ones."""
    return F.filter(F.transform(F.split(or_empty(text), P.SENTENCE_GAP), strip), lambda s: s != "")


def vote_sentences(text: Column | str) -> Column:
    """Distinct stretches between terminators that hold a vote phrase, in order."""
    parts = F.transform(F.regexp_extract_all(_col(text), F.lit(r"[^.?!\n]+[.?!\n]?"), F.lit(0)), spaces)
    return F.array_distinct(F.filter(parts, lambda s: s.rlike(P.VOTE_PHRASE)))


def _around(parts: Column, hit: Column) -> Column:
    """The part with index ``hit`` (from 1) and its neighbours, joined."""
    return F.array_join(F.slice(parts, F.greatest(hit - 1, F.lit(1)), F.least(F.lit(3), F.when(hit == 1, 2).otherwise(3))), " ")


def _window(text: Column, at: Column, claim: Column, margin: int) -> Column:
    begin = F.greatest(at - margin, F.lit(1))
    return F.substring(text, begin, F.least(at - 1 + F.length(claim) + margin, F.length(text)) - begin + 1)


def local_context(context: Column | str, claim: Column | str, limit: int = 1200) -> Column:
    """Sentences around the first one that holds the claim; else a window; else the claim."""
    whole, said = or_empty(context), or_empty(claim)
    parts = split_sentences(whole)
    hit = F.array_position(F.transform(parts, lambda s: F.contains(s, said)), True).cast("int")
    at = F.instr(whole, said)
    return F.when(hit > 0, trim_words(_around(parts, hit), limit)).when(at > 0, trim_words(_window(whole, at, said, 400), limit)).otherwise(trim_words(said, limit))


def local_context_v2(context: Column | str, claim: Column | str, limit: int = 1200, offset_fallback: bool = True) -> Column:
    """A window around the exact claim; else the sentences around its normalised form; else (optionally) a window at its
    normalised offset; else the whole, cut."""
    whole, said = spaces(or_empty(context)), spaces(or_empty(claim))
    at = F.instr(whole, said)
    parts = F.split(whole, P.SENTENCE_GAP)
    hit = F.array_position(F.transform(parts, lambda s: F.contains(match_key(s), match_key(said))), True).cast("int")
    out = F.when(whole == "", said).when(said == "", trim_hard(whole, limit)).when(at > 0, trim_hard(_window(whole, at, said, 420), limit)).when(hit > 0, trim_hard(_around(parts, hit), limit))
    if offset_fallback:
        low = F.instr(match_key(whole), match_key(said))
        out = out.when(low > 0, trim_hard(_window(whole, low, said, 420), limit))
    return out.otherwise(trim_hard(whole, limit))


def claim_type(text: Column | str, with_vote: bool = True) -> Column:
    """Type by the first rule one of whose words occurs anywhere, as part of a word too."""
    low = F.lower(or_empty(text))
    out = None
    for name, words in P.CLAIM_TYPES:
        if name == "vote" and not with_vote:
            continue
        hit = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def flip_direction(text: Column | str) -> Column:
    """The first "voted for" or "voted against" turned round, ``for`` tried first; unchanged where none stands."""
    t = _col(text)
    forward = F.regexp_replace(t, r"(?is)^(.*?)\bvoted for\b", "$1voted against")
    backward = F.regexp_replace(t, r"(?is)^(.*?)\bvoted against\b", "$1voted for")
    return F.when(t.rlike(r"(?i)\bvoted for\b"), forward).otherwise(backward)


def replace_first(text: Column | str, old: str, new: str) -> Column:
    """The first occurrence of a literal replaced; unchanged where it does not stand."""
    t = _col(text)
    at = F.instr(t, old)
    return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.lit(new), F.substring(t, at + len(old), F.length(t)))).otherwise(t)


def unfence(text: Column | str) -> Column:
    """Without Markdown code fences around it."""
    bare = strip(text)
    return strip(F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def with_end(text: Column | str, mark: str) -> Column:
    """With an end-of-text mark, appended once."""
    return F.when(F.endswith(_col(text), F.lit(mark)), _col(text)).otherwise(F.concat(_col(text), F.lit(mark)))


def has_format(text: Column | str) -> Column:
    """Whether all four answer lines stand in a text; null counts as no."""
    lines = (P.VERDICT_STRICT, P.CONFIDENCE_LINE, P.EXPLANATION_LINE, P.CORRECTION_LINE)
    return F.coalesce(reduce(lambda a, b: a & b, (_col(text).rlike(p) for p in lines)), F.lit(False))


def fact_sentences(text: Column | str) -> Column:
    """Sentences of an untagged text that state facts and are longer than 20 characters."""
    return F.filter(split_sentences(untag(or_empty(text))), lambda s: any_match(s, P.EXTRACT_FACTS) & (F.length(s) > 20))


def usable_claim(text: Column | str) -> Column:
    """30 to 420 characters, no low-signal pattern, at least one fact pattern."""
    t = strip(or_empty(text))
    return F.length(t).between(30, 420) & ~any_match(t, P.SILVER_LOW_SIGNAL) & any_match(t, P.SILVER_FACTS)


def quality_claim(text: Column | str) -> Column:
    """30 to 500 characters, at least half of them ASCII letters, no procedural opening."""
    t = or_empty(text)
    letters = F.length(F.regexp_replace(t, r"[^a-zA-Z]", ""))
    return F.length(t).between(30, 500) & (letters * 2 >= F.length(t)) & ~any_match(t, P.PROCEDURAL)


def merge_candidate(text: Column | str) -> Column:
    """45 to 320 characters and none of the stock openings."""
    t = or_empty(text)
    return F.length(t).between(45, 320) & ~any_match(t, P.MERGE_LOW_SIGNAL)


def signal_score(text: Column | str) -> Column:
    """Cues of a claim between true and false: 3 for each family, -5 for each clean binary form, 2 and 1 more."""
    t = or_empty(text)
    terms = [F.when(t.rlike(p), 3).otherwise(0) for p in P.MIDDLE_CUES] + [F.when(t.rlike(p), -5).otherwise(0) for p in P.BINARY_CLEAN]
    terms += [F.when(t.rlike(P.NUMBER_UNIT), 2).otherwise(0), F.when(t.rlike(P.POPULATION), 1).otherwise(0)]
    return reduce(lambda a, b: a + b, terms)


def candidate_score(text: Column | str, kind: Column | str) -> Column:
    """The signal score with a bonus by claim type and for recency."""
    bonus = F.when(_col(kind).isin("economic", "general", "environmental", "health"), 2).when(_col(kind) == "vote", -2).when(_col(kind) == "legislative", 1).otherwise(0)
    return signal_score(text) + bonus + F.when(or_empty(text).rlike(P.RECENCY), 1).otherwise(0)
