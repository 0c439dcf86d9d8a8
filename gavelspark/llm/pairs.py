"""Broken prompt and response pairs.

1. *Shortened versions.* Answers are range-sorted by text (numbers masked) and every answer is compared with its
   neighbour: a proper prefix of the next distinct text is a shortened version of it. The same is done with the texts
   of the last field of each answer, since most answers differ earlier. The sort is a range shuffle; the text that
   follows a partition's last one comes from a table with one row per partition.
2. *Length limits.* A length at which far more different unfinished answers end than at the lengths around it is a limit.
3. *Rules* for empty, refused, copied and foreign answers, and for what 1 and 2 found, in that order; every pair gets at
   most one defect. The rules read every pair once; what depends on 1 and 2 is settled afterwards by joins on hashes, for
   the few pairs that it can decide.

Defined results: a null or blank answer is ``empty``; with a null prompt nothing can be a copy or in another language;
repeated pairs are judged alike; an empty table gives no rows; answers of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.llm import languages
from gavelspark.session import cut

#: A length is a limit if so many times more unfinished answers end there than on average at the ten lengths around it, and
#: so many standard deviations more.
SPIKE_RATIO = 8.0
SPIKE_SIGMA = 6.0
#: Share of an answer's words that must stand in runs of at least COPY_RUN words of the prompt.
COPY_SHARE = 0.85
COPY_RUN = 5

#: The labels of the answer format, in order.
LABELS = ("verdict", "confidence", "explanation", "correction")
#: Ways to say that a field does not apply.
NOT_APPLICABLE = frozenset({"n/a", "na", "s. o.", "s.o.", "s o", "so", "none", "-", "aucune", "null", "nil", "n. a.", "sans objet", "not applicable"})
#: Wordings by which an answer declines.
REFUSAL = regex.compile(
    r"\b(?:i|we)\b['’]?\s*(?:(?:am|['’]?m|are)\s+)?(?:sorry|unable|not (?:able|allowed|permitted|in a position)|afraid)"
    r"|\b(?:i|we)\s+(?:must |have to |will |would )?(?:respectfully )?(?:decline|refuse)\b"
    r"|\b(?:i|we|it)\s*(?:cannot|can ?not|can['’]?t|could not|couldn['’]?t|will not|won['’]?t|would not|may not|do not|don['’]?t)\b"
    r"|\bi have no (?:opinion|view|answer)\b|\b(?:my|our) (?:guidelines|policy|policies|rules|remit|instructions|training)\b"
    r"|\b(?:per|against|under) (?:our |my )?policy\b|\bno (?:comment|assessment|answer|verdict|finding) (?:on|can|was|is|could)\b"
    r"|\bas an? (?:\w+ )?(?:assistant|ai|language model)\b|\b(?:not be|isn['’]?t|is not) appropriate\b|\bfalls? outside\b|\bbeyond (?:my|our|the)\b"
    r"|\blet['’]?s talk about\b|\bsomething else instead\b|\b(?:was|is|been) blocked\b|\bhuman reviewer\b|\bqualified source\b"
    r"|\bje (?:ne (?:peux|puis|suis)|refuse|regrette|suis désolé|dois refuser|décline)\b|\b(?:désolée?|malheureusement)\b|\ben tant qu['’](?:assistant|ia)\b|\bil ne serait pas approprié\b|\baucune? (?:évaluation|réponse|verdict)\b"
    r"|^\s*(?:sorry|unfortunately|regrettably|apologies)\b",
    regex.I,
)
_LABEL = regex.compile(r"(?<![\p{L}/\[])(verdict|confidence|explanation|correction)\s*[:：]", regex.I)
_TAG = regex.compile(r"<[^<>]*>")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_DECIDED = regex.compile(r"\b(?:true|false|vrai|faux|half-true|mostly|barely-true|pants-fire)\b", regex.I)
_LEAD_IN = regex.compile(r"^\s*(?:>|(?:claim|answer|q|a|question|response|réponse|affirmation|statement|quote)\s*[:：])\s*", regex.I)
_FINISHED = regex.compile(r"[.!?…。！？।][\s\"'”’»)\]]*$")
_PLACEHOLDER = re.compile(r"\s*\[")
_FIGURES = re.compile(r"[\d\s%]*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_BEGUN = re.compile(r"(?i)\s*v(?:e(?:r(?:d(?:i(?:c(?:t\s*:?)?)?)?)?)?)?\s*$")


def masked(text: Column) -> Column:
    """Comparison form of an answer: lower case, single blanks, every number one sign."""
    low = F.lower(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(low, r"[0-9]+", "0"))


def last_field(text: Column) -> Column:
    """The last labelled field of a masked answer with its label; the whole answer where no label stands."""
    return F.regexp_extract(text, r"(?s)^(?:.*(?<![\p{L}/\[]))?((?:verdict|confidence|explanation|correction) ?:.*)$", 1)


def shortened(texts: DataFrame) -> DataFrame:
    """Distinct texts that are a proper prefix of their neighbour in sorted order. ``texts``: t. Returns t."""
    distinct = texts.where("t is not null and t <> ''").select("t").distinct()
    # written once, so that every use sees the same ranges, also after an executor is lost
    ranged = cut(distinct.repartitionByRange("t").withColumn("pid", F.spark_partition_id()))
    firsts = ranged.groupBy("pid").agg(F.min("t").alias("first"))
    # one row per partition: the first text of the next partition that has any
    following = firsts.select((F.lead("pid").over(Window.orderBy("pid"))).alias("next_pid"), F.col("pid"), F.lead("first").over(Window.orderBy("pid")).alias("after"))
    order = Window.partitionBy("pid").orderBy("t")
    neighbour = F.coalesce(F.lead("t").over(order), F.col("after"))
    return ranged.join(F.broadcast(following.select("pid", "after")), "pid", "left").withColumn("next", neighbour).where(F.startswith("next", "t")).select("t")


def unfinished(text: Column) -> Column:
    """An answer that ends without a final mark."""
    return ~text.rlike(r"[.!?…。！？।][\s\"'”’»)\]]*$")


def limit_lengths(answers: DataFrame) -> DataFrame:
    """Lengths at which answers were cut by a limit. ``answers``: of those without a final mark the length n and the form
    (equal for answers that say the same). Returns n.

    Answers of one form count once: a stock answer is no limit, however often it is given.
    """
    ends = answers.select("n", "form").distinct().groupBy("n").agg(F.count("*").alias("c"))
    near = ends.select(F.explode(F.sequence(F.col("n") - 5, F.col("n") + 5)).alias("n"), F.col("n").alias("of"), "c")
    around = near.where("n <> of").groupBy("n").agg((F.sum("c") / 10).alias("level"))
    level = F.coalesce("level", F.lit(0.0))
    return ends.join(around, "n", "left").where((F.col("c") >= SPIKE_RATIO * level) & (F.col("c") - level >= SPIKE_SIGMA * F.sqrt(level + 1))).select("n")


def fields(answer: str) -> dict[str, str]:
    """Labelled fields of an answer in their first occurrence."""
    marks = list(_LABEL.finditer(answer))
    found: dict[str, str] = {}
    for mark, following in zip(marks, [*marks[1:], None], strict=False):
        found.setdefault(mark[1].lower(), answer[mark.end() : following.start() if following else len(answer)].strip())
    return found


def _blank(text: str) -> bool:
    return text.strip().lower() in NOT_APPLICABLE or not _WORD.search(text)


def copied_share(words: list[str], prompt: list[str], run: int = COPY_RUN) -> float:
    """Share of ``words`` that stand in runs of ``run`` or more words of the prompt (all words, if fewer)."""
    run = min(run, len(words))
    known = set(prompt)
    # words that the prompt lacks are in no run
    if not run or sum(w in known for w in words) < COPY_SHARE * len(words):
        return 0.0
    grams = {tuple(prompt[i : i + run]) for i in range(len(prompt) - run + 1)}
    covered = [False] * len(words)
    for i in range(len(words) - run + 1):
        if tuple(words[i : i + run]) in grams:
            covered[i : i + run] = [True] * run
    return sum(covered) / len(words)


def _words(text: str) -> list[str]:
    low = text.lower()
    return _ASCII_WORD.findall(low) if low.isascii() else _WORD.findall(low)


#: What a defect may depend on beside the pair itself: a longer neighbour of the answer, one of its last field, a length limit.
SHORT, SHORT_END, AT_LIMIT = 1, 2, 4


def examine(prompt: str | None, answer: str | None) -> tuple[str | None, int]:
    """The one defect of a pair, or None; with ``truncated`` the findings (a sum of SHORT, SHORT_END and AT_LIMIT) of which
    one must hold, 0 if none need."""
    text = _TAG.sub(" ", answer) if answer and "<" in answer else answer or ""
    if _blank(text):
        return "empty", 0
    found = fields(text)
    explanation = found.get("explanation", "")
    labelled = "verdict" in found and not _PLACEHOLDER.match(found["verdict"])
    decided = labelled and bool(_DECIDED.search(found["verdict"]))
    if found and all(_blank(v) or _FIGURES.fullmatch(v) for v in found.values()) and not text[: _LABEL.search(text).start()].strip():
        return "empty", 0
    said = explanation if labelled and explanation else text
    bare = languages.unquoted(said)
    if not decided and REFUSAL.search(bare):
        return "refusal", 0
    if decided and explanation and (parts := [s for s in _SENTENCE.split(bare.strip()) if s]) and all(REFUSAL.search(s) for s in parts):
        return "refusal", 0
    source = _words(prompt or "")
    words = _words(_LEAD_IN.sub("", said))
    if source and len(words) >= 3 and (not labelled or explanation) and copied_share(words, source) >= COPY_SHARE:
        return "copy", 0
    if prompt:
        expected, spoken = languages.guess(languages.unquoted(prompt)), languages.guess(bare if _WORD.search(bare) else said)
        if expected and spoken and expected != spoken and not (spoken not in ("en", "fr", "other") and len(words) < 4):
            return "language", 0
    if not labelled:
        if _BEGUN.match(text):
            return "truncated", 0
        if _DECIDED.search(text) or not _asks_verdict(prompt):
            return "truncated", AT_LIMIT if _FINISHED.search(text.strip()) else AT_LIMIT | SHORT
        return "refusal", 0  # the verdict asked for is not given
    correction = found.get("correction")
    if not correction:
        return "truncated", 0
    if correction.lower() in NOT_APPLICABLE or correction.rstrip(".").lower() in NOT_APPLICABLE:
        return None, 0
    if _FINISHED.search(correction):
        return ("truncated", SHORT_END) if len(correction) <= 3 else (None, 0)
    return "truncated", SHORT | SHORT_END | AT_LIMIT


def _asks_verdict(prompt: str | None) -> bool:
    return prompt is not None and "verdict" in prompt.lower()


def judge(prompt: str | None, answer: str | None, short: bool, short_end: bool, at_limit: bool) -> str | None:
    """The one defect of a pair, or None, with what is known of its neighbours and length."""
    defect, needs = examine(prompt, answer)
    return None if needs and not needs & (SHORT * short | SHORT_END * short_end | AT_LIMIT * at_limit) else defect


def _examined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [examine(p, a) for p, a in zip(pdf.prompt, pdf.completion, strict=True)]
        out = pdf[["pair_id", "t_hash", "end_hash", "n"]].assign(defect=[d for d, _ in found], needs=[k for _, k in found])
        yield out.dropna(subset="defect")


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """Defective pairs with their defect. ``pairs``: pair_id, prompt, completion. Returns pair_id, defect."""
    t = masked(F.col("completion"))
    end = F.nullif(last_field(F.col("t")), F.lit(""))
    hashed = pairs.select("pair_id", "prompt", "completion", t.alias("t")).select("pair_id", "prompt", "completion", F.xxhash64("t").alias("t_hash"), F.xxhash64(end).alias("end_hash"), F.length("completion").alias("n"))
    found = cut(hashed.mapInPandas(_examined, "pair_id long, t_hash long, end_hash long, n int, defect string, needs int"))
    sure, open_ = found.where("needs = 0"), found.where("needs > 0")
    # written once: the sorts below read their input twice, to find the ranges and to part the rows
    answers = cut(pairs.where("completion is not null").select(t.alias("t"), "completion").select("t", end.alias("end"), F.length("completion").alias("n"), unfinished(F.col("completion")).alias("open")))
    whole = shortened(answers).select(F.xxhash64("t").alias("t_hash"), F.lit(SHORT).alias("short"))
    ends = shortened(answers.select(F.col("end").alias("t"))).select(F.xxhash64("t").alias("end_hash"), F.lit(SHORT_END).alias("short_end"))
    limits = limit_lengths(answers.where("open").select("n", F.xxhash64("t").alias("form"))).withColumn("at_limit", F.lit(AT_LIMIT))
    marked = open_.join(whole, "t_hash", "left").join(ends, "end_hash", "left").join(limits, "n", "left")
    holds = F.coalesce("short", F.lit(0)) + F.coalesce("short_end", F.lit(0)) + F.coalesce("at_limit", F.lit(0))
    settled = marked.where(F.col("needs").bitwiseAND(holds) > 0)
    return sure.select("pair_id", "defect").unionByName(settled.select("pair_id", "defect")).distinct()
