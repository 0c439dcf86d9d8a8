"""Same or near-same records across splits: a weighted cosine join between train and the other splits.

*Vectors.* What the exact check (``same_record``) demands to be equal, verdict, numbers of the claim, direction of the vote, is
one term of a record's vector and holds ``KEY_SHARE`` of its squared norm; the words of the claim and of the context share
the rest evenly. The weights depend on the record alone, not on the corpus, so a cosine means the same at every size, and
instruction, evidence, confidence and the wording of explanations have no part in it.

*Lists.* A record lists its greatest terms until the norm of the rest is below the threshold: the key alone, since two
records without a common key reach at most 1 - ``KEY_SHARE`` by the norms of their rests. Keys that the other split lacks
are pruned, as no greatest weights of other terms make up for them. A list is parted by date where records have one.

*Dots.* The exact dot products of the pairs that meet decide. ``THRESHOLD`` follows from the edits allowed: with the key in common
a quarter of the claim's words alike reach it, and the check allows a quarter of them to differ, typos aside. The exact
check of claim, speaker, date, context and verdict comes last. A claim without numbers meets all those of its verdict,
direction and date.

Records equal in all words form classes; links are found between the classes' first records and never multiplied out, except
for ``overlaps``, which returns pairs of records.

Defined results: a null prompt and completion is no record; records equal in all words overlap; ties do not matter, since
every pair that qualifies is returned; a record is never paired with one of its own split's kind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from datetime import date
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.pairs import fields
from gavelspark.session import cut

#: Share of the squared norm of a record's vector that its key holds; the claim and the context have the rest in equal parts.
KEY_SHARE = 0.6
#: Least cosine of two candidates.
THRESHOLD = KEY_SHARE + (1 - KEY_SHARE) / 2 / 4

#: Labels of the prompts' sections, in English and French.
SECTIONS = {
    "claim": "claim", "affirmation": "claim", "statement": "claim", "speaker": "speaker", "intervenant": "speaker", "intervenante": "speaker", "date": "date",
    "bill": "bill", "projet de loi": "bill", "named party": "party", "party": "party", "parti nommé": "party", "parti": "party", "division": "division", "vote": "division",
    "context": "context", "contexte": "context", "evidence": "evidence", "preuve": "evidence", "preuves": "evidence",
}
MONTHS = {m: k % 12 + 1 for k, m in enumerate("january february march april may june july august september october november december janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split())}
_LABEL = re.compile(rf"(?<![^\s>])(?:[*_#>-]+\s*)?({'|'.join(sorted(SECTIONS, key=len, reverse=True))})\s*[*_]*\s*[:：]", re.I)
_INSTRUCTION = re.compile(r"(?:^|\s)(?:answer|reply|give|respond|répondez|donnez|return|output|write|provide)\b[^.]*\bverdict\b", re.I)
_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"\d+")


def bare(text: Column) -> Column:
    """Words of a text in lower case, one blank between them, digits grouped by blanks or commas put together."""
    low = F.regexp_replace(F.lower(text), r"(?<=\d)[, \u00a0\u202f](?=\d{3}(?!\d))", "")
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{M}\p{N}]+", " "))


def sections(prompt: str) -> dict[str, str]:
    """Labelled sections of a prompt; the instruction after the last one is left out."""
    marks = list(_LABEL.finditer(prompt))
    found: dict[str, str] = {}
    for k, mark in enumerate(marks):
        text = prompt[mark.end() : marks[k + 1].start() if k + 1 < len(marks) else len(prompt)]
        if k + 1 == len(marks) and (cut_at := _INSTRUCTION.search(text)):
            text = text[: cut_at.start()]
        found.setdefault(SECTIONS[re.sub(r"\s+", " ", mark[1].lower())], text.strip())
    return found


def _tokens(text: str) -> list[str]:
    return _WORD.findall(re.sub(r"(?<=\d)[,   ](?=\d{3}(?!\d))", "", text.lower()))


def _day(text: str) -> tuple:
    """A date in one form, whatever its style; else its words."""
    low = text.strip().lower()
    if m := re.search(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", low):
        return (int(m[1]), int(m[2]), int(m[3]))
    if m := re.search(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", low):
        return (int(m[3]), *sorted((int(m[1]), int(m[2])))) if int(m[1]) <= 12 and int(m[2]) <= 12 else (int(m[3]), *((int(m[1]), int(m[2])) if int(m[2]) > 12 else (int(m[2]), int(m[1]))))
    month = next((MONTHS[w] for w in re.findall(r"[^\W\d_]+", low) if w in MONTHS), None)
    numbers = [int(x) for x in _NUMBER.findall(low)]
    if month and len(numbers) >= 2:
        year = next((x for x in numbers if x > 31), 0)
        return (year, month, next((x for x in numbers if x <= 31), 0))
    return tuple(_tokens(low))


def _same_day(a: str, b: str) -> bool:
    x, y = _day(a), _day(b)
    return x == y or (len(x) == len(y) == 3 and all(isinstance(v, int) for v in (*x, *y)) and x[0] == y[0] and sorted(x[1:]) == sorted(y[1:]) and "-" not in (a + b))


def _like(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) > 3 and (sorted(a) == sorted(b) or SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.8))


def _unmatched(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """Words of either side without an equal or misspelt one on the other."""
    x, y = list((Counter(a) - Counter(b)).elements()), list((Counter(b) - Counter(a)).elements())
    for w in list(x):
        near = next((v for v in y if not w.isdigit() and _like(w, v)), None)
        if near is not None:
            x.remove(w)
            y.remove(near)
    # a word torn in two or two run together
    if "".join(x) == "".join(y):
        return [], []
    return x, y


def _directions(tokens: list[str]) -> list[str]:
    names = {"for": "for", "pour": "for", "against": "against", "contre": "against"}
    return [names[t] for k, t in enumerate(tokens) if t in names and k and re.match(r"vot|oppos", tokens[k - 1])]


def same_record(prompt_a: str | None, answer_a: str | None, prompt_b: str | None, answer_b: str | None) -> bool:
    """Whether two records make the same claim, of the same speaker and date, in the same context, with one verdict."""
    a, b = sections(prompt_a or ""), sections(prompt_b or "")
    va, vb = (_tokens(fields(x or "").get("verdict", ""))[:2] for x in (answer_a, answer_b))
    if va != vb:
        return False
    if not a.get("claim") or not b.get("claim"):
        ta, tb = _tokens(prompt_a or ""), _tokens(prompt_b or "")
        x, y = _unmatched(ta, tb)
        return bool(ta) and sorted(filter(str.isdigit, ta)) == sorted(filter(str.isdigit, tb)) and max(len(x), len(y)) <= 0.2 * min(len(ta), len(tb)) and _directions(ta) == _directions(tb)
    ca, cb = _tokens(a["claim"]), _tokens(b["claim"])
    if Counter(filter(str.isdigit, ca)) != Counter(filter(str.isdigit, cb)) or _directions(ca) != _directions(cb):
        return False
    x, y = _unmatched(ca, cb)
    if x or y:
        stated_a, stated_b = set(_tokens(a.get("evidence", "") + " " + a.get("party", ""))), set(_tokens(b.get("evidence", "") + " " + b.get("party", "")))
        if any(w in stated_a for w in x) and any(w in stated_b for w in y) or max(len(x), len(y)) > max(2, 0.25 * len(ca)):
            return False
    for name in ("bill", "party", "division"):
        if a.get(name) and b.get(name):
            x, y = _unmatched(_tokens(a[name]), _tokens(b[name]))
            if x and y:
                return False
    if a.get("speaker") and b.get("speaker"):
        x, y = _unmatched(_tokens(a["speaker"]), _tokens(b["speaker"]))
        if x and y:
            return False
    if a.get("date") and b.get("date") and not _same_day(a["date"], b["date"]):
        return False
    ka, kb = _tokens(a.get("context", "")), _tokens(b.get("context", ""))
    if ka and kb:
        x, y = _unmatched(ka, kb)
        return min(len(x), len(y)) <= 0.2 * min(len(ka), len(kb))
    return True


def record_keys(prompt: str | None, answer: str | None) -> list[tuple[str, str | None, bool]]:
    """Keys of a record with its date and whether it has a labelled claim: two records that ``same_record`` accepts share
    a key and, where both have one, the date. The key of the whole prompt is for pairs in which a claim is missing."""
    tokens = _tokens(prompt or "")
    if not tokens:
        return []
    found = sections(prompt)
    verdict = _tokens(fields(answer or "").get("verdict", ""))[:2]

    def key(kind: str, of: list[str]) -> str:
        return "|".join((kind, *(" ".join(part) for part in (verdict, sorted(filter(str.isdigit, of)), _directions(of)))))

    keys = [(key("prompt", tokens), None, bool(found.get("claim")))]
    if found.get("claim"):
        day = _day(found["date"]) if found.get("date") else None
        if day and all(isinstance(v, int) for v in day):
            day = (day[0], *sorted(day[1:]))  # as _same_day, which lets day and month change places
        keys.append((key("claim", _tokens(found["claim"])), None if day is None else repr(day), True))
    return keys


def record_vector(prompt: str, key: str) -> dict[tuple[str, str], float]:
    """Vector of a record under one of its keys: the key, and the words of claim and context, or of the whole prompt."""
    found = sections(prompt) if key.startswith("claim|") else {"claim": prompt}
    blocks = [(name, set(_tokens(found[name]))) for name in ("claim", "context") if found.get(name)]
    blocks = [(name, words) for name, words in blocks if words]
    vector = {("key", key): KEY_SHARE**0.5}
    for name, words in blocks:
        vector.update(dict.fromkeys(((name, w) for w in words), ((1 - KEY_SHARE) / len(blocks) / len(words)) ** 0.5))
    return vector


def cosine(a: dict, b: dict) -> float:
    """Exact dot product of two vectors of norm one."""
    return sum(w * b[t] for t, w in a.items() if t in b)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys = [[{"key": k, "day": d, "claimed": c} for k, d, c in record_keys(p, a)] for p, a in zip(pdf.prompt, pdf.completion, strict=True)]
        yield pdf[["pair_id", "side", "words"]].assign(keys=keys)


def keyed_records(pairs: DataFrame) -> DataFrame:
    """Records with a digest of their words and their keys, from one pass over the table. ``pairs``: pair_id, prompt,
    completion, split. Returns pair_id, side, words, keys."""
    text = F.concat_ws(" \u0001 ", F.coalesce("prompt", F.lit("")), F.coalesce("completion", F.lit("")))
    rows = pairs.where("prompt is not null or completion is not null").select(
        "pair_id", F.when(F.col("split") == "train", "train").otherwise("held").alias("side"), "prompt", "completion", F.md5(bare(text)).alias("words"),
    )
    return rows.mapInPandas(_keyed, "pair_id long, side string, words string, keys array<struct<key:string,day:string,claimed:boolean>>")


def listed_pairs(vectors: DataFrame) -> DataFrame:
    """Pairs of a train and a held-out class that meet in a list. ``vectors``: class, key, day, claimed, in_train, in_held.
    Returns train_class, held_class, key."""
    train = vectors.where("in_train").select("key", "day", F.col("class").alias("train_class"), F.col("claimed").alias("claimed_t"))
    held = vectors.where("in_held").select("key", "day", F.col("class").alias("held_class"), F.col("claimed").alias("claimed_h"))
    dated = train.join(held, ["key", "day"])
    one = train.where("day is null").join(held.drop("day"), "key")
    other = train.where("day is not null").drop("day").join(held.where("day is null"), "key")
    met = dated.unionByName(one).unionByName(other)
    # two records with claims meet in the key of their claims only
    once = ~F.startswith("key", F.lit("prompt|")) | ~(F.col("claimed_t") & F.col("claimed_h"))
    return met.where(once & (F.col("train_class") != F.col("held_class"))).select("train_class", "held_class", "key")


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = zip(pdf.key, pdf.train_prompt, pdf.train_completion, pdf.held_prompt, pdf.held_completion, strict=True)
        found = [cosine(record_vector(p, k), record_vector(q, k)) >= THRESHOLD - 1e-9 and same_record(p, a, q, b) for k, p, a, q, b in texts]
        yield pdf.loc[found, ["train_class", "held_class"]]


def overlap_classes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with their class (pair_id, side, class), and the links between a train and a held-out class (train_class,
    held_class; a class in both splits is linked to itself). ``pairs``: pair_id, prompt, completion, split. Both are written tables."""
    records = cut(keyed_records(pairs))
    classes = records.groupBy("words").agg(F.min("pair_id").alias("class"), F.max(F.col("side") == "train").alias("in_train"), F.max(F.col("side") == "held").alias("in_held"), F.min_by("keys", "pair_id").alias("keys"))
    vectors = classes.select("class", "in_train", "in_held", F.explode("keys").alias("k")).select("class", "in_train", "in_held", "k.*")
    members = cut(records.select("pair_id", "side", "words").join(classes.select("words", "class"), "words").select("pair_id", "side", "class"))
    # written tables have a size that the optimizer knows, so texts are shuffled only for many pairs
    met = cut(listed_pairs(vectors))
    texts = lambda side: pairs.select(F.col("pair_id").alias(f"{side}_class"), F.col("prompt").alias(f"{side}_prompt"), F.col("completion").alias(f"{side}_completion"))
    half = cut(texts("train").join(met, "train_class"))
    linked = texts("held").join(half, "held_class").mapInPandas(_linked, "train_class long, held_class long")
    equal = classes.where("in_train and in_held").select(F.col("class").alias("train_class"), F.col("class").alias("held_class"))
    return members, cut(linked.unionByName(equal).distinct())


def overlaps(pairs: DataFrame) -> DataFrame:
    """Overlapping records of train and the other splits, each pair of records. ``pairs``: pair_id, prompt, completion, split.

    Returns pair_id_a, pair_id_b (a < b).
    """
    members, links = overlap_classes(pairs)
    train = members.where("side = 'train'").select(F.col("class").alias("train_class"), F.col("pair_id").alias("train_id"))
    held = members.where("side = 'held'").select(F.col("class").alias("held_class"), F.col("pair_id").alias("held_id"))
    met = links.join(train, "train_class").join(held, "held_class")
    return met.select(F.least("train_id", "held_id").alias("pair_id_a"), F.greatest("train_id", "held_id").alias("pair_id_b")).distinct()


def overlap_links(pairs: DataFrame) -> DataFrame:
    """Every record with its class and the number of classes of the other side that it is linked to: pair_id, side, class,
    n_links. A group of copies of any size is not multiplied out."""
    members, links = overlap_classes(pairs)
    ends = links.select(F.explode(F.array(F.struct(F.lit("train").alias("side"), F.col("train_class").alias("class")), F.struct(F.lit("held").alias("side"), F.col("held_class").alias("class")))).alias("e"))
    n = ends.groupBy("e.side", "e.class").agg(F.count("*").alias("n_links"))
    return members.select("pair_id", "side", "class").join(n, ["side", "class"], "left").select("pair_id", "side", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Held-out records that train also holds, per split and source, counted by their classes."""
    linked = overlap_links(pairs).where("side = 'held' and n_links > 0").select("pair_id").distinct()
    held = pairs.where("split is null or split <> 'train'").select("pair_id", "split", "source_dataset")
    return held.join(linked, "pair_id", "left_semi").groupBy("split", "source_dataset").agg(F.countDistinct("pair_id").alias("n_records"))
