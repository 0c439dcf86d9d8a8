"""Filling fixed-capacity containers with texts.

Minimum bin slack over the histogram of lengths: the longest length left is fixed, a bitset subset-sum finds the fullest
combination with the lengths available, and the combination is removed as often as the counts allow. Each combination
uses up at least one length, so there are at most ``capacity`` combinations of at most sqrt(2 * capacity) lengths each,
whatever the number of texts: only the histogram and this plan pass through the driver. Texts of one length are ranked
in salted parts, and their rank gives their place in the plan.

Defined results: null and empty texts need no room and have no row; a text longer than a container is cut at word or
character borders, all its pieces but the last about full; repeated texts are packed each; an empty table packs nothing.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.operators.ranking import salted_rank
from gavelspark.session import cut

CAPACITY = 2048
TOKENIZERS = os.environ.get("GAVEL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the public byte-pair vocabularies part a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Greatest size of a vocabulary file; it goes out to every task.
VOCABULARY_BYTES = 16 << 20


def vocabulary_file(path: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> bytes:
    """A rank file; only the driver needs to have it."""
    with open(os.path.join(path, vocabulary), "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {VOCABULARY_BYTES} bytes")
    return data


def encoding(data: bytes):
    """A public byte-pair tokenizer from its rank file."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, encode, capacity: int) -> list[tuple[int, int, int]]:
    """Pieces (start, end, tokens) of a text, one unless it is longer than a container."""
    tokens = len(encode(text))
    if tokens <= capacity:
        return [(0, len(text), tokens)] if tokens else []
    out, at, rest = [], 0, tokens
    while at < len(text):
        end = len(text)
        if rest > capacity:
            # as many characters as the remaining text holds in one container, then fitted
            end = min(len(text), at + max(1, int((len(text) - at) * capacity / rest)))
            n = len(encode(text[at:end]))
            for _ in range(12):
                step = int((end - at) * (capacity - n) / max(n, 1))
                if 0 <= capacity - n <= 2 or (n < capacity and (end == len(text) or step < 1)):
                    break
                end = min(len(text), max(at + 1, end + (step if step else -1)))
                n = len(encode(text[at:end]))
            while n > capacity and end > at + 1:
                end = max(at + 1, end - max(1, n - capacity))
                n = len(encode(text[at:end]))
            space = text.rfind(" ", at + (end - at) * 9 // 10, end)
            if space > at and end < len(text) and text[end : end + 1].isalnum() and (m := len(encode(text[at:space]))) >= n - 6:
                end, n = space, m
        else:
            n = len(encode(text[at:end]))
            if n > capacity:
                rest = n
                continue
        out.append((at, end, n))
        rest = max(len(encode(text[end:])), 1) if end < len(text) and len(text) - end < 8 * capacity else max(rest - n, capacity + 1)
        at = end
    return out


def fullest(counts: Mapping[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths that leaves the least of ``room``: length -> how many."""
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many containers are filled with each; every counted text is in one."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = fullest(left, capacity - longest)
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[n] // k for n, k in combination.items())
        for n, k in combination.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((combination, times))
    return out


def places(filled: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by rank: the first rank of each stretch, its first container, and the copies per container."""
    stretches: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    container = 0
    for combination, times in filled:
        for n, k in combination.items():
            at = used.get(n, 0)
            stretches.setdefault(n, []).append((at, container, k))
            used[n] = at + k * times
        container += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for n, rows in stretches.items()}


def text_pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all texts with their tokens. ``documents``: doc_id, text. Returns doc_id, piece, start_at, end_at, n_tokens."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary_file(tokenizers, vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(shared.value).encode_ordinary
        for pdf in batches:
            rows = [(doc, k, *piece) for doc, text in zip(pdf.doc_id, pdf.text, strict=True) for k, piece in enumerate(pieces(text, encode, capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start_at", "end_at", "n_tokens"])

    rows = documents.select("doc_id", "text").where("text is not null and text <> ''")
    return rows.mapInPandas(run, "doc_id long, piece int, start_at int, end_at int, n_tokens int")


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Items with their container. ``items``: any columns with doc_id, piece and n_tokens of 1 to ``capacity``."""
    items = cut(items)
    histogram = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    shared = items.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))

    @F.pandas_udf("long")
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.empty(len(length), dtype=np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(lengths):
            here = lengths == n
            first, base, copies = shared.value[int(n)]
            k = np.searchsorted(first, ranks[here], side="right") - 1
            out[here] = base[k] + (ranks[here] - first[k]) // copies[k]
        return pd.Series(out)

    named = items.withColumn("_id", F.struct("doc_id", "piece"))
    return salted_rank(named, ["n_tokens"], "_id").withColumn("container", container("n_tokens", "rank")).drop("_id", "rank")


def packed_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """All texts in containers. Returns doc_id, piece, start_at, end_at, n_tokens, container."""
    return packed(text_pieces(documents, capacity, tokenizers, vocabulary), capacity)
