"""Evaluation texts leaking into training text.

Greedy string tiling between documents and held-out items that share seeds, runs of ``SEED`` words hashed by a running
Karp-Rabin sum:

1. *Counts.* The occurrences in the whole corpus of every seed of an item are summed.
2. *Seeds.* Of every ``LEAST_WORDS`` consecutive words of an item the ``CHOSEN`` disjoint seeds with the fewest occurrences
   are looked for, so that frequent seeds (boilerplate) are left out wherever rarer ones stand beside them. ``EDITS`` words
   changed, dropped or added spoil at most as many disjoint seeds, so a passage always keeps one of them.
3. *Join.* The seeds that a document holds are joined to the items in SQL; an item with a seed in common is a candidate. It is
   tiled where ``LEAST_WORDS`` of its words near one diagonal hold as many runs of ``SHORT`` words, of any frequency, as
   ``EDITS`` words leave whole.
4. *Tiles.* The longest runs of equal words that do not overlap are marked, longer ones first; tiles apart by single changed,
   dropped or added words make passages, and the words in tiles of ``COVER_RUN`` or more make the item's coverage, in
   whatever order they stand.

Tasks that look for seeds hold a bitmap of 2 ** ``BITS`` bits, which more seeds pass by chance the more items there are;
tasks that tile hold the words of a block of about ``BLOCK`` items and read only documents with candidates among them.

Defined results: null texts hold and are nothing; items shorter than ``LEAST_WORDS`` cannot leak; repeated documents and
repeated items are each reported; texts are read whole, markup and page footers aside.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.session import cut

LEAST_WORDS = 24
SEED = 5
#: Words changed, dropped or added among LEAST_WORDS that no candidate is lost by.
EDITS = 3
#: Disjoint seeds chosen among LEAST_WORDS words.
CHOSEN = EDITS + 1
#: Length of the runs of words that are counted near one diagonal before an item is tiled.
SHORT = 4
#: Width of a stripe of diagonals; stripes overlap by half.
BAND = 8
#: Most words that may lie between two tiles of one passage: in the item, and in the document (a footer adds some).
GAP_ITEM, GAP_DOCUMENT = 1, 3
#: Least share of a passage's item words that are equal in the document.
LEAST_SHARE = 0.85
#: Least length of the tiles that count as coverage, and least share of an item that they cover in another order.
COVER_RUN = 8
LEAST_COVER = 0.8
#: Bits of the map of seeds that every task holds (2 MB), and tasks that make one.
BITS = 24
BITMAP_TASKS = 4
#: Items whose words a task that tiles holds.
BLOCK = 5000
#: Characters hashed at a time.
CHUNK = 1 << 19

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_FOOTER = re.compile(r"(?m)^[ \t]*(?:[-–—][ \t]*)?page[ \t]+\d+(?:[ \t]*(?:of|de|sur|/)[ \t]*\d+)?[ \t]*(?:[-–—][ \t]*)?$")
_INNER, _BLANK, _LETTER, _DIGIT = 1, 2, 3, 4

_U = np.uint64
_BASE, _STEP, _SPREAD, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each character is to a word."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    kinds[[c for c in range(len(kinds)) if chr(c).isalnum()]] = _LETTER
    kinds[[c for c in range(len(kinds)) if chr(c).isdecimal()]] = _DIGIT
    kinds[[ord(c) for c in ".,'’‑–-"]] = _INNER
    kinds[[ord(c) for c in "   "]] = _BLANK
    return kinds


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=_U)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _grown(n: int) -> int:
    """A size from few, so that tables of powers are made seldom."""
    return max(CHUNK, 1 << (n - 1).bit_length()) if n else CHUNK


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(_MIX)
    return h ^ (h >> _U(29))


def _plain(text: str) -> str:
    """In lower case, without tags and page footers."""
    low = (_TAG.sub(" ", text) if "<" in text else text).lower()
    return _FOOTER.sub(" ", low) if "page" in low else low


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, one text after another, and the place of each text's first word (one more at the end).

    A word is letters and digits; points, commas, hyphens and apostrophes inside it and blanks that group digits are
    dropped. The hash is a running sum over all characters, so the time is that of a few passes over them.
    """
    low = [_plain(t) for t in texts]
    code = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.concatenate((_kinds()[code], np.zeros(4, dtype=np.uint8)))
    at = np.flatnonzero(kind >= _LETTER)
    edges = np.cumsum([0, *(len(t) + 1 for t in low)])
    if not len(at):
        return np.zeros(0, dtype=_U), np.zeros(len(texts) + 1, dtype=np.int64)
    gap = np.diff(at) - 1
    marks = np.cumsum(kind == _INNER, dtype=np.int32)[at]
    inside = np.diff(marks) == gap
    one = np.flatnonzero(gap == 1)
    a, b = at[one], at[one + 1]
    digits = kind == _DIGIT
    inside[one] |= (kind[a + 1] == _BLANK) & digits[a] & digits[b] & digits[b + 1] & digits[b + 2] & ~digits[b + 3]
    first = np.flatnonzero(np.concatenate(([True], ~inside)))
    power, inverse = _powers(_BASE, _grown(len(at) + 1))
    value = _mixed((code[at].astype(_U) + _U(1)) * _U(_SPREAD))
    sums = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(value * power[: len(at)], dtype=_U)))
    words = (sums[np.append(first[1:], len(at))] - sums[first]) * inverse[first]
    return _mixed(words), np.searchsorted(at[first], edges)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` words, from running sums."""
    if len(words) < size:
        return np.zeros(0, dtype=_U)
    power, inverse = _powers(_STEP, _grown(len(words) + 1))
    sums = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(words * power[: len(words)], dtype=_U)))
    return _mixed((sums[size:] - sums[:-size]) * inverse[: len(words) - size + 1])


def seeds(words: np.ndarray, begins: np.ndarray, size: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words that lie within one text, and the places of their first words."""
    found = run_hashes(words, size)
    whole = np.ones(len(found), dtype=bool)
    for k in range(1, size):
        across = begins[1:] - k
        whole[across[(across >= 0) & (across < len(found))]] = False
    places = np.flatnonzero(whole)
    return found[places], places


def chunks(texts: list[str], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Stretches of a list of texts of about CHUNK characters, and of at most ``most`` texts."""
    begin, n = 0, 0
    for k, text in enumerate(texts):
        if k > begin and (n + len(text) > CHUNK or (most and k - begin >= most)):
            yield begin, k
            begin, n = k, 0
        n += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _listed(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether the map holds each seed, or one that shares its bit."""
    place = (found >> _U(64 - BITS)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def item_words(items: DataFrame) -> DataFrame:
    """Items of enough words. ``items``: item_id, text. Returns row, item_id, words; a row for each distinct item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, begins = word_hashes(list(pdf.text))
            parts = [words[a:b].view(np.int64) for a, b in zip(begins[:-1], begins[1:], strict=True)]
            yield pdf[["row", "item_id"]].assign(words=parts)[[len(p) >= LEAST_WORDS for p in parts]]

    once = items.where("text is not null").select(F.xxhash64("item_id", "text").alias("row"), "item_id", "text").distinct()
    return once.mapInPandas(run, "row long, item_id long, words array<long>")


def item_seeds(words: DataFrame) -> DataFrame:
    """All seeds of items. ``words``: from ``item_words``. Returns row, pos, seed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, w in zip(pdf.row, pdf.words, strict=True):
                found = run_hashes(np.asarray(w, dtype=np.int64).view(_U), SEED)
                yield pd.DataFrame({"row": row, "pos": np.arange(len(found), dtype=np.int32), "seed": found.view(np.int64)})

    return words.select("row", "words").mapInPandas(run, "row long, pos int, seed long")


def seed_map(seeds_of: DataFrame) -> np.ndarray:
    """Bitmap of seeds; BITMAP_TASKS maps of a fixed size reach the driver, however many seeds there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << (BITS - 3), dtype=np.uint8)
        for pdf in batches:
            place = (pdf.seed.to_numpy(dtype=np.int64).view(_U) >> _U(64 - BITS)).astype(np.int64)
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        yield pd.DataFrame({"bits": [bits.tobytes()]})

    out = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for r in seeds_of.select("seed").coalesce(BITMAP_TASKS).mapInPandas(run, "bits binary").collect():
        out |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def seed_counts(documents: DataFrame, bits: np.ndarray) -> DataFrame:
    """Occurrences in the corpus of the seeds of a map. Returns seed, n."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in total]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in total])).astype(np.int64)

        for pdf in batches:
            texts = list(pdf.text)
            for a, b in chunks(texts):
                found, _ = seeds(*word_hashes(texts[a:b]))
                total.append(np.unique(found[_listed(shared.value, found)], return_counts=True))
                if len(total) > 16:
                    total = [summed()]
                    if len(total[0][0]) > 1 << 20:
                        yield pd.DataFrame({"seed": total[0][0].view(np.int64), "n": total[0][1]})
                        total = []
        if total:
            keys, n = summed()
            yield pd.DataFrame({"seed": keys.view(np.int64), "n": n})

    return documents.select("text").mapInPandas(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))


def choose(costs: list[int]) -> list[int]:
    """Places of seeds such that every LEAST_WORDS words hold CHOSEN disjoint ones, from left to right the cheapest beside
    those chosen already. ``costs``: of the seed at every place."""
    reach = LEAST_WORDS - SEED + 1
    chosen: set[int] = set()
    for start in range(len(costs) - reach + 1):
        # best[k]: (cost, places) of k disjoint seeds that end by now, with those SEED places ago
        history: list[list[tuple[float, tuple[int, ...]] | None]] = [[(0.0, ()), *[None] * CHOSEN]] * SEED
        for p in range(start, start + reach):
            cost = 0.0 if p in chosen else costs[p] + 0.001
            before, last = history[-SEED], history[-1]
            row = list(last)
            for k in range(1, CHOSEN + 1):
                if before[k - 1] is not None and (row[k] is None or before[k - 1][0] + cost < row[k][0]):
                    row[k] = (before[k - 1][0] + cost, (*before[k - 1][1], p))
            history.append(row)
        chosen.update(history[-1][CHOSEN][1])
    return sorted(chosen)


def chosen_seeds(seeds_of: DataFrame, counts: DataFrame) -> DataFrame:
    """The seeds to look for. ``seeds_of``: from ``item_seeds``; ``counts``: seed, n. Returns row, pos, seed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, listed in zip(pdf.row, pdf.listed, strict=True):
                n = [s["n"] for s in listed]
                # a seed that stands nowhere finds nothing
                kept = [k for k in choose(n) if n[k]]
                yield pd.DataFrame({"row": row, "pos": kept, "seed": [listed[k]["seed"] for k in kept]})

    counted = seeds_of.join(counts, "seed", "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "seed", F.coalesce("n", F.lit(0)).alias("n")))).alias("listed"))
    return counted.mapInPandas(run, "row long, pos int, seed long")


def seeds_of_documents(documents: DataFrame, bits: np.ndarray) -> DataFrame:
    """Documents with the seeds of a map that they hold. Returns doc_id, seed, each once for a document."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids = list(pdf.text), pdf.doc_id.to_numpy()
            for a, b in chunks(texts):
                words, begins = word_hashes(texts[a:b])
                found, places = seeds(words, begins)
                kept = _listed(shared.value, found)
                found, doc = found[kept], np.searchsorted(begins, places[kept], side="right") - 1
                order = np.lexsort((found, doc))
                found, doc = found[order], doc[order]
                once = np.ones(len(found), dtype=bool)
                once[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
                yield pd.DataFrame({"doc_id": ids[a:b][doc[once]], "seed": found[once].view(np.int64)})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, seed long")


def candidates(held: DataFrame, chosen: DataFrame) -> DataFrame:
    """Documents with the items of which they hold a chosen seed. Returns doc_id, rows. A document's seeds stand together,
    so its items are put into one set before the shuffle."""
    return held.join(chosen.select("seed", "row"), "seed").groupBy("doc_id").agg(F.collect_set("row").alias("rows"))


class _Block:
    """All runs of SHORT words of a block of items, sorted, with the items and places they come from."""

    def __init__(self, items: list[tuple[int, int, bytes]]):
        self.ids = [item for _, item, _ in items]
        self.words = [np.frombuffer(w, dtype=_U) for _, _, w in items]
        self.index = {row: k for k, (row, _, _) in enumerate(items)}
        runs = [run_hashes(w, SHORT) for w in self.words]
        every = np.concatenate([*runs, np.zeros(0, dtype=_U)])
        order = np.argsort(every, kind="stable")
        self.item = np.repeat(np.arange(len(runs)), [len(r) for r in runs])[order]
        self.pos = np.concatenate([*(np.arange(len(r)) for r in runs), np.zeros(0, dtype=np.int64)])[order]
        self.keys, self.starts, self.counts = np.unique(every[order], return_index=True, return_counts=True)
        self.longest = max(map(len, self.words), default=0) + 1

    def stretches(self, words: np.ndarray, begins: np.ndarray, wanted: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """Stretches of documents near whose diagonal LEAST_WORDS words of an item keep as many runs of SHORT words as EDITS words
        changed leave. ``wanted``: documents by items, true for candidates. Keys are (document, item), values spans of words."""
        found, places = seeds(words, begins, SHORT)
        if not len(found) or not len(self.keys):
            return {}
        k = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[k] == found)
        k, places = k[known], places[known]
        doc = np.searchsorted(begins, places, side="right") - 1
        n = self.counts[k]
        at = np.repeat(places - begins[doc], n)
        doc = np.repeat(doc, n)
        posting = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[k], n)
        item, pos = self.item[posting], self.pos[posting]
        kept = wanted[doc, item]
        doc, item, pos, at = doc[kept], item[kept], pos[kept], at[kept]
        diagonal = at - pos + self.longest
        width = int((len(words) + 2 * self.longest) // BAND + 2)
        pair = doc * len(self.words) + item
        spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        least = LEAST_WORDS - SHORT + 1 - SHORT * EDITS
        for half in (0, BAND // 2):
            stripe = pair * width + (diagonal + half) // BAND
            place = np.unique(stripe * self.longest + pos)
            stripe, p = place // self.longest, place % self.longest
            dense = (stripe[least - 1 :] == stripe[: 1 - least]) & (p[least - 1 :] - p[: 1 - least] <= LEAST_WORDS - SHORT)
            for s in np.unique(stripe[: 1 - least][dense]).tolist():
                d, i = divmod(s // width, len(self.words))
                low = s % width * BAND - half - self.longest
                size = len(self.words[i])
                slack = BAND + size // 4
                end = int(begins[d + 1] - begins[d])
                spans[d, i].append((max(0, low - slack), min(end, low + BAND + size + slack)))
        return spans


def tiled(documents: DataFrame, found: DataFrame, block: list[tuple[int, int, bytes]]) -> DataFrame:
    """Candidates with their tiles summed up. ``found``: doc_id, rows, of the items of ``block``: row, item_id, words.
    Returns doc_id, item_id, n_item, n_words, n_covered."""
    shared = documents.sparkSession.sparkContext.broadcast(block)
    columns = ["doc_id", "item_id", "n_item", "n_words", "n_covered"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Block(shared.value)
        for pdf in batches:
            texts, ids, listed = list(pdf.text), list(pdf.doc_id), list(pdf.rows)
            for a, b in chunks(texts, BLOCK):
                words, begins = word_hashes(texts[a:b])
                wanted = np.zeros((b - a, len(held.words)), dtype=bool)
                for d, rows in enumerate(listed[a:b]):
                    wanted[d, [held.index[r] for r in rows]] = True
                out = []
                for (d, i), spans in held.stretches(words, begins, wanted).items():
                    text = words[begins[d] : begins[d + 1]]
                    # stretches stand apart by one word that is in no item
                    parts = [p for k, (x, y) in enumerate(_merged(sorted(spans))) for p in ((np.array([k], dtype=_U), text[x:y]) if k else (text[x:y],))]
                    met = tiles(held.words[i], np.concatenate(parts))
                    out.append((ids[a + d], held.ids[i], len(held.words[i]), longest_passage(met), sum(n for _, _, n in met if n >= COVER_RUN)))
                yield pd.DataFrame(out, columns=columns)

    return documents.join(found, "doc_id").mapInPandas(run, "doc_id long, item_id long, n_item int, n_words int, n_covered int")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = [spans[0]]
    for begin, end in spans[1:]:
        if begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _runs(a: np.ndarray, b: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Pairs of places at which runs of ``size`` words have one hash."""
    ha, hb = run_hashes(a, size), run_hashes(b, size)
    order = np.argsort(hb, kind="stable")
    low, high = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
    return [(i, int(order[k])) for i in np.flatnonzero(low < high).tolist() for k in range(low[i], high[i])]


def tiles(first: np.ndarray, second: np.ndarray, least: int = 2) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in first, start in second, length), the longest matches first, none overlapping. The
    length looked for is halved when no match of it is left."""
    a, b = first.tolist(), second.tolist()
    used_a, used_b = bytearray(len(a)), bytearray(len(b))
    out: list[tuple[int, int, int]] = []
    size = 16
    while size >= least:
        matches = []
        for i, j in _runs(first, second, size):
            if used_a[i] or used_b[j] or (i and j and a[i - 1] == b[j - 1] and not used_a[i - 1] and not used_b[j - 1]):
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                n += 1
            if n >= size:
                matches.append((n, i, j))
        again = False
        for n, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if any(used_a[i : i + n]) or any(used_b[j : j + n]):
                again = True  # what is left of it may still be long enough
                continue
            used_a[i : i + n] = used_b[j : j + n] = b"\x01" * n
            out.append((i, j, n))
        if not again:
            size //= 2
    return out


def longest_passage(found: list[tuple[int, int, int]]) -> int:
    """Most consecutive words of the item that stand in the document, single changed, dropped or added words aside.
    ``found``: tiles of the item and the document."""
    best = 0
    ending: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by the item word after it: document word, begin, words matched
    for i, j, n in sorted(found):
        begin, matched = i, n
        for gap in range(GAP_ITEM + 1):
            for end_j, first, had in ending.get(i - gap, ()):
                if 0 <= j - end_j <= GAP_DOCUMENT and had + n > matched:
                    begin, matched = first, had + n
        ending[i + n].append((j + n, begin, matched))
        if matched >= LEAST_SHARE * (i + n - begin):
            best = max(best, i + n - begin)
    return best


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with the items that leaked into them. ``documents``: doc_id, text; ``items``: item_id, text.

    Returns doc_id, item_id, n_words (of the longest passage), n_covered, n_item and kind: ``passage`` from LEAST_WORDS
    consecutive words, else ``reordered`` if pieces cover LEAST_COVER of the item.
    """
    rows = documents.select("doc_id", "text").where("text is not null and text <> ''")
    words = cut(item_words(items.select("item_id", "text")))
    all_seeds = cut(item_seeds(words))
    counts = seed_counts(rows, seed_map(all_seeds))
    chosen = cut(chosen_seeds(all_seeds, counts))
    found = candidates(seeds_of_documents(rows, seed_map(chosen)), chosen)
    blocks = -(-words.count() // BLOCK)
    found = cut(found) if blocks > 1 else found
    met = documents.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item int, n_words int, n_covered int")
    for k in range(blocks):
        mine = F.pmod("row", F.lit(blocks)) == k
        block = [(r["row"], r["item_id"], np.array(r["words"], dtype=np.int64).tobytes()) for r in words.where(mine).collect()]
        theirs = found if blocks == 1 else found.withColumn("rows", F.filter("rows", lambda r: F.pmod(r, F.lit(blocks)) == k)).where(F.size("rows") > 0)
        met = met.unionByName(tiled(rows, theirs, block))
    best = met.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("n_covered").alias("n_covered"), F.max("n_item").alias("n_item"))
    covered = (F.col("n_covered") >= LEAST_WORDS) & (F.col("n_covered") >= LEAST_COVER * F.col("n_item"))
    kind = F.when(F.col("n_words") >= LEAST_WORDS, "passage").when(covered, "reordered")
    return best.withColumn("kind", kind).where("kind is not null")
