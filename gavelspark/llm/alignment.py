"""Sentence alignment in bilingual documents.

*Concepts.* All paired documents, hashed by id into ``GROUPS`` groups, are the shared concepts. A word of either language
is represented by its similarities to them, the weights with which it occurs in that language's side of each group beyond
what the group's size makes expected, reduced to ``DIMENSIONS`` by the singular vectors of the concepts; a sentence is the
weighted sum of its words. Frequencies and weights are summed over the whole corpus; the driver gets the matrix of the
``VOCABULARY`` most frequent words, and documents with others get the vectors of these by a join. Figures and names that
both languages spell alike count by themselves.

*Spans.* All pairs of one document meet in one batch, as products of small matrices: the same cosines as a join on
(document, concept), without writing a row for each entry of each sentence, which at 2 x 10^6 sentences took more disk
than the whole input. Mutual best spans are selected, single units first, then windows of two merged neighbours.

Defined results: a null or empty side, or a second side in the first one's language, aligns nothing; of a document
delivered twice the latest row aligns; a second side of which only a small part aligns renders something else and gives nothing.
"""

from __future__ import annotations

import gc
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.llm.sentences import sentence_spans
from gavelspark.session import cut

#: Groups of paired documents that serve as concepts, and the dimensions kept of them.
GROUPS = 2048
DIMENSIONS = 80
#: Least cosine of two spans, least share of aligned units of the second side, and gain that a merged window must bring.
LEAST = 0.66
LEAST_SHARE = 0.34
#: Added for two spans of at most SHORT words each: so few words say little either way.
SHORT, SHORT_GAIN = 3, 0.25
WINDOW_GAIN = 0.08
#: How far below the best cosine of words a pair may lie for figures and names to decide.
FIGURE_REACH = 0.5
#: A word in a larger share of the documents says nothing about a sentence, nor does one in fewer than RARE.
COMMON = 0.55
RARE = 3
#: Tasks that sum the Gram matrix of the groups, and the rows of the slabs in which its lower half goes to one task.
GRAM_TASKS, SLAB = 4, 128
#: Words whose vectors all tasks hold; those of rarer words are joined to the documents that have them.
VOCABULARY = 50_000
#: Words of a text that are added together with those of others.
LONG = 256
#: Documents whose words a task holds at a time.
BATCH = 256
#: Sums of a word and a group that a task holds before it passes them on.
HELD = 2_000_000

_WORD = re.compile(r"[^\W\d_]+")
#: Letters of the first 256 characters as they are, all else as blanks: a fast path of _WORD.
_LETTERS = bytes(b if chr(b).isalpha() else 32 for b in range(256))
#: A figure or a name, a capital and letters. One set at the head of both is found much faster than either by itself.
_MARK = re.compile(r"[\dA-ZÀ-ÖØ-Þ](?:(?<=\d)\d*(?:[.,\s\u00a0\u202f]\d{3}(?!\d))*(?:[.,]\d+)?|(?<!\d)[^\W\d_]{2,})")
#: Closes the words of a text in a list of the words of many.
_END = "\0"
_LETTERS_AND_END = _END.encode() + _LETTERS[1:]
_CLAUSE = re.compile(r"\s*;\s*(?!\(\d)")
_TAG = re.compile(r"<[^<>]*>")
_GROUP = re.compile(r"[\s\u00a0\u202f]")
_PARTS = re.compile(r"^([\d.,]*?)(?:([.,])(\d{1,2}|\d{4,}))?$")


def figure(token: str) -> str:
    """A figure in one spelling: no grouping, a point for the decimals."""
    head, mark, tail = _PARTS.match(_GROUP.sub("", token)).groups()
    return head.replace(",", "").replace(".", "") + (f".{tail}" if mark else "")


def bare_words(low: str) -> list[str]:
    """Words of a text in lower case."""
    try:
        return low.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(low)


def closed_words(texts: list[str]) -> list[str]:
    """Words in lower case of all texts, after those of each text ``_END``."""
    joined = f" {_END} ".join([*texts, ""])
    if joined.count(_END) == len(texts):
        try:
            return joined.lower().encode("latin-1").translate(_LETTERS_AND_END).decode("latin-1").split()
        except UnicodeEncodeError:
            pass
    return [word for text in texts for word in (*bare_words(text.lower()), _END)]


def marks(text: str) -> tuple[list[str], list[str]]:
    """Figures in one spelling, and capitalised words after the first in lower case."""
    figures, names = [], []
    for t in _MARK.findall(text):
        if t[0].isdigit():
            figures.append(t if t.isdigit() else figure(t))
        else:
            names.append(t)
    if names and text.startswith(names[0]):
        del names[0]
    return figures, [t.lower() for t in names]


def words(text: str) -> tuple[list[str], list[str], list[str]]:
    """Words in lower case, figures in one spelling, and capitalised words after the first."""
    return bare_words(text.lower()), *marks(text)


def _numbered() -> defaultdict:
    """A dictionary that gives every new key the next number; the first is ``_END``."""
    index: defaultdict = defaultdict(None, {_END: 0})
    index.default_factory = index.__len__
    return index


class _Sums:
    """Weights and document frequencies of words by group, summed over the batches of a task."""

    def __init__(self):
        self.ids: tuple[defaultdict, defaultdict] = (_numbered(), _numbered())
        self.parts: list[list[tuple]] = [[], [], []]
        self.n = 0

    def add(self, side: int, groups: np.ndarray, texts: list[str]) -> None:
        """Documents of which ``texts`` are one side; of side 2, the documents as such, no text is read."""
        if side == 2:
            ids, doc = np.zeros(len(groups), dtype=np.int64), np.arange(len(groups))
        else:
            found = closed_words(texts)
            ids = np.fromiter(map(self.ids[side].__getitem__, found), dtype=np.int64, count=len(found))
            ends = ids == 0
            ids, doc = ids[~ends], np.cumsum(ends)[~ends]
        once, counts = np.unique(ids * len(groups) + doc, return_counts=True)
        keys = once // len(groups) * GROUPS + groups[once % len(groups)]
        self.parts[side].append((keys, 1 + np.log(counts), np.ones(len(keys), dtype=np.int64)))
        self.n += len(keys)
        if self.n > HELD:
            self.compact()

    def compact(self) -> None:
        for side, parts in enumerate(self.parts):
            if len(parts) > 1:
                keys, weights, counts = (np.concatenate([p[k] for p in parts]) for k in range(3))
                # a stable sort merges the sorted parts
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                starts = np.flatnonzero(np.diff(keys, prepend=-1))
                self.parts[side] = [(keys[starts], np.add.reduceat(weights[order], starts), np.add.reduceat(counts[order], starts))]
        self.n = sum(len(p[0]) for parts in self.parts for p in parts)

    def rows(self) -> Iterator[pd.DataFrame]:
        self.compact()
        for side, parts in enumerate(self.parts):
            if not parts or not len(parts[0][0]):
                continue
            names = list(self.ids[side]) if side < 2 else [""]
            keys, weights, counts = parts[0]
            ids, starts = np.unique(keys // GROUPS, return_index=True)
            groups, weights, ends = (keys % GROUPS).astype(np.uint16), weights.astype(np.float32), [*starts[1:].tolist(), len(keys)]
            n = np.add.reduceat(counts, starts).astype(np.int64)
            rows = [(side, names[i], k, groups[x:y].tobytes(), weights[x:y].tobytes()) for i, k, x, y in zip(ids.tolist(), n.tolist(), starts.tolist(), ends, strict=True)]
            for k in range(0, len(rows), 1000):
                yield pd.DataFrame(rows[k : k + 1000], columns=["side", "word", "n", "groups", "weights"])


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums = _Sums()
    for pdf in batches:
        if not len(pdf):
            continue
        for k in range(0, len(pdf), BATCH):
            part = pdf.iloc[k : k + BATCH]
            groups = part.h.to_numpy()
            for side, texts in enumerate((part["first"], part["second"])):
                sums.add(side, groups, [_TAG.sub(" ", t) if "<" in t else t for t in texts])
            sums.add(2, groups, [])
        if sums.n > HELD:
            yield from sums.rows()
            sums = _Sums()
    yield from sums.rows()


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one word, which follow one another, as one."""
    now, n, dense, done = None, 0, np.zeros(GROUPS), []

    def row() -> tuple:
        at = np.flatnonzero(dense)
        return (*now, n, at.astype(np.uint16).tobytes(), dense[at].astype(np.float32).tobytes())

    columns = ["side", "word", "n", "groups", "weights"]
    for pdf in batches:
        for side, word, k, groups, weights in pdf.itertuples(index=False):
            if (side, word) != now:
                if now is not None and (n >= RARE or now[0] == 2):
                    done.append(row())
                now, n = (side, word), 0
                dense[:] = 0
            n += k
            dense[np.frombuffer(groups, dtype=np.uint16)] += np.frombuffer(weights, dtype=np.float32)
        yield pd.DataFrame(done, columns=columns)
        done = []
    if now is not None and (n >= RARE or now[0] == 2):
        yield pd.DataFrame([row()], columns=columns)


def word_profiles(paired: DataFrame) -> DataFrame:
    """Words of both sides with their document frequency and their weights by group. ``paired``: id, first, second, one row
    for each document. Returns side, word, n, groups, weights; side 2 has one row, the documents of each group."""
    schema = "side int, word string, n long, groups binary, weights binary"
    hashed = paired.select("first", "second", F.pmod(F.xxhash64("id"), F.lit(GROUPS)).alias("h"))
    sums = hashed.mapInPandas(_summed, schema)
    return sums.repartition("side", "word").sortWithinPartitions("side", "word").mapInPandas(_merged, schema)


def _block(pdf: pd.DataFrame, n_docs: int, sizes: np.ndarray) -> np.ndarray:
    """Centred rows of words over the groups, of length one."""
    block = np.zeros((len(pdf), GROUPS), dtype=np.float32)
    for row, groups, weights in zip(block, pdf.groups, pdf.weights, strict=True):
        sums = np.frombuffer(weights, dtype=np.float32)
        row[np.frombuffer(groups, dtype=np.uint16)] = sums
        row -= sums.sum(dtype=np.float64) / n_docs * sizes
    return block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-6)


def word_vectors(paired: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame | None:
    """Vectors of all words of both sides but the most common and the rarest. Returns side, word, n, vector (of 32-bit
    numbers); None without documents. The driver gets the groups' sizes and the singular vectors, GROUPS x ``dimensions``; the
    GRAM_TASKS matrices of GROUPS x GROUPS go to one task, by halves."""
    profiles = cut(word_profiles(paired))
    documents = profiles.where("side = 2").collect()
    if not documents:
        return None
    n_docs, sizes = documents[0]["n"], np.zeros(GROUPS)
    sizes[np.frombuffer(documents[0]["groups"], dtype=np.uint16)] = np.frombuffer(documents[0]["weights"], dtype=np.float32)
    kept = profiles.where((F.col("side") < 2) & (F.col("n") <= COMMON * n_docs))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((GROUPS, GROUPS), dtype=np.float32)
        for pdf in batches:
            block = _block(pdf, n_docs, sizes)
            total += block.T @ block
        slabs = range(0, GROUPS, SLAB)
        yield pd.DataFrame({"task": TaskContext.get().partitionId(), "slab": slabs, "gram": [total[k : k + SLAB, : k + SLAB].tobytes() for k in slabs]})

    def decomposed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # singular vectors of the concept space from its small Gram matrix, of which the lower half is read
        total = np.zeros((GROUPS, GROUPS))
        for pdf in batches:
            for k, slab in zip(pdf.slab, pdf.gram, strict=True):
                total[k : k + SLAB, : k + SLAB] += np.frombuffer(slab, dtype=np.float32).reshape(SLAB, -1)
        values, vectors = np.linalg.eigh(total, UPLO="L")
        yield pd.DataFrame({"top": [vectors[:, np.argsort(values)[::-1][:dimensions]].astype(np.float32).tobytes()]})

    # in one order, so that the sums are the same each time
    slabs = kept.coalesce(GRAM_TASKS).mapInPandas(gram, "task int, slab int, gram binary").repartition(1).sortWithinPartitions("task", "slab")
    top = np.frombuffer(slabs.mapInPandas(decomposed, "top binary").collect()[0]["top"], dtype=np.float32).reshape(GROUPS, -1)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            projected = _block(pdf, n_docs, sizes) @ top
            projected /= np.maximum(np.linalg.norm(projected, axis=1, keepdims=True), 1e-6)
            projected *= np.log(n_docs / pdf.n.to_numpy(dtype=np.float32))[:, None] ** 0.5
            yield pdf[["side", "word", "n"]].assign(vector=[v.astype(np.float32).tobytes() for v in projected])

    return cut(kept.mapInPandas(project, "side int, word string, n long, vector binary"))


def units(text: str) -> list[tuple[int, str]]:
    """Clauses of the sentences of a text, each with the start of its sentence: a sentence merged of two is parted at
    its semicolon."""
    found = []
    parted = ";" in text
    for start, end in sentence_spans(text):
        sentence = text[start:end]
        if parted and ";" in sentence:
            found.extend((start, part) for part in _CLAUSE.split(sentence) if part)
        else:
            found.append((start, sentence))
    return found


def _anchors(figures_a: list[str], known_f: set[str], known_n: set[str], figures_b: list[str], names_b: list[str]) -> float:
    """What figures and names say: agreement adds, figures of the second side that the first lacks take away."""
    value = 0.0
    if figures_b:
        if figures_a == figures_b:
            value = 0.3 * min(len(figures_b), 2)
        else:
            n_other = sum([f not in known_f and not (len(f) <= 2 and f.isdigit() and str(int(f) - 12) in known_f) for f in figures_b])
            value = 0.3 * min(len(figures_b) - n_other, 2) - 0.35 * min(n_other, 2)
    if names_b and known_n:
        shared = sum(map(known_n.__contains__, names_b))
        value += 0.12 * min(shared, 2) if shared else -0.08
    return value


def mutual_best(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of unit indexes that are each other's best among those left, round after round."""
    score = score.copy()
    pairs: list[tuple[int, int]] = []
    most = min(score.shape)
    while len(pairs) < most:
        best_second, best_first = score.argmax(1).tolist(), score.argmax(0).tolist()
        fresh = [(i, j) for i, j in enumerate(best_second) if best_first[j] == i and score[i, j] >= LEAST]
        if not fresh:
            break
        pairs += fresh
        if len(pairs) < most:
            score[[i for i, _ in fresh]] = -9
            score[:, [j for _, j in fresh]] = -9
    return pairs


def merged_windows(pairs: list[tuple[int, int]], x: np.ndarray, y: np.ndarray, figures_x: list, figures_y: list) -> list[tuple[int, int]]:
    """Further pairs: a unit of ``y`` left over belongs to the partner of a neighbour if the window of the two renders
    that partner better than the neighbour alone, and the partner has its figures."""
    taken = {j: i for i, j in pairs}
    found = []
    for j in range(len(y)):
        if j in taken:
            continue
        best, least = None, WINDOW_GAIN
        for k, i in taken.items():
            # a window of units apart, as reordering leaves it, needs a figure of its own as well
            if set(figures_y[j]) - set(figures_x[i]) or (abs(k - j) > 1 and not figures_y[j]):
                continue
            window = y[j] + y[k]
            gain = float(x[i] @ window) / max(float(np.linalg.norm(window)), 1e-6) - float(x[i] @ y[k])
            if gain >= least + (0.0 if figures_y[j] else 0.02):
                best, least = i, gain
        if best is not None:
            found.append((best, j))
    return found


class Aligner:
    """Aligns batches of documents with fixed word vectors."""

    def __init__(self, held: list[tuple[int, str, bytes]], dimensions: int = DIMENSIONS):
        # row 0 is the zero vector of unknown words
        self.indexes: tuple[dict, dict] = ({_END: -1}, {_END: -1})
        for i, (side, word, _) in enumerate(held):
            self.indexes[side][word] = i + 1
        self.matrix = np.vstack([np.zeros((1, dimensions), dtype=np.float32), *(np.frombuffer(v, dtype=np.float32)[None] for _, _, v in held)])

    def vectors(self, texts: list[str], side: int, others: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of texts and their numbers of words; ``others``: for each text the vectors of words that are not held."""
        found = closed_words(texts)
        ids = np.fromiter(map(self.indexes[side].get, found, repeat(0)), dtype=np.int32, count=len(found))
        closed = np.flatnonzero(ids < 0)
        held = ids > 0
        ends = np.cumsum(held)[closed]
        ids = ids[held]
        starts = np.concatenate([[0], ends[:-1]])
        # longest texts first: the k-th words of all that have so many are added at once, up to LONG, and the rest by text
        order = np.argsort(starts - ends, kind="stable")
        starts, lengths = starts[order], (ends - starts)[order]
        sums = np.zeros((len(texts), self.matrix.shape[1]), dtype=np.float32)
        *counts, n_long = np.searchsorted(-lengths, -np.arange(min(lengths[0], LONG) + 1)).tolist()
        for k, n in enumerate(counts):
            sums[:n] += self.matrix[ids[starts[:n] + k]]
        for row, start, n in zip(sums[:n_long], starts.tolist(), lengths.tolist(), strict=False):
            row += self.matrix[ids[start + LONG : start + n]].sum(axis=0)
        out = np.empty_like(sums)
        out[order] = sums
        first = 0
        for row, end, other in zip(out, closed.tolist(), others, strict=True):
            if other:
                for vector in filter(lambda v: v is not None, map(other.get, found[first:end])):
                    row += vector
            first = end + 1
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)
        return out, np.diff(closed, prepend=-1) - 1

    def documents(self, ids: list, firsts: list[str], seconds: list[str], rest: list | None = None) -> list[tuple]:
        """Aligned sentences of documents; ``rest``: of each the side, word and vector of its words that are not held."""
        docs = []
        texts: tuple[list, list] = ([], [])
        others: tuple[list, list] = ([], [])
        for doc, a, b, more in zip(ids, firsts, seconds, rest or [None] * len(ids), strict=True):
            ua, ub = units(a), units(b)
            if not ua or not ub:
                continue
            docs.append((doc, ua, ub, len(texts[0]), len(texts[1])))
            for side, own in enumerate((ua, ub)):
                texts[side].extend([t for _, t in own])
                known = {m["word"]: np.frombuffer(m["vector"], dtype=np.float32) for m in more if m["side"] == side} if more is not None else {}
                others[side].extend([known] * len(own))
        if not docs:
            return []
        (va, na), (vb, nb) = self.vectors(texts[0], 0, others[0]), self.vectors(texts[1], 1, others[1])
        brief_a, brief_b = (na <= SHORT).tolist(), (nb <= SHORT).tolist()
        rows = []
        for doc, ua, ub, ka, kb in docs:
            x, y = va[ka : ka + len(ua)], vb[kb : kb + len(ub)]
            cosine = x @ y.T
            ma, mb = [marks(t) for _, t in ua], [marks(t) for _, t in ub]
            same = {t for _, t in ua}
            sets = [(figures, set(figures), set(names)) for figures, names in ma]
            brief = [i for i, (figures, _) in enumerate(ma) if brief_a[ka + i] and not figures]
            if brief and (short := [j for j, (figures, _) in enumerate(mb) if brief_b[kb + j] and not figures]):
                cosine[np.ix_(brief, short)] += SHORT_GAIN
            for j, ((figures, names), column) in enumerate(zip(mb, cosine.T.tolist(), strict=True)):
                if ub[j][1] in same and len(ub[j][1]) > 12:
                    cosine[:, j] = -9
                elif figures or names:
                    # what lies further below the best in words is no partner, whatever its figures
                    floor = max(column) - FIGURE_REACH
                    for i, value in enumerate(column):
                        if value >= floor:
                            cosine[i, j] = value + _anchors(*sets[i], figures, names)
            pairs = mutual_best(cosine)
            if len(pairs) < LEAST_SHARE * len(ub):
                continue
            if len(pairs) < max(len(ua), len(ub)):
                fx, fy = [figures for figures, _ in ma], [figures for figures, _ in mb]
                seconds_merged = merged_windows(pairs, x, y, fx, fy)
                firsts_merged = [(i, j) for j, i in merged_windows([(j, i) for i, j in pairs], y, x, fy, fx)]
                pairs += seconds_merged + firsts_merged
            rows.extend({(doc, ua[i][0], ub[j][0]) for i, j in pairs})
        return rows


def _rest(paired: DataFrame, vectors: DataFrame, held: list) -> DataFrame:
    """Words of each document that are not among ``held``, with their vectors. Returns id, rest."""
    least = held[-1]
    beyond = vectors.where(
        (F.col("n") < least["n"]) | (F.col("n") == least["n"]) & ((F.col("side") > least["side"]) | (F.col("side") == least["side"]) & (F.col("word") > least["word"]))
    )
    known = paired.sparkSession.sparkContext.broadcast({(r["side"], r["word"]) for r in held})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, *texts in zip(pdf.id, pdf["first"], pdf["second"], strict=True):
                for side, text in enumerate(texts):
                    rows.extend((doc, side, w) for w in {w for _, t in units(text) for w in bare_words(t.lower())} if (side, w) not in known.value)
            yield pd.DataFrame(rows, columns=["id", "side", "word"])

    met = paired.mapInPandas(run, "id long, side int, word string").join(beyond.drop("n"), ["side", "word"])
    return met.groupBy("id").agg(F.collect_list(F.struct("side", "word", "vector")).alias("rest"))


def latest(documents: DataFrame, at: str | None = None) -> DataFrame:
    """The latest delivery of every document by a column ``at``; all rows where none is named. ``documents``: id and other
    columns. Only ids and times are aggregated; the texts are shuffled only where the written list of deliveries is too large
    for the optimizer to broadcast. Rows of one id and one time all stay."""
    if at is None:
        return documents
    timed = documents.withColumn("_at", F.coalesce(F.col(at).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))).where("id is not null")
    newest = cut(timed.groupBy("id").agg(F.max("_at").alias("_at")))
    return timed.join(newest, ["id", "_at"], "left_semi").drop("_at")


def aligned_sentences(spark: SparkSession, documents: DataFrame, vocabulary: int = VOCABULARY, at: str | None = None) -> DataFrame:
    """Sentences that render one another, in the latest delivery of each document by the column ``at``, if any is named.
    ``documents``: id, first, second. Returns id, first_start, second_start, each pair once."""
    once = latest(documents, at).where("length(trim(first)) > 0 and length(trim(second)) > 0 and first <> second").select("id", "first", "second")
    vectors = word_vectors(once)
    held = [] if vectors is None else vectors.orderBy(F.desc("n"), "side", "word").limit(vocabulary).collect()
    model = spark.sparkContext.broadcast([(r["side"], r["word"], bytes(r["vector"])) for r in held])
    whole = len(held) < vocabulary or vectors.count() == len(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(model.value)
        # nothing here makes reference cycles, and the model stays: fewer searches for them
        gc.freeze()
        gc.set_threshold(100_000, 50, 50)
        for pdf in batches:
            for k in range(0, len(pdf), BATCH):
                part = pdf.iloc[k : k + BATCH]
                rows = aligner.documents(list(part.id), list(part["first"]), list(part["second"]), None if whole else list(part.rest))
                yield pd.DataFrame(rows, columns=["id", "first_start", "second_start"])

    served = once if whole else once.join(_rest(once, vectors, held), "id", "left")
    found = served.mapInPandas(run, "id long, first_start int, second_start int")
    # two rows of one id and time give each pair once
    return found.distinct()
