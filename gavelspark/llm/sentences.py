"""Sentence boundaries across languages and scripts.

Spaced scripts: at every terminator the token before (title, reference, date, initial, other abbreviation) and the token
after (case, script, digit) say whether the edge that ends the sentence or the one that carries it on is the better; no edge's
worth depends on what was chosen at another terminator, so the best path is the better edge at each.

Scripts without spaces: words are those of the best path through a lattice over the function words listed below, a lexicon
induced from the corpus (``induced_lexicon``) and single unknown characters. A gap, a blank as well as a seam between two words
without any mark, is classed by the word before it and the word after it: it ends a sentence if a final particle stands before
it (at a seam one that only ends sentences) and no continuing word after it; a quotation is classed by the word after it. A
script without full stops ends a sentence at a blank. Quotations and parentheses are skipped as a whole and judged at their end.

Defined results: a null text, or one without any letter or digit, has no sentences; tags and empty lines end a sentence;
texts of any length are read whole, in time proportional to their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.session import cut

#: Abbreviations in lower case without their points, by what follows them.
TITLES = frozenset("ph mr mrs ms miss dr dre drs prof hon rév rev st ste sts gen gén sen sén sgt capt lt col gov pres rep fr sr mgr m mm mme mmes mlle me ald cllr messrs".split())
REFERENCES = frozenset("no nos nᵒ n vol vols p pp s ss art arts sec sect ch chap fig figs par para paras c cc cf app approx env ca circa vs v ed eds al tab div cl reg sched est tel tél ext poste bk ver".split())
MONTHS = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc".split())
NEVER_FINAL = frozenset("i.e e.g viz vs p.ex c.-à-d cf".split())
MAYBE_FINAL = frozenset("etc inc ltd ltée co corp llc llp jr bros dept govt assn p.m a.m ph.d m.d b.a m.a u.s u.k e.u n.b b.c s.o".split())
_ABBREVIATIONS = TITLES | REFERENCES | MONTHS | NEVER_FINAL | MAYBE_FINAL
#: Words that open an English or French sentence after an initial or a possibly final abbreviation.
OPENERS = frozenset("the a an this that these those we i it he she they you in on at for with by from as if when since although despite under after before during between without against over does do did is are was were will would who what why how there here bill version over one two le la les un une ce cette ces nous je il elle ils elles vous en dans au aux avec par pour sur si quand depuis bien malgré sous après avant pendant entre sans contre est-ce qui que pourquoi comment".split())
#: Words that carry a sentence on in a script without spaces, and words that open one.
CONTINUING = frozenset("と って という といった との とか は が を に も で の へ から ので けれど けど し 然后 接着 说 道 地 的 着 了 并 并且 而 这 之后 来 后 또 고 라고 이라고 라는 하고".split())
OPENING = frozenset("我 我们 你 你们 他 她 它 他们 这里 那里 去年 今年 明年 谁 私 私たち 彼 彼女 今 今日 昨年 また しかし そして それ これ この その 但是 因为 所以".split())
#: Words that end a sentence in a script without spaces, those of them that end nothing else, and words that
#: only look like one of the others.
FINAL_WORDS = frozenset("です ます でした ました ません ませんでした でしょう ましょう だ だった である よ ね か ですか ますか ましたか ください 了 吗 呢 吧 啊 呀 嘛".split())
ONLY_FINAL = frozenset("です ます でした ました ません ませんでした でしょう ましょう ですか ますか ましたか ください 吗".split())
SHIELDS = frozenset("静か 確か 明らか 僅か わずか 豊か 何か 誰か いつか どこか まだ ただ 为了 除了 了解 来年 来週 后来 地方 的确 目的 着急 说明 もし もう もっと".split())
#: Longest word of the induced lexicon, least occurrences, least cohesion (the logarithm of how much more often its parts stand
#: together than by chance), and how many words, the most frequent ones, the lexicon holds: it goes out to every task.
LONGEST_WORD, LEAST_OCCURRENCES, LEAST_COHESION, LEXICON = 4, 8, 2.5, 20_000
#: Case particles, which no induced word begins or ends with.
PARTICLES = frozenset("は が を に の へ と も で".split())

_THAI = "฀-๿຀-໿ក-៿"
_OPEN = {'"': '"', "“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "(": ")", "（": "）", "‹": "›", "《": "》"}
_MARKS = r'</?[A-Za-z][^<>]*>|\n[^\S\n]*\n\s*|[.?!…]+(?![0-9])|[。！？｡।॥؟۔։።။]+|["“«„「『(（‹《]'
_TOKEN = re.compile(_MARKS)
#: The first characters of all marks; one set is found much faster than the alternatives.
_FIRST = re.compile(r'[<\n.?!…。！？｡।॥؟۔։።“"«„「『(（‹《]')
#: Also blanks after a word of a script without full stops; only texts that hold one are searched this way.
_BLANKS = re.compile(rf"{_MARKS}|(?<=[{_THAI}])[0-9.,]*\s+|(?<=[{_THAI}][0-9])[0-9.,]*\s+")
_STOPLESS = re.compile(f"[{_THAI}]")
#: Marks that are no full stop of a script of their own and stand by themselves.
_POINTS = frozenset(".?!")
_HARD = frozenset("。！？｡।॥؟۔։።။")
_FINAL = frozenset(".?!…。！？｡।॥؟۔։።။")
_CLOSERS = "\"”»’')]」』）›》"
_BEFORE = re.compile(r"(?:[^\W\d_]|[.'’-])*$")
_NEXT_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_HAS_WORD = re.compile(r"[^\W_]")
_OWN_STOP = re.compile(r"[ऀ-෿぀-ヿ㐀-鿿԰-֏ሀ-፿]")
_SPACELESS = re.compile(rf"[぀-ヿ㐀-鿿가-힯{_THAI}]")
_WORDS = CONTINUING | OPENING | FINAL_WORDS | SHIELDS
_LONGEST = max(max(map(len, _WORDS)), LONGEST_WORD)
#: Costs of a listed word, an induced word and an unknown character on a path.
_LISTED, _INDUCED, _UNKNOWN = 1.0, 1.5, 2.0
#: Characters on either side of a gap that the lattice is built over.
_REACH = 16
_KANA_HAN = re.compile(r"[぀-ヿ㐀-鿿]")
#: Also blanks between two such characters; only texts that hold such characters are searched this way.
_GAP = r"(?<=[぀-ヿ㐀-鿿])[^\S\n]+(?=[぀-ヿ㐀-鿿])"
_RUN = re.compile(r"[぀-ヿ㐀-鿿]+")
_GAPS = re.compile(rf"{_MARKS}|{_GAP}")
_GAPS_AND_BLANKS = re.compile(rf"{_BLANKS.pattern}|{_GAP}")


def lattice_path(text: str, lexicon: frozenset[str] = frozenset()) -> list[str]:
    """Words of the best path through the lattice of ``text``; of two equal paths the one whose last word is longer wins."""
    cost, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        best, start = cost[end - 1] + _UNKNOWN, end - 1
        for n in range(1, min(_LONGEST, end) + 1):
            word = text[end - n : end]
            worth = _LISTED if word in _WORDS else _INDUCED if word in lexicon else None
            if worth is not None and cost[end - n] + worth <= best:
                best, start = cost[end - n] + worth, end - n
        cost.append(best)
        back.append(start)
    path, end = [], len(text)
    while end:
        path.append(text[back[end] : end])
        end = back[end]
    return path[::-1]


def _carries_on(text: str, at: int, lexicon: frozenset[str] = frozenset()) -> bool:
    """Whether what follows a gap or a quotation in a spaceless script belongs to the sentence before."""
    if at >= len(text):
        return False
    if text[at] in "，、,；;：:":
        return True
    path = lattice_path(text[at : at + _REACH], lexicon)
    return bool(path) and path[0] in CONTINUING


def _gap_ends(text: str, left: int, at: int, after: int, lexicon: frozenset[str]) -> bool:
    """Whether a blank in a spaceless script, from ``at`` to ``after``, ends the sentence that began at ``left``."""
    before = lattice_path(text[max(left, at - _REACH) : at], lexicon)
    return bool(before) and before[-1] in FINAL_WORDS and not _carries_on(text, after, lexicon)


def _seams(text: str, lexicon: frozenset[str]) -> list[int]:
    """Places inside runs of a spaceless script at which a sentence ends without any mark."""
    found = []
    for run in _RUN.finditer(text):
        if not any(w in run[0] for w in ONLY_FINAL):
            continue
        path, at = lattice_path(run[0], lexicon), run.start()
        for word, following in zip(path, path[1:], strict=False):
            at += len(word)
            if word in ONLY_FINAL and following not in CONTINUING and following not in FINAL_WORDS:
                found.append(at)
    return found


def _ends(text: str, left: int, at: int, stop: int, mark: str) -> bool:
    """Whether the terminator ``mark``, which begins at ``at`` and whose closers end at ``stop``, ends a sentence that
    began at ``left``."""
    n = len(text)
    if stop >= n:
        return True
    if mark[-1] in _HARD:
        return True
    after = stop
    while after < n and text[after].isspace():
        after += 1
    if after >= n:
        return True
    following = text[after]
    gap = after > stop
    word = ""
    if mark == ".":
        word = _BEFORE.search(text, max(left, at - 24), at)[0].strip("-'’")
        if len(word) > 2 and word[1] in "'’" and word[:1].lower() in "ldnsjmtc":
            word = word[2:]
    if not gap:
        # a missing blank: a whole word or figure, then a capitalised word
        if not (following.isupper() or following == "“" or (following == '"' and following.isupper())):
            return following in _OPEN and mark != "." and following != "("
        if mark == "." and not (at > left and (text[at - 1].isdigit() or (text[at - 1].islower() and len(word) > 2 and "." not in word) or text[at - 1] in _CLOSERS)):
            return False
        nxt = _NEXT_WORD.match(text, after)
        return bool(nxt) and (len(nxt[0]) > 1 or nxt[0] in "IAÀ") and not nxt[0].isupper() or bool(nxt) and nxt[0] in ("I", "A", "À")
    if following in "<":
        return True
    if following.islower() or following in ",;:%)]":
        return False
    if mark != ".":
        return True
    if at > left and _OWN_STOP.match(text[at - 1]):
        return following.isupper()
    low = word.lower()
    begins = not _HAS_WORD.search(text, left, at - len(word))
    if low in NEVER_FINAL:
        return False
    if following.isdigit() or following in "$€£#(":
        if begins and text[left:at].strip().isdigit():
            return False
        return not (low in REFERENCES or low in MONTHS or low in TITLES)
    if low in TITLES and not (begins and low in ("m", "me", "s")):
        return False
    opener = _NEXT_WORD.match(text, after)
    opens = bool(opener) and opener[0].lower() in OPENERS
    if begins and word == "" and text[left:at].strip().isdigit():
        return False
    if len(word) == 1 and word.isalpha():
        if word.isupper():
            before = text[left : at - 1].rstrip().rpartition(" ")[2]
            return opens and not (before[:1].isupper() or before.endswith("."))
        return low not in REFERENCES and (opens or not opener or not word.isascii())
    if low in REFERENCES:
        return opens or begins or following in _OPEN if low == "no" else opens and low not in ("vs", "v", "approx", "env", "ca")
    if low in MONTHS and low not in ("mar", "jun"):
        return opens
    if low in MAYBE_FINAL or "." in low:
        return opens or following in _OPEN or not following.isascii() or low in ("p.m", "a.m", "etc")
    return True


def _latin(text: str) -> bool:
    """Whether all characters are among the first 256: found much faster than any of a set."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def sentence_spans(text: str | None, lexicon: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Code-point offsets (start, end) of the sentences of a text."""
    if not text:
        return []
    cuts: list[tuple[int, int]] = []  # end of a sentence, start of the search for the next
    skip = left = 0
    n = len(text)
    latin = _latin(text)
    stopless = not latin and _STOPLESS.search(text) is not None
    gapped = not latin and _KANA_HAN.search(text) is not None
    seams = iter(_seams(text, lexicon)) if gapped else iter(())
    seam = next(seams, n)
    for m in (_GAPS_AND_BLANKS if stopless and gapped else _BLANKS if stopless else _GAPS if gapped else _FIRST).finditer(text):
        i = m.start()
        if i < skip:
            continue
        while seam <= i:
            if seam >= skip and seam > left and seam < i:
                cuts.append((seam, seam))
                left = skip = seam
            seam = next(seams, n)
        if gapped and text[i].isspace() and "\n" not in m[0] and _KANA_HAN.match(text, i - 1):
            if _gap_ends(text, left, i, m.end(), lexicon):
                cuts.append((i, m.end()))
                left = skip = m.end()
            continue
        c = text[i]
        if stopless or gapped:
            mark = m[0]
        elif c in _POINTS and text[i + 1 : i + 2].isspace():
            mark = c
        elif (c == "\n" and not text[i + 1 : i + 2].isspace()) or (m := _TOKEN.match(text, i)) is None:
            # a single line break is no mark
            continue
        else:
            mark = m[0]
        j = i + len(mark)
        if mark in _POINTS and text[j : j + 1].isspace():
            # the plain cases: a letter in lower case after the mark, or a capital after a question, an exclamation, a word
            # that is no abbreviation or a figure inside a sentence
            after = j + 1
            while after < n and text[after].isspace():
                after += 1
            following = text[after : after + 1]
            if following.islower():
                continue
            if following.isupper():
                word = text[text.rfind(" ", left, i) + 1 or left : i]
                word = word[word.rfind("\n") + 1 :]
                if mark != "." or (len(word) > 2 and word.isalpha() and word.lower() not in _ABBREVIATIONS) or (word.isdigit() and i - len(word) > left):
                    cuts.append((j, j))
                    left = skip = j
                    continue
        if c == "<" or c == "\n":
            cuts.append((i, j))
            left = skip = j
            continue
        if c in _OPEN and c not in _FINAL:
            if c == '"' and i > left and not (text[i - 1].isspace() or text[i - 1] in "([-—:>。！？") and not (i > 0 and text[i - 1] in _FINAL):
                continue
            close = text.find(_OPEN[c], i + 1)
            if close < 0:
                continue
            wall = _BLOCK.search(text, i + 1, close)
            if wall:
                continue
            while close + 1 < n and text[close + 1] in _CLOSERS and text[close + 1] != '"':
                close += 1
            skip = close + 1
            inner = text[i:close].rstrip(" \xa0 \t\r\n" + _CLOSERS)
            if inner and inner[-1] in _FINAL and c not in "(（":
                if skip < n and text[skip] in _FINAL:
                    continue
                if _SPACELESS.match(text, skip):
                    ends = not _carries_on(text, skip, lexicon)
                else:
                    ends = _ends(text, left, close, skip, "!" if inner[-1] not in _HARD or not _SPACELESS.match(inner[-2:-1] or " ") else "!")
                if ends:
                    cuts.append((skip, skip))
                    left = skip
            elif inner and inner[-1] in _FINAL:
                # a parenthesis that is a sentence of its own
                if not _HAS_WORD.search(text, left, i) and _ends(text, left, close, skip, "!"):
                    cuts.append((skip, skip))
                    left = skip
            continue
        if c.isspace() or c.isdigit() or (c in ".," and j > i and text[j - 1].isspace()):
            end = i + len(mark.rstrip())
            cuts.append((end, j))
            left = j
            continue
        stop = j
        while stop < n and text[stop] in _CLOSERS:
            if text[stop] in "'’" and stop + 1 < n and text[stop + 1].isalnum():
                break
            stop += 1
        hard = mark[-1] in _HARD
        # before a tag only a full stop of its own script ends a sentence, and the tag itself does
        if stop >= n or hard or (text[stop] != "<" and _ends(text, left, i, stop, "." if mark == "." else "!")):
            cuts.append((stop, stop))
            left = stop
            skip = stop
    while seam < n:
        if seam >= skip and seam > left:
            cuts.append((seam, seam))
            left = skip = seam
        seam = next(seams, n)
    spans: list[tuple[int, int]] = []
    begin = 0
    cuts.append((n, n))
    for end, resume in cuts:
        while begin < end and text[begin].isspace():
            begin += 1
        if end > begin and (text[begin].isalpha() or _HAS_WORD.search(text, begin, end)):
            while text[end - 1].isspace():
                end -= 1
            spans.append((begin, end))
        begin = resume
    return spans


_BLOCK = re.compile(r"</?[A-Za-z][^<>]*>|\n[^\S\n]*\n")


_GRAM_RUN = re.compile(rf"[぀-ヿ]+|[㐀-鿿぀-ヿ]+|[{_THAI}]+")


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for pdf in batches:
        for text in pdf.text:
            for run in _GRAM_RUN.findall(text):
                for n in range(1, LONGEST_WORD + 1):
                    counts.update(run[k : k + n] for k in range(len(run) - n + 1))
        if len(counts) > 1 << 19:
            yield pd.DataFrame(list(counts.items()), columns=["gram", "n"])
            counts = Counter()
    yield pd.DataFrame(list(counts.items()), columns=["gram", "n"])


def induced_lexicon(texts: DataFrame) -> frozenset[str]:
    """Words of spaceless scripts: runs of up to LONGEST_WORD characters that stand together more often than chance makes them,
    whichever way they are parted, and hold no function word. Counts run over all texts; the driver gets the LEXICON most
    frequent words. ``texts``: text."""
    rows = texts.where(F.col("text").rlike(rf"[぀-ヿ㐀-鿿{_THAI}]")).select("text")
    counts = cut(rows.mapInPandas(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_OCCURRENCES))
    total = counts.where(F.length("gram") == 1).agg(F.sum("n")).first()[0]
    if not total:
        return frozenset()
    long = counts.where(F.length("gram") > 1)
    parted = long.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k"))
    parted = parted.select("gram", "n", F.expr("substring(gram, 1, k)").alias("a"), F.expr("substring(gram, k + 1)").alias("b"))
    part = lambda name: counts.select(F.col("gram").alias(name), F.col("n").alias(f"n_{name}"))
    cohesion = F.log(F.col("n") * float(total) / (F.col("n_a").cast("double") * F.col("n_b")))
    kept = parted.join(part("a"), "a").join(part("b"), "b").groupBy("gram", "n").agg(F.min(cohesion).alias("cohesion")).where(F.col("cohesion") >= LEAST_COHESION)
    known = sorted(w for w in _WORDS if len(w) > 1)
    clean = ~F.col("gram").rlike("|".join(known)) & ~F.substring("gram", 1, 1).isin(*PARTICLES) & ~F.substring("gram", -1, 1).isin(*PARTICLES)
    return frozenset(r["gram"] for r in kept.where(clean).orderBy(F.desc("n"), "gram").limit(LEXICON).collect())


def _prepared(texts: DataFrame) -> tuple[DataFrame, object]:
    rows = texts.where("text is not null and text <> ''").select("table_name", "row_id", "text")
    return rows, texts.sparkSession.sparkContext.broadcast(induced_lexicon(rows))


def sentence_units(texts: DataFrame) -> DataFrame:
    """Sentences of every text. ``texts``: table_name, row_id, text. Returns table_name, row_id, start_at, sentence."""
    rows, lexicon = _prepared(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(a, b, s, t[s:e]) for a, b, t in zip(pdf.table_name, pdf.row_id, pdf.text, strict=True) for s, e in sentence_spans(t, lexicon.value)]
            yield pd.DataFrame(found, columns=["table_name", "row_id", "start_at", "sentence"])

    return rows.mapInPandas(run, "table_name string, row_id long, start_at int, sentence string")


def sentence_starts(texts: DataFrame, at: str | None = None) -> DataFrame:
    """Offsets of the sentences of every text, of the latest row where a column ``at`` names the time of delivery; of rows of
    one id and time one counts. ``texts``: table_name, row_id, text. Returns table_name, row_id, start_at."""
    rows, lexicon = _prepared(texts)
    timed = texts.where("text is not null and text <> ''").select("table_name", "row_id", "text", (F.col(at) if at else F.lit(None)).cast("timestamp_ntz").alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["table_name", "row_id", "at"]].assign(starts=[[s for s, _ in sentence_spans(t, lexicon.value)] for t in pdf.text])

    found = timed.mapInPandas(run, "table_name string, row_id long, at timestamp_ntz, starts array<int>")
    # the offsets of all deliveries are shuffled, not their texts
    newest = F.max_by("starts", F.coalesce("at", F.lit("0001-01-01").cast("timestamp_ntz")))
    once = found.groupBy("table_name", "row_id").agg(newest.alias("starts"))
    return once.select("table_name", "row_id", F.explode("starts").alias("start_at")).distinct()
