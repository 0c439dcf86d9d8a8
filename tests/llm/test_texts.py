import random
from collections import Counter

import numpy as np
import pytest

from gavelspark.llm import alignment, leakage, packing, pii, sentences

SPLITS = [
    ("One is here. Two came.", ["One is here.", "Two came."]),
    ("Mr. A. B. Cole paid $3.5 million to St. Ann Ltd. and left.", ["Mr. A. B. Cole paid $3.5 million to St. Ann Ltd. and left."]),
    ("It closed at 9:45 p.m. The vote was No. 12 of 40. No. We left.", ["It closed at 9:45 p.m.", "The vote was No. 12 of 40.", "No.", "We left."]),
    ('He said, "We wait. We need it," and sat. "Who pays? When?" The end.', ['He said, "We wait. We need it," and sat.', '"Who pays? When?"', "The end."]),
    ("It rose, i.e. by 2.1 points vs. 3.0 before ... and fell.", ["It rose, i.e. by 2.1 points vs. 3.0 before ... and fell."]),
    ("Three points: (1) it is late; (2) it is dear. Next!", ["Three points: (1) it is late; (2) it is dear.", "Next!"]),
    ("<p>A heading</p><p>A line\nbreak stays. Yes.</p>", ["A heading", "A line\nbreak stays.", "Yes."]),
    ("First part\n\nSecond part", ["First part", "Second part"]),
    ("It cost $8 million.The end.", ["It cost $8 million.", "The end."]),
    ("部长说：“我们不能等。必须行动。”然后坐下了。我代表渔民。", ["部长说：“我们不能等。必须行动。”然后坐下了。", "我代表渔民。"]),
    ("大臣は「待てない。今すぐ動く。」と述べました。橋は？", ["大臣は「待てない。今すぐ動く。」と述べました。", "橋は？"]),
    ("งบประมาณลดลงร้อยละ12.5 รัฐมนตรีจะตอบเมื่อใด", ["งบประมาณลดลงร้อยละ12.5", "รัฐมนตรีจะตอบเมื่อใด"]),
    ("डॉ. सरवेन ने 5 पत्र भेजे। हम आभारी हैं।", ["डॉ. सरवेन ने 5 पत्र भेजे।", "हम आभारी हैं।"]),
    ("متى سيجيب الوزير؟ نشكر اللجنة.", ["متى سيجيب الوزير؟", "نشكر اللجنة."]),
    ("M. Roy, Ph. D., parle. « C'est 5 % ! » Il part.", ["M. Roy, Ph. D., parle.", "« C'est 5 % ! »", "Il part."]),
    ("", []), (None, []), (" \n ", []), ("<br/>", []), ("...", []),
]


@pytest.mark.parametrize("text,expected", SPLITS)
def test_sentences(text, expected):
    assert [text[s:e] for s, e in sentences.sentence_spans(text)] == expected


def test_plain_ends_need_no_classes(monkeypatch):
    # most ends are plain and are told without the rules for abbreviations
    def never(*_):
        raise AssertionError("classed")

    monkeypatch.setattr(sentences, "_ends", never)
    text = "They met in Corvane\nHarbour. The end!\nWe left in\n2019. So?  Yes.\n\nIt rose.</p><p>It fell... At 5 p.m. they left."
    assert sentences.sentence_spans(text[: text.index("It fell")])[-1] == (text.index("It rose"), text.index("</p>"))
    assert [s for s, _ in sentences.sentence_spans("<p>One came.</p><p>Two left. Three stayed at noon approx. ten.</p>")] == [3, 19, 29]


def test_sentences_cover_long_texts():
    text = "A plain sentence stands here. " * 20000
    assert len(sentences.sentence_spans(text)) == 20000


@pytest.mark.parametrize("piece", ["\n", " ", "(", '"', "A. ", "1,", "a@", "<a ", "a.b.", "Ann Bell "])
def test_monotonous_texts_take_linear_time(piece):
    import time

    text = piece * (40000 // len(piece))
    for f in (sentences.sentence_spans, lambda t: leakage.word_hashes([t]), pii.find_spans, alignment.words):
        began = time.time()
        f(text)
        assert time.time() - began < 5


def test_sentence_rows_once(spark):
    df = spark.createDataFrame([("t", 1, "It came. They left.", "x"), ("t", 1, "It came. They left.", "y"), ("t", 2, None, "")], "table_name string, row_id bigint, text string, start_at string")
    assert sorted(tuple(r) for r in sentences.sentence_starts(df).collect()) == [("t", 1, 0), ("t", 1, 9)]
    assert sentences.sentence_units(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,starts",
    [
        ("予算は減りました 橋はいつ直るのですか 誰も知りません", [0, 9, 20]), ("这座桥修好了 谁来支付账单呢 我们不能等", [0, 7, 15]),
        ("予算 は減りました", [0]), ("これは静か 橋です", [0]), ("为了 我们的桥", [0]), ("予算は減りました が橋は直りました", [0]), ("予算は減りました\n橋は直りました", [0]),
    ],
)
def test_gaps_in_spaceless_scripts(text, starts):
    assert [s for s, _ in sentences.sentence_spans(text)] == starts


@pytest.mark.parametrize(
    "text,starts",
    [
        ("予算は減りました橋はいつ直るのですか誰も知りません", [0, 8, 18]), ("这座桥修好了吗谁来支付账单", [0, 7]), ("予算は減りましたが橋は直りました", [0]), ("橋は直りましたから渡れます", [0]), ("大臣は「待てません今すぐ動きます」と述べました", [0]),
        ("静かですね。橋は直りました今日渡れます", [0, 6, 13]),
    ],
)
def test_seams_in_spaceless_scripts(text, starts):
    assert [s for s, _ in sentences.sentence_spans(text)] == starts


def test_induced_lexicon(spark):
    rng = random.Random(5)
    words = ["橋梁", "予算", "渡し船", "委員会"]
    rows = [("".join(rng.choice(words) + rng.choice("はがを") + rng.choice("見聞読書待") for _ in range(12)) + "ました。",) for _ in range(60)] + [("plain text",), ("",)]
    got = sentences.induced_lexicon(spark.createDataFrame(rows, "text string"))
    assert {"橋梁", "予算", "渡し船", "委員会"} <= got and not any("は" in w or "ました" in w for w in got)
    assert sentences.lattice_path("橋梁は静かです", got) == ["橋梁", "は", "静か", "です"]
    assert sentences.induced_lexicon(spark.createDataFrame([("plain",)], "text string")) == frozenset()


def test_the_latest_delivery_counts(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2020, 1, d)
    df = spark.createDataFrame([("t", 1, day(1), "It came. They left."), ("t", 1, day(2), "It came to them. They left."), ("u", 1, None, "One. Two.")], "table_name string, row_id bigint, at timestamp_ntz, text string")
    assert sorted(tuple(r) for r in sentences.sentence_starts(df, "at").collect()) == [("t", 1, 0), ("t", 1, 17), ("u", 1, 0), ("u", 1, 5)]
    docs = spark.createDataFrame([(1, day(1), "a", "b"), (1, day(2), "c", "d"), (2, None, "e", "f")], "id bigint, at timestamp_ntz, first string, second string")
    assert sorted((r.id, r["first"]) for r in alignment.latest(docs, "at").collect()) == [(1, "c"), (2, "e")]


def test_lattice_path():
    assert sentences.lattice_path("橋は静かです") == ["橋", "は", "静か", "です"] and sentences.lattice_path("") == []


# alignment


def bilingual(rng, n):
    en = ["".join(rng.choice("bdfg") + rng.choice("aeio") for _ in range(3)) + "en" for _ in range(60)]
    fr = ["".join(rng.choice("klmn") + rng.choice("aeou") for _ in range(3)) + "ir" for _ in range(60)]
    pairs = []
    for _ in range(n):
        picks = [rng.sample(range(len(en)), 4) for _ in range(4)]
        pairs.append((" ".join(f"The {' '.join(en[i] for i in p)} moved." for p in picks), [f"Le {' '.join(fr[i] for i in p)} bouge." for p in picks]))
    return pairs


def test_alignment_of_a_made_up_language(spark):
    rng = random.Random(3)
    docs, truth = [], set()
    for k, (first, parts) in enumerate(bilingual(rng, 300)):
        order = list(range(4))
        rng.shuffle(order)
        second, at = "", {}
        for i in order:
            at[i] = len(second)
            second += parts[i] + " "
        docs.append((k, first, second))
        starts = [s for s, _ in sentences.sentence_spans(first)]
        truth |= {(k, starts[i], at[i]) for i in range(4)}
    extra = [(900, docs[0][1], None), (901, "", docs[0][2]), (902, docs[1][1], docs[1][1])] + docs[:1]
    df = spark.createDataFrame(docs + extra, "id bigint, first string, second string")
    got = {tuple(r) for r in alignment.aligned_sentences(spark, df).collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95
    assert not {r for r in got if r[0] >= 900}


def test_word_vectors_cover_all_documents(spark):
    # a word in a few of many documents has a vector, with the frequency counted over all of them
    docs = [(k, f"The w{k % 7}x office sat.", f"Le z{k % 7}y bureau siège.") for k in range(6000)]
    docs = [(k, a.replace("office", "lantern"), b.replace("bureau", "fanal")) if k % 1500 == 0 else (k, a, b) for k, a, b in docs]
    df = spark.createDataFrame(docs, "id bigint, first string, second string")
    got = {(r.side, r.word): r.n for r in alignment.word_vectors(df).collect()}
    assert got[0, "lantern"] == got[1, "fanal"] == 4 and (0, "the") not in got


def test_alignment_is_the_same_whatever_part_of_the_vocabulary_is_held(spark):
    docs = [(k, first, " ".join(parts)) for k, (first, parts) in enumerate(bilingual(random.Random(4), 120))]
    df = spark.createDataFrame(docs, "id bigint, first string, second string")
    whole = {tuple(r) for r in alignment.aligned_sentences(spark, df).collect()}
    assert whole and whole == {tuple(r) for r in alignment.aligned_sentences(spark, df, vocabulary=5).collect()}


def test_the_driver_gets_no_matrix(spark, monkeypatch):
    docs = [(k, first, " ".join(parts)) for k, (first, parts) in enumerate(bilingual(random.Random(4), 120))]
    df = spark.createDataFrame(docs, "id bigint, first string, second string")
    sent, collect = [], type(df).collect

    def counted(self):
        rows = collect(self)
        sent.append(sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(type(df), "collect", counted)
    assert alignment.aligned_sentences(spark, df).count()
    assert sent and max(sent) <= alignment.GROUPS * alignment.DIMENSIONS * 4


@pytest.mark.parametrize("texts", [["L'eau, l'été 2019.", "", "The x2 A-B"], ["Le cœur — oui", "ΟΔΟΣ ΑΣ", "", "İz"], ["a\0b", "\0", "c"], [""]])
def test_closed_words(texts):
    assert alignment.closed_words(texts) == [w for t in texts for w in (*alignment.bare_words(t.lower()), "\0")]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Roy paid 1,488 of 6\u00a0915 to McDonald and IBM at 27,0 %.", (["1488", "6915", "27.0"], ["mcdonald", "ibm"])),
        ("the 2019Budget of Élan", (["2019"], ["budget", "élan"])), ("Il A5 Été٣٤", (["5", "٣٤"], ["été"])), ("", ([], [])),
    ],
)
def test_figures_and_names(text, expected):
    assert alignment.marks(text) == expected


def test_vectors_are_the_sums_of_their_words():
    rng = np.random.default_rng(2)
    held = [(side, w, rng.standard_normal(8).astype(np.float32).tobytes()) for side in (0, 1) for w in ("one", "two", "œuvre")]
    own = {"other": np.ones(8, dtype=np.float32)}
    for texts in (["One two one, unknown", "", "Two", "one Other"], ["one " * 900 + "two", "", "two " * 257], [""], ["œuvre one", "Other two œuvre", "none"]):
        got, n = alignment.Aligner(held, 8).vectors(texts, 1, [own] * len(texts))
        known = {w: np.frombuffer(v, dtype=np.float32) for side, w, v in held if side == 1} | own
        for row, k, text in zip(got, n, texts, strict=True):
            bag = alignment.bare_words(text.lower())
            total = sum((known[w] for w in bag if w in known), np.zeros(8))
            assert k == len(bag) and np.allclose(row, total / max(np.linalg.norm(total), 1e-6), atol=1e-5)


def test_alignment_of_texts_without_letters(spark):
    docs = [(k, f"{k} 12. {k} 7!", f"{k} 12 ; {k} 7 %") for k in range(600)]
    assert alignment.aligned_sentences(spark, spark.createDataFrame(docs, "id bigint, first string, second string")).count() >= 0


def test_alignment_of_nothing(spark):
    assert alignment.aligned_sentences(spark, spark.createDataFrame([], "id bigint, first string, second string")).count() == 0


@pytest.mark.parametrize("token,expected", [("1,488", "1488"), ("1 488", "1488"), ("43,6", "43.6"), ("2.5", "2.5"), ("552 676", "552676"), ("7", "7")])
def test_figures(token, expected):
    assert alignment.figure(token) == expected


# packing


def test_fullest_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        counts = Counter(rng.randint(1, 12) for _ in range(rng.randint(0, 7)))
        room = rng.randint(0, 30)
        reach = {0}
        for n, c in counts.items():
            reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= room}
        chosen = packing.fullest(counts, room)
        assert sum(n * k for n, k in chosen.items()) == max(reach)
        assert all(k <= counts[n] for n, k in chosen.items())


def test_plan_places_every_item_once():
    rng = random.Random(7)
    histogram = Counter(rng.randint(1, 100) for _ in range(3000))
    filled = packing.plan(histogram, 100)
    used = Counter()
    for combination, times in filled:
        assert sum(n * k for n, k in combination.items()) <= 100
        for n, k in combination.items():
            used[n] += k * times
    assert used == histogram
    containers = sum(t for _, t in filled)
    assert containers <= 1.01 * sum(n * c for n, c in histogram.items()) / 100 + 1


def test_packed_documents(spark):
    rows = [(i, "word " * (i % 90 + 1), "x") for i in range(300)] + [(900, "many words in one text. " * 900, ""), (901, None, ""), (902, "", ""), (903, "字" * 3000, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rank string")
    got = packing.packed_documents(df, 256).collect()
    texts = {i: t for i, t, _ in rows}
    for doc, parts in {d: sorted((r.piece, r.start_at, r.end_at) for r in got if r.doc_id == d) for d in {r.doc_id for r in got}}.items():
        assert "".join(texts[doc][s:e] for _, s, e in parts) == texts[doc]
    assert {r.doc_id for r in got} == {i for i, t, _ in rows if t}
    fill = Counter()
    for r in got:
        assert 0 < r.n_tokens <= 256
        fill[r.container] += r.n_tokens
    assert max(fill.values()) <= 256
    assert sum(v < 240 for v in fill.values()) <= 2
    encode = packing.encoding(packing.vocabulary_file()).encode_ordinary
    assert all(len(encode(texts[r.doc_id][r.start_at : r.end_at])) == r.n_tokens for r in got if r.doc_id >= 900)
    assert packing.packed_documents(df.limit(0)).count() == 0


# leakage

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten eleven twelve".split()


LEAK_CASES = [
    (ITEM, True), (ITEM[3:27], True), (ITEM[3:26], False), ([w.upper() + "," for w in ITEM[2:34]], True), (ITEM[:10] + ["changed"] + ITEM[11:30], True), (ITEM[:12] + ITEM[13:32], True),
    (ITEM[:12] + ["added"] + ITEM[12:30], True), (ITEM[:12] + ["other"] * 9 + ITEM[20:34], False), (["none"] * 50, False), ([], False),
    (ITEM[:7] + ["a"] + ITEM[8:13] + ["b"] + ITEM[14:19] + ["c"] + ITEM[20:27], True),
    (["<b>" + ITEM[0] + "</b>"] + ITEM[1:9] + ["\n- Page 3 of 9 -\n"] + ITEM[9:25], True),
]


def leak_tables(spark, texts, items):
    return spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def test_leaks(spark):
    docs, items = leak_tables(spark, [(k, "Some words before. " + " ".join(words) + " and after.") for k, (words, _) in enumerate(LEAK_CASES)], [(1, " ".join(ITEM)), (2, "too short to leak"), (3, None)])
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).where("kind = 'passage'").collect()}
    assert got == {(k, 1) for k, (_, leaked) in enumerate(LEAK_CASES) if leaked}


def test_reordered_passages_are_covered(spark):
    item = [f"w{k}" for k in range(46)]
    docs, items = leak_tables(spark, [(1, " ".join(item[23:] + ["and", "so"] + item[:23])), (2, " ".join(item[:23])), (3, " ".join(item[::-1]))], [(5, " ".join(item))])
    assert [(r.doc_id, r.item_id, r.n_covered, r.n_item, r.kind) for r in leakage.leaks(docs, items).collect()] == [(1, 5, 46, 46, "reordered")]


def test_tiles_do_not_overlap():
    rng = random.Random(2)
    for _ in range(100):
        texts = [" ".join(rng.choice("abc") for _ in range(30)) for _ in range(2)]
        a, b = (leakage.word_hashes([t])[0] for t in texts)
        seen_a, seen_b = [], []
        for i, j, n in leakage.tiles(a, b):
            assert (a[i : i + n] == b[j : j + n]).all()
            seen_a += range(i, i + n)
            seen_b += range(j, j + n)
        assert len(seen_a) == len(set(seen_a)) and len(seen_b) == len(set(seen_b))


@pytest.mark.parametrize("text,words", [("It's 1,882 or 1 882, U.S. well-being; a–b", ["its", "1882", "or", "1882", "us", "wellbeing", "ab"]), ("<p>One</p>two\nPage 3 of 4\nthree", ["one", "two", "three"]), ("12 345 6789 1 23", ["12345", "6789", "1", "23"]), ("", []), ("...", []), ("été Été", ["été", "été"])])
def test_word_hashes(text, words):
    got, begins = leakage.word_hashes(["before", text, "after"])
    expected = np.concatenate([leakage.word_hashes([w])[0] for w in ["before", *words, "after"]])
    assert got.tolist() == expected.tolist() and begins.tolist() == [0, 1, 1 + len(words), 2 + len(words)]


def test_every_passage_keeps_a_chosen_seed():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(24, 60)
        costs = [rng.randint(0, 30) for _ in range(n - leakage.SEED + 1)]
        chosen = leakage.choose(costs)
        for start in range(n - 23):
            for _ in range(20):
                changed = rng.sample(range(start, start + 24), 3)
                assert any(start <= p <= start + 24 - leakage.SEED and not any(p <= c < p + leakage.SEED for c in changed) for p in chosen)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    phrases = [[rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(9)) for _ in range(6)] for _ in range(40)]
    items = [(k, [w for p in rng.sample(phrases, 8) for w in p]) for k in range(30)]
    docs = []
    for d in range(120):
        words = [w for p in rng.sample(phrases, 12) for w in p]
        if d % 3 == 0:
            item = rng.choice(items)[1]
            begin, size = rng.randrange(20), rng.randint(20, 28)
            part = item[begin : begin + size]
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = "changed"
            words[30:30] = part
        docs.append((d, words))
    hashed = lambda words: leakage.word_hashes([" ".join(words)])[0]
    expected = {(d, k) for d, words in docs for k, item in items if leakage.longest_passage(leakage.tiles(hashed(item), hashed(words))) >= 24}
    frames = leak_tables(spark, [(d, " ".join(w)) for d, w in docs], [(k, " ".join(w)) for k, w in items])
    assert expected and {(r.doc_id, r.item_id) for r in leakage.leaks(*frames).where("kind = 'passage'").collect()} == expected


def test_leak_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 1)
    docs, items = leak_tables(spark, [(1, " ".join(ITEM)), (2, None), (3, ""), (4, "x " + " ".join(ITEM)), (4, "x " + " ".join(ITEM))], [(7, " ".join(ITEM)), (8, " ".join(ITEM[::-1])), (9, None), (7, " ".join(ITEM))])
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()) == [(1, 7), (4, 7)]
    assert leakage.leaks(docs, items.limit(0)).count() == 0 and leakage.leaks(docs.limit(0), items).count() == 0


# personal information


@pytest.mark.parametrize(
    "text,kind,value",
    [
        ("Write to ann.bell@mail.example today.", "email", "ann.bell@mail.example"), ("ann [at] mail [dot] example", "email", "ann [at] mail [dot] example"), ("Tel.: (613) 555-0144", "phone", "613) 555-0144"), ("call +1 613 555 0132 now", "phone", "1 613 555 0132"),
        ("SIN: 046 454 286", "id_number", "046 454 286"), ("NAS : 012-345-678", "id_number", "012-345-678"), ("passport ZQ 837330.", "id_number", "ZQ 837330"), ("health card 0408 808 460 XX", "id_number", "0408 808 460 XX"),
        ("I live at Unit 29, 309 Sarmere Ave., Ottawa", "address", "Unit 29, 309 Sarmere Ave."), ("J'habite au 53, rue Rastholm", "address", "53, rue Rastholm"), ("P.O. Box 812, Quilbury Road", "address", "P.O. Box 812, Quilbury Road"),
        ("Ms. Ann Bell-Cole spoke.", "name", "Ann Bell-Cole"), ("Signed, BELL, Ann", "name", "BELL, Ann"), ("Letters from A. Bell were read", "name", "A. Bell"), ("Regards,\nAnn Bell", "name", "Ann Bell"),
        ("John Smith arrived at noon with a box.", "name", "John Smith"), ("We met Maria Garcia Lopez in the park.", "name", "Maria Garcia Lopez"), ("Letters from Ana Luz Ines Paz Rey Garcia were read", "name", "Ana Luz Ines Paz Rey Garcia"),
        ("Kwabel Maramin-Dovo The Harbour Alliance paid.", "name", "Kwabel Maramin-Dovo"), ("I live at 12 Old Upper North Mill Pond Lane, Ottawa", "address", "12 Old Upper North Mill Pond Lane"),
    ],
)
def test_personal_values(text, kind, value):
    found = [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text)]
    assert (kind, value) in found
    assert f"[{kind.upper()}]" in pii.redact(text) and value not in pii.redact(text)


@pytest.mark.parametrize("text", ["Follow @house_clerk today.", "See file 013-555-B.", "audited under reference 191902177.", "Petition 441-0912 carries 7,476 names.", "The Prairie Union promised it.", "in Corvane Bridge, near Sable Falls", "The Babafen Fund paid Oxbury Ltd.", "Highway 2 and Section 19 Road were closed.", "On June 19, 2019 Bill C-4001 was read.", "", "It cost $613,555,0144.", "Rural Broadband is late; rural towns wait.", "Code 123 456 789 is printed here."])
def test_nothing_personal(text):
    assert [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text)] == []


def test_windows_find_what_whole_texts_hold():
    rng = random.Random(8)
    pieces = ["ann.bell@mail.example", "ann [at] mail [dot] example", "call +44 20 7946 0958", "(613) 555-0144", "046 454 286", "0408 808 460 XX", "ABCD 1234 5678", "passport ZQ837330", "GB82 WEST 1234 5698 7654 32", "Unit 29, 309 Sarmere Ave.", "53, rue Rastholm", "P.O. Box 812", "word", "The", "21 letters", "June 19, 2019.", "$43.1 million", "\n"]
    for _ in range(200):
        text = " ".join(rng.choice(pieces) for _ in range(40))
        for pattern in (pii.EMAIL, pii.PHONE, pii.SIN, pii.HEALTH, pii.HEALTH_LETTERS, pii.PASSPORT, pii.IBAN, pii.ADDRESS):
            whole = {m.span() for m in pattern.finditer(text)}
            windows = pii._windows(text, (m.span() for m in pii._SPELLED.finditer(text)), 80, 330) if pattern is pii.EMAIL else pii._windows(text, (m.span() for m in pii._DIGITS.finditer(text)), 48, 48)
            if pattern is pii.ADDRESS:
                numbers = (m.span() for m in pii._RUN_OF_DIGITS.finditer(text))
                windows = pii._windows(text, ((a, b) for a, b in numbers if pii._STREET_AFTER.match(text, a) or pii._BOX_BEFORE.search(text, max(0, a - 16), a)), 80, 330)
            assert {m.span() for m in pii._matches(pattern, text, windows)} == whole


def test_checksums():
    assert pii.luhn("046454286") and not pii.luhn("046454287")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")


def test_personal_rows(spark):
    df = spark.createDataFrame([(1, "Mail a@b.example or a@b.example", "k"), (2, None, ""), (3, "", "")], "doc_id bigint, text string, kind string")
    assert sorted(tuple(r) for r in pii.personal_spans(df).collect()) == [(1, "email", 5), (1, "email", 20)]
    assert {r.doc_id: r.text for r in pii.redacted(df).collect()} == {1: "Mail [EMAIL] or [EMAIL]", 2: None, 3: ""}
