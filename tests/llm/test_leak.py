"""The index against plain search, and passages in every dress."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratamap.llm import leak

WORDS = "stone river lantern wooden market early carries seven hollow bridge under quiet copper tailor morning because silver harbour ladder winter neither broken kettle after orchard narrow candle beyond frozen window".split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.integers(1, 4))
def test_suffix_array_and_index(symbols, k):
    s = np.array(symbols, np.int64)
    text = [*symbols, -1]
    got = leak.suffix_array(np.append(s + 1, 0), 5).tolist()
    assert got == sorted(range(len(text)), key=lambda i: text[i:])
    index = leak.FMIndex(s, 4)
    patterns = np.array([[x // 4**j % 4 for j in range(k)] for x in range(4**k)], np.int64)
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns.tolist(), lo, hi):
        want = [i for i in range(len(symbols) - k + 1) if symbols[i : i + k] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def passage(n, seed=1):
    r = random.Random(seed)
    return [r.choice(WORDS) + r.choice(["", "s", "ed"]) for _ in range(n)]


ITEM = passage(60)
OPENING = "Answer this in one word."


def found(spark, texts, items=None):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(items or [(7, OPENING, f"{OPENING} {' '.join(ITEM)}")], "item_id bigint, opening string, text string")
    return {(r.doc_id, r.item_id) for r in leak.find_leaks(d, e).collect()}


def around(words):
    return "\\section{Intro} Some text comes first. " + words + " And some other text follows here."


def test_dresses(spark):
    part = ITEM[10:40]
    changed = [w if i not in (9, 19, 28) else "zebra" for i, w in enumerate(part)]
    dropped = [w for i, w in enumerate(part) if i not in (8, 17, 26)]
    added = [x for i, w in enumerate(part) for x in ([w, "zebra"] if i in (7, 16, 25) else [w])]
    hyphen = " ".join(part)
    k = hyphen.index(" ", 60) + 3
    yes = [
        " ".join(part), " ".join(part[:20]), " ".join(part).upper(), ", ".join(part), "\n% ".join(part), "\r\n".join(part), " ".join(changed), " ".join(dropped), " ".join(added),
        " ".join(f"\\emph{{{w}}}" for w in part), " ".join(f"{{\\bf {w}}}~\\cite[p.~2]{{abc1999}}" for w in part), " ".join(w + " [abc1999]" if i % 5 == 0 else w for i, w in enumerate(part)),
        hyphen[:k] + "-\n" + hyphen[k:], " ".join(w[0] + "­" + w[1:] for w in part), " ".join(part).translate(str.maketrans("aeo", "аео")), " ".join(w.replace("e", "é") for w in part),
        " ".join("".join(chr(ord(c) + 0xFEE0) for c in w) for w in part), " ".join(part) + " zebra" * 4000,
    ]
    no = [" ".join(part[:19]), " ".join(w if i % 3 else "zebra" for i, w in enumerate(part)), " ".join(sorted(part)), OPENING * 5, "", None, " ".join(part[:12]) + " zebra" * 30 + " ".join(part[12:24])]
    got = found(spark, [around(t) if t else t for t in yes + no])
    assert got == {(i, 7) for i in range(len(yes))}


def edited(words, kind, at):
    return words[:at] + (["zebra"] if kind != "dropped" else []) + words[at + (kind != "added") :]


def scanned(texts, item):
    items = leak.Items([(7, "", " ".join(item))])
    docs = [np.array([items.vocabulary.get(x.encode(), 0) for x in ["zebra"] * 5 + t + ["zebra"] * 5], np.int64) for t in texts]
    return leak._scan_shard(list(range(len(texts))), docs, items)


@pytest.fixture(params=[0, 1024, 10**9])
def common(request, monkeypatch):
    """All seeds common, some, none: the same passages must come out."""
    monkeypatch.setattr(leak, "COMMON", request.param)


def test_twenty_words_with_one_or_two_edits_at_every_place(common):
    item = [f"word{i}x" for i in range(60)]
    part, kinds = item[10:30], ("changed", "dropped", "added")
    one = [edited(part, k, i) for k in kinds for i in range(1, 20 if k == "added" else 19)]
    two = [edited(edited(part, k, i), q, j) for k in kinds for q in kinds for i in range(2, 20 if k == "added" else 19) for j in range(1, i)]
    got = scanned(one + two, item)
    assert [r[0] for r in got] == list(range(len(one + two))) and {r[2] for r in got} == {20}
    assert {r[3] for r in got[: len(one)]} == {1} and {r[3] for r in got[len(one) :]} <= {1, 2}  # a word dropped beside one added is one changed
    assert {(r[4], r[5] - len(t)) for r, t in zip(got, one + two)} == {(5, 4)}
    three = [edited(edited(edited(part, "changed", a), "changed", b), "changed", c) for a, b, c in ((5, 10, 15), (1, 2, 3), (16, 17, 18))]
    assert scanned([*three, part[:19], part[1:], edited(part, "changed", 0), edited(part, "changed", 19)], item) == []


def test_every_passage_of_a_pair_is_given(common):
    item = [f"word{i}x" for i in range(60)]
    gap = ["zebra"] * 7
    got = scanned([item[:25] + gap + item[30:55], (item[5:30] + gap) * 50], item)
    assert [r[2:] for r in got if r[0] == 0] == [(25, 0, 5, 29), (25, 0, 37, 61)]
    assert [r[2:] for r in got if r[0] == 1] == [(25, 0, 5 + 32 * i, 29 + 32 * i) for i in range(50)]


def test_longer_passages_with_edits_anywhere(common):
    """One edit in ten words, in the worst places: all in the middle, at both ends, one by one."""
    item = [f"word{i}x" for i in range(110)]
    texts = []
    r = random.Random(5)
    for n in (29, 30, 33, 37, 38, 45, 60, 90):
        k = n // 10
        for places in (range(n // 2, n // 2 + k), range(1, 1 + k), range(n - 1 - k, n - 1), sorted(r.sample(range(2, n - 2), k)), [*range(1, 1 + k // 2), *range(n - 1 - (k - k // 2), n - 1)]):
            t = item[7 : 7 + n]
            for i in sorted(places, reverse=True):
                t = edited(t, r.choice(["changed", "dropped"]), i)
            texts.append(t)
    assert {x[0] for x in scanned(texts, item)} == set(range(len(texts)))


def test_a_phrase_that_all_share_costs_little():
    """A phrase in every item and every document that is no passage; some documents hold one around it."""
    r = random.Random(1)
    vocabulary, phrase, n = [f"w{i}" for i in range(3000)], [f"c{i}" for i in range(10)], 150
    texts = [r.choices(vocabulary, k=40) + phrase + r.choices(vocabulary, k=40) for _ in range(n)]
    items = leak.Items([(i, "", " ".join(t)) for i, t in enumerate(texts)])
    docs = [np.array([items.vocabulary.get(x.encode(), 0) for x in r.choices(vocabulary, k=200) + (texts[d][35:54] + ["zebra"] + texts[d][55:57] if d % 5 == 0 else phrase) + r.choices(vocabulary, k=200)], np.int64) for d in range(n)]
    shard = leak.Shard(docs, items)
    assert shard.common.sum() >= 6 and len(np.unique(shard.pairs()[0])) < 2 * n
    assert sorted({x[:2] for x in leak._scan_shard(list(range(n)), docs, items)}) == [(d, d) for d in range(0, n, 5)]


def test_removal_spans(spark):
    rows = [(1, 7, 0, 30), (1, 8, 10, 20), (1, 8, 25, 50), (1, 7, 50, 60), (1, 9, 61, 90), (2, 7, 5, 30), (None, 7, 1, 30)]
    d = spark.createDataFrame([(*r, 10 * r[2], 10 * r[3] + 5) for r in rows], "doc_id bigint, item_id bigint, first_word bigint, last_word bigint, first_char bigint, end_char bigint")
    assert sorted(map(tuple, leak.merge_spans(d).collect())) == [(1, 0, 60, 0, 605, 2), (1, 61, 90, 610, 905, 1), (2, 5, 30, 50, 305, 1)]
    assert leak.merge_spans(d.limit(0)).count() == 0


DRESS = st.sampled_from(["word", "Wörd", "ﬁne", "İx", "Σας", "цена", "\\'e", "\\\"{\\i}", "\\cite[p.~2]{abc1999}", " [abc1999] ", "\\emph{", "}", "{}", "\\-", "-\n% ", "­", "​", "\r\n", " ", ", ", "é", "½", "１", "\\ref{x}", "한국", "日本", "x", "7"])


@settings(max_examples=300, deadline=None)
@given(st.lists(DRESS, max_size=40).map("".join))
def test_places_of_words(text):
    begin, end = leak.places_of(text)
    words = leak.words_of(text)
    assert len(begin) == len(end) == len(words) and (begin < end).all() and (begin[1:] >= begin[:-1]).all()
    for w, a, b in zip(words, begin, end):
        if text[a:b].isascii() and text[a:b].isalnum():
            assert text[a:b].lower().encode() == w or w.startswith(text[a:b].lower().encode())


def test_a_text_without_its_spans_holds_no_passage(spark):
    part = [f"\\emph{{{w}}}" if i % 3 else w.upper() + "," for i, w in enumerate(ITEM[5:40])]
    text = around(" ".join(part)) + around("\n% ".join(ITEM[20:50]).replace("e", "é"))
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    e = spark.createDataFrame([(7, "", " ".join(ITEM))], "item_id bigint, opening string, text string")
    spans = sorted(leak.merge_spans(leak.find_leaks(d, e)).collect(), reverse=True)
    assert len(spans) == 2
    rest = text
    for s in sorted(spans, key=lambda s: -s.first_char):
        rest = rest[: s.first_char] + rest[s.end_char :]
    assert leak.find_leaks(spark.createDataFrame([(1, rest)], "doc_id bigint, text string"), e).count() == 0
    assert rest.count("Some text comes first.") == 2 and rest.count("And some other text follows here.") == 2


def test_items_without_use(spark):
    assert found(spark, [around(" ".join(ITEM))], [(1, None, None), (2, "", ""), (3, "", "too short"), (4, None, " ".join(ITEM)), (None, "", " ".join(ITEM))]) == {(0, 4)}


def test_nothing(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, "", " ".join(ITEM))], "item_id bigint, opening string, text string")
    assert leak.find_leaks(d, e).count() == 0
    assert leak.find_leaks(spark.createDataFrame([(1, "some text " * 40)], "doc_id bigint, text string"), e.limit(0)).count() == 0


def test_shards_change_nothing(spark, monkeypatch):
    items = leak.Items([(i, "", " ".join(passage(50, i))) for i in range(8)])
    r = random.Random(3)
    docs = []
    for i in range(60):
        w = [r.choice(WORDS) for _ in range(80)]
        if i % 3 == 0:
            w[20:20] = passage(50, i % 8)[5:35]
        docs.append(np.array([items.vocabulary.get(x.encode(), 0) for x in w], np.int64))
    whole = leak._scan_shard(list(range(60)), docs, items)
    parts = [x for a in range(0, 60, 7) for x in leak._scan_shard(list(range(a, min(a + 7, 60))), docs[a : a + 7], items)]
    assert sorted(whole) == sorted(parts) and {(d, i) for d, i, *_ in whole} >= {(i, i % 8) for i in range(0, 60, 3)}


def test_items_are_searched_in_blocks(spark, monkeypatch):
    items = [(i, "", " ".join(passage(50, i))) for i in range(9)] + [(None, "", "x"), (20, "", None)]
    texts = [around(" ".join(passage(50, i)[10:40])) for i in range(9)] + [None]
    whole = found(spark, texts, items)
    monkeypatch.setattr(leak, "MAX_ITEM_WORDS", 120)
    assert found(spark, texts, items) == whole == {(i, i) for i in range(9)}


def test_hostile_markup_is_read_in_time():
    for t in ("\\cite{" * 50000, "\\cite[" * 50000, "[abc1999" * 50000, "-\n" * 100000, "\\" * 100000, "{}" * 100000):
        leak.words_of(t)
