"""Evaluation passages inside training text: an FM-index per shard of the corpus, searched by all test items."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of a passage, edits allowed (one in), and the exact words every such passage must hold:
#: 20 words with 2 edits leave 3 pieces of at least 6; 5 leaves room, and q-gram counting asks for MIN_SEEDS of them.
PASSAGE, ONE_IN, SEED = 20, 10, 5
MIN_SEEDS = (PASSAGE - SEED + 1) - SEED * (PASSAGE // ONE_IN)
#: Symbols of one shard, and the distance of sampled suffix positions.
SHARD, SAMPLE = 1_500_000, 8
#: Pairs of a seed's places (in documents and in items) that are listed outright; a seed with more is common.
COMMON = 1024
#: Words of an item around a seed that are compared: windows of 20 hold at most two edits, or the passage has 30 words
#: and at most three in them (see ``near_seed``); places compared at once.
WINDOWS, SHIFT, BLOCK = ((20, 18), (30, 27)), 3, 1 << 15
#: Starts and diagonals aligned at once, and the cost of what cannot be.
STARTS, NEVER = 4096, 1 << 40
#: Test items are sent to every task, so many words at once; more are searched in blocks.
MAX_ITEM_WORDS = 5_000_000

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")
_CITE = re.compile(r"\\(?:[a-zA-Z]*cite[a-zA-Z]*|[a-zA-Z]*ref|label)\*?(?:\[[^\[\]]*\])*\{[^{}]*\}")
_KEY = re.compile(r"\[[a-z]+[0-9]{4}[a-z]?(?:[,;] ?[a-z]+[0-9]{4}[a-z]?)*\]")
_ACCENT = re.compile(r"\\[\"'`^~=.](?:\{\\?([a-zA-Z])\}|\\?([a-zA-Z]))")
_COMMAND = re.compile(r"\\[a-zA-Z@]+\*?")
_BROKEN = re.compile(r"-(?<=[^\W\d_]-)[ \t]*(?:\r\n|\n|\r)[ \t%]*(?=[^\W\d_])")
_MARKS = re.compile("[\u0300-\u036f]+")
_OTHERS = re.compile("[\u0370-\u052f]")
_WORD = re.compile(r"[^\W_]+")
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнαοενικτρυχ", "aeopcyxijsdhkmtbhaovvikrpux")
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a TeX source without markup, citations, comment signs, case, punctuation and letter variants."""
    plain = text.isascii()
    t = text if plain else _INVISIBLE.sub("", text)
    if "\\" in t:
        t = _CITE.sub(" ", t.replace("\\-", "").replace("\\/", ""))
        t = _COMMAND.sub(" ", _ACCENT.sub(lambda m: m[1] or m[2], t))
    t = _BROKEN.sub("", _KEY.sub(" ", t).replace("{}", ""))
    if plain:
        return t.lower().encode("ascii").translate(_PLAIN).split()
    t = _MARKS.sub("", unicodedata.normalize("NFKD", t).lower())
    if _OTHERS.search(t):
        t = t.translate(LOOKALIKES)
    return [w.encode() for w in _WORD.findall(t)]


class _Traced:
    """A text under rewriting that knows for each character where it came from."""

    def __init__(self, text: str):
        self.text, self.at = text, np.arange(len(text))

    def sub(self, pattern: str | re.Pattern, to: str | None = "") -> _Traced:
        """Replace matches by a text, or by their own last group where ``to`` is None."""
        pieces, at, last = [], [], 0
        for m in re.finditer(re.escape(pattern) if isinstance(pattern, str) else pattern, self.text):
            pieces.append(self.text[last : m.start()])
            at.append(self.at[last : m.start()])
            if to is None:
                pieces.append(m[m.lastindex])
                at.append(self.at[m.start(m.lastindex) : m.end(m.lastindex)])
            elif to:
                pieces.append(to)
                at.append(np.full(len(to), self.at[m.start()]))
            last = m.end()
        if last:
            self.text, self.at = "".join([*pieces, self.text[last:]]), np.concatenate([*at, self.at[last:]])
        return self

    def each(self, changed: str, size: list[int]) -> _Traced:
        """Put a text in which every character became ``size`` ones."""
        self.text, self.at = changed, np.repeat(self.at, size)
        return self


def places_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``words_of`` begins and ends in the text, in characters; the end is exclusive."""
    plain = text.isascii()
    t = _Traced(text) if plain else _Traced(text).sub(_INVISIBLE)
    if "\\" in t.text:
        t.sub("\\-").sub("\\/").sub(_CITE, " ").sub(_ACCENT, None).sub(_COMMAND, " ")
    t.sub(_KEY, " ").sub("{}").sub(_BROKEN)
    if plain:
        spans = [m.span() for m in re.finditer(r"[a-zA-Z0-9]+", t.text)]
    else:
        t.each(unicodedata.normalize("NFKD", t.text), [len(unicodedata.normalize("NFKD", c)) for c in t.text])
        t.each(t.text.lower(), [len(c.lower()) for c in t.text]).sub(_MARKS)
        spans = [m.span() for m in _WORD.finditer(t.text.translate(LOOKALIKES))]
    a, b = (np.array([x[k] for x in spans], np.int64) for k in (0, 1))
    return (t.at[a], t.at[b - 1] + 1) if len(a) else (a, b)


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix order by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(s)
    if not n:
        return np.empty(0, np.int64)
    bits = max(1, int(sigma - 1).bit_length())
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        key[: max(0, n - j)] |= s[j:]
    # ends are shorter than any symbol: a true end sorts before, the tie is settled by length below
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.append(True, k[1:] != k[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        size = np.diff(np.append(np.flatnonzero(new), n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return order
        at = order[tied]
        after = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        first = rank[at]
        again = np.lexsort((after, first))
        order[tied] = at = at[again]
        first, after = first[again], after[again]
        same = np.append(False, (first[1:] == first[:-1]) & (after[1:] == after[:-1]))
        new[tied] = ~same
        rank[at] = np.maximum.accumulate(np.where(same, 0, tied))
        h *= 2


class FMIndex:
    """Burrows-Wheeler transform of a symbol sequence in a wavelet matrix, with sampled suffix positions.

    Ranks of all levels are cumulative counts, so a whole array of queries takes one look-up per level.
    """

    def __init__(self, s: np.ndarray, sigma: int):
        s = np.append(s.astype(np.int64) + 1, 0)  # a unique least symbol ends the text
        self.n, self.sigma = len(s), sigma + 1
        sa = suffix_array(s, self.sigma)
        bwt = s[sa - 1]
        self.bits = max(1, int(self.sigma - 1).bit_length())
        self.first = np.append(0, np.cumsum(np.bincount(s, minlength=self.sigma)))
        self.zeros, self.ones, level = [], [], bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.append(0, np.cumsum(bit)).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        marked = sa % SAMPLE == 0
        self.marks = np.append(0, np.cumsum(marked)).astype(np.int32)
        self.kept = sa[marked]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place of the transform."""
        lo = np.zeros_like(at)
        for lv in range(self.bits):
            bit = (symbol >> (self.bits - 1 - lv)) & 1
            ones, z = self.ones[lv], self.zeros[lv]
            o_at, o_lo = ones[at].astype(np.int64), ones[lo].astype(np.int64)
            at = np.where(bit == 1, z + o_at, at - o_at)
            lo = np.where(bit == 1, z + o_lo, lo - o_lo)
        return at - lo

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for lv in range(self.bits):
            ones, z = self.ones[lv], self.zeros[lv]
            o = ones[at].astype(np.int64)
            bit = ones[at + 1].astype(np.int64) - o
            out = (out << 1) | bit
            at = np.where(bit == 1, z + o, at - o)
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of patterns (q, k): the interval of suffixes that begin with each."""
        p = patterns.astype(np.int64) + 1
        lo, hi = np.zeros(len(p), np.int64), np.full(len(p), self.n, np.int64)
        for j in range(p.shape[1] - 1, -1, -1):
            c = p[:, j]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back by the LF mapping to the next sampled one."""
        out = np.full(len(rows), -1, np.int64)
        open_, at = np.arange(len(rows)), rows.copy()
        for step in range(SAMPLE):
            hit = self.marks[at + 1] > self.marks[at]
            out[open_[hit]] = self.kept[self.marks[at[hit]]] + step
            open_, at = open_[~hit], at[~hit]
            if not len(open_):
                break
            c = self.symbol(at)
            at = self.first[c] + self.rank(c, at)
        return out


class Items:
    """Test items as word ids, and all their seeds grouped by content."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.words = [], []
        for item, opening, text in rows:
            if text is None or item is None:
                continue
            if opening and text.startswith(opening):
                text = text[len(opening) :]
            w = words_of(text)
            if len(w) >= PASSAGE:
                self.ids.append(item)
                self.words.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64))
        grams = [np.lib.stride_tricks.sliding_window_view(w, SEED) for w in self.words]
        flat = np.concatenate(grams) if grams else np.empty((0, SEED), np.int64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        self.seeds, kind = np.unique(flat, axis=0, return_inverse=True)
        kind = kind.ravel()
        order = np.argsort(kind, kind="stable")
        self.owner, self.pos = owner[order], pos[order]
        self.start = np.append(0, np.cumsum(np.bincount(kind, minlength=len(self.seeds)))) if len(flat) else np.zeros(1, np.int64)


def starts_of(doc: np.ndarray, item: np.ndarray, i0: np.ndarray, d0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the item, in the document) where a passage around the seeds may begin.

    Every place where an exact run begins is a start, on the seeds' diagonals or so many beside them as a passage may have
    edits; words before it could only prolong the passage.
    """
    m = len(item)
    band = m // ONE_IN
    pad = m + 2 * band
    padded = np.concatenate([np.zeros(pad, np.int64), doc, np.zeros(pad, np.int64)])
    diags = np.unique((np.unique(d0 - i0)[:, None] + np.arange(-band, band + 1)).ravel())
    rows = np.lib.stride_tricks.sliding_window_view(padded, m)
    si, sd = [], []
    for at in range(0, len(diags), STARTS):
        some = diags[at : at + STARTS]
        eq = rows[pad + some] == item
        eq[:, 1:] &= ~eq[:, :-1]
        r, i = np.nonzero(eq[:, : m - PASSAGE + 1])
        si.append(i)
        sd.append(some[r] + i)
    return np.concatenate(si), np.concatenate(sd)


def align(text: np.ndarray, ends: np.ndarray, sd: np.ndarray, words: np.ndarray, wi: np.ndarray, left: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Word alignment of many starts at once, one word of the item a step, in a band around each diagonal.

    Starts stand at ``text[sd]`` and ``words[wi]``; their texts end at ``ends`` and are followed by more zeros than the band is
    wide, ``left`` words of the item remain. A passage begins and ends with a word of the item that stands in the text, spans
    PASSAGE or more words of the item and has at most one edit in ten of them. The band holds every alignment that
    one edit in ten words allows. For each start (words of the item, edits, last place) of the passage with most words,
    and of the one that reaches farthest in the document; 0 and -1 where there is none.
    """
    shift = np.arange(2 * band + 1)
    doc = np.lib.stride_tricks.sliding_window_view(text, len(shift))
    cost = np.tile(np.where(shift >= band, shift - band, NEVER), (len(sd), 1))
    most, far = np.zeros((len(sd), 3), np.int64), np.full((len(sd), 3), -1, np.int64)
    open_ = np.arange(len(sd))
    for t in range(1, int(left.max()) if len(left) else 0):
        eq = doc[np.minimum(sd + t - band, ends)] == words[wi + t][:, None]
        if t + 1 >= PASSAGE:
            ok = eq & (cost * ONE_IN <= t + 1)
            hit = np.flatnonzero(ok.any(axis=1))
            if len(hit):
                held = np.where(ok[hit], cost[hit], NEVER)
                k = held.argmin(axis=1)
                most[open_[hit]] = np.stack([np.full(len(hit), t + 1), held[np.arange(len(hit)), k], sd[hit] + t + k - band], axis=1)
                k = 2 * band - ok[hit][:, ::-1].argmax(axis=1)
                last = sd[hit] + t + k - band
                more = last >= far[open_[hit], 2]
                far[open_[hit[more]]] = np.stack([np.full(len(hit), t + 1), held[np.arange(len(hit)), k], last], axis=1)[more]
        step = cost + ~eq
        np.minimum(step[:, :-1], cost[:, 1:] + 1, out=step[:, :-1])
        cost = np.minimum.accumulate(step - shift, axis=1) + shift
        live = (cost.min(axis=1) * ONE_IN <= left) & (t + 1 < left)
        if not live.all():
            open_, sd, wi, left, ends, cost = (x[live] for x in (open_, sd, wi, left, ends, cost))
            if not len(open_):
                break
    return most, far


def near_seed(docs: np.ndarray, at: np.ndarray, items: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether a passage may hold the seed at ``docs[at]`` and ``items[of]``; both arrays have 0 around their texts.

    In a passage of 20 to 29 words or of 38 and more some window of 20 words of the item has two edits at most, as three in
    each would be more than one in ten; one of 30 to 37 words has at most three in 30. Such a window holds a seed, and all its
    words but the edited ones stand in the document beside the seed, moved by no more than the edits.
    """
    reach = WINDOWS[1][0] - SEED
    around = np.arange(-reach, SEED + reach)
    word = items[of[:, None] + around]
    same = np.zeros(word.shape, bool)
    for shift in range(-SHIFT, SHIFT + 1):
        same |= word == docs[at[:, None] + around + shift]
    same &= word > 0
    total = np.concatenate([np.zeros((len(at), 1), np.int16), np.cumsum(same, axis=1, dtype=np.int16)], axis=1)
    ok = np.zeros(len(at), bool)
    for size, least in WINDOWS:
        first, last = reach - (size - SEED), reach + 1
        ok |= ((total[:, first + size : last + size] - total[:, first:last]) >= least).any(axis=1)
    return ok


def _lists(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, index) of every entry of lists that begin at ``start`` and have ``size`` entries."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Shard:
    """The seeds of all items located in the documents of one shard, and the pairs of document and item they speak for."""

    def __init__(self, docs: list[np.ndarray], items: Items):
        self.items = items
        size = np.array([len(d) for d in docs], np.int64)
        full = np.concatenate(docs) if docs else np.empty(0, np.int64)
        doc_of = np.repeat(np.arange(len(docs)), size)
        # a run of words outside the items' vocabulary is one symbol 0; so is the border of a document
        known = full > 0
        keep = known | np.append(True, known[:-1]) | np.append(True, doc_of[1:] != doc_of[:-1])[: len(full)]
        border = np.append(False, doc_of[1:] != doc_of[:-1])[: len(full)]
        where = np.flatnonzero(keep)
        extra = np.flatnonzero(border[where])
        text, where = np.insert(full[where], extra, 0), np.insert(where, extra, -1)
        index = FMIndex(text, len(items.vocabulary) + 1)
        lo, hi = index.search(items.seeds)
        hit = np.flatnonzero(hi > lo)
        kind, rows = _lists(lo[hit], (hi - lo)[hit])
        kind, place = hit[kind], where[index.locate(rows)]
        order = np.lexsort((place, kind, doc_of[place]))
        #: Occurrences in the order of document, kind of seed and place.
        self.kind, self.place = kind[order], place[order]
        self.doc = doc_of[self.place]
        self.start = np.cumsum(size) - size
        self.size = size
        gap = max(WINDOWS[1][0] + SHIFT, 2 + 2 * max((len(w) for w in items.words), default=0) // ONE_IN)
        pad = lambda words: np.concatenate([np.append(np.zeros(gap, np.int64), w) for w in words] + [np.zeros(gap, np.int64)])
        self.text, self.text_at = pad(docs), self.start + gap * (1 + np.arange(len(docs)))
        lengths = np.array([len(w) for w in items.words], np.int64)
        self.words, self.words_at = pad(items.words), np.cumsum(lengths) - lengths + gap * (1 + np.arange(len(lengths)))
        owners = items.start[1:] - items.start[:-1]
        self.common = np.bincount(self.kind, minlength=len(owners)) * owners > COMMON

    def meet(self, doc: np.ndarray, place: np.ndarray, item: np.ndarray, ipos: np.ndarray) -> np.ndarray:
        """``near_seed`` of places in documents and items, block by block."""
        at, of = self.text_at[doc] + place - self.start[doc], self.words_at[item] + ipos
        return np.concatenate([near_seed(self.text, at[i : i + BLOCK], self.words, of[i : i + BLOCK]) for i in range(0, len(at), BLOCK)] or [np.empty(0, bool)])

    def rare(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, place in the item, place) of every occurrence of seeds that are not common."""
        some = np.flatnonzero(~self.common[self.kind])
        first = self.items.start[self.kind[some]]
        owner, back = _lists(first, self.items.start[self.kind[some] + 1] - first)
        at = some[owner]
        return self.doc[at] * len(self.items.ids) + self.items.owner[back], self.items.pos[back], self.place[at]

    def shared(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, place in the item, place) of the common seeds that the document and the item of given pairs share."""
        n = len(self.items.ids)
        flat = np.repeat(np.arange(len(self.common)), self.items.start[1:] - self.items.start[:-1])
        mine = np.flatnonzero(self.common[flat])
        mine = mine[np.argsort(self.items.owner[mine], kind="stable")]
        held = np.append(0, np.cumsum(np.bincount(self.items.owner[mine], minlength=n)))
        key = self.doc * len(self.common) + self.kind
        out = []
        for i in range(0, len(pairs), 4096):
            some = pairs[i : i + 4096]
            which, k = _lists(held[some % n], held[some % n + 1] - held[some % n])
            back = mine[k]
            wanted = some[which] // n * len(self.common) + flat[back]
            lo, hi = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
            each, at = _lists(lo, hi - lo)
            out.append((some[which[each]], self.items.pos[back[each]], self.place[at]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3

    def common_pairs(self) -> np.ndarray:
        """Pairs that a common seed and the words around it speak for.

        All items are held against each of its places in blocks of a few bytes a pair. Where the words before the seed
        are equal, too, and make a common seed with it, that one has been asked already.
        """
        found = [np.empty(0, np.int64)]
        order = np.argsort(self.kind, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(self.kind, minlength=len(self.common))))
        for kind in np.flatnonzero(self.common):
            own = order[ends[kind] : ends[kind + 1]]
            a, b = self.items.start[kind], self.items.start[kind + 1]
            item, ipos = self.items.owner[a:b], self.items.pos[a:b]
            before = self.words[self.words_at[item] + ipos - 1]
            for i in range(0, len(own), max(1, (1 << 20) // max(len(item), 1))):
                some = own[i : i + max(1, (1 << 20) // max(len(item), 1))]
                doc, place = self.doc[some], self.place[some]
                earlier = self.text[self.text_at[doc] + place - self.start[doc] - 1]
                x, y = np.nonzero((earlier[:, None] != before) | (before == 0))
                # a seed one word earlier that is not common has its pair among the rare ones already
                ok = self.meet(doc[x], place[x], item[y], ipos[y])
                found.append(np.unique(doc[x[ok]] * len(self.items.ids) + item[y[ok]]))
        return np.unique(np.concatenate(found))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, place in the item, place) of all shared seeds of the pairs that may hold a passage, sorted by pair."""
        pair, ipos, place = self.rare()
        cells = np.unique(np.stack([pair, ipos]), axis=1)[0]
        found, count = np.unique(cells, return_counts=True)
        extra = np.zeros(len(found), np.int64)
        if self.common.any():
            few = found[count < MIN_SEEDS]
            more = np.unique(np.stack(self.shared(few)[:2]), axis=1)[0]
            np.add.at(extra, np.searchsorted(found, more), 1)
        good = found[count + extra >= MIN_SEEDS]
        if self.common.any():
            good = np.union1d(good, self.common_pairs())
        mine = np.isin(pair, good)
        every = [np.concatenate(c) for c in zip((pair[mine], ipos[mine], place[mine]), self.shared(good) if self.common.any() else (np.empty(0, np.int64),) * 3)]
        n = len(self.items.ids)
        every[0], every[1], every[2] = np.unique(np.stack(every), axis=1) if len(every[0]) else every
        ok = self.meet(every[0] // n, every[2], every[0] % n, every[1]) if len(every[0]) else np.empty(0, bool)
        mine = np.isin(every[0], every[0][ok])
        return tuple(c[mine] for c in every)


def passages(shard: Shard, docs: list[np.ndarray]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By pair (words of the item, edits, first and last word in the document) of the accepted passages, but for those within another."""
    pair, ipos, place = shard.pairs()
    items, n = shard.items, len(shard.items.ids)
    queue: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for part in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(pair)) + 1) if len(pair) else []:
        p = int(pair[part[0]])
        d, it = divmod(p, n)
        queue.setdefault(len(items.words[it]) // ONE_IN, []).append((p, *starts_of(docs[d], items.words[it], ipos[part], place[part] - shard.start[d])))
    found: list[tuple[np.ndarray, ...]] = []
    for band, many in queue.items():
        of = np.repeat(np.array([p for p, _, _ in many]), [len(si) for _, si, _ in many])
        si, sd = (np.concatenate([x[k] for x in many]) for k in (1, 2))
        for i in range(0, len(of), STARTS):
            p, s, first = of[i : i + STARTS], si[i : i + STARTS], sd[i : i + STARTS]
            base = shard.text_at[p // n]
            size = np.array([len(items.words[x]) for x in (p % n).tolist()])
            for best in align(shard.text, base + shard.size[p // n], base + first, shard.words, shard.words_at[p % n] + s, size - s, band):
                ok = best[:, 0] > 0
                found.append((p[ok], first[ok], best[ok, 2] - base[ok], best[ok, 0], best[ok, 1]))
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    if found:
        p, first, last, words, edits = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((edits, -words, -last, first, p))
        p, first, last, words, edits = p[order], first[order], last[order], words[order], edits[order]
        if len(p):
            far = last + np.cumsum(np.append(False, p[1:] != p[:-1])) * (last.max() + 1)  # a later pair always reaches farther
            new = np.append(True, far[1:] > np.maximum.accumulate(far)[:-1])
        else:
            new = np.empty(0, bool)
        for x in zip(*(c[new].tolist() for c in (p, words, edits, first, last))):
            out.setdefault(x[0], []).append(x[1:])
    return out


def _scan_shard(keys: list, docs: list[np.ndarray], items: Items) -> list[tuple]:
    """Leaks of one shard: index, search, locate, choose pairs of document and item by their seeds, align their words."""
    if not docs or not len(items.seeds):
        return []
    n = len(items.ids)
    return [(keys[p // n], items.ids[p % n], *x) for p, many in passages(Shard(docs, items), docs).items() for x in many]


def _scan(batches: Iterator[pa.RecordBatch], key: str, text: str, items: Items, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    docs: list[np.ndarray] = []
    words = 0
    get = items.vocabulary.get

    def flush() -> Iterator[pa.RecordBatch]:
        rows, places = [], {}
        for d, item, *x in _scan_shard(list(range(len(held))), docs, items):
            if d not in places:
                places[d] = places_of(held[d][1])
            begin, end = places[d]
            rows.append((held[d][0], item, *x, int(begin[x[2]]), int(end[x[3]])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        held.clear()
        docs.clear()

    for b in batches:
        for k, t in zip(b.column(key).to_pylist(), b.column(text)):
            t = t.as_py()
            if not t:
                continue
            w = words_of(t)
            if len(w) < PASSAGE - PASSAGE // ONE_IN:
                continue
            held.append((k, t))
            docs.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
            words += len(w)
            if words >= SHARD:
                yield from flush()
                words = 0
    if docs:
        yield from flush()


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document and item where the text holds 20 or more successive words of the item after its opening.

    ``doc_id, item_id, n_words, n_edits, first_word, last_word, first_char, end_char``: every passage with its words in the
    document and its characters in the raw text (from 0, the end exclusive), but for passages that lie within another
    one of the same item. Markup, citations, comment signs, case, punctuation, line breaks and letter variants do not
    count, and one word in ten may be changed, dropped or added. Null and empty texts, items without text or
    with fewer than 20 words give nothing; repeated keys each give their rows.

    Map-only: each task indexes its documents shard by shard (whole texts, a shard is closed by its number of
    words) and searches all items at once. The items are the only thing sent to the tasks, in blocks of about
    ``MAX_ITEM_WORDS`` words; each block is a scan of the documents.
    """
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-size // MAX_ITEM_WORDS))
    kind = dict(docs.dtypes)[key]
    names = ("item_id", "n_words", "n_edits", "first_word", "last_word", "first_char", "end_char")
    arrow = pa.schema([(key, pa.int64() if kind == "bigint" else pa.string()), *[(c, pa.int64()) for c in names]])
    found = []
    for i in range(blocks):
        block = items.select("item_id", "opening", "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        shared = docs.sparkSession.sparkContext.broadcast(Items([(r[0], r[1], r[2]) for r in block.collect()]))
        found.append(docs.select(key, text).mapInArrow(lambda it, shared=shared: _scan(it, key, text, shared.value, arrow), ", ".join([f"{key} {kind}", *[f"{c} bigint" for c in names]])))
    return reduce(DataFrame.unionByName, found)


def merge_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Removal spans ``key, first_word, last_word, first_char, end_char, n_items`` of each document: its overlapping passages as one.

    Words and characters are counted from 0 as in ``find_leaks``: without the characters from ``first_char`` up to ``end_char``
    of its spans a text holds no passage any more. Passages that share no word stay apart, also
    side by side; ``n_items`` is the number of test items in a span. Passages of a null key have no document and
    are dropped; documents that repeat a key must be told apart beforehand.
    """
    w = Window.partitionBy(key).orderBy("first_word", "last_word")
    before = F.max("last_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("first_word") > before), 1).otherwise(0)
    runs = spans.filter(F.col(key).isNotNull()).withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(w))
    out = runs.groupBy(key, "_run").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.min("first_char").alias("first_char"), F.max("end_char").alias("end_char"), F.count_distinct("item_id").alias("n_items"))
    return out.select(key, "first_word", "last_word", "first_char", "end_char", "n_items")
