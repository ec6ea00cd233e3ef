"""Encoding of a corpus with a public byte-level BPE vocabulary, boundaries found without regular expressions."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Code points that the pattern's \s matches.
SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Distinct pre-tokens one worker remembers.
CACHE = 1_000_000
#: Characters handled at once.
CHUNK = 4_000_000


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(SPACES)] = SPACE
    return table


#: What the automaton reads: a character's class, for apostrophes with the length of the contraction that the next letters
#: spell, for blanks whether they end their run before other text; and whether the character begins a text.
WORD, DIGIT, SIGN, SHORT, LONG, BLANK, GAP, BREAK, SYMBOLS = *range(8), 8
#: Its states: nothing open; inside a run of letters, numbers, signs or blanks; after a space that the next token takes
#: along; before the last one or two letters of a contraction.
START, IN_WORD, IN_DIGITS, IN_SIGNS, IN_BLANKS, AFTER_GAP, ONE_MORE, TWO_MORE, STATES = *range(8), 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether the character starts a pre-token."""
    if state in (ONE_MORE, TWO_MORE):
        return (START if state == ONE_MORE else ONE_MORE), False
    if symbol in (GAP, BREAK):
        return (AFTER_GAP if symbol == GAP else START), True
    if symbol == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    if symbol in (SHORT, LONG):
        if state in (IN_SIGNS, AFTER_GAP):
            return IN_SIGNS, False
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    run = {WORD: IN_WORD, DIGIT: IN_DIGITS, SIGN: IN_SIGNS}[symbol]
    return run, state not in (run, AFTER_GAP)


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next state, starts a token, function of a symbol, composition, values of a function).

    Every symbol is a function of states. All functions that sequences of symbols can be are found by composing
    until nothing new comes; their composition is a table, so a function is one number.
    """
    step = [[_step(s, x) if x < SYMBOLS else (_step(START, x - SYMBOLS)[0], True) for x in range(2 * SYMBOLS)] for s in range(STATES)]
    nexts, starts = (np.array([[pair[i] for pair in row] for row in step], np.uint8) for i in (0, 1))
    known = {tuple(range(STATES)): 0}
    for f in map(tuple, nexts.T.tolist()):
        known.setdefault(f, len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in map(tuple, nexts.T.tolist()):
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    values = np.array(list(known), np.uint8)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in known] for f in known], np.uint16)
    symbol = np.array([known[tuple(f)] for f in nexts.T.tolist()], np.uint16)
    return nexts, starts, symbol, compose, values


def _exclusive(functions: np.ndarray) -> np.ndarray:
    """Composition of all functions before each one: blocks side by side, then the same over their totals."""
    compose = automaton()[3]
    n = len(functions)
    if n < 2:
        return np.zeros(n, np.uint16)
    width = max(2, min(256, int(n**0.5)))
    size = -(-n // width)
    grid = np.zeros(size * width, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(size, width).T)
    total = grid[0]
    for row in grid[1:]:
        total = compose[total, row]
    held = _exclusive(total)
    out = np.empty_like(grid)
    for j, row in enumerate(grid):
        out[j] = held
        held = compose[held, row]
    return out.T.ravel()[:n]


def boundaries(cp: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """True at each code point that starts a pre-token; ``texts`` holds the start of every text in ``cp``.

    The pattern is an automaton over the classes of the code points, with what its alternatives look ahead at put
    into the class. The characters' transition functions compose associatively: blocks of characters are composed side by
    side, a scan over the blocks gives the state each begins in, and from there all blocks step on together.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    k = classes()[cp]
    symbol = np.array([SIGN, WORD, DIGIT, BREAK], np.uint8)[k]
    first = np.zeros(n + 1, bool)
    first[texts[texts < n]] = True
    first[0] = first[n] = True
    # blanks with more blanks or nothing behind them
    blank = k == SPACE
    goes_on = first[1:].copy()
    goes_on[:-1] |= blank[1:]
    symbol[blank & goes_on] = BLANK
    symbol[blank & ~goes_on & (cp == 32)] = GAP
    at = np.flatnonzero(cp == 39)
    if len(at):
        a, b = np.minimum(at + 1, n), np.minimum(at + 2, n)
        one, two = (np.append(cp, 0)[x] for x in (a, b))
        one = np.where(first[a], 0, one)
        two = np.where(first[b] | first[a], 0, two)
        symbol[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[at[double]] = LONG
    symbol[first[:n]] += SYMBOLS
    nexts, starts, function, compose, values = automaton()
    width = max(1, min(256, int(n**0.5)))
    size = -(-n // width)
    grid = np.full(size * width, WORD, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(size, width).T)
    # tables are flat and hold rows' begins, so that a step is one addition and one look-up
    after = compose[:, function].astype(np.intp).ravel() * (2 * SYMBOLS)  # a function followed by a symbol
    total = np.zeros(size, np.intp)
    for row in grid:
        total = after.take(total + row)
    state = values[_exclusive((total // (2 * SYMBOLS)).astype(np.uint16)), START].astype(np.intp) * (2 * SYMBOLS)
    step, starts = nexts.astype(np.intp).ravel() * (2 * SYMBOLS), starts.ravel()
    out = np.empty((width, size), np.uint8)
    for j, row in enumerate(grid):
        at = state + row
        starts.take(at, out=out[j])
        state = step.take(at)
    return out.T.ravel()[:n].view(bool)


class Merger:
    """Ids of pre-tokens, remembered by content.

    Three levels: a direct-mapped table over the first 16 bytes that whole arrays of pre-tokens are looked up
    in at once, a dictionary for what misses it or is longer, and pair merging for what is new.
    """

    SLOTS = 1 << 17

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.new: list[list[int]] = []
        self.base, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.lo, self.hi = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.size, self.kind = np.zeros(self.SLOTS, np.int64), np.zeros(self.SLOTS, np.int64)

    def kind_of(self, piece: bytes) -> int:
        found = self.known.get(piece)
        if found is None:
            rank = self.ranks.get(piece)
            found = self.known[piece] = len(self.known)
            self.new.append([rank] if rank is not None else self.merge(piece))
        return found

    def kinds(self, data: bytes, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The kind of each pre-token ``data[at:stop]``; kinds index ``base`` and ``length``."""
        words = np.lib.stride_tricks.as_strided(np.frombuffer(data + bytes(16), np.uint8), (len(data) + 9, 8), (1, 1))
        n = stop - at
        keep = np.append(np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.arange(1, 9, dtype=np.uint64) * np.uint64(8)))
        lo = words[at].view(np.uint64).ravel() & keep[np.minimum(n, 8)]
        hi = np.zeros(len(at), np.uint64)
        longer = np.flatnonzero(n > 8)
        hi[longer] = words[at[longer] + 8].view(np.uint64).ravel() & keep[np.minimum(n[longer] - 8, 8)]
        with np.errstate(over="ignore"):
            h = (lo ^ (hi * np.uint64(0x9E3779B97F4A7C15)) ^ n.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        slot = ((h ^ (h >> np.uint64(32))) & np.uint64(self.SLOTS - 1)).astype(np.int64)
        out = self.kind[slot]
        miss = np.flatnonzero((self.lo[slot] != lo) | (self.hi[slot] != hi) | (self.size[slot] != n))
        if len(miss):
            out[miss] = got = np.fromiter(map(self.kind_of, map(data.__getitem__, map(slice, at[miss].tolist(), stop[miss].tolist()))), np.int64, len(miss))
            short = n[miss] <= 16
            m, s = miss[short], slot[miss[short]]
            s, one = np.unique(s, return_index=True)
            m = m[one]
            self.lo[s], self.hi[s], self.size[s], self.kind[s] = lo[m], hi[m], n[m], got[short][one]
        if self.new:
            length = np.fromiter(map(len, self.new), np.int64, len(self.new))
            self.base = np.append(self.base, len(self.flat) + np.cumsum(length) - length)
            self.length = np.append(self.length, length)
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(self.new), np.int32, int(length.sum())))
            self.new = []
        return out

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        n = len(piece)
        if n > 400:
            return self.merge_long(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        none = len(ranks) + 1
        score = [ranks.get(parts[i] + parts[i + 1], none) for i in range(n - 1)]
        while score:
            best = min(score)
            if best == none:
                break
            i = score.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del score[i]
            if i < len(score):
                score[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                score[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap over a linked list: n log n for very long pieces."""
        import heapq

        n, ranks = len(piece), self.ranks
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or part[i] + part[j] != pair:
                continue
            part[i], part[j] = pair, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := ranks.get(part[a] + part[after[a]])) is not None:
                    heapq.heappush(heap, (r, a, part[a] + part[after[a]]))
        return [ranks[p] for p in part if p is not None]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(read_ranks(path))


def encode_texts(texts: pa.Array, merge: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ids per text, byte end of each id's pre-token in its text) of a string array; null and empty texts have no ids."""
    texts = texts.fill_null("").cast(pa.large_string())
    size = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].to_pybytes()[size[0] : size[-1]] if len(texts) and texts.buffers()[2] is not None else b""
    if not data:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64), np.empty(0, np.int64)
    size = size - size[0]
    raw = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    begin = np.searchsorted(lead, size[:-1])
    at = lead[boundaries(cp, begin)]
    stop = np.append(at[1:], len(data))
    if len(merge.known) > CACHE:
        merge.reset()
    kinds = merge.kinds(data, at, stop)
    each = merge.length[kinds]
    where = np.repeat(merge.base[kinds] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    ends = np.append(0, np.cumsum(each))
    per_text = np.diff(ends[np.searchsorted(at, size)])
    return merge.flat[where], per_text, np.repeat(stop, each) - np.repeat(size[:-1], per_text)


def _encode(batches: Iterator[pa.RecordBatch], key: str, text: str, path: str, offsets: bool) -> Iterator[pa.RecordBatch]:
    merge = merger(path)
    for b in batches:
        texts = b.column(text)
        chars = np.append(0, np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)))
        i = 0
        while i < len(b):
            j = max(i + 1, int(np.searchsorted(chars, chars[i] + CHUNK, "right")) - 1)
            ids, n, ends = encode_texts(texts.slice(i, j - i), merge)
            at = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            out = {key: b.column(key).slice(i, j - i), "ids": pa.ListArray.from_arrays(at, pa.array(ids))}
            if offsets:
                out["ends"] = pa.ListArray.from_arrays(at, pa.array(ends.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
            i = j


def encode_corpus(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """One row per document: its key and ``ids array<int>`` without special tokens.

    Null and empty texts get an empty list, a null key stays null, repeated keys each keep their row. Strings
    that look like special tokens are ordinary text. Map-only: nothing is shuffled, and a worker holds a
    few million characters at a time, so very long texts only cost their own size. ``path`` names the
    vocabulary, which every worker must be able to read. With ``offsets`` there is also ``ends array<int>``: for each
    id the byte of the text where its pre-token ends, so that any range of ids can be cut back out of the text.
    """
    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(lambda it: _encode(it, key, text, path, offsets), f"{key} {kind}, ids array<int>" + ", ends array<int>" * offsets)


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of ids."""
    back = {v: k for k, v in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")
