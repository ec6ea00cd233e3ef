"""Abusive, hateful or sexual content: a bidirectional GRU with attention pooling over word and character inputs."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamap.llm.leak import LOOKALIKES

#: Bytes of a token at most, and the step between the overlapping pieces that longer ones (text without blanks) are cut into.
TOKEN, PIECE = 64, 48
#: Tokens of a window and the step between windows: every token stands in two of them.
WINDOW, STEP = 24, 12
#: Bounds of the training sample: documents labelled abusive and not abusive, and characters of one of them (longer ones
#: are not trained on; all are scored whole).
MAX_LABELLED, MAX_TRAIN_CHARS = (1500, 3500), 200_000
#: Hash buckets of words and of character trigrams, their width, and the hidden width of one direction.
WORDS, GRAMS, DIM, HIDDEN = 1 << 15, 1 << 14, 16, 16
#: Word types whose projections a worker remembers, and windows it scores at once.
TYPES, BATCH = 150_000, 1024

_INNER = re.compile(r"\\(?:textbf|emph|textit|textsc|texttt|underline)\{(\w{1,3})\}(?=\w)")
_COMMAND = re.compile(r"\\[a-zA-Z@]+\*?")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_IGNORED = re.compile("[\u00ad\u0300-\u036f\u200b-\u200f\u2060\ufeff]+")
_SIGNS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]+")
_SPELLED = re.compile(rb" [a-z](?: [a-z]){2,}(?= )")
#: Signs that may stand inside a disguised word, and the letters that figures and signs stand for.
INSIDE = b"*@$!"
LEET = bytes.maketrans(b"0134579@$!", b"oieastgasi")
_LEETED = re.compile(rb"(?<=[a-z])[0134579@$!]+(?=[a-z])")
_REPEAT = re.compile(rb"([a-z])\1\1+")
_KEEP = bytes(c if (c < 128 and chr(c).isalnum()) or c in INSIDE or c >= 128 else 32 for c in range(256))


@lru_cache(100_000)
def _fold(run: str) -> str:
    """Plain form of a run of characters outside ASCII: compatibility form without marks, look-alikes as Latin."""
    return _SIGNS.sub(" ", _IGNORED.sub("", unicodedata.normalize("NFKD", run)).lower().translate(LOOKALIKES))


def _inner(m: re.Match) -> str:
    return m[1] if m.start() and m.string[m.start() - 1].isalnum() else m[0]


def tokens_of(text: str) -> list[bytes]:
    """Lower-case tokens with disguises undone as far as plain rules can.

    Invisible characters, TeX breaks inside words and small inner markup go; look-alike letters, accents and
    compatibility forms become plain; letters spelled out one by one are joined. Figures and signs inside
    words stay here and are read as letters by ``features``. Tokens of more than ``TOKEN`` bytes become overlapping pieces.
    """
    t = text if text.isascii() else _FOREIGN.sub(lambda m: _fold(m[0]), text)
    if "\\" in t:
        t = _COMMAND.sub(" ", _INNER.sub(_inner, t.replace("\\-", "").replace("\\/", "")))
    words = t.replace("{}", "").lower().encode("utf-8", "replace").translate(_KEEP).split()
    tokens = _SPELLED.sub(lambda m: b" " + m[0].replace(b" ", b""), b" " + b" ".join(words) + b" ").split()
    if not tokens or max(map(len, tokens)) <= TOKEN:
        return tokens
    return [piece for x in tokens for piece in ([x] if len(x) <= TOKEN else [x[i : i + TOKEN] for i in range(0, len(x) - TOKEN + PIECE, PIECE)])]


def features(word: bytes) -> tuple[int, np.ndarray]:
    """Bucket of the word and of its character trigrams.

    Signs around it go, figures and signs between letters become letters, a letter repeated three times or
    more stands once, stars of a masked word stay; all numbers and lone signs are one word.
    """
    w = _REPEAT.sub(rb"\1", _LEETED.sub(lambda m: m[0].translate(LEET), word.strip(INSIDE)))
    if not w or w.isdigit():
        w = b"0"
    c = b"<" + w + b">"
    return zlib.crc32(w) % WORDS, np.array([zlib.crc32(c[i : i + 3]) % GRAMS for i in range(len(c) - 2)] or [0])


def sum_by(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by index, for indexes 0..n-1 that all occur."""
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(n))
    return np.add.reduceat(values[order], starts, axis=0)


@dataclass
class Model:
    """Weights. Gates stand side by side: update, reset, candidate; axis 0 of GRU weights is the direction."""

    word: np.ndarray
    gram: np.ndarray
    w_in: np.ndarray
    b_in: np.ndarray
    w_rec: np.ndarray
    att_w: np.ndarray
    att_v: np.ndarray
    out_w: np.ndarray
    out_b: np.ndarray
    threshold: float = 0.5

    NAMES = ("word", "gram", "w_in", "b_in", "w_rec", "att_w", "att_v", "out_w", "out_b")

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        g = lambda *s, k=0.1: (r.standard_normal(s) * k).astype(np.float32)
        return cls(g(WORDS, DIM, k=0.02), g(GRAMS, DIM, k=0.1), g(2, 2 * DIM, 3 * HIDDEN, k=0.25), np.zeros((2, 3 * HIDDEN), np.float32), g(2, HIDDEN, 3 * HIDDEN, k=0.25), g(2 * HIDDEN, HIDDEN, k=0.25), g(HIDDEN, k=0.25), g(4 * HIDDEN, k=0.25), np.array([-1.0], np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def run_gru(x: np.ndarray, w_rec: np.ndarray, keep: bool = False):
    """Hidden states (T, B, H) of one direction over projected inputs (T, B, 3H)."""
    steps, n = x.shape[:2]
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    kept = []
    zr, cand = w_rec[:, : 2 * HIDDEN], w_rec[:, 2 * HIDDEN :]
    for t in range(steps):
        g = h @ zr
        g += x[t, :, : 2 * HIDDEN]
        g *= 0.5
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        c = (r * h) @ cand
        c += x[t, :, 2 * HIDDEN :]
        np.tanh(c, out=c)
        before = h
        h = before + z * (c - before)
        out[t] = h
        if keep:
            kept.append((before, z, r, c))
    return out, kept


def pooled(both: np.ndarray, m: Model):
    """Attention and maximum over time of (T, B, 2H) states: (B, 4H) and what a backward pass needs."""
    a = np.tanh(both @ m.att_w)
    e = a @ m.att_v
    e = np.exp(e - e.max(axis=0))
    e /= e.sum(axis=0)
    att = np.einsum("tb,tbh->bh", e, both)
    top = both.argmax(axis=0)
    return np.concatenate([att, np.take_along_axis(both, top[None], 0)[0]], axis=1), a, e, top


def forward(x: np.ndarray, m: Model) -> np.ndarray:
    """Logits of windows from the projected inputs of both directions, (T, B, 6H)."""
    f, _ = run_gru(x[:, :, : 3 * HIDDEN], m.w_rec[0])
    b, _ = run_gru(x[::-1, :, 3 * HIDDEN :], m.w_rec[1])
    b = b[::-1]
    e = (np.tanh(f @ m.att_w[:HIDDEN] + b @ m.att_w[HIDDEN:])) @ m.att_v
    e = np.exp(e - e.max(axis=0))
    e /= e.sum(axis=0)
    parts = [np.einsum("tb,tbh->bh", e, f), np.einsum("tb,tbh->bh", e, b), f.max(axis=0), b.max(axis=0)]
    return np.concatenate(parts, axis=1) @ m.out_w + m.out_b


class Vocabulary(dict):
    """Word types seen so far, numbered, with their features in one flat layout."""

    def __init__(self):
        super().__init__({b"": 0})
        self.words, self.grams = [0], [np.array([0])]

    def __missing__(self, word: bytes) -> int:
        a, b = features(word)
        self.words.append(a)
        self.grams.append(b)
        self[word] = len(self.words) - 1
        return len(self.words) - 1

    def __call__(self, tokens: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def flat(self, lo: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = self.grams[lo:]
        size = np.array([len(g) for g in part])
        return np.array(self.words[lo:]), (np.concatenate(part) if part else np.empty(0, np.int64)), size


def embed(m: Model, words: np.ndarray, grams: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(types, 2 DIM): the word's vector beside the mean of its trigrams' vectors."""
    start = np.cumsum(size) - size
    mean = np.add.reduceat(m.gram[grams], start, axis=0) / size[:, None]
    return np.concatenate([m.word[words], mean], axis=1).astype(np.float32)


def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows over n tokens; the last reaches the end."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    s = np.arange(0, n - WINDOW + 1, STEP)
    return s if s[-1] == n - WINDOW else np.append(s, n - WINDOW)


def cut_windows(ids: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) type ids; a short text is filled with the empty type 0."""
    s = window_starts(len(ids))
    if len(ids) < WINDOW:
        ids = np.append(ids, np.zeros(WINDOW - len(ids), np.int64))
    return ids[s[:, None] + np.arange(WINDOW)]


@dataclass
class Adam:
    rate: float
    state: dict = field(default_factory=dict)
    t: int = 0

    def step(self, name: str, p: np.ndarray, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(p), np.zeros_like(p)))
        if rows is None:
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= self.rate * m / (np.sqrt(v) + 1e-6)
        else:
            m[rows] = 0.9 * m[rows] + 0.1 * g
            v[rows] = 0.99 * v[rows] + 0.01 * g * g
            p[rows] -= self.rate * m[rows] / (np.sqrt(v[rows]) + 1e-6)


def train_batch(m: Model, opt: Adam, win: np.ndarray, y: np.ndarray, weight: np.ndarray, lex: tuple, rng: np.random.Generator) -> float:
    """One step of back-propagation through both directions; returns the loss."""
    words, grams, size, start = lex
    kinds, inv = np.unique(win, return_inverse=True)
    inv = inv.reshape(win.shape).T  # (T, B)
    gs = size[kinds]
    at = np.repeat(start[kinds] - (np.cumsum(gs) - gs), gs) + np.arange(int(gs.sum()))
    g_ids, owner = grams[at], np.repeat(np.arange(len(kinds)), gs)
    e = embed(m, words[kinds], g_ids, gs)
    hide = np.ones((len(kinds), 2), np.float32)
    hide[rng.random(len(kinds)) < 0.2, 0] = 0
    e[:, :DIM] *= hide[:, :1]
    x = e[inv]
    steps, n = inv.shape
    proj = [(x.reshape(-1, 2 * DIM) @ m.w_in[k] + m.b_in[k]).reshape(steps, n, -1) for k in (0, 1)]
    f, kf = run_gru(proj[0], m.w_rec[0], True)
    b, kb = run_gru(proj[1][::-1], m.w_rec[1], True)
    both = np.concatenate([f, b[::-1]], axis=2)
    pool, a, att, top = pooled(both, m)
    logit = pool @ m.out_w + m.out_b
    p = sigmoid(logit)
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).mean())
    d = (weight * (p - y) / n).astype(np.float32)
    grad = {"out_w": pool.T @ d, "out_b": np.array([d.sum()], np.float32)}
    dpool = d[:, None] * m.out_w
    datt, dtop = dpool[:, : 2 * HIDDEN], dpool[:, 2 * HIDDEN :]
    dboth = att[:, :, None] * datt[None]
    np.put_along_axis(dboth, top[None], np.take_along_axis(dboth, top[None], 0) + dtop[None], 0)
    de = np.einsum("tbh,bh->tb", both, datt)
    de = att * (de - (att * de).sum(axis=0))
    grad["att_v"] = np.einsum("tb,tbh->h", de, a)
    da = de[:, :, None] * m.att_v * (1 - a * a)
    grad["att_w"] = both.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, HIDDEN)
    dboth += da @ m.att_w.T
    dx = np.zeros_like(x)
    grad["w_in"], grad["b_in"], grad["w_rec"] = np.zeros_like(m.w_in), np.zeros_like(m.b_in), np.zeros_like(m.w_rec)
    for k, kept, dh_out in ((0, kf, dboth[:, :, :HIDDEN]), (1, kb, dboth[::-1, :, HIDDEN:])):
        zr, cand = m.w_rec[k][:, : 2 * HIDDEN], m.w_rec[k][:, 2 * HIDDEN :]
        dh = np.zeros((n, HIDDEN), np.float32)
        dproj = np.empty((steps, n, 3 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, c = kept[t]
            dh = dh + dh_out[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - before) * z * (1 - z)
            drh = dc @ cand.T
            dr = drh * before * r * (1 - r)
            dg = np.concatenate([dz, dr], axis=1)
            dproj[t, :, : 2 * HIDDEN], dproj[t, :, 2 * HIDDEN :] = dg, dc
            grad["w_rec"][k][:, : 2 * HIDDEN] += before.T @ dg
            grad["w_rec"][k][:, 2 * HIDDEN :] += (r * before).T @ dc
            dh = dh * (1 - z) + drh * r + dg @ zr.T
        if k:
            dproj = dproj[::-1]
        flat = dproj.reshape(-1, 3 * HIDDEN)
        grad["w_in"][k] = x.reshape(-1, 2 * DIM).T @ flat
        grad["b_in"][k] = flat.sum(axis=0)
        dx += (flat @ m.w_in[k].T).reshape(x.shape)
    dk = sum_by(inv.ravel(), dx.reshape(-1, 2 * DIM), len(kinds))
    dk[:, :DIM] *= hide[:, :1]
    norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()) + float((dk * dk).sum()))
    scale = min(1.0, 1.0 / (norm + 1e-9))
    for name, g in grad.items():
        opt.step(name, getattr(m, name), g * scale + 1e-4 * getattr(m, name) * (name in ("w_in", "w_rec", "att_w", "out_w")))
    rows, at = np.unique(words[kinds], return_inverse=True)
    gw = sum_by(at, dk[:, :DIM] * scale, len(rows))
    opt.step("word", m.word, gw + 3e-5 * m.word[rows], rows)
    rows, at = np.unique(g_ids, return_inverse=True)
    gg = sum_by(at, (dk[:, DIM:] / gs[:, None]).astype(np.float32)[owner] * scale, len(rows))
    opt.step("gram", m.gram, gg, rows)
    return loss


def project(m: Model, e: np.ndarray) -> np.ndarray:
    """(types, 6H): input projections of word types for both directions side by side."""
    return np.concatenate([e @ m.w_in[k] + m.b_in[k] for k in (0, 1)], axis=1).astype(np.float32)


def score_windows(m: Model, proj: np.ndarray, win: np.ndarray) -> np.ndarray:
    """Logits of all windows given by type ids."""
    out = np.empty(len(win), np.float32)
    for i in range(0, len(win), BATCH):
        out[i : i + BATCH] = forward(proj[win[i : i + BATCH].T], m)
    return out


def _evidence(docs: list[np.ndarray], y: np.ndarray, n_types: int) -> np.ndarray:
    """Weight of each word type for a positive document: shrunken log odds of document frequencies, floored at 0."""
    df = np.zeros((2, n_types))
    for ids, label in zip(docs, y):
        df[int(label), np.unique(ids)] += 1
    n = np.array([max((y == 0).sum(), 1), max((y == 1).sum(), 1)])
    rate = (df + 0.5) / (n[:, None] + 1)
    odds = np.log(rate[1]) - np.log(rate[0])
    return np.where((df[1] >= 2) & (odds > 1.0), odds * np.sqrt(df[1] / (df[1] + 2)), 0.0)


def train(texts: Sequence[str], labels: Sequence[int], seed: int = 7, rounds: int = 3, steps: int = 240, rate: float = 0.004) -> Model:
    """Fit on document labels, some of them wrong, by multiple instances.

    A positive document is represented by its most telling window, first by word evidence, then by the model
    itself; negative ones by their most telling and some random windows. Positive documents that no window speaks
    for lose their weight. The threshold is where the documents held out score best. Deterministic.
    """
    m, rng = Model.fresh(seed), np.random.default_rng(seed)
    y = np.asarray(labels)
    if not len(y) or y.min() == y.max():
        m.out_b[:] = -20.0
        return m
    vocab = Vocabulary()
    docs = [vocab(tokens_of(t)) for t in texts]
    wins = [cut_windows(d) for d in docs]
    of = np.repeat(np.arange(len(wins)), [len(w) for w in wins])
    win = np.concatenate(wins)
    first = np.searchsorted(of, np.arange(len(wins)))
    words, grams, size = vocab.flat()
    lex = (words, grams, size, np.cumsum(size) - size)
    held = rng.random(len(y)) < 0.2
    weigh = _evidence([d for d, h in zip(docs, held) if not h], y[~held], len(words))
    score = np.sort(weigh[win], axis=1)[:, -6:].sum(axis=1)
    opt = Adam(rate)
    code = win @ np.random.default_rng(seed).integers(1 << 30, size=WINDOW)
    common = (y == 1)[of] & np.isin(code, code[(y == 0)[of]])  # what negative documents hold, too, speaks for nothing
    score[common] = np.minimum(score[common], 0)
    for rnd in range(rounds):
        best = np.array([first[d] + int(score[first[d] : first[d] + len(wins[d])].argmax()) for d in range(len(wins))])
        pos = best[(y == 1) & ~held]
        if rnd == 0:
            pos = pos[score[pos] > _floor(score[pos], score[best[(y == 0) & ~held]])]
            if len(pos) < 4:
                pos = best[(y == 1) & ~held]
        else:
            trust = pos[(score[pos] > 0) & ~common[pos]]
            pos = trust if len(trust) >= 4 else pos
        neg_docs = np.flatnonzero((y == 0) & ~held)
        hard = best[neg_docs]
        if rnd:  # a few negative documents are mislabelled: leave out those that the model is surest about
            order = np.argsort(-score[hard])
            hard = hard[order[int(0.005 * len(order)) :]]
        rest = np.array([first[d] + int(rng.integers(len(wins[d]))) for d in neg_docs for _ in range(3)])
        neg = np.unique(np.concatenate([hard, rest]))
        copies = max(1, min(20, len(neg) // max(4 * len(pos), 1)))
        idx = np.concatenate([np.repeat(pos, copies), neg])
        lab = np.concatenate([np.ones(len(pos) * copies), np.zeros(len(neg))]).astype(np.float32)
        for _ in range(max(2, min(8, steps * 256 // len(idx)))):
            order = rng.permutation(len(idx))
            for i in range(0, len(order), 256):
                k = order[i : i + 256]
                shifted = win[idx[k]]
                blank = rng.random(shifted.shape) < 0.05
                short = (rng.random(len(k)) < 0.1) & (lab[k] == 0)  # short texts end in empty places
                blank |= short[:, None] & (np.arange(WINDOW)[None] >= rng.integers(1, WINDOW, len(k))[:, None])
                train_batch(m, opt, np.where(blank, 0, shifted), lab[k], np.ones(len(k), np.float32), lex, rng)
        score = score_windows(m, project(m, embed(m, words, grams, size)), win)
    top = np.maximum.reduceat(score, first)
    m.threshold = _threshold(top[held], y[held])
    return m


def _floor(pos: np.ndarray, neg: np.ndarray, ratio: float = 30.0) -> float:
    """The lowest evidence that positive documents exceed ``ratio`` times as often as negative ones.

    Where many negative documents are mislabelled no evidence may reach the ratio; then the best one counts.
    """
    cuts = np.unique(np.quantile(neg, np.linspace(0.5, 1, 401)))
    p, q = ((v[:, None] > cuts).mean(axis=0) for v in (pos, neg))
    r = p / np.maximum(q, 1 / max(len(neg), 1))
    good = np.flatnonzero((r >= ratio) & (p > 0))
    return float(cuts[good[0]] if len(good) else cuts[np.where(p >= 0.2 * p.max(), r, 0).argmax()])


def _threshold(top: np.ndarray, y: np.ndarray) -> float:
    """The upper quartile of the best F1 plateau on held-out documents, kept within sane bounds of the logit."""
    if y.sum() < 5:
        return 0.0
    cuts = np.linspace(-1, 3, 41)
    f1 = np.array([2 * ((top > c) & (y == 1)).sum() / max((top > c).sum() + (y == 1).sum(), 1) for c in cuts])
    return float(np.quantile(cuts[f1 >= f1.max() - 0.02], 0.75))


class Scorer:
    """Scores texts with a model; remembers the projections of word types it has met."""

    def __init__(self, m: Model):
        self.m = m
        self.reset()

    def reset(self) -> None:
        self.vocab = Vocabulary()
        self.proj = np.empty((0, 6 * HIDDEN), np.float32)

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(highest logit, windows) per text; -inf and 0 where there is no token."""
        if len(self.vocab.words) > TYPES:
            self.reset()
        wins = [cut_windows(ids) if len(ids := self.vocab(tokens_of(t) if t else ())) else np.empty((0, WINDOW), np.int64) for t in texts]
        if len(self.vocab.words) > len(self.proj):
            self.proj = np.concatenate([self.proj, project(self.m, embed(self.m, *self.vocab.flat(len(self.proj))))])
        n = np.array([len(w) for w in wins], np.int64)
        top = np.full(len(wins), -np.inf, np.float32)
        some = np.flatnonzero(n)
        if len(some):
            scores = score_windows(self.m, self.proj, np.concatenate(wins))
            top[some] = np.maximum.reduceat(scores, (np.cumsum(n) - n)[some])
        return top, n


def _score(batches: Iterator[pa.RecordBatch], model: Model, keys: Sequence[str], text: str) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for b in batches:
        for i in range(0, len(b), 256):
            part = b.slice(i, 256)
            top, n = scorer(part.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(sigmoid(np.maximum(top, -30).astype(float))), pa.array(n), pa.array(top > model.threshold)], [*keys, "score", "n_windows", "is_abusive"])


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: tuple[int, int] = MAX_LABELLED) -> tuple[list[str], list[int]]:
    """Texts and majority labels of a bounded number of documents of either label, chosen by a hash of the id.

    Null labels do not count, ties drop the document, as do null, empty and very long texts.
    """
    votes = labels.filter("doc_id is not null and is_abusive is not null").groupBy("doc_id").agg(F.avg(F.col("is_abusive").cast("double")).alias("a"))
    judged = votes.filter("a <> 0.5").select("doc_id", (F.col("a") > 0.5).cast("int").alias("y"))
    first = [judged.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, limit[0]), (0, limit[1]))]
    chosen = first[0].unionByName(first[1])
    rows = docs.select("doc_id", "text").filter(F.length("text").between(1, MAX_TRAIN_CHARS)).join(F.broadcast(chosen), "doc_id").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], [r.y for r in rows]


_TRAINED: dict[str, Model] = {}


def trained(texts: Sequence[str], labels: Sequence[int]) -> Model:
    """``train``, remembered by the content of the sample for the queries of one driver."""
    digest = hashlib.blake2b(digest_size=16)
    for t, y in zip(texts, labels):
        digest.update(f"{y} {len(t)} ".encode() + t.encode("utf-8", "surrogatepass"))
    key = digest.hexdigest()
    if key not in _TRAINED:
        if len(_TRAINED) >= 4:
            _TRAINED.pop(next(iter(_TRAINED)))
        _TRAINED[key] = train(texts, labels)
    return _TRAINED[key]


def score_documents(docs: DataFrame, labels: DataFrame, keys: Sequence[str] = ("doc_id", "source"), text: str = "text") -> DataFrame:
    """``keys, score double, n_windows bigint, is_abusive boolean`` of every document.

    The model is trained on a bounded sample of the labels and sent to the tasks (a few MB, fixed by its
    parameters); scoring is map-only and covers all overlapping windows of the whole text. A null, empty or
    tokenless text has score 0 and no windows; without labels of both kinds nothing is abusive.
    """
    model = trained(*labelled_sample(docs, labels))
    kinds = dict(docs.dtypes)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)
    names = list(keys)
    schema = ", ".join(f"{k} {kinds[k]}" for k in names) + ", score double, n_windows bigint, is_abusive boolean"
    return docs.select(*names, text).mapInArrow(lambda it: _score(it, shared.value, names, text), schema)


def rates_by_source(scored: DataFrame) -> DataFrame:
    """Documents, abusive ones and their rate per source; spellings of a source are joined, null stays its own group."""
    source = F.lower(F.btrim(F.col("source"))).alias("source")
    return scored.groupBy(source).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("is_abusive").alias("n_abusive"), F.avg(F.col("is_abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
