"""Gradients, held-out accuracy and edge cases of the abuse model."""

import numpy as np
import pytest

from stratamap.llm import abuse

RUDE = ["you are a {} and should leave", "shut up you {} nobody cares", "only a {} would write this"]
NAMES = ["moron", "idiot", "scumbag", "pig"]
CALM = ["the model converges to a stable point", "we measure the sample at low temperature", "the proof follows from the lemma above", "pigs were kept apart in the pen", "the survey asks whether a person was called an idiot", "results are listed in the table below"]


def corpus(n, seed, wrong=0.05):
    r = np.random.default_rng(seed)
    texts, truth = [], []
    for _ in range(n):
        s = [CALM[i] for i in r.integers(0, len(CALM), 12)]
        bad = r.random() < 0.3
        if bad:
            s.insert(int(r.integers(0, 12)), RUDE[r.integers(0, 3)].format(NAMES[r.integers(0, 4)]))
        texts.append(". ".join(s))
        truth.append(bad)
    truth = np.array(truth)
    return texts, truth, np.where(r.random(n) < wrong, ~truth, truth).astype(int)


@pytest.fixture(scope="module")
def model():
    texts, _, labels = corpus(500, 1)
    return abuse.train(texts, labels)


def test_held_out_accuracy_despite_wrong_labels(model):
    texts, truth, _ = corpus(300, 2)
    top, n = abuse.Scorer(model)(texts)
    said = top > model.threshold
    assert (said & truth).sum() / truth.sum() > 0.95 and (said & truth).sum() / said.sum() > 0.95
    assert (n > 1).all()


def test_disguises(model):
    texts = [f"{'. '.join(CALM)}. only a {w} would write this. {'. '.join(CALM)}" for w in ("mo​ron", "m o r o n", "mоrоn", "mo{}ron", "mo\\/ron", "MORON", "morrrron", "m-o-r-o-n", "m.o.r.o.n", "mor0n")]
    top, _ = abuse.Scorer(model)(texts)
    assert (top > model.threshold).all()


def test_tokens():
    t = lambda s: [x.decode() for x in abuse.tokens_of(s)]
    assert t("b***h Déjà vu — „nur“ x\\-y \\textbf{big}") == ["b***h", "deja", "vu", "nur", "xy", "big"]
    assert t("a b c d end") == ["abcd", "end"] and t("") == [] and t("­") == []
    same = lambda a, b: np.array_equal(abuse.features(a)[1], abuse.features(b)[1])
    assert same(b"b1tch", b"bitch") and same(b"bitttch", b"bitch") and same(b"12", b"7") and same(b"idiot!", b"idiot") and not same(b"a", b"b")


def test_windows_cover_every_token_twice():
    for n in (1, 23, 24, 25, 36, 100):
        s = abuse.window_starts(n)
        assert s[0] == 0 and max(s[-1] + abuse.WINDOW, n) == (n if n > abuse.WINDOW else abuse.WINDOW)
        seen = np.zeros(max(n, abuse.WINDOW))
        for a in s:
            seen[a : a + abuse.WINDOW] += 1
        assert (seen >= 1).all() and (n <= abuse.WINDOW or (seen[abuse.STEP : n - abuse.STEP] >= 2).all())
        assert abuse.cut_windows(np.arange(n)).shape == (len(s), abuse.WINDOW)


def test_gradients_agree_with_differences():
    m = abuse.Model.fresh(3)
    for name in m.NAMES:
        setattr(m, name, getattr(m, name).astype(np.float64))
    r = np.random.default_rng(0)
    v = abuse.Vocabulary()
    v([f"w{i}".encode() for i in range(30)])
    words, grams, size = v.flat()
    lex = (words, grams, size, np.cumsum(size) - size)
    win, y = r.integers(0, 30, (6, abuse.WINDOW)), np.array([0, 1, 1, 0, 1, 0.0])

    class Keep:
        def __init__(self):
            self.g = {}

        def step(self, name, p, g, rows=None):
            self.g[name] = (g, rows)

    class NoHide:
        def random(self, n):
            return np.ones(n)

    def loss():
        e = abuse.embed(m, words, grams, size)
        logit = abuse.forward(abuse.project(m, e)[win.T], m)
        return float((np.logaddexp(0, logit) - y * logit).mean())

    keep = Keep()
    abuse.train_batch(m, keep, win, y, np.ones(6), lex, NoHide())
    for name, at in (("out_w", (3,)), ("att_v", (2,)), ("att_w", (1, 2)), ("w_rec", (0, 3, 5)), ("w_rec", (1, 3, 40)), ("w_in", (0, 2, 20)), ("w_in", (1, 20, 33)), ("b_in", (0, 7))):
        p = getattr(m, name)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        g = keep.g[name][0][at] - 1e-4 * old * (name in ("w_in", "w_rec", "att_w", "out_w"))
        assert g == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-4), name


def test_labels_of_one_kind_or_none():
    for texts, labels in (([], []), (["a"], [0]), (["a", "b"], [1, 1])):
        m = abuse.train(texts, labels)
        assert not (abuse.Scorer(m)(["anything at all", None, ""])[0] > m.threshold).any()


def test_documents(spark):
    texts, truth, labels = corpus(250, 4, 0.02)
    rows = [(i, t, f" S{i % 2} ", 0.5) for i, t in enumerate(texts)] + [(900, None, None, 1.0), (901, "", "s0", 1.0), (902, " ".join(["word"] * 40000), "s1", 1.0), (903, "short", "s1", 1.0), (None, "null key", "s1", 1.0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    lab = [(i, int(x)) for i, x in enumerate(labels)] + [(0, None), (None, 1), (5, 1), (5, 0), (12345, 1), (900, 1)]
    labels_df = spark.createDataFrame(lab, "doc_id bigint, is_abusive int")
    out = abuse.score_documents(d, labels_df)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    said = np.array([got[i].is_abusive for i in range(250)])
    assert (said == truth).mean() > 0.97
    assert (got[900].score, got[900].n_windows, got[901].n_windows, got[902].n_windows > 3000) == (pytest.approx(0, abs=1e-9), 0, 0, True)
    assert not got[900].is_abusive and not got[901].is_abusive
    rates = {r.source: r for r in abuse.rates_by_source(out).collect()}
    assert set(rates) == {"s0", "s1", None} and rates["s0"].n_docs == 126 and rates[None].rate == 0
    assert abuse.score_documents(d.limit(0), labels_df.limit(0)).count() == 0


def test_long_tokens_are_read_whole():
    """Words glued together or text without blanks: every byte stands in some piece, pieces overlap."""
    word = "".join(f"{i:03d}x" for i in range(60)).encode()
    pieces = abuse.tokens_of("start " + word.decode() + " end")
    assert pieces[0] == b"start" and pieces[-1] == b"end" and max(map(len, pieces)) <= abuse.TOKEN
    at = [word.index(x) for x in pieces[1:-1]]
    assert at[0] == 0 and at[-1] + len(pieces[-2]) == len(word) and all(b - a == abuse.PIECE for a, b in zip(at, at[1:]))
    for n in (31, 32, 33, 55, 56, 57, 200):
        *most, last = abuse.tokens_of("a1" * n)
        assert len(b"".join(x[: abuse.PIECE] for x in most) + last) == 2 * n


def test_a_model_is_trained_once_for_the_same_sample(monkeypatch):
    calls = []
    monkeypatch.setattr(abuse, "train", lambda t, y: calls.append(1) or abuse.Model.fresh())
    monkeypatch.setattr(abuse, "_TRAINED", {})
    a = abuse.trained(["x", "y"], [0, 1])
    assert abuse.trained(["x", "y"], [0, 1]) is a and abuse.trained(["xy", ""], [0, 1]) is not a and len(calls) == 2
