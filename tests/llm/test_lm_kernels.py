"""Kernels of the language model against plain rebuilds of them."""

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import lm_scoring as lm


@pytest.fixture(scope="module")
def layout():
    return lm.Layout([f"w{k}".encode() for k in range(9_000)])


def test_words_come_in_order_and_by_text():
    texts = ["  Ab\tÀB\x0bc\x1cd ", None, "", " \n", "x\x85y  É", "ab"]
    words, sizes = lm.lowered_words(pa.array(texts))
    plain = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(ws) for ws in plain]
    assert words.cast(pa.binary()).to_pylist() == [w for ws in plain for w in ws]
    words, sizes = lm.lowered_words(pa.array(["not this", *texts]).slice(1))
    assert sizes.tolist() == [len(ws) for ws in plain] and words[0].as_py() == "ab"


def test_sums_of_exp_beyond_the_range_of_floats():
    hidden = np.array([[1, 0], [300, 1], [-300, 1]], np.float32)
    outcomes = np.array([[1, 0], [1, 2], [0.5, 1]], np.float32)
    scores = hidden.astype(float) @ outcomes.T
    most = scores.max(axis=1)
    want = most + np.log(np.exp(scores - most[:, None]).sum(axis=1))
    assert lm._log_sums(hidden, outcomes) == pytest.approx(want, rel=1e-6)


def test_a_batch_moves_rows_like_plain_sums(layout):
    """One batch, rebuilt row by row in double precision: gradients of a row add up, each table has its own noise."""
    rng = np.random.default_rng(3)
    size = layout.size + lm.GROUPS
    counts = rng.integers(1, 50, size)
    shares = layout.shares(counts)
    start = lm.Model.start(shares)
    for name in "ksw":
        start.values[name][:, :-1] = rng.normal(0, 0.3, start.values[name][:, :-1].shape)
    row = np.concatenate([[0, 0], rng.choice(size, 400, p=counts / counts.sum()), np.repeat(70, 20), [0, 5, 0]]).astype(np.int32)
    trainer = lm.Trainer(start, layout, shares)
    trainer.train(row, 1, (1, 2))

    two, one, target = lm.trigrams(row)
    assert two[-1] == 0 and len(target) <= lm.BATCH
    draws = np.random.default_rng((1, 2, 0))
    draws.permutation(len(target))
    v = {name: x.astype(float) for name, x in start.values.items()}
    grads = {name: np.zeros_like(x) for name, x in v.items()}
    hidden = np.column_stack([v["c"][0] * v["r"][two] + v["c"][1] * v["r"][one], np.ones(len(target))])
    d = np.zeros_like(hidden)
    for name, of in (("k", layout.classes[target]), ("s", layout.parts[target]), ("w", target)):
        below, share = np.cumsum(shares[name]), np.log(lm.NOISE * shares[name])
        noise = np.searchsorted(below, draws.random(lm.NOISE) * below[-1], side="right")
        for t in range(len(target)) if name == "k" else np.flatnonzero(layout.inner[target]):
            for one_of, sign in ((of[t], 1), *((n, -1) for n in noise)):
                own = v[name][one_of]
                g = sign / (1 + np.exp(sign * (hidden[t] @ own - share[one_of])))
                d[t] += g * own
                grads[name][one_of] += g * hidden[t]
    for place, ids in ((0, two), (1, one)):
        np.add.at(grads["r"], ids, d[:, :-1] * v["c"][place])
        grads["c"][place] = (d[:, :-1] * v["r"][ids]).sum(0)
    for name, grad in grads.items():
        grad /= len(target)
        want = v[name] + lm.RATE * grad / np.sqrt(1e-6 + grad * grad)
        assert np.allclose(trainer.model.values[name], want, atol=2e-4), name
        assert np.abs(want - v[name]).max() > 0.01, name
    assert trainer.seen["w"].sum() == len(target) and trainer.seen["r"].sum() == 2 * len(target)


def _model(layout, spread):
    rng = np.random.default_rng(5)
    model = lm.Model.start(layout.shares(rng.integers(1, 50, layout.size + lm.GROUPS)))
    for name in "rksw":
        model.values[name][:, : lm.WIDTH] = rng.normal(0, spread, (len(model.values[name]), lm.WIDTH))
    return model


def test_scores_do_not_follow_from_how_tokens_come_together(layout):
    model, rng = _model(layout, 0.5), np.random.default_rng(6)
    two, one, target = rng.integers(0, layout.size, (3, 6_000))
    whole = lm.log10_tokens(model, layout, two, one, target)
    cuts = [0, 1, 3, 10, 777, 2_900, 6_000]
    pieces = [lm.log10_tokens(model, layout, two[a:b], one[a:b], target[a:b]) for a, b in zip(cuts, cuts[1:])]
    assert np.abs(np.concatenate(pieces) - whole).max() < 1e-9


def test_class_sums_of_words_that_lie_far_apart(layout):
    """Products of exps leave the range of floats where two words point at different classes; the sums hold all the same."""
    model = _model(layout, 0.5)
    model.values["r"][1:3] = 0
    model.values["r"][1, 0], model.values["r"][2, 0] = 400, -400
    scorer = lm.Scorer(model, layout)
    two, one = np.array([1, 1, 2, 2, 7, 1]), np.array([2, 1, 1, 2, 8, 9])
    hidden = scorer.two[two] + scorer.one[one]
    scores = hidden.astype(float) @ scorer.k.T.astype(float)
    most = scores.max(axis=1)
    want = most + np.log(np.exp(scores - most[:, None]).sum(axis=1))
    assert scorer._class_sums(two, one, hidden) == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_noise_classes_drawn_again_count_again(layout):
    """A batch gets each noise class once, with its times: as many as were drawn."""
    seen, trainer = [], lm.Trainer(_model(layout, 0.1), layout, layout.shares(np.ones(layout.size + lm.GROUPS)))
    trainer._batch = lambda two, one, aims, noise, log_aims, log_noise, times, rate: seen.append((noise[0], times, log_noise[0]))
    trainer.train(np.random.default_rng(1).integers(0, layout.size, 2 * lm.BATCH).astype(np.int32), 1, (1, 2))
    assert len(seen) == 2
    for noise, times, logs in seen:
        assert len(set(noise.tolist())) == len(noise) == len(times) == len(logs) < lm.NOISE and times.sum() == lm.NOISE
        assert 0 <= noise.min() - trainer.first["k"] and noise.max() - trainer.first["k"] < lm.CLASSES
