"""The toxicity network against a plain loop over one window, and its gradient against differences."""

import math

import numpy as np

from rippleframe.llm.toxicity import HIDDEN, Network


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def one_direction(gates, mask, U):
    """States of a gated recurrent network over one window, number by number."""
    h, out = [0.0] * HIDDEN, []
    for x, m in zip(gates, mask):
        u = [sum(h[i] * U[i][j] for i in range(HIDDEN)) for j in range(3 * HIDDEN)]
        new = []
        for k in range(HIDDEN):
            r, z = sigmoid(x[k] + u[k]), sigmoid(x[HIDDEN + k] + u[HIDDEN + k])
            c = math.tanh(x[2 * HIDDEN + k] + r * u[2 * HIDDEN + k])
            new.append(((1 - z) * c + z * h[k]) * m)
        h = new
        out.append(h)
    return out


def test_forward_is_the_plain_loop():
    net, r = Network(3), np.random.default_rng(1)
    steps, n = 7, 3
    gf, gb = (r.standard_normal((n, steps, 3 * HIDDEN)).astype(np.float32) for _ in range(2))
    mask = np.ones((n, steps), np.float32)
    mask[1, 4:] = mask[2, 1:] = 0
    logits, _ = net.forward(gf, gb, mask)
    for w in range(n):
        forth = one_direction(gf[w].tolist(), mask[w].tolist(), net.p["Uf"].tolist())
        back = one_direction(gb[w][::-1].tolist(), mask[w][::-1].tolist(), net.p["Ub"].tolist())[::-1]
        states = [a + b for a, b in zip(forth, back)]
        scores = [sum(s * a for s, a in zip(x, net.p["att"].tolist())) if m else None for x, m in zip(states, mask[w])]
        weights = [0.0 if s is None else math.exp(s) for s in scores]
        pooled = [sum(weights[t] * states[t][k] for t in range(steps)) / sum(weights) for k in range(2 * HIDDEN)]
        want = sum(p * o for p, o in zip(pooled, net.p["out"].tolist())) + float(net.p["bias"][0])
        assert abs(want - float(logits[w])) < 1e-4


def test_backward_is_the_slope():
    net, r = Network(4), np.random.default_rng(2)
    gf, gb = (r.standard_normal((2, 5, 3 * HIDDEN)).astype(np.float32) for _ in range(2))
    mask = np.ones((2, 5), np.float32)
    mask[1, 3:] = 0
    weight = np.array([0.7, -1.3], np.float32)
    loss = lambda: float(net.forward(gf, gb, mask)[0].astype(np.float64) @ weight)
    _, cache = net.forward(gf, gb, mask, keep=True)
    slopes, dgf, dgb = net.backward(weight, cache, mask)

    def differs(array, slope, at, step=2e-2):
        own = array[at]
        array[at] = own + step
        up = loss()
        array[at] = own - step
        down = loss()
        array[at] = own
        return abs((up - down) / (2 * step) - float(slope[at]))

    for name, slope in slopes.items():
        for _ in range(12):
            at = tuple(int(r.integers(s)) for s in net.p[name].shape)
            assert differs(net.p[name], slope, at) < 5e-3, name
    for array, slope in ((gf, dgf), (gb, dgb)):
        for _ in range(25):
            at = tuple(int(r.integers(s)) for s in array.shape)
            assert differs(array, slope, at) < 5e-3
    # Words beyond a window's end have no part in it.
    assert not dgf[1, 3:].any() and not dgb[1, 3:].any()
