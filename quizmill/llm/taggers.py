"""A character-level bidirectional LSTM with a CRF on top, in numpy: training, decoding, and labelled texts to train on."""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np

KINDS = ["email", "ip", "card", "phone", "id"]
TAGS = 1 + 2 * len(KINDS)  # 0 outside, then the first and the further characters of each kind
HIDDEN, WINDOW = 16, 96
WINDOWS, BATCH, ROUNDS, RATE, SEED = 1600, 64, 13, 0.02, 12  # what training sees, and for how long
LETTERS, OTHERS, PAD = 128, 129, 130
SYMBOLS = 131


class Model(NamedTuple):
    """Weights: of input symbols by direction, of the state before, of the tags, and of transitions between tags."""

    wx: np.ndarray
    wh: np.ndarray
    wo: np.ndarray
    bias: np.ndarray
    trans: np.ndarray


def symbols(text: str) -> np.ndarray:
    """A number for each code point: ASCII as it is, other letters of Latin script, all else."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(c < 128, c, np.where((c >= 0xC0) & (c < 0x250), LETTERS, OTHERS)).astype(np.uint8)


def _features() -> np.ndarray:
    """One-hot symbols, and beside them what kind of symbol it is."""
    kind = [1 if c in range(48, 58) else 2 if c in range(65, 91) else 3 if c in range(97, 123) or c == LETTERS else 4 if c in (9, 10, 13, 32) else 5 if c == PAD else 0 for c in range(SYMBOLS)]
    return np.concatenate([np.eye(SYMBOLS), np.eye(6)[kind]], axis=1).astype(np.float32)


def forbidden() -> np.ndarray:
    """Which tags may not follow which: a further character follows a first or further one of its kind alone."""
    out = np.zeros((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = True
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _lstm(m: Model, ids: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (time, windows, 2 * HIDDEN) of windows of symbols; both directions run side by side."""
    t, n, h3 = ids.shape[1], len(ids), 3 * HIDDEN
    x = np.stack([m.wx[0][ids.T], m.wx[1][ids.T[::-1]]], axis=1)
    h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    out = np.empty((t, 2, n, HIDDEN), np.float32)
    for k in range(t):
        z = x[k] + h @ m.wh
        gates, g = _sigmoid(z[..., :h3]), np.tanh(z[..., h3:])
        i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
        before = c
        c = f * c + i * g
        s = np.tanh(c)
        if trace is not None:
            trace.append((i, f, o, g, before, s, h))
        out[k] = h = o * s
    return np.concatenate([out[:, 0], out[::-1, 1]], axis=2)


def emissions(m: Model, ids: np.ndarray) -> np.ndarray:
    """Scores (time, windows, tags)."""
    return _lstm(m, ids) @ m.wo + m.bias


def decode(m: Model, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (windows, time) and, of each step, by how much its tag and the transition to it beat staying outside."""
    e = emissions(m, ids)
    t, n, _ = e.shape
    best, back = e[0], np.zeros((t, n, TAGS), np.uint8)
    for k in range(1, t):
        w = best[:, :, None] + m.trans
        back[k] = w.argmax(axis=1)
        best = w.max(axis=1) + e[k]
    tags = np.empty((n, t), np.int64)
    tags[:, -1] = best.argmax(axis=1)
    row = np.arange(n)
    for k in range(t - 1, 0, -1):
        tags[:, k - 1] = back[k][row, tags[:, k]]
    gain = np.take_along_axis(e.transpose(1, 0, 2), tags[:, :, None], axis=2)[:, :, 0] - e[:, :, 0].T
    gain[:, 1:] += m.trans[tags[:, :-1], tags[:, 1:]] - m.trans[0, 0]
    return tags, gain


def _crf_gradient(e: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of tag paths y (time, windows), and its gradients for emissions and transitions, by forward and backward sums."""
    t, n, k = e.shape
    top = e.max(axis=2, keepdims=True)
    x, a = np.exp(e - top), np.exp(trans)
    forward, scale = np.empty_like(x), np.empty((t, n, 1), np.float32)
    for j in range(t):
        f = x[j] if j == 0 else (forward[j - 1] @ a) * x[j]
        scale[j] = f.sum(axis=1, keepdims=True)
        forward[j] = f / scale[j]
    later, pairs = np.ones((n, k), np.float32), np.zeros((k, k), np.float32)
    g = np.empty_like(x)
    for j in range(t - 1, -1, -1):
        g[j] = forward[j] * later
        if j:
            come = x[j] * later / scale[j]
            pairs += forward[j - 1].T @ come
            later = come @ a.T
    row = np.arange(n)
    score = sum(e[j, row, y[j]] for j in range(t)) + sum(trans[y[j - 1], y[j]] for j in range(1, t))
    loss = float((np.log(scale).sum(axis=0)[:, 0] + top.sum(axis=0)[:, 0] - score).mean())
    pairs *= a
    np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
    for j in range(t):
        g[j, row, y[j]] -= 1
    return loss, g / n, pairs / n


def _gradients(m: Model, ids: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    trace: list = []
    states = _lstm(m, ids, trace)
    loss, de, dtrans = _crf_gradient(states @ m.wo + m.bias, m.trans, y.T)
    t, n, _ = de.shape
    dwo, dbias, ds = np.einsum("tnh,tnk->hk", states, de, optimize=True), de.sum(axis=(0, 1)), de @ m.wo.T
    dout = np.stack([ds[:, :, :HIDDEN], ds[::-1, :, HIDDEN:]], axis=1)
    dz = np.empty((t, 2, n, 4 * HIDDEN), np.float32)
    dwh, dh, dc = np.zeros_like(m.wh), 0.0, 0.0
    for k in range(t - 1, -1, -1):
        i, f, o, g, before, s, h = trace[k]
        dh = dh + dout[k]
        dc = dc + dh * o * (1 - s * s)
        dz[k] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=2)
        dwh += h.transpose(0, 2, 1) @ dz[k]
        dh, dc = dz[k] @ m.wh.transpose(0, 2, 1), dc * f
    hot = np.eye(SYMBOLS, dtype=np.float32)
    dwx = np.stack([hot[ids.T.ravel()].T @ dz[:, 0].reshape(t * n, -1), hot[ids.T[::-1].ravel()].T @ dz[:, 1].reshape(t * n, -1)])
    return loss, [dwx, dwh, dwo, dbias, dtrans]


def train(ids: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """A model fitted to windows of symbols and their tags by Adam with a falling rate."""
    rng, feat, no = np.random.default_rng(seed), _features(), forbidden()
    draw = lambda *s: rng.normal(0, 0.15, s).astype(np.float32)
    p = [draw(2, feat.shape[1], 4 * HIDDEN), draw(2, HIDDEN, 4 * HIDDEN), draw(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)]
    p[0][:, SYMBOLS:, HIDDEN : 2 * HIDDEN] += 0.5  # forget gates begin open
    p[4][no] = -30.0
    one, two, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    steps = rounds * -(-len(ids) // BATCH)
    for _ in range(rounds):
        order = rng.permutation(len(ids))
        for a in range(0, len(ids), BATCH):
            some = order[a : a + BATCH]
            _, g = _gradients(Model(feat @ p[0], *p[1:]), ids[some], y[some])
            g[0] = feat.T @ g[0]
            g[4][no] = 0
            size = np.sqrt(sum(float((v * v).sum()) for v in g))
            step += 1
            rate = RATE * (1 - 0.95 * step / steps)
            for k, v in enumerate(g):
                v = v * min(1.0, 5 / (size + 1e-9))
                one[k] = 0.9 * one[k] + 0.1 * v
                two[k] = 0.99 * two[k] + 0.01 * v * v
                p[k] -= rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)
    return Model(feat @ p[0], *p[1:])


# ---------------------------------------------------------------- labelled texts


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng, letters: str = "aaaeeeiiooutnrslhdcmpgbvfkwzäöüßéèêñçí") -> str:
    w = "".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(1, 10)))
    style = rng.random()
    return w.upper() if style < 0.06 else w.capitalize() if style < 0.2 else w


def _name(rng) -> str:
    return _word(rng, "aaaeeeiiooutnrslhdcmpgbvfkwzyxjq").lower() + _word(rng, "aeioutnrslhdcm").lower()


def _pick(rng, options: list):
    return options[int(rng.integers(0, len(options)))]


def personal(rng) -> tuple[str, int]:
    """A made piece of personal data and its kind."""
    d = lambda n: _digits(rng, n)
    kind = int(rng.integers(0, len(KINDS)))
    if kind == 0:
        user = _name(rng) + _pick(rng, ["", f".{_name(rng)}", f"_{_name(rng)}", d(2), f".{d(2)}", f"-{d(1)}"])
        host, top = _name(rng) + _pick(rng, ["", d(1), f".{_name(rng)}"]), _pick(rng, ["com", "org", "net", "de", "example.com", "fr", "es", "io"])
        return _pick(rng, [f"{user}@{host}.{top}", f"{user} [at] {host}.{top}", f"{user}[at]{host}.{top}", f"{user} [at] {host} [dot] {top}", f"{user}[at]{host}[dot]{top}", f"{user} @ {host}.{top}", f"{user}@{host}[.]{top}"]), 0
    if kind == 1:
        hexed = lambda: "".join(_pick(rng, list("0123456789abcdef")) for _ in range(int(rng.integers(1, 5))))
        six = ":".join(hexed() for _ in range(8)) if rng.random() < 0.5 else ":".join(hexed() for _ in range(int(rng.integers(1, 5)))) + "::" + ":".join(hexed() for _ in range(int(rng.integers(1, 4))))
        return _pick(rng, [six, ".".join(str(v) for v in rng.integers(0, 256, 4)), six.upper()]), 1
    if kind == 2:
        mark = _pick(rng, [" ", "-", ".", "/", "_"])
        return mark.join([d(4), d(4), d(4), d(4)]) if rng.random() < 0.75 else mark.join([d(4), d(6), d(5)]), 2
    if kind == 3:
        return _pick(rng, [f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(7)}", f"({d(3)}) {d(3)}-{d(4)}", f"(0{d(2)}) {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)}-{d(7)}", f"0{d(3)} {d(7)}", f"0{d(3)}/{d(6)}", f"00{d(2)} {d(2)} {d(7)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]), 3
    return _pick(rng, [f"{d(3)}-{d(2)}-{d(4)}", f"{_pick(rng, ['DE', 'FR', 'ES', 'GB', 'NL'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"]), 4


def ordinary(rng) -> str:
    """A made piece of text with digits or marks that is no personal data."""
    d = lambda n: _digits(rng, n)
    some = lambda a, b: d(int(rng.integers(a, b)))
    hexed = "".join(_pick(rng, list("0123456789abcdef")) for _ in range(int(rng.integers(8, 41))))
    mixed = "".join(_pick(rng, list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")) for _ in range(int(rng.integers(16, 45))))
    year, day, month = f"20{d(2)}", f"{int(rng.integers(1, 29)):02d}", f"{int(rng.integers(1, 13)):02d}"
    w = lambda: _word(rng)
    return _pick(rng, [
        f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{month}/{year}", f"{year}-{month}-{day} {d(2)}:{d(2)}:{d(2)}", f"{d(2)}:{d(2)}", year, f"{year}-{year}", f"v{d(1)}.{d(1)}.{d(1)}", f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(1)}.",
        f"${some(1, 5)}.{d(2)}", f"{some(1, 4)},{d(3)}", f"{some(1, 3)},{d(3)},{d(3)}", some(1, 5), some(5, 13), some(13, 20), d(16), d(16), f"{d(16)} {d(16)}", f'token = "{hexed}"', f"{some(1, 4)}%", f"{some(1, 4)}kg", f"{some(1, 3)}-{some(1, 3)}", f"{some(1, 3)} - {some(1, 4)}", f"{d(1)}+{d(1)}={d(2)}",
        hexed, hexed.upper(), f'token = "{hexed}"', f'password: {mixed}', mixed, f"AKIA{mixed[:16].upper()}", f"{hexed[:8]}-{hexed[:4]}-{d(4)}-{hexed[-4:]}-{hexed[:8]}{d(4)}", f"#{some(1, 7)}", f"0x{hexed[:8]}",
        f"CC BY-NC {d(1)}.0", f"version {d(1)}.", f"No. {some(1, 4)}", f"page {some(1, 4)}", f"{d(1)}st", f"[{some(1, 4)}]", f"{w()}[{d(1)}]", f"[{w()}](http://{_name(rng)}.org/{some(1, 4)})", f"[{w()}]", f"[x] {w()}", f"@{_name(rng)}", f"@{w()} {{", f"{w()} @ {w()}", f"{w()}_{some(1, 3)}",
        f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"http://{_name(rng)}.com/{some(1, 6)}?id={some(1, 6)}", f"x{d(2)}_{d(2)}", f"({d(1)})", f"({year})", f"{d(1)}) {w()}", f"{w()}{some(1, 3)}", f"{d(1)}/{d(1)}", f"{d(2)} {d(2)} {d(2)}", f"{some(1, 4)} {w()} {some(1, 4)}", f"{d(2)}.{d(1)}.", f"|{some(1, 5)}|{some(1, 5)}|",
    ])


def labelled(n: int, seed: int) -> tuple[str, list[tuple[int, int, int]]]:
    """Made text with about n pieces, and the spans (start, end, kind) of its personal data."""
    rng, parts, size, spans = np.random.default_rng(seed), [], 0, []

    def put(s: str) -> None:
        nonlocal size
        parts.append(s)
        size += len(s)

    for _ in range(n):
        for _ in range(int(rng.integers(0, 6))):
            put(_word(rng) + _pick(rng, [" ", " ", " ", " ", " ", ", ", ". ", "\n", "!! ", "### ", " | ", ": "]))
        put(_pick(rng, ["", "", "", "", "", "(", '"', "tel. ", "tel: ", "mail: ", "IP ", "id ", "<"]))
        if rng.random() < 0.5:
            text, kind = personal(rng)
            spans.append((size, size + len(text), kind))
            put(text)
        else:
            put(ordinary(rng))
        put(_pick(rng, [" ", " ", " ", " ", ", ", ". ", "\n", "!! ", "### ", "%%% ", " | ", ") ", '" ', "; ", "> "]))
    return "".join(parts), spans


def tags_of(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for a, b, kind in spans:
        out[a:b] = 2 + 2 * kind
        out[a] = 1 + 2 * kind
    return out


@functools.cache
def trained() -> Model:
    """The model, fitted to made texts of a fixed size in the driver, once for each process."""
    text, spans = labelled(WINDOWS * 3, SEED)
    ids, tags = symbols(text), tags_of(len(text), spans)
    at = np.random.default_rng(SEED).integers(0, len(ids) - WINDOW, WINDOWS)[:, None] + np.arange(WINDOW)
    x, y = ids[at], tags[at]
    short = np.arange(WINDOW) >= np.where(np.arange(WINDOWS) % 5 == 0, 8 + np.arange(WINDOWS) % 80, WINDOW)[:, None]
    return train(np.where(short, PAD, x), np.where(short, 0, y))
