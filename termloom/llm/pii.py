"""Personal data by a character-level bidirectional LSTM with CRF transitions, written and trained in numpy.

The tagger is trained on labelled spans that a seeded generator makes: addresses and numbers of each kind in their
usual formats between made-up words, beside strings that only look alike (hashes, keys, versions, dates, amounts).
A text is cut into windows that overlap by their context; each is decoded by Viterbi, and what the windows find is
reconciled over the whole text: a window speaks for its core, pieces of one kind that meet are joined, and of two
kinds in one place the longer stays.

Every kind holds a digit or an at sign, and a piece without either is never reported. So a window that has none of
these characters from end to end can't contribute and isn't run; `every_window` runs them all, with the same result.
"""

from __future__ import annotations

import random
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import quoted

KINDS = ("email", "phone", "ipv4", "card")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
HIDDEN = 20
#: Window = core with so much context on both sides.
CORE, CONTEXT = 64, 48
#: Training: windows of the generator (all of them labelled), their length, windows in a step, steps, learning rate.
TRAIN_WINDOWS, LENGTH, BATCH, STEPS, RATE = 12_000, 96, 64, 520, 0.012
SEED = 5
#: Character classes: 0 outside the text, one for each ASCII character, one for letters and one for signs beyond.
CLASSES = 98
_CLASS = np.full(0x250, 96, np.uint8)
_CLASS[:128] = 97
_CLASS[32:127] = np.arange(1, 96)
_CLASS[[9, 10, 13]] = 1
_CLASS[128:0xC0] = _CLASS[[0xD7, 0xF7]] = 97
_TRIGGER = np.zeros(CLASSES, bool)
_TRIGGER[[*range(ord("0") - 31, ord("9") - 30), ord("@") - 31]] = True


# -- labelled spans ------------------------------------------------------------------------------------------------


class Generator:
    """Made-up text with labelled personal data; the same seed gives the same text."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choices(string.digits, k=n))

    def letters(self, low: int, high: int, extra: str = "") -> str:
        return "".join(self.r.choices(string.ascii_lowercase + extra, k=self.r.randint(low, high)))

    def word(self) -> str:
        w = self.letters(1, 11, "äöüßéèçñóíê" if self.r.random() < 0.4 else "")
        return w.capitalize() if self.r.random() < 0.2 else w

    def email(self) -> str:
        r = self.r
        accents = "éèçñüöäß" if r.random() < 0.15 else ""
        local = self.letters(1, 12, accents)
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            local += r.choice("._-+.") + (self.digits(r.randint(1, 4)) if r.random() < 0.5 else self.letters(1, 9, accents))
        if r.random() < 0.2:
            local += self.digits(r.randint(1, 4))
        hosts = [self.letters(2, 10) + (self.digits(r.randint(1, 2)) if r.random() < 0.35 else "") for _ in range(r.choice((1, 1, 2, 2, 3)))]
        if r.random() < 0.2:
            hosts[0] += "-" + self.letters(2, 6)
        return f"{local}@{'.'.join(hosts)}.{r.choice(('com', 'com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io', 'info'))}"

    def phone(self) -> str:
        r, d = self.r, self.digits
        return r.choice(
            (
                lambda: f"+{r.choice(('1', '1', '44', '49', d(2)))} ({d(3)}) {d(3)}-{d(4)}", lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}",
                lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{r.randint(20, 99)} {d(2)} {d(4)} {d(4)}", lambda: f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
                lambda: f"+{r.randint(1, 99)}-{d(3)}-{d(3)}-{d(4)}", lambda: f"+{r.randint(20, 99)}{d(r.randint(9, 11))}", lambda: f"+34 {d(3)} {d(3)} {d(3)}",
            )
        )()

    def ipv4(self) -> str:
        return ".".join(str(self.r.randint(0, 255)) for _ in range(4))

    def card(self) -> str:
        d, sign = self.digits, self.r.choice(("", "", "", "", "", " ", "-"))
        return sign.join((d(4), d(6), d(5))) if sign and self.r.random() < 0.2 else sign.join(d(4) for _ in range(4))

    def lookalike(self) -> str:
        r, d = self.r, self.digits
        key = lambda n: "".join(r.choices(string.ascii_letters + string.digits + "+/_-", k=n))
        low = lambda n: "".join(r.choices("0123456789abcdef", k=n))
        return r.choice(
            (
                lambda: f'{self.letters(3, 8)} = "{low(r.choice((16, 32, 40, 40, 64)))}"', lambda: low(r.choice((8, 12, 32, 40, 64))), lambda: "AKIA" + "".join(r.choices(string.ascii_uppercase + string.digits, k=16)),
                lambda: r.choice(("ghp_", "sk_live_", "glpat-", "xoxb-")) + key(r.randint(20, 40)), lambda: key(r.randint(16, 48)), lambda: d(r.randint(1, 4)), lambda: d(r.randint(5, 11)), lambda: d(r.randint(20, 32)),
                lambda: f"{r.randint(1900, 2099)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{r.randint(1900, 2099)}", lambda: f"{d(2)}.{d(2)}.{r.randint(1900, 2099)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}",
                lambda: f"{d(r.randint(1, 3))}.{d(r.randint(1, 4))}", lambda: f"Version {d(1)}.{d(1)}.", lambda: f"v{d(1)}.{r.randint(0, 99)}.{r.randint(0, 99)}", lambda: f"${d(r.randint(1, 3))},{d(3)}.{d(2)}",
                lambda: f"#{d(r.randint(1, 6))}", lambda: "@" + self.letters(3, 10), lambda: f"{self.letters(1, 5)} @ {self.letters(2, 7)}", lambda: f"https://{self.letters(3, 9)}.com/{self.letters(2, 6)}/{d(r.randint(1, 6))}",
                lambda: f"{r.randint(1, 999)}%", lambda: f"{d(r.randint(1, 3))}-{d(r.randint(1, 3))}", lambda: f"({d(r.randint(1, 4))})", lambda: f"{d(r.randint(2, 3))} {d(r.randint(2, 3))}", lambda: f"{self.letters(2, 5)}{d(r.randint(1, 5))}",
            )
        )()

    def text(self, length: int, share: float = 0.22, alike: float = 0.14) -> tuple[str, list[tuple[int, int, int]]]:
        """A text of at least this length and its spans (kind, from, to)."""
        r, out, size, spans = self.r, [], 0, []
        shout, tail = r.random() < 0.08, r.choice(("!!", "###", "%%%", "***", "&&&", "$$$", " |", "") if r.random() < 0.2 else ("",))
        while size < length:
            x = r.random()
            kind = r.choice((0, 1, 2, 3, 3)) if x < share else -1
            part = getattr(self, KINDS[kind])() if kind >= 0 else self.lookalike() if x < share + alike else " ".join(self.word() for _ in range(r.randint(1, 6)))
            part = part.upper() if shout else part
            before = r.choice(("", "", "", "", "", "", "", "(", '"', "<", "=", ":", "mailto:", "tel: ")) if kind >= 0 else ""
            after = (r.choice(("", "", "", "", "", "", ".", ",", ")", '"', ">", ";", ":")) if r.random() < 0.7 else "") + tail
            if kind >= 0:
                spans.append((kind, size + len(before), size + len(before) + len(part)))
            piece = before + part + after + r.choice((" ", " ", " ", " ", " ", " ", "\n", ", ", "  "))
            out.append(piece)
            size += len(piece)
        return "".join(out), spans


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(points, 0x24F)]


def examples(count: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes and their tags; some begin or end beyond their text."""
    made = Generator(seed)
    x, y = np.zeros((count, length), np.uint8), np.zeros((count, length), np.int64)
    for i in range(count):
        text, spans = made.text(length + 60)
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            tags[a:b], tags[a] = 2 + 2 * kind, 1 + 2 * kind
        start = made.r.randint(-20, 0) if made.r.random() < 0.15 else made.r.randint(0, len(text) - length)
        end = len(text) if made.r.random() < 0.9 else max(1, start + made.r.randint(length // 2, length))
        held = codes(text)[max(0, start) : min(end, start + length)]
        at = max(0, -start)
        x[i, at : at + len(held)] = held
        y[i, at : at + len(held)] = tags[max(0, start) : max(0, start) + len(held)]
    return x, y


# -- the tagger ----------------------------------------------------------------------------------------------------

_KIND = np.array([-1, *(k for k in range(len(KINDS)) for _ in "BI")])
_INSIDE = np.array([False, *(x == "I" for _ in KINDS for x in "BI")])
#: Scores of moves that no labelled text has: into the inside of a kind from elsewhere.
_BARRED = np.where(_INSIDE[None, :] & (_KIND[:, None] != _KIND[None, :]), np.float32(-1e4), np.float32(0))


def _start(hidden: int, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
    table = w(2, CLASSES, 4 * hidden, scale=0.3)
    table[:, :, hidden : 2 * hidden] += 1.0  # remembers at first
    return {"table": table, "recur": w(2, hidden, 4 * hidden, scale=hidden**-0.5), "out": w(2 * hidden, TAGS, scale=0.2), "bias": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(p: dict[str, np.ndarray], x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, direction, window, unit) of both directions, the second in reversed time."""
    n, length = x.shape
    hidden = p["recur"].shape[1]
    h = c = np.zeros((2, n, hidden), np.float32)
    states, saved = np.empty((length, 2, n, hidden), np.float32), []
    gates = np.empty((2, n, 4 * hidden), np.float32)
    for t in range(length):
        np.matmul(h, p["recur"], out=gates)
        gates[0] += p["table"][0].take(x[:, t], 0)
        gates[1] += p["table"][1].take(x[:, length - 1 - t], 0)
        ifo = _sigmoid(gates[:, :, : 3 * hidden])
        g = np.tanh(gates[:, :, 3 * hidden :])
        i, f, o = ifo[:, :, :hidden], ifo[:, :, hidden : 2 * hidden], ifo[:, :, 2 * hidden :]
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            saved.append((h, before, ifo, g, tc))
        h = o * tc
        states[t] = h
    return states, saved


def _emissions(p: dict[str, np.ndarray], states: np.ndarray) -> np.ndarray:
    """(time, window, tag)."""
    hidden = states.shape[3]
    return states[:, 0] @ p["out"][:hidden] + states[::-1, 1] @ p["out"][hidden:] + p["bias"]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of the tags y under the CRF, and its gradients."""
    n, length = x.shape
    hidden = p["recur"].shape[1]
    states, saved = _lstm(p, x, True)
    e, moves = _emissions(p, states), p["moves"] + _BARRED
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + p["first"]
    for t in range(1, length):
        alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + moves, 1)
    for t in range(length - 2, -1, -1):
        beta[t] = _lse(moves + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    log_z = _lse(alpha[-1], 1)
    d = np.exp(alpha + beta - log_z[None, :, None])
    pairs = np.exp(alpha[:-1, :, :, None] + moves + (e[1:] + beta[1:])[:, :, None, :] - log_z[None, :, None, None]).sum((0, 1))
    rows, times = np.arange(n), np.arange(length)
    gold = p["first"][y[:, 0]] + e[times[None, :], rows[:, None], y].sum(1) + moves[y[:, :-1], y[:, 1:]].sum(1)
    d[times[:, None], rows[None, :], y.T] -= 1
    np.subtract.at(pairs, (y[:, :-1], y[:, 1:]), 1)
    d /= n
    grads = {"moves": pairs / n, "first": d[0].sum(0), "bias": d.sum((0, 1))}
    flat = d.reshape(-1, TAGS)
    forward, backward = states[:, 0].reshape(-1, hidden), states[::-1, 1].reshape(-1, hidden)
    grads["out"] = np.concatenate((forward.T @ flat, backward.T @ flat))
    above = np.stack((d @ p["out"][:hidden].T, (d @ p["out"][hidden:].T)[::-1]), 1)
    dh_next, dc_next, dgates = np.zeros((2, n, hidden), np.float32), np.zeros((2, n, hidden), np.float32), np.empty((length, 2, n, 4 * hidden), np.float32)
    recur, grads["recur"] = p["recur"].transpose(0, 2, 1), np.zeros_like(p["recur"])
    for t in range(length - 1, -1, -1):
        h, before, ifo, g, tc = saved[t]
        i, f, o = ifo[:, :, :hidden], ifo[:, :, hidden : 2 * hidden], ifo[:, :, 2 * hidden :]
        dh = above[t] + dh_next
        dc = dh * o * (1 - tc * tc) + dc_next
        slot = dgates[t]
        slot[:, :, :hidden], slot[:, :, hidden : 2 * hidden], slot[:, :, 2 * hidden : 3 * hidden] = dc * g, dc * before, dh * tc
        slot[:, :, : 3 * hidden] *= ifo * (1 - ifo)
        slot[:, :, 3 * hidden :] = dc * i * (1 - g * g)
        dc_next = dc * f
        dh_next = slot @ recur
        grads["recur"] += h.transpose(0, 2, 1) @ slot
    grads["table"] = np.zeros_like(p["table"])
    for side, seen in ((0, x.T), (1, x.T[::-1])):
        hot = np.zeros((CLASSES, length * n), np.float32)
        hot[seen.reshape(-1), np.arange(length * n)] = 1
        grads["table"][side] = hot @ dgates[:, side].reshape(-1, 4 * hidden)
    return float((log_z - gold).mean()), grads


@lru_cache(2)
def train(windows: int = TRAIN_WINDOWS, steps: int = STEPS, hidden: int = HIDDEN, seed: int = SEED) -> dict[str, np.ndarray]:
    """The tagger, fitted by Adam to `windows` labelled windows; the same arguments give the same tagger."""
    x, y = examples(windows, LENGTH, seed)
    p, order = _start(hidden, seed), np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = order.integers(0, windows, BATCH)
        _, grads = _gradients(p, x[pick], y[pick])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale, rate = min(1.0, 5.0 / (size + 1e-9)), RATE * min(1.0, step / 20) * max(0.03, 1 - step / steps)
        for k, g in grads.items():
            g = g * np.float32(scale)
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def decode(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Most likely tags of each window, by Viterbi."""
    n, length = x.shape
    e, moves = _emissions(p, _lstm(p, x, False)[0]), p["moves"] + _BARRED
    best, back = e[0] + p["first"], np.empty((length, n, TAGS), np.int8)
    for t in range(1, length):
        through = best[:, :, None] + moves
        back[t] = through.argmax(1)
        best = through.max(1) + e[t]
    tags = np.empty((n, length), np.int8)
    tags[:, -1] = best.argmax(1)
    rows = np.arange(n)
    for t in range(length - 1, 0, -1):
        tags[:, t - 1] = back[t][rows, tags[:, t]]
    return tags


# -- whole texts ---------------------------------------------------------------------------------------------------


def reconcile(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (kind, from, to) of a text from those of its windows: of one kind joined where they overlap, of two
    kinds the longer, and of two equally long the earlier kind."""
    joined: list[list[int]] = []
    for kind, a, b in sorted(pieces):
        if joined and joined[-1][0] == kind and a < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], b)
        else:
            joined.append([kind, a, b])
    kept: list[tuple[int, int, int]] = []
    for kind, a, b in sorted(joined, key=lambda s: (s[1] - s[2], s[0], s[1])):
        if all(b <= c or d <= a for _, c, d in kept):
            kept.append((kind, a, b))
    return sorted(kept, key=lambda s: s[1])


def find_in(p: dict[str, np.ndarray], texts: list[str | None], every_window: bool = False, batch: int = 1024) -> Iterator[tuple[int, int, int, int]]:
    """(index of the text, kind, from, to) of the personal data in the texts."""
    width = CORE + 2 * CONTEXT
    held = [codes(t or "") for t in texts]
    sizes = np.array([len(h) for h in held], np.int64)
    rooms = -(-sizes // CORE) * CORE + 2 * CONTEXT  # each text with room for its windows
    starts = np.concatenate(([0], np.cumsum(rooms)))
    line = np.zeros(starts[-1], np.uint8)
    for s, h in zip(starts, held):
        line[s + CONTEXT : s + CONTEXT + len(h)] = h
    counts = -(-sizes // CORE)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = starts[owner] + nth * CORE
    triggers = np.flatnonzero(_TRIGGER[line])
    if not every_window:
        run = np.searchsorted(triggers, windows + width) > np.searchsorted(triggers, windows)
        owner, nth, windows = owner[run], nth[run], windows[run]
    by: dict[int, list[tuple[int, int, int]]] = {}
    for at in range(0, len(windows), batch):
        x = line[windows[at : at + batch, None] + np.arange(width)]
        tags = decode(p, x)
        ends = np.zeros_like(tags)
        ends[:, :-1] = tags[:, 1:]
        edge = np.concatenate((np.zeros((len(tags), 1), tags.dtype), tags[:, :-1]), 1)
        first = (tags > 0) & (~_INSIDE[tags] | (_KIND[edge] != _KIND[tags]))
        last = (tags > 0) & ~(_INSIDE[ends] & (_KIND[ends] == _KIND[tags]))
        (row, a), (_, z) = np.nonzero(first), np.nonzero(last)
        seen = np.concatenate((np.zeros((len(x), 1), np.int32), np.cumsum(_TRIGGER[x], 1, dtype=np.int32)), 1)
        good = (a < CONTEXT + CORE) & (z + 1 > CONTEXT) & (seen[row, z + 1] > seen[row, a])
        for r, lo, hi in zip(row[good], a[good], z[good] + 1):
            i, shift = int(owner[at + r]), int(nth[at + r]) * CORE - CONTEXT
            by.setdefault(i, []).append((int(_KIND[tags[r, lo]]), max(0, int(lo) + shift), min(int(sizes[i]), int(hi) + shift)))
    for i in sorted(by):
        for kind, a, b in reconcile(by[i]):
            yield i, kind, a, b


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every_window: bool = False, **training) -> DataFrame:
    """One row for each finding: (doc_id, kind, start, value), start counting characters from 1.

    Null and empty texts have none; very long texts are tagged whole, window by window; repeated rows give
    repeated findings; a null id stays null; extra columns are ignored; an empty table gives no row.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(**training))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 512) for x in batches for at in range(0, x.num_rows, 512)):
            texts = b.column(1).to_pylist()
            found = list(find_in(model.value, texts, every_window))
            who = pa.array([f[0] for f in found], pa.int64())
            columns = [b.column(0).take(who), pa.array([KINDS[f[1]] for f in found], pa.string()), pa.array([f[2] + 1 for f in found], pa.int64()), pa.array([texts[i][a:z] for i, _, a, z in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "kind", "start", "value"])

    rows = docs.select(quoted(id_col), quoted(text_col).cast("string").alias("t")).where("t is not null")
    return rows.mapInArrow(run, f"doc_id {kind}, kind string, start long, value string")
