"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained in numpy from labelled spans.  Labels are what the fixed patterns find in a bounded
sample of windows (see :func:`fit`).  Decoding cuts a text into overlapping windows, finds the best tag
sequence of each, and reconciles them globally: every character takes the tag from the window in whose middle
half it lies, and runs of equal tags across window borders are one span.

Decoding is constrained: a span must hold a digit or an at sign, as all kinds here do.  A window without
either can only decode to no span at all, so it is not run; the result is the same.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, saved, text_of

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 64, 32
HIDDEN, TAGS = 12, len(KINDS) + 1
#: Windows per kind, and without a span, that training takes at most (those with the smallest hashes).
MOST_WINDOWS = 600
STEPS, BATCH, RATE = 500, 64, 0.03
LEAST_SPAN = 6
CHARS = 132                                   # 0: padding; 1-128: ASCII; then letters, digits, others

_TRIGGER = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OTHER = re.compile(r"[^0-9]+")


# ---------------------------------------------------------------------------
# Fixed patterns
# ---------------------------------------------------------------------------

def _emails(text: str):
    """Matches of local@domain, leftmost and non-overlapping; looks only at at signs, so long runs of local
    characters cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    doubled = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return doubled % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    if not _TRIGGER.search(text):
        return []
    found = [(a, b, 0) for a, b in _emails(text)]
    # Parts of up to 3 digits after leading zeros; longer ones are over 255.
    found += [(*m.span(), 1) for m in _IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in ((2, _CARD, 12, 19), (3, _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = _OTHER.sub("", m[0])
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                found.append((*m.span(), kind))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


# ---------------------------------------------------------------------------
# Network
# ---------------------------------------------------------------------------

def codes(text: str) -> np.ndarray:
    """Character numbers of a text: ASCII by character, others by class."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = points + 1
    for i in np.flatnonzero(points >= 128):
        c = text[i]
        out[i] = 129 if c.isalpha() else 130 if c.isdigit() else 131
    return out


@dataclass
class Network:
    """Weights: per direction a table of character inputs and a recurrent matrix; emissions; transitions."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        w = {}
        for d in ("f", "b"):
            w[f"in_{d}"] = rng.normal(0, 0.1, (CHARS, 4 * HIDDEN))
            w[f"in_{d}"][:, HIDDEN:2 * HIDDEN] += 1.0            # forget gates start open
            w[f"re_{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            w[f"out_{d}"] = rng.normal(0, 0.2, (HIDDEN, TAGS))
        w["bias"], w["move"] = np.zeros(TAGS), np.zeros((TAGS, TAGS))
        return Network({k: v.astype(np.float32) for k, v in w.items()})

    def run(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states (time, row, HIDDEN) of windows ``x`` (time, row) read in their given order."""
        w_in, w_re, h = self.weights[f"in_{d}"], self.weights[f"re_{d}"], HIDDEN
        out = np.empty((*x.shape, h), np.float32)
        state, cell, held = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32), []
        for t in range(len(x)):
            z = w_in[x[t]] + state @ w_re
            gate = 1 / (1 + np.exp(-z[:, :3 * h]))                # in, forget, out
            new = np.tanh(z[:, 3 * h:])
            before, cell = cell, gate[:, h:2 * h] * cell + gate[:, :h] * new
            shape = np.tanh(cell)
            last, state = state, gate[:, 2 * h:] * shape
            out[t] = state
            if keep:
                held.append((gate, new, before, shape, last))
        return out, held

    def emissions(self, x: np.ndarray, keep: bool = False):
        ahead, held_f = self.run(x, "f", keep)
        back, held_b = self.run(x[::-1], "b", keep)
        w = self.weights
        return ahead @ w["out_f"] + back[::-1] @ w["out_b"] + w["bias"], (ahead, held_f, back, held_b)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag sequences (time, row)."""
        e, _ = self.emissions(x)
        score, back = e[0], []
        for t in range(1, len(x)):
            through = score[:, :, None] + self.weights["move"]
            back.append(through.argmax(1))
            score = through.max(1) + e[t]
        tags = np.empty(x.shape, np.int64)
        tags[-1] = score.argmax(1)
        rows = np.arange(x.shape[1])
        for t in range(len(x) - 2, -1, -1):
            tags[t] = back[t][rows, tags[t + 1]]
        return tags

    def slopes(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log likelihood of tags ``y``."""
        w, n = self.weights, x.shape[1]
        e, (ahead, held_f, back, held_b) = self.emissions(x, keep=True)
        move = np.exp(w["move"])
        node = np.exp(e - e.max(2, keepdims=True))
        alpha, beta = np.empty_like(node), np.ones_like(node)
        alpha[0] = node[0] / node[0].sum(1, keepdims=True)
        for t in range(1, len(x)):
            a = (alpha[t - 1] @ move) * node[t]
            alpha[t] = a / a.sum(1, keepdims=True)
        g_move = np.zeros((TAGS, TAGS))
        for t in range(len(x) - 1, 0, -1):
            right = node[t] * beta[t]
            joint = alpha[t - 1][:, :, None] * move * right[:, None, :]
            g_move += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = right @ move.T
            beta[t - 1] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        np.subtract.at(g_move, (y[:-1].ravel(), y[1:].ravel()), 1)
        g_e = (p - np.eye(TAGS, dtype=np.float32)[y]) / n
        out = {"move": g_move / n, "bias": g_e.sum((0, 1))}
        for d, hidden, held, g, order in (("f", ahead, held_f, g_e, x), ("b", back, held_b, g_e[::-1], x[::-1])):
            out[f"out_{d}"] = np.einsum("tnh,tnk->hk", hidden, g)
            g_h = g @ w[f"out_{d}"].T
            out[f"in_{d}"], out[f"re_{d}"] = self._back(order, d, held, g_h)
        return out

    def _back(self, x, d, held, g_h):
        w_re, h = self.weights[f"re_{d}"], HIDDEN
        g_in, g_re = np.zeros((CHARS, 4 * h), np.float32), np.zeros_like(w_re)
        later, g_cell = np.zeros_like(g_h[0]), np.zeros_like(g_h[0])
        for t in range(len(x) - 1, -1, -1):
            gate, new, before, shape, last = held[t]
            g = g_h[t] + later
            g_cell = g_cell + g * gate[:, 2 * h:] * (1 - shape ** 2)
            g_gate = np.concatenate([g_cell * new, g_cell * before, g * shape], 1) * gate * (1 - gate)
            z = np.concatenate([g_gate, g_cell * gate[:, :h] * (1 - new ** 2)], 1)
            np.add.at(g_in, x[t], z)
            g_re += last.T @ z
            later = z @ w_re.T
            g_cell = g_cell * gate[:, h:2 * h]
        return g_in, g_re


def train(windows: np.ndarray, tags: np.ndarray, seed: int = 7) -> Network:
    """A network fitted to windows (row, time) and their tags, by Adam; the order of rows is taken as given.
    Without any window the network tags nothing."""
    net = Network.fresh(seed)
    if not len(windows):
        net.weights["bias"][0] = 30.0
        return net
    rng = np.random.default_rng(seed)
    m, v, step = {k: 0.0 for k in net.weights}, {k: 0.0 for k in net.weights}, 0
    while step < STEPS:
        order = rng.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            rows = order[start:start + BATCH]
            step += 1
            rate = RATE * max(0.02, 1 - step / STEPS)
            for k, g in net.slopes(windows[rows].T, tags[rows].T).items():
                g = np.clip(g, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                move = rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
                net.weights[k] = (net.weights[k] - move).astype(np.float32)
    return net


# ---------------------------------------------------------------------------
# Windows
# ---------------------------------------------------------------------------

def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign, of windows at every STRIDE characters."""
    last = max(0, -(-(len(text) - WIDTH) // STRIDE))
    found: list[int] = []
    for m in _TRIGGER.finditer(text):
        low = max(0, -(-(m.start() - WIDTH + 1) // STRIDE))
        for k in range(max(low, found[-1] + 1 if found else 0), min(last, m.start() // STRIDE) + 1):
            found.append(k)
    return [k * STRIDE for k in found]


def _padded(x: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WIDTH, np.int64)
    part = x[start:start + WIDTH]
    out[:len(part)] = part
    return out


def tag_texts(net: Network, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Model spans of texts: runs of equal tags after the windows are reconciled."""
    rows, place = [], []
    for i, text in enumerate(texts):
        starts = window_starts(text)
        x = codes(text) if starts else None
        for s in starts:
            rows.append(_padded(x, s))
            place.append((i, s))
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not rows:
        return spans
    distinct, which = np.unique(np.array(rows, np.int64), axis=0, return_inverse=True)
    tags = np.concatenate([net.decode(distinct[a:a + 2048].T).T for a in range(0, len(distinct), 2048)])
    quarter = (WIDTH - STRIDE) // 2
    last: dict[int, int] = {}
    for n, (i, s) in enumerate(place):
        size = len(texts[i])
        low = s if s == 0 else s + quarter
        high = size if s + WIDTH >= size else s + quarter + STRIDE
        own = tags[which[n]][low - s:high - s]
        edge = np.flatnonzero(np.diff(own)) + 1
        for a, b in zip([0, *edge], [*edge, len(own)]):
            if own[a]:
                start, end, kind = low + int(a), low + int(b), KINDS[own[a] - 1]
                if spans[i] and spans[i][-1][1] == start and spans[i][-1][2] == kind:
                    start = spans[i].pop()[0]
                spans[i].append((start, end, kind))
        last[i] = high
    return spans


def all_spans(net: Network, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text.  A model span is trimmed of blanks and closing marks and added if
    it holds a digit or an at sign, has LEAST_SPAN characters and touches no base span."""
    out = []
    for text, extra in zip(texts, tag_texts(net, texts)):
        base = base_spans(text)
        added = []
        for a, b, kind in extra:
            while a < b and text[a] in " \t\n\r.,;:(":
                a += 1
            while b > a and text[b - 1] in " \t\n\r.,;:(":
                b -= 1
            if (b - a >= LEAST_SPAN and _TRIGGER.search(text, a, b)
                    and not any(x < b and a < y for x, y, _ in base)):
                added.append((a, b, kind))
        out.append((base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))))
    return out


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------

def fit(docs: DataFrame, most: int = MOST_WINDOWS) -> Network:
    """Train on at most ``most`` distinct windows of each kind of span, and as many without one, of all
    documents; a window's labels are the fixed patterns' spans in its document."""

    def work():
        def cut(texts):
            out = []
            for text in texts:
                rows, base = [], base_spans(text)
                starts = window_starts(text)
                if starts:
                    tags = np.zeros(len(text), np.int64)
                    for a, b, kind in reversed(base):              # of overlapping spans the first wins
                        tags[a:b] = KINDS.index(kind) + 1
                    for s in starts:
                        part = tags[s:s + WIDTH]
                        mark = int(part.max(initial=0)) if not part.any() else int(part[part > 0][0])
                        rows.append({"chars": text[s:s + WIDTH], "tags": "".join(map(str, part)), "mark": mark})
                out.append(rows)
            return [out]
        return cut

    kind = pa.list_(pa.struct([("chars", pa.string()), ("tags", pa.string()), ("mark", pa.int32())]))
    found = (map_text(docs.select(text_of().alias("text")), "text", work,
                      [("windows", "array<struct<chars:string,tags:string,mark:int>>", kind)])
             .select(F.explode("windows").alias("w")).select("w.*").distinct())
    found = saved(found)
    rows = []
    for mark in range(TAGS):
        rows += (found.filter(F.col("mark") == mark).orderBy(F.xxhash64("chars", "tags"), "chars", "tags")
                 .limit(most).collect())
    windows = np.array([_padded(codes(r["chars"]), 0) for r in rows], np.int64).reshape(-1, WIDTH)
    tags = np.zeros_like(windows)
    for i, r in enumerate(rows):
        tags[i, :len(r["tags"])] = [int(c) for c in r["tags"]]
    return train(windows, tags)


def personal_data(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, end, kind), code points, end exclusive.

    Null and empty texts have none.  Each row is read by itself, so repeated rows and ties need no rule.
    Trains on ``docs`` unless a network is given.
    """
    weights = (net or fit(docs)).weights

    def work():
        own = Network(weights)

        def find(texts):
            pairs = all_spans(own, [t or "" for t in texts])
            as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
            return [[as_rows(x) for x, _ in pairs], [as_rows(y) for _, y in pairs]]
        return find

    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    ddl = "array<struct<start:bigint,end:bigint,kind:string>>"
    return map_text(docs, "text", work, [("base", ddl, arrow), ("spans", ddl, arrow)])


def digest(found: DataFrame) -> DataFrame:
    """The registered columns: base counts, the digest of the base spans and all spans as text."""
    def listed(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
                        listed("spans").alias("spans"))


def span_digest(spans: list[tuple[int, int, str]]) -> str:
    """The digest of spans as :func:`digest` gives it."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
