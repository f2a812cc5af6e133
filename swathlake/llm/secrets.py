"""Secret scans: patterns find the base spans, a character convolutional network in numpy judges every other candidate in its context.

The network learns from labelled findings in the whole texts of all documents: their base findings and made-up keys planted
in them are positive, all other candidates negative. Shards of documents are taught side by side and their networks
averaged after each pass. Scores are calibrated on a quarter of the documents held out, and the threshold is the highest
that keeps the wanted recall there.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, mix, slices, text_bytes, written

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")
LEAST = {"assign": 12, "access": 18, "hex": 16, "model": 12}

#: Pieces of a shard, about; made-up keys for each document; characters of a text for each piece, about; steps wanted of a shard, and between how many passes they take.
SHARD, PLANTED, PER_PIECE, STEPS, PASSES = 1 << 14, 2, 600, 192, (3, 8)
#: Pieces of a step, the first pass's rate; logits are counted by steps of 1 / BINS within -FAR and FAR, parameters are averaged in units of 1 / UNIT.
BATCH, RATE, BINS, FAR, UNIT = 256, 0.02, 64, 200, 1 << 32
#: Pieces that the network reads at once.
AT_ONCE = 64
INSIDE, AROUND, WIDTH, FILTERS, EMBED = 44, 12, 5, 16, 8
#: NO_THRESHOLD: of a network that had nothing to learn or to hold out.
RECALL, NO_THRESHOLD = 0.98, 0.5

_table = np.zeros(256, bool)
_table[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True
_hex = np.zeros(256, bool)
_hex[[*range(48, 58), *range(97, 103)]] = True
#: Last letters of the words before an assignment.
_lasts = np.zeros(256, bool)
_lasts[[*b"dtnyDTNY"]] = True
_separator = np.zeros(256, bool)
_separator[[*b"/.-_=+"]] = True
_sign = np.zeros(256, bool)
_sign[[*b":="]] = True


def runs(member: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, none across rows, of `least` or more."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    last[offsets[1:]] = True
    begins, ends = member.copy(), member.copy()
    begins[1:] &= ~member[:-1] | first[1:n]
    ends[:-1] &= ~member[1:] | last[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    keep = e - s >= least
    return s[keep], e[keep]


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of all rows: leftmost non-overlapping matches of each pattern, short ones dropped."""
    raw, out = data.tobytes(), []
    for s, e in zip(*runs(_hex[data], offsets, LEAST["hex"]), strict=True):
        out.append((2, int(s), int(e)))
    at = raw.find(b"AKIA")
    while at >= 0:
        row = int(np.searchsorted(offsets, at, "right")) - 1
        m = ACCESS.match(raw, at, int(offsets[row + 1]))
        if m and m.end() - at >= LEAST["access"]:
            out.append((1, at, m.end()))
        at = raw.find(b"AKIA", m.end() if m else at + 1)
    signs = np.flatnonzero(_sign[data])
    if len(signs):
        # only rows where a sign stands, over blanks and a quote, behind the last letter of a keyword can match
        rows = np.searchsorted(offsets, signs, "right") - 1
        hit = set()
        for at, row in zip(signs.tolist(), rows.tolist(), strict=True):
            if row in hit:
                continue
            p, low = at - 1, int(offsets[row])
            while p >= low and raw[p] == 32:
                p -= 1
            if p >= low and raw[p] in b"\"'":
                p -= 1
            if p >= low and _lasts[raw[p]]:
                hit.add(row)
        for row in sorted(hit):
            for m in ASSIGN.finditer(raw, int(offsets[row]), int(offsets[row + 1])):
                if m.end(2) - m.start(2) >= LEAST["assign"]:
                    out.append((0, m.start(), m.end()))
    out.sort(key=lambda x: (x[1], x[0]))
    return out


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of key characters, without full stops and signs at either end, of 12 or more."""
    s, e = runs(_table[data], offsets, LEAST["model"])
    edge = np.zeros(256, bool)
    edge[[*b".=-_+/"]] = True
    s, e = s.copy(), e.copy()
    for _ in range(3):
        s += edge[data[s]] if len(s) else 0
        e -= edge[data[e - 1]] if len(e) else 0
    keep = e - s >= LEAST["model"]
    return s[keep], e[keep]


def pieces(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, candidate) of what the network reads: candidates of INSIDE characters or fewer as they are; of longer ones, windows of INSIDE over the whole at half that step, and the parts between separators."""
    starts, ends, owner = [s[e - s <= INSIDE]], [e[e - s <= INSIDE]], [np.flatnonzero(e - s <= INSIDE)]
    for i in np.flatnonzero(e - s > INSIDE).tolist():
        at = np.append(np.arange(s[i], e[i] - INSIDE, INSIDE // 2), e[i] - INSIDE)
        cut = np.concatenate([[s[i] - 1], s[i] + np.flatnonzero(_separator[data[s[i] : e[i]]]), [e[i]]])
        a, b = cut[:-1] + 1, cut[1:]
        ok = (b - a >= LEAST["model"]) & (b - a <= INSIDE)
        starts += [at, a[ok]]
        ends += [at + INSIDE, b[ok]]
        owner.append(np.full(len(at) + int(ok.sum()), i))
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)


def greatest(p: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The greatest value of the pieces of each of n candidates."""
    out = np.zeros(n)
    np.maximum.at(out, owner, p)
    return out


def encode(data: np.ndarray, offsets: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """(n, AROUND + INSIDE + AROUND) codes: text before, the candidate's characters (long ones: begin and end), text after; 0 pads."""
    row = np.searchsorted(offsets, s, "right") - 1
    low, high = offsets[row], offsets[row + 1]
    width = 2 * AROUND + INSIDE
    at = np.empty((len(s), width), np.int64)
    k = np.arange(AROUND)
    at[:, :AROUND] = s[:, None] - AROUND + k
    at[:, AROUND + INSIDE :] = e[:, None] + k
    j, n = np.arange(INSIDE), (e - s)[:, None]
    at[:, AROUND : AROUND + INSIDE] = np.where((n > INSIDE) & (j >= INSIDE // 2), e[:, None] - INSIDE + j, s[:, None] + j)
    bad = (at < low[:, None]) | (at >= high[:, None])
    bad[:, AROUND : AROUND + INSIDE] |= (j[None, :] >= n)
    code = np.where(bad, 0, np.clip(data[np.clip(at, 0, max(len(data) - 1, 0))], 1, 127) if len(data) else 0)
    return code.astype(np.uint8)


class Network:
    """Embedding, one convolution of WIDTH over the codes, rectifier, maximum and mean over the candidate and maximum over its context, logistic output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        n = 3 * FILTERS
        self.p = {"E": r.normal(0, 0.5, (128, EMBED)), "W": r.normal(0, 0.25, (WIDTH, EMBED, FILTERS)), "b": np.zeros(FILTERS), "v": r.normal(0, 0.2, n), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, NO_THRESHOLD

    def columns(self, codes: np.ndarray) -> np.ndarray:
        """(places, WIDTH * EMBED): what the convolution reads at each place of each row."""
        e = np.take(self.p["E"], codes, 0)
        n, m = len(codes), codes.shape[1] - WIDTH + 1
        x = np.lib.stride_tricks.as_strided(e, (n, m, WIDTH * EMBED), (e.strides[0], e.strides[1], e.itemsize))
        return x.reshape(-1, WIDTH * EMBED)

    def hidden(self, x: np.ndarray, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """(FILTERS, rows, places) after the rectifier, from columns(), and what the output reads of each row."""
        z = (self.p["W"].reshape(-1, FILTERS).T @ x.T).reshape(FILTERS, rows, -1)
        z += self.p["b"][:, None, None]
        np.maximum(z, 0, out=z)
        a, b = AROUND - WIDTH // 2, AROUND + INSIDE - WIDTH // 2
        return z, [z[:, :, a:b].max(2).T, z[:, :, a:b].mean(2).T, np.maximum(z[:, :, :a].max(2), z[:, :, b:].max(2)).T]

    def logits(self, codes: np.ndarray, block: int = AT_ONCE) -> np.ndarray:
        blocks = (codes[i : i + block] for i in range(0, len(codes), block))
        out = [np.concatenate(self.hidden(self.columns(c), len(c))[1], 1) @ self.p["v"] + self.p["c"] for c in blocks]
        return np.concatenate(out) if out else np.zeros(0)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(codes) + self.shift, -40, 40)))

    def gradients(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        out: dict = {}
        for k in range(0, len(codes), AT_ONCE):  # small enough for a core's cache
            for name, g in self._gradients(codes[k : k + AT_ONCE], y[k : k + AT_ONCE], weight[k : k + AT_ONCE] / len(y)).items():
                out[name] = out[name] + g if k else g
        return out

    def _gradients(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        columns = self.columns(codes)
        z, parts = self.hidden(columns, len(codes))
        x = np.concatenate(parts, 1)
        d = (1 / (1 + np.exp(-np.clip(x @ self.p["v"] + self.p["c"], -40, 40))) - y) * weight
        d = d.astype(x.dtype)
        g = {"v": x.T @ d, "c": d.sum(keepdims=True)}
        dx = (d[:, None] * self.p["v"][None, :]).T
        a, b = AROUND - WIDTH // 2, AROUND + INSIDE - WIDTH // 2
        dz, f, n = np.zeros_like(z), np.arange(FILTERS)[:, None], np.arange(z.shape[1])[None, :]
        dz[:, :, a:b] = dx[FILTERS : 2 * FILTERS, :, None] / (b - a)
        dz[f, n, a + z[:, :, a:b].argmax(2)] += dx[:FILTERS]
        outer = np.concatenate([z[:, :, :a], z[:, :, b:]], 2)
        at = outer.argmax(2)
        dz[f, n, np.where(at < a, at, at - a + b)] += dx[2 * FILTERS :]
        dz *= z > 0
        g["b"] = dz.sum((1, 2))
        m, flat = z.shape[2], dz.reshape(FILTERS, -1)
        g["W"] = (flat @ columns).T.reshape(self.p["W"].shape)
        # what comes back to a character: from the WIDTH places that read it, with none beyond either end
        side = WIDTH - 1
        wide = np.zeros((len(codes), m + 2 * side, FILTERS), z.dtype)
        wide[:, side : side + m] = dz.transpose(1, 2, 0)
        back = np.lib.stride_tricks.as_strided(wide, (*codes.shape, WIDTH * FILTERS), (wide.strides[0], wide.strides[1], wide.itemsize)).reshape(-1, WIDTH * FILTERS)
        back = back @ self.p["W"][::-1].transpose(0, 2, 1).reshape(-1, EMBED)
        slot = (codes.astype(np.int64) * EMBED)[:, :, None] + np.arange(EMBED)
        g["E"] = np.bincount(slot.reshape(-1), back.reshape(-1), 128 * EMBED).reshape(128, EMBED).astype(z.dtype)
        return g

    def train(self, codes: np.ndarray, y: np.ndarray, share: float, state: dict, rate: float = RATE) -> None:
        """Steps of BATCH over the pieces, once; `share` of all pieces are positive, `state` is carried from call to call."""
        m, v = state.setdefault("m", {}), state.setdefault("v", {})
        weight = np.where(y > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
        order = np.random.default_rng(5).permutation(len(y))
        for at in range(0, len(y), BATCH):
            b = order[at : at + BATCH]
            step = state["step"] = state.get("step", 0) + 1
            for k, g in self.gradients(codes[b], y[b], weight[b]).items():
                m[k], v[k] = 0.9 * m.get(k, 0) + 0.1 * g, 0.99 * v.get(k, 0) + 0.01 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.p.values()])

    def fill(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).copy()
            at += x.size

    def counted(self, codes: np.ndarray, y: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kind, bin) rows of logits and how often they come: kinds 0 and 1 are negative and positive pieces, 2 the greatest piece of each candidate with a positive one (`owner` tells a piece's)."""
        z = np.floor(np.clip(self.logits(codes), -FAR, FAR) * BINS).astype(np.int64)
        own, k = np.unique(owner, return_inverse=True)
        top, positive = np.full(len(own), -FAR * BINS), np.zeros(len(own), bool)
        np.maximum.at(top, k, z)
        positive[k[y > 0]] = True
        rows = np.concatenate([np.stack([(y > 0).astype(np.int64), z], 1), np.stack([np.full(int(positive.sum()), 2), top[positive]], 1)])
        return np.unique(rows, axis=0, return_counts=True) if len(rows) else (rows, np.zeros(0, np.int64))

    def settle(self, rows: np.ndarray, n: np.ndarray, recall: float = RECALL) -> None:
        """Scale and shift of the logits by Newton steps on counted() pieces; then the highest threshold of the wanted recall of the positive candidates, to 1 / BINS of a logit."""
        of, low = rows[:, 0], rows[:, 1] / BINS
        w, own = np.array([1.0, 0.0]), of == 2
        x, y, many = np.stack([low[~own] + 0.5 / BINS, np.ones(int((~own).sum()))], 1), of[~own], n[~own]
        loss = lambda w: (many * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + 0.5e-2 * ((w - [1, 0]) ** 2).sum()
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (many * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            step = np.linalg.solve(h, x.T @ (many * (p - y)) + 1e-2 * (w - [1, 0]))
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:  # a whole step may go too far
                step = step / 2
            w = w - step
        self.scale, self.shift = float(w[0]), float(w[1])
        if not own.any():
            self.threshold = NO_THRESHOLD
            return
        ends = [1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40))) for z in (low[own], low[own] + 1 / BINS)]
        p, many = np.minimum(*ends), n[own]
        order = np.argsort(p)
        at = np.searchsorted(np.cumsum(many[order]), int((1 - recall) * many.sum()), "right")
        self.threshold = float(p[order][at])

    def calibrate(self, codes: np.ndarray, y: np.ndarray, owner: np.ndarray, recall: float = RECALL) -> None:
        self.settle(*self.counted(codes, y, owner), recall)


_upper, _lower, _digit = (np.frombuffer(x, np.uint8) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"))
_alphabets = [
    np.concatenate(x)
    for x in ([_digit, _upper[:6]], [_upper, _lower, _digit], [_upper, _lower, _digit, np.frombuffer(b"+/", np.uint8)], [_lower, _digit], [_upper, _digit], [_upper, _lower, _digit, np.frombuffer(b"-_", np.uint8)])
]
_letters = np.stack([np.resize(x, 64) for x in _alphabets])
_sizes = np.array([len(x) for x in _alphabets], np.uint64)
_prefixes = (b"", b"", b"sk-", b"key_", b"ghp_", b"xoxb-")


def made_up_keys(seeds: np.ndarray) -> list[bytes]:
    """A key of a random make for each seed."""
    u = mix(mix(seeds)[:, None] + np.arange(64, dtype=np.uint64))
    kind = (u[:, 0] % np.uint64(6)).astype(np.int64)
    size = np.where(kind == 0, 16 + u[:, 1] % np.uint64(33), 18 + u[:, 1] % np.uint64(43)).astype(np.int64)
    prefix = np.where(kind == 0, 0, u[:, 2] % np.uint64(6)).astype(np.int64)
    tail = (kind == 2) & (u[:, 3] % np.uint64(10) < 3)
    body = _letters[kind[:, None], (u[:, 4:] % _sizes[kind][:, None]).astype(np.int64)]
    return [_prefixes[q] + x[:n].tobytes() + b"==" * t for x, n, q, t in zip(body, size.tolist(), prefix.tolist(), tail.tolist(), strict=True)]


def made_up(r: np.random.Generator) -> bytes:
    return made_up_keys(r.integers(0, 1 << 63, 1).astype(np.uint64))[0]


def _path(r: random.Random, words: list[bytes], most: int = 5) -> bytes:
    """Some words as parts of a path."""
    return b"".join(w for k in range(r.randint(1, most)) for w in (r.choice((b"/", b".", b"-", b"_")) * (k > 0), r.choice(words)))


def _planted(data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The texts with PLANTED made-up keys each, at gaps between words, every fourth inside a path and every fourth before a path without one; and where the keys are. A row's seed decides."""
    raw, out, keys, size, off = data.tobytes(), [], [], 0, [0]
    gaps = np.flatnonzero((data == 32) | (data == 10))
    first = np.searchsorted(gaps, offsets)

    def add(part: bytes) -> None:
        nonlocal size
        out.append(part)
        size += len(part)

    u = mix(mix(seeds)[:, None] ^ np.arange(1, 2 * PLANTED + 1, dtype=np.uint64) << np.uint64(32))
    n = np.diff(first).astype(np.uint64)[:, None]
    to = np.where(n > 0, gaps[np.minimum(first[:-1, None] + (u[:, :PLANTED] % np.maximum(n, 1)).astype(np.int64), len(gaps) - 1)] if len(gaps) else 0, offsets[:-1, None])
    made = made_up_keys(u[:, PLANTED:].reshape(-1))
    way = (u[:, PLANTED:] % 4).tolist()
    for i, places in enumerate(np.sort(to, axis=1).tolist()):
        at, end = int(offsets[i]), int(offsets[i + 1])
        for j, p in enumerate(places):
            add(raw[at:p])
            at, before, after = p, b"", b""
            if way[i][j] < 2:
                words, r = [w for w in raw[p : min(p + 300, end)].split() if w.isalpha() and len(w) < 20] or [b"path"], random.Random(int(seeds[i]) + j)
                before, after = (_path(r, words) + b"/", b"/" + _path(r, words)) if way[i][j] else (b"", b" " + _path(r, words, 12))
            key = made[i * PLANTED + j]
            add(b" " + before)
            keys.append((size, size + len(key)))
            add(key + after + b" ")
        add(raw[at:end])
        off.append(size)
    return np.frombuffer(b"".join(out), np.uint8), np.array(off, np.int64), keys


def _lessons(docs: DataFrame, shards: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each candidate of each whole text, made-up keys included: its shard, its document's hash and its place there, whether it is held out, its pieces' codes and which of them are positive. Written, a shard in one file, in order of hash and place."""
    width = 2 * AROUND + INSIDE

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h = b.column("h").to_numpy()
            data, off, keys = _planted(*text_bytes(b.column("text")), h.view(np.uint64))
            cs, ce = candidates(data, off)
            if not len(cs):
                continue
            s, e, own = pieces(data, cs, ce)
            cover = np.zeros(len(data) + 1, np.int64)
            for p, q in [(p, q) for _, p, q in base_spans(data, off)] + keys:
                cover[p] += 1
                cover[q] -= 1
            cover = np.concatenate([[0], np.cumsum(np.cumsum(cover))])
            # a piece is positive if half of it is of a finding, negative if nothing is
            shared = cover[e] - cover[s]
            clear = np.flatnonzero((shared == 0) | (2 * shared >= np.minimum(e - s, LEAST["model"] * 2)))
            clear = clear[np.argsort(own[clear], kind="stable")]
            s, e, own, y = s[clear], e[clear], own[clear], (shared[clear] > 0).astype(np.uint8)
            codes = np.concatenate([encode(data, off, s[k : k + BATCH * 64], e[k : k + BATCH * 64]) for k in range(0, max(len(s), 1), BATCH * 64)])
            who, begin = np.unique(own, return_index=True)
            begin = np.append(begin, len(own))
            row = np.searchsorted(off, cs[who], "right") - 1
            binary = lambda x, at: pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(h[row]), pa.array(cs[who] - off[row]), binary(codes, begin * width), binary(y, begin)], ["h", "at", "codes", "y"])

    d = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    found = d.mapInArrow(make, "h long, at long, codes binary, y binary")
    found = found.select(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(shards)).alias("shard"), "h", "at", (F.pmod(F.xxhash64("h", F.lit(2)), F.lit(4)) == 0).alias("held"), "codes", "y")
    tasks = min(shards, max(4 * docs.sparkSession.sparkContext.defaultParallelism, shards // 4))  # shards are dealt by hash, so small tasks even them out
    return written(found.repartition(tasks, "shard").sortWithinPartitions("shard", "h", "at"), "lessons")


def _pieces_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and labels of a batch's pieces, and each one's row."""
    codes, _ = text_bytes(b.column("codes"))
    y, at = text_bytes(b.column("y"))
    return codes.reshape(-1, 2 * AROUND + INSIDE), y.astype(float), np.repeat(np.arange(b.num_rows), np.diff(at))


def _taught(lessons: DataFrame, net: Network, share: float, rate: float) -> np.ndarray:
    """The mean of the parameters of networks that go on from `net`, one for each shard."""

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, done, shard, student, state, waiting = np.zeros(len(net.flat()) + 1, np.int64), 0, None, Network(), {}, []

        def study() -> None:
            if waiting:
                student.train(np.concatenate([c for c, _ in waiting]), np.concatenate([y for _, y in waiting]), share, state, rate)
                waiting.clear()

        def close() -> None:
            study()
            if shard is not None:
                total[:-1] += np.rint(student.flat().astype(float) * UNIT).astype(np.int64)
                total[-1] += 1

        for b in batches:
            of = b.column("shard").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else []
            for k, to in zip(cut[:-1], cut[1:], strict=True):
                if of[k] != shard:
                    close()
                    shard, state, done = of[k], {}, 0
                    student.fill(net.flat().astype(np.float32))
                codes, y, _ = _pieces_of(b.slice(k, to - k))
                while len(y):  # blocks of SHARD, wherever batches end
                    n = min(len(y), SHARD - done)
                    waiting.append((codes[:n], y[:n]))
                    codes, y, done = codes[n:], y[n:], done + n
                    if done == SHARD:
                        study()
                        done = 0
        close()
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])

    # whole units, so that the order of the sums doesn't matter
    got = lessons.where("not held").select("shard", "codes", "y").mapInArrow(teach, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(net.flat()) + 1)
    for r in got:
        flat[r["k"]] = r["v"]
    return flat[:-1] / UNIT / flat[-1]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Trains on the whole texts of all of `docs`; three quarters of them by hash teach, the rest calibrate. Without any text the network stays as made, and judges nothing a secret but above 0.5."""
    size = docs.agg(F.count(text_col).alias("n"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars")).first()
    net = Network()
    if not size["n"]:
        return net
    lessons = _lessons(docs, 1 + (PLANTED * size["n"] + size["chars"] // PER_PIECE) // SHARD, id_col, text_col)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, _ = text_bytes(b.column("y"))
            yield pa.RecordBatch.from_arrays([pa.array([len(y)]), pa.array([int(y.sum())])], ["n", "positive"])

    taught = lessons.where("not held").select("y").mapInArrow(total, "n long, positive long").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).first()
    shards = lessons.where("not held").agg(F.countDistinct("shard")).first()[0]
    if shards and 0 < taught["positive"] < taught["n"]:
        passes = int(np.clip(np.ceil(STEPS * BATCH * shards / taught["n"]), *PASSES))
        for k in range(passes):
            net.fill(_taught(lessons, net, taught["positive"] / taught["n"], RATE * (1 - k / passes)))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, n = net.counted(*_pieces_of(b))
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(n)], ["kind", "bin", "n"])

        bins = lessons.where("held").select("codes", "y").mapInArrow(count, "kind long, bin long, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).orderBy("kind", "bin").collect()
        net.settle(np.array([(r["kind"], r["bin"]) for r in bins], np.int64).reshape(-1, 2), np.array([r["n"] for r in bins], np.int64))
    drop_written(lessons)
    return net


def spans(net: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans (base and the network's, which overlap no base span), as (kind, start, end) in bytes, by start and kind."""
    base = base_spans(data, offsets)
    s, e = candidates(data, offsets)
    if len(s) and base:
        b = np.array([x[1:] for x in base])
        reach = np.maximum.accumulate(b[:, 1])
        k = np.searchsorted(b[:, 0], e, "left")
        free = (k == 0) | (reach[np.maximum(k - 1, 0)] <= s)
        s, e = s[free], e[free]
    more = []
    if len(s):
        first, last, owner = pieces(data, s, e)
        hit = greatest(net.probabilities(encode(data, offsets, first, last)), owner, len(s)) >= net.threshold
        more = [(3, int(a), int(b)) for a, b in zip(s[hit], e[hit], strict=True)]
    return base, sorted(base + more, key=lambda x: (x[1], x[0]))


def _by_row(found: list[tuple[int, int, int]], data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Spans of each row with some, in code points of its text."""
    out: dict[int, list] = {}
    if found:
        rows = np.searchsorted(offsets, [x[1] for x in found], "right") - 1
        before = {}
        for (kind, a, b), row in zip(found, rows.tolist(), strict=True):
            if row not in before:
                text = data[offsets[row] : offsets[row + 1]]
                before[row] = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
            c, low = before[row], offsets[row]
            out.setdefault(row, []).append((kind, int(c[a - low]), int(c[b - low])))
    return out


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model; with `redacted` also the text with spans masked; then the columns in `carry`.

    One pass without a shuffle. Null and empty texts have no spans; repeated rows each get a row; a null id stays null.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, off = text_bytes(b.column("text"))
            base, every = spans(net, data, off)
            base, every = _by_row(base, data, off), _by_row(every, data, off)
            n = b.num_rows
            counts, sha, text = np.zeros((3, n), np.int64), [hashlib.sha256(b"").hexdigest()] * n, [""] * n
            for row, found in base.items():
                for k, _, _ in found:
                    counts[k, row] += 1
                sha[row] = hashlib.sha256(joined(found).encode()).hexdigest()
            model = np.zeros(n, np.int64)
            for row, found in every.items():
                text[row] = joined(found)
                model[row] = sum(k == 3 for k, _, _ in found)
            columns = [b.column("doc_id"), *[pa.array(c) for c in counts], pa.array(sha), pa.array(text), pa.array(model)]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"]
            if redacted:
                masked = b.column("text").to_pylist()
                for row, found in every.items():
                    masked[row] = mask(masked[row], found)
                columns.append(pa.array(masked, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays([*columns, *[b.column(f"carried_{k}") for k in range(len(carry))]], [*names, *[f"carried_{k}" for k in range(len(carry))]])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    kinds = "".join(f", carried_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    return d.mapInArrow(find, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long" + ", redacted string" * redacted + kinds).withColumnsRenamed({f"carried_{k}": c for k, c in enumerate(carry)})


def mask(text: str, found: list[tuple[int, int, int]]) -> str:
    """text with the union of the spans replaced by [SECRET]."""
    out, at = [], 0
    for _, a, b in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = b
    return "".join(out) + text[at:]


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document's whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, fit(docs))
