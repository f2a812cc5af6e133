"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of a bounded, documented sample of
labelled documents. Scoring cuts every whole text into windows, labels each byte position and pools the positions'
probabilities over the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, text_bytes

WINDOW = 128
#: Bound of the training sample: windows of SAMPLE_CHARS characters from this many documents of each language.
SAMPLE_PER_LANGUAGE, SAMPLE_WINDOWS, SAMPLE_CHARS, MOST_LANGUAGES = 400, 3, 200, 64
HIDDEN, EPOCHS, BATCH, RATE = 8, 6, 256, 0.02
UNKNOWN = "und"


class Network:
    """h(t) = (1 - f) h(t-1) + f c with f = sigmoid and c = tanh of E[byte] + U h(t-1), in both directions; a linear layer labels each position."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {
            "E": r.normal(0, 0.3, (2, 2 * hidden, 256)).astype(np.float32),
            "U": r.normal(0, 0.4 / np.sqrt(hidden), (2, 2 * hidden, hidden)).astype(np.float32),
            "W": r.normal(0, 0.3, (2, classes, hidden)).astype(np.float32),
            "c": np.zeros((classes, 1), np.float32),
        }

    def _run(self, x: np.ndarray, d: int, keep: bool):
        """x: (T, B) bytes. Yields (t, h, f, c, h before) in the order of direction d."""
        p, h = self.p, np.zeros((self.h, x.shape[1]), np.float32)
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            z = p["U"][d] @ h
            z += np.take(p["E"][d], x[t], axis=1)
            f, c = z[: self.h], z[self.h :]
            np.negative(f, out=f)
            np.exp(f, out=f)
            f += 1
            np.reciprocal(f, out=f)
            np.tanh(c, out=c)
            if keep:
                new = h + f * (c - h)
                yield t, new, f, c, h
                h = new
            else:
                c -= h
                c *= f
                h += c
                yield t, h, None, None, None

    def position_probabilities(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(t, (classes, B) probabilities) for each position of (T, B) bytes."""
        p = self.p
        ahead = np.empty((len(x), len(p["c"]), x.shape[1]), np.float32)
        for t, h, *_ in self._run(x, 0, False):
            np.matmul(p["W"][0], h, out=ahead[t])
        for t, h, *_ in self._run(x, 1, False):
            z = ahead[t]
            z += p["W"][1] @ h
            z += p["c"]
            z -= z.max(0)
            np.exp(z, out=z)
            z /= z.sum(0)
            yield t, z

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over unmasked positions and its gradients, by backpropagation through time."""
        p, steps = self.p, [list(self._run(x, d, True)) for d in (0, 1)]
        total = max(mask.sum(), 1)
        hs = [{t: h for t, h, *_ in s} for s in steps]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dh_at: list[dict] = [{}, {}]
        loss = 0.0
        for t in range(len(x)):
            z = p["W"][0] @ hs[0][t] + p["W"][1] @ hs[1][t] + p["c"]
            z -= z.max(0)
            np.exp(z, out=z)
            z /= z.sum(0)
            loss -= float((np.log(z[y, np.arange(len(y))] + 1e-9) * mask[t]).sum())
            z[y, np.arange(len(y))] -= 1
            z *= mask[t] / total
            g["c"] += z.sum(1, keepdims=True)
            for d in (0, 1):
                g["W"][d] += z @ hs[d][t].T
                dh_at[d][t] = p["W"][d].T @ z
        for d in (0, 1):
            dh = np.zeros_like(hs[d][0])
            for t, _, f, c, before in reversed(steps[d]):
                dh = dh + dh_at[d][t]
                dz = np.concatenate([dh * (c - before) * f * (1 - f), dh * f * (1 - c * c)])
                g["U"][d] += dz @ before.T
                for k in range(2 * self.h):
                    g["E"][d][k] += np.bincount(x[t], dz[k], 256)
                dh = dh * (1 - f) + p["U"][d].T @ dz
        return loss / total, g

    def train(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> list[float]:
        """Adam over shuffled batches. x, mask: (T, N)."""
        r, m, v, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        steps = max(1, epochs * -(-len(y) // BATCH))
        for _ in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), BATCH):
                b = order[at : at + BATCH]
                loss, g = self.gradients(x[:, b], y[b], mask[:, b])
                losses.append(loss)
                size = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
                step += 1
                lr = rate * (1 - 0.9 * step / steps)
                for k, q in g.items():
                    q = q / max(1.0, size)
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * q
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * q * q
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(T, N) bytes, (T, N) mask of positions not yet in an earlier window, (N,) row numbers. The last window of a long row ends where it ends; a short row is padded with 0."""
    length = np.diff(offsets)
    count = -(-length // size)
    row = np.repeat(np.arange(len(length)), count)
    k = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    begin, end = offsets[:-1][row], offsets[1:][row]
    fresh = begin + k * size
    start = np.maximum(begin, np.minimum(fresh, end - size))
    at = start[None, :] + np.arange(size)[:, None]
    mask = (at >= fresh) & (at < end)
    x = data[np.minimum(at, end - 1)] if len(data) else np.zeros((size, 0), np.uint8)
    x[at >= end] = 0
    return x, mask, row


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray, block: int = 2048) -> np.ndarray:
    """(rows, classes): mean of the positions' probabilities; rows without text have zeros."""
    out = np.zeros((len(offsets) - 1, len(net.p["c"])))
    x, mask, row = windows(data, offsets)
    for at in range(0, len(row), block):
        xb, mb = np.ascontiguousarray(x[:, at : at + block]), mask[:, at : at + block].astype(np.float32)
        total = np.zeros((out.shape[1], xb.shape[1]), np.float32)
        for t, z in net.position_probabilities(xb):
            z *= mb[t]
            total += z
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(row[at : at + block], total[k], len(out))
    return out / np.maximum(np.diff(offsets), 1)[:, None]


def training_rows(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(language, window) pairs of a bounded sample, chosen by a hash of the id; windows lie anywhere in the text."""
    d = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null")
    sizes = sorted(((r["l"], r["count"]) for r in d.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MOST_LANGUAGES).collect()))
    if not sizes:
        return []
    h = F.xxhash64(F.col("i").cast("string"), F.lit(17))
    share = F.element_at(F.create_map(*[x for name, n in sizes for x in (F.lit(name), F.lit(min(1.0, 1.5 * SAMPLE_PER_LANGUAGE / n)))]), F.col("l"))
    picked = d.withColumn("h", h).where((F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))) < share)
    starts = [(F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(1))) + 1).cast("int") for k in range(SAMPLE_WINDOWS)]
    rows = picked.select("l", "h", *[F.col("t").substr(s, F.lit(SAMPLE_CHARS)).alias(f"w{k}") for k, s in enumerate(starts)]).orderBy("h").limit(2 * SAMPLE_PER_LANGUAGE * len(sizes)).collect()
    seen: dict[str, int] = {}
    out = []
    for r in rows:
        seen[r["l"]] = seen.get(r["l"], 0) + 1
        if seen[r["l"]] <= SAMPLE_PER_LANGUAGE:
            out += [(r["l"], r[f"w{k}"]) for k in range(SAMPLE_WINDOWS)]
    return out


def fit(labelled: DataFrame, **columns: str) -> tuple[Network, list[str]] | None:
    """The trained network and its languages; None if no row has a text and a language."""
    rows = training_rows(labelled, **columns)
    if not rows:
        return None
    names = sorted({r[0] for r in rows})
    raw = [w.encode()[:WINDOW] for _, w in rows]
    x, mask = np.zeros((WINDOW, len(raw)), np.uint8), np.zeros((WINDOW, len(raw)), np.float32)
    for k, w in enumerate(raw):
        x[: len(w), k] = np.frombuffer(w, np.uint8)
        mask[: len(w), k] = 1
    net = Network(len(names))
    net.train(x, np.array([names.index(r[0]) for r in rows]), mask)
    return net, names


def identify(docs: DataFrame, model: tuple[Network, list[str]] | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, lang_pred, score and the columns named in `carry`, in one pass without a shuffle.

    Null texts and texts without a letter are `und` with score 0, as is every row when there is no model. A null id
    stays null; repeated rows each get a row; other columns are not read.
    """
    kept = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)]
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), *kept)
    back = [F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)]
    if model is None:
        return d.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *back)
    net, names = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            letters = b.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            p = document_probabilities(net, *text_bytes(b.column("text")))
            best = p.argmax(1)
            lang = pc.if_else(pa.array(letters), pa.array(names).take(pa.array(best)), UNKNOWN)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lang.cast(pa.string()), pa.array(np.where(letters, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)), *[b.column(f"carried_{k}") for k in range(len(carry))]], ["doc_id", "lang_pred", "score", *[f"carried_{k}" for k in range(len(carry))]])

    kinds = "".join(f", carried_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    return d.mapInArrow(score, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double" + kinds).select("doc_id", "lang_pred", "score", *back)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language; trained on the documents whose crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
