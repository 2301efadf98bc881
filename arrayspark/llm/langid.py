"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent networks read windows of bytes, one from each end; every position gets a distribution
over the languages from both states. A document's distribution is the mean over all its positions, so
whole texts count. The network is trained with numpy by backpropagation through time.

Defined results: null texts and texts without a letter are ``und`` with score 0; repeated rows have equal
results; ties go to the language that sorts first; an empty table gives an empty result; without any
labelled text every prediction is ``und``; a very long text is one task's, block by block of windows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import held_out, map_batches
from .textblocks import buffers, slices

WINDOW = 64
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, by the exponential, which numpy vectorises; overflow to infinity gives the limit, 0."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x += x
    _sigmoid(x)
    x += x
    x -= 1
    return x


def states(p: dict[str, np.ndarray], x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, direction, rows, hidden) over bytes ``x`` (steps, rows), each direction in its reading order.

    ``w`` (gate, direction, byte, hidden) and ``u`` (gate, direction, hidden, hidden) hold the gates update,
    reset and candidate, so a step is one look-up and one product for both directions.
    """
    gates, both, _, hidden = p["w"].shape
    table = p["w"].reshape(-1, hidden)
    base = (np.arange(gates * both) * 256).reshape(gates, both, 1)
    h = np.zeros((both, x.shape[1], hidden), p["w"].dtype)
    out = np.empty((len(x), *h.shape), h.dtype)
    with np.errstate(over="ignore"):
        for t in range(len(x)):
            at = base + np.stack([x[t], x[len(x) - 1 - t]])
            g, q = table.take(at, 0), h @ p["u"]
            g[:2] += q[:2]
            z, r = _sigmoid(g[:2])
            n = _tanh(g[2] + r * q[2])
            if keep is not None:
                keep.append((at, h, z, r, q[2], n))
            h = n + z * (h - n)
            out[t] = h
    return out


def back(p: dict[str, np.ndarray], kept: list, dout: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of ``w`` and ``u`` from those of the states, by backpropagation through time."""
    hidden = dout.shape[-1]
    du = np.zeros_like(p["u"])
    spots, parts = [], []
    dh = np.zeros_like(dout[0])
    for t in range(len(kept) - 1, -1, -1):
        at, h, z, r, q, n = kept[t]
        dh = dh + dout[t]
        dn = dh * (1 - z) * (1 - n * n)
        dg = np.stack([dh * (h - n) * z * (1 - z), dn * q * r * (1 - r), dn])
        dq = np.stack([dg[0], dg[1], dn * r])
        du += h.transpose(0, 2, 1) @ dq
        spots.append(at.ravel())
        parts.append(dg.reshape(-1, hidden))
        dh = dh * z + (dq @ p["u"].transpose(0, 1, 3, 2)).sum(axis=0)
    spot, part = np.concatenate(spots), np.concatenate(parts)
    order = np.argsort(spot.astype(np.int16), kind="stable")
    first = np.flatnonzero(np.diff(spot[order], prepend=-1))
    dw = np.zeros((p["w"].size // hidden, hidden), p["w"].dtype)
    dw[spot[order[first]]] = np.add.reduceat(part[order], first)
    return {"w": dw.reshape(p["w"].shape), "u": du}


def train_network(windows: np.ndarray, label: np.ndarray, classes: int, hidden: int = 8, steps: int = 200, rows: int = 256, rate: float = 0.02, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters after ``steps`` of Adam on (n, WINDOW) bytes; each position is trained on its text's label."""
    rng = np.random.default_rng(seed)
    shapes = {"w": (3, 2, 256, hidden), "u": (3, 2, hidden, hidden), "v": (2 * hidden, classes)}
    p = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in shapes.items()} | {"c": np.zeros(classes, np.float32)}
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    by = [np.flatnonzero(label == c) for c in range(classes)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(ix, max(1, rows // classes)) for ix in by if len(ix)])  # languages in equal parts
        x, y = windows[pick].T, label[pick]
        kept: list = []
        out = states(p, x, kept)
        hs = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        logit = hs @ p["v"] + p["c"]
        prob = np.exp(logit - logit.max(axis=2, keepdims=True))
        prob /= prob.sum(axis=2, keepdims=True)
        prob[:, np.arange(len(y)), y] -= 1
        prob /= prob.shape[0] * prob.shape[1]
        dhs = prob @ p["v"].T
        grad = back(p, kept, np.stack([dhs[:, :, :hidden], dhs[::-1, :, hidden:]], axis=1))
        grad["v"] = hs.reshape(-1, 2 * hidden).T @ prob.reshape(-1, classes)
        grad["c"] = prob.sum(axis=(0, 1))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] += 0.1 * (grad[k] - m[k])
            s[k] += 0.01 * (grad[k] ** 2 - s[k])
            p[k] -= (lr * m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    p: dict[str, np.ndarray]

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """(steps, rows, languages) distributions of bytes ``windows`` (rows, steps)."""
        out = states(self.p, np.ascontiguousarray(windows.T))
        hidden = out.shape[-1]
        logit = out[:, 0] @ self.p["v"][:hidden]
        logit += out[::-1, 1] @ self.p["v"][hidden:] + self.p["c"]
        np.clip(logit, -40, 40, out=logit)
        np.exp(logit, out=logit)
        logit /= logit @ np.ones((logit.shape[2], 1), np.float32)
        return logit

    def documents(self, buf: np.ndarray, off: np.ndarray, block: int = 2048) -> np.ndarray:
        """(texts, languages) mean distributions; texts of no bytes have zeros."""
        size = np.diff(off)
        count = -(-size // WINDOW)
        first = np.concatenate([[0], np.cumsum(count)])
        start = np.repeat(off[:-1] - first[:-1] * WINDOW, count) + np.arange(first[-1]) * WINDOW
        length = np.minimum(WINDOW, np.repeat(off[1:], count) - start)
        padded = np.concatenate([buf, np.full(WINDOW, 32, np.uint8)])
        sums = np.zeros((first[-1], len(self.languages)))
        step = np.arange(WINDOW)
        for a in range(0, first[-1], block):
            b = min(a + block, first[-1])
            inside = step[None, :] < length[a:b, None]
            windows = np.where(inside, padded[np.minimum(start[a:b, None] + step, len(padded) - 1)], 32)
            prob = self.positions(windows)
            if not inside.all():
                prob *= inside.T[:, :, None]
            sums[a:b] = prob.sum(axis=0)
        total = np.zeros((first[-1] + 1, len(self.languages)))
        np.cumsum(sums, axis=0, out=total[1:])
        return (total[first[1:]] - total[first[:-1]]) / np.maximum(size, 1)[:, None]


def fit(docs: DataFrame, per_language: int = 400, windows: int = 6, **options) -> LanguageModel | None:
    """A model of ``lang`` from about ``per_language`` texts of each language outside the held-out fold (documented bound).

    Texts enter by a hash of their id below a language's rate, and give ``windows`` windows each; of all that
    enter, a language keeps twice ``per_language * windows`` different ones at most, so what the driver gets
    doesn't grow with the table even if all rows have one id. The languages themselves are the driver's.
    """
    spot = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 3, 1)).select("doc_id", "lang", "text", spot.alias("spot"))
    counts = {r[0]: (r[1], r[2]) for r in known.groupBy("lang").agg(F.count("*"), F.min("spot")).collect()}
    if not counts:
        return None
    languages = tuple(sorted(counts))
    # below the rate, and the least id whatever the rate
    below = F.create_map(*[F.lit(x) for k in languages for x in (k, max(int(1_000_000 * min(1.0, per_language / counts[k][0])), counts[k][1] + 1))])
    chosen = known.where(F.col("spot") < below[F.col("lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            buf, off = buffers(part.column(2))
            langs, out = [], []
            for i, lang in enumerate(part.column(1).to_pylist()):
                text = buf[off[i] : off[i + 1]]
                if not _ASCII_LETTER[text].any() and not (text > 127).any():
                    continue
                for k in range(min(windows, max(1, len(text) // WINDOW))):
                    at = (k * max(1, len(text) - WINDOW)) // windows
                    langs.append(lang)
                    out.append(text[at : at + WINDOW].tobytes().ljust(WINDOW))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "w"])

    cuts = map_batches(chosen.select("doc_id", "lang", "text"), cut, "lang string, w binary").distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("w"), "w")
    kept = cuts.withColumn("k", F.row_number().over(first)).where(F.col("k") <= 2 * per_language * windows)
    got = kept.select("lang", "w").toArrow().sort_by([("lang", "ascending"), ("w", "ascending")])
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got.column("w").to_pylist()), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(np.array(languages), np.array(got.column("lang").to_pylist()))
    return LanguageModel(languages, train_network(x, y, len(languages), **options))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            buf, off = buffers(part.column(1))
            letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])
            known = letters[off[1:]] > letters[off[:-1]]
            for i in np.flatnonzero(~known & (np.diff(off) > 0)):
                known[i] = any(c.isalpha() for c in buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
            lang = np.full(part.num_rows, "und", object)
            score = np.zeros(part.num_rows)
            if model is not None and known.any():
                prob = model.documents(buf, off)
                best = prob.argmax(axis=1)
                lang[known] = np.array(model.languages, object)[best[known]]
                score[known] = np.clip(prob[np.arange(len(best)), best], 0, 1)[known]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", "text"), predict, "doc_id long, lang_pred string, score double")
