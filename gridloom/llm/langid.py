"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text forwards and backwards with gated recurrent
cells, labels every position with a distribution over languages, and a document's
probabilities are the mean over all its positions.  Texts are read in windows, so
that many run side by side and a long text needs no more memory: a window labels
``CORE`` bytes and reads ``CONTEXT`` bytes more on either side, across words, before
the state of either direction counts.  Every byte of the whole text is labelled once.

It is trained in numpy by backpropagation through time with Adam, on the driver,
from a bounded sample of whole labelled texts: ``TRAIN_DOCS`` a language, and
``TRAIN_ROWS`` in all where there are many languages, chosen by a hash of the row.
Every label found gets an output.  A training step draws spans of ``SPAN`` bytes from
anywhere in these texts, as many of each language.

Defined cases: null text, or a text without a letter -> 'und' with score 0; no
labelled row at all -> 'und' everywhere; equal probabilities -> the first language in
order; repeated rows give equal rows and train once; input columns called lang_pred
or score are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import map_text

#: Bounds of the training sample: documents a language, and in all.
TRAIN_DOCS, TRAIN_ROWS = 300, 20_000
EMBED, HIDDEN = 8, 16
STEPS, SPANS_A_STEP, SPAN, RATE = 500, 128, 32, 0.01
#: Bytes a window labels, and reads before and after these.
CORE, CONTEXT = 256, 16
#: Windows that go through the network at once.
RUN_WINDOWS = 1024


def _squash(x):
    """x / (1 + |x|): the cells' activation, several times as cheap as a tanh."""
    return x / (1.0 + np.abs(x))


def _slope(y):
    """Derivative of ``_squash`` where its value is y."""
    return (1.0 - np.abs(y)) ** 2


@dataclass
class BiGru:
    """p: parameters; E bytes x EMBED, W/U/b of each direction (gates z, r, h), V, c."""

    p: dict
    langs: list[str]

    @staticmethod
    def fresh(langs: list[str], seed: int = 7) -> "BiGru":
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"E": make(257, EMBED)}
        for d in "fb":
            p |= {f"W{d}": make(EMBED, 3 * HIDDEN), f"U{d}": make(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        return BiGru(p | {"V": make(2 * HIDDEN, len(langs)), "c": np.zeros(len(langs), np.float32)}, langs)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, N, H) of one direction; x (T, N) bytes, mask (T, N)."""
        steps, n = x.shape
        table = self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]
        u_zr, u_h = self.p[f"U{d}"][:, : 2 * HIDDEN], self.p[f"U{d}"][:, 2 * HIDDEN :]
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else reversed(range(steps)):
            a = table[x[t]]
            zr = 0.5 + 0.5 * _squash(a[:, : 2 * HIDDEN] + h @ u_zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            g = _squash(a[:, 2 * HIDDEN :] + (r * h) @ u_h)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, g, m))
            h = h + m * z * (g - h)
            out[t] = h
        return out

    def positions(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Label distribution of each position (T, N, langs)."""
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2)
        scores = both @ self.p["V"] + self.p["c"]
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        return scores / scores.sum(axis=2, keepdims=True)

    def loss_and_gradients(self, x, mask, label):
        """Mean cross entropy over positions and its gradients, through time."""
        p = self.p
        kept = {"f": [], "b": []}
        states = {d: self._run(x, mask, d, kept[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        scores = both @ p["V"] + p["c"]
        scores -= scores.max(axis=2, keepdims=True)
        prob = np.exp(scores)
        prob /= prob.sum(axis=2, keepdims=True)
        total = mask.sum()
        picked = np.take_along_axis(prob, np.broadcast_to(label[None, :, None], (*x.shape, 1)), 2)[..., 0]
        loss = float(-(np.log(picked + 1e-12) * mask).sum() / total)
        ds = prob.copy()
        ds[:, np.arange(x.shape[1]), label] -= 1
        ds *= mask[..., None] / total
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        grads["V"] = np.einsum("tnh,tnl->hl", both, ds)
        grads["c"] = ds.sum((0, 1))
        d_both = ds @ p["V"].T
        for at, d in ((0, "f"), (HIDDEN, "b")):
            u = p[f"U{d}"]
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, z, r, g, m in reversed(kept[d]):
                dh = dh + d_both[t][:, at : at + HIDDEN]
                step = dh * m
                dz, dg = step * (g - h) * 0.5 * _slope(2 * z - 1), step * z * _slope(g)
                drh = dg @ u[:, 2 * HIDDEN :].T
                dr = drh * h * 0.5 * _slope(2 * r - 1)
                da = np.concatenate([dz, dr, dg], axis=1)
                grads[f"U{d}"][:, : 2 * HIDDEN] += h.T @ da[:, : 2 * HIDDEN]
                grads[f"U{d}"][:, 2 * HIDDEN :] += (r * h).T @ dg
                grads[f"b{d}"] += da.sum(0)
                grads[f"W{d}"] += p["E"][x[t]].T @ da
                np.add.at(grads["E"], x[t], da @ p[f"W{d}"].T)
                dh = dh - step * z + drh * r + da[:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T
        return loss, grads

    def _states(self, x: np.ndarray, alive: list[int], d: str) -> np.ndarray:
        """As ``_run``, for columns in order of falling length: at step t the first
        alive[t] of them go on.  Gates are arrays of their own, so all is contiguous."""
        steps, n = x.shape
        gates = [slice(0, HIDDEN), slice(HIDDEN, 2 * HIDDEN), slice(2 * HIDDEN, None)]
        base = self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]
        tables = [np.ascontiguousarray(base[:, g], np.float32) for g in gates]
        weights = [np.ascontiguousarray(self.p[f"U{d}"][:, g], np.float32) for g in gates]
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        spare = np.empty((n, HIDDEN), np.float32)

        def squashed(state, gate, ch):
            y, size = state @ weights[gate], spare[: len(ch)]
            y += np.take(tables[gate], ch, axis=0, out=size, mode="clip")
            np.abs(y, out=size)
            size += 1.0
            y /= size
            return y

        for t in range(steps) if d == "f" else reversed(range(steps)):
            own, ch = h[: alive[t]], x[t, : alive[t]]
            z, r = squashed(own, 0, ch), squashed(own, 1, ch)
            z += 1.0
            r += 1.0
            z *= 0.5
            r *= 0.5
            r *= own
            g = squashed(r, 2, ch)
            g -= own
            g *= z
            own += g
            out[t, : alive[t]] = own
        return out

    def window_sums(self, raw: np.ndarray, begin: np.ndarray, first: np.ndarray, last: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sum of the label distributions of raw[first:last] for each window, which
        reads raw[begin:end] (len(begin), langs)."""
        out = np.zeros((len(begin), len(self.langs)))
        order = np.argsort(begin - end, kind="stable")
        for at in range(0, len(order), RUN_WINDOWS):
            some = order[at : at + RUN_WINDOWS]
            sizes = (end - begin)[some]
            spots = begin[some] + np.arange(sizes[0])[:, None]
            x = raw[np.minimum(spots, len(raw) - 1)].astype(np.intp)
            alive = np.searchsorted(-sizes, -np.arange(sizes[0])).tolist()
            scores = self.p["c"][:, None] + sum(self.p["V"][rows].T @ self._states(x, alive, d).reshape(-1, HIDDEN).T for d, rows in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))))
            scores -= scores.max(0)
            np.exp(scores, out=scores)
            core = (spots >= first[some]) & (spots < last[some])
            scores *= (core.ravel() / scores.sum(0)).astype(np.float32)
            out[some] = scores.reshape(-1, *x.shape).sum(1).T
        return out


def windows(offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, begin, first, last, end) of all windows of texts at offsets[i]:offsets[i + 1]."""
    sizes = np.diff(offsets)
    each = -(-sizes // CORE)
    text = np.repeat(np.arange(len(sizes)), each)
    number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    first = offsets[text] + number * CORE
    last = np.minimum(first + CORE, offsets[text + 1])
    return text, np.maximum(first - CONTEXT, offsets[text]), first, last, np.minimum(last + CONTEXT, offsets[text + 1])


def pack(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(T, N) bytes, 256 where a unit has ended, and the mask of real bytes."""
    longest = max(map(len, units))
    raw = np.frombuffer(b"".join(u.ljust(longest, b"\0") for u in units), np.uint8).reshape(len(units), longest)
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    mask = np.arange(longest)[None, :] < lengths[:, None]
    return np.where(mask, raw, 256).T.astype(np.int64), mask.T.astype(np.float32)


def train(sample: dict[str, list[bytes]], steps: int = STEPS, seed: int = 7) -> BiGru:
    """sample: texts by language.  Each step draws as many spans of every language."""
    langs = sorted(sample)
    net = BiGru.fresh(langs, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    each = max(1, SPANS_A_STEP // len(langs))
    for step in range(1, steps + 1):
        units, label = [], []
        # all languages in a step, or as many of them as it has spans
        drawn = range(len(langs)) if len(langs) <= SPANS_A_STEP else rng.choice(len(langs), SPANS_A_STEP, replace=False)
        for k in drawn:
            own = sample[langs[k]]
            for text in (own[i] for i in rng.integers(0, len(own), each)):
                at = rng.integers(0, max(1, len(text) - SPAN + 1))
                units.append(text[at : at + SPAN])
            label += [k] * each
        _, grads = net.loss_and_gradients(*pack(units), np.array(label))
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            np.clip(g, -1, 1, out=g)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def sample_texts(docs: DataFrame, lang_col: str = "lang", key_col: str = "doc_id") -> dict[str, list[bytes]]:
    """The bounded training sample: whole texts by language, equal rows once."""
    labelled = docs.where(F.col(lang_col).isNotNull() & (F.octet_length("text") > 0))
    named = labelled.select(F.col(lang_col).cast("string").alias("l"), F.xxhash64(key_col, "text", F.lit(11)).alias("h"), "text")
    counts = named.groupBy("l").count().collect()  # one number a label
    if not counts:
        return {}
    each = max(1, min(TRAIN_DOCS, TRAIN_ROWS // len(counts)))
    # a small language is taken whole, of others half as much again as is needed
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, max(1.5 * each, each + 20) / r["count"]))])
    draw = F.pmod(F.xxhash64("h"), F.lit(1 << 40)) / float(1 << 40)
    chosen = named.where(draw < rate[F.col("l")]).dropDuplicates(["l", "h"])
    out: dict[str, list[tuple[int, bytes]]] = {}
    for r in chosen.collect():
        out.setdefault(r["l"], []).append((r["h"], r["text"].encode()))
    return {k: [text for _, text in sorted(v)[:each]] for k, v in out.items()}


def predictor(net: BiGru | None):
    """A function from a list of texts to [language, score] Arrow arrays."""

    def predict(texts: list[str | None]) -> list[pa.Array]:
        langs: list[str] = ["und"] * len(texts)
        scores = [0.0] * len(texts)
        lettered = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
        if lettered:
            raws = [texts[i].encode() for i in lettered]
            raw = np.frombuffer(b"".join(raws), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
            text, *spots = windows(offsets)
            pooled = np.zeros((len(raws), len(net.langs)))
            np.add.at(pooled, text, net.window_sums(raw, *spots))
            pooled /= pooled.sum(1, keepdims=True)
            best = pooled.argmax(1)
            for i, b, row in zip(lettered, best, pooled):
                langs[i], scores[i] = net.langs[b], float(min(1.0, row[b]))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return predict


def identify(docs: DataFrame, net: BiGru | None, carry: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``carry`` columns plus lang_pred string, score double."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_text(docs, lambda: predictor(net), fields, text_col, carry)


def fit(docs: DataFrame, training: Column) -> BiGru | None:
    """Train on the rows for which ``training`` holds; None if none is labelled."""
    sample = sample_texts(docs.where(training))
    return train(sample) if sample else None
