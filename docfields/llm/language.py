"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads runs of letters (lower-cased UTF-8 bytes, cut into windows of at most
``WINDOW`` bytes) in both directions and gives every byte position a distribution over
languages.  A document's distribution is the mean over all its positions.  Training is numpy
backpropagation through time on a bounded sample of labelled documents; everything else -
every document, its whole text - is scored in one map pass.  A run's answer depends on the run
alone, so equal runs are computed once in a worker process.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import per_process

LETTERS = re.compile(r"[^\W\d_]+")
WINDOW = 48


def runs_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L), in lower case."""
    found = LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [x for run in found for x in "".join(c if c.isalpha() else " " for c in run).split()]  # numbers that are no digits


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Direction:
    """One direction of the network: parameters, forward pass, backward pass."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.w = (rng.standard_normal((256, 3 * hidden)) * 0.2).astype(np.float32)
        self.u = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, np.float32)

    def forward(self, codes: np.ndarray, keep: bool = False):
        """States (time, batch, hidden) for codes (time, batch)."""
        h = np.zeros((codes.shape[1], len(self.u)), np.float32)
        n = len(self.u)
        states, saved = np.empty((*codes.shape, n), np.float32), []
        for t in range(len(codes)):
            x = self.w[codes[t]] + self.b
            g = h @ self.u
            zr = sigmoid(x[:, : 2 * n] + g[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(x[:, 2 * n :] + r * g[:, 2 * n :])
            if keep:
                saved.append((h, z, r, c, g[:, 2 * n :]))
            h = c + z * (h - c)
            states[t] = h
        return states, saved

    def backward(self, codes: np.ndarray, saved: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of (w, u, b), given those of the states: backpropagation through time."""
        n = len(self.u)
        dw, du, db = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        dh = np.zeros_like(grad[0])
        for t in range(len(codes) - 1, -1, -1):
            h, z, r, c, gc = saved[t]
            dh = dh + grad[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            dx = np.concatenate((dz, dr, dc), axis=1)
            dg = np.concatenate((dz, dr, dc * r), axis=1)
            np.add.at(dw, codes[t], dx)
            du += h.T @ dg
            db += dx.sum(axis=0)
            dh = dh * z + dg @ self.u.T
        return [dw, du, db]


class Network:
    def __init__(self, classes: int, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Direction(hidden, rng), Direction(hidden, rng)
        self.v = (rng.standard_normal((2 * hidden, classes)) * 0.1).astype(np.float32)
        self.c = np.zeros(classes, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.v, self.c]

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """(time, batch, class) for codes (time, batch) of runs of one length."""
        states = np.concatenate((self.ahead.forward(codes)[0], self.back.forward(codes[::-1])[0][::-1]), axis=2)
        logits = states @ self.v + self.c
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)

    def step(self, codes: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients."""
        a, kept_a = self.ahead.forward(codes, keep=True)
        b, kept_b = self.back.forward(codes[::-1], keep=True)
        states = np.concatenate((a, b[::-1]), axis=2)
        logits = states @ self.v + self.c
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        p = e / e.sum(axis=2, keepdims=True)
        at = np.arange(codes.shape[1])
        loss = float(-np.log(p[:, at, label] + 1e-9).mean())
        p[:, at, label] -= 1.0
        p /= codes.size
        flat = p.reshape(-1, p.shape[2])
        grad = p @ self.v.T
        n = a.shape[2]
        grads = self.ahead.backward(codes, kept_a, grad[:, :, :n]) + self.back.backward(codes[::-1], kept_b, grad[::-1, :, n:])
        return loss, [*grads, states.reshape(-1, 2 * n).T @ flat, flat.sum(axis=0)]


def windows(run: str) -> list[bytes]:
    raw = run.encode()
    return [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]


def train(samples: list[tuple[str, int]], classes: int, hidden: int = 16, steps: int = 1200, batch: int = 256, seed: int = 5) -> Network:
    """A network fitted to (run, class) samples by Adam; every batch holds runs of one length."""
    rng, net = np.random.default_rng(seed), Network(classes, hidden, seed)
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for run, k in samples:
        for piece in windows(run):
            by_length.setdefault(len(piece), []).append((piece, k))
    groups = []
    for length, rows in sorted(by_length.items()):
        codes = np.frombuffer(b"".join(r for r, _ in rows), np.uint8).reshape(len(rows), length)
        groups.append((codes, np.array([k for _, k in rows])))
    share = np.array([codes.size for codes, _ in groups], dtype=float)
    share /= share.sum()
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for t in range(1, steps + 1):
        codes, label = groups[rng.choice(len(groups), p=share)]
        pick = rng.integers(0, len(label), batch)
        _, grads = net.step(np.ascontiguousarray(codes[pick].T), label[pick])
        rate = 0.02 * min(1.0, t / 50) * (1 - t / (steps + 1)) + 1e-4
        for p, g, m, s in zip(net.parameters(), grads, first, second):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return net


class Scorer:
    """Summed class probabilities and number of positions of runs, remembered run by run."""

    def __init__(self, net: Network, most: int = 400_000):
        self.net, self.most = net, most
        self.classes = len(net.c)
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.sums, self.sizes = np.zeros((0, self.classes), np.float32), np.zeros(0, np.int64)

    def add(self, runs: list[str]) -> None:
        by_length: dict[int, list[tuple[bytes, int]]] = {}
        for i, run in enumerate(runs):
            for piece in windows(run):
                by_length.setdefault(len(piece), []).append((piece, i))
        sums, sizes = np.zeros((len(runs), self.classes), np.float32), np.zeros(len(runs), np.int64)
        for length, rows in by_length.items():
            codes = np.frombuffer(b"".join(r for r, _ in rows), np.uint8).reshape(len(rows), length)
            owner = np.array([i for _, i in rows])
            for lo in range(0, len(rows), 4096):
                p = self.net.probabilities(np.ascontiguousarray(codes[lo : lo + 4096].T)).sum(axis=0)
                np.add.at(sums, owner[lo : lo + 4096], p)
            np.add.at(sizes, owner, length)
        first = len(self.index)
        self.index.update(zip(runs, range(first, first + len(runs))))
        self.sums, self.sizes = np.concatenate((self.sums, sums)), np.concatenate((self.sizes, sizes))

    def __call__(self, texts: list[str | None]) -> list[tuple[int, float] | None]:
        """(class, probability) of every text; None where there is no letter.  A long list is scored in parts."""
        out: list[tuple[int, float] | None] = []
        lo = 0
        while lo < len(texts):
            hi, size, found = lo, 0, []
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") < 4_000_000):
                size += len(texts[hi] or "")
                found.append(runs_of(texts[hi]))
                hi += 1
            if len(self.index) > self.most:
                self.reset()
            self.add(list({r: None for runs in found for r in runs if r not in self.index}))
            for runs in found:
                if not runs:
                    out.append(None)
                    continue
                at, times = np.unique(np.fromiter(map(self.index.__getitem__, runs), np.int64, len(runs)), return_counts=True)
                total = (self.sums[at].astype(np.float64) * times[:, None]).sum(axis=0)
                best = int(total.argmax())
                out.append((best, float(min(1.0, total[best] / float((self.sizes[at] * times).sum())))))
            lo = hi
        return out


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of the id as text, modulo 5, is 0 (a null id counts as seen)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sizes(classes: int) -> dict[str, int]:
    """Hidden units and training steps, growing with the number of classes."""
    return {"hidden": max(16, classes // 2), "steps": max(1200, 60 * classes)}


def fit(docs: DataFrame, per_language: int = 300, runs_per_language: int = 30_000, seed: int = 5) -> tuple[Network | None, list[str]]:
    """A network from at most ``per_language`` documents of every language outside the held-out fold.

    The documents are drawn by hash of their id; at most ``runs_per_language`` runs of letters
    of theirs, drawn at random from their whole texts, are trained on.
    """
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    languages = [r["lang"] for r in usable.select("lang").distinct().collect()]
    languages.sort()
    if not languages:
        return None, []
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_language)
    ids = [(r["doc_id"], r["lang"]) for r in chosen.select("doc_id", "lang").collect()]  # bounded: per_language for each language
    side = docs.sparkSession.createDataFrame(ids, "doc_id long, lang string")
    texts = usable.join(F.broadcast(side), ["doc_id", "lang"]).select("doc_id", "lang", "text").collect()
    rng, samples = np.random.default_rng(seed), []
    for k, name in enumerate(languages):
        runs = [r for row in sorted((x for x in texts if x["lang"] == name), key=lambda x: (x["doc_id"], x["text"] or "")) for r in runs_of(row["text"])]
        if len(runs) > runs_per_language:
            runs = [runs[i] for i in np.sort(rng.choice(len(runs), runs_per_language, replace=False))]
        samples += [(r, k) for r in runs]
    return (train(samples, len(languages), **sizes(len(languages)), seed=seed), languages) if samples else (None, [])


def predict(docs: DataFrame, net: Network | None, languages: list[str]) -> DataFrame:
    """doc_id, held_out, lang_pred, score from the texts alone.

    Cases: a null text or one without letters is ``und`` with score 0; so is every text if
    nothing could be learned; a null doc_id stays null; repeated rows are scored as often as
    they occur; other columns are ignored; an empty table gives no rows.
    """
    tag = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        scorer = per_process("language scorer", lambda: Scorer(net), tag) if net is not None else None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            got = scorer(texts) if scorer else [None] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([languages[g[0]] if g else "und" for g in got], pa.string()),
                    pa.array([g[1] if g else 0.0 for g in got], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    net, languages = fit(docs)
    return predict(docs, net, languages)
