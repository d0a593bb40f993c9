"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A forward and a backward GRU read the UTF-8 bytes of a window; at every position their states give the probabilities of
the languages, and a document's probability is the mean over all its positions. The network is trained by
backpropagation through time (Adam, cross-entropy at every position) on windows of labelled texts. Whole texts are
scored: they are cut into windows of `SPAN` bytes, each read from both ends, so that work is linear and memory bounded.

Training reads at most `SAMPLE` rows of a language and `MOST_SAMPLE` in all (but `LEAST_SAMPLE` of each language, if it
has them), drawn by a hash of the id from all labelled rows that `learn` allows. Every language that occurs is learned;
what is not drawn doesn't matter for anything else. The same rows give the same model.

Null text and text without a letter are `und` with score 0. With one language learned, all other text is that language;
with none, everything is `und` with score 0. Repeated rows get repeated results. An empty table gives no rows. Columns
that aren't named are not read by predict() and kept by known().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, fresh, small_table

#: States of each direction; bytes of a window when scoring; bytes and rows a language when training; steps.
HIDDEN, SPAN, TRAIN_SPAN, SAMPLE, STEPS, BATCH = 8, 128, 64, 4000, 1200, 192
#: Labelled rows to learn from, of all languages together, and of each one even so.
MOST_SAMPLE, LEAST_SAMPLE = 100_000, 16
#: Windows scored side by side (fewer with many languages), and bytes of text gathered before scoring.
SIDE, GATHER = 2048, 8 << 20
UNKNOWN = "und"


class BiGru:
    """Weights of both directions and of the output; float32."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng, self.languages, self.hidden = np.random.default_rng(seed), languages, hidden
        k = len(languages)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {f"{n}{d}": x for d in "fb" for n, x in (("E", draw(256, 3 * hidden)), ("U", draw(hidden, 3 * hidden)), ("c", np.zeros(hidden, np.float32)))}
        self.p |= {"W": draw(2 * hidden, k), "b": np.zeros(k, np.float32)}

    def states(self, x: np.ndarray, d: str, keep: bool = False, real: np.ndarray | None = None):
        """x: (steps, rows) bytes in reading order. States (steps, rows, hidden) after each byte, and what training needs.

        Where `real` (steps, rows) is false there is no byte, and the state stays at its start.
        """
        H, (T, B) = self.hidden, x.shape
        E, U, c = self.p[f"E{d}"], self.p[f"U{d}"], self.p[f"c{d}"]
        half = np.concatenate([np.full(2 * H, 0.5, np.float32), np.ones(H, np.float32)])
        E, U = E * half, U * half  # a gate is (1 + tanh(x / 2)) / 2
        out, h, kept = np.empty((T, B, H), np.float32), np.zeros((B, H), np.float32), []
        g, u, gate = np.empty((B, 3 * H), np.float32), np.empty((B, 3 * H), np.float32), np.empty((B, 2 * H), np.float32)
        for t in range(T):
            np.take(E, x[t], axis=0, out=g, mode="clip")
            np.matmul(h, U, out=u)
            np.add(g[:, : 2 * H], u[:, : 2 * H], out=gate)
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            z, r, m = gate[:, :H], gate[:, H:], u[:, 2 * H :]
            m += c
            n = out[t]
            np.multiply(r, m, out=n)
            n += g[:, 2 * H :]
            np.tanh(n, out=n)
            if keep:
                kept.append((h, z.copy(), r.copy(), m.copy(), n.copy()))
            h = h - n
            h *= z
            h += n  # n + z (h - n)
            if real is not None:
                h *= real[t][:, None]
            out[t] = h
        return (out, kept) if keep else out

    def back(self, x: np.ndarray, d: str, kept: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of one direction from those of its states (steps, rows, hidden)."""
        H, U = self.hidden, self.p[f"U{d}"]
        dE, dU, dc = np.zeros_like(self.p[f"E{d}"]), np.zeros_like(U), np.zeros(H, np.float32)
        dh = np.zeros(grad.shape[1:], np.float32)
        every = np.empty((*grad.shape[:2], 3 * H), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, m, n = kept[t]
            dh = dh + grad[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            every[t] = np.concatenate([dz, dr, dn], axis=1)
            dU += h.T @ du
            dc += (dn * r).sum(0)
            dh = dh * z + du @ U.T
        np.add.at(dE, x.ravel(), every.reshape(-1, 3 * H))
        return {f"E{d}": dE, f"U{d}": dU, f"c{d}": dc}

    def positions(self, x: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
        """(steps, rows, languages): the probabilities at every position of windows x (steps, rows)."""
        both = self.states(x, "f") @ self.p["W"][: self.hidden]
        both += self.states(x[::-1], "b", real=None if real is None else real[::-1])[::-1] @ self.p["W"][self.hidden :]
        both += self.p["b"]
        np.exp(both, out=both)
        both /= both.sum(2, keepdims=True)
        return both

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 2) -> BiGru:
        """windows: (rows, bytes); labels: language numbers."""
        rng, k = np.random.default_rng(seed), len(self.languages)
        m, v = ({n: np.zeros_like(x) for n, x in self.p.items()} for _ in "mv")
        by = [np.flatnonzero(labels == i) for i in range(k)]
        for step in range(1, steps + 1):
            some = by if k <= batch else [by[i] for i in rng.choice(k, batch, replace=False)]
            rows = np.concatenate([rng.choice(i, max(1, batch // k)) for i in some if len(i)])
            x, y = windows[rows].T, labels[rows]
            sf, kf = self.states(x, "f", keep=True)
            sb, kb = self.states(x[::-1], "b", keep=True)
            both = np.concatenate([sf, sb[::-1]], axis=2)
            logits = both @ self.p["W"] + self.p["b"]
            p = np.exp(logits - logits.max(2, keepdims=True))
            p /= p.sum(2, keepdims=True)
            p[:, np.arange(len(y)), y] -= 1
            p /= p.shape[0] * p.shape[1]
            dboth = p @ self.p["W"].T
            grads = self.back(x, "f", kf, dboth[:, :, : self.hidden]) | self.back(x[::-1], "b", kb, np.ascontiguousarray(dboth[::-1, :, self.hidden :]))
            grads |= {"W": both.reshape(-1, both.shape[2]).T @ p.reshape(-1, k), "b": p.sum((0, 1))}
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for n, g in grads.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m[n] = 0.9 * m[n] + 0.1 * g
                v[n] = 0.999 * v[n] + 0.001 * g * g
                self.p[n] -= now * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): mean probabilities over all positions of each non-empty text."""
        sizes = np.array([len(t) for t in texts])
        count = -(-sizes // SPAN)
        windows = np.zeros((int(count.sum()), SPAN), np.uint8)
        flat, starts = windows.reshape(-1), np.concatenate([[0], np.cumsum(count)])
        for t, s in zip(texts, starts.tolist()):
            flat[s * SPAN : s * SPAN + len(t)] = np.frombuffer(t, np.uint8)
        last = starts[1:] - 1
        filled = np.full(len(windows), SPAN)
        filled[last] = sizes - (count - 1) * SPAN
        total = np.empty((len(windows), len(self.languages)), np.float64)
        order = np.argsort(filled, kind="stable")  # windows of like length side by side
        side = max(1, SIDE * 4 // max(4, len(self.languages)))
        for a in range(0, len(order), side):
            rows = order[a : a + side]
            n = int(filled[rows[-1]])
            real = None if filled[rows[0]] == n else np.arange(n)[:, None] < filled[rows][None, :]
            p = self.positions(np.ascontiguousarray(windows[rows, :n].T), real)
            if real is not None:
                p *= real[:, :, None]
            total[rows] = p.sum(0)
        return np.add.reduceat(total, starts[:-1], axis=0) / sizes[:, None]


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, steps: int = STEPS) -> BiGru | None:
    """A model of the labels of the rows where `learn` holds; None if there are none.

    The draw takes each language's rows by a hash of the id, in the share that gives `sample` of them; the driver gets
    4 * TRAIN_SPAN bytes of each, from a place that the hash says.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("lang")).filter(learn).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return None
    languages = sorted(counts)
    sample = min(sample, max(LEAST_SAMPLE, MOST_SAMPLE // len(counts)))
    mixed = F.xxhash64(F.col("id"), F.lit(7))
    shares = small_table(df.sparkSession, [(lang, int(min(1.0, 1.1 * sample / n) * (1 << 20)) + 1) for lang, n in counts.items()], [("_lang", df.schema[label_col].dataType.simpleString()), ("_share", "int")])
    drawn = rows.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).filter(F.pmod(mixed, F.lit(1 << 20)) < F.col("_share"))  # a row a language
    wide = 4 * TRAIN_SPAN
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.greatest(F.lit(1), F.length("text") - wide + 1)).cast("int") + 1
    got = drawn.select(mixed.alias("mixed"), "lang", F.substring(F.col("text"), place, F.lit(wide)).alias("part")).orderBy("mixed", "lang", "part").limit(int(1.3 * sample * len(counts)) + 50 * len(counts)).collect()
    windows, labels, taken = [], [], dict.fromkeys(languages, 0)
    for r in got:
        if taken[r["lang"]] < sample:
            taken[r["lang"]] += 1
            raw = r["part"].encode()
            for a in range(0, max(1, len(raw) - TRAIN_SPAN + 1), TRAIN_SPAN):
                part = raw[a : a + TRAIN_SPAN]
                windows.append(np.frombuffer((part * (TRAIN_SPAN // max(1, len(part)) + 1))[:TRAIN_SPAN] if part else b" " * TRAIN_SPAN, np.uint8))
                labels.append(languages.index(r["lang"]))
    model = BiGru(languages)
    return model.train(np.stack(windows), np.array(labels), steps=steps) if len(languages) > 1 else model


def judge(model: BiGru | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text; null stands for what has no letter."""
    names = np.array([*(model.languages if model else []), UNKNOWN], object)
    best, top = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
    real = [i for i, t in enumerate(texts) if t] if model else []
    while real:
        size, n = 0, 0
        while n < len(real) and size < GATHER:
            size += len(texts[real[n]])
            n += 1
        p = model.score([texts[i].encode() for i in real[:n]])
        best[real[:n]], top[real[:n]] = p.argmax(1), p.max(1)
        real = real[n:]
    return names[best], np.minimum(top, 1.0)


def said(text_col: str) -> Column:
    """The text if it has a letter, else null."""
    return F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))


def predict(df: DataFrame, model: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = judge(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return df.select(F.col(id_col).alias("doc_id"), said(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def known(df: DataFrame, model: BiGru | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of `df` whose text has a language with a score of at least `least`; all columns as they were.

    Without a model nothing can be said against a language: every text with a letter stays.
    """
    bounded_batches(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model:
                lang, score = judge(model, batch.column(len(names)).to_pylist())
                keep = pa.array((lang != UNKNOWN) & (score >= least), pa.bool_())
            else:
                keep = batch.column(len(names)).is_valid()
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[: len(names)]], names)

    return df.select(*[F.col(f"`{c}`") for c in names], said(text_col).alias(fresh(df, "_said"))).mapInArrow(run, df.schema)
