"""Language identification by a byte convolutional network trained in numpy.

A window is ``width`` bytes of the lower-cased (ASCII) UTF-8 text, the last of a text padded with zeros. Bytes are
embedded, filters of 2, 3 and 4 bytes run over the window, each filter's maximum goes through a ReLU to a softmax over
the languages. A whole text is cut into windows; its languages' probabilities are those of its windows, weighted by
their bytes. For prediction the filters over embedded bytes are held as two tables by byte pair, so a position
costs two look-ups; the result is the same.

Training takes about ``docs_per_lang`` labelled texts of each language, fewer if there are so many languages that all come to over ``fit_docs``, chosen by
a hash of text and language, equal texts once, and ``windows_per_doc`` windows of each: that bounds what the driver holds. Every language in the labels is learned.
Null text or lang is not learned from.

Predictions: text null or without a letter, or nothing learned: ``und`` with score 0. Equal probabilities: the first language by name. Result
columns replace columns of their names; all rows stay. Very long texts are read window by window, whole. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

SIZES = (2, 3, 4)
UNKNOWN = "und"


@dataclass
class ByteCNN:
    langs: list[str]
    embed: np.ndarray  # 256 x d
    filters: np.ndarray  # 4 d x f, zero beyond a filter's size
    bias: np.ndarray  # f
    out: np.ndarray  # f x n
    out_bias: np.ndarray  # n
    width: int

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the filters' answers to bytes 0 and 1, and 2 and 3, by pair."""
        d = self.embed.shape[1]
        per = [self.embed @ self.filters[i * d : (i + 1) * d] for i in range(4)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
        return pair(per[0], per[1]), pair(per[2], per[3])

    def predictor(self, rows: int = 128):
        """A function from (n, width) bytes to (n, languages) probabilities."""
        first, second = self.tables()
        n_pos, f = self.width - 3, len(self.bias)
        a, b = np.empty((rows * n_pos, f), np.float32), np.empty((rows * n_pos, f), np.float32)

        def predict(windows: np.ndarray) -> np.ndarray:
            pooled = np.empty((len(windows), f), np.float32)
            for i in range(0, len(windows), rows):
                w = windows[i : i + rows].astype(np.intp)
                pairs = w[:, :-1] * 256 + w[:, 1:]
                n = len(w) * n_pos
                np.take(first, pairs[:, :-2].reshape(-1), axis=0, out=a[:n], mode="clip")
                np.take(second, pairs[:, 2:].reshape(-1), axis=0, out=b[:n], mode="clip")
                np.add(a[:n], b[:n], out=a[:n])
                a[:n].reshape(len(w), n_pos, f).max(axis=1, out=pooled[i : i + rows])
            return softmax(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)

        return predict


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(text: bytes, width: int) -> bytes:
    """The text's windows, one after another; one window at least."""
    return text.lower().ljust(max(1, -(-len(text) // width)) * width, b"\0")


def train(windows: list[bytes], langs: list[str], width: int = 256, d: int = 8, per_size: int = 8, epochs: int = 5, least_steps: int = 800, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
    """Fit by Adam on cross-entropy; half of the windows are shortened at random, as short texts are. Few windows are gone over more often."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    x = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in windows), np.uint8).reshape(-1, width)
    f, n = per_size * len(SIZES), len(names)
    size = np.repeat(SIZES, per_size)
    mask = np.repeat(np.arange(4)[:, None] < size[None, :], d, axis=0)
    p = {
        "embed": rng.normal(0, 0.5, (256, d)), "filters": rng.normal(0, 0.3, (4 * d, f)) * mask, "bias": np.zeros(f),
        "out": rng.normal(0, 0.2, (f, n)), "out_bias": np.zeros(n),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mean, var, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(max(epochs, least_steps * batch // len(x))):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            own = order[at : at + batch]
            xb, yb = x[own].copy(), y[own]
            short = rng.random(len(own)) < 0.5
            stop = np.where(short, np.exp(rng.uniform(np.log(4), np.log(width), len(own))).astype(int), width)  # short ones as often as long ones
            xb[np.arange(width)[None, :] >= stop[:, None]] = 0
            e = p["embed"][xb]
            patches = np.lib.stride_tricks.sliding_window_view(e, 4, axis=1).transpose(0, 1, 3, 2).reshape(len(own), width - 3, 4 * d)
            conv = patches @ p["filters"]
            best = conv.argmax(axis=1)
            pooled = np.take_along_axis(conv, best[:, None, :], axis=1)[:, 0] + p["bias"]
            act = np.maximum(pooled, 0)
            prob = softmax(act @ p["out"] + p["out_bias"])
            dz = prob
            dz[np.arange(len(own)), yb] -= 1
            dz /= len(own)
            da = (dz @ p["out"].T) * (pooled > 0)
            won = patches[np.arange(len(own))[:, None], best]  # batch x f x 4d
            de = np.einsum("bf,kf->bfk", da, p["filters"]).reshape(-1, 4, d)
            spots = xb[np.arange(len(own))[:, None, None], best[:, :, None] + np.arange(4)]
            dembed = np.zeros_like(p["embed"])
            np.add.at(dembed, spots.reshape(-1), de.reshape(-1, d))
            grads = {"embed": dembed, "filters": np.einsum("bf,bfk->kf", da, won) * mask, "bias": da.sum(0), "out": act.T @ dz, "out_bias": dz.sum(0)}
            step += 1
            for k, g in grads.items():
                mean[k] += 0.1 * (g - mean[k])
                var[k] += 0.001 * (g * g - var[k])
                p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteCNN(names, p["embed"], p["filters"], p["bias"], p["out"], p["out_bias"], width)


def fit_language_id(labelled: DataFrame, docs_per_lang: int = 600, windows_per_doc: int = 3, fit_docs: int = 120_000, width: int = 256) -> ByteCNN | None:
    """The network of the rows (text, lang) of labelled; None where there is nothing to learn."""
    bounded_batches(labelled.sparkSession)
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = known.groupBy("lang").count()
    langs = counts.count()
    if not langs:
        return None
    beside = F.broadcast if langs <= 100_000 else lambda df: df
    share = F.least(F.lit(1.0), F.lit(min(docs_per_lang, max(1, fit_docs // langs))) / F.col("count")) * float(1 << 62)
    drawn = known.withColumn("h", F.xxhash64(F.lit(17), "lang", "text")).join(beside(counts.select("lang", share.alias("share"))), "lang")
    some = drawn.where(F.pmod("h", F.lit(1 << 62)) < F.col("share")).dropDuplicates(["h"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, out = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = -(-len(text) // width)
                for i in range(min(n, windows_per_doc)):
                    s = i * n // min(n, windows_per_doc) * width
                    langs.append(lang)
                    out.append(text[s : s + width].lower())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "bytes"])

    rows = some.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(work, "lang string, bytes binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.bytes)))
    return train([bytes(r.bytes) for r in rows], [r.lang for r in rows], width) if rows else None


def identify(docs: DataFrame, model: ByteCNN | None, block_bytes: int = 1 << 20) -> DataFrame:
    """docs with lang_pred string and score double."""
    bounded_batches(docs.sparkSession)
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "__text")])
    names = [*kept.columns, "lang_pred", "score"]
    rows = kept.withColumn("__text", F.col("text").cast("binary"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["lang_pred string", "score double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        predict = model.predictor() if model else None
        for b in batches:
            texts = b.column(b.num_columns - 1)
            langs: list[str] = [UNKNOWN] * len(texts)
            scores = [0.0] * len(texts)
            held: list[tuple[int, int, bytes]] = []
            size = 0

            def flush() -> None:
                probs = predict(np.frombuffer(b"".join(h[2] for h in held), np.uint8).reshape(-1, model.width))
                at = 0
                for i, n, padded in held:
                    k = len(padded) // model.width
                    share = np.full(k, float(model.width))
                    share[-1] = n - (k - 1) * model.width
                    p = share @ probs[at : at + k].astype(np.float64) / n
                    best = int(p.argmax())
                    langs[i], scores[i] = model.langs[best], float(min(1.0, p[best]))
                    at += k
                held.clear()

            for i, t in enumerate(texts):
                raw = t.as_py()
                if not model or not raw or not letter(raw.decode("utf-8", "replace")):
                    continue
                held.append((i, len(raw), cut(raw, model.width)))
                size += len(raw)
                if size >= block_bytes:
                    flush()
                    size = 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return rows.mapInArrow(work, schema)


def filter_language(docs: DataFrame, model: ByteCNN | None, least_score: float = 0.5) -> DataFrame:
    """docs whose language is known with at least least_score; columns are those of docs."""
    packed = docs.withColumn("__row", F.struct("*")).select("__row", "text")
    return identify(packed, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("__row.*")
