"""Language ID with a byte convolutional network trained in numpy."""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_text

#: The sample that the network is fitted on: so many documents at most, an equal share of every language, and so many windows of each.
FIT_DOCS, FIT_WINDOWS = 3000, 4
#: Bytes in a window, numbers per byte, filter widths and filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 96, 8, (2, 3, 4, 5), 12
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.01, 11
_LETTER = regex.compile(r"\p{L}")


def windows(text: bytes) -> np.ndarray:
    """All consecutive windows of the text, in lower case; the last is filled up with zeros."""
    data = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-8"), np.uint8)
    whole = np.zeros((max(1, -(-len(data) // WINDOW)), WINDOW), np.uint8)
    whole.ravel()[: len(data)] = data
    return whole


class ByteConvNet:
    """Byte embedding, filters of several widths, max pooling over the window, softmax."""

    def __init__(self, classes: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.3, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes))
        self.p["bias"] = np.zeros(classes)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
        e = self.p["embed"][x]
        n, length, _ = e.shape
        pooled, kept = [], []
        for w in WIDTHS:
            span = np.concatenate([e[:, i : length - w + 1 + i] for i in range(w)], axis=2)
            y = span.reshape(-1, w * EMBED) @ self.p[f"w{w}"]
            y = y.reshape(n, length - w + 1, FILTERS)
            at = y.argmax(axis=1)
            top = np.take_along_axis(y, at[:, None], 1)[:, 0] + self.p[f"b{w}"]
            pooled.append(np.maximum(top, 0))
            kept.append((at, top > 0))
        return np.concatenate(pooled, axis=1), kept, e

    def log_softmax(self, x: np.ndarray) -> np.ndarray:
        z = self._pooled(x)[0] @ self.p["out"] + self.p["bias"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray) -> ByteConvNet:
        rng = np.random.default_rng(SEED)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                step += 1
                for k, g in self._gradients(x[rows], y[rows]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.p[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pooled, kept, e = self._pooled(x)
        z = pooled @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z /= len(y)
        grads = {"out": pooled.T @ z, "bias": z.sum(axis=0)}
        back = z @ self.p["out"].T
        to_embed = np.zeros((256, EMBED), np.float32)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            at, on = kept[i]
            d = back[:, i * FILTERS : (i + 1) * FILTERS] * on
            grads[f"b{w}"] = d.sum(axis=0)
            places = at[:, :, None] + np.arange(w)  # the bytes that each filter's maximum came from
            span = e[rows[:, :, None], places].reshape(len(x), FILTERS, w * EMBED)
            grads[f"w{w}"] = np.einsum("nf,nfk->kf", d, span)
            share = (d[:, :, None] * self.p[f"w{w}"].T).reshape(-1, EMBED)
            np.add.at(to_embed, x[rows[:, :, None], places].reshape(-1), share)
        grads["embed"] = to_embed
        return grads


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame) -> DataFrame:
    """(lang, draw, part): bytes from within the first documents of each language in the order of a hash, outside the held-out fold.

    Each language's share of FIT_DOCS is bounded by the hash before anything is
    ordered, and texts are cut to FIT_WINDOWS windows there, so what is ordered
    and sent on does not grow with the corpus.
    """
    labelled = docs.where(~_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.select("lang", "text", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("draw"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(FIT_DOCS + 1).collect()}
    if len(counts) > FIT_DOCS:
        raise ValueError(f"more languages than FIT_DOCS, {FIT_DOCS}: every language needs a document to be learned from")
    each = FIT_DOCS // max(1, len(counts))
    # a few more than needed pass with near certainty; the rank settles how many
    least = [(lang, -(1 << 63) + int(min((1 << 64) - 1, (each + 6 * each**0.5 + 10) / n * 2**64))) for lang, n in counts.items()]
    limits = F.broadcast(docs.sparkSession.createDataFrame(least, "lang string, top long"))  # FIT_DOCS rows at most
    part = WINDOW * FIT_WINDOWS
    begin = F.floor((F.length("text") - part) * F.pmod("draw", F.lit(97)) / 97)
    cut = F.substring(F.col("text"), F.greatest(F.lit(1), begin).cast("int"), F.lit(part)).alias("part")
    few = labelled.join(limits, "lang").where(F.col("draw") <= F.col("top")).select("lang", "draw", cut)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    return few.withColumn("rank", rank).where(F.col("rank") <= each).drop("rank")


def fit(docs: DataFrame) -> tuple[ByteConvNet | None, list[str]]:
    """The network and its languages, from sample(); without labelled text there is no network."""
    rows = sorted(sample(docs).collect(), key=lambda r: (r.lang, r.draw))
    rows = [r for r in rows if _LETTER.search(r.part)]
    names = sorted({r.lang for r in rows})
    if not names:
        return None, []
    x, y = [], []
    for r in rows:
        some = windows(r.part.encode("utf-8", "replace"))[:FIT_WINDOWS]
        x.append(some)
        y += [names.index(r.lang)] * len(some)
    return ByteConvNet(len(names)).fit(np.concatenate(x), np.array(y)), names


def predict_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row.

    The network sees every window of the whole text; the mean of the windows'
    log probabilities decides and, as a softmax, gives the score. Null text and
    text without a letter is `und` with score 0, as is everything if no labelled
    document exists. Nulls in lang only shrink the sample; a null doc_id is not
    held out; repeated rows get equal results; very long texts are worked off
    in pieces of 1,024 windows; an empty table gives none; other columns are not
    read, whatever their names. More languages than FIT_DOCS raise an error.
    """
    net, names = fit(docs)

    def measure(text: bytes) -> tuple[str, float]:
        if net is None or not _LETTER.search(text.decode("utf-8", "replace")):
            return "und", 0.0
        x = windows(text)
        total = np.zeros(len(names))
        for at in range(0, len(x), 1024):
            total += net.log_softmax(x[at : at + 1024]).sum(axis=0, dtype=np.float64)
        p = np.exp((total - total.max()) / len(x))
        p /= p.sum()
        best = int(p.argmax())
        return names[best], float(p[best])

    rows = docs.select("doc_id", _held_out().alias("held_out"), "text")
    return per_text(rows, ["doc_id", "held_out"], {"lang_pred": "string", "score": "double"}, measure)
