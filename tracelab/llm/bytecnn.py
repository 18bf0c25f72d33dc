"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.llm.common import plain_text, shipped, small_batches

shipped(__name__)

WIDTH = 8  # bytes that a filter sees
HALF = 128  # a chunk is two neighbouring halves; chunks overlap by one half
DEPTH, FILTERS, HIDDEN = 4, 32, 16
SEGMENT = 1 << 16  # bytes that are convolved at once, whatever the length of the text
SAMPLE_ROWS = 2500  # labelled rows that the network is fitted on, at most
SAMPLE_BYTES = 24 << 20  # bytes of their whole texts, at most
EPOCHS, BATCH, RATE = 10, 64, 0.01


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def initial(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": draw(256, DEPTH, scale=1.0),
        "filters": draw(WIDTH * DEPTH, FILTERS, scale=(WIDTH * DEPTH) ** -0.5),
        "bias": np.zeros(FILTERS, np.float32),
        "mix": draw(FILTERS, HIDDEN, scale=FILTERS**-0.5),
        "mix_bias": np.zeros(HIDDEN, np.float32),
        "top": draw(HIDDEN, scale=HIDDEN**-0.5),
        "low": draw(HIDDEN, scale=HIDDEN**-0.5),
        "top_bias": np.zeros(1, np.float32),
    }


def padded(text: bytes) -> np.ndarray:
    """Bytes with at least WIDTH - 1 zeros behind them, in whole halves, two at least."""
    halves = max(2, -(-(len(text) + WIDTH - 1) // HALF))
    out = np.zeros(halves * HALF, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def _windows(net: dict, data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Embedded bytes under every filter position in [start, stop)."""
    need = stop - start + WIDTH - 1
    own = data[start : start + need]
    if len(own) < need:
        own = np.concatenate([own, np.zeros(need - len(own), np.uint8)])
    embedded = net["embed"][own].ravel()
    return np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * DEPTH)[::DEPTH]


def half_maxima(net: dict, data: np.ndarray, where: bool = False):
    """Largest response of every filter in each half, and, if asked, at which byte."""
    best, at = [], []
    for start in range(0, len(data), SEGMENT):
        stop = min(len(data), start + SEGMENT)
        response = (np.ascontiguousarray(_windows(net, data, start, stop)) @ net["filters"]).reshape(-1, HALF, FILTERS)
        best.append(response.max(axis=1))
        if where:
            place = response.argmax(axis=1)
            at.append(place + start + HALF * np.arange(len(place))[:, None])
    return (np.concatenate(best), np.concatenate(at)) if where else np.concatenate(best)


def chunk_features(net: dict, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled responses of each chunk, rectified, and the chunk's hidden units."""
    pooled = np.maximum(np.maximum(halves[:-1], halves[1:]) + net["bias"], 0)
    return pooled, np.tanh(pooled @ net["mix"] + net["mix_bias"])


def probability(net: dict, text: bytes) -> float:
    """Probability of label 1 of a whole text: hidden units are max-pooled over all chunks, both ends count."""
    _, hidden = chunk_features(net, half_maxima(net, padded(text)))
    z = hidden.max(axis=0) @ net["top"] + hidden.min(axis=0) @ net["low"] + net["top_bias"][0]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _gradient(net: dict, data: np.ndarray, label: int, weight: float, grad: dict) -> None:
    halves, place = half_maxima(net, data, where=True)
    pooled, hidden = chunk_features(net, halves)
    i, j, units = hidden.argmax(axis=0), hidden.argmin(axis=0), np.arange(HIDDEN)
    high, low = hidden[i, units], hidden[j, units]
    p = 1 / (1 + np.exp(-np.clip(high @ net["top"] + low @ net["low"] + net["top_bias"][0], -30, 30)))
    d = np.float32(weight * (p - label))
    grad["top"] += d * high
    grad["low"] += d * low
    grad["top_bias"] += d
    for chunk, value, out in ((i, high, net["top"]), (j, low, net["low"])):
        du = d * out * (1 - value**2)  # one chunk carries the gradient of each hidden unit
        grad["mix"] += pooled[chunk].T * du
        grad["mix_bias"] += du
        dp = net["mix"].T * du[:, None] * (pooled[chunk] > 0)
        grad["bias"] += dp.sum(axis=0)
        later = halves[chunk] < halves[chunk + 1]
        at = np.where(later, place[chunk + 1], place[chunk])
        codes = data[np.minimum(at[..., None] + np.arange(WIDTH), len(data) - 1)]
        inputs = net["embed"][codes].reshape(HIDDEN, FILTERS, WIDTH * DEPTH)
        grad["filters"] += np.einsum("hf,hfw->wf", dp, inputs)
        back = (net["filters"].T[None] * dp[..., None]).reshape(-1, DEPTH)
        for k in range(DEPTH):
            grad["embed"][:, k] += np.bincount(codes.ravel(), weights=back[:, k], minlength=256).astype(np.float32)


def fit(texts: list[bytes], labels: list[int], seed: int = 3) -> dict[str, np.ndarray]:
    """Adam on the cross-entropy; both labels weigh the same in sum, then the bias is moved back to the true share."""
    net = initial(seed)
    if not texts or len(set(labels)) < 2:
        net["top"][:] = 0
        net["low"][:] = 0
        share = (sum(labels) + 1) / (len(labels) + 2)
        net["top_bias"][:] = np.log(share / (1 - share))
        return net
    data = [padded(t) for t in texts]
    weights = {q: len(labels) / (2 * labels.count(q)) for q in (0, 1)}
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    rng, step = np.random.default_rng(seed), 0
    total = EPOCHS * -(-len(data) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            grad = {k: np.zeros_like(v) for k, v in net.items()}
            part = order[at : at + BATCH]
            for k in part:
                _gradient(net, data[k], labels[k], weights[labels[k]] / len(part), grad)
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for k in net:
                first[k] += 0.1 * (grad[k] - first[k])
                second[k] += 0.01 * (grad[k] ** 2 - second[k])
                net[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return net


def learn(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Fit on at most SAMPLE_ROWS labelled rows outside the held-out part, the first ones by hash of the id.

    Rows without id, label or a quality of 0 or 1 are left out. The texts are whole. Rows are taken in that order up to SAMPLE_BYTES in sum (a text
    that alone takes a sixteenth of it is passed over), so the driver holds a bounded sample.
    """
    chosen = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
        .limit(SAMPLE_ROWS)
    )
    order = [F.xxhash64("doc_id", F.lit(12)), "doc_id", "text"]
    size = F.octet_length("text").cast("bigint")
    rows = (
        docs.select("doc_id", plain_text().alias("text"))
        .join(chosen, "doc_id")
        .where(size <= SAMPLE_BYTES // 16)
        .orderBy(*order)
        .limit(2 * SAMPLE_ROWS)  # ids are unique; repeated rows cannot outgrow the bound
        .withColumn("_sum", F.sum(size).over(Window.orderBy(*order)))
        .where(F.col("_sum") <= SAMPLE_BYTES)
        .orderBy("doc_id", "text")
        .collect()
    )
    return fit([r["text"].encode() for r in rows], [int(r["_quality"]) for r in rows])


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``.

    The score depends on the text's bytes alone. Null and empty texts are scored as a chunk of zeros; a null id counts as not
    held out and is scored like any other; repeated rows get equal scores. Without labels of both kinds every score is the
    smoothed share of label 1. Long texts are convolved in segments of SEGMENT bytes, so memory stays bounded.
    """
    small_batches(docs.sparkSession)
    net = learn(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([probability(net, (t or "").encode()) for t in texts], dtype="float64")

    scored = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.asNondeterministic()("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
