"""Secret scan: base patterns, and a character convolutional network in numpy over every candidate in its context."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import shipped, small_batches, staged

shipped(__name__)

KINDS = ["assign", "access", "hex", "model"]
#: Fixed patterns of the base.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")  # every base match holds such a run, and every candidate is one
BEFORE, AFTER = 24, 8  # characters of context on either side of a candidate
WIDTH, DEPTH, FILTERS = 5, 4, 24
SAMPLE_CANDIDATES = 20_000  # bound of what the network is fitted on, half of it for each label
FIT_CHARS = 4096  # length of a candidate and its context in that sample, at most; longer ones are scored and calibrated whole
SEGMENT = 1 << 14  # places of a candidate that are convolved at once
BIN, FURTHEST = 1 / 64, 64  # width of a bin of held-out logits, and where the last bins begin
RECALL = 0.98  # share of held-out findings that the threshold must keep
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 800, 64, 0.02


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Spans of the base patterns as (start, end, kind); ``runs`` are the text's matches of RUN."""
    if not runs:
        return []
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    for a, b in runs:  # a run of hex digits lies inside one run
        if b - a >= LEAST["hex"]:
            out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, a, b) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def touched(parts: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[bool]:
    """Which of ``parts`` meet a span, in one sweep; parts are apart and in order, spans in order of their starts."""
    out, at, furthest = [], 0, -1
    for a, b in parts:
        while at < len(spans) and spans[at][0] < b:
            furthest = max(furthest, spans[at][1])
            at += 1
        out.append(furthest > a)
    return out


def candidates(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs with a digit, or with capitals behind a small letter; plain words are none."""
    return [(a, b) for a, b in runs if re.search(r"[0-9]|[a-z][A-Z]", text[a:b])]


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a candidate and its context: ASCII as it is, other characters 127, plus 128 inside the candidate."""
    low = max(0, start - BEFORE)
    part = text[low : end + AFTER]
    codes = np.minimum(np.frombuffer(part.encode("utf-32-le"), np.uint32), 127).astype(np.uint8)
    codes[start - low : end - low] += 128
    return codes


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.standard_normal(shape) * scale
    return {
        "embed": draw(256, DEPTH, scale=1.0),
        "filters": draw(WIDTH * DEPTH, FILTERS, scale=(WIDTH * DEPTH) ** -0.5),
        "bias": np.zeros(FILTERS),
        "top": draw(FILTERS, scale=FILTERS**-0.5),
        "top_bias": np.zeros(1),
    }


def forward(net: dict, batch: list[np.ndarray]):
    """Logits of a batch; every candidate is convolved over its whole length and max-pooled."""
    lengths = np.array([len(c) + WIDTH - 1 for c in batch])
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.zeros(lengths.sum() + WIDTH, np.int64)
    for at, codes in zip(offsets, batch):
        flat[at : at + len(codes)] = codes
    taps = np.lib.stride_tricks.sliding_window_view(flat, WIDTH)[: lengths.sum()]
    response = np.maximum(net["embed"][taps].reshape(len(taps), -1) @ net["filters"] + net["bias"], 0)
    owner = np.repeat(np.arange(len(batch)), lengths)
    inside = np.arange(len(taps)) - offsets[owner] < (lengths - WIDTH + 1)[owner]  # a window starts at a character, not in the padding
    response[~inside] = 0
    pooled = np.maximum.reduceat(response, offsets, axis=0)
    return pooled @ net["top"] + net["top_bias"][0], pooled, response, taps, offsets, lengths


def fit(data: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on the cross-entropy with both labels at the same weight in sum."""
    net = initial(seed)
    weight = np.where(labels == 1, len(labels) / (2 * max(1, labels.sum())), len(labels) / (2 * max(1, (1 - labels).sum())))
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // -(-len(data) // BATCH)))):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            z, pooled, response, taps, offsets, lengths = forward(net, [data[i] for i in part])
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weight[part] / len(part)
            dp = d[:, None] * net["top"] * (pooled > 0)
            place = np.stack([response[o : o + n].argmax(axis=0) + o for o, n in zip(offsets, lengths)])
            codes = taps[place]  # candidate, filter, tap
            inputs = net["embed"][codes].reshape(len(part), FILTERS, WIDTH * DEPTH)
            back = (net["filters"].T[None] * dp[..., None]).reshape(-1, DEPTH)
            grad = {
                "top": d @ pooled,
                "top_bias": np.array([d.sum()]),
                "bias": dp.sum(axis=0),
                "filters": np.einsum("nf,nfw->wf", dp, inputs),
                "embed": np.stack([np.bincount(codes.ravel(), weights=back[:, k], minlength=256) for k in range(DEPTH)], axis=1),
            }
            step += 1
            for k in net:
                first[k] += 0.1 * (grad[k] - first[k])
                second[k] += 0.01 * (grad[k] ** 2 - second[k])
                net[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def logits(net: dict, data: list[np.ndarray]) -> np.ndarray:
    """Logits of candidates of any length: long ones are convolved in pieces of SEGMENT places, whose maxima are joined.

    A piece takes the WIDTH - 1 places behind it along, so its windows are those of the whole; only the last piece's run into padding.
    """
    best = np.zeros((len(data), FILTERS))
    pieces, starts, owners = [], [], []

    def flush() -> None:
        lengths = np.array([len(p) + WIDTH - 1 for p in pieces])
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.zeros(lengths.sum() + WIDTH, np.int64)
        for at, codes in zip(offsets, pieces):
            flat[at : at + len(codes)] = codes
        taps = np.lib.stride_tricks.sliding_window_view(flat, WIDTH)[: lengths.sum()]
        response = np.maximum(net["embed"][taps].reshape(len(taps), -1) @ net["filters"] + net["bias"], 0)
        response[np.arange(len(taps)) - np.repeat(offsets, lengths) >= np.repeat(np.array(starts), lengths)] = 0
        np.maximum.at(best, np.array(owners), np.maximum.reduceat(response, offsets, axis=0))
        pieces.clear(), starts.clear(), owners.clear()

    held = 0
    for i, codes in enumerate(data):
        for low in range(0, len(codes), SEGMENT):
            piece = codes[low : low + SEGMENT + WIDTH - 1]
            pieces.append(piece), starts.append(min(SEGMENT, len(codes) - low)), owners.append(i)
            held += len(piece)
            if held >= 4 * SEGMENT:
                flush()
                held = 0
    if pieces:
        flush()
    return best @ net["top"] + net["top_bias"][0] if data else np.zeros(0)


def calibrated(z: np.ndarray, labels: np.ndarray, count: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and offset of Platt's scaling, by a few damped Newton steps; every logit stands for ``count`` candidates."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, w = count * (p - labels), count * p * (1 - p)
        hessian = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(hessian, [(g * z).sum() + 1e-2 * (a - 1), g.sum() + 1e-2 * b])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


def labelled(docs: DataFrame) -> DataFrame:
    """Every different candidate of all documents with an id: ``context, start, end, label, h, held``; a third is held out, by hash."""

    def extract(batches):
        for batch in batches:
            out = []
            for text in batch["text"]:
                text = text or ""
                runs = [m.span() for m in RUN.finditer(text)]
                spans = base_spans(text, runs)
                parts = candidates(text, runs)
                for (a, b), found in zip(parts, touched(parts, spans)):
                    low = max(0, a - BEFORE)
                    out.append((text[low : b + AFTER], a - low, b - low, int(found)))
            yield pd.DataFrame(out, columns=["context", "start", "end", "label"])

    found = docs.where("doc_id is not null").select("text").mapInPandas(extract, "context string, start int, end int, label int")
    found = found.distinct().withColumn("h", F.xxhash64("context", F.lit(9)))
    return found.withColumn("held", F.pmod("h", F.lit(3)) == 0)


def threshold(p: np.ndarray, count: np.ndarray) -> float:
    """The largest of ``p`` that leaves RECALL of the findings at or above it; ``count`` findings have each."""
    order = np.argsort(p)
    return float(p[order][np.searchsorted(np.cumsum(count[order]), int((1 - RECALL) * count.sum()), side="right")])


def learn(docs: DataFrame) -> dict | None:
    """Fit on a sample of the labelled candidates of all documents; calibrate and choose the threshold on all that are held out.

    A candidate is a finding (label 1) if it meets a base span. A third of the candidates, by hash of their context, is held out. Of the
    others about SAMPLE_CANDIDATES / 2 of each label, by the same hash, fit the network, but for those over FIT_CHARS characters. Held-out logits reach the driver as
    counts per label and bin of BIN; they set Platt's scaling and the largest bin edge that still keeps RECALL of the findings.
    None where one label is missing in either part.
    """
    found = staged(labelled(docs), "candidates", "zstd")
    sizes = {(r["label"], r["held"]): r["count"] for r in found.groupBy("label", "held").count().collect()}
    if any(sizes.get((q, h), 0) < 3 for q in (0, 1) for h in (True, False)):
        return None
    # by a share of the hash range, so that no task ranks the candidates of all others
    least = {q: int(min(1.0, SAMPLE_CANDIDATES / 2 / sizes[q, False]) * (1 << 40)) for q in (0, 1)}
    picked = F.shiftrightunsigned("h", 24) < F.when(F.col("label") == 1, F.lit(least[1])).otherwise(F.lit(least[0]))
    rows = sorted(found.where(~F.col("held") & picked & (F.length("context") <= FIT_CHARS)).collect(), key=lambda r: (r["h"], r["context"], r["start"]))
    labels = np.array([r["label"] for r in rows])
    net = fit([encoded(r["context"], r["start"], r["end"]) for r in rows], labels)

    def score(batches):
        for batch in batches:
            z = logits(net, [encoded(t, a, b) for t, a, b in zip(batch["context"], batch["start"], batch["end"])])
            yield pd.DataFrame({"label": batch["label"], "bin": np.floor(np.clip(z, -FURTHEST, FURTHEST) / BIN).astype(np.int64)})

    scored = found.where("held").select("context", "start", "end", "label").mapInPandas(score, "label int, bin bigint")
    got = scored.groupBy("label", "bin").count().collect()
    label, low, count = (np.array([r[c] for r in got], float) for c in ("label", "bin", "count"))
    a, b = calibrated((low + 0.5) * BIN, label, count)
    # the edge of a bin that scores lower; beyond FURTHEST there is none
    edge = np.where(low * BIN <= -FURTHEST, -np.inf, low * BIN) if a >= 0 else np.where(low * BIN >= FURTHEST, np.inf, (low + 1) * BIN)
    with np.errstate(over="ignore"):
        p = 1 / (1 + np.exp(-(a * edge + b)))
    return {"net": net, "scale": a, "offset": b, "threshold": threshold(p[label == 1], count[label == 1])}


def spans_of(text: str | None, model: dict | None) -> list[tuple[int, int, str]]:
    """Base spans, and candidates apart from them that the network scores at the threshold or above."""
    text = text or ""
    runs = [m.span() for m in RUN.finditer(text)]
    spans = base_spans(text, runs)
    if model is None:
        return spans
    parts = candidates(text, runs)
    free = [part for part, found in zip(parts, touched(parts, spans)) if not found]
    if not free:
        return spans
    z = np.concatenate([logits(model["net"], [encoded(text, a, b) for a, b in free[i : i + 1024]]) for i in range(0, len(free), 1024)])
    p = 1 / (1 + np.exp(-(model["scale"] * z + model["offset"])))
    more = [(a, b, "model") for (a, b), x in zip(free, p) if x >= model["threshold"]]
    return sorted(spans + more, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, spans`` (array of start, end, kind; code points, end exclusive).

    Every whole text is scanned. Null and empty texts have no spans; a null ``doc_id`` is scanned but teaches nothing; repeated rows
    get equal spans. Without findings of both labels the base patterns stand alone.
    """
    small_batches(docs.sparkSession)
    model = learn(docs)

    @F.pandas_udf("array<struct<start: bigint, end: bigint, kind: string>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "kind": k} for s, e, k in spans_of(t, model)] for t in texts], dtype=object)

    return docs.select("doc_id", find.asNondeterministic()("text").alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    found = scan(docs.select("doc_id", "text")).withColumnRenamed("spans", "_spans")
    written = lambda keep: F.array_join(F.transform(F.filter("_spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(written(lambda s: s["kind"] != "model").cast("binary"), 256).alias("base_sha256"),
        written(lambda s: F.lit(True)).alias("spans"),
    )


def base_digest(text: str | None) -> str:
    """The digest of a text's base spans alone, as ``report`` gives it."""
    spans = spans_of(text, None)
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
