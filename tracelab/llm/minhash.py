"""Near-duplicate groups: MinHash bands, sequential Bayesian verification, exact check of the survivors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tracelab.llm.common import shipped, small_batches, staged
from tracelab.llm.graph import components

shipped(__name__)

WORDS = 5  # words of a shingle
PERCENT = 75  # least similarity of a link, in hundredths
BANDS, ROWS = 32, 4  # a pair at the threshold shares no band with a chance of 5e-6
BATCH = 32  # signature values compared before each look at the posterior
MISS = 1e-7  # posterior chance of a link below which a pair is dropped
WIDE = 32  # buckets above this size are split by rare shingles
CELLS = 1 << 18  # counters of the shingle frequency sketch

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEGMENT = 1 << 20
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_STEP, -1, 1 << 64)


def _random(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _random(5, 256)
_BYTE[_SEPARATOR] = 0
_FACTORS = _random(7, BANDS * ROWS)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _UNPOWER = _powers(_STEP, 1 << 14), _powers(_INVERSE, 1 << 14)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of every word of lower-cased bytes, from differences of one running polynomial sum."""
    global _POWER, _UNPOWER
    if len(data) > len(_POWER):
        size = 1 << len(data).bit_length()
        _POWER, _UNPOWER = _powers(_STEP, size), _powers(_INVERSE, size)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SEPARATOR[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWER[: len(data)], out=total[1:])
    return _mix((total[end] - total[start]) * _UNPOWER[start])


def _shingles(text: str) -> tuple[np.ndarray, bytes]:
    """Sorted distinct shingle hashes of a text, and a 128-bit digest of its word sequence."""
    data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + _SEGMENT)
        if stop < len(data):  # a segment ends at white space, so that no word is cut
            while True:
                gap = np.flatnonzero(_SEPARATOR[data[at:stop]])
                if len(gap) or stop == len(data):
                    break
                stop = min(len(data), stop + _SEGMENT)
            stop = at + int(gap[-1]) + 1 if stop < len(data) else stop
        parts.append(_word_hashes(data[at:stop]))
        at = stop
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    digest = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
    n = len(words)
    if n == 0:
        return words, digest
    width = min(n, WORDS)
    sums = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        sums = sums * np.uint64(_STEP) + words[i : n - width + 1 + i]
    return np.unique(_mix(sums)), digest


def _signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of every hash function, 32 bits each."""
    low = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        hashed = (shingles[None, at : at + 4096] * _FACTORS[:, None]) >> np.uint64(32)
        low = np.minimum(low, hashed.min(axis=1).astype(np.uint32))
    return low


def _sketch_texts(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shingles, digest = _shingles(text or "")
            rows.append((doc_id, len(shingles), digest, _signature(shingles).tobytes() if len(shingles) else None))
        names = ["doc_id", "n_shingles", "digest", "signature"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.binary(), pa.binary()])], names
        ) if rows else pa.RecordBatch.from_pylist([], _SKETCHED)


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])


def _full_sets(batches):
    for batch in batches:
        sets = [_shingles(text or "")[0].view(np.int64) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["v", "shingles"]
        )


def least_matches(compared: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest equal values among ``compared`` at which a link is still as likely as ``miss``.

    With a uniform prior the posterior of the similarity after m of n equal values is Beta(m+1, n-m+1); its mass above t
    equals the chance of at most m successes among n+1 trials of chance t.
    """
    t, below = percent / 100, 0.0
    for m in range(compared + 1):
        below += math.comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
        if below >= miss:
            return m
    return compared


@F.pandas_udf(BooleanType())
def _still_likely(x: pd.Series, y: pd.Series) -> pd.Series:
    """Compare signatures batch by batch; a pair leaves at the first batch whose posterior falls below the bound."""
    n = BANDS * ROWS
    if not len(x):
        return pd.Series([], dtype=bool)
    a = np.frombuffer(b"".join(x), np.uint32).reshape(-1, n)
    b = np.frombuffer(b"".join(y), np.uint32).reshape(-1, n)
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for at in range(0, n, BATCH):
        equal[alive] += (a[alive, at : at + BATCH] == b[alive, at : at + BATCH]).sum(axis=1)
        alive = alive[equal[alive] >= least_matches(at + BATCH)]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return pd.Series(out)


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that pass the sequential test and then share enough of their full shingle sets."""
    side = lambda c: classes.select(F.col("v").alias(c), F.col("signature").alias(f"s{c}"))
    likely = _still_likely.asNondeterministic()("sa", "sb")
    alive = staged(
        pairs.join(side("a"), "a").join(side("b"), "b").withColumn("ok", likely).where("ok").select("a", "b"), f"{name}-alive"
    )
    wanted = alive.select(F.col("a").alias("v")).union(alive.select(F.col("b").alias("v"))).distinct()
    sets = staged(
        texts.join(wanted, "v", "left_semi").select("v", "text").mapInArrow(_full_sets, "v bigint, shingles array<bigint>"),
        f"{name}-sets",
    )
    own = lambda c: sets.select(F.col("v").alias(c), F.col("shingles").alias(f"s{c}"))
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - shared
    return (
        alive.join(own("a"), "a").join(own("b"), "b").where(100 * shared >= PERCENT * union).select("a", "b").distinct()
    )


def _ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mark the rows of each bucket that are outside its largest component; buckets of one component go."""
    counts = df.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy(*keys).agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
    return df.join(main.where("parts > 1"), keys).withColumn("minor", F.col("component") != F.col("main")).drop("main", "parts")


def _frequency(sets: DataFrame) -> np.ndarray:
    """Counters of shingle frequency, merged over tasks slice by slice; their size does not depend on the data."""
    slices = 64

    def count(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            cells += np.bincount((flat % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        parts = cells.astype(np.int32).reshape(slices, -1)
        keep = [i for i in range(slices) if parts[i].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keep, pa.int32()), pa.array([parts[i].tobytes() for i in keep], pa.binary())], ["slice", "cells"]
        )

    def merge(key, rows):
        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in rows["cells"])
        return pd.DataFrame({"slice": [key[0]], "cells": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    merged = sets.mapInArrow(count, "slice int, cells binary").groupBy("slice").applyInPandas(merge, "slice int, cells binary")
    out = np.zeros((slices, CELLS // slices), np.int32)
    for row in merged.collect():  # at most 64 rows, one megabyte in all
        out[row["slice"]] = np.frombuffer(row["cells"], np.int32)
    return out.ravel()


def _rare_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Possible links inside wide buckets, without comparing all members with each other.

    Two sets of similarity 0.75 or more share one of the rarest shingles of each: the first seventh of the smaller set and
    the first quarter of the larger, in one common order (by estimated frequency, then value; any order gives
    the same links, this one the fewest candidates). Only pairs whose positions leave room for enough
    common shingles pass the join.
    """
    ids = members.select("v", "component").distinct()
    sets = staged(
        texts.join(ids.select("v"), "v", "left_semi").select("v", "text").mapInArrow(_full_sets, "v bigint, shingles array<bigint>"),
        "wide-sets",
    )
    counts = sets.sparkSession.sparkContext.broadcast(_frequency(sets))  # CELLS numbers

    def prefixes(batches):
        for batch in batches:
            out = [[], [], [], []]
            for v, shingles in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles.values.to_numpy(zero_copy_only=False)
                seen = counts.value[(s.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)]
                n = len(s)
                order = np.lexsort((s, seen))[: n - -(-PERCENT * n // 100) + 1]
                keep = np.flatnonzero(seen[order] > 1)
                for column, values in zip(out, (np.full(len(keep), v), s[order[keep]], keep, np.full(len(keep), n))):
                    column.append(values.astype(np.int64))
            columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out]
            yield pa.RecordBatch.from_arrays(columns, ["v", "token", "at", "n"])

    rows = sets.mapInArrow(prefixes, "v bigint, token bigint, at bigint, n bigint").join(ids, "v")
    rows = staged(_ranked(rows, ["token"]), "wide-rows")
    # the smaller set of a pair with n + m members needs at least PERCENT/(100+PERCENT) of them in common
    small = rows.where(f"(n - at) * {100 + PERCENT} >= 2 * {PERCENT} * n").select("token", *[F.col(c).alias(f"a_{c}") for c in ("v", "component", "at", "n", "minor")])
    large = rows.select("token", *[F.col(c).alias(f"b_{c}") for c in ("v", "component", "at", "n", "minor")])
    fits = F.expr(
        f"a_component != b_component and (a_n < b_n or (a_n = b_n and a_v != b_v)) and 100 * a_n >= {PERCENT} * b_n "
        f"and {100 + PERCENT} * least(a_n - a_at, b_n - b_at) >= {PERCENT} * (a_n + b_n)"
    )
    one = small.where("a_minor").join(large, "token").where(fits)
    two = small.where("not a_minor").join(large.where("b_minor"), "token").where(fits)
    both = one.unionByName(two)
    return both.select(F.least("a_v", "b_v").alias("a"), F.greatest("a_v", "b_v").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate class of every document.

    Returns ``doc_id, n_shingles, component_id, kept``. Texts with one word sequence (A-Z lower-cased) form a class,
    represented by its smallest ``doc_id``; only classes are compared, so copies cost nothing. Candidates share a
    band of the MinHash signature. Each bucket first compares its members with one leader; components then show
    which pairs can still matter: members outside the bucket's main component against the rest, directly in
    buckets up to ``WIDE`` members, through their rare shingles in wider ones. So a group of n near copies costs about n
    comparisons per band, and no pair that shares a band is left undecided.

    Null text: like an empty one, no shingles, linked with nothing. Null ``doc_id``: linked with nothing, null class, not
    kept. Rows that repeat a ``doc_id`` count as one document with one class. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketched = staged(
        docs.mapInArrow(_sketch_texts, "doc_id bigint, n_shingles bigint, digest binary, signature binary"), "sketched"
    )
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = staged(
        full.groupBy("digest").agg(F.min("doc_id").alias("v"), F.first("signature").alias("signature")), "classes"
    )
    texts = docs.withColumnRenamed("doc_id", "v")
    bands = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(signature, {4 * ROWS * i + 1}, {4 * ROWS})")) for i in range(BANDS)])
    keys = classes.select("v", F.explode(bands).alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("leader")).where("n > 1")
    members = staged(keys.join(buckets, "key"), "members")
    # one shuffle of the texts at every size; all later steps read the share that is in some bucket
    texts = staged(texts.join(members.select("v").distinct().hint("shuffle_hash"), "v", "left_semi"), "member-texts")
    pairs = members.where("v != leader").select(F.col("leader").alias("a"), F.col("v").alias("b")).distinct()
    first = staged(_links(pairs, classes, texts, "first"), "links-first")
    label = components(first)
    placed = members.join(label.withColumnRenamed("id", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    open_ = staged(_ranked(placed.drop("leader"), ["key"]), "open")
    a = open_.where(f"n <= {WIDE} and minor").select("key", F.col("v").alias("x"), F.col("component").alias("cx"))
    b = open_.where(f"n <= {WIDE}").select("key", F.col("v").alias("y"), F.col("component").alias("cy"))
    direct = a.join(b, "key").where("cx != cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    later = direct.join(pairs, ["a", "b"], "left_anti").unionByName(_rare_pairs(open_.where(f"n > {WIDE}"), texts)).distinct()
    second = _links(staged(later, "later"), classes, texts, "second")
    label = components(first.unionByName(second))
    owner = sketched.join(classes.select("digest", "v"), "digest", "left").join(label.withColumnRenamed("id", "v"), "v", "left")
    alone = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "v")).otherwise(F.col("doc_id"))
    return owner.select("doc_id", "n_shingles", alone.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + {WORDS - 1}], ' ') AS x FROM i),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z y ON y.doc_id = a JOIN z v ON v.doc_id = b WHERE 100 * c >= {PERCENT} * (y.n + v.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, u.b FROM r JOIN u ON r.o = u.a),
c AS (SELECT id, min(o) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN c ON id = doc_id LEFT JOIN z USING (doc_id)
"""
