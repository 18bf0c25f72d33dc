"""Exact dedup, spelling variants and the Merkle manifest: brute force on small tables, and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from test_llm import docs_of, levenshtein, odd_rows, prose

from tracelab.llm import exactindex, merkle, pivotal


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# exact copies


def naive_groups(rows):
    by = collections.defaultdict(list)
    for i, t in rows:
        by[lower(t)].append(i)
    out = []
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return collections.Counter(out)


def copies(rng):
    base = [prose(rng, rng.randrange(0, 40), 9) for _ in range(60)]
    rows = [(i, rng.choice(base).upper() if i % 7 == 0 else rng.choice(base)) for i in range(400)]
    return rows + [(400 + i, "the hot one") for i in range(300)] + [(900, "É"), (901, "é"), (902, None), (903, "")]


@pytest.mark.parametrize(("bits", "capacity"), [(64, 1 << 20), (64, 60), (3, 60)])
def test_exact_groups_match_brute_force(spark, monkeypatch, bits, capacity):
    monkeypatch.setattr(exactindex, "BITS", bits)  # three bits: most hashes are chains of different texts
    rows = copies(random.Random(1))
    docs = docs_of(spark, [(i, t, "s") for i, t in rows], extra=True)
    got = exactindex.groups(docs, capacity).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert collections.Counter(map(tuple, got)) == naive_groups(rows)
    kept = exactindex.deduplicated(docs, capacity)
    assert kept.columns == docs.columns
    want = {r[1] for r in naive_groups(rows)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_directory_doubles_and_chains(spark, monkeypatch):
    rows = copies(random.Random(2))
    docs = docs_of(spark, [(i, t, "s") for i, t in rows]).select("doc_id", "text")
    light = exactindex.hashed(docs).select("doc_id", "h", F.octet_length("body").cast("bigint").alias("bytes"))
    total = sum(len(t.encode()) for t in {lower(t) for _, t in rows})
    index = exactindex.build(docs, light, capacity=total // 8)
    slots = {r["slot"]: (r["bucket"], r["local_depth"]) for r in index.directory.collect()}
    assert set(slots) <= set(range(1 << index.depth)) and index.depth > 3 and len({d for _, d in slots.values()}) > 1
    load = collections.Counter()
    for r in index.entries.collect():
        bucket, local = slots[(r["h"] % (1 << 64)) >> (64 - index.depth)]
        assert bucket == r["bucket"] and r["chained"] == 1
        load[bucket, local] += len(r["body"].encode())
    assert all(n <= total // 8 for (_, local), n in load.items() if local < 3 + exactindex.SPLITS)
    monkeypatch.setattr(exactindex, "BITS", 2)
    light = exactindex.hashed(docs).select("doc_id", "h", F.octet_length("body").cast("bigint").alias("bytes"))
    chains = collections.defaultdict(list)
    for r in exactindex.build(docs, light, capacity=100).entries.collect():
        chains[r["h"]].append((r["chain"], r["chained"], r["body"]))
    for chain in chains.values():
        chain.sort()
        assert [c for c, _, _ in chain] == list(range(len(chain))) and {n for _, n, _ in chain} == {len(chain)}
        assert [b for _, _, b in chain] == sorted((b for _, _, b in chain), key=str.encode)


def test_exact_groups_of_odd_rows(spark):
    rows = odd_rows(random.Random(3))
    docs = docs_of(spark, rows, extra=True)
    got = exactindex.report(docs).collect()
    assert collections.Counter(map(tuple, got)) == naive_groups([(i, t) for i, t, _ in rows])
    kept = collections.Counter(r["doc_id"] for r in exactindex.deduplicated(docs).collect())
    assert kept == collections.Counter([2, 4, 5, 6, 7, 8])  # 1 and 2 share a text, as do 3, 4 and the row of nulls
    only = docs_of(spark, [(None, "x", "b"), (None, "X", "a")])
    assert [(r["text"], r["source"]) for r in exactindex.deduplicated(only).collect()] in ([("X", "a")], [("x", "b")])
    assert exactindex.report(docs.limit(0)).count() == 0 and exactindex.deduplicated(docs.limit(0)).count() == 0


# spelling variants


def naive_words(rows):
    out = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def naive_variants(rows):
    n = naive_words(rows)
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and levenshtein(v, w) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return out


def spelled(rng, n):
    letters = "abcdeé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(25)]
    words = list(base)
    for _ in range(150):
        w = rng.choice(words)
        i = rng.randrange(len(w))
        words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    words += ["aaaaaaaa", "aaaaaaa", "aaaaaabaa", "ababababab", "abababab", "ababababa", "ÀÉÎÕÜß", "ÀÉÎÕÜßÿ"]
    weights = [rng.choice([1, 2, 6, 30, 160]) for _ in words]
    return [" ".join(w.capitalize() if rng.random() < 0.2 else w for w in rng.choices(words, weights, k=120)) for _ in range(n)]


@pytest.mark.parametrize("beside", [10, 0])
def test_variants_match_brute_force(spark, monkeypatch, beside):
    monkeypatch.setattr(pivotal, "BESIDE", beside)
    rows = list(enumerate(spelled(random.Random(4), 120))) + [(None, "colour colour colour colour Colour"), (500, None), (501, "")]
    got = pivotal.variants(docs_of(spark, [(i, t, "s") for i, t in rows], extra=True)).collect()
    want = naive_variants(rows)
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert sum(r["n_near"] for r in got) > 100 and any(r["form"] is not None and r["root"] != r["form"] for r in got)


def test_pivots_are_the_rarest_disjoint_pair(spark):
    rng = random.Random(5)
    kind = "array<struct<pos:int,w:bigint,g:string>>"
    rows = []
    for _ in range(200):
        places = sorted(rng.sample(range(12), rng.randrange(3, 9)))
        rows.append(([(p, rng.randrange(1, 30), "ab") for p in places],))
    for r in spark.createDataFrame(rows, f"grams {kind}").select("grams", pivotal.pivots("grams").alias("p")).collect():
        best = min(a["w"] + b["w"] for a in r["grams"] for b in r["grams"] if b["pos"] - a["pos"] >= 2)
        assert len(r["p"]) == 2 and abs(r["p"][0]["pos"] - r["p"][1]["pos"]) >= 2 and sum(x["w"] for x in r["p"]) == best


def test_variants_of_odd_rows(spark):
    rows = [(i, t) for i, t, _ in odd_rows(random.Random(6))] + [(20 + i, "z" * 3000 + " " + "z" * 3001) for i in range(6)]
    docs = docs_of(spark, [(i, t, "s") for i, t in rows], extra=True)
    got = pivotal.variants(docs).collect()
    assert set(map(tuple, got)) == naive_variants(rows) and {len(r["word"]) for r in got} == {3000, 3001}
    assert pivotal.variants(docs.limit(0)).count() == 0


# Merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, run):
    """Root of a list of digests, and for each its siblings per level, left and right."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            start = i - i % run
            paths[k].append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + run])))
        nodes = [H(*nodes[i : i + run]) for i in range(0, len(nodes), run)]
        at = [i // run for i in at]
    return nodes[0], paths


def naive_manifest(rows, run):
    by = collections.defaultdict(list)
    for row in rows:  # doc_id, source, lang, n_chars, text
        by[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: x[:3])
        trees[lang] = tree([leaf for _, _, leaf, _ in by[lang]], run)
    root, upper = tree([trees[x][0] for x in langs], run)
    out = []
    for lang, above in zip(langs, upper):
        for (_, _, leaf, row), path in zip(by[lang], trees[lang][1]):
            path = path + above
            h = leaf
            if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                h = leaf_of((*row[:3], row[3] + 1, row[4]))
            for left, right in path:
                h = H(left, h, right)
            out.append((row[0], leaf, trees[lang][0], root, H(*[x for p in path for x in p]), h, h == root))
    return collections.Counter(out)


@pytest.mark.parametrize("run", [2, 3])
def test_manifest_matches_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rng = random.Random(7)
    langs = ["en"] * 6 + ["fr", "de", None, "é", ""]
    rows = [(i * 3 - 50, rng.choice(["a", None]), rng.choice(langs), rng.choice([None, 5, 2**63 - 1]), prose(rng, 5)) for i in range(150)]
    rows += [(None, None, None, None, None), (None, "x", "en", 1, ""), (7, "s", "lone", 2, "é"), rows[3], rows[3], (0, None, "en", None, "t")]
    names = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    docs = spark.createDataFrame(rows, names).withColumns({c: F.lit(1) for c in ("tree", "i", "n", "h", "path", "kid", "root")})
    got = merkle.report(docs, run)
    assert collections.Counter(map(tuple, got.collect())) == naive_manifest(rows, run)
    assert merkle.report(docs.limit(0), run).count() == 0
    one = merkle.report(docs.where("lang = 'lone'"), run).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["verified"] and one["proof_sha256"] == H("")


def test_manifest_of_odd_rows(spark):
    rows = [(i, s, "en", None if t is None else len(t), t) for i, t, s in odd_rows(random.Random(8))]
    docs = docs_of(spark, odd_rows(random.Random(8)), extra=True)
    assert collections.Counter(map(tuple, merkle.report(docs).collect())) == naive_manifest(rows, 2)
