"""Merkle manifest of a table: one tree per language and one over their roots, with a proof for every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import CRC_SQL, crc_sql, staged
from tracelab.operators.scale import ordinal_in_group

RUN = 2  # nodes under one parent
BLOCK = 4096  # ids whose rows are ordered in one task
TAMPERED = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STAGED_EVERY = 5  # levels of proofs in one plan


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, kid``: the language's tree and a struct ``doc_id, h, t`` (leaf; leaf after tampering, null where there is none)."""
    leaf = lambda n: digest(*[field(n if c == "n_chars" else F.col(c)) for c in FIELDS])
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    # the null language comes first, as its name is the shortest
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    return docs.select(*FIELDS).select(tree.alias("tree"), "doc_id", leaf(F.col("n_chars")).alias("h"), F.when(hit, leaf(more)).alias("t"))


def sibling(slot: int, run: int) -> Column:
    """Index of the slot-zero node that node ``i`` in ``slot`` stands beside: by XOR in pairs, else by the slot's offset."""
    return F.col("i").bitwiseXOR(F.lit(1)) if run == 2 else F.col("i") - slot


def level(nodes: DataFrame, run: int) -> DataFrame:
    """Parents of ``nodes`` (tree, i, n, kid): ``tree, p, n, h`` and their kids ``kid0`` to ``kid<run - 1>``.

    Every slot joins slot zero on the computed index; slot-zero rows, which all runs have, emit the parents.
    """
    out = nodes.where(F.col("i") % run == 0).withColumnRenamed("kid", "kid0")
    for slot in range(1, run):
        beside = nodes.where(F.col("i") % run == slot).select("tree", sibling(slot, run).alias("i"), F.col("kid").alias(f"kid{slot}"))
        out = out.join(beside, ["tree", "i"], "left")
    kids = [f"kid{s}" for s in range(run)]
    parent = digest(*[F.coalesce(F.col(f"{k}.h"), F.lit("")) for k in kids])
    return out.select("tree", F.expr(f"i div {run}").alias("p"), F.expr(f"(n + {run - 1}) div {run}").alias("n"), parent.alias("h"), *kids)


def climb(nodes: DataFrame, run: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of all trees, from the leaves on, and the trees' roots (``tree, h``). ``nodes`` is staged."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tops, made = nodes.where("n = 1").select("tree", "kid.h"), []
    while most > 1:
        made.append(staged(level(nodes.where("n > 1"), run), f"merkle-{len(made)}"))
        tops = tops.unionByName(made[-1].where("n = 1").select("tree", "h"))
        nodes = made[-1].select("tree", F.col("p").alias("i"), "n", F.struct("h").alias("kid"))
        most = (most + run - 1) // run
    return made, tops


def descend(nodes: DataFrame, made: list[DataFrame], base: DataFrame, run: int) -> DataFrame:
    """``tree, i, kid, path`` of every leaf of ``nodes``; ``base`` (tree, path) is what lies above the trees' roots.

    ``path`` has for each level, from the leaf on, the siblings to the left and to the right, each concatenated. Children take
    their parent's path and put their own siblings before it, so each level moves as many rows as it has nodes.
    """
    up = None
    for at in range(len(made) - 1, -1, -1):
        paths = made[at].where("n = 1").join(base, "tree")
        if up is not None:
            paths = paths.unionByName(made[at].where("n > 1").join(up.select("tree", F.col("i").alias("p"), "path"), ["tree", "p"]).select(*paths.columns))
        kids = [F.col(f"kid{s}") for s in range(run)]
        side = lambda some: F.concat(F.lit(""), *[F.coalesce(k["h"], F.lit("")) for k in some])
        each = [
            F.struct(
                (F.col("p") * run + s).alias("i"), kids[s].alias("kid"),
                F.concat(F.array(F.struct(side(kids[:s]).alias("l"), side(kids[s + 1 :]).alias("r"))), F.col("path")).alias("path"),
            )
            for s in range(run)
        ]
        up = paths.select("tree", F.explode(F.array(*each)).alias("x")).where("x.kid is not null").select("tree", "x.*")
        if at and at % STAGED_EVERY == 0:
            up = staged(up, "merkle-paths")
    alone = nodes.where("n = 1").join(base, "tree").select("tree", "i", "kid", "path")
    return alone if up is None else up.select("tree", "i", "kid", "path").unionByName(alone)


def numbered(rows: DataFrame, block: Column, order: list[str]) -> DataFrame:
    """``rows`` with their index ``i`` in their tree and its size ``n``; rows of one ``block`` are ordered in one task."""
    rows = staged(rows.withColumn("_block", block), "merkle-rows")
    out = ordinal_in_group(rows, ["tree"], ["_block", *order], "i").drop("_block")
    return out.join(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "tree")


def proofs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Per row of ``docs``: ``doc_id, leaf, tampered, path, subroot, root``.

    ``leaf`` digests doc_id, source, lang, n_chars and text; ``tampered`` the same with one more in n_chars where TAMPERED divides the
    id's CRC-32 (null elsewhere, and for a null id or n_chars). A null lang is a tree of its own, before all others; a null
    doc_id comes before all ids of its tree. Repeated ids follow their leaves' digests, so that repeated rows need no order. Rows of BLOCK ids
    of one language are ordered in one task, and one id is taken to have few rows. Other columns are not read. An empty table gives no rows.
    """
    block = F.floor(F.col("doc_id") / BLOCK)
    rows = numbered(leaves(docs), block, ["doc_id", "h"])
    nodes = staged(rows.select("tree", "i", "n", F.struct("doc_id", "h", "t").alias("kid")), "merkle-leaves")
    made, tops = climb(nodes, run)
    tops = staged(tops, "merkle-subroots")
    # the subroots are the leaves of one more tree
    upper = tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h")
    upper = numbered(upper, F.substring("name", 1, 3), ["name"])
    upper = staged(upper.select("tree", "i", "n", F.struct("name", "h").alias("kid")), "merkle-top")
    over, root = climb(upper, run)
    root = root.first()
    none = F.array().cast("array<struct<l:string,r:string>>")
    empty = staged(docs.sparkSession.range(1).select(F.lit("").alias("tree"), none.alias("path")), "merkle-empty")
    above = descend(upper, over, empty, run)
    above = staged(above.select(F.col("kid.name").alias("tree"), F.struct("path", F.col("kid.h").alias("subroot")).alias("top")), "merkle-above")
    down = descend(nodes, made, above.select("tree", F.col("top.path").alias("path")), run)
    down = down.join(above.select("tree", "top.subroot"), "tree")
    return down.select("kid.doc_id", F.col("kid.h").alias("leaf"), F.col("kid.t").alias("tampered"), "path", "subroot", F.lit(root["h"] if root else None).alias("root"))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda h, s: digest(s["l"], h, s["r"]))


def report(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    rows = proofs(docs, run).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    return rows.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEAF = "sha256(" + " || ".join(
    f"coalesce(octet_length(encode(CAST({{{c}}} AS VARCHAR))) || ':' || CAST({{{c}}} AS VARCHAR), '-')" for c in FIELDS
) + ")"
_SAME = dict(zip(FIELDS, FIELDS))
SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT *, coalesce('=' || lang, '') AS tree, {_LEAF.format(**_SAME)} AS leaf, {crc_sql("CAST(doc_id AS VARCHAR)")} % {TAMPERED} = 0 AS hit, {_LEAF.format(**{**_SAME, "n_chars": "(n_chars + 1)"})} AS t FROM documents, crc),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
up AS (
  SELECT tree, 0 AS lv, i, n, leaf AS h FROM o
  UNION ALL SELECT tree, lv + 1, i // {RUN}, (max(n) + {RUN - 1}) // {RUN}, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY tree, lv, i // {RUN}
),
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lv, i, n, subroot AS h FROM s
  UNION ALL SELECT lv + 1, i // {RUN}, (max(n) + {RUN - 1}) // {RUN}, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lv, i // {RUN}
),
root AS (SELECT h AS root FROM top WHERE n = 1),
low AS (
  SELECT o.tree, o.i AS leaf_i, u.lv, string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i < o.i // CAST(pow({RUN}, u.lv) AS BIGINT)) AS l, string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i > o.i // CAST(pow({RUN}, u.lv) AS BIGINT)) AS r
  FROM o JOIN up u ON u.tree = o.tree AND u.n > 1 AND u.i // {RUN} = o.i // CAST(pow({RUN}, u.lv + 1) AS BIGINT) GROUP BY ALL
),
high AS (
  SELECT s.tree, 1000 + u.lv AS lv, string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i < s.i // CAST(pow({RUN}, u.lv) AS BIGINT)) AS l, string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i > s.i // CAST(pow({RUN}, u.lv) AS BIGINT)) AS r
  FROM s JOIN top u ON u.n > 1 AND u.i // {RUN} = s.i // CAST(pow({RUN}, u.lv + 1) AS BIGINT) GROUP BY ALL
),
path AS (SELECT * FROM low UNION ALL SELECT o.tree, o.i, high.lv, l, r FROM o JOIN high USING (tree)),
step AS (SELECT tree, leaf_i, coalesce(l, '') AS l, coalesce(r, '') AS r, row_number() OVER (PARTITION BY tree, leaf_i ORDER BY lv) AS pos FROM path),
fold AS (
  SELECT tree, i AS leaf_i, 0 AS pos, CASE WHEN hit AND n_chars IS NOT NULL THEN t ELSE leaf END AS h FROM o
  UNION ALL SELECT f.tree, f.leaf_i, f.pos + 1, sha256(s.l || f.h || s.r) FROM fold f JOIN step s ON s.tree = f.tree AND s.leaf_i = f.leaf_i AND s.pos = f.pos + 1
),
done AS (SELECT tree, leaf_i, arg_max(h, pos) AS folded_root FROM fold GROUP BY ALL),
proof AS (SELECT tree, leaf_i, sha256(string_agg(l || r, '' ORDER BY pos)) AS proof_sha256 FROM step GROUP BY ALL)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM o JOIN s ON s.tree = o.tree CROSS JOIN root JOIN done ON done.tree = o.tree AND done.leaf_i = o.i LEFT JOIN proof ON proof.tree = o.tree AND proof.leaf_i = o.i
"""
