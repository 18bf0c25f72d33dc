"""Line deduplication by a segment-partition edit join with banded bit-parallel verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import plain_text, staged

EDITS = 2  # insertions, deletions and substitutions of a link, at most
LEAST_CHARS = 24  # shorter lines link with nothing, as two edits would turn one into another; their copies go
LETTERS = "eatniorhsl"  # letters whose counts may differ by 2 * EDITS in sum


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines with a word (split at line feeds): ``doc_id, at, line``; ``at`` counts all lines from 0."""
    split = docs.select("doc_id", F.posexplode(F.split(plain_text(), "\n")).alias("at", "line"))
    return split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def segment(length: Column, number: int, edits: int = EDITS) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``number`` (from 1) of EDITS + 1 nearly equal ones; the last ones are the longer."""
    parts = edits + 1
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    start = 1 + (number - 1) * base + F.greatest(F.lit(0), F.lit(number - 1 - parts) + longer)
    return start, base + (F.lit(number + 0) > parts - longer).cast("int")


def key(length: Column, number: int, start: Column, width: Column) -> Column:
    """Hash of a length, a segment's number and the characters there; ``wide`` has four bytes a character, so a slice needs no scan."""
    return F.xxhash64(length, F.lit(number), F.substring("wide", 4 * start - 3, 4 * width))


def index_keys(edits: int = EDITS) -> Column:
    """Keys under which a line waits: its length and each of its segments."""
    return F.array(*[key(F.col("n"), i, *segment(F.col("n"), i, edits)) for i in range(1, edits + 2)])


def probe_keys(edits: int = EDITS) -> Column:
    """Keys at which a line asks for lines of its own length or up to EDITS less.

    A line within EDITS edits keeps a segment unchanged whose shift is bounded from both ends: the edits before it and the edits
    behind it, which leaves a few starts for each segment and length. Lines of one length and segments in place are left
    out: there the index meets itself.
    """
    keys = []
    for less in range(edits + 1):
        length = F.col("n") - less
        for i in range(1, edits + 2):
            start, width = segment(length, i, edits)
            for shift in range(max(1 - i, less - (edits + 1 - i)), min(i - 1, less + (edits + 1 - i)) + 1):
                if less or shift:
                    keys.append(key(length, i, start + shift, width))
    return F.array(*keys)


def letter_counts() -> Column:
    """Counts of ten letters, four bits each, in one number."""
    out = F.lit(0).cast("bigint")
    for i, c in enumerate(LETTERS):
        count = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft((count % 16).cast("bigint"), 4 * i))
    return out


#: A key row is two numbers: 48 bits of the key and 16 of the counts, 40 bits of the line's hash (its id) and 24 of the counts.
KEY_BITS, ID_BITS = 48, 40


def line_id() -> Column:
    return F.shiftright("h", 64 - ID_BITS)


def packed(made: Column) -> list[Column]:
    """``k, v`` of a key and the line it is for."""
    low = F.col("c").bitwiseAND(F.lit((1 << 24) - 1))
    return [
        F.shiftleft(made, 64 - KEY_BITS).bitwiseOR(F.shiftrightunsigned("c", 24)).alias("k"),
        F.shiftleft(line_id(), 64 - ID_BITS).bitwiseOR(low).alias("v"),
    ]


def counts_fit(a: str, b: str, edits: int = EDITS) -> Column:
    """True wherever the letter counts in two key rows allow EDITS edits (counts modulo 16: never false for a link)."""
    total = "0"
    for i in range(len(LETTERS)):
        part = lambda row: f"(shiftright({row}.v, {4 * i}) & 15)" if i < 6 else f"(shiftright({row}.k, {4 * i - 24}) & 15)"
        x = f"abs({part(a)} - {part(b)})"
        total += f" + least({x}, 16 - {x})"
    return F.expr(f"({total}) <= {2 * edits}")


def distance(a: str, b: str, edits: int = EDITS) -> Column:
    """Edit distance of two columns up to ``edits``, null above: a banded automaton with all diagonals in one number.

    Bit d + EDITS of state e is set while the first j characters of ``b`` and j + d of ``a`` differ by at most e edits. For each
    character of ``b`` a mask of the diagonals on which it equals the other text's character moves all states at once.
    """
    full = (1 << (2 * edits + 1)) - 1
    bits = " | ".join(f"if(_x[j + {t}] = c, {1 << t}, 0)" for t in range(2 * edits + 1))
    pad = ", ".join(["''"] * edits)
    # the pad is longer than needed behind the text, so that no index leaves the array when ``b`` is longer
    tail = ", ".join(["''"] * (3 * edits + 1))
    states = [f"{1 << edits}"]
    for e in range(1, edits + 1):
        states.append(str((int(states[-1]) | int(states[-1]) << 1) & full))
    start = ", ".join(f"{s} as r{e}" for e, s in enumerate(states))
    nexts = ["(s.r0 & m)"]
    for e in range(1, edits + 1):
        nexts.append(f"((s.r{e} & m) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | (shiftleft({nexts[-1]}, 1) & {full}))")
    step = ", ".join(f"{n} as r{e}" for e, n in enumerate(nexts))
    # the other text's characters are an argument of the fold, so that they are split once
    masks = f"transform(array(concat(array({pad}), split({a}, ''), array({tail}))), _x -> transform(split({b}, ''), (c, j) -> {bits}))[0]"
    end = f"aggregate({masks}, struct({start}), (s, m) -> struct({step}))"
    bit = f"shiftleft(1, char_length({a}) - char_length({b}) + {edits})"
    picks = " ".join(f"when (z.r{e} & {bit}) != 0 then {e}" for e in range(edits + 1))
    return F.expr(
        f"if(abs(char_length({a}) - char_length({b})) > {edits}, null, transform(array({end}), z -> case {picks} end)[0])"
    )


PLACES = 1 << 31  # places in a document


def distinct_lines(docs: DataFrame) -> DataFrame:
    """Each different line once: ``h`` (hash), ``c`` (letter counts), ``line``, ``n``, first place ``doc_id, at`` and number of ``copies``.

    The first place is the least of one decimal, which a hash aggregate can hold; a struct would have the lines sorted.
    """
    lines = lines_of(docs).where("doc_id is not null")
    place = (F.col("doc_id").cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(11,0)") + F.col("at")).cast("decimal(38,0)")
    grouped = lines.groupBy("line").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("copies"))
    at = F.pmod("p", F.lit(PLACES).cast("decimal(38,0)")).cast("int")
    doc = ((F.col("p") - at) / F.lit(PLACES).cast("decimal(11,0)")).cast("bigint")
    return grouped.select(F.xxhash64("line").alias("h"), letter_counts().alias("c"), "line", F.length("line").alias("n"), doc.alias("doc_id"), at.alias("at"), "copies")


def links(distinct: DataFrame, edits: int = EDITS) -> DataFrame:
    """All pairs of different lines (of LEAST_CHARS characters or more) within ``edits`` edits, the earlier one first.

    ``distinct`` comes from ``distinct_lines`` and should be staged. Returns ``a_doc, a_at, b_doc, b_at, distance`` and the hashes
    ``a, b``. Candidates share a key of the index and pass the letter counts inside the join; copies were merged before, so a
    common line has one row per key. Lines go by a 64-bit hash until the verification, which compares the texts of every
    line of either id, so equal ids of different lines lose nothing: such lines are candidates of each other.
    """
    wide = distinct.select("h", "c", "n", F.encode("line", "UTF-32").alias("wide"))
    rows = lambda keys: wide.select("h", "c", F.explode(keys).alias("key")).select(*packed(F.col("key")))
    ids = [F.shiftright(F.col(f"{s}.v"), 64 - ID_BITS).alias(s) for s in "xy"]
    same = lambda s: F.shiftright(F.col(f"{s}.k"), 64 - KEY_BITS)
    fit = counts_fit("x", "y", edits)
    meet = lambda other, which: rows(index_keys(edits)).alias("x").join(other.alias("y"), same("x") == same("y")).where(fit).select(*ids).where(which)
    pairs = meet(rows(index_keys(edits)), "x < y").unionByName(meet(rows(probe_keys(edits)), "x != y"))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    named = distinct.withColumn("id", line_id())
    twice = named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    pairs = staged(pairs.unionByName(twice), "line-pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = staged(named.join(wanted.hint("shuffle_hash"), "id", "left_semi").select("id", "h", "line", "doc_id", "at"), "line-texts")
    side = lambda c: texts.select(F.col("id").alias(c), F.col("h").alias(f"{c}_h"), F.col("line").alias(f"{c}_line"), F.struct("doc_id", "at").alias(f"{c}_p"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("a != b or a_p < b_p")
    met = met.withColumn("distance", distance("a_line", "b_line", edits))
    met = met.where("distance is not null")
    first = F.col("a_p") < F.col("b_p")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return met.select(
        pick("a_h", "b_h").alias("a"), pick("b_h", "a_h").alias("b"), pick("a_p", "b_p").alias("p"), pick("b_p", "a_p").alias("q"), "distance"
    ).select("a", "b", F.col("p.doc_id").alias("a_doc"), F.col("p.at").alias("a_at"), F.col("q.doc_id").alias("b_doc"), F.col("q.at").alias("b_at"), "distance")


def decisions(docs: DataFrame) -> DataFrame:
    """One row per dropped line: ``doc_id, at, reason``.

    A line goes as ``copy`` if it equals an earlier line (by doc_id, then line number), as ``near`` if it is the first of its kind but
    within EDITS edits of a line that occurs earlier. Null texts have no lines; lines of a null ``doc_id`` are never dropped and
    drop nothing; a row that repeats a ``doc_id`` and text shares its places, so its lines stay or go as in the first.

    Lines without a word stay. Lines under LEAST_CHARS characters go as ``copy`` only: their edit bound is 0, as two edits would turn
    one short line into another one.
    """
    docs = docs.select("doc_id", "text")
    distinct = staged(distinct_lines(docs), "lines", "zstd")
    near = links(distinct.where(F.col("n") >= LEAST_CHARS)).select(F.col("b_doc").alias("doc_id"), F.col("b_at").alias("at")).distinct().withColumn("near", F.lit(True))
    # both hashes are taken below the join, so that no text moves
    kinds = distinct.select("h", F.xxhash64("line", F.lit(1)).alias("h2"), "doc_id", "at", "copies").join(near, ["doc_id", "at"], "left")
    kinds = kinds.where("near or copies > 1").select("h", "h2", F.col("doc_id").alias("f_doc"), F.col("at").alias("f_at"), "near")
    places = lines_of(docs).where("doc_id is not null").select("doc_id", "at", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("h2"))
    is_first = (F.col("doc_id") == F.col("f_doc")) & (F.col("at") == F.col("f_at"))
    return (
        places.join(kinds, ["h", "h2"])
        .withColumn("reason", F.when(~is_first, "copy").when(F.col("near"), "near"))
        .where("reason is not null")
        .select("doc_id", "at", "reason")
    )


def report(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_lines, n_copy, n_near, dropped`` (numbers of the dropped lines, comma-joined)."""
    docs = docs.select("doc_id", "text")
    gone = decisions(docs).groupBy("doc_id").agg(
        F.count(F.when(F.col("reason") == "copy", 1)).alias("n_copy"),
        F.count(F.when(F.col("reason") == "near", 1)).alias("n_near"),
        F.array_join(F.array_sort(F.collect_set("at")), ",").alias("dropped"),
    )
    counted = docs.select("doc_id", F.size(F.split(plain_text(), "\n")).cast("bigint").alias("n_lines"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return counted.join(gone, "doc_id", "left").select("doc_id", "n_lines", zero("n_copy"), zero("n_near"), F.coalesce("dropped", F.lit("")).alias("dropped"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; a document may end up empty, null texts stay null."""
    gone = decisions(docs).groupBy("doc_id").agg(F.collect_set("at").alias("_gone"))
    kept = F.expr("array_join(transform(filter(transform(split(text, '\\n'), (x, i) -> struct(x, i)), s -> not array_contains(_gone, s.i)), s -> s.x), '\\n')")
    return docs.join(gone, "doc_id", "left").withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).drop("_gone")


SQL = f"""
WITH l AS (SELECT doc_id, unnest(range(0, len(s))) AS ln, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT * FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
o AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, ln) AS r FROM k),
d AS (SELECT doc_id, ln, line, length(line) AS n FROM o WHERE r = 1),
near AS (SELECT DISTINCT y.doc_id, y.ln FROM d x JOIN d y ON y.n BETWEEN x.n - {EDITS} AND x.n + {EDITS} AND (x.doc_id, x.ln) < (y.doc_id, y.ln) WHERE x.n >= {LEAST_CHARS} AND y.n >= {LEAST_CHARS} AND levenshtein(x.line, y.line) <= {EDITS}),
g AS (SELECT doc_id, ln, 'copy' AS reason FROM o WHERE r > 1 UNION ALL SELECT doc_id, ln, 'near' FROM near),
c AS (SELECT doc_id, count(*) FILTER (WHERE reason = 'copy') AS n_copy, count(*) FILTER (WHERE reason = 'near') AS n_near, string_agg(CAST(ln AS VARCHAR), ',' ORDER BY ln) AS dropped FROM g GROUP BY doc_id)
SELECT doc_id, n_lines, coalesce(n_copy, 0) AS n_copy, coalesce(n_near, 0) AS n_near, coalesce(dropped, '') AS dropped
FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines FROM documents) LEFT JOIN c USING (doc_id)
"""
