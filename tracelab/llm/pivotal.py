"""Spelling variants: words one edit apart, found by pivotal bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import CRC_SQL, crc_sql, lower_ascii_text, plain_text, staged

RUN_OF_LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
DELETED = 199  # a run whose hash this divides loses a letter
LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5  # a form is at least so many times as frequent as its variant
BESIDE = 10  # letters of each part of a word that a key holds, at most
CARRIED = 64  # letters of a word that its keys carry along; longer words are fetched for comparison


def words(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of all documents and how often they occur.

    Words are counted in the tasks before they move. Null text has no words; where ``doc_id`` is null no run loses a letter.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(plain_text(), F.lit(RUN_OF_LETTERS), F.lit(0))).alias("run"))
    runs = runs.select(lower_ascii_text(F.col("run")).alias("run"), F.col("doc_id").cast("string").alias("id"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary")))
    cut = F.expr("int(h % char_length(run))")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), cut), F.substring(F.col("run"), cut + 2, F.char_length("run")))
    made = runs.select(F.when(F.col("h") % DELETED == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= LEAST_LETTERS)
    return made.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def gram_prefixes(vocabulary: DataFrame) -> DataFrame:
    """Each word's rarest bigrams: ``id, word, last, len, chars, grams`` (array of structs ``pos, w, g, rank`` in order of position).

    Bigrams are ranked by the number of their places in the vocabulary, rarest first, ties by letters (below U+0100, so two bytes); ``last`` is the rank of
    the third rarest and ``grams`` are all with that rank or less, so equal bigrams never fall on both sides of a prefix. Words go by
    a 64-bit hash, and by their letters up to CARRIED. The counts (two letters of an alphabet of 90, so at most 8,100) are broadcast.
    """
    split = vocabulary.select(F.xxhash64("word").alias("id"), F.when(F.char_length("word") <= CARRIED, F.col("word")).alias("word"), F.split("word", "").alias("chars"))
    split = split.withColumn("len", F.size("chars"))
    places = split.select("id", F.posexplode(F.expr("transform(sequence(0, len - 2), i -> concat(chars[i], chars[i + 1]))")).alias("pos", "g"))
    places = staged(places, "gram-places")
    rank = F.shiftleft("w", 16) + F.ascii("g") * 256 + F.ascii(F.substring("g", 2, 1))
    ranks = places.groupBy("g").agg(F.count(F.lit(1)).alias("w")).withColumn("rank", rank)
    ranked = places.join(F.broadcast(ranks), "g").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "w", "g", "pos"))).alias("all"))
    near = F.expr("array_sort(transform(filter(all, x -> x.rank <= last), x -> struct(x.pos, x.w, x.g)))")
    ranked = ranked.select("id", F.expr("all[2].rank").alias("last"), "all").select("id", "last", near.alias("grams"))
    return split.join(ranked, "id")


def pivots(grams: str) -> Column:
    """The two disjoint bigrams of least total weight, by dynamic programming over places from left to right.

    The state holds the last bigram, the best of those before it, and the best pair; a bigram pairs with the best that starts at least two
    places before it, and only the last one can be nearer. Three different places always hold such a pair.
    """
    better = lambda a, b: f"if({a} is null or {b}.w < {a}.w, {b}, {a})"
    none = "cast(null as struct<w:bigint,xs:array<struct<pos:int,w:bigint,g:string>>>)"
    single = "struct(x.w as w, array(x) as xs)"
    far = f"if(s.close is null or s.close.xs[0].pos > x.pos - 2, s.far, {better('s.far', 's.close')})"
    pair = f"if(f is null, s.pair, {better('s.pair', 'struct(f.w + x.w as w, concat(f.xs, array(x)) as xs)')})"
    step = f"transform(array({far}), f -> struct({pair} as pair, {better('s.far', 's.close')} as far, {single} as close))[0]"
    start = f"struct({none} as pair, {none} as far, {none} as close)"
    return F.expr(f"aggregate({grams}, {start}, (s, x) -> {step}).pair.xs")


def keys(x: Column, chars: Column, length: Column, longer: int) -> list[Column]:
    """Keys of a bigram that the edit leaves as it is, for a partner ``longer`` letters longer than this word.

    An edit behind the bigram leaves its place and the letters before it; an edit before it leaves its distance from the end and the
    letters behind it. On the edited side either the nearer or the farther half (of the partner's letters there, less one) is as it was too. ``length`` is the word's own, the
    keys hold the partner's. At most BESIDE letters of each part are taken, so a key costs the same for every word.
    """
    some = lambda start, n: F.array_join(F.slice(chars, start, n), "")
    half = lambda n: F.least(F.greatest(F.floor((n + (longer - 1)) / 2).cast("int"), F.lit(0)), F.lit(BESIDE))
    pos, behind = x["pos"], length - x["pos"] - 2
    before, after = F.least(pos, F.lit(BESIDE)), half(behind)
    left = [some(pos + 1 - before, before), pos]
    right = [some(pos + 3, F.lit(BESIDE)), behind]
    lead = half(pos)
    parts = [
        ["ln", *left, some(pos + 3, after)], ["lf", *left, some(length + 1 - after, after)],
        ["rn", *right, some(pos + 1 - lead, lead)], ["rf", *right, some(F.lit(1), lead)],
    ]
    return [F.xxhash64(F.lit(tag), x["g"], length + longer, *rest) for tag, *rest in parts]


def candidates(vocabulary: DataFrame) -> DataFrame:
    """Pairs ``a, b`` (word hashes, each pair once) among which are all words one edit apart.

    Of two words one edit apart, the two disjoint pivots of one cannot both be hit by it, and the one left belongs to the other's prefix
    wherever that prefix reaches at least as far in the order of ranks. Each word waits under its prefix and asks with its pivots. Words
    that carry their letters are compared where they meet, so that few pairs move.
    """
    known = staged(gram_prefixes(vocabulary), "gram-prefixes")
    waiting = F.transform("grams", lambda x: F.array(*keys(x, F.col("chars"), F.col("len"), 0)))
    asking = F.transform(pivots("grams"), lambda x: F.array(*[k for d in (-1, 0, 1) for k in keys(x, F.col("chars"), F.col("len"), d)]))

    def side(made: Column, i: str) -> DataFrame:
        return known.select(F.explode(F.flatten(made)).alias("key"), F.col("id").alias(i), F.col("last").alias(f"{i}_last"), F.col("word").alias(f"{i}_word"))

    met = side(asking, "x").join(side(waiting, "y"), "key").where("x != y and x_last <= y_last")
    met = met.where(F.coalesce(F.levenshtein(F.col("x_word"), F.col("y_word"), 1) == 1, F.lit(True)))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: each word with each word exactly one edit away, both ways. ``vocabulary`` is staged.

    Candidates fetch all words of their hashes and are compared by edit distance, so equal hashes lose nothing.
    """
    named = vocabulary.select(F.xxhash64("word").alias("id"), "word", "n")
    # words of one hash would never be a pair of hashes: they ask each other
    same = named.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    pairs = candidates(vocabulary).unionByName(same)
    side = lambda c: named.select(F.col("id").alias(c), F.struct("word", "n").alias(f"{c}_w"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("a_w.word != b_w.word")
    met = met.where(F.levenshtein(F.col("a_w.word"), F.col("b_w.word"), 1) == 1).select("a_w", "b_w").distinct()
    both = F.explode(F.array(F.struct(F.col("a_w").alias("x"), F.col("b_w").alias("y")), F.struct(F.col("b_w").alias("x"), F.col("a_w").alias("y"))))
    return met.select(both.alias("p")).select("p.x.word", "p.x.n", F.col("p.y.word").alias("near"), F.col("p.y.n").alias("near_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the end of the chain of forms, by doubling steps. Forms grow in frequency, so no chain is a circle."""
    at = staged(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(at.join(on, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        at = step.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for all words of at least LEAST_LETTERS letters and LEAST_COUNT occurrences.

    Words are runs of letters, A-Z lowered; a run whose CRC-32 with its document's id DELETED divides has lost a letter. A word's form is its most
    frequent near word (ties: the first in code-point order) if that is at least TIMES as frequent. Repeated rows count as often as they
    occur; columns other than ``doc_id`` and ``text`` are not read; an empty table gives no rows.
    """
    vocabulary = staged(words(docs.select("doc_id", "text")), "words")
    near = near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    out = vocabulary.join(near, "word", "left")
    good = -F.col("best.m") >= TIMES * F.col("n")
    out = out.select("word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(good, -F.col("best.m")).alias("form_n"))
    out = staged(out, "forms")
    return out.join(roots(out), "word").select("word", "form", "root", "n", "n_near", "form_n")


SQL = f"""
WITH RECURSIVE {CRC_SQL},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {crc_sql("CAST(doc_id AS VARCHAR) || ':' || run")} AS h FROM g, crc),
c AS (SELECT n, CASE WHEN h % {DELETED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (
  SELECT x.word, y.word AS near FROM d x JOIN d y ON x.v = y.v AND x.i = y.i AND x.word <> y.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.v = w.word
  UNION SELECT w.word, d.word FROM d JOIN w ON d.v = w.word
),
b AS (SELECT e.word, count(*) AS n_near, min({{'m': -w.n, 'near': e.near}}) AS best FROM e JOIN w ON w.word = e.near GROUP BY e.word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= {TIMES} * n THEN best.near END AS form, CASE WHEN -best.m >= {TIMES} * n THEN -best.m END AS form_n
  FROM w LEFT JOIN b USING (word)
),
t AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT t.word, f.form, k + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(root, k) AS root, n, n_near, form_n FROM f JOIN t USING (word) GROUP BY ALL
"""
