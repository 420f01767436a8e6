"""Operator 12: phrases whose words occur together more often than their parts do.

Texts are cut into pieces at punctuation and line ends and into words at blanks. All n-grams of
a piece, of one length after another, become rows that are counted by language; a phrase seen too
rarely can neither be a candidate nor a part of one, so only the rest is kept. Cutting a candidate
in two gives its score from the counts of both parts, in exact decimals; the lowest-scoring cut
counts. A candidate goes if a phrase one word longer that has it is at least about as frequent: any
longer candidate that could drop it has such a phrase inside, which is as frequent or more.

Null texts are empty, null languages ``und``; texts without words add nothing. Repeated rows count
as often as they occur. Equal scores are ranked by count and then by the phrase's bytes. Very long
texts are read whole. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphaudit.llm.common import Scratch, release

#: Characters that end a piece.
ENDS = ".,;:!?\n\x0b\x0c\r"
#: Counts as decimals: with 15 digits (10^15 words) a count's square times a million has 37 digits at most.
_COUNT, _MILLION = "decimal(15,0)", "decimal(7,0)"


def pieces(docs: DataFrame) -> DataFrame:
    """``lang, words`` for each piece. Generators are outer ones, for which no filter is inferred that would cut each text once more."""
    flat = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase + ENDS + "\t", string.ascii_lowercase + "\n" * len(ENDS) + " ")
    cut = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode_outer(F.split(flat, "\n")).alias("piece"))
    return cut.where("piece <> ''").select("lang", F.array_remove(F.split("piece", " "), "").alias("words"))


def ngrams(pieces: DataFrame, n: int) -> DataFrame:
    """``lang, phrase``: the n-grams of word lists, joined by blanks. Without functions of a lambda, all is generated code."""
    placed = pieces.select("lang", "words", F.posexplode_outer("words").alias("at", "first")).where(F.col("at") + n <= F.size("words"))
    rest = [c for i in range(1, n) for c in (F.lit(" "), F.get("words", F.col("at") + i))]
    return placed.select("lang", F.concat("first", *rest).alias("phrase"))


def counts(docs: DataFrame, n: int) -> DataFrame:
    """``lang, phrase, f`` of all n-grams. Every task adds up its own before rows move."""
    return ngrams(pieces(docs), n).groupBy("lang", "phrase").agg(F.count("*").alias("f"))


def _cut(phrase: Column, k: int) -> tuple[Column, Column]:
    """The first k words, and the rest."""
    first = F.substring_index(phrase, " ", k)
    return first, F.substring(phrase, F.length(first) + 2, F.length(phrase))


def scored(frequent: DataFrame, max_n: int) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of the candidates, by their lowest-scoring cut."""
    cuts = [F.struct(F.lit(k).alias("k"), *[c.alias(name) for c, name in zip(_cut(F.col("phrase"), k), ("first", "rest"), strict=True)]) for k in range(1, max_n)]
    candidates = frequent.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.filter(F.array(*cuts), lambda c: c["k"] < F.col("words"))).alias("cut")).select("lang", "phrase", "words", "a", "cut.*")
    parts = frequent.where(F.col("words") < max_n)
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = candidates.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr(f"(CAST(a AS {_COUNT}) * CAST(a AS {_COUNT}) * CAST(1000000 AS {_MILLION})) DIV (CAST(l AS {_COUNT}) * CAST(r AS {_COUNT}))")
    lowest = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def mine(docs: DataFrame, max_n: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    words = scratch.put(counts(docs, 1), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least).withColumn("words", F.lit(1))
    # A length at a time, so that the disk holds the shuffle of one.
    for n in range(2, max_n + 1):
        release(spark, rounds=3, wait=1.0)
        frequent = frequent.unionByName(scratch.put(counts(docs, n).where(F.col("f") >= least), f"grams{n}").withColumn("words", F.lit(n)))
    release(spark, rounds=3, wait=1.0)
    longer = frequent.where("words > 2").select("lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    longest = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = scored(frequent, max_n).alias("c").join(longest.alias("e"), (F.col("c.lang") == F.col("e.lang")) & (F.col("c.phrase") == F.col("e.phrase")) & (F.col("e.f") * 100 >= F.col("c.a") * share), "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def sql(least: int = 10, share: int = 50, top: int = 2000) -> str:
    """The same in DuckDB for phrases of up to three words."""
    score = "(1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f)"
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS x FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda y: y <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {least}),
cut AS (SELECT lang, k, phrase, a, j, array_to_string(ws[:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y FROM c, (SELECT unnest([1, 2]) AS j) WHERE j < k),
s AS (SELECT cut.lang, cut.phrase, a, min({{'score': ({score})::BIGINT, 'j': j, 'l': l.f, 'r': r.f}}) AS best
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y GROUP BY ALL),
kept AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c e WHERE e.lang = s.lang AND e.k = 3 AND (array_to_string(e.ws[:2], ' ') = s.phrase OR array_to_string(e.ws[2:], ' ') = s.phrase) AND 100 * e.a >= {share} * s.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, phrase) AS rank, phrase, a, best.l AS l, best.r AS r, n, best.score AS score FROM kept JOIN t USING (lang) QUALIFY rank <= {top}"""
