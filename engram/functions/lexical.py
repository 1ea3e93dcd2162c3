"""Tokens, postings and BM25 as DataFrame expressions. Statistics are of the whole corpus; a filter restricts scored rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.session import materialise

K1, B = 1.2, 0.75
# fixed values: the stop words
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the to was were will with this these those i you we they not no but if then than so do does did".split()
# fixed values: what ends a token, and what joins the parts of one
_SPLIT, _JOINTS, _JOINT = r"[^\p{L}\p{N}_.\-/:@]+", r"[._\-/:@]+", "._-/:@"


def tokenize(text: Column) -> Column:
    """Lower-case tokens without stop words; a compound such as ``api/v2`` is followed by its parts of two letters or more."""
    raw = F.transform(F.split(F.lower(text), _SPLIT), lambda t: F.btrim(t, F.lit(_JOINT)))
    words = F.filter(raw, lambda t: (t != "") & ~t.isin(STOP_WORDS))
    parts = lambda t: F.filter(F.split(t, _JOINTS), lambda p: (F.length(p) > 1) & ~p.isin(STOP_WORDS))
    compound = lambda t: F.translate(t, _JOINT, "") != t
    whole = F.flatten(F.transform(words, lambda t: F.when(compound(t), F.concat(F.array(t), parts(t))).otherwise(F.array(t))))
    return F.when(F.exists(words, compound), whole).otherwise(words)


def tokenized(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.col(text).isNotNull() & (F.col(text) != "")).withColumn("tokens", tokenize(F.col(text)))


def postings(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, term, tf) of non-empty texts."""
    return tokenized(df, text).select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(df: DataFrame, query: str, k: int | None = None, allow: Column | None = None, key: str = "id", text: str = "text") -> DataFrame:
    """(key, score) of the rows that hold a query term, best first; ties by key.

    Texts are tokenised once: each row's length and its matches of the query's few terms are written to the shared folder,
    and the corpus statistics, document frequencies and scores are taken from there.
    """
    spark = df.sparkSession
    terms = [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(tokenize(F.lit(query)))).alias("t")).collect()]
    if not terms:
        return df.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    base = tokenized(df, text).withColumn("allowed", allow if allow is not None else F.lit(True))
    base = materialise(base.select(key, "allowed", F.size("tokens").cast("double").alias("len"), F.filter("tokens", lambda t: t.isin(terms)).alias("hits")), "hits")
    stats = base.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avgdl"))
    rows = base.where(F.size("hits") > 0).select(key, "len", "allowed", F.explode("hits").alias("term"))
    tf = rows.groupBy(key, "len", "allowed", "term").agg(F.count("*").cast("double").alias("tf"))
    found = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    scored = tf.where("allowed").join(F.broadcast(found), "term").crossJoin(F.broadcast(stats))  # a row per term, a row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    ranked = scored.groupBy(key).agg(F.sum(weight).alias("score"))
    return ranked if k is None else ranked.orderBy(F.col("score").desc(), key).limit(k)
