"""Importance resampling of documents towards a target distribution.

A feature is a word or two neighbouring words, hashed into one of a fixed number of buckets.
A bucket's gain is the scaled log ratio of its smoothed shares in the target and in the
documents. Higher-order functions make each document's array of buckets, which is never
exploded to score it: the gains are one literal array, and a document's weight is an aggregate
over its elements. So texts stay where they are read; counts of buckets, counts of
scores and the few columns of the drawn documents are all that is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Buckets of hashed features, words of the longest feature, and words that a document needs to be drawn.
BUCKETS, LONGEST, LEAST = 10_000, 2, 20
#: Percent of the eligible documents that are drawn, and the number that the noise is hashed with.
SHARE, SEED = 25, 7
#: Gains and noise are whole numbers of thousandths.
SCALE = 1000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII without letters and digits: what lies between words.
_BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z lower-cased; none of a null text."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _UPPER.lower() + " " * len(_BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def buckets_of(found: Column, buckets: int = BUCKETS, longest: int = LONGEST) -> Column:
    """The buckets of all runs of 1 to `longest` words of an array of words, repeats included."""

    def run(k: int) -> Column:
        joined = lambda w, i: F.concat(w, *(part for j in range(1, k) for part in (F.lit(" "), F.get(found, i + j))))
        first = F.slice(found, F.lit(1), F.greatest(F.size(found) - (k - 1), F.lit(0))) if k > 1 else found
        return F.transform(first, lambda w, i: F.crc32(joined(w, i)) % buckets)

    return F.concat(*(run(k) for k in range(1, longest + 1)))


def _hashed(table: DataFrame, key: str | None, buckets: int, longest: int) -> DataFrame:
    named = table.select(*([F.col(key).cast("long").alias("doc_id")] if key else []), words(F.col("text")).alias("_words"))
    return named.select(*(["doc_id"] if key else []), F.size("_words").alias("_n_words"), buckets_of(F.col("_words"), buckets, longest).alias("_buckets"))


def _counts(hashed: DataFrame, name: str) -> DataFrame:
    # an outer explode: from another one a filter is inferred that makes the buckets again
    each = hashed.select(F.explode_outer("_buckets").alias("bucket"))
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias(name)).where("bucket is not null")


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """The gain of every bucket: floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), in doubles.

    docs and target need a column text; s and t are the features of a bucket, S and T all of them.
    Two counts a bucket are shuffled, and one number a bucket, however many rows there are, goes to the driver.
    """
    s, t = (_counts(_hashed(x, None, buckets, longest), n) for x, n in ((docs, "s"), (target, "t")))
    both = stored(docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"]))
    of = {k: F.col(k).cast("double") for k in ("s", "t")}
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (of["t"] + 1) * F.lit(float(total["s"] + buckets)) / ((of["s"] + 1) * F.lit(float(total["t"] + buckets)))
    found = both.select("bucket", F.floor(F.log(ratio) * SCALE).cast("long").alias("gain")).collect()
    return [r["gain"] for r in sorted(found, key=lambda r: r["bucket"])]


def scores(docs: DataFrame, target: DataFrame, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs(doc_id, text), all long.

    The weight is the floored mean of the gains over a document's features (none: 0). The score adds
    Gumbel noise from the first 32 bits of the SHA-256 of `seed:doc_id`, so that the highest
    scores are a draw without replacement by exp(weight / 1000).
    """
    literal = F.split(F.lit(",".join(map(str, gains(docs, target, buckets, longest)))), ",").cast("array<bigint>")
    total = F.aggregate("_buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.get(literal, b))
    summed = _hashed(docs, "doc_id", buckets, longest).select("doc_id", F.col("_n_words").cast("long").alias("n_words"), F.size("_buckets").cast("long").alias("n_features"), total.alias("_sum"))
    n = F.col("n_features")
    # whole numbers all the way, so that no rounding can lift a mean over the next one
    weight = F.when(n == 0, F.lit(0).cast("long")).otherwise(F.expr("(_sum - pmod(_sum, n_features)) div n_features"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * SCALE).cast("long")
    return summed.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_features, weight, score, rank, all long.

    Of the N documents with at least `least` words the floor(share * N / 100) highest scores are drawn and ranked from
    1, ties to the smaller doc_id, then to fewer features; a null doc_id is the smallest. rank is null for the others.
    Null and empty texts have no words: weight 0, never drawn if `least` is above 0. Rows of one doc_id are documents of their own;
    equal rows are ranked one after another. Empty tables give an empty result, an empty target equal gains but for
    the documents' counts. Other columns are ignored. Jobs run while the result is declared.
    """
    spark = docs.sparkSession
    scored = stored(scores(docs, target, seed, buckets, longest).withColumn("_row", F.monotonically_increasing_id()))
    eligible = F.col("n_words") >= least
    take = scored.where(eligible).count() * share // 100
    nobody = F.lit(None).cast("long")
    columns = ["doc_id", "n_features", "weight", "score"]
    if not take:
        return scored.select(*columns, nobody.alias("rank"))
    # one row a distinct score: whole thousandths of logarithms of counts, some 100,000 at most, whatever the table's size
    levels = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    reached = levels.select("score", F.sum("n").over(Window.orderBy(F.desc("score"))).alias("n"))
    cut = reached.where(F.col("n") >= take).agg(F.max("score").alias("score")).first()["score"]
    near = eligible & (F.col("score") >= cut)
    # the row number last: rows that are equal in all else are spread over partitions too
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("_row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(scored.where(near).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # one row a partition
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.col("_before") + within + 1
    ranked = placed.join(F.broadcast(before), part == F.col("_part")).select(*columns, F.when(rank <= take, rank).alias("rank"))
    return ranked.unionByName(scored.where(~near).select(*columns, nobody.alias("rank")))
