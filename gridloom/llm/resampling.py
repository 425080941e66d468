"""Importance resampling towards a target distribution by hashed n-grams, with a dictionary of the distinct features.

Features are runs of consecutive words. All occurrences are counted by string over the whole corpus and the whole target; each distinct
string is hashed once into its bucket and the counts are summed by bucket. A bucket's gain is the (smoothed) log ratio of target to corpus,
in thousandths. The gains then go back to the features that each document holds: a document's weight is the sum over its feature counts.
With a Gumbel number of each document's id added to the weight, the documents with the highest scores are a weighted draw without replacement.

Features that make up at least one part in ``HEAVY`` of all occurrences, of which there can't be more than ``HEAVY``, go to the tasks
that read the documents; only the rest is joined by a shuffle, so no key of that join holds more rows than that part.

Null texts have no words; a document without features has weight 0. Rows with the same id and text share weight and score and
are ranked one after the other. Ids may be null (an empty text takes their place in the hash; last in ties). An empty table gives an empty one, an empty target
still gives gains. Columns of the input may have any names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_stored, stored
from gridloom.llm.words import Tally, ngrams, small_batches, strings, words
from gridloom.operators.ordering import numbered

BUCKETS, SMOOTH, THOUSAND = 10_000, 1, 1000
#: Features of at most this many bytes and at least one part in this many of all occurrences go to every task: at most 10 MB.
HEAVY, HEAVY_BYTES = 50_000, 200


def _counted(low: int, high: int):
    """Counts by feature, summed up within a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(1)

        def rows() -> Iterator[pa.RecordBatch]:
            for _, features, (n,) in tally.take():
                yield pa.RecordBatch.from_arrays([strings(features), pa.array(n, pa.int64())], ["feature", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                tally.add(0, (), ngrams(words(text), low, high))
            if tally.full():
                yield from rows()
        yield from rows()

    return count


def dictionary(docs: DataFrame, target: DataFrame, *, text: str = "text", low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Columns feature, n_docs, n_target and bucket, one row for each distinct feature of either side."""
    side = lambda df, d, t: df.select(F.col(text).cast("binary").alias("text")).mapInArrow(_counted(low, high), "feature string, n long").select("feature", (F.col("n") * d).alias("d"), (F.col("n") * t).alias("t"))
    every = side(docs, 1, 0).unionByName(side(target, 0, 1)).groupBy("feature").agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_target"))
    return every.withColumn("bucket", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int"))


def bucket_gains(features: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Columns bucket and gain (at most ``buckets`` rows), and the number of all feature occurrences of the documents."""
    by_bucket = stored(features.groupBy("bucket").agg(F.sum("n_docs").alias("s"), F.sum("n_target").alias("t")), "buckets")
    total = by_bucket.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    all_s, all_t = total["s"] or 0, total["t"] or 0
    double = lambda c: F.col(c).cast("double")
    ratio = ((double("t") + SMOOTH) * F.lit(float(all_s + buckets))) / ((double("s") + SMOOTH) * F.lit(float(all_t + buckets)))
    return by_bucket.select("bucket", F.floor(THOUSAND * F.log(ratio)).alias("gain")), all_s


def _weighed(heavy: dict[bytes, int], low: int, high: int):
    """For each document its numbers of words and features, the weight of its heavy features, and the others with their counts."""
    fields = pa.list_(pa.struct([("feature", pa.string()), ("n", pa.int64())]))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(2).to_pylist():
                found = words(text)
                features = Counter(ngrams(found, low, high))
                out[0].append(len(found))
                out[1].append(features.total())
                out[2].append(sum(n * heavy[f] for f, n in features.items() if f in heavy))
                out[3].append([{"feature": f.decode("utf-8", "surrogatepass"), "n": n} for f, n in features.items() if f not in heavy])
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], fields)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "of", "n_words", "n_features", "weight", "light"])

    return weigh


def weights(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Columns key, n_words, n_features and weight, one row for each document; a written table."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    with small_batches(spark):
        features = stored(dictionary(docs, target, text=text, low=low, high=high, buckets=buckets), "features")
        gains, total = bucket_gains(features, buckets)
        # At most ``buckets`` rows, which are a parameter.
        valued = features.where("n_docs > 0").join(F.broadcast(gains), "bucket").select("feature", "n_docs", "gain")
        is_heavy = (F.col("n_docs") * HEAVY >= F.lit(total)) & (F.octet_length("feature") <= HEAVY_BYTES)
        # At most HEAVY rows, for their counts add up to the total at most.
        heavy = {r["feature"].encode("utf-8", "surrogatepass"): r["gain"] for r in valued.where(is_heavy).select("feature", "gain").collect()}
        rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("of"), F.col(text).cast("binary").alias("text"))
        held = stored(rows.mapInArrow(_weighed(heavy, low, high), f"key {kind}, of long, n_words long, n_features long, weight long, light array<struct<feature:string,n:long>>"), "weighed")
    light = held.select("key", "of", F.explode("light").alias("f")).select("key", "of", "f.*").join(valued.where(~is_heavy), "feature")
    numbers = held.select("key", "of", "n_words", "n_features", "weight", F.lit(1).alias("copies"))
    none = F.lit(0).cast("long")
    both = numbers.unionByName(light.select("key", "of", none.alias("n_words"), none.alias("n_features"), (F.col("n") * F.col("gain")).alias("weight"), F.lit(0).alias("copies")))
    whole = both.groupBy("key", "of").agg(F.max("n_words").alias("n_words"), F.sum("n_features").alias("n"), F.sum("weight").alias("weight"), F.sum("copies").alias("copies"))
    # Rows with the same id and text were summed up together: each has its share.
    each = whole.select("key", "n_words", F.expr("n div copies").alias("n_features"), F.expr("weight div copies").alias("weight"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    out = stored(each, "weights")
    for t in (features, held):
        drop_stored(t)
    return out


def gumbel(key: Column, seed: int) -> Column:
    """A Gumbel number of an id in thousandths, from the first 32 bits of the digest of ``<seed>:<id>``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(THOUSAND)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 10, least_words: int = 20, seed: int = 2024, **features: int) -> DataFrame:
    """Every document with n_features, weight, score and rank: of those with ``least_words`` words, ``percent`` hundredths are drawn and ranked from 1."""
    scored = weights(docs, target, key=key, text=text, **features).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed))
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = math.floor(percent * fit.count() / 100)
    columns = [F.col("key").alias(key), "n_features", "weight", "score"]
    ranked = numbered(fit, [F.desc("score"), F.asc_nulls_last("key")], "rank", start=1).select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
