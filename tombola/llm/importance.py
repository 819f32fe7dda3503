"""Importance resampling towards a target distribution.

Every text is a bag of features, the runs of 1 to `longest` consecutive words,
and a feature falls into one of `buckets` by its CRC-32. A bucket's gain is the
logarithm of how much more likely the target texts hold it than the documents
do, both smoothed by one. The gains of a document's features add up to its weight;
a pseudo-random Gumbel number that depends on its id alone is added, and the highest
scores are drawn, which is sampling without replacement by weight.

All of it is SQL: features are exploded and counted a bucket, where partial
aggregates leave a row a bucket and task; the table of gains has `buckets` rows
whatever the data, so it is broadcast; a document's sum is a partial aggregate
too, as its features are exploded by one task. Ranks come from a range sort, with
the number of documents in all ranges before added.

Rows that are equal in id and text are one row with its number of copies until they
are dealt out again, so a group of copies of any size is no hot key.

Nulls: a null text has no words, a null id has the noise of an empty one and is the last of
a tie. Repeated rows are documents of their own. Ties go to the smaller id, then
(rows of one id) to the smaller hash of the text. A text without words weighs
0. A very long text is exploded by one task as a stream. Only id and text are
read, so other columns may have any name. Without target texts gains only say
how rare a bucket is. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, running, shuffle_partitions

#: What stands between words (A-Z counts as letters here: it is lowered later).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: So many copies of one row are dealt out by one task.
COPY_RUN = 1_000


def words(text: Column) -> Column:
    """A text's words, A-Z as they stand."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def features(found: Column, longest: int) -> Column:
    """The runs of 1 to `longest` words, joined by spaces."""
    if longest == 1:
        return found

    def of(w: Column, k: int) -> Column:
        starts = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]))  # slice() would copy all words

    # The words are a variable, so that they aren't split anew for every run.
    runs = lambda w: F.concat(w, *[of(w, k) for k in range(2, longest + 1)])
    return F.flatten(F.transform(F.array(found), runs))


def bucket(feature: Column, buckets: int) -> Column:
    """Lowers A-Z alone: a feature of ASCII only by the faster way."""
    low = F.when(F.length(feature) == F.octet_length(feature), F.lower(feature)).otherwise(ascii_lower(feature))
    return (F.crc32(low.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, into: str, *, text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket and the number of features in it."""
    each = texts.select(F.explode(features(words(F.col(f"`{text}`")), longest)).alias("feature"))
    return each.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias(into))


def gains(docs: DataFrame, target: DataFrame, *, text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """A row for each bucket: its gain in thousandths, rounded down."""
    options = {"text": text, "longest": longest, "buckets": buckets}
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counted = every.join(bucket_counts(docs, "s", **options), "bucket", "left").join(bucket_counts(target, "t", **options), "bucket", "left")
    counted = cut(counted.na.fill(0, ["s", "t"]))  # a row a bucket
    all_s, all_t = counted.agg(F.sum("s"), F.sum("t")).head()
    share = ((F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    return counted.select("bucket", F.floor(F.lit(1000.0) * F.ln(share)).cast("long").alias("gain"))


def noise(key: Column, seed: int) -> Column:
    """A Gumbel number in thousandths, rounded down, made of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, table: DataFrame, *, key: str = "doc_id", text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """key, one and two (the text's hash), n_words, copies, n_features and weight:
    one row for all rows of an id and a text."""
    raw = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(raw).alias("one"), F.xxhash64(F.lit(1), raw).alias("two"), words(raw).alias("words"))
    # The null before a row's features stands for the row itself.
    each = F.explode(F.concat(F.array(F.lit(None).cast("string")), features(F.col("words"), longest))).alias("feature")
    rows = rows.select("key", "one", "two", F.size("words").cast("long").alias("n_words"), each).withColumn("bucket", bucket(F.col("feature"), buckets))
    rows = rows.join(F.broadcast(table), "bucket", "left").groupBy("key", "one", "two", "n_words")
    rows = rows.agg(F.count_if(F.col("feature").isNull()).alias("copies"), F.count("feature").alias("found"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    return rows.select("key", "one", "two", "n_words", "copies", F.expr("found div copies").alias("n_features"), F.expr("total div copies").alias("weight"))


def resampled(
    docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", longest: int = 1, buckets: int = 10_000,
    least_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """One row a document: key, n_features, weight, score, and the rank if it is
    among the drawn `percent` of those with `least_words` words or more."""
    options = {"text": text, "longest": longest, "buckets": buckets}
    rows = weighed(docs, gains(docs, target, **options), key=key, **options)
    rows = cut(rows.withColumn("score", F.col("weight") + noise(F.col("key"), seed)))
    enough = F.col("n_words") >= least_words
    drawn = percent * (rows.where(enough).agg(F.sum("copies")).head()[0] or 0) // 100
    order = [F.desc("score"), F.col("key").asc_nulls_last(), F.asc("one"), F.asc("two")]
    ranked = running(rows.where(enough), order, ["copies"]).withColumnRenamed("before_copies", "ahead").drop("place")
    rows = cut(ranked.unionByName(rows.where(~enough).withColumn("ahead", F.lit(None).cast("long"))))
    many = rows.where("copies > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPY_RUN}"))))
    many = many.repartition(shuffle_partitions(docs.sparkSession), "key", "one", "two", "part")
    nth = F.explode(F.sequence(F.col("part") * COPY_RUN, F.least((F.col("part") + 1) * COPY_RUN, F.col("copies")) - 1)).alias("nth")
    many = many.select("*", nth).withColumn("ahead", F.col("ahead") + F.col("nth")).select(*rows.columns)
    out = rows.where("copies = 1").unionByName(many)
    return out.select(F.col("key").alias(key), "n_features", "weight", "score", F.when(F.col("ahead") < drawn, F.col("ahead") + 1).alias("rank"))


def op11(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resampled(docs, benchmark)


#: The same in SQL, which has no CRC-32: it is folded over the bytes of every
#: distinct word, by a table made from the polynomial.
OP11_SQL = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS step),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
w AS (SELECT r, unnest(words) AS word FROM d),
known AS (SELECT DISTINCT word FROM (SELECT word FROM w UNION ALL SELECT word FROM b)),
coded AS (
  SELECT word, xor(list_reduce(
      list_transform(range(CAST(strlen(word) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)),
      lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM known, steps),
s AS (SELECT bucket, count(*) AS s FROM w JOIN coded USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN coded USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000e0 * ln(
      (CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM w) + 10000 AS DOUBLE))
      / (CAST(s + 1 AS DOUBLE) * CAST((SELECT count(*) FROM b) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT r, sum(gain) AS weight FROM w JOIN coded USING (word) JOIN g USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000e0 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM ranked) THEN place END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""
