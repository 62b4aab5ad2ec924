"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into BUCKETS counters. One pass over the whole
corpus counts them for all documents and for the trusted target (documents
labelled quality = 1). A bucket's weight is the log ratio of its smoothed
probability in the target multinomial and in the raw multinomial; the target
leaves out the half of the documents, by hash, that the scored one belongs to. A document's
score is the mean weight of its words and pairs; it is kept when the score
reaches the threshold, the middle between the first percentile of the labelled
good documents and the last percentile of the labelled bad ones, or the former where that is less. Everything is
built from DataFrame functions.

Defined results: null and empty texts have no words, so they fail the base
rules; repeated rows are judged each; extra columns are ignored; an empty table
gives an empty result; without labels of both kinds the threshold is zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import join_checked, located, staged

BUCKETS = 1 << 16
SMOOTHING = 0.5
WINDOW = 5
MIN_WORDS = 10
EDGE = 0.01
FOLDS = 2
SPACE = r"[\x20\x09-\x0D]+"
#: The counts of every document, in the order of the result.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def with_repeated_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in windows of WINDOW words that occur twice or more.

    Equal hashes select the texts to look at; in these the windows themselves
    are sorted (not compared in pairs) and equal neighbours marked. Each step is
    a column of its own, so that it is computed once and not per element.
    """
    words, codes = F.col("words"), F.col("codes")
    count = F.size(words) - (WINDOW - 1)
    at = F.sequence(F.lit(0), count - 1)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(WINDOW)]))
    df = df.withColumn("has_repeat", F.when(count >= 2, F.size(F.array_distinct(hashes)) < count).otherwise(F.lit(False)))
    windows = F.array_sort(F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i"))))
    df = df.withColumn("windows", F.when(F.col("has_repeat"), windows).cast("array<struct<w:string,i:int>>"))
    same = lambda x, j: F.coalesce(F.get("windows", j)["w"] == x["w"], F.lit(False))
    df = df.withColumn("marked", F.transform("windows", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])))
    total = F.aggregate(
        F.array_sort(F.filter("marked", lambda i: i.isNotNull())),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("has_repeat", "windows", "marked")


def codes_of(words: Column) -> Column:
    """One hash per word; windows and pairs hash these."""
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(codes: Column) -> Column:
    """Bucket numbers of all words and all pairs of neighbours, from the word hashes."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    single = F.transform(codes, lambda h: bucket(h))
    pair = F.transform(F.sequence(F.lit(1), F.size(codes) - 1), lambda i: bucket(F.xxhash64(F.get(codes, i - 1), F.get(codes, i))))
    return F.when(F.size(codes) > 1, F.concat(single, pair)).otherwise(single)


def base_counts(text: Column, words: Column) -> list[Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words"),
    ]


def fold() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")


def weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, w): BUCKETS rows at most, counted over all documents; w[f] is the weight for documents of fold f.

    The target of fold f leaves the fold's own documents out, so that a labelled
    document is scored as an unlabelled one would be.
    """
    good = staged(labels.where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(1).cast("long")), "quality-good")
    # the labelled ids are small and broadcast; past the bound the plain texts are dealt by id, not their words
    marked = join_checked(docs.select("doc_id", "text"), good, ["doc_id"], "left", 32).withColumn("fold", F.coalesce(fold(), F.lit(0)))
    targets = [F.when((F.col("good") == 1) & (F.col("fold") != f), 1).otherwise(0).cast("long").alias(f"target{f}") for f in range(FOLDS)]
    words = marked.select(*targets, words_of(F.col("text")).alias("words"))
    codes = words.select(*[f"target{f}" for f in range(FOLDS)], codes_of(F.col("words")).alias("codes"))
    rows = codes.select(*[f"target{f}" for f in range(FOLDS)], F.explode(grams(F.col("codes"))).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("raw"), *[F.sum(f"target{f}").alias(f"target{f}") for f in range(FOLDS)])
    counts = staged(counts, "quality-counts")
    totals = counts.agg(F.sum("raw").alias("raws"), *[F.sum(f"target{f}").alias(f"targets{f}") for f in range(FOLDS)])
    share = lambda n, total: (F.col(n) + SMOOTHING) / (F.col(total) + SMOOTHING * BUCKETS)
    ratio = lambda f: F.log(share(f"target{f}", f"targets{f}")) - F.log(share("raw", "raws"))
    weight = F.array(*[F.when(F.col(f"targets{f}") > 0, ratio(f)).otherwise(F.lit(0.0)) for f in range(FOLDS)])
    return counts.crossJoin(F.broadcast(totals)).select("bucket", weight.alias("w"))


def scored(docs: DataFrame, labels: DataFrame, place: list[str]) -> DataFrame:
    """(file, at, doc_id, *BASE, score): one row per row of docs; the columns `place` of docs tell its rows."""
    docs = docs.select(F.col(place[0]).alias("file"), F.col(place[1]).alias("at"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = F.broadcast(staged(weights(docs, labels), "quality-weights"))  # BUCKETS rows of some 50 bytes at most
    words = docs.withColumn("words", words_of(F.col("text"))).withColumn("codes", codes_of(F.col("words")))
    # the counts are columns below the explode, so that they are computed per document
    counted = with_repeated_words(words).select("file", "at", "doc_id", "codes", *base_counts(F.col("text"), F.col("words")))
    flat = counted.select("file", "at", "doc_id", *BASE, F.explode_outer(grams(F.col("codes"))).alias("bucket"))
    # the rows of a document follow each other in one task, so nearly all is summed before the shuffle
    summed = flat.join(table, "bucket", "left").groupBy("file", "at", "doc_id", *BASE).agg(F.round(F.avg(F.get("w", F.coalesce(fold(), F.lit(0)))), 9).alias("score"))
    return staged(summed, "quality-scores")


def threshold(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with the column threshold."""
    known = scores.join(labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id").where("score IS NOT NULL")
    # scores rounded to three places are a histogram of bounded size
    bars = known.groupBy("quality", F.round("score", 3).alias("bar")).agg(F.count("*").alias("n"))
    good, bad = F.when(F.col("quality") == 1, F.col("bar")), F.when(F.col("quality") == 0, F.col("bar"))
    stats = bars.agg(F.percentile(good, F.lit(EDGE), F.col("n")).alias("good"), F.percentile(bad, F.lit(1 - EDGE), F.col("n")).alias("bad"))
    return stats.select(F.coalesce(F.least("good", (F.col("good") + F.col("bad")) / 2), F.lit(0.0)).alias("threshold"))


def judged(docs: DataFrame, labels: DataFrame, place: list[str] | None = None) -> DataFrame:
    """(file, at, doc_id, *BASE, base_failed, kept, score, threshold); the columns `place` of docs, if given, tell its rows."""
    if place is None:
        docs, place = located(docs.select("doc_id", "text"), "quality-rows")
    scores = scored(docs, labels, place)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    both = scores.crossJoin(F.broadcast(threshold(scores, labels))).withColumn("base_failed", failed)
    return both.select("file", "at", "doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.coalesce("score", F.lit(0.0)) >= F.col("threshold"))).alias("kept"), "score", "threshold")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("file", "at", "threshold")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go.

    Null and empty texts fail the base rules and go; repeated rows are judged each; a null document id has
    no label; extra columns stay as they are; an empty table stays empty.
    """
    rows, place = located(docs, "quality-rows")
    scores = judged(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), place)
    kept = staged(scores.where("kept").select(F.col("file").alias(place[0]), F.col("at").alias(place[1])), "quality-kept")
    return join_checked(rows, kept, place, "left_semi", 24).drop(*place)


QUERIES = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}
