"""Evaluation of readings against their truth, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import partial_ratio_udf
from ..functions.normalize import fold_any_script
from ..session import keep_apart
from .candidates import inverted_index, shared_grams

# The slices of the report.
SLICES = {
    "all": "true",
    "decorative": "decorative",
    "plain": "NOT decorative",
    "heldout": "heldout",
    "photo": "kind = 'photo'",
    "card": "kind = 'card'",
    "vowelled": "vowelled AND lang = 'ar'",
}
NEAR_PERFECT = 0.10


def score_report(rows: DataFrame, by: str = "lang") -> DataFrame:
    """(by, slice, n, accuracy, near_perfect, found_share) over overlapping slices, in one aggregation.

    Accuracy is 100 * (1 - mean of error rates, capped at 1). Rows without an error rate
    count in n only; a slice without rows has n 0 and nulls.
    """
    sums = []
    for name, test in SLICES.items():
        inside = F.coalesce(F.expr(test), F.lit(False))
        rate = F.when(inside & F.col("cer").isNotNull(), F.least(F.lit(1.0), F.col("cer")))
        sums += [
            F.sum(inside.cast("long")).alias(f"{name}_n"),
            (100 * (1 - F.avg(rate))).alias(f"{name}_accuracy"),
            F.avg(F.when(inside, (F.col("cer") <= NEAR_PERFECT).cast("double"))).alias(f"{name}_near"),
            F.avg(F.when(inside, F.col("found").cast("double"))).alias(f"{name}_found"),
        ]
    wide = rows.groupBy(by).agg(*sums)
    entries = [F.struct(F.lit(n).alias("slice"), *[F.col(f"{n}_{c}").alias(a) for c, a in (("n", "n"), ("accuracy", "accuracy"), ("near", "near_perfect"), ("found", "found_share"))]) for n in SLICES]
    return wide.select(by, F.explode(F.array(*entries)).alias("s")).select(by, "s.*")


def source_found(rows: DataFrame, corpus: DataFrame, row: str = "row_id", truth: str = "text", read: str = "ocr", rivals: int = 5, least: float = 0.8) -> DataFrame:
    """M3: (row, true_ratio, rival_ratio, found): whether a reading points to its own source rather than to another record.

    A reading of eight characters at least is compared with its truth and with the
    ``rivals`` records of the corpus (pos, text) that share most 4-grams with it and are
    long enough; it is found at 80 % of the truth if no rival of another text does better.
    """
    base = rows.select(F.col(row).alias("row"), fold_any_script(truth).alias("truth"), fold_any_script(read).alias("got")).where(F.length("got") >= 8)
    others = corpus.select("pos", fold_any_script("text").alias("skeleton")).where("skeleton IS NOT NULL")
    counted = shared_grams(base.select(F.col("row").alias("query"), F.col("got").alias("skeleton")), inverted_index(others))
    long = counted.join(others, "pos").join(base.select(F.col("row").alias("query"), "got", "truth"), "query")
    long = long.where((F.length("skeleton") >= least * F.length("got")) & (F.col("skeleton") != F.col("truth")))
    order = Window.partitionBy("query").orderBy(F.desc("n"), "first", "pos")
    near = long.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rivals)
    near = keep_apart(near, "query", "pos").withColumn("ratio", partial_ratio_udf("got", "skeleton"))
    best = near.groupBy(F.col("query").alias("row")).agg(F.max("ratio").alias("rival_ratio"))
    own = base.withColumn("true_ratio", partial_ratio_udf("got", "truth"))
    out = own.join(best, "row", "left")
    found = (F.col("true_ratio") >= 0.8) & (F.col("true_ratio") >= F.coalesce("rival_ratio", F.lit(0.0)))
    return out.select(F.col("row").alias(row), "true_ratio", "rival_ratio", found.alias("found"))


def modulo_split(rows: DataFrame, key: str, every: int = 10, at: int = 3) -> DataFrame:
    """The column ``split``: ``test`` where the key's remainder is ``at``, else ``train``; a null key trains."""
    test = F.pmod(F.col(key), F.lit(every)) == at
    return rows.withColumn("split", F.when(test, "test").otherwise("train"))


def one_per_family(rows: DataFrame, family: str = "family", file: str = "font", order: str = "row_id") -> DataFrame:
    """(family, file): the last file with Regular in its name, else the first file of each family."""
    regular = F.contains(F.col(file), F.lit("Regular"))
    last = F.max_by(file, F.when(regular, F.col(order)))
    return rows.groupBy(family).agg(F.coalesce(last, F.min_by(file, order)).alias(file))


def seeded_order(key: Column | str, seed: int = 0) -> Column:
    """A number by which rows are shuffled alike in every run."""
    return F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit(seed))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn by hash of the key: a top-n per task, merged."""
    return rows.orderBy(seeded_order(key, seed), key).limit(n)


def histogram(rows: DataFrame, value: str, bins: int = 256, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, n) of values in equal bins; values outside fall into the first and last one, nulls are left out."""
    width = (high - low) / bins
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width).cast("int")))
    return rows.where(F.col(value).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def lower_quantile(rows: DataFrame, by: str, value: str, share: float = 0.9) -> DataFrame:
    """(by, quantile): the value at place floor(share * (n - 1)) of each group, exact, by distributed counts of values."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(by).orderBy(value)
    placed = counted.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    return placed.where(F.col("upto") > F.floor(share * (F.col("n") - 1))).groupBy(by).agg(F.min(value).alias("quantile"))
