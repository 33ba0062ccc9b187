"""Problem 5: records of evaluation splits that the training split holds, exactly or almost.

An exact prefix-filter join on rare shingles between the two sides. A training text is cut
into chunks of five characters side by side: d edits break at most d of them, and what is
left whole is moved by d places at most. Its prefix, the d + 2 chunks that are rarest in the
evaluation texts, probes an index of their shingles with length and position filters; a
pair goes on if so many chunks of the prefix meet as its edits leave, and is verified by
edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import fold_any_script
from ..session import cut
from .canonical import canonicalize, wide_hash

Q = 5  # characters of a shingle; chunks then outnumber the edits of any text at a share of 0.15


def plain_id(column: Column) -> Column:
    """An id without white space and leading zeros, its digits in ASCII; null and blank ids are null."""
    digits = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９"
    t = F.translate(column, digits + "：", "0123456789" * 3 + ":")
    t = F.lower(F.regexp_replace(t, r"(?U)[\s\p{Cf}]+", ""))
    t = F.regexp_replace(t, r"(?<![0-9])0+(?=[0-9])", "")
    return F.when(t != "", t)


def most_edits(length: Column, share: float) -> Column:
    """Edits allowed between a text and the longest that it can match."""
    return F.floor(length * (share / (1 - share)) + 1e-9).cast("int")


def _bucket(length: Column, share: float) -> Column:
    """Texts that match a length lie in one bucket or in two neighbouring ones."""
    return F.floor(F.log(length) / (-2 * float(np.log(1 - share))) + 1e-9).cast("int")


def shingles(texts: DataFrame, step: int) -> DataFrame:
    """(g, id, n, at): every ``step``-th shingle of (id, n, t) and its place; the end is padded, so that last chunks count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns, grams, counts = b.column("id").to_numpy(), b.column("n").to_numpy(), [], []
            for t in b.column("t").to_pylist():
                padded = t + "\0" * (Q - 1)
                grams += [padded[i : i + Q] for i in range(0, len(t), step)]
                counts.append(-(-len(t) // step))
            counts = np.array(counts, dtype=np.int64)
            at = step * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
            cols = [pa.array(grams, pa.string()), pa.array(np.repeat(ids, counts)), pa.array(np.repeat(ns, counts)), pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["g", "id", "n", "at"])

    rows = texts.select("id", "n", "t").mapInArrow(run, "g string, id long, n int, at int")
    return rows.select(F.xxhash64("g").alias("g"), "id", "n", "at")


def near_texts(train: DataFrame, held: DataFrame, share: float) -> DataFrame:
    """(a, b): ids of different texts (id, n, t) of the two sides within ``share`` of the longer one's characters, by edits."""
    index = cut(shingles(held, 1))
    frequency = index.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    # a chunk that no evaluation text holds joins nothing, but counts among the rarest
    ranked = shingles(train, Q).join(frequency, "g", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    size = F.least(F.ceil(F.col("n") / Q).cast("int"), most_edits(F.col("n"), share) + 2)
    order = "row_number() OVER (PARTITION BY id ORDER BY df, at)"
    prefix = ranked.withColumn("size", size).withColumn("rank", F.expr(order)).where("rank <= size AND df > 0")
    # the bucket of the length in the key splits the lists of frequent shingles
    reach = F.sequence(_bucket(F.col("n") * (1 - share), share), _bucket(F.col("n") / (1 - share), share))
    probes = prefix.select("g", F.explode(reach).alias("bucket"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("at_a"), "size")
    index = index.select("g", _bucket(F.col("n"), share).alias("bucket"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("at_b"))
    edits = F.floor(F.greatest("na", "nb") * share + 1e-9).cast("int")
    met = probes.join(index, ["g", "bucket"]).where(
        (F.abs(F.col("na") - F.col("nb")) <= edits) & (F.abs(F.col("at_a") - F.col("at_b")) <= edits) & (F.col("a") != F.col("b"))
    )
    # edits break one chunk each: all others of the prefix are met
    counted = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.max(F.col("size") - edits).alias("whole"), F.max(edits).alias("most"))
    likely = counted.where("met >= whole").select("a", "b", "most")
    texts = likely.join(train.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(held.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    return texts.where(F.expr("levenshtein(ta, tb, most) >= 0")).select("a", "b")


def split_overlaps(records: DataFrame, share: float = 0.15) -> DataFrame:
    """(row_a, row_b), row_a < row_b: overlaps of one row of train with one of test or valid.

    Rows overlap by the same source and id (white space, leading zeros and the script of
    digits don't count), or by texts, in the problem-3 form and then SURVEY N8, that at
    most ``share`` of the longer one's characters set apart. Null ids, null sources and
    null or empty texts match nothing; rows of no split, or another one, are left out.
    Equal texts are one class: classes are compared and then expanded to their rows. Other
    columns are ignored.
    """
    side = F.when(F.col("split") == "train", 0).when(F.col("split").isin("test", "valid"), 1)
    slim = records.select(
        F.col("row_id").cast("long").alias("row"), side.alias("side"), "source",
        plain_id(F.col("id").cast("string")).alias("key"), F.col("text").alias("x"),
    ).where("side IS NOT NULL")
    formed = canonicalize(slim, "x", "f").withColumn("t", fold_any_script("f"))
    rows = cut(formed.select("row", "side", "source", "key", F.when(F.col("t") != "", F.col("t")).alias("t"), *wide_hash("t", "h1", "h2")))

    keyed = rows.where("source IS NOT NULL AND key IS NOT NULL").select("row", "side", "source", "key")
    a = keyed.where("side = 0").select("source", "key", F.col("row").alias("one"))
    b = keyed.where("side = 1").select("source", "key", F.col("row").alias("two"))
    same_id = a.join(b, ["source", "key"]).select("one", "two")

    classed = rows.where("t IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("row").alias("id"), F.first("t").alias("t"),
        F.max(F.expr("side = 0")).alias("in_train"), F.max(F.expr("side = 1")).alias("in_held"),
    )
    classes = cut(classed.select("h1", "h2", "id", F.length("t").alias("n"), "t", "in_train", "in_held"))
    train, held = classes.where("in_train"), classes.where("in_held")
    links = near_texts(train, held, share)
    links = links.unionByName(classes.where("in_train AND in_held").select(F.col("id").alias("a"), F.col("id").alias("b"))).distinct()
    members = rows.where("t IS NOT NULL").select("row", "side", "h1", "h2").join(classes.select("h1", "h2", "id"), ["h1", "h2"])
    one = members.where("side = 0").select(F.col("id").alias("a"), F.col("row").alias("one"))
    two = members.where("side = 1").select(F.col("id").alias("b"), F.col("row").alias("two"))
    near = links.join(one, "a").join(two, "b").select("one", "two")
    pairs = same_id.unionByName(near).where("one <> two")
    return pairs.select(F.least("one", "two").alias("row_a"), F.greatest("one", "two").alias("row_b")).distinct()


def overlap_report(records: DataFrame, share: float = 0.15) -> DataFrame:
    """(split, source, pairs, rows_hit, train_rows): overlaps per evaluation split and source; a null source is a group."""
    pairs = split_overlaps(records, share)
    held = records.where(F.col("split").isin("test", "valid")).select(F.col("row_id").alias("held"), "split", "source")
    ends = pairs.select(F.col("row_a").alias("held"), F.col("row_b").alias("train")).unionByName(
        pairs.select(F.col("row_b").alias("held"), F.col("row_a").alias("train"))
    )
    hit = ends.join(held, "held")
    # counts of distinct rows by two-step aggregation, so that one large group is spread
    per_row = hit.groupBy("split", "source", "held").agg(F.count(F.lit(1)).alias("k"))
    a = per_row.groupBy("split", "source").agg(F.sum("k").alias("pairs"), F.count(F.lit(1)).alias("rows_hit"))
    b = hit.select("split", "source", "train").distinct().groupBy("split", "source").agg(F.count(F.lit(1)).alias("train_rows"))
    same = a["split"].eqNullSafe(b["split"]) & a["source"].eqNullSafe(b["source"])
    return a.join(b, same).select(a["split"], a["source"], "pairs", "rows_hit", "train_rows")
