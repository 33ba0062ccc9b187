"""Problem 7: mixing sources to target weights by capped water-filling.

A source that would need more than its cap is clamped at it; what it leaves goes to the
others in proportion to their weights, until none is over its cap. Each record is then
used a whole number of times, and a seeded part of a source's records once more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .encode import count_tokens

BITS = 12  # of the hash, per level of the search for a source's last record


@dataclass
class Share:
    source: str
    weight: float  # of all weights of sources that are there
    size: int  # tokens of its records
    cap: int
    tokens: float = 0.0  # what it is given
    clamped: bool = False
    asked: float = 0.0  # the weight as listed

    @property
    def rate(self) -> float:
        return self.tokens / self.size if self.size else 0.0


def water_fill(shares: list[Share], total: float) -> None:
    """Distribute ``total`` over the sources by weight, none above ``cap * size``."""
    open_ = [s for s in shares if s.weight > 0 and s.size > 0 and s.cap > 0]
    left = float(total)
    while open_:
        weights = sum(s.weight for s in open_)
        over = [s for s in open_ if left * s.weight / weights >= s.cap * s.size]
        if not over:
            for s in open_:
                s.tokens = left * s.weight / weights
            return
        for s in over:
            s.tokens, s.clamped = float(s.cap * s.size), True
            left -= s.tokens
        open_ = [s for s in open_ if not s.clamped]


class Mixture:
    """A mixture of ``documents`` by ``targets`` (source, weight, max_repeats).

    - A null, negative or NaN weight counts as 0; several rows of one source add up their
      weights and take the largest cap; a null cap counts as 1, one below 1 bars the source.
    - Records of sources without a target, and of source null, are left out.
    - A source that is absent from the documents has share 0; the others take its weight.
    - Records of null or empty text have no tokens and follow their source's rate.
    - ``total`` is in tokens; by default all tokens of the listed sources. If every source
      is clamped, the mixture is smaller than that.
    - One record a row: repeated ``doc_id`` are records of their own, used alike.
    """

    def __init__(
        self, documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0,
        doc_id: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str | None = None,
    ):
        self.spark, self.seed = documents.sparkSession, seed
        weight = F.greatest(F.coalesce(F.nanvl(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
        listed = (
            targets.where("source IS NOT NULL").groupBy("source")
            .agg(F.sum(weight).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
        )
        rows = listed.collect()  # a row a source
        names = self.spark.createDataFrame([(r.source,) for r in rows], "source string")
        slim = documents.select(
            F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")
        )
        counted = count_tokens(slim.join(F.broadcast(names), "source", "left_semi"), "text", "n_tokens", vocabulary)
        key = F.xxhash64("doc_id", F.lit(seed))
        self.records = cut(counted.select("doc_id", "source", "n_tokens", key.alias("key")))
        sizes = {r.source: r.n for r in self.records.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        there = sum(r.weight for r in rows if sizes.get(r.source))
        self.shares = [
            Share(r.source, r.weight / there if there and sizes.get(r.source) else 0.0, sizes.get(r.source, 0), int(r.cap), asked=float(r.weight))
            for r in sorted(rows, key=lambda r: r.source)
        ]
        water_fill(self.shares, sum(sizes.values()) if total is None else total)
        self.plan = cut(self._thresholds())

    def _bucket(self, level: int):
        return F.shiftrightunsigned("key", 64 - BITS * (level + 1)).bitwiseAND(2**BITS - 1)

    def _edges(self, records: DataFrame, level: int, need: DataFrame) -> DataFrame:
        """(source, b, rest): the hash bucket in which a source's ``need`` is used up, and what is left of it there.

        At most ``2**BITS`` sums a source are put in order, each source's by themselves.
        """
        sums = records.groupBy("source", self._bucket(level).alias("b")).agg(F.sum("n_tokens").alias("n")).join(need, "source")
        run = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("b")))
        rest = F.col("need") - (F.col("upto") - F.col("n"))
        first = run.where(F.col("upto") > F.col("need") + 1e-6).groupBy("source").agg(F.min_by(F.struct("b", rest.alias("rest")), "b").alias("x"))
        told = need.join(first, "source", "left")
        return told.select("source", F.coalesce("x.b", F.lit(2**BITS - 1)).cast("long").alias("b"), F.coalesce("x.rest", F.lit(0.0)).alias("rest"))

    def _thresholds(self) -> DataFrame:
        """(source, b1, b2, rest, whole, cap): how far in hash order a source's records are used once more."""
        rows = [(s.source, s.tokens - int(s.rate + 1e-12) * s.size, int(s.rate + 1e-12), s.cap) for s in self.shares]
        wanted = self.spark.createDataFrame(rows, "source string, need double, whole long, cap long")
        one = cut(self._edges(self.records, 0, wanted.select("source", "need")))
        inside = self.records.join(one, "source").where(self._bucket(0) == F.col("b")).drop("b", "rest")
        two = self._edges(inside, 1, one.select("source", F.col("rest").alias("need")))
        edges = one.select("source", F.col("b").alias("b1")).join(two.select("source", F.col("b").alias("b2"), "rest"), "source")
        return wanted.drop("need").join(edges, "source")

    def records_used(self) -> DataFrame:
        """(doc_id, source, n_tokens, repeats): every record of a listed source and how often it is used, 0 included."""
        b1, b2 = self._bucket(0), self._bucket(1)
        placed = self.records.join(self.plan, "source").withColumn(
            "place",
            F.when((b1 < F.col("b1")) | ((b1 == F.col("b1")) & (b2 < F.col("b2"))), -1)
            .when((b1 == F.col("b1")) & (b2 == F.col("b2")), 0).otherwise(1),
        )
        used = placed.where("place <> 0").select("doc_id", "source", "n_tokens", "whole", "cap", (F.col("place") < 0).alias("more"))
        # the last bucket, one of 2**(2 * BITS) of a source's hashes, is cut record by record
        window = "sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING)"
        last = placed.where("place = 0").withColumn("run", F.expr(window))
        last = last.select("doc_id", "source", "n_tokens", "whole", "cap", (F.col("run") <= F.col("rest") + 1e-6).alias("more"))
        repeats = F.least(F.col("whole") + F.col("more").cast("long"), F.greatest("cap", F.lit(0)))
        return used.unionByName(last).select("doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats"))

    def report(self) -> DataFrame:
        """(source, asked, weight, size, max_repeats, clamped, tokens, share): targets and the actual shares, one row a source.

        ``asked`` is the weight as listed, ``weight`` its part among the sources that are there.
        """
        rows = [(s.source, s.asked, s.weight, s.size, s.cap, s.clamped) for s in self.shares]
        want = self.spark.createDataFrame(rows, "source string, asked double, weight double, size long, max_repeats int, clamped boolean")
        got = self.records_used().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
        out = want.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        whole = out.agg(F.sum("tokens").alias("whole"))
        share = F.when(F.col("whole") > 0, F.col("tokens") / F.col("whole")).otherwise(0.0)
        return out.crossJoin(F.broadcast(whole)).select(*out.columns, share.alias("share"))
