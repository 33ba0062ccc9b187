"""Candidate retrieval: an inverted index of character 4-grams.

A corpus of a measured, bounded size is held by every task as sorted arrays, so queries
are not shuffled; a larger one is cut into shards, each held by the tasks that search it.
Both give the same rows. Grams are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 4
JUDGED = 10_000  # pairs that are judged together
Judge = Callable[[list[str], list[str]], np.ndarray]  # which pairs of a query's and a record's text, in the form it judges, go on
HELD_LETTERS = 10_000_000  # letters of a corpus whose index is sent to every task: 12 bytes a letter at most, some 30 while the driver builds it
SHARD_LETTERS = 6_000_000  # letters of a shard, about: its index is built by each task that searches it


def grams(text: Column | str, n: int = GRAM) -> Column:
    """the distinct character n-grams; none if the text is shorter.

    Gathered by one regular expression per offset, which is linear in the text's length.
    """
    c = F.col(text) if isinstance(text, str) else text
    runs = [F.regexp_extract_all(F.substring(c, k, 2**31 - 1), F.lit(f"(?s).{{{n}}}"), F.lit(0)) for k in range(1, n + 1)]
    return F.array_distinct(F.concat(*runs))


def placed_grams(text: Column | str, n: int = GRAM) -> Column:
    """The n-grams with the place of their first occurrence, as structs (gram, at)."""
    c = F.col(text) if isinstance(text, str) else text

    def run(k: int) -> Column:
        found = F.regexp_extract_all(F.substring(c, k + 1, 2**31 - 1), F.lit(f"(?s).{{{n}}}"), F.lit(0))
        return F.transform(found, lambda g, i: F.struct(g.alias("gram"), (i * n + k).alias("at")))

    return F.concat(*map(run, range(n)))


def inverted_index(corpus: DataFrame, key: str = "pos", text: str = "skeleton") -> DataFrame:
    """(gram, key): the records in which each gram occurs."""
    return corpus.select(F.explode(grams(text)).alias("gram"), F.col(key))


def shared_grams(queries: DataFrame, index: DataFrame, query: str = "query", key: str = "pos", text: str = "skeleton") -> DataFrame:
    """(query, key, n, first): distinct grams shared with each record and the place of the first one in the query.

    A gram that occurs in much of the corpus is split by AQE's skew join; both sides are
    counted before anything else is joined.
    """
    asked = queries.select(F.col(query), F.explode(placed_grams(text)).alias("g")).groupBy(query, F.col("g.gram").alias("gram")).agg(F.min("g.at").alias("at"))
    return asked.join(index, "gram").groupBy(query, key).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


def top_candidates(counted: DataFrame, least: int, k: int, query: str = "query", key: str = "pos") -> DataFrame:
    """Per query the k records with most shared grams, ``least`` at least.

    Ties go to the record met by the earliest gram of the query, then to the smaller key.
    """
    order = Window.partitionBy(query).orderBy(F.desc("n"), "first", key)
    ranked = counted.where(F.col("n") >= least).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def with_extras(candidates: DataFrame, extras: DataFrame, corpus: DataFrame, query: str = "query", key: str = "pos") -> DataFrame:
    """Candidates followed by semantic extras that are in the corpus, each key once, at its first rank."""
    last = candidates.select(query, key, "rank")
    known = extras.join(corpus.select(key).distinct(), key, "left_semi")
    later = known.select(query, key, (F.col("rank") + 1_000_000).alias("rank"))
    return last.unionByName(later).groupBy(query, key).agg(F.min("rank").alias("rank"))


def positions_of(ids: DataFrame, corpus: DataFrame, id_: str = "id", pos: str = "pos") -> DataFrame:
    """The last position of each id in the corpus, -1 where it has none."""
    last = corpus.groupBy(id_).agg(F.max(pos).alias("found"))
    return ids.join(last, id_, "left").select(*ids.columns, F.coalesce("found", F.lit(-1)).alias("position"))


def neighbours(
    corpus: DataFrame, before: int = 2, after: int = 3, same: str | None = None, pos: str = "pos", carry: str | None = None
) -> DataFrame:
    """Each position with the records from ``before`` places before to ``after`` places after it.

    (pos, window): structs (pos, skeleton, and ``carry`` if given) in order. With ``same``
    (the service profile) only neighbours with an equal value stay. An equi-join on
    shifted positions: no global window, so it distributes.
    """
    columns = list(dict.fromkeys([pos, "skeleton", *filter(None, [same, carry])]))
    base = corpus.select(*columns)
    shifts = F.explode(F.sequence(F.lit(-after), F.lit(before)))
    spread = base.select(*columns, shifts.alias("shift")).withColumn("center", F.col(pos) + F.col("shift"))
    centers = corpus.select(F.col(pos).alias("center"), *([F.col(same).alias("wanted")] if same else []))
    joined = spread.join(centers, "center")
    if same:
        joined = joined.where(F.col(same).eqNullSafe(F.col("wanted")))
    window = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), "skeleton", *filter(None, [carry])))).alias("window")
    return joined.groupBy("center").agg(window).withColumnRenamed("center", pos)


def running_offset(corpus: DataFrame, pos: str = "pos", text: str = "skeleton", partitions: int | None = None) -> DataFrame:
    """The characters before each record in corpus order, as two sums: within ranges of positions and over ranges.

    Ranges are cut at quantiles of the position; only one number a range is summed in order.
    """
    n = partitions or corpus.sparkSession.sparkContext.defaultParallelism
    cuts = corpus.select(F.percentile_approx(pos, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + F.when(F.col(pos) > c, 1).otherwise(0)
    sized = corpus.withColumn("_part", part).withColumn("_size", F.coalesce(F.length(text), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    totals = sized.groupBy("_part").agg(F.sum("_size").alias("_total"))
    before = totals.alias("a").join(totals.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b._total"), F.lit(0)).alias("_before"))
    joined = sized.join(F.broadcast(before), "_part")  # one row a range
    offset = F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    return joined.withColumn("offset", offset).drop("_part", "_size", "_before")


class GramIndex:
    """The records in which each gram occurs, as sorted arrays: grams, where their lists begin, and the lists."""

    def __init__(self, keys: np.ndarray, texts: list[str], judged: list[str] | None = None):
        self.keys = keys
        self.texts = judged  # in the judge's form, if there is one
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.letters = np.flatnonzero(np.bincount(codes)) if len(codes) else np.zeros(0, np.int64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        gram, at = self._grams((np.searchsorted(self.letters, codes) + 1).astype(np.int16), sizes)
        del codes
        order = np.argsort(gram, kind="stable")  # texts stay in order within a gram
        gram, at = gram[order], at[order]
        del order
        new, other = np.ones(len(gram), bool), np.ones(len(gram), bool)
        new[1:], other[1:] = gram[1:] != gram[:-1], at[1:] != at[:-1]
        other |= new
        self.grams, self.lists = gram[new], at[other]
        self.begin = np.r_[np.flatnonzero(new[other]), len(self.lists)]
        self.sizes = np.bincount(self.lists, minlength=len(keys))

    @staticmethod
    def _grams(letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(grams as numbers, text of each): of texts whose letters, as numbers below 2**15, stand in a row."""
        n = len(letters) - GRAM + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        gram = np.zeros(n, dtype=np.int64)
        for k in range(GRAM):
            gram <<= 15
            gram |= letters[k : n + k]
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        inside = text[:n] == text[GRAM - 1 : n + GRAM - 1]
        return gram[inside], text[:n][inside]

    def near(self, text: str, least: int, k: int | None, part: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(records, shared grams, place of the first), the best ``k`` first: by shared grams, the earliest of them, and the key."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        place = np.minimum(np.searchsorted(self.letters, codes), max(len(self.letters) - 1, 0))
        known = np.where(self.letters[place] == codes, place + 1, 0) if len(self.letters) else np.zeros(len(codes), np.int64)
        gram, first = np.unique(self._grams(known, np.array([len(codes)]))[0], return_index=True)
        if k is None:
            every = len({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
        at = np.minimum(np.searchsorted(self.grams, gram), max(len(self.grams) - 1, 0))
        ok = self.grams[at] == gram if len(self.grams) else np.zeros(len(gram), bool)
        order = np.argsort(first[ok])
        at, first = at[ok][order], first[ok][order]
        many = self.begin[at + 1] - self.begin[at]
        met = self.lists[np.repeat(self.begin[at] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        counts = np.bincount(met, minlength=len(self.keys))
        found = np.flatnonzero(counts >= max(least, 1))
        if part:
            found = found[counts[found] >= part * np.minimum(self.sizes[found], every)]
        n = counts[found]
        if k is not None and len(found) > k:
            cut = np.partition(n, len(n) - k)[len(n) - k]
            found, n = found[n >= cut], n[n >= cut]
        earliest = np.zeros(len(self.keys), dtype=np.int64)
        earliest[met[::-1]] = np.repeat(first, many)[::-1]  # the last write, the first gram, stays
        best = np.lexsort((self.keys[found], earliest[found], -n))[:k]
        return found[best], n[best], earliest[found[best]]

    def rows(self, query: pa.Array, texts: pa.Array, least: int, k: int | None, part: float, judge: Judge | None = None, judged: pa.Array | None = None) -> pa.RecordBatch:
        """``near`` of a column of texts as rows (query, key, n, first, rank); of those that ``judge`` leaves, if given.

        ``judged``: the queries' texts in the judge's form, if that is another one.
        """
        found = [self.near(t, least, k, part) for t in texts.to_pylist()]
        if judge:
            asked, many = (texts if judged is None else judged).to_pylist(), np.array([len(f[0]) for f in found], dtype=np.int64)
            pairs = ((t, self.texts[i]) for t, f in zip(asked, found) for i in f[0])
            parts = [judge(*map(list, zip(*some))) for some in batched(pairs, JUDGED)]
            kept = np.split(np.concatenate(parts), np.cumsum(many)[:-1]) if parts else [np.zeros(0, bool)] * len(found)
            found = [tuple(c[ok] for c in f) for f, ok in zip(found, kept)]
        many = np.array([len(f[0]) for f in found], dtype=np.int64)
        at, n, first = (np.concatenate(c).astype(np.int64) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        rank = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + 1
        asked = query.take(pa.array(np.repeat(np.arange(len(many)), many)))
        cols = [asked, pa.array(self.keys[at]), pa.array(n), pa.array(first.astype(np.int32)), pa.array(rank.astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=["query", "key", "n", "first", "rank"])


def in_shards(queries: DataFrame, corpus: DataFrame, shards: int, least: int, k: int | None, part: float, judge: Judge | None = None) -> DataFrame:
    """(query, key, n, first, rank) of queries (query, text) in each shard of a corpus (key, text): ``GramIndex.near`` of every shard.

    Both have ``judged`` as well where the judge takes another form of the texts.

    A task has one shard and a share of the queries; shards are searched by several tasks
    where there are fewer of them than cores. Only texts are shuffled: the corpus once for
    each share, the queries once for each shard.
    """
    kind = queries.schema["query"].dataType.simpleString()
    shares = max(1, -(-2 * queries.sparkSession.sparkContext.defaultParallelism // shards))
    shard, share = F.pmod(F.xxhash64("key"), F.lit(shards)), F.pmod(F.xxhash64("query"), F.lit(shares))
    texts = [c for c in ("text", "judged") if c in corpus.columns]
    held = corpus.select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), shard.alias("shard"), F.lit(None).cast(kind).alias("query"), "key", *texts)
    asked = queries.select(share.alias("share"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query", F.lit(None).cast("long").alias("key"), *texts)
    both = held.unionByName(asked).withColumn("slot", (F.col("shard") * shares + F.col("share")).cast("int"))
    both = both.select("slot", "query", "key", *texts).repartitionById(shards * shares, "slot").sortWithinPartitions(F.col("key").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, told, index = [], {c: [] for c in texts}, None  # the records come first
        for b in batches:
            of_corpus = b.column("key").is_valid()
            records = b.filter(of_corpus)
            keys += records.column("key").to_pylist()
            for c in texts:
                told[c] += records.column(c).to_pylist()
            b = b.filter(pc.invert(of_corpus))
            if b.num_rows:
                index = index or GramIndex(np.array(keys, dtype=np.int64), told["text"], told[texts[-1]] if judge else None)
                told = {c: [] for c in texts}
                for at in range(0, b.num_rows, 1000):
                    few = b.slice(at, 1000)
                    yield index.rows(few.column("query"), few.column("text"), least, k, part, judge, few.column(texts[-1]))

    return both.mapInArrow(run, f"query {kind}, key long, n long, first int, rank int")


def retrieve(
    queries: DataFrame, corpus: DataFrame, least: int, k: int | None, part: float = 0.0, held_letters: int | None = None,
    query: str = "query", key: str = "pos", text: str = "skeleton", shard_letters: int | None = None,
    judge: Judge | None = None, judged: str | None = None, letters: int | None = None,
) -> DataFrame:
    """(query, key, n, rank): per query the ``k`` records with most shared grams, ``least`` at least.

    Ties go to the record met by the earliest gram of the query, then to the smaller key.
    With ``k`` null all such records come, of those that share ``part`` of the grams of the
    text that has fewer; rank is then null. A corpus of more than ``held_letters`` is
    searched in shards of about ``shard_letters``. ``judge`` sees each found pair where it
    is found, so that those it drops are never sent; it goes with null ``k`` and takes the
    column ``judged`` of both sides, if that is given. ``letters``: those of the corpus or
    some more, where a measure of ``text`` itself, or a look at its length, would compute it
    once more; ``text`` has no nulls then.
    """
    other = [F.col(judged).alias("judged")] if judge and judged else []
    rows = (corpus.where(F.length(text) >= GRAM) if letters is None else corpus).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *other)
    size = letters if letters is not None else rows.agg(F.sum(F.length("text"))).first()[0] or 0
    kind, target = queries.schema[query].dataType.simpleString(), corpus.schema[key].dataType.simpleString()
    asked = queries.where(F.length(text) >= GRAM).select(F.col(query).alias("query"), F.col(text).alias("text"), *other)
    told = [F.col("query").alias(query), F.col("key").cast(target).alias(key), "n"]
    rank = F.col("rank") if k is not None else F.lit(None).cast("int").alias("rank")
    if size > (HELD_LETTERS if held_letters is None else held_letters):
        found = in_shards(asked, rows, -(-size // (shard_letters or SHARD_LETTERS)), least, k, part, judge)
        # a record of the best of all shards is among the best of its own
        return (found if k is None else top_candidates(found, least, k, key="key")).select(*told, rank)
    records = rows.toArrow()  # held_letters at most
    shown = records.column(records.column_names[-1]).to_pylist() if judge else None
    held = queries.sparkSession.sparkContext.broadcast(GramIndex(records.column("key").to_numpy(), records.column("text").to_pylist(), shown))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield held.value.rows(b.column("query"), b.column("text"), least, k, part, judge, b.column(b.num_columns - 1))

    return asked.mapInArrow(run, f"query {kind}, key long, n long, first int, rank int").select(*told, rank)
