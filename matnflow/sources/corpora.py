"""Corpora as files: landed answers of services, JSON lists, resumable collections, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import squeeze

VERSE_SCHEMA = "pos int, sura int, aya int, text string, translation string"
REPORT_SCHEMA = "pos int, id string, text string, grade string, attribution string, translation string"
RULING_SCHEMA = "text string, narrator string, scholar string, book string, page_or_number string, ruling string"
WHOLE = 6236  # verses of the whole book, a fixed value


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON list (one file or many) in the declared schema; an empty table where there is no file."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    """K1: one object a line, UTF-8, nothing escaped that needn't be; nulls are written as such."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_suras(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers ``{"result": [...]}``, one per sura, as verses in order."""
    item = "struct<sura: string, aya: string, arabic_text: string, translation: string>"
    return with_positions(verses_of(spark.read.schema(f"result array<{item}>").json(path, multiLine=True)), "sura", "aya")


def verses_of(answers: DataFrame) -> DataFrame:
    """(sura, aya, text, translation) of answers with an array ``result``; numbers that are none become null."""
    r = answers.select(F.explode("result").alias("r"))
    return r.select(F.expr("try_cast(r.sura AS int)").alias("sura"), F.expr("try_cast(r.aya AS int)").alias("aya"), F.col("r.arabic_text").alias("text"), F.col("r.translation").alias("translation"))


def with_positions(rows: DataFrame, *order: str) -> DataFrame:
    """Positions from 0 in the given order: ranges are sorted by themselves and shifted by the rows before them."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    from ..session import cut

    placed = cut(placed)
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_low"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    shifts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = placed.join(F.broadcast(shifts.select("_p", "_low", "_before")), "_p")
    return joined.withColumn("pos", (F.col("_i") - F.col("_low") + F.col("_before")).cast("int")).drop("_p", "_i", "_low", "_before")


def check_whole(verses: DataFrame, expected: int = WHOLE) -> DataFrame:
    """The verses, if they are as many as expected; else an error when they are read."""
    count = verses.agg(F.count(F.lit(1)).alias("n")).select(F.assert_true(F.col("n") == expected, F.concat(F.lit("rows: "), F.col("n").cast("string"))).alias("ok"))
    return verses.join(F.broadcast(count), F.col("ok").isNull()).drop("ok")


def distinct_ids(pages: DataFrame, id_: str = "id", by_number: bool = True) -> DataFrame:
    """S3: each id once, in the order of its number, or of its first occurrence (column ``no``)."""
    once = pages.groupBy(id_).agg(F.min("no").alias("no"))
    return once.orderBy(F.expr(f"try_cast({id_} AS bigint)"), id_) if by_number else once.orderBy("no")


def with_translation(reports: DataFrame, translations: DataFrame, id_: str = "id") -> DataFrame:
    """Reports with their translation, null where there is none; the first of several translations."""
    one = translations.groupBy(id_).agg(F.min("translation").alias("translation"))
    return reports.drop("translation").join(one, id_, "left")


def to_fetch(wanted: DataFrame, have: DataFrame, id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows kept, ids still to fetch): what is no longer wanted goes, what is there already is not fetched."""
    ids = wanted.select(id_).where(F.col(id_).isNotNull()).distinct()
    kept = have.join(ids, id_, "left_semi")
    return kept, ids.join(kept.select(id_).distinct(), id_, "left_anti")


def fetch_batches(todo: DataFrame, fetch, schema: str, id_: str = "id", tries: int = 2) -> DataFrame:
    """``fetch(id) -> tuple`` for each id in parallel, tried ``tries`` times; (fields..., failed).

    ``schema`` lists the fields of the tuple. An id that fails keeps its row, with nulls and failed true.
    """
    import pandas as pd
    from pyspark.sql import types as T

    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    kind = todo.schema[id_].dataType.simpleString()

    def run(parts):
        for part in parts:
            rows = []
            for i in part[id_]:
                got = None
                for _ in range(tries):
                    try:
                        got = fetch(i)
                        break
                    except Exception:  # counted as failed below
                        continue
                rows.append((i, *(got or [None] * len(names)), got is None))
            yield pd.DataFrame(rows, columns=[id_, *names, "failed"])

    return todo.select(id_).mapInPandas(run, f"{id_} {kind}, {schema}, failed boolean")


def training_texts(verses: DataFrame, reports: DataFrame) -> DataFrame:
    """(source, id, text): verses, their translations without note numbers, and reports (their first long quote, if any)."""
    key = F.concat_ws(":", "sura", "aya")
    arabic = verses.where("text IS NOT NULL").select(F.lit("quran").alias("source"), key.alias("id"), "text")
    english = verses.where("translation IS NOT NULL").select(F.lit("quran-en").alias("source"), key.alias("id"), F.trim(F.regexp_replace("translation", r"\[\d+\]", "")).alias("text"))
    quote = F.regexp_extract("text", r"«([^»]{15,})»", 1)
    told = reports.where("text IS NOT NULL").select(F.lit("hadith").alias("source"), "id", F.when(quote != "", quote).otherwise(F.col("text")).alias("text"))
    return arabic.unionByName(english).unionByName(told).where(squeeze("text") != "")


def health(**corpora: DataFrame) -> DataFrame:
    """(corpus, n): the rows of each corpus, in one job."""
    out = None
    for name, df in sorted(corpora.items()):
        one = df.agg(F.lit(name).alias("corpus"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
