"""Queries of sources, sinks, labels and pictures: what is written is read again and compared with the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import normalize as nm
from ..operators import images as im
from ..operators import labels as lb
from ..operators import verdicts as vd
from ..functions import kernels as kn
from ..session import scratch, spread, table
from ..sources import binary as bn
from ..sources import corpora as cp
from .catalogue import _ALIKE, _FIRST, _READ, _SPACE, query, s_squeeze

ROWS = 1_000  # of a written part


@query("SELECT sura, aya, text, translation FROM ayat")
def src_suras(spark, d):
    """Verses landed as one answer a sura, read again."""
    item = F.struct(F.col("sura").cast("string").alias("sura"), F.col("aya").cast("string").alias("aya"), F.col("text").alias("arabic_text"), "translation")
    path = scratch(spark)
    # a verse's answer by itself: no sura is gathered in one row
    table(spark, d, "ayat").select(F.array(item).alias("result")).write.json(path)
    spark_rows = spark.read.schema("result array<struct<sura: string, aya: string, arabic_text: string, translation: string>>").json(path)
    return cp.verses_of(spark_rows).select("sura", "aya", "text", "translation")


@query("SELECT id, min(pos) AS no FROM enc_hadith GROUP BY id")
def src_ids(spark, d):
    return cp.distinct_ids(table(spark, d, "enc_hadith").select("id", F.col("pos").alias("no")))


@query(
    "SELECT id, CASE WHEN id LIKE '%7' THEN NULL ELSE 'report ' || id END AS text, id LIKE '%7' AS failed FROM (SELECT DISTINCT id FROM vectors WHERE corpus = 'hadith' AND id IS NOT NULL)"
)
def src_fetch(spark, d):
    """Ids fetched in parallel from a service that fails for some of them."""

    def fetch(number: str) -> tuple[str]:
        if number.endswith("7"):
            raise OSError("unreachable")
        return (f"report {number}",)

    ids = table(spark, d, "vectors").where("corpus = 'hadith' AND id IS NOT NULL").select("id").distinct()
    return cp.fetch_batches(ids, fetch, "text string")


@query("SELECT pos, id, text, grade, attribution, translation FROM enc_hadith")
def sink_json(spark, d):
    path = scratch(spark)
    cp.write_json(table(spark, d, "enc_hadith").select("pos", "id", "text", "grade", "attribution", "translation"), path)
    return spark.read.schema(cp.REPORT_SCHEMA).json(path)


@query("SELECT grade_id, label FROM gradelist")
def src_json_list(spark, d):
    """The list of grades, which has one size at every scale, as one JSON list."""
    path = scratch(spark)
    table(spark, d, "gradelist").agg(F.to_json(F.collect_list(F.struct("grade_id", "label")))).write.text(path)
    return cp.read_json_list(spark, f"{path}/part-*", "grade_id bigint, label string")


_PLACED = "row_number() OVER (PARTITION BY vec_id // 1000 ORDER BY vec_id) - 1"


def _read_part(df):
    return df.withColumn("part", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long")).drop("path")


def _named(parts, ending):
    return parts.withColumn("name", F.concat(F.col("part").cast("string"), F.lit(ending)))


@query(f"SELECT vec_id // 1000 AS part, {_PLACED} AS row, embedding AS vector FROM embeddings")
def sink_npy(spark, d):
    path = scratch(spark)
    parts = bn.npy_parts(table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector")), rows_a_part=ROWS)
    bn.write_files(_named(parts, ".npy"), path).agg(F.sum("size")).collect()
    return _read_part(bn.read_npy(spark, f"{path}/*.npy")).select("part", "row", "vector")


_WHOLE = "scales IS NOT NULL AND len(data) = 64 AND len(list_filter(data, lambda x: x IS NULL)) = 0"


@query(f"SELECT vec_id // 1000 AS part, {_PLACED} AS row, scales AS scale, data AS q FROM vectors WHERE {_WHOLE}")
def sink_packed(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "vectors").where("scales IS NOT NULL AND size(data) = 64 AND NOT exists(data, x -> x IS NULL)")
    parts = bn.packed_parts(rows.select(F.col("vec_id").alias("pos"), F.col("scales").alias("scale"), F.col("data").alias("q")), rows_a_part=ROWS)
    bn.write_files(_named(parts, ".bin"), path).agg(F.sum("size")).collect()
    return _read_part(bn.read_packed(spark, f"{path}/*.bin")).select("part", "row", "scale", "q")


@query(
    "SELECT id AS key, CASE WHEN sum((pos % 2 = 0)::INT) > 0 THEN max(CASE WHEN pos % 2 = 0 THEN coalesce(grade, '') END) ELSE max(coalesce(text, '')) END AS value FROM enc_hadith WHERE id IS NOT NULL GROUP BY id"
)
def sink_store(spark, d):
    """Reports put under their id, then the grades of some: the last put counts."""
    path = scratch(spark)
    rows = table(spark, d, "enc_hadith").where("id IS NOT NULL")
    bn.put(rows.select(F.col("id").alias("key"), F.coalesce("text", F.lit("")).alias("value")), path)
    bn.put(rows.where("pos % 2 = 0").select(F.col("id").alias("key"), F.coalesce("grade", F.lit("")).alias("value")), path)
    return bn.get(spark, path)


_KIND = "CASE WHEN s >= 0.99 THEN 'hadith_authentic' WHEN s >= 0.72 THEN 'different_wording' END"
_LABELS = "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{v[0]}'" for k, v in lb.KINDS.items() if k in ("hadith_authentic", "different_wording")) + " END"
_LABELS_EN = "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{v[1]}'" for k, v in lb.KINDS.items() if k in ("hadith_authentic", "different_wording")) + " END"


@query(f"SELECT row_id, kind, {_LABELS} AS label, {_LABELS_EN} AS label_en FROM (SELECT row_id, {_KIND} AS kind FROM (SELECT row_id, {_ALIKE} AS s FROM {_READ}))")
def verdict_reports(spark, d):
    t = table(spark, d, "evaluate").where("text IS NOT NULL AND ocr IS NOT NULL")
    s = t.select("row_id", nm.fold_any_script("text").alias("a"), nm.fold_any_script("ocr").alias("b")).withColumn("kind", vd.report_kind(kn.similarity("a", "b")))
    return s.select("row_id", "kind", lb.label("kind").alias("label"), lb.label("kind", "en").alias("label_en"))


_URL = "replace(replace(replace(replace(replace(replace(url_encode({0}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*'), '%7E', '~')"


@query(f"SELECT rec_id, 'https://hadeethenc.com/ar/browse/hadith/' || id AS page, 'https://dorar.net/hadith/search?q=' || {_URL.format(_FIRST)} AS search FROM enc_hadith")
def card_links(spark, d):
    return table(spark, d, "enc_hadith").select("rec_id", lb.report_url("id").alias("page"), lb.rulings_url("text").alias("search"))


@query(
    "SELECT row_id, replace(array_to_string(list_filter(list_transform(string_split(ocr, chr(10)), lambda l: " + s_squeeze("l")
    + r"), lambda x: length(regexp_replace(x, '[^\x{621}-\x{64a}]', '', 'g')) >= 3), chr(10)), chr(10), ' ') AS line FROM evaluate WHERE ocr IS NOT NULL"
)
def norm_join_lines(spark, d):
    return table(spark, d, "evaluate").where("ocr IS NOT NULL").select("row_id", nm.join_lines("ocr").alias("line"))


_GREY = f"SELECT vec_id, list_transform(data, lambda x: x::INTEGER + 128) AS g FROM vectors WHERE {_WHOLE}"
_SPREAD_OUT = "list_transform(g, lambda x: greatest(0, least(255, round_even((x - list_min(g)) * 255 / greatest(1, list_max(g) - list_min(g)), 0)))::INTEGER)"
_BETWEEN = (
    "list_transform(range(0, 256), lambda t: CASE WHEN len(list_filter(g, lambda x: x <= t)) IN (0, 64) THEN 0.0 ELSE "
    "len(list_filter(g, lambda x: x <= t)) * len(list_filter(g, lambda x: x > t)) * "
    "pow(list_avg(list_filter(g, lambda x: x <= t)) - list_avg(list_filter(g, lambda x: x > t)), 2) END)"
)


@query(
    f"SELECT vec_id, {_SPREAD_OUT} AS stretched, list_sort(g)[33] < 128 AS inverted, "
    f"CASE WHEN list_max(b) > 0 THEN list_position(list_transform(b, lambda x: x >= list_max(b) * (1 - 1e-12)), true) - 1 ELSE 128 END::INTEGER AS level FROM (SELECT *, {_BETWEEN} AS b FROM ({_GREY}))"
)
def pic_levels(spark, d):
    """Rows of vectors as grey pictures of eight by eight: contrast, polarity and threshold."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for q in b["data"]:
                grey = (np.asarray(q, dtype=np.int16) + 128).astype(np.uint8).reshape(8, 8)
                out.append((im.stretch(grey).ravel().astype(np.int32), bool((im.dark_on_light(grey) != grey).any()), im.otsu(grey)))
            yield pd.DataFrame({"vec_id": b["vec_id"], "stretched": [o[0] for o in out], "inverted": [o[1] for o in out], "level": [o[2] for o in out]})

    rows = spread(table(spark, d, "vectors").where("scales IS NOT NULL AND size(data) = 64 AND NOT exists(data, x -> x IS NULL)").select("vec_id", "data"))
    return rows.mapInPandas(run, "vec_id long, stretched array<int>, inverted boolean, level int")
