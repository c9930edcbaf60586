"""Queries over scalar functions: bytes, paths, sizes, time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import arith, octets
from trackloom.operators import containers
from trackloom.plans.catalog import query
from trackloom.sources import views
from trackloom.sources.views import SAMPLES, table

BUCKETS = [1000, 2500, 5000]


@query("rounding_functions", f"""
    SELECT track_id, idx, ((size * 3 + 3) // 7)::bigint AS rounded, ((size * 3 + 6) // 7)::bigint AS up, (size + 15) // 16 * 16 AS aligned, size + size % 2 AS even, (dts * 30 + 500) // 1000 AS ms30 FROM {SAMPLES}""")
def rounding_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("size").cast("long")
    return views.samples(spark, sf_dir).select(
        "track_id", "idx", arith.round_divide(size, 3, 7).alias("rounded"), arith.ceil_divide(size, 3, 7).alias("up"), arith.align_shift(size, 4).cast("int").alias("aligned"), arith.even(F.col("size")).alias("even"),
        arith.round_divide(F.col("dts"), 30, 1000).alias("ms30"),
    )


@query("size_statistics", f"""
    SELECT type, floor(median(size))::bigint AS middle, (sum(size) // count(*))::bigint AS mean, round(var_pop(size), 6) AS variance, round(stddev_pop(size), 6) AS deviation FROM {SAMPLES} GROUP BY type""")
def size_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).groupBy("type").agg(
        arith.whole_median("size").alias("middle"), arith.whole_mean("size").alias("mean"), F.round(arith.variance("size"), 6).alias("variance"), F.round(arith.std_dev("size"), 6).alias("deviation")
    )


@query("pad_bucket", """
    SELECT doc_id, size, (CASE WHEN size < 1000 THEN 1000 - size WHEN size > 1000 AND size < 2500 THEN 2500 - size WHEN size > 2500 AND size < 5000 THEN 5000 - size
        WHEN size > 5000 THEN (2500 - (size - 5000) % 2500) % 2500 ELSE 0 END)::bigint AS pad, (CASE WHEN size < 1000 THEN 1000 - size ELSE 0 END)::bigint AS lone
    FROM (SELECT doc_id, strlen(text)::bigint AS size FROM documents)""")
def pad_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return sized.withColumns({"pad": arith.padding(F.col("size"), BUCKETS), "lone": arith.padding(F.col("size"), BUCKETS[:1])})


@query("magic_sniff", """
    SELECT kind, count(*) AS n FROM (SELECT CASE WHEN starts_with(html, '<!DOC') THEN 'unknown' WHEN starts_with(html, 'BM') THEN 'bmp' WHEN starts_with(html, 'G') THEN 'mp2ts' ELSE 'unknown' END AS kind FROM pages
        UNION ALL SELECT CASE WHEN starts_with(text, 'BM') THEN 'bmp' WHEN starts_with(text, 'GIF8') THEN 'gif' WHEN starts_with(text, 'G') THEN 'mp2ts' ELSE 'unknown' END FROM documents) GROUP BY kind""")
def magic_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = table(spark, sf_dir, "pages").select(F.encode("html", "utf-8").alias("c")).unionAll(table(spark, sf_dir, "documents").select(F.encode("text", "utf-8")))
    return payloads.groupBy(octets.sniff(F.col("c")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("path_parts", r"""
    WITH p AS (SELECT doc_id AS file_id, '/in/' || source || '/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mp4.ts' WHEN 2 THEN '.mov' WHEN 3 THEN '.x.ts' ELSE '.webm' END AS path FROM documents)
    SELECT file_id, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '\.([^./]*)$', 1)) AS ext, regexp_replace(path, '\.[^./]*$', '') AS stem, regexp_replace(path, '/[^/]*$', '') AS parent,
        CASE WHEN contains(path, '.mp4') OR contains(path, '.mov') THEN 'mp4' WHEN contains(path, '.ts') THEN 'mp2ts' WHEN contains(path, '.webm') THEN 'webm' ELSE 'unknown' END AS output FROM p""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/in/"), "source", F.lit("/"), "doc_id", F.element_at(F.array(*map(F.lit, (".MP4", ".mp4.ts", ".mov", ".x.ts", ".webm"))), (F.col("doc_id") % 5 + 1).cast("int")))
    named = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"))
    p = F.col("path")
    return named.select("file_id", octets.file_name(p).alias("name"), octets.extension(p).alias("ext"), octets.without_extension(p).alias("stem"), octets.parent(p).alias("parent"), octets.output_kind(p).alias("output"))


@query("image_delay_pts", """
    WITH d AS (SELECT conv_id, turn, (CASE WHEN length(text) % 97 < 20 THEN 100 ELSE least(length(text), 5000) END)::bigint AS delay FROM conversations)
    SELECT conv_id, turn, delay, coalesce(sum(delay) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS pts FROM d""")
def image_delay_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("idx"), F.length("text").alias("n"))
    delay = F.when(F.col("n") % 97 < 20, 0).otherwise(F.greatest(F.col("n"), F.lit(20)))
    return containers.frame_times(turns, delay, ["conv_id"]).select("conv_id", "turn", "delay", "pts")


@query("output_sizes", """
    WITH o AS (SELECT o_orderkey, (100 + o_orderkey % 1900) AS w, (100 + o_custkey % 1000) AS h, o_orderkey % 4 AS turn, (o_orderkey % 3) * 360 AS t FROM orders),
    s AS (SELECT *, CASE WHEN t = 0 THEN w ELSE (w * t + least(w, h) // 2) // least(w, h) END AS a, CASE WHEN t = 0 THEN h ELSE (h * t + least(w, h) // 2) // least(w, h) END AS b FROM o)
    SELECT o_orderkey, CASE WHEN turn % 2 = 1 THEN b ELSE a END AS w2, CASE WHEN turn % 2 = 1 THEN a ELSE b END AS h2, least(a, b) AS side,
        CASE WHEN least(w, h) <= 480 THEN 'baseline' WHEN least(w, h) <= 720 THEN 'main' ELSE 'high' END AS profile FROM s""")
def output_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1900 + 100).alias("w"), (F.col("o_custkey") % 1000 + 100).alias("h"), (F.col("o_orderkey") % 4).alias("turn"), (F.col("o_orderkey") % 3 * 360).alias("t"))
    w, h = arith.output_size(F.col("w"), F.col("h"), F.col("t"), F.col("turn"))
    side, _ = arith.output_size(F.col("w"), F.col("h"), F.col("t"), F.col("turn"), square=True)
    return sizes.select("o_orderkey", w.alias("w2"), h.alias("h2"), side.alias("side"), arith.h264_profile(F.col("w"), F.col("h")).alias("profile"))


@query("mono_mix", """
    SELECT vec_id, array_to_string([greatest(-32768, least(32767, floor(embedding[2 * k + 1]::double * 65536)::int + floor(embedding[2 * k + 2]::double * 65536)::int)) FOR k IN range(32)], ',') AS mono FROM embeddings""")
def mono_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = F.transform("embedding", lambda v: F.floor(v.cast("double") * 65536).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(containers.mono(sound).cast("array<string>"), ",").alias("mono"))
