"""What the operators share: table access, words, and connected components."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.workspace import store

#: A word, as a pattern of Spark's regular expressions; bytes.split() gives the same.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="leadtide-"), "leadtide.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def row_struct(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` as one column ``row`` beside copies of ``columns``.

    Names that an operator adds cannot clash with names of the input.
    """
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[df[c] for c in columns])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id``, ``component``: the smallest id reachable over undirected ``links``.

    Large-star and small-star steps until the links stop changing. Minima are combined
    before their shuffle and joined back, so a hub of many links stays splittable. Each
    round is a written table. Ids without a link are not returned.
    """
    spark = links.sparkSession
    edges = store(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    before = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).filter("u != v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.filter("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = store(small, "links")
        after = _digest(edges)
        if after == before:
            break
        before = after
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct())


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


#: Most list entries that are broadcast beside texts: 8 bytes each at most, 64 MB.
BROADCAST_ENTRIES = 8_000_000


def beside_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``found`` of the documents in ``found`` (``doc_id``, a list).

    The lists are broadcast if their counted entries are few, so that texts need no shuffle;
    beyond that both sides are shuffled by id.
    """
    size = found.agg(F.sum(F.size("found") + 4)).first()[0] or 0
    if size <= BROADCAST_ENTRIES:
        found = F.broadcast(found)
    return docs.select("doc_id", "text").join(found, "doc_id").select("doc_id", "text", "found")
