"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. The first four return the columns
of documents; the last returns the encoded corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accountlens.llm import bpe, langid, mixing, quality, simhash
from accountlens.llm.queries import table
from accountlens.llm.storage import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go. Learned from all of ``documents`` and ``labels`` but the held-out rows."""
    net = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, net)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: those without a letter, and those that cost far more bits a letter than the language's own rows."""
    samples = langid.learn(docs)
    return langid.keep(docs, samples, langid.learn_limits(docs, samples))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. Shingles of five words, a similarity of 0.8 or more."""
    return simhash.keep_first(docs, words=5, radius=3, least=0.8)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mixture of sources weighted by the roots of their sizes; slots of finished sources are passed over."""
    mixed = mixing.mix(docs, mixing.tempered_weights(docs, 0.5))
    return mixed.orderBy("slot", "place").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus in the order of docs, that of the mixture: ids of every document, checksums of ids and decoded bytes, position (documents before it) and start (ids before it).

    The order is read from the files that the stage before wrote: their names, then the
    rows of each. Encoded rows are kept once; sums over the files say where each begins.
    """
    placed = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        docs.select(*placed).schema  # noqa: B018
    except AnalysisException:  # no files: the rows as they come
        placed = [F.format_string("%010d", F.spark_partition_id()).alias("file"), F.monotonically_increasing_id().alias("row")]
    marked = docs.select(F.struct("doc_id", *placed).alias("_at"), "text")
    encoded = written(bpe.round_trip(marked, public_tokenizers.path("byte_bpe_50k.tiktoken"), id_col="_at"), "encoded").select("_at.*", "n_tokens", "ids_sha256", "decoded_sha256")
    sums = encoded.groupBy("file").agg(F.count("*").alias("_docs"), F.sum("n_tokens").alias("_ids"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = sums.select("file", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_docs", "_ids")])
    inside = Window.partitionBy("file").orderBy("row")
    before = F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = encoded.select("*", (F.row_number().over(inside) - 1).alias("_n"), before.alias("_before"))
    out = own.join(F.broadcast(files), "file")
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", (F.col("_docs") + F.col("_n")).alias("position"), (F.col("_ids") + F.col("_before")).alias("start")).orderBy("position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_to_weights", mix_to_weights),
    ("byte_bpe", byte_bpe),
]

#: The classifier and the language models are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
