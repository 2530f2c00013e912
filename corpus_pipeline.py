"""A corpus pipeline: every stage reads what its predecessor kept.

``STAGES`` lists (name, function) pairs; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame.  All but the last return the columns of ``documents``; an
outer runner may write and read the frame between stages, as ``run`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.llm.bpe import byte_bpe
from glintframe.llm.common import cut, discard, small_enough
from glintframe.llm.decontaminate import without_contaminated
from glintframe.llm.partenum import similarity_join
from glintframe.llm.quality_gam import THRESHOLD, train_quality, with_quality
from glintframe.llm.suffix_dedup import suffix_dedup

#: Words of the repeated passages that the suffix stage removes.
PASSAGE_WORDS = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rest(docs: DataFrame):
    """All columns but the text as one struct, which the text operators pass through."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])


def _restored(docs: DataFrame, rest: str, text) -> list:
    """The columns of ``docs`` from such a struct and a new text, with its length anew."""
    length = {"n_chars": F.length(text).cast("long")}
    return [(text if c == "text" else length.get(c, F.col(f"{rest}.`{c}`"))).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = train_quality(docs, _table(spark, sf_dir, "labels"))
    return with_quality(docs, model, out="__quality").where(F.col("__quality") >= THRESHOLD).drop("__quality")


def _row(docs: DataFrame):
    """The id, nulls last, and a hash of all columns: only rows that are equal throughout have the same."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    every += [c.isNull() for c in every]  # the hash itself passes over nulls
    hashes = [F.nullif(F.xxhash64(F.lit(k), *every), F.lit(0)).alias(f"hash{k}") for k in (0, 1)]
    # All fields can be null, as they come back from Python; null stands before 1.
    return F.struct(F.when(F.col("doc_id").isNull(), 1).alias("none"), "doc_id", *hashes)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group at five words and similarity 0.8, by id (nulls last), then by a hash of the row.

    Rows are told apart by all their columns, so ids may be null or repeated.  Of
    rows that are equal throughout any one is the first.  Rows without words stay.
    """
    rows, made = docs.withColumn("__row", _row(docs)), []
    found = similarity_join(rows, words=5, percent=80, id_col="__row", made=made).where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("__row")).agg(F.max(F.expr("component_id < doc_id")).alias("later"), F.count("*").alias("n"))
    found = cut(found.where("later or n > 1"))
    discard(spark, made)
    # Most rows are told by one hash alone, so their texts are not shuffled.
    own = F.coalesce("__row.hash0", F.lit(0)).alias("__hash")
    hashes, rows = small_enough(cut(found.select(own).distinct())), rows.select("*", own)
    met = rows.join(hashes, "__hash", "left_semi")
    out = rows.join(hashes, "__hash", "left_anti").select(*met.columns).union(met.join(found, "__row", "left_anti").select(*met.columns))
    repeated = found.where("not later").select("__row")
    if not repeated.isEmpty():
        out = out.union(met.join(repeated, "__row", "left_semi").dropDuplicates(["__row"]).select(*met.columns))
    return out.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that occur anywhere else too."""
    out = suffix_dedup(docs.select(_rest(docs).alias("rest"), "text"), "rest", "text", window=PASSAGE_WORDS, words=True)
    return out.select(*_restored(docs, "doc_id", F.decode("kept", "UTF-8")))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as decoded from their ids, with the ids."""
    import public_tokenizers

    out = byte_bpe(docs.select(_rest(docs).alias("rest"), "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "rest", "text")
    return out.select(*_restored(docs, "doc_id", F.decode("decoded", "UTF-8")), "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark", benchmark), ("tokens", tokens)]

#: The stages learn a model, join similar sets and tokenise: SQL cannot express their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
