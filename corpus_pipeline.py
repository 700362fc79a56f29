"""The corpus pipeline: toxicity, near duplicates, repeated passages, source mix, sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the next one's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import common, mixing, neardup, packing, suffixes, toxicity

#: Bytes of a passage that may not repeat: about fifty short words.
PASSAGE = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.7 or more go."""
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (name,) = common.fresh(docs.columns, "toxicity")
    return toxicity.score(docs, scorer, name=name).where(F.col(name) < 0.7).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: SimHash links, each compared in full, and an exact prefix filter for what they miss."""
    return neardup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that start elsewhere, too, are removed from all their places; a cut character goes whole."""
    names = kept, size, removed, spans = tuple(common.fresh(docs.columns, "kept", "size", "removed", "spans"))
    cut = suffixes.remove(docs, PASSAGE, whole=True, names=names)
    cut = cut.withColumn("text", F.when(F.col(removed) == 0, F.col("text")).otherwise(F.col(kept).cast("string")))
    return cut.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; a begun copy has the first words only."""
    row, key, copy, begun, i, r, taken, size = common.fresh(docs.columns, "row", "key", "copy", "begun", "i", "r", "taken", "size")
    # Spark hashes no maps: as text it does
    cells = [F.to_json(c) if "map<" in docs.schema[c].dataType.simpleString() else F.col(c) for c in docs.columns]
    keyed = docs.withColumn(row, F.xxhash64(*cells))
    shares = mixing.mix(keyed, carry=("doc_id", row)).groupBy(common.key_of("c0").alias(i), F.col("c1").alias(r)).agg(F.sum("taken").alias(taken), F.first("size").alias(size))
    # whole rows travel once, for repeated rows and for the join
    one = keyed.withColumn(key, common.key_of("doc_id")).dropDuplicates([key, row])
    rows = one.join(shares.where(F.col(taken) > 0), (F.col(key) == F.col(i)) & (F.col(row) == F.col(r)))
    rows = rows.withColumn(copy, F.explode(F.expr(f"sequence(1L, cast(ceil({taken} / {size}) as long))")))
    left = F.col(taken) - (F.col(copy) - 1) * F.col(size)
    # parts end with a word each and hold the white space before it
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first = F.array_join(F.slice(parts, F.lit(1), left.cast("int")), "")
    rows = rows.withColumn(begun, left < F.col(size)).withColumn("text", F.when(F.col(begun), first).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.when(F.col(begun), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids in sequences of balanced cost."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Models, components and tokenizers are beyond SQL.
ORACLE_SQL: str | None = None
