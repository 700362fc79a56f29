"""Answers of models kept across runs: each content is asked about once, ever."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sinks.store import Store

KIND = "kind"


def known(store: Store, kind: str) -> DataFrame:
    """digest and answer of all that is stored of a kind; of several answers to one digest, the first. A failure is a row without an answer, and no answer."""
    rows = store.read("model_answers").where((F.col(KIND) == kind) & F.col("answer").isNotNull())
    return rows.groupBy("digest").agg(F.min_by("answer", "ts").alias("answer"))


def remembered(store: Store, requests: DataFrame, kind: str, ask, request: str = "request", waves: int = 4) -> DataFrame:
    """``requests`` (digest, request, ...) with answer, or null where the model failed.

    Digests that are stored under ``kind`` aren't asked (an anti join before the call); the others once each, however many rows have them. Answers are appended
    when their wave has ended, and read back for the result, so that no later step asks again; failures (null) are noted, but asked again in the next run. The digests
    are dealt into ``waves`` by hash: a run that ends early, or an executor that is lost for good, repeats at most the wave that was under way. ``ask`` is a function of a column.
    Rows with a null digest get null.
    """
    distinct = requests.where("digest is not null").groupBy("digest").agg(F.first(request).alias("request"))
    for wave in range(waves):
        own = distinct.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave)
        new = own.join(known(store, kind).select("digest"), "digest", "left_anti")
        # failures are written, too: a filter on the answer would make Spark ask once for the filter and once for the row
        answers = new.repartition("digest").withColumn("answer", ask(F.col("request")))
        error = store.append("model_answers", answers.select(F.current_timestamp().alias("ts"), F.lit(kind).alias(KIND), "digest", "answer"))
        if error:
            raise RuntimeError(error)
    return requests.join(known(store, kind), "digest", "left")
