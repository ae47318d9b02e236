"""Suggestions for lines as they are typed: a stateless stream against a fixed model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators import suggest as s


def typed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stream of typed lines from JSON files: ctx_id, line."""
    return spark.readStream.schema("ctx_id bigint, line string").json(path)


def contexts_of(lines: DataFrame, words: DataFrame) -> DataFrame:
    """ctx_id, ids of the known finished words in order, hint (the unfinished word)."""
    parts = s.split_input(lines, "line")
    tokens = parts.select("ctx_id", "hint", F.posexplode_outer(F.split(F.trim("finished"), r"\s+")).alias("pos", "word"))
    ids = words.where("word is not null").groupBy(F.lower("word").alias("lower")).agg(F.min("id").alias("id"))
    known = tokens.withColumn("lower", F.lower("word")).join(ids, "lower", "left")
    listed = known.groupBy("ctx_id", "hint").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))).alias("w"))
    return listed.select("ctx_id", F.transform("w", lambda x: x["id"]).alias("ids"), "hint")


def suggest_stream(lines: DataFrame, model: s.Model, k: int, out: str, checkpoint: str) -> StreamingQuery:
    """Write the suggestions of each batch of lines to ``out``; a batch that runs again replaces its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        found = s.suggest(contexts_of(df, model.words), model, k)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
