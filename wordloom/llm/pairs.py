"""Items that appear together: a pair table that is kept up to date.

The table is a folder that can be opened again by its path.  It holds three logs,
each hash-bucketed by its key: baskets by basket, pair counts by (word_a, word_b) and
word counts by word.  A batch of changed baskets looks up what is stored of these
baskets, and appends one segment of signed deltas to every log; nothing stored is
rewritten or shuffled.  A count is the sum of its deltas, which lie in one bucket.
After ``SEGMENTS`` batches a log is compacted, bucket by bucket, again without a shuffle.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.cooccur import distinct_words, emit_pairs
from wordloom.session import shuffle_partitions
from wordloom.storage import materialize, read_text, remove, workspace, write_text

#: Segments of a log that are read together; one more and they are made one.
SEGMENTS = 8


class PairTable:
    """Pair counts below ``path`` (a workspace folder of this session if none is given).

    An existing table is opened as it was after its last finished batch.  A batch that
    fails leaves rows of a segment that is not listed, which no one reads and the next
    compaction drops.  One writer at a time.
    """

    LOGS = {
        "baskets": (["basket"], "basket bigint, words array<bigint>, seg bigint"),
        "pairs": (["word_a", "word_b"], "word_a bigint, word_b bigint, d bigint, seg bigint"),
        "marginals": (["word"], "word bigint, d bigint, seg bigint"),
    }

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.path = spark, (path or workspace(spark, "pairs")).rstrip("/")
        stored = read_text(spark, f"{self.path}/manifest")
        state = json.loads(stored) if stored else {"buckets": buckets or shuffle_partitions(spark), "segments": [], "n_baskets": 0, "version": {p: 0 for p in self.LOGS}}
        self.buckets, self.segments, self.n_baskets, self.version = state["buckets"], state["segments"], state["n_baskets"], state["version"]
        self._names: dict[str, str] = {}

    def _commit(self) -> None:
        state = {"buckets": self.buckets, "segments": self.segments, "n_baskets": self.n_baskets, "version": self.version}
        write_text(self.spark, f"{self.path}/manifest", json.dumps(state))

    def _folder(self, log: str) -> str:
        return f"{self.path}/{log}-{self.version[log]}"

    def _name(self, log: str) -> str:
        """The catalog's name of a log's present version, made known to this session if it is not."""
        folder = self._folder(log)
        if folder not in self._names:
            keys, schema = self.LOGS[log]
            name = f"wordloom_{log}_{uuid.uuid4().hex[:12]}"
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(keys)}) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
            self._names[folder] = name
        return self._names[folder]

    def log(self, log: str) -> DataFrame:
        """All finished segments of a log."""
        return self.spark.table(self._name(log)).where(F.col("seg").isin(self.segments) if self.segments else F.lit(False))

    def counts(self, log: str) -> DataFrame:
        """Pairs or marginals with their counts ``n``; those that came to nothing are left out."""
        keys, _ = self.LOGS[log]
        return self.log(log).groupBy(*keys).agg(F.sum("d").alias("n")).where("n <> 0")

    def baskets(self) -> DataFrame:
        """The present, non-empty baskets."""
        return self._newest(self.log("baskets")).where("size(words) > 0")

    @staticmethod
    def _newest(log: DataFrame) -> DataFrame:
        return log.groupBy("basket").agg(F.max_by("words", "seg").alias("words"))

    def apply(self, batch: DataFrame) -> PairTable:
        """Take (basket, words, at): new or changed baskets; no words means the basket is withdrawn.

        Of several versions in one batch the latest ``at`` counts (then the larger
        words); rows with a null basket are ignored, a stored basket that comes again
        unchanged emits nothing.
        """
        version = F.struct(F.col("at"), distinct_words(F.col("words")).alias("words"))
        new = batch.where("basket is not null").select("basket", version.alias("v")).groupBy("basket").agg(F.max("v")["words"].alias("new"))
        empty = F.array().cast("array<bigint>")
        if self.segments:
            # The stored side keeps its buckets; only what belongs to baskets of this batch is looked at further.
            old = new.join(self.log("baskets"), "basket", "left").groupBy("basket").agg(F.first("new").alias("new"), F.max_by("words", "seg").alias("old"))
            both = old.select("basket", F.coalesce("old", empty).alias("old"), "new")
        else:
            both = new.select("basket", empty.alias("old"), "new")
        changed = materialize(both.where("old <> new"), "pairs-changed")

        side = lambda c, sign: F.struct(F.col(c).alias("words"), F.lit(sign).alias("sign"))
        sides = F.array(side("new", 1), side("old", -1)) if self.segments else F.array(side("new", 1))
        signed = changed.select(F.explode(sides).alias("v")).select("v.*").where("size(words) > 0")
        seg = max([0, *self.segments, time.time_ns()]) + 1
        # The shuffle of an aggregate has as many partitions as the log has buckets, so each bucket gets one file.
        width = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(self.buckets))
        try:
            pairs = emit_pairs(signed, keep=("sign",)).groupBy("word_a", "word_b").agg(F.sum("sign").alias("d")).where("d <> 0")
            self._append("pairs", pairs, seg)
            words = signed.select("sign", F.explode("words").alias("word")).groupBy("word").agg(F.sum("sign").alias("d")).where("d <> 0")
            self._append("marginals", words, seg)
            self._append("baskets", changed.select("basket", F.col("new").alias("words")).repartition(self.buckets, "basket"), seg)
        finally:
            self.spark.conf.set("spark.sql.shuffle.partitions", width)
        gained = F.sum((F.size("new") > 0).cast("bigint") - (F.size("old") > 0).cast("bigint"))
        self.n_baskets += changed.agg(gained).first()[0] or 0
        self.segments = [*self.segments, seg]
        self._commit()
        if len(self.segments) > SEGMENTS:
            self.compact()
        return self

    def _append(self, log: str, df: DataFrame, seg: int) -> None:
        columns = [c.split()[0] for c in self.LOGS[log][1].split(", ")]
        df.withColumn("seg", F.lit(seg).cast("bigint")).select(*columns).write.insertInto(self._name(log))

    def compact(self) -> None:
        """Write every log as one segment and forget the old files."""
        if not self.segments:
            return
        last, old = max(self.segments), {log: self._folder(log) for log in self.LOGS}
        whole = {log: self.counts(log).withColumnRenamed("n", "d") for log in ("pairs", "marginals")} | {"baskets": self.baskets()}
        self.version = {log: v + 1 for log, v in self.version.items()}
        for log, df in whole.items():
            self._append(log, df, last)
        self.segments = [last]
        self._commit()
        for folder in old.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(folder)}")
            remove(self.spark, folder)

    def close(self) -> None:
        """Forget the names in the session's catalog; the folder stays."""
        while self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._names.popitem()[1]}")

    def scores(self, min_count: int = 1, pairs: DataFrame | None = None) -> DataFrame:
        """word_a, word_b, n_ab, n_a, n_b, lift = n_ab * N / (n_a * n_b) of pairs seen ``min_count`` times (or of the given ones)."""
        pairs = (self.counts("pairs") if pairs is None else pairs).where(F.col("n") >= min_count)
        m = self.counts("marginals")
        a = m.select(F.col("word").alias("word_a"), F.col("n").alias("n_a"))
        b = m.select(F.col("word").alias("word_b"), F.col("n").alias("n_b"))
        lift = F.col("n") * F.lit(float(self.n_baskets)) / (F.col("n_a") * F.col("n_b"))
        return pairs.join(a, "word_a").join(b, "word_b").select("word_a", "word_b", F.col("n").alias("n_ab"), "n_a", "n_b", lift.alias("lift"))

    def affected_scores(self, min_count: int = 1) -> DataFrame:
        """Scores that the last batch touched other than through N: of pairs whose own count or the count of one of whose words it changed."""
        if not self.segments:
            return self.scores(min_count)
        last = F.col("seg") == max(self.segments)
        pairs = self.counts("pairs")
        words = self.log("marginals").where(last).select("word")
        own = self.log("pairs").where(last).select("word_a", "word_b")
        touched = [pairs.join(words.withColumnRenamed("word", c), c, "left_semi") for c in ("word_a", "word_b")] + [pairs.join(own, ["word_a", "word_b"], "left_semi")]
        return self.scores(min_count, reduce(DataFrame.unionByName, touched).distinct())
