"""Vectors of texts, kept by the texts' digests: a text is embedded once, whoever asks for it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stresslens.sources.versioned import VersionLog


class VectorCache:
    """A stored table (digest, v) that grows by what is missing.

    ``embed`` makes the array of a text column; ``model`` names it, and vectors
    of other models are never returned.  Every call adds the new texts'
    vectors as one more folder of the table; a call that finds all adds none.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, embed):
        self.log, self.model, self.embed = VersionLog(spark, path), model, embed

    @staticmethod
    def digest(text: Column) -> Column:
        """sha256 of a text; null counts as empty."""
        return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)

    def _stored(self, spark: SparkSession, state: dict) -> DataFrame:
        folders = state.get("models", {}).get(self.model, [])
        schema = "digest string, v array<double>"
        return spark.read.schema(schema).parquet(*[self.log.data(f) for f in folders]) if folders else spark.createDataFrame([], schema)

    def vectors(self, rows: DataFrame, text: str) -> tuple[DataFrame, int]:
        """``rows`` with their text's vector ``v`` (replaced if there is one), and how many texts were embedded for it.

        Digests are looked up without the texts; only texts that are missing,
        one for each digest, are embedded.
        """
        spark, (number, state) = rows.sparkSession, self.log.latest()
        known = self._stored(spark, state)
        marked = rows.drop("v").withColumn("_digest", self.digest(F.col(text)))
        missing = marked.select("_digest").distinct().join(known, F.col("_digest") == F.col("digest"), "left_anti")
        # copies of a text are one digest: the least of its equal texts stands for them, found where they lie
        texts = marked.join(missing, "_digest", "left_semi").groupBy("_digest").agg(F.min(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
        folder = f"v{number + 1:08d}"
        fresh = texts.select(F.col("_digest").alias("digest"), self.embed(F.col("text")).cast("array<double>").alias("v"))
        if not missing.isEmpty():
            fresh.write.mode("overwrite").parquet(self.log.data(folder))
            added = spark.read.parquet(self.log.data(folder)).count()
            models = state.get("models", {})
            state = state | {"models": models | {self.model: [*models.get(self.model, []), folder]}}
            self.log.commit(number + 1, state)
        else:
            added = 0
        every = self._stored(spark, state)
        return marked.join(every, F.col("_digest") == F.col("digest")).drop("digest", "_digest"), added
