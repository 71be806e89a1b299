"""An index of texts that follows adds, updates and deletions: postings in parts that are only written once.

A part has the postings of one batch, the lengths of its texts, and the ids whose older rows no longer count. What counts is
decided by a join when rows are read; parts that lie next to each other and have become many are written together as one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import text as T
from keepstone.operators.search import counted

#: Parts of about one size that are written together; sizes are alike within a factor of it.
TIER = 4
POSTINGS, TEXTS, GONE = "term string, id long, tf long, length int, part int", "id long, length int, part int", "id long, part int"


@dataclass
class Segments:
    """parts: (number, folder, texts) in the order of their batches; total and words: of the texts that count, kept by adding differences."""

    spark: SparkSession
    path: str
    parts: list[tuple[int, str, int]] = field(default_factory=list)
    total: int = 0
    words: int = 0
    batches: int = 0

    def _read(self, name: str, schema: str, parts: list[tuple[int, str, int]] | None = None) -> DataFrame:
        made = [f"{folder}/{name}" for _, folder, _ in (self.parts if parts is None else parts)]
        return self.spark.read.schema(schema).parquet(*made) if made else self.spark.createDataFrame([], schema)

    def _counting(self, rows: DataFrame, gone: DataFrame) -> DataFrame:
        """Rows (id, part) that no later part has replaced or deleted."""
        last = gone.groupBy("id").agg(F.max("part").alias("last"))
        return rows.join(last, "id", "left").where(F.col("part") >= F.coalesce("last", F.lit(-1))).drop("last")

    def postings(self) -> DataFrame:
        return self._counting(self._read("postings", POSTINGS), self._read("gone", GONE))

    def texts(self) -> DataFrame:
        return self._counting(self._read("texts", TEXTS), self._read("gone", GONE))

    def _write(self, number: int, postings: DataFrame, texts: DataFrame, gone: DataFrame) -> None:
        folder = f"{self.path}/{number}-{uuid.uuid4().hex}"
        postings.sortWithinPartitions("term", "id").write.parquet(f"{folder}/postings")
        texts.write.parquet(f"{folder}/texts")
        gone.write.parquet(f"{folder}/gone")
        n = self.spark.read.schema(TEXTS).parquet(f"{folder}/texts").count()
        self.parts = sorted([*[p for p in self.parts if p[0] != number], (number, folder, n)])

    def _batch(self, postings: DataFrame, texts: DataFrame, gone: DataFrame) -> None:
        sums = lambda d: d.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("w")).first()
        lost = sums(self.texts().join(gone.select("id"), "id", "left_semi"))
        number = self.batches
        self._write(number, postings.withColumn("part", F.lit(number)), texts.withColumn("part", F.lit(number)), gone.withColumn("part", F.lit(number)))
        new = sums(self._read("texts", TEXTS, [p for p in self.parts if p[0] == number]))
        self.total, self.words, self.batches = self.total - lost["n"] + new["n"], self.words - lost["w"] + new["w"], number + 1
        self._merge()

    def put(self, rows: DataFrame) -> None:
        """Add texts (id, text; an id once), in the place of those of the same ids that are there."""
        cut = rows.select(F.col("id").cast("long").alias("id"), T.tokenize(F.coalesce("text", F.lit(""))).alias("t"))
        length = F.size("t").alias("length")
        self._batch(counted(cut), cut.select("id", length), cut.select("id"))

    def delete(self, ids: DataFrame) -> None:
        none = lambda schema: self.spark.createDataFrame([], schema).drop("part")
        self._batch(none(POSTINGS), none(TEXTS), ids.select(F.col("id").cast("long").alias("id")).distinct())

    def _merge(self) -> None:
        """Write the last TIER parts as one while they are about of one size, or there are too many parts."""
        while len(self.parts) >= TIER:
            last = self.parts[-TIER:]
            sizes = sorted(n for _, _, n in last)
            if sizes[-1] > TIER * max(1, sizes[-2]) and len(self.parts) < 2 * TIER:
                return
            gone = self._read("gone", GONE, last)
            number = last[-1][0]
            kept = lambda name, schema: self._counting(self._read(name, schema, last), gone).withColumn("part", F.lit(number))
            # older parts must not get back what any of these has replaced
            every = gone.select("id").distinct().withColumn("part", F.lit(number))
            postings, texts = kept("postings", POSTINGS).select("term", "id", "tf", "length", "part"), kept("texts", TEXTS).select("id", "length", "part")
            before = self.parts[:-TIER]
            self._write(number, postings, texts, every)
            self.parts = [*before, self.parts[-1]]

    def scores(self, terms: DataFrame) -> DataFrame:
        """qid, id and score (as bm25_scores() of a fresh index) for the words (qid, term) of questions."""
        rows = self.postings().join(terms.select("term").distinct(), "term", "left_semi")
        df = rows.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.greatest(F.log((self.total - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        mean = self.words / self.total if self.total and self.words else 1.0
        norm = K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("length") / mean)
        asked = terms.join(df, "term")
        return rows.join(asked, "term").groupBy("qid", "id").agg(F.sum(idf * F.col("tf") * (K.BM25_K1 + 1) / (F.col("tf") + norm)).alias("score"))

