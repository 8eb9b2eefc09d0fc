"""A stored BM25 index laid out by term, extended batch by batch.

Tables below ``root``:

* ``blocks``, partitioned by ``bucket`` (a hash of the term) and sorted by term in each file: a block
  is up to ``block`` rows (id, len, tf) of one term, those with the highest counts and shortest texts
  first, with its largest ``tf`` and smallest ``len``. A frequent term is cut by a hash of the id
  before its rows meet, so no task holds all of them;
* ``terms``, partitioned alike: rows per term and batch;
* ``documents``: id and length of every row;
* ``totals``: one row per batch, written last. Rows of a batch without it are never read, so a batch
  that failed half way and is repeated counts once.

A search reads the buckets of its terms only and writes nothing. The sums over the whole corpus that
it needs are in the last row of ``totals``.

Upper bounds: a block's largest count and smallest length bound what one of its rows can add to a
score. The first block of each term gives every query a k-th score that it surely reaches. A block
is left out for a query if its bound and the highest bounds of the query's other terms stay below
it: none of its rows can be among the k best. Hits and scores equal those of a search without bounds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import rules
from docloom.config import Settings
from docloom.operators.sparse import Bm25Model, bm25_tokens, postings, summed, term_weights
from docloom.operators.topk import SCORE_DIGITS, top_k
from docloom.session import is_small, removed, stored, work_folder

BUCKETS = 16
BLOCK = 128
PART_ROWS = 1 << 16
# Below this difference two scores may be equal after rounding.
SLACK = 2 * 10.0**-SCORE_DIGITS


@dataclass
class TermIndex:
    spark: SparkSession
    root: str
    buckets: int = BUCKETS
    block: int = BLOCK
    part_rows: int = PART_ROWS

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def exists(self) -> bool:
        """True once a batch is complete."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("totals"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _read(self, name: str) -> DataFrame:
        """Rows of complete batches."""
        rows = self.spark.read.parquet(self._path(name))
        if name == "totals":
            return rows
        done = self._read("totals").select("batch").distinct()
        return rows.join(done, "batch", "left_semi")

    # --- building -----------------------------------------------------------------------

    def add(self, corpus: DataFrame, id_col: str = "id", text_col: str = "text") -> None:
        """Add the rows of ``corpus``; rows whose id is in the index are left out."""
        before = self._read("documents") if self.exists() else None
        rows = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        if before is not None:
            rows = rows.join(before.select("id"), "id", "left_anti")
        batch, folder = uuid.uuid4().hex, work_folder(self.spark, "postings")
        cut = stored(postings(rows, bm25_tokens(F.col("text"))), folder)
        first = cut.where("pos = 0").select("id", F.col("len").cast("long").alias("len"))
        docs, words = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        if docs:
            self._append(self._blocks(cut, -(-docs // self.part_rows)), "blocks", batch)
            named = cut.where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            self._append(named.withColumn("bucket", self._bucket(F.col("term"))).repartition("bucket"), "terms", batch)
            self._append(first, "documents", batch)
            self._total(batch, docs, words)
        removed(self.spark, folder)

    def _blocks(self, cut: DataFrame, parts: int) -> DataFrame:
        entry = F.struct((-F.col("tf")).alias("minus"), F.col("len"), F.col("id"))
        part = F.pmod(F.xxhash64("id"), F.lit(parts))
        dealt = cut.where(F.col("term").isNotNull()).select(self._bucket(F.col("term")).alias("bucket"), part.alias("part"), "term", entry.alias("e"))
        listed = dealt.repartition("bucket", "part").groupBy("bucket", "part", "term").agg(F.sort_array(F.collect_list("e")).alias("all"))
        number = F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / self.block).cast("int"))).alias("no")
        own = F.slice("all", F.col("no") * self.block + 1, self.block)
        entries = listed.select("bucket", "term", "all", number).select("bucket", "term", "no", own.alias("own"))
        return entries.select(
            "bucket",
            "term",
            "no",
            F.transform("own", lambda e: F.struct(e["id"].alias("id"), e["len"].alias("len"), (-e["minus"]).alias("tf"))).alias("entries"),
            (-F.element_at("own", 1)["minus"]).alias("max_tf"),
            F.array_min(F.transform("own", lambda e: e["len"])).alias("min_len"),
        ).sortWithinPartitions("bucket", "term", "no")

    def _append(self, rows: DataFrame, name: str, batch: str) -> None:
        writer = rows.withColumn("batch", F.lit(batch)).write.mode("append")
        (writer.partitionBy("bucket") if "bucket" in rows.columns else writer).parquet(self._path(name))

    def _total(self, batch: str, docs: int, words: int) -> None:
        """Totals after this batch: sums are carried on, the mean idf is taken over the terms."""
        last = self.totals() if self.exists() else None
        n, w, number = docs + (last["n_docs"] if last else 0), words + (last["n_words"] if last else 0), (last["number"] if last else 0) + 1
        known = self.spark.read.parquet(self._path("terms")).where(F.col("batch") == batch)
        if last:
            known = known.unionByName(self._read("terms").select(*known.columns))
        df = F.col("df")
        sums = known.groupBy("term").agg(F.sum("df").alias("df"))
        mean, count = sums.agg(F.avg(F.log(F.lit(float(n)) - df + 0.5) - F.log(df + 0.5)), F.count(F.lit(1))).first()
        row = [(batch, number, n, w, mean or 0.0, count)]
        schema = "batch string, number long, n_docs long, n_words long, avg_idf double, n_terms long"
        self.spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(self._path("totals"))

    # --- reading ------------------------------------------------------------------------

    def totals(self):
        """The last row of the totals."""
        return self._read("totals").orderBy(F.desc("number")).first()

    def model(self) -> Bm25Model:
        """The same index as rows of single postings; nothing is counted or written."""
        total = self.totals()
        words = self._read("blocks").select("term", F.inline("entries"))
        ids = self._read("documents").select("id")
        terms = self._read("terms").groupBy("term").agg(F.sum("df").alias("df"))
        n = total["n_docs"]
        return Bm25Model(words, terms, n, total["n_words"] / n, total["avg_idf"], total["n_terms"], ids)

    def asked_weights(self, queries: DataFrame, total) -> tuple[DataFrame, list[int]]:
        """(query_id, term, bucket, w) of the queries' terms in the index, and the buckets they are in."""
        asked = term_weights(queries, bm25_tokens(F.col("text"))).withColumn("bucket", self._bucket(F.col("term")))
        buckets = sorted(r[0] for r in asked.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        terms = self._read("terms").where(F.col("bucket").isin(buckets))
        counts = terms.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        n, df = F.lit(float(total["n_docs"])), F.col("df")
        idf = F.log(n - df + 0.5) - F.log(df + 0.5)
        idf = F.when(idf >= 0, idf).otherwise(rules.BM25_EPSILON * total["avg_idf"])
        return asked.join(counts, "term").select("query_id", "term", "bucket", (F.col("n") * idf).alias("w")), buckets

    def search(self, queries: DataFrame, k: int, bounds: bool = True) -> DataFrame:
        """``query_id, id, score, rank``: the k best rows with a positive score for each (query_id, text)."""
        hits = summed(self.contributions(queries, k, bounds), F.col("value")).where("score > 0")
        return top_k(hits, ["query_id"], [F.col("score").desc(), F.col("id")], k)

    def contributions(self, queries: DataFrame, k: int, bounds: bool = True) -> DataFrame:
        """``query_id, id, value``: what the rows that are read add to the scores."""
        total = self.totals()
        average = total["n_words"] / total["n_docs"]
        k1, b = rules.BM25_K1, rules.BM25_B

        def value(tf: Column, length: Column) -> Column:
            share = length / F.lit(average) if average else F.lit(0.0)
            return F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * share))

        weights, buckets = self.asked_weights(queries, total)
        blocks = self._read("blocks").where(F.col("bucket").isin(buckets))

        def added(chosen: DataFrame) -> DataFrame:
            rows = chosen.select("query_id", "w", F.inline("entries"))
            return rows.select("query_id", "id", value(F.col("tf"), F.col("len")).alias("value"))

        # Weights of a bounded number go to the blocks, which then are not shuffled.
        side = F.broadcast if is_small(weights, Settings.broadcast_rows) else lambda rows: rows
        known = side(weights.drop("bucket"))
        if not bounds:
            return added(blocks.join(known, "term"))
        # A term's bound is the highest of its blocks', of which only the headers are read.
        heads = blocks.select("term", "max_tf", "min_len").join(known, "term")
        bound = F.greatest(value(F.col("max_tf"), F.col("min_len")), F.lit(0.0))
        tops = heads.groupBy("query_id", "term", "w").agg(F.max(bound).alias("top"))
        # A weight below 0 makes sums of some terms no lower bound: such a query reads all blocks.
        reach = tops.groupBy("query_id").agg(F.sum("top").alias("all_tops"), F.min("w").alias("least"))
        first = summed(added(blocks.where("no = 0").join(known, "term")), F.col("value"))
        number = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        goal = first.withColumn("_n", number).where(F.col("_n") == k).select("query_id", F.col("score").alias("goal"))
        limits = reach.join(goal, "query_id", "left").select("query_id", "all_tops", F.when(F.col("least") >= 0, F.col("goal")).alias("goal"))
        needed = F.col("goal") - (F.col("all_tops") - F.col("top")) - SLACK
        asked = tops.join(limits, "query_id").select("query_id", "term", "w", needed.alias("needed"))
        reached = blocks.join(side(asked), "term").where(F.col("needed").isNull() | (value(F.col("max_tf"), F.col("min_len")) >= F.col("needed")))
        return added(reached)
