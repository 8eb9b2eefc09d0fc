"""Ingest files and answer batches of questions over a stored collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import rules
from docloom.config import Settings
from docloom.functions.classify import classify_query, query_type, technical_variants
from docloom.functions.validate import validate_answer
from docloom.operators import cache, compress, expansion, fusion, memory, parent, prompts, stats, store
from docloom.operators.chunking import semantic_chunks
from docloom.operators.dense import dense_search
from docloom.operators.sparse import TfidfModel, postings, tfidf_terms
from docloom.operators.store import ChunkStore, VersionedStore
from docloom.operators.term_index import TermIndex
from docloom.operators.topk import union_all
from docloom.providers import Providers
from docloom.session import removed, ship_package, written
from docloom.sources.files import check_uploads, listing, read_documents

MODES = ("parent", "hybrid", "two_way", "semantic", "keyword", "technical")


class Engine:
    """A collection of tables under one folder, and the plans that read and extend them."""

    def __init__(
        self, spark: SparkSession, root: str, settings: Settings = Settings(),
        providers: Providers = Providers(), sharded: bool = False,
    ):
        ship_package(spark)
        self.spark, self.settings, self.providers = spark, settings, providers
        folder = f"{root.rstrip('/')}/{settings.collection}"
        shards = settings.num_shards if sharded else 0
        self.chunks = ChunkStore(spark, folder, "chunks", shards)
        self.parents = ChunkStore(spark, folder, "parents")
        self.children = ChunkStore(spark, folder, "children")
        self.cache = ChunkStore(spark, folder, "cache")
        self.history = VersionedStore(spark, folder, "history")
        self.log = ChunkStore(spark, folder, "log")
        self.errors = ChunkStore(spark, folder, "ingest_errors")
        self.bm25_index = TermIndex(spark, f"{folder}/bm25_index")
        self.tfidf_postings = ChunkStore(spark, folder, "tfidf_postings")
        self.use_expansion = True
        self.synonyms: DataFrame | None = None

    # --- ingest -----------------------------------------------------------------------

    def ingest(self, path: str | list[str], hierarchy: bool = False) -> DataFrame:
        """Store the chunks of all accepted files; one report row per file.

        Chunks that are stored already, by place and content, are not added again.
        With ``hierarchy`` each file becomes a parent with small word-window children.
        """
        checks = check_uploads(listing(self.spark, path), self.settings)
        units = read_documents(
            self.spark, path, self.providers.pdf_reader, max_bytes=self.settings.max_upload_bytes
        )
        units = written(units)
        accepted = checks.where("success").select(F.col("path").alias("source"))
        good = units.where(F.col("error").isNull() & (F.trim("text") != "")).join(accepted, "source", "left_semi")
        if hierarchy:
            chunks = self._add_hierarchy(good)
        else:
            chunks = semantic_chunks(good, max_chars=self.settings.chunk_chars)
            self.add_chunks(chunks)
        counts = chunks.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("chunks_processed"))
        failed = units.where(F.col("error").isNotNull()).groupBy(F.col("source").alias("path")).agg(F.first("error").alias("broken"))
        return (
            checks.join(counts, "path", "left")
            .join(failed, "path", "left")
            .select(
                "filename",
                F.coalesce("chunks_processed", F.lit(0)).alias("chunks_processed"),
                (F.col("success") & F.col("broken").isNull()).alias("success"),
                F.coalesce("error", "broken").alias("error"),
            )
        )

    def add_chunks(self, chunks: DataFrame) -> None:
        """Project chunks to the stored form, embed and append those that are new, with their postings.

        Only ids of the sources at hand are compared, so a repeated file or batch adds nothing.
        """
        rows = store.stored_records(chunks)
        if self.chunks.exists():
            rows = self.chunks.without_stored(rows)
        if self.chunks.shards:
            rows = store.with_shard(rows, self.chunks.shards)
        rows = written(rows)  # what is new is settled before the table grows
        # Postings go first: a batch that is repeated after a failure replaces none, so ids in both
        # tables are compared.
        new = rows.select("id", "text")
        self.bm25_index.add(new)
        table = self.tfidf_postings
        if table.exists():
            new = new.join(table.all().where("pos = 0").select("id"), "id", "left_anti")
        table.append(postings(new, tfidf_terms(F.col("text"), rules.TFIDF_STOP_WORDS)))
        self.chunks.append(rows.withColumn("embedding", self.providers.embed(F.col("text"))))

    def _add_hierarchy(self, units: DataFrame) -> DataFrame:
        """Store parents and children of each file (one file is one row, at most the upload limit)."""
        order = F.coalesce("page_number", "paragraph_number", F.lit(0))
        texts = units.groupBy("source").agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "chunk_id", "text"))), lambda x: x["text"]), " "
            ).alias("text")
        )
        tops = parent.parents(texts.withColumn("doc_id", F.sha2("source", 256))).withColumn(
            "created_at", F.current_timestamp()
        )
        kids = parent.children(tops, self.settings.child_words)
        for table, rows, key in ((self.parents, tops, "parent_id"), (self.children, kids, "chunk_id")):
            table.append(rows.join(table.all().select(key), key, "left_anti") if table.exists() else rows)
        self.add_chunks(kids)
        return kids

    # --- search -----------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int, mode: str = "hybrid") -> DataFrame:
        """Context chunks: ``query_id, rank, id, chunk_id, text, source, page_number, score``.

        ``queries`` has ``query_id`` and ``text``.
        """
        if mode not in MODES:
            raise ValueError(f"search mode must be one of {', '.join(MODES)}")
        corpus = self.chunks.all()
        n = queries.count()
        if mode in ("parent", "semantic", "technical"):
            rows = self._dense_modes(queries, k, mode, corpus, n)
        else:
            rows = self._mixed_modes(queries, k, mode, corpus, n)
        meta = corpus.select("id", "chunk_id", "source", "page_number")
        kept = rows.select("query_id", "id", "rank", "score", "text")
        found = fusion.attach(kept, meta, n * k)
        return self._with_parents(found, n * k) if mode == "parent" else found.withColumn("parent_context", F.lit(None).cast("string"))

    def routed_search(self, queries: DataFrame, k: int, mode: str = "hybrid") -> DataFrame:
        """``search`` by the class of each question, in one plan.

        A technical question is asked in all its variants, whose chunks are merged with method
        documentation first; any other question is asked as it is.
        """
        kind = classify_query(F.col("text"))
        variants = queries.select(
            "query_id", (kind["type"] == "technical").alias("technical"), F.posexplode(technical_variants(F.col("text"), kind)).alias("variant", "text")
        ).withColumn("_key", F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant").cast("string")))
        found = self.search(variants.select(F.col("_key").alias("query_id"), "text"), k, mode)
        columns = found.columns
        named = found.withColumnRenamed("query_id", "_key").join(variants.drop("text"), "_key")
        direct = named.where(~F.col("technical")).select(*columns)
        corpus = self.chunks.all()
        kinds = F.col("content_type") if "content_type" in corpus.columns else F.lit(None).cast("string")
        several = (
            named.where(F.col("technical") & (F.col("rank") <= F.when(F.col("variant") == 0, k).otherwise(max(2, k // 2))))
            .withColumn("is_original", F.col("variant") == 0)
            .join(corpus.select("id", kinds.alias("content_type")), "id")
        )
        return direct.unionByName(expansion.merge_variants(several, k, method_docs_first=True).select(*columns))

    def _dense_modes(self, queries, k, mode, corpus, n) -> DataFrame:
        embed = self.providers.embed
        plain = corpus.select("id", "text", "embedding")
        if mode == "technical":
            variants = queries.select(
                "query_id", F.posexplode(technical_variants(F.col("text"), classify_query(F.col("text")))).alias("variant", "text")
            ).withColumn("is_original", F.col("variant") == 0)
            kind = F.col("content_type") if "content_type" in corpus.columns else F.lit(None).cast("string")
            tagged = corpus.select("id", "text", "embedding", kind.alias("content_type"))
            hits = expansion.search_variants(tagged, variants, embed, k, n * 4)
            return expansion.merge_variants(hits, k, method_docs_first=True)
        if mode == "semantic" and self.use_expansion and self.synonyms is not None:
            variants = expansion.expand_queries(queries, self.synonyms, most=2)
            return expansion.merge_variants(expansion.search_variants(plain, variants, embed, k, n * 3), k)
        if mode == "semantic":
            return expansion.plain_search(plain, queries, embed, k, n)
        vectors = queries.select("query_id", embed(F.col("text")).alias("embedding"))
        hits = dense_search(plain, vectors, 2 * k).where(F.col("rank") <= k)
        return fusion.attach(hits, plain.drop("embedding"), n * k)

    def _mixed_modes(self, queries, k, mode, corpus, n) -> DataFrame:
        embed, texts = self.providers.embed, corpus.select("id", "text")
        index = self.bm25_index
        if mode == "keyword":
            hits = index.search(queries, k)
            return fusion.attach(hits, texts, n * k)
        vectors = queries.select("query_id", embed(F.col("text")).alias("embedding"))
        parts = [fusion.tagged(dense_search(corpus, vectors, 2 * k), "dense")]
        words = index.search(queries, 2 * k) if mode == "hybrid" else index.model().search(queries, 2 * k, positive_only=False)
        parts.append(fusion.tagged(words, "bm25"))
        if mode == "hybrid":
            parts.append(fusion.tagged(TfidfModel.of_postings(self.tfidf_postings.all()).search(queries, 2 * k), "tfidf"))
        hits = fusion.attach(union_all(parts), texts, n * 2 * k * len(parts))
        fused = fusion.fuse_three(hits) if mode == "hybrid" else fusion.fuse_two(hits, self.settings.alpha)
        return fusion.best(fusion.rerank(fused, queries, self.providers.rerank), k, "final_score")

    def _with_parents(self, found: DataFrame, most: int) -> DataFrame:
        if not self.children.exists():
            return found.withColumn("parent_context", F.lit(None).cast("string"))
        hits = found.select("query_id", F.col("chunk_id").alias("id"), "score", "rank")
        context = parent.with_parent_context(
            hits, self.children.all(), self.parents.all(), most, self.settings.context_words
        ).select("query_id", "chunk_id", "parent_context")
        return found.join(context, ["query_id", "chunk_id"], "left")

    # --- questions --------------------------------------------------------------------

    def query(
        self, questions: DataFrame | str, k: int | None = None, mode: str = "parent", compression: bool = True,
        validation: bool = True,
    ) -> DataFrame:
        """Answers, one row per question.

        ``questions`` is a text or a table ``query_id, text`` (and ``session_id``). Known
        answers come from the cache table; the others are searched, prompted, answered,
        checked and corrected once, then appended to cache, history and log.
        """
        spark, k = self.spark, k or self.settings.default_k
        if isinstance(questions, str):
            questions = spark.createDataFrame([(0, questions)], "query_id int, text string")
        if "session_id" not in questions.columns:
            questions = questions.withColumn("session_id", F.lit(None).cast("string"))
        asked = questions.select("query_id", "text", "session_id").withColumn("classification", classify_query(F.col("text")))
        known = self._cached(asked)
        new = written(known.where(~F.col("cached")).drop("value", "level", "cached", "key"))
        answers = written(self._answer(new, k, mode, compression, validation))
        self._remember(answers)
        old = known.where("cached").select(
            "query_id", "session_id", F.col("text").alias("question"), "classification",
            F.from_json("value", _ANSWER).alias("a"), F.lit(mode).alias("search_mode"), F.lit(True).alias("cached"),
        )
        old = old.select("query_id", "session_id", "question", "a.*", "classification", "search_mode", "cached")
        return answers.select(*old.columns).unionByName(old)

    def _cached(self, asked: DataFrame) -> DataFrame:
        rows = asked.withColumn("query", F.col("text"))
        if not self.cache.exists():
            none = F.lit(None)
            return rows.drop("query").withColumns(
                {"key": none.cast("string"), "value": none.cast("string"), "level": none.cast("int"), "cached": F.lit(False)}
            )
        stored = cache.newest(self.cache.all())
        return cache.lookup(rows, [stored], F.current_timestamp()).drop("query")

    def _answer(self, new: DataFrame, k: int, mode: str, compression: bool, validation: bool) -> DataFrame:
        queries = new.select("query_id", "text")
        chunks = self.search(queries, k, mode) if mode == "technical" else self.routed_search(queries, k, mode)
        shown = chunks.withColumn("text", F.coalesce("parent_context", "text")) if mode == "parent" else chunks
        if compression:
            shown = self._compressed(shown, queries)
        else:
            shown = shown.withColumn("position", F.col("rank"))
        plain = prompts.gather(
            shown, prompts.context_block(F.col("position"), F.col("source"), F.col("page_number"), F.col("score"), F.col("text"))
        )
        listed = shown.groupBy("query_id").agg(
            F.count("*").cast("int").alias("context_chunks"),
            F.transform(F.sort_array(F.collect_list(F.struct("position", "source"))), lambda x: x["source"]).alias("sources"),
            F.collect_list("text").alias("context"),
        )
        rows = new.join(plain, "query_id", "left").join(listed, "query_id", "left")
        rows = rows.join(self._conversation(), "session_id", "left") if self.history.exists() else rows.withColumn("conversation", F.lit(""))
        kind, text = F.col("classification"), F.col("text")
        context = F.coalesce("context_text", F.lit(""))
        exact = (kind["type"] == "technical") & kind["requires_precision"]
        prompt = F.when(exact, prompts.technical_prompt(text, context, kind, F.col("conversation"))).otherwise(
            prompts.enhanced_prompt(text, context, query_type(text), F.col("conversation"))
        )
        rows = rows.withColumn("prompt", prompt)
        rows = rows.withColumn("a", self.providers.answer(F.col("prompt"), text, context))
        passed = F.lit(None).cast(_VERDICT)
        if validation:
            empty = F.array().cast("array<string>")
            rows = rows.withColumn("v", F.when(exact, validate_answer(F.col("a.answer"), kind, F.coalesce("context", empty))).cast(_VERDICT))
            wrong = F.col("v").isNotNull() & ~F.col("v.is_accurate")
            again = prompts.correction_prompt(text, F.col("a.answer"), F.col("v.issues_found"), F.col("v.corrections_suggested"))
            rows = rows.withColumn("b", F.when(wrong, self.providers.answer(again, text, context)))
            rows = rows.withColumn("a", F.when(F.col("b.success"), F.col("b")).otherwise(F.col("a")))
        else:
            rows = rows.withColumn("v", passed)
        return rows.select(
            "query_id", "session_id", F.col("text").alias("question"), F.col("a.answer").alias("answer"),
            F.coalesce("context_chunks", F.lit(0)).alias("context_chunks"),
            F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
            F.col("a.tokens_used").alias("tokens_used"), F.col("a.success").alias("success"), F.col("a.error").alias("error"),
            F.col("v").alias("technical_validation"), "classification", F.lit(mode).alias("search_mode"), F.lit(False).alias("cached"),
            F.current_timestamp().alias("answered_at"),
        )

    def _compressed(self, shown: DataFrame, queries: DataFrame) -> DataFrame:
        """Compression for questions with more than three chunks."""
        many = shown.groupBy("query_id").agg(F.count("*").alias("_n")).where("_n > 3").select("query_id")
        meta = shown.select("query_id", F.col("id"), "source", "page_number", "score")
        small = compress.compress_context(
            shown.join(many, "query_id", "left_semi").select("query_id", "rank", "id", "text"),
            queries, self.settings.compress_tokens, self.providers.summarize,
        ).select("query_id", "id", "position", "text")
        rest = shown.join(many, "query_id", "left_anti").select("query_id", "id", (F.col("rank") - 1).alias("position"), "text")
        return small.unionByName(rest).join(meta, ["query_id", "id"]).withColumn("position", F.col("position") + 1)

    def _conversation(self) -> DataFrame:
        rows = memory.session_context(self.history.all(), self.settings.history_in_prompt, "answered_at")
        return rows.withColumnRenamed("context", "conversation")

    def _remember(self, answers: DataFrame) -> None:
        good = answers.where("success")
        value = F.to_json(
            F.struct("answer", "context_chunks", "sources", "tokens_used", "success", "error", "technical_validation")
        )
        self.cache.append(
            cache.entries(
                good.select(F.col("question").alias("query"), value.alias("value"), F.col("answered_at").alias("created_at")),
                self.settings.ttl_seconds,
            )
        )
        self.history.append(
            good.where(F.col("session_id").isNotNull()).select(
                "session_id", F.col("question").alias("query"), F.col("answer").alias("response"), "answered_at"
            )
        )

    def record(self, log_rows: DataFrame) -> None:
        """Append ``ts, seconds, cached`` rows to the query log."""
        self.log.append(log_rows.select("ts", "seconds", "cached"))

    # --- upkeep -----------------------------------------------------------------------

    def clear_cache(self) -> None:
        self.cache.drop()

    def clear_session(self, session_id: str) -> None:
        """Rewrite the history without one session."""
        if self.history.exists():
            self.history.replace(memory.without_session(self.history.all(), session_id))

    def trim_history(self) -> None:
        """Keep the newest turns of each session only."""
        if self.history.exists():
            self.history.replace(memory.last_turns(self.history.all(), self.settings.max_history, "answered_at").drop("age"))

    def drop(self) -> None:
        for table in (self.chunks, self.parents, self.children, self.cache, self.history, self.log, self.errors, self.tfidf_postings):
            table.drop()
        removed(self.spark, self.bm25_index.root)

    def performance(self) -> DataFrame:
        return stats.performance(self.log.all())

    def stats(self) -> dict:
        def count(table: ChunkStore) -> int:
            return table.all().count() if table.exists() else 0

        sessions = self.history.all().select("session_id").distinct().count() if self.history.exists() else 0
        chunks = count(self.chunks)
        return {
            "documents_indexed": chunks,
            "cache_available": self.cache.exists(),
            "cache_entries": count(self.cache),
            "bm25_index_size": chunks,
            "active_sessions": sessions,
            "components": {
                "pdf": self.providers.pdf_reader is not None,
                "abstractive_summaries": self.providers.summarize is not None,
                "expansion": self.use_expansion and self.synonyms is not None,
                "sharded": bool(self.chunks.shards),
            },
        }

    def analyze(self) -> DataFrame:
        """Entities, relations and hierarchy of the stored collection."""
        docs = self.chunks.all().select(F.col("id").alias("doc_id"), "text", "source")
        return stats.collection_analysis(docs, "doc_id")


_VERDICT = (
    "struct<is_accurate:boolean,confidence_score:double,"
    "issues_found:array<struct<issue:string,correction:string,severity:string>>,"
    "corrections_suggested:array<string>,technical_score:double>"
)
_ANSWER = (
    "struct<answer:string,context_chunks:int,sources:array<string>,tokens_used:int,success:boolean,error:string,"
    f"technical_validation:{_VERDICT}>"
)
