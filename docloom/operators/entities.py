"""Entities from patterns and dictionaries, the entity index, and entity relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import rules
from docloom.config import Settings
from docloom.functions import text as t
from docloom.session import is_small, stored, work_folder

_ENTITY = (
    "array<struct<text:string,label:string,start:int,end:int,confidence:double,description:string,"
    "domain:string,category:string>>"
)
_TERM = "array<struct<term:string,domain:string,category:string>>"


def term_rows(dictionary=rules.ENTITY_TERMS) -> list[dict]:
    return [
        {"term": term.lower(), "domain": domain, "category": category}
        for domain, categories in dictionary.items()
        for category, terms in categories.items()
        for term in terms
    ]


def _entity(m: Column, label: Column, confidence: float, description: Column, domain: Column, category: Column) -> Column:
    return F.struct(
        m["text"].alias("text"),
        label.alias("label"),
        m["start"].alias("start"),
        m["end"].alias("end"),
        F.lit(confidence).alias("confidence"),
        description.alias("description"),
        domain.alias("domain"),
        category.alias("category"),
    )


def pattern_entities(text: Column, patterns=rules.ENTITY_PATTERNS) -> Column:
    """E-mail addresses, links, phone numbers and dates as an array of entities."""
    return F.concat(*[_labelled(text, label, pattern) for label, pattern in patterns])


# What a text must hold for a pattern to be worth a scan; these tests need no look-around.
_NEEDS = {
    "EMAIL": lambda text: text.contains("@"),
    "URL": lambda text: text.contains("://"),
    "PHONE": lambda text: text.rlike(r"\p{Nd}{3}-\p{Nd}{4}"),
    "DATE": lambda text: text.rlike(r"\p{Nd}/\p{Nd}{1,2}/\p{Nd}{4}|\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}"),
}


def _labelled(text: Column, label: str, pattern: str) -> Column:
    none = F.lit(None).cast("string")
    found = F.transform(
        t.matches(text, t.java(pattern)),
        lambda m: _entity(m, F.lit(label), rules.PATTERN_CONFIDENCE, F.lit(label.lower()), none, none),
    ).cast(_ENTITY)
    if label in _NEEDS:
        found = F.when(_NEEDS[label](text), found).otherwise(F.array().cast(_ENTITY))
    return found


def _whole_word(term: Column) -> Column:
    # The literal comes first: the look-behind is tried only where it was found.
    literal = F.concat(F.lit("\\Q"), term, F.lit("\\E"))
    return F.concat(literal, F.lit(f"(?<![{t.WORD}]"), literal, F.lit(f")(?![{t.WORD}])"))


def _label(r: Column) -> Column:
    return F.concat(F.lit("CUSTOM_"), r["domain"], F.lit("_"), F.upper(r["category"]))


def _of_term(parts: Column, low: Column, r: Column) -> Column:
    """Entities of one dictionary term, with the spelling of the text, which comes in ``pieces``."""
    description = F.concat(F.lower(r["domain"]), F.lit(" "), F.replace(r["category"], F.lit("_"), F.lit(" ")))
    return F.transform(
        t.matches(low, _whole_word(r["term"])),
        lambda m: _entity(
            F.struct(
                t.cut(parts, m["start"], m["end"]).alias("text"), m["start"].alias("start"),
                m["end"].alias("end"),
            ),
            _label(r), rules.TERM_CONFIDENCE, description, r["domain"], r["category"],
        ),
    )


def dictionary_entities(text: Column, dictionary=rules.ENTITY_TERMS) -> Column:
    """Whole-word dictionary terms, any case; each term is looked for on its own."""
    terms = t.table(term_rows(dictionary), _TERM)

    def scan(low: Column) -> Column:
        present = F.filter(terms, lambda r: low.contains(r["term"]))
        return t.let(t.pieces(text), lambda parts: F.flatten(F.transform(present, lambda r: _of_term(parts, low, r))))

    return t.let(F.lower(text), scan).cast(_ENTITY)


def entities(df: DataFrame, text_col: str = "text", dictionary=rules.ENTITY_TERMS, custom: bool = True, context: bool = True) -> DataFrame:
    """One row per entity: dictionary entities first, then patterns. Keeps all columns.

    Without ``context`` the text around the entities is not cut out, and its column is left out.
    """
    text = F.col(text_col)
    found = pattern_entities(text)
    if custom:
        found = F.concat(dictionary_entities(text, dictionary), found)

    def shown(e: Column, *around: Column) -> Column:
        return F.struct(
            e["text"].alias("entity"), e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end"),
            e["confidence"].alias("confidence"), e["description"].alias("description"), e["domain"].alias("domain"),
            e["category"].alias("category"), *around,
        )

    # The context is cut while the text is at hand; the text itself is not copied to the rows.
    if context:
        found = t.let(t.pieces(text), lambda parts: F.transform(
            found, lambda e: shown(e, t.around_in(parts, e["start"], e["end"], rules.CONTEXT_CHARS).alias("context"))
        ))
    else:
        found = F.transform(found, lambda e: shown(e))
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, F.posexplode(found).alias("entity_index", "_e")).select(*keep, "entity_index", "_e.*")


def table_entities(
    df: DataFrame, terms: DataFrame, id_col: str, text_col: str = "text", limit: int = Settings.broadcast_rows
) -> DataFrame:
    """Entities of a dictionary table (``term, domain, category``) of any size.

    A term that is one run of word characters is found where a run of the text equals it: the text is
    cut once, whatever the number of its terms. Other texts and terms meet on the first word of the
    term, so the cost does not grow with the dictionary; a term without a word meets them on its
    first character. The hits of a row are gathered by its id and a hash of its text, so rows that
    share an id keep their own, and the texts move once, to their hits. A dictionary of at most
    ``limit`` rows is broadcast, which changes the plan of one join only. Repeated rows and repeated
    terms count each time; null and empty terms have no entities.
    """
    term = F.lower("term")
    key = F.coalesce(F.get(t.word_runs(term), F.lit(0)), F.substring(term, 1, 1))
    keyed = terms.select(term.alias("term"), "domain", "category", key.alias("word")).where(F.col("word") != "")
    keyed = keyed.groupBy("term", "domain", "category", "word").agg(F.count("*").cast("int").alias("times"))
    run = F.col("term") == F.col("word")
    one = F.col("term").rlike(f"^[{t.WORD}]+$")
    rows = _run_entities(df, keyed.where(run & one), id_col, text_col, limit)
    rest = keyed.where(~(run & one))
    if rest.isEmpty():
        return rows
    return rows.unionByName(_term_entities(df, rest, id_col, text_col, limit))


def _run_entities(df: DataFrame, keyed: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    text = F.col(text_col)
    low = F.lower(text)
    # Lower case keeps places unless it changes the length; then the spelling is cut out by its place.
    spelled = F.when(
        F.length(low) == F.length(text), t.word_runs(text)
    ).otherwise(F.transform(F.col("_runs"), lambda m: F.substring(text, m["start"] + 1, m["end"] - m["start"])))
    runs = df.select(F.col(id_col).alias("_id"), text_col, t.word_places(low).alias("_runs"))
    runs = runs.select("_id", F.explode(F.arrays_zip(F.col("_runs").alias("m"), spelled.alias("text"))).alias("_e"))
    words = runs.select("_id", F.col("_e.m.text").alias("word"), F.col("_e.m.start").alias("start"), F.col("_e.m.end").alias("end"), F.col("_e.text").alias("entity"))
    pairs = words.join(F.broadcast(keyed) if is_small(keyed, limit) else keyed, "word")
    pairs = pairs.select("*", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return pairs.select(
        F.col("_id").alias(id_col), "entity", F.concat(F.lit("CUSTOM_"), "domain", F.lit("_"), F.upper("category")).alias("label"),
        "start", "end", F.lit(rules.TERM_CONFIDENCE).alias("confidence"),
    )


def _term_entities(df: DataFrame, keyed: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """Entities of terms that are more, or less, than one run of word characters."""
    low = F.lower(F.col(text_col))
    keys = t.word_runs(low)
    if not keyed.where(~F.col("term").rlike(f"[{t.WORD}]")).isEmpty():
        keys = F.concat(keys, F.regexp_extract_all(low, F.lit(f"[^{t.WORD}]"), F.lit(0)))
    place = [F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash")]
    words = df.select(*place, F.explode(F.array_distinct(keys)).alias("word"))
    pairs = words.join(F.broadcast(keyed) if is_small(keyed, limit) else keyed, "word")
    # A set: rows that repeat id and text bring the same hits, and each of them gets them all.
    hits = pairs.groupBy("_id", "_hash").agg(F.collect_set(F.struct("term", "domain", "category", "times")).alias("hits"))
    text = F.col(text_col)
    found = df.select(id_col, text_col).join(hits, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_hash")))
    each = t.let(
        t.pieces(text),
        lambda parts: F.transform("hits", lambda r: F.flatten(F.array_repeat(_of_term(parts, low, r), r["times"]))),
    )
    rows = found.select(id_col, F.explode(F.flatten(each)).alias("e"))
    return rows.select(id_col, F.col("e.text").alias("entity"), "e.label", "e.start", "e.end", "e.confidence")


def entity_index(entity_rows: DataFrame, id_col: str, source_col: str = "source") -> DataFrame:
    """Postings: label, lower-case entity, document, position, confidence and context."""
    return entity_rows.select(
        "label",
        F.lower("entity").alias("entity"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.col("start").alias("start_pos"),
        F.col("end").alias("end_pos"),
        "confidence",
        "context",
    )


def search_entities(index: DataFrame, label: str | None = None, entity: str | None = None) -> DataFrame:
    """Postings by label, by entity, or both; a label that is unknown counts as not given."""
    if label is None:
        return index.limit(0) if entity is None else index.where(F.col("entity") == entity.lower())
    of_label = index.where(F.col("label") == label)
    if entity is None:
        return of_label
    # One pass over the index: rows of either kind are written, and read for the test and the result.
    same = F.col("entity") == entity.lower()
    kept = stored(index.where(same | (F.col("label") == label)), work_folder(index.sparkSession, "postings"))
    some = kept.where(F.col("label") == label).limit(1)
    return kept.where(same & ((F.col("label") == label) | ~some.exists()))


def label_counts(entity_rows: DataFrame) -> DataFrame:
    return entity_rows.groupBy("label").agg(F.count("*").alias("entities"))


def top_entities(entity_rows: DataFrame, n: int = 20) -> DataFrame:
    counted = entity_rows.groupBy(F.lower("entity").alias("entity")).agg(F.count("*").alias("mentions"))
    return counted.orderBy(F.col("mentions").desc(), "entity").limit(n)


def entity_summary(entity_rows: DataFrame, n: int = 20) -> DataFrame:
    """``section, key, value``: distinct entities, mentions by label, the most common ones.

    Everything follows from counts by (label, entity), which are written: the texts are read once.
    """
    pairs = entity_rows.groupBy("label", F.lower("entity").alias("entity")).agg(F.count("*").alias("n"))
    pairs = stored(pairs, work_folder(entity_rows.sparkSession, "entity-counts"))
    by_text = pairs.groupBy("entity").agg(F.sum("n").alias("n"))
    total = by_text.agg(F.count("*").alias("value")).select(F.lit("total").alias("section"), F.lit("unique_entities").alias("key"), "value")
    labels = pairs.groupBy(F.col("label").alias("key")).agg(F.sum("n").alias("value")).select(F.lit("label").alias("section"), "key", "value")
    common = by_text.orderBy(F.col("n").desc(), "entity").limit(n).select(
        F.lit("common").alias("section"), F.col("entity").alias("key"), F.col("n").alias("value")
    )
    return total.unionByName(labels).unionByName(common)


_CELL = 64


def svo_relations(tokens: DataFrame, entity_rows: DataFrame) -> DataFrame:
    """Subject-verb-object triples whose ends lie inside entities.

    ``tokens`` (doc_id, i, head, text, lemma, pos, dep, idx) is the output of a parser;
    ``entity_rows`` has doc_id, entity_index, entity, label, start, end. Tokens meet
    entities in cells of 64 characters, an equi-join instead of all pairs per document.
    """
    verbs = tokens.where((F.col("pos") == "VERB") & F.col("dep").isin("ROOT", "ccomp")).select(
        "doc_id", F.col("i").alias("verb"), F.col("lemma").alias("relation")
    )
    ends = tokens.where(F.col("dep").isin("nsubj", "nsubjpass", "dobj", "pobj")).select(
        "doc_id", F.col("head").alias("verb"), "i", "idx", F.col("dep").isin("nsubj", "nsubjpass").alias("is_subject")
    )
    cells = entity_rows.select(
        "doc_id", "entity_index", "entity", "label", "start", "end",
        F.explode(F.sequence(F.floor(F.col("start") / _CELL), F.floor((F.col("end") - 1) / _CELL))).alias("cell"),
    )
    inside = (F.col("start") <= F.col("idx")) & (F.col("idx") < F.col("end"))
    named = (
        ends.withColumn("cell", F.floor(F.col("idx") / _CELL))
        .join(cells, ["doc_id", "cell"])
        .where(inside)
        .groupBy("doc_id", "verb", "i", "is_subject")
        .agg(F.min_by(F.struct("entity", "label"), "entity_index").alias("e"))
    )
    subject = named.where("is_subject").select("doc_id", "verb", F.col("i").alias("si"), F.col("e").alias("s"))
    target = named.where("NOT is_subject").select("doc_id", "verb", F.col("i").alias("oi"), F.col("e").alias("o"))
    return (
        subject.join(target, ["doc_id", "verb"])
        .join(verbs, ["doc_id", "verb"])
        .select(
            "doc_id",
            F.col("s.entity").alias("subject"),
            F.col("s.label").alias("subject_type"),
            "relation",
            F.col("o.entity").alias("object"),
            F.col("o.label").alias("object_type"),
            F.lit(0.7).alias("confidence"),
        )
    )
