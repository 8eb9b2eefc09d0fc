"""Relations from text patterns, parser output and entity pairs; the relation graph."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom import rules
from docloom.config import Settings
from docloom.functions import text as t
from docloom.operators.topk import top_k
from docloom.session import is_small, stored, work_folder

# A stretch of words and white space; a relation never crosses its ends.
RUN = f"[{t.WORD}](?:[{t.WORD}{t.SPACE}]*[{t.WORD}])?"
# Subject and object have more characters than this.
MIN_CHARS = 2


def connectors(table=rules.RELATION_CONNECTORS) -> list[tuple[int, str, str]]:
    pairs = [(relation, words) for relation, many in table for words in many]
    return [(i, relation, words) for i, (relation, words) in enumerate(pairs)]


def _between(words: str) -> str:
    return f"[{t.SPACE}]+" + f"[{t.SPACE}]+".join(words.split()) + f"[{t.SPACE}]+"


def _pattern(words: str) -> str:
    return f"(?isu)^([{t.WORD}].*){_between(words)}([{t.WORD}].*)$"


def relation_array(text: Column, table=rules.RELATION_CONNECTORS, min_chars: int = MIN_CHARS) -> Column:
    """Relations of a text in order of pattern and position, copies of a triple dropped.

    Both word groups of a pattern are greedy, so a run holds at most one match of each
    pattern: everything before the last connector, everything behind it. Runs without
    any connector are dropped first.
    """
    rows = connectors(table)
    inner = "|".join(sorted({f"[{t.SPACE}]+".join(words.split()) for _, _, words in rows}))
    some = f"(?iu)[{t.SPACE}](?:{inner})[{t.SPACE}]"

    def of_run(run: Column) -> Column:
        return t.let(F.lower(run["text"]), lambda low: matched(run, low))

    def matched(run: Column, low: Column) -> Column:
        body = run["text"]
        found = []
        for i, relation, words in rows:
            p = _pattern(words)
            found.append(
                F.when(
                    low.contains(words.split()[-1]) & body.rlike(p),
                    F.struct(
                        F.lit(i).alias("pattern"),
                        run["start"].alias("start"),
                        run["end"].alias("end"),
                        F.lit(relation).alias("relation"),
                        t.strip(F.regexp_extract(body, p, 1)).alias("subject"),
                        t.strip(F.regexp_extract(body, p, 2)).alias("object"),
                    ),
                )
            )
        return F.filter(
            F.array(*found),
            lambda r: r.isNotNull() & (F.length(r["subject"]) > min_chars) & (F.length(r["object"]) > min_chars),
        )

    def once(found: Column) -> Column:
        keyed = F.sort_array(
            F.transform(
                found,
                lambda r: F.struct(
                    F.lower(r["subject"]).alias("s"), r["relation"].alias("r"), F.lower(r["object"]).alias("o"), r.alias("row")
                ),
            )
        )

        def firsts(k: Column) -> Column:
            def differs(x: Column, i: Column) -> Column:
                before = F.get(k, i - 1)
                return (i == 0) | (x["s"] != before["s"]) | (x["r"] != before["r"]) | (x["o"] != before["o"])

            return F.filter(k, differs)

        return F.sort_array(F.transform(t.let(keyed, firsts), lambda x: x["row"]))

    runs = F.filter(t.matches(text, RUN), lambda r: r["text"].rlike(some))
    return t.let(F.flatten(F.transform(runs, of_run)), once)


def pattern_relations(
    df: DataFrame | pa.Table, text_col: str = "text", table=rules.RELATION_CONNECTORS, context: bool = True
) -> DataFrame | Iterator[pa.Table]:
    """One row per distinct relation of each text, with its ``context`` unless that is not asked for. Keeps all columns but the text.

    Arrow rows of whole texts ``with_words``, which ``count_routes`` hands out, give Arrow rows (doc_id, subject, relation,
    object, confidence, method).
    """
    if isinstance(df, pa.Table):
        return _connected(df, table)
    keep = [c for c in df.columns if c != text_col]
    text = F.col(text_col)

    def shown(r: Column, parts: Column | None) -> Column:
        around = [] if parts is None else [t.around_in(parts, r["start"], r["end"], rules.CONTEXT_CHARS).alias("context")]
        return F.struct(
            r["subject"].alias("subject"), r["relation"].alias("relation"), r["object"].alias("object"),
            F.lit(rules.RELATION_CONFIDENCE).alias("confidence"), F.lit("pattern").alias("method"),
            r["start"].alias("start_pos"), r["end"].alias("end_pos"),
            *around,
        )

    found = relation_array(text, table)
    if context:
        found = t.let(t.pieces(text), lambda parts: F.transform(found, lambda r: shown(r, parts)))
    else:
        found = F.transform(found, lambda r: shown(r, None))
    return df.select(*keep, F.explode(found).alias("_r")).select(*keep, "_r.*")


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(0))


def with_words(texts: pa.Table) -> pa.Table:
    """Adds the list ``words`` of each text, cut out of its ``runs``, and the list ``run_words``: how many each run has."""
    lists = _column(texts, "runs")
    words = pc.utf8_split_whitespace(lists.flatten())
    sizes, ends = pc.list_value_length(words), np.concatenate([[0], np.cumsum(_lengths(lists))])
    places = np.concatenate([[0], np.cumsum(_lengths(words))])[ends]
    flat = words.flatten().dictionary_encode()
    columns = {"words": (places, flat), "run_words": (ends, sizes)}
    for name, (offsets, values) in columns.items():
        texts = texts.append_column(name, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))
    return texts


def _connected(texts: pa.Table, table, min_chars: int = MIN_CHARS) -> Iterator[pa.Table]:
    """The relations of ``relation_array``. A run has word characters and white space only, so its words tell
    where a connector is; a run and the words' places give both sides."""
    lists, flat = _column(texts, "runs"), _column(texts, "words").flatten()
    ends = np.cumsum(_column(texts, "run_words").flatten().to_numpy())
    starts = np.append(0, ends)[:-1]
    run = np.repeat(np.arange(len(ends)), ends - starts)
    text_of_run = np.repeat(np.arange(len(lists)), _lengths(lists))
    pieces, names, indices = lists.flatten(), flat.dictionary, flat.indices
    rows = [(relation, words.split()) for _, relation, words in connectors(table)]
    asked = pa.array([w for _, words in rows for w in words], pa.string())
    # Two numbers for each word: of the connectors' words without regard to case, and as they stand in lower case.
    forms, plain = _folded(asked).unique(), asked.unique()
    codes = pc.fill_null(pc.index_in(_folded(names), forms).take(indices), -1).to_numpy()
    as_is = pc.fill_null(pc.index_in(t.lower_values(names), plain).take(indices), -1).to_numpy()
    found: dict[tuple, tuple] = {}
    for relation, words in rows:
        at = np.arange(len(codes) - len(words) + 1)
        for k, code in enumerate(pc.index_in(_folded(pa.array(words)), forms).to_pylist()):
            at = at[codes[at + k] == code]
        at = at[(at > starts[run[at]]) & (at + len(words) < ends[run[at]])]
        at = at[np.append(run[at][1:] != run[at][:-1], True)[: len(at)]]
        same = as_is[at + len(words) - 1] == plain.index(words[-1]).as_py()
        for r, j, known, piece in zip(run[at].tolist(), at.tolist(), same.tolist(), pieces.take(pa.array(run[at])).to_pylist()):
            if not known and words[-1] not in piece.lower():
                continue
            subject = piece.rsplit(None, int(ends[r]) - j)[0]
            target = piece.split(None, j + len(words) - int(starts[r]))[-1]
            if len(subject) > min_chars and len(target) > min_chars:
                text = int(text_of_run[r])
                found.setdefault((text, subject.lower(), relation, target.lower()), (text, subject, relation, target))
    text, *sides = zip(*found.values()) if found else [()] * 4
    yield pa.table({
        "doc_id": texts["doc_id"].take(pa.array(text, pa.int64())), **{c: pa.array(x, pa.string()) for c, x in zip(TRIPLE, sides)},
        "confidence": pa.repeat(rules.RELATION_CONFIDENCE, len(text)), "method": pa.repeat("pattern", len(text)),
    })


TRIPLE = ("subject", "relation", "object")


def _folded(values: pa.Array) -> pa.Array:
    """The form in which Java compares letters if case is ignored."""
    return pc.utf8_lower(pc.utf8_upper(values))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of complete texts from rows in which those of a text lie together.

    Only the text that a batch leaves open is held back.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        others = np.flatnonzero(~_true(pc.equal(ids, ids[-1])))
        cut = int(others[-1]) + 1 if len(others) else 0
        if held and (cut or held[-1].column(0)[-1] != ids[0]):
            done = pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
            yield done.combine_chunks()
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        if cut < batch.num_rows:
            held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(rows: pa.Table, name: str) -> pa.Array:
    parts = rows.column(name).chunks
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def _numbers(column: pa.Array) -> np.ndarray:
    """Integers, 0 where null."""
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def _true(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, False).to_numpy(zero_copy_only=False)


def _text_numbers(ids: pa.Array) -> np.ndarray:
    """0, 1, ...: the place of each row's text among the texts. A row without an id is a text of its own."""
    changes = ~_true(pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)))
    return np.concatenate([[0], np.cumsum(changes)])


def _coded(column: pa.Array) -> pa.DictionaryArray:
    return column if pa.types.is_dictionary(column.type) else column.dictionary_encode()


def _plain(column: pa.Array) -> pa.Array:
    return column.dictionary_decode() if pa.types.is_dictionary(column.type) else column


def _one_of(column: pa.Array, *names: str) -> np.ndarray:
    """True where a column has one of some values."""
    coded = _coded(column)
    known = np.append(_true(pc.is_in(coded.dictionary, pa.array(names))), False)
    return known[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)]


def _lowered(column: pa.Array) -> pa.Array:
    coded = _coded(column)
    return t.lower_values(coded.dictionary).take(coded.indices)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows repeated for each place from ``first`` to ``last`` (exclusive), and the places."""
    n = np.maximum(last - first, 0)
    rows = np.repeat(np.arange(len(n)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _equal(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of equal keys."""
    order = np.argsort(right, kind="stable")
    keys = right[order]
    rows, places = _ranges(np.searchsorted(keys, left, "left"), np.searchsorted(keys, left, "right"))
    return rows, order[places]


def _together(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", *order)


def dependency_relations(tokens: DataFrame | pa.Table, together: bool = False) -> DataFrame | Iterator[pa.Table]:
    """Relations from parser tokens (doc_id, i, head, text, lemma, pos, dep).

    A text's tokens are gathered once, unless they lie together already (``together``: rows that an
    ``explode`` made of one row per text), and meet their heads there. A task holds one batch of rows
    and the text that it leaves open. Arrow rows of whole texts, which ``count_routes`` hands out, give Arrow rows.
    """
    if isinstance(tokens, pa.Table):
        return _dependencies(tokens.filter(pc.is_valid(tokens["doc_id"])).combine_chunks())
    rows = tokens.where(F.col("doc_id").isNotNull()).select("doc_id", "i", "head", "text", "lemma", "pos", "dep")
    if not together:
        rows = _together(rows)
    kept = T.StructType([
        rows.schema["doc_id"], *[T.StructField(c, T.StringType()) for c in ("subject", "relation", "object")],
        T.StructField("confidence", T.DoubleType()), *[T.StructField(c, T.StringType()) for c in ("method", "pos_pattern")],
    ])
    arrow = to_arrow_schema(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _whole_texts(batches):
            found = [pa.Table.from_arrays(x.columns, schema=arrow) for x in _dependencies(texts)]
            yield from pa.concat_tables(found).to_batches(1 << 16) if found else []

    return rows.mapInArrow(run, kept)


def _dependencies(rows: pa.Table) -> Iterator[pa.Table]:
    if not rows.num_rows:
        return
    ids, text, lemma, dep = (_column(rows, c) for c in ("doc_id", "text", "lemma", "dep"))
    place, head = _column(rows, "i"), _column(rows, "head")
    has_place, has_head = _true(place.is_valid()), _true(head.is_valid())
    place, head = _numbers(place), _numbers(head)
    least = min(place.min(), head.min())
    base = _text_numbers(ids) * (max(place.max(), head.max()) - least + 1) - least
    own, above = base + place, base + head
    dep = _coded(dep)

    def of(name: str) -> np.ndarray:
        return np.flatnonzero(_one_of(dep, name) & has_head)

    verbs = np.flatnonzero(_one_of(_column(rows, "pos"), "VERB") & has_place)
    subjects, targets, preps, under = of("nsubj"), of("dobj"), of("prep"), of("pobj")
    s, v = _equal(above[subjects], own[verbs])
    subjects, verbs = subjects[s], verbs[v]

    def out(subject: np.ndarray, relation: pa.Array, target: np.ndarray, confidence: float, shape: str) -> pa.Table:
        n = len(subject)
        columns = {
            "doc_id": ids.take(pa.array(subject)), "subject": text.take(pa.array(subject)), "relation": relation,
            "object": text.take(pa.array(target)), "confidence": pa.repeat(confidence, n),
            "method": pa.repeat("dependency", n), "pos_pattern": pa.repeat(shape, n),
        }
        return pa.table(columns)

    a, b = _equal(above[subjects], above[targets])
    yield out(subjects[a], lemma.take(pa.array(verbs[a])), targets[b], 0.7, "nsubj-verb-dobj")
    preps = preps[has_place[preps]]
    a, b = _equal(above[subjects], above[preps])
    c, d = _equal(own[preps[b]], above[under])
    a, b = a[c], b[c]
    verb_prep = pc.binary_join_element_wise(
        _plain(lemma.take(pa.array(verbs[a]))), _plain(text.take(pa.array(preps[b]))), "_", null_handling="skip"
    )
    yield out(subjects[a], verb_prep, under[d], 0.6, "nsubj-verb-prep-pobj")
    heads = np.flatnonzero(has_place)
    for name, relation, confidence, shape in (("compound", "MODIFIES", 0.5, "compound"), ("poss", "POSSESSES", 0.6, "possessive")):
        nouns = of(name)
        a, b = _equal(above[nouns], own[heads])
        yield out(nouns[a], pa.repeat(relation, len(a)), heads[b], confidence, shape)


def entity_pair_relations(spans: DataFrame, tokens: DataFrame, reach: int = rules.ENTITY_PAIR_TOKENS) -> DataFrame:
    """Relations between entities at most ``reach`` tokens apart.

    ``spans`` (doc_id, ord, text, label, first, last) are entities in text order with
    token positions, last exclusive. Both sides of a text are gathered once; an entity meets only
    those that begin within reach of its end, never all entities of its text.
    """
    links = tokens.where(linking()).select("doc_id", F.col("i").cast("long").alias("i"), F.col("text").alias("word"))
    marked = links.unionByName(
        spans.select("doc_id", F.struct(*[F.col(c) for c in SPAN]).alias("span")), allowMissingColumns=True
    )
    return marked_pair_relations(marked, reach, together=False)


SPAN = ("ord", "text", "label", "first", "last")


LINKING = ("VERB", "ADP")


def linking() -> Column:
    return F.col("pos").isin(*LINKING)


def marked_pair_relations(
    marked: DataFrame | pa.Table, reach: int = rules.ENTITY_PAIR_TOKENS, together: bool = True
) -> DataFrame | Iterator[pa.Table]:
    """The same of one table: tokens (doc_id, i, word, span), ``word`` null unless the token links,
    ``span`` (ord, text, label, first, last) null unless an entity belongs to the row. Arrow rows of
    whole texts, which ``count_routes`` hands out, give Arrow rows."""
    if isinstance(marked, pa.Table):
        return _pairs(_marked_rows(marked), reach)
    span = F.col("span")
    numbers = [span[c].cast("long").alias(c) for c in ("ord", "first", "last")]
    rows = marked.where(F.col("doc_id").isNotNull() & (F.col("word").isNotNull() | span.isNotNull())).select(
        "doc_id", "i", "word", F.lower("word").alias("low_word"), *numbers, span["text"].alias("text"),
        F.lower(span["text"]).alias("low_text"), span["label"].alias("label"),
    )
    if not together:
        rows = _together(rows, "i", "word")
    names = ("subject", "subject_type", "relation", "object", "object_type")
    kept = T.StructType([
        rows.schema["doc_id"], *[T.StructField(c, T.StringType()) for c in names], T.StructField("confidence", T.DoubleType()),
        T.StructField("method", T.StringType()), T.StructField("distance", T.IntegerType()),
    ])
    arrow = to_arrow_schema(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _whole_texts(batches):
            for some in _pairs(texts, reach):
                yield from pa.Table.from_arrays(some.columns, schema=arrow).to_batches()

    return rows.mapInArrow(run, kept)


def _marked_rows(marked: pa.Table) -> pa.Table:
    """What ``_pairs`` reads of Arrow rows (doc_id, i, word, span)."""
    marked = marked.filter(pc.and_(pc.is_valid(marked["doc_id"]), pc.or_(pc.is_valid(marked["word"]), pc.is_valid(marked["span"]))))
    marked = marked.combine_chunks()
    if not marked.num_rows:
        return marked
    word, span = _column(marked, "word"), _column(marked, "span")
    fields = {c: pc.struct_field(span, c) for c in SPAN}
    low = {"low_word": _lowered(word), "low_text": _lowered(fields["text"])}
    return pa.table({"doc_id": marked["doc_id"], "i": marked["i"], "word": word, **fields, **low})


# Pairs that are made at a time.
_PAIRS = 1 << 16


def _pairs(rows: pa.Table, reach: int) -> Iterator[pa.Table]:
    if not rows.num_rows:
        return
    numbers = _text_numbers(_column(rows, "doc_id"))
    spans = np.flatnonzero(_true(pc.and_(_column(rows, "first").is_valid(), _column(rows, "last").is_valid())))
    links = np.flatnonzero(_true(pc.and_(_column(rows, "word").is_valid(), _column(rows, "i").is_valid())))
    if not len(spans):
        return
    order, first, last, at = (_numbers(_column(rows, c)) for c in ("ord", "first", "last", "i"))
    first, last, order = first[spans], last[spans], order[spans]
    low = min(first.min(), last.min(), at.min()) - reach
    base = numbers * (max(first.max(), last.max(), at.max()) + reach + 1 - low) - low
    starts = base[spans] + first
    by_start = np.argsort(starts, kind="stable")
    ends = base[spans] + last
    near = np.searchsorted(starts[by_start], ends - reach, "left"), np.searchsorted(starts[by_start], ends + reach, "right")
    links = links[np.argsort((base + at)[links], kind="stable")]
    places, words = (base + at)[links], _plain(_column(rows, "word").take(pa.array(links)))
    # Equal lower-case forms have equal codes; null has -1 and equals nothing.
    forms = pa.concat_arrays([_column(rows, "low_word").take(pa.array(links)), _column(rows, "low_text").take(pa.array(spans))])
    codes = pc.fill_null(forms.dictionary_encode().indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    word_codes, text_codes = codes[: len(links)], codes[len(links) :]
    ids, text, label = (_column(rows, c).take(pa.array(spans)) for c in ("doc_id", "text", "label"))
    total = np.cumsum(near[1] - near[0])
    cuts = np.unique(np.searchsorted(total, np.arange(_PAIRS, total[-1], _PAIRS), "left"))
    for some in np.split(np.arange(len(spans)), cuts):
        a, b = _ranges(near[0][some], near[1][some])
        a, b = some[a], by_start[b]
        later = order[b] > order[a]
        a, b = a[later], b[later]
        if not len(a):
            continue
        low_place = base[spans[a]] + np.minimum(first[a], first[b])
        high_place = base[spans[a]] + np.maximum(last[a], last[b]) - 1
        pair, link = _ranges(np.searchsorted(places, low_place, "left"), np.searchsorted(places, high_place, "right"))
        known = (text_codes[a] >= 0) & (text_codes[b] >= 0)
        other = known[pair] & (word_codes[link] != text_codes[a][pair]) & (word_codes[link] != text_codes[b][pair])
        pair, link = pair[other], link[other]
        n = np.bincount(pair, minlength=len(a))
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(link))), "_")
        types = [_plain(label.take(pa.array(x))) for x in (a, b)]
        fallback = pc.binary_join_element_wise("RELATED_TO", *types, "_", null_handling="skip")
        distance = np.abs(first[b] - last[a])
        columns = {
            "doc_id": ids.take(pa.array(a)), "subject": text.take(pa.array(a)), "subject_type": types[0],
            "relation": pc.if_else(pa.array(n > 0), joined, fallback), "object": text.take(pa.array(b)), "object_type": types[1],
            "confidence": pa.array(np.maximum(0.3, 0.8 - distance * 0.05)), "method": pa.repeat("entity", len(a)),
            "distance": pa.array(distance.astype(np.int32)),
        }
        yield pa.table(columns)


def first_of_triple(relations: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each (subject, relation, object), compared lower-case and trimmed."""
    keys = [t.strip(F.lower(F.col(c))) for c in ("subject", "relation", "object")]
    named = relations.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    full = named.where((F.col("_k0") != "") & (F.col("_k1") != "") & (F.col("_k2") != ""))
    return top_k(full, [*by, "_k0", "_k1", "_k2"], order, 1, "_n").drop("_k0", "_k1", "_k2", "_n")


ROUTES = ("pattern", "dependency", "entity")


def extract_relations(routes: list[DataFrame], by: str = "doc_id") -> DataFrame:
    """The union of several routes' relations (subject, relation, object, confidence, method), each
    triple once per text: the first route of ``ROUTES`` that has it keeps it."""
    columns = [by, "subject", "relation", "object", "confidence", "method"]
    rows = routes[0].select(*columns)
    for other in routes[1:]:
        rows = rows.unionByName(other.select(*columns))
    route = F.array_position(F.array(*map(F.lit, ROUTES)), F.col("method"))
    return first_of_triple(rows, [by], [route, F.col("subject"), F.col("relation"), F.col("object")])


def lone_texts(df: DataFrame, by: str = "doc_id", limit: int = Settings.broadcast_rows) -> DataFrame:
    """Adds ``alone``: true if the row has an id that no other row has. Only ids are read and moved for it,
    unless more than ``limit`` of them are repeated."""
    ids = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_rows"))
    many = ids.where(F.col("_rows") > 1).select(by, F.lit(True).alias("_many"))
    if is_small(many, limit):
        many = F.broadcast(many)
    alone = F.col(by).isNotNull() & F.col("_many").isNull()
    return df.join(many, by, "left").select(*df.columns, alone.alias("alone"))


# Bytes of the texts that are read at a time (a longer text is read by itself), and triples that are held.
_STEP_BYTES = 1 << 20
_STEP_TRIPLES = 1 << 20

Routes = Callable[[pa.Table], list[Iterable[pa.Table]]]


def count_routes(texts: DataFrame, routes: Routes) -> DataFrame:
    """``doc_id, method, relations``: how many triples of a text each of ``extract_relations``' routes keeps.

    ``texts`` has one row per text: ``doc_id``, ``alone`` (``lone_texts``), its ``runs``, and what else the routes read.
    ``routes`` makes of Arrow rows of whole texts, with numbers for ids, the relations (doc_id, subject, relation,
    object) of each of ``ROUTES``. The triples of a text that is alone meet where it lies, only their number moves.
    Those of rows that share an id or have none, and of steps with over ``_STEP_TRIPLES``, are shuffled, without the
    copies that a step sees.
    """
    texts = texts.select("doc_id", *[c for c in texts.columns if c != "doc_id"])
    keys = [T.StructField(f"_k{i}", T.StringType()) for i in range(3)]
    kept = T.StructType([texts.schema["doc_id"], *keys, T.StructField("route", T.IntegerType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _whole_texts(batches):
            for step in _text_steps(some):
                for columns in _step_counts(step, routes):
                    yield from pa.Table.from_arrays(columns, schema=arrow).to_batches(1 << 16)

    found = texts.mapInArrow(run, kept)
    # A text that was counted has no keys and one row for each route.
    counted = F.when(F.col("_k0").isNull(), F.col("route")).alias("_counted")
    once = found.groupBy("doc_id", "_k0", "_k1", "_k2", counted).agg(F.min("route").alias("route"), F.max("n").alias("n"))
    total = once.groupBy("doc_id", "route").agg(F.sum("n").alias("relations"))
    return total.select("doc_id", F.get(F.array(*map(F.lit, ROUTES)), F.col("route") - 1).alias("method"), "relations")


def _text_steps(texts: pa.Table) -> Iterator[pa.Table]:
    """Rows of at most ``_STEP_BYTES``, or of one text that has more; rows of a text stay together."""
    # The rows and the bytes up to the end of each text.
    rows = np.append(np.flatnonzero(np.diff(_text_numbers(_column(texts, "doc_id")))) + 1, texts.num_rows)
    size = np.cumsum(_run_bytes(texts))[rows - 1]
    first = at = 0
    while at < len(rows):
        before = int(size[at - 1]) if at else 0
        at = max(int(np.searchsorted(size, before + _STEP_BYTES, "right")), at + 1)
        yield texts.slice(first, int(rows[at - 1]) - first)
        first = int(rows[at - 1])


def _run_bytes(texts: pa.Table) -> np.ndarray:
    lists = _column(texts, "runs")
    up_to = np.concatenate([[0], np.cumsum(pc.binary_length(lists.flatten()).to_numpy(), dtype=np.int64)])
    return np.diff(up_to[np.concatenate([[0], np.cumsum(_lengths(lists))])])


def _step_counts(rows: pa.Table, routes: Routes) -> Iterator[list[pa.Array]]:
    ids, rows = _column(rows, "doc_id"), rows.combine_chunks()
    numbers = _text_numbers(ids)
    firsts = np.flatnonzero(np.diff(numbers, prepend=-1))
    alone = _true(_column(rows, "alone"))[firsts]
    known = _true(ids.is_valid())
    # The last place is that of rows without an id.
    ids, alone = ids.take(pa.array([*firsts, None], pa.int64())), np.append(alone, False)
    found = routes(rows.set_column(rows.schema.get_field_index("doc_id"), "doc_id", pa.array(numbers, mask=~known)))
    held, n = [], 0
    for route, part in ((route, part) for route, many in enumerate(found, 1) for part in many):
        held.append((route, part.select(["doc_id", *TRIPLE])))
        n += part.num_rows
        if n > _STEP_TRIPLES:
            alone = alone & False
            yield from _distinct(held, ids, alone)
            held, n = [], 0
    yield from _distinct(held, ids, alone)


def _distinct(parts: list[tuple[int, pa.Table]], ids: pa.Array, alone: np.ndarray) -> Iterator[list[pa.Array]]:
    """Different triples of the texts that are not alone, and the number that each route keeps of the others."""
    parts = [(route, part) for route, part in parts if part.num_rows]
    if not parts:
        return
    text = np.concatenate([pc.fill_null(x["doc_id"], len(ids) - 1).to_numpy() for _, x in parts])
    route = np.repeat(np.array([r for r, _ in parts]), [x.num_rows for _, x in parts])
    codes, forms = _forms([[c for _, x in parts for c in x[name].chunks] for name in TRIPLE])
    full = np.flatnonzero(np.all([c >= 0 for c in codes], axis=0))
    if not len(full):
        return
    # Parts come by route, so the first of equal triples is that of the route that keeps it.
    _, first = np.unique(_packed([text[full], *[c[full] for c in codes]]), return_index=True)
    first = full[first]
    own = alone[text[first]]
    cells, n = np.unique(text[first[own]] * (len(ROUTES) + 1) + route[first[own]], return_counts=True)
    none = pa.nulls(len(n), pa.string())
    at, by_route = np.divmod(cells, len(ROUTES) + 1)
    yield [ids.take(pa.array(at)), none, none, none, pa.array(by_route, pa.int32()), pa.array(n, pa.int64())]
    first = first[~own]
    keys = [forms.take(pa.array(c[first])) for c in codes]
    yield [ids.take(pa.array(text[first])), *keys, pa.array(route[first], pa.int32()), pa.array(np.ones(len(first), np.int64))]


def _forms(columns: list[list[pa.Array]]) -> tuple[list[np.ndarray], pa.Array]:
    """Codes of the lower-case, trimmed values of each column, -1 if null or empty; the values of the codes."""
    coded = [[_coded(c) for c in chunks] for chunks in columns]
    # Chunks that share a dictionary have its values looked at once.
    names, begins, size = [], {}, 0
    for c in (c for chunks in coded for c in chunks):
        values = c.dictionary
        key = (values.offset, len(values), *[b.address if b else 0 for b in values.buffers()])
        if key not in begins:
            begins[key], size = size, size + len(values)
            names.append(values)
    low = pc.utf8_trim(t.lower_values(pa.concat_arrays(names)), t.SPACE_CHARS)
    forms = pc.if_else(pc.equal(low, ""), None, low).dictionary_encode()
    places = np.append(pc.fill_null(forms.indices, -1).to_numpy(), -1)

    def codes(c: pa.DictionaryArray) -> np.ndarray:
        values = c.dictionary
        at = begins[(values.offset, len(values), *[b.address if b else 0 for b in values.buffers()])]
        return places[pc.fill_null(pc.add(c.indices, at), -1).to_numpy()]

    return [np.concatenate([codes(c) for c in chunks]) for chunks in coded], forms.dictionary


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """Equal numbers for equal rows, and only for them."""
    key, size = columns[0].astype(np.int64), int(columns[0].max()) + 1
    for column in columns[1:]:
        width = int(column.max()) + 1
        if size * width >= 1 << 62:
            names, key = np.unique(key, return_inverse=True)
            size = len(names)
        key, size = key * width + column, size * width
    return key


def relation_counts(relations: DataFrame, *by: str) -> DataFrame:
    return relations.groupBy(*by, "relation").agg(F.count("*").alias("relations"))


def relation_statistics(relations: DataFrame, n: int = 20) -> DataFrame:
    """``section, key, value``: totals, counts by method, mean confidence, common types."""
    pairs = relations.groupBy("relation", "method").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    # Written, so that the texts are read once.
    pairs = stored(pairs, work_folder(relations.sparkSession, "relation-counts"))
    total = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total_relationships"),
        F.count_distinct("relation").cast("double").alias("unique_patterns"),
        F.round(F.coalesce(F.sum("c") / F.sum("n"), F.lit(0.0)), 6).alias("average_confidence"),
    )
    totals = total.select(
        F.lit("total").alias("section"),
        F.expr("stack(3, 'total_relationships', total_relationships, 'unique_patterns', unique_patterns, 'average_confidence', average_confidence)").alias("key", "value"),
    )
    methods = pairs.groupBy(F.col("method").alias("key")).agg(F.sum("n").cast("double").alias("value"))
    common = pairs.groupBy(F.col("relation").alias("key")).agg(F.sum("n").cast("double").alias("value"))
    common = common.orderBy(F.col("value").desc(), "key").limit(n)
    return totals.unionByName(methods.select(F.lit("method").alias("section"), "key", "value")).unionByName(
        common.select(F.lit("pattern").alias("section"), "key", "value")
    )


def graph_edges(relations: DataFrame) -> DataFrame:
    return relations.where((F.col("subject") != "") & (F.col("object") != "")).select(
        F.col("subject").alias("from"), F.col("object").alias("to"), F.col("relation").alias("label"), "confidence", "method"
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Nodes with their number of edge ends and drawing size, in one aggregation."""
    ends = edges.select(F.explode(F.array("from", "to")).alias("id"))
    return (
        ends.groupBy("id")
        .agg(F.count("*").alias("connections"))
        .withColumn("label", F.col("id"))
        .withColumn("size", F.least(F.col("connections") * 2 + 5, F.lit(20)))
    )


def most_connected(nodes: DataFrame, n: int = 10) -> DataFrame:
    return nodes.orderBy(F.col("connections").desc(), "id").limit(n).select("id", "connections")


def graph_counts(edges: DataFrame) -> DataFrame:
    nodes = graph_nodes(edges)
    return nodes.agg(
        F.count("*").alias("node_count"), F.coalesce((F.sum("connections") / 2).cast("long"), F.lit(0)).alias("edge_count")
    )
