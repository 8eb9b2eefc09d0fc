"""Token ids as flat binary files with 64-bit document offsets.

Documents are range partitioned by id and every task writes its documents, in order, as one part:

* ``<part>.bin``: the token ids, little-endian unsigned integers of 16 bits if the vocabulary fits,
  of 32 bits otherwise, and nothing else;
* ``<part>.off``: n + 1 little-endian unsigned 64-bit offsets into it, in tokens;
* ``<part>.doc``: n ids of documents as signed 64-bit integers, then n bytes that are 1 where the id
  is null.

A task's row of the manifest (a Parquet table that Spark commits) names its files, which carry a
random name: files of lost or doubled attempts are named by no row. A part's base is the sum of the
tokens of all parts before it. Readers map the files into memory where the store is local.

Encoding: a text is cut at blanks between characters that are no white space; such a blank always
begins a token of the byte-level tokenizer, and such a line end is one, so the pieces can be encoded on
their own, and each different piece is encoded only once as long as a worker remembers it; words are
encoded apart from the signs behind them. Of two generations of
remembered pieces the older one is forgotten when the younger is full; pieces in use move over.
Texts move to the range partitions and are encoded there: their ids take as many bytes as the texts
do compressed, and would have to be stored before the move.

Edge cases: a null or empty text has only the end id; a null id comes before all others, equal ids
are in order of a hash of the text, then of the text; very long texts are taken like others; an
empty table gives an empty manifest. Other columns are left out.
"""

from __future__ import annotations

import json
import os
import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import file_system, runs_by_size, work_folder

END_ID = 0
REMEMBERED = 400_000
BATCH = 4_096
LINE = 256

MANIFEST_SCHEMA = "part int, name string, n_docs long, n_tokens long, width int"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"

BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
BLANK_RUN = re.compile(r"\s ")
LINE_RUN = re.compile(r"\n\s")

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """A tokenizer file that remembers the ids of the pieces it has met, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.cuts = self._cuts_at_blanks(path)
        self.first: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A line end is a token of its own between words; if so, many words are encoded as one text.
        blank, joined, end, word, second, plain = self._ids([" a\n b", "a\nb", "\n", " a", " b", "a"])
        whole = blank == word + end + second and joined == plain + end + self._ids(["b"])[0]
        self.line_end = end if whole and len(end) == self.width else b""

    @staticmethod
    def _cuts_at_blanks(path: str) -> bool:
        """Whether the tokenizer is of the byte-level kind that begins tokens with blanks."""
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        steps = [x for x in made.get("added_tokens", []) if x["single_word"] or x["lstrip"] or x["rstrip"] or " " in x["content"]]
        return bool(plain and not made.get("normalizer") and not made.get("post_processor") and not steps)

    def _ids(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.width == 2 else "I"
        return [array(code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, known: dict[str, bytes], pieces: set[str], before: str) -> None:
        new = pieces.difference(known)
        if before:
            kept = {p: self.older[p] for p in new if p in self.older}
            known.update(kept)
            new.difference_update(kept)
            # A piece that begins with a line end has no blank before its word.
            lines = [p for p in new if p[:1] == "\n"]
            self._learn(self.first, {p[1:] for p in lines}, "")
            known.update((p, self.line_end + self.first[p[1:]]) for p in lines)
            new.difference_update(lines)
        # Signs behind a word are tokens of their own: word and signs are encoded apart, once each.
        apart = {p: core for p in new if (core := p.rstrip(string.punctuation)) != p and core.isalpha()}
        signs = {p[len(core) :] for p, core in apart.items()}
        self._encode_into(known, (new - apart.keys() | set(apart.values())).difference(known), before)
        self._encode_into(self.first, signs.difference(self.first), "")
        known.update((p, known[core] + self.first[p[len(core) :]]) for p, core in apart.items())

    def _encode_into(self, known: dict[str, bytes], new: set[str], before: str) -> None:
        words = [p for p in new if p.isalpha()] if self.line_end else []
        for i in range(0, len(words), LINE):
            part = words[i : i + LINE]
            ids = np.frombuffer(self._ids(["".join([f"{before}{w}\n" for w in part])])[0], f"<u{self.width}")
            ends = np.flatnonzero(ids == np.frombuffer(self.line_end, f"<u{self.width}")[0])
            if len(ends) == len(part):
                raw, at = ids.tobytes(), (ends * self.width).tolist()
                known.update(zip(part, (raw[a:b] for a, b in zip([0, *(x + self.width for x in at)], at))))
        pieces = list(new.difference(known))
        for i in range(0, len(pieces), BATCH):
            part = pieces[i : i + BATCH]
            known.update(zip(part, self._ids([before + x for x in part])))

    def _pieces(self, text: str) -> list[str]:
        """The text cut at single blanks, and before single line ends, between words."""
        plain = text.replace("\n", " \n") if self.line_end else text
        if BLANK_RUN.search(plain) or LINE_RUN.search(plain) or plain[:1] == " ":  # only a pattern finds the places to cut
            return BETWEEN_WORDS.split(text)
        return plain.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of ``width`` bytes an id."""
        if not self.cuts:
            return self._ids(texts)
        if len(self.first) > REMEMBERED:
            self.first = {}
        if len(self.after) > REMEMBERED:
            self.older, self.after = self.after, {}
        split = [self._pieces(t) for t in texts]
        self._learn(self.first, {s[0] for s in split}, "")
        self._learn(self.after, set().union(*split), " ")
        return [self.first[s[0]] + b"".join(map(self.after.__getitem__, s[1:])) for s in split]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(documents: DataFrame, root: str, tokenizer: str, end_id: int = END_ID, run_chars: int = 1 << 20) -> DataFrame:
    """Encode (doc_id, text) in ascending order of doc_id below ``root``; returns the stored manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        end = np.array([end_id], f"<u{made.width}").tobytes()
        store, folder = file_system(f"{root}/parts")
        out, name, lengths, ids = None, uuid.uuid4().hex, [], []
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids.append(batch.column(0))
            for a, b in runs_by_size([len(t) for t in texts], run_chars):
                if out is None:
                    store.create_dir(folder)
                    out = store.open_output_stream(f"{folder}/{name}.bin", compression=None)
                encoded = made.encode(texts[a:b])
                lengths += [len(x) // made.width + 1 for x in encoded]
                out.write(b"".join(y for x in encoded for y in (x, end)))
        if out is None:
            return
        out.close()
        offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.uint64))).astype("<u8")
        with store.open_output_stream(f"{folder}/{name}.off", compression=None) as f:
            f.write(offsets.tobytes())
        joined = pa.chunked_array(ids).combine_chunks() if len(ids) > 1 else ids[0]
        with store.open_output_stream(f"{folder}/{name}.doc", compression=None) as f:
            f.write(joined.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            f.write(joined.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
        row = (TaskContext.get().partitionId(), name, len(lengths), int(offsets[-1]), made.width)
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["part", "name", "n_docs", "n_tokens", "width"])

    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("_hash", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_hash")
        .sortWithinPartitions("doc_id", "_hash", "text")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(write, MANIFEST_SCHEMA).write.parquet(f"{root}/manifest")
    return documents.sparkSession.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``: the tokens of all parts before. It has a row per part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def mapped(path: str) -> np.ndarray:
    """Bytes of a file, mapped into memory where the store is local."""
    store, place = file_system(path)
    if store.type_name == "local":
        return np.memmap(place, np.uint8, "r") if os.path.getsize(place) else np.zeros(0, np.uint8)
    with store.open_input_file(place) as f:
        return np.frombuffer(f.read(), np.uint8)


def read_tokens(manifest: DataFrame, root: str, rows: int = 8_192) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                path, n = f"{root}/parts/{part['name']}", part["n_docs"]
                tokens = mapped(f"{path}.bin").view(f"<u{part['width']}")
                offsets = mapped(f"{path}.off").view("<u8").astype(np.int64)
                docs = mapped(f"{path}.doc")
                ids, absent = docs[: 8 * n].view("<i8"), docs[8 * n :].view(bool)
                for a in range(0, n, rows):
                    b = min(n, a + rows)
                    sums = [zlib.crc32(tokens[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(ids[a:b]), pa.int64(), mask=np.array(absent[a:b])),
                            pa.array(offsets[a:b] + part["base"]),
                            pa.array(offsets[a + 1 : b + 1] - offsets[a:b]),
                            pa.array(sums, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    based = with_bases(manifest)
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(parts).mapInArrow(read, READ_SCHEMA)


def token_index(documents: DataFrame, tokenizer: str | None = None, root: str | None = None) -> DataFrame:
    """Write the documents' tokens and read their index back from the files."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    root = root or work_folder(documents.sparkSession, "tokens")
    return read_tokens(write_tokens(documents, root, tokenizer), root)
