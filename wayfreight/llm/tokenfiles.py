"""Token ids as Parquet files in the order of the documents, written for selective reads.

``<root>/tokens`` has one row a document: doc_id, part, start_in_part, n_tokens, token_ids. Ids are a list
column, dictionary-encoded or delta-encoded; the numbers beside it are delta-encoded. Row groups and pages are
small and the files carry page indexes, so that a range of documents is read by its pages, and a reader
that wants no ids leaves their column alone. ``<root>/index`` has one row a file: its documents, its tokens
and how many tokens all files before it hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight.llm.common import narrow, sliced
from wayfreight.session import shared_dir

ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 256  # documents of which a page may hold the ids
PAGE_BYTES = 256 << 10
#: A worker remembers at most twice so many chunks: once it has met so many since the last time, it forgets
#: those that were not among them.
MOST_CHUNKS = 1 << 18
CHUNK_CHARS = 64  # longer chunks are not remembered
LEARN_TOGETHER = 24  # chunks in one text for the library; short texts are quicker for it than long ones
ENCODINGS = ("dictionary", "delta")
NUMBERS = ("doc_id", "part", "start_in_part", "n_tokens")

TOKENS = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, token_ids array<int>"
INDEX = "part int, first_doc bigint, last_doc bigint, docs bigint, tokens bigint, start bigint"

#: A place where a text may be cut: a blank that something other than white space follows. The byte-level
#: pattern takes such a blank with what follows it, and white space before it by itself, cut or not.
CUT = r" (?=\S)"
#: A blank that is no such place.
OTHER_BLANK = r" (?!\S)"
#: Characters whose class in the byte-level pattern is beyond doubt: printable ASCII, Latin letters, and a line feed inside.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
PLAIN = rf"[!-~{LETTERS}]+(?:\n+[!-~{LETTERS}]+)*"
#: The byte-level pattern over these characters.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^ \n0-9{LETTERS}]+|[ \n]+(?![^ \n])|[ \n]+"
BETWEEN = "\0"  # stands in no plain chunk


class ChunkEncoder:
    """Encodes whole texts with the tokenizers library, chunk by chunk; chunks that come again are looked up.

    Natural text repeats its words, so most chunks are known after some documents. The others go to the library
    some at a time as one text, with a line feed before each, whose tokens fall apart at the chunks' bytes. Those of plain
    characters are cut by the pattern here and go to the library's model alone.
    """

    def __init__(self, vocabulary: str):
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has given each task its core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tokenizer.get_vocab()
        #: Bytes of each token: the vocabulary spells one character for each byte.
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.cut = re.compile(CUT).split
        self.odd = re.compile(OTHER_BLANK).search
        self.plain = re.compile(PLAIN).fullmatch
        self.pieces = re.compile(PIECES).findall
        # The same model by itself: pieces come to it as the pattern cuts them and as the vocabulary spells them.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(BETWEEN)
        self.spelled = byte_spelling() | {ord(BETWEEN): BETWEEN}
        self.by_model = by_this_pattern(self.tokenizer) and vocab.keys() >= set(byte_spelling().values())
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def _chunks(self, texts: list[str]) -> tuple[list[int], pa.Array, np.ndarray]:
        """The texts at their cuts: places of the texts, all their chunks, n + 1 offsets. All chunks but a text's first have lost their blank."""
        odd = [k for k, t in enumerate(texts) if self.odd(t)]
        apart = set(odd)
        even = [k for k in range(len(texts)) if k not in apart]
        by_blank = pc.split_pattern(pa.array([texts[k] for k in even], pa.string()), " ")
        by_cut = pa.array([self.cut(texts[k]) for k in odd], pa.list_(pa.string()))
        sizes = np.concatenate([pc.list_value_length(lists).to_numpy() for lists in (by_blank, by_cut)]).astype(np.int64)
        return even + odd, pa.concat_arrays([by_blank.flatten(), by_cut.flatten()]), np.concatenate(([0], np.cumsum(sizes)))

    def _by_model(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of plain chunks with their blank. The library's own cutting of short texts costs more than its model."""
        if not chunks:
            return {}
        pieces = self.pieces(" " + " ".join(chunks))
        texts = [BETWEEN.join(pieces[k : k + LEARN_TOGETHER]) for k in range(0, len(pieces), LEARN_TOGETHER)]
        texts = [
            t.replace(" ", "Ġ").replace("\n", "Ċ") if t.isascii() else t.encode().decode("latin-1").translate(self.spelled) for t in texts
        ]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum([(len(c) if c.isascii() else len(c.encode())) + 1 for c in chunks])
        at = (4 * np.searchsorted(np.cumsum(self.width[ids]), ends) + 4).tolist()
        raw = ids.tobytes()
        return {c: raw[a:b] for c, a, b in zip(chunks, [0, *at[:-1]], at)}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks with their blank, from texts of some of them at a time."""
        plain = [c for c in chunks if self.plain(c)] if self.by_model else []
        if len(plain) == len(chunks):
            return self._by_model(plain)
        apart = set(plain)
        return self._by_model(plain) | self._learn_whole([c for c in chunks if c not in apart])

    def _learn_whole(self, chunks: list[str]) -> dict[str, bytes]:
        # White space at the end of a chunk would run into the line feed after it: such chunks go alone.
        alone = [c for c in chunks if c[-1].isspace() or c[-1] < " "]
        if alone:
            apart = set(alone)
            chunks = [c for c in chunks if c not in apart]
        # "\n" and the blank of the next chunk are tokens of their own, whatever stands around them.
        texts = ["\n " + "\n ".join(chunks[k : k + LEARN_TOGETHER]) for k in range(0, len(chunks), LEARN_TOGETHER)]
        ids = np.concatenate([np.zeros(0, "<u4"), *self._whole(texts)])
        ends = np.cumsum([len(c.encode()) + 2 for c in chunks])
        at = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
        raw = ids.tobytes()
        found = {c: raw[4 * a + 4 : 4 * b] for c, a, b in zip(chunks, [0, *at[:-1].tolist()], at.tolist())}
        return found | {c: own.tobytes() for c, own in zip(alone, self._whole([f" {c}" for c in alone]))}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, little-endian unsigned 32-bit."""
        return [np.frombuffer(raw, "<u4") for raw in self.encode_raw(texts)]

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """The bytes of the ids of each text."""
        if len(self.known) > MOST_CHUNKS:
            self.earlier, self.known = self.known, {}
        if not texts:
            return []
        order, chunks, at = self._chunks(texts)
        rest = np.ones(len(chunks), bool)
        rest[at[:-1]] = False
        heads = self._whole(chunks.filter(pa.array(~rest)).to_pylist())
        coded = chunks.filter(pa.array(rest)).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # as to_pylist, several times faster
        ids = list(map(self.known.get, distinct))
        unknown = [k for k, raw in enumerate(ids) if raw is None]
        found = {distinct[k]: self.earlier.get(distinct[k]) for k in unknown}
        missing = [c for c, raw in found.items() if raw is None]
        if missing:
            found |= self._learn(missing)
        for k in unknown:
            ids[k] = found[distinct[k]]
        self.known |= {c: raw for c, raw in found.items() if len(c) <= CHUNK_CHARS}
        laid = pa.array(ids, pa.large_binary()).take(coded.indices)
        _, ends, data = laid.buffers()
        ends = np.frombuffer(ends, np.int64)[laid.offset :][at - np.arange(len(at))].tolist() if len(laid) else [0] * len(at)
        data = memoryview(data or b"")
        out = [b""] * len(texts)
        for k, head, a, b in zip(order, heads, ends[:-1], ends[1:]):
            out[k] = head.tobytes() + data[a:b]
        return out


def byte_spelling() -> dict[int, str]:
    """The character by which a byte-level vocabulary spells each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def by_this_pattern(tokenizer) -> bool:
    """Whether the tokenizer is byte-level BPE that cuts by the pattern of ``PIECES`` and nothing else."""
    import json

    made = json.loads(tokenizer.to_str())
    cuts, model = made["pre_tokenizer"] or {}, made["model"]
    plain_model = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
    by_bytes = cuts.get("type") == "ByteLevel" and cuts.get("use_regex") and not cuts.get("add_prefix_space")
    special = all(t["special"] for t in made["added_tokens"])  # these are ordinary text here
    return bool(by_bytes and special and made["normalizer"] is None and model["type"] == "BPE" and plain_model)


def encoder(vocabulary: str | None = None) -> ChunkEncoder:
    """The encoder of a vocabulary file, made once in each worker. Default: the public 50k byte vocabulary."""
    import public_tokenizers
    import tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    # Code of tasks travels with them and starts anew each time; what the library's module holds stays.
    made = tokenizers.__dict__.setdefault("_chunk_encoders", {})
    if vocabulary not in made:
        made[vocabulary] = ChunkEncoder(vocabulary)
    return made[vocabulary]


def _encode_batches(vocabulary: str | None, end_id: int | None):
    """Sorted texts -> rows of the token files, with places within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(vocabulary).encode_raw
        last = np.array([] if end_id is None else [end_id], "<u4").tobytes()
        place = 0
        for batch in sliced(batches, "text", 4 << 20):
            ids = [raw + last for raw in encode([t or "" for t in batch.column("text").to_pylist()])]
            n = np.array([len(raw) // 4 for raw in ids], np.int64)
            at = np.concatenate(([0], np.cumsum(n)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(np.full(len(ids), part, np.int32)),
                    pa.array(place + at[:-1]),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))),
                ],
                names=["doc_id", "part", "start_in_part", "n_tokens", "token_ids"],
            )
            place += int(at[-1])

    return run


def writer_options(encoding: str, row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS) -> dict[str, str]:
    """How Spark's Parquet writer lays the files out.

    Where a dictionary is off, the second data page version stores integers as deltas. Column and offset
    indexes are written with every file.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding is one of {', '.join(ENCODINGS)}")
    return {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true" if encoding == "dictionary" else "false",
        **{f"parquet.enable.dictionary#{c}": "false" for c in NUMBERS},
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.block.size.row.check.min": "10",
        "compression": "zstd",
    }


def write_tokens(
    docs: DataFrame,
    root: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int | None = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every whole text and write the token files and their index below ``root``.

    Texts are sorted by id first, rows without an id before all others and rows that share one by a hash of their
    text, and encoded in that order, so each file is a range of ids and the files continue each other.
    The sort is the one shuffle; the ids themselves never shuffle. Places are counted within each file, and the
    index of the files, one row each, adds the rest: no task counts all tokens.

    Defined cases: a null text is empty and has the end id only; strings that look like special tokens
    are ordinary text; repeated rows repeat; an empty table makes files without rows. Other columns are
    not looked at. A batch holds some MB of text or one longer text.
    """
    spark = docs.sparkSession
    rows = narrow(docs, id_col, text_col).orderBy(F.asc_nulls_first("id"), F.xxhash64("text"))
    encoded = rows.mapInArrow(_encode_batches(vocabulary, end_id), TOKENS)
    encoded.write.options(**writer_options(encoding, row_group_bytes, page_rows)).parquet(f"{root}/tokens")
    parts = (
        read_numbers(spark, root)
        .groupBy("part")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    )
    before, index = 0, []
    for part in sorted(parts.collect()):  # one row a file, each of some MB at least
        index.append((*part, before))
        before += part["tokens"]
    spark.createDataFrame(index, INDEX).coalesce(1).write.parquet(f"{root}/index")


def read_numbers(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, part, start_in_part and n_tokens of every document; the ids are not read."""
    return spark.read.schema(TOKENS).parquet(f"{root}/tokens").select(*NUMBERS)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{root}/index")


def read_tokens(
    spark: SparkSession, root: str, first_doc: int | None = None, last_doc: int | None = None, ids: bool = True
) -> DataFrame:
    """doc_id, start, n_tokens and, if wanted, token_ids of the documents in a range of ids; all by default.

    ``start`` is the number of ids of all documents before it, in the whole of the files. The range
    reaches the Parquet reader: row groups and pages outside it are skipped by their statistics.
    """
    found = spark.read.schema(TOKENS).parquet(f"{root}/tokens")
    if first_doc is not None:
        found = found.filter(F.col("doc_id") >= first_doc)
    if last_doc is not None:
        found = found.filter(F.col("doc_id") <= last_doc)
    # One row a file: small beside what it points to, and left to Spark's own check of its size.
    places = read_index(spark, root).select(F.col("part").alias("of_part"), F.col("start").alias("part_start"))
    columns = ["doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens"]
    return found.join(places, F.col("part") == F.col("of_part")).select(*columns, *(["token_ids"] if ids else []))


def _checksum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zlib import crc32

    for batch in batches:
        lists = batch.column("token_ids")
        at = lists.offsets.to_numpy().tolist()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy().astype("<u4"))).cast("B")
        sums = [crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of all its ids, as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "token_ids").mapInArrow(
        _checksum_batches, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def write_and_read(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Write the token files of all documents into the shared folder and read them back as checksums."""
    root = shared_dir(spark, "token-files")
    write_tokens(docs, root, id_col, text_col, **how)
    return checksums(read_tokens(spark, root))
