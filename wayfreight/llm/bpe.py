"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfreight.llm.common import narrow, sliced

#: Texts above this many characters are encoded in pieces cut at safe boundaries.
PIECE_CHARS = 1 << 16

_ENCODERS: dict[tuple[str, str], object] = {}


def encoder(rank_file: str | None = None, pattern: str | None = None):
    """The encoding of a rank file, built once per worker. Default: the public 50k byte vocabulary."""
    import base64

    import public_tokenizers
    import tiktoken

    rank_file = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    if (rank_file, pattern) not in _ENCODERS:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _ENCODERS[rank_file, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[rank_file, pattern]


def safe_pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``most`` characters that encode as the whole would.

    A cut is made only before a blank or line feed that follows something other than white space. No match of the pattern holds
    white space behind anything but white space, so a match always ends there; matching looks ahead
    over white space only, and what the pieces before the cut end with is none. A text without such a
    place within reach stays in one piece until the next.
    """
    import regex

    if len(text) <= most:
        yield text
        return
    boundary = regex.compile(r"\S(?=[ \n])")
    start = 0
    while len(text) - start > most:
        found = boundary.search(text, start + most - 1)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def encode(text: str, enc) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text) for i in enc.encode_ordinary(piece)]


def _encode_batches(rank_file: str | None, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for batch in sliced(batches, "text"):
            ids = [encode(t or "", enc) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "token_ids"]
            )

    return run


def bpe_encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, pattern: str | None = None
) -> DataFrame:
    """doc_id and token_ids of every whole text, as the library encodes it without special tokens.

    A null text is empty and has no tokens; strings that look like special tokens are ordinary text.
    Rows are independent: repeated rows repeat, nulls in the id stay null, an empty table stays empty,
    other columns are not looked at. No shuffle; a batch holds some MB of text or one longer text.
    """
    rows = narrow(docs, id_col, text_col)
    return rows.mapInArrow(_encode_batches(rank_file, pattern), "doc_id bigint, token_ids array<int>")


def _decode_batches(rank_file: str | None, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for batch in batches:
            ids, kept = batch.column("token_ids"), batch.column("doc_id")
            for start in range(0, batch.num_rows, 256):
                lists = ids.slice(start, 256).to_pylist()
                raw = [None if x is None else enc.decode_bytes(x) for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [kept.slice(start, 256), pa.array(raw, pa.binary())], names=["doc_id", "bytes"]
                )

    return run


def bpe_decode(tokens: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the raw bytes that token_ids stand for. Null ids give null; an unknown id is an error."""
    return tokens.select("doc_id", "token_ids").mapInArrow(_decode_batches(rank_file, pattern), "doc_id bigint, bytes binary")


def _round_trip_batches(rank_file: str | None, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        enc = encoder(rank_file, pattern)
        for batch in sliced(batches, "text"):
            n, ids_sha, decoded_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text or "", enc)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def bpe_round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Digests of the ids and of the bytes they decode to, in one pass: the ids never leave their task.

    The same encoding and the same defined cases as ``bpe_encode``.
    """
    rows = narrow(docs, id_col, text_col)
    return rows.mapInArrow(
        _round_trip_batches(rank_file, pattern), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def with_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of its tokens and the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder()
        for batch in sliced(batches, "text"):
            ids = [np.asarray(encode(t or "", enc), "<u4") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["doc_id", "n_tokens", "token_ids"],
            )

    rows = narrow(docs, id_col, text_col)
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, token_ids binary").select(
        F.col("doc_id"), "n_tokens", "token_ids"
    )
