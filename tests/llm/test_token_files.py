from __future__ import annotations

import random
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import documents, nothing, tricky  # noqa: F401

from wayfreight.llm import tokenfiles


@lru_cache(1)
def whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def library(texts):
    return [e.ids for e in whole().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def brute_files(pairs, end_id=2):
    """By id, nulls first; rows that share an id in any order, which the caller allows for."""
    out, place = [], 0
    for (i, _), ids in zip(pairs, library([t for _, t in pairs])):
        ids = np.array([*ids, end_id], "<u4")
        out.append((i, place, len(ids), crc32(ids.tobytes())))
        place += len(ids)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 1\n\t\r.'s\x00\x1c\x85\xa0é!　 <|"), max_size=40), max_size=5))
def test_chunks_encode_as_the_whole(texts):
    encode = tokenfiles.encoder().encode
    expected = library(texts)
    for _ in range(2):  # as new chunks, then as known ones
        assert [ids.tolist() for ids in encode(texts)] == expected


def test_special_tokens_in_texts_are_text_and_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenfiles, "MOST_CHUNKS", 3)
    texts = ["a <|endoftext|> b", "<|endoftext|>", " ".join(f"w{k}" for k in range(50)), "x" * 5000 + " " + "y" * 5000]
    encode = tokenfiles.encoder().encode
    for text in texts * 2:
        assert encode([text])[0].tolist() == library([text])[0]
    assert 50256 not in encode(["<|endoftext|>"])[0]
    assert all(len(c) <= tokenfiles.CHUNK_CHARS for c in tokenfiles.encoder().known)


@pytest.mark.parametrize("encoding", tokenfiles.ENCODINGS)
def test_files_equal_the_library(spark, documents, encoding):
    pairs = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    found = tokenfiles.write_and_read(spark, documents.repartition(5), encoding=encoding)
    assert rows(found, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute_files(pairs), key=str)


def test_files_of_odd_rows(spark, tricky):
    found = tokenfiles.write_and_read(spark, tricky).orderBy("start").collect()
    pairs = [(r.doc_id, r.text) for r in tricky.select("doc_id", "text").collect()]
    assert [r.doc_id for r in found] == sorted((i for i, _ in pairs), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in found] == np.concatenate(([0], np.cumsum([r.n_tokens for r in found])[:-1])).tolist()
    expected = sorted(((i, n, c) for i, _, n, c in brute_files(pairs)), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=str) == expected


def test_files_of_nothing(spark, nothing, tmp_path):
    root = f"file://{tmp_path}/none"
    tokenfiles.write_tokens(nothing, root)
    assert rows(tokenfiles.read_tokens(spark, root)) == [] and rows(tokenfiles.read_index(spark, root)) == []


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """3,000 documents in several files, row groups and pages."""
    rng = random.Random(8)
    texts = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(400)))) for k in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made = {}
    try:
        for encoding in tokenfiles.ENCODINGS:
            at = tmp_path_factory.mktemp(encoding)
            tokenfiles.write_tokens(docs, f"file://{at}/t", encoding=encoding, row_group_bytes=200_000, page_rows=50)
            made[encoding] = at / "t"
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return texts, made


def test_layout_is_the_one_asked_for(many):
    for encoding, root in many[1].items():
        files = sorted((root / "tokens").glob("*.parquet"))
        assert len(files) > 3
        last = -1
        by_first = sorted((pq.ParquetFile(f) for f in files), key=lambda f: f.metadata.row_group(0).column(0).statistics.min)
        for file in by_first:
            meta = file.metadata
            assert meta.num_row_groups > 1
            for g in range(meta.num_row_groups):
                columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
                assert all(c.has_offset_index and c.has_column_index for c in columns.values())
                assert columns["doc_id"].statistics.min > last
                last = columns["doc_id"].statistics.max
                for name, column in columns.items():
                    ids = name.startswith("token_ids")
                    packed = "RLE_DICTIONARY" if ids and encoding == "dictionary" else "DELTA_BINARY_PACKED"
                    assert packed in column.encodings, (name, column.encodings)
                assert sum(c.total_uncompressed_size for c in columns.values()) < 1_000_000


def test_selective_reads(spark, many):
    texts, made = many
    expected = brute_files(texts)
    for root in made.values():
        root = f"file://{root}"
        some = tokenfiles.read_tokens(spark, root, 1000, 1009)
        assert rows(some, "doc_id", "start", "n_tokens") == sorted([r[:3] for r in expected[1000:1010]], key=str)
        assert {r.doc_id: r.token_ids for r in some.collect()} == {
            i: [*ids, 2] for i, ids in zip(range(1000, 1010), library([t for _, t in texts[1000:1010]]))
        }
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(doc_id,1000), LessThanOrEqual(doc_id,1009)" in plan
        numbers = tokenfiles.read_tokens(spark, root, ids=False)
        assert "token_ids" not in numbers._jdf.queryExecution().executedPlan().toString()
        assert rows(numbers) == sorted((r[:3] for r in expected), key=str)


def test_a_range_of_documents_reads_few_rows(spark, many):
    """Pages outside the range are not decoded: the scan gives hardly more rows than were asked for."""
    some = tokenfiles.read_tokens(spark, f"file://{many[1]['dictionary']}", 1000, 1009)
    some.collect()
    found = []

    def walk(node):
        metrics = node.metrics()
        if node.nodeName().startswith("Scan parquet") and "token_ids" in node.simpleString(99):
            found.append(metrics.apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
            return
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            walk(node.plan())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(some._jdf.queryExecution().executedPlan())
    assert found and 10 <= found[0] <= 200


def test_unknown_encoding(documents):
    with pytest.raises(ValueError, match="encoding"):
        tokenfiles.writer_options("plain")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abstrevmld' 12\n.,!_~éÿſǅµªº²×÷\x7f"), max_size=40), max_size=5))
def test_plain_chunks_are_cut_as_the_library_cuts_them(texts):
    assert [ids.tolist() for ids in tokenfiles.encoder().encode(texts)] == library(texts)


def test_plain_chunks_go_to_the_model_alone(monkeypatch):
    import public_tokenizers

    encoder = tokenfiles.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole, seen = encoder._whole, []
    monkeypatch.setattr(encoder, "_whole", lambda texts: seen.extend(texts) or whole(texts))
    text = "first it's a'll, \"réf\" 12.5!? one\ntwo the µ end"
    assert encoder.encode([text])[0].tolist() == library([text])[0]
    assert "first" in seen and not any(c in t for t in seen for c in ("it's", "réf", "12.5", "end"))
    assert any("µ" in t for t in seen)  # its class is in doubt
