from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from conftest import rows
from odd_rows import documents, nothing, tricky  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfreight.llm import bpe, exact_dedup
from wayfreight.llm.common import UPPER

LOWERED = str.maketrans(UPPER, UPPER.lower())


def brute_dedup(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[hashlib.sha256((t or "").translate(LOWERED).encode()).hexdigest()].append(i)
    out = []
    for sha, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out, key=str)


def test_dedup_equals_brute_force(tricky, documents):
    for docs in (tricky, documents):
        expected = brute_dedup([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        found = rows(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert found == expected


def test_a_full_filter_changes_nothing(documents):
    small = rows(exact_dedup.exact_dedup(documents, most_filter_bits=1))
    assert small == rows(exact_dedup.exact_dedup(documents))


def test_dedup_of_nothing(nothing):
    assert rows(exact_dedup.exact_dedup(nothing)) == []
    assert exact_dedup.drop_exact_copies(nothing).count() == 0


def test_dropping_keeps_columns_and_rows_without_id(tricky):
    left = exact_dedup.drop_exact_copies(tricky)
    assert left.columns == tricky.columns
    kept = sorted((r.doc_id for r in left.collect()), key=str)
    assert kept == sorted([2, 5, 7, 8, 10, 11, 11, 4, 12, None, None], key=str)


def test_no_python_in_dedup(documents):
    plan = exact_dedup.exact_dedup(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_unique_rows_pass_without_a_shuffle(documents):
    """The first branch of the union, rows that no other equals, holds broadcasts but no exchange by key."""
    lines = exact_dedup.exact_dedup(documents)._jdf.queryExecution().executedPlan().toString().split("\n")
    union = next(k for k, line in enumerate(lines) if line.lstrip(" +-:").startswith("Union"))
    at = lines[union].index("Union")
    first = []
    for line in lines[union + 1 :]:
        if len(line) <= at or line[at] != ":":
            break
        first.append(line)
    assert first and not any("Exchange hashpartitioning" in line for line in first)


def test_round_trip_equals_the_library(tricky, documents):
    enc = bpe.encoder()
    for docs in (tricky, documents):
        expected = []
        for i, t in [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]:
            ids = enc.encode_ordinary(t or "")
            digest = hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
            expected.append((i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()))
        found = rows(bpe.bpe_round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
        assert found == sorted(expected, key=str)


def test_decode_gives_the_bytes_back(tricky):
    decoded = bpe.bpe_decode(bpe.bpe_encode(tricky)).collect()
    expected = sorted(((r.doc_id, (r.text or "").encode()) for r in tricky.select("doc_id", "text").collect()), key=str)
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in decoded), key=str) == expected


def test_packed_tokens_are_the_same(tricky):
    packed = {(r.doc_id, r.n_tokens, bytes(r.token_ids)) for r in bpe.with_tokens(tricky).collect()}
    plain = {(r.doc_id, len(r.token_ids), np.asarray(r.token_ids, "<u4").tobytes()) for r in bpe.bpe_encode(tricky).collect()}
    assert packed == plain


def test_bpe_of_nothing(nothing):
    assert bpe.bpe_round_trip(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab 1\n\t.'s \x1c\x85é!"), max_size=60), st.integers(1, 9))
def test_pieces_encode_as_the_whole(text, most):
    enc = bpe.encoder()
    pieces = list(bpe.safe_pieces(text, most))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
