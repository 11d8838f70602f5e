from __future__ import annotations

import base64
import hashlib
import io
import re

import pytest
import zstandard
from conftest import rows
from odd_rows import documents, nothing, tricky  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfreight.llm import pii, warc

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_by_table(digits):
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(doubled[d] for d in values[1::2])) % 10 == 0


def brute_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn_by_table(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def base_spans(text):
    return [f"{k}:{s}:{e}" for s, k, e, _ in pii.find_spans(text) if k in pii.BASE_KINDS]


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("0129.+@a-() %é_\n"), max_size=50))
def test_base_spans_equal_the_patterns(text):
    assert base_spans(text) == brute_spans(text)


def test_whole_table(tricky, documents):
    for docs in (tricky, documents):
        pairs = [(r.doc_id, (r.text or "")) for r in docs.select("doc_id", "text").collect()]
        expected = []
        for i, text in pairs:
            spans = brute_spans(text) if len(text) < 100_000 else base_spans(text)
            n = [sum(s.startswith(k + ":") for s in spans) for k in pii.BASE_KINDS]
            expected.append((i, *n, hashlib.sha256(",".join(spans).encode()).hexdigest()))
        found = rows(pii.find_pii(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
        assert found == sorted(expected, key=str)


def test_long_runs_take_linear_time():
    for text in ("9" * 400_000, "a" * 400_000, "1.2" * 100_000, "+1" * 100_000, "a@" * 100_000):
        pii.find_spans(text)


def test_added_kinds_need_their_checks():
    kinds = lambda text: [k for _, k, _, _ in pii.find_spans(text)]
    assert "iban" in kinds("pay to DE89 3704 0044 0532 0130 00 now")
    assert "iban" not in kinds("pay to DE88 3704 0044 0532 0130 00 now")
    assert kinds("number 123-45-6789 here") == []
    assert kinds("social security 123-45-6789 here") == ["ssn"]


def test_context_raises_the_score():
    plain, near = (pii.find_spans(t)[0][3] for t in ("xx 4111111111111111 xx", "my credit card 4111111111111111 xx"))
    assert near > plain


def test_pii_of_nothing(nothing):
    assert pii.find_pii(nothing).count() == 0


def expected_pages(pairs):
    first = {}
    for i, html in pairs:
        key = html or ""
        if i is not None and (key not in first or i < first[key]):
            first[key] = i
    out = []
    for i, html in pairs:
        raw = (html or "").encode()
        again = i is not None and i > first.get(html or "", i)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def test_archives_give_back_what_was_written(spark):
    html = "<html>" + "word " * 3000 + "</html>"
    pairs = [(5, html), (3, html), (9, html), (4, None), (2, ""), (7, "é\r\n\r\nü"), (8, html + "!"), (8, html + "!"), (None, html), (10, "x" * 3_000_000)]
    pages = spark.createDataFrame([(i, f"http://e/{i}" if i != 9 else None, h, "mine") for i, h in pairs], "page_id long, url string, html string, record_type string")
    assert rows(warc.write_and_read(spark, pages)) == expected_pages(pairs)


def test_payloads_and_urls_survive(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://e/{k}\r\nX: y", f"<p>{k}</p>" * 200) for k in range(400)], "page_id long, url string, html string")
    archives = warc.write_archives(pages, f"file://{tmp_path}")
    found = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read_archives(archives, f"file://{tmp_path}").collect()}
    assert found == {k: (f"http://e/{k}%0D%0AX: y", f"<p>{k}</p>" * 200) for k in range(400)}


def test_dictionary_travels_in_the_leading_frame():
    records = [warc.make_record(k, f"http://e/{k}", (f"<html><p>common words and {k * 7919}</p></html>" * 20).encode(), None) for k in range(300)]
    packed = warc.pack_archive(records)
    assert int.from_bytes(packed[:4], "little") == warc.DICTIONARY_FRAME
    assert list(warc.read_archive(io.BytesIO(packed))) == records
    without = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(packed) - 8 - int.from_bytes(packed[4:8], "little") < without


def test_small_archives_have_a_dictionary_too():
    for payloads in ([b""], [b"x"], [b"<p>" + bytes([65 + k]) * k for k in range(20)], [b"long " * 200_000]):
        records = [warc.make_record(k, None, p, None) for k, p in enumerate(payloads)]
        packed = warc.pack_archive(records)
        assert int.from_bytes(packed[:4], "little") == warc.DICTIONARY_FRAME
        assert list(warc.read_archive(io.BytesIO(packed))) == records
        with pytest.raises(zstandard.ZstdError):  # no record can do without the dictionary
            list(warc.read_archive(io.BytesIO(packed[8 + int.from_bytes(packed[4:8], "little") :])))
    assert warc.pack_archive([]) == b""
    assert list(warc.read_archive(io.BytesIO(b""))) == []


def test_archives_are_read_by_several_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(k, None, f"<p>{k}</p>") for k in range(60)], "page_id long, url string, html string").repartition(6)
    archives = warc.write_archives(pages, f"file://{tmp_path}")
    many = archives.count()
    found = warc.read_archives(archives, f"file://{tmp_path}")
    assert many > 1 and found.rdd.getNumPartitions() == min(many, 8)
    assert found.count() == 60


def test_no_pages(spark):
    assert warc.write_and_read(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_account_numbers_end_before_other_words():
    found = lambda text: [text[s:e] for s, kind, e, _ in pii.find_spans(text) if kind == "iban"]
    number = "DE89 3704 0044 0532 0130 00"
    for after in ("", " BIC COBADEFFXXX", " I said", " 2024", " AND 12 MORE", ", B", " GB82 WEST 1234 5698 7654 32"):
        for form in (number, number.replace(" ", "")):
            assert found(f"pay {form}{after}")[0] == form
    assert found(f"AB12 {number} X") == [number]
    assert found(f"{number} {number} GB82WEST12345698765432 OK") == [number, number, "GB82WEST12345698765432"]
    assert found("DE88 3704 0044 0532 0130 00 BIC") == []
    too_long = "DE85370400440532013000AB"  # passes modulo 97, but DE has 22 characters
    assert pii.mod97(too_long) and found(too_long) == []
    unlisted = next(f"ZZ{k:02} 1234 5678 9012" for k in range(2, 99) if pii.mod97(f"ZZ{k:02}123456789012"))
    assert found(unlisted + " X") == [unlisted]
