"""Language by a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfreight.llm.common import in_fold, narrow, sliced, text_bytes
from wayfreight.llm.sampling import sample_by_class

WINDOW = 192  # bytes the network sees at once
WIDTHS = (2, 3, 4)  # bytes a filter covers
FILTERS = 16  # of each width
EMBEDDING = 8
#: The model is fitted on a bounded sample: so many documents of each language, and of each so many excerpts.
DOCUMENTS_PER_LANGUAGE = 400
EXCERPTS = 4
EPOCHS = 10
UNKNOWN = "und"

_SPAN = max(WIDTHS)


def _filter_mask() -> np.ndarray:
    """(offset x embedding, filter): a filter of width w has weights at its first w offsets only."""
    mask = np.zeros((_SPAN, EMBEDDING, len(WIDTHS) * FILTERS), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask.reshape(_SPAN * EMBEDDING, -1)


def _columns(model: dict, windows: np.ndarray) -> np.ndarray:
    """(window, position, offset x embedding) for windows of bytes with _SPAN - 1 zero bytes at the end."""
    embedded = model["embedding"][windows]
    n = windows.shape[1] - _SPAN + 1
    return np.concatenate([embedded[:, j : j + n] for j in range(_SPAN)], axis=2)


def _probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(model: dict, windows: np.ndarray) -> np.ndarray:
    """Class probabilities of (n, WINDOW + _SPAN - 1) bytes: filters, maximum over positions, softmax."""
    out = np.empty((len(windows), model["dense"].shape[1]), np.float32)
    for at in range(0, len(windows), 128):
        part = windows[at : at + 128]
        columns = _columns(model, part)
        made = columns.reshape(-1, columns.shape[2]) @ model["kernel"]
        pooled = np.maximum(made.reshape(len(part), -1, made.shape[1]).max(axis=1) + model["shift"], 0)
        out[at : at + 128] = _probabilities(pooled @ model["dense"] + model["bias"])
    return out


def train(windows: np.ndarray, labels: np.ndarray, classes: int, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """Fit by Adam on cross-entropy. The zero byte, which pads, keeps a zero embedding."""
    rng = np.random.default_rng(seed)
    filters = len(WIDTHS) * FILTERS
    mask = _filter_mask()
    model = {
        "embedding": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        "kernel": (rng.normal(0, 0.3, (_SPAN * EMBEDDING, filters)) * mask).astype(np.float32),
        "shift": np.zeros(filters, np.float32),
        "dense": rng.normal(0, 0.3, (filters, classes)).astype(np.float32),
        "bias": np.zeros(classes, np.float32),
    }
    model["embedding"][0] = 0
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            part, wanted = windows[pick], labels[pick]
            columns = _columns(model, part)
            made = columns @ model["kernel"]
            best = made.argmax(axis=1)
            pooled = np.take_along_axis(made, best[:, None, :], axis=1)[:, 0] + model["shift"]
            active = np.maximum(pooled, 0)
            error = _probabilities(active @ model["dense"] + model["bias"])
            error[np.arange(len(pick)), wanted] -= 1
            error /= len(pick)
            back = (error @ model["dense"].T) * (pooled > 0)
            chosen = columns[np.arange(len(pick))[:, None], best]  # (window, filter, offset x embedding)
            to_input = (back[:, :, None] * model["kernel"].T[None]).reshape(len(pick), filters, _SPAN, EMBEDDING)
            at_byte = part[np.arange(len(pick))[:, None, None], best[:, :, None] + np.arange(_SPAN)]
            embedding = np.zeros_like(model["embedding"])
            np.add.at(embedding, at_byte.reshape(-1), to_input.reshape(-1, EMBEDDING))
            embedding[0] = 0
            grads = {
                "embedding": embedding,
                "kernel": np.einsum("bf,bfc->cf", back, chosen) * mask,
                "shift": back.sum(axis=0),
                "dense": active.T @ error,
                "bias": error.sum(axis=0),
            }
            step += 1
            rate = 0.01 * 0.8**epoch * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] = (model[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return model


def cut_windows(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts one behind another, padded with zero bytes; the text of each, and its bytes."""
    sizes = np.diff(ends)
    made = np.maximum(1, -(-sizes // WINDOW))
    owner = np.repeat(np.arange(len(sizes)), made)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    starts = ends[:-1][owner] + nth * WINDOW
    length = np.minimum(WINDOW, ends[1:][owner] - starts)
    return starts, owner, np.maximum(length, 0)


def _gather(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(WINDOW + _SPAN - 1)
    inside = np.arange(WINDOW + _SPAN - 1) < length[:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def fit(rows: DataFrame, id_col: str = "id", text_col: str = "text", lang_col: str = "lang") -> tuple[dict, list[str]]:
    """Model and language names from labelled rows; only excerpts of a bounded sample reach the driver."""
    room = F.greatest(F.length(text_col) - WINDOW, F.lit(0))
    excerpts = [F.substring(text_col, (1 + F.floor(room * k / max(1, EXCERPTS - 1))).cast("int"), F.lit(WINDOW)) for k in range(EXCERPTS)]
    short = rows.select(id_col, lang_col, F.array_distinct(F.array(*excerpts)).alias("excerpts"))
    sample, counts = sample_by_class(short, lang_col, F.col(id_col), DOCUMENTS_PER_LANGUAGE)
    names = sorted(counts)
    pieces = sorted((names.index(r[lang_col]), e) for r in sample.collect() for e in r["excerpts"] if e.strip())
    if not pieces:
        return {}, names
    raw = [e.encode()[:WINDOW] for _, e in pieces]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, owner, length = cut_windows(data, ends)
    return train(_gather(data, starts, length), np.array([k for k, _ in pieces])[owner], len(names)), names


def _predict_batches(model: dict, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        letter = re.compile(r"[^\W\d_]")
        for batch in sliced(batches, "text", 4 << 20):
            texts = batch.column("text")
            data, ends = text_bytes(texts)
            known = [t is not None and letter.search(t) is not None for t in texts.to_pylist()]
            total = np.zeros((batch.num_rows, len(names)))
            weight = np.zeros(batch.num_rows)
            starts, owner, length = cut_windows(data, ends)
            for at in range(0, len(starts), 2048):
                part = slice(at, at + 2048)
                chances = forward(model, _gather(data, starts[part], length[part]))
                np.add.at(total, owner[part], chances * length[part, None])
                np.add.at(weight, owner[part], length[part])
            best = total.argmax(axis=1)
            score = np.where(known, total.max(axis=1) / np.maximum(weight, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("held_out"),
                    pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                    pa.array(np.clip(score, 0, 1), pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, remainder: int = 2
) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    Rows whose crc32 of the id leaves ``remainder`` are held out; the network learns from text and
    non-null label of the others. A text is cut into windows of fixed length, all of which are scored,
    in batches; their probabilities are averaged by length. The score is that average for the
    predicted language.

    Defined cases: ``und`` with score 0 where the text is null or has no letter, and everywhere if
    there is nothing to learn from; a null id is not held out; repeated rows repeat; an empty table
    stays empty; other columns are not looked at.
    """
    rows = docs.select(
        docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")
    ).withColumn("held_out", in_fold("id", modulus, remainder))
    model, names = fit(rows.filter("lang IS NOT NULL AND text IS NOT NULL AND NOT held_out"))
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double"
    every = narrow(rows, "id", "text").withColumn("held_out", in_fold("id", modulus, remainder))
    if not model:
        return every.select(F.col("id").alias("doc_id"), "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return every.mapInArrow(_predict_batches(model, names), schema)
