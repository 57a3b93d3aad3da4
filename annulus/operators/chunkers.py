"""Text chunkers for retrieval, as array expressions; pieces of a character length are merged in Python."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE = 64  # texts that are cut at once

# Python's classes, which its pattern `(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!|。|？|！)\s*` means, in Java's syntax
_WORD = r"[\p{L}\p{N}_]"
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SENTENCE_END = rf"(?<=[.?!。？！])(?<!{_WORD}\.{_WORD}[^\n])(?<![A-Z][a-z]\.){_SPACE}*"


def grouped(parts: Column, size: int, overlap: int, joiner: str) -> Column:
    if size <= 0 or overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    n = F.size(parts)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1, F.lit(size - overlap)), lambda i: F.array_join(F.slice(parts, i + 1, size), joiner)))


def whole_sentences(text: str) -> Column:
    """Sentences with their terminators; no cut after abbreviations such as `Dr.` and `e.g.`."""
    trimmed = F.transform(F.split(F.col(text), SENTENCE_END), lambda x: F.regexp_replace(x, rf"\A{_SPACE}+|{_SPACE}+\z", ""))
    return F.filter(trimmed, lambda s: s != "")


def whole_sentence_chunks(df: DataFrame, text: str, size: int = 3, overlap: int = 0) -> DataFrame:
    """Chunks of `size` sentences with their terminators; the array of one binds the sentences, which are else split again for every chunk."""
    return df.withColumn("chunks", F.get(F.transform(F.array(whole_sentences(text)), lambda parts: grouped(parts, size, overlap, " ")), F.lit(0)))


def merged_lines(text: str, size: int, overlap: int) -> list[str]:
    """Lines joined up to `size` characters, a longer line alone; up to `overlap` characters of whole lines are repeated."""
    chunks: list[str] = []
    held: list[str] = []
    total = 0

    def emit():
        if joined := "\n".join(held).strip():
            chunks.append(joined)

    for line in filter(None, text.split("\n")):
        if held and total + len(line) + 1 > size:
            emit()
            while held and (total > overlap or total + len(line) + 1 > size):
                total -= len(held.pop(0)) + (1 if held else 0)
        held.append(line)
        total += len(line) + (1 if len(held) > 1 else 0)
    emit()
    return chunks


def by_slices(df: DataFrame, text: str, out: str, kind: str, fn) -> DataFrame:
    """df with `out`, a function of lists of at most SLICE texts; a slice's results leave Python before the next is made."""
    kept = df.drop(out)
    schema = T.StructType(kept.schema.fields + [T.StructField(out, T._parse_datatype_string(kind))])
    at, made = kept.columns.index(text), to_arrow_type(schema[-1].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                yield pa.record_batch([*part.columns, pa.array(fn(part.column(at).to_pylist()), made)], names=schema.names)

    return kept.mapInArrow(run, schema)


def fix_size_chunks(df: DataFrame, text: str, size: int, overlap: int = 0) -> DataFrame:
    if size <= 0 or not 0 <= overlap <= size:
        raise ValueError("overlap must not be larger than the chunk size")

    return by_slices(df, text, "chunks", "array<string>", lambda texts: [None if t is None else merged_lines(t, size, overlap) for t in texts])


def get_chunker(name: str):
    found = {"sentence": whole_sentence_chunks, "fix_size": fix_size_chunks, "semantic": semantic_chunks}
    if name not in found:
        raise ValueError(f"Unsupported chunk model: {name}")
    return found[name]


class HashEncoder:
    """Deterministic stand-in for a sentence model: signed word and trigram hashes, normalised."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            low = text.lower()
            for part in [*low.split(), *(low[k : k + 3] for k in range(max(0, len(low) - 2)))]:
                h = zlib.crc32(part.encode())
                row[h % self.dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def semantic_cuts(vectors: np.ndarray, threshold: float, window: int) -> list[int]:
    """Ends of chunks: after at least `window` sentences, where the means of the windows before and after differ (cosine below the threshold)."""
    cuts, held = [], 0
    for i in range(len(vectors)):
        held += 1
        if held >= window and i + 1 < len(vectors):
            a, b = vectors[max(0, i + 1 - window) : i + 1].mean(axis=0), vectors[i + 1 : i + 1 + window].mean(axis=0)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            if (float(a @ b / n) if n else 0.0) < threshold:
                cuts.append(i + 1)
                held = 0
    return [*cuts, len(vectors)] if len(vectors) else []


def semantic_chunks(df: DataFrame, text: str, size: int = 3, overlap: int = 0, threshold: float = 0.8, encoder=None) -> DataFrame:
    """Runs of sentences (split at full stops) of one topic; `size` is the window. encoder: an object with encode(texts)."""
    model = encoder or HashEncoder()

    def one(t):
        if t is None:
            return None
        parts = [s.strip() + "." for s in t.split(".") if s.strip()]
        cuts = semantic_cuts(model.encode(parts), threshold, size) if parts else []
        return [" ".join(parts[a:b]) for a, b in zip([0, *cuts], cuts) if b > a]

    return by_slices(df, text, "chunks", "array<string>", lambda texts: [one(t) for t in texts])


EMBEDDERS: dict[str, object] = {"hash": HashEncoder}


def get_embedder(name: str = "hash", **options):
    """An encoder by the registered prefix of its name; models are registered in EMBEDDERS."""
    for prefix, make in EMBEDDERS.items():
        if name.lower().startswith(prefix):
            return make(**options)
    raise ValueError(f"Unsupported embedding model: {name}")


def embedded(df: DataFrame, text: str, encoder=None, out: str = "v") -> DataFrame:
    model = encoder or HashEncoder()

    return by_slices(df, text, out, "array<double>", lambda texts: list(model.encode([t or "" for t in texts])))
