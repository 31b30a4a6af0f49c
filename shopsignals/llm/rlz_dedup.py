"""Substring dedup by relative Lempel-Ziv parsing of documents against
indexed reference blocks.

Every block of the corpus is a reference. Its index lists its phrases, cut by
content (all windows of consecutive words whose smallest 8-word gram is the
same), so that equal text is cut alike in document and reference. Documents are
factored greedily against the index of all blocks at once: a phrase found at
another place extends the current factor by all its windows, and factors that
touch are one. At factor boundaries, where a phrase differs from every indexed
phrase under its gram, its windows are looked up one by one, which moves the
factor's ends to the exact word. Factors of at least one window (35 words) are
the duplicate spans; unlike a parse against one earlier text, every place of a
factor is a span, the first included.

Results in cases of doubt: null text has no words; rows without doc_id take no
part and keep all words; rows that repeat a doc_id name the same document, so
equal places of it do not repeat each other, and each such row loses the spans
found for that id; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignals.llm import repeats
from shopsignals.llm.bucket_refinement import covered
from shopsignals.llm.kernels import U, batch, grams, groups, mix, text_buffer, window_min, word_ids, words
from shopsignals.llm.span_lists import flatten, slices

GRAM, HALF, CUT = 8, 32, 32  # words of the index gram, of an identifier; windows of one phrase


def _phrases(width: int):
    def phrases(raw, off, doc):
        for i, j in groups(off):
            ws, we, row = words(raw, off[i:j + 1])
            if len(ws) < width:
                continue
            ids = word_ids(raw, ws, we)
            gram = grams(ids, GRAM)
            low = window_min(gram, width - GRAM + 1)
            half = grams(ids, HALF)
            s, n = repeats.runs(low, row[:len(low)] == row[width - 1:], CUT)
            span = n + width - 1
            h = mix(mix(half[s], half[s + (span - HALF) // 2]), half[s + span - HALF] ^ span.astype(U))
            begin = np.searchsorted(row, np.arange(j - i))  # first word of each row
            _, w = repeats.within(s, n, gram[width - GRAM:] == low, lambda w: half[w], lambda w: half[w + width - HALF], False)
            inner = doc[i + row[w]], w - begin[row[w]]
            yield repeats.Phrases(low[s], h, doc[i + row[s]], s - begin[row[s]], n, inner)
    return phrases


def _located(width: int):
    def locate(raw, off, spans):
        at_row, s, n = flatten(spans)
        lo = np.searchsorted(at_row, np.arange(len(off)))
        for i, j in groups(off):
            ws, we, row = words(raw, off[i:j + 1])
            begin = np.searchsorted(row, np.arange(j - i))
            r, b, m = at_row[lo[i]:lo[j]], s[lo[i]:lo[j]], n[lo[i]:lo[j]]
            first = begin[r - i] + b
            yield r, b, m, ws[first], we[first + m + width - 2]
    return locate


def _windows(width: int):
    def windows(raw, off, doc, s, n):
        ws, we, row = words(raw, off)
        half = grams(word_ids(raw, ws, we), HALF)
        w, first = slices(np.searchsorted(row, np.arange(len(doc))), n)
        return repeats.Phrases(half[w], half[w + width - HALF], np.repeat(doc, n),
                               np.repeat(s, n) + np.arange(len(w)) - np.repeat(first[:-1], n), np.ones(len(w), np.int64))
    return windows


def _kept(b: pa.RecordBatch, width: int, spans: str = "spans"):
    """Per row: number of words, number removed, kept words joined by a space."""
    raw, off = text_buffer(b.column("text"))
    row, s, n = flatten(b.column(spans))
    at = np.searchsorted(row, np.arange(b.num_rows + 1))
    for i in range(b.num_rows):
        parts = raw[off[i]:off[i + 1]].tobytes().split()
        size, removed = len(parts), 0
        if at[i + 1] > at[i]:
            lo, hi = covered(s[at[i]:at[i + 1]], n[at[i]:at[i + 1]], width)
            kept, p = [], 0
            for x, y in zip(lo.tolist(), hi.tolist()):
                kept += parts[p:x]
                p = y
            parts = kept + parts[p:]
            removed = size - len(parts)
        yield size, removed, parts


def _digests(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_sha256", pa.string())])

    def apply(batches):
        for b in batches:
            rows = [(size, removed, hashlib.sha256(b" ".join(parts)).hexdigest())
                    for size, removed, parts in _kept(b, width)]
            size, removed, sha = zip(*rows) if rows else ((), (), ())
            yield batch(schema, b.column("doc_id"), np.array(size, np.int64), np.array(removed, np.int64),
                        pa.array(sha, pa.string()))
    return apply


_SPANS = "_duplicate_spans"


def _rewritten(width: int):
    def apply(batches):
        for b in batches:
            old = b.column("text")
            out = [t if not removed else b" ".join(parts).decode("utf-8")
                   for (size, removed, parts), t in zip(_kept(b, width, _SPANS), old.to_pylist())]
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field("text"), pa.array(out, b.schema.field("text").type)).drop_columns([_SPANS])
    return apply


def factors(documents: DataFrame, width: int = 35) -> DataFrame:
    """(doc, spans): the duplicate spans of each document that has any."""
    if not HALF <= width <= 2 * HALF:
        raise ValueError("width must be 32 to 64 words: two identifiers of 32 words cover it")
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    return repeats.repeated_spans(texts, _phrases(width), _located(width), _windows(width), keep_first=False)


def kept_words(documents: DataFrame, width: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 after removing every word covered
    by a window of ``width`` words that also starts anywhere else."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = factors(documents, width)
    return (docs.join(spans, docs["doc_id"] == spans["doc"], "left").select("doc_id", "text", "spans")
            .mapInArrow(_digests(width), "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def remove_duplicate_spans(documents: DataFrame, width: int = 35) -> DataFrame:
    """The documents with duplicate spans cut from ``text`` (kept words joined by
    one space) and ``n_chars``, where there is one, counted anew. Texts without
    such spans stay as they are; all rows and other columns stay."""
    spans = factors(documents, width).select(F.col("doc").alias("_duplicate_doc"), F.col("spans").alias(_SPANS))
    joined = (documents.join(spans, documents["doc_id"] == spans["_duplicate_doc"], "left")
              .drop("_duplicate_doc"))
    out = joined.mapInArrow(_rewritten(width), documents.schema)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(kind))
    return out
