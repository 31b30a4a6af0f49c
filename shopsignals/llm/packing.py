"""Vector bin packing of training examples into fixed-size sequences.

An example has a size in three dimensions: tokens, segments (pieces with their
own attention block) and loss-bearing tokens. A sequence is filled by the
dot-product heuristic: of the examples that still fit under every limit, the one
whose size vector has the greatest dot product with the capacity left goes in;
when none fits, the next sequence begins. Sizes and capacities are taken in
units of the limits. Examples are dealt by a hash of their id into groups of
about ``group_size``, packed apart, each in one task.

Results in cases of doubt: a null text is empty and packs as its end token
alone; null sizes are 0; an example above a limit by itself is an error in
``pack`` (``pack_documents`` cuts texts, so none is); ties go to the smaller id
and start; rows that repeat a doc_id are packed each; an id may be null; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignals.llm.kernels import SEPARATORS, U, groups, text_buffer, word_ids, words
from shopsignals.llm.span_lists import slices
from shopsignals.llm.tables import ship

WINDOW, END = 4096, 2
SEGMENTS = 256  # most pieces in one sequence
GROUP = 2048  # examples packed together
CACHE = 1_000_000  # remembered words of a worker
STEP = 1 << 21  # bytes coded at once
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def dot_product_pack(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and order in the bin of each row of ``sizes``; rows come in the order
    that settles ties. Equal size vectors are handled as one kind."""
    kinds, kind = np.unique(sizes, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    queue = np.argsort(kind, kind="stable")  # rows by kind, first come first
    nxt = np.concatenate(([0], np.cumsum(np.bincount(kind, minlength=len(kinds)))))
    end, at = nxt[1:].copy(), nxt[:-1].copy()
    scaled = kinds / limits
    bins, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    left_rows, b = len(sizes), -1
    alive = np.arange(len(kinds))
    while left_rows:
        b += 1
        room, n = limits.astype(np.int64).copy(), 0
        fits = alive[at[alive] < end[alive]]
        alive = fits
        while True:
            fits = fits[(at[fits] < end[fits]) & (kinds[fits] <= room).all(axis=1)]
            if not len(fits):
                break
            k = fits[np.argmax(scaled[fits] @ (room / limits))]
            row = queue[at[k]]
            at[k] += 1
            bins[row], place[row] = b, n
            room -= kinds[k]
            n += 1
            left_rows -= 1
        if not n:
            raise ValueError("an example is larger than a limit")
    return bins, place


def _packer(limits: dict[str, int], keys: list[str], schema: pa.Schema):
    names = list(limits)
    cap = np.array([limits[c] for c in names], np.int64)

    def apply(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([(k, "ascending") for k in keys])
        sizes = np.stack([t[c].to_numpy() for c in names], axis=1).astype(np.int64)
        bins, place = dot_product_pack(sizes, cap)
        order = np.lexsort((place, bins))
        t, bins = t.take(pa.array(order)), bins[order]
        tokens = sizes[order, 0]
        upto = np.cumsum(tokens) - tokens
        first = np.searchsorted(bins, bins)
        ids = (np.int64(key[0].as_py()) << np.int64(32)) + bins
        t = t.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(upto - upto[first]))
        return t.select(schema.names).cast(schema)
    return apply


def pack(examples: DataFrame, keys: list[str], limits: dict[str, int], groups: int) -> DataFrame:
    """``examples`` with sequence_id and offset. ``limits``: most of each size
    column in one sequence, the token column first. ``keys`` settle ties and,
    hashed, deal examples into ``groups`` groups."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    spark = examples.sparkSession
    ship(spark)
    examples = examples.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in limits})
    out = StructType([*examples.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    dealt = examples.withColumn("_pack_group", F.pmod(F.xxhash64(*keys), F.lit(max(1, groups))))
    return dealt.groupBy("_pack_group").applyInArrow(_packer(limits, keys, to_arrow_schema(out)), out)


class WordIds:
    """Token ids of texts by their distinct words, remembered from batch to batch.

    White space parts this tokenizer's words, so a word's ids do not depend on its
    neighbours. Words of ASCII and Latin-1 letters, digits and marks are folded
    to lower case and cut as the tokenizer cuts them, into runs of letters,
    single digits and runs of marks; all other words go to it whole."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.hash = np.zeros(0, U)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _code(self, words: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and number of ids of ``words``; plain ones are one run each."""
        size, parts = np.zeros(len(words), np.int64), []
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        n = int(plain.sum())
        text = [words[i].decode() for i in order]
        joined = [" ".join(text[i:min(i + 500, n)]) for i in range(0, n, 500)]
        flat = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        if flat:
            parts.append(np.concatenate(flat))
            size[order[:n]] = np.diff(np.concatenate(([-1], np.flatnonzero(self.ends[parts[0]]))))
        whole = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(text[n:], add_special_tokens=False)]
        size[order[n:]] = [len(x) for x in whole]
        ids = np.concatenate([*parts, *whole, np.zeros(0, "<u4")])
        at = np.zeros(len(words), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return ids[slices(at, size)[0]], size

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of one group, end to end, and the number of each row."""
        x, us, ue, row, plain = cut_words(raw, offsets)
        h, first, inverse = np.unique(word_ids(x, us, ue), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, h)
        new = np.ones(len(h), bool)
        new[at < len(self.hash)] = self.hash[at[at < len(self.hash)]] != h[at < len(self.hash)]
        if len(self.hash) + new.sum() > CACHE:
            self.hash, self.start, self.size, self.ids = self.hash[:0], self.start[:0], self.size[:0], self.ids[:0]
            new[:] = True
        if new.any():
            f = first[new]
            ids, size = self._code([x[i:j].tobytes() for i, j in zip(us[f].tolist(), ue[f].tolist())], plain[f])
            start = len(self.ids) + np.cumsum(size) - size
            place = np.searchsorted(self.hash, h[new])
            self.hash = np.insert(self.hash, place, h[new])
            self.start = np.insert(self.start, place, start)
            self.size = np.insert(self.size, place, size)
            self.ids = np.concatenate((self.ids, ids))
        k = np.searchsorted(self.hash, h)[inverse]
        size = self.size[k]
        ids = self.ids[slices(self.start[k], size)[0]]
        return ids, np.bincount(row, size, len(offsets) - 1).astype(np.int64)


def cut_words(raw: np.ndarray, offsets: np.ndarray):
    """Folded bytes of the rows, and start, end, row and kind of the words' runs
    (positions in those bytes; kind: True if it is one run to the tokenizer)."""
    ws, we, row = words(raw, offsets)
    a = int(offsets[0])
    ws, we = ws - a, we - a
    x = raw[a:int(offsets[-1])].copy()
    after_c3 = np.zeros(len(x), bool)
    after_c3[1:] = x[:-1] == 0xC3
    kind = KIND[x]
    kind[after_c3] = 1
    odd = (kind == 0) | (after_c3 & ((x == 0x97) | (x == 0xB7)))
    odd[1:] |= (x[1:] == 0x7C) & (x[:-1] == 0x3C)  # special tokens hold "<|"
    odd &= ~SEPARATORS[x]
    bad = np.concatenate(([0], np.cumsum(odd)))
    plain = bad[we] == bad[ws]
    edge = np.zeros(len(x), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    edge &= ~SEPARATORS[x]
    i = np.flatnonzero(edge)
    w = np.searchsorted(ws, i, side="right") - 1
    i = i[plain[w] & (w >= 0)] if len(ws) else i[:0]
    start = np.zeros(len(x), bool)
    start[ws] = True
    start[i] = True
    us = np.flatnonzero(start)
    w = np.searchsorted(ws, us, side="right") - 1
    ue = np.minimum(np.append(us[1:], len(x)), we[w])
    # fold case where the word is plain; others are folded by the tokenizer
    upper = ((x >= 0x41) & (x <= 0x5A)) | (after_c3 & (x >= 0x80) & (x <= 0x9E))
    up = np.flatnonzero(upper)
    if len(up) and len(ws):
        x[up[plain[np.searchsorted(ws, up, side="right") - 1]]] += 0x20
    return x, us, ue, row[w], plain[w]


# kinds of bytes in plain words: 1 letter (0xC3 begins a Latin-1 letter), 2 digit, 3 mark; 0: not plain
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = 3
KIND[0x30:0x3A] = 2
KIND[0x41:0x5B] = KIND[0x61:0x7B] = 1
KIND[0xC3] = 1
KIND[0x27] = 0  # contractions

_worker: dict[str, WordIds] = {}


def stretches(raw: np.ndarray, lo: int, hi: int, step: int):
    """Parts of about ``step`` bytes of one long row, cut at separators."""
    while hi - lo > step:
        sep = np.flatnonzero(SEPARATORS[raw[lo + 1:lo + step]])
        if len(sep):
            cut = lo + 1 + int(sep[-1])
        else:  # a word longer than that
            cut = lo + step
            while cut < hi and not len(sep := np.flatnonzero(SEPARATORS[raw[cut:cut + step]])):
                cut += step
            cut = min(cut + int(sep[0]), hi) if len(sep) else hi
        yield lo, cut
        lo = cut
    if hi > lo:
        yield lo, hi


def token_ids(path: str, raw: np.ndarray, offsets: np.ndarray, step: int = STEP) -> Iterator[np.ndarray]:
    """Ids of each row's text, with the end token, as unsigned 32-bit integers."""
    if path not in _worker:
        _worker[path] = WordIds(path)
    code, end = _worker[path], np.array([END], "<u4")
    for i, j in groups(offsets, step):
        if j == i + 1:
            parts = [code(raw, np.array(p))[0] for p in stretches(raw, int(offsets[i]), int(offsets[j]), step)]
            yield np.concatenate([*parts, end])
            continue
        ids, size = code(raw, offsets[i:j + 1])
        for part in np.split(ids, np.cumsum(size)[:-1]):
            yield np.concatenate((part, end))


def _cut(path: str, window: int):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

    def apply(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for i, coded in enumerate(token_ids(path, *text_buffer(b.column("text")))):
                n = len(coded)
                rows += [(ids[i], s, min(window, n - s), zlib.crc32(coded[s:s + window]), n) for s in range(0, n, window)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)
    return apply


def pack_documents(documents: DataFrame, tokenizer: str, window: int = WINDOW, segments: int = SEGMENTS,
                   group_size: int = GROUP) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A text longer than ``window`` is cut into full windows and a rest;
    all its tokens bear loss except, in a text's first piece, the first one,
    which nothing predicts. ``tokenizer``: path on every executor."""
    ship(documents.sparkSession)
    n = documents.count()
    pieces = (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .mapInArrow(_cut(tokenizer, window), PIECES_DDL)
              .withColumn("segments", F.lit(1))
              .withColumn("loss", F.col("length") - F.when(F.col("start") == 0, 1).otherwise(0)))
    packed = pack(pieces, ["doc_id", "start"], {"length": window, "segments": segments, "loss": window},
                  -(-n // group_size))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
