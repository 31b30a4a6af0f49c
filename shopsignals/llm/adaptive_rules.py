"""Quality rules with thresholds from the data: mergeable quantile sketches per
language and source, joined back to filter documents.

The counts of a document come from its whole text. A sketch of a measure is a
table of counts by logarithmic bin (bins grow by ``GROWTH``, so a quantile is
off by at most that factor); sketches merge by adding counts, in any order and
with one result, so one grouped sum builds those of every (lang, source), and
adding them up gives those of a language and of the corpus. The quartiles in
use are a group's own in the measure n / (n + ``prior``) that its n documents give
them, for the rest its language's, and these likewise the corpus's: no threshold
jumps as a group grows. A document is rejected
where a measure lies beyond the outer fence of its group: upper quartile plus
``reach`` times the spread of the quartiles, where the spread counts as no less
than ``slack``, so that a group of equal values does not reject its first
deviation. Word length, a mean, is odd on both sides and strays more in short
texts: there the reach grows by sqrt(1 + SHORT / n_words).

Base rule: fewer than 10 words, or more than 20% of the words in repeated
5-word windows.

Results in cases of doubt: null text has no words (base_failed); null lang or
source is a group of its own; rows that repeat a doc_id are documents each;
other columns are ignored, or kept by ``filter_documents``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsignals.llm.kernels import M3, SEPARATORS, U, batch, grams, groups, mix, text_buffer, word_ids, words
from shopsignals.llm.tables import ship, store

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LOOKS = 5  # words of a repeated window
GROWTH = 1.02
PRIOR = 50  # documents that weigh as much as a group's language
SHORT = 20  # words at which a mean strays noticeably
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: measure: (value from the counts, least spread, whether it is a mean of the words)
MEASURES: dict[str, tuple[str, float, bool]] = {
    "symbols": ("n_symbols / n_words", 0.05, False),
    "dup_lines": ("n_dup_lines / n_lines", 0.1, False),
    "repeats": ("n_repeat_words / n_words", 0.05, False),
    "word_length": ("word_chars / n_words", 0.5, True),
}


def _sums(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flag)))
    return c[off[1:]] - c[off[:-1]]


def _repeated_words(ids: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Words of each row in windows of LOOKS words that occur there twice or more."""
    g = grams(ids, LOOKS)
    if not len(g):
        return np.zeros(rows, np.int64)
    inside = np.flatnonzero(row[:len(g)] == row[LOOKS - 1:])
    h = mix(g[inside], row[inside].astype(U) * M3)
    o = np.argsort(h)
    same = h[o][1:] == h[o][:-1]
    again = np.zeros(len(h), bool)
    again[o[1:][same]] = True
    again[o[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int32)
    at = inside[again]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + LOOKS, -1)
    return np.bincount(row[np.cumsum(edge)[:-1] > 0], minlength=rows)


def _lines(raw: np.ndarray, lo: int, hi: int) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier one."""
    lines = [x for x in raw[lo:hi].tobytes().split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _count(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in COUNTS)])
    for b in batches:
        raw, off = text_buffer(b.column("text"))
        out = np.zeros((len(COUNTS), b.num_rows), np.int64)
        for i, j in groups(off):
            x, o = raw[off[i]:off[j]], off[i:j + 1] - off[i]
            ws, we, row = words(raw, off[i:j + 1])
            out[0, i:j] = np.bincount(row, minlength=j - i)
            out[1, i:j] = _sums(((x & 0xC0) != 0x80) & ~SEPARATORS[x], o)
            out[2, i:j] = _sums(SYMBOLS[x], o)
            out[4, i:j] = _repeated_words(word_ids(raw, ws, we), row, j - i)
            for k in range(i, j):
                out[5, k], out[3, k] = _lines(raw, off[k], off[k + 1])
        yield batch(schema, b.column("doc_id"), b.column("lang"), b.column("source"), *out)


def counts(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the COUNTS of every document."""
    ship(documents.sparkSession)
    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                             F.col("source").cast("string").alias("source"), "text")
            .mapInArrow(_count, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)))


def _measure(name: str) -> Column:
    top, _, bottom = MEASURES[name][0].partition(" / ")
    return F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0))


def sketch(counted: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: one quantile sketch per group and measure,
    of documents with words. Bin null holds the zeros."""
    v = F.col("m.value")
    bins = F.when(v > 0, F.ceil(F.log(v) / math.log(GROWTH)).cast("int"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _measure(m).alias("value")) for m in MEASURES]))
    return (counted.where("n_words > 0").select("lang", "source", each.alias("m"))
            .groupBy("lang", "source", F.col("m.measure").alias("measure"), bins.alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches merged to ``keys`` and measure: n, lower and upper quartile."""
    keys = [*keys, "measure"]
    merged = sketches.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy(F.col("bin").asc_nulls_first())
    c = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    middle = F.coalesce(F.pow(F.lit(GROWTH), F.col("bin") - F.lit(0.5)), F.lit(0.0))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), middle))
    return c.groupBy(*keys).agg(F.max("all").alias("n"), at(0.25).alias("lower"), at(0.75).alias("upper"))


def thresholds(sketches: DataFrame, prior: int = PRIOR, reach: float = 4.0) -> DataFrame:
    """Per lang and source: quartiles and reach (fence) of each measure."""
    own = quartiles(sketches, ["lang", "source"])
    lang = quartiles(sketches, ["lang"]).select(
        F.col("lang").alias("_lang"), F.col("measure").alias("_measure"), *[F.col(c).alias(f"lang_{c}") for c in ("n", "lower", "upper")])
    every = quartiles(sketches, []).select(
        F.col("measure").alias("_every"), *[F.col(c).alias(f"all_{c}") for c in ("lower", "upper")])
    t = (own.join(lang, own["lang"].eqNullSafe(lang["_lang"]) & (own["measure"] == lang["_measure"]))
         .join(every, own["measure"] == every["_every"]))
    own_part, lang_part = (F.col(n) / (F.col(n) + F.lit(prior)) for n in ("n", "lang_n"))
    pick = lambda c: own_part * F.col(c) + (1 - own_part) * (lang_part * F.col(f"lang_{c}") + (1 - lang_part) * F.col(f"all_{c}"))
    slack = F.create_map(*[F.lit(x) for m, (_, s, _) in MEASURES.items() for x in (m, s)])
    t = t.select("lang", "source", "measure", pick("lower").alias("lower"), pick("upper").alias("upper"))
    fence = F.greatest(F.col("upper") - F.col("lower"), slack[F.col("measure")]) * reach
    return t.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, v)).alias(f"{m}_{name}") for m in MEASURES
          for name, v in (("lower", F.col("lower")), ("upper", F.col("upper")), ("fence", fence))])


def verdicts(documents: DataFrame, prior: int = PRIOR, reach: float = 4.0) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    counted = store(counts(documents), "rule-counts")
    t = thresholds(sketch(counted), prior, reach)
    t = t.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    d = counted.join(t, counted["lang"].eqNullSafe(t["_lang"]) & counted["source"].eqNullSafe(t["_source"]), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    good = F.lit(True)
    for m, (_, _, mean) in MEASURES.items():
        fence = F.col(f"{m}_fence")
        if mean:
            fence = fence * F.sqrt(1 + F.try_divide(F.lit(float(SHORT)), F.col("n_words")))
            good = good & F.coalesce(_measure(m) >= F.col(f"{m}_lower") - fence, F.lit(True))
        good = good & F.coalesce(_measure(m) <= F.col(f"{m}_upper") + fence, F.lit(True))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & good).alias("kept"))


def filter_documents(documents: DataFrame, prior: int = PRIOR, reach: float = 4.0) -> DataFrame:
    """The documents that are kept, all columns. Of rows that repeat a doc_id all
    stay if one is kept."""
    kept = (verdicts(documents, prior, reach).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct())
    return documents.join(kept, documents["doc_id"].cast("long").eqNullSafe(kept["_kept_id"]), "left_semi")
