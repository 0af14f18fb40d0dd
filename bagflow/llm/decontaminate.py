"""Operator 6: benchmark decontamination by a BM25 index of the test items and block-max WAND.

The items are the indexed texts, every passage of every training document is a query. An item's score is divided by the score
it gives itself, so a score is the share of the item that the passage holds and one threshold serves all items. Whatever
reaches it is retrieved and then verified by the overlap of the item's question and answer."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from bagflow.llm.common import LOWER, chunked, discard, keyed, lean, mix, own, prepared, span_hashes, stored, table, utf8, words

K1, B = 1.2, 0.75
#: Share of an item's own score at which a passage retrieves it.
THRESHOLD = 0.6
#: Words of a shingle, and the share of question and of answer shingles, or of all, that must be in the passage.
SHINGLE, OVERLAP = 5, 0.8
#: Items of a block in the index; words between the starts of passages at least (a passage is two such steps long).
BLOCK, STEP = 8, 64
#: Bytes of item texts in one index. More items make more indexes, which are asked one after the other and agree in all scores.
INDEX_BYTES = 32 << 20

_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words."""
    if len(hashes) < n or n < 1:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= _MULTIPLIER
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def word_hashes(text: str) -> np.ndarray:
    body = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = words(body, np.array([0, len(body)]))
    return span_hashes(body, starts, ends)


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last line; of a single line, what follows the last sentence end inside it; else there is only a question."""
    text = text.strip()
    head, cut, tail = text.rpartition("\n")
    if not cut:
        at = max(text.rfind(mark, 0, -1) for mark in (". ", "? ", "! "))
        head, tail = (text[: at + 1], text[at + 2 :]) if at > 0 else (text, "")
    return head, tail


class Index:
    """Inverted index of items: for each term its postings (item, impact), its greatest impact, and that in each block of items.

    `statistics` are those of all items, of which these may be a part: their number, their mean length, and the sorted terms of
    these items with the number of all items that have each."""

    def __init__(self, items: list[tuple[int | None, str]], statistics: tuple[int, float, np.ndarray, np.ndarray] | None = None):
        self.ids = [i for i, _ in items]
        self.texts = [word_hashes(text) for _, text in items]
        self.sizes = np.array([len(t) for t in self.texts])
        self.step = max(STEP, int(self.sizes.max()))
        self.n = [min(SHINGLE, len(t)) for t in self.texts]
        self.parts = []
        for (_, text), hashes, n in zip(items, self.texts, self.n, strict=True):
            question, answer = (word_hashes(part) for part in question_and_answer(text))
            # a part shorter than a shingle is looked for as it is
            self.parts.append((np.unique(shingles(hashes, n)), np.unique(shingles(question, min(n, len(question)))), min(n, len(question)), np.unique(shingles(answer, min(n, len(answer)))), min(n, len(answer))))
        item = np.repeat(np.arange(len(items)), self.sizes)
        self.terms, term = np.unique(np.concatenate(self.texts), return_inverse=True)
        pairs, tf = np.unique(term * len(items) + item, return_counts=True)
        term, item = pairs // len(items), pairs % len(items)
        total, mean = len(items), float(self.sizes.mean())
        df = np.bincount(term, minlength=len(self.terms))
        if statistics is not None:
            total, mean, terms, found = statistics
            df = found[np.searchsorted(terms, self.terms)]
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.sizes[item] / mean))
        impact /= np.bincount(item, impact, len(items))[item]
        self.item, self.impact = item, impact
        self.first = first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        block = term * (len(items) // BLOCK + 1) + item // BLOCK
        start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        self.block, self.block_max = item[start] // BLOCK, np.maximum.reduceat(impact, start)
        self.block_first = np.searchsorted(term[start], np.arange(len(self.terms) + 1))
        self.blocks = len(items) // BLOCK + 1
        self.greatest = np.maximum.reduceat(impact, first[:-1])
        # the same as lists, for the walk along the postings
        self.lists = [(item[a:b].tolist(), impact[a:b].tolist(), float(m)) for a, b, m in zip(first[:-1].tolist(), first[1:].tolist(), self.greatest.tolist(), strict=True)]
        self.maxima = [dict(zip(self.block[a:b].tolist(), self.block_max[a:b].tolist(), strict=True)) for a, b in zip(self.block_first[:-1].tolist(), self.block_first[1:].tolist(), strict=True)]

        # the commonest terms, as long as together they give no item more than half the threshold: an item that reaches it
        # has the other half from the rest, so where those bounds stay below no passage need be walked
        total, self.common = np.zeros(len(items)), np.zeros(len(self.terms), bool)
        for t in np.argsort(-df, kind="stable"):
            at = slice(first[t], first[t + 1])
            more = total[item[at]] + impact[at]
            if more.max() > THRESHOLD / 2:
                break
            total[item[at]] = more
            self.common[t] = True
        self.rest = THRESHOLD - float(total.max())


def walked(terms: list[int], index: Index, threshold: float = THRESHOLD - 1e-9) -> dict[int, float]:
    """Block-max WAND: score by item of all items at which the terms of a passage reach the threshold.

    The terms' lists stand in order of the item their cursor is at. The pivot is the first item at which the greatest impacts of
    the lists up to it reach the threshold; no earlier item can. If the maxima of the pivot's block don't reach it either, all
    these lists skip the block; else the pivot is scored, or the lists before it are brought up to it."""
    cursors = [[index.lists[t][0][0], 0, t] for t in terms]
    out: dict[int, float] = {}
    while cursors:
        cursors.sort()
        bound, p = 0.0, -1
        for n, c in enumerate(cursors):
            bound += index.lists[c[2]][2]
            if bound >= threshold:
                p = n
                break
        if p < 0:
            return out
        pivot = cursors[p][0]
        while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
            p += 1
        block = pivot // BLOCK
        if sum(index.maxima[c[2]].get(block, 0.0) for c in cursors[: p + 1]) < threshold:
            goal, moved = (block + 1) * BLOCK, cursors[: p + 1]
            if p + 1 < len(cursors):
                goal = min(goal, cursors[p + 1][0])
        elif cursors[0][0] == pivot:
            score = sum(index.lists[c[2]][1][c[1]] for c in cursors[: p + 1])
            if score >= threshold:
                out[pivot] = score
            goal, moved = pivot + 1, cursors[: p + 1]
        else:
            goal, moved = pivot, [c for c in cursors[:p] if c[0] < pivot]
        ended = False
        for c in moved:
            items = index.lists[c[2]][0]
            c[1] = bisect_left(items, goal, c[1])
            c[0] = items[c[1]] if c[1] < len(items) else -1
            ended |= c[0] < 0
        if ended:
            cursors = [c for c in cursors if c[0] >= 0]
    return out


def expand(first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the lists `keys`, and for each the number of its key."""
    n = first[keys + 1] - first[keys]
    owner = np.repeat(np.arange(len(keys)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[keys], n), owner


def overlap(wanted: np.ndarray, n: int, passage: np.ndarray) -> float:
    return float(np.isin(wanted, shingles(passage, n)).mean()) if len(wanted) else 1.0


def matches(body: np.ndarray, bounds: np.ndarray, index: Index) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(row, item) to (score, question overlap, answer overlap) of all verified matches in some texts."""
    lower = LOWER[body]
    starts, ends, row = words(lower, bounds)
    hashes = span_hashes(lower, starts, ends)
    if not len(hashes):
        return {}
    texts, step = len(bounds) - 1, index.step
    cuts = np.searchsorted(row, np.arange(texts + 1))
    place = np.arange(len(hashes)) - cuts[row]
    passages = np.maximum(1, -(-np.diff(cuts) // step) - 1)
    base = np.cumsum(passages) - passages
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == hashes)
    term, where, mine = at[known], place[known] // step, row[known]
    # a word is in the passage that starts a step before its own, and in its own
    passage = np.concatenate([where, where - 1])
    term, mine = np.concatenate([term, term]), np.concatenate([mine, mine])
    fits = (passage >= 0) & (passage < passages[mine])
    query = np.unique((base[mine[fits]] + passage[fits]) * len(index.terms) + term[fits])
    passage, term = query // len(index.terms), query % len(index.terms)

    # passages with a block whose maxima can reach the threshold, all passages at once
    rare = ~index.common[term]
    entry, owner = expand(index.block_first, term[rare])
    bound_of, at = np.unique(passage[rare][owner] * index.blocks + index.block[entry], return_inverse=True)
    bound = np.bincount(at, index.block_max[entry], len(bound_of))
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p in np.unique(bound_of[bound >= index.rest - 1e-9] // index.blocks):
        own_terms = term[np.searchsorted(passage, p) : np.searchsorted(passage, p, "right")]
        r = int(np.searchsorted(base, p, "right")) - 1
        begin = cuts[r] + (p - base[r]) * step
        text = hashes[begin : min(begin + 2 * step, cuts[r + 1])]
        for i, score in walked(own_terms.tolist(), index).items():
            if index.sizes[i] < SHINGLE:
                # so short an item is found only as a whole text
                q = a = float(cuts[r + 1] - cuts[r] == index.sizes[i] and bool((text == index.texts[i]).all()))
                verified = q == 1.0
            else:
                whole, question, qn, answer, an = index.parts[i]
                q, a = overlap(question, qn, text), overlap(answer, an, text)
                verified = q >= OVERLAP and a >= OVERLAP or overlap(whole, index.n[i], text) >= OVERLAP
            if verified:
                found[r, i] = max(found.get((r, i), (0.0, 0.0, 0.0)), (score, q, a))
    return found


def _finder(shared) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            body, bounds = utf8(batch.column(1))
            rows, found = [], []
            for first, _, part, cuts in chunked(body, bounds):
                for (r, i), (score, q, a) in sorted(matches(part, cuts, index).items()):
                    rows.append(first + r)
                    found.append({"item_id": index.ids[i], "score": score, "question_overlap": q, "answer_overlap": a})
            names = ["item_id", "score", "question_overlap", "answer_overlap"]
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array([x[n] for x in found], k) for n, k in zip(names, kinds, strict=True))], ["row_key", *names])

    return find


def _clean(shared) -> Callable:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, bounds = utf8(batch.column(1))
            bad = {first + r for first, _, part, cuts in chunked(body, bounds) for r, _ in matches(part, cuts, shared.value)}
            yield batch.take(pa.array([r for r in range(batch.num_rows) if r not in bad], pa.int64()))

    return clean


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, term): the distinct words of each item; a row without a term has the item's number of words instead."""
    for batch in batches:
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words_ = word_hashes(text)
            terms = np.unique(words_).view(np.int64)
            n = len(terms) + 1
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.string()), pa.array([*terms.tolist(), None], pa.int64()), pa.array([1] * len(terms) + [len(words_)], pa.int64())], ["part", "term", "n"])


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", index_bytes: int = INDEX_BYTES) -> list:
    """Broadcast indexes of all items that have words. Items of like length share an index (up to STEP words, up to four times as
    many, and so on), as the longest decides how long its passages are; an index has about index_bytes of text at most. So what is
    sent at once is bounded, and more items cost more passes. Number, mean length and term counts are those of all items."""
    spark = prepared(items.sparkSession)
    base = own(items, item_id=F.col(key).cast("long"), text=text).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_words = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "))
    base = base.withColumn("kind", F.ceil(F.greatest(F.log2(n_words / STEP), F.lit(0.0)) / 2).cast("int"))
    sizes = {r["kind"]: r["bytes"] for r in base.groupBy("kind").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    number = F.lit(1)
    for kind, total in sizes.items():
        number = F.when(F.col("kind") == kind, F.lit(-(-total // index_bytes))).otherwise(number)
    base = base.withColumn("part", F.concat_ws(":", "kind", F.pmod(F.xxhash64("text"), number)))
    counted = stored(base.select("part", "text").mapInArrow(lean(_terms), "part string, term bigint, n bigint"))
    whole = counted.where("term is null").agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("mean")).first()
    df = counted.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    by_part = stored(counted.where("term is not null").select("part", "term").distinct().join(df, "term"))
    out = []
    for part in sorted(r[0] for r in counted.select("part").distinct().collect()):
        rows: list[Row] = base.where(F.col("part") == part).orderBy("item_id", "text").collect()
        known = by_part.where(F.col("part") == part).select("term", "df").toArrow()
        terms = known["term"].to_numpy().view(np.uint64)
        order = np.argsort(terms)
        out.append(spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in rows], (whole["items"], whole["mean"], terms[order], known["df"].to_numpy()[order]))))
    discard(counted, by_part)
    return out


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, score, question_overlap, answer_overlap. Clean documents have
    no row.

    Narrow over the documents: nothing is shuffled, a document is searched whole where it is read, in passages that overlap
    by half, so an item of any length lies whole in one of them. Words are compared with A-Z lower-cased. An item of fewer than
    SHINGLE words is held only by a text that is nothing else. Null, empty and wordless texts and items match nothing;
    repeated rows are searched one by one; empty tables give no rows; further columns are ignored."""
    prepared(docs.sparkSession)
    base = own(docs, row_key=F.col(key).cast("long"), text=text)
    schema = "row_key bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in indexes(items):
        out = out.unionAll(base.mapInArrow(lean(_finder(shared)), schema))
    return out.withColumnRenamed("row_key", "doc_id")


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no test item, with the columns they came with. Null, empty and wordless texts stay,
    repeated rows are judged one by one, an empty table gives no rows, columns of any name pass through. Of several indexes a
    task holds one: what the one before left is stored."""
    prepared(spark)
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_key"), F.col("text"))
    schema = keyed(frame, "text string")
    before = None
    for n, shared in enumerate(indexes(table(spark, sf_dir, "benchmark"))):
        if n:
            frame = stored(frame)
            discard(before)
            before = frame
        frame = frame.mapInArrow(lean(_clean(shared)), schema)
    return frame.select(*[F.col("row_key").getField(c).alias(c) for c in docs.columns])


def op6_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
