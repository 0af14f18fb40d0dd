"""Operator 8: scores of texts by a context-tree weighting model of bytes, beside a word-count baseline.

A byte is eight binary decisions. Each decision has a Krichevsky-Trofimov estimate in every context of no to DEPTH preceding bytes that
the training texts have; the weights of the depths follow from how well each has coded them. A context that was never seen has no
say: there the deepest seen one stands alone.

The tree grows with the corpus and is never in one place. Its keys (DEPTH bytes of context, nearest first, and the coded byte) are
dealt by the two nearest bytes, so that a bucket has whole subtrees; only the 65,536 decisions of the two upper depths come to the
driver. Documents are dealt into blocks of bounded bytes. A block asks each bucket once for the distinct keys it needs, and the
answers come back to it; words are counted and asked for in the same way."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagflow.llm.common import LOWER, chunked, lean, lean_cogroups, lean_groups, mix, prepared, span_hashes, stored, table, utf8, words

#: Documents whose crc32 of the id has this remainder are held out.
FOLDS, HELD_OUT = 7, 2
#: Bytes of context, six at most (a key and the number of a text share 64 bits), and those of them that name a bucket.
DEPTH, TOP = 6, 2
#: Text bytes of a block of documents, those that a bucket of keys stands for, and blocks that one copy of a bucket answers.
BLOCK_BYTES, BUCKET_BYTES, BLOCKS_OF_COPY = 16 << 20, 8 << 20, 2000
#: Text bytes whose keys are sorted at once.
SORTED_BYTES = 1 << 20
#: Keys of a bucket that are made a tree at once, about so many at most, but for those of one context of TOP bytes.
TREE_KEYS = 40_000
#: Distinct keys a counting task holds before it hands partial counts on.
HELD_KEYS = 1_500_000
#: Keys of partial counts that wait to be added to those of their bucket, at least.
MERGED_KEYS = 250_000
#: Never a byte of UTF-8: stands before a text and, coded as its last symbol, after it.
EDGE = 255

_WORD, _GRAM = 0, 1
_LOG2 = math.log(2)


# Keys.


def grams(body: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all coded symbols of some texts, each text's bytes and its end, and the number of them in each text."""
    length = np.diff(bounds) + 1
    begin = bounds[:-1] + (depth + 1) * np.arange(len(length))
    edges = np.concatenate([(begin[:, None] + np.arange(depth)).ravel(), begin + depth + length - 1])
    inner = np.ones(len(body) + (depth + 1) * len(length), bool)
    inner[edges] = False
    symbols = np.full(len(inner), EDGE, np.uint64)
    symbols[inner] = LOWER[body]
    # two bytes at a time, the nearest being the most significant
    pairs = symbols << np.uint64(8)
    pairs[1:] |= symbols[:-1]
    size = max(len(symbols) - depth, 0)
    keys = np.zeros(size, np.uint64)
    back = 1
    while back <= depth:
        wide = back < depth
        keys <<= np.uint64(16 if wide else 8)
        keys |= (pairs if wide else symbols)[depth - back : depth - back + size]
        back += 2 if wide else 1
    keys <<= np.uint64(8)
    keys |= symbols[depth:]
    coded = np.ones(size, bool)
    coded[(begin[1:, None] - depth + np.arange(depth)).ravel()] = False
    return keys[coded], length


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys, ascending."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def word_keys(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the text of each."""
    starts, ends, row = words(body, bounds)
    return span_hashes(LOWER[body], starts, ends), row


def bucket_of(kind: int, keys: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    near = keys >> np.uint64(8 * (depth + 1 - TOP)) if kind == _GRAM else keys
    return (mix(near) % np.uint64(buckets)).astype(np.int32)


def packed(values: np.ndarray) -> bytes:
    """Numbers by their bytes, all first bytes first: of ascending numbers most bytes repeat, which compresses well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def dealt(keys: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of ascending keys by bucket, ascending in both."""
    order = np.argsort(which, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], which[order][1:] != which[order][:-1]])) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=False):
        yield int(which[order[a]]), order[a:b]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


# Counts.

COUNTED = "bucket int, kind int, keys binary, counts binary"
MERGED = "bucket int, kind int, keys binary, counts binary, total bigint, distinct bigint"


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _count(buckets: int, depth: int) -> Callable:
    """Keys of all texts with their counts in those that are learnt from, by bucket."""

    def handed(kind: int, parts: list) -> Iterator[pa.RecordBatch]:
        keys, counts = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        for bucket, at in dealt(keys, bucket_of(kind, keys, buckets, depth)):
            yield _rows(bucket=pa.array([bucket], pa.int32()), kind=pa.array([kind], pa.int32()), keys=[packed(keys[at])], counts=[packed(counts[at].astype(np.uint32))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {_WORD: [], _GRAM: []}
        for batch in batches:
            learns = batch.column(0).to_numpy(zero_copy_only=False)
            body, bounds = utf8(batch.column(1))
            for first, last, part, cuts in chunked(body, bounds, SORTED_BYTES):
                mine = learns[first:last]
                gram, length = grams(part, cuts, depth)
                word, row = word_keys(part, cuts)
                of_gram = np.repeat(mine, length)
                for kind, keys, flag in ((_WORD, word, mine[row]), (_GRAM, gram, of_gram)):
                    some, counts = np.unique(keys[flag], return_counts=True)
                    held[kind].append((some, counts))
                    some = distinct(keys[~flag])
                    held[kind].append((some, np.zeros(len(some), np.int64)))
                    if sum(len(k) for k, _ in held[kind]) > HELD_KEYS:
                        held[kind] = [summed(np.concatenate([k for k, _ in held[kind]]), np.concatenate([c for _, c in held[kind]]))]
                        if len(held[kind][0][0]) > HELD_KEYS // 2:
                            yield from handed(kind, held[kind])
                            held[kind] = []
        for kind, parts in held.items():
            if parts:
                yield from handed(kind, parts)

    return count


def _merge(group: pa.Table) -> pa.Table:
    """A bucket's distinct keys with their sums; partial counts are added a part at a time."""
    keys, counts, waiting = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for some, times in zip(group["keys"], group["counts"], strict=True):
        keys.append(unpacked(some.as_py(), np.uint64))
        counts.append(unpacked(times.as_py(), np.uint32).astype(np.int64))
        waiting += len(keys[-1])
        if waiting > max(MERGED_KEYS, len(keys[0])):
            one, sums = summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, waiting = [one], [sums], 0
    one, sums = summed(np.concatenate(keys), np.concatenate(counts))
    return pa.Table.from_batches([_rows(bucket=group["bucket"].chunk(0)[:1], kind=group["kind"].chunk(0)[:1], keys=[packed(one)], counts=[packed(sums)], total=pa.array([int(sums.sum())], pa.int64()), distinct=pa.array([int((sums > 0).sum())], pa.int64()))])


# The tree.


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series eight steps up."""
    up = x + 8
    product = x.copy()
    for i in range(1, 8):
        product *= x + i
    return (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - np.log(product)


def estimate(one: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log probability that the KT estimator gives to so many ones among all bits."""
    return log_gamma(total - one + 0.5) + log_gamma(one + 0.5) - log_gamma(total + 1.0) - math.log(math.pi)


class Depth:
    """The contexts of one depth: ascending entries (context, symbol) with counts.

    An entry has a bit in eight decisions. Those of one context and one beginning of the symbol make a run of entries."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.run, self.first, self.total, self.one = [], [], [], []
        for level in range(8):
            head = keys >> np.uint64(8 - level)
            first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
            self.first.append(first)
            self.run.append(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys)))))
            self.total.append(np.add.reduceat(counts, first))
            self.one.append(np.add.reduceat(counts * self.bit(level), first))

    def bit(self, level: int) -> np.ndarray:
        return (self.keys >> np.uint64(7 - level)) & np.uint64(1)

    def predicted(self, level: int) -> np.ndarray:
        """The KT probability of each entry's own bit."""
        one, total = self.one[level][self.run[level]], self.total[level][self.run[level]]
        return (np.where(self.bit(level) == 1, one, total - one) + 0.5) / (total + 1)


class Tree:
    """Whole subtrees below contexts of TOP bytes, from distinct ascending keys and their counts (0: only to be scored)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.depth, self.depths, self.parents = depth, {depth: Depth(keys, counts.astype(np.float64))}, {}
        for d in range(depth, TOP, -1):
            at = self.depths[d]
            shorter, self.parents[d] = np.unique((at.keys >> np.uint64(16) << np.uint64(8)) | (at.keys & np.uint64(255)), return_inverse=True)
            self.depths[d - 1] = Depth(shorter, np.bincount(self.parents[d], at.counts, len(shorter)))
        # weighted probabilities from below: half the own estimate and half the product of the children's
        self.own: dict[int, list] = {}
        below: list = []
        for d in range(depth, TOP - 1, -1):
            at, self.own[d], up = self.depths[d], [], []
            for level in range(8):
                weighted = alone = estimate(at.one[level], at.total[level])
                if d < depth:
                    weighted = np.logaddexp(alone, below[level]) - _LOG2
                    self.own[d].append(np.exp(alone - _LOG2 - weighted))
                if d > TOP:
                    above = self.depths[d - 1]
                    up.append(np.bincount(above.run[level][self.parents[d][at.first[level]]], weighted, len(above.first[level])))
                else:
                    up.append(weighted)
            below = up
        #: log weighted probabilities of the decisions in contexts of TOP bytes, by level
        self.weighted = below

    def mixed(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each key the probability of its bit by all depths from TOP on, and whether its context of TOP bytes was seen."""
        at = self.depths[self.depth]
        out, seen = at.predicted(level), at.total[level][at.run[level]] > 0
        place = np.arange(len(at.keys))
        for d in range(self.depth - 1, TOP - 1, -1):
            place = self.parents[d + 1][place]
            at = self.depths[d]
            kt, run = at.predicted(level)[place], at.run[level][place]
            w = self.own[d][level][run]
            out, seen = np.where(seen, w * kt + (1 - w) * out, kt), at.total[level][run] > 0
        return out, seen


def subtrees(keys: np.ndarray, depth: int) -> Iterator[slice]:
    """A bucket's ascending keys in runs of about TREE_KEYS; those of one context of TOP bytes stay together."""
    near = keys >> np.uint64(8 * (depth + 1 - TOP))
    edge = np.append(np.flatnonzero(near[1:] != near[:-1]) + 1, len(keys))
    begin = 0
    while begin < len(keys):
        end = int(edge[min(np.searchsorted(edge, begin + TREE_KEYS), len(edge) - 1)])
        yield slice(begin, end)
        begin = end


def _upper(depth: int) -> Callable:
    """(last, node, below, one, total): the decisions in contexts of one byte, from a bucket's contexts of TOP bytes."""

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
                keys, counts = unpacked(keys.as_py(), np.uint64), unpacked(counts.as_py(), np.int64)
                for part in subtrees(keys, depth):
                    tree = Tree(keys[part], counts[part], depth)
                    top = tree.depths[TOP]
                    for level in range(8):
                        some = top.keys[top.first[level]]
                        node = (1 << level) | ((some & np.uint64(255)) >> np.uint64(8 - level)).astype(np.int64)
                        place = (some >> np.uint64(16)).astype(np.int64) << 8 | node
                        which, at = np.unique(place, return_inverse=True)
                        sums = [np.bincount(at, x, len(which)) for x in (tree.weighted[level], top.one[level], top.total[level])]
                        yield _rows(place=which, below=sums[0], one=sums[1], total=sums[2])

    return upper


@dataclass
class Upper:
    """Depths 0 and 1 by (last byte, decision in heap order): counts of ones and of all, and the weight of the own estimate."""

    one: np.ndarray
    total: np.ndarray
    own: np.ndarray
    own_root: np.ndarray

    def mixed(self, last: np.ndarray, node: np.ndarray, bit: np.ndarray, deeper: np.ndarray, seen: np.ndarray) -> np.ndarray:
        one, total = self.one[last, node], self.total[last, node]
        kt, w = (np.where(bit == 1, one, total - one) + 0.5) / (total + 1), self.own[last, node]
        out, seen = np.where(seen, w * kt + (1 - w) * deeper, kt), total > 0
        one, total = self.one.sum(0)[node], self.total.sum(0)[node]
        kt, w = (np.where(bit == 1, one, total - one) + 0.5) / (total + 1), self.own_root[node]
        return np.where(seen, w * kt + (1 - w) * out, kt)


def upper_of(merged: DataFrame, depth: int) -> Upper:
    """The two upper depths; what comes to the driver is bounded by the alphabet: 256 bytes with 255 decisions each."""
    rows = merged.where(F.col("kind") == _GRAM).select("keys", "counts").mapInArrow(lean(_upper(depth)), "place bigint, below double, one double, total double")
    got = rows.groupBy("place").agg(F.sum("below").alias("below"), F.sum("one").alias("one"), F.sum("total").alias("total")).toArrow()
    below, one, total = (np.zeros((256, 256)) for _ in range(3))
    for name, to in (("below", below), ("one", one), ("total", total)):
        to.reshape(-1)[got["place"].to_numpy()] = got[name].to_numpy()
    alone = estimate(one, total)
    weighted = np.logaddexp(alone, below) - _LOG2
    root = estimate(one.sum(0), total.sum(0))
    return Upper(one, total, np.exp(alone - _LOG2 - weighted), np.exp(root - np.logaddexp(root, weighted.sum(0))))


def log_scores(keys: np.ndarray, counts: np.ndarray, upper: Upper, depth: int) -> np.ndarray:
    """log10 probability of each key's symbol in its context, from a bucket's keys and the upper depths."""
    last, symbol = (keys >> np.uint64(8 * depth)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64)
    out = np.zeros(len(keys))
    for part in subtrees(keys, depth):
        tree = Tree(keys[part], counts[part], depth)
        for level in range(8):
            node, bit = (1 << level) | (symbol[part] >> (8 - level)), symbol[part] >> (7 - level) & 1
            out[part] += np.log10(upper.mixed(last[part], node, bit, *tree.mixed(level)))
    return out


# Questions and answers.

ASKED = "bucket int, block bigint, kind int, keys binary"
ANSWERED = "block bigint, kind int, keys binary, found binary"


def distinct_keys(texts: pa.Table, depth: int) -> dict[int, np.ndarray]:
    """All distinct keys of a block of texts by kind, ascending."""
    found: dict[int, list] = {_WORD: [], _GRAM: []}
    for body, bounds in columns_of(texts):
        for _, _, part, cuts in chunked(body, bounds, SORTED_BYTES):
            found[_GRAM].append(distinct(grams(part, cuts, depth)[0]))
            found[_WORD].append(distinct(word_keys(part, cuts)[0]))
            for kind, parts in found.items():
                if len(parts) > 2:
                    found[kind] = [distinct(np.concatenate(parts))]
    return {kind: distinct(np.concatenate(parts)) for kind, parts in found.items()}


def columns_of(texts: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for chunk in texts["text"].chunks:
        yield utf8(chunk)


def _ask(buckets: int, depth: int) -> Callable:
    def ask(texts: pa.Table) -> pa.Table:
        block = texts["block"][0].as_py()
        out = []
        for kind, keys in distinct_keys(texts, depth).items():
            out += [(bucket, block, kind, packed(keys[at])) for bucket, at in dealt(keys, bucket_of(kind, keys, buckets, depth))]
        columns = list(zip(*out, strict=True))
        return pa.Table.from_batches([_rows(bucket=pa.array(columns[0], pa.int32()), block=pa.array(columns[1], pa.int64()), kind=pa.array(columns[2], pa.int32()), keys=pa.array(columns[3], pa.binary()))])

    return ask


def _answer(upper, depth: int) -> Callable:
    """A bucket's counts against what blocks ask: for words their counts, for grams their log probabilities."""

    def answer(model: pa.Table, asked: pa.Table) -> pa.Table:
        known = {}
        if asked.num_rows:
            for kind, keys, counts in zip(model["kind"].to_pylist(), model["keys"].to_pylist(), model["counts"].to_pylist(), strict=True):
                keys, counts = unpacked(keys, np.uint64), unpacked(counts, np.int64)
                known[kind] = keys, counts if kind == _WORD else log_scores(keys, counts, upper.value, depth).astype(np.float32)
        found = []
        for kind, asked_keys in zip(asked["kind"].to_pylist(), asked["keys"].to_pylist(), strict=True):
            keys, values = known[kind]
            wanted = unpacked(asked_keys, np.uint64)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            if not (keys[at] == wanted).all():
                raise ValueError("a block asks for keys that were not counted: the documents changed between two reads")
            found.append(packed(values[at]))
        return pa.Table.from_arrays([asked["block"], asked["kind"], asked["keys"], pa.array(found, pa.binary())], ["block", "kind", "keys", "found"])

    return answer


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double"


#: Texts whose keys are sorted at once with the text's number beside each.
NUMBERED = 256


def answered(answers: pa.Table, kind: int, value: type) -> tuple[np.ndarray, np.ndarray]:
    """What all buckets have answered a block: ascending keys and their values."""
    of_kind = answers.filter(pc.equal(answers["kind"], kind))
    keys = np.concatenate([np.zeros(0, np.uint64), *(unpacked(x.as_py(), np.uint64) for x in of_kind["keys"])])
    values = np.concatenate([np.zeros(0, value), *(unpacked(x.as_py(), value) for x in of_kind["found"])])
    order = np.argsort(keys)
    return keys[order], values[order]


def summed_by_text(gram: np.ndarray, length: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of each text's keys. A key has 56 bits at most, so the number of its text fits beside it in a sort."""
    out, upto = np.zeros(len(length)), np.append(0, np.cumsum(length))
    for a in range(0, len(length), NUMBERED):
        b = min(a + NUMBERED, len(length))
        both = gram[upto[a] : upto[b]] << np.uint64(8)
        both |= np.repeat(np.arange(b - a).astype(np.uint64), length[a:b])
        both.sort()
        some = both >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
        at = np.minimum(np.searchsorted(keys, some[first]), len(keys) - 1)
        if not (keys[at] == some[first]).all():
            raise ValueError("keys of a block were not answered: the documents changed between two reads")
        value = np.repeat(values[at], np.diff(np.append(first, len(some))))
        both &= np.uint64(255)
        out[a:b] = np.bincount(both.astype(np.int64), value, b - a)
    return out


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double"


def _score(depth: int) -> Callable:
    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        words_, counts = answered(answers, _WORD, np.int64)
        keys, values = answered(answers, _GRAM, np.float32)
        del answers
        gain = np.log10(counts + 1.0)
        n_tokens, known, base, scores = [], [], [], []
        for body, bounds in columns_of(texts):
            for first, last, part, cuts in chunked(body, bounds, SORTED_BYTES):
                n = last - first
                scores.append(summed_by_text(*grams(part, cuts, depth), keys, values))
                word, row = word_keys(part, cuts)
                at = np.searchsorted(words_, word)
                n_tokens.append(np.bincount(row, minlength=n) + 1)
                known.append(np.bincount(row[counts[at] > 0], minlength=n))
                base.append(np.bincount(row, gain[at], n))
        columns = [np.concatenate(x) if x else np.zeros(0) for x in (n_tokens, known, base, scores)]
        arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
        return pa.Table.from_arrays([texts["doc_id"], texts["held_out"], *arrays], [x.split()[0] for x in SCORED.split(", ")])

    return score


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def scored(docs: DataFrame, learns: Column | None = None, key: str = "doc_id", text: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out (not learnt from), n_tokens, n_known, train_tokens, base_score, score.

    The rows where `learns` holds (by default those not held out) are the training texts. Null or empty text: one token, the end.
    Repeated rows stay apart; nothing learnt gives finite scores too; an empty table gives no rows; further columns are ignored.
    Counts are summed in each task before they are shuffled. Blocks deal documents by hash and place, so neither copies nor null
    ids fill one. A bucket that very many blocks ask stands in copies, each for some of the blocks."""
    spark = prepared(docs.sparkSession)
    learns = ~held_out(key) if learns is None else learns
    base = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(learns, F.lit(False)).alias("learns"), F.col(f"`{text}`").alias("text"))
    seen = base.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("learns").cast("long")).alias("ends")).first()
    total, ends = seen["bytes"] or 0, seen["ends"] or 0
    buckets = min(1 << 16, max(8, -(-total // bucket_bytes)))
    blocks = max(1, -(-total // block_bytes))
    copies = -(-blocks // BLOCKS_OF_COPY)

    counted = base.select("learns", "text").mapInArrow(lean(_count(buckets, depth)), COUNTED)
    merged = stored(counted.groupBy("bucket", "kind").applyInArrow(lean_groups(_merge), MERGED))
    of_words = merged.where(F.col("kind") == _WORD).agg(F.sum("total").alias("n"), F.sum("distinct").alias("distinct")).first()
    tokens, distinct = ends + (of_words["n"] or 0), (1 if ends else 0) + (of_words["distinct"] or 0)
    upper = spark.sparkContext.broadcast(upper_of(merged, depth))

    block = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(blocks))
    dealt_texts = base.select(block.alias("block"), "doc_id", (~F.col("learns")).alias("held_out"), "text").repartition("block")
    asked = dealt_texts.groupBy("block").applyInArrow(lean_groups(_ask(buckets, depth)), ASKED).withColumn("copy", F.pmod("block", F.lit(copies)).cast("int"))
    model = merged.select("bucket", "kind", "keys", "counts").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    answers = model.groupBy("bucket", "copy").cogroup(asked.groupBy("bucket", "copy")).applyInArrow(lean_cogroups(_answer(upper, depth)), ANSWERED)
    got = dealt_texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean_cogroups(_score(depth)), SCORED)
    return got.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + (1 if ends else 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(tokens + distinct + 1))).alias("base_score"), "score",
    )


def op8_lm(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"))
