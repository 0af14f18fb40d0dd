"""Operator 7: byte-level BPE by corpus-level merge replay.

The distinct pieces of the corpus are counted, and the most frequent of them, up to a bound that a worker can hold, are merged once
for all documents; rarer ones are merged with the batch of texts that brings them, by the same replay and with the same ids. In a
replay all pieces are laid end to end. An inverted index leads from the rank of a pair to the places where that pair stands; the
ranks are taken in order, each merge is applied at all its places at once, and only the pairs with the two neighbours of a merged
place are looked at again."""

from __future__ import annotations

import base64
import functools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagflow.llm.common import discard, keyed, lean, own, prepared, stored, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Most frequent pieces of the corpus that are merged ahead and sent to all workers, at most.
FREQUENT = 200_000
#: Rarer pieces a worker remembers; beyond that it begins anew, which costs time and changes nothing.
REMEMBERED = 100_000
#: Distinct pieces a counting task holds before it hands partial counts on.
HELD_PIECES = 200_000

_NONE = np.int64(1 << 60)


class Vocabulary:
    """Ranks of byte strings, the strings by rank, and the rank of every pair of tokens that makes a token."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pairs = np.full((256, 256), _NONE, np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0], token[1]] = rank
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # (id of the left part << 32 | id of the right part), ascending, and the rank of the two together, for all splits of all tokens
        find, keys, joined = self.ranks.get, [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (left := find(token[:cut])) is not None and (right := find(token[cut:])) is not None:
                    keys.append(left << 32 | right)
                    joined.append(rank)
        order = np.argsort(keys)
        self.keys, self.joined = np.array(keys, np.int64)[order], np.array(joined, np.int64)[order]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = self.keys.searchsorted(wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.joined[at], _NONE)


@functools.lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    """Read once in each worker from the tokenizers installed there; a name with a slash is a path."""
    return Vocabulary(name if "/" in name else public_tokenizers.path(name))


def one_by_one(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain rule for one piece: merge the leftmost pair of least rank until no pair has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min((ranks.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
        if best[0] == _NONE:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


def apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of ascending places of one rank, those that a merge from left to right takes: none begins where the one before ends."""
    overlaps = after[at[:-1]] == at[1:]
    if not overlaps.any():
        return at
    keep = np.ones(len(at), bool)
    for n in np.flatnonzero(overlaps).tolist():
        keep[n + 1] = not keep[n]
    return at[keep]


def replay(pieces: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Ids of all pieces, each as little-endian 32-bit numbers.

    Replaying rank by rank over all pieces gives what each alone would give, unless a merge makes a pair of a lower rank than
    its own; a piece where that happens is done again by the plain rule."""
    ranks = vocab.ranks
    out: list[bytes] = [b""] * len(pieces)
    rest = []
    for n, piece in enumerate(pieces):
        whole = ranks.get(piece)
        if whole is not None:
            out[n] = whole.to_bytes(4, "little")
        elif piece:
            rest.append(n)
    if not rest:
        return out
    flat = np.frombuffer(b"".join([pieces[n] for n in rest]), np.uint8)
    ends = np.cumsum([len(pieces[n]) for n in rest])
    size = len(flat)
    rank = np.full(size, _NONE, np.int64)
    rank[:-1] = vocab.pairs[flat[:-1], flat[1:]]
    rank[ends - 1] = _NONE
    after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
    after[ends - 1] = -1  # no pair reaches over the border of two pieces
    before[ends[:-1]] = -1
    ids = vocab.single[flat]
    places = np.flatnonzero(rank < _NONE)
    places = places[np.argsort(rank[places], kind="stable")]
    values, cuts = np.unique(rank[places], return_index=True)
    index: dict[int, list] = {r: [p] for r, p in zip(values.tolist(), np.split(places, cuts[1:]), strict=True)} if len(places) else {}
    queue = list(index)
    heapify(queue)
    again: list[np.ndarray] = []
    while queue:
        now = heappop(queue)
        at = np.concatenate([np.atleast_1d(x) for x in index[now]]) if len(index[now]) > 1 else index[now][0]
        del index[now]
        at = at[rank[at] == now]  # the others are stale: one of the two has been merged with another
        if not len(at):
            continue
        if len(at) > 1:
            at = apart(np.unique(at), after)
        j = after[at]
        k = after[j]
        ids[at], ids[j] = now, -1
        rank[at] = rank[j] = _NONE
        after[at] = k
        right = k >= 0
        k, from_k = k[right], at[right]
        before[k] = from_k
        h = before[at]
        left = h >= 0
        h = h[left]
        rank[h] = _NONE
        where = np.concatenate([from_k, h])
        new = vocab.rank_of(ids[where], ids[after[where]])
        good = new < _NONE
        where, new = where[good], new[good]
        if not len(new):
            continue
        rank[where] = new
        if (new <= now).any():
            again.append(where[new <= now])
        order = np.argsort(new, kind="stable")
        where, new = where[order], new[order]
        first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
        for r, group in zip(new[first].tolist(), np.split(where, first[1:]), strict=True):
            if r in index:
                index[r].append(group)
            else:
                index[r] = [group]
                heappush(queue, r)
    live = ids >= 0
    packed = ids[live].astype("<u4").tobytes()
    upto = np.cumsum(live)[ends - 1] * 4
    begin = 0
    for n, end in zip(rest, upto.tolist(), strict=True):
        out[n] = packed[begin:end]
        begin = end
    for n in np.unique(np.searchsorted(ends, np.concatenate(again), "right")).tolist() if again else ():
        out[rest[n]] = np.array(one_by_one(pieces[rest[n]], ranks), "<u4").tobytes()
    return out


# The corpus' pieces.


@functools.lru_cache(maxsize=1)
def written_out() -> re.Pattern:
    """PATTERN for the standard library's matcher, which is much faster: its classes as code points, below U+10000 only."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    letter, number, white = ("".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(kind + "+", every)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """What gives a text's matches of the pattern."""
    whole = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return whole
    below = written_out().findall

    def split(text: str) -> list[str]:
        return below(text) if text.isascii() or 2 * len(text) == len(text.encode("utf-16-le")) else whole(text)

    return split


def _pieces(pattern: str) -> Callable:
    """(piece, n): how often each piece stands in a task's texts, in parts."""

    def handed(counts: Counter) -> Iterator[pa.RecordBatch]:
        names, times = list(counts), list(counts.values())
        for i in range(0, len(names), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 50_000], pa.string()), pa.array(times[i : i + 50_000], pa.int64())], ["piece", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = splitter(pattern), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(split(text))
            if len(counts) > HELD_PIECES:
                yield from handed(counts)
                counts = Counter()
        yield from handed(counts)

    return count


def _replayed(name: str) -> Callable:
    """A whole partition of distinct pieces is one replay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [p for batch in batches for p in batch.column(0).to_pylist()]
        ids = replay([p.encode() for p in pieces], vocabulary(name))
        for i in range(0, len(pieces), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pieces[i : i + 50_000], pa.string()), pa.array(ids[i : i + 50_000], pa.binary())], ["piece", "ids"])

    return run


def merged_ahead(texts: DataFrame, name: str, pattern: str, frequent: int) -> Broadcast:
    """The corpus' most frequent pieces with their ids, as a broadcast of at most `frequent` of them.

    All documents are counted. Steps of an eighth of a power of two say from which count on pieces are few enough."""
    spark = texts.sparkSession
    counts = stored(texts.mapInArrow(lean(_pieces(pattern)), "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")))
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("pieces"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, total = 1 << 62, 0
    for step in steps:
        total += step["pieces"]
        if total > frequent:
            break
        least = step["least"]
    chosen = counts.where(F.col("n") >= least).select("piece").repartition(4, "piece")
    got = chosen.mapInArrow(lean(_replayed(name)), "piece string, ids binary").toArrow()
    discard(counts)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, got.schema) as writer:
        writer.write_table(got)
    return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


# Texts.


class Known:
    """Pieces and their ids in a task: the frequent ones for good, others as they come."""

    def __init__(self, vocab: Vocabulary, packed: bytes):
        frequent = pa.ipc.open_stream(packed).read_all()
        self.vocab = vocab
        self.ids = dict(zip(frequent["piece"].to_pylist(), frequent["ids"].to_pylist(), strict=True))
        self.rare: list[str] = []

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.ids))
        if len(self.rare) + len(new) > REMEMBERED:
            for piece in self.rare:
                del self.ids[piece]
            self.rare = []
            new = list(pieces.difference(self.ids))
        self.rare += new
        self.ids.update(zip(new, replay([piece.encode() for piece in new], self.vocab), strict=True))


def encode_batch(texts: Iterable[str | None], known: Known, found: Callable[[str], list[str]]) -> list[bytes]:
    split = [found(text) if text else [] for text in texts]
    known.learn(set().union(*split))
    find = known.ids.__getitem__
    return [b"".join(map(find, pieces)) for pieces in split]


def decode_batch(ids: list[bytes], vocab: Vocabulary) -> list[bytes]:
    find = vocab.tokens.__getitem__
    return [b"".join(map(find, np.frombuffer(one, "<u4").tolist())) for one in ids]


def _encoder(name: str, pattern: str, shared: Broadcast) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # for the length of the task: a worker that goes on to other work holds nothing
        known, found = Known(vocabulary(name), shared.value), splitter(pattern)
        for batch in batches:
            ids = encode_batch(batch.column(1).to_pylist(), known, found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["row_key", "ids"])

    return encode


def _decoder(name: str) -> Callable:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name)
        for batch in batches:
            texts = decode_batch(batch.column(1).to_pylist(), vocab)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["row_key", "ids", "decoded"])

    return decode


def _both(name: str, pattern: str, shared: Broadcast) -> Callable:
    """Encoder and decoder in one Python worker: ids go from one to the other without leaving it."""
    encode, decode = _encoder(name, pattern, shared), _decoder(name)
    return lambda batches: decode(encode(batches))


def encoded(docs: DataFrame, text: str = "text", name: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, frequent: int = FREQUENT) -> DataFrame:
    """row_key, the struct of all columns but the text, and ids: the tokens as little-endian unsigned 32-bit numbers.

    Each match of the pattern is encoded by itself, without special tokens; null and empty texts have no ids. Only the counts of
    pieces are shuffled; texts are encoded where they are read, so repeated rows and keys stay apart and hot keys don't matter.
    A worker holds one batch of texts, their distinct pieces, the `frequent` ones and at most REMEMBERED others. An empty table
    gives no rows; columns of any name pass through."""
    prepared(docs.sparkSession)
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]).alias("row_key"), F.col(f"`{text}`").alias("text"))
    shared = merged_ahead(frame.select("text"), name, pattern, frequent)
    return frame.mapInArrow(lean(_encoder(name, pattern, shared)), keyed(frame, "ids binary"))


def decoded(frame: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """row_key, ids and decoded, the bytes that the ids stand for."""
    return frame.select("row_key", "ids").mapInArrow(lean(_decoder(name)), keyed(frame, "ids binary, decoded binary"))


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; null and empty texts have no tokens."""
    prepared(docs.sparkSession)
    frame = own(docs, row_key=key, text=text)
    shared = merged_ahead(frame.select("text"), name, public_tokenizers.PATTERN, frequent)
    got = frame.mapInArrow(lean(_both(name, public_tokenizers.PATTERN, shared)), keyed(frame, "ids binary, decoded binary"))
    return got.select(
        F.col("row_key").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def tokenised(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every column but the text, the ids, and how many they are; columns that came as `ids` or `n_tokens` are
    replaced. Null and empty texts have no ids, repeated rows stay, an empty table gives no rows."""
    got = encoded(docs)
    others = [F.col("row_key").getField(c).alias(c) for c in docs.columns if c not in ("text", "ids", "n_tokens")]
    return got.select(*others, "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


def op7_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))
