"""Operator 3: removal of repeated passages by suffix order and longest previous factors.

A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller id. One suffix array of a corpus doesn't
fit a machine, so the suffixes are dealt out such that equal strings of LENGTH bytes meet:

1. Every such string (a window) has an anchor, the least hash among its substrings of GRAM bytes; equal windows have equal anchors.
   Anchors found in one text only are dropped, which leaves the fifth of the corpus that might repeat.
2. A run of windows with one anchor, with its bytes, is a context. Contexts are dealt by anchor into buckets of bounded bytes; an
   anchor that very many texts have would fill one, so its windows are dealt one by one, by their own hash.
3. In a bucket the windows are put in suffix order to depth LENGTH. The nearest neighbours in that order from earlier documents, the
   previous and the next smaller position, give each window its longest previous factor, and where that reaches LENGTH the
   window goes; the earliest document keeps its copy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagflow.llm.common import chunked, discard, gathered, in_pieces, keyed, lean, mix, own, places_of, prepared, span_hashes, stored, table, utf8

#: Bytes of a string that may not come again, and of the substrings whose hashes compete for its anchor. Substrings of 16 bytes, two
#: or three words, come again by chance the more often the larger the corpus is, and each such anchor sends its contexts for nothing.
LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
#: Text bytes that a bucket of anchors, or of contexts, stands for: what one step of a task holds follows from it.
BUCKET_BYTES = 4 << 20
#: Windows that are put in suffix order at once, about so many at most, but for equal ones.
SLICE = 200_000
#: Texts (of those asking after it) from which on an anchor is hot, at least, and hot anchors that every task knows, at most: with
#: more, the number of texts is raised until they are few enough.
HOT_TEXTS, HOT_ANCHORS = 1000, 200_000
#: An anchor in one text of so many is hot: windows dealt one by one take many times the bytes of their context, which only pays
#: where most of them are settled in their batch. Of a context, its bytes and numbers, a bucket holds BUCKET_BYTES of one anchor at most.
HOT_SHARE, CONTEXT_BYTES = 250, 128

_P = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 2**64))


def rolled(body: np.ndarray) -> np.ndarray:
    """A polynomial hash of every GRAM bytes, by doubling the length hashed and joining what GRAM has of such lengths."""
    part, step, out, upto = body.astype(np.uint64) + np.uint64(1), 1, None, 0
    while step <= GRAM:
        if GRAM & step:
            size = len(body) - upto - step + 1
            out = part if out is None else out[:size] * _power(step) + part[upto : upto + size]
            upto += step
        if 2 * step <= GRAM:
            part = part[:-step] * _power(step) + part[step:]
        step *= 2
    return out


def gram_hashes(body: np.ndarray) -> np.ndarray:
    return mix(rolled(body))


def window_hashes(body: np.ndarray) -> np.ndarray:
    """A hash of every LENGTH bytes, from the hashes of GRAM bytes and single bytes for the rest."""
    grams, size = rolled(body), len(body) - LENGTH + 1
    out = np.zeros(size, np.uint64)
    for k in range(0, LENGTH - GRAM + 1, GRAM):
        out = out * _power(GRAM) + grams[k : k + size]
    for k in range(LENGTH // GRAM * GRAM, LENGTH):
        out = out * _power(1) + (body[k : k + size].astype(np.uint64) + np.uint64(1))
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, step = values, 1
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(out) - (width - step)], out[width - step :]) if step < width else out


def anchors(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: row, first window, end of the last window's start (exclusive), anchor hash.

    Places are counted from the start of all bytes. Windows never cross rows."""
    if len(body) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least = sliding_min(gram_hashes(body), WINDOW)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = row[: len(least)] == row[LENGTH - 1 :]
    edge = np.empty(len(least), bool)
    edge[0] = True
    edge[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (row[1 : len(least)] != row[: len(least) - 1])
    first = np.flatnonzero(edge)
    end = np.append(first[1:], len(least))
    keep = inside[first]
    first, end = first[keep], end[keep]
    return row[first], first, end, least[first]


def code_of(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of an anchor and 32 bits of it within the bucket. Two anchors taken for one cost a comparison and change nothing."""
    return ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def blobs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct sorted keys, and for each the bytes of its rows of values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], np.ascontiguousarray(values[order])
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = values.dtype.itemsize * int(np.prod(values.shape[1:], dtype=np.int64))
    offsets = (np.append(first, len(keys)) * size).astype(np.int32)
    return keys[first], pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


# Step 1: which anchors stand in more than one text.


def _asking(buckets: int) -> Callable:
    """(text_code, text) to rows (bucket, text_code, codes, subs, texts).

    With codes: anchors that two texts of this batch share are known to be shared, for each of these texts. With subs and
    texts: the question about all others, and one witness of each shared anchor, for the other batches."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            body, bounds = utf8(batch.column(1))
            hashes, texts = [], []
            for first, _, part, cuts in chunked(body, bounds):
                row, _, _, anchor = anchors(part, cuts)
                hashes.append(anchor)
                texts.append(names[first + row])
            anchor, text = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(texts) if texts else np.zeros(0, np.int64)
            order = np.lexsort((text, anchor))
            anchor, text = anchor[order], text[order]
            fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]) if len(anchor) else np.zeros(0, bool)
            anchor, text = anchor[fresh], text[fresh]
            same = np.concatenate([anchor[1:] == anchor[:-1], [False]]) if len(anchor) else np.zeros(0, bool)
            witness = np.concatenate([[True], ~same[:-1]]) if len(anchor) else same
            shared = same | ~witness
            bucket, sub = code_of(anchor, buckets)
            code = bucket.astype(np.int64) << 32 | sub
            mine, known = blobs(text[shared], code[shared])
            # a hash of the text deals these rows out evenly
            yield _asked(mine % buckets, mine, known, None, None)
            which, subs = blobs(bucket[witness], sub[witness])
            yield _asked(which, None, None, subs, blobs(bucket[witness], text[witness])[1])

    return ask


def _asked(bucket, text, codes, subs, texts) -> pa.RecordBatch:
    n = len(bucket)
    empty = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket.astype(np.int32)), pa.nulls(n, pa.int64()) if text is None else pa.array(text), *(empty if x is None else x for x in (codes, subs, texts))], ["bucket", "text_code", "codes", "subs", "texts"]
    )


ASKED = "bucket int, text_code bigint, codes binary, subs binary, texts binary"


def by_bucket(batches: Iterator[pa.RecordBatch], through: Callable[[pa.RecordBatch], pa.RecordBatch], column: str) -> Iterator:
    """Rows come sorted by bucket. Rows where `column` is null need nothing and go `through`; of the others, each bucket's are
    given together as (bucket, rows)."""
    held: list[dict] = []
    now = None
    for batch in batches:
        asks = batch.column(column).is_valid()
        yield through(batch.filter(pc.invert(asks)))
        for row in batch.filter(asks).to_pylist():
            if row["bucket"] != now and held:
                yield now, held
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        yield now, held


def opened(batch: pa.RecordBatch, name: str, *keys: str) -> pa.RecordBatch:
    """Rows of keys and packed 64-bit numbers to a row for each number."""
    body, bounds = utf8(batch.column(name))
    times = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds) // 8))
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(times) for k in keys), pa.array(body.view(np.int64))], [*keys, name])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_code, codes): the anchors of a text that stand in another text too, a row for each."""
    for got in by_bucket(batches, lambda b: opened(b, "codes", "text_code"), "subs"):
        if isinstance(got, pa.RecordBatch):
            yield got
            continue
        bucket, rows = got
        sub = np.concatenate([np.frombuffer(r["subs"], np.uint32) for r in rows])
        text = np.concatenate([np.frombuffer(r["texts"], np.int64) for r in rows])
        order = np.lexsort((text, sub))
        sub, text = sub[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1]]))
        size = np.diff(np.append(first, len(sub)))
        last = first + size - 1
        shared = np.repeat(text[first] != text[last], size)
        yield pa.RecordBatch.from_arrays([pa.array(text[shared]), pa.array((np.int64(bucket) << 32) | sub[shared].astype(np.int64))], ["text_code", "codes"])


# Step 2: contexts of shared anchors.


def settle(code: np.ndarray, ids: np.ndarray, hashes: np.ndarray, body: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts, which of them (the head) is the same bytes in the smallest id, and whether that id is smaller than theirs."""
    order = np.lexsort((ids, hashes, code))
    c, h = code[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (h[1:] != h[:-1])])) if len(c) else np.zeros(0, np.int64)
    head = np.empty(len(c), np.int64)
    head[order] = np.repeat(order[first], np.diff(np.append(first, len(c))))
    # the bytes decide, not the hash
    other = np.flatnonzero(head != np.arange(len(head)))
    same = size[other] == size[head[other]]
    head[other[~same]] = other[~same]
    other = other[same]
    for k in in_pieces(size[other]):
        some = other[k]
        differ = body[places_of(start[some], size[some])[0]] != body[places_of(start[head[some]], size[some])[0]]
        wrong = some[np.add.reduceat(differ, np.cumsum(size[some]) - size[some]) > 0]
        head[wrong] = wrong
    return head, ids > ids[head]


def packed(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans as single numbers."""
    return begin.astype(np.int64) << 32 | end.astype(np.int64)


CONTEXTS = "bucket int, text_code bigint, text_id bigint, spans binary, subs binary, ids binary, texts binary, starts binary, sizes binary, body binary"


def alone(body: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray, ids: np.ndarray, buckets: int) -> tuple:
    """Contexts of hot anchors taken apart into their windows: (code, row, place) of those that only their bucket can settle, and
    (row, begin, end) of runs of windows that a smaller id among these texts has."""
    n = end - begin
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    row = np.repeat(row, n)
    hashes = window_hashes(body)[place]
    order = np.lexsort((ids[row], hashes))
    h = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    head = np.empty(len(order), np.int64)
    head[order] = np.repeat(order[first], np.diff(np.append(first, len(order))))
    later = ids[row] > ids[row[head]]
    for mine, its in zip(words_at(body, place[later]), words_at(body, place[head[later]]), strict=True):
        later[later] &= mine == its
    bucket, sub = code_of(hashes[~later], buckets)
    gone, of = place[later], row[later]
    new = np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (of[1:] != of[:-1])]) if len(gone) else np.zeros(0, bool)
    last = np.append(new[1:], True) if len(gone) else new
    return bucket.astype(np.int64) << 32 | sub, row[~later], place[~later], of[new], gone[new], gone[last] + LENGTH


def _contexts(buckets: int, hot: np.ndarray) -> Callable:
    """(text_code, id, text, codes) to rows by bucket. With spans: removals that this batch alone shows, for a text. With the
    rest: contexts that only their bucket can settle; of equal ones in a batch only those of the smallest id are sent."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            codes = [np.sort(flat[at[k] : at[k + 1]]) for k in range(len(lists))]
            body, bounds = utf8(batch.column(2))
            parts, settled = [], []
            for first, last, part, cuts in chunked(body, bounds):
                row, begin, end, anchor = anchors(part, cuts)
                bucket, sub = code_of(anchor, buckets)
                code = bucket.astype(np.int64) << 32 | sub
                shared = np.zeros(len(code), bool)
                at = np.searchsorted(row, np.arange(last - first + 1))
                for k in range(last - first):
                    mine, known = code[at[k] : at[k + 1]], codes[first + k]
                    shared[at[k] : at[k + 1]] = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
                row, begin, end, code = row[shared], begin[shared], end[shared], code[shared]
                many = hot[np.minimum(np.searchsorted(hot, code), len(hot) - 1)] == code if len(hot) else np.zeros(len(code), bool)
                if many.any():
                    c, r, place, of, a, b = alone(part, row[many], begin[many], end[many], ids[first:last], buckets)
                    settled.append((first + of, a - cuts[of], b - cuts[of]))
                    size = np.full(len(c), LENGTH)
                    parts.append((c, first + r, place - cuts[r], size, span_hashes(part, place, place + size), gathered(part, place, size)))
                row, begin, end, code = row[~many], begin[~many], end[~many], code[~many]
                size = end - begin + LENGTH - 1
                parts.append((code, first + row, begin - cuts[row], size, span_hashes(part, begin, begin + size), gathered(part, begin, size)))
            if not parts:
                continue
            code, row, start, size, hashes, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            place = np.cumsum(size) - size
            _, later = settle(code, ids[row], hashes, text, place, size)
            settled.append((row[later], start[later], start[later] + size[later]))
            who, a, b = (np.concatenate(x) for x in zip(*settled, strict=True))
            done, spans = blobs(who, packed(a, b))
            yield _context_rows(names[done] % buckets, (names[done], ids[done]), spans, None)
            ask = np.flatnonzero(~later)
            ask = ask[np.argsort(code[ask] >> 32, kind="stable")]
            which = (code[ask] >> 32).astype(np.int32)
            if len(ask):
                columns = [blobs(which, c)[1] for c in ((code[ask] & 0xFFFFFFFF).astype(np.uint32), ids[row[ask]], names[row[ask]], start[ask].astype(np.int32), size[ask].astype(np.int32))]
                first_of = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
                offsets = np.append(0, np.cumsum(np.add.reduceat(size[ask], first_of))).astype(np.int32)
                columns.append(pa.Array.from_buffers(pa.binary(), len(first_of), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(gathered(text, place[ask], size[ask]).tobytes())]))
                yield _context_rows(which[first_of], None, None, columns)

    return make


def _context_rows(bucket, text, spans, columns) -> pa.RecordBatch:
    n = len(bucket)
    empty = pa.nulls(n, pa.binary())
    who = [pa.nulls(n, pa.int64())] * 2 if text is None else [pa.array(x) for x in text]
    arrays = [pa.array(bucket.astype(np.int32)), *who, empty if spans is None else spans, *(columns or [empty] * 6)]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in CONTEXTS.split(", ")])


# Step 3: suffix order in a bucket.


def words_at(body: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """The LENGTH bytes at each place as big-endian numbers, most significant first."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eight = np.zeros(len(body) + 1, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + len(eight)]
    out = [eight[places + k] for k in range(0, LENGTH - 7, 8)]
    rest = LENGTH % 8
    return [*out, eight[places + LENGTH - rest] >> np.uint64(64 - 8 * rest)] if rest else out


def common_prefix(keys: list[np.ndarray]) -> np.ndarray:
    """Bytes that each string has in common with the one before it, LENGTH at most; keys are the strings in order."""
    n = len(keys[0])
    out, undecided = np.full(max(n - 1, 0), LENGTH), np.ones(max(n - 1, 0), bool)
    for k, key in enumerate(keys):
        differ = key[1:] ^ key[:-1]
        now = np.flatnonzero(undecided & (differ != 0))
        width = min(8, LENGTH - 8 * k)
        bytes_ = sum((differ[now] < np.uint64(1 << 8 * b)).astype(np.int64) for b in range(1, width))
        out[now] = 8 * k + bytes_
        undecided[now] = False
    return out


def previous_smaller(values: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place the least of lcp on the way back to the nearest place with a smaller value; 0 where there is none.

    Least values of 1, 2, 4 … places say how far each may step back without passing a smaller one."""
    n = len(values)
    least, shared = [values], [np.concatenate([[0], lcp])]
    while 2 * (step := 1 << (len(least) - 1)) < n:
        a, b = least[-1], shared[-1]
        least.append(np.concatenate([a[:step], np.minimum(a[step:], a[:-step])]))
        shared.append(np.concatenate([b[:step], np.minimum(b[step:], b[:-step])]))
    at, out = np.arange(n), np.full(n, LENGTH)
    for k in range(len(least) - 1, -1, -1):
        # the 2**k places before `at` end at at - 1
        can = np.flatnonzero(at >= 1 << k)
        far = at[can]
        free = least[k][far - 1] >= values[can]
        can, far = can[free], far[free]
        out[can] = np.minimum(out[can], shared[k][far])
        at[can] = far - (1 << k)
    return np.where(at > 0, np.minimum(out, shared[0][at]), 0)


def previous_factors(body: np.ndarray, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The longest previous factor of each place, LENGTH at most: the longest prefix of the LENGTH bytes there that is also the
    beginning at a place with a smaller id.

    The places are put in suffix order to depth LENGTH. In that order the best match from an earlier document is the nearest one
    on either side, so the common prefixes on the way to the previous and to the next smaller id are all that is needed."""
    if not len(places):
        return np.zeros(0, np.int64)
    keys = words_at(body, places)
    order = np.lexsort((ids, *keys[::-1]))
    lcp = common_prefix([key[order] for key in keys])
    values = ids[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(previous_smaller(values, lcp), previous_smaller(values[::-1], lcp[::-1])[::-1])
    return out


def slices(hashes: np.ndarray) -> Iterator[slice]:
    """Windows, sorted by their hash, in runs of about SLICE; equal ones stay together."""
    edge = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    begin = 0
    while begin < len(hashes):
        at = np.searchsorted(edge, begin + SLICE)
        end = int(edge[at]) if at < len(edge) else len(hashes)
        yield slice(begin, end)
        begin = end


def reached(body: np.ndarray, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each place reaches LENGTH. Of a window whose hash no other one has it doesn't; the
    others are put in suffix order, as many at a time as SLICE."""
    gone = np.zeros(len(places), bool)
    if not len(places):
        return gone
    hashes = window_hashes(body)[places]
    order = np.argsort(hashes)
    hashes = hashes[order]
    same = np.concatenate([[False], hashes[1:] == hashes[:-1], [False]])
    twice = same[1:] | same[:-1]
    order, hashes = order[twice], hashes[twice]
    for part in slices(hashes):
        at = order[part]
        gone[at] = previous_factors(body, places[at], ids[at]) >= LENGTH
    return gone


def bucket_spans(sub: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, begin, end) of the removals among a bucket's contexts; places are counted in the contexts' texts."""
    cuts = np.concatenate([[0], np.cumsum(size)])
    head, later = settle(sub, ids, span_hashes(body, cuts[:-1], cuts[1:]), body, cuts[:-1], size)
    heads = np.flatnonzero(head == np.arange(len(head)))
    # an anchor with one head has no other string to meet
    _, at, times = np.unique(sub[heads], return_inverse=True, return_counts=True)
    heads = heads[times[at] > 1]
    windows = size[heads] - LENGTH + 1
    owner = np.repeat(np.arange(len(heads)), windows)
    within = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    gone = reached(body, cuts[heads][owner] + within, ids[heads][owner])
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    new_owner = np.concatenate([[False], owner[1:] != owner[:-1], [False]]) if len(owner) else np.zeros(1, bool)
    both = new_owner[:-1] & gone & np.concatenate([[False], gone[:-1]]) if len(gone) else np.zeros(0, bool)
    begin = np.flatnonzero((edge[:-1] == 1) | both)
    end = np.flatnonzero((edge[1:] == -1) | (np.concatenate([both[1:], [False]]) if len(both) else both)) + 1
    of, a, b = owner[begin], within[begin], within[end - 1] + LENGTH
    # a head's removals hold for its equals of the same id; equals of larger ids go whole
    place = np.full(len(head), -1)
    place[heads] = np.arange(len(heads))
    equals = np.flatnonzero(~later & (place[head] >= 0))
    count = np.bincount(of, minlength=len(heads))
    first = np.cumsum(count) - count
    n = count[place[head[equals]]]
    entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[place[head[equals]]], n)
    who = np.repeat(equals, n)
    whole = np.flatnonzero(later)
    return np.concatenate([who, whole]), np.concatenate([start[who] + a[entry], start[whole]]), np.concatenate([start[who] + b[entry], start[whole] + size[whole]])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_code, text_id, spans): removals of a text, a row for each, of contexts sorted by bucket."""
    for got in by_bucket(batches, lambda b: opened(b, "spans", "text_code", "text_id"), "subs"):
        if isinstance(got, pa.RecordBatch):
            yield got
            continue
        _, rows = got
        sub, ids, texts, start, size, body = (np.concatenate([np.frombuffer(r[name], kind) for r in rows]) for name, kind in (("subs", np.uint32), ("ids", np.int64), ("texts", np.int64), ("starts", np.int32), ("sizes", np.int32), ("body", np.uint8)))
        context, begin, end = bucket_spans(sub, ids, start.astype(np.int64), size.astype(np.int64), body)
        yield pa.RecordBatch.from_arrays([pa.array(texts[context]), pa.array(ids[context]), pa.array(packed(begin, end))], ["text_code", "text_id", "spans"])


def removed(size: int, spans: np.ndarray) -> np.ndarray:
    edge = np.bincount(spans >> 32, minlength=size + 1) - np.bincount(spans & 0xFFFFFFFF, minlength=size + 1)
    return np.cumsum(edge[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, bounds = utf8(batch.column(1))
        kept, gone, runs = [], [], []
        lists = batch.column(2)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for k in range(batch.num_rows):
            text = body[bounds[k] : bounds[k + 1]]
            mask = removed(len(text), flat[at[k] : at[k + 1]])
            kept.append(text[~mask].tobytes())
            gone.append(int(mask.sum()))
            runs.append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(kept, pa.binary()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())], ["text_code", "id", "kept", "n_removed", "n_spans"])


def spans_of(base: DataFrame, first: DataFrame, buckets: int | None = None, hot_texts: int | None = None) -> DataFrame:
    """(code, first_id, spans): what the distinct texts that lose bytes lose, each in its smallest id.

    base: text_code, id, text of all documents; first: text_code, a second hash of the text, and its smallest id. Two texts of one
    code are told apart by their smallest ids."""
    if buckets is None:
        total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(8, -(-total // BUCKET_BYTES))
    if hot_texts is None:
        hot_texts = hot_limit(first.count())
    asked = base.select("text_code", "text").mapInArrow(lean(_asking(buckets)), ASKED)
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_answer), "text_code bigint, codes bigint")
    shared = stored(answers.groupBy("text_code").agg(F.collect_set("codes").alias("codes")))
    keyed = shared.join(first, "text_code").select(F.col("text_code").alias("code"), "first_id", "codes")
    # an id beside the hash spreads the copies of one text
    met = base.join(keyed, (F.col("text_code") == F.col("code")) & (F.col("id") == F.col("first_id"))).select("text_code", "id", "text", "codes")
    sent = met.mapInArrow(lean(_contexts(buckets, hot_codes(shared, hot_texts))), CONTEXTS)
    spans = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_remove), "text_code bigint, text_id bigint, spans bigint")
    return spans.groupBy(F.col("text_code").alias("code"), F.col("text_id").alias("first_id")).agg(F.collect_list("spans").alias("spans"))


def hot_limit(texts: int) -> int:
    """From how many texts on an anchor is hot, of so many texts."""
    return max(HOT_TEXTS, min(texts // HOT_SHARE, BUCKET_BYTES // CONTEXT_BYTES))


def hot_codes(shared: DataFrame, hot_texts: int) -> np.ndarray:
    """The anchors that at least hot_texts texts share, ascending; at most HOT_ANCHORS of them, the most frequent."""
    counts = shared.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_texts)
    rows = counts.orderBy(F.desc("n"), "code").limit(HOT_ANCHORS).select("code").toArrow()
    return np.sort(rows["code"].to_numpy())


def cut_texts(base: DataFrame, first: DataFrame, hot_texts: int | None = None) -> DataFrame:
    """(text_code, id, kept, n_removed, n_spans) of the distinct texts that lose bytes, in their smallest ids.

    In one query with the search, so that the texts, dealt out for that, needn't be dealt out again."""
    keyed = spans_of(base, first, hot_texts=hot_texts)
    met = base.join(keyed, (F.col("text_code") == F.col("code")) & (F.col("id") == F.col("first_id"))).select("text_code", "text", "spans", "id")
    return met.mapInArrow(lean(_cut), "text_code bigint, id bigint, kept binary, n_removed bigint, n_spans bigint")


def second_code(text: Column | str) -> Column:
    return F.xxhash64(F.lit(1), text)


def based(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    body = F.coalesce(F.col(text), F.lit(""))
    base = own(docs, id=F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)), doc_id=F.col(key).cast("long"), text=body)
    # a text is only taken for another's copy if 128 bits agree
    base = base.withColumns({"text_code": F.xxhash64("text"), "second": second_code("text")})
    return base, stored(base.groupBy("text_code", "second").agg(F.min("id").alias("first_id")))


def cut_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_texts: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Equal texts are one: the copies of larger ids lose everything at once if they have LENGTH bytes, and only one of a text's
    rows is searched. Null text: no bytes. A null id counts as larger than any other. Rows that repeat an id take nothing
    from each other. An empty table gives no rows; further columns are ignored."""
    prepared(docs.sparkSession)
    base, first = based(docs, key, text)
    cut = cut_texts(base.select("text_code", "id", "text"), first, hot_texts)
    cut = cut.select("text_code", F.col("id").alias("first_id"), "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256")).dropDuplicates(["text_code", "first_id"])
    known = first.join(cut, ["text_code", "first_id"], "left")
    light = base.select("doc_id", "id", "text_code", "second", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    met = light.join(known, ["text_code", "second"])
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_bytes") >= LENGTH)
    return met.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
    )


def without_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, its text without what documents of smaller ids have. Of a character that is cut in part
    the rest goes too; n_chars, where the table has it, follows the new text. A null text stays null, a null id counts as larger
    than any other, rows that repeat an id take nothing from each other. An empty table gives no rows; columns of any name pass.

    Not texts but their spans meet the documents, and copies of a text come as one span over all of it."""
    prepared(spark)
    base, first = based(docs, "doc_id", "text")
    found = spans_of(base.select("text_code", "id", "text"), first).select("code", F.col("first_id").alias("at"), "spans")
    copies = base.select("text_code", "second", "id", F.octet_length("text").cast("long").alias("n")).where(f"n >= {LENGTH}").join(first, ["text_code", "second"]).where("id > first_id")
    copies = copies.select(F.col("text_code").alias("code"), F.col("id").alias("at"), F.array("n").alias("spans")).dropDuplicates(["code", "at"])
    spans = stored(found.unionAll(copies))
    discard(first)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row_key"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"))
    rows = rows.withColumn("text_code", F.xxhash64(F.coalesce("text", F.lit(""))))
    met = rows.join(spans, (F.col("text_code") == F.col("code")) & (F.col("id") == F.col("at")), "left")
    out = met.select("row_key", "text", "spans").mapInArrow(lean(_rewrite), keyed(rows, "text string, cut boolean"))
    size = F.when(F.col("cut"), F.length("text")).otherwise(F.col("row_key").getField("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in others else None
    return out.select(*[F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col("row_key").getField(c).alias(c) for c in docs.columns])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, cut = batch.column(1).to_pylist(), batch.column(2).is_valid()
        for k in np.flatnonzero(cut.to_numpy(zero_copy_only=False)):
            if texts[k] is not None:
                body = np.frombuffer(texts[k].encode(), np.uint8)
                texts[k] = body[~removed(len(body), np.array(batch.column(2)[int(k)].as_py(), np.int64))].tobytes().decode("utf-8", "ignore")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), cut], ["row_key", "text", "cut"])


def op3_suffix(spark, sf_dir):
    return cut_documents(table(spark, sf_dir, "documents"))


#: Brute force over all windows of 50 bytes, in hexadecimal: t has the windows that go, u their maximal runs.
ORACLE = """
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h, cast(strlen(coalesce(text, '')) as bigint) as n from documents),
w as (select doc_id, unnest(range(0, n - 49)) as s, h from d where n >= 50),
g as (select doc_id, s, hash(substr(h, 2 * s + 1, 100)) as x from w),
f as (select x, min(doc_id) as first_id from g group by x having count(*) > 1),
t as (select g.doc_id, g.s, lag(g.s) over (partition by g.doc_id order by g.s) as before from g join f on g.x = f.x where g.doc_id > f.first_id),
i as (select doc_id, s, sum(case when before is null or s > before + 50 then 1 else 0 end) over (partition by doc_id order by s rows unbounded preceding) as run from t),
u as (select doc_id, min(s) as a, max(s) + 50 as b from i group by doc_id, run),
v as (select *, lag(b, 1, 0) over (partition by doc_id order by a) as upto from u),
k as (select v.doc_id, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans,
    string_agg(substr(h, 2 * upto + 1, 2 * (a - upto)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as h from v join d on v.doc_id = d.doc_id group by 1)
select d.doc_id, d.n as n_bytes, coalesce(k.n_removed, 0) as n_removed, coalesce(k.n_spans, 0) as n_spans, sha256(unhex(coalesce(k.h, d.h))) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""
