"""Operators on documents against brute force, with the odd rows every table may hold."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from bagflow.llm import bpe, decontaminate, dedup, lm, quality, sharding, suffix

SCHEMA = "doc_id bigint, text string, n_words int, row_key string, node int, code int, id string, part int, shard string, size int, bands int"
WORDS = ["the", "of", "Ärger", "été", "sea", "stone", "Ring", "wave", "x", "longerword", "ñandú", "#tag", "and"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", str(rng.randrange(50))]) for _ in range(n))


def rows():
    rng = random.Random(7)
    base = sentence(rng, 120)
    passage = sentence(rng, 14)
    out = [(i, sentence(rng, rng.randrange(5, 200))) for i in range(40)]
    out += [(100, base), (101, base), (102, base + " extra tail words"), (103, base.replace("sea", "lake", 1)), (7, base.upper())]
    out += [(110 + i, sentence(rng, 30) + " " + passage + "\n" + sentence(rng, 20)) for i in range(4)]
    out += [(120, None), (121, ""), (122, " \n\t "), (123, "one two"), (124, "one two"), (125, "ONE two"), (None, base), (None, None), (None, "lonely null words here and there")]
    out += [(5, base), (130, "line a b c\n" * 40), (131, "aaaa" * 3000), (132, sentence(rng, 20000)), (133, "###$$$ %%% " * 60), (100, base)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, "z", 4, "s", 5, 6) for i, t in rows()], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bag(frame, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in frame.collect())


# 2


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_labels(pairs, percent):
    """A number for each text's component, over all pairs of sets."""
    sets = [shingles(t) for _, t in pairs]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return label


def brute_components(pairs, percent):
    label, least = brute_labels(pairs, percent), {}
    for (i, _), x in zip(pairs, label):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return collections.Counter((i, len(shingles(t)), least.get(x), i == least.get(x)) for (i, t), x in zip(pairs, label))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, percent):
    got = dedup.linked(docs, percent=percent)
    assert bag(got, "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows(), percent)


def test_near_duplicates_of_nothing(none):
    assert dedup.linked(none).count() == 0


def test_stars_reach_members_their_first_hub_misses(spark):
    """A chain of texts, each close to the next only: the first is no hub for all."""
    rng = random.Random(3)
    w = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for i in range(14):
        texts.append((i, " ".join(w)))
        for k in range(3):
            w[20 * i + 7 * k] = f"n{i}{k}"
    got = dedup.linked(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert bag(got, "doc_id", "n_shingles", "component_id", "kept") == brute_components(texts, dedup.PERCENT)


def test_pairs_of_a_crowded_template_are_all_compared(spark):
    """Texts of one template just under the threshold, some with one partner just above it that shares two of their changes."""
    rng = random.Random(6)
    template = [f"t{i}" for i in range(1154)]
    slots = range(4, 1149, 5)

    def text(changes):
        w = list(template)
        for at, word in changes:
            w[at] = word
        return " ".join(w)

    texts = []
    for i in range(100):
        own = [(at, f"c{i}at{at}") for at in rng.sample(slots, 11)]
        texts.append((3 * i, text(own)))
        if i < 20:
            taken = {at for at, _ in own}
            texts.append((3 * i + 1, text(own[:2] + [(at, f"p{i}at{at}") for at in rng.sample([x for x in slots if x not in taken], 9)])))
    want = brute_components(texts, 85)
    assert sum(not kept for _, _, _, kept in want) >= 20
    got = dedup.linked(spark.createDataFrame(texts, "doc_id bigint, text string"), percent=85)
    assert bag(got, "doc_id", "n_shingles", "component_id", "kept") == want


def test_large_buckets_close_in_blocks(spark, monkeypatch):
    """The same components when every bucket counts as large and chunks are small."""
    rng = random.Random(16)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for i in range(90):
        w = list(base)
        for at in rng.sample(range(300), rng.randrange(1, 7)):
            w[at] = f"n{i}at{at}"
        texts.append((i, " ".join(w)))
    want = brute_components(texts, 85)
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    for small, rows_ in ((24, 1000), (2, 7)):
        monkeypatch.setattr(dedup, "SMALL", small)
        monkeypatch.setattr(dedup, "CHUNK_ROWS", rows_)
        assert bag(dedup.linked(frame, percent=85), "doc_id", "n_shingles", "component_id", "kept") == want


def test_links_of_a_block():
    """Exact links by matrix products, over more columns than one product takes."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 60, 9000).astype(np.uint64)
    sets = [np.unique(np.concatenate([pool[k * 100 : k * 100 + 3000], rng.integers(0, 1 << 60, 40).astype(np.uint64)])) for k in range(30)]
    label = dedup.links_of_block(sets, np.arange(30), np.arange(30), np.arange(30), 90)
    want = list(range(30))
    for a in range(30):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                want = [min(want[a], want[b]) if x in (want[a], want[b]) else x for x in want]
    assert label.tolist() == want


def test_components_at_sf01(spark):
    """All links of the table, found by a join of all shingles, against the components of the operator: none may be missing."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    import duckdb

    want = duckdb.connect().execute(dedup.ORACLE.replace("from documents", "from '/root/testdata/sf0.1/documents.parquet'")).fetchall()
    got = dedup.linked(docs, percent=85)
    assert bag(got, "doc_id", "n_shingles", "component_id", "kept") == collections.Counter(want)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(bytes([0, i + 1]), bytes([0, i])) for i in range(60)] + [(b"\x09\x09", b"\x09\x08")], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["comp"]) for r in dedup.components(edges).collect()}
    assert len(got) == 63 and {got[bytes([0, i])] for i in range(61)} == {b"\0\0"} and got[b"\x09\x09"] == b"\x09\x08"


# 3


def brute_marks(pairs, length=50):
    """Of each text its bytes and which of them go."""
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, t in pairs:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            if x not in first or order(i) < order(first[x]):
                first[x] = i
    for i, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if order(first[b[s : s + length]]) < order(i):
                gone[s : s + length] = b"\1" * length
        yield i, b, bytes(gone)


def brute_kept(pairs):
    return [(i, bytes(x for x, g in zip(b, gone) if not g)) for i, b, gone in brute_marks(pairs)]


def brute_removals(pairs, length=50):
    out = collections.Counter()
    for (i, b, gone), (_, kept) in zip(brute_marks(pairs, length), brute_kept(pairs)):
        out[i, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_previous_factors():
    """Against all pairs of places."""
    rng = random.Random(1)
    for n in range(30):
        body = bytes(rng.choice(b"ab" if n % 2 else b"abc\xff\0") for _ in range(400))
        if n % 3 == 0:
            body = body[:150] + body[20:120] + body[:150] + body[:130]
        places, ids = sorted(rng.sample(range(len(body) - 50), 120)), [rng.randrange(8) for _ in range(120)]

        def common(p, q):
            k = 0
            while k < 50 and body[p + k] == body[q + k]:
                k += 1
            return k

        want = [max((common(p, q) for q, j in zip(places, ids) if j < i), default=0) for p, i in zip(places, ids)]
        assert suffix.previous_factors(np.frombuffer(body, np.uint8), np.array(places), np.array(ids)).tolist() == want


def test_hot_anchors_are_dealt_by_window(docs, spark, monkeypatch):
    """The same removals when every shared anchor counts as hot, and when a bucket is sorted in small slices."""
    want = brute_removals(rows())
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert bag(suffix.cut_documents(docs, hot_texts=1), *columns) == want
    assert bag(suffix.cut_documents(docs, hot_texts=3), *columns) == want
    body = np.frombuffer((rows()[40][1] * 3).encode(), np.uint8)
    size = np.full(3, len(body) // 3)
    parts = (np.zeros(3, np.uint32), np.array([5, 2, 9]), np.zeros(3, np.int64), size, body)
    whole = [x.tolist() for x in suffix.bucket_spans(*parts)]
    monkeypatch.setattr(suffix, "SLICE", 40)
    assert [x.tolist() for x in suffix.bucket_spans(*parts)] == whole


def test_suffix_removals(docs):
    got = suffix.cut_documents(docs)
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removals(rows())


def test_suffix_removals_of_random_bytes(spark):
    """Few letters, so that matches of all lengths about the limit, overlapping and within documents, are common."""
    rng = random.Random(11)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.randrange(20, 120))) for _ in range(12)]
    pairs = [(rng.randrange(60), "".join(rng.choice(pool)[rng.randrange(10) :] for _ in range(rng.randrange(1, 8)))) for _ in range(80)]
    frame = spark.createDataFrame(pairs, "doc_id bigint, text string").repartition(6)
    got = suffix.cut_documents(frame)
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removals(pairs)


def test_what_recurs_by_chance_is_not_searched():
    import pyarrow as pa

    rng = random.Random(4)
    few = ["".join(rng.choices("abdeinorst", k=rng.randrange(4, 8))) for _ in range(30)]
    texts = [" ".join(rng.choices(few, k=300)).encode() for _ in range(400)]
    windows = collections.Counter(w for t in texts for w in {t[k : k + suffix.LENGTH] for k in range(len(t) - suffix.LENGTH + 1)})
    assert max(windows.values()) == 1
    body, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    all_ = len(set(zip(*(x.tolist() for x in (suffix.anchors(body, bounds)[k] for k in (0, 3))), strict=True)))
    got = suffix._asking(8)(iter([pa.record_batch({"text_code": pa.array(range(400)), "text": pa.array(texts)})]))
    shared = sum(len(codes) // 8 for batch in got for codes in batch["codes"].to_pylist() if codes)
    # with substrings of 16 bytes it was seven in ten
    assert shared < 0.1 * all_


def test_hot_anchors_follow_the_corpus(spark, monkeypatch):
    limits = []
    monkeypatch.setattr(suffix, "hot_codes", lambda _, hot_texts, of=suffix.hot_codes: limits.append(hot_texts) or of(_, hot_texts))
    monkeypatch.setattr(suffix, "HOT_TEXTS", 3)
    twice = "a passage of more than fifty bytes that stands in four texts of two thousand "
    docs = spark.createDataFrame([(i, f"{i} {twice * (i % 500 == 0)}{i * i} words of text {i}, number {i + 7}, and so on") for i in range(2000)], "doc_id bigint, text string")
    suffix.cut_documents(docs).collect()
    assert limits == [2000 // suffix.HOT_SHARE]
    assert suffix.hot_limit(1 << 40) * suffix.CONTEXT_BYTES == suffix.BUCKET_BYTES


def test_suffix_removals_of_nothing(none):
    assert suffix.cut_documents(none).count() == 0


# 5


def test_shards(docs):
    got = sorted(sharding.shards_by_bytes(docs, 8, parts=3).collect(), key=lambda r: (r["shard"], r["slot"]))
    want = sorted((((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows()))
    assert [((r["doc_id"] is not None, r["doc_id"] or 0), r["text_crc32"], r["size"]) for r in got] == want
    total, upto, slots = sum(w[2] for w in want), 0, collections.Counter()
    for r, (_, _, size) in zip(got, want):
        shard = (2 * upto + size) * 8 // (2 * total)
        assert (r["shard"], r["slot"], r["law"], r["grown_shard"]) == (shard, slots[shard], "bytes", None)
        slots[shard] += 1
        upto += size


def test_shards_of_nothing(none):
    assert sharding.shards_by_bytes(none).count() == 0


# 6


def test_contamination(spark, docs, none):
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.randrange(12, 90)) + rng.choice(["\n", ". "]) + sentence(rng, rng.randrange(1, 12))) for i in range(30)] + [(90, None), (91, ""), (92, " \n")]
    leaks = [(500, rows()[3][1] + " " + items[4][1] + " " + rows()[9][1]), (501, re.sub("[a-z]", lambda m: m[0].upper(), items[7][1]).replace(" ", "  ")), (502, items[9][1].split(" ", 8)[8]), (500, items[4][1])]
    leaks.append((503, sentence(rng, 3000) + " " + items[11][1] + " " + sentence(rng, 2000)))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    frame = docs.select("doc_id", "text").unionAll(spark.createDataFrame(leaks, "doc_id bigint, text string"))
    found = decontaminate.contaminated(frame, benchmark)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}

    def held(text, item):
        a = [x.lower() for x in words_of(item)]
        b = [x.lower() for x in words_of(text)]
        n = min(5, len(a))
        want = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}
        return want and len(want & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}) / len(want) >= 0.8

    assert got == {(d, i) for d, t in rows() + leaks for i, x in items if x and x.strip() and held(t, x)}
    assert {(500, 4), (501, 7), (503, 11)} <= got
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    # many small indexes have the statistics of all items: the same matches with the same scores
    small = decontaminate.indexes(benchmark, index_bytes=500)
    assert len(small) > 3 and sum(len(s.value.ids) for s in small) == 30
    scores = {(r["doc_id"], r["item_id"]): r["score"] for r in found.collect()}
    for shared in small:
        for d, t in leaks:
            body = np.frombuffer(t.encode(), np.uint8)
            for (_, i), (score, _, _) in decontaminate.matches(body, np.array([0, len(body)]), shared.value).items():
                assert abs(scores[d, shared.value.ids[i]] - score) < 1e-9 or scores[d, shared.value.ids[i]] > score


def test_short_and_long_items(spark):
    """A word or two are held by a text that is nothing else; one very long item doesn't make the passages of others long."""
    rng = random.Random(9)
    items = [(1, "yes"), (2, "the sea"), (3, sentence(rng, 3000)), (4, sentence(rng, 30))]
    texts = [(10, "yes"), (11, "yes the sea"), (12, " The\n sea "), (13, sentence(rng, 500) + " " + items[2][1] + " x"), (14, items[3][1]), (15, sentence(rng, 200))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id bigint, text string"), benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(10, 1), (12, 2), (13, 3), (14, 4)}
    assert sorted(s.value.step for s in decontaminate.indexes(benchmark)) == [64, 3000]


def test_walk_finds_what_full_scoring_finds():
    """Block-max WAND against scores of all items, for passages of random items' words."""
    rng = random.Random(12)
    items = [(i, sentence(rng, rng.randrange(5, 60))) for i in range(120)]
    index = decontaminate.Index(items)
    for _ in range(80):
        text = " ".join(x for i in rng.sample(range(120), 2) for x in items[i][1].split() if rng.random() < rng.choice([0.5, 0.8, 1.0]))
        hashes = np.intersect1d(decontaminate.word_hashes(text), index.terms)
        terms = np.searchsorted(index.terms, hashes).tolist()
        score = np.zeros(120)
        for t in terms:
            np.add.at(score, index.item[index.first[t] : index.first[t + 1]], index.impact[index.first[t] : index.first[t + 1]])
        got = decontaminate.walked(terms, index, 0.4)
        assert set(got) == {int(i) for i in np.flatnonzero(score >= 0.4)} and all(abs(score[i] - x) < 1e-9 for i, x in got.items())


def test_bound_loses_nothing():
    """All scores at the threshold are found, against scores computed without blocks or bounds."""
    rng = random.Random(2)
    items = [(i, sentence(rng, rng.randrange(8, 40))) for i in range(40)]
    index = decontaminate.Index(items)
    for _ in range(60):
        at = rng.randrange(40)
        w = items[at][1].split()
        rng.shuffle(w)
        text = " ".join(w[: rng.randrange(len(w) // 2, len(w) + 1)] + sentence(rng, rng.randrange(0, 50)).split())
        hashes = set(decontaminate.word_hashes(text).tolist())
        score = np.zeros(40)
        for t, term in enumerate(index.terms.tolist()):
            if term in hashes:
                s = slice(index.first[t], index.first[t + 1])
                score[index.item[s]] += index.impact[s]
        body = np.frombuffer(text.encode(), np.uint8)
        got = decontaminate.matches(body, np.array([0, len(body)]), index)
        for (_, i), (value, _, _) in got.items():
            assert abs(value - score[i]) < 1e-9 and value >= decontaminate.THRESHOLD - 1e-9
        whole = {i for i in range(40) if score[i] >= decontaminate.THRESHOLD and decontaminate.overlap(index.parts[i][0], index.n[i], decontaminate.word_hashes(text)) >= 0.8}
        assert whole <= {i for _, i in got}


# 7


def test_bpe(docs, none):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for i, t in rows():
        ids = plain.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert bag(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.round_trip(none).count() == 0
    two = bpe.decoded(bpe.encoded(docs.select("doc_id", "text")))
    assert collections.Counter((r["row_key"]["doc_id"], bytes(r["decoded"])) for r in two.collect()) == collections.Counter((i, (t or "").encode()) for i, t in rows())


def test_replay_is_the_plain_rule():
    vocab = bpe.vocabulary(bpe.VOCABULARY)
    rng = random.Random(1)
    pieces = list({bytes(rng.choice(b"abcdeinrst \xc3\xa9") for _ in range(rng.randrange(1, 14))) for _ in range(3000)}) + [b"a" * n for n in range(20, 60)]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.replay(pieces, vocab)]
    assert got == [[vocab.ranks[p]] if p in vocab.ranks else bpe.one_by_one(p, vocab.ranks) for p in pieces]


def test_pieces_are_the_patterns_and_the_slow_matcher_is_seldom_asked(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    import regex

    rng, slow, asked = random.Random(2), regex.compile(public_tokenizers.PATTERN).findall, []
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    odd = [chr(c) for c in range(0x3000)] + list(" \n\t'\x1c\x85²½Ⅷ٣ª") * 200 + list("'s't're've'm'll'd'S ") * 60
    plain = [every, *(a + c + c + "b" for c in every for a in ("x", " ")), *("".join(rng.choices(odd, k=rng.randrange(1, 40))) for _ in range(2000))]
    beyond = ["😀 a", "𝐀𝟙 \U000e0020b", "a  𝐀"]
    want = collections.Counter(piece for text in [*plain, *beyond] for piece in slow(text))
    monkeypatch.setattr(bpe.regex, "compile", lambda _: type("Asked", (), {"findall": staticmethod(lambda text: asked.append(text) or slow(text))}))
    got = collections.Counter()
    for batch in bpe._pieces(public_tokenizers.PATTERN)(iter([pa.record_batch({"text": pa.array([*plain, None, "", *beyond])})])):
        got.update(dict(zip(batch["piece"].to_pylist(), batch["n"].to_pylist(), strict=True)))
    assert got == want
    assert asked == beyond


# 8


def lm_counts(pairs):
    tokens = lambda t: [*(x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(t)), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(x for i, t in pairs if not held(i) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in pairs]


def lm_columns(frame):
    return collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in frame)


def test_lm_counts_and_base(docs, none):
    for block_bytes, bucket_bytes in ((1 << 24, 1 << 23), (20_000, 5_000)):
        found = lm.scored(docs, block_bytes=block_bytes, bucket_bytes=bucket_bytes).collect()
        assert lm_columns(found) == collections.Counter(lm_counts(rows()))
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert lm.scored(none).count() == 0
    from pyspark.sql import functions as F

    untaught = lm.scored(docs, F.lit(False)).collect()
    assert len(untaught) == len(rows()) and all(math.isfinite(r["score"]) and r["n_known"] == 0 and r["held_out"] for r in untaught)


def brute_tree(training, depth):
    """log10 probability of a text by the recursion over dictionaries: weighted probabilities from the deepest contexts up, and a
    prediction from the deepest seen context down to the root."""
    counts = collections.defaultdict(lambda: [0, 0])
    children = collections.defaultdict(set)

    def decisions(text):
        symbols = [255] * depth + [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()] + [255]
        for i in range(depth, len(symbols)):
            for level in range(8):
                yield tuple(symbols[i - 1 - k] for k in range(depth)), (1 << level) | symbols[i] >> (8 - level), symbols[i] >> (7 - level) & 1

    for text in training:
        for context, node, bit in decisions(text):
            for d in range(depth + 1):
                counts[context[:d], node][bit] += 1
                if d:
                    children[context[: d - 1], node].add(context[:d])

    def kt(key):
        zero, one = counts[key]
        return math.lgamma(zero + 0.5) + math.lgamma(one + 0.5) - math.lgamma(zero + one + 1) - math.log(math.pi)

    known = {}

    def weighted(context, node):
        if (context, node) not in known:
            own = kt((context, node))
            known[context, node] = own if len(context) == depth else np.logaddexp(own, sum(weighted(c, node) for c in children[context, node])) - math.log(2)
        return known[context, node]

    def predicted(context, node, bit, d=0):
        zero, one = counts.get((context[:d], node), (0, 0))
        own = ((one if bit else zero) + 0.5) / (zero + one + 1)
        if d == depth or (context[: d + 1], node) not in counts:
            return own
        weight = math.exp(kt((context[:d], node)) - math.log(2) - weighted(context[:d], node))
        return weight * own + (1 - weight) * predicted(context, node, bit, d + 1)

    return lambda text: sum(math.log10(predicted(*x)) for x in decisions(text))


def test_context_tree_weighting(spark):
    """Scores of documents against the recursion; with small blocks and buckets they come from many tasks."""
    rng = random.Random(4)
    pairs = [(i, " ".join(rng.choice(["ab", "Abba", "b\u00e9a", "cab", "x"]) for _ in range(rng.randrange(1, 12)))) for i in range(60)] + [(60, None), (61, "unlike ALL"), (None, "ab ab"), (3, "ab")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    frame = spark.createDataFrame(pairs, "doc_id bigint, text string").repartition(3)
    for depth in (3, 6):
        score = brute_tree([t for i, t in pairs if not held(i)], depth)
        want = collections.Counter((i, round(score(t), 3)) for i, t in pairs)
        got = lm.scored(frame, depth=depth, block_bytes=200, bucket_bytes=100)
        assert collections.Counter((r["doc_id"], round(r["score"], 3)) for r in got.collect()) == want


def test_trees_in_parts(monkeypatch):
    """A bucket that is weighed in many parts gives what it gives as one tree."""
    rng = np.random.default_rng(8)
    body = rng.choice(np.frombuffer(b"abcd ", np.uint8), 4000)
    keys, counts = np.unique(lm.grams(body, np.array([0, 1500, 4000]), 4)[0], return_counts=True)
    upper = lm.Upper(*(rng.integers(0, 9, (256, 256)).astype(float) for _ in range(2)), rng.random((256, 256)), rng.random(256))
    upper.total += upper.one
    whole = lm.log_scores(keys, counts, upper, 4)
    monkeypatch.setattr(lm, "TREE_KEYS", 20)
    assert len(list(lm.subtrees(keys, 4))) > 10 and np.allclose(lm.log_scores(keys, counts, upper, 4), whole)


def test_lm_on_held_out_texts(spark):
    """Six bytes of context need far fewer bits than the 2.7 of two, and a text seen in training scores better than it would unseen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = lm.scored(docs).join(docs.select("doc_id", "text"), "doc_id").groupBy("held_out").agg({"score": "sum", "base_score": "sum"})
    sizes = docs.select("doc_id", "text").withColumn("held_out", lm.held_out("doc_id")).selectExpr("held_out", "octet_length(text) + 1 as n").groupBy("held_out").agg({"n": "sum"})
    bits = {r["held_out"]: -r["sum(score)"] / r["sum(n)"] * math.log2(10) for r in sums.join(sizes, "held_out").collect()}
    assert bits[True] < 2.3 and bits[False] < bits[True]


# 10


def brute_quality(text):
    w = words_of(text)
    n = len(w)
    triples = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    hit = {k for i in range(n - 2) if triples[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            again += line in seen
            seen.add(line)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(hit), n < 50 or 100 * len(hit) > 50 * n


def brute_share(text, n):
    w = words_of(text)
    times = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    hit = {k for i in range(len(w) - n + 1) if times[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
    return sum(len(w[k]) for k in hit) / max(1, sum(map(len, w)))


def brute_verdict(text):
    """kept by the base and all limits, on their own for short texts with few repeated lines."""
    n, _, symbols, again, _, failed = brute_quality(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    repeated = sum(len(x) for k, x in enumerate(lines) if x in lines[:k])
    few = n < quality.SHORT and 1 <= again <= quality.FEW
    limits, of_lines = (quality.ONCE_SHARE, quality.ONCE_LINE_SHARE) if few else (quality.DUPLICATE_SHARE, quality.LINE_SHARE)
    return not failed and symbols <= quality.SYMBOL_SHARE * n and again <= of_lines * len(lines) and repeated <= quality.LINE_CHAR_SHARE * sum(map(len, lines)) and all(brute_share(text, k) <= v for k, v in limits.items())


def test_quality(docs, none):
    got = quality.quality_measures(docs).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter(tuple(r[c] for c in columns) for r in got) == collections.Counter((i, *brute_quality(t)) for i, t in rows())
    shares = collections.Counter((i, *(round(brute_share(t, n), 9) for n in quality.DUPLICATE_SHARE)) for i, t in rows())
    assert collections.Counter((r["doc_id"], *(round(x, 9) for x in r["dup_char_shares"])) for r in got) == shares
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not kept[130] and not kept[133] and not kept[121] and kept[132]
    assert collections.Counter((r["doc_id"], r["kept"]) for r in got) == collections.Counter((i, brute_verdict(t)) for i, t in rows())
    assert quality.quality_measures(none).count() == 0


def test_repetition_decides_beyond_the_base(spark):
    """Texts that pass the base: by n-grams, by lines, and a short one with one line found twice, which stays."""
    w = [f"w{i}" for i in range(300)]
    passage = " ".join(w[:12])
    prose = [" ".join(w[6 * i : 6 * i + 6]) for i in range(20)]
    texts = {
        "ngrams": f"{passage} {' '.join(w[20:60])} {passage} {' '.join(w[60:100])}",
        "lines": "\n".join(x for k in range(14) for x in ([prose[k], "see more"] if k < 8 else [prose[k]])),
        "once": "\n".join([*prose[:9], prose[0]]),
        "plain": " ".join(w),
    }
    frame = spark.createDataFrame(list(enumerate(texts.values())), "doc_id bigint, text string")
    got = {list(texts)[r["doc_id"]]: (r["base_failed"], r["kept"]) for r in quality.quality_measures(frame).collect()}
    assert got == {"ngrams": (False, False), "lines": (False, False), "once": (False, True), "plain": (False, True)}
