"""Operator 2: near-duplicates by one-permutation MinHash, banded buckets and stars.

Equal shingle sets are one class. Classes that share a bucket are candidates, but only as stars: all against two hubs of the bucket,
its least id (among copies most often the original) and one that differs from band to band. Links are confirmed on whole sets.
What a star can miss is a link between two members that neither hub is linked with, so buckets that then still hold more than one
component are closed, once: all pairs of a small bucket, which are few for each member; of a larger one, blocks of members by
matrix products over the shingles they share, which give exact intersections and leave a spanning forest of links, never a pair for
each comparison. So every pair of every bucket is compared or in one component, in a number of steps that doesn't grow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagflow.llm.common import chunked, discard, lean, own, prepared, stored, table, utf8
from bagflow.llm.minhash import BANDS, BINS, bands, set_key, shingle_sets, short, signatures

#: Linked if 100 * intersection >= PERCENT * union; the query of operator 2 asks for 85.
PERCENT = 80
#: Leaves that are compared with one copy of their hub's text; a hub with more has more copies.
LEAVES = 256
#: Members of a bucket whose pairs are compared one by one; larger buckets are closed in blocks.
SMALL = 24
#: Members and shingles of a chunk; a block is two chunks of a bucket.
CHUNK_ROWS, CHUNK_SHINGLES = 500, 500_000
#: Columns of a matrix product.
COLUMNS = 4096
#: Rows of ids (16 bytes each) that may be sent to every task to pick texts where they are read; more are joined.
SENT = 200_000

#: Pairs whose signatures agree in a share of bins that is under the threshold by so many standard errors aren't compared further.
ERRORS = 4.5

SKETCH = "doc_id bigint, text_code bigint, n_shingles bigint, class binary, sig binary"
_FLIP = -(1 << 63)


def _sketch(percent: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, bounds = utf8(batch.column(2))
            for first, last, part, cuts in chunked(body, bounds):
                hashes, ends = shingle_sets(part, cuts)
                sizes = np.diff(ends)
                coded = short(signatures(hashes, ends))
                # a set that can be linked with an equal one only needs no bands
                banded = 100 * sizes >= percent * (sizes + 1)
                classes = [set_key(hashes[ends[k] : ends[k + 1]]) if sizes[k] else None for k in range(last - first)]
                sigs = [coded[k].tobytes() if banded[k] else None for k in range(last - first)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(sizes), pa.array(classes, pa.binary()), pa.array(sigs, pa.binary())],
                    ["doc_id", "text_code", "n_shingles", "class", "sig"],
                )

    return sketch


def rows_of(column: pa.Array) -> np.ndarray:
    return utf8(column)[0].view(np.uint16).reshape(-1, BINS)


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = bands(rows_of(batch.column(2))).view(np.int64).reshape(-1)
        take = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(codes)], ["node", "n", "band"])


def node_of(doc_id: Column, text_code: Column) -> Column:
    """17 bytes that name a class by its first row and sort as its id does, a null id last."""
    digits = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(_FLIP))), 16, "0")
    return F.unhex(F.concat(F.coalesce(F.concat(F.lit("00"), digits), F.lit("01" + "0" * 16)), F.lpad(F.hex(text_code), 16, "0")))


def id_of(node: Column) -> Column:
    value = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_FLIP))
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", value)


def starred(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Rows (hub, leaf, n, value) for a stream: each hub's own row, leaf being null, then its leaves'.

    A hub's value is copied for each LEAVES leaves, so a hub that many leaves share is many tasks' work and no key is hot."""
    copies = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / LEAVES).cast("int").alias("copies"))
    leaves = pairs.join(copies, "hub").select("hub", F.pmod(F.xxhash64("leaf"), F.col("copies")).cast("int").alias("copy"), "leaf")
    leaves = leaves.join(values.withColumnRenamed("node", "leaf"), "leaf").select("hub", "copy", "leaf", "n", "value")
    hubs = copies.join(values.withColumnRenamed("node", "hub"), "hub")
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("binary").alias("leaf"), "n", "value")
    rows = hubs.unionByName(leaves).repartition("hub", "copy").sortWithinPartitions("hub", "copy", F.col("leaf").asc_nulls_first())
    return rows.select("hub", "leaf", "n", "value")


def _agree(least: float) -> Callable:
    """Pairs whose signatures agree well enough for a link; of small sets the bins repeat few hashes, so more leeway is given."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_sig, hub_n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs, n, leaf = rows_of(batch.column(3)), batch.column(2).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            # the hub's row of each row; -1 is the hub of the batch before
            at = np.maximum.accumulate(np.where(leaf, -1, np.arange(len(n))))
            sides = np.concatenate([sigs, hub_sig if hub_sig is not None else sigs[:1]])
            sizes = np.append(n, hub_n)
            share = (sigs == sides[at]).mean(1)
            bins = np.minimum(BINS, np.minimum(n, sizes[at]))
            keep = pa.array(leaf & (share >= least - ERRORS * np.sqrt(least * (1 - least) / np.maximum(bins, 1))))
            hub_sig, hub_n = sides[at[-1:]], sizes[at[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(keep), batch.column(0).filter(keep)], ["leaf", "hub"])

    return agree


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: a hub's text, then its leaves. Only the hub's set is held."""
    hub_set = np.zeros(0, np.uint64)
    for batch in batches:
        body, bounds = utf8(batch.column(3))
        hubs, leaves = batch.column(0), batch.column(1).is_valid().to_pylist()
        rows, inter, union = [], [], []
        for first, _, part, cuts in chunked(body, bounds):
            hashes, ends = shingle_sets(part, cuts)
            for k in range(len(cuts) - 1):
                mine = hashes[ends[k] : ends[k + 1]]
                if not leaves[first + k]:
                    hub_set = mine
                elif len(mine) and len(hub_set):
                    at = np.minimum(np.searchsorted(hub_set, mine), len(hub_set) - 1)
                    both = int((hub_set[at] == mine).sum())
                    rows.append(first + k)
                    inter.append(both)
                    union.append(len(mine) + len(hub_set) - both)
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(1).take(take), hubs.take(take), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "inter", "union"])


def links_of_block(sets: list[np.ndarray], comps: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """For each set the least set it reaches by links between sets of different components; pairs are (left, right) rows.

    Intersections are exact: products of 0/1 matrices over the shingles that more than one of the sets has."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    common = times[at] > 1
    owner, column = owner[common], number[at[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + COLUMNS])
        matrix = np.zeros((len(sets), COLUMNS), np.float32)
        matrix[owner[a:b], column[a:b] - begin] = 1
        inter += matrix[left] @ matrix[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    linked = (100 * inter.astype(np.float64) >= percent * union) & (comps[left][:, None] != comps[right][None, :])
    label = np.arange(len(sets))
    while linked.any():
        new = label.copy()
        far = len(sets)
        np.minimum.at(new, left, np.where(linked, label[right][None, :], far).min(1))
        np.minimum.at(new, right, np.where(linked, label[left][:, None], far).min(0))
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def _blocks(percent: int) -> Callable:
    """Rows (block, chunk, node, comp, text) sorted by block, a block being one or two chunks of a bucket; out come links (a, b)."""

    def block_links(held: list) -> Iterator[pa.RecordBatch]:
        chunks = np.array([h[0] for h in held])
        comps = np.unique([h[2] for h in held], return_inverse=True)[1]
        if len(held) > 1 and comps.max() > 0:
            left, right = np.flatnonzero(chunks == chunks.min()), np.flatnonzero(chunks == chunks.max())
            label = links_of_block([h[3] for h in held], comps, left, right, percent)
            found = np.flatnonzero(label != np.arange(len(held)))
            nodes = [h[1] for h in held]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in found], pa.binary()), pa.array([nodes[label[k]] for k in found], pa.binary())], ["a", "b"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            block, chunk, node, comp = (batch.column(i).to_pylist() for i in range(4))
            body, bounds = utf8(batch.column(4))
            for first, _, part, cuts in chunked(body, bounds):
                hashes, ends = shingle_sets(part, cuts)
                for k in range(len(cuts) - 1):
                    if block[first + k] != now:
                        yield from block_links(held)
                        now, held = block[first + k], []
                    held.append((chunk[first + k], node[first + k], comp[first + k], hashes[ends[k] : ends[k + 1]].copy()))
        yield from block_links(held)

    return close


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes on edges (a, b), stored; comp is the least node reachable. Labels go to neighbours and then to
    the label's own label, so long chains shorten fast; each step is two grouped minima, written to the shared folder."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = stored(both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    label = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("u").alias("old"), F.least("u", "m").alias("comp")))
    while True:
        now = label.select("node", "comp")
        heard = both.join(now.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        new = now.join(heard, now["node"] == heard["u"]).select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = now.select(F.col("node").alias("j"), F.col("comp").alias("further"))
        new = stored(new.join(jump, F.col("comp") == F.col("j"), "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        discard(label)
        label = new
        if new.where("old <> comp").isEmpty():
            discard(both)
            out = label.select("node", "comp")
            out.stored_at = label.stored_at
            return out


def _like(n: str, m: str, percent: int) -> Column:
    """Whether sets of such sizes can be linked."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _confirmed(pairs: DataFrame, signed: DataFrame, texts: Callable, percent: int) -> DataFrame:
    """The pairs (leaf, hub) that are linked, as stored edges (a, b): signatures first, then whole sets."""
    sigs = signed.select("node", "n", F.col("sig").alias("value"))
    close = stored(starred(pairs, sigs).mapInArrow(lean(_agree(percent / 100)), "leaf binary, hub binary"))
    bodies = texts(close.select(F.col("leaf").alias("node")).unionAll(close.select(F.col("hub").alias("node"))))
    met = starred(close, bodies.withColumn("n", F.lit(0))).mapInArrow(lean(_compare), "a binary, b binary, inter bigint, union bigint")
    found = stored(met.where(100 * F.col("inter") >= percent * F.col("union")).select("a", "b"))
    discard(close, bodies)
    return found


def _labels(classes: DataFrame, coded: DataFrame, percent: int) -> DataFrame | None:
    """(node, comp) of all classes that are linked with another, stored; None if there are none."""
    signed = classes.where("sig is not null").select("node", F.col("n_shingles").cast("int").alias("n"), "sig")

    def texts(nodes: DataFrame) -> DataFrame:
        """(node, value), the texts of some classes, picked where they are read if the classes are few."""
        wanted = stored(classes.select("node", F.col("doc_id").alias("id"), F.col("text_code").alias("code")).join(nodes.distinct(), "node"))
        keys = F.broadcast(wanted) if wanted.count() <= SENT else wanted
        met = coded.join(keys, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("code") == F.col("text_code")))
        out = stored(met.select("node", F.col("text").alias("value")).dropDuplicates(["node"]))
        discard(wanted)
        return out

    members = signed.mapInArrow(lean(_band), "node binary, n int, band bigint")
    hubs = members.groupBy("band").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("one"), F.min(F.struct(F.xxhash64("node", "band").alias("x"), "node", "n")).alias("two")
    ).where("size > 1")
    hubs = hubs.select("band", "size", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("one", "two") for c in ("node", "n")])
    live = stored(members.join(hubs, "band"))

    star = F.explode(F.array(*[F.struct(F.col(f"{x}_node").alias("hub"), F.col(f"{x}_n").alias("m")) for x in ("one", "two")])).alias("x")
    pairs = live.select("node", "n", star).where((F.col("node") != F.col("x.hub")) & _like("n", "x.m", percent))
    # a pair that two bands order differently is one pair
    pairs = pairs.groupBy(F.least("node", "x.hub").alias("a"), F.greatest("node", "x.hub").alias("b")).agg(F.min("x.hub").alias("hub"))
    pairs = stored(pairs.select("a", "b", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("leaf"), "hub"))
    edges = _confirmed(pairs, signed, texts, percent)
    label = components(edges)
    discard(edges)

    # closing: buckets of more than two that still are more than one component
    comp = live.where("size > 2").select("band", "node", "n", "size").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sums = comp.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("n").alias("shingles")).where("low <> high").select("band", "shingles")
    mixed = stored(comp.join(sums, "band"))
    small, large = mixed.where(f"size <= {SMALL}"), mixed.where(f"size > {SMALL}")
    other = small.select("band", F.col("node").alias("leaf"), F.col("n").alias("m"), F.col("comp").alias("leaf_comp"))
    rest = small.join(other, "band").where((F.col("node") < F.col("leaf")) & (F.col("comp") != F.col("leaf_comp")) & _like("n", "m", percent))
    rest = rest.select(F.col("node").alias("a"), F.col("leaf").alias("b")).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    rest = stored(rest.select(F.col("b").alias("leaf"), F.col("a").alias("hub")))
    more = [] if rest.isEmpty() else [_confirmed(rest, signed, texts, percent)]
    if not large.isEmpty():
        more.append(_closed(large, texts, percent))
    discard(live, pairs, mixed, rest)
    if any(not m.isEmpty() for m in more):
        first = label
        edges = first.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        for m in more:
            edges = edges.unionAll(m)
        label = components(edges)
        discard(first)
    discard(*more)
    return label


def _closed(large: DataFrame, texts: Callable, percent: int) -> DataFrame:
    """Links (a, b), stored, between members of different components of large buckets: chunks of a bucket in pairs."""
    chunks = F.greatest(F.ceil(F.col("size") / CHUNK_ROWS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    dealt = large.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    block = F.struct("band", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"))
    bodies = texts(large.select("node"))
    rows = dealt.select(block.alias("block"), "chunk", "node", "comp").join(bodies, "node").select(F.to_json("block").alias("block"), "chunk", "node", "comp", "value")
    out = stored(rows.repartition("block").sortWithinPartitions("block").mapInArrow(lean(_blocks(percent)), "a binary, b binary"))
    discard(bodies)
    return out


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_code (xxhash64 of the text) and component, which names the
    component also where it has no ids (null without words).

    Null or empty text and text without words: no shingles, linked with nothing, kept. A null doc_id is linked by its text
    like any other but is never the smallest id, and is kept only in a component without ids. Rows that repeat an id with
    other text are linked by their texts; all rows that carry the component's id are kept. An empty table gives no rows.
    Further columns are ignored. The result is a small stored table; what was stored on the way is deleted."""
    prepared(docs.sparkSession)
    base = own(docs, doc_id=F.col(key).cast("long"), text=text)
    coded = base.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_code"), "text")
    sketch = stored(coded.mapInArrow(lean(_sketch(percent)), SKETCH))
    # the class's row of the least id, null being the last
    ordered = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_code", "n_shingles", "sig")
    classes = sketch.where("n_shingles > 0").groupBy("class").agg(F.min(ordered).alias("x")).select("class", *[f"x.{c}" for c in ("doc_id", "text_code", "n_shingles", "sig")])
    classes = stored(classes.withColumn("node", node_of(F.col("doc_id"), F.col("text_code"))))
    label = _labels(classes, coded, percent)
    of_class = classes.select("class", "node").join(label, "node", "left").select("class", F.coalesce("comp", "node").alias("component"))
    got = sketch.select("doc_id", "text_code", "n_shingles", "class").join(of_class, "class", "left")
    own_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(id_of(F.col("component")))
    out = stored(got.select("doc_id", "n_shingles", own_id.alias("component_id"), F.col("doc_id").eqNullSafe(own_id).alias("kept"), "text_code", "component"))
    discard(sketch, classes, label)
    return out


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, whole and with its columns; texts without words (null, empty, blank)
    all stay, one row for each id and text. Of a component whose least id came with several texts one stays; a component
    without ids keeps one row too. An empty table gives no rows; columns of any name are kept as they are.

    The decision is made on ids and hashes; the texts meet it once, spread by (id, text_code)."""
    got = linked(docs).where("kept")
    # an id that came with several linked texts: the least hash stays
    stay = got.where("component is not null").groupBy("component").agg(F.min(F.struct("text_code", "doc_id")).alias("x")).select("x.doc_id", "x.text_code")
    bare = got.where("component is null").select("doc_id", "text_code").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    code = F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), code.alias("code"))
    met = rows.join(stay.unionAll(bare), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("code") == F.col("text_code")))
    return met.dropDuplicates(["id", "code"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_minhash(spark, sf_dir):
    return linked(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


#: Brute force over all pairs with a common shingle.
ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, sh from (
  select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) end) as sh from w)),
n as (select w.doc_id, cast(count(s.sh) as bigint) as n_shingles from w left join s on w.doc_id = s.doc_id group by 1),
p as (select a.doc_id as u, b.doc_id as v, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
e as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
r as (select doc_id, doc_id as c from n union select e.v, r.c from r join e on e.u = r.doc_id),
m as (select doc_id, min(c) as component_id from r group by 1)
select n.doc_id, n.n_shingles, m.component_id, n.doc_id = m.component_id as kept from n join m on n.doc_id = m.doc_id
"""
