"""n-gram Jaccard join by vertical partitioning.

Every document is the set of its word n-grams. All n-grams have one global order, rare ones first; the order is cut
into fragments, and the overlap of a candidate pair is counted in each fragment separately and summed per pair.
Candidates share an n-gram of their prefixes; documents with equal sets are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gram_shards as G
from .common import Scratch, components, map_batches, materialise, small_batches, unused
from .tokens import U64, Words, batches, mix, slices, texts

SIZE, NUM, DEN = 4, 85, 100
FRAGMENTS = 8
#: A task sorts its shard of hashes in so many parts, by their last bits, and deals its answers to so many times more
#: buckets than there are shards: neither costs bytes in the shuffle, as smaller shards would.
PARTS, BUCKETS = 8, 3


def document_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, by text and then hash, and the text of each. A shorter text is one n-gram."""
    hashes = words.hashes()
    rolled, at = words.windows(hashes, size)
    doc = words.docs()[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        grams = []
        for k in short:
            value = U64(0)
            own = hashes[words.first[k] : words.first[k + 1]]
            for h in own:
                value = mix(np.array([value ^ h]), 11)[0]
            grams.append(mix(np.array([value]), 11 + len(own))[0])
        rolled, doc = np.concatenate((rolled, np.array(grams, U64))), np.concatenate((doc, short))
    order = np.lexsort((rolled, doc))
    rolled, doc = rolled[order], doc[order]
    new = np.ones(len(rolled), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (doc[1:] != doc[:-1])
    return rolled[new], doc[new]


def fingerprints(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 128-bit fingerprint (two columns) of each text's set."""
    n = np.bincount(doc, minlength=n_docs)
    out = np.zeros((n_docs, 2), U64)
    full = n > 0
    if full.any():
        heads = (np.cumsum(n) - n)[full]
        for k in (0, 1):
            out[full, k] = np.add.reduceat(mix(hashes, 20 + k), heads)
    return n, out


def _hashes(size: int):
    def hashes(rows: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in rows:
            for _, _, words in batches(batch.column(0), lower=True):
                yield document_sets(words, size)[0]

    return hashes


SETS = "doc_id bigint, mark bigint, n bigint, node binary"


def _sets(size: int):
    def sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b, words in batches(batch.column(2), lower=True):
                n, prints = fingerprints(*document_sets(words, size), b - a)
                node = G.packed(prints.reshape(-1), 2 * np.arange(b - a + 1))
                own = [batch.column(k).slice(a, b - a) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), node], names=["doc_id", "mark", "n", "node"])

    return sets


BLOCKS = "shard int, nodes binary, sizes binary, counts binary, hashes binary"
REPLIES = "bucket int, nodes binary, sizes binary, counts binary, grams binary, freqs binary"


def _replies(nodes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, grams: np.ndarray, freqs: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Runs of n-grams, one run for each node, as one row for each bucket of nodes."""
    to = G.shard_of(nodes[:, 0], buckets)
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.diff(to[order], prepend=-1))
    starts = np.cumsum(counts) - counts
    rows = []
    for part in np.split(order, edges[1:]):
        n = counts[part]
        at = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows.append((int(to[part[0]]), nodes[part].tobytes(), sizes[part].astype(np.uint32).tobytes(), n.astype(np.uint32).tobytes(), grams[at].tobytes(), freqs[at].astype(np.uint32).tobytes()))
    types = [pa.int32()] + [pa.binary()] * 5
    names = [x.split()[0] for x in REPLIES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _send(size: int, shards: int, hot: np.ndarray):
    """Blocks of (node, hash) for all shards; equal sets of one run of texts are sent once."""

    most = G.block_bytes(shards)

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            data, bounds = texts(batch.column(0))
            for a, b in slices(bounds, most):
                found, before = [], 0
                for c, d in slices(bounds[a : b + 1]):
                    c, d = a + c, a + d
                    words = Words(data[bounds[c] : bounds[d]], bounds[c : d + 1] - bounds[c], lower=True)
                    hashes, doc = document_sets(words, size)
                    n, prints = fingerprints(hashes, doc, d - c)
                    found.append((hashes, doc + before, n, prints))
                    before += d - c
                hashes, doc, n, prints = (np.concatenate(x) for x in zip(*found, strict=True))
                _, once = np.unique(prints, axis=0, return_index=True)
                first = np.zeros(len(n), bool)
                first[once] = True
                use = first[doc] & ~G.in_sorted(hashes, hot)[0]
                hashes, doc = hashes[use], doc[use]
                rows_out = [
                    (s, prints[own].tobytes(), n[own].astype(np.uint32).tobytes(), k.astype(np.uint32).tobytes(), hashes[part].tobytes())
                    for s, part, own, k in G.split(hashes, doc, shards)
                ]
                if rows_out:
                    types = [pa.int32()] + [pa.binary()] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows_out, strict=True), types, strict=True)], names=["shard", "nodes", "sizes", "counts", "hashes"]
                    )

    return send


def _merge(buckets: int):
    """For each node its n-grams in this shard that a second node has, with their number of nodes."""

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in G.runs(rows, "shard"):
            nodes = G.joined(table, "nodes", U64).reshape(-1, 2)
            sizes, counts = G.joined(table, "sizes", np.uint32), G.joined(table, "counts", np.uint32).astype(np.int64)
            hashes = G.joined(table, "hashes", U64)
            del table
            # Equal sets from different tasks are one node; they hold equal hashes here, and the first stands for all.
            _, first = np.unique(nodes, axis=0, return_index=True)
            stands = np.zeros(len(nodes), bool)
            stands[first] = True
            owner = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
            use = stands[owner]
            owner, hashes = owner[use], hashes[use]
            if not len(hashes):
                continue
            freq = np.empty(len(hashes), np.int32)
            for part in range(PARTS):
                at = np.flatnonzero(hashes % U64(PARTS) == U64(part)).astype(np.int32)
                if len(at):
                    own = hashes[at]
                    order = np.argsort(own)
                    at, own = at[order], own[order]
                    edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    runs = np.diff(np.append(edge, len(own))).astype(np.int32)
                    freq[at] = np.repeat(runs, runs)
            shared = freq > 1
            owner, hashes, freq = owner[shared], hashes[shared], freq[shared]
            if len(owner):
                heads = np.flatnonzero(np.diff(owner, prepend=-1))
                who = owner[heads]
                yield _replies(nodes[who], sizes[who], np.diff(np.append(heads, len(owner))), hashes, freq, buckets)

    return merge


def _hot_replies(size: int, hot: np.ndarray, buckets: int):
    """The frequent n-grams of each node; they share the last place of the global order."""

    def replies(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b, words in batches(batch.column(0), lower=True):
                hashes, doc = document_sets(words, size)
                n, prints = fingerprints(hashes, doc, b - a)
                _, once = np.unique(prints, axis=0, return_index=True)
                first = np.zeros(len(n), bool)
                first[once] = True
                use = first[doc] & G.in_sorted(hashes, hot)[0]
                hashes, doc = hashes[use], doc[use]
                if len(doc):
                    heads = np.flatnonzero(np.diff(doc, prepend=-1))
                    who = doc[heads]
                    yield _replies(prints[who], n[who], np.diff(np.append(heads, len(doc))), hashes, np.full(len(doc), 2**32 - 1, np.uint32), buckets)

    return replies


ORDERED = "node binary, n bigint, shared bigint, grams array<bigint>, freqs array<bigint>"


def _gather(num: int, den: int):
    """The shared n-grams of each node in the global order, if there are enough of them for any link."""

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in G.runs(rows, "bucket"):
            nodes, sizes = G.joined(table, "nodes", U64).reshape(-1, 2), G.joined(table, "sizes", np.uint32).astype(np.int64)
            counts, grams, freqs = G.joined(table, "counts", np.uint32).astype(np.int64), G.joined(table, "grams", U64), G.joined(table, "freqs", np.uint32)
            known, at, which = np.unique(nodes, axis=0, return_index=True, return_inverse=True)
            owner = np.repeat(which.reshape(-1), counts)
            order = np.lexsort((grams, freqs, owner))
            owner, grams, freqs = owner[order], grams[order], freqs[order]
            new = np.ones(len(owner), bool)  # frequent n-grams of equal sets come from several tasks
            new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
            owner, grams, freqs = owner[new], grams[new], freqs[new]
            n, shared = sizes[at], np.bincount(owner, minlength=len(known))
            keep = den * shared >= num * n
            use = keep[owner]
            edges = np.append(0, np.cumsum(shared[keep]))
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v)) for v in (grams[use].view(np.int64), freqs[use].astype(np.int64))]
            node = G.packed(np.ascontiguousarray(known[keep]).reshape(-1), 2 * np.arange(keep.sum() + 1))
            yield pa.RecordBatch.from_arrays([node, pa.array(n[keep]), pa.array(shared[keep].astype(np.int64)), *lists], names=["node", "n", "shared", "grams", "freqs"])

    return gather


def _linked(overlap: Column, a: Column, b: Column, num: int, den: int) -> Column:
    return F.lit(den) * overlap >= F.lit(num) * (a + b - overlap)


def overlaps(pairs: DataFrame, fragments: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs that link: overlaps are counted in each fragment and summed per pair."""
    left = fragments.select(F.col("node").alias("a"), "fragment", F.col("n").alias("n_a"), F.col("grams").alias("grams_a"))
    right = fragments.select(F.col("node").alias("b"), "fragment", F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("part"))
    total = partial.groupBy("a", "b").agg(F.sum("part").alias("overlap"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return total.where(_linked(F.col("overlap"), F.col("n_a"), F.col("n_b"), num, den)).select("a", "b")


def jaccard_components(docs: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN, fragments: int = FRAGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when den * |intersection| >= num * |union|.

    component_id is the smallest id reachable by links. Null and empty texts, and texts without words, have an empty
    set and link with nothing; a null id is reached but never the smallest unless alone. Rows that repeat have equal
    sets and are one node. Extra columns are ignored; an empty table gives an empty result.

    No link between different sets is missed, but not all are written: a group of candidates is first compared with
    its most central member, and members that are in one component by then are never compared. All candidate pairs
    between different components are compared at the end. N-grams are told apart by 64-bit hashes and sets by 128-bit
    sums of them; a wrong link needs many collisions within one pair of documents.
    """
    with Scratch(docs.sparkSession, "jaccard") as work:
        named = _labelled(docs, size, num, den, fragments, id_col, text_col, work)
        smallest = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("smallest"))
        joined = named.join(smallest, "comp", "left")
        named = joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))
        return materialise(named, "components")


def _labelled(docs: DataFrame, size: int, num: int, den: int, fragments: int, id_col: str, text_col: str, work: Scratch) -> DataFrame:
    """(doc_id, mark, n, comp): a hash of the text, the size of its set and its component, null for an empty set."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.coalesce(text_col, F.lit("")).alias("text"))
    sets = work.table(map_batches(rows, _sets(size), SETS), "sets")
    shards = G.shard_count(rows)
    hot = G.hot_hashes(rows, _hashes(size), "id")
    only_text = rows.select("text")
    blocks = G.dealt(map_batches(only_text, _send(size, shards, hot), BLOCKS), shards)
    buckets = BUCKETS * shards
    told = map_batches(blocks, _merge(buckets), REPLIES)
    if len(hot):
        told = told.unionByName(map_batches(only_text, _hot_replies(size, hot, buckets), REPLIES))
    nodes = work.table(map_batches(G.dealt(told, buckets, "bucket"), _gather(num, den), ORDERED), "ordered")
    links = _links(nodes, fragments, num, den, work)
    labels = components(sets.select("node").where("n > 0").distinct(), links, work)
    named = sets.where("n > 0").join(labels, "node").select("doc_id", "mark", "n", "comp")
    return named.unionByName(sets.where("n = 0").select("doc_id", "mark", "n", F.lit(None).cast("binary").alias("comp")))


def _links(nodes: DataFrame, fragments: int, num: int, den: int, work: Scratch) -> DataFrame:
    """Links (a, b) whose components are those of all links."""
    place = F.posexplode("grams").alias("at", "gram")
    # The prefix: n - ceil(t * n) + 1 n-grams in the global order, of which the unshared ones come first.
    prefix = F.col("shared") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)) + 1
    heads = nodes.select("node", "n", "shared", F.slice("grams", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int")).alias("grams")).select("node", "n", "shared", place)
    heads = work.table(heads, "heads")
    # Fragments of the order: cuts at equal shares of the n-grams' frequencies.
    cuts = nodes.select(F.explode("freqs").alias("f")).agg(F.percentile_approx("f", [k / fragments for k in range(1, fragments)], 1000).alias("cuts")).first()["cuts"] or []
    # Frequencies repeat, so each class of frequency is cut again by the n-gram itself.
    coarse = sum((F.when(F.col("f") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    cells = nodes.select("node", "n", F.explode(F.arrays_zip("grams", "freqs")).alias("x")).select("node", "n", F.col("x.grams").alias("g"), F.col("x.freqs").alias("f"))
    parts = cells.groupBy("node", "n", (coarse * 2 + F.when(F.col("g") < 0, 0).otherwise(1)).alias("fragment")).agg(F.collect_list("g").alias("grams"))
    parts = work.table(parts, "fragments")
    work.drop(nodes)
    # First each group of candidates is compared with its most central member only.
    best = heads.groupBy("gram").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("share"), "node", "n")).alias("top"), F.count("*").alias("k"))
    star = heads.join(best.where("k > 1"), "gram").where("node <> top.node").where(_near(F.col("n"), F.col("top.n"), num, den))
    pairs = star.select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b")).distinct()
    found = work.table(overlaps(pairs, parts, num, den), "links")
    labels = work.table(components(heads.select("node").distinct(), found, work), "labels")
    return work.table(found.unionByName(overlaps(_rest(heads, labels, num, den, work), parts, num, den)), "links")


def _near(a: Column, b: Column, num: int, den: int) -> Column:
    return (F.lit(den) * F.least(a, b)) >= (F.lit(num) * F.greatest(a, b))


def _rest(heads: DataFrame, labels: DataFrame, num: int, den: int, work: Scratch) -> DataFrame:
    """Candidate pairs between components: of each group, all members outside its largest component with all others
    whose size is near enough. Groups are joined by size class, so a frequent n-gram is many keys."""
    now = heads.join(labels, "node")
    sizes = now.groupBy("gram", "comp").agg(F.count("*").alias("k"))
    top = sizes.groupBy("gram").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("gram", F.col("top.comp").alias("top"))
    live = work.table(now.join(top, "gram"), "live")
    # The smaller set of a pair needs a shorter prefix: n - ceil(2t / (1 + t) * n) + 1, as the other isn't smaller.
    short = F.col("shared") - F.ceil(F.col("n") * F.lit(2 * num) / F.lit(den + num)) + 1
    # Near sizes are in the same or in adjacent classes; a class is a little wider than they can differ.
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num) * (1 + 1e-9))) if num < den else F.col("n")
    live = live.withColumn("short", F.col("at") < short).withColumn("class", size_class)
    side = lambda df, k: df.select("gram", "class", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "shared", "at", "comp", "short")))
    x, y = side(live.where("comp <> top"), "x"), side(live.withColumn("class", F.explode(F.array(*(F.col("class") + k for k in (-1, 0, 1))))), "y")
    smaller_x = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") < F.col("node_y")))
    # What can still overlap: before the common n-gram no more than the shorter head, after it no more than the shorter tail.
    most = F.least("at_x", "at_y") + F.least(F.col("shared_x") - F.col("at_x"), F.col("shared_y") - F.col("at_y"))
    pairs = x.join(y, ["gram", "class"]).where("comp_x <> comp_y").where(F.when(smaller_x, F.col("short_x")).otherwise(F.col("short_y")))
    pairs = pairs.where(_near(F.col("n_x"), F.col("n_y"), num, den)).where(_linked(most, F.col("n_x"), F.col("n_y"), num, den))
    pairs = pairs.select(F.col("node_x").alias("x"), F.col("node_y").alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def one_of_each(docs: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN, fragments: int = FRAGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns: that with the smallest id, null ids last.

    Of rows that repeat an id and a text one stays. Null and empty texts, and texts without words, link with nothing,
    so all these rows stay. An empty table gives an empty result.
    """
    own, k_id, k_mark, k_many = unused(docs, "own_mark", "kept_id", "kept_mark", "kept_many")
    with Scratch(docs.sparkSession, "jaccard") as work:
        named = work.table(_labelled(docs, size, num, den, fragments, id_col, text_col, work), "named")
        row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
        best = named.where("comp is not null").groupBy("comp").agg(F.min(row).alias("best"))
        again = named.where("comp is not null").groupBy(row.alias("best")).agg((F.count("*") > 1).alias("many"))
        keep = best.select("best").join(again, "best").unionByName(named.where("comp is null").select(row.alias("best"), F.lit(False).alias("many")).distinct())
        keep = materialise(keep.select(F.col("best.doc_id").alias(k_id), F.col("best.mark").alias(k_mark), F.col("many").alias(k_many)), "representatives")
    rows = docs.withColumn(own, F.xxhash64(text_col)).join(keep, F.col(id_col).cast("long").eqNullSafe(F.col(k_id)) & (F.col(own) == F.col(k_mark)))
    once = rows.where(~F.col(k_many)).select(*docs.columns)
    if keep.where(F.col(k_many)).isEmpty():
        return once
    one = rows.where(F.col(k_many)).groupBy(k_id, k_mark).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(one.select("row.*"))
