"""MinHash near-duplicates: BagMinHash signatures, banding, exact multiset verification, components.

A text is the multiset of its five-word shingles (words: lower-cased runs of letters, digits and
non-ASCII characters; a text of one to four words is one shingle).  Two texts are linked when the
weighted Jaccard similarity of their multisets, sum of minima over sum of maxima, is 0.8 or more;
a class is a connected component of links.

Defined results.  Null text: an empty one.  Texts without words are equal to each other and form
one class.  Exact copies and repeated rows share a class.  Null ids order last; the class id is the
least id of the class (null only if all are).  Empty table: no rows.  Only the id and text columns
are read, so further columns of any name do no harm; very long texts are read whole.

Scale.  Copies collapse on a 64-bit fingerprint of the multiset before any candidate search, with
map-side partial aggregation, so a group of a third of all rows is one row afterwards; its verdict
goes to every task instead of through a join by fingerprint.  A bucket never meets in one task: in
each of ``STAR_ROUNDS`` rounds a member is compared with one centre out of all its buckets, so a round
makes at most as many pairs as there are members.  Then members of buckets that still hold several
components are compared by an exact prefix filter: a link to another component needs a common token
among the rarest of both multisets, so texts with too much of their own are out without a comparison.
No bucket is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import _text
from strandline.llm._ranges import largest, matched, numbered
from strandline.llm._scratch import Scratch
from strandline.sources.tables import spread

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 6
STAR_ROUNDS = 2
HOT = 8
HEAD = 16
#: A fingerprint with more rows than both HOT_ROWS and a HOT_SHARE-th of all is hot.
HOT_ROWS, HOT_SHARE = 1000, 256
_U64 = np.uint64
_CHUNK = 1_000_000


def shingle_bags(chunk: _text.Chunk, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of each distinct shingle, ordered by document and hash."""
    hashes, first = _text.ngrams(_text.words(chunk, _text.ALNUM), n)
    if not len(hashes):
        return np.zeros(0, np.int64), hashes, np.zeros(0, np.int64)
    doc = np.repeat(np.arange(chunk.rows), np.diff(first))
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(hashes)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64 random bits."""
    return ((x >> _U64(11)).astype(np.float64) + 1.0) * 2.0**-53


def bag_minhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """BagMinHash: ``docs x slots`` 64-bit values that agree in a slot with the weighted Jaccard probability.

    Integer weights are the discretisation.  The unit levels [0, w) of an element carry a Poisson
    process seeded by the element alone; the process is split hierarchically into the intervals
    [0,1), [1,2), [2,4), [4,8), ...: an interval wholly above w is never started, and a point of
    the interval that straddles w is kept if its level is below w.  A slot takes the earliest of the
    points that fall on it.  Points are made in ascending time up to a horizon at which the slots of
    the document are expected to be full; a document with an open slot is continued with twice the
    horizon, so the result is the one of the unbounded processes.
    """
    best = np.full(docs * slots, np.inf)
    out = np.zeros(docs * slots, _U64)
    mass = np.bincount(doc, weights=weight, minlength=docs)
    horizon = np.where(mass > 0, slots * (math.log(slots) + 2.0) / np.maximum(mass, 1), 0.0)
    open_docs = mass > 0
    done_until = np.zeros(docs)
    while open_docs.any():
        pick = open_docs[doc]
        e_doc, e_key, e_weight = doc[pick], key[pick], weight[pick]
        low, high = 0, 1
        while len(e_doc):
            p_doc, p_weight = e_doc, e_weight
            state = _text.mix64(e_key ^ _U64(high * 0x9E3779B1))
            time = np.zeros(len(p_doc))
            while len(p_doc):
                state = _text.mix64(state)
                time = time - np.log(_unit(state)) / (high - low)
                alive = time <= horizon[p_doc]
                p_doc, p_weight, state, time = p_doc[alive], p_weight[alive], state[alive], time[alive]
                place = _text.mix64(state ^ _U64(0xA5A5A5A5A5A5A5A5))
                take = time > done_until[p_doc]
                if high - low > 1:
                    level = low + (_unit(_text.mix64(place)) * (high - low)).astype(np.int64)
                    take &= np.minimum(level, high - 1) < p_weight
                at = p_doc[take] * slots + (place[take] % _U64(slots)).astype(np.int64)
                t = time[take]
                np.minimum.at(best, at, t)
                won = best[at] == t
                out[at[won]] = state[take][won]
            low, high = high, high * 2
            rest = e_weight > low
            e_doc, e_key, e_weight = e_doc[rest], e_key[rest], e_weight[rest]
        empty = np.isinf(best.reshape(docs, slots)).any(axis=1)
        done_until = np.where(open_docs, horizon, done_until)
        open_docs &= empty
        horizon = np.where(open_docs, horizon * 2, horizon)
    return out.reshape(docs, slots)


def _fingerprints(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """A 64-bit hash of each document's multiset (order-independent sum of mixed elements)."""
    mixed = _text.mix64(key + _text.mix64(weight.astype(_U64)))
    total = np.concatenate([np.zeros(1, _U64), np.cumsum(mixed, dtype=_U64)])
    first = np.searchsorted(doc, np.arange(docs + 1))
    return _text.mix64(total[first[1:]] - total[first[:-1]])


def _signature_batches(slots_bands: int, slots_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = slots_bands * slots_rows
        for batch in _text.slices(batches):
            lowered = pc.utf8_lower(pc.fill_null(batch.column("text"), ""))
            for part in _text.chunks(lowered, _CHUNK):
                doc, key, weight = shingle_bags(part)
                sig = bag_minhash(doc, key, weight, part.rows, slots)
                mass = np.bincount(doc, weights=weight, minlength=part.rows).astype(np.int64)
                bands = np.zeros((part.rows, slots_bands), _U64)
                for b in range(slots_bands):
                    acc = np.full(part.rows, b + 1, _U64)
                    for r in range(slots_rows):
                        acc = _text.mix64(acc ^ sig[:, b * slots_rows + r])
                    bands[:, b] = acc
                some = mass > 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(some, slots_bands, 0))]).astype(np.int32)),
                    pa.array(bands[some].reshape(-1).view(np.int64)),
                )
                rows = slice(part.first, part.last)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[rows],
                        batch.column("text_hash")[rows],
                        pa.array(_fingerprints(doc, key, weight, part.rows).view(np.int64)),
                        pa.array(mass),
                        lists,
                    ],
                    ["doc_id", "text_hash", "fp", "n", "bands"],
                )

    return run


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, bag): each text's multiset as distinct hashes of (shingle, which occurrence)."""
    for batch in _text.slices(batches):
        lowered = pc.utf8_lower(pc.fill_null(batch.column("text"), ""))
        for part in _text.chunks(lowered, _CHUNK):
            doc, key, weight = shingle_bags(part)
            each = np.repeat(np.arange(len(key)), weight)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)
            unary = _text.mix64(key[each] + _text.mix64(nth.astype(_U64)))
            size = np.bincount(doc[each], minlength=part.rows)
            bags = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(unary.view(np.int64))
            )
            fp = _fingerprints(doc, key, weight, part.rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp), bags], ["fp", "bag"])


def components(scratch: Scratch, edges: DataFrame, known: DataFrame | None, name: str) -> DataFrame:
    """(fp, root): the least node of each node's connected component.

    Minimum labels spread over edges and along pointers until none changes, from the labels already
    ``known``; each round is written to the shared folder, so lineage stays short and a lost executor
    costs one round at most.  Files are as many as the number of edges asks for.
    """
    parts = 1 + edges.count() // 500_000
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("m"))
    if known is None:
        first = first.select("fp", F.least("fp", "m").alias("root"))
    else:
        first = first.join(known, "fp", "full").select("fp", F.least("fp", "m", "root").alias("root"))
    labels = scratch.save(first, f"{name}-0", parts)
    step = 0
    while True:
        step += 1
        spread = (
            both.join(labels.withColumnRenamed("fp", "b"), "b")
            .groupBy(F.col("a").alias("fp"))
            .agg(F.min("root").alias("near"))
        )
        jump = labels.select(F.col("fp").alias("root"), F.col("root").alias("far"))
        stepped = (
            labels.join(spread, "fp", "left")
            .join(jump, "root")
            .select("fp", F.least("root", "near", "far").alias("root"), F.col("root").alias("was"))
        )
        now = scratch.save(stepped, f"{name}-{step}", parts)
        changed = now.filter("root <> was").limit(1).count()
        labels = now.drop("was")
        if not changed:
            return labels


def rare_prefixes(bags: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """(token, fp, n, root, hot, core, nth, head): the tokens by which a link to another component must be found.

    Two sets of at least ``threshold`` Jaccard similarity share a token among the n - ceil(threshold
    * n) + 1 rarest of each, whatever order of tokens is common to both; here the order is by how many
    of the sets hold a token.  Tokens that a single component holds find no new link and go.

    ``hot`` tokens, held by more than ``HOT`` sets, are last in the order: a set with one among its
    rarest has all its other tokens there too.  So two sets that meet by hot tokens alone share nothing
    else, and the lesser of their numbers of hot tokens (``core``) bounds what they have in common: a set
    with less than ``threshold`` of its tokens hot finds no link by them.  ``nth`` counts a set's tokens
    that are left, ``head`` holds the first ``HEAD`` of them.
    """
    each = placed.join(bags, "fp").select("fp", "n", "root", F.explode("bag").alias("token"))
    held = each.groupBy("token").agg(
        F.count("*").alias("held"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    order = Window.partitionBy("fp").orderBy("held", "token")
    ranked = each.join(held, "token").withColumn("place", F.row_number().over(order)).withColumn("hot", F.col("held") > HOT)
    ranked = ranked.withColumn("core", F.sum(F.col("hot").cast("int")).over(Window.partitionBy("fp")))
    room = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1
    may = ~F.col("hot") | (F.col("core") >= threshold * F.col("n") - 1e-6)
    mine = Window.partitionBy("fp").orderBy("place")
    rows = ranked.filter((F.col("place") <= room) & (F.col("low") != F.col("high")) & may).withColumn("nth", F.row_number().over(mine))
    every = mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.collect_list(F.when(F.col("nth") <= HEAD, F.col("token"))).over(every)
    return rows.select("token", "fp", "n", "root", "hot", "core", "nth", head.alias("head"))


def met_pairs(tokens: DataFrame, threshold: float) -> DataFrame:
    """(a, b): sets of several components and like sizes that meet in ``rare_prefixes``.

    Two sets meet at the first token that both have in their heads, and not again at those behind it, so
    a large group of sets gives about one row a pair.
    """
    left = tokens.withColumnsRenamed({"fp": "a", "n": "a_n", "root": "a_root", "core": "a_core", "head": "a_head"})
    right = tokens.drop("hot", "nth").withColumnsRenamed({"fp": "b", "n": "b_n", "root": "b_root", "core": "b_core", "head": "b_head"})
    close = F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n")
    most = F.least("a_core", "b_core")
    may = ~F.col("hot") | (most >= threshold * (F.col("a_n") + F.col("b_n") - most))
    before = F.slice("a_head", F.lit(1), F.least(F.col("nth") - 1, F.lit(HEAD)))
    apart = F.col("a_root") != F.col("b_root")
    pairs = left.join(right, "token").filter((F.col("a") < F.col("b")) & apart & close & may & ~F.arrays_overlap(before, "b_head"))
    return pairs.select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: (doc_id, text_hash, class_id, class_size, kept).

    ``kept`` holds for exactly one row of each class, one with the least (doc_id, text_hash).
    ``text_hash`` is ``xxhash64`` of the text, empty for null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")))
    signed = scratch.save(
        source.mapInArrow(
            _signature_batches(bands, rows), "doc_id long, text_hash long, fp long, n long, bands array<long>"
        ),
        "signed",
    )
    row = F.struct("doc_id", "text_hash")
    distinct = scratch.save(
        signed.groupBy("fp").agg(
            F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), row)), F.min(row)).alias("first"),
            F.count("*").alias("copies"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
        ),
        "distinct",
    )
    keyed = distinct.select("fp", "n", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket")
    members = scratch.save(keyed.join(shared, "bucket").select("bucket", "fp", "n"), "members")
    parts = 1 + members.count() // 100_000
    wanted = distinct.join(members.select("fp").distinct(), "fp", "left_semi").select(
        F.col("first.doc_id").alias("w_id"), F.col("first.text_hash").alias("w_hash")
    )
    texts = source.join(
        wanted, (F.col("text_hash") == F.col("w_hash")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi"
    ).select("text")
    bags = scratch.save(
        texts.mapInArrow(_bag_batches, "fp long, bag array<long>").groupBy("fp").agg(F.first("bag").alias("bag")),
        "bags",
    )

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Of the pairs (a, b), those whose multisets reach the threshold."""
        pairs = scratch.save(pairs, f"{name}-pairs", parts)
        left = bags.select(F.col("fp").alias("a"), F.col("bag").alias("bag_a"))
        right = bags.select(F.col("fp").alias("b"), F.col("bag").alias("bag_b"))
        both = F.size(F.array_intersect("bag_a", "bag_b"))
        found = (
            pairs.join(right, "b")
            .join(left, "a")
            .withColumn("common", both)
            .filter(F.col("common") >= threshold * (F.size("bag_a") + F.size("bag_b") - F.col("common")))
            .select("a", "b")
        )
        return scratch.save(found, f"{name}-links", parts)

    close = F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n")
    apart = F.col("a_root") != F.col("b_root")
    edges: DataFrame | None = None
    roots: DataFrame | None = None
    for step in range(STAR_ROUNDS + 1):
        placed = members.withColumn("root", F.col("fp"))
        if roots is not None:
            placed = members.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        mixed = mixed.filter("low <> high").select("bucket")
        placed = scratch.save(placed.join(mixed, "bucket").select("bucket", "fp", "n", "root"), f"placed-{step}", parts)
        if not placed.limit(1).count():
            break
        if step < STAR_ROUNDS:
            pairs = star_pairs(placed, edges, apart & close)
        else:
            lonely = placed.select("fp", "n", "root").distinct()
            tokens = scratch.save(rare_prefixes(bags, lonely, threshold), "tokens")
            pairs = met_pairs(tokens, threshold)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = linked(pairs, f"round-{step}")
        if found.limit(1).count():
            edges = found if edges is None else edges.union(found)
            roots = components(scratch, edges, roots, f"components-{step}")

    classes = distinct.select("fp", "first", "copies")
    classes = (
        classes.withColumn("root", F.col("fp"))
        if roots is None
        else classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    )
    known = F.when(F.col("first.doc_id").isNotNull(), F.col("first"))
    least = classes.groupBy("root").agg(
        F.coalesce(F.min(known), F.min("first")).alias("first"), F.sum("copies").alias("class_size")
    )
    verdict = classes.select("fp", "copies", "root").join(least, "root")
    verdict = scratch.save(
        verdict.select("fp", "copies", F.col("first.doc_id").alias("class_id"), "class_size", "first"), "verdict"
    )
    scratch.keep("signed", "verdict")
    # A multiset with more than 1/HOT_SHARE of all rows goes to every task: fewer than HOT_SHARE rows.
    hot = F.col("copies") > max(HOT_ROWS, signed.count() // HOT_SHARE)
    rows_of = signed.select("doc_id", "text_hash", "fp")
    hot_ones = F.broadcast(verdict.filter(hot).drop("copies"))
    whole = rows_of.join(hot_ones, "fp").unionByName(
        rows_of.join(F.broadcast(verdict.filter(hot).select("fp")), "fp", "left_anti").join(verdict.filter(~hot).drop("copies"), "fp")
    )
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    # Repeated rows of the kept (doc_id, text_hash) are counted and numbered: one of them stays.
    firsts = whole.filter(same).groupBy("doc_id", "text_hash", "class_id", "class_size").agg(F.count("*").alias("copies"))
    firsts = numbered(firsts, "copies", "nth", largest(verdict, "copies")).withColumn("kept", F.col("nth") == 0)
    columns = ["doc_id", "text_hash", "class_id", "class_size", "kept"]
    return whole.filter(~same).withColumn("kept", F.lit(False)).select(*columns).union(firsts.select(*columns))


def star_pairs(placed: DataFrame, edges: DataFrame | None, may: Column) -> DataFrame:
    """(a, b): each member with one centre, at most as many pairs as members.

    All members have one order: most links found so far first, then most fellow members in all buckets
    together (such a text is in the middle of its group, so the others are near to it), then a hash.  A
    bucket's centre is its first member; a member takes the first of the centres of its buckets that are
    of another component and of like size.
    """
    crowd = placed.groupBy("bucket").agg(F.count("*").alias("crowd"))
    popular = placed.join(crowd, "bucket").groupBy("fp").agg(F.sum("crowd").alias("crowd"))
    graded, first = placed.join(popular, "fp"), [-F.col("crowd"), F.xxhash64("fp")]
    if edges is not None:
        ends = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("degree"))
        graded, first = graded.join(ends, "fp", "left"), [-F.coalesce("degree", F.lit(0)), *first]
    graded = graded.withColumn("order", F.struct(*first))
    centre = graded.groupBy("bucket").agg(F.min(F.struct("order", "fp", "n", "root")).alias("c"))
    centre = centre.select(
        "bucket", "c.order", F.col("c.fp").alias("a"), F.col("c.n").alias("a_n"), F.col("c.root").alias("a_root")
    )
    met = placed.withColumnsRenamed({"fp": "b", "n": "b_n", "root": "b_root"}).join(centre, "bucket").filter(may)
    return met.groupBy("b").agg(F.min(F.struct("order", "a")).alias("c")).select("c.a", "b")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are kept: one of each class.

    Nulls, empty texts, repeated rows and an empty table: as above.  The input's columns travel in one
    struct, so further columns of any name do no harm.
    """
    kept = near_duplicates(docs, id_col, text_col, **options).filter("kept")
    kept = matched(kept.select("doc_id", "text_hash"), {"id": (F.col("doc_id"), 0), "hash": (F.col("text_hash"), 0)})
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
    )
    rows = matched(rows, {"id": (F.col("doc_id"), 0), "hash": (F.col("text_hash"), 0)})
    keys = ["id", "id_null", "hash"]
    return rows.join(kept.select(*keys), keys, "left_semi").dropDuplicates(keys).select("row.*")
