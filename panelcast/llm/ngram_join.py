"""N-gram Jaccard self-join by vertical partitioning, and its connected groups.

A document is the set of 64-bit hashes of its distinct shingles of ``Rule.words`` words; two link if
their Jaccard similarity reaches ``Rule.num / Rule.den``. The global n-gram order is the order of these hashes, cut at pivots into fragments. The work is exact:

1. *Classes.* Documents with equal sets are one class, represented by its smallest document id.
2. *Fragment signatures.* Two sets that reach the threshold differ in few n-grams, so with more
   fragments than that at least one fragment is equal in both. Each class gets one signature per
   fragment, for the fragment count of its size interval (and of those below, if its partners
   may be there). Unlike single n-grams, whole fragments are not shared by documents that merely
   contain the same passage. Sets with too many empty fragments also give their prefix n-grams.
3. *Candidates.* One exchange brings equal signatures together. One of up to ``SMALL`` classes gives
   its pairs: those with its first class are verified first, then those still in different groups,
   so a group of alike texts does not have all its pairs verified. A task that already sees more classes with one sends a mark instead of them, so a hot
   signature arrives as a few rows per task. The classes of such larger ones are joined among themselves by prefix filtering with positions: their n-grams are ordered
   by frequency, and only pairs whose remaining n-grams can reach the threshold survive. That
   join first pairs each n-gram's classes with the foremost one only, and then only classes that
   are not connected yet, so a group of alike texts does not give all its pairs.
4. *Partial overlaps.* Candidates are verified fragment by fragment: overlaps of segments are
   counted apart, and summed per pair.

A set below ``Rule.least`` n-grams can only equal its partner. Null and empty texts have no set and
link with nothing. Texts with fewer words than a shingle have one n-gram, the whole sequence. Rows that share a
document id are one document; rows without one link with nothing and get no component. An empty
table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.components import components
from panelcast.llm.words import mix, word_blocks
from panelcast.session import discard, release_shuffles, stage

#: Signatures with more classes than this go through the prefix join.
SMALL = 32
#: Ratio of the bounds of a size interval.
INTERVAL = 1.3
#: Signatures that a task gathers before it sends them on.
GATHER = 1 << 18
#: Fragments for verification: the top bits of the hash.
FRAGMENT_BITS = 3
#: Parts of the fragments that are verified one after the other.
SLICES = 4

#: Parts that the rows of one key are dealt over when what is known of the key is joined; at most 64.
BUCKETS = 64

_U = np.uint64
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], _U)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words, linked from a similarity of ``num / den``. Signatures are exchanged in
    ``passes`` parts by their hash, one after the other: the lower the similarity, the more there are. So are the
    texts and segments of the documents to verify, by document."""

    words: int = 3
    num: int = 9
    den: int = 10
    passes: int = 1

    @property
    def least(self) -> int:
        """The n-grams that a set needs to link with a different one."""
        return -(-self.num // (self.den - self.num))

    def apart(self, n: int) -> int:
        """The n-grams in which two partners can differ, if the smaller has up to ``n``."""
        return n * (self.den - self.num) // self.num

    def prefix(self, n: int) -> int:
        """Two partners share one of this many first n-grams."""
        return n * (self.den - self.num) // self.den + 1


@functools.cache
def _intervals(rule: Rule, upto: int) -> list[tuple[int, int]]:
    """Size intervals (first, last) that cover all sizes up to ``upto`` that may have partners."""
    found, low = [], rule.least
    while low <= upto:
        high = max(low, int(low * INTERVAL))
        found.append((low, high))
        low = high + 1
    return found


def shingles(words: np.ndarray, size: int = 3) -> np.ndarray:
    """The sorted distinct n-gram hashes of one document's word hashes."""
    factors = np.concatenate([_K, mix(_K[0] * np.arange(1, max(1, size - 2), dtype=_U))])[:size]
    if not len(words):
        return words
    if len(words) < size:
        return mix((words * factors[: len(words)]).sum(keepdims=True) + _U(len(words)))
    n = len(words) - size + 1
    sums = words[:n] * factors[0]
    for k in range(1, size):
        sums = sums + words[k : n + k] * factors[k]
    return np.unique(mix(sums + _U(size)))


def set_key(found: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    halves = (mix(found ^ _K[0]).sum(), mix(found ^ _K[1]).sum() + _U(len(found)))
    return b"".join(int(h).to_bytes(8, "big") for h in halves)


def signatures(found: np.ndarray, rule: Rule = Rule()) -> np.ndarray:
    """Hashes of the fragments of a sorted set, for its size interval and those that a smaller partner may be in."""
    n = len(found)
    if n < rule.least:
        return found[:0]
    spans = _intervals(rule, 1 << (n * 2).bit_length())
    own = next(i for i, (_, high) in enumerate(spans) if n <= high)
    out = []
    for i in range(own, -1, -1):
        if rule.num * n > rule.den * spans[i][1]:
            break
        low, most = spans[i][0], rule.apart(spans[i][1])
        spare = 1 + int(most * (0.02 + 2 * math.exp(-low / (most + 1))))  # for fragments empty by chance
        count = most + 1 + spare
        fragment = ((found >> _U(32)) * _U(count)) >> _U(32)
        starts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
        sums = np.add.reduceat(mix(found ^ _K[2]), starts)
        interval = np.array([i], _U)
        out.append(mix(sums + fragment[starts] * _K[0] + interval * _K[1]))
        if count - len(starts) > spare:
            out.append(mix(found[: rule.prefix(n)] + interval * _K[2]))
    return np.concatenate(out)


def _profiles(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, words, bounds in word_blocks(batch.column("text")):
            sets = [shingles(words[a:b], rule.words) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(at, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "key"],
            )


_MEMBER = "sig long, cls long, n int"
#: A pair of classes, or a class of a large signature (``sig``).
_MET = "cls long, n int, other long, other_n int, first boolean, sig long"


def _combined(sig: np.ndarray, cls: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Each (signature, class) of a block once."""
    order = np.lexsort((cls, sig))
    sig, cls, n = sig[order], cls[order], n[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])])
    return pa.RecordBatch.from_arrays([pa.array(c[fresh]) for c in (sig, cls, n)], ["sig", "cls", "n"])


def _signed(batches: Iterator[pa.RecordBatch], rule: Rule, some: int = 0) -> Iterator[pa.RecordBatch]:
    """One pass's signatures of all documents with the class (the start of the set's key) and size."""
    held: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def emit() -> pa.RecordBatch:
        lengths = [len(s) for s, _, _ in held]
        cls = np.repeat(np.array([c for _, c, _ in held], np.int64), lengths)
        return _combined(
            np.concatenate([s for s, _, _ in held]).view(np.int64),
            cls,
            np.repeat(np.array([n for _, _, n in held], np.int32), lengths),
        )

    for batch in batches:
        for _, words, bounds in word_blocks(batch.column("text")):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                found = shingles(words[a:b], rule.words)
                signs = signatures(found, rule)
                signs = signs[signs % _U(rule.passes) == some]
                if len(signs):
                    held.append((signs, int.from_bytes(set_key(found)[:8], "big", signed=True), len(found)))
                    size += len(signs)
                if size >= GATHER:
                    yield emit()
                    held, size = [], 0
    if size:
        yield emit()


def _met(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature: pairs of classes that share one. A signature of more than ``SMALL``
    classes gives those with its first class, and each of its classes beside the signature."""
    left = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]

    def found(columns: list[np.ndarray]) -> pa.RecordBatch | None:
        sig, cls, n = columns
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        ends = np.append(starts[1:], len(sig))
        parts = []
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            members, at = np.unique(cls[a:b], return_index=True)
            sizes = n[a:b][at]
            many = len(members) > SMALL
            if many:
                parts.append((members, sizes, None, None, None, np.full(len(members), sig[a])))
                i, j = np.zeros(len(members) - 1, np.int64), np.arange(1, len(members))
            else:
                i, j = np.triu_indices(len(members), 1)
            fit = rule.den * np.minimum(sizes[i], sizes[j]) >= rule.num * np.maximum(sizes[i], sizes[j])
            parts.append((members[i[fit]], sizes[i[fit]], members[j[fit]], sizes[j[fit]], i[fit] == 0, None))
        lengths = [len(p[0]) for p in parts]
        if not sum(lengths):
            return None
        arrays = [pa.array(np.concatenate([p[0] for p in parts])), pa.array(np.concatenate([p[1] for p in parts]), pa.int32())]
        for k, kind in ((2, pa.int64()), (3, pa.int32()), (4, pa.bool_()), (5, pa.int64())):
            chunks = [pa.nulls(m, kind) if p[k] is None else pa.array(p[k], kind) for p, m in zip(parts, lengths, strict=True)]
            arrays.append(pa.concat_arrays(chunks))
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _MET.split(", ")])

    for batch in batches:
        columns = [np.concatenate([h, c.to_numpy()]) for h, c in zip(left, batch.columns, strict=True)]
        if not len(columns[0]):
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last signature may go on
        left = [c[last:] for c in columns]
        out = found([c[:last] for c in columns]) if last else None
        if out is not None:
            yield out
    if len(left[0]):
        out = found(left)
        if out is not None:
            yield out


def _segments(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """One row per document and non-empty fragment."""
    pivots = (np.arange(1, 1 << FRAGMENT_BITS, dtype=_U) << _U(64 - FRAGMENT_BITS))
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for at, words, bounds in word_blocks(batch.column("text")):
            rows: list[tuple[int, int, int]] = []
            parts = []
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                found = shingles(words[a:b], rule.words)
                for f, part in enumerate(np.split(found, np.searchsorted(found, pivots))):
                    if len(part):
                        rows.append((ids[at + i], len(found), f))
                        parts.append(part.view(np.int64))
            if rows:
                doc, n, f = zip(*rows, strict=True)
                ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
                arrays = [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(f, pa.int32())]
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts))))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "fragment", "segment"])


def _sizes_fit(rule: Rule, a: Column, b: Column) -> Column:
    return rule.den * F.least(a, b) >= rule.num * F.greatest(a, b)


def _reaches(rule: Rule, overlap: Column, a: Column, b: Column) -> Column:
    """Jaccard similarity at or above the threshold, from the overlap and both sizes."""
    return (rule.den + rule.num) * overlap >= rule.num * (a + b)


def _verified(pairs: DataFrame, segments: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, na, b, nb) that reach the threshold, by partial overlaps per fragment.

    Some fragments at a time are met with the pairs, and only the counts are kept, so that no more than
    their share of the segments lies in shuffle files at once.
    """
    pairs = stage(pairs, "ngram-candidates")
    counts = []
    for some in range(SLICES):
        own = segments.where(F.col("fragment") % SLICES == some)
        left = own.select(F.col("doc_id").alias("a"), "fragment", F.col("segment").alias("left"))
        right = own.select(F.col("doc_id").alias("b"), "fragment", F.col("segment").alias("right"))
        # One kind of join at every size, so that what is measured on small tables holds on large ones.
        parts = pairs.hint("merge").join(left, "a").hint("merge").join(right, ["b", "fragment"])
        parts = parts.select("a", "na", "b", "nb", F.size(F.array_intersect("left", "right")).alias("part"))
        counts.append(stage(parts.where("part > 0"), "ngram-overlaps"))
        del parts
        release_shuffles(pairs.sparkSession)
    every = functools.reduce(DataFrame.unionByName, counts)
    summed = every.groupBy("a", "na", "b", "nb").agg(F.sum("part").alias("overlap"))
    reached = summed.where(_reaches(rule, F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b")
    links = stage(reached, "ngram-links")
    discard(pairs, every)
    return links


def _bucket(doc: Column) -> Column:
    """The part of its key's rows that a document is dealt to."""
    return F.pmod(F.xxhash64(doc), F.lit(BUCKETS)).cast("int")


def _used_buckets() -> Column:
    """A bit mask of the parts that a key's rows (column ``bucket``) are dealt to."""
    return F.bit_or(F.expr("shiftleft(1L, bucket)")).alias("used")


def _each_bucket() -> Column:
    """The parts of a mask, one row each, so that what is known of a key goes once to each part."""
    parts = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
    return F.explode(F.filter(parts, lambda b: F.getbit("used", b) == 1)).alias("bucket")


def _ordered_pair(x: Column, y: Column) -> list[Column]:
    low, high = F.least(x, y), F.greatest(x, y)
    return [low["doc"].alias("a"), low["n"].alias("na"), high["doc"].alias("b"), high["n"].alias("nb")]


def _postings(crowded: DataFrame, segments: DataFrame, rule: Rule) -> DataFrame:
    """Prefix n-grams of the crowded classes, rarest first: gram, (doc, n), position."""
    grams = segments.join(crowded, "doc_id", "left_semi").select("doc_id", "n", F.explode("segment").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    listed = grams.join(shared, "gram").groupBy("doc_id", "n")
    listed = listed.agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    prefix = F.floor(F.col("n") * (rule.den - rule.num) / rule.den).cast("int") + 1
    rows = listed.where(alone < prefix).select(
        F.struct(F.col("doc_id").alias("doc"), "n").alias("member"),
        alone.alias("alone"),
        F.posexplode(F.slice("shared", F.lit(1), (prefix - alone).cast("int"))).alias("i", "s"),
    )
    return rows.select(F.col("s.gram").alias("gram"), "member", (F.col("alone") + F.col("i")).alias("pos"))


def _possible(rule: Rule, x: Column, px: Column, y: Column, py: Column) -> Column:
    """Sizes fit, and what follows the first shared n-gram can still reach the threshold."""
    left = F.least(x["n"] - px, y["n"] - py)
    return _sizes_fit(rule, x["n"], y["n"]) & _reaches(rule, left, x["n"], y["n"]) & (x["doc"] != y["doc"])


def _foremost_pairs(postings: DataFrame, rule: Rule) -> DataFrame:
    dealt = postings.withColumn("bucket", _bucket(F.col("member.doc")))
    first = dealt.groupBy("gram").agg(F.min(F.struct("pos", "member")).alias("head"), _used_buckets())
    met = dealt.join(first.select("gram", "head", _each_bucket()), ["gram", "bucket"])
    fits = _possible(rule, F.col("member"), F.col("pos"), F.col("head.member"), F.col("head.pos"))
    return met.where(fits).select(*_ordered_pair(F.col("member"), F.col("head.member"))).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that are in different components so far."""
    for side in ("a", "b"):
        known = labels.select(F.col("node").alias(side), F.col("component").alias(f"in_{side}"))
        pairs = pairs.join(known, side, "left").withColumn(f"in_{side}", F.coalesce(f"in_{side}", side))
    return pairs.where("in_a <> in_b").select("a", "na", "b", "nb")


def _pairs_across(postings: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that share a prefix n-gram and are in different components so far."""
    node = labels.select(F.col("node").alias("node"), "component")
    marked = postings.join(node, F.col("member.doc") == F.col("node"), "left")
    marked = marked.select("gram", "member", "pos", F.coalesce("component", "member.doc").alias("component"))
    marked = marked.withColumn("bucket", _bucket(F.col("member.doc")))
    mixed = marked.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), _used_buckets())
    marked = marked.join(mixed.where("low < high").select("gram", _each_bucket()), ["gram", "bucket"], "left_semi")
    other = marked.select("gram", *[F.col(c).alias(f"{c}2") for c in ("member", "pos", "component")])
    fits = _possible(rule, F.col("member"), F.col("pos"), F.col("member2"), F.col("pos2"))
    met = marked.join(other, "gram").where(fits & (F.col("component") < F.col("component2")))
    return met.select(*_ordered_pair(F.col("member"), F.col("member2"))).distinct()


def _crowded(large: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of large signatures (``sig``, ``doc_id``) whose classes are in different components so far."""
    known = large.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    known = known.select("sig", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    dealt = known.withColumn("bucket", _bucket(F.col("doc_id")))
    ends = dealt.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), _used_buckets())
    mixed = ends.where("low < high").select("sig", _each_bucket())
    return dealt.join(mixed, ["sig", "bucket"], "left_semi").select("doc_id").distinct()


def groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = Rule(), tidy: bool = False
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row. ``tidy`` deletes the texts' segments too
    once all is verified; other tables in between always are, the result's own never."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = rows.mapInArrow(lambda it: _profiles(it, rule), "doc_id long, n long, key binary")
    profiles = stage(made, "ngram-profiles")
    named_rows = rows.where("doc_id IS NOT NULL").select("text")
    parts = []
    for some in range(rule.passes):
        signed = named_rows.mapInArrow(functools.partial(_signed, rule=rule, some=some), _MEMBER)
        placed = signed.repartition("sig").sortWithinPartitions("sig")
        parts.append(stage(placed.mapInArrow(lambda it: _met(it, rule), _MET).distinct(), "ngram-met"))
        del signed, placed
        release_shuffles(docs.sparkSession)  # the signatures are the largest exchange by far
    # A pair that meets in several passes is there as often; both uses below take it once.
    met = functools.reduce(DataFrame.unionByName, parts)
    del made

    whole = profiles.where("n > 0 AND doc_id IS NOT NULL")
    start = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    heads = whole.groupBy(start.alias("cls")).agg(F.min("doc_id").alias("doc"))
    there = heads.select(F.col("cls").alias("other"), F.col("doc").alias("other_doc"))
    member = [F.struct(F.col(d).alias("doc"), F.col(n).cast("long").alias("n")) for d, n in (("doc", "n"), ("other_doc", "other_n"))]
    pairs = met.where("other IS NOT NULL").join(heads, "cls").join(there, "other")
    pairs = pairs.select(*_ordered_pair(*member), "first").groupBy("a", "na", "b", "nb").agg(F.max("first").alias("first"))
    small = stage(pairs, "ngram-pairs")
    large = stage(met.where("other IS NULL").join(heads, "cls").select("sig", F.col("doc").alias("doc_id")), "ngram-large")
    discard(met)
    needed = small.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(large.select("doc_id"))
    needed = stage(needed.distinct(), "ngram-needed")
    parts = []
    for some in range(rule.passes):  # or the exchanges of all texts and of all segments lie on disk at once
        own = F.pmod(F.xxhash64("doc_id"), F.lit(rule.passes)) == some
        texts = rows.where(own).join(needed.where(own).hint("merge"), "doc_id", "left_semi")
        cut = texts.mapInArrow(functools.partial(_segments, rule=rule), "doc_id long, n long, fragment int, segment array<long>")
        parts.append(stage(cut.groupBy("doc_id", "n", "fragment").agg(F.max("segment").alias("segment")), "ngram-segments"))
        del texts, cut
        release_shuffles(docs.sparkSession)
    segments = functools.reduce(DataFrame.unionByName, parts)

    links = _verified(small.where("first").drop("first"), segments, rule)
    labels = components(links)
    crowded = stage(_crowded(large, labels), "ngram-crowded")
    postings = stage(_postings(crowded, segments, rule), "ngram-postings")
    if not postings.isEmpty():
        links = links.unionByName(_verified(_foremost_pairs(postings, rule), segments, rule))
        discard(labels)
        labels = components(links)
    across = _apart(small.where("NOT first").drop("first"), labels).unionByName(_pairs_across(postings, labels, rule))
    links = links.unionByName(_verified(across.distinct(), segments, rule))
    discard(small, large, crowded, postings, labels, *([needed, segments] if tidy else []))
    release_shuffles(docs.sparkSession)
    labels = components(links)

    slim = profiles.select("doc_id", "n", "key", _bucket(F.col("doc_id")).alias("bucket"))
    heads = slim.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("head"), _used_buckets())
    named = heads.join(labels, F.col("head") == F.col("node"), "left")
    named = named.select("key", F.coalesce("component", "head").alias("component_id"), _each_bucket())
    joined = slim.join(named, ["key", "bucket"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), own)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
