"""N-gram Jaccard self-join of documents, and the groups that its links make.

Candidates come from rare-first prefixes: every document's shingles are ordered by how often they occur
in the corpus, then by hash, and documents that reach the threshold share a shingle within a
length-dependent prefix of that order. Frequencies are estimated from two fixed-size rows of counters
over all documents, as what a shingle's counters hold beyond the median counter: what the mass of rare
shingles adds to every counter cancels out, so frequent ones stand out in corpora of any size. Length,
positional and suffix filters apply inside the join; each remaining pair is verified once, on the whole
sets.

To stay linear in hot groups the join works on classes of equal sets, on one shingle for all shingles
with the same documents, and in rounds. First every document meets only the hub of its posting lists,
the document that shares most; what proves linked is one component. Then only pairs in different
components are left, and these are all verified. No pair within the threshold is lost: pairs skipped
are pairs whose ends are already known to be linked by a path.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import cut, prepare, release
from partweave.llm.components import connected_components
from partweave.llm.kernels import U, give_back, mix, shingle_sets, steps

#: Words of a shingle; threshold in hundredths.
SHINGLE, PERCENT = 5, 75
#: Count table: two rows of 2^16 counters, a fixed size; parts of a set that the suffix filter compares in the join; shingles by which a pair is emitted once.
SKETCH_BITS, PARTS, FIRST = 16, 64, 16
#: Membership filters sent to the workers have 16 bits for each entry, within these bounds (128 KB to 16 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Hub rounds go on while the pairs left may exceed this many for each posting, and the last round still linked some.
LEFT_PER_POSTING, MOST_ROUNDS = 1000, 6
NULL_KEY = -(2**63)


@dataclass(frozen=True)
class Threshold:
    """Exact integer arithmetic of 100 * intersection >= percent * union."""

    percent: int

    def overlap(self, a: Column, b: Column) -> Column:
        """Least common shingles of linked sets of these sizes."""
        return _ceil_div(self.percent * (a + b), 100 + self.percent)

    def probe(self, n: int) -> int:
        """Prefix of a set that meets equal or smaller sets."""
        return n - -(-self.percent * n // 100) + 1

    def index(self, n: Column) -> Column:
        """Prefix of a set that meets equal or larger sets."""
        return n - _ceil_div(2 * self.percent * n, 100 + self.percent) + 1

    def least(self, a: int, b: int) -> int:
        """Least common shingles, as a number."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def links(self, a: int, b: int, common: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + F.lit(b - 1)) / F.lit(b)).cast("long")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    f1 = np.array([mix(s).sum(dtype=U) if len(s) else U(0) for s in sets], U)
    f2 = np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) if len(s) else U(0) for s in sets], U)
    return f1, f2


def _outline(s: np.ndarray) -> np.ndarray:
    """Numbers of shingles by hash, in about half as many buckets (a power of two): what the suffix filter compares."""
    buckets = max(PARTS, 1 << max(0, (len(s) - 1).bit_length() - 1))
    return np.bincount((s & U(buckets - 1)).astype(np.int64), minlength=buckets)


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the number of shingles that only one of two sets has; the longer outline is folded."""
    if len(a) > len(b):
        a, b = b, a
    if (a == 255).any() or (b == 255).any():
        # Counts at the limit may be larger: such buckets say nothing.
        b = b.reshape(-1, len(a))
        known = (a < 255) & (b < 255).all(0)
        return int(np.abs(a.astype(np.int64) - b.sum(0, dtype=np.int64))[known].sum())
    return int(np.abs(a.astype(np.int64) - b.reshape(-1, len(a)).sum(0, dtype=np.int64)).sum())


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """Rows of two kinds: a document's set size, fingerprints and part counts; and counts of the sketch's buckets."""
    schema = "doc long, n int, f1 long, f2 long, parts array<byte>, outline binary, bucket int, hits long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(2 << SKETCH_BITS, np.int64)
        for rows, data, offsets in steps(batches, "text"):
            sets = shingle_sets(data, offsets, size)
            n = np.array([len(s) for s in sets], np.int32)
            f1, f2 = _fingerprints(sets)
            outlines = [_outline(s) for s in sets]
            parts = np.array([np.minimum(o.reshape(-1, PARTS).sum(0), 127) for o in outlines], np.int8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, PARTS, dtype=np.int32)), pa.array(parts.ravel()))
            k = len(sets)
            for counters in _counters(np.concatenate(sets)):
                sketch += np.bincount(counters, minlength=2 << SKETCH_BITS)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), _signed(f1), _signed(f2), lists, pa.array([np.minimum(o, 255).astype(np.uint8).tobytes() for o in outlines], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], names=names)
        some = np.flatnonzero(sketch)
        k = len(some)
        empty = [pa.nulls(k, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int8()), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(some.astype(np.int32)), pa.array(sketch[some])], names=names)

    return docs.mapInArrow(run, schema)


def _counters(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's counter in each row; those of the second row come after the first row's."""
    mask = U((1 << SKETCH_BITS) - 1)
    return (s >> U(64 - SKETCH_BITS)).astype(np.int64), (1 << SKETCH_BITS) + ((s >> U(64 - 2 * SKETCH_BITS)) & mask).astype(np.int64)


def _ranks(hits: np.ndarray) -> np.ndarray:
    """A frequency class for each counter: twice the logarithm of what it holds beyond its row's median."""
    rows = hits.reshape(2, -1)
    return np.floor(2 * np.log2(1 + np.maximum(rows - np.median(rows, axis=1, keepdims=True), 0))).astype(U).ravel()


def _ordered(sets: list[np.ndarray], rank: np.ndarray) -> list[np.ndarray]:
    """Shingles as 63-bit tokens whose numeric order is rare first: the lower frequency class of both counters, then 56 bits of the hash."""
    classes = lambda s: np.minimum(*(rank[c] for c in _counters(s)))
    return [np.sort((classes(s) << U(56)) | (s >> U(8))) for s in sets]


def _filter_bits(values: DataFrame, column: str) -> tuple[int, bytes]:
    """A Bloom filter of two positions per value, as (bits, compressed words); made by aggregates, bounded by ``MOST_BITS``."""
    n = values.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, (16 * n - 1).bit_length())))
    places = values.select(F.explode(F.array(F.col(column).bitwiseAND(bits - 1), F.shiftrightunsigned(column, 28).bitwiseAND(bits - 1))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("v")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["w"].to_numpy()] = words["v"].to_numpy()
    packed = zlib.compress(table.tobytes(), 1)
    del words, table
    give_back()
    return bits, packed


class _Filter:
    def __init__(self, packed: tuple[int, bytes]):
        self.mask, self.table = U(packed[0] - 1), np.frombuffer(zlib.decompress(packed[1]), U)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        found = np.ones(len(x), bool)
        for p in (x & self.mask, (x >> U(28)) & self.mask):
            found &= (self.table[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & U(1) == 1
        return found


def _spread(key: Column) -> Column:
    """A key as a non-negative number with evenly spread bits, for the filter."""
    return F.xxhash64(key).bitwiseAND((1 << 62) - 1)


def _within(t: Threshold, x: str, y: str) -> Column:
    """Length and positional filters of two postings of one shingle."""
    c = lambda side, name: F.col(f"{side}.{name}")
    nx, ny, px, py = c(x, "n"), c(y, "n"), c(x, "pos"), c(y, "pos")
    length = 100 * F.least(nx, ny) >= t.percent * F.greatest(nx, ny)
    return length & (F.least(px, py) + 1 + F.least(nx - px, ny - py) - 1 >= t.overlap(nx, ny))


def _parts_within(t: Threshold, x: str, y: str) -> Column:
    """Suffix filter: parts of the two sets may differ by no more than the threshold leaves. Parts of 127 say nothing."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = lambda a, b: F.when((a == 127) | (b == 127), 0).otherwise(F.abs(a.cast("int") - b.cast("int")))
    apart = F.aggregate(F.zip_with(F.col(f"{x}.parts"), F.col(f"{y}.parts"), differ), F.lit(0), lambda a, b: a + b)
    return apart <= nx + ny - 2 * t.overlap(nx, ny)


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    a, b = F.col(f"{x}.node"), F.col(f"{y}.node")
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _with_comp(live: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return live.withColumn("comp", F.col("node"))
    return live.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _hub_pairs(live: DataFrame, t: Threshold, salt: int) -> DataFrame:
    """Each posting with the hub of its list, where their components differ."""
    place = F.struct("central", F.xxhash64("node")) if salt == 0 else F.struct(F.xxhash64("node", "token", F.lit(salt)))
    hub = F.max_by(F.struct("node", "n", "pos", "comp"), place).alias("h")
    hubs = cut(live.groupBy("token").agg(hub, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", "h.*"))
    rows = live.alias("x").join(hubs.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & _within(t, "x", "y"))
    return _pairs(rows, "x", "y")


def _mixed(live: DataFrame) -> tuple[DataFrame, int]:
    """Postings of shingles with more than one component, with the list's largest, as a written table; and how many pairs these leave at most."""
    sizes = live.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    major = cut(sizes.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), F.max("k").alias("most"), F.sum("k").alias("k")).where("most < k"))
    left = major.select(F.coalesce(F.sum((F.col("k") - F.col("most")) * F.col("k").cast("double")), F.lit(0.0)).alias("s")).first()["s"]
    return major, int(left)


def _remaining_pairs(live: DataFrame, major: DataFrame, heads: DataFrame, t: Threshold) -> DataFrame:
    """Every pair of postings with different components: those outside a list's largest component against all.

    A pair is emitted at the first shingle that both lists of first shingles have, if there is one.
    """
    rows = cut(live.select("token", "node", "n", "pos", "comp").join(major.select("token", "major"), "token").join(heads, "node"))
    x, y = rows.where("comp <> major").alias("x"), rows.alias("y")
    both = (F.col("y.comp") == F.col("y.major")) | (F.col("x.node") > F.col("y.node"))
    small_y = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.node") < F.col("x.node")))
    prefix = F.when(small_y, F.col("y.pos") < t.index(F.col("y.n"))).otherwise(F.col("x.pos") < t.index(F.col("x.n")))
    shared = F.array_intersect(F.col("x.first"), F.col("y.first"))
    once = F.coalesce(F.get(shared, 0) == F.col("x.token"), F.lit(True))
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & both & prefix & _within(t, "x", "y") & _parts_within(t, "x", "y") & once
    return _pairs(x.join(y, on), "x", "y")


def _with_both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``a``, ``b`` and the nodes' values as ``x`` and ``y``."""
    left = values.select(F.col("node").alias("a"), F.col(column).alias("x"))
    right = values.select(F.col("node").alias("b"), F.col(column).alias("y"))
    # Merged at every size, so that small inputs show what large ones move.
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")


def _nodes_of(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(reps, "node")


def _plausible(pairs: DataFrame, profiles: DataFrame, reps: DataFrame, t: Threshold) -> DataFrame:
    """The pairs that the suffix filter leaves, from the sets' outlines: a sixteenth to an eighth of the sets' bytes."""
    nodes = _nodes_of(pairs, reps.select("node", "doc", "f1", "n"))
    outlines = cut(profiles.select("doc", "f1", "outline").join(nodes.hint("merge"), ["doc", "f1"]).dropDuplicates(["node"]).select("node", F.struct("n", "outline").alias("o")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                most = x["n"] + y["n"] - 2 * t.least(x["n"], y["n"])
                keep.append(_apart(np.frombuffer(x["outline"], np.uint8), np.frombuffer(y["outline"], np.uint8)) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = cut(_with_both(pairs, outlines, "o").mapInArrow(compare, "a long, b long"))
    release(outlines)
    return left


def _verified(pairs: DataFrame, docs: DataFrame, profiles: DataFrame, reps: DataFrame, t: Threshold, size: int) -> DataFrame:
    """The pairs that reach the threshold, by their whole sets. Sets are made again, for the documents of plausible pairs alone."""
    plausible = pairs = _plausible(pairs, profiles, reps, t)
    nodes = cut(_nodes_of(pairs, reps.select("node", "doc", "f1")))
    packed = _filter_bits(nodes.select(_spread(F.col("doc")).alias("v")).distinct(), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Filter(packed)
        for batch in batches:
            chosen = batch.filter(pa.array(wanted(batch.column(2).to_numpy().view(U))))
            for rows, data, offsets in steps(iter([chosen]), "text"):
                sets = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([rows.column(0), _signed(_fingerprints(sets)[0]), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["doc", "f1", "grams"])

    made = docs.withColumn("v", _spread(F.col("doc"))).mapInArrow(run, "doc long, f1 long, grams binary")
    sets = cut(made.join(nodes.hint("merge"), ["doc", "f1"]).select("node", "grams").dropDuplicates(["node"]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                at = np.searchsorted(y, x)
                keep.append(t.links(len(x), len(y), int((y[np.minimum(at, len(y) - 1)] == x).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = cut(_with_both(pairs, sets, "grams").mapInArrow(compare, "a long, b long"))
    release(plausible, nodes, sets)
    return found


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per document: ``key``, ``n_shingles`` and ``component_id``, the smallest key reachable by links.

    Words are runs of characters other than the six ASCII spaces, with A-Z read as a-z; a document's set
    is its distinct ``size``-word shingles, or all its words as one if there are fewer. Documents link
    when 100 * intersection >= ``percent`` * union. Null, empty and wordless texts have no shingles and
    link with nothing. Rows with equal sets link whatever their keys; rows that share a key are rows of
    their own and each get a result. A null key is smaller than any other; a key must be a number,
    or text that reads as one. Shingles are compared by a 64-bit hash, within one document and within a
    pair; classes of equal sets by size and 128 bits. Other columns are ignored. An empty table gives no
    rows.
    """
    prepare(docs.sparkSession)
    t = Threshold(percent)
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("doc"), F.col(text).alias("text"))
    profiles = cut(_profiles(texts, size))
    profiles, counts = profiles.where("bucket IS NULL"), profiles.where("bucket IS NOT NULL")
    rows = profiles.select("doc", "n", "f1", "f2", "parts")
    counts = counts.groupBy("bucket").agg(F.sum("hits").alias("hits")).toArrow()
    hits = np.zeros(2 << SKETCH_BITS, np.int64)
    hits[counts["bucket"].to_numpy()] = counts["hits"].to_numpy()
    # Parts travel with a class once; equal sets have equal parts.
    reps = rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc").alias("doc"), F.first("parts").alias("parts"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))
    order = zlib.compress(_ranks(hits).tobytes())

    def prefixes(sets: list[np.ndarray], ranks: np.ndarray) -> list[np.ndarray]:
        return [s[: t.probe(len(s))] for s in _ordered(sets, ranks)]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.frombuffer(zlib.decompress(order), U)
        for _, data, offsets in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(prefixes(shingle_sets(data, offsets, size), ranks)))], names=["token"])

    shared = cut(texts.mapInArrow(tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token"))
    packed = _filter_bits(shared, "token")

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, wanted = np.frombuffer(zlib.decompress(order), U), _Filter(packed)
        for step, data, offsets in steps(batches, "text"):
            sets = shingle_sets(data, offsets, size)
            heads = prefixes(sets, ranks)
            lengths = np.array([len(h) for h in heads])
            token = np.concatenate(heads)
            at = np.flatnonzero(wanted(token))
            owner = np.repeat(np.arange(len(heads)), lengths)[at]
            pos = (at - (np.cumsum(lengths) - lengths)[owner]).astype(np.int32)
            doc, f1 = step.column(0).to_numpy(zero_copy_only=False), _fingerprints(sets)[0]
            yield pa.RecordBatch.from_arrays([_signed(token[at]), pa.array(doc[owner]), _signed(f1[owner]), pa.array(pos)], names=["token", "doc", "f1", "pos"])

    lists = cut(texts.mapInArrow(postings, "token long, doc long, f1 long, pos int").join(reps.select("doc", "f1", "node"), ["doc", "f1"]).select("token", "node", "pos").distinct())
    # Shingles with the same documents serve alike: the rarest of them, which stands first in all, is kept.
    alike = lists.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2")).where("c > 1")
    kept = cut(alike.groupBy("c", "s1", "s2").agg(F.min("token").alias("token")).select("token", "c"))
    live = cut(lists.join(kept, "token"))
    release(lists, kept, shared)
    heads = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), 1, FIRST)
    sizes = reps.select("node", F.col("n").cast("long").alias("n"), "parts")
    nodes = cut(live.groupBy("node").agg(F.sum(F.log2("c")).alias("central"), heads.alias("first")).join(sizes, "node"))
    bare, live = live, cut(live.select("token", "node", "pos").join(nodes.select("node", "n", "central"), "node"))
    release(bare)

    links, comps, seen, entries = None, None, None, live.count()
    major, left = None, None
    for salt in range(MOST_ROUNDS):
        mine = _with_comp(live, comps)
        pairs = cut(_hub_pairs(mine, t, salt) if seen is None else _hub_pairs(mine, t, salt).join(seen, ["a", "b"], "left_anti"))
        found = _verified(pairs, texts, profiles, reps, t, size)
        seen = pairs if seen is None else seen.union(pairs)
        links = found if links is None else links.union(found)
        some = not found.isEmpty()
        before, comps = comps, connected_components(links) if some or comps is None else comps
        release(before if before is not comps else None, major)
        major, left = _mixed(_with_comp(live, comps))
        if left <= LEFT_PER_POSTING * entries or not some:
            break
    if left:
        pairs = cut(_remaining_pairs(_with_comp(live, comps), major, nodes.select("node", "first", "parts"), t).join(seen, ["a", "b"], "left_anti"))
        found = _verified(pairs, texts, profiles, reps, t, size)
        if not found.isEmpty():
            comps = connected_components(links.union(found))
    classes = reps.select("node", "doc", "n", "f1", "f2").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = cut(classes.groupBy("comp").agg(F.min("doc").alias("least")))
    named = cut(classes.join(smallest, "comp").select("n", "f1", "f2", "least"))
    out = rows.select("doc", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    real = lambda c: F.when(c != NULL_KEY, c)
    return out.select(real(F.col("doc")).alias(key), F.col("n").cast("long").alias("n_shingles"), real(F.coalesce("least", "doc")).alias("component_id"))
