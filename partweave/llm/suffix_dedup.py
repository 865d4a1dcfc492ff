"""Removal of repeated passages by longest-previous-factor arrays over suffixes that may have a match.

What two places share is judged by its strings of ``LENGTH`` bytes, wherever they start. Of the grams of
``GRAM`` bytes inside such a string the one with the smallest hash, and the leftmost of several, is its
anchor. That depends on the string alone, so equal strings have equal anchors; neighbouring strings mostly
share theirs, and the bytes of a stretch of them are one context. Contexts with equal bytes are one class.
A class with several occurrences is repeated as a whole; a class whose anchor no other class has is alone.

Only the classes that share an anchor with others are compared string by string. Each such group is a
small text of its own: its suffixes are sorted by their first ``LENGTH`` bytes, common prefixes of
neighbours are measured, and the previous and the next smaller position in suffix order give each suffix
its longest earlier match and where that is. Groups of more than ``MOST_CLASSES`` classes (an anchor that
very many places share) are too large for one task. Their contexts are cut into pieces of ``STEP`` starts,
counted from the anchor, and the same is done once more: equal pieces are one class, a piece whose common
bytes no other piece has is alone, and of what is left the strings are compared by two independent 64-bit
hashes, summed on the map side. The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import cut, prepare, release, whole_text
from partweave.llm.kernels import U, mix, span_hashes, steps, text_bytes

LENGTH, GRAM = 400, 128
#: Classes of one anchor that one task sorts together, and suffixes of one sort.
MOST_CLASSES, MOST_SUFFIXES = 256, 30_000
#: Starts of a piece of a context.
STEP = 8
#: Strings of a long text that are anchored in one step, and the bits that their places take.
PIECE, PLACE_BITS = 1 << 19, 20

_RAW, _RAW2 = np.random.Generator(np.random.PCG64(20240312)).integers(1, 2**63, (2, 256), dtype=np.uint64)


def anchored(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first start, last start, place and hash of the anchor of each stretch of strings with one anchor."""
    if len(data) < length:
        return (*(np.zeros(0, np.int64),) * 4, np.zeros(0, U))
    places = np.arange(len(data) - gram + 1)
    hashes = span_hashes(_RAW[data], places, places + gram)
    mask = U((1 << PLACE_BITS) - 1)
    low, size, wide = (hashes & ~mask) | places.astype(U), 1, length - gram + 1
    while size * 2 <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < wide:
        low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    starts = np.flatnonzero(offsets[owner + 1] - np.arange(len(low)) >= length)
    if not len(starts):
        return (*(np.zeros(0, np.int64),) * 4, np.zeros(0, U))
    chosen, owner = (low[starts] & mask).astype(np.int64), owner[starts]
    first = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])))
    return owner[first], starts[first], starts[np.append(first[1:], len(starts)) - 1], chosen[first], hashes[chosen[first]]


def suffix_factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest-previous-factor array of the suffixes at ``starts``, to ``length`` at most, and where each factor's earlier match is.

    Suffixes are compared by their first ``length`` bytes; earlier is what stands before in ``starts``.
    """
    n = len(starts)
    suffixes = np.ndarray((len(data) - length + 1,), f"S{length}", data, strides=(1,))[starts]
    order = np.argsort(suffixes, kind="stable")
    letters = suffixes[order].view(np.uint8).reshape(n, length)
    differ = letters[1:] != letters[:-1]
    common = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), length)])

    def smaller(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the order the nearest one before it with a smaller position (-1: none) and their common prefix."""
        before, shared = np.arange(n) - 1, common.copy()
        open_ = np.flatnonzero((before >= 0) & (order[before] > order))
        while len(open_):
            over = before[open_]
            shared[open_], before[open_] = np.minimum(shared[open_], shared[over]), before[over]
            open_ = open_[(before[open_] >= 0) & (order[before[open_]] > order[open_])]
        return before, np.where(before >= 0, shared, 0)

    previous, left = smaller(order, common)
    # The next smaller position is the previous one of the reversed order.
    following, right = (x[::-1] for x in smaller(order[::-1], np.concatenate([[0], common[:0:-1]])))
    following = n - 1 - following
    factor, source = np.zeros(n, np.int64), np.full(n, -1)
    factor[order] = np.maximum(left, right)
    source[order] = np.where(left >= right, order[previous], order[np.minimum(following, n - 1)])
    source[factor == 0] = -1
    return factor, source


def _spans(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and end of each run of flags; those of owner k are from ``first[k]`` to ``first[k + 1]``, and runs end there."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[first] = True
    begin = np.flatnonzero(flags & np.append(True, ~flags[:-1] | edge[1:-1]))
    end = np.flatnonzero(flags & np.append(~flags[1:] | edge[1:-1], True)) + 1
    owner = np.searchsorted(first, begin, "right") - 1
    return owner, begin - first[owner], end - first[owner]


def _rows_of_spans(owner: np.ndarray, begin: np.ndarray, end: np.ndarray, f1: list[int], f2: list[int]) -> pa.RecordBatch:
    has, at = np.unique(owner, return_index=True)
    spans = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["a", "e"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(owner)).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([pa.array([f1[k] for k in has.tolist()], pa.int64()), pa.array([f2[k] for k in has.tolist()], pa.int64()), lists], names=["f1", "f2", "spans"])


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, keep_first: bool = True, gram: int = GRAM, most_classes: int = MOST_CLASSES) -> DataFrame:
    """``doc``, ``fp``, ``spans`` (bytes from ``a`` until ``e``, may overlap, in any order) of each text that has a repeated string.

    With ``keep_first`` a string's first occurrence, by key, hash of the text and place, is left alone.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(whole_text(text)).alias("fp"), whole_text(text).cast("binary").alias("text"))
    able = texts.where(F.octet_length("text") >= length)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            for skip in range(0, max(len(data) - length + 1, 1), PIECE) if rows.num_rows == 1 else [0]:
                part = data[skip : skip + PIECE + length - 1] if rows.num_rows == 1 else data
                bounds = np.array([0, len(part)]) if rows.num_rows == 1 else offsets
                owner, low, high, at, name = anchored(part, bounds, length, gram)
                f1, f2 = (span_hashes(raw[part], low, high + length).view(np.int64) for raw in (_RAW, _RAW2))
                place, take = low - bounds[owner] + skip, pa.array(owner)
                arrays = [rows.column(0).take(take), rows.column(1).take(take), pa.array(place.astype(np.int32)), pa.array((high - low + 1).astype(np.int16)), pa.array((at - low).astype(np.int16)), *map(pa.array, (name.view(np.int64), f1, f2))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "fp", "low", "starts", "back", "anchor", "f1", "f2"])

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(groups: list[pa.Array]) -> pa.RecordBatch:
            members = pa.concat_arrays(groups)
            data, offsets = text_bytes(members.field("context"))
            counts = np.diff(offsets) - length + 1
            first = np.concatenate([[0], np.cumsum(counts)])
            starts = np.arange(first[-1]) + np.repeat(offsets[:-1] - first[:-1], counts)
            factor, source = suffix_factors(np.ascontiguousarray(data), starts, length)
            flags = factor >= length
            if not keep_first:
                flags[source[flags]] = True
            flags &= np.repeat(np.asarray(members.field("open")), counts)
            return _rows_of_spans(*_spans(flags, first), members.field("f1").to_pylist(), members.field("f2").to_pylist())

        for batch in batches:
            held, size = [], 0
            for k in range(batch.num_rows):
                held.append(batch.column(0)[k].values)
                # Suffixes of a group are fewer than its bytes less the length of each context.
                size += sum(n - length + 1 for n in pc.binary_length(held[-1].field("context")).to_pylist())
                if size >= MOST_SUFFIXES:
                    yield judged(held)
                    held, size = [], 0
            if held:
                yield judged(held)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, "context"):
            counts = np.diff(offsets) - length + 1
            back, anchor = (np.asarray(rows.column(rows.schema.get_field_index(c))).astype(np.int64) for c in ("back", "anchor"))
            # Piece p has the starts that stand from STEP * p to STEP * p + STEP - 1 bytes before the anchor.
            most, least = back // STEP, (back - counts + 1) // STEP
            owner = np.repeat(np.arange(rows.num_rows), most - least + 1)
            p = np.repeat(most, most - least + 1) - (np.arange(len(owner)) - np.repeat(np.cumsum(most - least + 1) - (most - least + 1), most - least + 1))
            last = back[owner] - STEP * p
            begin, end = np.maximum(last - STEP + 1, 0), np.minimum(last + 1, counts[owner])
            at = offsets[owner]
            core = mix(span_hashes(_RAW[data], at + last, at + last - STEP + 1 + length) + mix(anchor[owner].view(U) + p.astype(U)))
            whole = (mix(span_hashes(raw[data], at + begin, at + end - 1 + length)).view(np.int64) for raw in (_RAW, _RAW2))
            kept = (rows.column(rows.schema.get_field_index(c)).take(pa.array(owner)) for c in ("doc", "fp", "low", "f1", "f2", "open"))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(core.view(np.int64)), *map(pa.array, whole)], names=["doc", "fp", "low", "f1", "f2", "open", "a", "e", "core", "g1", "g2"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, "context"):
            counts = np.diff(offsets) - length + 1
            owner = np.repeat(np.arange(rows.num_rows), counts)
            own = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = offsets[owner] + own
            w1, w2 = (mix(span_hashes(raw[data], starts, starts + length)).view(np.int64) for raw in (_RAW, _RAW2))
            kept = (rows.column(rows.schema.get_field_index(c)).take(pa.array(owner)) for c in ("doc", "fp", "low", "f1", "f2", "open"))
            begin = np.asarray(rows.column(rows.schema.get_field_index("a")))[owner]
            yield pa.RecordBatch.from_arrays([*kept, pa.array((begin + own).astype(np.int32)), pa.array(w1), pa.array(w2)], names=["doc", "fp", "low", "f1", "f2", "open", "s", "w1", "w2"])

    def spans_of_large(large: DataFrame) -> DataFrame:
        """``f1``, ``f2``, ``spans`` of the contexts whose anchor too many classes share."""
        cut_up = cut(large.mapInArrow(pieces, "doc long, fp long, low int, f1 long, f2 long, open boolean, a int, e int, core long, g1 long, g2 long"))
        whole = F.struct("doc", "fp", "low", "a", "e", "f1", "f2", "open")
        kinds = cut(cut_up.groupBy("core", "g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.min(whole).alias("first")))
        again = cut_up.where("open").join(kinds.where("n > 1").select("core", "g1", "g2", F.col("first.doc").alias("_d"), F.col("first.fp").alias("_p"), F.col("first.low").alias("_l")).hint("merge"), ["core", "g1", "g2"])
        if keep_first:
            again = again.where(~F.struct("doc", "fp", "low").eqNullSafe(F.struct("_d", "_p", "_l")))
        several = again.groupBy("f1", "f2").agg(F.collect_set(F.struct("a", "e")).alias("spans"))
        shared = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("core")
        left = kinds.join(shared.hint("merge"), "core").select("first.*", (F.col("first.open") & (F.lit(True) if keep_first else F.col("n") == 1)).alias("wanted")).drop("open").withColumnRenamed("wanted", "open")
        part = F.substring("context", F.col("a") + 1, F.col("e") - F.col("a") + F.lit(length - 1)).alias("context")
        parts = left.join(large.select("f1", "f2", "context").hint("merge"), ["f1", "f2"]).select("doc", "fp", "low", "f1", "f2", "open", "a", part)
        strings = cut(parts.mapInArrow(windows, "doc long, fp long, low int, f1 long, f2 long, open boolean, s int, w1 long, w2 long"))
        at = F.struct("doc", "fp", (F.col("low") + F.col("s")).alias("at"))
        twice = cut(strings.groupBy("w1", "w2").agg(F.min(at).alias("least"), F.max(at).alias("most")).where("NOT least <=> most").select("w1", "w2", "least"))
        marked = strings.where("open").join(twice.hint("merge"), ["w1", "w2"])
        if keep_first:
            marked = marked.where(~at.eqNullSafe(F.col("least")))
        single = marked.groupBy("f1", "f2").agg(F.collect_set(F.struct(F.col("s").alias("a"), (F.col("s") + 1).alias("e"))).alias("spans"))
        return several.unionByName(single)

    occurrences = cut(able.mapInArrow(anchors, "doc long, fp long, low int, starts short, back short, anchor long, f1 long, f2 long"))
    place = F.struct("doc", "fp", "low")
    classes = cut(occurrences.groupBy("anchor", "f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max("starts").alias("starts"), F.max("back").alias("back")))
    groups = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")).where("classes > 1" if keep_first else "classes > 1 AND least = 1")
    # ``open``: whether the class itself still needs a verdict.
    contested = classes.join(groups, "anchor").select("anchor", "f1", "f2", "first", "starts", "back", "classes", (F.lit(True) if keep_first else F.col("n") == 1).alias("open"))
    own = contested.select("first.*", "anchor", "f1", "f2", "starts", "back", "classes", "open").hint("merge")
    found = own.join(able.withColumnRenamed("doc", "_doc"), F.col("doc").eqNullSafe(F.col("_doc")) & (own["fp"] == able["fp"]))
    context = F.substring(able["text"], F.col("low") + 1, F.col("starts") + F.lit(length - 1)).alias("context")
    contexts = cut(found.select("doc", own["fp"], "low", "f1", "f2", "open", "back", "anchor", "classes", context))

    small = contexts.where(F.col("classes") <= most_classes).groupBy("anchor").agg(F.sort_array(F.collect_set(F.struct("doc", "fp", "low", "f1", "f2", "open", "context"))).alias("members"))
    spans = small.select("members").mapInArrow(factors, "f1 long, f2 long, spans array<struct<a:int,e:int>>")
    large = contexts.where(F.col("classes") > most_classes)
    if not large.isEmpty():
        # Pieces and strings may both say something of one class.
        spans = spans.unionByName(spans_of_large(large.dropDuplicates(["f1", "f2"]))).groupBy("f1", "f2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    judged = classes.select("f1", "f2", "n", "first", "starts").join(spans, ["f1", "f2"], "left").where("n > 1 OR spans IS NOT NULL")
    verdicts = cut(judged)
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("v.starts").cast("int").alias("e")))
    is_first = F.struct("o.doc", "o.fp", "o.low").eqNullSafe(F.struct("v.first.doc", "v.first.fp", "v.first.low"))
    mine = F.when(is_first, F.col("v.spans")).otherwise(whole) if keep_first else F.when(F.col("v.n") > 1, whole).otherwise(F.col("v.spans"))
    joined = occurrences.alias("o").join(verdicts.hint("merge").alias("v"), (F.col("o.f1") == F.col("v.f1")) & (F.col("o.f2") == F.col("v.f2")))
    covered = F.transform(mine, lambda x: F.struct((F.col("o.low") + x["a"]).alias("a"), (F.col("o.low") + x["e"] + F.lit(length - 1)).alias("e")))
    covered = joined.select("o.doc", "o.fp", covered.alias("spans")).where("spans IS NOT NULL")
    # The spans of one text come together here: at most its strings.
    gone = cut(covered.groupBy("doc", "fp").agg(F.flatten(F.collect_set("spans")).alias("spans")))
    release(occurrences, classes, contexts, verdicts)
    return gone


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, keep_first: bool = True, gram: int = GRAM, most_classes: int = MOST_CLASSES) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_bytes``, ``spans`` (removed bytes, from ``a`` until ``e``, apart and in order), ``kept`` (binary, what is left).

    Texts are UTF-8 bytes; what is left may begin or end inside a character. Every byte goes that a string
    of ``length`` bytes covers which starts at another place too, in the same or another text; with
    ``keep_first`` its first occurrence stays. Strings are judged on the texts as given, and no match
    crosses texts. Null counts as empty; texts shorter than ``length`` lose nothing. Rows that repeat
    key and text are copies of each other that share one place: with ``keep_first`` all of them keep what
    one would. A null key comes first; keys must be numbers, or text that reads as one. Other
    columns are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    gone = repeated_spans(docs, text, key, length, keep_first, gram, most_classes)
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(whole_text(text)).alias("fp"), whole_text(text).cast("binary").alias("t"))
    joined = texts.alias("t").join(gone.hint("merge").alias("g"), F.col("t.doc").eqNullSafe(F.col("g.doc")) & (F.col("t.fp") == F.col("g.fp")), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for whole, found in zip(batch.column(1), batch.column(2), strict=True):
                raw = whole.as_py()
                sizes.append(len(raw))
                if not found.is_valid:
                    spans.append([])
                    kept.append(raw)
                    continue
                begin, end = (np.asarray(found.values.field(k)).astype(np.int64) for k in (0, 1))
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                first = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
                begin, end = begin[first].tolist(), end[np.append(first[1:], len(end)) - 1].tolist()
                spans.append([{"a": a, "e": e} for a, e in zip(begin, end, strict=True)])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *end], [*begin, len(raw)], strict=True)))
            pairs = pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("e", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pairs, pa.array(kept, pa.binary())], names=[key, "n_bytes", "spans", "kept"])

    return joined.select("t.doc", "t.t", "g.spans").mapInArrow(remove, f"{key} long, n_bytes long, spans array<struct<a:long,e:long>>, kept binary")
