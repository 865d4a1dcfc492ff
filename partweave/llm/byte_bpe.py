"""Byte-level BPE encoding and decoding by the tokenizers library over Arrow batches.

Ranks of a .tiktoken file become a BPE model of the library whose alphabet is one character per byte,
so the library's character offsets are byte offsets. Text is cut into pretokens by the parallel
transducer of ``pretokens``; each distinct pretoken of a step goes to the library once, all of them as
one delimited input, and the offsets in its result tell which tokens belong to which pretoken. The
ids of whole texts are then gathered. Decoding looks each id's bytes up in a table and joins them
before any character is read, so characters split between tokens come out whole.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import prepare
from partweave.llm.kernels import give_back, kept, span_hashes, steps
from partweave.llm.pretokens import classes_from, pretokens
from partweave.llm.token_counts import byte_characters

#: Ids and pretokens that a worker remembers; beyond that it starts anew, with the same results.
MOST_IDS, MOST_WORDS = 1_000_000, 200_000

_RAW = np.random.Generator(np.random.PCG64(20240302)).integers(1, 2**63, 256, dtype=np.uint64)
#: Delimits pretokens in the library's input; not in the byte alphabet.
_DELIMITER = " "


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


class Codec:
    """Encoder and decoder of one rank file, built in each worker from the file's contents."""

    def __init__(self, ranks: bytes, table: bytes):
        from tokenizers import Tokenizer, models, pre_tokenizers

        rows = [line.split() for line in zlib.decompress(ranks).splitlines() if line]
        words = {base64.b64decode(w): int(i) for w, i in rows}
        chars = byte_characters()
        spell = lambda w: "".join(chars[b] for b in w)
        # Any two tokens that spell a third merge at its rank, leftmost pair first, as a rank file means it.
        merges = [(spell(w[:k]), spell(w[k:])) for w in sorted(words, key=words.get) for k in range(1, len(w)) if w[:k] in words and w[k:] in words]
        self.model = Tokenizer(models.BPE({spell(w): i for w, i in words.items()}, merges))
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_DELIMITER)
        self.chars = chars
        self.characters = np.array([ord(c) for c in chars], np.uint32)
        self.whole = {w for w in words if len(w) > 1}
        self.words = words
        size = max(words.values()) + 1
        spelled = [b""] * size
        for w, i in words.items():
            spelled[i] = w
        self.lengths = np.array([len(w) for w in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.table = np.frombuffer(zlib.decompress(table), np.uint8)
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.begin, self.count, self.flat, self.used, self.rows = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.uint32), 0, 0

    def learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        """Encodes new pretokens in one call of the library and remembers their ids."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        text = self.characters[np.frombuffer(b"\0".join(pieces), np.uint8)]
        text[(begins[1:] - 1)] = ord(_DELIMITER)
        made = self.model.encode(text.tobytes().decode("utf-32-le"), add_special_tokens=False)
        ids, at = np.array(made.ids, np.uint32), np.array([a for a, _ in made.offsets], np.int64)
        first = np.searchsorted(at, np.append(begins, len(text)))
        counts = np.diff(first)
        # Ranks take a pretoken that is a token as it is, whether or not merges lead to it.
        for i, p in enumerate(pieces):
            if counts[i] > 1 and p in self.whole:
                ids[first[i]], counts[i] = self.words[p], 1
        need, rows = self.used + len(ids), self.rows + len(pieces)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.uint32)])
        if rows > len(self.begin):
            more = np.zeros(max(rows, len(self.begin)), np.int64)
            self.begin, self.count = np.concatenate([self.begin, more]), np.concatenate([self.count, more])
        self.flat[self.used : need] = ids
        self.begin[self.rows : rows], self.count[self.rows : rows] = first[:-1] + self.used, counts
        self.known.update(zip(hashes, range(self.rows, rows), strict=True))
        self.used, self.rows = need, rows

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of ids before each text (one more than texts)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, first = pretokens(data, offsets, self.table)
        ends = np.append(starts[1:], len(data))
        which, places, inverse = np.unique(span_hashes(_RAW[data], starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > MOST_WORDS or self.used > MOST_IDS:
            self.reset()
        raw, new, pieces = data.tobytes(), [], []
        for h, p in zip(which.tolist(), places.tolist(), strict=True):
            if h not in self.known:
                new.append(h)
                pieces.append(raw[starts[p] : ends[p]])
        if new:
            self.learn(new, pieces)
        rows = np.fromiter((self.known[h] for h in which.tolist()), np.int64, len(which))[inverse]
        lengths = self.count[rows]
        return _gather(self.flat, self.begin[rows], lengths), np.concatenate([[0], np.cumsum(lengths)])[first]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and the number of bytes before each text."""
        lengths = self.lengths[ids]
        return _gather(self.bytes, self.starts[ids], lengths), np.concatenate([[0], np.cumsum(lengths)])[bounds]

    def encode_checked(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, bounds and decoded bytes; where the round trip fails (two pretokens with one hash) it encodes anew with an empty memory."""
        ids, bounds = self.encode(data, offsets)
        decoded, ends = self.decode(ids, bounds)
        if not (np.array_equal(ends, offsets) and np.array_equal(decoded, data)):
            if len(offsets) > 2:
                parts = [self.encode_checked(data[a:b], np.array([0, b - a])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                sizes = np.cumsum([0, *(len(p[0]) for p in parts)])
                return np.concatenate([p[0] for p in parts]), sizes, np.concatenate([p[2] for p in parts])
            self.reset()
            ids, bounds = self.encode(data, offsets)
            decoded, ends = self.decode(ids, bounds)
            if not np.array_equal(decoded, data):
                raise ValueError("the ids of a text do not decode to it")
        return ids, bounds, decoded


OWNER = "byte_bpe"


def _codec(ranks: bytes, table: bytes) -> Codec:
    name, store = sha256(ranks).hexdigest(), kept(OWNER)
    if name not in store:
        store[name] = Codec(ranks, table)
    return store[name]


def library_classes() -> bytes:
    """The symbol table as tiktoken's own regular expressions see each code point."""
    import tiktoken

    def found(pattern: str, text: str) -> list[int]:
        # What a pattern does not match is dropped: the bytes that come back are the class, in order of code points.
        one = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        kept = set(bytes(one.encode_ordinary(text)).decode())
        return [k for k, c in enumerate(text) if c in kept]

    return classes_from(found)


def _packed(rank_file: str) -> bytes:
    with open(rank_file, "rb") as f:
        return zlib.compress(f.read())


def encode_texts(docs: DataFrame, rank_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, ``ids`` (array of int), ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    ``rank_file``: a .tiktoken file, read by the driver. No special tokens are added or recognised. The
    two digests are those of the ids as little-endian unsigned 32-bit integers, and of the bytes that
    the ids decode to, which are checked to be the text's. Null and empty texts have no ids. Texts of
    any length are encoded whole. Rows with equal keys each get a row. A key must be a number, or text
    that reads as one. Other columns are ignored. An empty table gives no rows.
    """
    ranks, table = _packed(rank_file), library_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, table)
        give_back()
        for rows, data, offsets in steps(batches, "text", owner=OWNER):
            ids, bounds, decoded = codec.encode_checked(data, offsets)
            raw = ids.astype("<u4", copy=False)
            arrays = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            digests = [[sha256(x[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] for x, at in ((raw, bounds), (decoded, offsets))]
            yield pa.RecordBatch.from_arrays([rows.column(0), arrays, pa.array(np.diff(bounds)), *map(pa.array, digests)], names=[key, "ids", "n_tokens", "ids_sha256", "decoded_sha256"])
            del rows, data, offsets, ids, bounds, decoded, raw, arrays, digests
        give_back()

    prepare(docs.sparkSession)
    whole = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return whole.mapInArrow(run, f"{key} long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_ids(encoded: DataFrame, rank_file: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` of each row's ids; bytes that are no UTF-8 read as U+FFFD. Null ids give a null text.

    The bytes of all ids of a row are joined before they are read, so a character whose bytes lie in
    several tokens is whole. An id outside the vocabulary raises.
    """
    ranks, table = _packed(rank_file), library_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, table)
        for batch in batches:
            texts = [None if x is None else codec.decode(y := np.array(x, np.int64), np.array([0, len(y)]))[0].tobytes().decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    prepare(encoded.sparkSession)
    return encoded.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"{key} long, text string")
