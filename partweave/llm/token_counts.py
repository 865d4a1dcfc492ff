"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers run one after the other. The first cuts text into pretokens; its chunk
state maps are composed by a parallel prefix scan (``pretokens``). The second reads the bytes of a
pretoken and annotates each transition with the change in the number of tokens emitted so far; it is
determinised state by state as texts need it. It rests on a property of byte-pair encoding: the
encoding of a prefix ends in the one token t such that the encoding of the rest ends in a token p for
which the pair (p, t) encodes to itself. So a state only holds the longest suffix that still begins
some token, and the last tokens and relative counts at its positions.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import prepare
from partweave.llm.kernels import kept, span_hashes, steps
from partweave.llm.pretokens import classes_from, pretokens

#: States, pairs and remembered pretokens that a worker keeps; beyond that it starts anew, with the same results.
MOST_STATES, MOST_PAIRS, MOST_WORDS = 300_000, 1_000_000, 600_000
#: Token number limit of the contract's flag.
LIMIT = 1024

_RAW = np.random.Generator(np.random.PCG64(20240301)).integers(1, 2**63, 256, dtype=np.uint64)


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class CountTransducer:
    """Maps the bytes of a pretoken to its number of tokens, one transition for each byte."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        never = len(merges)
        self.merged: dict[tuple[int, int], int] = {}
        self.ids = {bytes([b]): b for b in range(256)}
        words = [bytes([b]) for b in range(256)]
        # Of a token's spines, each piece with the rank of the merge that ends it: last pieces first, and first pieces.
        last: list[list[tuple[int, int]]] = [[(b, never)] for b in range(256)]
        first: list[list[tuple[int, int]]] = [[(b, never)] for b in range(256)]
        for rank, (left, right) in enumerate(merges):
            pair = self.ids[left], self.ids[right]
            self.merged.setdefault(pair, rank)
            if left + right not in self.ids:
                new = self.ids[left + right] = len(words)
                words.append(left + right)
                last.append([(new, never)] + [(p, rank if i == 0 else end) for i, (p, end) in enumerate(last[pair[1]])])
                first.append([(new, never)] + [(p, rank if i == 0 else end) for i, (p, end) in enumerate(first[pair[0]])])
        self.words, self.last, self.first = words, last, first
        self.ids = {w: i for w, i in self.ids.items() if len(w) == 1 or self.encode(w) == [i]}
        self.begins = {w[:k] for w in self.ids for k in range(len(w) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.plans: dict[tuple[bytes, int], tuple] = {}
        self.reset()

    def reset(self) -> None:
        # A state: the longest suffix that begins a token, and for each of its own suffixes that does, from the
        # longest to the empty one, the last token before it and the count there relative to the end.
        start = (b"", ((-1, 0),))
        self.states, self.known, self.next = [start], {start: 0}, [{}]

    def encode(self, word: bytes) -> list[int]:
        """Plain byte-pair encoding, to compile the transducer with."""
        all_ids = self.all_ids = getattr(self, "all_ids", None) or {w: i for i, w in enumerate(self.words)}
        parts, none = [*word], 1 << 60
        while len(parts) > 1:
            rank, at = min((self.merged.get(pair, none), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == none:
                break
            parts[at : at + 2] = [all_ids[self.words[parts[at]] + self.words[parts[at + 1]]]]
        return parts

    def agree(self, a: int, b: int) -> bool:
        """Whether a and b side by side encode to themselves: no merge across comes before the merges that build them."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            merged, known = self.merged, True
            for x, x_end in self.last[a]:
                for y, y_end in self.first[b]:
                    rank = merged.get((x, y))
                    # At equal rank the merge further left comes first.
                    if rank is not None and rank < x_end and rank <= y_end:
                        known = False
                        break
            self.pairs[a, b] = known
        return known

    def plan(self, suffix: bytes, byte: int) -> tuple:
        """What a suffix and a byte decide for all states: places with a token that ends here, places that go on, and the new suffix."""
        places = [k for k in range(len(suffix) + 1) if suffix[k:] in self.begins]
        longer = suffix + bytes([byte])
        ends = [(i, self.ids[longer[k:]]) for i, k in enumerate(places) if longer[k:] in self.ids]
        goes = [i for i, k in enumerate(places) if longer[k:] in self.begins]
        self.plans[suffix, byte] = found = (ends, goes, longer[places[goes[0]] :] if goes else b"")
        return found

    def transition(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change of the count; compiled once."""
        suffix, tail = self.states[state]
        ends, goes, longer = self.plans.get((suffix, byte)) or self.plan(suffix, byte)
        for i, token in ends:
            before, count = tail[i]
            if before < 0 or self.agree(before, token):
                break
        else:
            raise ValueError(f"no token ends {suffix!r} and byte {byte}")
        delta = count + 1
        reached = (longer, (*[(tail[i][0], tail[i][1] - delta) for i in goes], (token, 0)))
        at = self.known.get(reached)
        if at is None:
            at = self.known[reached] = len(self.states)
            self.states.append(reached)
            self.next.append({})
        self.next[state][byte] = found = (at, delta)
        return found

    def count(self, word: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.reset()
        state = total = 0
        for byte in word:
            step = self.next[state].get(byte)
            state, delta = step if step is not None else self.transition(state, byte)
            total += delta
        return total


class TokenCounter:
    """Counts tokens of many texts; built in each worker from the tokenizer file's contents."""

    def __init__(self, model: bytes, table: bytes):
        spec = json.loads(zlib.decompress(model))
        back = {c: b for b, c in enumerate(byte_characters())}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.transducer = CountTransducer([tuple(bytes(back[c] for c in part) for part in m) for m in merges])
        # The library looks for strings that stand for themselves first, then, in what is left, for those of the normalized text.
        added = spec.get("added_tokens") or []
        kinds = [[t["content"].encode() for t in added if bool(t.get("normalized")) is kind and t["content"]] for kind in (False, True)]
        # Longer ones first: of those that match at one place the longest does.
        self.specials = [re.compile(b"|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))) for words in kinds if words]
        self.table = np.frombuffer(zlib.decompress(table), np.uint8)
        self.known: dict[int, int] = {}

    def split_specials(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Borders of the stretches between special strings, and which stretches are such strings: one pass, leftmost and longest first."""
        raw, borders, starts = data.tobytes(), offsets.astype(np.int64), np.zeros(0, np.int64)
        for pattern in self.specials:
            plain = ~np.isin(borders[:-1], starts)
            found = [m.span() for a, b in zip(borders[:-1][plain].tolist(), borders[1:][plain].tolist(), strict=True) for m in pattern.finditer(raw, a, b)]
            if found:
                spans = np.array(found, np.int64)
                borders, starts = np.union1d(borders, spans.ravel()), np.union1d(starts, spans[:, 0])
        borders = np.unique(borders)
        return borders, np.isin(borders[:-1], starts)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        borders, special = self.split_specials(data, offsets)
        starts, first = pretokens(data, borders, self.table)
        ends = np.append(starts[1:], len(data))
        which, places, inverse = np.unique(span_hashes(_RAW[data], starts, ends), return_index=True, return_inverse=True)
        numbers = np.zeros(len(which), np.int64)
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        for i, h in enumerate(which.tolist()):
            n = self.known.get(h)
            if n is None:
                p = places[i]
                n = self.known[h] = self.transducer.count(data[starts[p] : ends[p]].tobytes())
            numbers[i] = n
        sums = np.concatenate([[0], np.cumsum(numbers[inverse])])
        stretch = np.where(special, 1, np.diff(sums[first]))
        totals = np.concatenate([[0], np.cumsum(stretch)])
        return np.diff(totals[np.searchsorted(borders, offsets)])


OWNER = "token_counts"


def _counter(model: bytes, table: bytes) -> TokenCounter:
    name, store = sha256(model).hexdigest(), kept(OWNER)
    if name not in store:
        store[name] = TokenCounter(model, table)
    return store[name]


def library_classes() -> bytes:
    """The symbol table as the tokenizers library's own regular expressions see each code point."""
    from tokenizers import Regex, pre_tokenizers

    def found(pattern: str, text: str) -> list[int]:
        split = pre_tokenizers.Split(Regex(f"[^{pattern}]"), "removed").pre_tokenize_str(text)
        return [k for _, (a, b) in split for k in range(a, b)]

    return classes_from(found)


def token_counts(docs: DataFrame, tokenizer_file: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """One row per document: ``key``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``tokenizer_file``: a byte-level BPE of the tokenizers library (.json); the driver reads it, so
    executors need no such file. The special strings it lists count one token each inside texts, as the
    library does by default; none are added. Null and empty texts have no bytes and no tokens. Texts of
    any length are counted whole. Rows with equal keys each get a row. A key must be a number, or text
    that reads as one. Other columns are ignored. An empty table gives no rows.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    made = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or any(made.get(k) != v for k, v in plain.items()) or spec["model"].get("ignore_merges"):
        raise ValueError("only byte-level BPE files without normalizer are compiled")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or []):
        raise ValueError("special strings that take neighbouring characters are not compiled")
    spec["model"].pop("vocab", None)
    model, table = zlib.compress(json.dumps(spec).encode()), library_classes()
    schema = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model, table)
        for rows, data, offsets in steps(batches, "text", owner=OWNER):
            n = counter.counts(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], schema=schema)

    prepare(docs.sparkSession)
    whole = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return whole.mapInArrow(count, f"{key} long, n_bytes long, n_tokens long, over_limit boolean")
