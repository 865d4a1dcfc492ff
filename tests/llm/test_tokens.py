from __future__ import annotations

import base64
import json
import random
import struct
import zlib
from hashlib import sha256
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from partweave.llm.byte_bpe import decode_ids, encode_texts
from partweave.llm.token_counts import CountTransducer, TokenCounter, library_classes, token_counts

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["'", "s", "t", "re", "e", "ve", "l", "ll", " ", "  ", "\n", "\t", "1", "é", "中", "!", " ", "²", "'s", " '", "😀", "\r\n", "<|endoftext|>", "<|endo", "aa", "==", "the", "ing", "\0"]


@pytest.fixture(scope="module")
def strange(spark):
    r = random.Random(7)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 50))) for _ in range(600)] + ["a" * n for n in range(0, 200, 7)] + [None, "", " " * 50, "é" * 333]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_counts_as_the_library(strange, documents, messy):
    library = Tokenizer.from_file(JSON)
    for df in (strange, documents.select("doc_id", "text"), messy.where("doc_id IS NOT NULL")):
        want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect()}
        got = token_counts(df, JSON).collect()
        assert {r.doc_id: r.n_tokens for r in got} == want and all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_very_many_special_strings(spark):
    """One pass however many there are; overlapping ones as the library takes them."""
    spec = json.loads(Path(JSON).read_text())
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "special": False}
    spec["added_tokens"] += [{"id": 50257 + i, "content": w, "normalized": n, **plain} for i, (w, n) in enumerate((("<|end", False), ("text|><", True), ("b<|endof", False)))]
    counter, library = TokenCounter(zlib.compress(json.dumps(spec).encode()), library_classes()), Tokenizer.from_str(json.dumps(spec))
    texts = ["<|endoftext|>", "<|endo", "ftext|>", "", "a<|endoftext|><|endoftext|> b<|endoftext", "ab<|endoftext|><|end<|endoftext|><x text|><", "b<|endof<|endoftext|>"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    assert counter.counts(data, offsets).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    df = spark.createDataFrame([(1, "<|endoftext|>" * 1_000_000)], "doc_id long, text string")
    assert token_counts(df, JSON).first().n_tokens == 1_000_000


def test_transducer_on_its_own():
    t = CountTransducer([(b"a", b"b"), (b"ab", b"c"), (b"b", b"c"), (b"a", b"a"), (b"aa", b"a")])
    for word in (b"", b"abc", b"aabcbcaaab", b"aaaaaaa", b"bcbcbc", b"xyz"):
        assert t.count(word) == len(t.encode(word))


def test_encoding_as_tiktoken_and_round_trip(strange, documents, messy):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (strange, documents.select("doc_id", "text"), messy.where("doc_id IS NOT NULL")):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        encoded = encode_texts(df, RANKS)
        got = encoded.collect()
        assert len(got) == len(texts)
        for r in got:
            ids = library.encode_ordinary(texts[r.doc_id])
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()
        assert {r.doc_id: r.text for r in decode_ids(encoded, RANKS).collect()} == texts


def test_empty_tables(empty):
    assert token_counts(empty, JSON).count() == 0 and encode_texts(empty, RANKS).count() == 0


def test_split_characters(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    parts = [ranks[bytes([b])] for b in "😀".encode()]
    df = spark.createDataFrame([(1, parts), (2, parts[:2]), (3, None), (4, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode_ids(df, RANKS).collect()} == {1: "😀", 2: "�", 3: None, 4: ""}
