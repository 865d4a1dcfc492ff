from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from partweave.llm import registry, source_divergence
from partweave.llm.importance_resampling import importance_resample
from partweave.llm.source_divergence import divergence
from partweave.llm.suffix_dedup import remove_repeats, suffix_factors


def brute_spans(rows, length, keep_first):
    """Covered bytes of each row, from every string of every text."""
    seen, whole = collections.defaultdict(list), [(t or "").encode() for _, t in rows]
    for i, raw in enumerate(whole):
        for p in range(len(raw) - length + 1):
            seen[raw[p : p + length]].append((i, p))
    marks = [bytearray(len(raw)) for raw in whole]
    for places in seen.values():
        for i, p in (places[1:] if keep_first else places) if len(places) > 1 else []:
            marks[i][p : p + length] = b"\1" * length
    return whole, marks


def spans_of(mark):
    return [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(mark))]


def random_texts(seed, n, words=9):
    rng = random.Random(seed)
    vocabulary = ["a", "bb", "ccc", "é", "中文", " ", "\n", "aaaa", "x" * 7][:words]
    shared = ["".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(6)]
    return ["".join(rng.choice(shared)[rng.randrange(9) : rng.randrange(30, 80)] if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("most", [1, 4, 256])
def test_repeats_against_brute_force(spark, keep_first, most):
    """Also where every group is too large for one task, and with runs of one character."""
    rows = list(enumerate([*random_texts(1, 40), "a" * 90, "ab" * 60, None, "", "中" * 30]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(docs, length=24, gram=8, keep_first=keep_first, most_classes=most).collect()}
    # With the first kept, texts are read in the order of their keys.
    whole, marks = brute_spans(rows, 24, keep_first)
    for i, _ in rows:
        assert [(x.a, x.e) for x in got[i].spans] == spans_of(marks[i]), i
        assert bytes(got[i].kept) == bytes(b for b, m in zip(whole[i], marks[i], strict=True) if not m) and got[i].n_bytes == len(whole[i])


def test_repeats_query_against_brute_force(spark, sf_dir):
    """The registered query over all documents, by every string of 400 bytes."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    whole = [(t or "").encode() for _, t in rows]
    names = []
    for raw in whole:
        v = np.ndarray((max(len(raw) - 399, 0),), "S400", raw, strides=(1,)) if len(raw) >= 400 else []
        names.append([hash(bytes(x).ljust(400, b"\0")) for x in v])
    counts = collections.Counter(h for own in names for h in own)
    want = {}
    for (i, _), raw, own in zip(rows, whole, names, strict=True):
        mark = np.zeros(len(raw) + 1, int)
        for p, h in enumerate(own):
            if counts[h] > 1:
                mark[p] += 1
                mark[min(p + 400, len(raw))] -= 1
        mark = (np.cumsum(mark)[:-1] > 0).astype(np.uint8)
        want[i] = (len(raw), int(mark.sum()), len(spans_of(mark.tobytes())), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[mark == 0])).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.QUERIES["op12_suffix_dedup"](spark, sf_dir).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_factors_against_a_plain_search():
    rng = np.random.default_rng(3)
    for size, letters in ((80, 2), (120, 3), (60, 1)):
        raw = rng.integers(97, 97 + letters, size).astype(np.uint8)
        text, length = raw.tobytes(), 12
        n = size - length + 1
        factor, source = suffix_factors(raw, np.arange(n), length)
        for i in range(n):
            common = [next((k for k in range(length) if text[i + k] != text[j + k]), length) for j in range(i)]
            assert factor[i] == max(common, default=0)
            assert source[i] == -1 if factor[i] == 0 else (source[i] < i and common[source[i]] == factor[i])


def test_repeats_edges(spark, messy, empty):
    got = remove_repeats(messy, keep_first=False, length=100, gram=32)
    assert got.count() == messy.count() and remove_repeats(empty).count() == 0
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1].kept == by_id[2].kept == by_id[None].kept == b"" and by_id[4].n_bytes == 0 and by_id[11].spans == []
    first = {r.doc_id: r for r in remove_repeats(messy, length=100, gram=32).collect()}
    assert [tuple(x) for x in first[None].spans] == [(148, 296)] and len(first[1].kept) == 0, "a null key comes first; its text says itself twice"
    assert bytes(first[15].kept) != b"" and first[14].spans == [], "a long text"
    twice = {r.doc_id: r.kept for r in remove_repeats(messy.union(messy), length=100, gram=32, keep_first=False).collect()}
    assert bytes(twice[14]) == b""


def plain_divergence(rows, least):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t) for t, _, _ in rows]
    words = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in own] for own in words]
    out = set()
    for lang in {la for _, la, _ in rows}:
        own = [(w, s) for w, (_, la, s) in zip(words, rows, strict=True) if la == lang]
        frequency = collections.Counter(t for w, _ in own for t in set(w))
        kept = sorted((t for t, n in frequency.items() if n >= least), key=str.encode)
        sources = sorted({s for _, s in own})
        count = {s: collections.Counter(t for w, x in own if x == s for t in w if t in set(kept)) for s in sources}
        everything = sum(count.values(), collections.Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        shares, q = {s: p(count[s]) for s in sources}, p(everything)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(shares[s][t], shares[x][t]) for t in kept), x) for x in sources if x != s]
            terms = [(-f(shares[s][t], q[t]), t) for t in kept if count[s][t] and shares[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < 10}
    return out


def test_divergence_against_a_plain_version(spark, empty, monkeypatch):
    monkeypatch.setattr(source_divergence, "MOST_SUMS", 50)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Alpha", "béta", "Écru", "zz", "中文", "x1y", "alpha", "Ω"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = [(t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None])) for t in texts] + [(None, "en", "silent"), ("few words", "xx", "a"), ("", "xx", "b"), ("alone", "yy", "a")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as term", "2 as n", "3 as `value`", "4 as sources")
    got = [tuple(r) for r in divergence(docs, least_docs=5).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, 5)
    assert ("xx", "a", "pair", "b", 0, 1) in got and not any(r[0] == "yy" for r in got)
    assert divergence(empty).count() == 0


def test_divergence_of_messy_rows(messy):
    rows = [(r.text, r.lang, r.source) for r in messy.collect()]
    assert {tuple(r) for r in divergence(messy, least_docs=1).collect()} == plain_divergence(rows, 1)


def test_resampling_against_a_plain_version(spark, messy, empty):
    target = spark.createDataFrame([("the old mill near the town",), (None,), ("perros blancos y gatos",)], "text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    features = lambda t: [zlib.crc32(w.encode()) % 10000 for w in re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    rows = [(r.doc_id, features(r.text)) for r in messy.collect()]
    s, t = (collections.Counter(b for own in x for b in own) for x in ([f for _, f in rows], [features(r.text) for r in target.collect()]))
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (wanted + 10000))))
    scored = []
    for i, f in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        scored.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {r[0]: k + 1 for k, r in enumerate(able[: 40 * len(able) // 100])}
    got = {tuple(r) for r in importance_resample(messy, target, percent=40).collect()}
    assert got == {(*r, rank.get(r[0])) for r in scored} and rank
    assert importance_resample(empty, target).count() == 0
    assert importance_resample(messy, empty).where("rank IS NOT NULL").count() == 10 * len(able) // 100
    doubled = importance_resample(messy.union(messy), target, percent=100).where("rank IS NOT NULL").collect()
    assert sorted(r["rank"] for r in doubled) == list(range(1, 2 * len(able) + 1))


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_importance_resampling"])
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf_dir)
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert collections.Counter(map(tuple, got.select(*columns).collect())) == collections.Counter(want.fetchall())
