from __future__ import annotations

import collections
import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from partweave.llm import exact_dedup, registry
from partweave.llm.components import connected_components
from partweave.llm.exact_dedup import exact_duplicates, keep_one
from partweave.llm.jaccard_join import near_duplicates
from partweave.llm.line_dedup import GRAM_LINES, GRAM_WORDS, WINDOW, dedup_lines


def by_key(df, column, key="doc_id"):
    return {r[key]: r[column] for r in df.collect()}


def test_exact(messy, empty):
    got = exact_duplicates(messy)
    keep = by_key(got, "keep_id")
    assert (keep[1], keep[2], keep[None], keep[3]) == (2, 2, 2, 3) and (keep[4], keep[5], keep[6]) == (5, 5, 6) and keep[8] == 9
    assert by_key(got, "group_size")[1] == 3 and got.count() == messy.count()
    assert exact_duplicates(empty).count() == 0
    kept = keep_one(messy)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 4


def test_exact_reads_and_counts_every_row(spark, messy, monkeypatch):
    """Repeated rows are rows of their own; of those with the key that stays one stays. As brute force and the SQL have it."""
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "a"), (None, "c"), (None, "c"), (None, None), (3, ""), (None, "d"), (None, "d" * 9000), (None, "d" * 9000)]
    monkeypatch.setattr(exact_dedup, "STRETCH", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in exact_duplicates(docs).collect())
    want, kept = collections.Counter(), set()
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True):
        same = [j for j, u in rows if (u or "") == (t or "")]
        top = max((j for j in same if j is not None), default=None)
        first = i == top and (t or "") not in kept
        if first:
            kept.add(t or "")
        want[i, top, len(same), first, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert collections.Counter(con.execute(registry.ORACLES["op2_exact_dedup"]).fetchall()) == want
    assert exact_duplicates(messy.union(messy)).count() == 2 * messy.count()


def test_exact_is_free_of_collisions_and_of_the_block_size(messy):
    want = by_key(exact_duplicates(messy), "keep_id")
    assert by_key(exact_duplicates(messy, block_bytes=16, router=lambda *c: F.xxhash64(*c) % 3), "keep_id") == want


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, least = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}
    changed = True
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    return least, {i: len(s) for i, s in sets}


def test_near_matches_brute_force(documents):
    got = near_duplicates(documents)
    least, sizes = brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert by_key(got, "component_id") == least and by_key(got, "n_shingles") == sizes


def test_near_on_a_large_group_of_close_texts(spark):
    words = [f"w{i}" for i in range(80)]
    texts = [(i, " ".join(words[: i % 70] + [f"x{i}"] + words[i % 70 + 1 :])) for i in range(300)] + [(1000, " ".join(words[:40])), (1001, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    least, _ = brute(texts)
    assert by_key(near_duplicates(df), "component_id") == least


def test_near_edges(messy, empty):
    got = by_key(near_duplicates(messy), "component_id")
    assert got[1] is None and got[3] is None and got[None] is None, "linked with the null key, which is smallest"
    assert (got[4], got[5], got[6]) == (4, 5, 6) and got[9] == 8 and got[10] == 8 and got[12] == 11 and got[15] == 14
    assert near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (103, 102), (7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    parts = collections.defaultdict(set)
    for r in got.collect():
        parts[r.comp].add(r.node)
    assert sorted(map(sorted, parts.values())) == [list(range(51)), [100, 101, 102, 103]]




def test_lines_deletes_later_runs_and_keeps_the_first(spark):
    run = [f"line number {i} of the shared run" for i in range(8)]
    long_line = " ".join(f"word{i}" for i in range(GRAM_WORDS + 5))
    texts = [
        (1, "\n".join(["start one", *run, "end one"])), (2, "\n".join(["start two", *run, "", "end two"])), (3, "\n".join([run[0], run[1], "other"])),
        (4, long_line), (5, f"before\n{long_line}\nafter"), (6, None), (7, ""), (8, "\n".join(["tick"] * 12)),
    ]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1].n_deleted == 0 and got[2].text == "start two\n\nend two" and got[3].n_deleted == 0
    assert got[4].n_deleted == 0 and got[5].text == "before\nafter" and got[6].text == "" and got[7].n_lines == 1
    assert 0 < got[8].n_deleted < 12 and set(got[8].text.split("\n")) == {"tick"}
    assert GRAM_LINES + WINDOW - 1 <= 8


def test_lines_finds_every_guaranteed_run(spark):
    """Any run of GRAM_LINES + WINDOW - 1 lines that an earlier document has goes, wherever it stands."""
    k = GRAM_LINES + WINDOW - 1
    texts = [(0, "\n".join(f"base {i}" for i in range(60)))] + [(n, "\n".join([f"own {n} a", f"own {n} b"][: n % 3] + [f"base {i}" for i in range(n, n + k)] + [f"own {n} z"])) for n in range(1, 50)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(got[n].n_deleted == k and "base" not in got[n].text for n in range(1, 50)) and got[0].n_deleted == 0


def test_lines_finds_every_passage_of_gram_words(spark):
    """A passage of 1 to 4 lines with over GRAM_WORDS words together goes at its later place, wherever it stands."""
    texts, shared = [], {}
    for n in range(120):
        k = 1 + n % 4
        passage = [" ".join(f"p{n}l{i}w{j}" for j in range(GRAM_WORDS // k + 2)) for i in range(k)]
        own = lambda d: [f"own {n} {d} {i}" for i in range(12)]
        a, b = own("a"), own("b")
        texts += [(2 * n, "\n".join(a[: n % 7] + passage + a[n % 7 :])), (2 * n + 1, "\n".join(b[: n % 5] + passage + b[n % 5 :]))]
        shared[2 * n + 1] = list(range(n % 5, n % 5 + k))
    got = by_key(dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")), "deleted")
    assert {i: d for i, d in got.items() if d} == shared


def test_lines_goes_on_beyond_a_part_that_has_an_earlier_copy(spark):
    """Lines beside a passage that a third document has first go with the rest of what two later ones share."""
    texts, shared = [], {}
    for n in range(40):
        b = [f"boilerplate {n} {i}" for i in range(9 + n % 4)]
        run = [f"before {n} {i}" for i in range(1 + n % 4)] + b + [f"after {n} {i}" for i in range(1 + n % 3)]
        texts += [(3 * n, "\n".join(b))] + [(3 * n + d, "\n".join([f"own {n} {d} x", *run, f"own {n} {d} y"])) for d in (1, 2)]
        shared[3 * n + 1] = list(range(2 + n % 4, 2 + n % 4 + len(b)))
        shared[3 * n + 2] = list(range(1, 1 + len(run)))
    got = by_key(dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")), "deleted")
    assert {i: d for i, d in got.items() if d} == shared


def test_lines_against_brute_force(spark):
    """Exactly the lines of runs of enough lines or words that an earlier place has go, for runs of every length."""
    rng, lines = random.Random(5), [f"w{i} " * (1 + i * i % 23) + "." for i in range(14)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(14)))) for i in range(150)] + [(900, None), (901, "\n".join(["tick"] * 9)), (950, "x\n" + "long " * 55), (951, "long " * 55 + "\ny")]
    for n, length in enumerate(range(1, 11)):
        run = [f"run {n} line {k}" + " word" * (n % 3 * 12) for k in range(length)]
        rows += [(1000 + 10 * n + d, "\n".join([f"own {n} {d}", *run[d % 2 :], f"end {n} {d}"])) for d in range(3)]
    seen, least = set(), GRAM_LINES + WINDOW - 1
    got, by_length = by_key(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")), "deleted"), collections.Counter()
    for i, t in rows:
        have = [(k, x) for k, x in enumerate((t or "").split("\n")) if x.split()]
        want, mine = set(), []
        for a in range(len(have)):
            for z in range(a + 1, len(have) + 1):
                run = tuple(x for _, x in have[a:z])
                if z - a >= least or sum(len(x.split()) for x in run) >= GRAM_WORDS:
                    if run in seen or run in mine:
                        want.update(k for k, _ in have[a:z])
                        by_length[z - a] += 1
                    mine.append(run)
        seen.update(mine)
        assert sorted(want) == got[i], i
    assert set(range(1, 10)) <= set(by_length)


def test_lines_recall_of_short_runs(spark):
    """Planted pairs of runs of 3 and 4 short lines, wherever they stand: all are found, and nothing else."""
    texts, shared = [], {}
    for n in range(300):
        length = 3 + n % 2
        run = [f"r{n} {k}" for k in range(length)]
        own = lambda d: [f"own {n} {d} {i}" for i in range(9)]
        texts += [(2 * n + d, "\n".join(own(d)[: (n + d) % 8] + run + own(d)[(n + d) % 8 :])) for d in (0, 1)]
        shared[2 * n + 1] = list(range((n + 1) % 8, (n + 1) % 8 + length))
    got = by_key(dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")), "deleted")
    assert {i: d for i, d in got.items() if d} == shared


def test_lines_edges(messy, empty):
    got = dedup_lines(messy)
    assert got.count() == messy.count() and dedup_lines(empty).count() == 0
    assert by_key(got, "n_deleted")[4] == 0
