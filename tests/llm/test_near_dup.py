"""Near duplicates against brute force, on hard cases and on a whole table."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import numpy as np
import pytest

from quillframe.llm import near_dup

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.01"


def by_hand(rows: list[tuple[int, str]]) -> tuple[dict[int, int], int]:
    """Classes of ids and the number of links, over all pairs that share a shingle."""
    sets = [near_dup.multiset(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(i)
    pairs = {(a, b) for h in holders.values() for x, a in enumerate(h) for b in h[x + 1 :]}
    found = [(a, b) for a, b in pairs if near_dup.similarity(sets[a], sets[b]) >= near_dup.SIMILARITY]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        x, y = sorted((root(rows[a][0]), root(rows[b][0])))
        parent[y] = x
    return {i: root(i) for i in parent}, len(found)


def classes(spark, rows):
    return {x.doc_id: x.class_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}


def changed(words, r, n):
    out = words[:]
    for i in r.sample(range(len(out)), n):
        out[i] = f"x{r.random()}"
    return " ".join(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_whole_table(spark):
    out = {x.doc_id: x.class_id for x in near_dup.query(spark, SF).collect()}
    want, links = by_hand([tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])
    print(f"{sum(out[i] == c for i, c in want.items())} of {len(want)} classes, {links} links")
    assert out == want and links > 50


def test_shared_ids(spark):
    r = random.Random(2)
    one, two = ([f"w{r.randint(0, 10**6)}" for _ in range(100)] for _ in "ab")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, changed(one, r, 1)), (3, changed(two, r, 1)), (1, " ".join(one)), (4, ""), (4, " ".join(two)), (5, "")]
    for case in (rows, rows[::-1]):
        table = spark.createDataFrame(case, SCHEMA)
        out = near_dup.near_duplicates(table).collect()
        assert len(out) == len(case) and {x.doc_id: x.class_id for x in out} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
        kept = near_dup.keep_one(table).collect()
        assert sorted(x.doc_id for x in kept) == [1, 1, 5] and {x.text for x in kept if x.doc_id == 1} == {" ".join(one), " ".join(two)}


def test_large_bucket(spark, monkeypatch):
    """5,000 near copies of one text, and texts that share its buckets without a link to it but with one to each other."""
    monkeypatch.setattr(near_dup, "BLOCK", 500)
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, changed(base, r, 1)) for i in range(5000)]
    apart = changed(base, r, 6).split()
    rows += [(6000 + i, " ".join(apart[:-1] + [f"y{i}"])) for i in range(6)]
    rows += [(7000 + i, changed(base, r, 7)) for i in range(4)]
    r.shuffle(rows)
    sets = {i: near_dup.multiset(t) for i, t in rows}
    rare = sorted(i for i in sets if i >= 6000)
    linked = {i for i in rare if any(near_dup.similarity(sets[i], s) >= 0.8 for j, s in sets.items() if j < 5000)}
    groups, _ = by_hand([(i, t) for i, t in rows if i >= 6000])
    touched = {groups[i] for i in linked}
    want = {i: 0 if i < 5000 or groups[i] in touched else groups[i] for i in sets}
    assert classes(spark, rows) == want and len(set(want.values())) > 1


def test_names_and_empty(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(str(i), changed(base, r, 1), "g", "a") for i in range(4)] + [(None, " ".join(base), "g", "a")]
    table = spark.createDataFrame(rows, "doc_id string, text string, gone string, again string")
    assert {x.class_id for x in near_dup.near_duplicates(table).collect()} == {0, None}
    kept = near_dup.keep_one(table)
    assert kept.columns == table.columns and sorted(x.doc_id or "" for x in kept.collect()) == ["", "0"]
    assert near_dup.keep_one(table.limit(0)).count() == 0


def test_few_tasks_and_both_ways(spark, monkeypatch):
    """Small tables aren't written in as many files as there are shuffle partitions, and both ways give the same classes."""
    r = random.Random(7)
    bases = [[f"w{k}_{i}" for i in range(120)] for k in range(5)]
    rows = [(i, changed(bases[i % 5], r, r.choice([0, 1, 2, 4, 6]))) for i in range(150)] + [(150 + i, f"other {i}") for i in range(20)]
    want, _ = by_hand(rows)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    files = {}

    def counted(df, label, real=near_dup.written):
        out = real(df, label)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        return out

    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(near_dup, "written", counted)
        assert classes(spark, rows) == want and {"links", "labels", "placed", "open", "classes"} <= set(files)
        assert max(files.values()) <= 4 * spark.sparkContext.defaultParallelism, files
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("SMALL", "MAX_LOCAL", "MAX_BROADCAST"):
        monkeypatch.setattr(near_dup, name, -1)
    assert classes(spark, rows) == want


def test_components_both_ways(spark, monkeypatch):
    r = random.Random(8)
    chain = list(range(60))
    r.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(100 + r.randrange(80), 100 + r.randrange(80)) for _ in range(50)]
    table = spark.createDataFrame([(min(e), max(e)) for e in edges if e[0] != e[1]], "a long, b long")
    here = {x.id: x.label for x in near_dup.components(table).collect()}
    monkeypatch.setattr(near_dup, "MAX_LOCAL", -1)
    assert here == {x.id: x.label for x in near_dup.components(table).collect()} and {here[i] for i in chain} == {0}
    ids, least = near_dup.least_labels(np.array([5, 7, 9, 2]), np.array([7, 9, 1, 3]))
    assert dict(zip(ids.tolist(), least.tolist())) == {1: 1, 2: 2, 3: 2, 5: 1, 7: 1, 9: 1}
