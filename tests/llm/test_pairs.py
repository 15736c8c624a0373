"""Fingerprints, repeated passages and nearest neighbours against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from llm_cases import odd_texts, prose

import corpus_pipeline
from contactgrid.llm import neighbours, simhash, suffixes, windows


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def components(codes, distance):
    codes = np.array(codes, np.uint64)
    label = np.arange(len(codes))
    near = [np.flatnonzero(np.bitwise_count(codes ^ c) <= distance) for c in codes]
    while True:
        before = label.copy()
        for found in near:
            label[found] = label[found].min()
        if (label == before).all():
            return label


def ball(seed, centres, each):
    rng = random.Random(seed)
    codes = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            code = centre
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                code ^= 1 << bit
            codes.add(code)
    return sorted(codes)


def test_fingerprints_of_odd_documents(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    texts = odd_texts()
    codes = [fingerprint(t) for _, t, _ in texts]
    label = components(codes, 3)
    smallest = {k: min((texts[j][0] for j in np.flatnonzero(label == k)
                        if texts[j][0] is not None), default=None) for k in set(label)}
    expected = sorted((i or 0, code, smallest[k]) for (i, _, _), code, k in
                      zip(texts, codes, label, strict=True))
    got = sorted((r.doc_id or 0, r.fingerprint % (1 << 64), r.component_id) for r in rows)
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert simhash.near_duplicates(none).collect() == []


def test_one_document_of_each_group_stays(make_docs, none):
    base = prose(9, 300)
    near = base.replace("a", "b", 1)
    texts = [(5, base, "a"), (3, base, "b"), (3, base, "b"), (8, near, "a"),
             (9, prose(10, 300), "a"), (11, None, "c"), (12, "", "c")]
    kept = simhash.keep_representatives(make_docs(texts))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9, 11]
    assert kept.columns == none.columns
    assert simhash.keep_representatives(none).collect() == []


def test_unrelated_documents_under_one_id_or_none_stay(make_docs):
    texts = [(None, prose(30 + n, 200), "a") for n in range(4)]
    texts += [(None, prose(30, 200), "b"), (7, prose(40, 200), "a"), (7, prose(41, 200), "a"),
              (8, prose(41, 200), "b"), (None, prose(40, 200), "c")]
    kept = simhash.keep_representatives(make_docs(texts)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted(
        [("None", prose(30 + n, 200)) for n in range(4)] + [("7", prose(40, 200)),
                                                            ("7", prose(41, 200))])


def five_word_sets(texts):
    return [{tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}
            for words in (t.split() for t in texts)]


def test_the_stage_removes_copies_of_similarity_from_eight_tenths(spark, make_docs, none):
    rng = random.Random(3)
    texts = []
    for group, edits in enumerate([1, 4, 8, 9, 10, 11, 12, 14, 20, 40]):
        words = prose(60 + group, 400).split()
        texts.append(" ".join(words))
        for copy in range(12):
            other = list(words)
            for at in rng.sample(range(400), edits):
                other[at] = f"edit{copy}"
            texts.append(" ".join(other))
    sets = five_word_sets(texts)
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    docs = make_docs([(n, t, "a") for n, t in enumerate(texts)])
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    assert 10 < len(set(label)) < 100
    assert kept.columns == none.columns
    assert corpus_pipeline.near_dedup(spark, none, "").collect() == []


def test_the_stage_keeps_unrelated_documents_under_one_id_or_none(spark, make_docs):
    texts = [(None, prose(30, 200), "a"), (None, prose(31, 200), "a"), (None, None, "a"),
             (7, prose(40, 200), "a"), (7, prose(41, 200), "a"), (8, prose(41, 200), "b"),
             (None, prose(40, 200), "c"), (9, " ", "c"), (7, "few words", "c")]
    kept = corpus_pipeline.near_dedup(spark, make_docs(texts), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted(
        [("None", prose(30, 200)), ("None", prose(31, 200)), ("7", prose(40, 200)),
         ("7", prose(41, 200)), ("9", " "), ("7", "few words")])


@pytest.mark.parametrize("node_rows", [1 << 13, 150])
def test_links_inside_dense_groups(spark, monkeypatch, node_rows):
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    monkeypatch.setattr(simhash, "SLAB_ROWS", 700)
    codes = ball(2, 4, 400)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(c,) for c in signed], "fingerprint long")
    edges = simhash.link_fingerprints(frame).collect()
    assert len(edges) <= 40 * len(codes)
    index = {c: k for k, c in enumerate(signed)}
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(index[a])] = find(index[b])
    label = components(codes, 3)
    mine = [find(k) for k in range(len(codes))]
    assert len(set(mine)) == len(set(label)) == len(set(zip(mine, label, strict=True)))


@pytest.mark.parametrize("distance", [0, 2, 7])
def test_links_at_other_distances(spark, distance):
    codes = sorted({code for step in (5, 9) for code in ball(step, 12, 12)} | {
        sum(1 << bit for bit in range(0, 64, 9)), 0, 1 << 63, (1 << 64) - 1,
        sum(1 << bit for bit in range(8, 64, 8))})
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(c,) for c in signed], "fingerprint long")
    edges = simhash.link_fingerprints(frame, distance).collect()
    label = components(codes, distance)
    mine = np.arange(len(codes))
    for a, b in edges:
        mine[mine == mine[signed.index(a)]] = mine[signed.index(b)]
    assert len(set(mine)) == len(set(label)) == len(set(zip(mine, label, strict=True)))


def brute_removed(texts):
    seen, twice = set(), set()
    for raw in texts:
        for p in range(len(raw) - windows.WINDOW + 1):
            piece = raw[p:p + windows.WINDOW]
            (twice if piece in seen else seen).add(piece)
    found = []
    for raw in texts:
        gone = bytearray(len(raw))
        for p in range(len(raw) - windows.WINDOW + 1):
            if raw[p:p + windows.WINDOW] in twice:
                gone[p:p + windows.WINDOW] = b"\1" * windows.WINDOW
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        found.append((len(raw), spans, sum(gone), hashlib.sha256(left).hexdigest()))
    return found


def passage_texts():
    shared, other = prose(20, 90), prose(21, 140)
    texts = [(n, f"{prose(30 + n, 20 + n)}\n{shared}\n{prose(60 + n, 40)}", "a")
             for n in range(12)]
    texts += [(20, other[:700] + other[200:900], "b"), (21, "ab" * 600, "b"),
              (22, "z" * 401, "b"), (23, "z" * 399, "b"), (24, shared[:400], "c"),
              (25, shared[1:400], "c"), (26, "é" * 300 + shared, "c")]
    return texts


@pytest.mark.parametrize("unit_runs", [suffixes.UNIT_RUNS, 3])
def test_repeated_passages(make_docs, monkeypatch, unit_runs):
    monkeypatch.setattr(suffixes, "BATCH_RUNS", 5)
    texts = [t for t in odd_texts() if t[0] not in (8, 9)] + passage_texts()
    rows = suffixes.remove_repeats(make_docs(texts), unit_runs=unit_runs).collect()
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_spans,
                  sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)),
                  hashlib.sha256(r.kept).hexdigest()) for r in rows)
    expected = brute_removed([(t or "").encode() for _, t, _ in texts])
    assert got == sorted((t[0] or 0, *e) for t, e in zip(texts, expected, strict=True))


def test_no_documents_to_cut(none):
    assert suffixes.remove_repeats(none).collect() == []


def test_window_family_marks_both_sides():
    rng = np.random.default_rng(4)
    family = suffixes.WindowFamily()
    names = rng.integers(0, 400, 900).astype(np.uint64)
    for at in range(0, 900, 60):
        family.add(names[at:at + 60], names[at:at + 60])
    values, counts = np.unique(names, return_counts=True)
    often = set(values[counts > 1].tolist())
    assert np.concatenate(family.marked).tolist() == [n in often for n in names.tolist()]
    sizes = [len(level[0]) for level in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def brute_neighbours(points, every, wanted):
    found = {}
    for i, v in points:
        if i % every:
            continue
        scored = sorted((float(np.sqrt(np.square(np.array(v) - np.array(w)).sum())), j)
                        for j, w in points if j != i)
        found[i] = [(rank + 1, j, d) for rank, (d, j) in enumerate(scored[:wanted])]
    return found


def vector_table(spark, points):
    return spark.createDataFrame(points, "vec_id long, embedding array<float>, score string")


def test_neighbours_with_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    points = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(300)]
    same = points[7][1]
    points += [(i, same) for i in range(300, 400)]
    bad = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None] * 4),
           (1004, []), (1010, [float("inf")] * 8), (None, same), (1020, [1.0, 2.0])]
    table = vector_table(spark, [(i, v, "x") for i, v in points + bad + points[:3]])
    rows = neighbours.nearest_rows(table, "embedding", 10, 10).collect()
    got = {}
    for row in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    expected = brute_neighbours(points, 10, 10)
    assert got.keys() == expected.keys()
    hits = sum(len({j for _, j, _ in got[i]} & {j for _, j, _ in expected[i]}) for i in expected)
    assert hits >= 0.99 * 10 * len(expected)
    exact = [i for i in expected if {j for _, j, _ in got[i]} == {j for _, j, _ in expected[i]}]
    for i in exact:
        assert [g[:2] for g in got[i]] == [e[:2] for e in expected[i]]
        assert np.allclose([g[2] for g in got[i]], [e[2] for e in expected[i]], rtol=1e-12)


def test_few_or_no_vectors(spark):
    few = vector_table(spark, [(0, [1.0, 2.0], "x"), (5, [1.0, 2.0], "x"), (7, [3.0, 1.0], "x")])
    rows = neighbours.nearest_rows(few, "embedding", 5, 10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in rows] == [
        (0, 1, 5), (0, 2, 7), (5, 1, 0), (5, 2, 7)]
    empty = vector_table(spark, [])
    assert neighbours.nearest_rows(empty, "embedding", 5, 10).collect() == []


def test_recall_on_the_test_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = neighbours.op10_nearest_neighbours(spark, folder).collect()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    points = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding is not None]
    expected = brute_neighbours(points, 100, 10)
    pairs = {(r.query_id, r.vec_id) for r in rows}
    hits = sum((i, j) in pairs for i, found in expected.items() for _, j, _ in found)
    assert hits >= 0.9 * sum(map(len, expected.values()))
