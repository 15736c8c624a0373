"""Token counts, token files and packing against the tokenizers library and direct walks."""

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contactgrid.llm import packing, token_counts, token_files, wordids
from contactgrid.llm.storage import Workspace

WORDS = wordids.vocabulary_file()
BYTES = wordids.vocabulary_file(token_counts.VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def greedy(entries, longest, word):
    rest, count = b" " + word, 0
    while rest:
        size = next((n for n in range(min(longest, len(rest)), 0, -1) if rest[:n] in entries), 0)
        if not size:
            return 1
        rest, count = rest[size:], count + 1
    return count


def test_automaton_on_small_vocabularies():
    rng = random.Random(3)
    for _ in range(200):
        entries = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(8)}
        entries |= {b" " + bytes(rng.choices(b"abc", k=rng.randint(0, 4))) for _ in range(5)}
        counts = token_counts.LongestMatch(sorted(entries))
        for _ in range(40):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 12)))
            assert counts[word] == greedy(entries, 6, word)


def test_counts_of_odd_documents(spark, odd, none):
    with open(BYTES, encoding="utf-8") as file:
        entries = set(token_counts.vocabulary_entries(file.read()))
    longest = max(map(len, entries))
    expected = sorted(
        (i or 0, len((t or "").encode()), len((t or "").encode().split()),
         sum(greedy(entries, longest, w) for w in (t or "").encode().split()))
        for i, t, _ in odd_texts())
    got = token_counts.count_tokens(odd, BYTES).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_words, r.n_tokens) for r in got) == expected
    assert token_counts.count_tokens(none, BYTES).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_words_encode_like_the_library(text):
    encoder = wordids.encoder(type("Shipped", (), {"value": open(WORDS, encoding="utf-8").read()}))
    expected = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u2").tolist() == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), min_size=1, max_size=6))
def test_variable_length_coding_round_trip(documents):
    counts = np.array([len(d) for d in documents], np.int64)
    ranks = np.array([r for d in documents for r in d], np.uint32)
    control, data = token_files.pack_ranks(ranks, counts)
    assert token_files.unpack_ranks(control, data, counts).tolist() == ranks.tolist()
    assert [len(c.as_py()) for c in control] == [-(-n // 4) for n in counts]
    if len(documents) > 1:  # columns that start inside their buffers
        tail = pa.record_batch([control, data], names=["c", "d"]).slice(1)
        rest = [r for d in documents[1:] for r in d]
        assert token_files.unpack_ranks(tail.column(0), tail.column(1),
                                        counts[1:]).tolist() == rest


def test_token_files_of_odd_documents(spark, odd, none, tokenizer):
    folder = Workspace(spark).path("files")
    token_files.write_token_files(odd, folder, WORDS)
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    texts = sorted((-1 if i is None else i, ids_of(tokenizer, t)) for i, t, _ in odd_texts())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in rows) == texts
    assert [r.doc_id or -1 for r in rows] == sorted(r.doc_id or -1 for r in rows)
    start = 0
    for row in rows:
        assert (row.start, row.n_tokens) == (start, len(row.ids))
        start += row.n_tokens
    sums = {r.start: r.ids_crc32 for r in token_files.read_checksums(spark, folder).collect()}
    assert sums == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}
    ranks = spark.read.parquet(f"{folder}/ranks").collect()
    assert [r.occurrences for r in ranks] == sorted((r.occurrences for r in ranks), reverse=True)
    empty = Workspace(spark).path("empty")
    token_files.write_token_files(none, empty, WORDS)
    assert token_files.read_token_files(spark, empty).collect() == []
    assert token_files.read_checksums(spark, empty).collect() == []


def check_packing(rows, capacity):
    by_sequence = {}
    for row in rows:
        by_sequence.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_packing_of_odd_documents(odd, none, tokenizer):
    rows = packing.pack_documents(odd, WORDS, capacity=512).collect()
    check_packing(rows, 512)
    expected = []
    for i, t, _ in odd_texts():
        ids = ids_of(tokenizer, t)
        for piece, start in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[start:start + 512], "<u4")
            expected.append((i or 0, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32)
                  for r in rows) == sorted(expected)
    assert packing.pack_documents(none, WORDS).collect() == []


def best_fit(lengths, capacity):
    gaps, count = [], 0
    for n in sorted(lengths, reverse=True):
        place = bisect_left(gaps, n)
        left = (gaps.pop(place) if place < len(gaps) else capacity) - n
        count += left == capacity - n and place >= len(gaps)
        insort(gaps, left)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = [64, 4096][seed % 2]
    lengths = np.minimum(capacity, 1 + rng.lognormal(
        np.log(capacity / 6), 1.2, 3000).astype(int))
    if seed > 3:
        lengths[:1000] = capacity // 3  # a third of all pieces alike
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.PackingPlan(dict(zip(values.tolist(), counts.tolist(), strict=True)), capacity,
                               packing.GROUPS, packing.SMALL_SHARE)
    filled = {}
    for n, count in zip(values.tolist(), counts.tolist(), strict=True):
        rows = [*plan.rows[n], (count, 0, 1, 0)]
        for (rank, sequence, each, offset), after in zip(rows, rows[1:], strict=False):
            for r in range(rank, after[0]):
                filled.setdefault(sequence + (r - rank) // each, []).append(
                    (offset + (r - rank) % each * n, n))
    assert sum(map(len, filled.values())) == len(lengths)
    for places in filled.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= capacity
    bound = -(-int(lengths.sum()) // capacity)
    assert len(filled) <= max(best_fit(lengths.tolist(), capacity) * 1.01, bound + 3)
