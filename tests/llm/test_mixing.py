"""Targets, schedule and taken words of the mix."""

import re
from collections import Counter, defaultdict

import pytest
from llm_cases import odd_texts, prose

from contactgrid.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > repeats * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in free}
        for s in over:
            full[s] = float(repeats * sizes[s])
            free.discard(s)
        rest = share * sum(sizes.values()) - sum(full.values())
    return full


def sizes_of(texts):
    sizes = Counter()
    for _, text, source in texts:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return sizes


def mixed_texts():
    made = [(n, prose(n, 5 + n * 7 % 300), "hot" if n % 3 == 0 else f"s{n % 7}")
            for n in range(240)]
    return made + odd_texts()


@pytest.fixture(scope="module")
def result(make_docs):
    texts = mixed_texts()
    places, mixed = mixing.mix(make_docs(texts), block_words=64)
    return texts, places.collect(), mixed.collect(), mixing.taken_words(places, mixed).collect()


def test_targets_and_taken_words(result):
    texts, _, _, rows = result
    sizes = sizes_of(texts)
    wanted = targets(sizes)
    assert len(rows) == len(texts)
    taken = Counter()
    for row in rows:
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(wanted[row.source])
        assert 0 <= row.taken <= 2 * row.size
        taken[row.source] += row.taken
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 1


def test_blocks_are_equal_and_cover_the_target(result):
    _, places, mixed, _ = result
    goal = {p.place: round(p.target) for p in places}
    words = Counter()
    owner = {}
    for span in mixed:
        assert span.begin < span.end
        words[span.slot] += span.end - span.begin
        assert owner.setdefault(span.slot, span.place) == span.place
    by_place = defaultdict(list)
    for slot, place in owner.items():
        by_place[place].append(words[slot])
    for place, blocks in by_place.items():
        assert sum(blocks) == goal[place]
        assert max(blocks) - min(blocks) <= 1


def test_every_stretch_of_slots_is_near_the_weights(spark):
    sizes = spark.createDataFrame([("a", 5000), ("b", 90000), ("c", 40000), (None, 7)],
                                  "source string, source_size long")
    table = mixing.source_targets(sizes).cache()
    shares = {r.place: r.target for r in table.collect()}
    words = sum(shares.values())
    slots = sorted(mixing.schedule_slots(spark, table, words, 50).collect())
    for start in range(0, len(slots) - 200, 100):
        seen = Counter(s.place for s in slots[start:start + 200])
        for place, share in shares.items():
            assert abs(seen[place] - 200 * share / words) <= 6
    ranks = defaultdict(list)
    for slot in slots:
        ranks[slot.place].append(slot.rank)
    assert all(found == list(range(len(found))) for found in ranks.values())
    assert set(ranks) == set(shares)  # the tiny source has a slot too


def test_reruns_and_partitions_do_not_matter(make_docs, result):
    texts, _, _, rows = result
    places, mixed = mixing.mix(make_docs(texts[::-1]).repartition(7), block_words=64)
    again = mixing.taken_words(places, mixed).collect()
    key = lambda r: str((r.doc_id, r.tie, r.at, r.taken))
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_documents_of_the_mix(make_docs, none):
    texts = mixed_texts()
    mixed = mixing.mixed_documents(make_docs(texts))
    assert mixed.columns == none.columns
    rows = mixed.collect()
    words = Counter()
    times = Counter()
    known = {(t[0], " ".join((t[1] or "").split())) for t in texts}
    for row in rows:
        words[row.source] += len(re.findall(r"[^\x20\x09-\x0D]+", row.text))
        times[(row.doc_id, row.text)] += 1
        flat = " ".join(row.text.split())
        assert any(i == row.doc_id and text.startswith(flat) for i, text in known)
    for source, target in targets(sizes_of(texts)).items():
        assert abs(words[source] - target) <= 1


def test_nothing_to_mix(make_docs, none):
    places, mixed = mixing.mix(none)
    assert places.collect() == [] and mixed.collect() == []
    assert mixing.mixed_documents(none).collect() == []
    places, mixed = mixing.mix(make_docs([(1, None, None), (2, "", "a")]))
    rows = mixing.taken_words(places, mixed).collect()
    assert sorted((r.doc_id, r.size, r.taken, r.target) for r in rows) == [
        (1, 0, 0, 0.0), (2, 0, 0, 0.0)]


def test_one_id_and_text_in_two_sources(make_docs):
    texts = [(1, prose(1, 90), "a"), (1, prose(1, 90), "b"), (2, prose(2, 90), "c"),
             (1, prose(1, 90), None)]
    docs = make_docs(texts)
    taken = {}
    for row in mixing.taken_words(*mixing.mix(docs)).collect():
        taken[row.source] = taken.get(row.source, 0) + row.taken
    words = {}
    for row in mixing.mixed_documents(docs).collect():
        words[row.source] = words.get(row.source, 0) + len(row.text.split())
    assert words == {source: n for source, n in taken.items() if n}
    assert len(words) > 1
