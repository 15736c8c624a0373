"""Cross-tokenizer alignment, conversation repair and the exact similarity join by brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from llm_cases import odd_texts, prose
from tokenizers import Tokenizer

from contactgrid.llm import alignment, conversations, jaccard

# --- op11


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_VOCABULARY))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path(alignment.PIECE_VOCABULARY))


@pytest.fixture(scope="module")
def table():
    with open(public_tokenizers.path(alignment.BYTE_VOCABULARY), encoding="utf-8") as file:
        vocabulary = file.read()
    with open(public_tokenizers.path(alignment.PIECE_VOCABULARY), "rb") as file:
        return alignment.Aligner(vocabulary, file.read())


def ends_of(tokens):
    ends, at = [], 0
    for token in tokens:
        at += len(token)
        ends.append(at)
    return ends


def aligned(text, libraries, table):
    """(n_a, n_b, n_groups, n_links, digest), links; from whole texts, by walks over the ends."""
    nothing = (0, 0, 0, 0, ""), Counter()
    if not text:
        return nothing
    a = libraries[0].encode(" " + text, add_special_tokens=False).ids
    b = libraries[1].encode(text)
    one, two = [table.bytes_a[i] for i in a], [table.bytes_b[i] for i in b]
    if b"".join(one) != (" " + text).encode() or b"".join(two) != b"".join(one):
        return nothing
    ends_a, ends_b = ends_of(one), ends_of(two)
    groups = []
    i = j = 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        i, j = k, m
    links = Counter()
    j = 0
    for i, end in enumerate(ends_a):
        start = end - len(one[i])
        while ends_b[j] <= start:
            j += 1
        k = j
        while k < len(b) and ends_b[k] - len(two[k]) < end:
            links[a[i], b[k]] += 1
            k += 1
    return (len(a), len(b), len(groups), sum(links.values()),
            hashlib.sha256(";".join(groups).encode()).hexdigest()), links


def test_chunks_align_as_whole_texts_do(libraries, table):
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\n\n", " \n", "\x1c", "\xa0", "　", "▁",
             "é", "é", "漢字", "!", "...", "'s", "23", "<|endoftext|>", "<s>", "<0x41>", "ﬁ",
             "\x85", " ", "😀", "\r\n", "\r", ";\r", "\x00", "Ab", "ing", "\x0b"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]
    texts += [prose(3, 400), "x" * 30_000, ""]
    got = table.align(texts)
    assert [row[:5] for row in got] == [aligned(t, libraries, table)[0] for t in texts]
    assert sum(row[0] > 0 for row in got) > 1500


@pytest.mark.parametrize("shipped", [alignment.SHIPPED_PAIRS, 10])
def test_links_are_counted_over_the_corpus(odd, none, libraries, table, shipped):
    texts = odd_texts()
    known = [aligned(t, libraries, table) for _, t, _ in texts]
    total = sum((links for _, links in known), Counter())
    best = Counter()
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    expected = sorted(
        (i or 0, *facts[:4], sum(n for (a, b), n in links.items() if total[a, b] == best[b]),
         sum(n * total[pair] for pair, n in links.items()), facts[4])
        for (i, _, _), (facts, links) in zip(texts, known, strict=True))
    rows = alignment.align(odd, shipped_pairs=shipped).collect()
    assert sorted((r.doc_id or 0, *tuple(r)[1:]) for r in rows) == expected
    assert alignment.align(none, shipped_pairs=shipped).collect() == []


# --- op12

BLANKS = " \t\n\x0b\x0c\r"


def test_chunks_are_encoded_in_bounded_batches(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "ENCODED", 7)
    one = alignment.Aligner(open(public_tokenizers.path(alignment.BYTE_VOCABULARY)).read(), open(
        public_tokenizers.path(alignment.PIECE_VOCABULARY), "rb").read())

    class Watched:
        def encode_batch(self, chunks, **options):
            assert len(chunks) <= 7
            return library.encode_batch(chunks, **options)

    library, texts = one.a, [prose(n, 60) for n in range(3)]
    want = [row[:5] for row in one.align(texts)]
    one.forget()
    one.a = Watched()
    assert [row[:5] for row in one.align(texts)] == want


def test_chunks_share_the_texts_that_are_encoded(libraries, table):
    given = []

    class Watched:
        def encode_batch(self, chunks, **options):
            given.extend(chunks)
            return library.encode_batch(chunks, **options)

    library, texts = table.a, [prose(n, 300) for n in range(4)] + ["ends in a tab\t", " ", "a \t b"]
    want = [aligned(text, libraries, table)[0] for text in texts]
    chunks = {chunk for text in texts for chunk in alignment.CHUNK.findall(" " + text)}
    table.forget()
    table.a = Watched()
    try:
        assert [row[:5] for row in table.align(texts)] == want
    finally:
        table.a = library
    assert len(given) < len(chunks) / 10 and sum(map(len, given)) == sum(map(len, chunks))


def brute_repair(turns):
    """Counts and the cheapest repair of ordered (turn, role, text), by shortest paths."""
    known = [turn for turn, _, _ in turns if turn is not None]
    out = {"gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0}
    faults, seen = [], set()
    for _, role, text in turns:
        left = text.rstrip(BLANKS)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else
                      None if left[-1] in ".!?" else "truncated")
        seen.add((role, text))
    out |= {name: faults.count(name) for name in ("blank", "duplicate", "truncated")}
    out["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au")
                         for a, b in zip(turns, turns[1:], strict=False))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, last, made = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(turns) and last in ("", "a"):
            break
        role = "assistant" if last == "u" else "user"
        steps = [(3, "I", at, role[0], ((role, ""),))]
        if at < len(turns):
            steps.append((4, "D", at + 1, last, ()))
            if faults[at] not in ("blank", "duplicate"):
                extra, (_, own, text) = 3 * (faults[at] == "truncated"), turns[at]
                steps.append((3 + extra, "R", at + 1, role[0], ((role, text),)))
                if own[:1] == role[0] or (own[:1] == "s" and not last):
                    steps.append((extra, "K", at + 1, own[0], ((own, text),)))
        for price, edit, place, state, more in steps:
            heapq.heappush(heap, (cost + price, audit + edit, place, state, made + more))
    repaired = "\n".join(f"{role}:{text}" for role, text in made)
    return out | {"cost": cost, "audit": audit,
                  "repaired_sha256": hashlib.sha256(repaired.encode()).hexdigest()}


def brute_damage(rows):
    """Turns of each conversation after the damage, in order."""
    found = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        named = [" " if value is None else str(value) for value in (conv, turn, role, text)]
        way = zlib.crc32(f"{named[0]}:{named[1]}".encode()) % 20
        role = "user" if way == 4 else named[2]
        text = "" if way == 1 else re.sub("[.!?]", "", named[3]) if way == 2 else named[3]
        found[conv] += [(turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return {conv: sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
            for conv, turns in found.items()}


def conversation_rows(seed, conversations_, turns):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations_)]:
        for turn in range(rng.randint(1, turns)):
            role = rng.choice(["system"] * (turn == 0) + ["user", "assistant"] * 3
                              + ["tool", "", None, "sys"])
            text = rng.choice(["Hi.", "Hi.", f"t{turn}?", f"t{turn}", " \t", "", None, "end! \n"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    return rows


CONVERSATION = "conv_id long, turn long, role string, text string, cost string, part string"


def same_repairs(spark, rows):
    table = spark.createDataFrame([(*row, "x", "x") for row in rows], CONVERSATION).repartition(3)
    turns = conversations.damage(table)
    got = {r.conv_id: {name: r[name] for name in r.asDict() if name not in ("conv_id", "digest")}
           | {"repaired_sha256": r.digest} for r in conversations.repair(turns).collect()}
    expected = {conv: brute_repair(turns) for conv, turns in brute_damage(rows).items() if turns}
    assert got == expected


def test_repairs_equal_shortest_paths(spark, monkeypatch):
    rows = conversation_rows(1, 120, 9)
    same_repairs(spark, rows + rows[:5])
    monkeypatch.setattr(conversations, "STRETCH", 2)
    rng = random.Random(5)
    for _ in range(300):
        codes = "".join(rng.choices("suauaUAS-x", k=rng.randint(0, 12)))
        turns = [(n, {"s": "system", "u": "user", "a": "assistant", "-": "user", "x": "x"}[
            c.lower()], "" if c == "-" else f"{n}" if c.isupper() else f"{n}.")
            for n, c in enumerate(codes)]
        expected = brute_repair(turns)
        for stretch in (1, 3, 48):
            conversations._KNOWN.clear()
            monkeypatch.setattr(conversations, "STRETCH", stretch)
            found = conversations.accepted(conversations.extend(
                {conversations.NOTHING: (0, "")}, codes))
            assert found == (expected["cost"], expected["audit"])
    conversations._KNOWN.clear()


def test_conversations_that_span_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = conversation_rows(2, 3, 40) + [
            (7, n, ("user", "assistant")[n % 2], f"{n}" + "." * (n % 3)) for n in range(300)]
        same_repairs(spark, rows + [(7, 5, "user", "same.")] * 20)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_no_turns_left(spark, tmp_path):
    gone = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x."), (gone + 1, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"
                          ).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in conversations.op12_conversation_repair(
        spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[gone]) == (gone, 0, 0, 0, 0, 0, 0, "", empty)
    assert got[gone + 1].blank == 1 and got[gone + 1].repaired_sha256 == empty
    assert conversations.repair(conversations.damage(spark.createDataFrame(
        [], "conv_id long, turn long, role string, text string"))).collect() == []


# --- op13


def word_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets = [word_set(t) for _, t, _ in texts]
    label = list(range(len(sets)))
    for a, one in enumerate(sets):
        for b, two in enumerate(sets[:a]):
            if one and 100 * len(one & two) >= 80 * len(one | two):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    ids = {}
    for (i, _, _), x in zip(texts, label, strict=True):
        if i is not None:
            ids[x] = min(ids.get(x, i), i)
    return [(i, len(s), ids.get(x)) for (i, _, _), s, x in zip(texts, sets, label, strict=True)]


def near_texts():
    """Groups of edited copies at similarities about 0.8, and a passage that many texts share."""
    rng = random.Random(3)
    texts = []
    for group, edits in enumerate([1, 4, 7, 8, 9, 10, 11, 14, 30]):
        words = prose(60 + group, 400).split()
        for copy in range(14):
            other = list(words)
            for at in rng.sample(range(400), edits):
                other[at] = f"edit{group}x{copy}"
            texts.append(" ".join(other[:400 - 3 * copy]))
    passage = prose(99, 60)
    texts += [prose(200 + n, 40) + "\n" + passage for n in range(120)]
    texts += ["One two THREE", "one two three", "one two three four", "a b c d e", "a b c d e f",
              "a b c d e f g h i j", "a b c d e f g h i k"]
    return [(n, text, "a") for n, text in enumerate(texts)]


@pytest.mark.parametrize("rows", [jaccard.NODE_ROWS, 16])
def test_links_of_similar_sets(make_docs, monkeypatch, rows):
    monkeypatch.setattr(jaccard, "NODE_ROWS", rows)
    monkeypatch.setattr(jaccard, "TASK_EDGES", 1 << 18 if rows > 16 else 3)
    monkeypatch.setattr(jaccard, "COMMON_DOCS", 20)
    texts = near_texts()
    expected = brute_components(texts)
    got = jaccard.similar_sets(make_docs(texts)).collect()
    ids = {}
    for r in got:
        if r.root is not None:
            ids[r.root] = min(ids.get(r.root, r.doc_id), r.doc_id)
    assert sorted((r.doc_id, r.size, ids[r.root]) for r in got) == expected
    assert 20 < sum(i == c for i, _, c in expected) < len(expected)


def test_links_across_the_parts_of_a_cut_tree(make_docs, monkeypatch):
    """Families share eight shingles of ten, too few for links; one pair in each shares nine."""
    monkeypatch.setattr(jaccard, "NODE_ROWS", 1)
    rng, texts = random.Random(3), []
    for family in range(40):
        words = [f"w{family}x{i}" for i in range(12)]
        ends = [[f"e{family}x{n}", f"f{family}x{n}"] for n in range(2)]
        ends += [[f"pair{family}", "left"], [f"pair{family}", "right"]]
        rng.shuffle(ends)
        texts += [(4 * family + n, " ".join(words + end), "a") for n, end in enumerate(ends)]
    want = {doc_id: component for doc_id, _, component in brute_components(texts)}
    assert len(set(want.values())) == len(texts) - 40
    roots = {r.doc_id: r.root for r in jaccard.similar_sets(make_docs(texts)).collect()}
    smallest = {root: min(i for i in roots if roots[i] == root) for root in set(roots.values())}
    assert {i: smallest[root] for i, root in roots.items()} == want


def test_odd_documents_and_the_query(spark, odd, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = jaccard.op13_count_vector_join(spark, str(tmp_path)).collect()
    key = lambda row: str(tuple(row))
    assert sorted(map(key, got)) == sorted(map(key, brute_components(odd_texts())))
    assert jaccard.similar_sets(none).collect() == []
