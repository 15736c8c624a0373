"""Token counts by greedy longest match, in time linear in the text, without building pieces.

The vocabulary is that of a byte-level tokenizer. A word starts with a blank; entries that start
with one begin a word, all others continue it. Both kinds form tries. Every trie node has a failure
link: the node where matching goes on once the longest entries of the text read so far are split
off, and the number of entries that this pops. Reading a word follows one child or failure link
after the other and adds up the popped counts; no character is read twice and no entry is named.

Words are the runs of characters other than the six ASCII white spaces. A word that the vocabulary
cannot spell counts as one token.

Edge cases: null, empty and blank texts have no words and no tokens; equal rows are counted each; a
null doc_id is kept; an empty table gives no rows; very long words cost linear time; other columns
are not read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from contactgrid.llm.queries import register
from contactgrid.llm.wordids import byte_letters, ship_vocabulary, vocabulary_file
from contactgrid.sources.tables import read_table

VOCABULARY = "byte_bpe_50k.json"
#: Words a worker remembers before it starts anew; this bounds memory and changes no result.
REMEMBERED = 1 << 19
BLANK = ord(" ")


def vocabulary_entries(file: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary file."""
    letters = {letter: byte for byte, letter in byte_letters().items()}
    parsed = json.loads(file)
    special = {token["content"] for token in parsed["added_tokens"]}
    return [bytes(letters[letter] for letter in entry)
            for entry in parsed["model"]["vocab"] if entry not in special]


class LongestMatch(dict):
    """Tokens of words (bytes without the blank); a mapping that remembers what it counted.

    Nodes are numbers: 0 starts a word, 1 continues it. `child` maps `node * 256 + byte`.
    """

    def __init__(self, entries: list[bytes]):
        super().__init__()
        self.child: dict[int, int] = {}
        ends = set()
        nodes = 2
        for entry in entries:
            node = 0 if entry[:1] == b" " else 1
            for byte in entry:
                key = node * 256 + byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = nodes
                    nodes += 1
            ends.add(node)
        self.fail: list[int] = [-1] * nodes
        self.pops = [0] * nodes
        below: list[list[tuple[int, int]]] = [[] for _ in range(nodes)]
        for key, node in self.child.items():
            below[key >> 8].append((key & 255, node))
        waiting = deque([0, 1])
        while waiting:  # by depth: links only point to nodes that are finished
            parent = waiting.popleft()
            for byte, node in below[parent]:
                waiting.append(node)
                if node in ends:
                    self.fail[node], self.pops[node] = 1, 1
                    continue
                popped, link = self.pops[parent], self.fail[parent]
                while link >= 0 and link * 256 + byte not in self.child:
                    popped, link = popped + self.pops[link], self.fail[link]
                if link >= 0:
                    self.fail[node] = self.child[link * 256 + byte]
                    self.pops[node] = popped

    def __missing__(self, word: bytes) -> int:
        count = self[word] = self.count(word)
        return count

    def count(self, word: bytes) -> int:
        """Entries in the greedy longest-match split of a word; 1 if it has none."""
        child, fail, pops = self.child, self.fail, self.pops
        node, total = child.get(BLANK, -1), 0
        if node < 0:
            return 1
        for byte in word:
            after = child.get(node * 256 + byte)
            while after is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                after = child.get(node * 256 + byte)
            node = after
        while node != 1:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


_MATCHERS: dict[str, LongestMatch] = {}


def matcher(vocabulary: str) -> LongestMatch:
    """This worker's automaton for a vocabulary file's text, built once a worker."""
    if vocabulary not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[vocabulary] = LongestMatch(vocabulary_entries(vocabulary))
    return _MATCHERS[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens of each document."""
    shipped = ship_vocabulary(docs.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = matcher(shipped.value)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                words = raw.split()
                rows.append((len(raw), len(words), sum([counts[word] for word in words])))
                if len(counts) > REMEMBERED:
                    counts.clear()
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.record_batch(
                [batch.column(0), *(pa.array(column, pa.int64()) for column in columns)],
                names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_words long, n_tokens long")


@register("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy token counts of every document."""
    return count_tokens(read_table(spark, sf_dir, "documents"), vocabulary_file(VOCABULARY))
