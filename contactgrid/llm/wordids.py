"""Token ids of whole texts, word by word with a bounded memory of words.

The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are its
words' ids one after the other. Distinct words are far fewer than words: a worker encodes a word
once and then looks it up. The tokenizers library does the normalizing, cutting and encoding.
"""

from __future__ import annotations

import public_tokenizers
import regex
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from contactgrid.session import ship_package

VOCABULARY = "word_bpe_49k.json"
#: Words a worker remembers before it starts anew; this bounds memory and changes no result.
REMEMBERED = 1 << 19
#: Texts of characters below this one need no composing, and both regular-expression libraries
#: agree on their letters and digits.
PLAIN = "\u0250"
#: How the vocabulary cuts normalized text (read off its file), and the printable
#: stand-ins of byte-level vocabularies.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {byte: chr(byte) for byte in shown}
    hidden = [byte for byte in range(256) if byte not in table]
    return table | {byte: chr(256 + place) for place, byte in enumerate(hidden)}


def vocabulary_file(name: str = VOCABULARY) -> str:
    """Path of a public vocabulary."""
    return public_tokenizers.path(name)


def ship_vocabulary(spark: SparkSession, path: str):
    """Broadcast of a vocabulary file's text; its size is the file's, whatever the corpus."""
    ship_package(spark)
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


class WordEncoder(dict):
    """Ids of texts as little-endian unsigned integers of `width` bytes; remembers words' ids."""

    def __init__(self, vocabulary: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size(True) <= 1 << 16 else 4
        self.specials = tuple(token.content.encode() for token in
                              self.tokenizer.get_added_tokens_decoder().values())
        self.letters = byte_letters()
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; null is the empty text."""
        return b"".join([self[word] for word in text.encode().split()]) if text else b""

    def make_room(self) -> None:
        """Forget all words once there are too many; called between texts."""
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self._special(word) if b"<" in word and any(
            special in word for special in self.specials) else self._plain(word.decode())
        return ids

    def _plain(self, text: str) -> bytes:
        if not (text.isascii() or max(text) < PLAIN):
            normal = self.tokenizer.normalizer.normalize_str(text)
            return b"".join([self._model(letters) for letters, _ in
                             self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)])
        text = text.lower()  # composed already: nothing below PLAIN combines
        if text.isalpha():
            return self._piece(text)
        stem = text.rstrip(".,;:!?")
        if stem.isalpha():
            return self._piece(stem) + self._piece(text[len(stem):])
        return b"".join([self._piece(piece) for piece in PIECES.findall(text)])

    def _special(self, word: bytes) -> bytes:
        return self._pack(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            letters = piece.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[piece] = self._model(letters)
        return ids

    def _model(self, letters: str) -> bytes:
        return self._pack([token.id for token in self.model.tokenize(letters)])

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(self.width, "little") for i in ids])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(shipped) -> WordEncoder:
    """This worker's encoder of a shipped vocabulary, built once a worker."""
    vocabulary = shipped.value
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    found = _ENCODERS[vocabulary]
    found.make_room()
    return found


def forget() -> None:
    """Give back the memory of this worker's encoder; for the steps after the encoding."""
    _ENCODERS.clear()
