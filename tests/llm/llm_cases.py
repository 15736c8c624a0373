"""Documents with every odd case."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, tie string,"
          " row string, `key` string, `lines` string, q_text string, n_tokens string,"
          " fingerprint string, size string, place string")


def prose(seed, words):
    rng = random.Random(seed)
    made = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(words)]
    lines = [" ".join(made[i:i + 12]) for i in range(0, words, 12)]
    return "\n".join(lines)


def odd_texts():
    """(doc_id, text, source); one row twice, one id with two texts, one null id."""
    plain = prose(1, 120)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\r\n\x0b\x0c ", None), (4, "word", "b"),
        (5, plain, "b"), (5, plain, "b"), (6, plain, "a"), (7, prose(2, 130), None),
        (7, prose(3, 90), "c"), (None, prose(4, 70), "c"), (8, "x" * 120_000, "d"),
        (9, prose(5, 9000), "d"), (10, "a b a b a b a b " * 30, "a"),
        (11, "Ünï 漢字 <|endoftext|> it's ok \x1c end", "b"), (12, plain + " more", "c"),
    ]


def rows(texts):
    return [(i, t, "en", s, len(t or ""), "x", "x", "x", "x", "x", "x", "x", "x", "x")
            for i, t, s in texts]
