"""Rows that operators must take: nulls anywhere, empty and long texts, repeats and ties."""

import random

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n))


LONG = words(60_000, 1)
ODD = [
    (1, "", "en", "a", 0),
    (2, None, None, None, None),
    (3, LONG, "en", "a", len(LONG)),
    (4, "token = 'Zx81kQpw72LmNv' and 0123abcd9876fedc55", "en", None, 10),
    (4, "token = 'Zx81kQpw72LmNv' and 0123abcd9876fedc55", "en", None, 10),
    (None, "a text without an id", "fr", "b", 20),
    (None, None, "fr", "b", 20),
    (7, "!!! ... ???", "de", "b", 11),
    (8, "héé 日本語 😀 <|im_end|> ÀÉ\x00\t\n", None, "ü", 9),
    (9, words(300, 2), "en", "a", 5),
    (10, words(300, 2), "de", "c", 5),
]
