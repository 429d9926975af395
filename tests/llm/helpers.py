"""Brute-force versions of the contracts, in plain Python, and awkward rows for every operator."""

import hashlib
import re

SF = "/root/testdata/sf0.001"

AWKWARD = [
    (1, "", "en", "s", 0),
    (2, None, None, None, None),
    (3, "one", "en", "s", 3),
    (4, "Same text here, again and again", "en", "s", 31),
    (5, "Same text here, again and again", "en", "s", 31),
    (5, "Same text here, again and again", "en", "s", 31),
    (6, " \t\n\x0b\x0c\r ", "de", "s", 7),
    (7, "é漢字 😀 ñandú's  don't x", "fr", "s", 20),
    (8, "word " * 4000, "en", "s", 20000),
    (9, "x" * 30000, "en", "s", 30000),
    (10, "A b\nA b\n\nc\n", None, "s", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
