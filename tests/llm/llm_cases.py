"""Word rules and odd rows shared by the tests of the text operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "_row string, _text string, line long, copies string, node double, c0 int, label string"
)


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_rows():
    """Null, empty, blank, tied, repeated and very long texts, null ids and sources."""
    long = " ".join(f"w{i * 7919 % 4001}" for i in range(60_000)) + "\n" + "x" * 100_000
    page = "Same header here\n" + " ".join(f"body{i}" for i in range(80)) + "\nSame footer here"
    texts = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "one two", "b"), (6, "one two", None),
        (7, long, "c"), (8, long, "d"), (9, page, "e"), (10, page, "f"), (10, page, "f"), (10, "other text " * 40, "f"),
        (None, page, None), (None, None, None), (11, page.upper(), "é"), (12, "ünïcödé wörds ñ     𝔘 " * 20, "g"),
        (-5, "<|im_end|> token = abcdef \x00 under the MIT license", "g"),
    ]
    return [(i, t, "en", s, None if t is None else len(t), "clash", "clash", 3, "clash", 0.5, 1, "clash") for i, t, s in texts]
