"""License scans: short notices, also misspelt ones, with their place and number of edits.

Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered are joined by
one space.  The exact phrases of ``PHRASES`` are found by the hash of their word sequence.
For the notices of ``NOTICES`` with up to ``e`` edits, the notice is cut into ``e + 1``
pieces: by the pigeonhole principle one of them stands unchanged, so one automaton over all
pieces finds every candidate place.  Only there the ``regex`` library's bounded-error
matching looks for the notice, verifies the edits and reports the span.  The words that tell
one license from another must stand unchanged.

The score is 1 for an exact phrase, else 1 less the share of characters edited in the best
notice, and 0 without any.  Defined cases: a null text is empty; places that several pieces
point to are reported once; texts are scanned whole and rows are judged one by one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm import words
from tidemark.llm.frames import ID, plain_id, rows_of

# Exact phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Notices that may be misspelt.  Parts in braces must stand unchanged.
NOTICES = (
    ("under the {mit} license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("apache license version {2}", "apache-2"),
    ("creative commons attribution {noncommercial}", "cc-by-nc"),
    ("{gnu} general public license", "gpl"),
    ("{gnu lesser} general public license", "lgpl"),
    ("{gnu affero} general public license", "agpl"),
    ("{mozilla} public license", "mpl-2"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons {zero}", "cc0"),
    ("creative commons attribution {sharealike}", "cc-by-sa"),
    ("{eclipse} public license", "epl"),
    ("spdx license {identifier mit}", "mit"),
    ("spdx license {identifier apache 2}", "apache-2"),
    ("spdx license {identifier gpl}", "gpl"),
    ("spdx license {identifier lgpl}", "lgpl"),
    ("spdx license {identifier agpl}", "agpl"),
    ("spdx license {identifier mpl 2}", "mpl-2"),
    ("spdx license {identifier bsd}", "bsd"),
    ("spdx license {identifier isc}", "isc"),
    ("spdx license {identifier zlib}", "zlib"),
    ("spdx license {identifier unlicense}", "unlicense"),
    ("spdx license {identifier cc0}", "cc0"),
    ("spdx license {identifier epl}", "epl"),
)
# One edit for so many characters.
PER_EDIT = 10


def _plan(notice: str) -> tuple[str, int, regex.Pattern]:
    """The plain notice, its edits, and the pattern that allows them outside of braces."""
    plain = notice.replace("{", "").replace("}", "")
    edits = len(plain) // PER_EDIT
    pattern = "".join(
        regex.escape(p, literal_spaces=True) if i % 2 else f"(?:{regex.escape(p, literal_spaces=True)}){{e<={edits}}}" if p else ""
        for i, p in enumerate(regex.split(r"[{}]", notice))
    )
    return plain, edits, regex.compile(rf"(?b)\b{pattern}\b")


@lru_cache(maxsize=1)
def _search():
    plans = [(*_plan(notice), label) for notice, label in NOTICES]
    pieces: dict[str, list[tuple[int, int]]] = {}
    for number, (plain, edits, _, _) in enumerate(plans):
        for i in range(edits + 1):
            a, b = i * len(plain) // (edits + 1), (i + 1) * len(plain) // (edits + 1)
            pieces.setdefault(plain[a:b], []).append((number, b))
    automaton = ahocorasick.Automaton()
    for piece, of in pieces.items():
        automaton.add_word(piece, of)
    automaton.make_automaton()
    return plans, automaton


def _phrase_hashes() -> list[tuple[int, np.uint64, str]]:
    found = []
    for phrase, label in PHRASES:
        (part,) = words.cut(pa.array([phrase]), words.LOWER_ALNUM)
        n = len(part.hashes)
        found.append((n, part.grams(n)[0], label))
    return found


def notices(text: str) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of the notices in a normalised text, by place."""
    plans, automaton = _search()
    found: dict[tuple[str, int, int], int] = {}
    tried = set()
    for last, of in automaton.iter(text):
        for number, offset in of:
            plain, edits, pattern, label = plans[number]
            start = last + 1 - offset
            if (number, start) in tried:
                continue
            tried.add((number, start))
            # The notice starts within `edits` characters of where the piece puts it.
            low, high = max(0, start - edits), min(len(text), start + len(plain) + edits)
            # Only words that lie wholly within take part, so that word ends are those of the text.
            if low and text[low - 1] != " ":
                low = text.find(" ", low, high) + 1 or high
            if high < len(text) and text[high] != " ":
                high = max(low, text.rfind(" ", low, high))
            match = pattern.search(text, low, high)
            if match and sum(match.fuzzy_counts) <= edits:
                key = (label, *match.span())
                found[key] = min(found.get(key, edits), sum(match.fuzzy_counts))
    return sorted((label, a, b, e) for (label, a, b), e in found.items())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = _phrase_hashes()
    match_type = pa.struct(
        [("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64())]
    )
    for batch in batches:
        for part in words.cut(batch.column("_text"), words.LOWER_ALNUM):
            n = len(part)
            places: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            for k, wanted, label in phrases:
                at = np.flatnonzero(part.grams(k) == wanted)
                low, high = part.gram_ranges(k)
                of = np.searchsorted(part.first, at, "right") - 1
                for place, d in zip(at.tolist(), of.tolist()):
                    if place < high[d]:
                        places[d].append((place - int(low[d]), label))
            rows = []
            data = part.data.tobytes()
            limits = np.concatenate([part.starts, [len(data)]])[part.first]
            for d in range(n):
                text = b" ".join(data[limits[d] : part.ends[part.first[d + 1] - 1]].split()).decode() if part.counts[d] else ""
                found = notices(text)
                # Blanks before a place: a search in their places, not a count from the start.
                blanks = [m.start() for m in regex.finditer(" ", text)] if found else []
                fuzzy = [
                    {"label": label, "first_word": bisect_left(blanks, a), "end_word": bisect_left(blanks, b) + 1, "edits": e, "size": b - a}
                    for label, a, b, e in found
                ]
                base = places[d]
                best = max((1 - f["edits"] / max(f["size"], 1) for f in fuzzy), default=0.0)
                rows.append(
                    (
                        int(part.counts[d]),
                        len(base),
                        min(base)[0] if base else None,
                        max(base)[0] if base else None,
                        ",".join(sorted({label for _, label in base})),
                        ",".join(sorted({label for _, label in base} | {f["label"] for f in fuzzy})),
                        1.0 if base else max(0.0, best),
                        [{k: f[k] for k in ("label", "first_word", "end_word", "edits")} for f in fuzzy],
                    )
                )
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(match_type)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(ID).slice(part.row, n), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], _COLUMNS
            )


_COLUMNS = [ID, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact places, labels, score and the fuzzy ``notices`` (in words, with edits) of every row."""
    rows = rows_of(docs, id_col=id_col, text_col=text_col).select(ID, "_text")
    found = rows.mapInArrow(
        _scan,
        f"{ID} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, notices array<struct<label:string,first_word:bigint,end_word:bigint,edits:bigint>>",
    )
    return found.select(plain_id().alias("doc_id"), *_COLUMNS[1:])
