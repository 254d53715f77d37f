"""Each statistic of the quality classifier against a plain version."""

import math

import pytest
import zstandard
from llm_cases import words

from tidemark.llm import quality


def repeated(own):
    """Words in 8-word windows that stand twice or more, the first included."""
    windows = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
    held = {}
    for w in windows:
        held[w] = held.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if held[w] > 1 for j in range(i, i + 8)}
    return len(covered)


def plain(text):
    raw, own = (text or "").encode(), words(text)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, size = max(len(own), 1), max(len(raw), 1)
    of = lambda chars: sum(chr(b) in chars for b in raw if b < 128) / size
    return {
        "bytes_log": math.log1p(len(raw)),
        "word_count_log": math.log1p(len(own)),
        "word_length": sum(len(w.encode()) for w in own) / n,
        "upper": of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digits": of("0123456789"),
        "symbols": of("#*$%&<>@^~=+_{}[]\\/"),
        "marks": of("!?"),
        "bars": of("|"),
        "spaces": of(" \t\n\x0b\x0c\r"),
        "high_bytes": sum(b >= 128 for b in raw) / size,
        "capital_words": sum("A" <= w[0] <= "Z" for w in own) / n,
        "distinct_words": len(set(own)) / n if raw else 0.0,
        "repeated_words": repeated(own) / n,
        "line_length": math.log1p(len(raw) / max(len(lines), 1)) if raw else 0.0,
        "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1) if raw else 0.0,
        "ratio": len(zstandard.ZstdCompressor(level=1).compress(raw)) / len(raw) if raw else 0.0,
    }


def check(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [r for r in quality.statistics(docs).collect() if r["_id"] in texts]
    assert rows
    for r in rows:
        assert {s: r[s] for s in quality.STATISTICS} == pytest.approx(plain(texts[r["_id"]]), abs=1e-9)


def test_of_the_table(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_of_odd_rows(spark, odd):
    check(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))


def test_columns_come_along(spark, odd):
    labels = spark.createDataFrame([(7, 1), (2, 0), (8, 1), (3, 0)], "doc_id long, quality int")
    found = quality.keep_good(odd, labels, least=0.0)
    assert found.schema.names == odd.schema.names
    assert sorted(map(str, found.collect())) == sorted(map(str, odd.collect()))
