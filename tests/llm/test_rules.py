"""Compression rules, license scans and secret scans against plain versions of their base rules."""

import base64
import hashlib
import json
import random
import re
from collections import Counter

from llm_cases import ascii_lower, words

from tidemark.llm import compression, licenses, queries, secrets


def base_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def rated(df):
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()]


def test_base_counts(spark, sf_dir, odd, no_rows):
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = [(r.doc_id, *base_counts(r.text)) for r in docs.collect()]
        assert sorted(rated(compression.rated(docs)), key=str) == sorted(want, key=str)
    assert compression.rated(no_rows).collect() == []


def test_bands(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    noise = " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(200))
    # No 8 words are alike, yet each line says nearly the same.
    drone = "\n".join(f"the same old line {i} again" for i in range(900))
    mixed = prose + "\n" + noise
    df = spark.createDataFrame(enumerate([prose, noise, drone, mixed]), "doc_id long, text string")
    found = {r.doc_id: r for r in compression.rated(df).collect()}
    assert [found[i].kept for i in range(4)] == [True, False, False, False]
    assert not found[1].base_failed and not found[2].base_failed
    assert found[3].n_chunks_outside > 0


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(
        spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"), "doc_id"
    )
    assert compression.rated(docs).where("NOT kept AND NOT base_failed").count() == 0


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    found = [
        (i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()
    ]
    labels = ",".join(sorted({label for _, label in found}))
    return (len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, labels)


def test_license_base(spark, sf_dir, odd, no_rows):
    extra = [
        (900, "Under the MIT License, or: under the mit-license! CC-BY-NC. cc by nc nd; xcc by nc"),
        (901, "apache license version 2.0 apache license version 22 under the\nmit\tlicense"),
        (902, "under the mit"),
    ]
    extra = spark.createDataFrame(extra, "doc_id long, text string")
    for docs in (odd, extra, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = [(r.doc_id, *license_base(r.text)) for r in docs.collect()]
        found = licenses.scanned(docs).collect()
        got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found]
        assert sorted(got, key=str) == sorted(want, key=str)
        for r in found:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
            assert (r.score > 0) == bool(r.labels)
    assert licenses.scanned(no_rows).collect() == []


def test_misspelt_notices():
    def labels(text):
        return {(label, edits) for label, _, _, edits in licenses.notices(text)}

    assert labels("it is undr the mit licence okay") == {("mit", 2)}
    assert labels("underthe mit license") == {("mit", 1)}
    assert labels("under the mpl license") == set() == labels("under the bit license")
    assert labels("apache licence versoin 2 0") == {("apache-2", 3)} or labels("apache licence version 2") == {("apache-2", 1)}
    assert labels("apache license version 3") == set()
    assert ("gpl", 0) in labels("the gnu general public license")
    assert labels("gnu lesser general public license") == {("lgpl", 0)}
    assert labels("nothing to see in this sentence about the weather") == set()


def test_pieces_find_whatever_the_pattern_finds():
    """Random edits within the bound: searching the whole text finds no more than the seeds do."""
    rng = random.Random(8)
    plans, _ = licenses._search()
    for plain, edits, pattern, label in plans * 6:
        text = list(plain)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], [rng.choice("abc ")], [text[at], rng.choice("xyz")]])
        text = "before " + " ".join("".join(text).split()) + " after"
        if pattern.search(text):
            assert label in {n[0] for n in licenses.notices(text)}


def secret_base(text):
    text, found = text or "", []
    rules = (
        ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    )
    for order, (kind, pattern, group, least) in enumerate(rules):
        flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return [s for _, _, s in sorted(found)]


def der(*parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return b"\x30" + size + body


def test_secret_structure():
    rng = random.Random(2)
    number = lambda n: b"\x02" + bytes([n]) + b"\x11" + rng.randbytes(n - 1)
    key = der(b"\x02\x01\x00", *[number(60) for _ in range(5)])
    box = secrets.MAGIC + b"\0\0\0\4none\0\0\0\4none\0\0\0\0\0\0\0\1" + rng.randbytes(60)
    b64 = lambda x: base64.b64encode(x).decode()
    web = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    kinds = lambda text: [s[0] for s in secrets.spans(text)]
    assert kinds(f"é {b64(key)} x") == ["der"] and secrets.spans(f"é {b64(key)} x")[0][1] == 2
    assert kinds(key.hex().upper()) == ["der"] and kinds(key.hex()) == ["hex", "der"]
    assert kinds(b64(box)) == ["ssh"]
    assert kinds(b64(key[:-1] + b"xx")) == [] and kinds(b64(rng.randbytes(200))) == []
    token = f"{web({'alg': 'HS256'})}.{web({'sub': 1})}.c2ln"
    assert kinds(token) == ["jwt"] and kinds(f"{web({'typ': 1})}.{web({'sub': 1})}.c2ln") == []
    assert "pem" in kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{b64(key)}\n-----END RSA PRIVATE KEY-----")
    assert kinds("-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----") == []


def test_secret_base(spark, sf_dir, odd, no_rows, tmp_path):
    rng = random.Random(6)
    bits = ["password", "TOKEN", "api_key", "apikey", "secret", "paſſword", " ", ":", "=", '"', "'", "abcdef", "a", "AKIA", "X" * 16,
            "deadbeef" * 3, "0123456789abcdef" * 2, "\n", "é", "-", "."]
    made = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(600)]
    for docs in (odd, spark.createDataFrame(made, "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        docs.write.parquet(str(tmp_path / f"{id(docs)}" / "documents.parquet"))
        found = queries.op5_secret_scan(spark, str(tmp_path / f"{id(docs)}")).collect()
        want = []
        for r in docs.collect():
            own = secret_base(r.text)
            n = [sum(s.startswith(k + ":") for s in own) for k in secrets.BASE]
            want.append((r.doc_id, *n, hashlib.sha256(",".join(own).encode()).hexdigest()))
        got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert secrets.scanned(no_rows).collect() == []
