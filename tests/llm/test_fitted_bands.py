"""Compression limits that follow the corpus, against a plain version and with planted junk."""

import random
from collections import defaultdict

import zstandard

from tidemark.llm import compression as c

WORDS = 6000
ANY = (0.0, float("inf"))


def prose(rng, vocabulary, size):
    """Words whose frequency falls with their rank, as in written language."""
    out, n = [], 0
    while n < size:
        out.append(vocabulary[int(len(vocabulary) ** rng.random()) - 1])
        n += len(out[-1]) + 1
    return " ".join(out)[:size]


def spaced(rng, letters, size):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(size // 7))[:size]


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9))) for _ in range(WORDS)]
    clean = [prose(rng, vocabulary, rng.randint(16_384, 30_000)) for _ in range(120)]
    clean += [prose(rng, vocabulary, rng.randint(200, 9000)) for _ in range(60)]
    junk = [spaced(rng, letters, 20_000) for letters in ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef")]
    # A clean text whose second half is junk, and the same with only a little of it.
    half, little = clean[0][:10_000] + junk[0][:10_000], clean[1][:16_000] + junk[0][:1000]
    return clean, junk, half, little


def plain_verdicts(texts):
    """From the documented rule; texts that fail the base rules are not among the inputs."""
    packer = zstandard.ZstdCompressor(level=c.LEVEL)
    ratio = lambda b: len(packer.compress(b)) / len(b)
    size_class = lambda n: n.bit_length() - 1 if n >= c.LIMITS[0][0] else None
    pieces = [[t[i : i + c.CHUNK] for i in range(0, len(t), c.CHUNK)] if len(t) >= c.CHUNK else [] for t in texts]
    seen = defaultdict(list)
    for size, r, chunks in {(len(t), ratio(t), tuple(p)) for t, p in zip(texts, pieces)}:
        seen[size_class(size)].append(r)
        seen["chunk"].extend(ratio(x) for x in chunks if len(x) == c.CHUNK)
    fitted = {}
    for name, ratios in seen.items():
        if name is not None and len(ratios) >= c.LEAST:
            bins = sorted(int(r * 1000) for r in ratios)
            q = [bins[-(-len(bins) * i // 4) - 1] / 1000 for i in (1, 2, 3)]
            reach = c.FENCE * (q[2] - q[0])
            fitted[name] = (min(q[0] - reach, (1 - c.SLACK) * q[1]), max(q[2] + reach, (1 + c.SLACK) * q[1]))

    def inside(r, size, chunk=False):
        fixed = c.CHUNK_LIMITS if chunk else ([x[1:] for x in c.LIMITS if size >= x[0]] or [ANY])[-1]
        low, high = fitted.get("chunk" if chunk else size_class(size), ANY)
        return fixed[0] <= r <= fixed[1] and low <= r <= high

    out = []
    for t, own in zip(texts, pieces):
        bad = [len(x) for x in own if not inside(ratio(x), len(x), len(x) == c.CHUNK)]
        out.append((len(bad), inside(ratio(t), len(t)) and sum(bad) <= c.MAX_CHUNKS * len(t)))
    return out


def test_against_a_plain_version(spark):
    clean, junk, half, little = corpus()
    texts = [*clean, *junk, half, little, clean[2], "short but long enough " + " ".join(map(str, range(20)))]
    found = c.rated(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).orderBy("doc_id").collect()
    assert not any(r.base_failed for r in found)
    assert [(r.n_chunks_outside, r.kept) for r in found] == plain_verdicts([t.encode() for t in texts])


def test_planted_junk_goes_and_clean_texts_stay(spark):
    clean, junk, half, little = corpus()
    texts = [*clean, *junk, half, little]
    found = c.rated(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).orderBy("doc_id").collect()
    kept = [r.kept for r in found]
    assert all(kept[: len(clean)])
    assert kept[len(clean) :] == [False, False, False, True]
    # The fixed limits alone let all of them pass.
    assert all(r.ratio <= 0.65 for r in found[len(clean) :])


def test_many_copies_do_not_move_the_limits(spark):
    clean, junk, _, _ = corpus()
    texts = [*clean, *junk[:1] * 2000]
    found = c.rated(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.kept for r in found] == [True] * len(clean) + [False] * 2000


def test_few_texts_have_fixed_limits_only(spark):
    clean, junk, _, _ = corpus()
    texts = [*clean[:4], *junk]
    assert all(r.kept for r in c.rated(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect())
