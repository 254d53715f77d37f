"""Class-based language model against plain versions of its parts, and by what it learns."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import SCHEMA, ascii_lower, words
from pyspark.sql import functions as F

from tidemark.llm import lm
from tidemark.llm.words import LOWER, cut

END = None


def trains():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1


def held_out(doc_id):
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def tokens_of(text):
    return [*words(ascii_lower(text)), END]


def hash_of(word):
    return int(lm.END) if word is END else int(next(cut(pa.array([word]), LOWER)).hashes[0])


def test_base_columns_of_odd_rows(odd):
    rows = odd.collect()
    train = Counter(t for r in rows if not held_out(r["doc_id"]) for t in tokens_of(r["text"]))
    total, distinct = sum(train.values()), len(train)
    want = []
    for r in rows:
        tokens = tokens_of(r["text"])
        base = sum(math.log10((train[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        want.append((r["doc_id"], held_out(r["doc_id"]), len(tokens), sum(train[t] > 0 for t in tokens), total, round(base, 5)))
    found = lm.score_texts(odd, trains(), n_heads=16, n_classes=3).select(
        F.when(F.col("_id") != -(2**63), F.col("_id")), ~F.col("trains"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 5)
    )
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def planted(n, seed):
    """Nouns follow adjectives and adjectives follow nouns; which word of a kind comes is chance."""
    draw = random.Random(seed)
    kinds = [[f"adj{i}" for i in range(40)], [f"Noun{i}" for i in range(40)], [f"verb{i}" for i in range(40)]]
    texts = []
    for d in range(n):
        text = [draw.choice(kinds[i % 3]) for i in range(draw.randrange(3, 60))]
        texts.append((d, " ".join(text), "en", "s", 0, "clash", "clash", 3, "clash", 0.5, 1, "clash"))
    texts.append((n, "rareadj noun3 verb2 rareadj noun5 verb9 rareadj noun7 verb1", *texts[0][2:]))
    return texts


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(planted(300, 1), SCHEMA).repartition(3)
    slices = lm.slices_of(docs, trains())
    counts = {r["word"]: r["n"] for r in lm.word_counts(slices).collect()}
    ordered = sorted((w for w in counts if w != hash_of(END)), key=lambda w: (-counts[w], w))[:100]
    hashes = np.array([hash_of(END)] + [w % 2**64 for w in ordered], np.uint64)
    unplaced = lm.Heads(hashes, np.zeros(len(hashes), np.int64))
    bigrams = slices.select("words", "docs").mapInArrow(lm._head_bigrams(unplaced), "pair long, n long")
    bigrams = bigrams.groupBy("pair").agg(F.sum("n").alias("n"))
    heads, pairs = lm.cluster(bigrams, hashes, 3)
    rare = lm.place_rare(slices, heads, pairs, 3)
    return docs, counts, heads, pairs, rare


def test_classes_are_found(fitted):
    _, _, heads, pairs, rare = fitted
    class_of = dict(zip(heads.hashes.tolist(), heads.classes.tolist()))
    class_of |= {r["word"] % 2**64: r["class"] for r in rare.collect()}
    kinds = [{class_of[hash_of(f"{kind}{i}") % 2**64] for i in range(40)} for kind in ("adj", "noun", "verb")]
    assert all(len(k) == 1 for k in kinds) and len(set.union(*kinds)) == 3
    # A word outside the heads goes where its own occurrences say.
    assert class_of[hash_of("rareadj") % 2**64] in kinds[0]


def test_rare_words_by_plain_sums(fitted):
    docs, counts, heads, pairs, rare = fitted
    class_of = dict(zip(heads.hashes.tolist(), heads.classes.tolist()))
    before = defaultdict(Counter)
    for r in docs.collect():
        if not held_out(r["doc_id"]):
            tokens = [hash_of(t) % 2**64 for t in tokens_of(r["text"])]
            for a, b in zip([hash_of(END) % 2**64, *tokens], tokens):
                if b not in class_of:
                    before[b][class_of.get(a)] += 1
    found = {r["word"] % 2**64: (r["n"], r["class"]) for r in rare.collect()}
    assert set(found) == set(before)
    after = pairs.sum(0)
    for word, seen in before.items():
        scores = []
        for c in range(1, 4):
            total = 0.0
            for b, n in seen.items():
                if b is None:
                    chance = (after[c] + 1) / (after[1:].sum() + 4)
                else:
                    chance = (pairs[b, c] + 1) / (pairs[b].sum() + 4)
                total += n * (math.log(chance) - math.log(after[c] + 1))
            scores.append(total)
        n, chosen = found[word]
        assert n == sum(seen.values()) == counts[word if word < 2**63 else word - 2**64]
        assert scores[chosen - 1] >= max(scores) - 1e-3


def test_scores_by_plain_sums(fitted):
    docs, counts, heads, _, rare = fitted
    counts = {w % 2**64: n for w, n in counts.items()}
    class_of = dict(zip(heads.hashes.tolist(), heads.classes.tolist())) | {r["word"] % 2**64: r["class"] for r in rare.collect()}
    by_class, follows, once = Counter(), Counter(), Counter()
    for w, n in counts.items():
        by_class[class_of[w]] += n
    end = hash_of(END) % 2**64
    texts = [(r["doc_id"], held_out(r["doc_id"]), [hash_of(t) % 2**64 for t in tokens_of(r["text"])]) for r in docs.collect()]
    for _, out, tokens in texts:
        if out:
            continue
        for a, b in zip([end, *tokens], tokens):
            follows[class_of[a], class_of[b]] += 1
            once[class_of[a]] += counts[b] == 1 and b != end
            if counts[a] == 1 and a != end:
                follows[4, class_of[b]] += 1
                once[4] += counts[b] == 1 and b != end
    total, n_once = sum(counts.values()), sum(n == 1 for w, n in counts.items() if w != end)
    into = {c: sum(follows[b, c] for b in range(4)) for c in range(4)}

    def step(a, b):
        n = sum(follows[a, c] for c in range(4))
        new = (once[a] + lm.PRIOR * (n_once + 0.5) / (total + 1)) / (n + lm.PRIOR)
        share = (into.get(b, 0) + 0.5) / (total + 0.5 * 4)
        return new if b == 4 else (1 - new) * (follows[a, b] + lm.PRIOR * share) / (n + lm.PRIOR)

    for a in range(5):
        assert sum(step(a, b) for b in range(5)) == pytest.approx(1)
    want = {}
    for id_, _, tokens in texts:
        classes = [class_of.get(t, 4) for t in tokens]
        score = sum(math.log10(step(a, b)) for a, b in zip([0, *classes], classes))
        want[id_] = score + sum(math.log10(counts[t] / by_class[class_of[t]]) for t in tokens if t in counts)
    found = {r["_id"]: r["score"] for r in lm.score_texts(docs, trains(), n_heads=101, n_classes=3).collect()}
    # The rare words' transitions after a word seen once are the only ones between texts' parts: none crosses a text.
    assert found == pytest.approx(want, abs=1e-6)


def test_a_move_is_worth_what_the_likelihood_says():
    draw = np.random.default_rng(2)
    bigrams = draw.integers(0, 9, size=(12, 12)) * draw.integers(0, 2, size=(12, 12))
    classes = np.concatenate([[0], 1 + np.arange(11) % 3])

    def counted(classes):
        one_hot = np.eye(4, dtype=np.int64)[classes]
        return bigrams.T @ one_hot, bigrams @ one_hot, np.diagonal(bigrams)

    for w in range(1, 12):
        values = []
        for c in range(1, 4):
            moved = classes.copy()
            moved[w] = c
            values.append(lm.likelihood(lm.class_bigrams(counted(moved)[0], moved, 4)))
        after = lm.exchange(*counted(classes), classes, 4, np.arange(12) == w)
        assert values[after[w] - 1] == pytest.approx(max(values))


def test_scores_beat_single_words_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = lm.score_texts(docs, trains()).where("NOT trains").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_reruns_and_partitions_agree(spark):
    docs = spark.createDataFrame(planted(80, 3), SCHEMA)
    runs = [
        sorted((r["_id"], round(r["score"], 9)) for r in lm.score_texts(docs.repartition(n), trains(), n_heads=60, n_classes=4).collect())
        for n in (1, 5)
    ]
    assert runs[0] == runs[1]


def test_nothing_to_learn_from(spark, no_rows):
    assert lm.score_texts(no_rows, trains()).count() == 0
    one = spark.createDataFrame([(1, "a b", *planted(1, 1)[0][2:])], SCHEMA)
    row = lm.score_texts(one, F.lit(False)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert math.isfinite(row["score"])
