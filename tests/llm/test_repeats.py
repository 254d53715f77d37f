import random

from llm_cases import words

from tidemark.llm.repeats import cut_repeats


def brute(rows, n):
    """Kept words per row; a repeat of the window must start under a smaller id."""
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    found = []
    for i, text in rows:
        w, gone = words(text), set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        found.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(found, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()), key=str)


def test_random_texts_with_shared_passages(spark):
    rng = random.Random(5)
    passages = [[rng.choice("abcdefgh") for _ in range(30)] for _ in range(6)]
    rows = []
    for i in range(120):
        text = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(30)] = "edit"
            a, b = sorted(rng.sample(range(31), 2))
            at = rng.randint(0, len(text))
            text[at:at] = p[a:b]
        rows.append((rng.choice([i, i, i, i // 2]), rng.choice([" ", "\n", " \t "]).join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(cut_repeats(df, window=8, seed=3)) == brute(rows, 8)
    assert got(cut_repeats(df, window=8, seed=8)) == brute(rows, 8)


def test_odd_rows(odd, no_rows):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = cut_repeats(odd)
    assert got(found) == brute(rows, 50)
    for r in found.where("n_removed > 0").collect():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    assert cut_repeats(no_rows).collect() == []
