import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import ascii_lower

from tidemark.llm import decontaminate


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def bag(w):
    """5-word shingles; fewer words are one shingle."""
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    weigh = lambda x: sum(n * sum(len(p.encode()) for p in s) for s, n in x.items())
    return weigh(a & b) / weigh(a | b) if a | b else 0.0


def brute(docs, items, percent=80):
    found = []
    for d, text in docs:
        w = split(text)
        for i, item in items:
            own = split(item)
            if not own or not w or (len(own) >= 5 and not bag(own).keys() & bag(w).keys()):
                continue
            windows = [w[s : s + len(own)] for s in range(max(1, len(w) - len(own) + 1))]
            scores = [similarity(bag(own), bag(x)) for x in windows]
            if max(scores) * 100 >= percent:
                at = scores.index(max(scores))
                found.append((d, i, round(max(scores), 9), at, len(windows[at])))
    return sorted(found, key=str)


def got(df):
    return sorted(((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word, r.n_words) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(rng.randint(3, 70)))) for i in range(40)] + [(90, None), (91, ""), (92, "a b c d")]
    items += [(93, items[7][1]), (7, items[7][1]), (94, "x y z x y z x y z x y z")]
    docs = []
    for d in range(150):
        text = words(rng.randint(0, 120))
        if d % 2:
            leak = items[rng.randrange(40)][1].split()
            for _ in range(rng.randint(0, 3)):
                leak[rng.randrange(len(leak))] = rng.choice(vocabulary)
            leak = leak[rng.randint(0, 3) : len(leak) - rng.randint(0, 3)]
            at = rng.randint(0, len(text))
            text[at:at] = leak
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(text).replace("w1", rng.choice(["w1", "W1"]))))
    return docs + [(200, items[20][1].upper()), (201, "x y z " * 50)], items


def test_edited_passages(spark, planted):
    docs, items = planted
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, sorted(set(items), key=str))
    assert len(want) > 15 and any(s < 1 for _, _, s, _, _ in want)
    assert got(decontaminate.contaminated(df, bench)) == want
    # The same from many small blocks of the benchmark.
    assert got(decontaminate.contaminated(df, bench, block_words=500)) == want


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"t{x}" for x in rng.integers(0, 50, 20))) for i in range(50)]
    items = decontaminate.Items.of(rows, 5)
    prints = []
    for apart in range(0, 129, 4):
        bits = np.unpackbits(items.prints[apart % 50])
        bits[rng.choice(256, apart, replace=False)] ^= 1
        prints.append(np.packbits(bits))
    prints = np.array(prints)
    window, item = items.within_radius(prints)
    distance = np.bitwise_count(prints[:, None] ^ items.prints[None]).sum(axis=2)
    assert set(zip(window.tolist(), item.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(distance <= decontaminate.RADIUS))))


def test_odd_rows(spark, odd, no_rows):
    bench = spark.createDataFrame([(1, " ".join(f"body{i}" for i in range(40))), (None, "wörds ünïcödé wörds ünïcödé wörds")], "item_id long, text string")
    found = decontaminate.contaminated(odd, bench)
    assert {r.doc_id for r in found.where("item_id = 1").collect()} == {9, 10, 11, None}
    assert {r.doc_id for r in found.where("item_id IS NULL").collect()} <= {12}
    assert found.where("doc_id = 10").count() == 2
    stay = decontaminate.drop_contaminated(odd, bench)
    assert stay.columns == odd.columns and stay.where("doc_id IN (9, 11)").count() == 0 and stay.where("doc_id = 10").count() == 1
    none = bench.limit(0)
    assert decontaminate.contaminated(odd, none).collect() == [] == decontaminate.contaminated(no_rows, bench).collect()
    assert decontaminate.drop_contaminated(odd, none).count() == odd.count()


def test_short_items_match_where_their_words_stand(spark):
    docs = [(1, "so A b, c d e"), (2, "a b x c d"), (3, "a b c"), (4, ""), (5, "one ONE"), (6, "a b c d"), (7, "b c d a b c d")]
    items = [(1, "a b c d"), (2, "one"), (3, "one"), (4, "a b c d"), (5, "x c")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = got(decontaminate.contaminated(df, bench))
    assert found == brute(docs, items)
    assert (1, 4, 1.0, 1, 4) in found and (5, 3, 1.0, 0, 1) in found
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()} == {3, 4}
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench, block_words=4).collect()} == {3, 4}


def test_a_text_that_repeats_itself_costs_little():
    """A megabyte of one word, or of one item, against items of the same words: time by the length, memory flat."""
    import time
    import tracemalloc

    import pyarrow as pa

    item = " ".join(f"w{i % 37}" for i in range(100))
    for word, rows in (("a", [(1, " ".join(["a"] * 100))]), (item, [(1, item), (2, " ".join(f"w{i % 37}" for i in range(9, 80)))])):
        items = decontaminate.Items.of(rows, 5)
        took, held = [], []
        for size in (250_000, 500_000, 1_000_000):
            text = (word + " ") * (size // (len(word) + 1))
            batch = pa.RecordBatch.from_arrays([pa.array([text])], ["_text"])
            tracemalloc.start()
            list(decontaminate._found(batch, items, 5, 80))
            held.append(tracemalloc.get_traced_memory()[1] / size)
            tracemalloc.stop()
            start = time.process_time()
            assert [x[1] for x in decontaminate._found(batch, items, 5, 80)][0] == 0
            took.append(time.process_time() - start)
        assert took[-1] < 20 and took[-1] < 8 * took[0] + 1
        # The words of the text, their hashes and sums: a fixed number of bytes a byte.
        assert max(held) < 400
