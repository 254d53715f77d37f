import random

import numpy as np
import pyarrow as pa
from llm_cases import ascii_lower, words

from tidemark.llm import words as w


def test_cut_matches_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \t\n\x0b\x0c\ré 𝔘\x00.") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " ", "x", "x" * 5_000_000]
    seen = {}
    for part in w.cut(pa.array(texts), w.LOWER):
        for d in range(len(part)):
            own = words(ascii_lower(texts[part.row + d]))
            a, b = part.first[d], part.first[d + 1]
            got = [part.data[s:e].tobytes().decode() for s, e in zip(part.starts[a:b], part.ends[a:b])]
            assert got == own
            for word, h in zip(own, part.hashes[a:b].tolist()):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_of_an_array_and_sequences():
    texts = pa.array(["zero", "a b c a b c", None, "b c a"]).slice(1)
    (part,) = w.cut(texts, w.AS_IS)
    assert part.counts.tolist() == [6, 0, 3]
    grams = part.grams(3)
    assert grams[0] == grams[3] and grams[1] == grams[6] and grams[0] != grams[1]
    assert part.sequences(np.array([0, 3]), np.array([3, 6])).tolist() == grams[[0, 3]].tolist()
    assert [a.tolist() for a in part.gram_ranges(3)] == [[0, 6, 6], [4, 6, 7]]


def test_parts_of_a_long_text_do_not_matter(monkeypatch):
    text = " ".join(f"w{i % 977}" * (i % 5 + 1) for i in range(4000))
    (whole,) = w.cut(pa.array([text]), w.AS_IS)
    for size in (1, 7, 300):
        monkeypatch.setattr(w, "SLICE_BYTES", size)
        (parts,) = w.cut(pa.array([text]), w.AS_IS)
        assert (parts.hashes == whole.hashes).all()
