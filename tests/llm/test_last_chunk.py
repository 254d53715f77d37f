"""The compression bands see every byte of a text."""

import base64
import random

from pyspark.sql import functions as F

from tidemark.llm import compression


def test_junk_at_the_end_is_rated(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(6000))
    junk = base64.b64encode(rng.randbytes(9000)).decode()
    n = compression.CHUNK
    texts = [
        prose[:n] + junk[: n - 1], junk[:n] + prose[: n - 1], prose[:n] + junk[:1600], prose[:n] + prose[n : n + 1600],
        prose[: 4 * n] + junk[:1100], prose[: n - 1], prose[:n],
    ]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    found = {r.doc_id: r for r in compression.rated(df).collect()}
    assert not any(r.base_failed for r in found.values())
    assert [found[i].kept for i in range(7)] == [False, False, False, True, True, True, True]
    assert [found[i].n_chunks for i in range(7)] == [2, 2, 2, 2, 5, 0, 1]
    assert [found[i].n_chunks_outside for i in range(7)] == [1, 1, 1, 0, 1, 0, 0]
    # The limits of the whole text let the first one pass.
    fixed = compression._within(F.lit(found[0].ratio), F.lit(len(texts[0])))
    assert spark.range(1).select(fixed).first()[0]
