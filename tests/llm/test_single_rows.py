"""One row of each class stays, also where ids repeat or are missing."""

from tidemark.llm import minhash

SCHEMA = "doc_id long, text string, source string"


def test_one_row_of_each_class(spark):
    page = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    rows = [(1, page(1), "a")] * 3 + [(2, page(1), "a"), (1, page(1) + " more", "b")]
    rows += [(None, page(2), s) for s in "abc"] + [(None, page(2) + " more", "a")]
    rows += [(None, page(3), "a"), (5, page(3), "b")]
    rows += [(7, "", "a")] * 2 + [(8, "", "a"), (9, None, "a"), (10, page(4), "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    stay = minhash.drop_near_duplicates(df)
    assert stay.columns == df.columns
    found = stay.collect()
    assert sorted((str(r.doc_id), (r.text or "").split(" ")[0]) for r in found) == sorted(
        [("1", "word1x0"), ("None", "word2x0"), ("5", "word3x0"), ("7", ""), ("8", ""), ("9", ""), ("10", "word4x0")]
    )
    assert {tuple(r) for r in found} <= set(rows)
    # A table loaded twice leaves what it leaves when it is loaded once.
    twice = minhash.drop_near_duplicates(df.union(df)).select("doc_id", "text").collect()
    assert sorted(map(str, twice)) == sorted(str(r) for r in stay.select("doc_id", "text").collect())
