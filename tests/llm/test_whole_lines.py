"""Line dedup as the pipeline runs it: no text and no line is passed over."""

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, source string"


def after(spark, rows):
    return {(r.doc_id, r.source): r.text for r in pipeline.strip_boilerplate(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}


def test_only_proven_copies_stay_whole(spark):
    menu, legal = "All our pages at a glance", "Every right to this page is reserved"
    short = [(i, f"{menu}\nown {i}\n{legal}", f"s{i}") for i in range(12)]
    bare = (50, menu, "s1")
    copies = [(100 + i, f"{menu}\nA copied line\n{legal}", f"s{i}") for i in range(12)]
    turned = (120, f"{legal}\n A copied line\n{menu}\n", "s0")
    no_ids = [(None, f"{legal}\nwithout an id", f"s{i}") for i in range(3)]
    twice = [(200, f"{menu}\nloaded twice", "s2")] * 2
    found = after(spark, [*short, bare, *copies, turned, *no_ids, *twice])
    assert all(found[i, s] == f"own {i}" for i, _, s in short)
    assert found[50, "s1"] == "" and found[200, "s2"] == "loaded twice"
    assert all(found[i, s] == text for i, text, s in [*copies, turned, *no_ids])


def test_lines_without_a_blank_count(spark):
    common = ["Home|About|Contact", "版权所有不得转载", "https://example.org/imprint", "Terms of use", "Les."]
    rows = [(i, "\n".join([f"the own words of page {i}, longer than all of the menu lines " * 3, *common, f"page{i}"]), f"s{i}") for i in range(11)]
    rare = [(i, text + "\nnine", source) for i, text, source in rows[:9]]
    found = after(spark, rare + rows[9:])
    for i, text, source in rare + rows[9:]:
        assert found[i, source] == "\n".join(x for x in text.split("\n") if x not in common)


def test_columns_of_any_kind_and_name_come_along(spark):
    schema = "doc_id long, text string, source string, _had_text string, _empty string, found int, whole string, `a b` struct<`c d`: int, e: array<struct<`f.g`: string>>>"
    rows = [(1, None, "a", "mine", "mine", 3, "mine", (1, [("x",)])), (2, "x y\nz", "b", "mine", None, None, "w", (None, None))]
    docs = spark.createDataFrame(rows, schema)
    found = pipeline.strip_boilerplate(spark, docs, "")
    assert found.schema.names == docs.schema.names
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, docs.collect()))
