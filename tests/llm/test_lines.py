import random

from llm_cases import words

from tidemark.llm import lines

BLANK = " \t\x0b\x0c\r"


def line_set(text):
    return frozenset(x.strip(BLANK) for x in (text or "").split("\n") if words(x))


def brute(rows, min_sites, max_share):
    sites = {}
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if words(line):
                sites.setdefault(line.strip(BLANK), set()).add(source)
    held = {}
    for i, text, source in rows:
        held.setdefault(line_set(text), set()).add((i, text, source))
    found = []
    for i, text, _ in rows:
        own = (text or "").split("\n")
        bad = [n for n, line in enumerate(own) if len(sites.get(line.strip(BLANK), ())) >= min_sites]
        size = sum(len(x.strip(BLANK)) for x in own)
        # Only a text mostly of boilerplate, whose lines another document has too, stays whole.
        strip = sum(len(own[n].strip(BLANK)) for n in bad) <= max_share * size or len(held[line_set(text)]) < 2
        kept = "\n".join(x for n, x in enumerate(own) if n not in bad) if strip else text or ""
        found.append((i, sum(bool(words(x)) for x in own), len(bad), bad if strip else [], kept))
    return sorted(found, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_boilerplate, r.removed, r.kept_text) for r in df.collect()), key=str)


def test_spread_around_the_threshold(spark):
    """Lines on 1 to 60 sites, so that sketches settle some and exact counts the rest."""
    rng = random.Random(4)
    common = {n: f"line seen on {n} sites" for n in range(1, 61)} | {61: "single", 62: "two words"}
    pages = {s: [] for s in range(60)}
    for n, line in common.items():
        for s in rng.sample(range(60), min(n, 60)):
            pages[s] += [line] * rng.randint(1, 2)
    rows = []
    for i, (s, own) in enumerate(pages.items()):
        source = None if s == 0 else f"site{s}"
        # Three short pages and one long page per site.
        for part in (own[::3], own[1::3], own[2::3]):
            rows.append((10 * i + len(rows) % 3, "\n".join([f"  {x}\t" for x in part] + [""]), source))
        rows.append((10 * i + 5, "\n".join([*own, *(f"{s} own text {k} " * 5 for k in range(60))]), source))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for sites in (1, 10, 30):
        assert got(lines.stripped(df, min_sites=sites)) == brute(rows, sites, lines.MAX_SHARE)
    assert got(lines.stripped(df, min_sites=12, max_share=1.0)) == brute(rows, 12, 1.0)


def test_odd_rows(odd, no_rows):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    for sites in (2, 3):
        assert got(lines.stripped(odd, min_sites=sites)) == brute(rows, sites, lines.MAX_SHARE)
    assert lines.stripped(no_rows).collect() == []
