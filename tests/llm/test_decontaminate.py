"""Benchmark items in documents: short items, and a nested-loop template matcher."""

import re

from folioscope.llm import decontaminate

PUNCTUATION = decontaminate.PUNCTUATION


def found(spark, docs, items, **how):
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(rows, bench, **how).collect())


def test_short_items(spark):
    items = [(1, "Which river is longest?"), (2, "Which river is longest?"), (3, "Why not?"), (4, "?!"), (5, "Is 5 more than 3"), (6, None)]
    docs = [
        (10, "He asked: which river is LONGEST, and left."), (11, "Which river is the longest?"), (12, "why not?"), (13, "why not go"),
        (14, "Which river is longest?"), (14, "Which river is longest?"), (15, "is 5 more than 3 now"), (16, "is 5 more than 4 now"), (17, ""), (18, None), (None, "Why not"),
    ]
    want = [(10, 1), (10, 2), (12, 3), (14, 1), (14, 2), (15, 5)]
    for limit in (0, 500_000):
        rows = spark.createDataFrame(docs, "doc_id long, text string")
        got = decontaminate.leaks(rows, spark.createDataFrame(items, "item_id long, text string"), max_broadcast=limit)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"]) for r in got.collect()) == [(-1, 3), *want]
    long = "In the old town they bought some apples for her sister and then gave pears to him before going home"
    assert found(spark, [(1, f"so {long} ok"), (2, "ask why not please, ok"), (3, "which river is longest")], [(8, long), (1, "Which river is longest?")]) == [(1, 8), (3, 1)]


def shape(text):
    """Template words and their values in plain Python: <num>, <name>, <unit>, or the word."""
    joined = []
    raw = text.split()
    for i, w in enumerate(raw):  # a run of capitalised words inside a sentence is one word
        if i >= 2 and w[:1].isupper() and raw[i - 1][:1].isupper() and re.fullmatch(r"\w[\w'-]*", raw[i - 1]) and raw[i - 2][-1] not in ".!?:\"":
            joined[-1] += "_" + w
        else:
            joined.append(w)
    out = []
    for i, w in enumerate(joined):
        bare = w.strip(PUNCTUATION)
        low = bare.lower()
        inside = i > 0 and joined[i - 1][-1] not in ".!?:\""
        kind = "<num>" if bare[:1].isdigit() else "<name>" if bare[:1].isupper() and inside else "<unit>" if low in decontaminate.UNITS else ""
        out.append((kind or low, low if kind else ""))
    return out


def whole_copy(doc, item):
    """Whether the item, but for its first word, stands in the document with other names, units and numbers, one to one."""
    d, b = shape(doc), shape(item)[1:]
    for at in range(len(d) - len(b) + 1):
        part = d[at : at + len(b)]
        if [t for t, _ in part] == [t for t, _ in b]:
            pairs = {(t, v, w) for (t, v), (_, w) in zip(b, part, strict=True) if v}
            if len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs}):
                return True
    return False


def test_whole_copies_equal_a_nested_loop(spark):
    items = [
        (i, f"In the {a} town Alice {b} 12 apples for {i + 3} dollars and then Alice gave 7 kg of {a} pears to Bob Miller before going home {b}")
        for i, (a, b) in enumerate([("old", "bought"), ("new", "sold"), ("red", "found"), ("wet", "lost")])
    ]
    docs = []
    for i, t in items:
        docs += [
            (10 * i, f"well, {t} again"),
            (10 * i + 1, "so " + t.replace("Alice", "Carol").replace("Bob Miller", "Dave").replace("12", "40").replace("7 kg", "9 miles")),
            (10 * i + 2, "so " + t.replace("Alice gave", "Carol gave").replace("Bob Miller", "Alice")),
            (10 * i + 3, t.split("dollars")[0]),
        ]
    docs += [(900, "a clean text about nothing " * 30), (901, "Alice Bob Carol " * 40)]
    want = sorted((d, i) for d, text in docs for i, t in items if whole_copy(text, t))
    assert found(spark, docs, items, share=1.0, window=10_000) == want and len(want) == 8
