"""Groups of near-duplicates: components, hubs, and which row of a group stays."""

import numpy as np

from folioscope.llm import common, simhash


def labels_of(pairs):
    label = {}

    def top(i):
        label.setdefault(i, i)
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        label[b] = a
    return {i: top(i) for i in label}


def test_components_with_hubs_and_chains(spark):
    rng = np.random.default_rng(4)
    pairs = [(5000, int(i)) for i in range(5001, 5400)] + [(int(i) + 7000, int(i) + 7001) for i in rng.permutation(150)]
    pairs += [tuple(map(int, p)) for p in rng.integers(0, 300, (120, 2))] + [(9001, 9000), (9001, 9002), (8500, 9002)]
    want = {k: v for k, v in labels_of([p for p in pairs if p[0] != p[1]]).items()}
    got = common.connected_components(spark.createDataFrame(pairs + pairs[:50], "u long, v long").repartition(3)).collect()
    assert {r["node"]: r["label"] for r in got} == want and len(got) == len(want)
    assert common.connected_components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_small_graphs_are_collected(spark):
    pairs = [(5, 9), (9, 2), (7, 7), (11, 10), (12, 11), (-3, 5)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    got = {r["node"]: r["label"] for r in common.connected_components(edges, collected=100).collect()}
    assert got == {5: -3, 9: -3, 2: -3, -3: -3, 11: 10, 10: 10, 12: 10} == {r["node"]: r["label"] for r in common.connected_components(edges, collected=2).collect()}


def test_vantage_leaves_lose_no_pair_and_save_comparisons():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2, (12, 640))
    rows = np.array([c ^ (rng.random(640) < 0.06) for c in centres for _ in range(60)])[rng.permutation(720)]
    for data, radius, saves in ((rows, 152, True), (rng.integers(0, 2, (300, 640)), 152, False)):
        far = np.array([(data != x).sum(axis=1) for x in data])
        meets, homes, compared = np.zeros(far.shape, bool), [], 0
        for part, own in simhash.vantage_leaves(len(data), lambda some, data=data: lambda v: (data[some] != data[v]).sum(axis=1), radius):
            meets[np.ix_(own, part)] = True
            homes += own.tolist()
            compared += len(own) * len(part)
        assert sorted(homes) == list(range(len(data))) and meets[far <= radius].all()
        assert compared < 0.5 * far.size if saves else compared <= far.size


def test_crowded_shards_are_searched_through_trees(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[: 60 + 12 * (i % 5)] + [f"x{i % 7}.{j}" for j in range(20 + i % 3)] + [f"z{rng.integers(0, 40)}"]) for i in range(300)]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    pairs = [(i, j) for i in range(300) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {i: i for i in range(300)} | labels_of(pairs)
    monkeypatch.setattr(simhash, "LEAF", 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()} == want


def test_least_of_crowded_and_other_keys(spark):
    rows = [(1, i) for i in range(500, 0, -1)] + [(k, k + 7) for k in range(2, 90)] + [(3, 1)]
    got = common.with_least(spark.createDataFrame(rows, "k long, v long"), "k", "v", len(rows)).collect()
    low = {k: min(v for j, v in rows if j == k) for k, _ in rows}
    assert sorted((r["k"], r["v"], r["least"]) for r in got) == sorted((k, v, low[k]) for k, v in rows)


def test_one_row_of_each_group_stays(spark):
    long = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    rows = [
        (1, long("a"), "x"), (2, long("a"), "y"), (2, long("b"), "z"),  # id 2 holds a copy of 1 and a text of its own
        (None, long("b"), "u"), (None, long("c"), "v"), (None, long("c"), "w"), (7, None, "p"), (8, "", "q"), (9, long("d"), "r"), (9, long("d"), "r"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)
    kept = simhash.keep_one(docs, simhash.similar_groups(docs.select("doc_id", "text"))).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "label"}
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept) == sorted([(1, long("a")), (2, long("b")), (0, long("c")), (7, ""), (9, long("d"))])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(none).count() == 0
    assert simhash.keep_one(none, simhash.similar_groups(none)).count() == 0
