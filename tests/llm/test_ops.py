"""The training-data operators on small fixtures: brute force, round trips, held-out accuracy, and the odd cases."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash

from folioscope.llm import ann, common, decontaminate, langid, pieces, pii, queries, repeats, simhash, tokencount, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
#: Nulls, empty and blank texts, no letters, repeated rows, a long text, and columns that clash with results.
ODD = [
    (None, None), (None, "a text without an id"), (1, None), (2, ""), (3, "  \n\t "), (4, "1234 5678 !!"), (5, "same text here"), (5, "same text here"),
    (6, "ein " * 60000), (7, "\U0001f642\ufb01 ▁ x"), (8, "A" * 1200),
]
SCHEMA = "doc_id long, text string, lang string, score double, n_found int, ids string, lang_pred string, component_id long, n_tokens int, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 0.0, 1, "x", "y", 3, 4, "s", 5) for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return queries.table(spark, SF, "documents")


def bits_differ(a, b):
    return bin(a ^ b).count("1")


def test_simhash_equals_brute_force(spark, docs, odd):
    every = docs.select("doc_id", "text").where("doc_id > 8").union(odd.select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"] or "") for r in every.collect()]

    def fingerprint(text):
        w = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if len(h) < 5000 else None

    prints = [fingerprint(t) for _, t in rows]
    got = collections.Counter((r["doc_id"], r["fp"] & (2**64 - 1)) for r in simhash.components(every).collect())
    assert all(got[(i, p)] for (i, _), p in zip(rows, prints, strict=True) if p is not None) and sum(got.values()) == len(rows)
    found = {r["fp"] & (2**64 - 1): r["component_id"] for r in simhash.components(every, home_rows=16).collect()}
    known = sorted(found)
    label = {p: p for p in known}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if bits_differ(a, b) <= 4:
                label[root(b)] = root(a)
    groups = collections.defaultdict(set)
    ids = collections.defaultdict(list)
    for (i, _), r in [((r["doc_id"], 0), r["fp"] & (2**64 - 1)) for r in simhash.components(every).collect()]:
        if i is not None:
            ids[root(r)].append(i)
    for p in known:
        groups[root(p)].add(found[p])
    assert all(g == {min(ids[k], default=None)} for k, g in groups.items())


def test_simhash_chunks_agree(spark, docs, monkeypatch):
    whole = {r["doc_id"]: r["component_id"] for r in simhash.components(docs).collect()}
    monkeypatch.setattr(simhash.crowded_shards, "__defaults__", (7,))
    assert whole == {r["doc_id"]: r["component_id"] for r in simhash.components(docs).collect()}
    groups = simhash.similar_groups(docs.select("doc_id", "text"))
    same = {r["text"]: r["component_id"] for r in groups.join(docs, "doc_id").collect()}
    assert all(same[r["text"]] == r["component_id"] for r in groups.join(docs, "doc_id").collect())
    kept = simhash.keep_one(docs, groups)
    assert kept.count() == groups.select("component_id").distinct().count()


def test_repeats_equals_brute_force(spark, docs, odd):
    length = 60
    every = docs.select("doc_id", "text").where("doc_id > 8 and length(text) < 4000").limit(120).union(odd.select("doc_id", "text").where("doc_id is null or doc_id <> 6"))
    every = common.written(every, "every")
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in every.collect()]
    seen = collections.Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    want = collections.Counter()
    for doc, t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if cover[i] and (i == 0 or not cover[i - 1]))
        want[(doc, len(t), sum(cover), spans, hashlib.sha256(bytes(c for c, f in zip(t, cover, strict=True) if not f)).hexdigest())] += 1
    for limits in ({}, {"max_group": 1}, {"bin_rows": 5}):
        got = repeats.remove_repeats(every, length, **limits).collect()
        assert collections.Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in got) == want
        assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got if "\ufffd" not in r["text"])


def test_ann_recall_and_odd_vectors(spark):
    t = queries.table(spark, SF, "embeddings")
    rows = t.select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    nan = float("nan")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 20, [0.0] * 64), (10**6 + 40, [nan] * 64), (10**6 + 60, [1.0, 2.0]), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(dict)
    for r in ann.search(t.select("vec_id", "embedding").union(extra), "vec_id % 20 = 0").collect():
        got[r["query_id"]][r["vec_id"]] = (r["rank"], r["score"])
    hit = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[ids == ids[i]] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hit += len(set(best.tolist()) & set(got[ids[i]]))
        assert all(abs(v[1] - x[ids == k][0] @ x[i]) < 1e-12 for k, v in got[ids[i]].items()) and sorted(v[0] for v in got[ids[i]].values()) == list(range(1, 21))
    assert hit / (20 * (ids % 20 == 0).sum()) >= 0.9 and set(got) == set(ids[ids % 20 == 0].tolist())
    assert ann.search(t.where("false"), "vec_id % 20 = 0").count() == 0
    two = ann.search(t.where("vec_id in (0, 7)"), "vec_id % 20 = 0").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in two] == [(0, 1, 7)]


def test_pieces_equal_the_library(spark, docs, odd):
    import sentencepiece

    path = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
    model, library = pieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    every = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    for r in pieces.decode(pieces.encode(every, model), model).collect():
        assert r["ids"] == library.encode(r["text"] or "") and r["n_tokens"] == len(r["ids"])
        assert r["round_trip"] == (r["decoded"] == (r["text"] or "")) == ("▁" not in (r["text"] or ""))
    assert pieces.encode(odd, model).columns.count("ids") == 1


def test_unigram_path_is_the_cheapest():
    model = pieces.Model.__new__(pieces.Model)
    model.pieces, model.scores, model.kinds = ["<unk>", "a", "b", "ab", "abb", "bb"], [0.0, -2.0, -2.0, -2.5, -9.0, -1.0], [2, 1, 1, 1, 1, 1]
    model.bpe, model.rules, model.prefix, model.squeeze = False, {}, False, False
    assert pieces.Transducer(model).path("abb") == [1, 5]


def test_token_counts(spark, docs, odd):
    v = tokencount.Vocabulary(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken", queries.SPLIT, queries.END_OF_DOCUMENT)
    every = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    encode = v.encoder()
    want = collections.Counter((r["doc_id"], len(encode(r["text"] or ""))) for r in every.collect())
    for block in (1 << 20, 97):
        got = tokencount.count_tokens(every, v, block)
        assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
    assert tokencount.count_tokens(every.where("false"), v).count() == 0


def test_scan_of_a_foreign_file(spark, tmp_path):
    np.array([9, 1, 2, 9, 9, 3, 4, 5, 6, 7], "<u2").tofile(tmp_path / "a.bin")
    for block in (1, 2, 3, 100):
        got = sorted((r["ordinal"], r["n_tokens"]) for r in tokencount.scan(spark, f"file://{tmp_path}", 9, 2, block).collect())
        assert got == [(0, 0), (1, 2), (2, 0), (3, 5)]


def test_url_rules(spark):
    want = {
        "https://a.EXAMPLE.com/en/7x?y": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://x.com/en/9#/net/de/": ("x.com", "/en/9", "com/en/", "block"),
        "http://xcom/en/": ("xcom", "/en/", None, "allow"),
        "http://site.org/ads/1": ("site.org", "/ads/1", None, "block"),
        "no scheme.com/en/": ("", "", None, "allow"),
        "ftp://h?q://net/de/": ("h", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://q.net/de/" + "x" * 100000: ("q.net", "/de/" + "x" * 100000, "net/de/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*want, None])], "page_id long, url string, host string")
    for r in urlfilter.judge(pages, queries.url_rules()).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want[r["url"]]
    rule = urlfilter.Rule("block", pattern="||ads.*/pic^")
    assert rule.tokens() == {"ads", "pic"}
    assert urlfilter.judge(pages.where("false"), queries.url_rules()).count() == 0


def test_language(spark, odd):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    held = queries.op7_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    model = langid.fit(docs)
    for r in langid.predict(odd, model).collect():
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["lang_score"] <= 1
    none = langid.fit(odd.where("false"))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    code = langid.codewords(30)
    assert min((code[i] != code[j]).sum() for i in range(30) for j in range(i)) >= 10


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.1"
    rows = queries.op4_toxicity(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    wrong = sum(r["predicted"] for r in rows if not r["toxic"])
    caught = sum(r["predicted"] for r in rows if r["toxic"])
    assert caught >= 0.5 * sum(r["toxic"] for r in rows) and wrong <= 0.01 * len(rows)
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert {r["score"] < 0.5 for r in toxicity.score(odd, toxicity.fit(odd, labels.where("false"))).collect()} == {True}


def network(values, radices, kind, key):
    """The Feistel network in plain Python."""
    half = len(values) // 2
    a, b, ra, rb = values[:half], values[half:], radices[:half], radices[half:]
    for r in range(pii.ROUNDS):
        x, y, radix = (a, b, ra) if r % 2 == 0 else (b, a, rb)
        seed = "|".join([key, kind, str(r), ",".join(map(str, y))])
        x = [(v + int(hashlib.sha256(f"{seed}|{i}".encode()).hexdigest()[:12], 16)) % radix[i] for i, v in enumerate(x)]
        a, b = (x, b) if r % 2 == 0 else (a, x)
    return a + b


def test_pii(spark, odd):
    text = "card 4111111111111111 4111 1111 1111 1111 bad 4111111111111112 mail a.b1@x.com on 2021-02-28 not 2021-02-30 ip 10.0.0.255 call +1 (743) 555-3824 or 743-555-3824"
    docs = spark.createDataFrame([(1, text), (2, "again 2021-02-28 and a.b1@x.com")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k").collect()}
    new = rows[1]["text"]
    digits = network([int(c) for c in "11111111111111"], [10] * 14, "card", "k")  # the first digit is kept, the last computed
    body = "4" + "".join(map(str, digits))
    double = [int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(body)]
    card = body + str(-sum(d - 9 if d > 9 else d for d in double) % 10)
    assert f"card {card} {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} bad 4111111111111112" in new
    assert "2021-02-30" in new and "2021-02-28" not in new and "10.0.0.255" not in new and "@x.com" in new and "a.b1@" not in new
    number = int((np.datetime64("2021-02-28") - np.datetime64("1900-01-01")).astype(int))
    day = network([number // 292, number % 292], [250, 292], "date", "k")
    shown = str(np.datetime64("1900-01-01") + (day[0] * 292 + day[1]))
    assert shown in new and shown in rows[2]["text"]
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or (\S+)", new)
    assert "-".join(phone.groups()[:3]) == phone.group(4) and rows[1]["n_found"] == 7
    out = {(r["doc_id"], r["text"]): r["n_found"] for r in pii.pseudonymise(odd, "k").collect()}
    assert out == dict.fromkeys(ODD, 0)


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    pairs = spark.range(12 * 7).select(pii.feistel(F.array((F.col("id") / 7).cast("int"), (F.col("id") % 7).cast("int")), F.array(F.lit(12), F.lit(7)), "t", "k").alias("v"))
    assert len({tuple(r["v"]) for r in pairs.collect()}) == 84


def test_decontamination(spark, docs, odd):
    item = "In the old town Alice bought 5 apples for 3 dollars and then Alice gave 5 pears to Bob before going home quickly"
    bench = spark.createDataFrame([(1, item), (2, "x y"), (3, None), (4, item), (5, "")], "item_id long, text string")
    other = item.replace("Alice", "Carol").replace("5", "8").replace("Bob", "Dave")
    rows = [(10, f"well. {other} ok"), (11, f"well. {other.replace('gave 8', 'gave 7')} ok"), (12, f"so {item}"), (None, item), (12, f"so {item}"), (13, item.upper()[:40])]
    got = {(r["doc_id"], r["item_id"], r["verbatim"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(10, 1, False), (10, 4, False), (12, 1, True), (12, 4, True), (None, 1, True), (None, 4, True)}
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(docs, bench.where("false")).count() == 0
    real = queries.table(spark, SF, "benchmark")
    found = decontaminate.leaks(docs, real)
    held = docs.alias("d").join(real.alias("b"), docs["text"].contains(real["text"])).select("doc_id", "item_id").collect()
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} >= {tuple(r) for r in held}
    for limit in (0, 500_000):
        assert decontaminate.leaks(docs, real, max_broadcast=limit).count() == found.count()
    assert decontaminate.without_leaks(docs, found).count() == docs.count() - len({r["doc_id"] for r in found.collect()})


def test_pipeline(spark, odd, docs):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs.where("false"), docs.union(odd.select(docs.columns))):
            out = stage(spark, rows, SF)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            out.write.format("noop").mode("overwrite").save()
    assert 0 < corpus_pipeline.run(spark, SF).count() <= docs.count()


def test_toxicity_inflected_forms():
    from folioscope.llm import toxicity

    memo = toxicity.WordHashes()
    shared = set(toxicity.bins(["grumbling"], memo).tolist()) & set(toxicity.bins(["grumbled"], memo).tolist())
    assert len(shared) == 1
    assert len(toxicity.bins(["short"], memo)) == 1
    assert len(toxicity.bins([], memo)) == 0


def test_similar_groups_equal_brute_force(spark, docs, monkeypatch):
    word = lambda i: f"w{i}"
    texts = [r["text"] or "" for r in docs.collect()]
    for k in range(2, 60):  # short texts about the limit, and long ones of 500 shingles with a share of words replaced
        texts += [" ".join(word(1000 * k + i) for i in range(k + 4)), " ".join(word(1000 * k + i) for i in range(k + 3))]
    rng = np.random.default_rng(3)
    for k in range(60):
        base = [word(10**6 + 1000 * k + i) for i in range(504)]
        other = list(base)
        for at in rng.choice(504, size=int(rng.integers(8, 16)), replace=False):
            other[at] = "x" + other[at]
        texts += [" ".join(base), " ".join(other)]
    base = [word(10**8 + i) for i in range(300)]  # a crowded group of near copies, no pair of which need be similar
    texts += [" ".join(w if i % 29 != k % 29 and i % 31 != k % 31 else f"{w}y{k}" for i, w in enumerate(base)) for k in range(60)]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: top(i) for i in range(len(texts))}
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(rows).collect()} == want
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 16)
    monkeypatch.setattr(simhash, "CHUNK_SHINGLES", 2000)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(rows).collect()} == want


def test_decontamination_of_edited_copies(spark):
    item = "In the old town Alice bought several apples for her sister and then Alice gave some pears to Bob before going home quickly"
    sums = "So we add 3 and 5 and then 7 and 2 to the heap of 9 and 11 coins that were left over by others"
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    bench = spark.createDataFrame([(1, item), (2, sums), (3, long)], "item_id long, text string")
    parts = item.split()
    rows = [(i, 1, "well. " + " ".join([*parts[:i], "quite", *parts[i:]])) for i in range(2, len(parts))]
    rows += [(100 + i, 1, "well. " + " ".join([*parts[:i], "quite", *parts[i + 1 :]])) for i in range(1, len(parts)) if parts[i].islower()]
    rows += [(200, 1, "well. " + item.replace("Alice", "Carol Ann").replace("Bob", "Dave"))]
    rows += [(300, 2, sums.replace("3", "4").replace("5", "4"))]
    rows += [(400, 3, "he said " + " ".join(long.split()[20:38]) + " and left")]
    none = [(500, "well. " + item.replace("Alice gave", "Carol gave")), (501, "he said " + " ".join(long.split()[20:30]) + " and left")]
    every = [(i, t) for i, _, t in rows] + none
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(every, "doc_id long, text string"), bench).collect()}
    assert got == {(i, k) for i, k, _ in rows}


def test_pii_long_secrets_and_unseparated_numbers(spark):
    secret = "a1B2" * 200
    values = [secret, "+15551234567", "5552234567", "+442071234567", "+49 151 23456789", "3782 822463 10005"]
    texts = [f"token={secret} end", *(f"call {v} now" for v in values[1:]), "card 3782 822463 10006 now", "at 1700000000 now"]
    rows = [r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert [r["n_found"] for r in rows] == [1] * len(values) + [0, 0]
    assert all(v not in r["text"] and len(r["text"]) == len(t) for v, r, t in zip(values, rows, texts, strict=False))
    assert rows[1]["text"].startswith("call +1") and rows[3]["text"].startswith("call +44") and rows[4]["text"].startswith("call +49 ")
