"""The two classifiers against plain versions of their methods."""

import numpy as np

from folioscope.llm import langid, toxicity

WORDS = {"aa": "kala sana talo vesi", "bb": "brot haus wasser und", "cc": "pain maison eau le", "dd": "pan casa agua el", "ee": "chleb dom woda i"}


def rows_of(spark, per, words=WORDS):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(v.split(), size=9)), lang) for n, (lang, v) in enumerate(words.items()) for k in range(n * per, (n + 1) * per)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)


def test_decoding_is_the_least_weighted_loss(spark):
    docs = rows_of(spark, 30)
    model = langid.fit(docs)
    w, b, mean, weight = model.fitted
    table = langid.byte_table()
    for r in langid.predict(docs, model).collect():
        margin = (langid.features(r["text"].encode(), table) - mean) @ w + b
        loss = [sum(np.log1p(np.exp(-m * c)) * k for m, c, k in zip(margin, code, weight / weight.mean(), strict=True)) for code in model.code]
        share = np.exp(min(loss) - np.array(loss))
        assert r["lang_pred"] == model.langs[int(np.argmin(loss))] and abs(r["lang_score"] - (share / share.sum()).max()) < 1e-3
    assert sum(r["lang"] == r["lang_pred"] for r in langid.predict(docs, model).collect()) == 150


def test_one_wrong_bit_is_corrected():
    code = langid.codewords(5)
    model = langid.Model(list("abcde"), code, (np.eye(code.shape[1], dtype=np.float32), np.zeros(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1])))
    for k in range(5):
        for bit in range(code.shape[1]):
            x = code[k].astype(float).copy()
            x[bit] = -x[bit]
            assert model.decode(x[None])[0][0] == k


def test_many_languages_and_repeated_ids(spark):
    names = {f"l{k:03}": f"x{k}y z{k}w q{k}v" for k in range(30)}
    docs = rows_of(spark, 4, names)
    model = langid.fit(docs, max_docs=80, max_langs=25)
    assert len(model.langs) == 25 and model.left_out == 5 and model.langs == sorted(names)[:25]
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} <= set(model.langs)
    same = spark.createDataFrame([(1, "kala sana", "aa"), (1, "brot haus", "bb"), (1, "kala sana", "aa")] * 3, "doc_id long, text string, lang string")
    one, two = langid.fit(same.repartition(3)), langid.fit(same.repartition(1))
    assert one.langs == two.langs and np.array_equal(one.fitted[0], two.fitted[0])


def test_learning_is_ftrl_proximal():
    rng = np.random.default_rng(2)
    alpha, beta, l1, l2 = 0.3, 1.0, 2.5, 0.1
    state = toxicity.Ftrl(12, alpha, beta, l1, l2)
    z, n = [0.0] * 12, [0.0] * 12

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(300):
        at = np.unique(rng.integers(0, 12, 5))
        y = int(at[0] < 3)
        p = 1 / (1 + np.exp(-(0.1 + sum(weight(i) for i in at))))
        for i, w in [(i, weight(i)) for i in at]:
            g = p - y
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w
            n[i] += g * g
        state.learn(at, 0.1, y)
    assert np.allclose(state.weights(slice(None)), [weight(i) for i in range(12)]) and any(weight(i) == 0 for i in range(12))


def test_toxicity_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
