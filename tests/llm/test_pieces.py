"""Pieces against the library: both kinds of model, with and without a character map and squeezed blanks."""

import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from folioscope.llm import pieces, queries

PARTS = ["▁", " ", "  ", "   ", "a", "t", "th", "\t", "ab", " x", "\n", "1", "é", "日", "▁the", "ing", "ﬁ", "①", "Å", "　", "ｱﾞ", "\u200b", "½", "Ⅷ", "\x01", "가", "…"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [" " * n + "x" for n in range(70)] + [r["text"] or "" for r in docs]


def model(rule="", squeeze=False, unigram=False):
    proto = pb.ModelProto()
    with open(f"{queries.TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        proto.ParseFromString(f.read())
    if rule:
        normaliser = pb.ModelProto()
        normaliser.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = normaliser.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    if unigram:  # the same pieces with made-up weights
        proto.trainer_spec.model_type = 1
        for i, p in enumerate(proto.pieces):
            if p.type == 1:
                p.score = -1 - 0.37 * ((i * 7919) % 1000) / 100 * len(p.piece) ** 0.5
    return proto


@pytest.mark.parametrize(("rule", "squeeze", "unigram"), [("", False, False), ("", True, False), ("nmt_nfkc", True, False), ("nfkc_cf", False, False), ("", False, True), ("nmt_nfkc", True, True), ("nmt_nfkc", False, True)])
def test_ids_are_the_librarys(texts, rule, squeeze, unigram):
    proto = model(rule, squeeze, unigram)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), pieces.Encoder(pieces.Transducer(pieces.Model.of(proto)))
    assert [t for t in texts if own(t).tolist() != library.encode(t)] == []


def test_pairs_weigh_what_merging_says():
    t = pieces.Transducer(pieces.Model.of(model()))
    rng, known = random.Random(5), sorted(t.usable)
    for _ in range(20000):
        a, b = rng.choice(known), rng.choice(known)
        assert t.pair_fits(t.arcs[a], t.arcs[b]) == (t.merge(a + b) == [a, b])
