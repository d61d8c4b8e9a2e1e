"""The column-wise suffix order against plain sorting, and the repeats that it gives."""

import collections

import numpy as np

from folioscope.llm import columns, repeats


def texts_of(seed):
    rng = np.random.default_rng(seed)
    shared = rng.integers(97, 100, 60).astype(np.uint8).tobytes()
    out = [rng.integers(97, 100, int(rng.integers(0, 40))).astype(np.uint8).tobytes() + shared[: int(rng.integers(0, 60))] for _ in range(25)]
    return [*out, b"", b"a" * 50, out[3], out[3], "größe".encode() * 6]


def test_order_and_prefixes(tmp_path):
    texts = texts_of(1)
    done = columns.suffix_order(texts, str(tmp_path))
    got = columns.read(str(tmp_path))
    want = sorted((t[s:], i, s) for i, t in enumerate(texts) for s in range(len(t) + 1))
    assert [(i, s) for _, i, s in want if s < len(texts[i])] == [(i, s) for i, s in zip(got["owner"].tolist(), got["start"].tolist(), strict=True) if s < len(texts[i])]
    common = [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for (a, _, _), (b, _, _) in zip(want, want[1:], strict=False)]
    assert got["prefix"][1:].tolist() == common and done["rounds"] == max(map(len, texts))


def test_repeats_by_the_transform_and_by_bins(tmp_path):
    for seed in range(4):
        texts, length = texts_of(seed), 9
        seen = collections.Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
        want = [[seen[t[s : s + length]] > 1 for s in range(len(t) - length + 1)] for t in texts]
        assert [f.tolist() for f in columns.repeated(texts, length, str(tmp_path))] == want
        # Aligned sequences of one group: the bins' construction gives the same.
        row = [bytes(range(97, 117))[i:] + b"SHARED ANCHOR HERE" + bytes([65 + i % 3]) * 12 for i in range(6)]
        flags = repeats.repeated_windows(np.zeros(6, int), row, np.arange(20, 14, -1), np.ones(6, int), 14)
        assert [f.tolist() for f in flags] == [f.tolist() for f in columns.repeated(row, 14, str(tmp_path))]
