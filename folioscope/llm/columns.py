"""The suffix order of a collection of texts, built column by column through sequential files.

Texts are taken from their ends. Each round inserts one more symbol of every text that still has one: the symbol is
written into the transform at the place of the text's latest suffix, a stable sort of the transform's symbols tells
where the longer suffix belongs, and common prefixes next to the inserted suffixes follow from range minima over the
round before. The transform, the common prefixes and the suffixes' places are files, which a round reads and writes
from end to end; nothing else is kept but one number per text.

Memory is that of the files' columns for one round; the work is the length of the longest text times the collection.
"""

from __future__ import annotations

import os

import numpy as np

#: The transform's symbol for a suffix that nothing stands before yet.
OPEN = 256
FILES = {"transform": np.uint16, "prefix": np.int32, "owner": np.int32, "start": np.int32}


def read(folder: str) -> dict[str, np.ndarray]:
    return {name: np.fromfile(f"{folder}/{name}", kind) for name, kind in FILES.items()}


def write(folder: str, columns: dict[str, np.ndarray]) -> int:
    for name, kind in FILES.items():
        columns[name].astype(kind, copy=False).tofile(f"{folder}/{name}.new")
        os.replace(f"{folder}/{name}.new", f"{folder}/{name}")
    return sum(os.path.getsize(f"{folder}/{name}") for name in FILES)


def suffix_order(texts: list[bytes], folder: str) -> dict[str, int]:
    """Leave in folder the sorted suffixes' owner, start and common prefix with the one before; rounds and bytes passed.

    Equal suffixes stand in the order of their texts. The empty suffix of each text comes first.
    """
    n = len(texts)
    start = np.array([len(t) for t in texts], np.int32)
    moved = write(folder, {"transform": np.full(n, OPEN), "prefix": np.zeros(n), "owner": np.arange(n), "start": start})
    rounds, passed = int(start.max(initial=0)), moved
    at = np.arange(n)  # where each text's latest suffix stands
    for r in range(1, rounds + 1):
        now = read(folder)
        live = np.flatnonzero(start >= r)
        latest = at[live]
        now["transform"][latest] = [texts[i][-r] for i in live]
        fresh = np.zeros(len(now["transform"]), bool)
        fresh[latest] = True
        order = np.argsort(now["transform"], kind="stable")
        order = order[: np.count_nonzero(now["transform"] != OPEN)]
        new = fresh[order]
        put, old = n + np.flatnonzero(new), n + np.flatnonzero(~new)
        nxt = {name: np.empty(n + len(order), kind) for name, kind in FILES.items()}
        for name in FILES:
            nxt[name][:n], nxt[name][old] = now[name][:n], now[name][n:]
        nxt["transform"][put], nxt["owner"][put], nxt["start"][put] = OPEN, now["owner"][order[new]], now["start"][order[new]] - 1
        # Common prefixes change only before an inserted suffix and behind it.
        beside = np.flatnonzero(new | np.concatenate([[False], new[:-1]]))
        symbol = now["transform"][order]
        same = beside[(beside > 0) & (symbol[beside] == symbol[np.maximum(beside - 1, 0)])]
        nxt["prefix"][n + beside] = 0
        if len(same):
            spans = np.empty(2 * len(same), np.int64)
            spans[::2], spans[1::2] = order[same - 1] + 1, order[same] + 1
            held = np.append(now["prefix"], np.int32(0))
            nxt["prefix"][n + same] = 1 + np.minimum.reduceat(held, spans)[::2]
        at[now["owner"][order[new]]] = put
        passed += moved
        moved = write(folder, nxt)
        passed += moved
    return {"rounds": rounds, "bytes": passed, "disk": moved}


def repeated(texts: list[bytes], length: int, folder: str) -> list[np.ndarray]:
    """For each text a flag per window of a length: whether it starts anywhere else in the collection."""
    suffix_order(texts, folder)
    now = read(folder)
    long = now["prefix"] >= length
    hit = long | np.concatenate([long[1:], [False]])
    flags = [np.zeros(max(0, len(t) - length + 1), bool) for t in texts]
    for i, s in zip(now["owner"][hit].tolist(), now["start"][hit].tolist(), strict=True):
        flags[i][s] = True
    return flags
