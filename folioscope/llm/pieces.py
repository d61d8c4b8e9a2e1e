"""SentencePiece encoding and decoding as weighted finite-state transduction.

A model is compiled to three transducers, which are composed with each input:

* the normaliser: the model's character map (longest match first, else the character itself), then white-space
  rules (dummy prefix, squeezing, escaping);
* the lexicon: a trie whose arcs read characters and whose final states write a piece;
* byte fallback: a character that no piece spells becomes its UTF-8 bytes' pieces.

The encoding is the tropical-semiring shortest path of the composition. For a unigram model an arc weighs its
piece's negative score, and positions are relaxed from left to right. A BPE model is made exact by weighing pairs of
neighbouring arcs: a pair weighs zero if merging the characters of both by the model's order leaves exactly these two
pieces, else infinity. The path of finite weight is then unique and is what merging the whole input gives. As all
finite weights are zero, the search may go depth first, from the longest arc on, as long as no position that was found
dead is tried again.

No piece has a blank after another character (checked when compiling), so a BPE model's paths over a text are those
of its words, end to end; they are remembered within a task, `MEMO` words at most. A unigram model's sums run over
the whole text, since which of two equal paths wins depends on how the running sum is rounded. Whole texts are encoded.

Defined results: null and empty texts have no ids; a null text decodes to null again. U+2581 in a text is
the blank's escape and decodes to a blank, which `round_trip` then shows, as it shows what a character map or squeezed
blanks have changed. Repeated rows get equal results; other columns pass through; an empty table gives an empty
result. Models that put the blank behind a word, or leave blanks unescaped, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLANK = "▁"
MEMO = 300_000


def character_map(blob: bytes) -> dict[str, str]:
    """What a compiled character map rewrites to what.

    Fixed format: the trie's size (four bytes), a double array of 32-bit units, then the rewritten strings, each ended
    by a zero byte. A unit holds its label in the low byte, a leaf flag in bit 8 and an offset in bits 10 to 30, which
    bit 9 scales by 256; a leaf unit holds the place of its string.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, strings = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    jump = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    rules, labels, stack = {}, np.arange(1, 256), [(int(jump(units[0])), b"")]
    while stack:
        base, key = stack.pop()
        at = labels ^ base
        at, c = at[at < len(units)], labels[at < len(units)]
        here = (units[at] & 0x800000FF) == c
        at, c = at[here], c[here]
        down, leaf = at ^ jump(units[at]), (units[at] >> 8) & 1
        for x, place, ends in zip(c.tolist(), down.tolist(), leaf.tolist(), strict=True):
            if ends:
                start = int(units[place]) & 0x7FFFFFFF
                rules[key + bytes([x])] = strings[start : strings.index(b"\0", start)]
            stack.append((place, key + bytes([x])))
    return {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in rules.items()}


class Model:
    """What is read from a model file: pieces, scores and kinds, and the normaliser's switches."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self._read(proto)

    @classmethod
    def of(cls, proto) -> "Model":
        """A model from a parsed file."""
        model = cls.__new__(cls)
        model._read(proto)
        return model

    def _read(self, proto) -> None:
        norm = proto.normalizer_spec
        if not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with unescaped blanks or blanks behind words are not supported")
        self.rules = character_map(norm.precompiled_charsmap)
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.bpe = proto.trainer_spec.model_type == 2
        self.prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        #: The bytes that each id stands for.
        self.spell = [
            bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(BLANK, " ").encode()
            for p in proto.pieces
        ]
        self.digest = hashlib.sha256(proto.SerializeToString()).hexdigest()

    def text(self, ids: list[int]) -> str:
        """The inverse transduction: what the ids spell, without the dummy prefix."""
        return b"".join(map(self.spell.__getitem__, ids)).decode("utf-8", "replace")[1 if self.prefix and ids else 0 :]


class Normaliser:
    """The character map and the white-space rules as one function of texts."""

    def __init__(self, model: Model):
        self.rules, self.prefix, self.squeeze = model.rules, model.prefix, model.squeeze
        self.longest = max(map(len, self.rules), default=0)
        heads = sorted({k[0] for k in self.rules})
        self.head = re.compile("[" + "".join(map(re.escape, heads)) + "]") if heads else None

    def mapped(self, text: str) -> str:
        out, done, m = [], 0, self.head.search(text)
        while m:
            at = m.start()
            for k in range(self.longest, 0, -1):
                new = self.rules.get(text[at : at + k])
                if new is not None and len(text) >= at + k:
                    out += [text[done:at], new]
                    done = at = at + k
                    break
            else:
                at += 1
            m = self.head.search(text, at)
        return "".join([*out, text[done:]]) if out else text

    def __call__(self, text: str) -> str:
        new = self.mapped(text) if self.head else text
        if self.squeeze:
            new = re.sub(" +", " ", new.strip(" "))
        if not (new if self.squeeze else text):
            return ""
        new = (BLANK if self.prefix else "") + new.replace(" ", BLANK)
        return new.rstrip(BLANK) if self.squeeze else new


class Lexicon:
    """Pieces as a trie: step[(state, character)] is the next state, writes[state] the piece that ends there."""

    def __init__(self, pieces: dict[str, int]):
        self.step: dict[tuple[int, str], int] = {}
        self.writes: dict[int, int] = {}
        for text, i in pieces.items():
            state = 0
            for c in text:
                state = self.step.setdefault((state, c), len(self.step) + 1)
            self.writes[state] = i

    def arcs(self, text: str, at: int):
        """(end, piece) of the composition's arcs from a position, shortest first."""
        state, step, writes = 0, self.step, self.writes
        for end in range(at, len(text)):
            state = step.get((state, text[end]), -1)
            if state < 0:
                return
            if state in writes:
                yield end + 1, writes[state]


class Transducer:
    """A compiled model. Piece kinds: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""

    def __init__(self, model: Model):
        self.model, self.bpe = model, model.bpe
        self.arcs = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (1, 4)}
        self.score = model.scores
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == 6}
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == 2), 0)
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.arcs):
            raise ValueError("a piece goes past the end of a word")
        self.normalise, self.lexicon = Normaliser(model), Lexicon(self.arcs)
        joined = {c for p in self.arcs if len(p) > 1 for c in p}
        self.line_cut = "\n" not in joined
        self.spines: dict[int, tuple | None] = {}
        self.fits: dict[int, bool] = {}
        own = [s for s, k in zip(model.scores, model.kinds, strict=True) if k == 1]
        # Fixed value: a character that no piece spells costs ten more than the worst piece.
        self.worst = np.float32(min(own, default=0.0)) - np.float32(10)
        # A piece that the user has set beats any pieces over the same characters.
        free = np.float32(max(own, default=0.0))
        self.weight = [float(len(p.encode()) * free) - 0.1 if k == 4 else float(np.float32(s)) for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True)]
        # Pieces that merging can give, and the lengths that those have by their first three characters.
        self.usable = {p: i for p, i in self.arcs.items() if not self.bpe or len(p) == 1 or self.spine(i) is not None}
        lengths: dict[str, set[int]] = {}
        for p in self.usable:
            lengths.setdefault(p[:3], {1, 2}).add(len(p))
        self.lengths = {p: tuple(sorted(k, reverse=True)) for p, k in lengths.items()}

    def merge(self, text: str) -> list[str]:
        """Merging in the model's order: the best-scored neighbouring pair first, then the leftmost. Only pieces are merged, to weigh them."""
        part, nxt, prv = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap, arcs, score = [], self.arcs, self.score

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(part) and (at := arcs.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-score[at], i, part[i], part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if part[i] != a or nxt[i] >= len(part) or part[nxt[i]] != b:
                continue
            j = nxt[i]
            part[i], part[j] = a + b, ""
            nxt[i] = nxt[j]
            if nxt[j] < len(part):
                prv[nxt[j]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [p for p in part if p]

    def spine(self, at: int) -> tuple | None:
        """The piece's outermost parts through time, on either side: ((string, score at which it is taken up), ...).

        None if merging the piece's own characters does not give the piece.
        """
        if at in self.spines:
            return self.spines[at]
        text, found = self.model.pieces[at], None
        if len(text) == 1:
            found = (((text, -math.inf),), ((text, -math.inf),))
        else:
            for cut in range(1, len(text)):
                a, b = self.arcs.get(text[:cut]), self.arcs.get(text[cut:])
                if (a is not None or cut == 1) and (b is not None or cut == len(text) - 1) and self.merge(text) == [text]:
                    left = self.spine(a) if a is not None else (((text[:1], -math.inf),),) * 2
                    right = self.spine(b) if b is not None else (((text[-1:], -math.inf),),) * 2
                    if left and right and self._meets(left[1], right[0], self.score[at]):
                        s = self.score[at]
                        first = ((text, -math.inf), *((p, s if k == 0 else t) for k, (p, t) in enumerate(left[0])))
                        last = ((text, -math.inf), *((p, s if k == 0 else t) for k, (p, t) in enumerate(right[1])))
                        found = (first, last)
                        break
        self.spines[at] = found
        return found

    def _meets(self, left: tuple, right: tuple, target: float) -> bool:
        """Whether the first merge across the border of two whole pieces is the one of both, at this score."""
        for i, (a, until_a) in enumerate(left):
            for j, (b, until_b) in enumerate(right):
                at = self.arcs.get(a + b)
                if at is not None and (i or j) and self.score[at] > until_a and self.score[at] >= until_b:
                    return False
        return True

    def pair_fits(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay apart when the characters of both are merged."""
        key = a * len(self.score) + b
        got = self.fits.get(key)
        if got is None:
            last, first = self.spine(a)[1], self.spine(b)[0]
            got = True
            for x, until_x in last:
                for y, until_y in first:
                    at = self.arcs.get(x + y)
                    if at is not None and self.score[at] > until_x and self.score[at] >= until_y:
                        got = False
            if len(self.fits) >= 1_000_000:
                self.fits.clear()
            self.fits[key] = got
        return got

    def fallback(self, c: str) -> list[int]:
        return [self.byte[x] for x in c.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def path(self, text: str) -> list[int]:
        """The ids on the shortest path over one normalised stretch of text."""
        return self._joined(text) if self.bpe else self._relaxed(text)

    def _joined(self, text: str) -> list[int]:
        """The path whose pairs all weigh zero, depth first; the lexicon is read by lengths, which is the trie from its ends."""
        arcs, lengths, fits, wide = self.usable, self.lengths, self.fits, len(self.score)
        n, dead, at, starts, taken, size = len(text), set(), 0, [], [], len(text)
        while at < n:
            prev = taken[-1] if taken else -1
            for k in lengths.get(text[at : at + 3], (2, 1)):
                if k > size or at + k in dead:
                    continue
                p = arcs.get(text[at : at + k], -1)
                if p < 0 and k > 1:
                    continue
                if prev >= 0 and p >= 0:
                    fit = fits.get(prev * wide + p)
                    if not (self.pair_fits(prev, p) if fit is None else fit):
                        continue
                starts.append(at)
                taken.append(p)
                at += k
                size = n - at
                break
            else:
                if not taken:
                    raise AssertionError(f"no path over {text!r}")
                dead.add(at)
                size = at - starts[-1] - 1
                at = starts.pop()
                taken.pop()
        return [i for s, p in zip(starts, taken, strict=True) for i in ([p] if p >= 0 else self.fallback(text[s]))]

    def _relaxed(self, text: str) -> list[int]:
        """The path of the least sum of arc weights; of equal ones, position by position, that with the longer last arc.

        Sums are kept in single precision, as the models' own scores are, and compared in double.
        """
        n, worst = len(text), self.worst
        best, back = [np.float32(0)] + [None] * n, [(0, -1)] * (n + 1)
        for at in range(n):
            single, here = False, float(best[at])
            for end, piece in self.lexicon.arcs(text, at):
                single |= end == at + 1
                total = here + self.weight[piece]
                if best[end] is None or total > best[end]:
                    best[end], back[end] = np.float32(total), (at, piece)
            if not single:
                total = best[at] + worst
                if best[at + 1] is None or total > best[at + 1]:
                    best[at + 1], back[at + 1] = total, (at, -1)
        out, at = [], n
        while at > 0:
            start, piece = back[at]
            out.append([piece] if piece >= 0 else self.fallback(text[start]))
            at = start
        return [i for ids in reversed(out) for i in ids]


class Encoder:
    """Encodes whole texts, remembering the paths of words."""

    def __init__(self, transducer: Transducer):
        self.t = transducer
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pack = [i.to_bytes(4, sys.byteorder) for i in range(len(transducer.score))]

    def word(self, text: str) -> bytes:
        """The path of one word, remembered in two generations: the older is dropped when the newer is full."""
        got = self.memo.get(text)
        if got is None:
            got = self.older.get(text)
            if got is None:
                got = b"".join([self.pack[i] for i in self.t.path(text)])
            if len(text) <= 64:
                if len(self.memo) >= MEMO // 2:
                    self.memo, self.older = {}, self.memo
                self.memo[text] = got
        return got

    def __call__(self, text: str) -> np.ndarray:
        text = self.t.normalise(text)
        if not text:
            return np.zeros(0, np.int32)
        if not self.t.bpe:
            return np.array(self.t.path(text), np.int32)
        lines = text.split("\n") if self.t.line_cut else [text]
        end = np.array(self.t.fallback("\n") if "\n" not in self.t.arcs else [self.t.arcs["\n"]], np.int32).tobytes()
        out, word = [], self.word
        for line in lines:
            get = self.memo.get
            if line:
                if BLANK * 2 in line:
                    words = re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", line)
                else:
                    words = line.split(BLANK)
                    if words[0]:
                        out.append(word(words[0]))
                    words = [BLANK + w for w in words[1:]]
                out += [get(w) or word(w) for w in words]
            out.append(end)
        out.pop()
        return np.frombuffer(b"".join(out), np.int32)


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with n_tokens, ids and round_trip after them; needs a column text."""
    at = docs.columns.index("text")
    taken = [c for c in docs.columns if c not in ("n_tokens", "ids", "round_trip")]

    def run(batches):
        encoder = common.per_process(("pieces", model.digest), lambda: Encoder(Transducer(model)))
        spell = model.spell
        skip = 1 if model.prefix else 0
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                ids, same = [], []
                for t in b.column(at):
                    text = t.as_py()
                    got = encoder(text or "")
                    ids.append(got)
                    back = b"".join(map(spell.__getitem__, got.tolist()))[skip if len(got) else 0 :]
                    same.append(text is None or back == text.encode("utf-8", "surrogatepass"))
                counts = np.array([len(i) for i in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                new = [pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in taken), *new], names=[*taken, "n_tokens", "ids", "round_trip"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in taken)
    return docs.mapInArrow(run, f"{schema}n_tokens long, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model: Model) -> DataFrame:
    """All columns of tokens with decoded after them; needs a column ids (null stays null)."""
    at = tokens.columns.index("ids")
    taken = [c for c in tokens.columns if c != "decoded"]

    def run(batches):
        for b in batches:
            out = [None if i is None else model.text(i) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in taken), pa.array(out, pa.string())], names=[*taken, "decoded"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in tokens.schema if f.name in taken)
    return tokens.mapInArrow(run, f"{schema}decoded string")


common.ship(__name__)
