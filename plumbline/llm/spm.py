"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position the automaton's output links give every piece that ends there, and each relaxes the best way to that
position. In unigram files the best way has the largest sum of scores. In BPE files the sum of scores doesn't give the
library's ids, as merges are ordered; there a piece extends a way only if the way's last piece and it are what merging
gives for the two of them, which one way at most fulfils. Both give the ids of the sentencepiece library.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Entries that a worker remembers of words, parts (twice) and pairs of pieces (four times); beyond them it begins anew.
REMEMBERED = 60_000
#: Bytes of text that are encoded at once: equal words are looked up once in them.
ENCODED = 2 << 20
#: Instead of a piece: nothing to merge with.
NOTHING = -1
#: What an unknown character costs below the least score, in unigram files.
UNKNOWN_COST = 10.0


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: number and value (int or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + n]
        at += n


class Pieces:
    """The pieces of a .model file and its way to encode."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.read(f.read())

    def read(self, data: bytes) -> None:
        self.names: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.prefix, trim, self.unknown, rules = UNIGRAM, True, True, 0, b""
        for field, value in wire(data):
            if field == 1:
                own = dict(wire(value))
                self.names.append(own[1].decode())
                self.scores.append(float(np.frombuffer(own.get(2, bytes(4)), np.float32)[0]))
                self.kinds.append(own.get(3, 1))
            elif field == 2:
                own = dict(wire(value))
                self.type = own.get(3, UNIGRAM)
            elif field == 3:
                own = dict(wire(value))
                self.prefix, trim, rules = bool(own.get(3, 1)), bool(own.get(4, 1)), own.get(2, b"")
        if trim or rules or self.type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE files with the identity normaliser are supported")
        normal = [i for i, k in enumerate(self.kinds) if k == 1]
        self.byte = {int(self.names[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == 6}
        self.unknown = self.kinds.index(2)
        self.ids = {self.names[i]: i for i in normal}
        self.chars = {x for x in self.ids if len(x) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.names[i], (i, len(self.names[i]), self.scores[i]))
        self.automaton.make_automaton()
        self.worst = min(self.scores[i] for i in normal) - UNKNOWN_COST
        # Where no piece has a space after another character, no way crosses the begin of a run of spaces; none crosses a
        # line end that no piece holds, nor goes from a letter to a mark that no piece has after a letter.
        apart = not any(SPACE in x.lstrip(SPACE) for x in self.ids)
        line = "" if any("\n" in x for x in self.ids) else "\n"
        joined = {x[i + 1] for x in self.ids for i in range(len(x) - 1) if x[i].isalpha()}
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined)
        word = (f"{SPACE}*[^\\W\\d_]+(?=[{marks}])|" if marks else "") + f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+"
        self.words = re.compile((f"{line}|" if line else "") + word if apart else ".+", re.S)
        # A text without these is cut at its spaces and line ends as it is.
        self.odd = f"  |\x01|{SPACE}|^[ \n]| $| \n|\n " if apart and line and self.prefix else ""
        self.sizes = [len(x) for x in self.names]
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # By the left piece, the last for NOTHING: the right pieces and whether they fit.
        self.pairs: list[dict[int, bool]] = [{} for _ in range(len(self.names) + 1)]
        self.n_pairs = 0
        plain = self.plain = [x.replace(SPACE, " ").encode() if k == 1 else bytes([int(x[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() for x, k in zip(self.names, self.kinds, strict=True)]
        self.lengths = np.array([len(x) for x in plain], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(plain), np.uint8)

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: again and again the neighbours with the best score, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' text gives these two. left is below 0 where nothing can merge with what is before."""
        b = self.names[right]
        ok = self.merged(b) == [b] if left < 0 else self.merged(self.names[left] + b) == [self.names[left], b]
        if self.n_pairs >= 4 * REMEMBERED:
            self.pairs, self.n_pairs = [{} for _ in self.pairs], 0
        self.pairs[left][right] = ok
        self.n_pairs += 1
        return ok

    def viterbi(self, text: str) -> list[int]:
        return self._bpe(text) if self.type == BPE else self._unigram(text)

    def _bpe(self, text: str) -> list[int]:
        # last[i]: the piece that ends at i on the way to i, None where no way leads, NOTHING where nothing can merge
        # with what is before: at the begin and after a character without a piece.
        n = len(text)
        last: list[int | None] = [None] * (n + 1)
        last[0] = NOTHING
        if not self.chars.issuperset(text):
            for i, c in enumerate(text, 1):
                if c not in self.chars:
                    last[i] = NOTHING
        for end, (piece, size, _) in self.automaton.iter(text):
            end += 1
            if last[end] is None and (left := last[end - size]) is not None:
                ok = self.pairs[left].get(piece)
                if ok or ok is None and self.fits(left, piece):
                    last[end] = piece
        out: list[int] = []
        at = n
        while at:
            piece = last[at]
            if piece is None:
                raise AssertionError(f"no way through {text[:at]!r}")
            if piece == NOTHING:
                out += reversed(self.fallback(text[at - 1]))
                at -= 1
            else:
                out.append(piece)
                at -= self.sizes[piece]
        out.reverse()
        return out

    def _unigram(self, text: str) -> list[int]:
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        back = [-1] * (n + 1)
        done = 0

        def pass_by(to: int) -> None:
            nonlocal done
            while done < to:
                done += 1
                if text[done - 1] not in self.chars and best[done - 1] + self.worst > best[done]:
                    best[done], back[done] = best[done - 1] + self.worst, -1

        for end, (piece, size, score) in self.automaton.iter(text):
            pass_by(end)
            total = best[end + 1 - size] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, piece
        pass_by(n)
        out: list[int] = []
        at = n
        while at:
            if back[at] < 0:
                out += reversed(self.fallback(text[at - 1]))
                at -= 1
            else:
                out.append(back[at])
                at -= len(self.names[back[at]])
        return out[::-1]

    def packed(self, text: str | None) -> bytes:
        """Ids as 32-bit numbers, one after the other. Words that were encoded before are remembered."""
        if not text:
            return b""
        text = text.replace(" ", SPACE)
        return b"".join(map(self.remembered, self.words.findall(SPACE + text if self.prefix else text)))

    def packed_all(self, texts: pa.StringArray) -> list[bytes]:
        """packed() of each text. Equal words of usual texts are looked up once for all texts."""
        texts = pc.fill_null(texts, "")
        usual = pc.invert(pc.match_substring_regex(texts, self.odd)).to_numpy(zero_copy_only=False) if self.odd else np.zeros(len(texts), bool)
        out = [b"" if u else self.packed(t) for t, u in zip(texts.to_pylist(), usual.tolist(), strict=True)] if not usual.all() else [b""] * len(texts)
        if usual.any():
            # A word has a space before it; that after a line end has none, and is marked.
            cut = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(usual)), "\n", " \n \x01"), " ")
            words = cut.flatten().dictionary_encode()
            own = pa.array([self.word(w) for w in words.dictionary.to_pylist()], pa.large_binary()).take(words.indices)
            data = own.buffers()[2]
            data = memoryview(data) if data is not None else memoryview(b"")
            ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset :][cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
            for i, a, b in zip(np.flatnonzero(usual).tolist(), ends[:-1], ends[1:], strict=True):
                out[i] = data[a:b].tobytes()
        return out

    def word(self, w: str) -> bytes:
        x = self.known.get(w)
        if x is None:
            whole = "" if not w else w if w == "\n" else w[1:] if w[0] == "\x01" else SPACE + w
            x = b"".join(map(self.remembered, self.words.findall(whole)))
            if len(w) < 64:
                if len(self.known) >= REMEMBERED:
                    self.known = {}
                self.known[w] = x
        return x

    def remembered(self, word: str) -> bytes:
        """Ids of a part that no piece reaches out of."""
        x = self.parts.get(word)
        if x is None:
            x = self.older.get(word)
            if x is None:
                x = array("i", self.viterbi(word)).tobytes()
            if len(word) < 64:
                self.parts[word] = x
                if len(self.parts) >= REMEMBERED:  # what is met again comes back from the older half
                    self.parts, self.older = {}, self.parts
        return x

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD. A U+2581 of the encoded text comes back as a space."""
        ids = np.asarray(ids, np.int64)
        size = self.lengths[ids]
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        data = self.bytes[np.repeat(self.starts[ids] - ends + size, size) + np.arange(n)].tobytes()
        return (data[1:] if self.prefix and data[:1] == b" " else data).decode(errors="replace")


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """The file's pieces, read once a worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", output: str = "ids") -> DataFrame:
    """Adds the ids of each text to the columns `keep`, one row for each row; null and empty texts have no ids.

    A column named as `output` among `keep` is refused, not overwritten. Whole texts, no shuffle; memory follows one text.
    """

    def make():
        pieces = loaded(path)

        def f(texts: pa.StringArray) -> list:
            found = pieces.packed_all(texts)
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))]

        return f

    return map_text(docs, text, keep, f"{output} array<int>", make, ENCODED)


def decode(encoded: DataFrame, path: str, keep: list[str], ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids to the columns `keep`; null ids give an empty text."""
    if output in keep:
        raise ValueError(f"columns clash: {output}")
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out = [pieces.decode(() if x is None else x) for x in part.column(ids).to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(out, pa.string())], names=schema.names)

    return encoded.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, n_tokens, intact: whether decoding the ids gives the text again (U+2581 counts as the space it stands for)."""
    coded = encode(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), path, ["k", "t"], "t")
    back = decode(coded, path, ["k", "t", "ids"])
    same: Column = F.replace(F.coalesce(F.col("t"), F.lit("")), F.lit(SPACE), F.lit(" ")) == F.col("decoded")
    return back.select(F.col("k").alias(key), "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("intact"))
