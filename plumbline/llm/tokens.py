"""Token counts of whole texts by overlapping chunks, spliced where both chunks are proven to agree."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_text

#: Characters of a chunk and of the overlap of two. A text of more than one chunk is spliced.
CHUNK, OVERLAP = 4096, 128
#: Places where the byte-level pattern begins anew wherever its scan began: after a letter, digit or mark that the next
#: character can't be joined to. The apostrophe is left out, as it may begin a contraction.
PATTERN_STABLE = re.compile(r"(?<=\w)(?=[ \n])|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z])|(?<=[!-&(-/:-@\[-`{-~])(?=[ \nA-Za-z0-9])")
#: Two characters of words: between them the vocabulary decides.
INSIDE = re.compile(r"(?<=\w)(?=\w)")
#: Characters on which both libraries' patterns are tested to agree, one by one (tests/llm/test_tokens.py).
_OTHER = re.compile("[^\u0000-ɏ]")


class Stable:
    """Finds places of a text that end a token and begin one in every encoding of any part of the text around them.

    Either the pattern cuts there whatever comes before, or no token of the vocabulary, read as bytes, lies across the place:
    merging never crosses it then, so what is left and right of it is encoded apart. A place inside the text of a special
    token is none.
    """

    def __init__(self, tokens: dict[bytes, int], special: list[str]):
        self.special, self.tokens, self.automaton = special, tokens, None
        self.reach = max(map(len, tokens))

    def uncrossed(self, text: str, start: int, end: int) -> list[int]:
        """Places between start and end, between two word characters, that no token of two or more bytes lies across; the last first."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for t in self.tokens:
                if len(t) > 1:
                    self.automaton.add_word(t.decode("latin-1"), len(t))
            self.automaton.make_automaton()
        low, high = max(0, start - self.reach), min(len(text), end + self.reach)
        data = text[low:high].encode()
        edge = np.zeros(len(data) + 2, np.int64)  # +1 where the places that a token crosses begin, -1 after them
        found = np.array([(e, n) for e, n in self.automaton.iter(data.decode("latin-1"))], np.int64).reshape(-1, 2)
        np.add.at(edge, found[:, 0] - found[:, 1] + 2, 1)
        np.add.at(edge, found[:, 0] + 1, -1)
        begins = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        places = low + np.flatnonzero(np.cumsum(edge)[begins] == 0)
        return [p for p in places[(places > start) & (places < end)][::-1].tolist() if INSIDE.match(text, p)]

    def last(self, text: str, start: int, end: int) -> int | None:
        """The last proven place p with start < p < end."""
        for m in reversed(list(PATTERN_STABLE.finditer(text, start + 1, end))):
            if not self.in_special(text, m.start()):
                return m.start()
        return next((p for p in self.uncrossed(text, start, end) if not self.in_special(text, p)), None)

    def in_special(self, text: str, p: int) -> bool:
        return any(text.find(s, max(0, p - len(s) + 1), p + len(s) - 1) >= 0 for s in self.special)


def splice(encode: Callable[[str], np.ndarray], sizes: np.ndarray, stable: Stable, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of a text of any length from overlapping chunks, equal to those of encode(text).

    `sizes` are the bytes of each id. Two neighbouring chunks are spliced at the last proven place of their overlap where both
    have the boundary. While the overlap has none it is doubled, to the left; where there is none down to what is done, the
    left chunk is doubled. So each part is encoded a bounded number of times, and memory follows the longest stretch
    without a proven place.
    """
    out = []
    at = base = none = 0  # text[:at] is done; the left chunk is text[base:end]; no place is proven from at to none
    end = min(chunk, len(text))
    left = encode(text[:end])
    while end < len(text):
        width, cut = overlap, None
        while cut is None:
            start = max(at, none, end - width)
            cut = stable.last(text, start, end)
            if cut is not None:
                stop = min(len(text), end + chunk - overlap)
                right = encode(text[start:stop])
                a, b, c = (_token_at(ids, sizes, len(text[x:y].encode())) for ids, x, y in ((left, base, at), (left, base, cut), (right, start, cut)))
                if None in (a, b, c):  # not a boundary of both
                    cut = None
            if cut is None:
                if start <= max(at, none):
                    break
                width *= 2
        if cut is None:
            base, end, none = at, min(len(text), at + 2 * (end - at)), end - 1
            left = encode(text[base:end])
        else:
            out.append(left[a:b])
            at, base, end, left = cut, start, stop, right
    out.append(left[_token_at(left, sizes, len(text[base:at].encode())) :])
    return np.concatenate(out)


def _token_at(ids: np.ndarray, sizes: np.ndarray, offset: int) -> int | None:
    """The index of the token that begins at this byte, the number of tokens at the end; None if none does."""
    ends = np.cumsum(sizes[ids])
    i = int(np.searchsorted(ends, offset, "right")) if offset else 0
    return i if (ends[i - 1] if i else 0) == offset else None


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks for tiktoken from a byte-level BPE file; None unless its merges are in the order of ids."""
    if spec["model"].get("type") != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {x["content"] for x in spec["added_tokens"]}
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
    merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
    ids = [vocab.get("".join(m), -1) for m in merges]
    if ids != sorted(ids) or -1 in ids or len(ids) + 256 != len(vocab):
        return None
    return {bytes(byte[c] for c in k): v for k, v in vocab.items()}


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Callable[[str], int]:
    """count(text) -> tokens by the file at `path`, as the tokenizers library counts them (.json) or sentencepiece (.model).

    By a byte-level file, texts of over `chunk` characters are spliced from overlapping chunks. A chunk whose characters are
    all below U+0250 is encoded by tiktoken with the same vocabulary, where its results are the same. Other files' patterns
    have no proven boundaries here: their texts are counted whole, and memory follows one text.
    """
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text))
    encode, sizes, stable = encoder(path)
    if stable is None:
        return lambda text: len(encode(text))
    return lambda text: len(encode(text) if len(text) <= chunk else splice(encode, sizes, stable, text, chunk, overlap))


def encoder(path: str) -> tuple[Callable[[str], np.ndarray], np.ndarray | None, Stable | None]:
    """encode(text) -> ids of a .json file, the bytes of each id, and its stable places (None unless it is byte-level)."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    whole = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
    ranks = byte_ranks(spec)
    special = {x["content"]: x for x in spec["added_tokens"]}
    if not ranks or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in special.values()):
        return whole, None, None
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={k: x["id"] for k, x in special.items()})
    sizes = np.zeros(max([*ranks.values(), *(x["id"] for x in special.values())]) + 1, np.int64)
    for t, i in [*ranks.items(), *((k.encode(), x["id"]) for k, x in special.items())]:
        sizes[i] = len(t)

    def encode(text: str) -> np.ndarray:
        return whole(text) if _OTHER.search(text) else np.array(quick.encode(text, allowed_special="all"), np.int64)

    return encode, sizes, Stable(ranks, list(special))


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """One row per row: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null keys are kept as they are; other columns of docs
    are not read, so their names cannot clash. No shuffle; each text is counted whole by one task.
    """

    def make():
        count = counter(path, chunk)

        def f(texts: pa.StringArray) -> list:
            n = [0 if t is None else count(t) for t in texts.to_pylist()]
            return [pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), n, [x > limit for x in n]]

        return f

    return map_text(docs, text, [key], "n_bytes long, n_tokens long, over_limit boolean", make)
