"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filter_text, map_text, stored
from .textops import ALNUM, LOWER

#: Bytes of window text that one automaton takes. A larger benchmark makes several, used one after the other. An automaton
#: measures some 45 times its text and its windows 7 times, so a block costs a worker about 200 MB at most.
BLOCK = 4 << 20

_NORMAL = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

Window = tuple[str, int, list[str]]


def normal_words(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8; null has none."""
    return [] if text is None else text.encode().translate(_NORMAL).split()


def joined(words: list[bytes]) -> str:
    return f" {b' '.join(words).decode()} "


def windows(items: Iterator[tuple[object, str | None]], size: int = 10, limit: int = BLOCK) -> Iterator[list[Window]]:
    """Blocks of distinct windows: text between single spaces, number of words, ids of the items that hold it.

    An item of fewer than `size` words, but not none, is one window. Null ids take part without a name.
    """
    block: dict[str, Window] = {}
    held = 0
    for key, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            part = words[i : i + size]
            entry = block.setdefault(joined(part), (joined(part), len(part), []))
            held += len(entry[0]) if not entry[2] else 0
            if key is not None and (not entry[2] or entry[2][-1] != str(key)):
                entry[2].append(str(key))
        if held > limit:
            yield list(block.values())
            block, held = {}, 0
    yield list(block.values())


def matcher(block: list[Window]) -> Callable[[str | None], tuple[int, np.ndarray | None, list[str]]]:
    """f(text) -> (number of words, which words are hit or None if none is, ids of the items found)."""
    automaton = ahocorasick.Automaton()
    for text, n, ids in block:
        automaton.add_word(text, (n, ids))
    if block:
        automaton.make_automaton()

    def f(text: str | None) -> tuple[int, np.ndarray | None, list[str]]:
        words = normal_words(text)
        found = list(automaton.iter(whole)) if words and block and (whole := joined(words)) else []
        if not found:
            return len(words), None, []
        spaces = np.flatnonzero(np.frombuffer(whole.encode("utf-32-le"), np.uint32) == 32)
        hit = np.zeros(len(words), bool)
        for end, (n, _) in found:
            last = int(np.searchsorted(spaces, end))
            hit[last - n : last] = True
        return len(words), hit, sorted({x for _, (_, ids) in found for x in ids})

    return f


def original_spans(text: str, hit: np.ndarray) -> list[int]:
    """Begin and end, in characters of the original text, of each run of hit words, one after the other."""
    at = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [x for a, b in zip(edges[::2], edges[1::2], strict=True) for x in (at[a][0], at[b - 1][1])]


def blocks_of(benchmark: DataFrame, item_key: str, item_text: str, size: int) -> list:
    """Broadcasts of the benchmark's windows: the stated query set, read partition by partition, in blocks of BLOCK bytes."""
    rows = benchmark.select(item_key, item_text).toLocalIterator()
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(block) for block in windows(((r[0], r[1]) for r in rows), size)]


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """One row per row of docs: key, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A word is hit if it stands inside any occurrence of a window, `size` consecutive words of an item; spans are the hit
    runs in characters of the original text (begin, end, begin, end, ...). Null or empty texts, and those without words,
    have 0 words and no hit; an empty benchmark hits nothing; repeated rows give repeated results; other columns of docs
    are not read. Each text is scanned once for each block of windows, in its own task, without a shuffle.
    """
    blocks = blocks_of(benchmark, item_key, item_text, size)
    if len(blocks) > 1:
        return _merged(docs, blocks, key, text)

    def make():
        match = matcher(blocks[0].value)

        def f(texts: pa.StringArray) -> list:
            return list(zip(*(_row(t, *match(t)) for t in texts.to_pylist()), strict=True))

        return f

    return map_text(docs, text, [key], "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>", make)


def _row(text: str | None, n: int, hit: np.ndarray | None, ids: list[str]) -> tuple:
    n_hit = 0 if hit is None else int(hit.sum())
    return n, n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n_hit > 0, [] if hit is None else original_spans(text, hit)


def _merged(docs: DataFrame, blocks: list, key: str, text: str) -> DataFrame:
    """The same for several automata: hit words and items of one block after the other are kept beside each text."""
    state = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.lit(None).cast("binary").alias("h"), F.array().cast("array<string>").alias("i"))
    for n, block in enumerate(blocks):

        def run(batches, block=block):
            match = matcher(block.value)
            for b in batches:
                h, i = [], []
                for t, old, ids in zip(b.column("t").to_pylist(), b.column("h").to_pylist(), b.column("i").to_pylist(), strict=True):
                    count, hit, more = match(t)
                    if hit is not None and old is not None:
                        hit |= np.unpackbits(np.frombuffer(old, np.uint8), count=count).view(bool)
                    h.append(old if hit is None else np.packbits(hit).tobytes())
                    i.append(sorted({*ids, *more}))
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("t"), pa.array(h, pa.binary()), pa.array(i, pa.list_(pa.string()))], names=["k", "t", "h", "i"])

        state = stored(state.mapInArrow(run, state.schema), f"scan{n}")

    def last(batches):
        for b in batches:
            rows = []
            for t, h, ids in zip(b.column("t").to_pylist(), b.column("h").to_pylist(), b.column("i").to_pylist(), strict=True):
                n = len(normal_words(t))
                rows.append(_row(t, n, None if h is None else np.unpackbits(np.frombuffer(h, np.uint8), count=n).view(bool), ids))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column("k"), *[pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=out.names)

    out = T.StructType([T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>").fields])
    return state.mapInArrow(last, out)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs. Null and empty texts stay."""
    for block in blocks_of(benchmark, item_key, item_text, size):

        def make(block=block):
            match = matcher(block.value)
            return lambda texts: [match(t)[1] is None for t in texts.to_pylist()]

        docs = filter_text(docs, text, make)
    return docs
