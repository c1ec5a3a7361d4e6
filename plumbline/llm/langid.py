"""Language identification by language-bitmask n-gram filters: bit-sliced Bloom filters and corrected popcounts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_text, map_text, pieces, stored
from .textops import U, mix, raw

#: An n-gram is in a language's filter if it makes up this share of the language's n-grams and this part of its share in
#: the language that has most of it. The first bounds a filter to 1 / LEAST n-grams, however large the corpus is.
LEAST, PART = 1e-5, 0.1
#: Slots of the filter (each holds a bit for every language) and hash functions.
SLOTS, HASHES = 1 << 20, 3
#: Distinct (language, n-gram) counts that a task holds before it hands them on.
HELD = 1 << 19
#: N-grams that a text needs for its language to be refused.
LEAST_TOLD = 20

_BYTE = np.full(256, 32, np.uint8)
_BYTE[97:123] = np.arange(97, 123)
_BYTE[128:] = np.arange(128, 256)


def ngrams(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """All 4-byte n-grams of each text, lower-cased, each run of other characters than letters one space; and each text's first n-gram.

    A text begins and ends with a space; it has none with fewer than two bytes of letters.
    """
    data, offs = raw(pc.utf8_lower(texts))
    # A space is put between texts, and so one before the first and after the last.
    n = len(offs) - 1
    room = np.full(len(data) + n + 1, 32, np.uint8)
    owner = np.repeat(np.arange(1, n + 1), np.diff(offs))
    room[np.arange(len(data)) + owner] = _BYTE[data]
    keep = np.ones(len(room), bool)
    keep[1:] = (room[1:] != 32) | (room[:-1] != 32)
    at = np.cumsum(keep) - 1  # a border that is not kept is the space before it
    border = at[offs + np.arange(n + 1)]
    b = room[keep].astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    g = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
    inside = np.ones(len(g), bool)
    for back in (1, 2):  # n-grams that have a border in their midst belong to no text
        x = border - back
        inside[x[(x >= 0) & (x < len(g))]] = False
    first = np.concatenate(([0], np.cumsum(inside)))[np.minimum(border, len(g))]
    return g[inside], first


@dataclass
class Filter:
    """masks[slot] has bit l set if a hash of an n-gram of languages[l] falls on the slot; wrong[l] is the rate of false positives."""

    languages: list[str]
    masks: np.ndarray
    wrong: np.ndarray

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as bits (or also as falsely positive)."""
        out = None
        for slot in slots(grams):
            found = self.masks[slot]
            out = found if out is None else out & found
        return out


def slots(grams: np.ndarray) -> Iterator[np.ndarray]:
    h = mix(grams.astype(U) + U(0x9E3779B97F4A7C15))
    for k in range(HASHES):
        yield ((h >> U(20 * k)) & U(SLOTS - 1)).astype(np.int64)


def build(languages: list[str], grams: np.ndarray, of: np.ndarray) -> Filter:
    """The filter over n-grams and the indices of their languages. Above 64 languages it takes several words a slot."""
    words = max(1, -(-len(languages) // 64))
    kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 30)) if len(languages) <= n)
    masks = np.zeros((SLOTS, words), kind)
    for l in range(len(languages)):
        for slot in slots(grams[of == l]):
            masks[slot, l // 64] |= kind(1 << (l % 64))
    wrong = np.array([np.count_nonzero((masks[:, l // 64] >> kind(l % 64)) & kind(1)) / SLOTS for l in range(len(languages))]) ** HASHES
    return Filter(languages, masks, wrong)


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> Filter:
    """Learns from every row whose text and language are not null. N-grams are counted in tasks, summed by Spark and thinned
    to a bounded number before they reach the driver. Without such rows the filter has no language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[at], np.add.reduceat(n, at)

        def rows() -> pa.RecordBatch:
            keys, n = held[0]
            by = list(names)
            return pa.RecordBatch.from_arrays([pa.array([by[i] for i in (keys >> U(32)).astype(int).tolist()], pa.string()), pa.array((keys & U(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            for b in pieces(iter([batch]), text):
                g, first = ngrams(b.column(text))
                code = np.array([names.setdefault(x, len(names)) for x in b.column(lang).to_pylist()], np.uint64)
                if len(g):
                    keys, n = np.unique(g.astype(U) | (np.repeat(code, np.diff(first)) << U(32)), return_counts=True)
                    held.append((keys, n))
                    size += len(keys)
                if size > HELD:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield rows()
                        held.clear()
                        size = 0
        if held:
            held[:] = [merged()]
            yield rows()

    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias(lang), F.col(text).alias(text))
    counts = stored(known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(totals, "lang").withColumn("p", F.col("n") / F.col("total"))
    # PART of the largest share over languages: by a grouping, as an n-gram has a row for each language at most.
    top = share.groupBy("gram").agg(F.max("p").alias("top"))
    chosen = share.filter(F.col("p") >= LEAST).join(top, "gram").filter(F.col("p") >= PART * F.col("top")).select("lang", "gram")
    rows = chosen.toPandas()
    languages = sorted(rows["lang"].unique())
    code = {x: i for i, x in enumerate(languages)}
    return build(languages, rows["gram"].to_numpy(np.int64).astype(np.uint32), rows["lang"].map(code).to_numpy())


def scorer(f: Filter):
    """g(texts) -> language, score, share and number of n-grams of each text."""

    def g(texts: pa.StringArray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        n_texts, n_langs = len(texts), len(f.languages)
        if not n_langs:
            return ["und"] * n_texts, np.zeros(n_texts), np.zeros(n_texts), np.zeros(n_texts)
        grams, first = ngrams(texts)
        n = np.diff(first).astype(float)
        found = f.hits(grams)
        right = np.zeros((n_texts, n_langs))
        for l in range(n_langs):
            bit = (found[:, l // 64] >> found.dtype.type(l % 64)) & found.dtype.type(1)
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))[first]
            # Of n n-grams, x are in the language and (n - x) * wrong are hit falsely.
            right[:, l] = np.clip((np.diff(ones) - n * f.wrong[l]) / (1 - f.wrong[l]), 0, None)
        best = right.argmax(1)
        top = right[np.arange(n_texts), best]
        if n_langs > 1:
            second = np.partition(right, -2, axis=1)[:, -2]
        else:
            second = np.zeros(n_texts)
        sure = letters & (top > 0)
        score = np.where(sure, top / np.maximum(top + second, 1e-9), 0.0)
        share = np.where(sure, top / np.maximum(n, 1), 0.0)
        return [f.languages[i] if x else "und" for i, x in zip(best.tolist(), letters.tolist(), strict=True)], score, share, n

    return g


def identify(docs: DataFrame, f: Filter, keep: list[str], text: str = "text") -> DataFrame:
    """Adds lang_pred, score and share to the columns `keep`, one row for each row.

    `und` if the text is null, has no letter, or no language is learned. score is the corrected count of the best language
    over the sum of the best two (0 if none is hit; ties go to the first language by name); share is its part of the text's
    n-grams. The filter has a fixed number of slots and is broadcast; no shuffle.
    """
    known = docs.sparkSession.sparkContext.broadcast(f)

    def make():
        g = scorer(known.value)
        return lambda texts: list(g(texts)[:3])

    return map_text(docs, text, keep, "lang_pred string, score double, share double", make)


def learn_and_identify(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score, share: learns from rows that are not held out (a null condition counts as not)."""
    out = F.coalesce(held_out, F.lit(False))
    f = train(docs.filter(~out), lang, text)
    return identify(docs.select(F.col(key), F.col(text), out.alias("held_out")), f, [key, "held_out"], text)


def in_language(docs: DataFrame, f: Filter, least_share: float, text: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, with a letter and in a learned language that covers at least `least_share` of the n-grams.

    Texts of fewer than LEAST_TOLD n-grams tell too little and stay. Without a learned language nothing stays.
    """
    known = docs.sparkSession.sparkContext.broadcast(f)

    def make():
        g = scorer(known.value)

        def keep(texts: pa.StringArray) -> list[bool]:
            lang, _, share, n = g(texts)
            return [x != "und" and (y >= least_share or z < LEAST_TOLD) for x, y, z in zip(lang, share.tolist(), n.tolist(), strict=True)]

        return keep

    return filter_text(docs, text, make)
