"""Evaluation passages inside training texts.

A test item leaks into a document when both hold the same run of at least ``run`` consecutive
words. That is a containment search with short queries and long domains, and MinHash finds
containment only where query and domain are of like size. So the sizes are made alike before
hashing: items and documents are both cut into all their windows of ``run`` words, a window being
the set of its ``run - shingle + 1`` word shingles. All domains then lie in one size class, full
containment of a passage is a Jaccard similarity of one, and a single MinHash value per window
finds it with certainty instead of with some probability (the minima of sliding windows are
computed for whole blocks of text at once). Texts shorter than a window form the other size class,
which cannot hold a passage.

The values of all items are set in a bit map of bounded size, which is sent to the executors. One scan
of the documents picks the windows whose value is set there, and these are verified by an exact
join on the words of the window. Nothing depends on the number of items but the size of the map and
the way in which Spark runs the join.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import codepoints as cpk
from gleaner.runtime import cut, map_arrow, small, spread

RUN, SHINGLE = 13, 5
#: Bits of the map for each value of an item, and the least and most bits (powers of two) it may have.
MAP_ROOM, MAP_LEAST, MAP_MOST = 16, 16, 29
_SLICE_BITS = 1 << 20
_WORDS = regex.compile(r"[\p{L}\p{N}]+")
_LOWER: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """The lower case of each code point. Both forms of the small sigma are one here, as the form that
    ``str.lower`` takes depends on the place in the word; so equal words have equal hashes."""
    if not _LOWER:
        t = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x20000):
            c = chr(i).lower()
            if c != chr(i):
                t[i] = ord(c[0])
        t[0x3C2] = 0x3C3
        _LOWER.append(t)
    return _LOWER[0]


def words(text: str | None) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text or "")]


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash, start and end (in the joined block) of every word of a block of texts, in order."""
    cp, starts = cpk.joined(texts)
    s, e = cpk.runs((cpk.classes()[cp] & (cpk.LETTER | cpk.DIGIT)) > 0)
    return np.searchsorted(starts, s, side="right") - 1, cpk.span_hashes(_lower()[cp], s, e), s, e


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word of a block of texts, in order."""
    return word_spans(texts)[:2]


def window_minima(doc: np.ndarray, h: np.ndarray, run: int = RUN, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """First word and MinHash value of every window of ``run`` words that lies in one text."""
    n = len(h) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sh = np.zeros(len(h) - shingle + 1, np.uint64)
        for j in range(shingle):
            sh = sh * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - shingle + 1 + j]
        sh = cpk.mix(sh)
    low, width, want = sh, 1, run - shingle + 1
    while width * 2 <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = want - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    whole = np.flatnonzero(doc[:n] == doc[run - 1 :])
    return whole, low[whole]


def _passages(rows: DataFrame, key: str, run: int, shingle: int, held=None) -> DataFrame:
    """(key, value, passage) of the windows of rows(key, text), with ``held`` only of those whose value is set there."""
    import pyarrow as pa

    def scan(batches):
        for b in batches:
            for ids, texts in cpk.blocks(cpk.values(b.column(0)), cpk.values(b.column(1))):
                doc, h, s, e = word_spans(texts)
                first, low = window_minima(doc, h, run, shingle)
                if held is not None:
                    keep = is_set(held.value, low)
                    first, low = first[keep], low[keep]
                whole = "\n".join(texts) if len(first) else ""
                word: dict[int, str] = {}
                for i in first.tolist():
                    for k in range(i, i + run):
                        if k not in word:
                            word[k] = whole[s[k] : e[k]].lower()
                passages = [" ".join(word[k] for k in range(i, i + run)) for i in first.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc[first].tolist()], pa.int64()), pa.array(low.view(np.int64)), pa.array(passages, pa.string())], names=[key, "value", "passage"])

    return map_arrow(spread(rows.select(key, "text").where(F.length("text") >= 2 * run - 1)), scan, f"{key} long, value long, passage string")


def _bits(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each value in a map of ``2**bits`` bits."""
    mask = np.uint64((1 << bits) - 1)
    return (values & mask).astype(np.int64), (cpk.mix(values) & mask).astype(np.int64)


def is_set(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether both places of each value are set in a map (bytes)."""
    if not len(values):
        return np.zeros(0, bool)
    a, b = _bits(values, (len(bitmap) * 8).bit_length() - 1)
    return ((bitmap[a >> 3] >> (a & 7).astype(np.uint8)) & (bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1) > 0


def value_map(values: DataFrame, n: int) -> np.ndarray:
    """The map of ``n`` values(value), made in slices by the tasks that hold their places."""
    import pyarrow as pa

    bits = min(MAP_MOST, max(MAP_LEAST, (MAP_ROOM * n).bit_length()))
    size = min(_SLICE_BITS, 1 << bits)

    def places(batches):
        for b in batches:
            at = np.unique(np.concatenate(_bits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32))], names=["slice", "at"])

    def fill(batches):
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            part, at = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for k in np.unique(part).tolist():
                maps.setdefault(k, np.zeros(size, bool))[at[part == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([np.packbits(m, bitorder="little").tobytes() for m in maps.values()], pa.binary())], names=["slice", "bits"])

    slices = (1 << bits) // size
    sliced = map_arrow(values.select("value"), places, "slice int, at int").repartition(min(slices, 64), "slice")
    out = np.zeros((slices, size // 8), np.uint8)
    for row in map_arrow(sliced, fill, "slice int, bits binary").toLocalIterator():
        out[row[0]] = np.frombuffer(row[1], np.uint8)
    return out.ravel()


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id) of every document and item that share ``run`` consecutive words.

    Null and blank texts, and texts of fewer words, share nothing. Each pair comes once, also
    when ids repeat. Items in no document and documents without items give no rows. The documents are
    scanned once, however many items there are; a passage that very many documents hold meets a
    broadcast side, or is split by adaptive execution where there are too many items for that.
    """
    items = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    wanted = cut(_passages(items, "item_id", run, shingle).distinct())
    held = documents.sparkSession.sparkContext.broadcast(value_map(wanted, wanted.count()))
    found = _passages(documents, "doc_id", run, shingle, held).select("doc_id", "passage")
    return found.join(small(wanted.select("item_id", "passage")), "passage").select("doc_id", "item_id").dropDuplicates()


def summary(found: DataFrame, items: DataFrame) -> DataFrame:
    """How many documents hold each item; items that did not leak come out with zero."""
    n = found.groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.select("item_id").distinct().join(n, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"))
