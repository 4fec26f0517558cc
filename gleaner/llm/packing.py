"""Filling containers of fixed capacity with whole documents.

Sizes are whole numbers up to the capacity, so all documents of a size are interchangeable and
the packing is worked out on the histogram of sizes, which has no more entries than the capacity
whatever the number of documents. Documents above a third of the capacity stand at most two to a
container and are paired greedily, the largest with the largest partner that still fits; smaller
ones, in decreasing order, go to the fullest container with room (best fit). Both steps treat
equal containers together, so the plan is a short list of runs: "documents of size s with ranks
from r go to containers from c on, q to each". Ranking the documents within their size and looking
up the run are the only distributed steps.

A document larger than a container is cut into full containers and a rest that is packed like any
other document. Nothing else is ever split.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm import codepoints as cpk
from gleaner.runtime import cut, map_arrow, spread

CAPACITY = 2048
#: Documents ranked together; a size held by very many documents is ranked in as many parts.
RANK_GROUP = 1_000_000


def token_counts(texts: list[str]) -> np.ndarray:
    """Tokens of each text: runs of letters and digits, and single other characters that aren't white space."""
    cp, starts = cpk.joined(texts)
    cls = cpk.classes()[cp]
    word = (cls & (cpk.LETTER | cpk.DIGIT)) > 0
    one = ~word & ((cls & cpk.SPACE) == 0)
    one[1:] |= word[1:] & ~word[:-1]
    one[0] |= word[0]
    return np.add.reduceat(one, starts[:-1], dtype=np.int64)


def sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens); null and blank texts have none."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for ids, texts in cpk.blocks(cpk.values(b.column(0)), cpk.values(b.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(token_counts(texts))], names=["doc_id", "n_tokens"])

    return map_arrow(spread(documents.select("doc_id", "text")), run, "doc_id long, n_tokens long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (size, rank_from, rank_to, container_from, per_container, offset) that pack the histogram.

    Item number r of a size lies in container ``container_from + (r - rank_from) // per_container``
    at token ``offset + (r - rank_from) % per_container * size``.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    done = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted; rooms[g]: (first container, how many) with g tokens free
    rooms: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def put(size: int, n: int, first: int, each: int, free: int) -> None:
        runs.append((size, done[size], done[size] + n, first, each, capacity - free))
        done[size] += n
        left[size] -= n

    def room(free: int, first: int, n: int) -> None:
        if free > 0 and n > 0:
            if free not in rooms:
                insort(gaps, free)
                rooms[free] = []
            rooms[free].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for a in reversed(large):
        while left[a] > 0:
            i = bisect_left(large, min(a, capacity - a) + 1)
            while i and (left[large[i - 1]] < (2 if large[i - 1] == a else 1)):
                i -= 1
            b = large[i - 1] if i else 0
            n = (min(left[a], left[b]) if b != a else left[a] // 2) if b else left[a]
            first, bins = bins, bins + n
            put(a, n, first, 1, capacity)
            if b:
                put(b, n, first, 1, capacity - a)
            room(capacity - a - b, first, n)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s] > 0:
            i = bisect_left(gaps, s)
            if i == len(gaps):
                n = -(-left[s] // (capacity // s))
                room(capacity, bins, n)
                bins += n
                continue
            free = gaps[i]
            first, n = rooms[free].pop()
            if not rooms[free]:
                del rooms[free]
                gaps.pop(i)
            each = free // s
            full = min(n, left[s] // each)
            if full:
                put(s, full * each, first, each, free)
                room(free - each * s, first, full)
            rest = left[s] if full < n else 0
            if rest:  # fewer than would fill one more container of this kind
                put(s, rest, first + full, rest, free)
                room(free - rest * s, first + full, 1)
                full += 1
            room(free, first + full, n - full)
    return runs


def pack(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part_no, n_tokens, container, place): place is the first token's position.

    Documents without tokens (null or blank text) take no room: container and place are null.
    Repeated ids are packed as documents of their own.
    """
    spark = documents.sparkSession
    sized = cut(sizes(documents))
    parts = sized.where("n_tokens > 0").select("doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0), F.expr(f"int((n_tokens - 1) div {capacity})"))).alias("part_no", "x"))
    parts = parts.select("doc_id", "part_no", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part_no") * F.lit(capacity)).cast("int").alias("size"))
    salts = max(1, -(-sized.count() // RANK_GROUP))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(salts)).cast("int"))
    tally = parts.groupBy("size", "salt").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in tally.groupBy("size").agg(F.sum("n")).collect()}
    runs = spark.createDataFrame(plan(counts, capacity), "size int, rank_from long, rank_to long, container_from long, per_container long, offset long")
    ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy("size", "salt").orderBy("doc_id", "part_no")) - 1)
    if salts > 1:
        before = tally.withColumn("before", F.sum("n").over(W.partitionBy("size").orderBy("salt")) - F.col("n")).drop("n")
        ranked = ranked.join(before, ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    at = F.col("rank") - F.col("rank_from")
    # the plan has a few runs for each size up to the capacity: small by construction
    packed = ranked.join(F.broadcast(runs), "size").where("rank >= rank_from and rank < rank_to")
    packed = packed.select(
        "doc_id", "part_no", F.col("size").cast("long").alias("n_tokens"),
        (F.col("container_from") + F.floor(at / F.col("per_container"))).cast("long").alias("container"),
        (F.col("offset") + F.pmod(at, F.col("per_container")) * F.col("size")).cast("long").alias("place"),
    )
    empty = sized.where("n_tokens = 0").select("doc_id", F.lit(0).alias("part_no"), "n_tokens", F.lit(None).cast("long").alias("container"), F.lit(None).cast("long").alias("place"))
    return packed.unionAll(empty)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, and the share of the room that is used."""
    used = packed.agg(F.max("container").alias("last"), F.sum("n_tokens").alias("n_tokens"))
    n = F.coalesce(F.col("last") + 1, F.lit(0))
    return used.select(n.alias("n_containers"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.when(n > 0, F.col("n_tokens") / (n * capacity)).alias("fill"))


def layout(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, tokens and parts in containers, and the faults of a packing, which are all zero.

    n_overlaps and n_gaps: parts that begin before or behind the end of the one before (or the start of the
    container); n_overfull: containers beyond capacity; n_split_in_vain: documents with more parts than their
    tokens need; n_unused: container numbers below the last that hold nothing.
    """
    parts = packed.where("container is not null")
    end = F.coalesce(F.lag(F.col("place") + F.col("n_tokens")).over(W.partitionBy("container").orderBy("place", "n_tokens")), F.lit(0))
    placed = parts.select("container", "place", "n_tokens", end.alias("end"))
    full = placed.groupBy("container").agg(F.max(F.col("place") + F.col("n_tokens")).alias("used"), F.count_if(F.col("place") < F.col("end")).alias("o"), F.count_if(F.col("place") > F.col("end")).alias("g"), F.count("*").alias("k"), F.sum("n_tokens").alias("n"))
    bins = full.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_parts"), F.coalesce(F.sum("o"), F.lit(0)).alias("n_overlaps"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_gaps"),
        F.count_if(F.col("used") > capacity).alias("n_overfull"), (F.coalesce(F.max("container") + 1, F.lit(0)) - F.count("*")).alias("n_unused"),
    )
    docs = parts.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n")).agg(F.count("*").alias("n_documents"), F.count_if(F.col("k") > F.ceil(F.col("n") / capacity)).alias("n_split_in_vain"))
    names = ("n_documents", "n_tokens", "n_parts", "n_overlaps", "n_gaps", "n_overfull", "n_split_in_vain", "n_unused")
    return docs.unionByName(bins, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in names))
