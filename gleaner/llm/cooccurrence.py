"""Items that appear together in a record, counted by external sorting.

Items are numbered densely, so that a pair packs into one 64-bit code (smaller number in the high
half; where there are more items than fit in half a code, their upper bits form a second one, zero otherwise). Map tasks form the codes of their records and sort and run-length count each batch, which
leaves one row a code however hot the pair is. The shuffle then sorts the codes externally (sorted
runs spilled to disk, merged in order) and a single pass over the sorted stream adds up the runs.
Lift and the odds ratio with continuity correction are applied to the counted pairs.

A record with very many items is hashed into blocks of about ``BLOCK`` items, and each pair of
blocks is worked off on its own, so no task holds a whole record; the pairs of items themselves are
the result that is asked for. Where a smallest count is given, items with fewer records cannot
reach it and leave before any pair is formed.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import cut, map_arrow, parallelism

BLOCK = 512
#: Bits of an item's number that a code holds.
ITEM_BITS = 31
#: Pairs that a task forms (one more record or pair of blocks at most).
TASK_PAIRS = 4_000_000


def items_of(ngrams: DataFrame) -> DataFrame:
    """Distinct (doc_id, item): lower-cased words joined by single blanks; null and empty tuples left out."""
    item = F.lower(F.concat_ws(" ", "ngram_tuple"))
    return ngrams.select("doc_id", item.alias("item")).where("doc_id is not null and item <> ''").distinct()


def numbered(items: DataFrame, min_records: int = 1) -> DataFrame:
    """(item, item_no, n_records): items held by at least ``min_records`` records, numbered from 0.

    The counted items are written once; numbers come from the place in the written partitions, so
    only one offset a partition passes through the driver.
    """
    spark = items.sparkSession
    counted = cut(items.groupBy("item").agg(F.count("*").alias("n_records")).where(F.col("n_records") >= min_records))
    placed = counted.withColumn("at", F.monotonically_increasing_id())
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, "part long, start long"))  # a row a partition
    return placed.withColumn("part", part).join(offsets, "part").select("item", (F.col("start") + within).alias("item_no"), "n_records")


def pair_codes(a: np.ndarray, b: np.ndarray, bits: int = ITEM_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(upper, code) of pairs of item numbers."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    mask = (1 << bits) - 1
    return (low >> bits << 32) | (high >> bits), ((low & mask) << 32) | (high & mask)


def _count_batch(batches, bits: int):
    """Codes of each batch of (left, right) lists, sorted and run-length counted."""
    import pyarrow as pa

    for batch in batches:
        runs, held = [], 0
        for left, right in zip(batch.column(0), batch.column(1)):
            x = np.asarray(left.values)
            if right.is_valid:
                y = np.asarray(right.values)
                i, j = np.repeat(x, len(y)), np.tile(y, len(x))
            else:
                p, q = np.triu_indices(len(x), 1)
                i, j = x[p], x[q]
            runs.append(pair_codes(i, j, bits))
            held += len(i)
            if held > TASK_PAIRS:
                yield _run(runs, pa)
                runs, held = [], 0
        if runs:
            yield _run(runs, pa)


def _run(codes: list[tuple[np.ndarray, np.ndarray]], pa):
    upper, code = (np.concatenate(c) for c in zip(*codes))
    if upper.any():
        order = np.lexsort((code, upper))
        upper, code = upper[order], code[order]
    else:
        code.sort()
    first = _firsts(upper, code)
    n = np.diff(np.concatenate((first, [len(code)])))
    return pa.RecordBatch.from_arrays([pa.array(upper[first], pa.int64()), pa.array(code[first], pa.int64()), pa.array(n, pa.int64())], names=["upper", "code", "n"])


def _firsts(upper: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Where the runs of equal codes of a sorted stream begin."""
    return np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (upper[1:] != upper[:-1])))) if len(code) else np.zeros(0, np.int64)


def _merge_runs(batches):
    """Add up equal codes of a sorted stream; the last code of a batch is carried over."""
    import pyarrow as pa

    def out(upper, code, n):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (upper, code, n)], names=["upper", "code", "n_shared"])

    upper = code = n = np.zeros(0, np.int64)
    for b in batches:
        upper, code, n = (np.concatenate((x, b.column(i).to_numpy(zero_copy_only=False))) for i, x in enumerate((upper, code, n)))
        if not len(code):
            continue
        first = _firsts(upper, code)
        upper, code, n = upper[first], code[first], np.add.reduceat(n, first)
        yield out(upper[:-1], code[:-1], n[:-1])
        upper, code, n = upper[-1:], code[-1:], n[-1:]
    yield out(upper, code, n)


def counted_pairs(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(upper, code, n_shared) from distinct (doc_id, item_no)."""
    spark = members.sparkSession
    size = cut(members.groupBy("doc_id").agg(F.count("*").alias("size")).where(F.col("size") > 1))
    # the work is in the pairs, which the bytes of the lists do not show
    n_pairs = size.agg(F.coalesce(F.sum(F.col("size").cast("double") * (F.col("size") - 1) / 2), F.lit(0.0))).first()[0]
    tasks_at_once = max(parallelism(spark), int(n_pairs // TASK_PAIRS) + 1)
    wide = members.join(size, "doc_id")
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    wide = wide.select("doc_id", "item_no", blocks.alias("blocks"), F.when(blocks > 1, F.pmod(F.xxhash64("item_no"), blocks)).otherwise(0).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    tasks = wide.select("doc_id", "item_no", "own", other).withColumn("lo", lo).withColumn("hi", hi).repartition(tasks_at_once, "doc_id", "lo", "hi")
    grouped = tasks.groupBy("doc_id", "lo", "hi").agg(
        F.collect_list(F.when(F.col("own") == F.col("lo"), F.col("item_no"))).alias("left"),
        F.collect_list(F.when(F.col("own") != F.col("lo"), F.col("item_no"))).alias("right"),
    )
    lists = grouped.select("left", F.when(F.col("lo") < F.col("hi"), F.col("right")).alias("right"))
    codes = map_arrow(lists, partial(_count_batch, bits=ITEM_BITS), "upper long, code long, n long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(codes.repartition(parts, "upper", "code").sortWithinPartitions("upper", "code"), _merge_runs, "upper long, code long, n_shared long")


def together(ngrams: DataFrame, min_shared: int = 1, block: int = BLOCK) -> DataFrame:
    """Every pair of items with at least ``min_shared`` records in common.

    Columns: item_a < item_b, n_shared, n_a, n_b, n_records (all records), lift (times chance) and
    log_odds (natural log of the odds ratio, 0.5 added to each cell of the two-by-two table).
    Null record ids, null and empty tuples are no items (a record with nothing else still counts
    as a record); repeated rows and other case count once; an empty table gives no rows.
    """
    items = cut(items_of(ngrams))
    total = ngrams.select("doc_id").where("doc_id is not null").agg(F.countDistinct("doc_id")).first()[0]
    names = cut(numbered(items, min_shared))
    members = items.join(names.select("item", "item_no"), "item").select("doc_id", "item_no")
    pairs = counted_pairs(members, block).where(F.col("n_shared") >= min_shared)
    half = F.lit((1 << 32) - 1)

    def number(upper, lower):
        return F.shiftleft(upper, ITEM_BITS).bitwiseOR(lower)

    no_a = number(F.shiftright("upper", 32), F.shiftright("code", 32))
    no_b = number(F.col("upper").bitwiseAND(half), F.col("code").bitwiseAND(half))
    a = names.select(F.col("item_no").alias("no_a"), F.col("item").alias("x"), F.col("n_records").alias("n_x"))
    b = names.select(F.col("item_no").alias("no_b"), F.col("item").alias("y"), F.col("n_records").alias("n_y"))
    named = pairs.select(no_a.alias("no_a"), no_b.alias("no_b"), "n_shared").join(a, "no_a").join(b, "no_b")
    swap = F.col("x") > F.col("y")
    out = named.select(
        F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "n_shared",
        F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("n_a"), F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("n_b"),
        F.lit(total).cast("long").alias("n_records"),
    )
    s, na, nb, n = (F.col(c).cast("double") for c in ("n_shared", "n_a", "n_b", "n_records"))
    odds = F.log((s + 0.5) * (n - na - nb + s + 0.5) / ((na - s + 0.5) * (nb - s + 0.5)))
    return out.withColumn("lift", s * n / (na * nb)).withColumn("log_odds", odds)


def surprising(pairs: DataFrame, times: int = 10) -> DataFrame:
    """Pairs that meet at least ``times`` as often as chance has it (in whole numbers, so without rounding)."""
    wide = [F.col(c).cast("decimal(19,0)") for c in ("n_shared", "n_records", "n_a", "n_b")]
    return pairs.where(wide[0] * wide[1] >= F.lit(times) * wide[2] * wide[3]).select("item_a", "item_b")
