"""Frequency of every distinct term and n-gram, by suffix sorting.

Every position of a text begins a suffix, cut after ``max_terms`` terms; the n-grams of the
collection are the prefixes of these suffixes. Suffixes are routed by their first term, sorted in
reverse lexicographic order, and one pass with a stack of the open prefixes yields the total count
and the number of records of every prefix: when a suffix leaves a prefix behind, that prefix is
complete.

Before the shuffle each block of texts is sorted the same way, and the blocks of a task are merged. A
task sends each of its distinct suffixes with its count and, for each prefix length, the number of
records in which it is the first suffix with that prefix. Summed over all suffixes that share a prefix
these are exactly the records holding it, since blocks have no record in common. A term that stands in
every text thus arrives once a task and suffix. First terms with more suffixes than a task should hold
are routed by their first two terms, and their own counts are added up afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import codepoints as cpk
from gleaner.runtime import cut, map_arrow, spread

#: Separates the terms of a suffix; sorts below every letter.
SEP = " "


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Text number and term number of every term in order, and the block's terms in sorted order."""
    low = [t.lower() for t in texts]
    cp, starts = cpk.joined(low)
    s, e = cpk.runs((cpk.classes()[cp] & cpk.LETTER) > 0)
    text = np.searchsorted(starts, s, side="right") - 1
    _, first, number = np.unique(cpk.span_hashes(cp, s, e), return_index=True, return_inverse=True)
    whole = "\n".join(low)
    words = [whole[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())]
    order = sorted(range(len(words)), key=words.__getitem__)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return text, place[number], [words[i] for i in order]


def block_suffixes(record: np.ndarray, part: np.ndarray, term: np.ndarray, max_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes (rows of term numbers, -1 past the end), counts, first records by prefix length."""
    n = len(term)
    suffix = np.full((n, max_terms), -1, np.int64)
    for j in range(max_terms):
        m = n - j
        if m > 0:
            inside = part[:m] == part[j:]
            suffix[:m, j][inside] = term[j:][inside]
    order = np.lexsort((record, *(suffix[:, j] for j in reversed(range(max_terms)))))
    suffix, record = suffix[order], record[order]
    fresh = np.ones(n, bool)
    if n:
        fresh[1:] = (suffix[1:] != suffix[:-1]).any(1)
    first = np.flatnonzero(fresh)
    counts = np.diff(np.concatenate((first, [n])))
    docs = np.zeros((len(first), max_terms), np.int64)
    group = np.cumsum(fresh) - 1
    for length in range(1, max_terms + 1):
        new = np.ones(n, bool)
        if n:
            new[1:] = (suffix[1:, :length] != suffix[:-1, :length]).any(1)
        prefix = np.cumsum(new) - 1
        pair = np.lexsort((prefix, record)) if length < max_terms else np.arange(n)
        lead = np.ones(n, bool)
        if n:
            lead[1:] = (prefix[pair][1:] != prefix[pair][:-1]) | (record[pair][1:] != record[pair][:-1])
        hit = pair[lead]
        hit = hit[suffix[hit, length - 1] >= 0]
        docs[:, length - 1] = np.bincount(group[hit], minlength=len(first))
    return suffix[first], counts, docs


#: Rows of suffixes that a task holds before it merges equal ones, and before it sends the rarer half of them.
MERGE_ROWS, HELD_ROWS = 1 << 20, 1 << 21


def _suffix_rows(columns: int, max_terms: int):
    """Map side: (record, text columns...) -> (suffix, n, d1..dk), equal suffixes of a task merged."""
    import pyarrow as pa

    names = ["suffix", "n", *(f"d{k}" for k in range(1, max_terms + 1))]

    def block(ks, ts):
        text, term, words = terms_of(ts)
        suffix, n, docs = block_suffixes(np.asarray(ks)[text], text, term, max_terms)
        col = np.array([*words, ""], object)
        parts = [col[suffix[:, j]].tolist() for j in range(max_terms)]
        full = parts[0] if max_terms == 1 else [SEP.join(p).rstrip(SEP) for p in zip(*parts)]
        return pa.Table.from_arrays([pa.array(full, pa.string()), pa.array(n, pa.int64()), *(pa.array(docs[:, k], pa.int64()) for k in range(max_terms))], names=names)

    def run(batches):
        held = _Merged(names)
        for b in batches:
            rows = enumerate(zip(*(cpk.values(b.column(1 + c)) for c in range(columns))))
            for ks, ts in _even_blocks(rows):
                yield from held.add(block(ks, ts))
        yield from held.rest()

    return run


class _Merged:
    """Suffixes of a task, equal ones merged. Where there are too many, the rarer half is sent on."""

    def __init__(self, names: list[str]):
        self.names, self.tables, self.rows, self.merged = names, [], 0, 0

    def add(self, table):
        self.tables.append(table)
        self.rows += table.num_rows
        if self.rows - self.merged > MERGE_ROWS:
            self._merge()
            if self.rows > HELD_ROWS:
                import pyarrow.compute as pc

                whole = self.tables[0]
                rare = pc.less_equal(whole.column("n"), pc.quantile(whole.column("n"), 0.5, interpolation="lower")[0])
                yield from whole.filter(rare).to_batches(65_536)
                self._keep(whole.filter(pc.invert(rare)))

    def _merge(self) -> None:
        import pyarrow as pa

        if self.tables:
            whole = pa.concat_tables(self.tables).group_by("suffix").aggregate([(c, "sum") for c in self.names[1:]])
            self._keep(pa.Table.from_arrays([whole.column("suffix"), *(whole.column(f"{c}_sum") for c in self.names[1:])], names=self.names))

    def _keep(self, table) -> None:
        self.tables, self.rows, self.merged = [table], table.num_rows, table.num_rows

    def rest(self):
        self._merge()
        for t in self.tables:
            yield from t.combine_chunks().to_batches(65_536)


def _even_blocks(rows):
    """Blocks of texts that never part the columns of a record (whose terms are counted together)."""
    ks: list = []
    ts: list[str] = []
    n = 0
    for key, texts in rows:
        row = [t or "" for t in texts]
        size = sum(map(len, row))
        if n and n + size > cpk.BLOCK_CHARS:
            yield ks, ts
            ks, ts, n = [], [], 0
        ks.extend([key] * len(row))
        ts.extend(row)
        n += size
    if ks:
        yield ks, ts


def _stack(max_terms: int):
    """Reduce side: one pass over suffixes in reverse lexicographic order with a stack of open prefixes.

    Equal prefixes stand together, so within a batch the counts of each prefix length are sums over runs; the
    last run of each length stays open on the stack until a batch begins with another prefix.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def columns(suffix) -> list:
        """The terms of each suffix by place, null past its end."""
        split = pc.split_pattern(suffix, SEP)
        start, size = split.offsets.to_numpy()[:-1], pc.list_value_length(split).to_numpy(zero_copy_only=False)
        return [split.values.take(pa.array(start + k, mask=size <= k)) for k in range(max_terms)]

    def run(batches):
        stack: list[list | None] = [None] * max_terms  # of each length: the open prefix, its count, its records

        def batch(closed: list[tuple]):
            cols = [*zip(*closed)] or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            terms = columns(b.column(0))
            n = b.column(1).to_numpy(zero_copy_only=False)
            fresh = np.zeros(b.num_rows, bool)
            fresh[0] = True
            prefix = None
            closed: list[tuple] = []
            for k in range(max_terms):
                t = terms[k]
                prefix = t if k == 0 else pc.binary_join_element_wise(prefix, t, SEP)  # null past the end
                fresh[1:] |= pc.fill_null(pc.not_equal(t[1:], t[:-1]), True).to_numpy(zero_copy_only=False)
                first = np.flatnonzero(fresh)
                total, records = np.add.reduceat(n, first), np.add.reduceat(b.column(2 + k).to_numpy(zero_copy_only=False), first)
                heads = prefix.take(pa.array(first))
                there = heads.is_valid().to_numpy(zero_copy_only=False)
                opened = stack[k]
                if opened is not None and there[0] and heads[0].as_py() == opened[0]:
                    total[0] += opened[1]
                    records[0] += opened[2]
                elif opened is not None:
                    closed.append((opened[0], k + 1, opened[1], opened[2]))
                stack[k] = [heads[-1].as_py(), int(total[-1]), int(records[-1])] if there[-1] else None
                done = np.flatnonzero(there[:-1])
                at = pa.array(done)
                yield pa.RecordBatch.from_arrays([heads.take(at), pa.array(np.full(len(done), k + 1, np.int32)), pa.array(total[done]), pa.array(records[done])], names=names)
            yield batch(closed)
        yield batch([(o[0], k + 1, o[1], o[2]) for k, o in enumerate(stack) if o is not None])

    names, kinds = ["term", "n_terms", "n_total", "n_reports"], (pa.string(), pa.int32(), pa.int64(), pa.int64())
    return run


#: Suffixes of one first term, as sent by the tasks, from which it is routed by two terms.
HEAVY_SUFFIXES = 100_000


def term_counts(reports: DataFrame, columns: tuple[str, ...] = ("title", "body"), max_terms: int = 1) -> DataFrame:
    """(term, n_terms, n_total, n_reports) of every n-gram of up to ``max_terms`` terms.

    Rows of ``reports`` are records (pass distinct ones). N-grams do not reach from one column
    into another. Null and empty texts have no terms but their records still count wherever a
    share of all records is taken.
    """
    spark = reports.sparkSession
    sent = ", ".join(f"d{k} long" for k in range(1, max_terms + 1))
    rows = map_arrow(spread(reports.select(F.lit(0), *columns)), _suffix_rows(len(columns), max_terms), f"suffix string, n long, {sent}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    route = F.substring_index("suffix", SEP, 1)
    heavy = None
    if max_terms > 1:
        rows = cut(rows)
        firsts = rows.groupBy(route.alias("first")).agg(F.count("*").alias("k"))
        total = rows.count()
        # no more than a few a partition can be heavy, so the list is small whatever the collection
        heavy = [r[0] for r in firsts.where(F.col("k") > max(HEAVY_SUFFIXES, total // (4 * parts))).select("first").collect()]
        if heavy:
            route = F.when(route.isin(heavy), F.substring_index("suffix", SEP, 2)).otherwise(route)
    routed = rows.withColumn("route", route).repartition(parts, "route").sortWithinPartitions(F.col("suffix").desc()).drop("route")
    counted = map_arrow(routed, _stack(max_terms), "term string, n_terms int, n_total long, n_reports long")
    if not heavy:
        return counted
    counted = cut(counted)
    split = (F.col("n_terms") == 1) & F.col("term").isin(heavy)
    single = counted.where(split).groupBy("term", "n_terms").agg(F.sum("n_total").alias("n_total"), F.sum("n_reports").alias("n_reports"))
    return counted.where(~split).unionAll(single)


def marked(counts: DataFrame, n_reports: int, common: float = 0.15, rare_reports: int = 2, rare_total: int = 3) -> DataFrame:
    """Add ``mark``: common (in more than this share of all reports), rare, or null."""
    mark = F.when(F.col("n_reports") > F.lit(common) * F.lit(n_reports), "common").when((F.col("n_reports") <= rare_reports) & (F.col("n_total") <= rare_total), "rare")
    return counts.withColumn("mark", mark)


def index_figures(index: DataFrame) -> DataFrame:
    """(term, index_total, index_reports): postings in any case, repeated rows once, the largest frequency holding."""
    rows = index.where("term is not null and doc_id is not null").groupBy(F.lower("term").alias("term"), "doc_id").agg(F.max("term_frequency").alias("tf"))
    return rows.groupBy("term").agg(F.sum("tf").alias("index_total"), F.count("*").alias("index_reports"))
