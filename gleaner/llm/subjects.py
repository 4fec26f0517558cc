"""Subject areas of documents, from the share of their sentences that deal with each subject.

A document is read as its sentences, each a bag of words and word pairs (of character pairs and
triples in scripts without spaces), hashed into a table whose size follows the collection (``slot_bits``).
One labelled document in ``HELD`` is held out: its label takes no part in steps 1 and 2. Training has three steps:

1. Complement naive Bayes from documents labelled as a whole: the weight of a feature for a subject
   is its log frequency in documents of the subject against its log frequency in all others.
   Documents without hand-made labels count with a small weight under the subjects of their codes.
2. Expectation-maximization over all documents, labelled or not: sentences take posteriors over the
   subjects and *none*, under a mixture of their own document that starts from its label or codes;
   counts of features weighted by these posteriors give the next complement model.
3. Calibration: on a bounded sample of the labels held out, Platt scaling turns each subject's
   evidence into independent posteriors, by which sentences are decided one subject at a time; a second
   one turns a document's share of such sentences into its posterior.

The expectation steps are single passes over a compact table of features. A task sends the counts of
the features that it saw, added up in slices before the driver sees them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import codepoints as cpk
from gleaner.llm import sentences as sent
from gleaner.llm.leakage import _lower
from gleaner.runtime import cut, map_arrow, spread

SUBJECTS = ("science", "law", "sport", "software", "energy", "health", "finance", "farming")
NONE = len(SUBJECTS)
#: Powers of two between which the number of slots lies, and the slots for each feature expected in a collection.
BITS, MOST_BITS, SLOTS_EACH = 18, 21, 4
#: One labelled document in so many is kept for the calibration.
HELD = 5
_SLICES = 32
#: Evidence (natural log) that a sentence must carry to leave *none* in the first pass.
FIRST_BAR = 4.0
#: Share of *none* in the mixture of every document: fixed, so that it never yields to a strong subject.
NONE_SHARE = 0.4


@dataclass
class SubjectModel:
    """weights[feature, class]: log odds against the complement; prior log odds of each class; Platt scales of documents and sentences."""

    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray | None = None
    shift: np.ndarray | None = None
    unit_scale: np.ndarray | None = None
    unit_shift: np.ndarray | None = None


def unit_features(texts: list[str], units: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature number, unit number (over the whole block) and document of each unit."""
    cp, starts = cpk.joined(texts)
    cp = _lower()[cp]
    flat = [(d, starts[d] + s, starts[d] + e) for d, us in enumerate(units) for s, e in us]
    if not flat:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, us, ue = (np.array(x, np.int64) for x in zip(*flat))
    s, e = cpk.runs((cpk.classes()[cp] & (cpk.LETTER | cpk.MARK)) > 0)
    unit = np.searchsorted(us, s, side="right") - 1
    inside = (unit >= 0) & (s < ue[np.maximum(unit, 0)])
    s, e, unit = s[inside], e[inside], unit[inside]
    unspaced = _unspaced(cp[s]) if len(s) else np.zeros(0, bool)
    h = cpk.span_hashes(cp, s, e)
    keep = ~unspaced
    hs, hu = h[keep], unit[keep]
    feats, owner = [hs], [hu]
    if len(hs) > 1:
        pair = hu[1:] == hu[:-1]
        with np.errstate(over="ignore"):
            feats.append(cpk.mix(hs[:-1][pair] * np.uint64(0xD6E8FEB86659FD93) + hs[1:][pair]))
        owner.append(hu[1:][pair])
    if unspaced.any():
        ws, we, wu = s[unspaced], e[unspaced], unit[unspaced]
        for n in (2, 3):
            count = np.maximum(we - ws - n + 1, 0)
            at = np.repeat(ws, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            feats.append(cpk.span_hashes(cp, at, at + n))
            owner.append(np.repeat(wu, count))
    f, o = np.concatenate(feats), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return (f[order] >> np.uint64(32)).astype(np.uint32), o[order], doc


def _held_out() -> Column:
    """Whether a report's label is kept for the calibration (by a hash of the key, so for good)."""
    return F.pmod(F.xxhash64("newid"), F.lit(HELD)) == 0


def slot_bits(occurrences: int) -> int:
    """Bits of the table: room for the distinct features that a collection of so many occurrences is expected to
    have, which grow as the power 0.7 (Heaps), within the bounds above."""
    return min(MOST_BITS, max(BITS, math.ceil(math.log2(SLOTS_EACH * max(occurrences, 1) ** 0.7))))


def _unspaced(c: np.ndarray) -> np.ndarray:
    """Thai, kana, Han: scripts that put no blanks between words."""
    return ((c >= 0xE00) & (c <= 0xEFF)) | ((c >= 0x3040) & (c <= 0x9FFF)) | ((c >= 0xF900) & (c <= 0xFAFF)) | (c >= 0x20000)


def featured(reports: DataFrame, boundaries: sent.BoundaryModel) -> DataFrame:
    """(newid, label, hint, n_units, units, feats, n_feats): one row a report, features as packed arrays of 32-bit hashes."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, label, hint = (b.column(i).to_pylist() for i in range(3))
            for rows, texts in cpk.blocks(range(b.num_rows), cpk.values(b.column(3))):
                units = [sent.split_text(t, boundaries) for t in texts]
                f, unit, doc = unit_features(texts, units)
                n = np.array([len(u) for u in units], np.int64)
                first = np.concatenate(([0], np.cumsum(n)))
                cuts = np.searchsorted(unit, first)
                packed = [((unit[a:z] - k).astype(np.int32).tobytes(), f[a:z].tobytes()) for a, z, k in zip(cuts[:-1], cuts[1:], first)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[r] for r in rows], pa.int64()), pa.array([label[r] for r in rows], pa.int32()), pa.array([hint[r] for r in rows], pa.int32()), pa.array(n, pa.int32()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary()), pa.array(np.diff(cuts), pa.int64())],
                    names=["newid", "label", "hint", "n_units", "units", "feats", "n_feats"],
                )

    return map_arrow(spread(reports.select("newid", "label", "hint", "body")), run, "newid long, label int, hint int, n_units int, units binary, feats binary, n_feats long")


#: Features of the reports that a pass holds at a time.
PIECE_FEATURES = 1 << 20


def _pieces(batch):
    """Slices of a batch with a bounded number of features (a very long report is one of its own)."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(batch.column(5)).to_numpy(zero_copy_only=False)) // 4
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + PIECE_FEATURES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _load(batch, bits: int) -> tuple[np.ndarray, ...]:
    """Labels, hints, units a document, document of each unit, unit of each feature, features."""
    label, hint = (np.array(batch.column(i).to_pylist(), np.int64) for i in (1, 2))
    n = np.array(batch.column(3).to_pylist(), np.int64)
    parts = [np.frombuffer(x, np.int32) for x in batch.column(4).to_pylist()]
    first = np.cumsum(n) - n
    unit = np.concatenate([p + k for p, k in zip(parts, first)]) if parts else np.zeros(0, np.int64)
    feats = np.concatenate([np.frombuffer(x, np.uint32) for x in batch.column(5).to_pylist()]) if parts else np.zeros(0, np.uint32)
    return label, hint, n, np.repeat(np.arange(len(n)), n), unit.astype(np.int64), (feats & np.uint32((1 << bits) - 1)).astype(np.int64)


def _evidence(weights: np.ndarray, feats: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, weights.shape[1]))
    if len(feats):
        first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        out[unit[first]] = np.add.reduceat(weights[feats], first, axis=0, dtype=np.float64)
    return out


def _mask(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] >> np.arange(NONE)) & 1


def _posteriors(evidence: np.ndarray, label: np.ndarray, hint: np.ndarray, doc: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Sentence posteriors over subjects and none, with the mixture of each document."""
    size = len(label)
    start = np.full((size, NONE + 1), 0.02)
    start[:, :NONE] += np.where(label[:, None] > 0, 0.3 * _mask(label), 0.1 * _mask(hint))
    start[:, NONE] = 0
    mix = _with_none(start)
    e = np.exp(np.clip(evidence - evidence.max(1, keepdims=True), -60, 0))
    r = e
    for _ in range(rounds):
        r = e * mix[doc]
        r /= r.sum(1, keepdims=True)
        mix = start * 2
        for c in range(NONE):
            mix[:, c] += np.bincount(doc, r[:, c], size)
        mix = _with_none(mix)
    return r


def _with_none(mix: np.ndarray) -> np.ndarray:
    mix[:, NONE] = 0
    mix = mix / mix.sum(1, keepdims=True) * (1 - NONE_SHARE)
    mix[:, NONE] = NONE_SHARE
    return mix


def complement(counts: np.ndarray, strength: float = 4.0, min_count: float = 8.0, step: int = 1 << 17) -> np.ndarray:
    """Log odds of each feature in a class against all other classes, shrunk towards zero when rare."""
    own = counts.sum(0, dtype=np.float64)
    whole, rest = own.sum(), own.sum() - own
    out = np.empty(counts.shape, np.float32)
    for k in range(0, len(counts), step):
        c = counts[k : k + step].astype(np.float64)
        total = c.sum(1)
        share = ((total + 1e-9) / (whole + 1e-6))[:, None] * strength * 50 + 1e-3
        a = np.log((c + share) / (own + strength * 50 + 1e-3 * len(counts)))
        b = np.log((total[:, None] - c + share) / (rest + strength * 50 + 1e-3 * len(counts)))
        w = (a - b) * (total / (total + strength))[:, None]
        w[total < min_count] = 0.0
        out[k : k + step] = w
    return out


def _counted(rows: DataFrame, weigh, bits: int) -> np.ndarray:
    """Sum over all documents of ``weigh(batch) -> (feature weights (k,), features)``, as one table."""
    import pyarrow as pa

    size, width, classes = 1 << bits, (1 << bits) // _SLICES, NONE + 1

    def run(batches):
        total = None
        for b in (p for batch in batches for p in _pieces(batch)):
            r, feats = weigh(b)
            if total is None:
                total = np.zeros((size, classes), np.float32)
            if 2 * len(feats) < size:
                used, at = np.unique(feats, return_inverse=True)
                total[used] += np.stack([np.bincount(at, r[:, c], len(used)) for c in range(classes)], 1).astype(np.float32)
            else:  # cheaper than sorting
                for c in range(classes):
                    total[:, c] += np.bincount(feats, r[:, c], size)
        if total is None:
            return
        used = np.flatnonzero(total.any(1))
        cuts = np.searchsorted(used, np.arange(_SLICES + 1) * width)
        parts = [used[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([(u % width).astype(np.int32).tobytes() for u in parts], pa.binary()), pa.array([total[u].tobytes() for u in parts], pa.binary())], names=["slice", "slots", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, at, c in zip(*(b.column(j).to_pylist() for j in range(3))):
                sums.setdefault(i, np.zeros((width, classes), np.float32))[np.frombuffer(at, np.int32)] += np.frombuffer(c, np.float32).reshape(-1, classes)
        for i, t in sums.items():
            used = np.flatnonzero(t.any(1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([used.tobytes()], pa.binary()), pa.array([t[used].tobytes()], pa.binary())], names=["slice", "slots", "counts"])

    kinds = "slice int, slots binary, counts binary"
    out = np.zeros((_SLICES, width, classes), np.float32)
    for i, at, c in map_arrow(map_arrow(rows, run, kinds).repartition(_SLICES, "slice"), add, kinds).collect():
        out[i, np.frombuffer(at, np.int32)] = np.frombuffer(c, np.float32).reshape(-1, classes)
    return out.reshape(size, classes)


def train(rows: DataFrame, passes: int = 3) -> SubjectModel:
    """Complement naive Bayes, then ``passes`` of expectation-maximization over all rows of ``featured``."""
    bits = slot_bits(rows.agg(F.sum("n_feats")).first()[0] or 0)
    rows = rows.withColumn("label", F.when(_held_out(), 0).otherwise(F.col("label")))

    def by_label(batch):
        label, hint, _, doc, unit, feats = _load(batch, bits)
        known = label > 0
        m = np.where(known[:, None], _mask(label), _mask(hint)).astype(np.float64)
        out = np.zeros((len(label), NONE + 1))
        out[:, :NONE] = m / np.maximum(m.sum(1, keepdims=True), 1) * np.where(known, 1.0, 0.5)[:, None]
        return out[doc[unit]], feats

    spark = rows.sparkSession
    weights = complement(_counted(rows, by_label, bits), min_count=3.0)
    weights[:, NONE] = 0.0
    bias = np.zeros(NONE + 1)
    bias[NONE] = FIRST_BAR
    for _ in range(passes):
        held = spark.sparkContext.broadcast((weights, bias))

        def expect(batch, held=held):
            weights, bias = held.value
            label, hint, _, doc, unit, feats = _load(batch, bits)
            r = _posteriors(_evidence(weights, feats, unit, len(doc)) + bias, label, hint, doc)
            return r[unit], feats

        counts = _counted(rows, expect, bits)
        held.unpersist()
        weights = complement(counts)
        own = counts.sum(0, dtype=np.float64)
        bias = np.log((own + 1) / (own.sum() - own + 1))
    return SubjectModel(weights, bias)


#: Evidence (natural log) beyond which a sentence counts as certain in the calibration.
CERTAIN = 20.0


def _bits(model: SubjectModel) -> int:
    return (len(model.weights) - 1).bit_length()


def _margins(model: SubjectModel, feats: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """(units, subjects): evidence of a sentence for each subject, against the others and against *none*."""
    e = _evidence(model.weights, feats, unit, n) + model.bias
    return np.clip(np.minimum(e[:, :NONE], e[:, :NONE] - e[:, NONE:]), -CERTAIN, CERTAIN)


def unit_decisions(model: SubjectModel, feats: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """(units, subjects): whether a sentence deals with each subject, decided independently.

    With calibrated evidence (``calibrate_units``) a posterior above a half decides, else the raw log odds.
    """
    m = _margins(model, feats, unit, n)
    return m > 0 if model.unit_scale is None else model.unit_scale * m + model.unit_shift > 0


def _shares(batch, model: SubjectModel) -> tuple[np.ndarray, np.ndarray]:
    label, _, n, doc, unit, feats = _load(batch, _bits(model))
    yes = unit_decisions(model, feats, unit, len(doc))
    hit = np.zeros((len(n), NONE))
    np.add.at(hit, doc, yes)
    return hit, n


def shares(rows: DataFrame, model: SubjectModel) -> DataFrame:
    """(newid, label, subject, n_hits, n_units) for every subject of every report with a sentence; n_hits may be 0."""
    import pyarrow as pa

    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in (p for batch in batches for p in _pieces(batch)):
            hit, n = _shares(b, held.value)
            d, c = np.nonzero(np.broadcast_to(n[:, None] > 0, hit.shape))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(d)), b.column(1).take(pa.array(d)), pa.array([SUBJECTS[i] for i in c], pa.string()), pa.array(hit[d, c].astype(np.int32)), pa.array(n[d].astype(np.int32))],
                names=["newid", "label", "subject", "n_hits", "n_units"],
            )

    return map_arrow(rows, run, "newid long, label int, subject string, n_hits int, n_units int")


def _platt(x: np.ndarray, y: np.ndarray, scale: float, shift: float, ridge: float) -> tuple[float, float]:
    """Scale and shift of the logistic curve of y over x, with a ridge towards the given ones."""
    a, b = scale, shift
    for _ in range(200 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, w = p - y, p * (1 - p)
        grad = np.array([(g * x).sum() + ridge * (a - scale), g.sum() + ridge * (b - shift)])
        hess = np.array([[(w * x**2).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
    return a, b


def calibrate_units(model: SubjectModel, rows: DataFrame, fit_labels: int = 4000, least: float = 0.25) -> SubjectModel:
    """Platt scaling of each subject's evidence in sentences, on at most ``fit_labels`` labelled documents that were held out.

    A document deals with a subject where ``least`` of its sentences do, so its label speaks about the
    sentence that completes this share: the label is fitted over the evidence of that sentence, and
    the curve holds for every sentence. A subject that no, or every, document of the sample has
    keeps its raw log odds.
    """
    import pyarrow as pa

    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in (p for batch in batches for p in _pieces(batch)):
            label, _, n, doc, unit, feats = _load(b, _bits(held.value))
            m = _margins(held.value, feats, unit, len(doc))
            at = (np.cumsum(n) - n + np.ceil(least * n).astype(np.int64) - 1)[n > 0]
            x = np.stack([m[np.lexsort((-m[:, c], doc)), c][at] for c in range(NONE)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(label[n > 0], pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    got = map_arrow(sent.lowest(rows.where((F.col("label") > 0) & _held_out()), "newid", fit_labels), run, "label int, x binary").collect()
    x = np.array([np.frombuffer(r.x) for r in got]).reshape(-1, NONE)
    y = _mask(np.array([r.label for r in got], np.int64))
    fits = [_platt(x[:, c], y[:, c], 1.0, 0.0, 0.1) if 0 < y[:, c].sum() < len(y) else (1.0, 0.0) for c in range(NONE)]
    scale, shift = np.array(fits).T
    return replace(model, unit_scale=scale, unit_shift=shift)


def calibrate(model: SubjectModel, rows: DataFrame, fit_labels: int = 4000) -> SubjectModel:
    """Platt scaling of each subject's share on at most ``fit_labels`` labelled documents that were held out, those without a hit among them."""
    sample = sent.lowest(rows.where((F.col("label") > 0) & _held_out()), "newid", fit_labels)
    got = [(r.newid, r.label, r.subject, r.n_hits / r.n_units) for r in shares(sample, model).collect()]
    ids = sorted({g[:2] for g in got})
    x = np.zeros((len(ids), NONE))
    at = {k: i for i, (k, _) in enumerate(ids)}
    for newid, _, subject, share in got:
        x[at[newid], SUBJECTS.index(subject)] = share
    y = _mask(np.array([m for _, m in ids], np.int64)) if ids else np.zeros((0, NONE))
    model.scale, model.shift = np.full(NONE, 20.0), np.full(NONE, -5.0)
    for c in range(NONE):
        # a ridge towards the threshold of a quarter keeps subjects with few labels calibrated
        model.scale[c], model.shift[c] = _platt(x[:, c], y[:, c], 20.0, -5.0, 0.02)
    return model


def prepared(reports: DataFrame, labels: DataFrame, codes: DataFrame, boundaries: sent.BoundaryModel) -> DataFrame:
    """Features of every distinct report with a body, its hand-made labels and the subjects of its codes as bits.

    The code list is small and fixed; codes are compared without case and outer blanks. Reports
    without labels or known codes have zero bits.
    """
    bit = F.create_map(*[x for i, s in enumerate(SUBJECTS) for x in (F.lit(s), F.lit(1 << i))])
    lab = labels.where("newid is not null").groupBy("newid").agg(F.bit_or(F.coalesce(bit[F.col("subject")], F.lit(0))).alias("label"))
    table = codes.where("subject is not null").groupBy(F.lower(F.trim("code")).alias("code")).agg(F.bit_or(F.coalesce(bit[F.col("subject")], F.lit(0))).alias("bits")).collect()
    known = F.create_map(*[F.lit(x) for r in table for x in (r[0], r[1])]) if table else None
    own = F.aggregate(F.coalesce("topics", F.array().cast("array<string>")), F.lit(0), lambda acc, t: acc.bitwiseOR(F.coalesce(known[F.lower(F.trim(t))], F.lit(0)))) if table else F.lit(0)
    docs = reports.select("newid", "body", own.alias("hint")).join(lab, "newid", "left")
    return cut(featured(docs.select("newid", F.coalesce("label", F.lit(0)).cast("int").alias("label"), F.col("hint").cast("int"), "body"), boundaries))


def found(shares: DataFrame, least: float = 0.25) -> DataFrame:
    """(newid, subject) where at least this share of the document's units deals with the subject."""
    return shares.where((F.col("n_hits") > 0) & (F.col("n_hits") >= F.lit(least) * F.col("n_units"))).select("newid", "subject")


def posteriors(shares: DataFrame, model: SubjectModel) -> DataFrame:
    """Calibrated posterior of all subjects for every report with a sentence."""
    at = F.create_map(*[x for i, s in enumerate(SUBJECTS) for x in (F.lit(s), F.array(F.lit(float(model.scale[i])), F.lit(float(model.shift[i]))))])[F.col("subject")]
    share = F.col("n_hits") / F.col("n_units")
    return shares.select("newid", "subject", share.alias("unit_share"), (1 / (1 + F.exp(-(at[0] * share + at[1])))).alias("posterior"))
