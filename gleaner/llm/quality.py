"""Per-document text quality: statistics, and the share of prose, list, table and junk lines.

A hidden Markov model runs over the lines of a text. Its states are the four kinds; a line is
observed as a vector of binned statistics (length, shares of letters, figures and symbols, column
gaps, first and last characters, token lengths, ...). As a kind has several looks (bullets or bare
names, columns or commas, symbol soup or encoded bytes), each state emits through a mixture of
independent-feature components, learned with expectation-maximization. Training starts from
documents labelled as a whole, so every line first takes its document's kind, and Baum-Welch
passes then let lines leave it (a heading above a list, a table below a story). The verdict of a
document is the kind holding more than half of its characters.

Labels hold mistakes, and a mixture would give each of them a component of its own, which could then
draw every line of that language. So labels are tried first: a regularized logistic regression over
the line statistics of whole documents, fitted on some folds of the sample, judges the other ones, and
a label that it contradicts has no say in the model. Lines leave their document's kind only as long
as that kind keeps half of the characters, so that no document changes sides in training. When texts are
tagged, the regression's posterior of the whole document joins the emissions of its lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import codepoints as cpk
from gleaner.runtime import cut, map_arrow, spread

KINDS = ("prose", "list", "table", "junk")
_CLOSING = ".!?…。！？।॥"
_QUOTES = "\"'”’»」』“)]）"


def _member(chars: str) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in chars]] = True
    return out


def _rank(x: np.ndarray, cuts) -> np.ndarray:
    return np.searchsorted(np.asarray(cuts, float), x, side="right")


#: Code points of the scripts that a line statistic tells apart (kana, Han, Thai, Indic).
SCRIPTS = (((0x3040, 0x3100),), ((0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)), ((0xE00, 0xE80),), ((0x900, 0xE00),))
#: Line statistics, and bins of the one with the most.
FEATURES, BINS = 21, 135
#: Pseudo-count of each bin of a feature.
SMOOTH = 0.3
_SHARES = (0.02, 0.06, 0.12, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9)
_TABLES: dict = {}


def _tables() -> dict:
    if not _TABLES:
        c = cpk.classes()
        kind = np.zeros(0x110000, np.int8)  # class of a line's first and last characters
        kind[(c & cpk.LETTER) > 0] = 1
        kind[(c & cpk.UPPER) > 0] = 2
        kind[0x900:0x20000][(c[0x900:0x20000] & (cpk.LETTER | cpk.MARK)) > 0] = 3
        kind[(c & cpk.DIGIT) > 0] = 4
        for chars, k in ((_CLOSING, 5), (_QUOTES + "„«「『", 6), (",;:、，；：", 7), ("-*•–—·+", 8), ("([{<", 9), ("|/\\_=~#@%&^$", 10)):
            kind[[ord(x) for x in chars]] = k
        flags = np.zeros(0x110000, np.uint16)
        for i, m in enumerate((c & cpk.LETTER, c & cpk.DIGIT, c & (cpk.PUNCT | cpk.SYMBOL), c & cpk.UPPER, c & cpk.MARK)):
            flags[m > 0] |= 1 << i
        flags[_member(_CLOSING)] |= 1 << 5
        flags[_member("|,;:>=\t/{}()_")] |= 1 << 6
        flags[_member("aeiouyAEIOUY")] |= 1 << 7
        flags[0x41:0x5B] |= 1 << 8
        flags[0x61:0x7B] |= 1 << 8
        flags[0x80:0x100] |= 1 << 9
        flags[[0xFFFD, 0x201A, 0x20AC, 0x2020]] |= 1 << 9
        for i, ranges in enumerate(SCRIPTS):
            for lo, hi in ranges:
                flags[lo:hi] |= 1 << (10 + i)
        combos, combo = np.unique(flags, return_inverse=True)
        bits = ((combos[:, None] >> np.arange(14)) & 1).astype(np.int64)
        low, up, let, dig = (bits[:, 0] & ~bits[:, 3] & 1), bits[:, 3], bits[:, 0], bits[:, 1]
        trans = np.outer(low, up) | (np.outer(let, dig) | np.outer(dig, let)) << 1
        _TABLES.update(kind=kind, combo=combo.astype(np.int16), bits=bits, trans=trans.astype(np.int8).ravel(), black=(c & cpk.SPACE) == 0, ends=_member(_CLOSING + _QUOTES))
    return _TABLES


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binned statistics (lines, features), document of each line, its characters; blank lines left out."""
    t = _tables()
    cp, starts = cpk.joined(texts)
    black = t["black"][cp]
    ts, te = cpk.runs(black)
    nl = np.flatnonzero(cp == 10)
    first_token = np.searchsorted(ts, np.concatenate(([0], nl[:-1] + 1)))
    after = np.concatenate((first_token[1:], [len(ts)]))
    keep = after > first_token
    ft, lt = first_token[keep], after[keep] - 1
    if not len(ft):
        return np.zeros((0, FEATURES), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last, size = ts[ft], te[lt] - 1, len(ft)
    doc = np.searchsorted(starts, first, side="right") - 1
    tokens = lt - ft + 1
    tline = np.repeat(np.arange(size), tokens)
    width = te - ts

    def per_token(mask: np.ndarray) -> np.ndarray:
        return np.bincount(tline[mask], minlength=size)

    def per_char(at: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(first, at, side="right") - 1, minlength=size)

    # one histogram of character classes a line gives every plain count
    cls = t["combo"][cp]
    line = np.repeat(np.arange(size, dtype=np.int32), np.diff(np.concatenate((first, [len(cp)]))))
    many = len(t["bits"])
    hist = np.bincount(line * many + cls[first[0] :], minlength=size * many).reshape(size, many)
    letters, digits, symbols, upper, marks, closing, seps, vowels, ascii_letters, high, *scripts = (hist @ t["bits"]).T
    n = np.bincount(tline, width, size).astype(np.int64)
    longest = np.maximum.reduceat(width, ft)
    c1 = cls[:-1]
    c2 = cls[1:]
    trans = t["trans"][c1.astype(np.int32) * many + c2]
    camel, mixed = per_char(np.flatnonzero(trans & 1) + 1), per_char(np.flatnonzero(trans & 2) + 1)
    same = per_char(np.flatnonzero((cp[1:] == cp[:-1]) & black[1:]) + 1)
    # two blanks or more between fields; wide spacing behind a closing mark is only a typist's habit
    inner = np.ones(len(ts), bool)
    inner[ft] = False
    wide = inner & (np.concatenate(([0], ts[1:] - te[:-1])) > 1) & ~t["ends"][cp[np.concatenate(([0], te[:-1] - 1))]]
    gaps = per_token(wide) + per_char(np.flatnonzero(cp == 9)[np.flatnonzero(cp == 9) >= first[0]])
    head = t["bits"][cls[ts]]
    caps, numbers = per_token(head[:, 3] > 0), per_token(head[:, 1] > 0)
    small = per_token((head[:, 0] > 0) & (head[:, 3] == 0) & (width <= 3))
    th = cpk.span_hashes(cp, ts, te)
    by = np.argsort(th ^ (tline.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    fresh = np.concatenate(([True], (th[by][1:] != th[by][:-1]) | (tline[by][1:] != tline[by][:-1])))
    distinct = np.bincount(tline[by][fresh], minlength=size)
    words = letters + marks
    k = t["kind"]
    shape = k[cp[first]].astype(np.int64) * 11 + k[cp[np.minimum(first + 1, last)]]
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1]))
    alike = np.concatenate(([0], (shape[1:] == shape[:-1]).astype(np.int64))) + 2 * np.concatenate(([0], (np.abs(np.log(n[1:] / n[:-1])) < 0.35).astype(np.int64)))
    alike[new_doc] = 4
    whole = cpk.mix(np.add.reduceat(th * (np.arange(len(ts), dtype=np.uint64) - np.repeat(ft, tokens).astype(np.uint64) + np.uint64(1)), ft))
    order = np.lexsort((whole, doc))
    echo = np.zeros(size, bool)
    twin = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    echo[order[1:][twin]] = echo[order[:-1][twin]] = True
    alike[echo & (n > 3)] = 5
    cols = [
        _rank(n, (4, 8, 12, 18, 26, 40, 60, 90, 150, 300, 1000)), _rank(words / n, _SHARES), _rank(digits / n, _SHARES), _rank(symbols / n, _SHARES),
        np.minimum(gaps, 6), _rank(seps / tokens, (0.01, 0.05, 0.1, 0.2, 0.4, 0.7, 1.01, 2)), shape, k[cp[last]].astype(np.int64),
        _rank(n / tokens, (1.5, 2.5, 3.5, 4.5, 5.5, 7, 9, 14, 30, 70)), _rank(longest, (3, 6, 9, 12, 16, 22, 35, 60, 90)), _rank(tokens, (1.5, 2.5, 3.5, 5, 7, 10, 15, 25, 60)),
        np.where(ascii_letters * 2 < n, _script(np.stack(scripts), letters, n), _rank(vowels / np.maximum(ascii_letters, 1), (0.03, 0.08, 0.14, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.7))),
        _rank(camel / n, (0.002, 0.02, 0.05, 0.1, 0.15)), _rank(high / n, (0.01, 0.03, 0.07, 0.12, 0.2, 0.35)), _rank(same / n, (0.01, 0.05, 0.1, 0.2, 0.5, 0.8)),
        _rank(mixed / n, (0.002, 0.02, 0.06, 0.12, 0.2)), _rank(caps / tokens, (0.05, 0.2, 0.4, 0.6, 0.8, 0.99)), _rank(closing / tokens, (0.01, 0.04, 0.1, 0.2, 0.4, 0.8)),
        np.where(tokens < 6, 9, _rank(distinct / tokens, (0.1, 0.25, 0.5, 0.7, 0.85, 0.95))), _rank(small / tokens, (0.02, 0.1, 0.2, 0.3, 0.45, 0.7)), alike * 5 + _rank(numbers / tokens, (0.05, 0.3, 0.6, 0.9)),
    ]
    return np.stack(cols, 1), doc, last + 1 - first


def _script(counts: np.ndarray, letters: np.ndarray, n: np.ndarray) -> np.ndarray:
    """12 to 15 for a line mostly in one of ``SCRIPTS`` (kana marks Japanese among Han), 16 for other letters, else 11."""
    counts = counts * np.array([4, 1, 1, 1])[:, None]
    return np.where(counts.max(0) * 3 > n, 12 + counts.argmax(0), np.where(letters * 2 > n, 16, 11))


#: Largest difference (natural log) that one line makes, and the odds that a line is not of its document's kind.
LINE_RANGE, STRAY = 8.0, np.exp(-4.0)


@dataclass
class LineModel:
    """Log probabilities: start (K), transitions (K, K), emissions as a table a component (K, M, features, bins);
    ``whole`` are the weights of the regression over whole documents (features * bins, K)."""

    start: np.ndarray
    move: np.ndarray
    mix: np.ndarray
    emit: np.ndarray
    whole: np.ndarray

    def log_emission(self, x: np.ndarray) -> np.ndarray:
        """(lines, K), in blocks of lines."""
        kinds, parts, feats, _ = self.emit.shape
        out = np.empty((len(x), kinds))
        flat = np.ascontiguousarray(self.emit.reshape(kinds * parts, feats, -1).transpose(1, 2, 0)).astype(np.float32)
        base = self.mix.reshape(-1).astype(np.float32)
        for a in range(0, len(x), 8192):
            b = x[a : a + 8192]
            lp = np.repeat(base[None], len(b), 0)
            for f in range(feats):
                lp += flat[f][b[:, f]]
            lp = lp.reshape(len(b), kinds, parts)
            top = lp.max(2)
            out[a : a + 8192] = top + np.log(np.exp(lp - top[:, :, None]).sum(2))
        return out

    def line_scores(self, x: np.ndarray, doc: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """(lines, K): log emission, no line weighing more than ``LINE_RANGE``, and what the whole document says of a line's kind.

        A line takes its document's kind with certainty or else, at the odds of ``STRAY``, any kind.
        """
        e = self.log_emission(x)
        if not len(e):
            return e
        at, own = np.unique(doc, return_inverse=True)
        p = _softmax(np.concatenate([s @ self.whole for s in document_shares(x, own, chars, len(at))]))
        return np.maximum(e, e.max(1, keepdims=True) - LINE_RANGE) + np.log(p + (1 - p) * STRAY)[own]

    def tag(self, x: np.ndarray, doc: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return self.best_path(self.line_scores(x, doc, chars), doc)

    def best_path(self, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Viterbi for all documents at once: step i advances every document that has a line i."""
        if not len(e):
            return np.zeros(0, np.int64)
        begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        size = np.diff(np.concatenate((begin, [len(doc)])))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        back = np.zeros(e.shape, np.int8)
        v = self.start + e[begin]
        final = np.empty(len(begin), np.int64)
        score = v.copy()
        for i in range(1, int(size[0])):
            m = int(np.searchsorted(-size, -i, side="left"))
            at = begin[:m] + i
            step = score[:m, :, None] + self.move
            back[at] = step.argmax(1)
            score[:m] = step.max(1) + e[at]
        final = score.argmax(1)
        out = np.empty(len(e), np.int64)
        state = final.copy()
        for i in range(int(size[0]) - 1, -1, -1):
            m = int(np.searchsorted(-size, -i, side="left"))
            at = begin[:m] + i
            out[at] = state[:m]
            if i:
                state[:m] = back[at, state[:m]]
        return out


def _fit_parts(x: np.ndarray, weight: np.ndarray, parts: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixture of independent-feature components of one kind, by expectation-maximization."""
    rng = np.random.default_rng(seed)
    n, feats = x.shape
    resp = rng.dirichlet(np.full(parts, 0.3), n) if n else np.zeros((0, parts))
    cell = x + np.arange(feats) * BINS
    mix, emit = np.full(parts, -np.log(parts)), np.full((parts, feats, BINS), -np.log(BINS))
    for _ in range(rounds):
        r = resp * weight[:, None]
        mass = r.sum(0) + 0.5
        mix = np.log(mass / mass.sum())
        for p in range(parts):
            c = np.bincount(cell.ravel(), np.repeat(r[:, p], feats), feats * BINS).reshape(feats, BINS) + SMOOTH
            emit[p] = np.log(c / c.sum(1, keepdims=True))
        if n:
            lp = _log_parts(x, mix, emit)
            lp -= lp.max(1, keepdims=True)
            resp = np.exp(lp)
            resp /= resp.sum(1, keepdims=True)
    return mix, emit


def _log_parts(x: np.ndarray, mix: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """(lines, components): log of the share of a component times its probability of the line."""
    out = np.repeat(mix[None], len(x), 0)
    for f in range(x.shape[1]):
        out += emit[:, f].T[x[:, f]]
    return out


def _best_parts(x: np.ndarray, weight: np.ndarray, held: np.ndarray, parts: int, rounds: int, seed: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of several random starts, fitted without the lines in ``held``, the one likeliest there, then fitted on all."""
    if starts > 1 and held.any() and not held.all():

        def likelihood(start: int) -> float:
            lp = _log_parts(x[held], *_fit_parts(x[~held], weight[~held], parts, rounds, seed + 101 * start))
            top = lp.max(1)
            return float((weight[held] * (top + np.log(np.exp(lp - top[:, None]).sum(1)))).sum())

        seed += 101 * max(range(starts), key=likelihood)
    return _fit_parts(x, weight, parts, rounds, seed)


#: Folds in which labels are tried, and the share below which a label counts as contradicted.
FOLDS, DOUBT = 5, 0.1


def doubtful(x: np.ndarray, doc: np.ndarray, chars: np.ndarray, y: np.ndarray, seed: int = 7) -> np.ndarray:
    """(documents,): labels that the other documents of the sample contradict.

    ``y`` are the kinds of the documents. The ridge of the regression keeps a few wrong labels from outvoting
    the right ones of their kind. A second round leaves the contradicted labels of the first out of the fits.
    """
    size = len(y)
    share = _used(np.concatenate([*document_shares(x, doc, chars, size)]))[0]
    fold = np.random.default_rng(seed).permutation(size) % FOLDS
    bad = np.zeros(size, bool)
    for _ in range(2):
        p = np.zeros((size, len(KINDS)))
        for k in range(FOLDS):
            fit = (fold != k) & ~bad
            p[fold == k] = _softmax(share[fold == k] @ _regression(share[fit], y[fit]))
        own = p[np.arange(size), y]
        bad = (own < DOUBT) & (p.argmax(1) != y)
    return bad


def document_shares(x: np.ndarray, doc: np.ndarray, chars: np.ndarray, size: int, step: int = 1024):
    """Root of the share of a document's characters in each bin of each statistic, ``step`` documents at a time.

    ``doc`` numbers the documents of the lines in order.
    """
    feats = x.shape[1]
    for a in range(0, size, step):
        n = min(step, size - a)
        lo, hi = np.searchsorted(doc, (a, a + n))
        cell = ((doc[lo:hi, None] - a) * feats + np.arange(feats)) * BINS + x[lo:hi]
        share = np.bincount(cell.ravel(), np.repeat(chars[lo:hi], feats), n * feats * BINS).reshape(n, -1).astype(np.float32)
        yield np.sqrt(share / np.maximum(share.sum(1, keepdims=True) / feats, 1))


def _used(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns that are not all zero, and their numbers."""
    at = np.flatnonzero(share.any(0))
    return share[:, at], at


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 150) -> np.ndarray:
    """Weights (columns, kinds) of a softmax regression, by accelerated gradient steps."""
    w = np.zeros((x.shape[1], len(KINDS)), np.float32)
    if not len(x):
        return w
    goal = np.eye(len(KINDS), dtype=np.float32)[y]
    step = 1.0 / (0.5 * float((x**2).sum(1).max()) * len(x) + ridge)
    ahead, t = w, 1.0
    for _ in range(rounds):
        after = ahead - np.float32(step * 4) * (x.T @ (_softmax(x @ ahead) - goal) + np.float32(ridge) * ahead)
        further = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = after + np.float32((t - 1) / further) * (after - w), after, further
    return w


def train(texts: list[str], kinds: list[str], parts: int = 8, passes: int = 3, seed: int = 7, starts: int = 3) -> LineModel:
    """From texts labelled as a whole; see the module's description."""
    x, doc, chars = line_features(texts)
    label = np.array([KINDS.index(k) for k in kinds], np.int64)
    whole = np.zeros((FEATURES * BINS, len(KINDS)), np.float32)
    if len(doc):
        sure = ~doubtful(x, doc, chars, label, seed)
        share, at = _used(np.concatenate([*document_shares(x, doc, chars, len(label))]))
        whole[at] = _regression(share[sure], label[sure], rounds=300)
        keep = sure[doc]
        x, doc, chars = x[keep], doc[keep], chars[keep]
    y = label[doc] if len(doc) else np.zeros(0, np.int64)
    held = doc % 5 == 0
    weight = np.minimum(chars, 200) ** 0.5
    own = y.copy()
    for step in range(passes + 1):
        emit = []
        for k in range(len(KINDS)):
            mine = own == k
            emit.append(_best_parts(x[mine], weight[mine], held[mine], parts, 12, seed + k, starts if step == passes else 1))
        move = np.ones((4, 4))
        start = np.ones(4)
        if len(doc):
            follow = np.flatnonzero(doc[1:] == doc[:-1])
            np.add.at(move, (own[follow], own[follow + 1]), 1)
            np.add.at(start, own[np.concatenate(([True], doc[1:] != doc[:-1]))], 1)
        model = LineModel(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.stack([m for m, _ in emit]), np.stack([e for _, e in emit]), whole)
        if step < passes and len(doc):  # a label speaks for most of its document, not for each line
            prior = np.where(np.arange(4) == y[:, None], 0.0, -2.0)
            own = model.best_path(model.log_emission(x) + prior, doc)
            bad = _contrary(own, y, chars, doc)
            own[bad] = y[bad]
    return model


def _contrary(own: np.ndarray, y: np.ndarray, chars: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Lines of documents whose label would no longer hold half of the characters."""
    agree = np.bincount(doc, chars * (own == y)) / np.maximum(np.bincount(doc, chars), 1)
    return agree[doc] < 0.5


def shares(texts: list[str], model: LineModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters (docs, 4) by kind; lines (docs,); lines that end in a closing mark (docs,)."""
    x, doc, chars = line_features(texts)
    tags = model.tag(x, doc, chars)
    out = np.zeros((len(texts), len(KINDS)))
    np.add.at(out, (doc, tags), chars)
    return out, np.bincount(doc, minlength=len(texts)), np.bincount(doc, np.isin(x[:, 7], (5, 6)) if len(x) else None, minlength=len(texts))


def _labelled(documents: DataFrame, labels: DataFrame, fit_labels: int, fit_chars: int) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled documents, in hash order; documents with labels of several kinds are left out."""
    lab = labels.where(F.col("kind").isin(*KINDS) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("kind").alias("kind"), F.max("kind").alias("other"))
    lab = lab.where("kind = other").select("doc_id", "kind").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_labels)
    rows = cut(documents.select("doc_id", "text").join(F.broadcast(lab), "doc_id").where(F.length(F.trim("text")) > 0).dropDuplicates(["doc_id"]))
    picked, used = [], 0
    for doc_id, n in rows.select("doc_id", F.length("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if used + n <= fit_chars:
            picked.append(doc_id)
            used += n
    got = sorted((r[0], r[1], r[2]) for r in rows.where(F.col("doc_id").isin(picked)).collect())
    return [r[1] for r in got], [r[2] for r in got]


def fit(documents: DataFrame, labels: DataFrame, fit_labels: int = 6000, fit_chars: int = 50_000_000) -> LineModel:
    """From at most ``fit_labels`` labelled documents with at most ``fit_chars`` characters in all."""
    return train(*_labelled(documents, labels, fit_labels, fit_chars))


def common_words(documents: DataFrame, share: float = 0.05) -> np.ndarray:
    """Hashes of the words that stand in at least ``share`` of all non-blank texts.

    No more than (mean number of distinct words of a text) / ``share`` words can, so the result
    is small whatever the size of the collection. Each block of texts is counted before the shuffle.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for _, texts in cpk.blocks(cpk.values(b.column(0)), cpk.values(b.column(1))):
                doc, h = _words(texts)[:2]
                pair = np.unique(np.stack((doc.astype(np.uint64), h), 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                words, n = np.unique(pair[:, 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    texts = documents.select("doc_id", "text").where(F.length(F.trim("text")) > 0)
    total = texts.count()
    counted = map_arrow(spread(texts), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= max(1.0, share * total)).select("word").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and length of every word (a run of letters with their marks, lower-cased)."""
    cp, starts = cpk.joined([t.lower() for t in texts])
    s, e = cpk.runs((cpk.classes()[cp] & (cpk.LETTER | cpk.MARK)) > 0)
    return np.searchsorted(starts, s, side="right") - 1, cpk.span_hashes(cp, s, e), e - s


def verdicts(documents: DataFrame, model: LineModel) -> DataFrame:
    """(doc_id, kind, share of the characters of each kind) of every non-blank text.

    kind is the state that holds more than half of the characters, else prose. Null and blank
    texts give no row; repeated ids give a row each.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for ids, texts in cpk.blocks(cpk.values(b.column(0)), cpk.values(b.column(1))):
                by, lines, _ = shares(texts, model)
                keep = lines > 0
                part = by[keep] / by[keep].sum(1, keepdims=True)
                best = np.where(part.max(1) > 0.5, part.argmax(1), 0) if keep.any() else np.zeros(0, int)
                ids = [i for i, k in zip(ids, keep) if k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([KINDS[i] for i in best], pa.string()), *(pa.array(part[:, j], pa.float64()) for j in range(4))],
                    names=["doc_id", "kind", *(f"{k}_share" for k in KINDS)],
                )

    schema = "doc_id long, kind string, " + ", ".join(f"{k}_share double" for k in KINDS)
    return map_arrow(spread(documents.select("doc_id", "text")), run, schema)


def statistics(documents: DataFrame, model: LineModel, common: np.ndarray) -> DataFrame:
    """Word, symbol, line and common-word statistics and the verdict of every text.

    Null and blank texts have zero words and lines, null means and shares, and a null verdict.
    """
    import pyarrow as pa

    names = ["doc_id", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "closed_line_share", "common_word_share", "kind"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.string()]

    def run(batches):
        for b in batches:
            for ids, texts in cpk.blocks(cpk.values(b.column(0)), cpk.values(b.column(1))):
                by, lines, closed = shares(texts, model)
                size = len(texts)
                doc, h, width = _words(texts)
                n = np.bincount(doc, minlength=size)
                known = np.isin(h, common)
                cp, starts = cpk.joined(texts)
                cls = cpk.classes()[cp]
                owner = np.repeat(np.arange(size), np.diff(starts))
                black = np.bincount(owner, (cls & cpk.SPACE) == 0, size)
                symbols = np.bincount(owner, (cls & (cpk.PUNCT | cpk.SYMBOL)) > 0, size)
                with np.errstate(invalid="ignore", divide="ignore"):
                    part = by / by.sum(1, keepdims=True)
                    best = np.where(part.max(1) > 0.5, part.argmax(1), 0)
                    cols = [ids, n, lines, np.bincount(doc, width, size) / n, symbols / black, closed / lines, np.bincount(doc, known, size) / n]
                kind = [KINDS[i] if ok else None for i, ok in zip(best, lines > 0)]
                arrays = [pa.array(c, t, mask=np.isnan(c) if t == pa.float64() else None) for c, t in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(kind, pa.string())], names=names)

    schema = "doc_id long, n_words long, n_lines long, mean_word_length double, symbol_ratio double, closed_line_share double, common_word_share double, kind string"
    return map_arrow(spread(documents.select("doc_id", "text")), run, schema)
