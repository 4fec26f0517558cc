"""Sentence boundaries across languages and scripts.

Every character carries the tag *boundary* or *inside* in a linear-chain model decoded with
Viterbi. Characters that can never close a unit (a letter within a word, say) have the tag
*inside* with certainty, so the chain is decoded over the remaining positions only: runs of
closing marks with the quotation marks behind them and, in scripts written without closing
marks, blanks. This gives the same best path as tagging every character.

The model is trained without hand-made labels. Paragraph breaks are certain boundaries, so they
are hidden (the closing mark is followed by a plain blank, and the text of an unpunctuated script
is a bare string of words) and the model learns to tell them from the marks that are certainly
inside a sentence. How often a left context stands before a paragraph break, and how often a word
opens a paragraph, labels the marks in between; these figures are counted over all reports in one
pass. The weights of the chain alone are learned, with the averaged structured perceptron, on a bounded
sample (``fit_reports``). Contexts too rare there to have weights of their own share those of a class,
into which the counts of the whole collection put them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import codepoints as cpk
from gleaner.runtime import cut, map_arrow, spread
from gleaner.sources.tables import distinct_by

#: Closing marks: the characters with the Unicode property Sentence_Terminal, and the dots of omission.
TERMINATORS = frozenset(c for c in map(chr, range(0x20000)) if regex.match(r"\p{Sentence_Terminal}", c)) | {"…"}
#: Opening marks, and pairs of quotation marks.
OPENERS = "„«「『“‘¿¡([<（【-–—\"*•"
PAIRS = {"„": "“", "«": "»", "「": "」", "『": "』", "“": "”"}
#: Characters from which a context is kept as a digest, which tells it apart as well.
DIGEST = 40
#: One mark; those beyond the first plane stand apart, as a class that reaches there is slow to test.
_CLOSING = "(?:[" + re.escape("".join(sorted(c for c in TERMINATORS if c <= "\uffff"))) + "]|(?=[\U00010000-\U0010ffff])[" + "".join(sorted(c for c in TERMINATORS if c > "\uffff")) + "])"
#: Closing and quotation marks: of plain ASCII, of any script, and of Thai, where blanks count too.
_ASCII_MARK = re.compile(r"[.!?]+|''|\"")
_MARK = re.compile(_CLOSING + r"+|''|[\"“”„«»「」『』]")
_THAI_MARK = re.compile(_MARK.pattern + r"|(?<=[^\s\x00-\x7f])[ \t]*\n?[ \t]*(?<=[ \t\n])(?=[^\s])|(?<=\S)[ \t\n]+(?=[฀-๿])")
_PARAGRAPH = re.compile(r"\n[ \t\r　 ]*\n\s*")
_WORD = re.compile(r"\w+")
_FIGURE = re.compile(r"[\w%$)][ \t]{2,}\S|\t|\|")  # wide blanks, but not behind a closing mark
_RUN_ON = re.compile(r"(?<=\w\w)[.!?](?=\w\w)(?![a-z])|[!?]")
_STRIPPED = re.compile(_CLOSING + "+")
_THAI = re.compile(r"[฀-๿]")
#: Class of the contexts that are rare in the sample and, in the whole collection, never at a boundary.
NEVER = "never|"
_TOKEN_START = re.compile(r"[\s(\[“„«「『\"‘（]")
_BLANKS = re.compile(r"\s*")
_DIGIT = re.compile(r"[\d" + "".join(c for c in map(chr, range(0x20000)) if c.isdigit() and not c.isdecimal()) + "]")
_NO_FIGURE = re.compile(r"[^\d.,\-$%]")


@dataclass
class BoundaryModel:
    """Lexicons of frequent contexts and the weights of the chain."""

    left: set = field(default_factory=set)
    right: set = field(default_factory=set)
    weights: dict = field(default_factory=dict)
    near: dict = field(default_factory=dict)  # misspellings of long abbreviations that never end a unit
    longest: int = 0  # characters of the longest of them
    never_left: set = field(default_factory=set)  # rare in the sample, but never ends a unit in the collection
    never_right: set = field(default_factory=set)  # rare in the sample, but never opens a unit in the collection


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Offsets of the paragraphs (a blank line is always a boundary), white space left out."""
    out, at = [], 0
    for m in _PARAGRAPH.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(s, e) for s, e in (_trim(text, s, e) for s, e in out) if e > s]


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    piece = text[start:end]
    end = start + len(piece.rstrip())
    return end - len(text[start:end].lstrip()) if end > start else end, end


def figure_lines(text: str, start: int, end: int) -> list[tuple[int, int]] | None:
    """The lines of a block of figures, or None if the paragraph is running text.

    A block has at least two lines, most of them set in columns, and figures in most lines.
    """
    piece = text[start:end]
    if "\n" not in piece or not _DIGIT.search(piece):
        return None
    lines, at = [], start
    for line in piece.split("\n"):
        s, e = _trim(text, at, at + len(line))
        if e > s:
            lines.append((s, e))
        at += len(line) + 1
    columns = sum(1 for s, e in lines if _FIGURE.search(text, s, e) and text[e - 1] not in TERMINATORS)
    figures = sum(1 for s, e in lines if _DIGIT.search(text, s, e))
    return lines if len(lines) > 1 and min(columns, figures) * 5 >= len(lines) * 4 else None


def _next_class(par: str, at: int, end: int) -> str:
    c = par[at]
    if c.islower():
        return "camel" if at + 1 < len(par) and par[at + 1].isupper() else "low"
    if c.isupper():
        return "up"
    if c.isdigit():
        return "dig"
    if c in OPENERS or par.startswith("''", at):
        return "open"
    return "let" if c.isalpha() or "ऀ" <= c <= "๿" else "punct"


def _script(c: str) -> str:
    return "th" if "฀" <= c <= "๿" else "latin" if c.isascii() and c.isalnum() or c.isalpha() and c < "Ͱ" else "other"


@lru_cache(maxsize=4096)
def _kind(mark: str) -> str:
    """Dots of omission, dots, marks of East Asian width, questions and exclamations, or full stops of other scripts."""
    c = mark[0]
    if mark.startswith("..") or c == "…":
        return "ell"
    if c == ".":
        return "dot"
    if c in "!?":
        return "qe"
    if unicodedata.east_asian_width(c) in "WFH":
        return "cjk"
    name = unicodedata.name(c, "")
    return "qe" if "QUESTION" in name or "EXCLAMATION" in name or "INTERROBANG" in name else "dan"


def candidates(par: str, thai: bool) -> list[tuple[int, str, str, str, str, int, str]]:
    """(end, kind, left context, right word, class of what follows, open quotations, space) of a paragraph."""
    stack: list[tuple[str, str]] = []
    out: list[list] = []
    for m in (_ASCII_MARK if par.isascii() else _THAI_MARK if thai else _MARK).finditer(par):
        s = m.group()
        if not s:
            continue
        c = s[0]
        if c in TERMINATORS:
            out.append([m.start(), m.end(), s, len(stack), "", ""])
        elif c.isspace():
            if thai:
                out.append([m.start(), m.start(), " ", len(stack), "", ""])
        else:
            closing = stack and (stack[-1][0] == s or PAIRS.get(stack[-1][0]) == s)
            if not closing and s in "”»」』":
                continue
            if closing:
                _, lead = stack.pop()
                last = out[-1] if out else None
                if last and last[2] != " " and last[3] > len(stack) and _BLANKS.match(par, last[1]).end() >= m.start():
                    last[1], last[3], last[4], last[5] = m.end(), len(stack), "q", lead
            else:
                k = m.start()
                while k and par[k - 1].isspace():
                    k -= 1
                before = par[k - 1 : k]
                lead = "start" if not before or before in TERMINATORS or before in "”»」』\"“" else "colon" if before in ":：" else "comma" if before in ",，、" else "other"
                stack.append((s, lead))
    found = []
    lefts = _Lefts(par)
    for start, end, mark, depth, closed, lead in out:
        while end < len(par) and par[end] in ")]）" and mark != " ":
            end += 1
        at = end
        while at < len(par) and par[at].isspace():
            at += 1
        if at >= len(par):
            continue
        nxt = _next_class(par, at, len(par))
        if mark == "." and nxt == "dig" and at == end and start and par[start - 1].isdigit():
            continue  # a decimal point is inside with certainty
        if mark == " ":
            a, b = par[start - 1], par[at]
            found.append((end, "blank", "blank|" + _script(a), "blank|" + _script(b), "let", depth, "s"))
            continue
        kind = _kind(mark)
        if kind == "dot":
            left = lefts.of(start)
        else:
            left = kind
        found.append((end, kind, f"{left}{closed}{lead}", _word(par, at, nxt), nxt, depth, "n" if at == end else "s"))
    return found


class _Lefts:
    """What stands to the left of the dots of a paragraph, asked for from left to right; each character is looked at once."""

    def __init__(self, par: str):
        self.par, self.at, self.token, self.seen, self.odd = par, 0, 0, 0, -1
        self.breaks: list[int] | None = None
        self.passed, self.sums, self.before = 0, None, (-1, "")

    def of(self, start: int) -> str:
        """The token that ends at ``start``: INIT for an initial, NUM and the word before for a number, else the token."""
        par = self.par
        for m in _TOKEN_START.finditer(par, self.at, start):
            self.token = m.end()
        if self.breaks is None:
            self.breaks = [m.end() for m in _RUN_ON.finditer(par)]
        self.at = max(self.at, start)
        while self.passed < len(self.breaks) and self.breaks[self.passed] <= start:
            self.passed += 1
        k = max(self.token, self.breaks[self.passed - 1] if self.passed else 0)  # a missing blank makes no difference
        if k < start and par[start - 1].isupper() and not (start - 1 > k and par[start - 2].isalnum()):
            return "INIT"
        if k < start and par[start - 1].isdigit():
            for m in _NO_FIGURE.finditer(par, max(self.seen, k), start):
                self.odd = m.start()
            self.seen = start
            if self.odd < k:
                return "NUM|" + self._word_before(k)
        return self._digest(k, start)

    def _word_before(self, k: int) -> str:
        if self.before[0] != k:
            end = k
            while end and self.par[end - 1].isspace():
                end -= 1
            begin = end
            while begin and not self.par[begin - 1].isspace():
                begin -= 1
            self.before = k, self._digest(begin, end)
        return self.before[1]

    def _digest(self, a: int, b: int) -> str:
        """The text, or a hash of a long one (from running sums, so that its length does not matter)."""
        if b - a <= DIGEST:
            return self.par[a:b]
        if self.sums is None:
            self.sums = cpk.SpanHashes(cpk.codes(self.par))
        return f"{self.par[a : a + 8]}#{self.sums.of(a, b):016x}"


def _word(par: str, at: int, nxt: str) -> str:
    """What stands at a place: a word, a single character of a script without blanks, a mark, or any number."""
    if nxt == "dig":
        return "<dig"
    w = _WORD.match(par, at)
    if not w or (nxt == "let" and par[at] > "⹿"):
        return par[at]
    word = w.group()
    return word if len(word) <= DIGEST else f"{word[:8]}#{xxhash.xxh3_64_hexdigest(word)}"


def _left_key(left: str, model: BoundaryModel) -> str:
    if left in model.left:
        return left
    if left in model.never_left:
        return NEVER
    if model.near and 4 <= len(left) <= model.longest and left.isalpha():
        meant = model.near.get(left) or model.near.get("~" + "".join(sorted(left)))
        if meant:
            return meant if meant in model.left else NEVER
    if left.startswith("NUM|"):
        return "NUM|Cap" if left[4:5].isupper() else "NUM|low"
    return "word" + ("q" if left.endswith(("qstart", "qcolon", "qcomma", "qother")) else "")


def _features(c: tuple, model: BoundaryModel) -> tuple[str, ...]:
    _, kind, left, word, nxt, depth, ws = c
    lk = _left_key(left, model)
    rk = _right_key(word, nxt, model)
    return _named(lk, rk, kind, nxt, depth, ws)


def _right_key(word: str, nxt: str, model: BoundaryModel) -> str:
    return word if word in model.right else ("<" + NEVER if word in model.never_right else "<") + nxt


def _named(lk: str, rk: str, kind: str, nxt: str, depth: int, ws: str) -> tuple[str, ...]:
    return ("L" + lk, "R" + rk, f"N{kind}|{nxt}|{ws}", f"M{lk}|{nxt}", f"P{lk}|{rk}", f"D{depth > 0}|{kind}")


def _gap(a: int, b: int) -> str:
    return "near" if b - a < 12 else "far"


def decode(cands: list[tuple], model: BoundaryModel, gold: list[bool] | None = None, named: list[tuple] | None = None) -> list[bool]:
    """Viterbi over the tags of a paragraph's candidate positions; the paragraph starts after a boundary.

    With ``gold`` (in training) every wrong tag is worth one more, which teaches a margin; ``named`` are
    the features of the candidates where they are known.
    """
    w = model.weights
    get = w.get
    score = {False: -1e18, True: 0.0}
    back: list[tuple[bool, bool]] = []
    last = 0
    for i, c in enumerate(cands):
        e = sum(get(f, 0.0) for f in (named[i] if named else _features(c, model)))
        if gold is not None:
            e += -1.0 if gold[i] else 1.0
        g = _gap(last, c[0])
        inside = (score[False] + get("T00" + g, 0.0), score[True] + get("T10" + g, 0.0))
        bound = (score[False] + get("T01" + g, 0.0) + e, score[True] + get("T11" + g, 0.0) + e)
        back.append((inside[1] > inside[0], bound[1] > bound[0]))
        score = {False: max(inside), True: max(bound)}
        last = c[0]
    tags: list[bool] = []
    tag = score[True] > score[False]
    for from_inside, from_bound in reversed(back):
        tags.append(tag)
        tag = from_bound if tag else from_inside
    return tags[::-1]


def split_text(text: str | None, model: BoundaryModel) -> list[tuple[int, int]]:
    """(start, end) of the units of one text, in code points."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    for s, e in paragraphs(text):
        lines = figure_lines(text, s, e)
        if lines:
            out.extend(lines)
            continue
        par = text[s:e]
        cands = candidates(par, bool(_THAI.search(par)))
        at = 0
        for c, tag in zip(cands, decode(cands, model) if cands else ()):
            if tag:
                u = _trim(text, s + at, s + c[0])
                if u[1] > u[0]:
                    out.append(u)
                at = c[0]
        u = _trim(text, s + at, e)
        if u[1] > u[0]:
            out.append(u)
    return out


def _opening(text: str, start: int, end: int) -> str:
    """The first word of a paragraph and the character behind it, or its first two characters."""
    w = _WORD.match(text, start)
    return text[start : min(end, w.end() + 1 if w else start + 2)]


def _marks(text: str | None) -> tuple[list[list[tuple[tuple, bool | None]]], list[str], list[tuple[str, str]]]:
    """Candidates by paragraph (True: a hidden paragraph break), what stands before the end of the text, its first word."""
    chains: list[list[tuple[tuple, bool | None]]] = []
    ends: list[str] = []
    starts: list[tuple[str, str]] = []
    pars = [(s, e) for s, e in paragraphs(text or "") if figure_lines(text, s, e) is None]
    for (s, e), following in zip(pars, [*pars[1:], None]):
        par = text[s:e]
        thai = bool(_THAI.search(par))
        if thai:  # a script without closing marks is learned from text that has none
            par = _STRIPPED.sub(" ", par).strip() or par
        found = candidates(par + " " + (_opening(text, *following) if following else "Z"), thai)
        cands = [(c, None) for c in found if c[0] < len(par)]  # the next paragraph changes nothing before the end
        if following:  # the paragraph break, hidden
            hidden = [c for c in found if c[0] >= len(par) - (0 if thai else 2) and c[0] <= len(par)]
            cands.extend((c, True) for c in hidden[-1:])
        else:
            last = [c for c in found if c[1] != "blank" and len(par) - 2 <= c[0] <= len(par)]
            ends.extend(c[2] for c in last[-1:])
        if s == pars[0][0]:
            nxt = _next_class(par, 0, len(par))
            starts.append((_word(par, 0, nxt), nxt))
        chains.append(cands)
    return chains, ends, starts


def _tally(marks: tuple, into: dict) -> None:
    """Add the marks of a text to (side, context, class) -> [uses, uses at a certain boundary, uses that speak against one].

    Those are, of a left context, its uses within a paragraph; of an opening word, its uses behind a
    dot that stands outside quotations (other marks close a sentence whatever word follows).
    """

    def add(side, key, fold, end, mid):
        at = into.setdefault((side, key, fold), [0, 0, 0])
        at[0] += 1
        at[1] += end
        at[2] += mid

    chains, ends, starts = marks
    plain = BoundaryModel()
    for chain in chains:
        for c, label in chain:
            fold = _left_key(c[2], plain)
            add("L", c[2], fold, bool(label), not label and c[4] not in ("low", "punct"))
            add("R", c[3], "<" + c[4], bool(label), not label and c[1] == "dot" and c[5] == 0 and fold != "wordq")
    for left in ends:
        add("L", left, _left_key(left, plain), 1, 0)
    for word, nxt in starts:
        add("R", word, "<" + nxt, 1, 0)


def _folded(tally: dict, frequent: int) -> list[tuple]:
    """(side, key, kept, uses, at a boundary, against one) where contexts used less than ``frequent`` times count as their class."""
    uses: Counter = Counter()
    for (side, key, _), at in tally.items():
        uses[side, key] += at[0]
    out: dict[tuple, list] = {}
    for (side, key, fold), at in tally.items():
        kept = uses[side, key] >= frequent
        row = out.setdefault((side, key if kept else fold), [False, 0, 0, 0])
        row[0] = row[0] or kept
        for i in range(3):
            row[1 + i] += at[i]
    return [(*k, *v) for k, v in out.items()]


def train(texts: list[str], frequent: int = 20, epochs: int = 4, counted: list[tuple] | None = None) -> BoundaryModel:
    """Learn lexicons, labels and weights from texts alone (see the module's description).

    ``counted`` are the figures of the whole collection (``count_marks``), of which ``texts`` are a
    sample; without them the texts are the collection.
    """
    marks = [_marks(t) for t in texts]
    tally: dict = {}
    for m in marks:
        _tally(m, tally)
    own = _folded(tally, frequent)
    figures = own if counted is None else counted
    kept = {side: {r[1] for r in figures if r[0] == side and r[2]} for side in "LR"}
    model = BoundaryModel(*({r[1] for r in own if r[0] == side and r[2]} & kept[side] for side in "LR"))
    lefts = {r[1]: r[4:] for r in figures if r[0] == "L"}  # at a boundary, within
    rights = {r[1]: r[3:] for r in figures if r[0] == "R"}  # all, at a boundary, behind a dot
    final = {k: end >= 0.03 * (end + mid) for k, (end, mid) in lefts.items()}
    # a word that the sample hardly holds needs more uses, and behind dots, before it counts as one that opens nothing
    opens = {k: start + 1 >= 0.02 * (start + dots) if k in kept["R"] and k not in model.right else start >= 0.02 * n for k, (n, start, dots) in rights.items()}
    model.never_left = {k for k in kept["L"] - model.left if not final[k]}
    model.never_right = {k for k in kept["R"] - model.right if not opens[k]}
    for word in sorted(model.left | model.never_left):
        if word.isalpha() and len(word) >= 5 and lefts[word][0] * 1000 <= sum(lefts[word]) and word not in ("INIT",):
            model.near["~" + "".join(sorted(word))] = word  # letters swapped
            model.near.update((word[:i] + word[i + 1 :], word) for i in range(len(word)))  # a letter lost
    model.longest = max((len(w) - w.startswith("~") for w in model.near), default=0)
    data = []
    turn: Counter = Counter()
    for chains, _, _ in marks:
        for chain in chains:
            rows = []
            for c, label in chain:
                lk, rk = _left_key(c[2], model), _right_key(c[3], c[4], model)
                ends_here = lk != NEVER and final.get(lk, True)
                starts_here = not rk.startswith("<" + NEVER) and opens.get(rk, True)
                if not label:
                    label = c[4] not in ("low", "punct") and c[5] == 0 and ends_here and starts_here and not (c[6] == "n" and c[4] == "dig" and c[1] == "dot")
                # one use in four of the frequent ones teaches the class of the rare ones, if there are any
                if model.never_left and lk in model.left and not ends_here:
                    turn[lk] += 1
                    lk = lk if turn[lk] % 4 else NEVER
                if model.never_right and rk in model.right and not starts_here:
                    turn["<", rk] += 1
                    rk = rk if turn["<", rk] % 4 else "<" + NEVER + c[4]
                rows.append((c, bool(label), _named(lk, rk, c[1], c[4], c[5], c[6])))
            if rows:
                data.append(rows)
    model.weights = _perceptron(data, model, epochs)
    return model


def _perceptron(data: list, model: BoundaryModel, epochs: int) -> dict:
    """Averaged structured perceptron over the chains."""
    w: dict[str, float] = {}
    total: dict[str, float] = {}
    step = 1
    scorer = BoundaryModel(weights=w)
    for _ in range(epochs):
        for rows in data:
            gold = [y for _, y, _ in rows]
            tags = decode([c for c, _, _ in rows], scorer, gold, [f for _, _, f in rows])
            if tags != gold:
                for path, sign in ((gold, 1.0), (tags, -1.0)):
                    prev, last = True, 0
                    for (c, _, feats), y in zip(rows, path):
                        keys = (*(feats if y else ()), f"T{int(prev)}{int(y)}{_gap(last, c[0])}")
                        for f in keys:
                            w[f] = w.get(f, 0.0) + sign
                            total[f] = total.get(f, 0.0) + sign * step
                        prev, last = y, c[0]
            step += 1
    return {f: v - total.get(f, 0.0) / step for f, v in w.items() if v or total.get(f)}


def lowest(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows of the ``rows`` distinct keys that come first in the order of a hash: a bounded sample, wherever they are stored."""
    h = F.xxhash64(key)
    last = df.where(F.col(key).isNotNull()).select(h.alias("h")).distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(last)) if last is not None else df.limit(0)


def sample_texts(df: DataFrame, key: str, text: str, rows: int, chars: int = 50_000_000) -> list[str]:
    """At most ``rows`` texts of distinct keys with at most ``chars`` characters in all, the first by a hash of the key: a bounded sample for fitting."""
    picked = lowest(df.select(key, text).where(F.length(text) > 0), key, rows).dropDuplicates([key])
    keys, used = [], 0
    for k, n in picked.select(key, F.length(text)).orderBy(F.xxhash64(key), key).collect():
        if used + n <= chars:
            keys.append(k)
            used += n
    return sorted(r[0] for r in picked.where(F.col(key).isin(keys)).select(text).collect())


#: Contexts that a task holds before it sends their counts.
HELD_CONTEXTS = 200_000


def count_marks(reports: DataFrame, frequent: int = 20, least_share: float = 2e-6, text: str = "body") -> list[tuple]:
    """The figures of ``_folded`` over all rows of ``reports`` (pass distinct ones), counted in one pass.

    A context is kept from ``frequent`` uses and ``least_share`` of all uses, which bounds the
    lexicons that come to the driver whatever the collection; all others are added up by class.
    """
    import pyarrow as pa

    names = ["side", "key", "fold", "n", "n_end", "n_mid"]

    def batch(tally):
        cols = [*zip(*tally)] or [(), (), ()]
        sums = [*zip(*tally.values())] or [(), (), ()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), *(pa.array(c, pa.int64()) for c in sums)], names=names)

    def run(batches):
        tally: dict = {}
        for b in batches:
            for t in cpk.values(b.column(0)):
                _tally(_marks(t), tally)
                if len(tally) >= HELD_CONTEXTS:
                    yield batch(tally)
                    tally = {}
        yield batch(tally)

    seen = map_arrow(spread(reports.select(text).where(F.length(text) > 0)), run, "side string, key string, fold string, n long, n_end long, n_mid long")
    sums = [F.sum(c).alias(c) for c in names[3:]]
    counts = cut(seen.groupBy("side", "key", "fold").agg(*sums))
    total = counts.where("side = 'L'").agg(F.sum("n")).first()[0] or 0
    whole = counts.groupBy("side", "key").agg(F.sum("n").alias("uses"), F.collect_list(F.struct("fold", *names[3:])).alias("by"))
    kept = F.col("uses") >= max(frequent, least_share * total)
    rows = whole.select("side", "key", kept.alias("kept"), F.explode("by").alias("x")).select("side", F.when(F.col("kept"), F.col("key")).otherwise(F.col("x.fold")).alias("key"), "kept", "x.n", "x.n_end", "x.n_mid")
    return sorted(tuple(r) for r in rows.groupBy("side", "key").agg(F.max("kept").alias("kept"), *sums).collect())


def fit(reports: DataFrame, fit_reports: int = 4000, written: bool = False) -> BoundaryModel:
    """Count contexts over all distinct ``reports(newid, body)``; fit weights on at most ``fit_reports`` of them.

    ``written`` says that the reports are a written table of distinct ones, which need not be made here.
    """
    texts = reports.select("newid", "body") if written else cut(distinct_by(reports.where(F.length("body") > 0), "newid", "body"))
    return train(sample_texts(texts, "newid", "body", fit_reports), counted=count_marks(texts))


def sentences(reports: DataFrame, model: BoundaryModel, key: str = "newid", text: str = "body", with_text: bool = False) -> DataFrame:
    """One row per unit: (key, unit_no, start_pos, end_pos[, unit]).

    Null, empty and blank texts give no rows. Repeated keys give repeated rows, so pass distinct
    reports. Whole texts are read, whatever their length; other columns are not read at all.
    """
    import pyarrow as pa

    schema = f"{key} long, unit_no int, start_pos long, end_pos long" + (", unit string" if with_text else "")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.string()] * with_text
    names = [key, "unit_no", "start_pos", "end_pos"] + ["unit"] * with_text

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for k, t in zip(cpk.values(b.column(0)), cpk.values(b.column(1))):
                for i, (s, e) in enumerate(split_text(t, model)):
                    for col, v in zip(cols, (k, i, s, e, t[s:e])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return map_arrow(spread(reports.select(key, text).where(F.length(text) > 0)), run, schema)
