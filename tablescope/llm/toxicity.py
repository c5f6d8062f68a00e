"""Toxicity: noisy-channel deobfuscation by Viterbi over character lattices, then scoring."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import materialize

# Letters that digits and marks may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}

#: Log probability of one disguised character, of a dropped repeat and of a dropped separator.
DISGUISED, REPEATED, SEPARATED = math.log(0.05), math.log(0.1), math.log(0.3)
#: Log probabilities of a separator that stands for nothing and of one that ends a word, in runs
#: of single letters and between pieces of several letters.
SPACED, PIECES = (SEPARATED, math.log(0.1)), (math.log(0.1), math.log(0.9))
#: States kept per step of the decoder.
BEAM = 64
#: Parts of the sample; each is calibrated with weights from the others.
FOLDS = 4
#: Prefix lengths of the features besides whole words.
PREFIXES = (4, 5, 6, 7, 8)
#: Restored tokens and joined runs remembered in a task; tokens known to be looked at.
REMEMBERED, SEEN = 200_000, 500_000
#: Cells of a dense count of trigrams; characters after which the texts held are counted.
DENSE, CHUNK = 1 << 22, 1 << 19
#: The strongest word of a text counts fully, the next ones count this share each.
NEXT, NEXT_SHARE = 4, 0.3

_TOKEN = re.compile(r"\S+")
_PLAIN = re.compile(r"[^\W\d_]+")
#: Letters or their disguises one by one, with single separators between.
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+(€£¡*])(?:[ ._\-*]{1,2}(?:[^\W_]|[@$!|+(€£¡*])){2,}(?!\S)")
#: What every such run begins with; quicker to look for.
_MAYBE_SPACED = re.compile(r"\s\S[ ._\-*]{1,2}\S[ ._\-*]{1,2}\S(?:[ ._\-*]|(?!\S))")
_THRICE = re.compile(r"(.)\1\1", re.DOTALL)
_EDGES = ".,;:?\"'()[]{}<>«»„“”…"


def trigrams(words: dict[str, int]) -> Counter:
    """Counts of letter trigrams of counted words, two marks before and one after."""
    out: Counter = Counter()
    for w, c in words.items():
        s = f"^^{w}$"
        for i in range(2, len(s)):
            out[s[i - 2:i + 1]] += c
    return out


@dataclass
class CharModel:
    """Trigram model of letters within a word, interpolated with bigrams and unigrams."""

    tri: dict[str, float]
    bi: dict[str, float]
    uni: dict[str, float]
    logs: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def build(cls, words: dict[str, int]) -> CharModel:
        return cls.from_counts(trigrams(words))

    @classmethod
    def from_counts(cls, tri: dict[str, int]) -> CharModel:
        """From counts of trigrams; each names its bigram and letter by its end."""
        bi, uni, ctx2, ctx1 = Counter(), Counter(), Counter(), Counter()
        for g, c in tri.items():
            bi[g[1:]] += c
            uni[g[2]] += c
            ctx2[g[:2]] += c
            ctx1[g[1]] += c
        total = sum(uni.values()) or 1
        return cls({g: c / ctx2[g[:2]] for g, c in tri.items()}, {g: c / ctx1[g[0]] for g, c in bi.items()},
                   {g: c / total for g, c in uni.items()})

    def log(self, two: str, nxt: str) -> float:
        gram = two + nxt
        got = self.logs.get(gram)
        if got is None:
            got = math.log(0.7 * self.tri.get(gram, 0.0) + 0.2 * self.bi.get(gram[1:], 0.0) + 0.0999 * self.uni.get(nxt, 0.0) + 1e-6)
            if len(self.logs) >= REMEMBERED:
                self.logs.clear()
            self.logs[gram] = got
        return got


def lattice(token: str, gaps: tuple[float, float] | None = None) -> list[list[tuple[str, float]]]:
    """Per character of ``token``: what it may stand for (a letter, or nothing) and the cost.

    A letter stands for itself; a third or later repeat may also be dropped, a second one
    at a cost too; a digit or mark stands for its letters; separators stand for nothing, or
    with ``gaps`` (costs of nothing and of a word's end) also for a space.
    Characters without any reading keep themselves.
    """
    out = []
    before = ""
    for c in token:
        if c.isalpha():
            ways = [(c, 0.0)]
            if c == before:
                ways.append(("", REPEATED))
        elif c in LEET:
            ways = [(x, DISGUISED) for x in LEET[c]]
            if c == before:
                ways.append(("", REPEATED))
            if c in "*!|+(":
                ways.append(("", SEPARATED))
            if c == "*" and gaps:
                ways.append((" ", gaps[1]))
        elif c in " ._-":
            ways = [("", gaps[0]), (" ", gaps[1])] if gaps else [("", SEPARATED)]
        else:
            ways = [(c, 0.0)]
        out.append(ways)
        before = c
    return out


def decode(model: CharModel, token: str, gaps: tuple[float, float] | None = None) -> str:
    """The likeliest letters behind ``token``: Viterbi with the last two letters as state.

    With ``gaps`` the letters come in words: a space ends one (``$``) and the next begins
    anew (``^``), so the model decides where words end.
    """
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for ways in lattice(token, gaps):
        step: dict[str, tuple[float, tuple | None]] = {}
        for two, (cost, text) in states.items():
            for letter, noise in ways:
                if letter == " ":
                    key, value = "^^", cost + noise + (0.0 if two == "^^" else model.log(two, "$"))
                elif letter:
                    key, value = two[1] + letter, cost + noise + model.log(two, letter)
                else:
                    key, value = two, cost + noise
                if key not in step or value > step[key][0]:
                    step[key] = (value, (text, letter) if letter else text)
        if len(step) > BEAM:
            step = dict(sorted(step.items(), key=lambda x: -x[1][0])[:BEAM])
        states = step
    text = max(states.items(), key=lambda x: x[1][0] + (0.0 if gaps and x[0] == "^^" else model.log(x[0], "$")))[1][1]
    out = []
    while text:
        text, letter = text
        out.append(letter)
    return "".join(reversed(out))


def comes_out_whole(model: CharModel, run: str, word: str) -> bool:
    """Whether ``word`` is among the words decoded from pieces with gaps.

    Two pieces of letters that never repeat have two readings, one word or two: their costs
    are added up in the order of the decoder.
    """
    pieces = run.split(" ")
    if len(pieces) != 2 or not (pieces[0].isalpha() and pieces[1].isalpha()) or any(a == b for p in pieces for a, b in zip(p, p[1:])):
        return word in decode(model, run, PIECES).split()
    log = model.log
    two, one = "^^", 0.0
    for c in pieces[0]:
        one += log(two, c)
        two = two[1] + c
    parted, at = one + PIECES[1] + log(two, "$"), "^^"
    one += PIECES[0]
    for c in pieces[1]:
        one, parted = one + log(two, c), parted + log(at, c)
        two, at = two[1] + c, at[1] + c
    whole = one + log(two, "$") >= parted + log(at, "$")
    return word == "".join(pieces) if whole else word in pieces


def disguised(token: str) -> bool:
    """Whether a lower-case token has letters and something to decode."""
    inner = token.strip(_EDGES)
    if inner.isalpha():
        return _THRICE.search(inner) is not None
    letters = sum(c.isalpha() for c in inner)
    return letters >= 1 and all(c.isalpha() or c in LEET or c in "._-" for c in inner) and (
        letters + sum(c in LEET for c in inner) >= 3)


def restored(model: CharModel, text: str | None, memory: dict[str, tuple[str, ...]]) -> Counter:
    """Words of the text after decoding, with counts. The words as written are kept besides.

    Runs of single letters are decoded as a whole into words, and besides as one word, so
    each word of a whole text is looked at.
    """
    if not text:
        return Counter()
    low = text.lower()
    out: Counter = Counter()
    for word in spaced_words(model, low):
        out[word] += 1
    for token, n in Counter(low.split()).items():
        got = memory.get(token)
        if got is None:
            got = token_words(model, token)
            if len(memory) >= REMEMBERED:
                memory.clear()
            memory[token] = got
        for w in got:
            out[w] += n
    return out


def token_words(model: CharModel, token: str) -> tuple[str, ...]:
    """Words of a lower-case token as written, and after decoding if it is disguised."""
    plain = tuple(_PLAIN.findall(token))
    if not disguised(token):
        return plain
    word = decode(model, token.strip(_EDGES))
    return (*plain, *(w for w in _PLAIN.findall(word) if w not in plain))


def spaced_words(model: CharModel, low: str, tried: Callable[[str], bool] | None = None) -> Iterator[str]:
    """Words written letter by letter in a lower-case text: each run as words, and besides as one word.

    ``tried`` says which runs are worth decoding."""
    if not _MAYBE_SPACED.search(" " + low):
        return
    for m in _SPACED.finditer(low):
        if tried and not tried(m.group()):
            continue
        words = decode(model, m.group(), SPACED).split()
        for word in {*words, *([decode(model, m.group())] if len(words) > 1 else [])}:
            if len(word) >= 3:
                yield word


def features(word: str) -> list[str]:
    """The word, and its beginnings (marked) where it is longer."""
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) >= n)]


class _Any:
    """Holds every character."""

    def __contains__(self, character: str) -> bool:
        return True


_ANY = _Any()


@dataclass
class Model:
    """Character model, feature weights (log odds) and the calibration of the text score."""

    chars: CharModel
    weights: dict[str, float]
    slope: float
    offset: float
    base: float
    memory: dict = field(default_factory=dict)
    known: dict = field(default_factory=dict)
    joins: dict = field(default_factory=dict)
    starts: dict = field(default_factory=dict)
    seen: set = field(default_factory=set)

    def __post_init__(self) -> None:
        whole = {f.rstrip("~") for f in self.weights}
        #: Beginnings of what has a weight: where a word in pieces may go on.
        self.begins = {w[:n] for w in whole for n in range(1, len(w) + 1)}
        #: What each beginning may grow to by one letter.
        self.grown: dict[str, list[str]] = {}
        for b in self.begins:
            self.grown.setdefault(b[:-1], []).append(b)
        #: Beginnings that have a weight themselves.
        self.marks = {f[:-1] for f in self.weights if f.endswith("~")}

    def weight(self, word: str) -> float:
        """Of the strongest feature; no longer beginning is looked at once nothing with a weight begins like it."""
        begins, weights = self.begins, self.weights
        if word[:PREFIXES[0]] not in begins:
            return 0.0
        best = weights.get(word, 0.0)
        for n in PREFIXES:
            start = word[:n]
            if len(start) < n or start not in begins:
                break
            best = max(best, weights.get(start + "~", 0.0))
        return best

    def spells(self, raw: str, gaps: tuple[float, float] | None = None) -> tuple[bool, bool]:
        """Whether some reading of ``raw`` has a weight, and whether some reading begins what has one.

        Walks the readings of its lattice that begin something with a weight, and no others (with
        ``gaps`` a word may begin after each); what decoding gives is one of all readings, so
        without either it need not be tried.
        """
        open_, sure = {""}, False
        for ways in lattice(raw, gaps):
            step = {s + letter for s in open_ for letter, _ in ways if letter != " " and (not letter or s + letter in self.begins)}
            sure = sure or any(s in self.marks or gaps and s in self.weights for s in step)
            if gaps and any(letter == " " for letter, _ in ways):
                step.add("")
            open_ = step
            if not open_ and not gaps:
                break
        return sure or any(s in self.weights for s in open_), bool(open_)

    def _start(self, token: str) -> str:
        """``token`` without marks around it if a word in pieces may begin with it, else nothing.

        A mark after it, as at the end of a sentence, ends the word.
        """
        first = token.lstrip(_EDGES)
        if first != first.rstrip(_EDGES):
            return ""
        if first in self.begins:
            return first
        if first.isalpha() or not any(c.isalpha() for c in first):
            return ""
        return first if any(self.spells(first)) else ""

    def _opening(self, token: str) -> tuple[str, frozenset[str] | _Any]:
        """What ``_start`` says, and the characters with which the next token may go on."""
        first = self._start(token)
        if not first:
            return "", frozenset()
        if not first.isalpha():
            return first, _ANY
        letters = {b[len(first)] for b in self.grown.get(first, ())}
        return first, frozenset(letters | {c for c, ways in LEET.items() if letters & set(ways)} | set(_EDGES))

    def joined(self, text: str | None) -> Counter:
        """Words with a weight that were written in pieces ('stu pid', 'id i0t').

        Neighbouring tokens are put together for as long as they begin something with a
        weight; a mark such as a comma after a piece ends the word. What then weighs more than any
        of its pieces is decoded as one lattice in which each gap is nothing or the end of a
        word; it counts if the word comes out whole.
        """
        tokens = text.lower().split() if text else []
        self._look(set(tokens))
        return self._pieces(tokens)

    def _pieces(self, tokens: list[str]) -> Counter:
        """``joined`` for tokens that have been looked at."""
        out: Counter = Counter()
        starts, begins, marks, least = self.starts, self.begins, self.marks, PREFIXES[0]
        near = [(i, start[0]) for i, (t, after) in enumerate(zip(tokens, tokens[1:])) if (start := starts.get(t)) and after[0] in start[1]]
        for i, first in near:
            piece = tokens[i + 1]
            if not piece.isalpha():
                piece = piece.strip(_EDGES)
            if (first + piece)[:least] not in begins and piece.isalpha() and first.isalpha():
                continue
            run, raw, j, found = first, first, i + 1, ""
            while j < len(tokens):
                piece = tokens[j].strip(_EDGES)
                if not piece:
                    break
                if raw.isalpha():
                    if piece.isalpha():
                        whole = raw + piece
                        if whole[:least] not in begins or raw + piece[0] not in begins or not (whole in begins or any(whole[:n] in marks for n in PREFIXES)):
                            break
                    elif not any(raw + x in begins for x in LEET.get(piece[0], piece[0])):
                        break
                run, raw = run + " " + piece, raw + piece
                word, more = self._join(run, raw)
                found = word or found
                if not more or tokens[j][-1] in _EDGES:
                    break
                j += 1
            if found:
                out[found] += 1
        return out

    def _join(self, run: str, raw: str) -> tuple[str, bool]:
        """The word of a weight that the pieces of ``run`` are, or nothing; and whether it may go on."""
        got = self.joins.get(run)
        if got is None:
            if raw.isalpha():
                word = raw
            else:
                word = decode(self.chars, raw) if any(self.spells(raw)) and disguised(raw) else ""
            weight = self.weight(word) if word else 0.0
            whole = weight > 0.0 and weight > max(
                self.weight(p if p.isalpha() else decode(self.chars, p)) for p in run.split(" ")) and comes_out_whole(self.chars, run, word)
            got = (word if whole else "", word in self.begins)
            if len(self.joins) >= REMEMBERED:
                self.joins.clear()
            self.joins[run] = got
        return got

    def _words(self, token: str) -> tuple[str, ...]:
        """Words of a token that may have a weight: decoding is tried only where some reading has one."""
        if disguised(token) and self.spells(token.strip(_EDGES))[0]:
            return token_words(self.chars, token)
        return (token,) if token.isalpha() else tuple(_PLAIN.findall(token))

    def _look(self, tokens: set[str]) -> None:
        """Enters new tokens: in ``known`` those whose words have a weight, in ``starts`` those a word may begin with."""
        if len(self.seen) >= SEEN:
            self.seen, self.known, self.starts = set(), {}, {}
        for token in tokens - self.seen:
            inner = token.strip(_EDGES)
            if inner.isalpha() and not _THRICE.search(inner):
                if inner[:PREFIXES[0]] in self.begins:
                    if x := self.weight(inner):
                        self.known[token] = {inner: x}
                    if inner in self.begins and token.endswith(inner):
                        self.starts[token] = self._opening(token)
                continue
            got = {w: x for w in self._words(token) if (x := self.weight(w)) > 0}
            if got:
                self.known[token] = got
            first, following = self._opening(token)
            if first and following:
                self.starts[token] = (first, following)
        self.seen |= tokens

    def weighted(self, text: str | None) -> dict[str, float]:
        """Words with a weight, as written, decoded or put together from pieces."""
        if not text:
            return {}
        low = text.lower()
        out: dict[str, float] = {}
        tokens = low.split()
        distinct = set(tokens)
        self._look(distinct)
        for token in self.known.keys() & distinct:
            out.update(self.known[token])
        for word in (*spaced_words(self.chars, low, lambda run: self.spells(run, SPACED)[0]), *self._pieces(tokens)):
            if (x := self.weight(word)) > 0:
                out[word] = x
        return out

    def strength(self, text: str | None) -> float:
        """Weight of the strongest word and a share of the next; a word weighs as much as its strongest feature."""
        best = sorted(self.weighted(text).values(), reverse=True)
        return float(best[0] + NEXT_SHARE * sum(best[1:1 + NEXT])) if best else 0.0

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.base
        return float(1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * self.strength(text) + self.offset)))))


def _gram_counts(text: str) -> Counter:
    """What ``trigrams`` counts over the words of a lower-case text: windows of three letters as one integer.

    Whatever is no letter is 0: a mark before a word, and after it the end. Few different
    letters are counted in a dense array, many by sorting; the counts are the same.
    """
    points = np.frombuffer(f"  {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    present = np.flatnonzero(np.bincount(points)).tolist()
    letters = [c for c in present if _PLAIN.match(chr(c))]
    code = np.zeros(present[-1] + 1, np.int64)
    code[letters] = np.arange(1, len(letters) + 1)
    s, width = code[points], len(letters) + 1
    before, last = s[:-2] * (s[1:-1] > 0), s[1:-1]
    grams = ((before * width + last) * width + s[2:])[(last > 0) | (s[2:] > 0)]
    if width ** 3 <= DENSE:
        n = np.bincount(grams, minlength=1)
        grams = np.flatnonzero(n)
        n = n[grams]
    else:
        grams, n = np.unique(grams, return_counts=True)
    start, end = ["^", *map(chr, letters)], ["$", *map(chr, letters)]
    return Counter({start[g // width // width] + start[g // width % width] + end[g % width]: k for g, k in zip(grams.tolist(), n.tolist())})


def _trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        counts: Counter = Counter()
        held, size = [], 0
        for t in b["text"]:
            held.append(t.lower())
            size += len(t)
            if size >= CHUNK:
                counts.update(_gram_counts("\n".join(held)))
                held, size = [], 0
        if held:
            counts.update(_gram_counts("\n".join(held)))
        yield pd.DataFrame(list(counts.items()), columns=["gram", "n"])


def count_letters(texts: DataFrame) -> CharModel:
    """Character model over every row of (text), copies and words met once included.

    The table has a row for each trigram that occurs, so its counts grow with the input
    while it stays small."""
    rows = texts.select("text").filter("text IS NOT NULL").mapInPandas(_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    return CharModel.from_counts(dict(zip(rows["gram"], rows["n"])))


def _features(shipped: Broadcast) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chars, memory = shipped.value, {}
        for b in batches:
            counts: dict[tuple[int, int], Counter] = {}
            for t, y, fold in zip(b["text"], b["toxic"], b["fold"]):
                counts.setdefault((int(y), int(fold)), Counter()).update({f for w in restored(chars, t, memory) for f in features(w)})
            yield pd.DataFrame([(f, *at, n) for at, c in counts.items() for f, n in c.items()], columns=["feature", "toxic", "fold", "n"])

    return run


def _strengths(shipped: Broadcast) -> Callable[[Column, Column], Column]:
    """Strength of each text under the model of its fold."""
    @F.pandas_udf("double")
    def strength(texts: pd.Series, folds: pd.Series) -> pd.Series:
        return pd.Series([shipped.value[f].strength(t) for t, f in zip(texts, folds)], dtype="float64")

    return strength


def _scores(shipped: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shipped.value.score(t) for t in texts], dtype="float64")

    return score


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton steps with a small ridge."""
    a, b = 0.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        grad = np.array([np.sum(g * x) + 1e-3 * a, np.sum(g)])
        hess = np.array([[np.sum(h * x * x) + 1e-3, np.sum(h * x)], [np.sum(h * x), np.sum(h) + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def draw_labels(labels: DataFrame, key: str = "doc_id", label: str = "toxic", per_class: int = 4000) -> DataFrame:
    """About ``per_class`` rows of each class, drawn by a hash of the key; a bounded table.

    Taken before the texts are joined, so the join can broadcast it and no text moves.
    """
    given = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    totals = {r[0]: r[1] for r in given.groupBy(F.col(label).cast("int")).count().collect()}
    share = F.lit(0.0)
    for y in (0, 1):
        share = F.when(F.col(label) == y, F.lit(min(1.0, per_class / max(1, totals.get(y, 0))))).otherwise(share)
    return given.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share * (1 << 30))


def class_totals(labels: DataFrame, label: str = "toxic") -> dict[int, int]:
    """Rows of each class among all labels."""
    return {r[0]: r[1] for r in labels.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).count().collect() if r[0] in (0, 1)}


def train(
    labelled: DataFrame, per_class: int = 4000, least_texts: int = 5, texts: DataFrame | None = None, totals: dict[int, int] | None = None,
) -> Model:
    """Model from (text, toxic) rows with both given.

    The character model counts the words of all ``texts`` (of the labelled rows if not
    given) as written. Weights are fitted on a bounded sample: about ``per_class`` distinct
    texts of each class, drawn by a hash of the text; a text with both labels counts in
    both. They are smoothed log odds of features in at
    least ``least_texts`` texts. For the calibration each text is judged by weights from the
    other folds of the sample (by hash), and each class counts with its share of ``totals`` (rows
    of each class among all labels; of ``labelled`` if not given), so scores do not depend on how
    many rows of a class were drawn. Without both classes every score is the share of toxic rows (0.5 without rows).
    """
    given = labelled.filter("text IS NOT NULL AND toxic IS NOT NULL").select("text", F.col("toxic").cast("int").alias("toxic"))
    drawn = class_totals(given)
    n0, n1 = drawn.get(0, 0), drawn.get(1, 0)
    if not n0 or not n1:
        return Model(CharModel({}, {}, {}), {}, 0.0, 0.0, n1 / (n0 + n1) if n0 + n1 else 0.5)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class / n1))).otherwise(F.lit(min(1.0, per_class / n0)))
    sample = materialize(given.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)).distinct().repartition(32))
    sc = labelled.sparkSession.sparkContext
    chars = count_letters(given if texts is None else texts)
    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS)).cast("int")
    counted = materialize(sample.withColumn("fold", fold))
    sizes = {(r[0], r[1]): r[2] for r in counted.groupBy("toxic", "fold").count().collect()}
    cells = [(y, k) for y in (0, 1) for k in range(FOLDS)]
    table = counted.mapInPandas(_features(sc.broadcast(chars)), "feature string, toxic int, fold int, n long").groupBy("feature").agg(
        *[F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"n{y}_{k}") for y, k in cells],
        F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("bad"),
    ).filter(F.col("bad") >= least_texts).toPandas()

    def weigh(without: int | None) -> dict[str, float]:
        """Smoothed log odds from all folds but one; what is smoothed or demanded shrinks with the share of texts."""
        folds, part = [k for k in range(FOLDS) if k != without], 1.0 if without is None else 1 - 1 / FOLDS
        clean, bad = (table[[f"n{y}_{k}" for k in folds]].sum(axis=1) for y in (0, 1))
        t0, t1 = (sum(sizes.get((y, k), 0) for k in folds) + part for y in (0, 1))
        odds = np.log((bad + 0.1 * part) / t1) - np.log((clean + part) / t0)
        return {f: float(x) for f, x, n in zip(table["feature"], odds, bad) if x > 1.0 and n >= least_texts * part}

    strength = _strengths(sc.broadcast([Model(chars, weigh(k), 0.0, 0.0, 0.5) for k in range(FOLDS)]))
    points = counted.select("toxic", strength(F.col("text"), F.col("fold")).alias("x")).toPandas()
    y = points["toxic"].to_numpy(dtype=np.float64)
    all0, all1 = (totals or {}).get(0, n0), (totals or {}).get(1, n1)
    scale = np.where(y == 1, all1 / max(1, (y == 1).sum()), all0 / max(1, (y == 0).sum())) / (all0 + all1) * len(y)
    slope, offset = fit_logistic(points["x"].to_numpy(dtype=np.float64), y, scale)
    return Model(chars, weigh(None), slope, offset, all1 / (all0 + all1))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold) from the whole text.

    Null and empty texts have no words and get the score of a text without any toxic word.
    Rows are judged one by one, other columns pass through, columns of these names are
    replaced.
    """
    score = _scores(docs.sparkSession.sparkContext.broadcast(model))(F.col(text))
    return docs.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
