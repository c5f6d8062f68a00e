"""Benchmark decontamination: BM25 index of test items, block-max WAND over training passages."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import materialize

HIT = "struct<item_id:bigint,score:double,question:double,answer:double>"
_WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Items per block of the index.
BLOCK = 4
#: Words in a gram of the final comparison.
GRAM = 5


#: Lower case of every ASCII word character, a space for the others.
_ASCII = "".join(chr(c).lower() if chr(c).isalnum() or chr(c) == "_" else " " for c in range(128))


def terms_of(text: str | None) -> list[str]:
    """Lower-cased runs of word characters."""
    if not text:
        return []
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text.lower())


def _grams(words: list[str]) -> set[tuple[str, ...]]:
    """Grams of GRAM words; the whole sequence if it is shorter."""
    if len(words) <= GRAM:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + GRAM]) for i in range(len(words) - GRAM + 1)}


@dataclass
class Index:
    """Inverted index of a bounded set of items, impacts divided by the item's own score.

    An item that is contained in a passage scores 1 there, so one threshold suits items of
    every length. ``postings[t]`` holds item positions and impacts, ``blocks[t]`` the
    largest impact per block of items.
    """

    ids: list[int]
    questions: list[set]
    answers: list[set]
    vocabulary: dict[str, int]
    postings: list[tuple[list[int], list[float]]]
    blocks: np.ndarray
    longest: int

    @classmethod
    def build(cls, items: list[tuple[int, str, str]], frequency: dict[str, int], n_items: int, mean_length: float) -> Index:
        words = [(terms_of(q), terms_of(a)) for _, q, a in items]
        vocabulary: dict[str, int] = {}
        lists: list[list[tuple[int, float]]] = []
        for i, (q, a) in enumerate(words):
            counts = Counter(q + a)
            length = sum(counts.values())
            impacts = {
                t: np.log1p((n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * length / mean_length))
                for t, c in counts.items()}
            own = sum(impacts.values()) or 1.0
            for t, x in impacts.items():
                at = vocabulary.setdefault(t, len(lists))
                if at == len(lists):
                    lists.append([])
                lists[at].append((i, x / own))
        postings = [([i for i, _ in p], [x for _, x in p]) for p in lists]
        blocks = np.zeros((max(len(lists), 1), -(-max(len(items), 1) // BLOCK)), dtype=np.float32)
        for t, (at, x) in enumerate(postings):
            np.maximum.at(blocks[t], np.array(at) // BLOCK, x)
        return cls([i for i, _, _ in items], [_grams(q) for q, _ in words], [_grams(a) for _, a in words], vocabulary,
                   postings, blocks, max([len(q) + len(a) for q, a in words], default=1) or 1)

    def passages(self, n: int) -> list[tuple[int, int]]:
        """Windows of twice the longest item, half overlapping: every item lies whole in one."""
        step = self.longest
        return [(s, min(n, s + 2 * step)) for s in range(0, max(n - step, 1), step)]

    def search(self, query: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items that score at least ``threshold`` for the distinct terms ``query``.

        Block-max WAND: cursors sorted by their item; the pivot is the first item whose
        terms' largest impacts reach the threshold; if the largest impacts in its block do
        not, all cursors move behind the block, else the item is scored.
        """
        lists = [self.postings[t] for t in query]
        blocks = self.blocks[query].tolist()
        most = [max(b) for b in blocks]
        cursors = [[p[0][0], 0, q] for q, p in enumerate(lists)]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, q) in enumerate(cursors):
                bound += most[q]
                if bound >= threshold - 1e-6:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            tight = sum(blocks[c[2]][block] for c in cursors[:pivot + 1])
            if tight < threshold - 1e-6:
                # no item up to the end of the block, nor before the next cursor, can reach the threshold
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target, moved = max(target, item + 1), pivot + 1
            elif cursors[0][0] == item:
                score = sum(lists[q][1][k] for _, k, q in cursors[:pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                target, moved = item + 1, pivot + 1
            else:
                target, moved = item, pivot
            for c in cursors[:moved]:
                at = lists[c[2]][0]
                c[1] = bisect_left(at, target, c[1])
                c[0] = at[c[1]] if c[1] < len(at) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def hits(self, text: str | None, threshold: float, overlap: float) -> list[dict]:
        """Verified items of one text. A first bound per passage and block, for all passages
        of the text at once, leaves the search to passages that can reach the threshold."""
        words = terms_of(text)
        if not words or not self.ids:
            return []
        unknown = len(self.vocabulary)
        terms = np.fromiter(map(self.vocabulary.get, words, repeat(unknown)), dtype=np.int64, count=len(words))
        best: dict[int, float] = {}
        spans: dict[int, list[tuple[int, int]]] = {}
        # Each stretch of one step is part of two windows; a window's bound is at most the sum of theirs.
        known_at = np.flatnonzero(terms != unknown)
        if not len(known_at):
            return []
        pairs = np.unique((known_at // self.longest) * unknown + terms[known_at])
        stretch = pairs // unknown
        starts = np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1]]))
        bounds = np.zeros((-(-len(words) // self.longest) + 1, self.blocks.shape[1]), dtype=np.float32)
        bounds[stretch[starts]] = np.add.reduceat(self.blocks[pairs % unknown], starts, axis=0)
        windows = self.passages(len(words))
        reach = (bounds[:-1] + bounds[1:]).max(axis=1)
        for w in np.flatnonzero(reach[:len(windows)] >= threshold - 1e-6):
            s, e = windows[w]
            query = np.unique(terms[s:e])
            query = query[query != unknown]
            if self.blocks[query].sum(axis=0).max() < threshold - 1e-6:
                continue
            for item, score in self.search(query, threshold):
                best[item] = max(score, best.get(item, 0.0))
                spans.setdefault(item, []).append((s, e))
        out = []
        for item, score in best.items():
            seen: set = set()
            for s, e in spans[item]:
                part = words[s:e]
                for n in {GRAM, *(len(g) for g in (*self.questions[item], *self.answers[item]))}:
                    seen.update(tuple(part[i:i + n]) for i in range(len(part) - n + 1))
            shares = [len(g & seen) / len(g) if g else None for g in (self.questions[item], self.answers[item])]
            known = [x for x in shares if x is not None]
            if known and all(x >= overlap for x in known):
                out.append({"item_id": self.ids[item], "score": score, "question": shares[0], "answer": shares[1]})
        return sorted(out, key=lambda h: (h["item_id"] is None, h["item_id"]))


def _indexes(items: DataFrame, item_id: str, question: Column, answer: Column, shard_terms: int) -> Iterator[Index]:
    """Indexes over parts of the items, each of about ``shard_terms`` words, with the
    document frequencies of all items."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, 1, c) for q, a in zip(b.question, b.answer) for t, c in Counter(terms_of(q) + terms_of(a)).items()]
            yield pd.DataFrame(rows, columns=["term", "items", "words"])

    known = materialize(items.select(
        F.col(item_id).cast("long").alias("item_id"), F.coalesce(question, F.lit("")).alias("question"),
        F.coalesce(answer, F.lit("")).alias("answer")).filter(F.concat("question", "answer").rlike(r"[\p{L}\p{N}]")))
    terms = materialize(known.select("question", "answer").mapInPandas(count, "term string, items long, words long").groupBy("term").agg(
        F.sum("items").alias("items"), F.sum("words").alias("words")))
    n_items, n_words = known.count(), terms.agg(F.sum("words")).first()[0] or 0
    parts = max(1, -(-n_words // shard_terms))
    dealt = known.withColumn("part", F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(parts)))
    for part in range(parts):
        own = dealt.filter(F.col("part") == part).drop("part")
        rows = [tuple(r) for r in own.orderBy("item_id", "question", "answer").collect()]
        words = own.select("question", "answer").mapInPandas(count, "term string, items long, words long").select("term").distinct()
        frequency = {r[0]: r[1] for r in terms.join(words, "term", "left_semi").select("term", "items").collect()}
        yield Index.build(rows, frequency, n_items, n_words / max(1, n_items))


def _searcher(shipped: Broadcast, threshold: float, overlap: float) -> Callable[[Column], Column]:
    @F.pandas_udf(f"array<{HIT}>")
    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([shipped.value.hits(t, threshold, overlap) for t in texts], dtype=object)

    return search


def find_leaks(docs: DataFrame, items: DataFrame, question: Column, answer: Column, text: str = "text", item_id: str = "item_id",
               threshold: float = 0.5, overlap: float = 0.5, shard_terms: int = 2_000_000) -> DataFrame:
    """``docs`` with ``leaks``: verified items (item_id, score, question, answer) per row.

    Every passage of every row is a query. ``score`` is the share of the item's own BM25
    score that the best passage reaches, at least ``threshold``; ``question`` and ``answer``
    are the shares of their word grams found in the passages, each at least ``overlap``
    (null and not asked for where an item has none). The index is shipped to the tasks in
    parts of at most about ``shard_terms`` words; with more than one part, rows are written
    between passes. Null and empty texts have no leaks; items without words are left out;
    items of equal text are all reported; rows are judged one by one, other columns pass
    through, a column ``leaks`` is replaced.
    """
    out = docs.withColumn("leaks", F.array().cast(f"array<{HIT}>"))
    for k, index in enumerate(_indexes(items, item_id, question, answer, shard_terms)):
        if k:
            out = materialize(out)
        search = _searcher(docs.sparkSession.sparkContext.broadcast(index), threshold, overlap)
        out = out.withColumn("leaks", F.concat("leaks", search(F.col(text))))
    return out


def split_item(text: Column) -> tuple[Column, Column]:
    """Question and answer of an item kept as one text: the last sentence is the answer.

    A text of one sentence is all question.
    """
    pattern = r"(?s)^(.*[.!?])\s+(\S.*)$"
    answer = F.regexp_extract(text, pattern, 2)
    return F.when(answer == "", text).otherwise(F.regexp_extract(text, pattern, 1)), answer
