"""Language identification: known words first, shorter and shorter character n-grams for the rest."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import materialize

#: Longest character n-gram of the backoff.
LONGEST = 5
#: Unseen words whose score is remembered in a task.
REMEMBERED = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of the word with its edges marked; single letters without edges."""
    if n == 1:
        return list(word)
    edged = f"<{word}>"
    return [edged[i:i + n] for i in range(len(edged) - n + 1)]


@dataclass
class Model:
    """Log frequencies per language: of known words, and of n-grams per length 1 to LONGEST."""

    langs: list[str]
    known: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    memory: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def build(cls, langs: list[str], rows: Iterator[tuple[str, int, int, int]]) -> Model:
        """``rows``: (term, n, language position, count); n = 0 for words. Add-half smoothing
        against the total of the same length and language."""
        at: dict[int, dict[str, np.ndarray]] = defaultdict(dict)
        totals: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
        for term, n, lang, count in rows:
            at[n].setdefault(term, np.zeros(len(langs)))[lang] += count
            totals[n][lang] += count

        def logs(n: int) -> dict[str, np.ndarray]:
            size = len(at[n])
            return {t: np.log((c + 0.5) / (totals[n] + 0.5 * size)).astype(np.float32) for t, c in at[n].items()}

        grams: dict[str, np.ndarray] = {}
        for n in range(1, LONGEST + 1):
            grams.update(logs(n))
        return cls(langs, logs(0), grams)

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequency of the known n-grams of the longest length that has any; zeros if none has."""
        got = self.memory.get(word)
        if got is None:
            got = np.zeros(len(self.langs), dtype=np.float32)
            for n in range(LONGEST, 0, -1):
                found = [self.grams[g] for g in grams_of(word, n) if g in self.grams]
                if found:
                    got = np.mean(found, axis=0)
                    break
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[word] = got
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the best sum over the words; the score is its share after a
        softmax of the sums divided by the root of the number of words."""
        words = words_of(text)
        if not words or not self.langs:
            return "und", 0.0
        counts = Counter(words)
        known = self.known
        rows = np.array([known[w] if w in known else self.unseen(w) for w in counts])
        sums = np.array(list(counts.values()), dtype=np.float64) @ rows
        best = int(np.argmax(sums))
        shares = np.exp((sums - sums[best]) / math.sqrt(len(words)))
        return self.langs[best], float(shares[best] / shares.sum())


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch and language: words and their n-grams with token counts, words with text counts."""
    for b in batches:
        out = []
        for lang, texts in b.groupby("lang")["text"]:
            tokens: Counter = Counter()
            held: Counter = Counter()
            for t in texts:
                c = Counter(words_of(t))
                tokens.update(c)
                held.update(c.keys())
            terms: Counter = Counter()
            for w, c in tokens.items():
                for n in range(1, LONGEST + 1):
                    for g in grams_of(w, n):
                        terms[g, n] += c
            out += [(lang, w, 0, c, held[w]) for w, c in tokens.items()]
            out += [(lang, g, n, c, 1) for (g, n), c in terms.items()]
        yield pd.DataFrame(out, columns=["lang", "term", "n", "count", "texts"])


def train(labelled: DataFrame, per_lang: int = 2000, least_texts: int = 3, least_grams: int = 5, most_langs: int = 1000) -> Model:
    """Model from (text, lang) rows with lang and text given.

    Fitted on a bounded sample: about ``per_lang`` distinct texts of each language, drawn by
    a hash of the text, so the model's size depends on the sample, not on the table. Words
    in fewer than ``least_texts`` texts count as unseen; n-grams need ``least_grams``
    occurrences. More than ``most_langs`` languages are refused.
    """
    given = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    totals = {r[0]: r[1] for r in given.groupBy("lang").count().limit(most_langs + 1).collect()}
    if len(totals) > most_langs:
        raise ValueError(f"more than {most_langs} values in lang: is it a language column?")
    if not totals:
        return Model([], {}, {})
    share = F.lit(0.0)
    for lang, n in totals.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)
    sample = given.filter(drawn).select("text", "lang").distinct()
    terms = sample.mapInPandas(_count_terms, "lang string, term string, n int, count long, texts long").groupBy("lang", "term", "n").agg(
        F.sum("count").alias("count"), F.sum("texts").alias("texts"))
    kept = materialize(terms.filter(F.when(F.col("n") == 0, F.col("texts") >= least_texts).otherwise(F.col("count") >= least_grams)))
    langs = sorted(totals)
    place = {x: i for i, x in enumerate(langs)}
    return Model.build(langs, ((r.term, r.n, place[r.lang], r.count_) for r in kept.withColumnRenamed("count", "count_").toPandas().itertuples()))


def _predictor(shipped: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = shipped.value
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    return predict


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) from the whole text.

    Null texts and texts without a letter, and every text under a model without languages,
    get ``und`` and 0. Equal sums go to the first language in alphabetical order. Rows are
    judged one by one, other columns pass through, columns of these names are replaced.
    """
    found = _predictor(docs.sparkSession.sparkContext.broadcast(model))(F.col(text))
    return docs.withColumn("_found", found).withColumns({"lang_pred": F.col("_found.lang"), "score": F.col("_found.score")}).drop("_found")
