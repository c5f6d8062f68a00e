"""Toxicity: words in pieces against trying every reading, and calibration whatever the size of the draw."""

import random

from pyspark.sql import functions as F

from tablescope.llm import toxicity as T
from tablescope.llm.columns import crc_mod4

WORDS = {"idiot": 5, "stupid": 7, "moron": 3, "table": 30, "the": 90, "apple": 20, "stump": 4, "pidgin": 3, "a": 40, "is": 50}


def model(cls=T.Model):
    weights = {"idiot": 3.0, "stupid": 4.0, "stupi~": 2.0, "moron": 2.5, "moro~": 1.5}
    return cls(T.CharModel.build(WORDS), weights, 1.0, -2.0, 0.1)


class Tries(T.Model):
    """Decodes whatever might be a word, without looking first whether any reading has a weight."""

    def spells(self, raw, gaps=None):
        return True, True

    def _start(self, token):
        first = token.lstrip(T._EDGES)
        if first != first.rstrip(T._EDGES):
            return ""
        odd = not first.isalpha() and any(c.isalpha() for c in first)
        return first if first in self.begins or odd else ""


def pieces(rng):
    word = list(rng.choice([*WORDS, "idiots", "stupidly", "morons"]))
    word = [rng.choice({"i": "i1!", "o": "o0", "s": "s$5", "t": "t7+", "a": "a4@"}.get(c, c)) if rng.random() < 0.3 else c for c in word]
    for _ in range(rng.randrange(3)):
        word.insert(rng.randrange(1, len(word) + 1), " ")
    return rng.choice(["", "", "(", '"']) + "".join(word) + rng.choice(["", "", ",", ".", "!"])


def test_words_in_pieces_match_trying_every_reading():
    rng, found = random.Random(9), 0
    fast, slow = model(), model(Tries)
    for _ in range(400):
        text = " ".join(pieces(rng) for _ in range(rng.randrange(12)))
        assert fast.joined(text) == slow.joined(text), text
        assert abs(fast.strength(text) - slow.strength(text)) < 1e-12
        found += len(fast.joined(text))
    assert found > 50
    assert fast.joined("you stu pid") == {"stupid": 1} and not fast.joined("stu, pid") and fast.joined('"id i0t."') == {"idiot": 1}


def test_strength_is_that_of_the_words_restored():
    rng, m = random.Random(2), model()
    for _ in range(200):
        text = " ".join(pieces(rng) for _ in range(rng.randrange(12)))
        words = T.restored(m.chars, text, {}) | m.joined(text)
        best = sorted((x for x in map(m.weight, words) if x > 0), reverse=True)
        assert abs(m.strength(text) - (best[0] + T.NEXT_SHARE * sum(best[1:1 + T.NEXT]) if best else 0.0)) < 1e-12


def test_letters_are_counted_word_by_word(spark):
    texts = ["The cat, the\tCAT\nnaïve x1y", None, "", "don't 日本 日本"]
    got = {r["gram"]: r["n"] for r in spark.createDataFrame([(t,) for t in texts], "text string").filter("text IS NOT NULL").mapInPandas(
        T._trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    want = {}
    for w in "the cat the cat naïve x y don t 日本 日本".split():
        s = f"^^{w}$"
        for i in range(2, len(s)):
            want[s[i - 2:i + 1]] = want.get(s[i - 2:i + 1], 0) + 1
    assert got == want


def test_precision_does_not_depend_on_the_draw(spark):
    """Both classes beyond the bound, as in a large table: the shares of all labels count, not those of the draw."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    learn, held = labels.filter(crc_mod4(F.col("doc_id")) != 2), docs.join(labels.filter(crc_mod4(F.col("doc_id")) == 2), "doc_id")
    seen = {}
    for bound in (4000, 300):
        drawn = docs.join(T.draw_labels(learn, per_class=bound), "doc_id").select("text", "toxic")
        fitted = T.train(drawn, per_class=bound, totals=T.class_totals(learn))
        scored = T.score_toxicity(held, fitted).agg(
            F.avg("score"), F.avg("toxic"), F.expr("count_if(predicted = 1 AND toxic = 1)") / F.expr("count_if(predicted = 1)"), F.expr("count_if(predicted = 1 AND toxic = 1)") / F.expr("count_if(toxic = 1)")).first()
        seen[bound] = tuple(scored)
    assert seen[300][2] > seen[4000][2] - 0.05 and seen[4000][2] > 0.85 and seen[4000][3] > 0.85 and seen[300][3] > 0.6
    assert all(abs(score - share) < 0.04 for score, share, _, _ in seen.values())


def test_two_pieces_come_out_as_the_decoder_says():
    rng, chars = random.Random(4), T.CharModel.build(WORDS)
    starts = sorted({w[:n] for w in WORDS for n in range(1, len(w) + 1)} | {"stupp", "1d", "o", "aa"})
    whole = 0
    for _ in range(3000):
        run = " ".join(rng.choice(starts) for _ in range(rng.choice([1, 2, 2, 2, 3])))
        for word in {run.replace(" ", ""), *run.split(" ")}:
            got = T.comes_out_whole(chars, run, word)
            assert got == (word in T.decode(chars, run, T.PIECES).split()), (run, word)
        whole += T.comes_out_whole(chars, run, run.replace(" ", ""))
    assert 20 < whole < 3000


def test_letter_windows_are_counted_alike_dense_and_sorted(monkeypatch):
    text = "the naïve the\t日本. x x,x _x9y 𝒳y the\n日本 '' ^$ x"
    want = T.trigrams(T.Counter(T._PLAIN.findall(text)))
    for cells in (T.DENSE, 1):
        monkeypatch.setattr(T, "DENSE", cells)
        assert T._gram_counts(text) == want
    assert not T._gram_counts("") and not T._gram_counts(" 12 _ ")


def test_runs_of_single_letters_are_never_passed_over():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab *._-\n\t@1,") for _ in range(rng.randrange(1, 14))) for _ in range(30000)]
    found = [t for t in texts if T._SPACED.search(t)]
    assert len(found) > 100 and all(T._MAYBE_SPACED.search(" " + t) for t in found)
