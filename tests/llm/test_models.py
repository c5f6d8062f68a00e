"""Language, toxicity, URL filter, packing, decontamination, near duplicates and the pipeline."""

import itertools
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tablescope.llm import decontaminate, jaccard, language, packing, toxicity, url_model
from tablescope.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def fold(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_backs_off_to_shorter_grams(spark):
    rows = [("der hund und die katze", "de"), ("the dog and the cat", "en")] * 1 + [(f"der hund und {x}", "de") for x in "abc"] + [(f"the dog and {x}", "en") for x in "abc"]
    model = language.train(spark.createDataFrame(rows + [(None, "en"), ("x", None)], "text string, lang string"), least_texts=2, least_grams=1)
    assert model.langs == ["de", "en"] and "hund" in model.known and "katze" not in model.known
    katze = np.mean([model.grams[g] for g in language.grams_of("katze", 5)], axis=0)
    assert np.allclose(model.unseen("katze"), katze) and katze[0] > katze[1]
    assert not model.unseen("жжж").any()
    docs = spark.createDataFrame([(1, None, "c"), (2, "12 34!", "c"), (3, "Katzen", "c"), (4, "the " * 50_000, "c"), (4, "the " * 50_000, "c")],
                                 "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred) for r in language.identify(docs, model).orderBy("doc_id").collect()]
    assert got == [(1, "und"), (2, "und"), (3, "de"), (4, "en"), (4, "en")]
    empty = language.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op1_language_id"][0](spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


WORDS = {w: 50 for w in "idiot stupid pathetic worthless loser the people hello thing about another bottle coffee".split()}


def test_viterbi_restores_disguises_and_is_optimal():
    model = toxicity.CharModel.build(WORDS)
    for token, word in [("1d10t", "idiot"), ("$tup1d", "stupid"), ("p4th3t1c", "pathetic"), ("s.t.u.p.i.d", "stupid"),
                        ("l o s e r", "loser"), ("iiidiooot", "idiot"), ("w0rthl3$$", "worthless"), ("coffee", "coffee")]:
        assert toxicity.decode(model, token) == word
    for token in ("1d1", "s5ss", "a*b"):
        def cost(choice):
            text, noise, two = "".join(c for c, _ in choice), sum(n for _, n in choice), "^^"
            for c in text + "$":
                noise, two = noise + model.log(two, c), two[1] + c
            return noise
        best = max(itertools.product(*toxicity.lattice(token)), key=cost)
        assert toxicity.decode(model, token) == "".join(c for c, _ in best)


def test_toxicity_scores_restored_text(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choices("the people hello thing about another bottle coffee".split(), k=20)) for _ in range(60)]
    rows = [(t, 0) for t in clean] + [(t + " idiot " + rng.choice(["stupid", "loser", "pathetic"]), 1) for t in clean[:40]]
    model = toxicity.train(spark.createDataFrame(rows + [(None, 1)], "text string, toxic int"))
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hello people", 0), (4, "you 1d10t", 0), (5, "i d i o t", 0), (6, "the " * 40_000 + "l0s3r idiot", 0)],
                                 "doc_id long, text string, predicted int")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(docs, model).collect()}
    assert [got[i][1] for i in range(1, 7)] == [0, 0, 0, 1, 1, 1] and got[1][0] == got[2][0]
    none = toxicity.train(spark.createDataFrame([], "text string, toxic int"))
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}


def test_toxicity_in_spaced_letters_pieces_and_long_tokens():
    words = {**WORDS, "you": 400, "are": 300, "a": 400}
    few = toxicity.CharModel.build(words)
    words |= {"as": 200, "sign": 50}
    model = toxicity.Model(toxicity.CharModel.build(words), {"idiot": 4.0, "stupid": 4.0, "stupi~": 3.0, "assig~": 1.0}, 2.0, -3.0, 0.5)
    assert toxicity.decode(few, "a s t u p i d", toxicity.SPACED) == "a stupid"
    assert toxicity.decode(few, "y o u i d i o t", toxicity.SPACED) == "you idiot"
    for text in ("you are a s t u p i d", "y o u i d i o t", "a stu pid bottle", "you id iot!", "st up id", "id i0t", "1d 10t", "s" * 50 + "7" + "u" * 30 + "p1d",
                 ".".join("s" * 40) + ".t.u.p.1.d"):
        assert model.strength(text) >= 3.0, text
    for text in ("hello people", "as sign", "you are a people", "the bottle", "x" * 5000 + "1"):
        assert model.strength(text) == 0.0, text


def test_toxicity_counts_letters_over_all_texts(spark):
    labelled = spark.createDataFrame([("hello people", 0), ("stupid people", 1)], "text string, toxic int")
    texts = [f"word{'' if i % 3 else ' zebra'}" for i in range(900)] + ["quixotic", None]
    all_texts = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    model = toxicity.train(labelled, per_class=1, texts=all_texts).chars
    assert model == toxicity.CharModel.build({"word": 900, "zebra": 300, "quixotic": 1})
    own = toxicity.train(labelled).chars
    assert own == toxicity.CharModel.build({"hello": 1, "people": 2, "stupid": 1})


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op2_toxicity"][0](spark, sf).collect()]
    assert len({r.doc_id for r in got}) == len(got) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    hit = sum(p and t for p, t in held)
    assert hit >= 0.85 * sum(t for _, t in held) and hit >= 0.85 * sum(p for p, _ in held)


def brute_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host):])[0]


URLS = [None, "", "no scheme", "http://", "http://A.Org/x?y#z", "ftp://u:p@É.com:80?a/b", "a://b://c/d", "http://x\n.org/é\n/f", "https://org", "https://org/",
        "https://aorg/", "https://m.example.org/en/1", "https://example.org/es/", "https://x.com/fr/1", "https://com/de/"]


def test_url_parts_and_rules(spark):
    rules = [url_model.Rule("org", "/", True), url_model.Rule("example.org", "/es/", False), url_model.Rule("example.org", "/en/1", False),
             url_model.Rule("com", "/fr/", True), url_model.Rule("com", "/de/", False)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    for r in url_model.filter_urls(df, rules).collect():
        host, path = brute_url(r.url)
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best.name)
        assert best is None or r.verdict == ("allow" if best.allow else "block")
    assert url_model.filter_urls(df.limit(0), rules).count() == 0


def test_url_model_is_a_distribution_and_separates(spark):
    texts = [(1, f"good.org/news/{i}") for i in range(300)] + [(0, f"bad.org/spam/{i}") for i in range(300)]
    counts = url_model.count_models(spark.createDataFrame(texts, "label int, text string").repartition(5))
    assert counts[1][0].sum() == sum(len(t) + 1 for y, t in texts if y == 1)
    assert url_model.log_ratio(counts, "else.net/news/5") > 0 > url_model.log_ratio(counts, "else.net/spam/5")
    rules = [url_model.Rule("good.org", "/", True), url_model.Rule("bad.org", "/", False)]
    pages = spark.createDataFrame([(i, "http://" + t) for i, (_, t) in enumerate(texts)] + [(1000, "http://x.good.net/news/1"), (1001, "http://x.bad.net/spam/1")],
                                  "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_model.filter_urls(pages, rules).collect()}
    assert (got[1000], got[1001]) == ("allow", "block")
    scored = spark.createDataFrame([(y, float(i)) for i in np.linspace(-1, 1, 101) for y in (0, 1)], "label int, score double")
    limit = url_model.calibrate(scored, 0.05)
    assert sum(x < limit for x in np.linspace(-1, 1, 101)) <= 5.05 and limit > -1


def test_url_counts_are_by_gram_over_all_rules(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-_."
    urls = [f"http://{'good' if i % 2 else 'bad'}.org/" + "".join(rng.choices(letters, k=80)) for i in range(4000)]
    other = ["http://else.net/" + "".join(rng.choices(letters, k=80)) for _ in range(20)]
    rules = [url_model.Rule("good.org", "/", True), url_model.Rule("bad.org", "/", False)]
    pages = spark.createDataFrame(list(enumerate(urls + other)), "page_id long, url string")
    got = {r.page_id: r.score for r in url_model.filter_urls(pages, rules).collect()}
    counts = [{}, {}]
    for u in urls:
        s = "^" * 4 + u[7:] + "$"
        for i in range(4, len(s)):
            for k in range(5):
                for key in (s[i - k:i + 1], (s[i - k:i],)):
                    own = counts["good" in u[:12]]
                    own[key] = own.get(key, 0) + 1
    assert len(counts[0]) > 1 << 17
    for i, u in enumerate(other, len(urls)):
        s, total = "^" * 4 + u[7:] + "$", 0.0
        for at in range(4, len(s)):
            p = [1 / 97, 1 / 97]
            for k in range(5):
                p = [(c.get(s[at - k:at + 1], 0) + 2 * x) / (c.get((s[at - k:at],), 0) + 2) for c, x in zip(counts, p)]
            total += np.log(p[1]) - np.log(p[0])
        assert abs(got[i] - total / (len(s) - 4)) < 1e-9


def test_url_values_in_parts_give_the_same_scores(spark):
    grams = [int(g) for t in ("good.org/a", "bad.org/b") for g in set(url_model._grams(t))]
    values = spark.createDataFrame([(g, float(g % 7)) for g in set(grams)], "gram long, x double")
    texts = spark.createDataFrame([("good.org/a",), ("bad.org/b",), ("",)], "_text string")
    one, many = ({r._text: r.score for r in url_model.score_texts(texts, values, "x", n).collect()} for n in (1000, 3))
    assert all(abs(one[t] - many[t]) < 1e-9 for t in one) and one["good.org/a"] > 0


def test_bucket_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(25):
        lengths = sorted(rng.sample(range(1, 40), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 20) for _ in lengths]
        for k in (1, 2, 3, 12):
            def padding(ends):
                return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))
            ends = packing.bucket_bounds(lengths, counts, k)
            want = min(padding((*e, lengths[-1])) for n in range(min(k, len(lengths))) for e in itertools.combinations(lengths[:-1], n))
            assert len(ends) <= k and padding(ends) == want
    assert packing.bucket_bounds([], [], 4) == []


def test_packing_places_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 7)
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "a b, c", "w " * rng.randrange(1, 90), "w " * 1000]), "clash") for i in range(300)] + [(5, "again", "clash"), (5, "again", "clash"), (None, "x", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = packing.pack(df, max_len=64, buckets=4, budget=256).collect()
    count = lambda t: len(re.findall(r"[^\W_]+|[^\w\s]|_", t or ""))
    assert sum(r.n_tokens for r in got) == sum(count(t) for _, t, _ in rows)
    assert len(got) == sum(max(1, -(-count(t) // 64)) for _, t, _ in rows)
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)
    for b in {r.bucket for r in got}:
        own = [r for r in got if r.bucket == b]
        per = max(1, 256 // own[0].bucket_len)
        assert all(r.n_tokens <= r.bucket_len and r.slot < per for r in own)
        assert sorted((r.batch, r.slot) for r in own) == [(i // per, i % per) for i in range(len(own))]
    assert packing.pack(df.limit(0)).count() == 0


def test_block_max_wand_finds_all_above_threshold():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words, 12)), " ".join(rng.choice(words, 3))) for i in range(50)]
    frequency = {w: sum(w in f"{q} {a}".split() for _, q, a in items) for w in words}
    index = decontaminate.Index.build(items, frequency, 50, 15.0)
    for _ in range(60):
        query = rng.choice(len(index.vocabulary), 20, replace=False)
        scores = np.zeros(50)
        for t in query:
            scores[index.postings[t][0]] += index.postings[t][1]
        for threshold in (0.2, 0.35, 0.5):
            assert sorted(i for i, _ in index.search(query, threshold)) == [int(i) for i in np.flatnonzero(scores >= threshold)]


def test_leaks_are_found_in_whole_texts_and_parts_of_the_index(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(400)]
    said = [" ".join(rng.choices(words, k=25)) + ". " + " ".join(rng.choices(words, k=5)) for _ in range(12)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(said)] + [(90, None), (91, ""), (92, said[0])], "item_id long, text string")
    filler = " ".join(rng.choices(words, k=3000))
    docs = [(1, f"{filler} {said[3].upper()} {filler}", 1), (2, filler, 1), (3, None, 1), (4, "", 1), (5, said[0], 1), (5, said[0], 1), (6, said[7].replace("v", "u"), 1),
            (7, said[4].split(". ")[1], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, leaks int")
    q, a = decontaminate.split_item(F.col("text"))
    for terms in (10**6, 100):
        got = decontaminate.find_leaks(df, items, q, a, shard_terms=terms).collect()
        hits = sorted((r.doc_id, [h.item_id for h in r.leaks]) for r in got)
        assert [(d, sorted(h)) for d, h in hits] == [(1, [3]), (2, []), (3, []), (4, []), (5, [0, 92]), (5, [0, 92]), (6, []), (7, [])]
    assert decontaminate.find_leaks(df, items.limit(0), q, a).filter(F.size("leaks") > 0).count() == 0
    assert decontaminate.find_leaks(df.limit(0), items, q, a).count() == 0


def shingles(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute_groups(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d if d is not None else -1, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for _ in range(25):
        text = rng.choices(words, k=rng.choice([1, 3, 5, 8, 12, 30, 80, 200]))
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rows += [f"{' '.join(rng.choices(words, k=70))} {passage}" for _ in range(20)]
    rows += [None, "", " \t", rows[0].upper(), rows[1], "one two", "One  two", "w " * 20_000]
    return list(enumerate(rows, 10)) + [(10, rows[0]), (None, rows[2]), (None, "only here with no id at all")]


def test_jaccard_groups_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    for seed, n, percent in ((1, 4, 85), (2, 5, 80), (3, 2, 50)):
        rows = near_rows(seed)
        df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_shingles int")
        got = jaccard.jaccard_groups(df, words=n, percent=percent).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in got) == [
            (d, s, c) for d, s, c in brute_groups(rows, n, percent)]
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0


def test_bitmap_bound_never_drops_a_link():
    rng = np.random.default_rng(8)
    for _ in range(30):
        base = np.unique(rng.integers(0, 2**63, 120).astype(np.uint64))
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(60, len(base)), replace=False), rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)]))
                for _ in range(12)]
        k = np.arange(12)
        out = jaccard.compare_tile(np.zeros(12, int), k, k, sets, 80)
        up = {i: i for i in range(12)}

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x
        for i, j in itertools.combinations(range(12), 2):
            if jaccard.linked(sets[i], sets[j], 80):
                up[find(i)] = find(j)
        want = {frozenset(i for i in range(12) if find(i) == r) for r in map(find, range(12))}
        mine = {i: i for i in range(12)}
        for a, b in out:
            x, y = find(a, mine), find(b, mine)
            mine[x] = y
        assert {frozenset(i for i in range(12) if find(i, mine) == r) for r in {find(i, mine) for i in range(12)}} == want


def test_pipeline_stages_match_brute_force(spark):
    import corpus_pipeline as p
    from tests.llm.test_native import base, repeated

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    known = {r.doc_id: r.text for r in docs.collect()}
    stay = {r.doc_id for r in kept.collect()}
    for d, t in known.items():
        w = WORD.findall(t)
        if len(w) < 20 or 100 * repeated(w) > 30 * len(w):
            assert d not in stay
    alone = p.near_duplicate_stage(spark, kept, sf)
    groups = brute_groups([(d, known[d]) for d in sorted(stay)], 5, 80)
    left = {r.doc_id for r in alone.collect()}
    assert left == {d for d, _, c in groups if c == d} and alone.columns == docs.columns
    pure = p.decontamination_stage(spark, alone, sf)
    items = [" ".join(decontaminate.terms_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in pure.collect()} == {d for d in left if not any(f" {i} " in f" {' '.join(decontaminate.terms_of(known[d]))} " for i in items)}
    safe = p.secret_stage(spark, pure, sf).collect()
    assert all(not base(r.text) and r.n_chars == len(r.text) for r in safe) and len(safe) == pure.count()
    assert {r.doc_id for r in p.packing_stage(spark, p.secret_stage(spark, pure, sf), sf).collect()} == {r.doc_id for r in safe}
    assert len(p.STAGES) == 5 and p.run(spark, sf).count() >= len(safe)


def test_near_duplicate_stage_keeps_one_of_repeated_ids(spark):
    import corpus_pipeline as p

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, text + " x"), (2, text), (None, text), (3, None), (3, None), (None, "other words that stand alone here")]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = p.near_duplicate_stage(spark, df, "").collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 3, 3]
