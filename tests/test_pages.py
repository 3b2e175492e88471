"""Page maps against the rules as written down for one issue, and the cases that runs of words miss."""

from __future__ import annotations

import random

from quirework.operators import pages

ARTICLES, PAGES = "doc_id string, article_idx int, text string", "doc_id string, page_number int, text string"


def runs(text):
    return {text.lower()[i : i + 4] for i in range(len(text) - 3)}


def brute(arts, side):
    """The page of each article of one issue, by loops."""
    share = lambda a, p: 1.0 if a[:40] in p else sum(g in p.lower() for g in runs(a)) / len(runs(a))
    last, out = 0, []
    for a in arts:
        low, found = max(0, last - 1), None
        if len(a[:40]) >= 30:
            scores = {k: share(a, p) for k, p in enumerate(side) if k >= low}
            best = max(scores, key=lambda k: (scores[k], -k))
            near = max((k for k in scores if k < low + 7), key=lambda k: (scores[k], -k))
            if scores[best] * len(runs(a)) >= max(3, 0.2 * len(runs(a))):
                found = near if scores[near] >= 0.9 * scores[best] else best
        if found is None and a:
            found = next((k for k, p in enumerate(side) if k >= low and a[:20] in p), None)
        if found is not None:
            last = max(found + 1, last)
        elif len(a[:40]) >= 30:
            scores = [share(a, p) for p in side]
            best = max(range(len(side)), key=lambda k: (scores[k], -k))
            found = best if scores[best] >= 0.5 else None
        out.append(None if found is None else found + 1)
    return out


def mapped(spark, arts, side):
    a = spark.createDataFrame([("d", k, t) for k, t in enumerate(arts)], ARTICLES)
    p = spark.createDataFrame([("d", k + 1, t) for k, t in enumerate(side)], PAGES)
    return [r["pdf_page"] for r in pages.article_pages(a, p).orderBy("article_idx").collect()]


def test_whole_text_counts(spark):
    form = "Le ministre de la justice a fixé par le présent arrêté ce qui suit. " * 7
    rest = " ".join(f"parcelle {k * 7919 % 1000} lot {k * 104729 % 997}" for k in range(60))
    side = [form.replace("Le ministre", "La ministre"), rest]
    a = spark.createDataFrame([("d", 0, form + rest)], ARTICLES)
    p = spark.createDataFrame([("d", k + 1, t) for k, t in enumerate(side)], PAGES)
    own = {r["page_number"]: (r["n"], r["score"]) for r in pages.page_scores(a, p).collect()}
    every = runs((form + rest).strip())
    shares = {k + 1: len(every & runs(t.strip())) / len(every) for k, t in enumerate(side)}
    assert shares[1] < pages.LEAST_SHARE < shares[2] and own == {2: (len(every), shares[2])}
    assert mapped(spark, [form + rest], side) == [2]


def test_noise_in_every_word(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(40)]
    other = ["".join(rng.choice("qrstuvwxyz") for _ in range(12)) for _ in range(40)]
    noisy = " ".join(w[:10] + "~" + w[11:] for w in words)
    assert mapped(spark, [" ".join(words)], [" ".join(other), noisy]) == [2]


def test_short_articles(spark):
    side = ["Article premier. Abrogé.", "Texte de la page deux", "Article premier. Abrogé.", "Article 2. Supprimé."]
    assert mapped(spark, ["Article 2. Supprimé.", "Article premier. Abrogé.", "", "introuvable"], side) == [4, None, None, None]
    assert mapped(spark, ["Article premier. Abrogé.", "Texte de la page deux", "Article premier. Abrogé."], side) == [1, 2, 3]


def test_walk_is_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for _ in range(4):
        side = [some(40) for _ in range(12)]
        arts = [t[k : k + rng.randrange(8, 160)].strip() for t in side for k in (0, 70)] + [some(9) for _ in range(4)] + [some(2), side[2][30:120].strip()]
        rng.shuffle(arts)
        assert mapped(spark, arts, side) == brute(arts, side)


def test_runs_are_counted_exactly():
    texts = ["abcabcabc", "ABCA", "abc", "", "xabca\u0633\u0644\u0627\u0645 \U0001f600!", "\u0633\u0644\u0627\u0645"]
    own = pages.run_numbers(texts)
    assert [len(r) for r in own] == [len(runs(t)) for t in texts]
    both = pages.shared_runs(own[:3], own[3:])
    assert both.tolist() == [[len(runs(a) & runs(b)) for b in texts[3:]] for a in texts[:3]]
    assert pages.shared_runs([], own).shape == (0, 6) and [len(r) for r in pages.run_numbers([])] == []


def test_blocks_meet_once(spark):
    rng = random.Random(8)
    side = ["".join(rng.choice("abcdefghij") for _ in range(90)) for _ in range(150)]
    arts = [side[k * 7 % 150][:60] for k in range(140)]
    a = spark.createDataFrame([("d", k, t) for k, t in enumerate(arts)] + [("d", 500, None), (None, 1, "x" * 50)], ARTICLES)
    p = spark.createDataFrame([("d", k + 1, t) for k, t in enumerate(side)] + [("d", None, side[0]), ("d", 900, None), ("e", 1, side[1])], PAGES)
    got = sorted((r["article_idx"], r["page_number"]) for r in pages.page_scores(a, p).collect() if r["score"] == 1.0)
    assert got == [(k, k * 7 % 150 + 1) for k in range(140)]
