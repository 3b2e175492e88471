"""Merge-and-rematch: rounds of blocking, matching and merging."""

from __future__ import annotations

import random
from itertools import combinations

from quirework.llm import names, pairs


def placed(spark, rows):
    """The sets of texts of each cluster of rows (doc_id, text, kind, family, given, short)."""
    own = spark.createDataFrame(rows, names.PROFILE)
    found = own.select("doc_id", "text", names.form_number().alias("form")).join(names.resolve(own), "form")
    out: dict = {}
    for r in found.collect():
        out.setdefault((r["doc_id"], r["cluster"]), set()).add(r["text"])
    return sorted(map(sorted, out.values()))


def person(text, family, given=(), short=(), doc="d"):
    return (doc, text, "person", family, sorted(given), sorted(short))


def test_a_long_chain_is_one(spark):
    chain = ["abcdefgh", "xbcdefgh", "xycdefgh", "xyzdefgh", "xyzwefgh", "xyzwvfgh", "xyzwvugh", "xyzwvuth"]
    rows = [person(f"t{k}", w, ["omar"]) for k, w in enumerate(chain)] + [("d", "m", "ministry", "eau", ["eau"], []), ("d", "o", "other", "omar", [], [])]
    assert placed(spark, rows) == [["m"], ["o"], [f"t{k}" for k in range(8)]]
    assert placed(spark, rows[:0]) == []


def test_two_blocks_meet_only_through_a_merged_profile(spark):
    a, b, c = person("a", "abcdefgh", ["omar"]), person("b", "abcdefgx", ["ali", "omar"]), person("c", "abcdefyx", ["omar", "zaki"])
    assert not names.close("abcdefgh", "abcdefyx")
    assert placed(spark, [b, c]) == [["b"], ["c"]] and placed(spark, [a, c]) == [["a"], ["c"]]
    assert placed(spark, [a, b, c]) == [["a", "b", "c"]]  # the spelling of b, the given name of a
    # a bare name fits two full ones, until those are found to be one
    assert placed(spark, [person("a", "danghi", ["ali", "omar"]), person("b", "danghi", ["omar"]), person("c", "danghi")]) == [["a", "b", "c"]]


def test_ambiguous_evidence_links_nothing(spark):
    rows = [person("l", "danghi", ["lahcen"]), person("o", "danghi", ["omar"]), person("bare", "danghi"), person("i", "danghi", [], ["l"]), person("x", "danghi", ["omar"], doc="e")]
    assert placed(spark, rows) == [["bare"], ["i", "l"], ["o"], ["x"]]
    alone = [person("n", "danghi", [], ["n"]), person("nou", "danghi", [], ["nou"]), person("k", "toufas", [], ["k"]), person("m", "toufas", [], ["m"]), person("b2", "toufas")]
    assert placed(spark, alone) == [["b2"], ["k"], ["m"], ["n", "nou"]]
    assert placed(spark, [person("n", "danghi", [], ["n"]), person("bare", "danghi"), person("typo", "danhgi")]) == [["bare", "n", "typo"]]


def test_ministries_go_through_the_same_rounds(spark):
    def ministry(text, *words, short=()):
        return ("d", text, "ministry", "".join(words), sorted(set(words)), sorted(short))

    rows = [
        ministry("full", "peche", "maritime"), ministry("one", "pechemaritime"), ministry("typo", "peche", "maritmie"), ministry("part", "maritime"), ministry("cut", "peche", short=["mar"]),
        ministry("rural", "modernisation", "rurale"), ministry("roads", "routes", "rurale"), ministry("both", "rurale"),
    ]
    assert placed(spark, rows) == [["both"], ["cut", "full", "one", "part", "typo"], ["roads"], ["rural"]]


def test_waw_is_an_initial_or_a_ministry(spark):
    rows = [(k, f"d{k % 9}", "وزارة الفلاحة") for k in range(9)] + [(20, "d1", "و. الفلاحة"), (21, "d1", "وفاء تيلميجياس"), (22, "d1", "و. تيلميجياس")]
    rows += [(30 + k, f"d{k}", f"وفاء {n}") for k, n in enumerate(["تيلميجياس", "ساشفاك", "بنلكغال", "ميجسوم"])]
    out = {(r["doc_id"], r["text"]): r["cluster"] for r in names.clusters(spark.createDataFrame(rows, "id bigint, doc_id string, text string")).collect()}
    assert out["d1", "و. الفلاحة"] == out["d1", "وزارة الفلاحة"] != out["d1", "و. تيلميجياس"] == out["d1", "وفاء تيلميجياس"]


def test_near_spellings_are_brute_force(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abou") for _ in range(n)) for n in (4, 5, 9, 10) for _ in range(60)} | {"abouabouab", "oubaoubaob"}
    words = sorted(words)
    rows = spark.createDataFrame([(k, 1, w) for k, w in enumerate(words)] + [(900, 2, words[0])], "sid bigint, home bigint, word string")
    near = {tuple(r) for r in names.near_spellings(rows).collect()}
    like = lambda a, b: names.close(a, b) or (len(a) > 3 < len(b) and names.close(names.sound(a), names.sound(b)))
    missed = {(i, j) for i, j in combinations(range(len(words)), 2) if like(words[i], words[j])} - near
    assert all(i != j and (j, i) in near for i, j in near) and not missed


def test_few_and_many_spellings_of_a_home_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abouw") for _ in range(n)) for n in (3, 4, 5, 9, 10, 11) for _ in range(40)} | {"ouabou", "uabu", "shabou", "chabu"})
    rows = [(100 * h + k, h, w) for h, own in enumerate((words[::3], words[1::3], words[2::3], words[:1])) for k, w in enumerate(own)]
    like = lambda a, b: len(a) > 3 < len(b) and (names.close(a, b) or names.close(names.sound(a), names.sound(b)))
    right = {(i, j) for i, h, a in rows for j, g, b in rows if h == g and i != j and like(a, b)}
    for each in (1, 60, 1000):
        monkeypatch.setattr(names, "EACH", each)
        near = [tuple(r) for r in names.near_spellings(spark.createDataFrame(rows, "sid bigint, home bigint, word string")).collect()]
        assert len(near) == len(set(near)) and set(near) == right


def test_closeness_is_by_edits():
    rng = random.Random(4)
    for _ in range(20_000):
        a = [rng.choice("abc") for _ in range(rng.randrange(3, 12))]
        b = a[:]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(b))
            b[k : k + rng.randrange(3)] = [rng.choice("abc") for _ in range(rng.randrange(3))] if rng.random() < 0.5 or k + 1 == len(b) else [b[k + 1], b[k]]
            b = b or ["a"]
        a, b = "".join(a), "".join(b)
        most = 2 if min(len(a), len(b)) >= 9 else 1
        assert names.close(a, b) == (a == b or min(len(a), len(b)) > 3 and names.distance(a, b, 99) <= most)


def test_homes_without_merges_leave_the_rounds(spark, monkeypatch):
    chain = ["abcdefgh", "xbcdefgh", "xycdefgh", "xyzdefgh", "xyzwefgh", "xyzwvfgh", "xyzwvugh", "xyzwvuth"]
    rows = [person(f"t{k}", w, ["omar"]) for k, w in enumerate(chain)]
    for d in range(20):  # an only name, and two spellings of one
        rows += [person("a", "danghi", ["ali"], doc=f"e{d}"), person("b", "toufas", ["ali"], doc=f"e{d}"), person("c", "tuofas", [], ["a"], doc=f"e{d}")]
    entered, links = [], names.links

    def counted(profiles_):
        entered.append(profiles_.count())
        return links(profiles_)

    monkeypatch.setattr(names, "links", counted)
    assert placed(spark, rows) == sorted([[f"t{k}" for k in range(8)]] + [["a"], ["b", "c"]] * 20)
    assert entered[0] == 68 and len(entered) > 2 and max(entered[2:]) <= 8
    monkeypatch.setattr(names, "MOST_HOMES", -1)  # the same without a broadcast
    assert placed(spark, rows) == sorted([[f"t{k}" for k in range(8)]] + [["a"], ["b", "c"]] * 20)


def test_a_block_gives_two_options_of_many():
    full = [names.Member(k, True, [frozenset([f"g{k}"])], [], []) for k in range(50)]
    bare = names.Member(99, True, [], [], [])
    assert sum(x[2] == "fits" for x in names.links_of_block("person", [*full, bare])) == 2
    equal = [names.Member(k, True, [frozenset(["omar"])], [], []) for k in range(50)]
    assert len(names.links_of_block("person", equal)) == 2 * 49


def test_pairs_of_a_large_group_meet_once(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PART", 7)
    rows = [(1, i, "ab"[i % 2]) for i in range(60)] + [(2, 100, "a"), (2, 101, "b"), (3, 102, "a"), (3, 103, "a")]
    out = [tuple(r) for r in pairs.differing_pairs(spark.createDataFrame(rows, "g int, id bigint, raw string"), ["g"], []).collect()]
    assert len(out) == len(set(out)) and set(out) == {(i, j) for g, i, a in rows for h, j, b in rows if g == h and i < j and a != b}
