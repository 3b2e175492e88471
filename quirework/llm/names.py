"""Linking the spellings of persons, organisations and ministries by merge-and-rematch.

A mention is parsed into a distinctive part (family or company name), qualifiers (given names; the trade of a company;
the field of a ministry), initials and titles. Which words qualify is learned: words that stand in the mentions of a
set share of all bulletins. Short forms of given names are learned too: a word that keeps company with one given name
beside the same family name, far more often than with any other.

A profile holds spellings, sets of qualifiers and initials. It enters a block for each of its spellings and for each spelling
of the bulletin that is close to one of them. Profiles match within blocks, matched profiles merge, the union of their
spellings, qualifiers and initials enters blocking again, and so on until a round merges nothing. Evidence goes by strength:
the same qualifiers (a set within the other); then, for a profile without qualifiers, abbreviations, initials or a bare name
that fit one full profile alone; at last, where no full profile is near, abbreviations and bare names among themselves. Ministries
go through the same rounds, blocked by the words of their field. Rounds are DataFrame jobs; a block is what has one spelling, or
one like it, in one bulletin, each distinct form once, so its size follows from the number of forms, not of rows. The profiles of one
kind in one bulletin (its home) meet no others, so a home in which a round merges nothing is done, and later rounds leave it out.

Labels don't matter. Null, empty and numeric mentions link to nothing. Copies of a spelling share its profile. A mention of
qualifiers alone, or of a field that fits several ministries, has the cluster of its own folded form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.confusables import needs_form, one_form
from quirework.llm.pairs import differing_pairs
from quirework.sources.tables import cut, table

#: Least share of bulletins (and least number) in whose mentions a qualifying word stands.
COMMON_SHARE = 0.012
COMMON_LEAST = 4
#: A short form stands beside its given name in this share of its families, and this many times.
SHORT_SHARE = 0.2
SHORT_LEAST = 2

#: Forms of address, company words and legal forms, ministry words, particles.
TITLES = {"m", "mr", "mme", "mlle", "me", "dr", "pr", "maitre", "docteur", "monsieur", "madame", "السيد", "السيدة", "الاستاذ", "الدكتور", "السيده"}
COMPANY = {"societe", "ste", "groupe", "compagnie", "cie", "شركة", "شركه", "ش", "مجموعة", "مؤسسة"}
LEGAL = {"sa", "sarl", "sas", "snc", "شمم", "dite", "dit", "مم", "م"}
MINISTRY = {"ministere", "min", "ministeriel", "departement", "وزارة", "وزاره", "الوزارة", "المكلفة", "الوزاره", "المكلفه"}
PARTICLES = {"eddine", "ben", "bin", "بن", "ابن", "el", "al", "ould", "ait", "bent", "بنت"}
STOP = {"de", "la", "le", "les", "du", "des", "et", "l", "d", "en", "a", "aux", "ة"}

ARABIC = re.compile(r"[؀-ۿ]")
WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"\d")
#: Legal forms written with dots.
SARL_ARABIC = re.compile(r"\b(?:ش\s*\.\s*)?م\s*\.\s*م\b\.?")
SARL = re.compile(r"\bs\.\s?a\.\s?r\.\s?l\b\.?")
SA = re.compile(r"\bs\.\s?a\b\.?(?!\w)")


class _Plain(dict):
    """What each character is folded to, found once: marks go and letters keep their order, so a text is folded character by character."""

    INTERCHANGED = str.maketrans("أإآٱىة", "اااايه", "ـ")

    def __missing__(self, code: int) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        self[code] = plain = plain.translate(self.INTERCHANGED)
        return plain


PLAIN = _Plain()


def fold(text: str) -> str:
    """Lower case without accents; Arabic letters that people interchange as one."""
    plain = (one_form(text) if needs_form(text) else text).lower()
    return plain if plain.isascii() else plain.translate(PLAIN)


def close(a: str, b: str) -> bool:
    """At most one edit apart, swaps of neighbours included; two in words of nine letters and more."""
    if a == b:
        return True
    most = 2 if min(len(a), len(b)) >= 9 else 1
    if abs(len(a) - len(b)) > most or min(len(a), len(b)) < 4:
        return False
    # what both begin and end with alike needs no edit
    i, j, k = 0, len(a), len(b)
    while i < j and i < k and a[i] == b[i]:
        i += 1
    while j > i and k > i and a[j - 1] == b[k - 1]:
        j, k = j - 1, k - 1
    longer = max(j, k) - i
    if longer <= most:
        return True
    if most == 1:
        return longer == 2 and j == k and a[i] == b[i + 1] and a[i + 1] == b[i]
    return distance(a[i:j], b[i:k], most) <= most


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, swaps of neighbours included; most + 1 if there are more."""
    before, last = list(range(len(b) + 1)), []
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, last[j - 2] + 1)
            row.append(c)
        if min(row) > most:
            return most + 1
        last, before = before, row
    return before[-1]


@dataclass
class Parsed:
    """Words of a mention in order, and what its marks say."""

    words: list[str] = field(default_factory=list)
    short: list[str] = field(default_factory=list)
    title: bool = False
    company: bool = False
    ministry: bool = False
    waw: bool = False


TITLE_FOLDED = {fold(w) for w in TITLES}
COMPANY_FOLDED = {fold(w) for w in COMPANY}
LEGAL_FOLDED = {fold(w) for w in LEGAL}
MINISTRY_FOLDED = {fold(w) for w in MINISTRY}
PARTICLE_FOLDED = {fold(w) for w in PARTICLES}


@lru_cache(maxsize=100_000)
def _like_ben(word: str) -> bool:
    return distance(word, "ben", 1) < 2


def parse(text: str) -> Parsed | None:
    """The parts of a mention; null for what has digits or no letters."""
    plain = fold(text)
    if DIGIT.search(plain) or not WORD.search(plain):
        return None
    out = Parsed()
    if "." in plain:
        if "م" in plain:
            plain = SARL_ARABIC.sub(" شمم ", plain.replace("ش.م.م", " شمم "))
        if "s." in plain:
            plain = SA.sub(" sa ", SARL.sub(" sarl ", plain))
    plain = plain.replace("السيد(ه)", " السيد ")
    tokens = [(m.group(), plain[m.end() : m.end() + 1] == ".") for m in WORD.finditer(plain)]
    for k, (w, dot) in enumerate(tokens):
        first = k == 0
        if w in MINISTRY_FOLDED:
            out.ministry = True
        elif first and w == "و" and dot:  # a ministry if the words of a field follow, else an initial
            out.waw = True
        elif w in COMPANY_FOLDED and (w != "ش" or dot) or w in LEGAL_FOLDED:
            out.company = True
        elif w in TITLE_FOLDED and (first or len(w) > 2) and len(tokens) > 1 and not (w == "m" and dot and not first):
            out.title = True
        elif w in STOP or w in PARTICLE_FOLDED or (len(w) < 5 and not dot and _like_ben(w)):
            continue
        elif dot and len(w) <= 6 and len(tokens) > 1:
            out.short.append(w)
        elif len(w) == 1 and len(tokens) > 1:
            continue
        else:
            out.words.append(w)
    return out if out.words or out.short else None


#: Spellings of one sound in names written in Latin letters, in this order.
SOUNDS = [("ou", "u"), ("oo", "u"), ("w", "u"), ("sh", "ch"), ("ph", "f")]


def sound(word: str) -> str:
    """A word by its sounds, so that ways of writing it in Latin letters meet."""
    for written, one in SOUNDS:
        word = word.replace(written, one)
    return word


def bare(word: str) -> str:
    """A family name without the particle written together with it."""
    for particle in ("ben", "بن"):
        if word.startswith(particle) and len(word) >= len(particle) + 4:
            return word[len(particle) :]
    return word


MENTION = "doc_id string, text string, n bigint, words array<string>, short array<string>, company boolean, ministry boolean, waw boolean"


def mentions(rows: DataFrame) -> DataFrame:
    """The distinct mentions (doc_id, text, n, parts) of rows (doc_id, text)."""
    distinct = rows.where("text IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.count("*").alias("n"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, names_ = pa.list_(pa.string()), ["doc_id", "text", "n", "words", "short", "company", "ministry", "waw"]
        for batch in batches:
            parsed = [parse(text) for text in batch.column("text").to_pylist()]
            own = [p for p in parsed if p is not None]
            kept = batch.filter(pa.array([p is not None for p in parsed], pa.bool_()))
            parts = [pa.array([p.words for p in own], strings), pa.array([p.short for p in own], strings), *(pa.array([getattr(p, x) for p in own], pa.bool_()) for x in names_[5:])]
            yield pa.RecordBatch.from_arrays([*(kept.column(x) for x in names_[:3]), *parts], names=names_)

    return distinct.mapInArrow(split, MENTION)


@dataclass(frozen=True)
class Lexicon:
    """Qualifying words, given names and trades, with what each stands for; the words of ministries' fields."""

    given: dict[str, str]
    trades: dict[str, str]
    fields: frozenset[str] = frozenset()

    def index(self) -> dict[str, list[tuple[str, str]]]:
        """Qualifying words by each of them with up to one letter left out, two in long words; and, marked, by their sound."""
        out: dict[str, list[tuple[str, str]]] = {}
        for x in sorted(self.given):
            if self.given[x] == x and len(x) > 3:
                out.setdefault("~" + sound(x), []).append(("given", x))
        for kind, group in (("trade", self.trades), ("given", self.given)):
            for x in group:
                if len(x) > 4:
                    for hole in _holes(x):
                        out.setdefault(hole, []).append((kind, x))
        return out

    def qualifier(self, word: str, index: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
        """('given' or 'trade', canonical word) of a qualifying word, or of one that is close to it."""
        if word in self.trades:
            return "trade", self.trades[word]
        if word in self.given:
            return "given", self.given[word]
        near = {kx for kx in {kx for hole in _holes(word) if hole in index for kx in index[hole]} if close(kx[1], word)} or set(index.get("~" + sound(word), ()))
        if not near:
            return None
        kind, x = min(near, key=lambda kx: (distance(kx[1], word, 2), kx[1]))
        return kind, (self.given if kind == "given" else self.trades)[x]


def _holes(word: str) -> set[str]:
    one = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
    return one if len(word) < 9 else one | {w[:i] + w[i + 1 :] for w in one for i in range(len(w))}


def _bounded(rows: DataFrame, bound: int, what: str) -> list:
    """Collected rows, refused beyond a bound."""
    found = rows.limit(bound + 1).collect()
    if len(found) > bound:
        raise ValueError(f"more than {bound} {what}")
    return found


#: Most qualifying words; a word stands in COMMON_SHARE of the bulletins, so there are at most (distinct words a bulletin) / COMMON_SHARE.
MOST_WORDS = 100_000


def _near(words: list[str]) -> dict[str, list[str]]:
    """The close words of each word, found by the words with letters left out that they share."""
    index: dict[str, list[str]] = {}
    for w in words:
        for hole in _holes(w):
            index.setdefault(hole, []).append(w)
    return {w: sorted({x for hole in _holes(w) for x in index[hole] if x != w and close(x, w)}) for w in words}


def lexicon(parsed: DataFrame) -> Lexicon:
    """Qualifying words of all mentions."""
    parts = parsed.select("doc_id", "company", "ministry", F.explode("words").alias("word"))
    bulletins = parsed.where("NOT ministry").select("doc_id").distinct().count()
    least = max(COMMON_LEAST, COMMON_SHARE * bulletins)
    common = (
        parts.groupBy("ministry", "word")
        .agg(F.countDistinct("doc_id").alias("bulletins"), F.avg(F.col("company").cast("double")).alias("company"), F.count("*").alias("n"))
        .where((F.col("bulletins") >= least) | (F.col("ministry") & (F.col("bulletins") >= COMMON_LEAST) & (F.col("bulletins") >= COMMON_SHARE * bulletins / 4)))
    )
    every = _bounded(common, MOST_WORDS, "qualifying words")
    rows = [r for r in every if not r["ministry"]]
    fields = frozenset(_field(r["word"]) for r in every if r["ministry"])
    trades = frozenset(r["word"] for r in rows if r["company"] >= 0.3)
    given = {r["word"]: r["word"] for r in rows if r["company"] < 0.3}
    number = {r["word"]: r["n"] for r in rows}
    for g, h in _short_forms(parsed, frozenset(given)).items():
        given[g] = h
    # a common misspelling stands for the name it resembles
    for g, close_words in _near(sorted(given)).items():
        if given[g] == g:
            near = [x for x in close_words if number.get(x, 0) > 3 * number.get(g, 0) and len(x) > 3 and x[0] == g[0]]
            if near:
                given[g] = max(near, key=lambda x: (number[x], x))
    for g in list(given):  # a misspelling of a short form
        seen = {g}
        while given.get(given[g], given[g]) != given[g] and given[g] not in seen:
            seen.add(given[g])
            given[g] = given[given[g]]
    # a trade may be written without some of its letters
    ends: dict[tuple[str, str], list[str]] = {}
    for t in trades:
        ends.setdefault((t[0], t[-1]), []).append(t)
    whole = {
        t: max((x for x in ends[t[0], t[-1]] if len(x) >= len(t) + 3 and number[x] > 3 * number[t] and _within(t, x)), key=lambda x: (number[x], x), default=t)
        for t in trades
    }
    return Lexicon(given, whole, fields)


def _short_forms(parsed: DataFrame, known: frozenset[str]) -> dict[str, str]:
    """Given names that are short forms, and of what: they stand beside another one's families far more often than beside any third."""
    shared = parsed.sparkSession.sparkContext.broadcast(known)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for doc, words in zip(batch["doc_id"], batch["words"], strict=True):
                g, f = sorted(w for w in words if w in known), [w for w in words if w not in known]
                if len(f) == 1 and 1 <= len(g) <= 2:
                    out.append((doc, " ".join(g), f[0]))
            yield pd.DataFrame(out, columns=["doc_id", "g", "f"])

    two = parsed.where("NOT ministry AND NOT company AND size(words) BETWEEN 2 AND 3").select("doc_id", "words")
    pairs = cut(two.mapInPandas(split, "doc_id string, g string, f string").distinct())
    # beside one family of a bulletin stand at most as many forms as there are qualifying words and pairs of them
    beside = pairs.join(pairs.withColumnRenamed("g", "h"), ["doc_id", "f"]).where("g <> h AND NOT contains(g, ' ')").groupBy("g", "h").agg(F.count("*").alias("n"))
    alone = pairs.groupBy("g").agg(F.count("*").alias("all"))
    judged = beside.where(F.col("n") >= SHORT_LEAST).join(alone, "g").join(alone.select(F.col("g").alias("h"), F.col("all").alias("all_h")), "h").where("all_h > 2.5 * all")
    order = Window.partitionBy("g").orderBy(F.desc("n"), "h")
    best = judged.withColumn("second", F.lead("n", 1, 0).over(order)).withColumn("k", F.row_number().over(order))
    best = best.where((F.col("k") == 1) & (F.col("n") >= SHORT_SHARE * F.col("all")) & (F.col("n") >= 2 * F.col("second"))).select("g", "h")
    return {r["g"]: r["h"] for r in _bounded(best, MOST_WORDS, "short forms")}


def _within(short: str, long: str) -> bool:
    """Whether the letters of a word stand in a longer one, in order."""
    letters = iter(long)
    return all(c in letters for c in short)


def _field(word: str) -> str:
    """A word of a ministry's field without what is written together with it."""
    return re.sub(r"^(?:و?ا+ل|بال|وا?ل|ب|لل)(?=\w{3})", "", word)


PROFILE = "doc_id string, text string, kind string, family string, given array<string>, short array<string>"


def profiles(parsed: DataFrame, known: Lexicon) -> DataFrame:
    """Each mention with its kind, distinctive part (of a ministry: its field in one word) and qualifiers (of a ministry: the words of its field)."""
    shared = parsed.sparkSession.sparkContext.broadcast(known)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, {}
        index = known.index()
        for batch in batches:
            out = []
            for words, short, company, ministry, waw in zip(*(batch.column(c).to_pylist() for c in ("words", "short", "company", "ministry", "waw")), strict=True):
                fields = [_field(w) for w in words] if ministry or waw else []
                if ministry or (waw and fields and all(f in known.fields for f in fields)):
                    out.append(("ministry", "".join([*fields[:1], *words[1:]]), sorted(set(fields)), sorted(set(short))))
                    continue
                if waw:
                    short.append("و")
                given, trades, rest, unsure = [], [], [], []
                for w in words:
                    if w not in seen:
                        seen[w] = known.qualifier(w, index) or (known.qualifier(bare(w), index) if bare(w) != w else None)
                    q = seen[w]
                    (rest if q is None else given if q[0] == "given" else trades).append(w if q is None else q[1])
                    if q is not None and q[0] == "given" and w not in known.given:
                        unsure.append((w, q[1]))
                long = [w for w in rest if len(w) > 3]
                rest = long or rest
                kind = "company" if company or trades else "person"
                if kind == "company" and given and not rest:
                    rest, given = given, []
                if len(rest) > 1:  # a name broken by a blank, or a rare given name before a family name
                    rest = [max(rest, key=len)] if kind == "person" and given else ["".join(rest)] if kind == "company" else [rest[-1]]
                if not rest and unsure and kind == "person":  # what resembles a given name is a family name here
                    rest = [unsure[-1][0]]
                    given.remove(unsure[-1][1])
                if not rest and len(given) > 1 and kind == "person":
                    rest, given = given[-1:], given[:-1]
                if not rest:
                    out.append(("other", " ".join(sorted(words + short)), [], []))
                    continue
                qualifiers = trades if kind == "company" else [p for g in given for p in g.split(" ")]
                out.append((kind, bare(rest[0]), sorted(set(qualifiers)), sorted(set(short))))
            parts = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *parts], names=["doc_id", "text", "kind", "family", "given", "short"])

    return parsed.mapInArrow(build, PROFILE)


def _left_out(c: F.Column) -> F.Column:
    """A word, and the word with each one of its letters left out."""
    return F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))))


#: Spellings of a home that are compared each with each; a home of more goes by words with letters left out.
EACH = 100


def near_spellings(spellings: DataFrame) -> DataFrame:
    """(sid, near): for each spelling (sid, home, word) the close ones of the same home, both ways.

    Few spellings of a home are compared each with each as they come by; of more, only those that share a key (see _keyed_pairs)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own, many = None, [], False
        for batch in batches:
            pairs, passed = [], []
            for sid, home, word in zip(*(batch.column(c).to_pylist() for c in ("sid", "home", "word")), strict=True):
                if home != here:
                    pairs += [] if many else _near_pairs(own)
                    here, own, many = home, [], False
                own.append((sid, home, word))
                if many or len(own) > EACH:
                    passed += own
                    own, many = [], True
            yield rows(pairs, passed)
        yield rows(_near_pairs(own), [])

    def rows(pairs: list[tuple[int, int]], passed: list[tuple[int, int, str]]) -> pa.RecordBatch:
        sid, near = [p[0] for p in pairs] + [p[0] for p in passed], [p[1] for p in pairs] + [None] * len(passed)
        home, word = [None] * len(pairs) + [p[1] for p in passed], [None] * len(pairs) + [p[2] for p in passed]
        return pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(near, pa.int64()), pa.array(home, pa.int64()), pa.array(word, pa.string())], names=["sid", "near", "home", "word"])

    by_home = spellings.where(F.length("word") > 3).select("sid", F.col("home").cast("bigint").alias("home"), "word").repartition("home").sortWithinPartitions("home")
    both = cut(by_home.mapInArrow(compare, "sid bigint, near bigint, home bigint, word string"))
    found, large = both.where("near IS NOT NULL").select("sid", "near"), both.where("near IS NULL").select("sid", "home", "word")
    if large.isEmpty():
        return found
    more = _keyed_pairs(large)
    return found.unionByName(more).unionByName(more.select(F.col("near").alias("sid"), F.col("sid").alias("near")))


def _letters(word: str) -> int:
    """A bit for each letter."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def _near_pairs(spellings: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The close ones of a few spellings, both ways. An edit changes at most two letters of the set of a word's letters."""
    out = []
    if len(spellings) < 2:
        return out
    ready = [(sid, w, len(w), _letters(w), sound(w)) for sid, _, w in spellings]
    ready = [(sid, w, n, bits, heard, bits if heard == w else _letters(heard)) for sid, w, n, bits, heard in ready]
    for k, (sid, a, n, bits, heard, heard_bits) in enumerate(ready):
        for other, b, m, other_bits, other_heard, other_heard_bits in ready[:k]:
            if (-3 < n - m < 3 and (bits ^ other_bits).bit_count() < 5 and close(a, b)) or ((heard_bits ^ other_heard_bits).bit_count() < 5 and close(heard, other_heard)):
                out += [(sid, other), (other, sid)]
    return out


def _keyed_pairs(spellings: DataFrame) -> DataFrame:
    """(sid, near): close spellings of a home, found by keys.

    Words at most one edit apart, swaps included, share a word with one letter left out; from nine letters on two may be left
    out. So do words that sound alike, by their sounds. What shares one is compared letter by letter. Letters are few, so what
    shares one key is bounded by the alphabet and the length of a word."""
    heard = F.col("word")
    for written, one in SOUNDS:
        heard = F.replace(heard, F.lit(written), F.lit(one))
    keyed = spellings.withColumn("heard", heard)
    once = F.array_distinct(F.concat(_left_out(F.col("word")), _left_out(F.col("heard"))))
    twice = F.when(F.length("word") >= 9, F.flatten(F.transform(once, _left_out))).otherwise(once)
    keys = keyed.select("sid", F.explode(F.array_distinct(F.transform(twice, lambda x: F.xxhash64("home", x)))).alias("key"))
    pairs = keys.join(keys.select("key", F.col("sid").alias("other")), "key").where("sid < other").select("sid", "other").distinct()
    named = pairs.join(spellings.select("sid", F.col("word").alias("a")), "sid").join(spellings.select(F.col("sid").alias("other"), F.col("word").alias("b")), "other")

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([close(x, y) or close(sound(x), sound(y)) for x, y in zip(a, b, strict=True)], dtype=bool)

    return cut(named.where(alike("a", "b")).select("sid", F.col("other").alias("near")))


def first_profiles(own: DataFrame) -> DataFrame:
    """(pid, home, kind, spellings, near, given, short, members) of each distinct form (kind, family, given, short) of a bulletin.

    spellings and near are numbers of (doc_id, kind, word); those of a ministry are the words of its field and the beginning and end of the
    field in one word."""
    joined = F.col("family")
    words = F.when(F.col("kind") == "ministry", F.concat("given", F.array(F.concat(F.lit("^"), F.left(joined, F.lit(6))), F.concat(F.right(joined, F.lit(6)), F.lit("$"))))).otherwise(F.array(joined))
    number = lambda w: F.xxhash64("doc_id", "kind", w)
    home = F.xxhash64("doc_id", "kind").alias("home")
    forms = own.select("doc_id", "kind", "family", "given", "short", form_number().alias("pid")).distinct()
    forms = cut(forms.select("pid", home, "doc_id", "kind", "family", words.alias("words"), F.array(F.array_join("given", " ")).alias("given"), F.array(F.array_join("short", " ")).alias("short")))
    parts = forms.where("kind <> 'other'").select("pid", "home", "doc_id", "kind", F.explode("words").alias("word"))
    spelt = parts.select(number("word").alias("sid"), "home", "word").where("NOT (startswith(word, '^') OR endswith(word, '$'))").distinct()
    near = parts.select("pid", number("word").alias("sid")).join(near_spellings(spelt), "sid").groupBy("pid").agg(F.collect_set("near").alias("near"))
    none = F.array().cast("array<bigint>")
    kept = lambda c: F.filter(F.col(c), lambda x: x != "")
    return forms.join(near, "pid", "left").select(
        "pid", "home", "kind", F.transform("words", number).alias("spellings"), F.coalesce("near", none).alias("near"), kept("given").alias("given"), kept("short").alias("short"), F.when(F.col("kind") == "ministry", F.array("family")).otherwise(F.array().cast("array<string>")).alias("joined"),
        F.array("pid").alias("members"),
    )


def form_number() -> F.Column:
    """The number of a form, from columns doc_id, kind, family, given and short."""
    return F.xxhash64("doc_id", "kind", "family", F.array_join("given", " "), F.array_join("short", " "))


@dataclass
class Member:
    """A profile in a block; own: it has the block's spelling itself, not one near it."""

    pid: int
    own: bool
    given: list[frozenset[str]]
    short: list[tuple[str, ...]]
    joined: list[str]


def _abbreviates(short: tuple[str, ...], given: frozenset[str]) -> bool:
    """Whether shortened words fit a set of qualifiers: each begins one."""
    return all(any(g.startswith(s) for g in given) for s in short)


def _agree(s: tuple[str, ...], t: tuple[str, ...]) -> bool:
    """Whether each shortened word begins one of the other's, or the other way round."""
    return all(any(x.startswith(y) or y.startswith(x) for y in t) for x in s)


Link = tuple[int, int, str, int]


def links_of_block(kind: str, members: list[Member]) -> list[Link]:
    """(from, to, what, distance) of the profiles of a block of which at least one of two has its spelling.

    what: 'same' (the same one, both ways), 'fits' (to is a full profile that from, without qualifiers, fits, by the same spelling), 'near' (so, by
    a close spelling), 'part' (to is a ministry of which from is a part), 'known' (to is a full profile near from), 'short' (to has
    initials and no qualifiers, and is near from), 'alike' (neither has qualifiers, and they agree). Of 'fits' and 'near', two
    decide as much as more, so two are given of each."""
    if kind == "ministry":
        return _ministry_links(members)
    out: list[Link] = []
    hubs: dict[frozenset[str], int] = {}
    for m in members:
        if m.own:
            for g in m.given:
                hubs[g] = min(m.pid, hubs.get(g, m.pid))
    full, rest = [m for m in members if m.given], [m for m in members if not m.given]
    for m in full:
        found = set()
        for g in m.given:
            if len(g) <= 4:
                names_ = sorted(g)
                parts = [frozenset(n for k, n in enumerate(names_) if bits >> k & 1) for bits in range(1, 1 << len(names_))]
                found |= {hubs[x] for x in parts if x in hubs}
            else:
                found |= {h for x, h in hubs.items() if x <= g}
        for h in found - {m.pid}:
            out += [(m.pid, h, "same", 0), (h, m.pid, "same", 0)]
    for p in rest:
        left = {"fits": 2, "near": 2}
        for q in full:
            if not (p.own or q.own):
                continue
            if len(left) == 2 and left["fits"] == left["near"] == 2:
                out.append((p.pid, q.pid, "known", 0))
            what = "fits" if p.own and q.own else "near"
            if left[what] and all(any(_abbreviates(s, g) for g in q.given) for s in p.short):
                left[what] -= 1
                out.append((p.pid, q.pid, what, 0))
            if not any(left.values()):
                break
        shorts = 2
        for q in rest:
            if not (p.own or q.own):
                continue
            if q.short and shorts:
                shorts -= 1
                out.append((p.pid, q.pid, "short", 0))
            if p.pid != q.pid and p.short and q.short and q.pid < p.pid and any(_agree(s, t) or _agree(t, s) for s in p.short for t in q.short):
                out.append((p.pid, q.pid, "alike", 0))
            elif not p.short and (q.short or q.pid < p.pid) and p.pid != q.pid:
                out.append((p.pid, q.pid, "bare", 0))
    return out


def _fits_field(a: frozenset[str], short: list[tuple[str, ...]], b: frozenset[str]) -> bool:
    """Whether the words and shortened words of a field are words of another."""
    return all(any(close(x, y) for y in b) for x in a) and all(_abbreviates(s, b) for s in short)


def _ministry_links(members: list[Member]) -> list[Link]:
    out: list[Link] = []
    for p in members:
        for q in members:
            if p.pid == q.pid or not (p.own or q.own):
                continue
            if p.pid > q.pid and any(len(g) == len(t) and _fits_field(g, [], t) for g in p.given for t in q.given if g):
                out += [(p.pid, q.pid, "same", 0), (q.pid, p.pid, "same", 0)]
            elif p.pid > q.pid and any(distance(a, b, min(3, len(a) // 4)) <= min(3, len(a) // 4) for a in p.joined for b in q.joined if a and b):
                out += [(p.pid, q.pid, "same", 0), (q.pid, p.pid, "same", 0)]
            else:
                large, small = max(map(len, q.given), default=0), max(map(len, p.given), default=0)
                if large > small and any(_fits_field(g, p.short, t) for g in p.given or [frozenset()] for t in q.given if len(t) > len(g)):
                    far = min((distance(a, b, 30) for a in p.joined for b in q.joined), default=30)
                    out.append((p.pid, q.pid, "part" if small > 1 else "fits", far))
    return out


@lru_cache(maxsize=100_000)
def _sets(written: str) -> list[frozenset[str]]:
    return [frozenset(g.split(" ")) for g in written.split("|")] if written else []


@lru_cache(maxsize=100_000)
def _tuples(written: str) -> list[tuple[str, ...]]:
    return [tuple(s.split(" ")) for s in written.split("|")] if written else []


def links(profiles_: DataFrame) -> DataFrame:
    """(home, pid, to, what, far): the links of all blocks. Blocks come one after the other in sorted partitions.

    What a profile holds crosses to Python as text, its parts between bars (words are letters alone)."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kind, home, rows = None, "", 0, []
        for batch in batches:
            out: list[tuple[int, Link]] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "home", "pid", "own", "given", "short", "joined")), strict=True):
                if row[0] != key:
                    if len(rows) > 1:
                        out += [(home, x) for x in linked(kind, rows)]
                    key, kind, home, rows = row[0], row[1], row[2], []
                rows.append(row[3:])
            yield columns(out)
        yield columns([(home, x) for x in linked(kind, rows)] if len(rows) > 1 else [])

    def linked(kind: str, rows: list[tuple]) -> list[Link]:
        return links_of_block(kind, [Member(pid, own, _sets(given), _tuples(short), joined.split("|") if kind == "ministry" else []) for pid, own, given, short, joined in rows])

    def columns(out: list[tuple[int, Link]]) -> pa.RecordBatch:
        parts = [pa.array([h for h, _ in out], pa.int64()), *(pa.array([x[k] for _, x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int32())))]
        return pa.RecordBatch.from_arrays(parts, names=["home", "pid", "to", "what", "far"])

    places = F.concat(
        F.transform("spellings", lambda x: F.struct(x.alias("block"), F.lit(True).alias("own"))),
        F.transform(F.array_except("near", "spellings"), lambda x: F.struct(x.alias("block"), F.lit(False).alias("own"))),
    )
    written = [F.array_join(c, "|").alias(c) for c in ("given", "short", "joined")]
    rows = profiles_.where("kind <> 'other'").select("kind", "home", "pid", *written, F.explode(places).alias("at")).select("at.block", "at.own", "kind", "home", "pid", "given", "short", "joined")
    return rows.repartition("block").sortWithinPartitions("block", "pid").mapInArrow(match, "home bigint, pid bigint, to bigint, what string, far int")


def merged_into(found: DataFrame) -> DataFrame:
    """(home, pid, to): what each profile merges into by the links found. In a home where no full profile merges any more, profiles
    without qualifiers merge among themselves."""
    of = lambda what: F.collect_set(F.when(F.col("what") == what, F.col("to")))
    least = lambda what: F.min(F.when(F.col("what") == what, F.col("to")))
    own = found.groupBy("pid").agg(
        F.first("home").alias("home"), least("same").alias("same"), of("fits").alias("fits"), of("near").alias("near"), of("short").alias("short"), least("alike").alias("alike"),
        F.count_if(F.col("what") == "known").alias("known"), F.min(F.when(F.col("what") == "part", F.struct("far", "to"))).alias("part"), least("bare").alias("bare"),
    )
    one = F.when(F.size("fits") == 1, F.col("fits")[0]).when((F.size("fits") == 0) & (F.size("near") == 1), F.col("near")[0])
    full = F.coalesce(F.when(F.col("same") < F.col("pid"), F.col("same")), F.when(F.col("same").isNull(), F.coalesce(F.col("part")["to"], one)))
    among = F.when(F.col("known") + F.size("fits") + F.size("near") == 0, F.coalesce("alike", F.when(F.size("short") <= 1, F.col("bare"))))
    either = own.select("home", "pid", full.alias("full"), among.alias("among")).where("full IS NOT NULL OR among IS NOT NULL")
    alone = F.max("full").over(Window.partitionBy("home")).isNull()
    return either.select("home", "pid", F.when(alone, F.col("among")).otherwise(F.col("full")).alias("to")).where("to IS NOT NULL")


def merge(profiles_: DataFrame, into: DataFrame) -> DataFrame:
    """The profiles with those merged that go to one, spellings, qualifiers and initials united."""
    into = into.select("pid", "to")
    further = into.join(into.select(F.col("pid").alias("to"), F.col("to").alias("end")), "to", "left").select("pid", F.coalesce("end", "to").alias("to"))
    moved = profiles_.join(further, "pid", "left").withColumn("pid", F.coalesce("to", "pid"))
    united = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("spellings", "near", "given", "short", "joined", "members")]
    return moved.groupBy("pid").agg(F.first("home").alias("home"), F.first("kind").alias("kind"), *united).select(profiles_.columns)


#: Most homes whose numbers are broadcast; more are joined by a shuffle.
MOST_HOMES = 100_000


def resolve(own: DataFrame) -> DataFrame:
    """(form, cluster) of each form: rounds of blocking, matching and merging, in each home until none merges.

    The first round merges in most homes, so all of them enter the second; from then on only those in which the last round merged."""
    placed = lambda profiles_: profiles_.select(F.explode("members").alias("form"), F.col("pid").alias("cluster"))
    open_, done, first = cut(first_profiles(own)), [], True
    while True:
        into = cut(merged_into(links(open_)))
        if into.isEmpty():
            break
        if not first:
            homes = into.select("home").distinct()
            homes = F.broadcast(homes) if homes.count() <= MOST_HOMES else homes
            done.append(placed(open_.join(homes, "home", "left_anti")))
            open_ = open_.join(homes, "home", "left_semi")
        open_, first = cut(merge(open_, into)), False
    return reduce(DataFrame.unionByName, done, placed(open_))


def numbered_clusters(rows: DataFrame) -> DataFrame:
    """(doc_id, text, cluster) of the distinct mentions of rows (doc_id, text); a cluster has the number of one of its forms."""
    parsed = cut(mentions(rows))
    own = cut(profiles(parsed, lexicon(parsed)))
    placed = own.select("doc_id", "text", form_number().alias("form")).join(resolve(own), "form")
    return placed.select("doc_id", "text", "cluster")


def clusters(rows: DataFrame) -> DataFrame:
    """(doc_id, text, cluster) of the distinct mentions of rows (doc_id, text)."""
    return numbered_clusters(rows).withColumn("cluster", F.col("cluster").cast("string"))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """(id, doc_id, text) of the entities that may be names: those without digits."""
    home = table(spark, folder, "articles").select(F.col("id").alias("article_id"), "doc_id")
    named = table(spark, folder, "entities").select("id", "article_id", "text").where(~F.col("text").rlike(r"[0-9\x{660}-\x{669}\x{FF10}-\x{FF19}]"))
    return cut(named.join(home, "article_id").select("id", "doc_id", "text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows of a bulletin that name the same one by different texts."""
    rows = _rows(spark, folder)
    placed = rows.join(numbered_clusters(rows), ["doc_id", "text"])
    return differing_pairs(cut(placed.select("cluster", "id", F.col("text").alias("raw"))), ["cluster"], [])


def p6_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every mention with the cluster of its bulletin that it belongs to."""
    rows = _rows(spark, folder)
    return rows.join(clusters(rows), ["doc_id", "text"]).select("id", "doc_id", "text", "cluster")


QUERIES = {"p6_found": p6_found, "p6_clusters": p6_clusters}
SQL: dict[str, str] = {}
