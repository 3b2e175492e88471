"""Spans of text: references, dates, institutions, citations, companies; their filters and merges.

A span is struct(label, text, start, end_pos, meta): start and end_pos are code points, half open, from 0; -1 where the text
isn't located. One kernel finds all matches of ordered patterns with offsets; the rest are array expressions.
A null text has an empty array of spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from quirework.functions import fixed
from quirework.functions.text import let, replaced, strip

SPAN = StructType(
    [
        StructField("label", StringType()),
        StructField("text", StringType()),
        StructField("start", IntegerType()),
        StructField("end_pos", IntegerType()),
        StructField("meta", MapType(StringType(), StringType())),
    ]
)
SPANS = ArrayType(SPAN)
Raw = tuple[str, str, int, int, dict[str, str] | None]


def longest_first(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def any_alef(pattern: str) -> str:
    """a pattern in which each alef stands for all its forms."""
    return re.sub("[اأإآ]", "[اأإآٱ]", pattern)


# The forms of references.
N_FR = r"n[°oº]\s?"
NUM_FR = r"\d+(?:[-–.]\d+){1,2}"
DAY_FR = r"\d{1,2}\s+[^\d\s,;.\n()]+\s+\d{3,4}"
BRACKET = r"(?:\s*\([^)]{4,40}\))?"
NEXT_FR = r"(?:[;.]\s+|,\s*(?:[ld][eéa]|l'|d'|du|il|elle|ce)\s|\n)"
TITLE_FR = rf"(?:(?!{NEXT_FR})[^;.\n]){{0,200}}"
CAPITALS = r"[A-Z][A-Z0-9]*(?:\s+[A-Z0-9&'.+-]+)*"
NUMBERS_FR = "cent|deux cents|trois cents|cinq cents|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|douze|quinze|vingt|trente|quarante|cinquante|soixante"
REFERENCES_FR = {
    "DAHIR": rf"[Dd]ahir(?:\s+portant\s+(?:loi\s+)?)?\s*{N_FR}{NUM_FR}(?:\s+du\s+{DAY_FR})?{BRACKET}(?:\s+relative?\s+[àa]{TITLE_FR})?",
    "LOI": rf"[Ll]oi\s+(?:(?:organique|cadre|ordinaire)\s+)?(?:{N_FR})?\s*{NUM_FR}(?:\s+relative?s?\s+[àa]{TITLE_FR})?",
    "DECRET": rf"[Dd][ée]cret\s+(?:{N_FR})?\s*{NUM_FR}(?:\s+relatif\s+[àa]{TITLE_FR})?",
    "ARRETE": rf"[Aa]rr[êe]t[ée](?:\s+susvisé)?(?:\s+{N_FR}{NUM_FR})?(?:\s+conjoint)?(?:\s+du\s+ministre[^,;.\n]{{0,100}}|\s+du\s+{DAY_FR})?",
    "BULLETIN_OFFICIEL": rf"Bulletin\s+officiel\s*»?\s*{N_FR}\d{{3,4}}(?:\s+du\s+{DAY_FR})?{BRACKET}",
    "MONEY": rf"\d{{1,3}}(?:[.\s]\d{{3}})+,\d{{2}}\s*(?:DH|MAD|EUR|USD|euros?|dirhams?|dollars?)|\b(?:{NUMBERS_FR})\s+(?:millions?|milliards?)\s+d['’]?euros?",
    "ORG": (
        r"[Ss]oci[ée]t[ée]\s+«[^»]{2,80}»"
        r"|(?:[Bb]anque|[Oo]rganisme|[Ss]ite|[Ee]ntreprise|[Gg]roupe|[ÉéEe]tablissement|[Uu]niversit[ée]|[Ii]nstitution)\s+«\s*[A-ZÀ-Ü0-9][^»]{1,80}»"
        r"|\bBANK\s+AL-MAGHRIB\b"
        rf"|\b{CAPITALS}\s+(?:CO\.?\s*,\s*(?:LTD|INC|PLC|LLC)\b|CO\b|LTD\b|LLC\b|PLC\b|INC\b|SARL\b|SPA\b|S\.A\.\b|GROUP\b|HOLDINGS\b|PORT\s+AUTHORITY\b|BANK\b(?!\s+[A-Z])|AGENCY\b)"
    ),
}
CIRCULAIRE_FR = rf"[Cc]irculaire\s+(?:{N_FR})?\s*\d+(?:[-–./]\d+){{0,2}}"
D_AR = r"[\d٠-٩]"
NUM_AR = rf"{D_AR}+(?:[.\-–]{D_AR}+){{1,2}}"
HIJRI_DAY_AR = rf"{D_AR}{D_AR}?\s+(?:من\s+)?(?:{any_alef(longest_first(list(fixed.HIJRI_AR)))})\s+{D_AR}{{3,4}}"
GREGORIAN_DAY_AR = rf"{D_AR}{D_AR}?\s+(?:{any_alef(longest_first(list(fixed.GREGORIAN_AR)))})\s+{D_AR}{{4}}"
DAY_OF_AR = rf"{D_AR}\s+من\s+(?:{any_alef(longest_first(list(fixed.GREGORIAN_AR)))})\s+{D_AR}{{4}}"
REFERENCES_AR = {
    "DAHIR": rf"ظهير(?:\s+(?:ال)?شريف)?\s*(?:رقم\s*)?{NUM_AR}(?:\s+(?:ال)?صادر\s+في\s+{HIJRI_DAY_AR})?{BRACKET}",
    "LOI": rf"قانون\s*(?:رقم\s*)?{NUM_AR}(?:\s+يتعلق\s+ب[^,،؛.\n]{{0,80}})?",
    "DECRET": rf"مرسوم\s*(?:رقم\s*)?{NUM_AR}",
    "ARRETE": rf"قرار(?:\s+رقم\s*{NUM_AR})?(?:\s+مشترك)?\s+لوزير[^,،؛.\n]{{0,100}}",
    "CIRCULAIRE": rf"منشور\s*(?:رقم\s*)?{NUM_AR}",
    "BULLETIN_OFFICIEL": rf"الجريدة\s+الرسمية\s*عدد\s*{D_AR}{{3,4}}(?:\s+بتاريخ[^,،؛.\n)]{{4,40}})?{BRACKET}",
    "DATE_HIJRI": HIJRI_DAY_AR,
    "DATE_GREGORIAN": GREGORIAN_DAY_AR,
}
#: Literals of which a match of a pattern has at least one; a text without them isn't searched.
NEEDED = {
    REFERENCES_FR["DAHIR"]: ("ahir",),
    REFERENCES_FR["LOI"]: ("oi",),
    REFERENCES_FR["DECRET"]: ("cret",),
    REFERENCES_FR["ARRETE"]: ("rrêt", "rret"),
    REFERENCES_FR["BULLETIN_OFFICIEL"]: ("Bulletin",),
    REFERENCES_FR["MONEY"]: ("euro", "DH", "MAD", "EUR", "USD", "dirham", "dollar"),
    REFERENCES_FR["ORG"]: ("«", "BANK", "CO", "LTD", "LLC", "PLC", "INC", "SARL", "SPA", "S.A.", "GROUP", "HOLDINGS", "AUTHORITY", "AGENCY"),
    REFERENCES_AR["DAHIR"]: ("ظهير",),
    REFERENCES_AR["LOI"]: ("قانون",),
    REFERENCES_AR["DECRET"]: ("مرسوم",),
    REFERENCES_AR["ARRETE"]: ("لوزير",),
    REFERENCES_AR["CIRCULAIRE"]: ("منشور",),
    REFERENCES_AR["BULLETIN_OFFICIEL"]: ("الجريدة",),
}
INSTITUTION_AR = rf"(?:{longest_first(fixed.INSTITUTIONS_AR)})(?:\s+[ء-ي]+){{0,6}}"
ARTICLE_NO = r"\d+(?:[-–.]\d+)?"
CITATIONS_FR = [
    rf"\bl['’]?article\s+{ARTICLE_NO}\b",
    rf"\barticles\s+{ARTICLE_NO}(?:\s*,\s*{ARTICLE_NO})*(?:\s+et\s+{ARTICLE_NO})?\b",
    rf"\barticles?\s+{ARTICLE_NO}\s+à\s+{ARTICLE_NO}\b",
]
CITATIONS_AR = [
    rf"(?:ال|لل|بال|كال|فال|وال)?مادة\s+(?:{D_AR}+|{any_alef(longest_first(fixed.ORDINALS_AR))})(?:\s+مكرر)?",
    rf"(?:ال|لل|بال|كال|فال|وال)?مواد\s+{D_AR}+\s*(?:[-–إلىو]\s*{D_AR}+)?",
]


@lru_cache(maxsize=256)
def compiled(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, flags)


def possible(pattern: str, text: str) -> bool:
    """Whether a text has what a match of the pattern needs, where that is known."""
    needed = NEEDED.get(pattern)
    if needed is None:
        return True
    for w in needed:
        if w in text:
            return True
    return False


def matches(text: str, patterns: dict[str, str], flags: int = 0) -> list[Raw]:
    """All matches of each pattern, by start, in the order of the patterns."""
    found = [(label, m.group(), m.start(), m.end(), None) for label, p in patterns.items() if flags or possible(p, text) for m in compiled(p, flags).finditer(text)]
    return sorted(found, key=lambda s: s[2])


def swept(spans: list[Raw]) -> list[Raw]:
    """From left to right, the longest at each start, without overlap."""
    out, end = [], -1
    for s in sorted(spans, key=lambda s: (s[2], s[2] - s[3])):
        if s[2] >= end:
            out.append(s)
            end = s[3]
    return out


@lru_cache(maxsize=2)
def date_forms(lang: str) -> list[tuple[str, str, re.Pattern, dict[str, int]]]:
    """(label, calendar, pattern, months) of both calendars. Patterns start with a class, for which they are searched faster."""
    out = []
    tables = ((fixed.GREGORIAN_FR, "gregorian", "4"), (fixed.HIJRI_FR, "hijri", "3,4")) if lang == "fr" else ((fixed.GREGORIAN_AR, "gregorian", "4"), (fixed.HIJRI_AR, "hijri", "3,4"))
    for months, calendar, digits in tables:
        names = longest_first(list(months))
        if lang == "fr":
            pattern = re.compile(rf"(\d(?<!\w\d)\d?)(?:er)?\s+({names})\s+(\d{{{digits}}})\b", re.IGNORECASE)
        else:
            pattern = re.compile(rf"({D_AR}{D_AR}?)\s+(?:من\s+)?({any_alef(names)})\s+({D_AR}{{{digits}}})")
        known = {plain_month(k): v for k, v in months.items()}
        out.append(("DATE_GREGORIAN" if calendar == "gregorian" else "DATE_HIJRI", calendar, pattern, known))
    return out


@lru_cache(maxsize=4096)
def plain_month(name: str) -> str:
    return re.sub("[أإآٱ]", "ا", name.lower())


def dates(text: str, lang: str) -> list[Raw]:
    """Dates with day, month, name of the month, year and calendar."""
    out: list[Raw] = []
    for label, calendar, pattern, known in date_forms(lang):
        for m in pattern.finditer(text):
            day, name, year = m.groups()
            meta = {"day": str(int(day)), "month": str(known[plain_month(name)]), "month_name": name, "year": str(int(year)), "calendar": calendar}
            out.append((label, m.group(), m.start(), m.end(), meta))
    return sorted(out, key=lambda s: s[2])


def references(text: str, lang: str) -> list[Raw]:
    """References, money and organisations."""
    return matches(text, REFERENCES_FR if lang == "fr" else REFERENCES_AR)


def institutions(text: str, lang: str) -> list[Raw]:
    """Arabic institutions: a keyword and up to six words. Keywords are looked up one by one, and the pattern is tried where one stands."""
    if lang != "ar":
        return []
    starts: set[int] = set()
    for word in fixed.INSTITUTIONS_AR:
        at = text.find(word)
        while at >= 0:
            starts.add(at)
            at = text.find(word, at + 1)
    out, end, pattern = [], 0, compiled(INSTITUTION_AR)
    for at in sorted(starts):
        if at >= end and (m := pattern.match(text, at)):
            end = m.end()
            out.append(("INSTITUTION", m.group().strip(), at, end, None))
    return out


def citations(text: str, lang: str) -> list[Raw]:
    """Citations of articles."""
    patterns = CITATIONS_FR if lang == "fr" else CITATIONS_AR
    return swept([s for p in patterns for s in matches(text, {"ARTICLE_CITATION": p}, re.IGNORECASE if lang == "fr" else 0)])


def companies(text: str, lang: str) -> list[Raw]:
    """Names in capitals after 'société' or in quotation marks: two words, or one of six letters."""
    own = r"(?:[Ss]oci[eé]t[eé])\s*[«\"'<]?\s*([A-Z][A-Z\s]{2,60}?)(?=\s*[»\"'>]|\s+(?:Sarl|SARL|SA|S\.A\.)\b|\s[a-z]|[,;:.\n]|$)"
    alone = r"[«\"'<]\s*([A-Z][A-Z\s]{2,60}?)(?=\s*[»\"'>]|\s+(?:Sarl|SARL|SA|S\.A\.)\b)"
    out: list[Raw] = []
    for pattern in (own, alone):
        for m in compiled(pattern).finditer(text):
            name = m.group(1).strip()
            words = name.split()
            if (len(words) > 1 or words and len(words[0]) > 5) and not any(s[2] == m.start(1) or s[1] == name for s in out if pattern is alone):
                out.append(("ORG", name, m.start(1), m.end(1), None))
    return out


#: The ministries known by name, by language: label and phrase.
MINISTRIES = {
    "fr": [*(f"{w} {name}" for w in ("ministère", "ministre") for name in fixed.MINISTRIES_FR), *fixed.SECRETARIATS_FR],
    "ar": fixed.MINISTRIES_AR,
}


def phrase_pattern(phrases: list[str]) -> str:
    """Phrases as whole words, the longest first, whatever the blanks between their words."""
    words = "|".join(r"\s+".join(map(re.escape, p.split())).replace("'", "['’]\\s?") for p in sorted(set(phrases), key=lambda p: (-len(p), p)))
    return rf"(?<!\w)(?:{words})(?!\w)"


def dictionary_spans(phrases: dict[str, dict[str, list[str]]]) -> Callable[[Column, Column], Column]:
    """A function of (text, lang) that finds phrases (by language and label) in any case, without overlaps, the longest first."""
    patterns = {g: {label: phrase_pattern(own) for label, own in by_label.items() if own} for g, by_label in phrases.items()}
    return extractor(lambda text, lang: swept(matches(text, patterns.get(lang, {}), re.IGNORECASE)))


def first_kept(groups: list[list[Raw]]) -> list[Raw]:
    """Spans of earlier groups win over overlapping ones of later groups; the result is by start."""
    out: list[Raw] = []
    for s in (s for g in groups for s in g):
        if all(s[3] <= o[2] or s[2] >= o[3] for o in out):
            out.append(s)
    return sorted(out, key=lambda s: s[2])


#: By language. The word bound before a ministry stands after its first letter, for which it is searched faster.
MINISTRY = {"fr": r"[Mm](?<!\w[Mm])inist[èe]re\s+(?:de\s+l['’]|de\s+la\s+|des?\s+|du\s+)[^,;.:\n()]{3,90}", "ar": r"وزارة(?:\s+[ء-ي]+){1,4}"}


def legal_entities(text: str, lang: str) -> list[Raw]:
    """Ministries, references, dates and institutions without overlaps, in that order of precedence.

    Arabic references have the dates of both calendars, but for Gregorian ones with 'من' between day and month; where none of these
    stands, all dates would lose to the same spans among the references.
    """
    days = dates(text, lang) if lang == "fr" or "من" in text and compiled(DAY_OF_AR).search(text) else []
    return first_kept([matches(text, {"MINISTERE": MINISTRY[lang]}), references(text, lang), days, institutions(text, lang)])


ARROW_SPANS = to_arrow_type(SPANS)


def span_arrays(found: list[list[Raw]]) -> pa.Array:
    """Spans of many texts as one Arrow array, column by column."""
    flat = [s for spans in found for s in spans]
    labels, texts, starts, ends, metas = zip(*flat, strict=True) if flat else ((), (), (), (), ())
    kind = ARROW_SPANS.value_type
    maps = pa.array([None if m is None else list(m.items()) for m in metas], kind.field("meta").type)
    columns = [*(pa.array(v, kind.field(c).type) for c, v in (("label", labels), ("text", texts), ("start", starts), ("end_pos", ends))), maps]
    offsets = pa.array(accumulate(map(len, found), initial=0), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(kind)), type=ARROW_SPANS)


def extractor(kernel: Callable[[str, str], list[Raw]], may: dict[str, str] | None = None) -> Callable[[Column, Column], Column]:
    """A function of (text, lang) columns from a kernel. may: by language, a cheap pattern (Java's) that a text must have."""

    @F.arrow_udf(SPANS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, langs in batches:
            yield span_arrays([[] if t is None else kernel(t, "ar" if g == "ar" else "fr") for t, g in zip(texts.to_pylist(), langs.to_pylist(), strict=True)])

    def spans(text: Column, lang: Column) -> Column:
        if may is None:
            return run(text, lang)
        possible = F.when(lang == "ar", text.rlike(may["ar"])).otherwise(text.rlike(may["fr"]))
        return F.when(possible, run(F.when(possible, text), lang)).otherwise(F.array().cast(SPANS))

    return spans


find_references = extractor(references)
find_dates = extractor(dates, {"fr": r"[0-9]\S*\s+\p{L}+.*\s[0-9]{3}", "ar": "[0-9٠-٩]"})
find_institutions = extractor(institutions, {"fr": "(?!)", "ar": "[ء-ي]"})
find_citations = extractor(citations, {"fr": "(?i)article", "ar": "ماد|مواد"})
find_companies = extractor(companies, {"fr": "[A-Z]{3}", "ar": "[A-Z]{3}"})
find_legal_entities = extractor(legal_entities)
find_ministries = dictionary_spans({lang: {"MINISTERE": phrases} for lang, phrases in MINISTRIES.items()})


def joined_texts(texts: Column, separator: str) -> Column:
    """struct(text, starts): texts in one with a separator, and where each starts; null texts count as empty. For recognisers that are asked
    once for many texts."""
    whole = F.transform(texts, lambda t: F.coalesce(t, F.lit("")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    grown = F.aggregate(
        whole, zero, lambda a, t: F.struct((a["at"] + F.length(t) + len(separator)).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"]
    )
    return F.struct(F.array_join(whole, separator).alias("text"), grown.alias("starts"))


def redistributed(spans: Column, texts: Column, separator: str) -> Column:
    """Spans (a column) of joined texts as an array for each text, with offsets into it; what lies on a separator goes."""

    def dealt(starts: Column) -> Column:
        def own(t: Column, i: Column) -> Column:
            low = F.get(starts, i)
            inside = F.filter(spans, lambda s: (s["start"] >= low) & (s["start"] < low + F.length(F.coalesce(t, F.lit("")))))
            return F.transform(inside, lambda s: s.withField("start", s["start"] - low).withField("end_pos", s["end_pos"] - low))

        return F.transform(texts, own)

    return let(joined_texts(texts, separator)["starts"], dealt)


@F.pandas_udf(SPAN)
def located(entities: pd.DataFrame, sources: pd.Series) -> pd.DataFrame:
    """An entity moved to where its text stands in a source: at its offsets if they are valid, else where its words follow each
    other across any blanks, else where its number stands; null if nowhere. Its text is the slice."""
    out = []
    for e, source in zip(entities.to_dict("records"), sources, strict=True):
        out.append(_locate(e, source))
    return pd.DataFrame(out, columns=["label", "text", "start", "end_pos", "meta"])


def _locate(e: dict, source: str | None) -> tuple:
    none = (None, None, None, None, None)
    if source is None or e["label"] is None and e["text"] is None:
        return none
    start, end = e["start"], e["end_pos"]
    if start is not None and end is not None and start == start and end == end and 0 <= start < end <= len(source):
        return e["label"], source[int(start) : int(end)], int(start), int(end), e["meta"]
    text = (e["text"] or "").strip()
    m = re.search(r"\s+".join(map(re.escape, text.split())), source) if text else None
    if m is None and text:
        m = next((x for n in re.findall(NUM_FR, text) if (x := re.search(re.escape(n), source))), None)
    return none if m is None else (e["label"], m.group(), m.start(), m.end(), e["meta"])


@F.pandas_udf(SPANS)
def bio_spans(tokens: pd.Series, tags: pd.Series, texts: pd.Series) -> pd.Series:
    """Spans of tokens tagged B-x, I-x, O, with punctuation at their ends left out and offsets into the text."""
    out = []
    for words, labels, text in zip(tokens, tags, texts, strict=True):
        spans: list[Raw] = []
        at, open_ = 0, None
        for w, t in [*zip(words if words is not None else [], labels if labels is not None else [], strict=False), ("", "O")]:
            found = (text or "").find(w, at) if w else at
            start, end = (found, found + len(w)) if found >= 0 else (at, at)
            if open_ and (t[:2] != "I-" or t[2:] != open_[0]):
                a, b = open_[1], open_[2]
                while b > a and text[b - 1] in " .,;:!?،؛؟«»\"'()":
                    b -= 1
                while a < b and text[a] in " .,;:!?،؛؟«»\"'()":
                    a += 1
                if b > a:
                    spans.append((open_[0], text[a:b], a, b, None))
                open_ = None
            if w and t != "O":
                open_ = (open_[0], open_[1], end) if open_ else (t[2:], start, end)
            at = end
        out.append(spans)
    return pd.Series(out, dtype=object)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two spans share a character."""
    return (a["start"] < b["end_pos"]) & (b["start"] < a["end_pos"])


def rules_over_statistics(rules: Column, statistical: Column) -> Column:
    """Rule spans and the statistical spans that overlap none of them, by start."""
    kept = F.filter(statistical, lambda s: ~F.exists(rules, lambda r: overlaps(s, r)))
    return by_start(F.concat(rules, kept))


def by_start(spans: Column) -> Column:
    """Spans in the order of their starts; equal starts in their order before."""

    def ordered(all_: Column) -> Column:
        keyed = F.transform(all_, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i")))
        return F.transform(F.array_sort(keyed), lambda k: F.get(all_, k["i"]))

    return let(spans, ordered)


def resolved_overlaps(spans: Column) -> Column:
    """First come, first kept: spans that overlap an earlier one of the array go; the rest are by start."""
    kept = F.aggregate(
        spans, F.array().cast(SPANS), lambda acc, s: F.when(F.exists(acc, lambda o: overlaps(s, o)), acc).otherwise(F.concat(acc, F.array(s)))
    )
    return by_start(kept)


def unique_spans(spans: Column) -> Column:
    """The first span of each text and start."""
    same = lambda o, s: o["text"].eqNullSafe(s["text"]) & o["start"].eqNullSafe(s["start"])
    return let(spans, lambda all_: F.filter(all_, lambda s, i: ~F.exists(F.slice(all_, 1, i), lambda o: same(o, s))))


def first_of_text(spans: Column) -> Column:
    """The first span of each text, whatever its case and label."""
    return let(spans, lambda all_: F.filter(all_, lambda s, i: ~F.exists(F.slice(all_, 1, i), lambda o: F.lower(o["text"]) == F.lower(s["text"]))))


def valid(text: Column, label: Column) -> Column:
    """Whether an entity is one: three characters, no open number mark at the end, half of it letters unless its label is one of
    numbers, not a word that is none, not a number."""
    whole = strip(text)
    norm = replaced(F.lower(whole), r"^[.,;:!?]+|[.,;:!?]+$", "")
    share = F.regexp_count(whole, F.lit(r"\p{L}")) / F.length(whole)
    return (
        (F.length(whole) >= 3)
        & ~norm.rlike(r"(?U)(?:n°|رقم|عدد)\s*$")
        & (label.isin(fixed.DIGIT_LABELS) | (share >= 0.5))
        & ~((label == "PERSON") & norm.isin(fixed.NOT_PERSONS))
        & ~((label == "ORGANIZATION") & norm.isin(fixed.NOT_ORGANISATIONS))
        & ~whole.rlike(r"(?U)^\d+$")
    )


def in_range(spans: Column, text: Column) -> Column:
    """Spans whose offsets lie in the text."""
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end_pos"]) & (s["end_pos"] <= F.length(text)))


def before(text: Column, start: Column, n: int) -> Column:
    """The n characters before an offset, lower case."""
    return F.lower(F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n))))


def after(text: Column, end: Column, n: int) -> Column:
    return F.substring(text, end + 1, F.lit(n))


def any_word(text: Column, words: list[str]) -> Column:
    """Whether a text contains one of the words."""
    return text.rlike("|".join(re.escape(w) for w in words))


def likely_person(name: Column, lang: Column) -> Column:
    """First pass over recognised persons."""
    text = strip(name)
    words = F.split(text, r"(?U)\s+")
    hits = F.size(F.filter(words, lambda w: F.lower(w).isin([*fixed.NOT_PERSONS, *fixed.TITLES_FR])))
    fr = lang == "fr"
    noisy = fr & (((F.size(words) == 1) & ((F.length(text) <= 2) | text.rlike(r"^[A-Z]{3,}$"))) | (hits >= F.size(words) - 1) & ((F.size(words) > 1) | (hits > 0)))
    minister = F.when(fr, any_word(text, fixed.MINISTERS["fr"])).otherwise(any_word(text, fixed.MINISTERS["ar"]))
    shaped = F.when(fr, text.rlike(r"\p{Lu}")).otherwise((F.size(words) >= 2) & ~text.isin(fixed.TITLES_AR))
    return (text != "") & ~noisy & ~text.rlike(r"[0-9\x{200E}\x{200F}\n\r|]") & (F.size(words) <= 5) & (minister | shaped)


def gazetteer_person(name: Column, start: Column, end: Column, article: Column) -> Column:
    """Second pass: none that is a cross reference, a run of prepositions, misread, a lone common word, a species, street, school
    or place by its context."""
    text = strip(name)
    norm = replaced(F.lower(text), r"^[.,;:!?\"'«»()\[\]{}]+|[.,;:!?\"'«»()\[\]{}]+$", "")
    words = F.split(norm, r"(?U)\s+")
    cross = norm.rlike("^(?:" + "|".join(re.escape(c) for c in fixed.CROSS_REFERENCES) + ")")
    prepositions = (F.size(words) <= 3) & F.forall(words, lambda w: w.isin(fixed.PREPOSITIONS))
    lone = (F.size(words) == 1) & (text.rlike(r"^\p{Ll}") | (text.rlike(r"^\P{Ll}+$") & text.rlike(r"\p{Lu}") & (F.length(text) > 4)))
    place = text.isin(fixed.PLACES_AR) | text.rlike("^(?:" + "|".join(fixed.PLACE_PREFIXES_AR) + ")") | (before(article, start, 30).contains("الفقيه") & text.rlike("^(?:بن|أولاد) "))
    context = (
        any_word(before(article, start, fixed.SPECIES[1]), fixed.SPECIES[0])
        | any_word(before(article, start, fixed.STREETS[1]), fixed.STREETS[0])
        | any_word(before(article, start, fixed.UNIVERSITIES[1]), fixed.UNIVERSITIES[0])
        | any_word(F.lower(after(article, end, fixed.UNIVERSITIES[1])), fixed.UNIVERSITIES[0])
    )
    return ~(
        norm.isin([*fixed.NOT_PERSONS, "sidi rbat", "al haouz"]) | cross | prepositions | text.rlike(r"[0-9\x{200E}\x{200F}\x{202A}-\x{202E}]") | text.rlike(r"\p{Ll}\p{Lu}")
        | lone | F.upper(text).rlike("^(?:" + "|".join(fixed.DOUARS) + ")") | place | F.coalesce(context, F.lit(False))
    )


def likely_organisation(name: Column, lang: Column) -> Column:
    """Organisations need a word of institutions, and are no lone common word."""
    text = strip(name)
    lone = ~text.rlike(r"(?U)\s") & F.when(lang == "ar", text.isin(fixed.COMMON_ORG["ar"])).otherwise(F.lower(text).isin(fixed.COMMON_ORG["fr"]))
    word = lambda ws: text.rlike(r"(?iuU)\b(?:" + "|".join(re.escape(w) for w in ws) + r")\b")
    return (text != "") & ~lone & ~text.rlike(r"[\x{200E}\x{200F}]") & F.when(lang == "ar", word(fixed.ORG_WORDS_AR)).otherwise(word(fixed.ORG_WORDS_FR))


def has_month(text: Column, lang: Column) -> Column:
    """Whether a date names a month of its language."""
    return F.when(lang == "ar", any_word(text, [*fixed.GREGORIAN_AR, *fixed.HIJRI_AR])).otherwise(any_word(F.lower(text), [*fixed.GREGORIAN_FR, *fixed.HIJRI_FR]))


def company_context(name: Column, start: Column, end: Column, article: Column) -> Column:
    """Whether what was taken for a person is a company, by what stands around it or by its own words."""
    words = F.transform(F.split(F.lower(name), r"(?U)\s+"), lambda w: replaced(w, "^[.,;:»\"']+|[.,;:»\"']+$", ""))
    caps = name.rlike(r"^[A-Z][A-Z\s]{2,}$") & (F.size(words) >= 2)
    marked = F.exists(F.split(F.upper(name), r"(?U)\s+"), lambda w: w.rlike("^(?:" + "|".join(fixed.PERSON_MARKS) + ")"))
    suffix = after(article, end, 40).rlike(r"(?iU)^\s*[»\"')\]>]*\s*(?:Sarl|S\.A\.?R\.?L\.?|SA|S\.A\.)(?:\s+AU)?(?![\p{L}\p{N}])")
    return ~F.arrays_overlap(words, F.array(*map(F.lit, fixed.ADDRESSES))) & (
        before(article, start, 80).rlike("soci[ée]t[ée]") | suffix | F.when(caps, ~marked).otherwise(F.arrays_overlap(words, F.array(*map(F.lit, fixed.COMPANY_WORDS))))
    )


def reclassified(persons: Column, article: Column, companies_: Column) -> Column:
    """Persons with the label ORG where they are companies by context or by a name among the article's companies (find_companies)."""
    named = F.transform(companies_, lambda c: F.lower(c["text"]))
    return F.transform(
        persons,
        lambda p: F.when(F.coalesce(company_context(p["text"], p["start"], p["end_pos"], article), F.lit(False)) | F.array_contains(named, F.lower(p["text"])), p.withField("label", F.lit("ORG"))).otherwise(p),
    )


def has_legal_entity(spans: Column) -> Column:
    return F.exists(spans, lambda s: s["label"].isin(fixed.LEGAL_OR_ISSUE))


def position(start: Column, *others: Column) -> Column:
    """The first known of several position fields, else -1."""
    return F.coalesce(start, *others, F.lit(-1))
