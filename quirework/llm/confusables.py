"""One consistent form for texts that look the same.

A token's scripts are the intersection of the script sets of its letters. An empty intersection marks a mixed-script
token; a token in one script all of whose letters have a look-alike in the script of its text is a whole-script
confusable. Both are respelled in the script that all of the token's letters can be written in, the one most of the
text's unambiguous letters belong to. Widths, presentation forms, combining marks, blanks, hyphens that print alike and
characters that don't print are then brought to one form.

Null stays null; an empty text stays empty. Case, accents, digits, punctuation and spelling are kept, and so is what compatibility
forms show otherwise: raised and lowered signs, circled and fraction numbers, signs for words, letters with other dots.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirework.llm.pairs import differing_pairs
from quirework.sources.tables import cut, spread, table

#: Letters of other scripts that print like a Latin letter.
CYRILLIC = dict(zip("АВЕКМНОРСТХУЅІЈԚԜҮӀаеорсхуѕіјԛԝһԁүӏ", "ABEKMHOPCTXYSIJQWYIaeopcxysijqwhdyl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj", strict=True))
#: Letters of Arabic script that print like another one where they stand: joined to a next letter, or not.
JOINED = "(?=[\u064b-\u065f\u0670]*[\u0622-\u064a\u066e-\u06d3])"
ARABIC = re.compile(f"(?P<yeh>ی{JOINED})|(?P<bare>ی)|(?P<kaf>ک{JOINED})|(?P<heh>ہ(?!{JOINED[3:-1]}))")
PRINTED = {"yeh": "ي", "bare": "ى", "kaf": "ك", "heh": "ه"}
SAME = {"ɑ": "a", "ɡ": "g", **dict.fromkeys("‐‑−﹣", "-")}
TO_LATIN = CYRILLIC | GREEK
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items()}
TO_GREEK = {v: k for k, v in GREEK.items()}

#: Compatibility forms that print like what they stand for: widths, joined and lone forms, letters of another design, ligatures,
#: digraphs, and Roman numbers, by blocks.
PRINT_ALIKE = {"<wide>", "<narrow>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>"}
LIGATURES = [*range(0x132, 0x134), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18)]
BLOCKS = [*range(0x2100, 0x2150), *range(0xFB1D, 0xFF00), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00)]
COMPATIBLE = {c: unicodedata.normalize("NFKD", chr(c)) for c in BLOCKS if unicodedata.decomposition(chr(c)).split(" ")[0] in PRINT_ALIKE}
COMPATIBLE |= {c: unicodedata.normalize("NFKD", chr(c)) for c in LIGATURES}
COMPATIBLE_FORM = re.compile("[\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\u2100-\u217f\ufb00-\ufeff\uff01-\uffee\U0001d400-\U0001d7ff\U0001ee00-\U0001eeff]+")

#: Not printed: format characters, fillers, selectors.
UNSEEN = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ"
    "︀-️﻿ﾠ\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]"
)
BLANK = re.compile("[ \t   -   　]")
LINE_END = re.compile("\r\n|[\r\x0b\x0c\x85  ]")
TOKEN = re.compile(r"[^\W\d_]+")
ENDS = re.compile(r" +(?=\n|$)")
#: A text without any of these is in its one form already.
SUSPECT = re.compile(
    "[^\x20-\x7e\n\xab\xb0\xbb\xc0-\xd6\xd8-\xf6\xf8-\u0130\u0132-\u017e\u0621-\u063a\u0640-\u0652\u0660-\u0669\u060c\u061b\u061f\u2013\u2014\u2018\u2019\u201c\u201d]"
    "| \n| $"
)

_SCRIPTS: dict[str, frozenset[str]] = {}


def scripts(letter: str) -> frozenset[str]:
    """Scripts in which the letter can be written: its own and those with a look-alike."""
    known = _SCRIPTS.get(letter)
    if known is None:
        name = unicodedata.name(letter, "").split(" ")[0]
        own = {"LATIN", "CYRILLIC", "GREEK", "ARABIC"} & {name} or {name or "UNKNOWN"}
        if letter in CYRILLIC:
            own |= {"LATIN"}
        if letter in GREEK:
            own |= {"LATIN"}
        if letter in TO_CYRILLIC:
            own |= {"CYRILLIC"}
        if letter in TO_GREEK:
            own |= {"GREEK"}
        known = _SCRIPTS[letter] = frozenset(own)
    return known


def _spell(token: str, script: str) -> str:
    table_ = {"LATIN": TO_LATIN, "CYRILLIC": TO_CYRILLIC, "GREEK": TO_GREEK}.get(script, {})
    return "".join(table_.get(c, c) if unicodedata.name(c, "").split(" ")[0] != script else c for c in token)


def needs_form(text: str) -> bool:
    """Whether a text may not be in its one form."""
    return SUSPECT.search(text) is not None


WIDE_BLANK = re.compile(BLANK.pattern.replace(" ", "", 1))
SAME_LETTER = re.compile("[" + "".join(SAME) + "]")
OTHER_SCRIPT = re.compile("[" + "".join(TO_LATIN) + "]")
#: Letters that one script alone has.
ONLY = {
    "LATIN": re.compile("[A-Za-zÀ-ɏ]".replace("[", "(?![" + "".join(sorted({*TO_CYRILLIC, *TO_GREEK})) + "])[", 1)),
    "CYRILLIC": re.compile("(?![" + "".join(CYRILLIC) + "])[Ѐ-ԯ]"),
    "GREEK": re.compile("(?![" + "".join(GREEK) + "])[Ͱ-Ͽ]"),
    "ARABIC": re.compile("[ء-ۿ]"),
}


def one_form(text: str) -> str:
    """The consistent form of a text."""
    text = COMPATIBLE_FORM.sub(lambda m: m.group().translate(COMPATIBLE), UNSEEN.sub("", LINE_END.sub("\n", text)))
    text = SAME_LETTER.sub(lambda m: SAME[m.group()], WIDE_BLANK.sub(" ", unicodedata.normalize("NFD", text)))
    if "ی" in text or "ک" in text or "ہ" in text:
        text = ARABIC.sub(lambda m: PRINTED[m.lastgroup], text)
    if OTHER_SCRIPT.search(text):
        votes = {s: len(p.findall(text)) for s, p in ONLY.items()}
        chief = max(votes, key=lambda s: (votes[s], s == "LATIN"))

        def respell(m: re.Match) -> str:
            token = m.group()
            if not OTHER_SCRIPT.search(token):
                return token
            possible = frozenset.intersection(*map(scripts, token))
            if chief in possible:  # mixed letters that agree, or a whole-script confusable
                return _spell(token, chief)
            return _spell(token, max(possible, key=lambda s: (votes.get(s, 0), s == "LATIN", s))) if possible else token

        text = TOKEN.sub(respell, text)
    return ENDS.sub("", unicodedata.normalize("NFC", text))


@F.pandas_udf(StringType())
def _one_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([t if t is None or not needs_form(t) else one_form(t) for t in texts], dtype=object)


def consistent(text: Column) -> Column:
    """The consistent form of a text column."""
    return _one_form(text)


def digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, raw, form): digests of the stored text and of its consistent form, for rows with a text that isn't empty."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", raw binary, form binary"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, form = [], []
            for t in batch.column("text").to_pylist():
                own = hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()
                raw.append(own)
                form.append(hashlib.md5(one_form(t).encode("utf-8", "surrogatepass")).digest() if needs_form(t) else own)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(raw, pa.binary()), pa.array(form, pa.binary())], names=[*keys, "raw", "form"])

    return spread(rows.where("text IS NOT NULL AND text <> ''").select(*keys, "text")).mapInArrow(digest, schema)


def alike_pairs(keyed: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b, of rows of one group (tbl, doc_id) that look the same but are stored otherwise.

    keyed: tbl, doc_id, id, raw, form. Rows with a null group pair with none. Exact copies of a text meet only the rows
    with another spelling.
    """
    return differing_pairs(cut(keyed.where("doc_id IS NOT NULL")), ["tbl", "doc_id", "form"], ["tbl"])


def _keyed(spark: SparkSession, folder: str) -> DataFrame:
    articles = table(spark, folder, "articles")
    own = digests(articles.select("id", "doc_id", F.col("raw_text").alias("text")), ["id", "doc_id"])
    home = articles.select(F.col("id").alias("article_id"), "doc_id")
    named = digests(table(spark, folder, "entities").where("article_id IS NOT NULL").select("id", "article_id", "text"), ["id", "article_id"]).join(home, "article_id")
    return own.select(F.lit("articles").alias("tbl"), "doc_id", "id", "raw", "form").unionByName(named.select(F.lit("entities").alias("tbl"), "doc_id", "id", "raw", "form"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows of a bulletin that look the same and differ in at least one code point."""
    return alike_pairs(_keyed(spark, folder))


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every article and entity with the digest of its consistent form and whether the form differs from what is stored."""
    return _keyed(spark, folder).select("tbl", "id", "doc_id", F.lower(F.hex("form")).alias("form_md5"), (F.col("form") != F.col("raw")).alias("changed"))


QUERIES = {"p4_found": p4_found, "p4_forms": p4_forms}
SQL: dict[str, str] = {}
