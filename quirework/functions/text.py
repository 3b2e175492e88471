"""Cleaning of gazette text, as columns.

Patterns use Java's syntax with (?U), so classes and word bounds follow Unicode; (?d) keeps $ at line feeds alone.
A null text stays null in every function.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quirework.functions import fixed
from quirework.functions.fixed import AR_LETTERS, GREGORIAN_AR, LAAIHA, PROTECTED_CAPS

ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
ELISION = " […texte non modifié…] "


def replaced(text: Column, pattern: str, by: str) -> Column:
    """regexp_replace with a literal pattern."""
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with a name for a value, so that a value that is used often is computed once and stands in the plan once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return replaced(text, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def nfc(text: Column) -> Column:
    """Composed form. Texts without combining characters and compatibility ideographs don't leave the JVM."""
    loose = text.rlike(r"[\p{M}\x{F900}-\x{FAFF}\x{212A}\x{212B}\x{1100}-\x{11FF}\x{0340}-\x{0344}\x{037E}\x{0387}]")
    return F.when(loose, _nfc(F.when(loose, text))).otherwise(text)


def line_ends(text: Column) -> Column:
    """Line feeds for all line ends."""
    return replaced(text, r"\r\n?", "\n")


def unicode_clean(text: Column) -> Column:
    """Composed, plain blanks, without control and direction characters."""
    return replaced(F.translate(nfc(text), " ", " "), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200E}\x{200F}]", "")


def apostrophes(text: Column) -> Column:
    """One kind of apostrophe."""
    return F.translate(text, "’‘ʼ`´", "'''''")


def french_headers(text: Column) -> Column:
    """Without issue lines, running titles and lone page numbers; then without lone words in capitals, but for those that
    the gazette itself uses."""
    heads = r"(?imUd)^[^\S\n]*(?:N[ºo°]\s*\d+\s*[–\-—]\s*\d+\s+\w+\s+\d{4}\s*\(.*?\)|BULLETIN OFFICIEL|[^\n]*?FFICIEL\s+N[ºo°]\s*\d+\s*[–\-—]|\d{1,4})\s*$"
    caps = rf"(?mUd)^[^\S\n]*(?!(?:{'|'.join(PROTECTED_CAPS)})\b)[A-ZÉÈÊËÀÂÎÏÔÛÙÇ]{{4,}}\s*$"
    return replaced(replaced(text, heads, ""), caps, "")


def dot_leaders(text: Column) -> Column:
    """Without contents lines; dots within a line mark an omission."""
    return replaced(replaced(text, r"(?md)^[^\n]*?\.{4,}[^\S\n]*[0-9]*[^\S\n]*$", ""), r"\.{4,}", ELISION)


def arabic_headers(text: Column) -> Column:
    """Without the running title and lone page numbers."""
    return replaced(text, r"(?mUd)^\s*(?:الجريدة\s+الرسمية|[0-9٠-٩]{1,4})\s*$", "")


def arabic_dots(text: Column) -> Column:
    return replaced(text, r"\.{4,}", " ")


def squeezed_lines(text: Column) -> Column:
    """No blank lines, no blanks at line ends, none around the text."""
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: replaced(x, r"(?U)\s+$", "")), lambda x: x.rlike(r"(?U)\S"))
    return strip(F.array_join(kept, "\n"))


def collapsed(text: Column) -> Column:
    """At most one blank line in a row."""
    return replaced(text, r"\n{3,}", "\n\n")


QUOTED = StructType([StructField("text", StringType()), StructField("removed", ArrayType(StringType()))])


@F.pandas_udf(QUOTED)
def without_arabic(texts: pd.Series) -> pd.DataFrame:
    """A French text without runs of Arabic, but for quotations; and the runs that went.

    A run is quoted if, past blanks, Arabic letters, digits and ).( , it comes after « or before ».
    """
    import re

    run = re.compile(r"[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿‎‏]+(?:[ \t]+[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿‎‏]+)*")
    passed = re.compile(r"[\s؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿)(.\d]*")
    texts_out, removed_out = [], []
    for t in texts:
        if t is None:
            texts_out.append(None)
            removed_out.append(None)
            continue
        mirror, n, removed, parts, at = t[::-1], len(t), [], [], 0
        for m in run.finditer(t):
            before = passed.match(mirror, n - m.start()).end()
            after = passed.match(t, m.end()).end()
            if (before < n and mirror[before] == "«") or (after < n and t[after] == "»"):
                continue
            parts.append(t[at : m.start()])
            at = m.end()
            removed.append(m.group().strip())
        texts_out.append("".join([*parts, t[at:]]))
        removed_out.append(removed)
    return pd.DataFrame({"text": texts_out, "removed": removed_out})


def clean_french(text: Column, headers: bool = True, leaders: bool = True, apostrophe: bool = True, arabic: bool = True) -> Column:
    """struct(text, removed): the French cleaning chain; removed has the Arabic runs taken out."""
    out = unicode_clean(line_ends(text))
    out = french_headers(out) if headers else out
    out = dot_leaders(out) if leaders else out
    out = apostrophes(out) if apostrophe else out
    if not arabic:
        return F.struct(squeezed_lines(collapsed(out)).alias("text"), F.array().cast("array<string>").alias("removed"))
    parts = without_arabic(out)
    return F.struct(squeezed_lines(collapsed(parts["text"])).alias("text"), parts["removed"].alias("removed"))


def lam_meem(text: Column) -> Column:
    """Article and meem that extraction swapped at the start of a word."""
    return replaced(text, r"(?m)(^|[\s«»\"'.\-)(:؛,،])([وفبكل]{0,3})مال(?=[ء-ي])", "$1$2الم")


def laaiha(text: Column) -> Column:
    """A word from which scanners drop a letter; the replacements apply one after the other."""
    for wrong, right in LAAIHA:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def arabic_normal(
    text: Column, tashkeel: bool = True, tatweel: bool = True, alef: bool = True, maksura: bool = False, marbuta: bool = False, digits: bool = True
) -> Column:
    """One spelling of Arabic letters, each step by a switch."""
    out = nfc(text)
    out = replaced(out, r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]", "") if tashkeel else out
    out = F.translate(out, "ـ", "") if tatweel else out
    out = F.translate(out, "آأإٱ", "اااا") if alef else out
    out = F.translate(out, "ى", "ي") if maksura else out
    out = F.translate(out, "ة", "ه") if marbuta else out
    out = western_digits(out) if digits else out
    return replaced(out, r"(?U)\s+([،؛؟])", "$1") if tashkeel else out


def western_digits(text: Column) -> Column:
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def hijri_brackets(text: Column) -> Column:
    """Brackets that slipped in 'hijri date (gregorian date)' put back around the second."""
    months = "|".join(sorted((("[اأإآٱ]" + m[1:]) if m[0] in "اأإآٱ" else m for m in GREGORIAN_AR), key=lambda m: (-len(m), m)))
    return replaced(text, rf"(?U)([\d٠-٩]{{1,2}})\)\s*([\d٠-٩]{{3,4}}\s+)?({months})\s*[:.،\-]?\s*\(\s*([\d٠-٩]{{4}})", "$2($1 $3 $4)")


def clean_arabic(text: Column, lam: bool = True, headers: bool = True, dots: bool = True, brackets: bool = True, laaiha_: bool = True, **switches: bool) -> Column:
    """The Arabic cleaning chain; brackets are mended after alefs became one."""
    out = unicode_clean(line_ends(text))
    out = lam_meem(out) if lam else out
    out = arabic_dots(arabic_headers(out) if headers else out) if dots else (arabic_headers(out) if headers else out)
    out = arabic_normal(out, **switches)
    out = hijri_brackets(out) if brackets else out
    out = laaiha(out) if laaiha_ else out
    return squeezed_lines(collapsed(out))


def right_word(word: str) -> str:
    """A word put right: by the list for any case, then by that for its own case, then by that of lost accents."""
    word = fixed.WORD_FIXES.get(word.lower(), word)
    word = fixed.CASED_FIXES.get(word, word)
    accented = fixed.ACCENT_FIXES.get(word.lower(), word)
    return accented if isinstance(accented, str) else accented[not word.islower()]


@F.pandas_udf(StringType())
def _pdf_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import re

    word = re.compile(r"\w+")
    for texts in batches:
        yield texts.map(lambda t: t if t is None else word.sub(lambda m: right_word(m.group()), t))


def pdf_words(text: Column) -> Column:
    """French words put right that come broken out of PDF files. Only texts with such a word leave the JVM."""
    words = "|".join([*fixed.WORD_FIXES, *fixed.CASED_FIXES, *fixed.ACCENT_FIXES])
    hit = text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])")
    return F.when(hit, _pdf_words(F.when(hit, text))).otherwise(text)


def flat_entity(text: Column) -> Column:
    """Blanks single; a page number stuck to the last word gone."""
    flat = strip(replaced(text, r"(?U)\s+", " "))
    return F.when(flat.rlike(r"^\d{3,4}$"), flat).otherwise(strip(replaced(flat, r"(?U)(?<![\s\d_\-])\d{3,4}\s*$", "")))


def plain_key(text: Column) -> Column:
    """Key that ignores case, accents and runs of blanks."""
    marked = text.rlike(r"[^\x00-\x7F]")
    folded = F.when(marked, _folded(F.when(marked, text))).otherwise(text)
    return strip(replaced(F.lower(folded), r"(?U)\s+", " "))


def slug(reference: Column) -> Column:
    """A reference as part of an identifier."""
    out = replaced(F.coalesce(reference, F.lit("")), r"(?iU)^\s*n\s*[°ºo]\s*", "")
    return replaced(replaced(replaced(out, r"[-–—.]", "_"), r"[^0-9_]", ""), r"^_+|_+$", "")


def shortened(text: Column, most: int, suffix: str = "…") -> Column:
    """At most so many characters and a suffix."""
    return F.when(F.length(text) > most, F.concat(replaced(F.left(text, F.lit(most)), r"(?U)\s+$", ""), F.lit(suffix))).otherwise(text)


def table_cell(cell: Column) -> Column:
    """A cell for a pipe table."""
    return strip(replaced(F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit("\\|")), r"(?U)\s+", " "))


def arabic_letters(text: Column) -> Column:
    """Number of code points of the Arabic blocks."""
    return F.regexp_count(text, F.lit(f"[{AR_LETTERS}]"))


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))
