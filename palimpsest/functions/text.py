"""Text items, which hold an original (``uk``) and, once set, a translation (``en``); predicates and clean-up of text."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .brackets import once

#: ``en_set`` tells a translation that is missing from one that is set to null.
TEXT_ITEM = "struct<uk:string,en:string,en_set:boolean>"


# How letters are spelt in ASCII, and the patterns of numbers and of natural keys.
LETTERS = dict(zip(
    "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿАБВГҐДЕЗИІЙКЛМНОПРСТУФЫЭабвгґдезиійклмнопрстуфыэ",
    "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyyABVGGDEZIIIKLMNOPRSTUFYEabvggdeziiiklmnoprstufye",
    strict=True,
))
CLUSTERS = {
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "Є": "Ie", "є": "ie", "Ё": "Io", "ё": "io", "Ж": "Zh", "ж": "zh",
    "Ї": "Yi", "ї": "yi", "Х": "Kh", "х": "kh", "Ц": "Ts", "ц": "ts", "Ч": "Ch", "ч": "ch", "Ш": "Sh", "ш": "sh",
    "Щ": "Shch", "щ": "shch", "Ю": "Iu", "ю": "iu", "Я": "Ia", "я": "ia", "Ь": "'", "ь": "'", "Ъ": "\"", "ъ": "\"",
}
_NUMERIC = "^[0-9]+([–-][0-9]+)?$"
_NATURAL = r"^([\p{L}\-‐‑‒–—]*)(\p{Nd}+)([\p{L}\-‐‑‒–—]*)$"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_numeric(text: Column) -> Column:
    """A number or a range of two, after stripping."""
    return strip(text).rlike(_NUMERIC)


def is_ascii(text: Column) -> Column:
    """Characters of one byte only."""
    return F.octet_length(text) == F.char_length(text)


def text_item(source: Column, translate: bool = False) -> Column:
    """A text item of a source text. Empty, numeric and ASCII texts are their own translation, unless ``translate``."""
    # Patterns come last: most texts are told without them.
    own = source.isNull() | is_ascii(source) | is_numeric(source)
    own = F.lit(False) if translate else F.coalesce(own, F.lit(True))
    return F.struct(source.alias("uk"), F.when(own, source).alias("en"), own.alias("en_set"))


def get_text(item: Column) -> Column:
    """The translation if it is set, even to null, else the original."""
    return F.when(item["en_set"], item["en"]).otherwise(item["uk"])


def needs_translation(item: Column) -> Column:
    return item.isNotNull() & ~item["en_set"]


def equal_text(a: Column, b: Column) -> Column:
    """Translations are compared where both are set, else originals."""
    return F.when(a["en_set"] & b["en_set"], a["en"].eqNullSafe(b["en"])).otherwise(a["uk"].eqNullSafe(b["uk"]))


def match_text(item: Column, text: Column) -> Column:
    """Whether a text is the original or the translation; an unset translation counts as null."""
    return item["uk"].eqNullSafe(text) | F.when(item["en_set"], item["en"]).eqNullSafe(text)


def strip_number(text: Column) -> Column:
    """Without a leading number, one punctuation mark and spaces."""
    return F.regexp_replace(text, r"^\p{N}+\p{P}?\p{Zs}*", "")


def redact(text: Column) -> Column:
    return F.concat(F.substring(text, 1, 3), F.lit("..."))


def to_ascii(text: Column, letters: dict[str, str] | None = None, clusters: dict[str, str] | None = None) -> Column:
    """Letters spelt in ASCII, one by one and those that take several; characters of no table stay."""
    letters, clusters = LETTERS if letters is None else letters, CLUSTERS if clusters is None else clusters
    out = F.translate(text, "".join(letters), "".join(letters.values())) if letters else text
    for letter, spelt in clusters.items():
        out = F.replace(out, F.lit(letter), F.lit(spelt))
    return out


def ascii_filename(name: Column) -> Column:
    """An ASCII file name: letters are spelt in ASCII, the pair ``-_`` goes, characters but letters, digits and ``-_.``
    become an underscore; a name of nothing is ``download``."""
    cleaned = F.regexp_replace(F.replace(to_ascii(name), F.lit("-_"), F.lit("")), r"[^A-Za-z0-9_.-]", "_")
    return F.when(cleaned == "", "download").otherwise(cleaned)


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "“”", '""')


def year_range(text: Column) -> Column:
    """``dddd - dddd`` as it stands, else the first four digits that are a year from 1500 to 2029, else nothing."""
    span = F.regexp_extract(text, r"([0-9]{4}\s*[-–]\s*[0-9]{4})", 1)
    years = F.filter(
        F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), 1), lambda y: y.cast("int").between(1500, 2029)
    )
    return F.when(span != "", span).otherwise(F.coalesce(F.get(years, 0), F.lit("")))


def suffix(name: Column) -> Column:
    """What follows the last dot; nothing without one."""
    return F.regexp_extract(name, r"\.([^.]+)$", 1)


def has_keyword(text: Column, words: list[str]) -> Column:
    return text.rlike("(?i)" + "|".join(words))


def parse_item(text: Column) -> Column:
    """(fond, opus, description) of ``fond, opus "description"``; quotes end the description."""
    plain = straight_quotes(text)
    head = F.substring_index(plain, '"', 1)
    quoted = F.when(F.contains(plain, F.lit('"')), F.substring(plain, F.length(head) + 2, F.length(plain))).otherwise("")
    return F.struct(
        F.trim(F.split_part(head, F.lit(","), F.lit(1))).alias("fond"),
        F.trim(F.split_part(head, F.lit(","), F.lit(2))).alias("opus"),
        F.trim(F.replace(quoted, F.lit('"'), F.lit(""))).alias("description"),
    )


def natural_key(text: Column) -> Column:
    """A key that sorts ``2`` before ``10``: by number, what stands before it, what follows; other texts come last. Text is
    letters with dashes, a number of any length, letters with dashes."""
    number = F.regexp_extract(text, _NATURAL, 2)
    ok = number != ""
    # Without zeros in front longer numbers are greater, and equally long ones sort as text.
    number = F.regexp_replace(number, r"^0+(?=.)", "")
    return F.struct(
        (~ok).alias("other"),
        F.when(ok, F.length(number)).alias("digits"),
        F.when(ok, number).alias("number"),
        F.when(ok, F.regexp_extract(text, _NATURAL, 1)).otherwise(text).alias("prefix"),
        F.when(ok, F.regexp_extract(text, _NATURAL, 3)).otherwise("").alias("suffix"),
    )


def chunk(position: Column, size: int) -> Column:
    """Number of the batch that a position from 0 falls in."""
    return F.floor(position / size).cast("int")


def unescaped(text: Column) -> Column:
    """Text with its HTML entities, named and numbered, as characters; each is read once, unknown ones stay."""
    # Entries are looked through from the first one on.
    common = {k: name2codepoint[k] for k in ("amp", "quot", "lt", "gt", "nbsp")}
    named = F.from_json(F.lit(json.dumps({k: chr(v) for k, v in (common | name2codepoint).items()})), "map<string,string>")

    def plain(t: Column) -> Column:
        body = F.substr(t, F.lit(2), F.length(t) - 2)
        digits = F.regexp_extract(body, "^#([0-9]+)$", 1).try_cast("int")
        number = F.coalesce(digits, F.conv(F.regexp_extract(body, "^#[xX]([0-9A-Fa-f]+)$", 1), 16, 10).try_cast("int"))
        # A code point as UTF-8, by its UTF-32 bytes.
        shown = lambda n: F.when(n.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        # Parts without an entity, most of them, are told by their first character.
        numbered = F.coalesce(once(number, shown), t)
        entity = F.when(F.startswith(body, F.lit("#")), numbered).otherwise(F.coalesce(F.try_element_at(named, body), t))
        return F.when(F.startswith(t, F.lit("&")), entity).otherwise(t)

    parts = F.regexp_extract_all(text, F.lit("(?s)(&[#A-Za-z0-9]+;|[^&]+|&)"), 1)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, plain), "")).otherwise(text)
