"""Text rules of the layout operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyphs and letters that open a bulleted item (before white space).
BULLET = r"\A(?:●|•|◘|○|◙|⦿|‣|⁃|⁌|⁍|➡|◆|◇|◌|◈|➢|➣|➤|➥|➦|➧|➱|➮|▷|▶|▸|▹|▻|⊛|=>|->|>|\*|o|-)(?=(?U)\s)"
# Roman numerals one to ten.
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
# Style words dropped before font names are compared.
STYLE_WORDS = "medium|regular|bold|italic|ital|roman"


def emphasis(font: Column) -> Column:
    """0 plain, 1 bold, 2 italic, 3 both, from the font's name."""
    name = F.regexp_replace(F.lower(font), r"[^\p{L}\p{N}]", "")
    return F.when(name.contains("bold"), 1).otherwise(0) + F.when(name.rlike("ital|oblique"), 2).otherwise(0)


def bare_font(font: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(font), r"[^\p{L}\p{N}]", ""), STYLE_WORDS, "")


def font_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length of the bare names."""
    x, y = bare_font(a), bare_font(b)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer > 0, 1 - F.levenshtein(x, y) / longer).otherwise(1.0)


def band_key(text: Column) -> Column:
    """What running headers are compared by: script marks unwrapped, space collapsed, digits alike, lower case."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\^_]\{(.*?)\}", "$1"), r"(?U)\s+", " "))
    return F.lower(F.regexp_replace(plain, "[0-9]", "&"))


def numeral_classes(token: Column) -> Column:
    """Every reading of a list token as (class, value): letters 1-26, decimals 0-999, romans 1-10; else the token itself with 0."""
    code = F.ascii(token)
    one = F.length(token) == 1
    roman = F.array_position(F.array(*map(F.lit, ROMAN)), F.lower(token)).cast("int")
    read = lambda name, value: F.struct(F.lit(name).alias("class"), value.cast("int").alias("value"))
    found = F.filter(
        F.array(
            F.when(one & token.rlike("^[a-z]$"), read("lower", code - 96)),
            F.when(one & token.rlike("^[A-Z]$"), read("upper", code - 64)),
            F.when(token.rlike("^(?:0|[1-9][0-9]{0,2})$"), read("decimal", token.try_cast("int"))),
            F.when((roman > 0) & token.rlike("^[a-z]+$"), read("roman_lower", roman)),
            F.when((roman > 0) & token.rlike("^[A-Z]+$"), read("roman_upper", roman)),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(token.alias("class"), F.lit(0).alias("value"))))


# Fixed: what one part of a list number may be: a roman numeral up to nine in one case, up to three digits, a letter or comma.
_ROMANS = sorted(ROMAN[:9], key=len, reverse=True)
_TOKEN = "(?:" + "|".join([*_ROMANS, *map(str.upper, _ROMANS), "[0-9]{1,3}", "[a-zA-Z,]"]) + ")"
# Up to three parts, each with its point, before the last one.
LIST_NUMBER = rf"(?:{_TOKEN} ?\. ?){{0,3}}{_TOKEN}"
# Fixed: what must not follow a number: a percent sign or bracket within three spaces; for a plain one also a digit or small letter.
_NO_VALUE, _NO_SENTENCE = r"(?! {0,3}[%(])", r"(?! {1,3}[0-9a-z])"
# In order: plain, in brackets, after a word.
LIST_NUMBERS = (
    r"(?U)\A\(?\[?" + LIST_NUMBER + r" ?[.:)\]\s]" + _NO_VALUE + _NO_SENTENCE,
    r"(?U)\A[(\[]" + LIST_NUMBER + r" ?[)\] ]" + _NO_VALUE,
    r"(?U)\A[a-zA-Z,]{2,} +" + LIST_NUMBER + r"(?:[.:)\] ]|\s|\z)",
)


def list_number(text: Column) -> Column:
    """The list number that opens a text, by the first pattern that matches; null if none does."""
    found = [F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in LIST_NUMBERS]
    return F.regexp_replace(F.coalesce(*found), r"(?U)\A\s+|\s+\z", "")


def bullet(text: Column) -> Column:
    """The bullet that opens a text, null if none does."""
    return F.nullif(F.regexp_extract(text, BULLET, 0), F.lit(""))


def readings(number: Column) -> Column:
    """Every reading of a list number: one (class, value) for each of its tokens, in all combinations."""
    zero = F.array(F.array().cast("array<struct<class:string,value:int>>"))
    tokens = F.transform(F.regexp_extract_all(number, F.lit("[0-9a-zA-Z]+"), F.lit(0)), numeral_classes)
    return F.aggregate(tokens, zero, lambda acc, t: F.flatten(F.transform(acc, lambda head: F.transform(t, lambda r: F.concat(head, F.array(r))))))


def separators(number: Column) -> Column:
    return F.trim(F.regexp_replace(number, "[0-9a-zA-Z]", ""))


def band_readings(text: Column) -> Column:
    """What a running header is joined by: its readings as a numeral, else (its key, null)."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\^_]\{(.*?)\}", "$1"), r"(?U)\s+", " "))

    def one(p: Column) -> Column:  # the lambda binds the plain text, so that its patterns run once
        words = F.array(F.struct(F.concat(F.lit("text "), F.lower(F.regexp_replace(p, "[0-9]", "&"))).alias("class"), F.lit(None).cast("int").alias("value")))
        read = F.filter(numeral_classes(p), lambda r: r["value"] > 0)
        return F.when((F.length(p) > 4) | (F.size(read) == 0), words).otherwise(read)

    return F.get(F.transform(F.array(plain), one), F.lit(0))


def soft_similarity(a: Column, b: Column) -> Column:
    """Shorter length less the edit distance over the longer length; 0 beyond three edits, null for two empty texts."""
    edits = F.levenshtein(a, b, 3)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(edits < 0, 0.0).otherwise((F.least(F.length(a), F.length(b)) - edits) / F.nullif(longer, F.lit(0)))
