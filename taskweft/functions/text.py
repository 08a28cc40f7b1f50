"""Task-name text: normalising, tokens, tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Punctuation that marks an entity, token pattern, entity tags.
PUNCTUATION = r"[=\-+_.:/*',?]"
TOKEN = r"<.+?>|\w*\d{1,}\.*\d{1,}\w*|\w+"
NAME, NUMBER = "<name>", "<number>"
#: Common English function words.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can did do does doing don down during each few for from further had has have having he her here hers him his how i if in "
    "into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some "
    "such than that the their them then there these they this those through to too under until up very was we were what when "
    "where which while who whom why will with you your"
).split()


def normalize(text: Column) -> Column:
    """Tag what is no plain word.

    Each blank-separated token in turn replaces all its occurrences in the running text: with a digit and
    an ASCII letter by ``<name>``, with a digit by ``<number>``, else with punctuation by ``<name>``.  Equal
    neighbours then collapse in one pass.
    """
    clean = F.replace(text, F.lit("&amp"), F.lit(""))

    def tag(acc: Column, token: Column) -> Column:
        digit, letter = token.rlike(r"\d"), token.rlike("[A-Za-z]")
        label = F.when(digit & letter, NAME).when(digit, NUMBER).when(token.rlike(PUNCTUATION), NAME)
        return F.replace(acc, token, label.otherwise(token))

    tagged = F.aggregate(F.split(clean, " "), clean, tag)
    once = F.replace(tagged, F.lit(f"{NAME} {NAME}"), F.lit(NAME))
    return F.replace(once, F.lit(f"{NUMBER} {NUMBER}"), F.lit(NUMBER))


def split_tokens(tokens: Column, marks: str) -> Column:
    """For each mark in turn: tokens that hold it are split there and moved to the end."""

    def step(acc: Column, mark: Column) -> Column:
        pieces = F.flatten(F.transform(F.filter(acc, lambda t: t.contains(mark)), lambda t: F.split(t, F.concat(F.lit("\\Q"), mark, F.lit("\\E")))))
        return F.concat(F.filter(acc, lambda t: ~t.contains(mark)), pieces)

    return F.aggregate(F.array(*(F.lit(m) for m in marks)), tokens, step) if marks else tokens


def is_int(token: Column) -> Column:
    return token.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$")


def is_float(token: Column) -> Column:
    digits = r"\d+(_\d+)*"
    return token.rlike(rf"(?i)^\s*[+-]?(({digits}\.?({digits})?|\.{digits})(e[+-]?{digits})?|inf|infinity|nan)\s*$")


def tokenize(
    text: Column,
    unique: bool = False,
    stop_words: list[str] | None = None,
    exclude_chars: bool = True,
    split_on: str = "/-+_",
    clean_punctuation: bool = False,
    exclude_numbers: bool = False,
    exclude_digit_tokens: bool = False,
    exclude_parentheses: bool = False,
    normalized: bool = True,
    lowercased: bool = True,
) -> Column:
    """Tokens of a name in order; flags as their names say. ``\\w`` covers Unicode letters and digits."""
    if exclude_parentheses:
        text = F.regexp_replace(text, r"\(.+?\)", "")
    if normalized:
        text = normalize(text)
    tokens = F.regexp_extract_all(text, F.lit("(?U)" + TOKEN), F.lit(0))
    if lowercased:
        tokens = F.transform(tokens, F.lower)
    tokens = split_tokens(tokens, split_on)
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(list(stop_words)))
    if clean_punctuation:
        tokens = F.transform(tokens, lambda t: F.regexp_replace(t, PUNCTUATION, ""))
    if exclude_chars:
        tokens = F.filter(tokens, lambda t: F.length(t) > 1)
    if exclude_numbers:
        tokens = F.filter(tokens, lambda t: ~is_int(t) & ~is_float(t))
    if exclude_digit_tokens:
        tokens = F.filter(tokens, lambda t: ~t.rlike(r"\d"))
    return F.array_distinct(tokens) if unique else tokens


def all_upper(token: Column) -> Column:
    """Every character an upper-case letter; true for the empty text."""
    return token.rlike(r"^\p{Lu}*$")


def any_upper(token: Column) -> Column:
    return token.rlike(r"\p{Lu}")


def upper_map(tokens: Column) -> Column:
    """capitalised form -> the upper-case token, the last one winning."""
    upper = F.filter(tokens, lambda t: all_upper(t) & (F.length(t) > 0))
    keyed = F.transform(upper, lambda t: F.struct(F.initcap(t).alias("k"), t.alias("v")))
    last = F.filter(F.transform(keyed, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), (~F.exists(F.slice(keyed, i + 2, F.size(keyed)), lambda y: y["k"] == x["k"])).alias("last"))), lambda x: x["last"])
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def restore_upper(tokens: Column, upper: Column) -> Column:
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(upper, t), t))


def name_parts(text: Column) -> Column:
    """Parts between `` - ``, ``/`` and brackets, trimmed, without empty ones."""
    return F.filter(F.transform(F.filter(F.split(text, r" - |/|\(|\)|\[|\]"), lambda p: p != ""), lambda p: F.trim(p)), lambda p: p != "")


def capwords(text: Column) -> Column:
    """Words capitalised, white space single and trimmed."""
    return F.initcap(F.trim(F.regexp_replace(text, r"\s+", " ")))


def clean_key(text: Column) -> Column:
    """A readable key: leading tags and punctuation go, ``/ , ;`` become ``-``."""
    t = F.replace(text, F.lit("> <"), F.lit("><"))
    t = F.trim(F.regexp_replace(t, r"^[\s=\-+_.:/*',?]*(<number><name>|<name><number>|<name>|<number>)+", ""))
    t = F.regexp_replace(F.replace(t, F.lit("&amp"), F.lit("")), "[/,;]", "-")
    return F.trim(F.regexp_replace(t, r"^[\s=\-+_.:/*',?|]*", ""))


def token_class(token: Column) -> Column:
    """metric, meters, volts, letters, dotted or other."""
    return (
        F.when(token.rlike(r"(?i)^\d+(\.\d+)?(mm|cm|km)$"), "metric")
        .when(token.rlike(r"(?i)^\d+(\.\d+)?m$"), "meters")
        .when(token.rlike(r"(?i)^\d+(\.\d+)?k?v$"), "volts")
        .when(token.rlike(r"^[A-Za-z]+$"), "letters")
        .when(token.rlike(r"^\w+(\.\w+)+$"), "dotted")
        .otherwise("other")
    )


def tag_entities(text: Column) -> Column:
    """E-mails, links, dates and numbers by tags."""
    t = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
    t = F.regexp_replace(t, r"https?://[^\s<>]+|www\.[^\s<>]+", "<link>")
    t = F.regexp_replace(t, r"\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\b", "<date>")
    return F.regexp_replace(t, r"\b\d+(\.\d+)?\b", "<number>")


def split_digits(text: Column) -> Column:
    """Split on ``/ . , -``, strip digits, drop what is left with one character or none."""
    return F.filter(F.transform(F.split(text, "[/.,-]"), lambda t: F.regexp_replace(t, r"\d", "")), lambda t: F.length(t) > 1)


def hyphens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(" - "))


def company_of_file(name: Column) -> Column:
    """File name without extension and date."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"[_\s-]*\d{1,4}[-_.]\d{1,2}[-_.]\d{1,4}", ""))


def clean_label(text: Column) -> Column:
    """``&amp`` goes, ``_`` is a space."""
    return F.translate(F.replace(text, F.lit("&amp"), F.lit("")), "_", " ")


def strip_replacement_char(text: Column) -> Column:
    return F.replace(text, F.lit("�"), F.lit(""))


def safe_name(name: str) -> str:
    """A column or table name: lower case, blanks as ``_``, ``%`` as ``perc``."""
    return name.strip().lower().replace(" ", "_").replace("%", "perc")
