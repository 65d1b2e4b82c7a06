"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_LINES = 3
MAX_EDGE_CHARS = 60
#: What a scale word multiplies by.
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12, "k": 1e3, "m": 1e6, "bn": 1e9, "b": 1e9}
#: Patterns of numbers in questions and answers.
_NUMBER = r"(?i)\(?\$?\s*(-?\d+(?:\.\d+)?)\s*(thousand|million|billion|trillion|bn|k|m|b)?"
_NUMBERS = r"(?i)\(?\$?\s*(-?\d[\d,]*(?:\.\d+)?)\s*(thousand|million|billion|trillion|bn|k|m|b)?"
#: Fixed value: the sentence that an answer must hold to count as a refusal.
REFUSAL = "I cannot answer from the provided context."


def utrim(c: Column) -> Column:
    """Strip all Unicode white space; ``trim`` knows the space only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def signature(line: Column) -> Column:
    """A line with digits masked and case folded, so that page 12 and page 13 agree."""
    return F.regexp_replace(F.lower(utrim(line)), r"(?U)\d+", "#")


def collapse(line: Column) -> Column:
    """Runs of spaces and tabs to one space, ends stripped."""
    return utrim(F.regexp_replace(line, r"[ \t]+", " "))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def search_tokens(text: Column) -> Column:
    """word_tokens; a token that mixes letters and digits also gives its runs: fy2018 -> fy2018, fy, 2018."""
    mixed = lambda w: w.rlike("[0-9]") & w.rlike("[a-z]")  # noqa: E731  few tokens have a digit
    runs = lambda w: F.regexp_extract_all(w, F.lit("[a-z]+|[0-9]+"), F.lit(0))
    split = F.flatten(F.transform(word_tokens(text), lambda w: F.when(mixed(w), F.concat(F.array(w), runs(w))).otherwise(F.array(w))))
    return F.when(text.rlike("[0-9]"), split).otherwise(word_tokens(text))


def search_bag(text: Column) -> Column:
    """The tokens of search_tokens in another order: the runs of mixed tokens at the end. Only mixed tokens meet a lambda."""
    low = F.lower(F.coalesce(text, F.lit("")))
    mixed = F.regexp_extract_all(low, F.lit("[a-z0-9]*(?:[a-z][0-9]|[0-9][a-z])[a-z0-9]*"), F.lit(0))
    runs = F.flatten(F.transform(mixed, lambda w: F.regexp_extract_all(w, F.lit("[a-z]+|[0-9]+"), F.lit(0))))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(text.rlike("[0-9]"), F.concat(words, runs)).otherwise(words)


def distinct_grams(tokens: Column, n: int = 3) -> Column:
    """Distinct runs of n tokens; fewer tokens than n make one gram, none makes none. tokens: a column, not an expression, which each gram would compute anew."""
    return F.array_distinct(grams_of(tokens, n))


def grams_of(tokens: Column, n: int = 3) -> Column:
    """The runs of n tokens in their order; a slice in the lambda would copy all tokens for each."""
    one = lambda i: F.array_join(F.array(*[F.get(tokens, i + j) for j in range(n)]), " ")  # noqa: E731  those beyond the end are null and left out
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), one)
    return F.when(F.size(tokens) > 0, grams).otherwise(F.array().cast("array<string>"))


def citations(answer: Column) -> Column:
    """Sorted distinct numbers of bracket groups such as [2] or [1, 3]."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[[\d,\s]+\]"), F.lit(0))
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\d+"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda d: d.cast("int"))))


def is_refusal(answer: Column, sentence: str = REFUSAL) -> Column:
    return F.contains(F.lower(answer), F.lit(sentence.lower()))


def word_count(text: Column) -> Column:
    bare = utrim(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"(?U)\s+")))


def _factor(scale: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(scale)), F.lit(1.0))


def parse_number(text: Column) -> Column:
    """The first number of a text, with its scale word; negative where a bracket stands before and one after it.

    A scale word needs no word end ("12 basis points" is 12 billion), and the places of brackets are counted in the text without commas.
    """
    bare = F.replace(text, F.lit(","), F.lit(""))
    digits, scale, whole = (F.regexp_extract(bare, _NUMBER, g) for g in (1, 2, 0))
    start = F.regexp_instr(bare, F.lit(_NUMBER))
    value = digits.cast("double") * _factor(scale)
    before, after = F.substring(text, F.lit(1), start), F.substring(text, start + F.length(whole) - 1, F.length(text) + 1)
    value = F.when(F.contains(before, F.lit("(")) & F.contains(after, F.lit(")")), -F.abs(value)).otherwise(value)
    return F.when(digits != "", value)


def numeric_match(gold: Column, answer: Column, tolerance: float = 0.01) -> Column:
    """Null if gold has no number; else whether some number of the answer is within the tolerance."""
    want, said = parse_number(gold), F.coalesce(answer, F.lit(""))
    digits, scales = (F.regexp_extract_all(said, F.lit(_NUMBERS), F.lit(g)) for g in (1, 2))  # no bracket closes within a number, so none is negative by brackets
    numbers = F.zip_with(digits, scales, lambda d, s: F.replace(d, F.lit(","), F.lit("")).cast("double") * _factor(s))
    # Beside each number stands the wanted one: inside a lambda it would be parsed anew for each.
    near = F.zip_with(numbers, F.array_repeat(want, F.size(numbers)), lambda n, w: F.coalesce(F.abs(n - w) <= F.greatest(tolerance * F.abs(w), F.lit(1e-6)), F.lit(False)))
    return F.when(want.isNotNull(), F.exists(near, lambda x: x))


def context_block(contexts: Column) -> Column:
    """array<struct<doc_name, page_number, text>> -> numbered lines with white space collapsed."""
    body = lambda c: utrim(F.regexp_replace(c["text"], r"(?U)\s+", " "))
    line = lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), c["doc_name"], F.lit(" p."), c["page_number"].cast("string"), F.lit(") "), body(c))
    return F.array_join(F.transform(contexts, line), "\n")


def weight_tag(weight: Column) -> Column:
    return F.replace(F.format_string("d%.2f", weight.cast("double")), F.lit("."), F.lit("p"))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def first_of_pair(key: Column) -> Column:
    """Whether the SHA-256 of a key is even: decides which of two answers is shown first."""
    return F.conv(F.right(F.sha2(key.cast("string").cast("binary"), 256), F.lit(1)), 16, 10).cast("int") % 2 == 0


def verdict_of(reply: Column, field: str, allowed: tuple[str, ...], otherwise: str) -> Column:
    """One field of a JSON reply, lower-cased; anything else than the allowed values, or no JSON, is ``otherwise``."""
    value = F.lower(F.get_json_object(reply, f"$.{field}"))
    return F.when(value.isin(*allowed), value).otherwise(F.lit(otherwise))
