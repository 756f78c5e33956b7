"""Text functions: trimming, matching, similarity, hashing, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(text: Column) -> Column:
    """Without white space, line ends included, at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    return F.lower(trimmed(text))


def holds(text: Column, part: Column) -> Column:
    """Whether text contains part, whatever their case; false where either is null."""
    return F.coalesce(F.contains(F.lower(text), F.lower(part)), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance's share of the longer length, on trimmed lower-case labels; equal ones give 1."""
    x, y = normalised(a), normalised(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(x, y) / longest)


def most_edits(longest: Column, least: float) -> Column:
    """No fewer edits than a similarity over `least` allows two labels whose longer length is `longest`."""
    return (F.ceil(longest * F.lit(1 - least) + F.lit(1e-9)) - 1).cast("int")


def over_similarity(a: Column, b: Column, least: float) -> Column:
    """similarity(a, b) > least, cheap tests first: lengths, then an edit distance that stops at its bound."""
    x, y = normalised(a), normalised(b)
    longest = F.greatest(F.length(x), F.length(y))
    edits = F.call_function("levenshtein", x, y, most_edits(longest, least))
    near = (edits >= 0) & (F.lit(1.0) - edits / longest > F.lit(least))
    return (F.abs(F.length(x) - F.length(y)) <= F.lit(1 - least) * longest) & F.when(x == y, F.lit(least < 1)).otherwise(near)


def sha_prefix(text: Column) -> Column:
    """The first 16 bytes of SHA-256, as hex."""
    return F.left(F.sha2(text, 256), F.lit(32))


def flexible_pattern(snippet: Column) -> Column:
    """A pattern that matches the snippet's words, in any case, with any white space between them."""
    words = F.filter(F.split(trimmed(snippet), r"\s+"), lambda w: w != "")
    return F.concat(F.lit("(?i)"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), r"\s+"))


def flexible_match(text: Column, snippet: Column) -> Column:
    """What of text matches the snippet first, white space aside; null if nothing or the snippet is blank."""
    found = F.regexp_substr(text, flexible_pattern(snippet))
    return F.when(trimmed(snippet) != "", found)


def folded_find(text: Column, snippet: Column) -> Column:
    """Whether text has the snippet, case and accents aside."""
    return F.contains(F.collate(text, "UNICODE_CI_AI"), F.collate(snippet, "UNICODE_CI_AI"))


def passage_found(text: Column, snippet: Column) -> Column:
    """A snippet is found as it stands, case and accents aside, or else with flexible white space; never if blank."""
    return F.when(trimmed(snippet) == "", F.lit(False)).otherwise(F.coalesce(folded_find(text, snippet), F.lit(False)) | flexible_match(text, snippet).isNotNull())


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def quoted_json(text: Column) -> Column:
    """Double quotes escaped, and nothing else."""
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def marked_node(contents: Column, prefix: str) -> Column:
    """The node id in an annotation's contents after the prefix, if it is a UUID; else null."""
    return F.nullif(F.regexp_extract(contents, rf"^{prefix}([0-9A-Fa-f]{{8}}(?:-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}})$", 1), F.lit(""))


def ordered_join(order: Column, text: Column, separator: str) -> Column:
    """An aggregate: texts joined in the order given."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda r: r["t"]), separator)


def percent(confidence: Column) -> Column:
    """Whole per cent, cut off."""
    return (confidence * 100).cast("int")


# Signs of formulas, and of operators.
FORMULA_SIGNS = "∑∫∂∇≈≠≤≥∈∉⊂⊃∪∩→←⇒⇔∀∃∞αβγδεθλμπσφω"
OPERATOR_SIGNS = "=+-*/^_{}()[]"


def looks_like_equation(text: Column) -> Column:
    """Over two formula signs, or operators over 0.3 of a text longer than 5."""
    count = lambda signs: F.length(text) - F.length(F.translate(text, signs, ""))
    return (count(FORMULA_SIGNS) > 2) | ((F.length(text) > 5) & (count(OPERATOR_SIGNS) / F.length(text) > 0.3))


def block_class(text: Column, height: Column, median: Column, y: Column, page_height: Column) -> Column:
    """A block's class by ordered rules: the first that holds decides."""
    n = F.length(text)
    return (
        F.when(looks_like_equation(text), "equation")
        .when((height > median * 1.4) & (n < 120), "heading")
        .when((n > 3) & (n < 80) & (text == F.upper(text)) & ~text.rlike("[a-z]"), "heading")
        .when((y < page_height * 0.15) & (n < 200), "footnote")
        .when((height < median * 0.7) & (n < 150), "caption")
        .when(F.lower(text).startswith("figure ") | F.lower(text).startswith("fig. "), "caption")
        .otherwise("body")
    )
