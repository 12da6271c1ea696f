"""Column functions on text: tokenisers, normalisers, cleaners. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A letter as Python's [^\W\d_] has it; plain \w is ASCII only in Java.
LETTER = r"[\p{L}\p{Nl}\p{No}]"
#: One class for what follows the first letter: an alternative there would cost Java a call for each letter.
WORD = rf"{LETTER}[\p{{L}}\p{{Nl}}\p{{No}}'’\-]*+"
LEXICAL = rf"{LETTER}++(?:['’\-]{LETTER}++)*+"
ASCII_WORD = r"[A-Za-z][A-Za-z'\-]*"
EDGES = r"^['’\-]+|['’\-]+$"
END_MARKS = ("'", "’", "-")
SPACE_ENDS = r"(?U)^\s+|\s+$"
#: Names of languages by code; and prose around the texts of a well-known library.
LANGUAGES = {"en": "English", "es": "Spanish"}
START_MARK = r"(?is)^.*?\*\*\* START OF (?:THE )?PROJECT GUTENBERG EBOOK.*?\*\*\*"
END_MARK = r"(?is)\*\*\* END OF (?:THE )?PROJECT GUTENBERG EBOOK.*"


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    """Corpus tokens: letters, then letters, apostrophes and hyphens."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lexical_tokens(text: Column) -> Column:
    """Case-folded tokens for diversity: apostrophes and hyphens only between letters."""
    return F.transform(F.regexp_extract_all(text, F.lit(LEXICAL), F.lit(0)), casefold)


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(ASCII_WORD), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(text, SPACE_ENDS, "")


def normalize_word(word: Column) -> Column:
    """Lower case without apostrophes and hyphens at its ends; empty if that isn't one token."""
    clean = F.regexp_replace(F.lower(strip(word)), EDGES, "")
    return F.when(clean.rlike(f"^(?:{WORD})$"), clean).otherwise(F.lit(""))


def match_keys(token: Column) -> tuple[Column, Column]:
    """The two keys that a token is looked up by: lower case, then that without trailing marks."""
    low = F.lower(token)
    return low, F.regexp_replace(low, r"['’\-]+$", "")


def is_capitalized(token: Column) -> Column:
    return token.rlike(r"(?U)^\p{Upper}")


def normalize_language(language: Column) -> Column:
    clean = strip(F.coalesce(language, F.lit("")))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(clean == "", F.lit("English")).otherwise(F.coalesce(F.try_element_at(known, F.lower(clean)), clean))


def is_spanish(language: Column, missing: bool = True) -> Column:
    """es, es-*, spanish*, spa*; what a missing language counts as is a choice of the source."""
    low = F.lower(strip(F.coalesce(language, F.lit(""))))
    return F.when(low == "", F.lit(missing)).otherwise(low.rlike(r"^(?:es$|es-|spanish|spa)"))


def strip_boilerplate(text: Column) -> Column:
    """What stands behind the first start mark, where there is one, and before the first end mark."""
    return F.regexp_replace(F.regexp_replace(text, START_MARK, ""), END_MARK, "")


def slug(text: Column, lower: bool = True, most: int | None = None) -> Column:
    """Runs of other characters than ASCII letters and digits become one underscore; never empty."""
    clean = strip(F.lower(text) if lower else text)
    out = F.regexp_replace(F.regexp_replace(clean, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    out = F.left(out, F.lit(most)) if most else out
    return F.when(out == "", F.lit("words")).otherwise(out)


def canonical_path(path: Column, root: str = "data/processed/") -> Column:
    """From the corpus root on, with forward slashes."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    at = F.instr(clean, root)
    return F.when(at > 0, F.substr(clean, at)).otherwise(clean)


def excerpt(prefix: Column, match: Column) -> Column:
    return F.concat(F.regexp_replace(prefix, r"(?U)\s+$", ""), F.lit(" "), match)


def significant(value: Column, digits: int = 8) -> Column:
    """Rounded to so many significant digits."""
    return F.format_string(f"%.{digits - 1}e", value).cast("double")


def format_p(p: Column) -> Column:
    """<.001, else three decimals without the zero before the point."""
    return F.when(p < 0.001, F.lit("<.001")).otherwise(F.regexp_replace(F.format_string("%.3f", p), r"^0", ""))


def model_short_name(model: Column) -> Column:
    return F.element_at(F.split(model, "/"), -1)


def model_variant(model: Column) -> Column:
    """instruct or base, by a model's name."""
    return F.when(F.lower(model).rlike("instruct|-it|chat|distill"), F.lit("instruct")).otherwise(F.lit("base"))


def html_text(html: Column) -> Column:
    """Text of an HTML document's blocks (h1-h3, p, blockquote, li), else of all its lines."""
    clean = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1\s*>", " ")
    blocks = F.regexp_extract_all(clean, F.lit(r"(?is)<(?:h[1-3]|p|blockquote|li)(?:\s[^>]*)?>(.*?)(?=</?(?:h[1-3]|p|blockquote|li)[\s>]|$)"), F.lit(1))
    plain = lambda x: strip(F.regexp_replace(_unescaped(F.regexp_replace(x, r"(?s)<[^>]*>", "")), r"(?U)\s+", " "))
    found = F.filter(F.transform(blocks, plain), lambda x: x != "")
    lines = F.filter(F.transform(F.split(F.regexp_replace(clean, r"(?s)<[^>]*>", "\n"), "\n"), plain), lambda x: x != "")
    return F.array_join(F.when(F.size(found) > 0, found).otherwise(lines), "\n")


def _unescaped(text: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text
