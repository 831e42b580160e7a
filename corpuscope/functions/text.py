"""Text functions (Column in, Column out). All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from .. import taxonomy as tx


def as_col(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def array_of(values: Sequence[str]) -> Column:
    """A literal string array; an empty list keeps its element type."""
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False)) if conditions else F.lit(False)


# -- substring counts --------------------------------------------------------

def term_count(lowered, term: str) -> Column:
    """Non-overlapping occurrences of ``term`` as a plain substring of lower-cased text."""
    lowered, needle = as_col(lowered), term.lower()
    removed = F.octet_length(lowered) - F.octet_length(F.replace(lowered, F.lit(needle), F.lit("")))
    return F.when(
        lowered.contains(needle), F.floor(removed / len(needle.encode()))
    ).otherwise(F.lit(0).cast("long"))


def lowered_keyword_count(lowered, terms: Sequence[str]) -> Column:
    """Sum of :func:`term_count` over ``terms``; give it a column, not an expression.

    Terms count independently, so one that lies inside another counts for both. Empty or
    missing text gives 0. The ``contains`` guard keeps the replacement off the texts
    (nearly all of them) that do not hold the term.
    """
    return sum((term_count(lowered, t) for t in terms), F.lit(0).cast("long"))


def keyword_count(text, terms: Sequence[str]) -> Column:
    """Case-insensitive :func:`lowered_keyword_count` of a text."""
    return lowered_keyword_count(F.lower(as_col(text)), terms)


def library_hits(lowered, libraries: Sequence[str]) -> Column:
    """How many of the library names occur in a lower-cased manifest (presence, not frequency)."""
    lowered = F.coalesce(as_col(lowered), F.lit(""))
    return sum((lowered.contains(lib.lower()).cast("long") for lib in libraries),
               F.lit(0).cast("long"))


def readme_length(text) -> Column:
    """Length in characters (code points); a missing README has length 0."""
    return F.coalesce(F.length(as_col(text)), F.lit(0)).cast("long")


# -- encoded and list-valued input -------------------------------------------

def decode_content(encoded) -> Column:
    """Base64 (line-wrapped or not) to text; bytes that are not UTF-8 are left out."""
    return valid_text(F.unbase64(as_col(encoded)))


def valid_text(raw) -> Column:
    """UTF-8 bytes to text without the bytes that are not; a real U+FFFD stays.

    Bytes with a genuine U+FFFD are cut at its three bytes first, so that every mark the
    repair puts in stands for a bad byte.
    """
    mark = "\ufffd"
    raw = as_col(raw)
    plain = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), mark, "")
    # in hexadecimal two digits are a byte, so a split there meets whole bytes only
    real = "EFBFBD"
    parts = F.split(F.regexp_replace(F.hex(raw), "(..)", "$1 "), "EF BF BD ")
    mended = F.array_join(F.transform(parts, lambda p: F.regexp_replace(
        F.make_valid_utf8(F.unhex(F.replace(p, F.lit(" "), F.lit(""))).cast("string")), mark, "")), mark)
    return F.when(F.contains(raw, F.unhex(F.lit(real))), mended).otherwise(plain)


def parse_topics(text) -> Column:
    """A list literal such as ``['a', 'b']`` (or JSON) to an array; anything else gives []."""
    text = as_col(text)
    parsed = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    return F.coalesce(parsed, F.array().cast("array<string>"))


# -- tutorial tokens -----------------------------------------------------------

def norm_tokens(text, topics) -> Column:
    """Distinct lower-case alphanumeric tokens of ``text`` plus each whole topic."""
    words = F.split(F.lower(F.coalesce(as_col(text), F.lit(""))), "[^a-z0-9]+")
    tags = F.transform(
        F.coalesce(as_col(topics), F.array().cast("array<string>")),
        lambda t: F.trim(F.lower(t)),
    )
    return F.array_distinct(F.filter(F.concat(words, tags), lambda w: w != ""))


def plural_forms(word: str, no_plural: Sequence[str] = tx.TUTORIAL_NO_PLURAL) -> tuple[str, ...]:
    """The word with its simple plurals, unless it is listed as having none."""
    return (word,) if word in no_plural else (word, word + "s", word + "es")


def tutorial_hit(text, topics, words: Sequence[str] = tx.TUTORIAL_WORDS,
                 phrases: Sequence[str] = tx.TUTORIAL_PHRASES) -> Column:
    """``struct(keyword, token)`` of the first tutorial rule that fires, else NULL.

    Words are tried in list order against whole tokens; the phrases follow as substrings. Tokens and lower
    case are computed once a row, as the variable of a function over one element, and the rules are tried only where
    one of them fires.
    """
    def rules(of: Column) -> Column:
        tokens, flat = of["tokens"], of["flat"]
        fires = [F.when(
            F.arrays_overlap(tokens, array_of(plural_forms(word))),
            F.struct(F.lit(word).alias("keyword"), F.array_min(F.array_intersect(tokens, array_of(plural_forms(word)))).alias("token")),
        ) for word in words]
        fires += [F.when(
            flat.contains(phrase),
            F.struct(F.lit(phrase).alias("keyword"), F.lit(phrase).alias("token")),
        ) for phrase in phrases]
        forms = array_of([form for word in words for form in plural_forms(word)])
        return F.when((F.size(F.array_intersect(tokens, forms)) > 0) | any_of([flat.contains(p) for p in phrases]), F.coalesce(*fires))

    seen = F.struct(norm_tokens(text, topics).alias("tokens"), F.lower(as_col(text)).alias("flat"))
    return F.transform(F.array(seen), rules)[0]


# -- README clean-up -----------------------------------------------------------

def clean_readme(md) -> Column:
    """Fenced code, inline code, URLs and markdown marks become spaces, in that order.

    The patterns of the first three begin their work only where the text holds what all their matches do; the
    spaces put in bring no new one about.
    """
    text = as_col(md)
    for needed, pattern in (("```", "(?s)" + tx.CODE_FENCE), ("`", tx.INLINE_CODE), ("://", "(?U)" + tx.URL)):
        text = F.when(as_col(md).contains(needed), F.regexp_replace(text, pattern, " ")).otherwise(text)
    return F.regexp_replace(text, tx.MARKDOWN_MARKS, " ")


LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"
BLANKS = " \t\x1f  　"


def text_lines(text, min_letters: int = 20) -> Column:
    """Array of trimmed lines that hold at least ``min_letters`` ASCII letters."""
    lines = F.transform(F.split(as_col(text), LINE_BREAK), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.filter(lines, lambda x: x.rlike(f"\\A(?:[^a-zA-Z]*+[a-zA-Z]){{{min_letters}}}"))


def readme_lang(share, threshold: float = tx.ENGLISH_THRESHOLD) -> Column:
    """``en`` from the threshold on, ``non-en`` below it, NULL when undetectable."""
    share = as_col(share)
    return F.when(share >= threshold, "en").when(share.isNotNull(), "non-en")


# -- mentions --------------------------------------------------------------------

def scrub(text) -> Column:
    """URLs, then e-mail addresses, become one space each."""
    text = as_col(text)
    no_url = F.when(text.contains("://"), F.regexp_replace(text, "(?U)" + tx.URL, " ")).otherwise(text)
    return F.when(
        no_url.contains("@"), F.regexp_replace(no_url, "(?U)" + tx.EMAIL, " ")
    ).otherwise(no_url)


def fold_case(text) -> Column:
    """Lower case for guards in front of a Unicode case-insensitive pattern.

    The pattern also equates four non-ASCII letters with i, s and k; texts that are pure
    ASCII skip their replacement.
    """
    text = as_col(text)
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.lower(F.translate(text, "İıſK", "iisk"))
    )


def bounded_pattern(keyword: str) -> str:
    """Case-insensitive literal that no ASCII letter or digit touches on either side."""
    return r"(?iu)(?<![A-Za-z0-9])" + re.escape(keyword) + r"(?![A-Za-z0-9])"


def keyword_candidates(folded, keywords: Sequence[str]) -> Column:
    """Indexes of the keywords that occur as plain substrings of a case-folded text column.

    NULL if none does, which is the usual case and is found without building an array.
    """
    folded = as_col(folded)
    occurs = [folded.contains(kw.lower()) for kw in keywords]
    return F.when(any_of(occurs), F.array_compact(F.array(*[
        F.when(hit, i) for i, hit in enumerate(occurs)])))


def first_hit(text, pattern) -> Column:
    """0-based offset, in characters, of the first match; NULL without one.

    It is the length of the text in front of the match, because ``regexp_instr`` counts
    UTF-16 units.
    """
    parts = F.split(as_col(text), as_col(pattern), 2)
    return F.when(F.size(parts) == 2, F.length(parts[0]))


def context_window(text, pos, keyword, margin: int = tx.SNIPPET_MARGIN) -> Column:
    """The hit with up to ``margin`` characters on either side, clipped at the text's ends."""
    pos, size = as_col(pos), F.length(as_col(keyword))
    before = F.least(pos, F.lit(margin))
    return F.substring(as_col(text), pos - before + 1, before + size + margin)


def clean_snippet(context, limit: int = tx.SNIPPET_LENGTH) -> Column:
    """Control characters except tab vanish, then whitespace collapses; first ``limit`` kept.

    A line break is a control character, so the words it separates join up.
    """
    printable = F.regexp_replace(as_col(context), "[\\x00-\\x08\\x0A-\\x1F]", "")
    return F.substring(F.trim(F.regexp_replace(printable, r"(?U)\s+", " ")), 1, limit)


def first_class(text, classes, default: str, lowered=None) -> Column:
    """First class, in list order, one of whose cues is a substring of the lower-cased text.

    ``lowered`` is a column that holds the lower-cased text already; without it Spark lower-cases the text
    for every cue.
    """
    lowered = F.lower(as_col(text)) if lowered is None else as_col(lowered)
    rules = [F.when(any_of([lowered.contains(c) for c in cues]), F.lit(name)) for name, cues in classes]
    return F.coalesce(*rules, F.lit(default))


def classify_context(context, lowered=None) -> Column:
    return first_class(context, tx.CONTEXT_HINTS, "unspecified", lowered)


def mention_type(context, lowered=None) -> Column:
    return first_class(context, tx.MENTION_CUES, "reference", lowered)


def is_testing_related(context, artifact, has_test_infra, context_type=None) -> Column:
    """Classified, or names a testing term, or is structural in a repository that tests."""
    context_type = classify_context(context) if context_type is None else as_col(context_type)
    structural = as_col(artifact).isin("commit_trailer", "config_artifact")
    return F.coalesce(
        (context_type != "unspecified")
        | as_col(context).rlike("(?iuU)" + tx.TESTING_TERMS)
        | (structural & F.coalesce(as_col(has_test_infra), F.lit(False))),
        F.lit(False),
    )


def confidence(artifact, context_type, testing_related) -> Column:
    """Base score by artifact, more if classified, less if not about testing; in [0.05, 1]."""
    artifact = as_col(artifact)
    base = (
        F.when(artifact.isin("commit_trailer", "config_artifact"), 0.9)
        .when(artifact == "commit_message", 0.55).otherwise(0.5)
    )
    score = (
        base + F.when(as_col(context_type) != "unspecified", 0.15).otherwise(0.0)
        - F.when(as_col(testing_related), 0.0).otherwise(0.2)
    )
    return F.round(F.least(F.greatest(score, F.lit(0.05)), F.lit(1.0)), 2)


def trailer_tool(message) -> Column:
    """Tool named in the first co-author trailer that names one, as written; else NULL.

    ``(?d)`` makes the dot stop at a line feed only.
    """
    return F.nullif(F.regexp_extract(as_col(message), "(?iudU)" + tx.TRAILER, 1), F.lit(""))


def catalog_flag(full_name, description, topics) -> Column:
    """Is this a curated list rather than a project?

    Topics are rendered as a quoted list, so that a phrase cannot span two of them.
    """
    topics = as_col(topics)
    listed = F.when(F.size(topics) > 0, F.concat(
        F.lit("['"), F.array_join(topics, "', '"), F.lit("']"))).otherwise(F.lit("[]"))
    prose = F.concat_ws(" ", F.coalesce(as_col(description), F.lit("")), listed)
    return F.coalesce(
        F.lower(as_col(full_name)).rlike(tx.CATALOG_NAME)
        | prose.rlike("(?iuU)" + tx.CATALOG_TEXT),
        F.lit(False),
    )


def exclusion_reason(stage) -> Column:
    """Text in front of the first colon."""
    return F.substring_index(as_col(stage), ":", 1)
