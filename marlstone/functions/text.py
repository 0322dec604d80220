"""Text columns: normal forms, tokens, identifiers. All are built-in expressions, inside whole-stage codegen where Spark has it."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their bare ones, from the Unicode tables."""
    src, dst = ["đ"], ["d"]
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and bare != chr(c) and chr(c) == chr(c).lower():
            src.append(chr(c))
            dst.append(bare)
    return "".join(src), "".join(dst)


SRC, DST = _accents()
#: What a normalised text keeps besides letters and digits.
KEPT = r"[^\p{L}\p{N}_@./:+-]+"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    """Absent text is empty text."""
    return F.coalesce(_col(x).cast("string"), F.lit(""))


def norm(x: Column | str) -> Column:
    """Trimmed lower case; runs of other characters than letters, digits and ``_@./:+-`` are one blank."""
    return F.trim(F.regexp_replace(F.lower(text(x)), KEPT, " "))


def norm_ascii(x: Column | str) -> Column:
    """``norm`` without accents."""
    bare = F.regexp_replace(F.translate(F.lower(text(x)), SRC, DST), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(bare, KEPT, " "))


def slug(x: Column | str) -> Column:
    """Lower-case words joined by hyphens; ``item`` if nothing is left."""
    parts = F.regexp_replace(F.regexp_replace(norm_ascii(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(parts == "", F.lit("item")).otherwise(parts)


def ws(x: Column | str) -> Column:
    """White space collapsed, case kept."""
    return F.trim(F.regexp_replace(text(x), r"\s+", " "))


def words(x: Column | str) -> Column:
    """Runs of non-white space, as an array; empty for an empty text."""
    clean = ws(x)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


#: Words that carry no topic; a caller may give its own.
STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "was", "are")


def keyword_terms(x: Column | str, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Terms of at least three characters: no stopwords, no numbers, at most two characters that are neither letter nor digit."""
    bare = F.transform(F.split(norm_ascii(x), " "), lambda t: F.regexp_replace(t, "^[./:+-]+|[./:+-]+$", ""))
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")

    def good(t: Column) -> Column:
        letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
        return (F.length(t) >= 3) & ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$") & (letters >= F.greatest(F.lit(2), F.length(t) - 2))

    return F.filter(bare, good)


def keyword_id(term: Column | str) -> Column:
    """``kw-``, 24 characters of the term with runs of others than letters, digits and ``._-`` as ``_`` (``default`` if nothing is left), and ten hexadecimal digits."""
    t = text(term)
    safe = F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("kw-"), F.substring(F.when(safe == "", F.lit("default")).otherwise(safe), 1, 24), F.lit("-"), F.substring(F.sha1(t), 1, 10))


def alnum_tokens(x: Column | str, least: int = 1, without: tuple[str, ...] = ()) -> Column:
    """``[a-z0-9]+`` tokens of the normal form, of ``least`` characters at least, without the given words."""
    found = F.regexp_extract_all(norm_ascii(x), F.lit("[a-z0-9]+"), F.lit(0))
    if least > 1:
        found = F.filter(found, lambda t: F.length(t) >= least)
    if without:
        stop = F.array(*[F.lit(w) for w in without])
        found = F.filter(found, lambda t: ~F.array_contains(stop, t))
    return found


def important_tokens(x: Column | str) -> Column:
    """Distinct tokens that are emails, urls, hold a digit or have six characters at least, in order."""
    found = F.regexp_extract_all(norm(x), F.lit(r"[\p{L}\p{N}_@./:+-]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: t.contains("@") | t.contains("http") | t.rlike("[0-9]") | (F.length(t) >= 6)))


def unique_strings(xs: Column, limit: int) -> Column:
    """First of the strings with the same normal form, in order, blanks left out, ``limit`` at most. For short arrays."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        key = norm_ascii(x)
        new = (key != "") & ~F.array_contains(acc.seen, key)
        return F.when(
            new, F.struct(F.concat(acc.seen, F.array(key)).alias("seen"), F.concat(acc.out, F.array(F.trim(x))).alias("out"))
        ).otherwise(acc)

    return F.slice(F.aggregate(xs, start, add, lambda acc: acc.out), 1, limit)


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """Phrases of ``low`` to ``high`` neighbouring tokens, joined by blanks, shortest first."""
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
        return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(none)

    return F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def hint_match(x: Column, hint: str, mode: str) -> Column:
    """Whether a hint is in a normalised text: ``contains``, ``equals``, or ``word`` (a whole word; phrases as substrings)."""
    if mode == "equals":
        return x == hint
    if mode == "word" and " " not in hint:
        return F.concat(F.lit(" "), F.regexp_replace(x, "[^a-z0-9]+", " "), F.lit(" ")).contains(f" {hint} ")
    return x.contains(hint)


def any_hint(x: Column, hints: list[str], mode: str = "contains") -> Column:
    out = F.lit(False)
    for hint in hints:
        out = out | hint_match(x, hint, mode)
    return out


def stable_id(prefix: str, *parts: Column, size: int = 16) -> Column:
    """``prefix-`` and hexadecimal digits of the SHA-1 over the parts, each ended by NUL."""
    joined = F.concat(*[x for p in parts for x in (text(p), F.lit("\0"))])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(joined), 1, size))


def token_overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the distinct query tokens that the text has."""
    return F.size(F.array_intersect(query_tokens, text_tokens)) / F.greatest(F.lit(1), F.size(F.array_distinct(query_tokens)))


def hash_bucket(key: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of the key's SHA-1, as a number."""
    return F.conv(F.substring(F.sha1(key), 1, digits), 16, 10).cast("long")
