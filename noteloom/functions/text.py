"""Scalar text functions: whitespace, token estimate, tokeniser, hashes, paths, labels.

All are built-in column expressions; none starts a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
# White space as JavaScript strings define it (wider than Java's or Spark's own notion).
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS_CLASS = (
    r"\x{09}\x{0A}\x{0B}\x{0C}\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
CJK_CLASS = r"\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}"
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has "
    "had do does did will would could should may might shall can need must it its this that these "
    "those i you he she we they me him her us them my your his our their not no so if as just about"
).split()
LATIN_CHARS_PER_TOKEN = 4.0
CJK_CHARS_PER_TOKEN = 1.5
# ----------------------------------------------------------------------------------------

TOKEN_RUNS = rf"([{CJK_CLASS}]+|[^{CJK_CLASS}{WS_CLASS}\p{{P}}]+)"
# The same runs for Java's patterns. ASCII letters and digits stand first: most characters are settled by them.
_FAST_RUNS = rf"[a-zA-Z0-9[^{CJK_CLASS}{WS_CLASS}\p{{P}}]]++|[{CJK_CLASS}]++"
# In lower-case ASCII text the runs of two or more are these: digits, letters, symbols and control characters.
_ASCII_WORDS = r"[0-9a-z$+<=>^`|~\x00-\x08\x0E-\x1F\x7F]{2,}+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def js_trim(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def js_ltrim(c: Column | str) -> Column:
    return F.ltrim(_col(c), F.lit(WHITESPACE))


def js_rtrim(c: Column | str) -> Column:
    return F.rtrim(_col(c), F.lit(WHITESPACE))


def utf16_length(c: Column | str) -> Column:
    """String length in UTF-16 units; ASCII text (one byte per character) takes the short way."""
    c = _col(c)
    chars = F.char_length(c)
    wide = (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")
    return F.when(F.octet_length(c) == chars, chars).otherwise(wide)


def estimate_tokens(c: Column | str) -> Column:
    """Rough token count: CJK characters weigh 1/1.5, every other UTF-16 unit 1/4."""
    c = _col(c)
    chars = F.char_length(c)
    cjk = F.regexp_count(c, F.lit(f"[{CJK_CLASS}]"))
    mixed = F.ceil(cjk / F.lit(CJK_CHARS_PER_TOKEN) + (utf16_length(c) - cjk) / F.lit(LATIN_CHARS_PER_TOKEN))
    plain = F.ceil(chars / F.lit(LATIN_CHARS_PER_TOKEN))
    return (
        F.when(c.isNull(), F.lit(0))
        .when(F.octet_length(c) == chars, plain)
        .otherwise(mixed)
        .cast("int")
    )


def char_bigrams(c: Column | str) -> Column:
    """All adjacent character pairs in order; empty for strings shorter than two."""
    c = _col(c)
    n = F.char_length(c)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def tokenize(c: Column | str) -> Column:
    """Search tokens: CJK runs become bigrams, other runs lower-cased words without stop words."""
    c = _col(c)
    ascii_words = F.regexp_extract_all(F.lower(c), F.lit(_ASCII_WORDS), F.lit(0))
    runs = F.regexp_extract_all(c, F.lit(_FAST_RUNS), F.lit(0))
    wide = lambda run: F.octet_length(run) > F.char_length(run)  # noqa: E731 - most runs are ASCII and need no pattern
    is_cjk = lambda run: wide(run) & run.rlike(f"^[{CJK_CLASS}]")
    expanded = F.flatten(
        F.transform(runs, lambda r: F.when(is_cjk(r), char_bigrams(r)).otherwise(F.array(F.lower(r))))
    )
    # One character counts as two units when it lies outside the basic plane (4 bytes in UTF-8).
    long_enough = lambda t: (F.char_length(t) > 1) | (F.octet_length(t) == 4)
    return F.when(F.octet_length(c) == F.char_length(c), F.filter(ascii_words, lambda t: ~t.isin(STOP_WORDS))).otherwise(
        F.filter(expanded, lambda t: long_enough(t) & ~t.isin(STOP_WORDS))
    )


def content_hash(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


# --- paths -------------------------------------------------------------------------------


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def base_name(path: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def parent_folder(path: Column | str) -> Column:
    """Folder part of a path, '' for the root."""
    path = _col(path)
    name = F.substring_index(path, "/", -1)  # no pattern: links are many
    return F.when(F.contains(path, F.lit("/")), F.left(path, F.char_length(path) - F.char_length(name) - 1)).otherwise("")


def folder_segments(path: Column | str) -> Column:
    parent = parent_folder(path)
    return F.when(F.contains(_col(path), F.lit("/")), F.split(parent, "/")).otherwise(
        F.array().cast("array<string>")
    )


# --- labels ------------------------------------------------------------------------------


def fixed_digits(x: Column, digits: int) -> Column:
    """Decimal text with ``digits`` places, rounding the exact binary value, exact ties upwards.

    A double can only lie exactly halfway between two such decimals if it is an odd multiple of
    2**-(digits + 1); there half-up applies. Everywhere else correct rounding is unambiguous.
    """
    x = x.cast("double")
    scaled = x * F.lit(float(2 ** (digits + 1)))
    tie = (scaled == F.floor(scaled)) & (F.abs(scaled % 2) == 1)
    pattern = "0." + "0" * digits
    return F.when(tie, F.format_string(f"%.{digits}f", x)).otherwise(F.call_function("format_number", x, F.lit(pattern)))


def token_label(tokens: Column | str) -> Column:
    t = _col(tokens)
    return (
        F.when(t < 1000, t.cast("string"))
        .when(t < 10000, F.concat(fixed_digits(t / 1000, 1), F.lit("K")))
        .otherwise(F.concat(F.floor(t / 1000 + 0.5).cast("string"), F.lit("K")))
    )


def bytes_label(size: Column | str) -> Column:
    s = _col(size)
    return (
        F.when(s < 1024, F.concat(s.cast("string"), F.lit("B")))
        .when(s < 1048576, F.concat(fixed_digits(s / 1024, 1), F.lit("KB")))
        .otherwise(F.concat(fixed_digits(s / 1048576, 1), F.lit("MB")))
    )


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of the wall-clock time (same for both timestamp types under UTC)."""
    origin = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("MICROSECOND", origin, _col(ts).cast("timestamp_ntz"))


def minute_label(ts: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm``; '-' when there is no time (null or the epoch)."""
    ts = _col(ts)
    known = epoch_micros(ts) > 0
    return F.when(known, F.date_format(ts, "yyyy-MM-dd HH:mm")).otherwise("-")


def short_date_label(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "M/d HH:mm")


def short_title(text: Column | str) -> Column:
    """First 30 characters of the trimmed text, with dots when something was cut off."""
    t = js_trim(text)
    return F.when(F.char_length(t) > 30, F.concat(F.substring(t, 1, 30), F.lit("..."))).otherwise(t)


def count_occurrences(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.replace(haystack, needle, F.lit(""))
    return ((F.char_length(haystack) - F.char_length(gone)) / F.char_length(needle)).cast("long")


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Replace the first occurrence of a literal; the text is unchanged when there is none."""
    at = F.position(old, text)
    head = F.substring(text, F.lit(1), at - 1)
    tail = F.substring(text, at + F.char_length(old), F.char_length(text))
    return F.when(at > 0, F.concat(head, new, tail)).otherwise(text)
