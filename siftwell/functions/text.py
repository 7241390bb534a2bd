"""Text functions as Catalyst expressions."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, in code order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def clean_text(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def strip_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def tokens(c: Column) -> Column:
    """Lower-case words without punctuation; empty ones dropped. Null gives an empty array."""
    t = F.split(strip_punctuation(F.lower(F.trim(F.coalesce(c, F.lit(""))))), r"\s+")
    return F.filter(t, lambda x: x != "")


def tokens_by_word(c: Column) -> Column:
    """Split first, strip punctuation inside each word: a word of punctuation alone stays as an empty token."""
    t = F.split(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+")
    return F.transform(t, strip_punctuation)


def alphanumeric_terms(c: Column) -> Column:
    """Search terms: lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def term_count(c: Column) -> Column:
    """How many ``alphanumeric_terms`` there are."""
    return F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"))


def clean_tokens(c: Column) -> Column:
    """Tokens with all but Latin, Cyrillic letters, digits, hyphens and underscores replaced by spaces."""
    t = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{IsLatin}\p{IsCyrillic}0-9_\-]+", " "), " ")
    return F.filter(t, lambda x: x != "")


def prefixed(c: Column, prefix: str) -> Column:
    """Serving rule: prepend as is unless the text starts with it."""
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def prefixed_for_training(c: Column, prefix: str) -> Column:
    """Training rule: both parts trimmed, one space between; an empty prefix leaves the trimmed text."""
    return F.trim(F.concat(F.lit(prefix.strip() + " "), F.trim(c)))


def clip(c: Column, length: int = 6000) -> Column:
    return F.substring(c, 1, length)


def shorten(c: Column, length: int) -> Column:
    """At most ``length`` characters, then an ellipsis of three dots."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def rfc3339(c: Column) -> Column:
    """A timestamp (or text that can be cast to one) with microseconds and a Z; null where it is none."""
    t = c.try_cast("timestamp")
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def is_number(c: Column) -> Column:
    return c.try_cast("double").isNotNull()


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def payload_queries(c: Column) -> Column:
    """Query texts of a JSON payload: a list, or an object with one of the keys queries, rephrases, questions, items (first found)."""
    listed = F.from_json(c, "array<string>")
    keys = ("queries", "rephrases", "questions", "items")
    named = F.from_json(c, ", ".join(f"{k} array<string>" for k in keys))
    starts = F.substring(F.trim(c), 1, 1)
    found = F.when(starts == "[", listed).when(starts == "{", F.coalesce(*(named[k] for k in keys))).otherwise(F.array(c))
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def base64_text(c: Column) -> Column:
    """Base64 of the text's UTF-8 bytes in one line, whatever the session says about lines of 76 characters."""
    return F.translate(F.base64(F.encode(c, "utf-8")), "\r\n", "")


def base64_back(c: Column) -> Column:
    return F.decode(F.unbase64(c), "utf-8")


def snapshot(separator: str = "|", **columns: Column) -> Column:
    """``key=value`` parts joined by the separator."""
    return F.concat_ws(separator, *(F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in columns.items()))


def paragraphs(texts: Column) -> Column:
    """``Paragraph i: text`` lines of an array."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("Paragraph "), i.cast("string"), F.lit(": "), x)), "\n")


_SLOT = re.compile(r"\{\{\s*([\w.]+)\s*\}\}")


def render(template: str, fields: dict[str, Column]) -> Column:
    """A template with ``{{ a.b }}`` slots; unknown or null ones are empty."""
    parts, at = [], 0
    for m in _SLOT.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(fields[m[1]].cast("string"), F.lit("")) if m[1] in fields else F.lit("")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def sha1_tag(c: Column, length: int = 10) -> Column:
    return F.upper(F.substring(F.sha1(c), 1, length))


def collection_name(c: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def camel_case(c: Column) -> Column:
    """Words at other than letters and digits, each with its first letter upper."""
    w = F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda x: x != "")
    return F.array_join(F.transform(w, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def file_name(c: Column) -> Column:
    """Portable file name: runs of other characters than letters, digits, dot, hyphen, underscore become one underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def attention_mask(ids: Column, length: int) -> Column:
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def term_frequencies(toks: Column) -> Column:
    """Map of token to count."""
    return F.aggregate(
        F.array_distinct(toks), F.create_map().cast("map<string,int>"),
        lambda m, t: F.map_concat(m, F.create_map(t, F.size(F.filter(toks, lambda x: x == t)))),
    )


def inverse_idf_recall(query: Column, doc: Column) -> Column:
    """Share of the query tokens' weight 1 / ln(1 + tf) that the document holds.

    tf counts in the document, 1 where absent; query tokens count as often as they stand. An
    empty query gives 0.
    """
    weight = lambda t: F.lit(1.0) / F.log1p(F.greatest(F.lit(1), F.size(F.filter(doc, lambda x: x == t))).cast("double"))
    total = F.aggregate(query, F.lit(0.0), lambda a, t: a + weight(t))
    held = F.aggregate(query, F.lit(0.0), lambda a, t: a + F.when(F.array_contains(doc, t), weight(t)).otherwise(0.0))
    return F.when(F.size(query) == 0, 0.0).otherwise(held / total)


def keyword_recall(query: Column, doc: Column) -> Column:
    """Unnormalised sum of 1 / ln(1 + tf) over distinct query tokens that the document holds."""
    common = F.array_intersect(F.array_distinct(query), doc)
    return F.aggregate(common, F.lit(0.0), lambda a, t: a + F.lit(1.0) / F.log1p(F.size(F.filter(doc, lambda x: x == t)).cast("double")))


def common_words(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(a), F.array_distinct(b)))


#: What coverage statistics leave in a text besides letters and digits.
COVERAGE_SYMBOLS = "'#!@$%^&*()-=+[]{}|\\:;\"<>,.?/"


def _others(kept: str) -> str:
    """A class of all characters but ``kept``, as ranges: Java matches them several times as fast as a negated class."""
    ranges, at = [], 0
    for p in [*sorted(map(ord, set(kept))), 0x110000]:
        if p > at:
            ranges.append(f"\\x{{{at:x}}}-\\x{{{p - 1:x}}}")
        at = p + 1
    return f"[{''.join(ranges)}]"


_COVERED = string.ascii_letters + string.digits + COVERAGE_SYMBOLS + "".join(map(chr, range(0x410, 0x450)))
_BETWEEN = _others(_COVERED) + "+"


def coverage_words(c: Column) -> Column:
    """Lower-case words: Latin or Cyrillic letters, digits and symbols, split where anything else stands."""
    return F.array_remove(F.split(F.lower(c), _BETWEEN), "")


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated once for each row, however often ``f`` reads it."""
    return F.transform(F.array(c), f)[0]


def coverage(queries: Column, content: Column, keywords: Column) -> Column:
    """``LQ, LD, LQD, LKD, LKED``: mean words of the queries; words of the content; mean share of its words that a query
    holds; the same summed over keywords, and over keywords with their explanations. Empty contents and no queries give 0.
    """
    named = F.filter(keywords, lambda k: k["keyword_or_phrase"].isNotNull())
    told = F.filter(named, lambda k: k["explanation"].isNotNull())
    words = {
        "asked": F.transform(F.filter(queries, lambda q: q.isNotNull()), coverage_words),
        "named": F.transform(named, lambda k: coverage_words(k["keyword_or_phrase"])),
        "told": F.transform(told, lambda k: coverage_words(F.concat(k["keyword_or_phrase"], F.lit("\n"), k["explanation"]))),
    }

    def figures(p: Column) -> Column:
        ld, n = p["size"].cast("double"), F.size(queries).cast("double")
        share = lambda t: F.when(ld > 0, F.size(F.array_intersect(t, p["held"])) / ld).otherwise(0.0)
        total = lambda k, f: F.aggregate(p[k], F.lit(0.0), lambda a, t: a + F.coalesce(f(t), F.lit(0.0)))
        mean = lambda f: F.when(n > 0, total("asked", f) / n).otherwise(0.0)
        return F.struct(
            mean(lambda t: F.size(t).cast("double")).alias("LQ"), ld.alias("LD"), mean(share).alias("LQD"),
            total("named", share).alias("LKD"), total("told", share).alias("LKED"),
        )

    # The content is split once; of its words only those count that are looked for.
    sought = lambda p: F.flatten(F.concat(*(F.coalesce(p[k], F.array().cast("array<array<string>>")) for k in words)))
    split = F.struct(coverage_words(content).alias("doc"), *(w.alias(k) for k, w in words.items()))
    found = lambda p: F.struct(F.size(p["doc"]).alias("size"), F.array_intersect(p["doc"], sought(p)).alias("held"), *(p[k].alias(k) for k in words))
    return _once(_once(split, found), figures)
