"""Text expressions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of keywords and content terms.
STOPWORDS = (
    "a about after all also an and any are as at be because been but by can could did do does for from had has have how if in into is it its "
    "may more most no not of on one or other our over should some such than that the their them then there these they this those through "
    "to under up was we were what when where which while who will with would you your"
).split()
#: Endings taken off a stem, longest first.
SUFFIXES = ("ations", "ation", "ments", "ment", "ings", "ing", "ness", "ies", "ed", "es", "ly", "s")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def casefold(text: Column | str) -> Column:
    """Lower case with sharp s written out."""
    return F.replace(F.lower(_c(text)), F.lit("ß"), F.lit("ss"))


def tokens(text: Column | str) -> Column:
    """Runs of a-z and 0-9 of more than two characters, in order."""
    return F.filter(F.regexp_extract_all(casefold(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2)


def keywords(text: Column | str) -> Column:
    """Distinct words of four letters or more (inner hyphens allowed) that are no stop words, in order."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[a-z][a-z\-]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*(F.lit(w) for w in STOPWORDS)))


def content_terms(text: Column | str) -> Column:
    """Distinct tokens that are no stop words."""
    return F.array_except(F.array_distinct(tokens(text)), F.array(*(F.lit(w) for w in STOPWORDS)))


def stem(word: Column) -> Column:
    """A word without the first ending that leaves four letters or more."""
    out = word
    for ending in reversed(SUFFIXES):
        out = F.when(word.endswith(ending) & (F.length(word) - len(ending) >= 4), F.left(word, F.length(word) - F.lit(len(ending)))).otherwise(out)
    return out


def normalise(text: Column | str) -> Column:
    """Hyphens at line breaks joined, lower case, anything but letters and digits as one space."""
    joined = F.regexp_replace(_c(text), r"([A-Za-z])-\s*\n\s*([a-z])", "$1$2")
    return F.trim(F.regexp_replace(F.lower(joined), "[^a-z0-9]+", " "))


def words(text: Column | str) -> Column:
    """Parts between white space."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def runs(items: Column, n: int) -> Column:
    """All runs of n elements as arrays."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - F.lit(n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, F.lit(n)))


def ngrams(items: Column, low: int, high: int) -> Column:
    """All runs of low to high elements, joined by spaces, short runs first."""
    return F.concat(*(F.transform(runs(items, n), lambda r: F.array_join(r, " ")) for n in range(low, high + 1)))


def shingles(text: Column | str, n: int = 12) -> Column:
    """Distinct runs of n words of the normalised text."""
    return F.array_distinct(ngrams(words(normalise(text)), n, n))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of a's elements that b has; 0 for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def snippet(text: Column | str, cap: int = 280) -> Column:
    """White space collapsed; beyond cap characters cut after a whole word, with ' ...'."""
    flat = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    cut = F.regexp_replace(F.substring(flat, 1, cap), " [^ ]*$", "")
    return F.when(F.length(flat) <= cap, flat).otherwise(F.concat(cut, F.lit(" ...")))


def pages(text: Column | str, size: int = 2400) -> Column:
    """Array of (offset, page, next_offset); next_offset is null on the last page."""
    t = _c(text)
    offsets = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size)))
    return F.transform(
        offsets,
        lambda o: F.struct(o.alias("offset"), F.substring(t, o + 1, F.lit(size)).alias("page"), F.when(o + size < F.length(t), o + size).alias("next_offset")),
    )


def windows(items: Column, size: int, overlap: int) -> Column:
    """Array of (start, items): windows of size elements that start every size - overlap; the last ends with the array."""
    n = F.size(items)
    step = size - overlap
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(step)).cast("int")) * step, F.lit(step)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(items, s + 1, F.lit(size)).alias("items")))


def stable_id(*parts: Column | str, length: int = 16) -> Column:
    """Hex prefix of the SHA-256 of the parts joined by the unit separator; null parts as empty text."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts)), 256), 1, length)


def slug(text: Column | str, default: str = "item") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(default)).otherwise(out)


def doi(text: Column | str) -> Column:
    """Lower case, without resolver prefix and outer spaces."""
    return F.regexp_replace(F.lower(F.trim(_c(text))), r"^(https?://)?(dx\.)?doi\.org/|^doi:\s*", "")


def strip_citations(text: Column | str) -> Column:
    """Without bracketed citation numbers, and without the spaces they leave."""
    out = F.regexp_replace(_c(text), r"\s*\[[0-9]+(?:\s*[,;–-]\s*[0-9]+)*\]", "")
    return F.trim(F.regexp_replace(out, r" +([.,;])", "$1"))


def citation_numbers(text: Column | str) -> Column:
    """Numbers cited in brackets, ranges expanded, distinct in order; ranges that run backwards or are wider than 100 are dropped."""
    groups = F.regexp_extract_all(_c(text), F.lit(r"\[([0-9]+(?:\s*[,;–-]\s*[0-9]+)*)\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[,;]\s*")))

    def expand(p: Column) -> Column:
        ends = F.transform(F.split(p, r"\s*[–-]\s*"), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int"))
        low, high = ends[0], F.element_at(ends, -1)
        return F.when((low <= high) & (high - low <= 100), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(parts, expand)))


def numbers(text: Column | str) -> Column:
    """Distinct numbers in order, without trailing zeros; whole numbers of one digit are left out."""
    found = F.regexp_extract_all(_c(text), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    kept = F.filter(found, lambda x: (F.length(x) > 1))
    return F.array_distinct(F.transform(kept, lambda x: F.when(x.contains("."), F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")).otherwise(x)))


#: Fixed value: a number with a unit.
QUANTITY = r"[0-9]+(?:\.[0-9]+)?\s?(?:MPa m\^1/2|MPa|GPa|HV|nm|µm|mm|K|°C|%|h|s|kJ/mol|eV)"


def quantities(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(QUANTITY + r"(?![A-Za-z])"), F.lit(0))


def token_estimate(text: Column | str) -> Column:
    return F.floor(F.length(_c(text)) / 4).cast("long")


def sentences(text: Column | str) -> Column:
    """Parts between sentence ends, trimmed."""
    marked = F.regexp_replace(_c(text), r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, r"\n+"), lambda s: F.trim(s)), lambda s: s != "")
