"""Text normalisation as column expressions over posting bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that separate blocks, and the named entities that bodies use.
BLOCK_TAGS = "(?is)<br\\s*/?>|</?(?:p|div|h[1-6]|li|ul|ol)[^>]*>"
ANY_TAG = "(?is)<[^>]+>"
#: The same block tags with what their forms share told once, which is searched faster; white space that isn't one blank.
_BLOCK, _UNEVEN = "(?is)<(?:br\\s*/?|/?(?:p|div|h[1-6]|li|ul|ol)[^>]*)>", "\\s{2,}|[^\\S ]"
HIDDEN = "(?is)<(script|style|template|noscript)[^>]*>.*?</(script|style|template|noscript)>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
SENTENCE_END = "(?<=[.!?])\\s+(?=[A-Z#*])"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once a row: no filter or projection above can repeat them."""
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", made)


def unescape(text: Column) -> Column:
    """Common character references, the ampersand last."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _UNEVEN, " "))


def html_to_text(html: Column) -> Column:
    """Tags become blanks, references are decoded, white space is collapsed."""
    html = F.coalesce(html, F.lit(""))
    return squeeze(unescape(F.regexp_replace(F.regexp_replace(html, _BLOCK, " "), ANY_TAG, " ")))


def html_to_lines(html: Column) -> Column:
    """Non-empty lines of a body, as an array; block tags end lines."""
    html = F.coalesce(html, F.lit(""))
    text = unescape(F.regexp_replace(F.regexp_replace(html, _BLOCK, "\n"), ANY_TAG, " "))
    return F.filter(F.transform(F.split(text, "\n"), squeeze), lambda x: x != "")


def visible_text(html: Column) -> Column:
    """Lines of a page without scripts and styles, joined by line feeds."""
    return F.array_join(html_to_lines(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")), "\n")


def split_sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda x: x != "")


def clean_provider_html(html: Column) -> Column:
    """Encoded newlines and empty paragraphs become breaks; three breaks or more become two."""
    html = F.regexp_replace(html, "(?i)(&#10;|&#13;|\\\\n)+", "<br>")
    html = F.regexp_replace(html, "(?i)(<p>(\\s|&nbsp;)*</p>\\s*)+", "<br>")
    return F.regexp_replace(html, "(?i)(<br\\s*/?>\\s*){3,}", "<br><br>")


def normalize_lower(text: Column) -> Column:
    """The form that matching and digests use."""
    return F.lower(squeeze(unescape(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))))


def token_set(text: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Sorted distinct lower-case words of two letters or more."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " ")
    words = F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))
    return F.array_sort(F.array_except(words, F.array(*[F.lit(w) for w in ignored])) if ignored else words)


def shingles(text: Column, size: int) -> Column:
    """Distinct word shingles; fewer words make one."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
    made = lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<string>")).when(F.size(ws) < size, F.array(F.array_join(ws, " "))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(ws) - size + 1), lambda i: F.array_join(F.slice(ws, i, size), " "))))
    return F.transform(F.array(words), made)[0]


def excerpt(text: Column, at: Column, most: int = 160) -> Column:
    """``most`` characters around the one-based place ``at``, with ellipses where it is cut."""
    first = F.greatest(at - most // 3, F.lit(1))
    cut = F.substring(text, first, F.lit(most))
    return F.concat(F.when(first > 1, "…").otherwise(""), F.trim(cut), F.when(first + most <= F.length(text), "…").otherwise(""))


def mask_names(text: Column, pattern: Column, token: str = "the employer") -> Column:
    """Names given by a pattern column are replaced, their case ignored."""
    return F.regexp_replace(text, F.concat(F.lit("(?i)"), pattern), F.lit(token))


def word_place(text: Column, pattern: str) -> Column:
    """One-based number of the word at which the first match of a heading's pattern begins, or null."""
    at = F.regexp_instr(text, F.lit(pattern))
    before = F.filter(F.split(F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0))), "\\s+"), lambda w: w != "")
    return F.when(at > 0, F.size(before) + 1)


def span_windows(n: Column, capacity: int, strategy: str, duty: Column | None = None, qualification: Column | None = None) -> Column:
    """One-based word places kept of ``n`` words: prefix, head_tail, head_mid_tail or sections.

    sections keeps a quarter from the head, half from the first duty heading and a quarter from the first
    qualification heading (places of words; without one the middle and the tail).  What overlaps saves goes to more of
    the head, so ``capacity`` places are kept whenever there are as many.
    """
    half, third, quarter = capacity // 2, capacity // 3, capacity // 4
    run = lambda a, b: F.when(b >= a, F.sequence(a.cast("int"), b.cast("int"))).otherwise(F.array().cast("array<int>"))
    one = F.lit(1)
    if strategy == "prefix":
        parts = [run(one, F.least(n, F.lit(capacity)))]
    elif strategy == "head_tail":
        parts = [run(one, F.least(n, F.lit(half))), run(F.greatest(one, n - half + 1), n)]
    elif strategy == "sections":
        rest = capacity - quarter - half
        middle = F.greatest(one, F.least(F.coalesce(duty, F.floor((n - half) / 2) + 1), n - half + 1))
        tail = F.greatest(one, F.least(F.coalesce(qualification, n - rest + 1), n - rest + 1))
        parts = [run(one, F.least(n, F.lit(quarter))), run(middle, F.least(n, middle + half - 1)), run(tail, F.least(n, tail + rest - 1))]
        kept = reduce(F.array_union, parts)
        more = F.slice(F.array_except(run(one, n), kept), F.lit(1), F.greatest(F.lit(capacity) - F.size(kept), F.lit(0)))
        return F.array_sort(F.concat(kept, more))
    else:
        mid = F.greatest(one, F.floor(n / 2) - third // 2)
        parts = [run(one, F.least(n, F.lit(third))), run(mid, F.least(n, mid + third - 1)), run(F.greatest(one, n - third + 1), n)]
    return F.array_sort(reduce(F.array_union, parts))
