"""Cleaning and measuring Markdown notes, as column expressions on one row per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstat.functions import fixed
from quillstat.functions.expr import let

HAN = r"\x{4E00}-\x{9FFF}"


#: What ``\s`` matches in a regular expression.
SPACES = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def count_characters(text: Column, kind: str) -> Column:
    """Number of characters of a class (like ``a-z``); runs of them are taken out at once."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{kind}]++", ""))


def clean_latex(text: Column, keep_percent: bool = False) -> Column:
    """Join spaced digits inside ``$…$``, then drop commands, dollar signs and (by default) percent signs."""
    def join_digits(part):
        part = F.regexp_replace(part, r"(\d)\s+(\d)", "$1$2")
        part = F.regexp_replace(part, r"(\d)\s+(\.)", "$1$2")
        return F.regexp_replace(part, r"(\.)\s+(\d)", "$1$2")

    # the text between formulas and the formulas take turns; a lone dollar sign belongs to the text
    pair = r"\$([^$]+?)\$"
    def join_math(t):
        inner = F.transform(F.regexp_extract_all(t, F.lit(pair), F.lit(1)), join_digits)
        return F.array_join(F.zip_with(F.split(t, pair, -1), inner, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    out = F.when(text.contains("$"), let(text, join_math)).otherwise(text)
    out = F.replace(out, F.lit("$"), F.lit(""))
    out = F.regexp_replace(out, r"\\[a-zA-Z]+", "")
    return out if keep_percent else F.replace(out, F.lit("%"), F.lit(""))


def clean_images(text: Column) -> Column:
    own_line = F.regexp_replace(text, r"(?m)^[^\S\n]*!\[.*?\]\(.*?\)[^\S\n]*$", "")
    return F.regexp_replace(own_line, r"!\[.*?\]\(.*?\)", "")


_CELL = r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"


def _cells(row: Column) -> Column:
    return F.transform(F.regexp_extract_all(row, F.lit(_CELL), F.lit(1)), lambda c: strip(F.regexp_replace(c, r"<[^>]+>", "")))


def table_to_text(table: Column) -> Column:
    """One HTML table → ``header+value`` lines; rows of two or one cells are kept, ragged rows dropped."""
    rows = F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), _cells)

    def line(header, values):
        paired = F.array_join(
            F.filter(F.zip_with(header, values, lambda h, v: F.when(v != "", F.concat(h, v))), lambda x: x.isNotNull()), "；")
        return (F.when(F.size(header) == F.size(values), F.when(paired != "", paired)).when(F.size(values) == 2, F.array_join(values, ""))
                .when(F.size(values) == 1, values[0]))

    def lines(r):
        body = F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
        return F.array_join(F.filter(F.transform(body, lambda v: line(r[0], v)), lambda x: x.isNotNull()), "；")

    return let(rows, lambda r: F.when(F.size(r) > 0, lines(r)).otherwise(""))


def clean_html_tables(text: Column) -> Column:
    """Replace every table by its text."""
    pattern = r"(?is)<table[^>]*>.*?</table>"
    outside = F.split(text, pattern)
    inside = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), table_to_text)
    inside = F.transform(inside, lambda d: F.when(d != "", F.concat(F.lit("\n"), d, F.lit("\n"))).otherwise(""))
    merged = F.array_join(F.flatten(F.zip_with(outside, inside, lambda o, d: F.array(o, F.coalesce(d, F.lit(""))))), "")
    return F.when(text.rlike(r"(?i)<table"), merged).otherwise(text)


def clean_characters(text: Column) -> Column:
    """Keep Han, CJK punctuation and forms, full-width, printable ASCII, tab and line ends; runs of what is kept are read at once."""
    kept = rf"[\x20-\x7E\n\r\t]++|[{HAN}\x{{3000}}-\x{{303F}}\x{{FF00}}-\x{{FFEF}}\x{{FE30}}-\x{{FE4F}}]++"
    return F.array_join(F.regexp_extract_all(text, F.lit(kept), F.lit(0)), "")


def clean_footer(text: Column, guard: float = 0.05) -> Column:
    """Cut from the paragraph of the first disclaimer phrase; empty when less than ``guard`` is left."""
    def said(x):
        return reduce(lambda a, b: a | b, [x.contains(p) for p in fixed.FOOTER_PHRASES])

    def cut(lines):
        hit = F.array_position(F.transform(lines, lambda x: said(x)), True)
        before = F.slice(lines, 1, F.greatest((hit - 1).cast("int"), F.lit(0)))
        return let(before, lambda b: strip(F.array_join(F.slice(b, 1, F.coalesce(F.array_max(F.transform(
            b, lambda x, i: F.when(x.rlike(r"^\s*$"), i + 1).otherwise(0))), F.lit(0))), "\n")))

    kept = let(let(F.split(text, "\n"), cut), lambda k: F.when(F.length(k) < F.length(text) * guard, F.lit("")).otherwise(k))
    return F.when(said(text), kept).otherwise(text)


def clean_all(text: Column, keep_percent: bool = False) -> Column:
    out = clean_images(clean_latex(text, keep_percent))
    out = clean_characters(let(out, clean_html_tables))
    return strip(F.regexp_replace(let(out, clean_footer), r"\n{3,}", "\n\n"))


def estimate_tokens(text: Column) -> Column:
    """⌊Han/1.5 + alphanumerics/3.5 + lines·0.5⌋."""
    han, alnum = count_characters(text, HAN), count_characters(text, "a-zA-Z0-9")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.floor(han / F.lit(1.5) + alnum / F.lit(3.5) + lines * F.lit(0.5)).cast("int")


def classify_section(heading: Column) -> Column:
    def has(words):
        return reduce(lambda a, b: a | b, [heading.contains(w) for w in words])

    first, *rest = fixed.SECTION_LABELS
    chain = reduce(lambda acc, g: acc.when(has(g[0]), F.lit(g[1])), rest, F.when(has(first[0]), F.lit(first[1])))
    return chain.otherwise(F.lit(fixed.OTHER_SECTION))


def base_name(file_name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[^.]*$", "")


def note_metadata(file_name: Column) -> Column:
    """Struct (year, report_type, period) from a file name."""
    name = base_name(file_name)
    year = F.regexp_extract(name, r"(20\d{2})", 1).try_cast("int")

    def first_match(pairs):
        (p0, v0), *rest = pairs
        return reduce(lambda acc, p: acc.when(name.rlike(p[0]), F.lit(p[1])), rest, F.when(name.rlike(p0), F.lit(v0)))

    return F.struct(year.alias("year"), F.coalesce(first_match(fixed.NOTE_KINDS), F.lit(fixed.DEFAULT_NOTE_KIND)).alias("report_type"),
                    first_match(fixed.NOTE_PERIODS).alias("period"))


def tokenize(text: Column) -> Column:
    """Search tokens: words and numbers in lower case, Han runs as bigrams (a single character stays)."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(rf"([\p{{L}}\p{{N}}&&[^{HAN}]]+)"), F.lit(1))
    pairs = F.regexp_extract_all(low, F.lit(rf"(?=([{HAN}]{{2}}))"), F.lit(1))
    single = F.regexp_extract_all(low, F.lit(rf"(?<![{HAN}])([{HAN}])(?![{HAN}])"), F.lit(1))
    return F.when(low.rlike(f"[{HAN}]"), F.concat(words, pairs, single)).otherwise(words)


def bigrams(text: Column, with_single: bool = False) -> Column:
    """Distinct character pairs (and single characters): the join keys of containment joins."""
    pairs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(..))"), F.lit(1)))
    if not with_single:
        return pairs
    return F.array_union(pairs, F.array_distinct(F.split(text, "")))
