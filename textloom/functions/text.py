"""Scalar functions over text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Locale codes (fixed values).
LOCALES = ("en", "zh", "ja", "ko", "fr", "de", "es", "pt", "ru", "ar", "it", "nl", "pl", "tr", "vi", "th", "id", "hi", "bn", "mx", "tw", "cn", "hk", "us", "uk", "br")


def norm_line(line: Column) -> Column:
    """Without Unicode white space (and byte order marks) at either end; inner text and leading +/- stay."""
    return F.regexp_replace(line, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def norm_lines(text: Column) -> Column:
    """The normalised lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n", -1), norm_line), lambda x: x != "")


def token_set(text: Column) -> Column:
    """Distinct lower-case words of ASCII letters, digits and underscores."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+"), lambda x: x != ""))


def strip_front_matter(text: Column) -> Column:
    """Without a block of metadata at the start: from a first line --- to the next line --- or ...; unchanged if it doesn't begin or end so."""
    lines = F.split(text, "\n", -1)
    ends = F.filter(F.transform(lines, lambda x, i: F.when((i > 0) & x.isin("---", "..."), i)), lambda i: i.isNotNull())
    end = F.get(ends, F.lit(0))
    return F.when(text.startswith("---\n") & end.isNotNull(), F.array_join(F.slice(lines, end + 2, F.size(lines)), "\n")).otherwise(text)


def norm_code(code: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(code, F.lit("")), r"\s+", " ")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 1 if both are empty, 0 if one is."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def strip_ext(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./\\]*$", "")


def get_ext(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]*)$", 1)


def strip_locale(path: Column) -> Column:
    """Without the first locale that ends a part between dots: a name of ``LOCALES`` after - or _, or such a name and two more letters."""
    known = lambda x: F.lower(x).isin(*LOCALES)
    parts = F.split(path, r"\.", -1)

    def excess(part):
        names = F.split(part, "[_-]", -1)
        last, before = F.element_at(names, -1), F.when(F.size(names) > 2, F.try_element_at(names, F.lit(-2)))
        return F.when(known(before) & last.rlike("^[A-Za-z]{2}$"), F.length(before) + F.length(last) + 2).when((F.size(names) > 1) & known(last), F.length(last) + 1).otherwise(0)

    cuts = F.transform(parts, excess)
    first = F.array_position(F.transform(cuts, lambda n: n > 0), True)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i + 1 == first, F.left(x, F.length(x) - F.get(cuts, i))).otherwise(x)), ".")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    characters = F.filter(F.split(text, ""), lambda x: x != "")
    n = F.size(characters)
    share = lambda c: F.size(F.filter(characters, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(characters), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def mask(secret: Column, keep: int = 4) -> Column:
    """The first characters, then a star for each of the rest."""
    return F.concat(F.substring(secret, 1, keep), F.repeat(F.lit("*"), F.greatest(F.length(secret) - keep, F.lit(0))))


def bulleted(items: Column) -> Column:
    """One item as it is, several as a list of bullets."""
    return F.when(F.size(items) == 1, F.element_at(items, 1)).otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def change_density(insertions: Column, deletions: Column, diff: Column) -> Column:
    return (insertions + deletions) / F.greatest(F.length(diff), F.lit(1))
