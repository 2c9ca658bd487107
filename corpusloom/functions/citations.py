"""Citations of the form [source: id] in answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import coverage, tokens

_MARK = r"(?i)\[source:\s*([^\]]+)\]"


def citations(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(_MARK), F.lit(1)), lambda x: F.trim(x))


def without_citations(answer: Column) -> Column:
    return F.regexp_replace(answer, _MARK, "")


def unknown_citations(answer: Column, known: Column) -> Column:
    return F.filter(citations(answer), lambda c: ~F.array_contains(known, c))


def citation_coverage(answer: Column, known: Column) -> Column:
    """Share of the known ids that are cited; 1 if none is known."""
    return coverage(citations(answer), known)


def citation_accuracy(answer: Column, allowed: Column) -> Column:
    """Share of the citations, repeats included, that name an allowed id; 1 without citations."""
    c = citations(answer)
    return F.when(F.size(c) > 0, F.size(F.filter(c, lambda x: F.array_contains(allowed, x))) / F.size(c)).otherwise(1.0)


def unsourced_sentences(answer: Column) -> Column:
    """Sentences without a citation, but for those that say that the answer is not known."""
    parts = F.filter(F.transform(F.split(answer, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")
    return F.filter(parts, lambda s: ~F.lower(s).rlike(r"^(je ne sais pas|i don't know|i do not know)") & ~s.rlike(_MARK))


def validate(answer: Column, known: Column, require: bool = False, flag_unsourced: bool = False) -> Column:
    """Struct of citations, unknown and missing ids, unsourced sentences, grounded score, warnings and ok."""
    none = F.array().cast("array<string>")
    cited, unknown = citations(answer), unknown_citations(answer, known)
    missing = F.when((F.size(known) > 0) & (F.size(cited) == 0), known).otherwise(none) if require else none
    unsourced = unsourced_sentences(answer) if flag_unsourced else none
    tag = lambda c, name: F.when(F.size(c) > 0, F.lit(name))
    return F.struct(
        cited.alias("citations"), unknown.alias("unknown"), missing.alias("missing"), unsourced.alias("unsourced"), citation_coverage(answer, known).alias("grounded_score"),
        F.array_compact(F.array(tag(missing, "missing_citations"), tag(unknown, "unknown_citations"), tag(unsourced, "unsourced_claims"))).alias("warnings"),
        ((F.size(unknown) == 0) & (F.size(missing) == 0) & (F.size(unsourced) == 0)).alias("ok"),
    )


def location(source: Column, page: Column, line_start: Column, line_end: Column, char_start: Column, char_end: Column) -> Column:
    """Readable place of a chunk, e.g. "source=a.pdf; page=3; chars=120-260"; parts that are not known are left out."""
    span = lambda name, a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit(f"{name}="), a.cast("string"), F.lit("-"), b.cast("string")))
    return F.concat_ws("; ", F.when(source != "", F.concat(F.lit("source="), source)), F.when(page.isNotNull(), F.concat(F.lit("page="), page.cast("string"))), span("lines", line_start, line_end), span("chars", char_start, char_end))


def groundedness(answer: Column, context: Column) -> Column:
    """Share of the answer's words that the context holds; 1 without words, 0 without context words."""
    a, c = F.array_distinct(tokens(without_citations(answer))), tokens(context)
    return F.when(F.size(a) == 0, 1.0).when(F.size(c) == 0, 0.0).otherwise(F.size(F.array_intersect(a, c)) / F.size(a))


def answer_relevance(answer: Column, query: Column) -> Column:
    """Share of the query's words that the answer holds; 1 without words."""
    return coverage(tokens(answer), tokens(query))
