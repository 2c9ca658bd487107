"""Text functions as native Column expressions, so scans keep them in generated code."""

from __future__ import annotations

import html
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_FR = frozenset(
    "a afin ai ainsi alors au aucun aussi aux avec ce ces cet cette comme dans de des du elle en et etre fait il ils je la le les leur lui mais ne nous "
    "ou par pas pour que qui se ses son sur tu un une vous".split()
)
STOP_EN = frozenset("a an and are as at be by for from has have in is it its of on or that the this to was were with".split())
STOPWORDS = STOP_FR | STOP_EN

WORD = r"[\p{L}\p{N}_]+(?:[\-'][\p{L}\p{N}_]+)*"
def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: Characters whose compatibility decomposition without marks is one other character, and the ligatures, which give several.
_FOLD = {c: p for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if len(p := _plain(c)) == 1 and p != c}
_LIGATURES = {c: _plain(c) for c in "ﬀﬁﬂﬃﬄĳ½¼¾™"}


def fold(text: Column) -> Column:
    """Lower case, straight apostrophes and no accents; letters by a table, combining marks removed. Texts of ASCII are lowered only."""
    low = F.lower(text)
    t = F.translate(low, "".join(_FOLD) + "’", "".join(_FOLD.values()) + "'")
    for k, v in _LIGATURES.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.regexp_replace(t, r"\p{M}+", ""))


def words(text: Column, stopwords: frozenset[str] = STOPWORDS, min_length: int = 2, keep_hyphenated: bool = True) -> Column:
    """Index terms of a text in order: folded words; compounds followed by their parts; no stop words, nothing shorter than min_length but digits."""

    def keep(x: Column) -> Column:
        ok = (F.length(x) > 0) & ((F.length(x) >= min_length) | x.rlike(r"^\p{Nd}+$"))
        return ok & ~x.isin(sorted(stopwords)) if stopwords else ok

    def of(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
        bare = F.transform(found, lambda x: F.regexp_replace(x, r"^[_\-']+|[_\-']+$", ""))
        if keep_hyphenated:
            bare = F.flatten(F.transform(bare, lambda x: F.when(x.contains("-") | x.contains("'"), F.concat(F.array(x), F.filter(F.split(x, "[-']+"), lambda p: p != ""))).otherwise(F.array(x))))
            bare = F.transform(bare, lambda x: F.regexp_replace(x, "^_+|_+$", ""))
        # only texts with these marks have words to trim or to split
        marked = t.contains("_") | t.contains("-") | t.contains("'")
        return F.filter(F.when(marked, bare).otherwise(found), keep)

    # as a lambda's argument the text is folded once
    return F.get(F.transform(F.array(fold(text)), of), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by a space."""
    if n == 2:
        return F.filter(F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    count = F.size(tokens) - F.lit(n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column, ngram_max: int = 2, **how) -> Column:
    """words, followed by their n-grams up to ngram_max."""
    base = words(text, **how)
    if ngram_max < 2:
        return base
    # as a lambda's argument the words are made once, not again for each n-gram
    return F.get(F.transform(F.array(base), lambda w: F.concat(w, *[ngrams(w, n) for n in range(2, ngram_max + 1)])), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences after collapsing white space: split behind a final mark."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?。！？])\s+"), lambda s: F.trim(s) != "")


def sentences_by_capital(text: Column) -> Column:
    """Sentences split where a final mark is followed by a capital or digit; white space inside stays."""
    return F.filter(F.transform(F.split(text, r"(?<=[.?!])\s+(?=[A-ZÀ-Ÿ0-9])"), lambda x: F.trim(x)), lambda s: F.length(s) > 1)


def normalise_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


_ENTITIES = {f"&{k}": v for k, v in html.entities.html5.items() if k.endswith(";") and k[:-1] in {"lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "trade", "middot", "hellip", "mdash", "ndash", "laquo", "raquo", "euro", "eacute", "egrave", "agrave", "ccedil", "lsquo", "rsquo", "ldquo", "rdquo", "bull"}}


def html_to_text(raw: Column) -> Column:
    """Readable text of HTML: scripts and styles gone, block starts as line breaks, other tags as spaces, entities decoded, blank runs collapsed."""
    t = F.regexp_replace(raw, r"(?is)<\s*(script|style).*?>.*?<\s*/\s*\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<\s*(br|p|div|li|h[1-6]|tr)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for k, v in _ENTITIES.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    t = F.replace(F.replace(t, F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def coverage(found: Column, wanted: Column, empty: float = 1.0) -> Column:
    """Share of the distinct wanted items that are found; empty where nothing is wanted."""
    return F.when(F.size(F.array_distinct(wanted)) > 0, F.size(F.array_intersect(found, wanted)) / F.size(F.array_distinct(wanted))).otherwise(empty)


def token_estimate(text: Column) -> Column:
    """About how many model tokens a text has: a quarter of its characters, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4).cast("int"))


def content_terms(text: Column) -> Column:
    """Distinct words of three letters or more without question words."""
    stop = "the and for with that this what which who how est une des les dans pour que qui quoi comment quelle quel quels quelles sur avec aux du de la le".split()
    found = F.regexp_extract_all(F.lower(text), F.lit("[A-Za-zÀ-ÖØ-öø-ÿ0-9_]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(stop)))


def distinct_ignoring_case(items: Column) -> Column:
    """Items with white space collapsed, blank ones and later repeats (in any case) removed, in order."""
    clean = F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    keys = F.transform(clean, F.lower)
    return F.filter(clean, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def query_variants(query: Column, most: int = 4) -> Column:
    """The query, the query without question words, and its first twelve words in lower case."""
    flat = F.trim(F.regexp_replace(query, r"\s+", " "))
    bare = F.trim(F.regexp_replace(flat, r"(?iU)\b(quel|quelle|quels|quelles|comment|pourquoi|est-ce que|what|how|why|which)\b", ""))
    keys = F.array_join(F.slice(F.regexp_extract_all(F.lower(flat), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), 1, 12), " ")
    return F.slice(distinct_ignoring_case(F.array(query, bare, keys)), 1, max(most, 1))


def step_back(query: Column) -> Column:
    """The query and a wider one: general context of its first ten words."""
    found = F.regexp_extract_all(query, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    core = F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, 10), " ")).otherwise(query)
    return distinct_ignoring_case(F.array(query, F.trim(F.concat(F.lit("contexte général "), core))))


def sub_queries(query: Column, most: int = 4) -> Column:
    """The query, its conjuncts of three words or more, and focused queries on comparison, causes and risks."""
    q = F.trim(F.regexp_replace(query, r"\s+", " "))
    low = F.lower(q)
    parts = F.transform(F.split(q, r"(?i)\s+(?:et|puis|ensuite|ainsi que|versus|vs\.?|compared to|and|then)\s+"), lambda p: F.regexp_replace(p, r"^[ ,;:.?\n\t]+|[ ,;:.?\n\t]+$", ""))
    parts = F.filter(parts, lambda p: (F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")) >= 3) & (F.lower(p) != low))
    when = lambda marks, lead: F.when(low.rlike(marks), F.array(F.concat(F.lit(lead), q))).otherwise(F.array().cast("array<string>"))
    every = F.concat(
        F.array(q), parts,
        when("compare|différence|difference|versus| vs ", "Éléments de comparaison pour: "),
        when("pourquoi|cause|raison|explain|why", "Causes et justifications documentées pour: "),
        when("risque|impact|conséquence|consequence", "Risques, impacts et conséquences liés à: "),
    )
    keys = F.transform(every, F.lower)
    return F.slice(F.filter(every, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1), 1, most)


FOLLOW_UP = (
    "et ", "mais ", "donc ", "cela", "celui", "celle", "ce ", "cet ", "cette ", "ces ", "il ", "elle ", "ils ", "elles ", "son ", "sa ", "ses ",
    "leur ", "leurs ", "them", "it", "that", "those", "these", "he ", "she ", "they ", "what about",
)


def is_follow_up(query: Column) -> Column:
    """A question that leans on the turns before it: short, or begun or marked with a back reference."""
    q = F.lower(F.trim(query))
    n = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    starts = q.rlike("^(" + "|".join(FOLLOW_UP) + ")")
    return (n <= 8) | starts | q.rlike(" ce document| ce contrat| cette clause| above| previous")
