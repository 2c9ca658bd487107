"""Routing of questions by rules in French and English."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    route: str
    reason: str
    patterns: tuple[str, ...]
    weight: float = 0.9
    boost: tuple[str, ...] = ()


RULES = (
    Rule("summary", "summary intent", (r"\b(résume|resume|summari[sz]e|synthèse|synthese|tl;?dr|en bref|points clés|key points)\b", r"\b(fais|donne).{0,25}\b(résumé|resume|synthèse|synthese)\b"), boost=("summary", "résumé", "synthèse")),
    Rule("sql", "structured data or SQL intent", (r"\b(sql|requête|requete|query|select|join|table|base de données|database)\b", r"\b(ventes|sales|revenu|revenue|ca|chiffre d'affaires|q[1-4]|trimestre|quarter)\b", r"\b(compare|comparer|comparaison).{0,40}\b(q[1-4]|ventes|sales|revenu|revenue)\b"), boost=("sql", "database", "table", "structured", "données")),
    Rule("analytics", "analytical comparison intent", (r"\b(analyse|analyser|compare|comparer|comparaison|évolution|evolution|trend|tendance|pourquoi|why)\b", r"\b(impact|corrélation|correlation|cause|root cause|variance|écart|ecart)\b"), 0.82, ("analysis", "analytics", "analyse")),
    Rule("multi_step", "multi-step reasoning intent", (r"\b(décompose|decompose|étape par étape|step by step|multi[- ]?hop|raisonnement|raisonne)\b", r"\b(compare).{0,50}\b(et|avec|versus|vs\.?|contre)\b"), 0.78),
    Rule("fallback", "current or outside information intent", (r"\b(météo|meteo|weather|actualité|actualités|news|aujourd'hui|today|maintenant|current|latest|dernières nouvelles)\b", r"\b(hors corpus|pas dans les documents|outside the corpus)\b"), 0.88),
    Rule("qa", "factual question intent", (r"\b(qui|quoi|quand|où|ou|comment|combien|what|who|when|where|how many|quelle?|quel)\b", r"\?"), 0.55),
)


def rule_score(query: Column, rule: Rule, description: str = "") -> Column:
    """0 if no pattern is found; else the weight, a little more for each further pattern and for a fitting description, 1 at most."""
    hits = sum((F.lower(query).rlike(f"(?iU){p}").cast("int") for p in rule.patterns), F.lit(0))
    bonus = 0.05 if description and any(b.lower() in description.lower() for b in rule.boost) else 0.0
    return F.when(hits == 0, 0.0).otherwise(F.least(F.lit(1.0), rule.weight + F.least(0.08 * (hits - 1), F.lit(0.1)) + bonus))


def route(query: Column, routes: list[str], descriptions: dict[str, str] | None = None, default: str | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (route, confidence, reason): the best rule, the first at a tie; else the description that shares most words; else the default."""
    if not routes:
        raise ValueError("at least one route is needed")
    descriptions = descriptions or {}
    usable = [r for r in rules if r.route in routes]
    made = lambda name, conf, reason: F.struct(F.lit(name).alias("route"), conf.cast("double").alias("confidence"), F.lit(reason).alias("reason"))
    none = made(default if default in routes else routes[0], F.lit(0.35), "default route")
    words = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    best_overlap, by_words = F.lit(0.0), none
    for name, text in descriptions.items():
        if name in routes:
            own = F.array_distinct(F.regexp_extract_all(F.lower(F.lit(f"{name} {text}")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
            overlap = F.size(F.array_intersect(words, own)) / F.greatest(F.lit(4), F.size(words))
            by_words = F.when(overlap > best_overlap, made(name, F.least(F.lit(0.75), 0.4 + overlap), "route description match")).otherwise(by_words)
            best_overlap = F.greatest(best_overlap, overlap)
    if not usable:
        return by_words
    scores = [rule_score(query, r, descriptions.get(r.route, "")) for r in usable]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = by_words
    for r, s in reversed(list(zip(usable, scores, strict=True))):
        out = F.when((s == top) & (s > 0), made(r.route, s, r.reason)).otherwise(out)
    return out
