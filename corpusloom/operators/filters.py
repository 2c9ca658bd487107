"""Metadata predicates and access control, compiled to one Column so that Catalyst can push them into the scan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LADDER = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3, "secret": 4}


def _no() -> Column:
    return F.lit(False)



def _members(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]


def _is_in(c: Column, values: Iterable) -> Column:
    values = list(values)
    known = c.isin([v for v in values if v is not None]) if any(v is not None for v in values) else _no()
    return F.coalesce(known, _no()) | (c.isNull() if None in values else _no())


def _one(c: Column, kind: T.DataType, op: str, value: Any) -> Column:
    number = isinstance(kind, T.NumericType)
    comparable = number == isinstance(value, (int, float)) or not isinstance(value, (int, float, str))
    order = {"$gt": c > value, "$gte": c >= value, "$lt": c < value, "$lte": c <= value} if op in {"$gt", "$gte", "$lt", "$lte"} else {}
    if order:
        return F.coalesce(order[op], _no()) if comparable else _no()
    if op == "$eq":
        return F.coalesce(c == value, _no())
    if op == "$ne":
        return F.coalesce(c != value, _no())
    if op == "$in":
        return _is_in(c, _members(value))
    if op == "$nin":
        return ~_is_in(c, _members(value))
    if op == "$contains":
        if isinstance(kind, T.StringType):
            return F.coalesce(c.contains(str(value)), _no())
        return F.coalesce(F.array_contains(c, value), _no()) if isinstance(kind, T.ArrayType) else _no()
    return _no()


def matches(schema: T.StructType, filters: Mapping[str, Any] | None, dialect: str = "metadata") -> Column:
    """Predicate of a filter mapping: equality, membership for lists, $eq $ne $in $nin $exists $contains $gt $gte $lt $lte; all must hold.

    A null or absent column is a missing key: every operator but $exists fails on it, also $ne and $nin. Types that don't
    compare fail. With dialect "self_query" $ne and $nin hold for missing keys and unknown operators are ignored.
    """
    kinds = {f.name: f.dataType for f in schema.fields}
    tests: list[Column] = []
    for key, want in (filters or {}).items():
        there = F.col(key).isNotNull() if key in kinds else _no()
        c, kind = (F.col(key), kinds[key]) if key in kinds else (F.lit(None).cast("string"), T.StringType())
        if isinstance(want, Mapping):
            for op, value in want.items():
                if op == "$exists":
                    tests.append(there if value else ~there)
                elif dialect == "self_query" and op in {"$ne", "$nin"}:
                    tests.append(~there | _one(c, kind, op, value))
                elif dialect == "self_query" and op not in {"$eq", "$in", "$contains", "$gt", "$gte", "$lt", "$lte"}:
                    continue
                else:
                    tests.append(there & _one(c, kind, op, value))
        elif isinstance(want, (list, tuple, set, frozenset)):
            tests.append(_is_in(c, want))
        else:
            tests.append(c.isNull() if want is None else F.coalesce(c == want, _no()))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filter_metadata(df: DataFrame, filters: Mapping[str, Any] | None, dialect: str = "metadata") -> DataFrame:
    return df.where(matches(df.schema, filters, dialect))


def merged(base: Mapping[str, Any] | None, extra: Mapping[str, Any] | None) -> dict:
    """Filters of a call over those of the index: a key of extra replaces the same key of base."""
    return {**(base or {}), **(extra or {})}


@dataclass(frozen=True)
class Principal:
    user_id: str = "anonymous"
    roles: frozenset[str] = frozenset()
    tenant_ids: frozenset[str] = frozenset()
    collection_ids: frozenset[str] = frozenset()
    max_classification: str = "internal"


@dataclass(frozen=True)
class Policy:
    tenant_match: bool = True
    collection_match: bool = False
    allow_public: bool = True
    default_classification: str = "internal"
    equals: Mapping[str, Any] = field(default_factory=dict)
    one_of: Mapping[str, Iterable] = field(default_factory=dict)


def access_reason(schema: T.StructType, principal: Principal, policy: Policy = Policy()) -> Column:
    """Why a row may be read or not, "allowed" if it may. Uses those of the columns tenant_id, collection_id, classification, allowed_users, allowed_roles, denied_users, denied_roles that are there.

    Tests in order: denied user or role, allow lists, tenant, collection (admins pass both; rows without one too),
    classification (unknown labels count as internal), then the policy's own conditions.
    """
    names = set(schema.fieldNames())
    none = F.array().cast("array<string>")
    array = lambda n: F.coalesce(F.col(n), none) if n in names else none
    scalar = lambda n: F.col(n) if n in names else F.lit(None).cast("string")
    roles = F.array(*[F.lit(r) for r in sorted(principal.roles)]).cast("array<string>")
    admin = "admin" in principal.roles
    tests = [
        (F.array_contains(array("denied_users"), principal.user_id), "user_explicitly_denied"),
        (F.arrays_overlap(array("denied_roles"), roles), "role_explicitly_denied"),
        ((F.size(array("allowed_users")) > 0) & ~F.array_contains(array("allowed_users"), principal.user_id), "user_not_allowed"),
        ((F.size(array("allowed_roles")) > 0) & ~F.arrays_overlap(array("allowed_roles"), roles), "role_not_allowed"),
    ]
    if policy.tenant_match and not admin:
        tests.append((scalar("tenant_id").isNotNull() & ~_is_in(scalar("tenant_id"), principal.tenant_ids), "tenant_mismatch"))
    if policy.collection_match and not admin:
        tests.append((scalar("collection_id").isNotNull() & ~_is_in(scalar("collection_id"), principal.collection_ids), "collection_mismatch"))
    label = F.lower(F.coalesce(scalar("classification"), F.lit(policy.default_classification)))
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LADDER.items() for x in kv]), label), F.lit(1))
    public = (label == "public") if policy.allow_public else _no()
    tests.append((~public & (level > LADDER.get(principal.max_classification.lower(), 1)), "classification_too_high"))
    tests += [(~F.coalesce(scalar(k) == v, _no()), "metadata_equals_failed") for k, v in policy.equals.items()]
    tests += [(~_is_in(scalar(k), v), "metadata_in_failed") for k, v in policy.one_of.items()]
    reason = F.lit("allowed")
    for test, name in reversed(tests):
        reason = F.when(test, name).otherwise(reason)
    return reason


def readable(df: DataFrame, principal: Principal, policy: Policy = Policy()) -> DataFrame:
    """The rows that the principal may read, with access_decision."""
    return df.withColumn("access_decision", access_reason(df.schema, principal, policy)).where("access_decision = 'allowed'")
