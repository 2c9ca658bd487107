"""Tenants, their collections, and what a principal may read in them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import Policy, Principal, readable

ACL_LISTS = ("allowed_users", "allowed_roles", "denied_users", "denied_roles")


def with_lists(df: DataFrame) -> DataFrame:
    """Access columns as ARRAY<STRING>: a scalar becomes a list of one, an empty string or null an empty list."""
    for f in df.schema.fields:
        if f.name in ACL_LISTS and not isinstance(f.dataType, T.ArrayType):
            c = F.col(f.name).cast("string")
            df = df.withColumn(f.name, F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.array(c)))
    return df


def principal_of(values: dict[str, Any]) -> Principal:
    """A principal of loose values: lists, tuples, sets or single strings."""
    many = lambda v: frozenset([v] if isinstance(v, str) else map(str, v or ()))
    return Principal(str(values.get("user_id") or "anonymous"), many(values.get("roles")), many(values.get("tenant_ids")), many(values.get("collection_ids")), str(values.get("max_classification") or "internal"))


@dataclass
class Tenant:
    tenant_id: str
    name: str | None = None
    enabled: bool = True
    default_collection: str | None = None
    collections: dict[str, Any] = field(default_factory=dict)


class Registry:
    """Tenants and their collections; a collection's target is a frame of documents or a retriever (queries, k -> hits)."""

    def __init__(self) -> None:
        self.tenants: dict[str, Tenant] = {}

    def add_tenant(self, tenant_id: str, name: str | None = None, enabled: bool = True) -> Tenant:
        return self.tenants.setdefault(tenant_id, Tenant(tenant_id, name, enabled))

    def add_collection(self, tenant_id: str, collection_id: str, target: Any, default: bool = False) -> None:
        """The first collection of a tenant is its default until another is made so."""
        t = self.add_tenant(tenant_id)
        t.collections[collection_id] = target
        if default or t.default_collection is None:
            t.default_collection = collection_id

    def find(self, tenant_id: str, collection_id: str | None = None) -> tuple[str, Any]:
        """(collection_id, target); unknown tenants and collections are a KeyError, disabled tenants a PermissionError."""
        t = self.tenants.get(tenant_id)
        if t is None:
            raise KeyError(f"unknown tenant: {tenant_id}")
        if not t.enabled:
            raise PermissionError(f"tenant is disabled: {tenant_id}")
        name = collection_id or t.default_collection
        if name is None or name not in t.collections:
            raise KeyError(f"tenant {tenant_id} has no collection {name}")
        return name, t.collections[name]

    def retrieve(self, search_in: Callable[[DataFrame], Callable], queries: DataFrame, tenant_id: str, principal: Principal = Principal(), collection_id: str | None = None, k: int = 5, policy: Policy = Policy()) -> DataFrame:
        """Hits of a tenant's collection with tenant_id and collection_id. Documents are filtered by the principal's rights before the search, so k hits remain k.

        The tenant asked for counts among the principal's tenants for this call only.
        """
        name, target = self.find(tenant_id, collection_id)
        here = replace(principal, tenant_ids=principal.tenant_ids | {tenant_id}, collection_ids=principal.collection_ids | {name})
        if isinstance(target, DataFrame):
            hits = search_in(readable(with_lists(target), here, policy).drop("access_decision"))(queries, k)
        else:
            hits = target(queries, k)
        return hits.withColumn("tenant_id", F.lit(tenant_id)).withColumn("collection_id", F.lit(name))

    def stats(self) -> dict[str, Any]:
        return {
            "tenant_count": len(self.tenants), "collection_count": sum(len(t.collections) for t in self.tenants.values()),
            "tenants": {t.tenant_id: {"enabled": t.enabled, "default_collection_id": t.default_collection, "collections": list(t.collections)} for t in self.tenants.values()},
        }
