"""Tenant scope: the engine adds it to every operator's input; callers can only narrow it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """Who asks. No knowledge bases means all of the organisation's."""

    organization_id: str
    knowledge_base_ids: tuple[str, ...] = ()
    document_ids: tuple | None = None

    def condition(self, org: str = "organization_id", kb: str = "knowledge_base_id", document: str = "document_id") -> Column:
        if not self.organization_id:
            raise ValueError("an organization is required")
        found = F.col(org) == self.organization_id
        if self.knowledge_base_ids:
            found &= F.col(kb).isin(*self.knowledge_base_ids)
        if self.document_ids is not None:
            found &= F.col(document).isin(*self.document_ids)
        return found


def scoped(df: DataFrame, scope: Scope) -> DataFrame:
    return df.where(scope.condition())


def without_summaries(df: DataFrame) -> DataFrame:
    """Content chunks; a missing flag means content."""
    return df.where(~F.coalesce(F.col("is_summary"), F.lit(False)))


def attached(hits: DataFrame, payloads: DataFrame, keys: list[str], scope: Scope) -> DataFrame:
    """Hits with their stored rows. Tenancy is checked again on what is stored: a hit whose row is another tenant's is dropped."""
    return hits.join(scoped(payloads, scope), keys)
