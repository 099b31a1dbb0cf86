"""Who may see what: filters applied before anything is ranked."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchFilter:
    """A tenant and sets of sources, documents and kinds; ``None`` and an empty set both mean no filter."""

    tenant_id: str
    acl: tuple[str, ...] = ()
    source_ids: tuple[str, ...] | None = None
    document_ids: tuple[str, ...] | None = None
    kinds: tuple[str, ...] | None = None
    current_only: bool = True
    extra: tuple[Column, ...] = field(default=())

    def predicate(self) -> Column:
        """One conjunction that Catalyst pushes into the scan."""
        p = F.col("tenant_id") == self.tenant_id
        for name, values in (("source_id", self.source_ids), ("document_id", self.document_ids), ("kind", self.kinds)):
            if values:
                p = p & F.col(name).isin(*values)
        if self.current_only:
            p = p & F.col("is_current")
        if self.acl:
            p = p & acl_overlap(F.col("acl"), F.array(*map(F.lit, self.acl)))
        for c in self.extra:
            p = p & c
        return p


def acl_overlap(acl: Column, allowed: Column) -> Column:
    """Strict overlap, a missing list counting as public: public must be asked for.  No caller list is no restriction."""
    listed = F.coalesce(acl, F.array(F.lit("public")))
    return F.coalesce(F.size(allowed) <= 0, F.lit(True)) | F.coalesce(F.arrays_overlap(listed, allowed), F.lit(False))


def document_visible(acl: Column, allowed: Column) -> Column:
    """Public documents are always visible, a missing or empty list is public; no caller list sees everything."""
    listed = F.when(F.coalesce(F.size(acl), F.lit(0)) <= 0, F.array(F.lit("public"))).otherwise(acl)
    everyone = F.coalesce(F.size(allowed), F.lit(0)) <= 0
    return everyone | F.array_contains(listed, "public") | F.coalesce(F.arrays_overlap(listed, allowed), F.lit(False))


def titles_matching(versions: DataFrame, needle: str, sources: tuple[str, ...] | None = None) -> DataFrame:
    """(document_id) of current versions whose title holds the needle in any case; % and _ stand for themselves."""
    escaped = needle.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    found = versions.where(F.col("is_current") & F.col("title").ilike(f"%{escaped}%"))
    if sources:
        found = found.where(F.col("source_id").isin(*sources))
    return found.select("document_id").distinct()


def resolve_documents(titled: DataFrame | None, explicit: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Rows of the documents in both sets; a set that is given but empty leaves nothing."""
    for chosen in (titled, explicit):
        if chosen is not None:
            rows = rows.join(chosen.select("document_id").distinct(), "document_id", "left_semi")
    return rows


def heading_contains(path: Column, needle: str) -> Column:
    return F.contains(F.lower(F.array_join(F.coalesce(path, F.array().cast("array<string>")), " ")), F.lit(needle.lower()))


def discriminative(text: Column, share: float = 0.5) -> Column:
    from lectern.functions.text import word_share

    return word_share(text) >= share
