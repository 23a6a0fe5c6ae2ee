"""Secondary indexes as clustered copies.

An index keeps the items as Parquet, ranged and sorted by its fields, with Bloom filters on them. A selector on the
leading field then reads few files and row groups: the pushed filter is checked against their least and largest values
and the filters. The key is the last range column, so that a value which many items share is cut over several files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from foliant.functions.paths import get
from foliant.plans.collection import cut_lineage_to, scratch


def constrained(selector: dict) -> set[str]:
    """Paths that every match must satisfy a condition on."""
    out = {k for k in selector if not k.startswith("$")}
    for part in selector.get("$and", []):
        out |= constrained(part)
    return out


class ClusteredIndex:
    """fields: dotted paths, the leading one first. Built on the first query after a change, so writes stay cheap."""

    def __init__(self, *fields: str, key: str = "id", files: int | None = None) -> None:
        if not fields:
            raise ValueError("an index needs a field")
        self.fields, self.key, self.files = fields, key, files
        self.items: DataFrame | None = None
        self.table: DataFrame | None = None

    def rebuild(self, df: DataFrame) -> None:
        self.items, self.table = df, None

    def query(self, selector: dict) -> DataFrame | None:
        if self.items is None or self.fields[0] not in constrained(selector):
            return None
        if self.table is None:
            self.table = self._build(self.items)
        return self.table

    def _build(self, df: DataFrame) -> DataFrame | None:
        by = [c for c in (get(df.schema, f) for f in dict.fromkeys([*self.fields, self.key])) if c is not None]
        if get(df.schema, self.fields[0]) is None:
            return None
        laid = df.repartitionByRange(self.files, *by) if self.files else df.repartitionByRange(*by)
        blooms = {f"parquet.bloom.filter.enabled#{f}": "true" for f in self.fields}
        return cut_lineage_to(laid.sortWithinPartitions(*by), scratch(df.sparkSession), blooms)
