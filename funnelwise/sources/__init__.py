"""Schemas, loaders and the derivation of the shop tables from ``events``."""

from funnelwise.sources.schema import SCHEMAS, ShopTables, check_keys, conform
from funnelwise.sources.loader import read_shop_tables, tables_for
from funnelwise.sources.events_fixture import derive_shop_tables

__all__ = [
    "SCHEMAS",
    "ShopTables",
    "check_keys",
    "conform",
    "derive_shop_tables",
    "read_shop_tables",
    "tables_for",
]
