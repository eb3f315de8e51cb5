"""Catalogs of tables, external databases, JSON files and declared schemas."""
