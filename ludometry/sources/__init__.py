"""Schemas, readers and writers, SQL views, and table adapters."""
