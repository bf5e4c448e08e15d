"""Ingestion of association results as they arrive, by Structured Streaming."""

from .ingest import ingest_gwas, variant_counts

__all__ = ["ingest_gwas", "variant_counts"]
