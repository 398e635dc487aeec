"""Audit-knowledge analytics as PySpark DataFrame operators."""

from riskloom.graph import AuditGraph

__all__ = ["AuditGraph"]
