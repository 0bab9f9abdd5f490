"""Auditloom: provenance analytics over system-call audit logs, on Spark."""
