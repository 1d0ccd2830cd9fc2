"""Reusable schemas and row validation."""
