"""Readers for logs, stored tables and small dimensions."""
