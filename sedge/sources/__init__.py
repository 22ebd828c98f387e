"""Durable collections."""
