"""Readers: test tables, manifests, container layers."""
