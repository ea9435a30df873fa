"""Readers of manifests, logs, documents and sample streams."""
