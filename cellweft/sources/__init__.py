"""Readers of text formats, matrices, manifests and bundles."""
