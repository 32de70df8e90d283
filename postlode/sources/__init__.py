"""Readers and writers of store files, reports and manifests."""
