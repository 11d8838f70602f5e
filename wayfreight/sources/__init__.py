"""Readers and writers: file trees, file tables, manifests and the sample star schema."""
