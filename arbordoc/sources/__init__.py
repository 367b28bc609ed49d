"""Codecs, readers and writers of documents."""
