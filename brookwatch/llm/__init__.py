"""Operators for building training corpora out of documents and web pages."""
