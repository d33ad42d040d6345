"""Readers: articles, stop words, word vectors."""
