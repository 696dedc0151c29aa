"""Quarryloom: analytics over captured web pages and text corpora, expressed as DataFrame operators."""
