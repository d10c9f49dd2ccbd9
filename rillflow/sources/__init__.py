"""Streams of lines, JSON documents and keyed records."""
