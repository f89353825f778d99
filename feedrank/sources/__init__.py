"""Readers: driver tables, bibliography files, feed lake, landed binaries, caches."""
