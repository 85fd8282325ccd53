"""Helpers shared by the tests of the training-data operators."""

import zlib


def crc(doc_id, m):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m
