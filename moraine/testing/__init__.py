"""Encoders for archives, wrappers and ciphers that the engine only reads, for tests and for the registered queries."""
