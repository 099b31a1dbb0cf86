"""Scans, decoders, parsers and sinks."""
