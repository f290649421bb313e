"""Codecs of the engine."""
