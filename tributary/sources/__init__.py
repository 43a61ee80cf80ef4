"""Readers, connector and tenant descriptions, sinks."""
