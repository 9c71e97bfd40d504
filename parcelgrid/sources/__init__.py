"""Readers, cleaning steps and sinks. Schemas are declared, never inferred."""
