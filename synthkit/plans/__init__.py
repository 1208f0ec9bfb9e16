"""Spec format, the infer → synthesise → validate flow, and the registered query catalog."""
