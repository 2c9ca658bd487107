"""Compositions: retrieval pipelines, presets and workflows."""
