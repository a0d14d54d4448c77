"""Batch and streaming jobs that turn raw document tables into retrieval-ready knowledge tables."""
