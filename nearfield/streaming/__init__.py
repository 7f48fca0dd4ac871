"""Streaming search requests."""

from .requests import REQUEST_SCHEMA, answer_batch, serve

__all__ = ["REQUEST_SCHEMA", "answer_batch", "serve"]
