"""Ordered and stateful operators: answers put together from deltas, event streams, turn memory."""
