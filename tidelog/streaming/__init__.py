"""Streaming twins: the log as a source and a sink, the coordinator as a stateful processor."""
