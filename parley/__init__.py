"""Spark jobs that judge chat-agent conversations at scale."""
