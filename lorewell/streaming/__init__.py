"""Structured Streaming over the event log and the queue of notes without vectors."""
