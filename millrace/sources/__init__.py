"""Readers and writers: seeds, objects, messages."""
