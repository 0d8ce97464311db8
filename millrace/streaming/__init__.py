"""Message decoding and the streaming consumers."""
