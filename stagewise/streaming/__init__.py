"""Structured Streaming: plateau detection on training traces, checkpoint logs, event windows."""
