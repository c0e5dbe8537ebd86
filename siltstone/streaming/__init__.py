"""Replayed event streams: windows, samples, decayed profiles, point-in-time activity."""
