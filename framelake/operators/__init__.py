"""Operators over series of frames, as DataFrame builders."""
