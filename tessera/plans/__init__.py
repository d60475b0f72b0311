"""Configuration and compilation of output plans."""
