"""Operators over ordered events, intervals, vectors, feedback and catalogues."""
