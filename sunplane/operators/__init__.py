"""Relational operators of the engine: assignment, clipping, plane fits, roofs, heights, mounting, statistics."""
