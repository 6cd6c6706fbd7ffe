"""Column functions: angles, confidences, planar shapes, names and projections."""
