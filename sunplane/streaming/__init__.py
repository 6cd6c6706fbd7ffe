"""An addition of this engine: new point tables are measured as they arrive."""
