"""Column functions: text, spans, vectors, judge replies."""
