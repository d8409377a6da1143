"""Plans over array frames: reductions, windows, sorting, sets, indexing, shapes, products."""
