"""Arrays that grow: cells and chunks from a stream, appended to a stored array."""
