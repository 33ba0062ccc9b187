"""Reading and writing corpora, vectors and pages."""
