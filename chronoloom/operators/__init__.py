"""DataFrame operators: normalisation, late points, segments, searches, postings, codec statistics."""
