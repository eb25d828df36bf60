"""DataFrame-to-DataFrame operators; each module states the result for odd input."""
