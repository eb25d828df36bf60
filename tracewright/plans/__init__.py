"""Driver-side planning: question parsing, the retrieval pipeline, registered queries."""
