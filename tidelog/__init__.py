"""A versioned change-log engine on Spark: atomic groups of document changes, replicas, outboxes, retention and files."""
