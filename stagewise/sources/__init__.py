"""Sources and sinks: splits, metadata, logs, checkpoints, reports, manifests."""
