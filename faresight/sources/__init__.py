"""Sources and sinks: the market view, file readers/writers, manifests."""
