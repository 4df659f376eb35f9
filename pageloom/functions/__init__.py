"""Package of the pageloom engine."""
