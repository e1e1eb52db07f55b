"""Running statistics over growing tree sets and traces."""
