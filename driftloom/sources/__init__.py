"""Where observations and metric streams come from."""
