"""driftloom: drift analytics over model outputs and event streams, on Spark."""
