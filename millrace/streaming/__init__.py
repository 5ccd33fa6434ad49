"""Document-event dataflow on Structured Streaming."""
