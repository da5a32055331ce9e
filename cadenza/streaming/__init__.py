"""Live turn detection with Structured Streaming state."""
