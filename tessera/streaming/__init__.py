"""The stateless operators over Structured Streaming sources."""
