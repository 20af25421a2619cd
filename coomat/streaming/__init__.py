"""Edge streams: degrees kept up to date with Structured Streaming."""
