"""Nothing is streamed: graphs are loaded in batches, and queries run over what is loaded."""
