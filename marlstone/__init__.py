"""marlstone: compression and signal-quality analytics as Spark DataFrame programs."""
