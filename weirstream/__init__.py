"""weirstream: integrity analytics over generated text streams, on Spark tables and streams."""

__version__ = "0.1.0"
