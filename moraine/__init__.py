"""moraine: analytics over collections of classic Macintosh archives, on Spark."""

__version__ = "0.1.0"
