"""Wi-Fi quality scoring for homes, as DataFrame-in / DataFrame-out functions on Spark."""

__version__ = "0.1.0"
