"""Analytics over source code and text corpora on Spark."""

from tesserine.config import Config, load_config

__all__ = ["Config", "load_config"]
