"""maskwright: find, mask and audit personal identifiers in Arabic-English text at table scale, on Spark."""

__version__ = "0.1.0"
