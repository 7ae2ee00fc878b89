"""maldadum: Korean text correction and correction-corpus analytics on PySpark DataFrames."""

__version__ = "0.1.0"
