"""Lets tests import their helpers whatever folder pytest starts in."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import data  # noqa: E402

__all__ = ["brute", "data"]
