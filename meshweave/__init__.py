"""Graph and Bayesian-network analytics on Spark DataFrames."""

from .api import *  # noqa: F403
from .api import __all__ as __all__
