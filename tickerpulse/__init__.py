"""tickerpulse: mention-sentiment research tables on Spark.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column``) function built on
Spark SQL expressions, joins and windows. The pipeline it covers:

raw posts/comments -> cleaned mentions with tickers -> class probabilities ->
daily sentiment per ticker -> sentiment shocks (BUY/SELL) -> market filter ->
trades, equity curves, risk metrics and parameter sweeps.
"""

__version__ = "0.1.0"
