"""ledgerlens: DataFrame-in, DataFrame-out operators for company-filing analytics.

Sub-packages:
  sources    - explicit-schema readers (filing index JSON, HTML, section texts,
               CSV panels, structured facts, the benchmark parquet tables)
  functions  - Column builders (HTML cleanup, word/term counts, number search,
               safe division, label formatting)
  operators  - DataFrame -> DataFrame operators (filings, extraction, features,
               quality, sentiment, statistics, chart frames, sinks)
  plans      - compositions: the three end-to-end flows and the registered
               queries over the benchmark tables
  streaming  - incremental (skip-if-materialised) section extraction as a
               Structured Streaming job
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers of a cluster need not have this package installed: functions
# and classes of it that are sent to them travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
