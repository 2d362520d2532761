"""sleuth: agent-forensics analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames (lazy); no operator
collects data to the driver. See README.md for the module map.
"""

__version__ = "0.1.0"
