"""edusignal — learning-analytics jobs on Spark DataFrames.

Every operator is a function ``DataFrame(s) -> DataFrame``; nothing here
collects data to the driver.  Sessions are created only by callers
(tests, bench, jobs) through :mod:`edusignal.session`.
"""

__version__ = "0.1.0"
