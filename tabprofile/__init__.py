"""tabprofile: a distributed table profiler on Spark DataFrames.

Every operator takes a DataFrame (and options) and returns a DataFrame with a
fixed, long-form schema.  Nothing but O(columns) literals is collected to the
driver.
"""

__version__ = "0.1.0"
