"""shelfkin: content-based similarity and recommendation over a catalogue, as Spark jobs.

Every operator is a function from DataFrame to DataFrame (or Column to Column).  Fitted
state is a DataFrame too, nothing runs at import, and no session is held globally.
"""

__version__ = "0.1.0"
