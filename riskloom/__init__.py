"""riskloom: tabular risk modelling and audit operators on Spark DataFrames.

Every operator takes a DataFrame plus column names and returns a DataFrame,
so the plans stay lazy and Catalyst sees the whole query.
"""

from riskloom.session import checkpoint_dir, get_session, sized_broadcast

__all__ = ["get_session", "checkpoint_dir", "sized_broadcast"]
