"""roadlens: incident analytics as Spark DataFrame operators.

Every operator is a plain function ``op(df, **params) -> DataFrame`` (stateless
projections) or a ``fit(df, ...) -> Model`` / ``Model.transform(df)`` pair whose
state is a small statistics DataFrame.  Nothing is evaluated on the driver except
tiny statistic tables whose size is checked before they are broadcast.
"""

from roadlens.session import get_session, ensure_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
