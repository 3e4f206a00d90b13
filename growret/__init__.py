"""growret: growth-versus-return analytics as Spark DataFrame operators.

Three analyses over four model tables (annual bars, monthly revenue growth,
weekly bars, price dates):

* return-bin heatmap  -- :mod:`growret.operators.heatmap`
* burst probability   -- :mod:`growret.operators.bursts`
* announcement timing -- :mod:`growret.operators.timing`

Every operator is a plain function from DataFrames to a DataFrame; nothing is
collected to the driver and no Python UDF runs in the hot path.
"""

from growret.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
