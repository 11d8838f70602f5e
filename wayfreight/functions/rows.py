"""Row selection on derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_if(df: DataFrame, keep: Column, derived: Sequence[Column], through: Sequence[str]) -> DataFrame:
    """Rows where ``keep`` holds: the columns in ``through`` as they are, and the ``derived`` ones.

    For predicates that took a scan of the text to decide. A plain filter would be pushed below the
    projections that derive the column, so the optimizer would put the whole classification into the
    filter and then run it again for the rows that pass. A generator that yields one row or none is
    not pushed, and each text is classified once.
    """
    one_or_none = F.when(keep, F.array(F.struct(*derived)))
    return df.select(*through, F.inline(one_or_none))
