"""Column-expression helpers (JVM-side, codegen-friendly)."""

from tempora.functions.expressions import (  # noqa: F401
    nan_to_null, epoch_us, floor_ts, ts_plus_seconds, horner, safe_corr,
    freq_seconds, EPOCH,
)
from tempora.functions.calendar import (  # noqa: F401
    anchored_quarter_end, whole_days,
)
