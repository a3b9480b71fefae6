from .scalar import (  # noqa: F401
    affine,
    cut,
    cut_order,
    days_since,
    flag_eq,
    flag_in,
    safe_ratio,
    weighted_score,
)
