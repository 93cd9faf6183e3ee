from .columns import (
    cast_columns,
    columns_like,
    decay_weight,
    format_report,
    parse_date_columns,
    resolve_parent,
    split_group,
    zero_fill,
)

__all__ = [
    "cast_columns",
    "columns_like",
    "decay_weight",
    "format_report",
    "parse_date_columns",
    "resolve_parent",
    "split_group",
    "zero_fill",
]
