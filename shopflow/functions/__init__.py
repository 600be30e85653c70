"""Column expressions shared by the analyses (buckets, periods, channels, ratios)."""

from shopflow.functions.buckets import (  # noqa: F401
    at, before, after, between, bucket_columns, sunday_week, period_label)
from shopflow.functions.channels import channel_group, is_organic  # noqa: F401
from shopflow.functions.ratio import ratio, round_avg_half_up  # noqa: F401
