"""User-level operators of the sales analyses."""

from ledgerline.operators.calendar import calendar_between, calendar_for, dim_date, fact_date_range
from ledgerline.operators.concentration import (
    concentration_frame,
    customer_concentration,
    customer_revenue,
    hhi_summary,
    pareto_cutoff,
)
from ledgerline.operators.customers import (
    customer_activity,
    customer_churn,
    customer_order_stats,
    customer_rfm,
    orphan_customers,
    reference_date,
)
from ledgerline.operators.reports import REPORTS, export_reports
from ledgerline.operators.revenue import (
    net_revenue_lines,
    order_revenue,
    orders_with_revenue,
    share_order_revenue,
)
from ledgerline.operators.distinct import distinct_by_period, orders_without_lines
from ledgerline.operators.fact_store import refresh_fact, store_fact, stored_fact
from ledgerline.operators.star import (
    dim_category,
    dim_customer,
    dim_product,
    fact_sales,
    fact_sales_load,
    register_star_views,
    star_rollup,
    star_rollup_sql,
)
from ledgerline.operators.trends import (
    monthly_growth,
    monthly_revenue,
    product_month_base,
    product_top,
    product_trend,
)

__all__ = [
    "dim_date", "calendar_for", "calendar_between", "fact_date_range", "concentration_frame",
    "customer_concentration", "customer_revenue", "hhi_summary",
    "pareto_cutoff", "customer_activity", "customer_churn", "customer_order_stats", "customer_rfm",
    "orphan_customers", "distinct_by_period", "orders_without_lines", "reference_date", "net_revenue_lines", "order_revenue", "orders_with_revenue",
    "share_order_revenue",
    "dim_category", "dim_customer", "dim_product", "fact_sales", "fact_sales_load",
    "store_fact", "refresh_fact", "stored_fact",
    "register_star_views", "star_rollup", "star_rollup_sql", "monthly_growth", "monthly_revenue",
    "product_month_base", "product_top", "product_trend", "REPORTS", "export_reports",
]
