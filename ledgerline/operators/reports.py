"""Export of the five analyses as CSV reports, one folder per report."""

from __future__ import annotations

import os

from ledgerline.operators.concentration import customer_concentration
from ledgerline.operators.customers import customer_churn, customer_rfm
from ledgerline.operators.revenue import share_order_revenue
from ledgerline.operators.trends import monthly_growth, product_trend
from ledgerline.sources.csv import export_csv
from ledgerline.sources.model import SalesTables

REPORTS = {
    "customer_rfm": customer_rfm,
    "product_trend": product_trend,
    "monthly_growth": monthly_growth,
    "customer_concentration": customer_concentration,
    "customer_churn": customer_churn,
}
FROM_ORDERS = set(REPORTS) - {"product_trend"}    # start from the revenue per order


def export_reports(t: SalesTables, out_dir: str, names: tuple[str, ...] | None = None) -> dict[str, str]:
    """Write each analysis (sorted as the report defines) under ``out_dir``.

    Each report is written by all tasks in parallel into its own folder of
    part files (headered, UTF-8, ``NULL`` for nulls); nothing passes through
    the driver.  Order facts (revenue per order) are computed once and
    shared when two or more of the reports start from them.  Returns report name -> folder.
    """
    names = names or tuple(REPORTS)
    if t.order_facts is None and len(FROM_ORDERS.intersection(names)) > 1:
        t = share_order_revenue(t)
    written = {}
    for name in names:
        path = os.path.join(out_dir, name)
        export_csv(REPORTS[name](t), path)
        written[name] = path
    return written
